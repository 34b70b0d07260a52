"""Order tables seen as clinical ones: customers are persons, parts are concepts, orders are visits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Concepts whose ancestors a task makes.
_NODES = 8192


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", F.to_date("l_shipdate").alias("day"))
    return lines.join(_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("person_id")), "l_orderkey")


def domain_tables(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Conditions, drugs and procedures by return flag, with the columns that clinical tables have."""
    shapes = (
        ("A", "condition_occurrence_id", "condition_concept_id", "condition_start_date"),
        ("N", "drug_exposure_id", "drug_concept_id", "drug_exposure_start_date"),
        ("R", "procedure_occurrence_id", "procedure_concept_id", "procedure_date"),
    )
    lines = _lines(spark, sf_dir)
    return [
        lines.where(F.col("l_returnflag") == flag).select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias(key), "person_id", F.col("l_partkey").alias(concept), F.col("day").alias(date), F.col("l_orderkey").alias("visit_occurrence_id"))
        for flag, key, concept, date in shapes
    ]


def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("visit_occurrence_id"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical events, repeated ones and concept 0 included."""
    domain = F.when(F.col("l_returnflag") == "A", "condition").when(F.col("l_returnflag") == "N", "drug").otherwise("procedure")
    return _lines(spark, sf_dir).select("person_id", F.col("l_partkey").alias("standard_concept_id"), F.col("day").alias("event_date"), F.col("l_orderkey").alias("visit_occurrence_id"), domain.alias("domain"))


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dealt out by concept before their ancestors are made, so aggregates and joins by concept need not shuffle the closure."""
    nodes = _table(spark, sf_dir, "part").where("p_partkey >= 1").select(F.col("p_partkey").alias("n"))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), nodes.count() // _NODES)
    return nodes.repartition(tasks, "n")


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The closure of the tree in which n >> 1 is the parent of n."""
    levels = _nodes(spark, sf_dir).select("n", F.explode(F.sequence(F.lit(0), F.lit(40))).alias("l")).withColumn("a", F.expr("shiftright(n, l)")).where("a >= 1")
    return levels.select(F.col("a").alias("ancestor_concept_id"), F.col("n").alias("descendant_concept_id"), F.col("l").alias("min_levels_of_separation"), F.col("l").alias("max_levels_of_separation"))


def dag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The closure of the graph in which n div 2 and n div 3 are parents of n."""
    # no more powers than a number has, give or take one that the last filter drops
    powers = lambda c, base, most: F.sequence(F.lit(0), F.least(F.lit(most), F.ceil(F.log(float(base), c)).cast("int") + 1))
    threes = F.array(*[F.lit(3**j).cast("bigint") for j in range(16)])
    rows = _nodes(spark, sf_dir).select("n", F.explode(powers(F.col("n"), 2, 24)).alias("i")).withColumn("h", F.expr("shiftright(n, i)")).where("h >= 1")
    rows = rows.select("n", "i", "h", F.explode(powers(F.col("h"), 3, 15)).alias("j")).withColumn("p", F.get(threes, F.col("j")))
    rows = rows.where("h >= p").withColumn("a", F.expr("h div p")).withColumn("l", F.col("i") + F.col("j"))
    return rows.groupBy(F.col("a").alias("ancestor_concept_id"), F.col("n").alias("descendant_concept_id")).agg(F.min("l").alias("min_levels_of_separation"), F.max("l").alias("max_levels_of_separation"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree(spark, sf_dir).where("min_levels_of_separation = 1").select(F.col("ancestor_concept_id").alias("parent"), F.col("descendant_concept_id").alias("child"))


def concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("p_type") == "SMALL", "Ingredient").otherwise(F.col("p_type"))
    return _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("concept_id"), F.col("p_name").alias("concept_name"), kind.alias("concept_class_id"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concept k with (7k + 3) mod the number of parts, where both are known and different, and their names."""
    parts = _table(spark, sf_dir, "part").select("p_partkey", "p_name")
    n = parts.agg(F.count(F.lit(1)).alias("n"))
    made = parts.where("p_partkey >= 1").crossJoin(F.broadcast(n)).select(F.col("p_partkey").alias("concept_id_1"), F.expr("(p_partkey * 7 + 3) % n").alias("concept_id_2"), F.col("p_name").alias("concept_name_1"))
    other = parts.select(F.col("p_partkey").alias("concept_id_2"), F.col("p_name").alias("concept_name_2"))
    return made.where("concept_id_2 >= 1 and concept_id_1 != concept_id_2").join(other.hint("merge"), "concept_id_2").select("concept_id_1", "concept_id_2", "concept_name_1", "concept_name_2")


def name_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = _table(spark, sf_dir, "part").select("p_name").distinct()
    return names.select(F.col("p_name").alias("name_1")).crossJoin(names.select(F.col("p_name").alias("name_2")))


def embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("standard_concept_id"), F.transform("embedding", lambda x: x.cast("double")).alias("vector"), "label")


def labelled_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors k and 7k + 3, modulo their number, with ground truth 1 if their labels are equal."""
    e = _table(spark, sf_dir, "embeddings").select("vec_id", "label")
    n = e.agg(F.count(F.lit(1)).alias("n"))
    one = e.crossJoin(F.broadcast(n)).select(F.col("vec_id").alias("concept_id_1"), F.expr("(vec_id * 7 + 3) % n").alias("concept_id_2"), F.col("label").alias("label_1"))
    two = e.select(F.col("vec_id").alias("concept_id_2"), F.col("label").alias("label_2"))
    return one.join(two, "concept_id_2").select("concept_id_1", "concept_id_2", (F.col("label_1") == F.col("label_2")).cast("int").alias("ground_truth"))
