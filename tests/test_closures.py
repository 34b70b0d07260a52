"""Joins with generated closures: never broadcast, and right for repeated rows and several roots."""

import pytest
from pyspark.sql import functions as F

from conceptloom.operators import events, information, ontology


@pytest.fixture
def closure(spark):
    rows = spark.range(1, 400).select(F.col("id").alias("n"), F.explode(F.sequence(F.lit(0), F.lit(9))).alias("l")).withColumn("a", F.expr("shiftright(n, l)")).where("a >= 1")
    return rows.select(F.col("a").alias("ancestor_concept_id"), F.col("n").alias("descendant_concept_id"), F.col("l").alias("min_levels_of_separation"), F.col("l").alias("max_levels_of_separation"))


@pytest.fixture
def pairs(spark):
    return spark.range(1, 400).select(F.col("id").alias("concept_id_1"), F.expr("id * 7 % 400").alias("concept_id_2"))


def broadcasts(df):
    return df._jdf.queryExecution().sparkPlan().toString().count("BroadcastHashJoin")


def test_distances_and_similarities_do_not_broadcast_the_closure(pairs, closure):
    assert broadcasts(ontology.min_distance(pairs, closure)) == 0
    assert broadcasts(ontology.semantic_similarity(pairs, closure)) <= 1  # the few roots


def test_repeated_rows_and_several_roots(spark):
    rows = [(1, 1, 0, 0), (2, 2, 0, 0), (1, 3, 1, 1), (2, 3, 1, 2), (1, 3, 1, 1), (3, 3, 0, 0), (3, 4, 1, 1), (3, 4, 2, 2), (4, 4, 0, 0), (3, 5, 1, 1), (5, 5, 0, 0), (2, 4, 2, 3), (2, 5, 2, 3)]
    closure = spark.createDataFrame(rows, "ancestor_concept_id long, descendant_concept_id long, min_levels_of_separation int, max_levels_of_separation int")
    pairs = spark.createDataFrame([(4, 5), (4, 5), (1, 2), (3, 3)], "concept_id_1 long, concept_id_2 long")
    assert sorted(map(tuple, ontology.common_ancestors(pairs, closure).collect())) == [(3, 3, 1, 1, 1), (3, 3, 2, 1, 1), (3, 3, 3, 0, 0), (4, 5, 2, 2, 2), (4, 5, 3, 1, 1)]
    got = sorted(map(tuple, ontology.semantic_similarity(pairs, closure).collect()), key=str)
    assert got == [(1, 2, None, 0), (3, 3, 1.0, 1), (4, 5, 4 / 6, 1), (4, 5, 4 / 6, 1)]


def test_roll_up_does_not_broadcast_the_closure(spark, closure):
    drugs = spark.range(1, 400).select(F.col("id").alias("drug_concept_id"), (F.col("id") % 9).alias("person_id"))
    concept = spark.range(1, 400).select(F.col("id").alias("concept_id"), F.when(F.col("id") % 3 == 0, "Ingredient").otherwise("Brand").alias("concept_class_id"))
    assert broadcasts(events.roll_up_to_ingredients(drugs, concept, closure)) == 0


def test_contents_and_measures_do_not_broadcast_the_closure(spark, pairs, closure):
    rows = spark.range(1, 400).select((F.col("id") % 7).alias("person_id"), F.col("id").alias("standard_concept_id"))
    content = information.information_content(rows, closure)
    assert broadcasts(content) == 0
    assert broadcasts(information.common_contents(pairs, content, closure)) == 0
    assert broadcasts(information.information_content_of(content.select(F.col("concept_id").alias("standard_concept_id"), "count"), closure)) == 0
    assert broadcasts(information.measures(pairs, content, closure)) == 0
