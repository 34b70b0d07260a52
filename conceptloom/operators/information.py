"""Information content of concepts, and measures of pairs that rest on it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from conceptloom.operators.ontology import PAIR, common_ancestors, strict
from conceptloom.storage import materialise, shuffled

MEASURES = ("mica_information_content", "lin_measure", "jiang_measure", "information_coefficient", "relevance_measure", "graph_ic_measure")


def _from_frequencies(frequency: DataFrame, total: DataFrame, closure: DataFrame) -> DataFrame:
    """(concept, n), a one-row total and a closure to counts summed up the hierarchy."""
    rolled = closure.join(shuffled(frequency.withColumnRenamed("c", "descendant_concept_id")), "descendant_concept_id").groupBy(F.col("ancestor_concept_id").alias("concept_id")).agg(F.sum("n").alias("count"))
    share = F.col("count") / F.col("total")
    return rolled.crossJoin(F.broadcast(total)).select("concept_id", "count", (-F.log(share)).alias("information_content"), share.alias("probability"))


def information_content(events: DataFrame, closure: DataFrame) -> DataFrame:
    """(concept_id, count, information_content, probability). ``events`` still hold concept 0, which counts in the total only."""
    seen = events.select("person_id", "standard_concept_id").distinct()
    frequency = seen.where("standard_concept_id != 0").groupBy(F.col("standard_concept_id").alias("c")).agg(F.count(F.lit(1)).alias("n"))
    return _from_frequencies(frequency, seen.agg(F.count(F.lit(1)).alias("total")), closure)


def information_content_of(frequencies: DataFrame, closure: DataFrame) -> DataFrame:
    """The same from (standard_concept_id, count), over strict ancestors, with the sum of counts as the total."""
    frequency = frequencies.select(F.col("standard_concept_id").cast("bigint").alias("c"), F.col("count").cast("bigint").alias("n"))
    return _from_frequencies(frequency, frequency.agg(F.sum("n").alias("total")), strict(closure))


def _of_common_ancestors(pairs: DataFrame, content: DataFrame, closure: DataFrame) -> DataFrame:
    """One row per pair and common ancestor with known content: (pair, ancestor, ic, p)."""
    known = content.select(F.col("concept_id").alias("ancestor"), F.col("information_content").alias("ic"), F.col("probability").alias("p"))
    return common_ancestors(pairs, closure).select(*PAIR, "ancestor").join(shuffled(known), "ancestor")


def _content_above(content: DataFrame, closure: DataFrame) -> DataFrame:
    """(concept_id, above): the summed content of all distinct ancestors of a concept."""
    up = closure.select(F.col("descendant_concept_id").alias("concept_id"), F.col("ancestor_concept_id").alias("ancestor")).distinct()
    known = content.select(F.col("concept_id").alias("ancestor"), F.col("information_content").alias("ic"))
    return up.join(shuffled(known), "ancestor").groupBy("concept_id").agg(F.sum("ic").alias("above"))


def measures(pairs: DataFrame, content: DataFrame, closure: DataFrame, bag_union: bool = False, standard: bool = False) -> DataFrame:
    """``pairs`` with MEASURES. One aggregate over the common ancestors of a pair and the sums over those of each side give all of them.

    ``bag_union`` counts common ancestors twice in the graph measure's denominator; ``standard`` uses the sum of both contents in Lin's
    measure instead of their product. A zero denominator gives null.
    """
    content = materialise(content, "content")
    rows = _of_common_ancestors(pairs, content, closure).groupBy(*PAIR).agg(F.max("ic").alias("mica_information_content"), F.max("p").alias("_p"), F.sum("ic").alias("_shared"))
    own = content.select("concept_id", "information_content").join(shuffled(_content_above(content, closure)), "concept_id", "full")
    own = materialise(own, "content-above")
    of = lambda k: shuffled(own.toDF(f"concept_id_{k}", f"_ic{k}", f"_above{k}"))
    joined = pairs.drop(*MEASURES).join(shuffled(rows), PAIR, "left").join(of(1), "concept_id_1", "left").join(of(2), "concept_id_2", "left")
    zero = F.lit(0.0)
    either = F.coalesce("_above1", zero) + F.coalesce("_above2", zero) - (zero if bag_union else F.coalesce("_shared", zero))
    joined = joined.withColumn("_every", either)
    mica, ic1, ic2 = F.col("mica_information_content"), F.col("_ic1"), F.col("_ic2")
    lin = F.try_divide(2 * mica, ic1 + ic2 if standard else ic1 * ic2)
    return joined.select(
        *pairs.drop(*MEASURES).columns, mica, lin.alias("lin_measure"), (1 - (ic1 + ic2 - 2 * mica)).alias("jiang_measure"),
        (lin * (1 - F.try_divide(F.lit(1.0), 1 + mica))).alias("information_coefficient"), (lin * (1 - F.col("_p"))).alias("relevance_measure"),
        F.try_divide("_shared", "_every").alias("graph_ic_measure"),
    )


def common_contents(pairs: DataFrame, content: DataFrame, closure: DataFrame) -> DataFrame:
    """A row per pair and common ancestor, with the ancestor's content."""
    return _of_common_ancestors(pairs, content, closure).select(*PAIR, F.col("ancestor").alias("ancestor_concept_id"), F.col("ic").alias("mica_information_content"))


def diagnostics(measured: DataFrame, content: DataFrame) -> DataFrame:
    """Pairs with ``is_connected`` and MEASURES to those that a reader should look at, and why: ``unconnected`` ones, ``uninformative``
    ones (connected, but only by an ancestor without information), and those with an ancestor but ``unknown`` content of their own."""
    of = lambda k: shuffled(content.select(F.col("concept_id").alias(f"concept_id_{k}"), F.col("information_content").alias(f"_ic{k}")))
    rows = measured.join(of(1), "concept_id_1", "left").join(of(2), "concept_id_2", "left")
    mica = F.col("mica_information_content")
    found = {"unconnected": F.col("is_connected") == 0, "uninformative": (F.col("is_connected") == 1) & (mica == 0), "unknown": mica.isNotNull() & (F.col("_ic1").isNull() | F.col("_ic2").isNull())}
    why = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in found.items()]), lambda x: x.isNotNull())
    return rows.select("concept_id_1", "concept_id_2", "is_connected", "mica_information_content", "graph_ic_measure", F.explode(why).alias("finding"))
