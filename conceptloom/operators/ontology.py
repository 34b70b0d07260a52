"""Concept hierarchies as transitive closures (ancestor_concept_id, descendant_concept_id, min and max levels), self rows included."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from conceptloom.storage import materialise, shuffled

PAIR = ["concept_id_1", "concept_id_2"]


def typed(closure: DataFrame) -> DataFrame:
    return closure.select(*[F.col(c).cast("bigint").alias(c) for c in ("ancestor_concept_id", "descendant_concept_id")], *[F.col(c).cast("int").alias(c) for c in ("min_levels_of_separation", "max_levels_of_separation")])


def strict(closure: DataFrame) -> DataFrame:
    return closure.where("min_levels_of_separation >= 1")


def closure_of(edges: DataFrame, max_depth: int = 64) -> DataFrame:
    """Edges (parent, child) of an acyclic graph to its closure, a level at a time; each level is written, so plans stay small."""
    nodes = edges.select(F.col("parent").alias("n")).unionByName(edges.select(F.col("child").alias("n"))).distinct()
    reached = nodes.select(F.col("n").alias("a"), F.col("n").alias("d"), F.lit(0).alias("level"))
    frontier, levels = reached, [reached]
    for level in range(1, max_depth + 1):
        frontier = materialise(frontier.join(edges, F.col("d") == F.col("parent")).select("a", F.col("child").alias("d"), F.lit(level).alias("level")).distinct(), "closure")
        if frontier.isEmpty():
            break
        levels.append(frontier)
    else:
        raise ValueError(f"deeper than {max_depth} levels, or cyclic")
    rows = levels[0]
    for more in levels[1:]:
        rows = rows.unionByName(more)
    return rows.groupBy(F.col("a").alias("ancestor_concept_id"), F.col("d").alias("descendant_concept_id")).agg(F.min("level").alias("min_levels_of_separation"), F.max("level").alias("max_levels_of_separation"))


def roots(closure: DataFrame) -> DataFrame:
    """Concepts whose only closure row is their own."""
    return closure.groupBy("descendant_concept_id").count().where("count = 1").select(F.col("descendant_concept_id").alias("concept_id"))


def common_ancestors(pairs: DataFrame, closure: DataFrame) -> DataFrame:
    """Distinct pairs to (pair, ancestor, d1, d2), one row each: least levels to each common ancestor.

    The ancestors of a concept travel as two arrays, so the shuffles carry a row per pair instead of one per pair and ancestor.
    """
    by_concept = closure.groupBy("descendant_concept_id").agg(F.array_sort(F.collect_list(F.struct("ancestor_concept_id", "min_levels_of_separation"))).alias("s"))
    lists = by_concept.select("descendant_concept_id", F.col("s.ancestor_concept_id").alias("up"), F.col("s.min_levels_of_separation").alias("levels"))
    first = shuffled(pairs.select(*PAIR).distinct()).join(shuffled(lists.toDF("concept_id_1", "up1", "levels1")), "concept_id_1")
    both = first.join(shuffled(lists.toDF("concept_id_2", "up2", "levels2")), "concept_id_2")
    each = both.select(*PAIR, F.explode(F.arrays_zip(F.col("up1").alias("ancestor"), F.col("levels1").alias("d1"))).alias("x"), "up2", "levels2")
    # the lists are sorted, so of a repeated ancestor the least level comes first
    at = each.select(*PAIR, "x.ancestor", "x.d1", F.array_position("up2", F.col("x.ancestor")).cast("int").alias("at"), "levels2").where("at > 0")
    return at.select(*PAIR, "ancestor", "d1", F.get("levels2", F.col("at") - 1).alias("d2")).groupBy(*PAIR, "ancestor").agg(F.min("d1").alias("d1"), F.min("d2").alias("d2"))


#: Roots that are sent to every executor; more are joined by a shuffle.
FEW_ROOTS = 100_000


def semantic_similarity(pairs: DataFrame, closure: DataFrame, name: str = "semantic_similarity") -> DataFrame:
    """``name`` and ``is_connected``: the best 2r / (2r + d1 + d2) over common ancestors that are not roots, r being the most levels
    from a root down to the ancestor; null and 0 where only roots are shared."""
    top = materialise(roots(closure).select(F.col("concept_id").alias("ancestor_concept_id")), "roots")
    top = F.broadcast(top) if top.count() <= FEW_ROOTS else shuffled(top)
    depth = closure.where("ancestor_concept_id != descendant_concept_id").join(top, "ancestor_concept_id", "left_semi")
    depth = depth.groupBy(F.col("descendant_concept_id").alias("ancestor")).agg(F.max("max_levels_of_separation").alias("r"))
    r2 = F.col("r") * 2
    best = common_ancestors(pairs, closure).join(shuffled(depth), "ancestor").groupBy(*PAIR).agg(F.max(r2 / (r2 + F.col("d1") + F.col("d2"))).alias(name))
    return pairs.drop(name, "is_connected").join(shuffled(best), PAIR, "left").withColumn("is_connected", F.col(name).isNotNull().cast("int"))


def min_distance(pairs: DataFrame, closure: DataFrame, name: str = "min_distance") -> DataFrame:
    """The fewest levels between the two concepts by way of a common ancestor."""
    best = common_ancestors(pairs, closure).groupBy(*PAIR).agg(F.min(F.col("d1") + F.col("d2")).alias(name))
    return pairs.drop(name).join(shuffled(best), PAIR, "left")


def paths(edges: DataFrame, max_depth: int = 64) -> DataFrame:
    """(concept_id, path): every path from a root down to each concept that has a parent. Numbers of paths may grow with the depth."""
    children = edges.select("child").distinct()
    top = edges.select(F.col("parent").alias("concept_id")).distinct().join(children, F.col("concept_id") == F.col("child"), "left_anti")
    frontier, found = top.select("concept_id", F.array("concept_id").alias("path")), None
    for _ in range(max_depth):
        frontier = frontier.join(edges, F.col("concept_id") == F.col("parent")).select(F.col("child").alias("concept_id"), F.concat("path", F.array("child")).alias("path"))
        frontier = materialise(frontier, "paths")
        if frontier.isEmpty():
            return found if found is not None else frontier
        found = frontier if found is None else found.unionByName(frontier)
    raise ValueError(f"deeper than {max_depth} levels, or cyclic")


def path_similarity(pairs: DataFrame, edges: DataFrame, name: str = "path_score") -> DataFrame:
    """The best 2 * shared / (length + length) over pairs of paths, shared being their common beginning; 0 without paths."""
    known = paths(edges)
    a, b = known.toDF("concept_id_1", "path_1"), known.toDF("concept_id_2", "path_2")
    shared = F.aggregate(
        F.zip_with("path_1", "path_2", lambda x, y: F.coalesce(x == y, F.lit(False))),
        F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")),
        lambda s, same: F.struct((s["n"] + F.when(s["on"] & same, 1).otherwise(0)).alias("n"), (s["on"] & same).alias("on")),
        lambda s: s["n"],
    )
    score = 2.0 * shared / (F.size("path_1") + F.size("path_2"))
    best = pairs.select(*PAIR).distinct().join(a, "concept_id_1").join(b, "concept_id_2").groupBy(*PAIR).agg(F.max(score).alias(name))
    return pairs.drop(name).join(best, PAIR, "left").withColumn(name, F.coalesce(name, F.lit(0.0)))
