"""Concept embeddings (standard_concept_id, vector array<double>): parsing, joining, distances and their statistics."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from conceptloom.functions import vectors as V
from conceptloom.storage import materialise

BLOCK = 512


def target_context_mean(vocabulary: DataFrame, weights: DataFrame) -> DataFrame:
    """(id, standard_concept_id) and (wordId, vector) to embeddings: the mean of the target vector ``id`` and the context vector
    ``id + N``, N being the size of the vocabulary, which is joined as a one-row table."""
    size = vocabulary.agg(F.count(F.lit(1)).alias("_n"))
    v = vocabulary.select("id", "standard_concept_id").crossJoin(F.broadcast(size)).withColumn("_context", F.col("id") + F.col("_n"))
    target = weights.select(F.col("wordId").alias("id"), F.col("vector").alias("_target"))
    context = weights.select(F.col("wordId").alias("_context"), F.col("vector").alias("_vector"))
    return v.join(target, "id").join(context, "_context").select("standard_concept_id", V.mean_of(F.col("_target"), F.col("_vector")).alias("vector"))


def with_dictionary(dictionary: DataFrame, vectors: DataFrame) -> DataFrame:
    """(id, standard_concept_id) and (id, vector) to embeddings."""
    return dictionary.join(vectors, "id").select(F.col("standard_concept_id").cast("int").alias("standard_concept_id"), "vector")


def pair_vectors(pairs: DataFrame, embedding: DataFrame, how: str) -> DataFrame:
    of = lambda k: embedding.select(F.col("standard_concept_id").alias(f"concept_id_{k}"), F.col("vector").alias(f"_v{k}"))
    return pairs.join(of(1), "concept_id_1", how).join(of(2), "concept_id_2", how)


def cosine_of_pairs(pairs: DataFrame, embedding: DataFrame, name: str) -> DataFrame:
    """The cosine, 0 where a vector is missing, NaN where one is zero."""
    known = F.col("_v1").isNotNull() & F.col("_v2").isNotNull()
    return pair_vectors(pairs.drop(name), embedding, "left").select(*pairs.drop(name).columns, F.when(known, V.cosine(F.col("_v1"), F.col("_v2"))).otherwise(0.0).alias(name))


#: Blocks of the right side that a task of the grid holds.
SIDE = 64


def _grid(embedding: DataFrame) -> DataFrame:
    """Every block of about BLOCK vectors beside every block, as (l_ids, l_vectors, r_ids, r_vectors) in bytes.

    Blocks are packed by hash of the id and written once; their number follows that of the vectors. Each side is dealt out once and a
    Cartesian product reads it from there, so what is shuffled is the blocks and not their pairs.
    """
    n = max(1, -(-embedding.count() // BLOCK))

    def pack(block: pa.Table) -> pa.Table:
        ids = block["standard_concept_id"].to_numpy().astype("<i8").tobytes()
        vectors = np.stack(block["vector"].to_numpy()).astype("<f8").tobytes()
        return pa.table({"ids": pa.array([ids], pa.binary()), "vectors": pa.array([vectors], pa.binary())})

    keyed = embedding.select(F.col("standard_concept_id").cast("bigint").alias("standard_concept_id"), "vector", F.pmod(F.xxhash64("standard_concept_id"), F.lit(n)).alias("block"))
    blocks = materialise(keyed.groupBy("block").applyInArrow(pack, "ids binary, vectors binary"), "blocks")
    left = blocks.repartition(n).toDF("l_ids", "l_vectors")
    return left.crossJoin(blocks.repartition(-(-n // SIDE)).toDF("r_ids", "r_vectors"))


def _matrix(ids: bytes, vectors: bytes) -> tuple[np.ndarray, np.ndarray]:
    i = np.frombuffer(ids, "<i8")
    return i, np.frombuffer(vectors, "<f8").reshape(len(i), -1)


def _taken(i: np.ndarray, j: np.ndarray) -> bool:
    """Of the two orders of different blocks one, dealt evenly over both sides; a block has its first id alone."""
    a, b = int(i[0]), int(j[0])
    return a == b or (a < b) == ((a + b) % 2 == 0)


def _cells(batches: Iterator[pa.RecordBatch], metric: str, once: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of each pair of blocks, or with ``once`` only of one of its orders, the ids of both and their distances."""
    for batch in batches:
        for cell in zip(*batch.columns, strict=True):
            l_ids, l_vectors, r_ids, r_vectors = (x.as_py() for x in cell)
            (i, a), (j, b) = _matrix(l_ids, l_vectors), _matrix(r_ids, r_vectors)
            if not once or _taken(i, j):
                yield i, j, _metric(a, b, metric)


def _metric(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    if metric == "cosine":
        size = np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1)[None, :]
        with np.errstate(invalid="ignore", divide="ignore"):
            return (a @ b.T) / size
    return np.sqrt(np.stack([((b - x) ** 2).sum(axis=1) for x in a]))


def pairwise(embedding: DataFrame, metric: str, nearest: int | None = None, ascending: bool = True) -> DataFrame:
    """(concept_id_1, concept_id_2, metric) of all ordered pairs, the diagonal included.

    Blocks of vectors meet blocks, so a task holds two blocks and their distances. With ``nearest`` a block keeps only that many
    other concepts for each of its own, which bounds what is shuffled for a ranking. Without it the distances of two blocks are made
    once, and a vector's row comes in one direction and then in the other, so that a file's compression finds it again.
    """
    if metric not in ("cosine", "euclidean"):
        raise ValueError(metric)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for i, j, m in _cells(batches, metric, once=nearest is None):
            if nearest is None:
                ways = 1 if i[0] == j[0] else 2
                here, there = np.repeat(i, len(j)).reshape(m.shape), np.tile(j, (len(i), 1))
                c1, c2, both = (np.stack(x[:ways], axis=1).ravel() for x in ([here, there], [there, here], [m, m]))
                yield pa.RecordBatch.from_arrays([pa.array(c1), pa.array(c2), pa.array(both)], names=["concept_id_1", "concept_id_2", "metric"])
            else:
                key = np.where(i[:, None] == j[None, :], np.inf, m if ascending else -m)
                top = np.stack([np.lexsort((j, row))[: nearest + 1] for row in np.round(key, 12)])
                rows, cols = np.repeat(np.arange(len(i)), top.shape[1]), top.ravel()
                keep = i[rows] != j[cols]
                rows, cols = rows[keep], cols[keep]
                yield pa.RecordBatch.from_arrays([pa.array(i[rows]), pa.array(j[cols]), pa.array(m[rows, cols])], names=["concept_id_1", "concept_id_2", "metric"])

    return _grid(embedding).mapInArrow(of, "concept_id_1 long, concept_id_2 long, metric double")


def nearest(embedding: DataFrame, k: int = 10, metric: str = "euclidean", ascending: bool = True) -> DataFrame:
    """The k closest other concepts of each concept; ties go to the smaller id."""
    near = pairwise(embedding, metric, k, ascending)
    value = F.round("metric", 12)
    rank = F.row_number().over(Window.partitionBy("concept_id_1").orderBy(value.asc() if ascending else value.desc(), "concept_id_2"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k)


def distance_between(distances: DataFrame, c1: int, c2: int) -> DataFrame:
    """One row, or none for unknown concepts."""
    return distances.where((F.col("concept_id_1") == c1) & (F.col("concept_id_2") == c2))


def among(distances: DataFrame, concepts: DataFrame, keep_same: bool = True) -> DataFrame:
    """The long form of the part of a matrix whose concepts (concept_id) are listed; unlisted and unknown ones drop out."""
    ids = concepts.select("concept_id").distinct()
    one, two = (ids.withColumnRenamed("concept_id", f"concept_id_{k}") for k in (1, 2))
    part = distances.join(one, "concept_id_1", "left_semi").join(two, "concept_id_2", "left_semi")
    return part if keep_same else part.where("concept_id_1 != concept_id_2")


def distance_statistics(distances: DataFrame, concepts: DataFrame, keep_same: bool = True) -> DataFrame:
    """One row: mean, q25, median, q75 of the distances among listed concepts, and how many are known and missing. A concept that is
    listed twice counts as missing once."""
    part = among(distances, concepts, keep_same)
    stats = part.agg(F.avg("metric").alias("mean"), *[F.percentile("metric", q).alias(n) for q, n in ((0.25, "q25"), (0.5, "median"), (0.75, "q75"))])
    known = distances.select(F.col("concept_id_1").alias("concept_id")).distinct()
    listed = concepts.agg(F.count("concept_id").alias("_listed"))
    found = concepts.select("concept_id").distinct().join(known, "concept_id", "left_semi").agg(F.count(F.lit(1)).alias("num_of_concepts"))
    return stats.crossJoin(found).crossJoin(listed).withColumn("num_of_missings", F.col("_listed") - F.col("num_of_concepts")).drop("_listed")


#: Bins of the histogram by which quantiles are found.
BINS = 1 << 18
QUANTILES = {"q25": 0.25, "median": 0.5, "q75": 0.75}


def statistics_among(embedding: DataFrame, concepts: DataFrame, metric: str = "euclidean", keep_same: bool = True) -> DataFrame:
    """distance_statistics() of the listed concepts (concept_id) without a row per pair: exact, in three passes over the blocks.

    The first pass sums the distances up and finds their range, the second counts them in bins of it, the third counts the different
    values of those bins that hold the wanted ranks. Distances that are no finite numbers come last, as in an ordered column.
    """
    spark = embedding.sparkSession
    ids = concepts.select(F.col("concept_id").alias("standard_concept_id")).distinct()
    listed = materialise(embedding.join(ids, "standard_concept_id", "left_semi"), "listed")
    grid = _grid(listed)

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for i, j, m in _cells(batches, metric):
            yield m.ravel() if keep_same else m[i[:, None] != j[None, :]]

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for m in values(batches):
            finite = m[np.isfinite(m)]
            yield pa.RecordBatch.from_pylist([{"n": len(m), "total": float(m.sum()), "low": float(finite.min()) if len(finite) else None, "high": float(finite.max()) if len(finite) else None}])

    summed = grid.mapInArrow(ranges, "n long, total double, low double, high double").agg(F.sum("n"), F.sum("total"), F.min("low"), F.max("high")).first()
    n, total, low, high = summed[0] or 0, summed[1], summed[2] or 0.0, summed[3] or 0.0
    step = (high - low) / BINS

    def bins_of(m: np.ndarray) -> np.ndarray:
        with np.errstate(invalid="ignore"):
            at = np.floor((m - low) / step) if step > 0 else np.zeros(len(m))
        return np.where(np.isfinite(m), np.clip(np.nan_to_num(at), 0, BINS - 1), BINS).astype(np.int64)

    def histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BINS + 1, np.int64)
        for m in values(batches):
            counts += np.bincount(bins_of(m), minlength=BINS + 1)
        bins = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(bins), pa.array(counts[bins])], names=["bin", "n"])

    places = {name: q * (n - 1) for name, q in QUANTILES.items()} if n else {}
    ranks = sorted({f(p) for p in places.values() for f in (math.floor, math.ceil)})
    found: dict[int, float] = {}
    if ranks:
        counted = sorted(map(tuple, grid.mapInArrow(histogram, "bin long, n long").groupBy("bin").agg(F.sum("n")).collect()))
        ends = np.cumsum([c for _, c in counted])
        at = [int(np.searchsorted(ends, r, side="right")) for r in ranks]
        inside = [(r, counted[k][0], r - int(ends[k]) + counted[k][1]) for r, k in zip(ranks, at, strict=True)]
        chosen = np.array(sorted({b for _, b, _ in inside}))

        def chosen_values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for m in values(batches):
                bins = bins_of(m)
                keep = np.isin(bins, chosen)
                for b in np.unique(bins[keep]):
                    value, times = np.unique(m[keep & (bins == b)], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(value), b)), pa.array(value), pa.array(times)], names=["bin", "metric", "n"])

        several = grid.mapInArrow(chosen_values, "bin long, metric double, n long").groupBy("bin", "metric").agg(F.sum("n").alias("n"))
        through = F.sum("n").over(Window.partitionBy("bin").orderBy("metric").rowsBetween(Window.unboundedPreceding, 0))
        wanted = F.broadcast(spark.createDataFrame(inside, "rank long, bin long, inside long"))
        hit = several.withColumn("through", through).join(wanted, "bin").where("inside < through and inside >= through - n")
        found = {r.rank: r.metric for r in hit.select("rank", "metric").collect()}

    def quantile(p: float) -> float:
        below, above = math.floor(p), math.ceil(p)
        return found[below] if found[below] == found[above] else (above - p) * found[below] + (p - below) * found[above]

    known, asked = listed.select("standard_concept_id").distinct().count(), concepts.agg(F.count("concept_id")).first()[0]
    row = (total / n if n else None, *[quantile(places[q]) if n else None for q in QUANTILES], known, asked - known)
    return spark.createDataFrame([row], f"mean double, {', '.join(f'{q} double' for q in QUANTILES)}, num_of_concepts long, num_of_missings long")


def random_concepts(embedding: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """k concepts drawn without replacement: those with the smallest hashes of seed and id."""
    drawn = F.md5(F.concat(F.lit(f"{seed}:"), F.col("concept_id").cast("string")))
    return embedding.select(F.col("standard_concept_id").alias("concept_id")).orderBy(drawn, "concept_id").limit(k)


def recall_precision(reference: DataFrame, embedding: DataFrame, above: float = 0.5) -> DataFrame:
    """Pairs with ``ground_truth`` to one row: recall and precision of predicting 1 for cosines over ``above``; pairs without both
    vectors do not count, and an empty denominator gives null."""
    scored = pair_vectors(reference, embedding, "inner")
    yes, truth = V.cosine(F.col("_v1"), F.col("_v2")) > above, F.col("ground_truth") == 1
    count = lambda c: F.count_if(c)
    counts = scored.agg(count(yes & truth).alias("tp"), count(yes & ~truth).alias("fp"), count(~yes & truth).alias("fn"))
    return counts.select(F.try_divide("tp", F.col("tp") + F.col("fn")).alias("recall"), F.try_divide("tp", F.col("tp") + F.col("fp")).alias("precision"))


def shared_vocabulary(embeddings: list[DataFrame]) -> DataFrame:
    """Concepts that every embedding has."""
    ids = [e.select("standard_concept_id") for e in embeddings]
    return reduce(lambda a, b: a.join(b, "standard_concept_id", "left_semi"), ids[1:], ids[0]).distinct()


def restrict(embedding: DataFrame, vocabulary: DataFrame) -> DataFrame:
    return embedding.join(vocabulary.select("standard_concept_id"), "standard_concept_id", "left_semi")


def restrict_pairs(pairs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    for c in ("concept_id_1", "concept_id_2"):
        pairs = pairs.join(vocabulary.select(F.col("standard_concept_id").alias(c)), c, "left_semi")
    return pairs


def max_pool(members: DataFrame, embedding: DataFrame, key: str) -> DataFrame:
    """(key, standard_concept_id) to the element-wise maximum over the distinct concepts that have a vector. The maxima of places
    are partial aggregates, so no group is gathered."""
    spread = members.select(key, "standard_concept_id").distinct().join(embedding, "standard_concept_id").select(key, F.posexplode("vector").alias("at", "x"))
    tops = spread.groupBy(key, "at").agg(F.max("x").alias("x"))
    return tops.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda s: s["x"]).alias("vector"))


def tagged(embedding: DataFrame, concepts: DataFrame, source: str, phenotype: str) -> DataFrame:
    """The vectors of listed concepts, tagged with where they come from and what they stand for."""
    ids = concepts.select(F.col("concept_id").alias("standard_concept_id"))
    return embedding.join(ids, "standard_concept_id", "left_semi").withColumns({"source": F.lit(source), "phenotype": F.lit(phenotype)})


def with_names(rows: DataFrame, concept: DataFrame, key: str = "standard_concept_id") -> DataFrame:
    return rows.join(concept.select(F.col("concept_id").alias(key), "concept_name"), key)


def plot_frame(points: DataFrame, tagged_rows: DataFrame, concept: DataFrame) -> DataFrame:
    """(standard_concept_id, x, y) and tagged() rows to what a plot shows: coordinates, source, phenotype and concept_name."""
    tags = tagged_rows.select("standard_concept_id", "source", "phenotype")
    return with_names(points.join(tags, "standard_concept_id"), concept).select("standard_concept_id", "x", "y", "source", "phenotype", "concept_name")


def in_box(points: DataFrame, x: tuple[float, float], y: tuple[float, float]) -> DataFrame:
    """Points strictly inside a box of the plane."""
    return points.where((F.col("x") > x[0]) & (F.col("x") < x[1]) & (F.col("y") > y[0]) & (F.col("y") < y[1]))
