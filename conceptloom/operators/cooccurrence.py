"""Concept occurrence and co-occurrence.

Pairs are made once, with the smaller concept first, and mirrored at the end: half the joined rows of a plain self-join. Rows are
made distinct before they are joined where only persons are counted. The joins keep the person as an equality key, so that AQE can split
persons with many events.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conceptloom.operators.events import mapped
from conceptloom.storage import materialise, shuffled


def occurrence(events: DataFrame, first_id: int = 1) -> DataFrame:
    """(id, standard_concept_id, count): distinct persons of each mapped concept; ids are dense in the order of concepts.

    The ranking window runs over one row per concept.
    """
    counts = mapped(events).select("person_id", "standard_concept_id").distinct().groupBy("standard_concept_id").agg(F.count(F.lit(1)).alias("count"))
    return _numbered(counts, first_id)


def _numbered(counts: DataFrame, first_id: int = 1) -> DataFrame:
    rank = F.dense_rank().over(Window.orderBy("standard_concept_id")) + (first_id - 1)
    return counts.select(rank.cast("bigint").alias("id"), "standard_concept_id", "count")


def _mirrored(pairs: DataFrame, *values: str) -> DataFrame:
    a, b = F.col("c1"), F.col("c2")
    both = F.array(F.struct(a.alias("c1"), b.alias("c2")), F.struct(b.alias("c1"), a.alias("c2")))
    return pairs.select(F.explode(both).alias("p"), *values).select("p.c1", "p.c2", *values)


def _persons_of_pairs(joined: DataFrame, once: bool = False) -> DataFrame:
    """``once``: a person has each pair once already, so there is nothing to make distinct."""
    rows = joined.select("person_id", "c1", "c2")
    return (rows if once else rows.distinct()).groupBy("c1", "c2").agg(F.count(F.lit(1)).alias("count"))


def _of_wanted(rows: DataFrame, wanted: DataFrame, keys: list[str], near: str | None = None) -> DataFrame:
    """(person_id, c1 < c2): the wanted pairs (concept_id_1, concept_id_2) that ``rows`` with equal ``keys`` hold, ``near`` being a
    condition on the days of both.

    Each pair starts from the rows of its rarer concept and looks for the other one with the same keys, so what is made follows the
    events of rare concepts, not the pairs of a person's events.
    """
    counts = rows.groupBy("standard_concept_id").agg(F.count(F.lit(1)).alias("n"))
    of = lambda k: shuffled(counts.toDF(f"c{k}", f"n{k}"))
    a, b = F.col("concept_id_1"), F.col("concept_id_2")
    pairs = wanted.select(F.least(a, b).alias("c1"), F.greatest(a, b).alias("c2")).where("c1 < c2").distinct().join(of(1), "c1").join(of(2), "c2")
    first = F.col("n1") <= F.col("n2")
    sides = pairs.select(F.when(first, F.col("c1")).otherwise(F.col("c2")).alias("rare"), F.when(first, F.col("c2")).otherwise(F.col("c1")).alias("other"))
    day = ["day"] if near else []
    named = lambda concept, k: rows.select(*keys, F.col("standard_concept_id").alias(concept), *[F.col(d).alias(f"{d}{k}") for d in day])
    met = named("rare", 1).join(shuffled(sides), "rare").join(shuffled(named("other", 2)), [*keys, "other"])
    met = met.where(near) if near else met
    return met.select("person_id", F.least("rare", "other").alias("c1"), F.greatest("rare", "other").alias("c2"))


def pairs_in_windows(windowed: DataFrame, window: str | None = "time_window", wanted: DataFrame | None = None) -> DataFrame:
    """(c1 < c2, count): persons with both concepts in one window. Without a window any two events of a person meet, and distinct
    events make distinct pairs. With ``wanted`` pairs no others are made."""
    keys = ["person_id"] + ([window] if window else [])
    rows = mapped(windowed).select(*keys, "standard_concept_id").distinct()
    if wanted is not None:
        return _persons_of_pairs(_of_wanted(rows, wanted, keys), once=window is None)
    a, b = rows.withColumnRenamed("standard_concept_id", "c1"), rows.withColumnRenamed("standard_concept_id", "c2")
    return _persons_of_pairs(a.join(b, keys).where("c1 < c2"), once=window is None)


def pairs_in_span(events: DataFrame, days: int, wanted: DataFrame | None = None) -> DataFrame:
    """(c1 < c2, count): persons with both concepts at most ``days`` apart.

    Days are dealt into bins of ``days``: events that near are in one bin or the next, so a person's events meet only those of two
    bins on either side instead of all. With ``wanted`` pairs no others are made.
    """
    width = max(days, 1)
    rows = mapped(events).select("person_id", "standard_concept_id", F.unix_date("event_date").alias("day")).distinct()
    if wanted is not None:
        return _persons_of_pairs(_of_wanted(rows, wanted, ["person_id"], f"abs(day1 - day2) <= {days}"))
    a = rows.select("person_id", F.col("standard_concept_id").alias("c1"), F.col("day").alias("day1"), F.floor(F.col("day") / width).alias("bin"))
    near = F.explode(F.array(*[F.floor(F.col("day") / width) + k for k in (-1, 0, 1)]))
    b = rows.select("person_id", F.col("standard_concept_id").alias("c2"), F.col("day").alias("day2"), near.alias("bin"))
    return _persons_of_pairs(a.join(b, ["person_id", "bin"]).where(f"c1 < c2 and abs(day1 - day2) <= {days}"))


def _blocks_of(rows: DataFrame) -> int:
    """Blocks of concepts, so that there are about two pairs of blocks for each shuffle partition."""
    return math.ceil(math.sqrt(4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


#: Rows of a block that are sent to a task at once, pairs that a task counts at once, and pairs that it returns at once.
PART, COUNTED, RETURNED = 1 << 18, 1 << 20, 1 << 16
_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def _packed(rows: pa.Table, known: pa.Table, parts: int) -> pa.Table:
    """A block: its concepts in order with their ids and counts, and in each part of the persons those that have some, in order, how
    many each has, and which."""
    known = known.sort_by("c")
    person, at = rows["person"].to_numpy(), np.searchsorted(known["c"].to_numpy(), rows["c"].to_numpy()).astype("<u4")
    order = np.lexsort((at, person))
    names, k = np.unique(person, return_counts=True)
    at = at[order]
    of = names % parts
    out = []
    for part in range(parts):
        mine = of == part
        concepts = [known[x].to_numpy().astype("<i8").tobytes() if part == 0 else b"" for x in ("c", "id", "n")]
        out.append([part, *concepts, names[mine].astype("<i8").tobytes(), k[mine].astype("<u4").tobytes(), at[np.repeat(mine, k)].tobytes()])
    block = pa.array([known["block"][0].as_py()] * parts, pa.int32())
    return pa.table([block, pa.array([x[0] for x in out], pa.int32()), *[pa.array([x[k] for x in out], pa.binary()) for k in range(1, 7)]], names=["block", "part", "c", "id", "n", "persons", "k", "at"])


def _block_of(rows: list[tuple]) -> tuple:
    """The concepts, ids and counts of a block and, by part, its persons, how many concepts each has and where they start in the last."""
    c, i, n = (np.frombuffer(b"".join(r[k] for r in rows), "<i8") for k in (1, 2, 3))
    held, start = {}, 0
    for part, _, _, _, persons, k, _ in rows:
        k = np.frombuffer(k, "<u4").astype(np.int64)
        held[part] = np.frombuffer(persons, "<i8"), k, start + np.cumsum(k) - k
        start += int(k.sum())
    return c, i, n, held, np.frombuffer(b"".join(r[6] for r in rows), "<u4").astype(np.int64)


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each start, as many as its size."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())


def _counted(left: tuple, right: tuple, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(place in left, place in right, persons) of the concepts that a person has in both blocks, a bounded number of pairs at a time."""
    (*_, of_left, at_left), (c_right, *_, of_right, at_right) = left, right
    mine, start, size = [], [], []
    for part, (persons, k, first) in of_left.items():
        others, k_other, first_other = of_right[part]
        _, i, j = np.intersect1d(persons, others, assume_unique=True, return_indices=True)
        mine.append(_ranges(first[i], k[i]))
        start.append(np.repeat(first_other[j], k[i]))
        size.append(np.repeat(k_other[j], k[i]))
    mine, start, size = at_left[np.concatenate(mine)], np.concatenate(start), np.concatenate(size)
    order = np.argsort(mine, kind="stable")
    mine, start, size = mine[order], start[order], size[order]
    ends = np.flatnonzero(np.diff(mine, append=-1)) + 1  # a concept's rows stay together
    made, low = np.cumsum(size)[ends - 1], 0
    while low < len(ends):
        high = max(low + 1, int(np.searchsorted(made, (made[low - 1] if low else 0) + COUNTED, side="right")))
        rows = slice(ends[low - 1] if low else 0, ends[high - 1])
        a, b = np.repeat(mine[rows], size[rows]), at_right[_ranges(start[rows], size[rows])]
        codes, persons = np.unique((a * len(c_right) + b)[a < b] if same else a * len(c_right) + b, return_counts=True)
        yield codes // len(c_right), codes % len(c_right), persons
        low = high


def _partners(of: tuple, others: tuple, a: np.ndarray, b: np.ndarray, persons: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Each concept ``a`` with all its partners ``b`` and their counts; ``a`` is in order."""
    for low in range(0, len(a), RETURNED):
        x, y, k = a[low : low + RETURNED], b[low : low + RETURNED], persons[low : low + RETURNED]
        first = np.flatnonzero(np.diff(x, prepend=-1))
        normalized = k * 2.0 / (of[2][x] + others[2][y])
        cells = pa.StructArray.from_arrays([pa.array(others[0][y]), pa.array(others[1][y]), pa.array(normalized), pa.array(k)], ["c", "id", "normalized", "count"])
        yield pa.RecordBatch.from_arrays([pa.array(of[0][x[first]]), pa.array(of[1][x[first]]), pa.ListArray.from_arrays(pa.array(np.append(first, len(x)), pa.int32()), cells)], ["c", "id", "all"])


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs of all blocks that meet in a task, in both directions."""
    cells: dict[tuple[int, int], tuple[dict, dict]] = {}
    for batch in batches:
        for l_block, l_part, *rest in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            left, right = cells.setdefault((l_block, rest[6]), ({}, {}))
            left[l_part], right[rest[7]] = (l_part, *rest[:6]), tuple(rest[7:])
    while cells:
        (i, j), sides = cells.popitem()
        left, right = (_block_of([side[part] for part in sorted(side)]) for side in sides)
        del sides
        for a, b, persons in _counted(left, right, i == j):
            yield from _partners(left, right, a, b, persons)
            order = np.argsort(b, kind="stable")
            yield from _partners(right, left, b[order], a[order], persons[order])


def _dice_in_blocks(rows: DataFrame) -> DataFrame:
    """The Dice matrix of distinct (person_id, standard_concept_id), any two concepts of a person being a pair.

    Concepts are dealt into blocks by a hash, which are packed and written once. A Cartesian product reads each block beside each, and
    there their pairs are made, counted and given their ids and counts, so neither pairs nor copies of rows are shuffled.
    """
    n, spark, kind = _blocks_of(rows), rows.sparkSession, rows.schema["standard_concept_id"].dataType
    rows = materialise(rows, "rows")
    parts = 1 + rows.count() // (n * PART)
    c = F.col("standard_concept_id").cast("bigint")
    block = F.pmod(F.xxhash64("standard_concept_id"), F.lit(n)).cast("int").alias("block")
    known = _numbered(rows.groupBy("standard_concept_id").agg(F.count(F.lit(1)).alias("count"))).select(block, c.alias("c"), "id", F.col("count").alias("n"))
    persons = rows.where("person_id is not null").select(block, F.col("person_id").cast("bigint").alias("person"), c.alias("c"))
    schema = "block int, part int, c binary, id binary, n binary, persons binary, k binary, at binary"
    packed = persons.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(lambda p, k: _packed(p, k, parts), schema)
    blocks = materialise(packed, "blocks")
    # all parts of two blocks meet in one task; the difference keeps the planner from shuffling by part
    left, right = (blocks.select([F.col(x).alias(f"{side}_{x}") for x in blocks.columns]).repartitionById(n, F.col(f"{side}_block")) for side in "lr")
    met = left.hint("shuffle_replicate_nl").join(right, F.expr("l_block <= r_block and l_part - r_part = 0"))
    named = met.mapInArrow(_met, "c long, id long, all array<struct<c: long, id: long, normalized: double, count: long>>")
    pairs = named.select("c", "id", F.explode("all").alias("x"))
    return pairs.select(F.col("id").alias("id_1"), F.col("x.id").alias("id_2"), F.col("x.normalized").alias("normalized_count"), F.col("c").cast(kind).alias("standard_concept_id_1"), F.col("x.c").cast(kind).alias("standard_concept_id_2"), F.col("x.count").alias("count"))


def dice(pairs: DataFrame, occurrences: DataFrame) -> DataFrame:
    """Both directions of each pair, with ``normalized_count`` = 2 n12 / (n1 + n2)."""
    of = lambda k: occurrences.select(F.col("id").alias(f"id_{k}"), F.col("standard_concept_id").alias(f"c{k}"), F.col("count").alias(f"n{k}"))
    joined = _mirrored(pairs, "count").join(of(1), "c1").join(of(2), "c2")
    return joined.select(
        "id_1", "id_2", (F.col("count") * 2.0 / (F.col("n1") + F.col("n2"))).alias("normalized_count"),
        F.col("c1").alias("standard_concept_id_1"), F.col("c2").alias("standard_concept_id_2"), "count",
    )


def cooccurrence(windowed: DataFrame, days: int | None = None, window: str | None = "time_window", wanted: DataFrame | None = None) -> DataFrame:
    """The Dice matrix of events in windows, or, with ``days``, of events within a span of days; with ``wanted`` pairs
    (concept_id_1, concept_id_2) only their cells, in both directions."""
    if days is None and window is None and wanted is None:
        rows = mapped(windowed).select("person_id", "standard_concept_id").distinct()
        if all(isinstance(f.dataType, _WHOLE) for f in rows.schema):
            return _dice_in_blocks(rows)
    pairs = pairs_in_windows(windowed, window, wanted) if days is None else pairs_in_span(windowed, days, wanted)
    return dice(pairs, occurrence(windowed))


def decayed(windowed: DataFrame, window: str = "patient_window", include_diagonal: bool = False) -> DataFrame:
    """(id_1, id_2, normalized_count, concepts): sum of 1 / (days apart + 1) over the pairs of events in a person's window.

    Equal events are counted, not repeated. On the diagonal each unordered pair of events of a concept adds twice.
    """
    keys = ["person_id", window]
    rows = mapped(windowed).groupBy(*keys, "standard_concept_id", F.unix_date("event_date").alias("day")).agg(F.count(F.lit(1)).alias("m"))
    a, b = (rows.select(*keys, F.col("standard_concept_id").alias(f"c{k}"), F.col("day").alias(f"day{k}"), F.col("m").alias(f"m{k}")) for k in (1, 2))
    weight = F.col("m1") * F.col("m2") / (F.abs(F.col("day1") - F.col("day2")) + 1.0)
    # one join for all pairs: an event with itself stands for its repeats, two events of a concept are met once and add twice
    met = "c1 < c2 or (c1 = c2 and (day1 < day2 or (day1 = day2 and m1 > 1)))" if include_diagonal else "c1 < c2"
    adds = F.when(F.col("c1") < F.col("c2"), weight).when(F.col("day1") < F.col("day2"), 2 * weight).otherwise(F.col("m1") * (F.col("m1") - 1.0))
    sums = a.join(b, keys).where(met).groupBy("c1", "c2").agg(F.sum(adds).alias("normalized_count"))
    a, b = F.col("c1"), F.col("c2")
    ways = F.when(a == b, F.array(F.struct("c1", "c2"))).otherwise(F.array(F.struct("c1", "c2"), F.struct(b.alias("c1"), a.alias("c2"))))
    off = sums.select(F.explode(ways).alias("p"), "normalized_count").select("p.c1", "p.c2", "normalized_count")
    ids = occurrence(windowed, first_id=0)
    of = lambda k: ids.select(F.col("id").alias(f"id_{k}"), F.col("standard_concept_id").alias(f"c{k}"))
    return off.join(of(1), "c1").join(of(2), "c2").select("id_1", "id_2", "normalized_count", F.col("c1").alias("standard_concept_id_1"), F.col("c2").alias("standard_concept_id_2"))
