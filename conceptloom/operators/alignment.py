"""Global alignment of concept sequences by dynamic programming, in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GAP_STEP = 0
BOTH, FIRST, SECOND = range(3)
#: Cells of the tables that are filled together.
CELLS = 1 << 22
STEP = "struct<sequence_1:long,sequence_2:long,alignment_score:double>"


@dataclass(frozen=True)
class Scoring:
    """Cost of a gap and of a mismatch; ``similarity`` seeks the largest instead of the smallest score."""

    gap: float = 1.0
    mismatch: float = 2.0
    similarity: bool = False


Aligned = tuple[float | None, list[tuple[int, int, float]]]


def align(a: Sequence[int], b: Sequence[int], scoring: Scoring = Scoring(), costs: np.ndarray | None = None) -> Aligned:
    """One pair; see align_batch()."""
    return align_batch([a], [b], scoring, None if costs is None else [costs])[0]


def align_batch(firsts: Sequence[Sequence[int]], seconds: Sequence[Sequence[int]], scoring: Scoring = Scoring(), costs: Sequence[np.ndarray] | None = None) -> list[Aligned]:
    """For each pair the normalised score 2 * score / (m + n), null for two empty sequences, and the steps from the beginning.

    ``costs`` (m x n each) replace match and mismatch. Of equal candidates the one that came from the better cell wins, then the
    diagonal, then a gap in the second sequence, then one in the first. A step carries the score reached by it.

    The tables of all pairs are filled together, one anti-diagonal after the other, as the cells of one depend on the two before only.
    Pairs are padded to the longest, which changes no cell of their own.
    """
    out: list[Aligned] = []
    at = 0
    while at < len(firsts):
        end, m, n = at, 0, 0
        while end < len(firsts):
            wide, high = max(n, len(seconds[end])), max(m, len(firsts[end]))
            if end > at and (end + 1 - at) * (high + 1) * (high + wide + 1) > CELLS:
                break
            end, m, n = end + 1, high, wide
        out += _align_together(firsts[at:end], seconds[at:end], m, n, scoring, costs[at:end] if costs is not None else None)
        at = end
    return out


def _padded(rows: Sequence[Sequence[int]], width: int) -> np.ndarray:
    table = np.zeros((len(rows), width), np.int64)
    for i, r in enumerate(rows):
        table[i, : len(r)] = r
    return table


def _align_together(firsts: Sequence[Sequence[int]], seconds: Sequence[Sequence[int]], m: int, n: int, scoring: Scoring, costs: Sequence[np.ndarray] | None) -> list[Aligned]:
    many, a, b = len(firsts), _padded(firsts, m), _padded(seconds, n)
    if costs is not None:
        grid = np.zeros((many, m, n))
        for k, c in enumerate(costs):
            grid[k, : c.shape[0], : c.shape[1]] = c
    sign = -1.0 if scoring.similarity else 1.0
    # by anti-diagonal i + j, pair and i
    score = np.zeros((m + n + 1, many, m + 1))
    move = np.full((m + n + 1, many, m + 1), BOTH, np.int8)
    for d in range(1, m + n + 1):
        if d <= n:
            score[d, :, 0], move[d, :, 0] = d * scoring.gap, SECOND
        if d <= m:
            score[d, :, d], move[d, :, d] = d * scoring.gap, FIRST
        i = np.arange(max(1, d - n), min(m, d - 1) + 1)
        if not len(i):
            continue
        x, y = i - 1, d - i - 1
        cell = grid[:, x, y] if costs is not None else np.where(a[:, x] == b[:, y], 0.0, scoring.mismatch)
        from_ = score[d - 2][:, i - 1]
        best, way = from_ + cell, np.full((many, len(i)), BOTH, np.int8)
        for came, step in ((score[d - 1][:, i - 1], FIRST), (score[d - 1][:, i], SECOND)):
            value = came + scoring.gap
            wins = (sign * value < sign * best) | ((value == best) & (sign * came < sign * from_))
            best, from_, way = np.where(wins, value, best), np.where(wins, came, from_), np.where(wins, np.int8(step), way)
        score[d][:, i], move[d][:, i] = best, way
    out: list[Aligned] = []
    for k, (p, q) in enumerate(zip(firsts, seconds, strict=True)):
        i, j, steps = len(p), len(q), []
        last = float(score[i + j, k, i])
        while i or j:
            way, here = move[i + j, k, i], float(score[i + j, k, i])
            i, j = i - (way != SECOND), j - (way != FIRST)
            steps.append((int(p[i]) if way != SECOND else GAP_STEP, int(q[j]) if way != FIRST else GAP_STEP, here))
        out.append((2 * last / (len(p) + len(q)) if steps else None, steps[::-1]))
    return out


def align_pairs(pairs: DataFrame, scoring: Scoring = Scoring(), costs: str | None = None) -> DataFrame:
    """Rows with ``sequence_1`` and ``sequence_2`` (and a column of cost rows, array<array<double>>) to all their columns with
    ``score`` and ``alignment``."""
    kept = pairs.columns
    at = [kept.index(c) for c in ("sequence_1", "sequence_2")] + ([kept.index(costs)] if costs else [])
    out = pa.list_(pa.struct([("sequence_1", pa.int64()), ("sequence_2", pa.int64()), ("alignment_score", pa.float64())]))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, *c = ([x if x is not None else [] for x in batch.column(i).to_pylist()] for i in at)
            own = [np.array(x, float).reshape(len(p), len(q)) for x, p, q in zip(c[0], a, b, strict=True)] if c else None
            done = align_batch(a, b, scoring, own)
            steps = [[dict(zip(("sequence_1", "sequence_2", "alignment_score"), s, strict=True)) for s in x] for _, x in done]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([s for s, _ in done], pa.float64()), pa.array(steps, out)], names=[*kept, "score", "alignment"])

    from pyspark.sql.types import StructType

    schema = StructType(pairs.schema.fields + StructType.fromDDL(f"score double, alignment array<{STEP}>").fields)
    return pairs.mapInArrow(of, schema)


def all_pairs(sequences: DataFrame, scoring: Scoring = Scoring()) -> DataFrame:
    """(position, sequence) to the alignment of every pair with position_1 < position_2."""
    one, two = (sequences.select(F.col("position").alias(f"position_{k}"), F.col("sequence").alias(f"sequence_{k}")) for k in (1, 2))
    return align_pairs(one.join(two, F.col("position_1") < F.col("position_2")), scoring)


def steps_of(aligned: DataFrame, *keys: str) -> DataFrame:
    return aligned.select(*keys, F.posexplode("alignment").alias("step", "s")).select(*keys, "step", "s.*")


def matched_frequency(aligned: DataFrame) -> DataFrame:
    """How often each concept stands opposite itself, over all alignments."""
    same = aligned.select(F.explode("alignment").alias("s")).where("s.sequence_1 = s.sequence_2").select(F.col("s.sequence_1").alias("concept_id"))
    return same.groupBy("concept_id").agg(F.count(F.lit(1)).alias("count"))


def name_steps(steps: DataFrame, concept: DataFrame) -> DataFrame:
    """Names of both sides of each step; steps with a gap go, unless the gap's id is a concept."""
    for k in (1, 2):
        steps = steps.join(concept.select(F.col("concept_id").alias(f"sequence_{k}"), F.col("concept_name").alias(f"concept_name_{k}")), f"sequence_{k}")
    return steps
