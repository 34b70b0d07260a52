"""GloVe vectors by alternating weighted least squares over Spark tables.

The objective is that of GloVe: weighted squared error of target . context + two biases against the logarithm of the co-occurrence.
With one side fixed every word of the other side is a small ridge regression of its own.

Co-occurrences are summed before they are shuffled, and stay packed: a row holds the cells of some whole words. Words are dealt into blocks
by ranges, as near ids often occur together. A half sweep sends a vector once to each block that has a word seen with it, not with each cell.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from conceptloom.storage import materialise, shuffled

#: Cells that a task holds before it sums them, cells of a packed row (more only of a single word), numbers of a group of matrices.
PENDING, CHUNK, NUMBERS = 1 << 20, 1 << 16, 1 << 21

Cells = tuple[np.ndarray, np.ndarray, np.ndarray]  # word, other word, x


def _pack(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> bytes:
    out = pa.BufferOutputStream()
    delta = {"a": "DELTA_BINARY_PACKED", "b": "DELTA_BINARY_PACKED"}
    pq.write_table(pa.table({"a": a, "b": b, "x": x}), out, compression="zstd", use_dictionary=["x"], column_encoding=delta, write_statistics=False)
    return out.getvalue().to_pybytes()


def _unpack(cells: bytes) -> Cells:
    table = pq.ParquetFile(pa.BufferReader(cells)).read(use_threads=False)
    return tuple(table[c].to_numpy() for c in "abx")


def _starts(a: np.ndarray) -> np.ndarray:
    """Where runs of equal values start, and the end."""
    return np.append(np.flatnonzero(np.concatenate([np.ones(min(len(a), 1), bool), a[1:] != a[:-1]])), len(a))


def _summed(cells: list[Cells]) -> Cells:
    """Sorted by both words, equal ones summed."""
    a, b, x = (np.concatenate(c) for c in zip(*cells, strict=True))
    words, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    key = at[: len(a)] * len(words) + at[len(a) :]
    order = np.argsort(key, kind="stable")
    first = _starts(key[order])[:-1]
    key = key[order[first]]
    return words[key // len(words)], words[key % len(words)], np.add.reduceat(x[order], first)


def _pairs(sequences: pa.Array, window: int | None) -> Iterator[Cells]:
    """The pairs of places of each distance, in both directions. Unknown words keep their place."""
    words, lengths = sequences.flatten(), pc.fill_null(pc.list_value_length(sequences), 0).to_numpy(zero_copy_only=False)
    known, words = pc.is_valid(words).to_numpy(zero_copy_only=False), pc.fill_null(words, 0).to_numpy(zero_copy_only=False)
    ends = np.repeat(np.cumsum(lengths), lengths)
    at, apart = np.arange(len(words)), 1
    while len(at) and (window is None or apart <= window):
        at = at[at + apart < ends[at]]
        met = at[known[at] & known[at + apart]]
        a, b, x = words[met], words[met + apart], np.full(len(met), 1.0 / apart)
        yield a, b, x
        yield b, a, x
        apart += 1


def _packed(sequences: DataFrame, window: int | None) -> tuple[DataFrame, int, Callable[[np.ndarray], np.ndarray]]:
    """``concepts`` arrays to (block, cells), the number of blocks, and the blocks of words.

    Blocks are ranges of words with about equal numbers of places. Cells are counted in finer ranges, one for each shuffle partition.
    """
    tasks = int(sequences.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = math.ceil(math.sqrt(4 * tasks))
    each = math.ceil(tasks / blocks)
    parts = blocks * each
    rows = sequences.select(F.col("concepts").cast("array<bigint>").alias("concepts"))
    shares = F.array(*[F.lit(k / parts) for k in range(1, parts)])
    cuts = rows.select(F.explode("concepts").alias("c")).agg(F.percentile_approx("c", shares, 100 * parts).alias("cuts")).first().cuts
    cuts = np.array(cuts or [], "int64")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def dealt() -> pa.RecordBatch:
            cells = _summed(held)
            part = np.searchsorted(cuts, cells[0])
            at = _starts(part)
            packed = [_pack(*(c[i:j] for c in cells)) for i, j in zip(at[:-1], at[1:], strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(part[at[:-1]], pa.int32()), pa.array(packed, pa.binary())], ["part", "cells"])

        for batch in batches:
            for cells in _pairs(batch.column(0), window):
                held.append(cells)
                size += len(cells[0])
                if size >= PENDING:
                    yield dealt()
                    held, size = [], 0
        if size:
            yield dealt()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, known = [], 0, 0
        for batch in batches:
            for packed in batch.column("cells"):
                held.append(_unpack(packed.as_py()))
                size += len(held[-1][0])
                if size >= max(PENDING, known) + known:
                    held = [_summed(held)]
                    size = known = len(held[0][0])
        if not held:
            return
        cells = _summed(held)
        starts = _starts(cells[0])
        block = np.searchsorted(cuts, cells[0][starts[:-1]]) // each
        i = 0
        while i < len(block):
            j = max(i + 1, min(np.searchsorted(starts, starts[i] + CHUNK, "right") - 1, np.searchsorted(block, block[i], "right")))
            packed = _pack(*(c[starts[i] : starts[j]] for c in cells))
            yield pa.RecordBatch.from_arrays([pa.array([block[i]], pa.int32()), pa.array([packed], pa.binary())], ["block", "cells"])
            i = j

    counted = rows.mapInArrow(count, "part int, cells binary").repartitionById(parts, "part")
    return counted.mapInArrow(merge, "block int, cells binary"), blocks, lambda words: np.searchsorted(cuts, words) // each


def corpus_weights(sequences: DataFrame, window: int | None = None) -> DataFrame:
    """``concepts`` arrays to symmetric (c1, c2, x): the sum of 1 / distance over places at most ``window`` apart (None: any)."""

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for packed in batch.column("cells"):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in _unpack(packed.as_py())], ["c1", "c2", "x"])

    return _packed(sequences, window)[0].select("cells").mapInArrow(cells, "c1 long, c2 long, x double")


def dictionary(sequences: DataFrame) -> DataFrame:
    words = sequences.select(F.explode("concepts").alias("standard_concept_id")).distinct()
    return words.select((F.dense_rank().over(Window.orderBy("standard_concept_id")) - 1).cast("bigint").alias("id"), "standard_concept_id")


def _start(ids: DataFrame, width: int, seed: int) -> DataFrame:
    value = F.transform(F.sequence(F.lit(1), F.lit(width)), lambda k: (F.pmod(F.xxhash64(F.lit(seed), F.col("id"), k), F.lit(2_000_001)) / 1e6 - 1.0) / width)
    return ids.select(F.col("standard_concept_id").cast("bigint").alias("word"), value.alias("v"))


def _lists(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(values))


def _seen_in(starts: np.ndarray, other: np.ndarray, block_of: Callable[[np.ndarray], np.ndarray]) -> pa.Array:
    """The blocks of the words seen with each word, which are those that need its vector. Other words come sorted, so their blocks do."""
    block, word = block_of(other).astype("int32"), np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    new = np.concatenate([[True], (block[1:] != block[:-1]) | (word[1:] != word[:-1])])
    return _lists(block[new], np.bincount(word[new], minlength=len(starts) - 1))


def _needed(cells: DataFrame, block_of: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(word, blocks): where the vector of each word is needed."""

    def needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for packed in batch.column("cells"):
                a, b, _ = _unpack(packed.as_py())
                starts = _starts(a)
                yield pa.RecordBatch.from_arrays([pa.array(a[starts[:-1]]), _seen_in(starts, b, block_of)], ["word", "blocks"])

    return cells.select("cells").mapInArrow(needed, "word long, blocks array<int>")


def _solve(cells: DataFrame, blocks: int, block_of: Callable[[np.ndarray], np.ndarray], fixed: DataFrame, dimensions: int, ridge: float, x_max: float, alpha: float) -> DataFrame:
    """Packed cells and vectors (word, v, blocks) of the other side, laid out as [vector, own bias], to this side's."""
    width = dimensions + 1

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, vectors, held = [np.zeros(0, "int64")], [np.zeros((0, width))], []
        for batch in batches:
            held += batch.column("cells").drop_null().to_pylist()
            rows = batch.filter(pc.is_null(batch.column("cells")))
            words.append(rows.column("word").to_numpy())
            vectors.append(rows.column("v").flatten().to_numpy().reshape(-1, width))
        known = np.concatenate(words)
        order = np.argsort(known)
        known, x = known[order], np.concatenate(vectors)[order]
        words, vectors = [], []
        bias = x[:, dimensions].copy()
        x[:, dimensions] = 1.0
        most, piece = max(1, NUMBERS // width**2), max(1, NUMBERS // width)
        for packed in held:
            a, b, n = _unpack(packed)
            at, f = np.searchsorted(known, b), np.minimum((n / x_max) ** alpha, 1.0)
            y = np.log(n) - bias[at]
            all_starts = _starts(a)
            for k in range(0, len(all_starts) - 1, most):
                starts = all_starts[k : k + most + 1]
                left, right = np.zeros((len(starts) - 1, width, width)), np.zeros((len(starts) - 1, width))
                for w, (start, end) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)):
                    for i in range(start, end, piece):  # a frequent word has many
                        j = min(i + piece, end)
                        v = x[at[i:j]]
                        weighted = v.T * f[i:j]
                        left[w] += weighted @ v
                        right[w] += weighted @ y[i:j]
                done = np.linalg.solve(left + ridge * np.eye(width), right[:, :, None])
                within = slice(starts[0], starts[-1])
                out = [pa.array(a[starts[:-1]]), _lists(done.ravel(), np.full(len(done), width)), _seen_in(starts - starts[0], b[within], block_of)]
                yield pa.RecordBatch.from_arrays(out, ["word", "v", "blocks"])

    no = lambda kind, name: F.lit(None).cast(kind).alias(name)
    sent = fixed.select(F.explode("blocks").alias("block"), "word", "v", no("binary", "cells"))
    both = sent.unionByName(cells.select("block", no("bigint", "word"), no("array<double>", "v"), "cells"))
    return both.repartitionById(blocks, "block").mapInArrow(solve, "word long, v array<double>, blocks array<int>")


def train(sequences: DataFrame, dimensions: int = 200, sweeps: int = 10, window: int | None = None, x_max: float = 100.0, alpha: float = 0.75, ridge: float = 0.1, seed: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sequences to (dictionary, target vectors, context vectors), vectors as (id, vector, bias)."""
    sequences = materialise(sequences.select("concepts"), "glove-sequences")
    ids = materialise(dictionary(sequences), "glove-ids")
    cells, blocks, block_of = _packed(sequences, window)
    cells = materialise(cells, "glove-cells")
    target, context = None, materialise(shuffled(_needed(cells, block_of)).join(shuffled(_start(ids, dimensions + 1, seed)), "word").select("word", "v", "blocks"), "glove-context")
    for _ in range(sweeps):  # co-occurrence is symmetric, so both sides read the same cells
        target = materialise(_solve(cells, blocks, block_of, context, dimensions, ridge, x_max, alpha), "glove-target")
        context = materialise(_solve(cells, blocks, block_of, target, dimensions, ridge, x_max, alpha), "glove-context")
    of = shuffled(ids.select("id", F.col("standard_concept_id").cast("bigint").alias("word")))
    shape = lambda t: shuffled(t).join(of, "word").select("id", F.slice("v", 1, dimensions).alias("vector"), F.get("v", F.lit(dimensions)).alias("bias"))
    return ids, shape(target), shape(context)


def loss(cells: DataFrame, target: DataFrame, context: DataFrame) -> DataFrame:
    """(id, other, f, y) and both sides to one row: the weighted squared error."""
    t = target.select("id", F.col("vector").alias("_t"), F.col("bias").alias("_bt"))
    c = context.select(F.col("id").alias("other"), F.col("vector").alias("_c"), F.col("bias").alias("_bc"))
    dot = F.aggregate(F.zip_with("_t", "_c", lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    error = dot + F.col("_bt") + F.col("_bc") - F.col("y")
    return cells.join(t, "id").join(c, "other").agg(F.sum(F.col("f") * error * error).alias("loss"))
