"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from conceptloom.storage import materialise, shared_dir, shuffled

__all__ = ["annotate", "bind", "documents", "held_out", "in_bytes", "labelled_sample", "labelled_texts", "materialise", "power_of_two", "ranked", "shared_dir", "shuffled"]


def in_bytes(texts: pa.Array) -> Iterator[bytes]:
    """The UTF-8 bytes of each text of an Arrow column; null is empty."""
    raw = texts.cast(pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary())
    return (x.as_py() or b"" for x in raw)


def annotate(df: DataFrame, text: str, keep: list[str], fields: str, scorer: Callable[[], Callable[[list[bytes]], dict[str, list]]], where: Callable[[dict[str, list]], list[bool]] | None = None) -> DataFrame:
    """The columns ``keep`` of ``df`` and ``fields``, worked out from the whole texts batch by batch, without a shuffle.

    ``scorer()`` is called once a task and gives a function from texts to columns; with ``where`` only its true rows stay.
    """
    sent = keep if text in keep else [*keep, text]  # the text goes to Python once
    at = sent.index(text)
    schema = StructType([df.schema[c] for c in keep] + (StructType.fromDDL(fields).fields if fields else []))
    extra = to_arrow_schema(StructType.fromDDL(fields)) if fields else []

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer()
        for batch in batches:
            columns = score(list(in_bytes(batch.column(at))))
            out = pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(keep))] + [pa.array(columns[f.name], f.type) for f in extra], names=keep + [f.name for f in extra])
            yield out.filter(pa.array(where(columns), pa.bool_())) if where else out

    return df.select(*sent).mapInArrow(of, schema)


def labelled_sample(labels: DataFrame, label: str, caps: dict[int, int]) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, y): at most ``caps[y]`` rows of each label that are not held out, chosen by a hash of the id, and how many rows
    of each label there are in all. Repeated ids count once, with the label most of their rows have (1 if equal)."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(*caps)).where(~held_out(F.col("doc_id")))
    once = known.groupBy("doc_id").agg((F.avg(label) >= 0.5).cast("int").alias("y"))
    counts = {r.y: r.n for r in once.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = [once.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for y, n in caps.items()]
    return reduce(DataFrame.unionByName, parts), {y: counts.get(y, 0) for y in caps}


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, caps: dict[int, int]) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, y, text) of at most ``caps[y]`` different texts of each label that are not held out, and how many ids of each label
    there are in all. Equal texts are one, with their smallest id and the label most of their ids have (1 if equal)."""
    sample, totals = labelled_sample(labels, label, caps)
    chosen = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").where(F.col("text").isNotNull())  # at most the sum of caps ids
    once = chosen.groupBy("text").agg(F.min("doc_id").alias("doc_id"), (F.avg("y") >= 0.5).cast("int").alias("y"))
    # an id may have several texts: the bound holds for texts as well
    return reduce(DataFrame.unionByName, [once.where(F.col("y") == y).orderBy(F.xxhash64("text"), "doc_id").limit(n) for y, n in caps.items()]), totals


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3, is 1. A null id counts as the empty text (remainder 0)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once a row however often ``use`` refers to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def power_of_two(n: float) -> int:
    return 1 << max(0, int(n) - 1).bit_length()


def ranked(df: DataFrame, keys: list[str], order: list[Column], salts: int, out: str) -> DataFrame:
    """Add ``out``, the 0-based position of a row among the rows with equal ``keys`` (long).

    A key that holds most rows is dealt over ``salts`` sub-groups by a hash of ``order``; only the counts of sub-groups meet,
    so no task sorts a hot key as a whole. Positions follow (sub-group, order). ``keys`` must not be null; a column ``_salt``
    of the input is not preserved.
    """
    df = df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    sub = [*keys, "_salt"]
    counts = df.groupBy(*sub).agg(F.count(F.lit(1)).alias("_n"))
    below = Window.partitionBy(*keys).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*sub, F.coalesce(F.sum("_n").over(below), F.lit(0)).alias("_offset"))
    within = Window.partitionBy(*sub).orderBy(*order)
    return (
        df.withColumn("_rn", F.row_number().over(within) - 1)
        .join(offsets, sub)
        .withColumn(out, F.col("_offset") + F.col("_rn"))
        .drop("_salt", "_rn", "_offset")
    )
