"""Document fingerprints by a homomorphic multiset hash (DataFrame functions only).

A paragraph (line) is hashed into a wide vector: four lanes of independent 62-bit hashes of the paragraph, and 21 lanes into which
the hash bits of its sentences are spread as small counters, three to a lane. Vectors are added modulo 2**62. The sum of a
document does not depend on the order of its paragraphs, and a paragraph is inserted or deleted by adding or subtracting its
vector. Equal sums mean equal multisets of paragraphs (but for hash collisions); the counters, centred, give an estimate of the
share of sentences that two documents have in common. The counters have 20 bits at least, so the likeness (not the equality) holds for
documents of up to 1,048,575 sentences.

Edge cases: a null text is the empty text, which has one empty paragraph; repeated rows (same id and text) count as one document
of the ring of next documents and each get its result; rows of one id with different texts follow each other by a hash of the
text; equal texts have equal vectors and likeness 1; very long texts are split and summed whole, in memory in proportion to the text;
a single document is its own next; empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from conceptloom.llm.common import bind, documents, materialise

MODULUS = (1 << 62) - 1  # as a mask
EXACT, SPREAD = 4, 21
SPREAD_MASK = 1 | 1 << 21 | 1 << 42
#: Documents per task when the ring of next documents is made.
RING_ROWS = 250_000


def _long(n: int) -> Column:
    return F.lit(n).cast("long")


def _sum(values: Column, of) -> Column:
    return F.aggregate(values, _long(0), lambda a, v: (a + of(v)).bitwiseAND(_long(MODULUS)))


def text_vector(text: Column) -> Column:
    """array<long>: EXACT lanes, SPREAD lanes, and the number of sentences."""
    paragraphs = F.split(text, "\n")
    exact = [_sum_of_seed(paragraphs, seed) for seed in range(EXACT)]
    sentences = F.transform(F.split(text, r"\n|(?<=[.!?]) "), lambda s: F.xxhash64(s))
    spread = lambda hs: F.transform(
        F.sequence(F.lit(0), F.lit(SPREAD - 1)), lambda k: F.aggregate(hs, _long(0), lambda a, h: (a + F.call_function("shiftright", h, k).bitwiseAND(_long(SPREAD_MASK))).bitwiseAND(_long(MODULUS)))
    )
    return F.concat(F.array(*exact), bind(sentences, lambda hs: F.concat(spread(hs), F.array(F.size(hs).cast("long")))))


def _sum_of_seed(paragraphs: Column, seed: int) -> Column:
    return _sum(paragraphs, lambda p: F.xxhash64(F.lit(seed), p).bitwiseAND(_long(MODULUS)))


def insert(vector: Column, paragraph: Column) -> Column:
    """The vector of a document after inserting a paragraph."""
    return F.zip_with(vector, text_vector(paragraph), lambda a, b: (a + b).bitwiseAND(_long(MODULUS)))


def delete(vector: Column, paragraph: Column) -> Column:
    """The vector of a document after deleting one of its paragraphs."""
    return F.zip_with(vector, text_vector(paragraph), lambda a, b: (a - b).bitwiseAND(_long(MODULUS)))


def as_text(vector: Column) -> Column:
    return F.array_join(F.transform(vector, lambda v: F.lpad(F.lower(F.hex(v)), 16, "0")), "")


def _centred(vector: Column) -> Column:
    n = F.get(vector, F.lit(EXACT + SPREAD))
    field = lambda v, shift, bits: (F.shiftright(v, shift).bitwiseAND(_long((1 << bits) - 1)) * 2 - n).cast("double")
    return F.flatten(F.transform(F.slice(vector, EXACT + 1, SPREAD), lambda v: F.array(field(v, 0, 21), field(v, 21, 21), field(v, 42, 20))))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: the cosine of the centred counters, at least 0; 1 if the vectors are equal."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    cosine = bind(F.struct(_centred(a).alias("a"), _centred(b).alias("b")), lambda c: F.try_divide(dot(c["a"], c["b"]), F.sqrt(dot(c["a"], c["a"]) * dot(c["b"], c["b"]))))
    return F.when(a == b, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(cosine, F.lit(0.0)))))


def next_of(ids: DataFrame) -> DataFrame:
    """Distinct (doc_id, th, n) to the ring in descending order: (doc_id, th, n, next_id, next_th).

    Rows are dealt by ranges of the id and written with the number of their range; a window per range finds the next row, and the
    first row of each range (one row per range) closes the gaps between ranges.
    """
    spark = ids.sparkSession
    rows = materialise(ids, "ring-ids")
    n = max(1, rows.count() // RING_ROWS, spark.sparkContext.defaultParallelism)
    ranged = materialise(rows.repartitionByRange(n, F.desc_nulls_last("doc_id"), F.desc("th")).withColumn("_range", F.spark_partition_id()), "ring")
    down = [F.desc_nulls_last("doc_id"), F.desc("th")]
    w = Window.partitionBy("_range").orderBy(*down)
    follow = ranged.withColumn("_next", F.lead(F.struct("doc_id", "th")).over(w))
    heads = ranged.groupBy("_range").agg(F.max(F.struct(F.col("doc_id").isNotNull(), "doc_id", "th")).alias("_top")).select("_range", F.struct("_top.doc_id", "_top.th").alias("_top"))
    ring = Window.orderBy("_range")
    everything = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = heads.select("_range", F.coalesce(F.lead("_top").over(ring), F.first("_top").over(everything)).alias("_after"))
    return follow.join(heads, "_range").select("doc_id", "th", "n", F.coalesce("_next", "_after").alias("_next")).select("doc_id", "th", "n", F.col("_next.doc_id").alias("next_id"), F.col("_next.th").alias("next_th"))


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """(doc_id, text) to the vectors of each text, its edited text and the next document's text, and the edited text.

    Texts are shuffled once by the document's key; only the heads that the document before needs are shuffled again.
    """
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    ring = materialise(next_of(base.select("doc_id", "th", F.length("text").alias("n")).distinct()), "ring-next")
    key = ["_id", "_none", "_th"]  # no nulls, so that the window and both joins share a partitioning

    def keyed(doc_id: str, th: str) -> list[Column]:
        return [F.coalesce(doc_id, F.lit(0).cast(dict(docs.dtypes)["doc_id"])).alias("_id"), F.col(doc_id).isNull().alias("_none"), F.col(th).alias("_th")]

    # the id itself is left out, so that both uses need the same columns and read one exchange
    rows = base.select("text", *keyed("doc_id", "th")).withColumn("_copy", F.row_number().over(Window.partitionBy(*key).orderBy("_th")))
    before = ring.select(*keyed("next_id", "next_th"), F.col("doc_id").alias("to_id"), F.col("th").alias("to_th"), F.floor(F.col("n") / 2).cast("int").alias("need"))
    # greatest() keeps the planner from limiting rows before the exchange, which would then not be shared
    sent = rows.where(F.greatest("_copy", F.lit(1)) == 1).join(before, key).select(*keyed("to_id", "to_th"), F.expr("substring(text, 1, need)").alias("head"), text_vector(F.col("text")).alias("next_vector"))
    edited = F.concat(F.expr("substring(text, 1, length(text) - length(text) div 2)"), F.col("head"))
    doc_id = F.when(~F.col("_none"), F.col("_id")).alias("doc_id")
    both = rows.join(sent, key).select(doc_id, F.length("text").cast("long").alias("n_chars"), edited.alias("edited"), text_vector(F.col("text")).alias("vector"), "next_vector")
    return both.withColumn("edited_vector", text_vector(F.col("edited")))


def op10_multiset_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited text, with their likeness."""
    out = fingerprint_edits(documents(spark, sf_dir))
    return out.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("vector")).alias("fingerprint"), as_text(F.col("edited_vector")).alias("edited_fingerprint"),
        likeness(F.col("vector"), F.col("edited_vector")).alias("near_edited"), likeness(F.col("vector"), F.col("next_vector")).alias("near_next"),
    )
