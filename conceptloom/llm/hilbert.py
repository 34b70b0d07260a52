"""Sharding along a Hilbert curve over several metadata dimensions (DataFrame functions only).

Every dimension is quantised into bins: one for each distinct value while there are enough, else equal-depth runs of values, counted
exactly over whole values, texts in full. The bins are mapped to an index on the Hilbert curve, and the rows in curve order are cut into shards whose row counts differ by at most one. Neighbours on the curve are close in every dimension, so the
files of a shard have narrow value ranges in all of them and readers can skip files on any.

Counts are exact, so the same rows give the same shards on every run and cluster.

Edge cases: a null in a dimension takes its lowest bin; ties and repeated rows share a curve index and are told apart by the tie
columns (rows equal in these may swap places, which changes no result); an empty input gives an empty result; fewer rows than
shards leave some shards empty. Columns of the input are kept, except that ``hilbert``, ``shard`` and ``slot`` are replaced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from conceptloom.llm.common import bind, documents, materialise, power_of_two, ranked

#: Rows per sub-group of a curve cell when positions are counted.
ROWS_PER_SALT = 100_000
#: Distinct values of a dimension that one task sums up in order.
VALUES = 1_000_000


def bin_bounds(table: DataFrame, name: str, bins: int) -> list:
    """The first value of every bin but the lowest; at most ``bins`` - 1 values come to the driver.

    Values are counted, ranges of VALUES distinct values are summed by tasks of their own, and a value falls into the bin where the
    middle of its rows lies.
    """
    counts = materialise(table.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("_value")).agg(F.count(F.lit(1)).alias("_n")), "hilbert-values")
    distinct, rows = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("_n"), F.lit(0))).first()
    if distinct <= bins:
        return [r._value for r in counts.orderBy("_value").collect()][1:]
    ranged = materialise(counts.repartitionByRange(1 + distinct // VALUES, "_value").withColumn("_range", F.spark_partition_id()), "hilbert-ranges")
    before = lambda w: F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = ranged.groupBy("_range").agg(F.sum("_n").alias("_n")).select("_range", before(Window.orderBy("_range")).alias("_start"))  # a row for VALUES values
    placed = ranged.join(starts, "_range").withColumn("_before", F.col("_start") + before(Window.partitionBy("_range").orderBy("_value")))
    lowest = placed.withColumn("_bin", F.expr(f"((2L * _before + _n) * {bins}L) div {2 * rows}L")).groupBy("_bin").agg(F.min("_value").alias("_value"))
    return [r._value for r in lowest.orderBy("_bin").collect()][1:]


def hilbert_index(bins: Column, dims: int, bits: int) -> Column:
    """Index on the Hilbert curve of an array of ``dims`` bin numbers, each below 2**bits.

    The recursion over quadrants is folded over a literal list of (bit, axis) steps with lambdas, so the expression stays small.
    """

    def at(xs: Column, i) -> Column:
        return F.get(xs, F.lit(i) if isinstance(i, int) else i)

    def undo(xs: Column, step: Column) -> Column:
        bit, axis = step["bit"], step["axis"]
        low = bit - 1
        first, own = at(xs, 0), at(xs, axis)
        swap = first.bitwiseXOR(own).bitwiseAND(low)
        is_set = own.bitwiseAND(bit) != 0
        return F.transform(
            xs,
            lambda x, j: F.when(is_set, F.when(j == 0, x.bitwiseXOR(low)).otherwise(x))
            .when((j == 0) & (axis != 0), x.bitwiseXOR(swap))
            .when((j == axis) & (axis != 0), x.bitwiseXOR(swap))
            .otherwise(x),
        )

    def packed(steps: list[tuple[int, int]]) -> Column:
        return F.array(*[F.struct(F.lit(b).cast("long").alias("bit"), F.lit(a).alias("axis")) for b, a in steps])

    high_to_low = [1 << b for b in range(bits - 1, 0, -1)]
    undone = F.aggregate(packed([(b, a) for b in high_to_low for a in range(dims)]), bins, undo) if bits > 1 else bins

    def gray(xs: Column) -> Column:
        return F.transform(xs, lambda _, j: F.aggregate(F.slice(xs, F.lit(1), j + 1), F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(x)))

    def parity(xs: Column) -> Column:
        last = at(xs, dims - 1)
        return reduce(Column.bitwiseXOR, [F.when(last.bitwiseAND(b) != 0, F.lit(b - 1)).otherwise(F.lit(0)).cast("long") for b in high_to_low], F.lit(0).cast("long"))

    def interleave(xs: Column) -> Column:
        each_bit = packed([(1 << b, a) for b in range(bits - 1, -1, -1) for a in range(dims)])
        return F.aggregate(each_bit, F.lit(0).cast("long"), lambda v, s: v * 2 + F.when(at(xs, s["axis"]).bitwiseAND(s["bit"]) != 0, 1).otherwise(0))

    turned = bind(bind(undone, gray), lambda xs: bind(parity(xs), lambda p: F.transform(xs, lambda x: x.bitwiseXOR(p))))
    return bind(turned, interleave)


def hilbert_shards(df: DataFrame, dims: list[Column], tie: list[str], n_shards: int, bits: int = 5) -> DataFrame:
    """``df`` with ``hilbert`` (long), ``shard`` (int, 0 to n_shards-1) and ``slot`` (long, gapless from 0 in its shard).

    ``dims`` are columns that can be ordered. The driver only receives the 2**bits - 1 bin bounds of each dimension and the row count.
    """
    names, ties = [f"_dim{i}" for i in range(len(dims))], [f"_tie{i}" for i in range(len(tie))]
    kept = df.drop("hilbert", "shard", "slot")
    # the columns of the input travel in one struct, so none of their names can clash
    slim = kept.select(F.struct(*kept.columns).alias("_all"), *[d.alias(n) for n, d in zip(names, dims, strict=True)], *[F.col(t).alias(n) for n, t in zip(ties, tie, strict=True)])
    table = materialise(slim, "hilbert")
    types = dict(table.dtypes)
    bounds = [bin_bounds(table, n, 2**bits) for n in names]
    rows = table.count()

    def bin_of(name: str, at: list) -> Column:
        if not at:
            return F.lit(0).cast("long")
        return F.size(F.filter(F.array(*[F.lit(b).cast(types[name]) for b in at]), lambda b: b <= F.col(name))).cast("long")

    index = hilbert_index(F.array(*[bin_of(n, b) for n, b in zip(names, bounds, strict=True)]), len(dims), bits)
    celled = materialise(table.withColumn("hilbert", index).drop(*names), "hilbert-cells")
    cells = celled.groupBy("hilbert").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("hilbert").rowsBetween(Window.unboundedPreceding, -1)  # at most 2**(bits * dims) rows
    starts = cells.select("hilbert", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    placed = ranked(celled, ["hilbert"], [F.col(t) for t in ties], max(16, power_of_two(rows / ROWS_PER_SALT)), "_pos").join(starts, "hilbert")
    n = max(rows, 1)
    shard = F.expr(f"(({n_shards}L * (_start + _pos + 1)) - 1) div {n}L")
    return (
        placed.withColumn("shard", shard.cast("int"))
        .withColumn("slot", F.col("_start") + F.col("_pos") - F.expr(f"(shard * {n}L) div {n_shards}L"))
        .select("_all.*", "hilbert", "shard", "slot")
    )


def write_shards(sharded: DataFrame, path: str, files: int) -> None:
    """Write one folder per shard, each file a run of the curve."""
    sharded.repartitionByRange(files, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op1_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight shards, law ``rows``: sources, languages and sizes span the curve."""
    text = F.coalesce("text", F.lit(""))
    slim = documents(spark, sf_dir).select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), "lang", "source"
    )
    placed = hilbert_shards(slim, [F.col("source"), F.col("lang"), F.col("size")], ["doc_id", "size", "text_crc32"], 8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert")
