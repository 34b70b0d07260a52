"""Mixing sources to target weights by entropy balancing (DataFrame functions only).

Among all document rates between 0 and ``most`` the ones closest to 1 in relative entropy that give every source its target tokens
are ``rate = min(most, exp(lambda_source * size / mean size))``. The convex dual in the lambdas separates by source. It is solved
for all sources at once by Newton steps kept inside a bracket. A step needs two sums per source, taken over the histogram
(source, size, documents), never over the documents; sums are exact decimals, so neither the order of tasks nor a rerun changes
them. Rates are then rounded into whole copies by carrying what rounding leaves from long to short documents of the source.

Edge cases: a null source is a source of its own, last in order; documents without words take nothing and change nothing; a source
whose target is its cap takes ``most`` copies of everything; empty input gives an empty result; repeated rows are documents of
their own; very long texts are counted whole; equal sizes of a source are ordered by a hash of the id, then the id. Extra columns are
kept, whatever their names; the columns this operator adds are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from conceptloom.llm.common import bind, documents, materialise, power_of_two, ranked

WORDS = r"[^\x20\x09-\x0D]+"
#: Sizes of a source in a part of the list that is folded, and documents of a size that one task numbers.
PART, ROWS_PER_SALT = 1024, 100_000
STEPS, TOLERANCE = 80, 1e-7


def token_targets(sources: DataFrame, cycle: tuple[int, ...], most: int) -> DataFrame:
    """(_source, source, source_size) to targets: shares by weight, none above ``most`` times its size; one row per source.

    The limits bind in the order of size per weight, so the share level after each binding source is a running sum.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weights = F.array(*[F.lit(w) for w in cycle])
    w = sources.withColumn("_w", F.get(weights, (F.row_number().over(order) - 1) % len(cycle)).cast("double"))
    cap = F.col("source_size") * F.lit(float(most))
    everything = Window.partitionBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    fill = Window.partitionBy(F.lit(0)).orderBy(cap / F.col("_w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum(cap).over(fill), F.lit(0.0))) / (F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(fill), F.lit(0.0)))
    return (
        w.withColumn("_level", level)
        .withColumn("_bound", cap <= F.col("_level") * F.col("_w"))
        .withColumn("_share", F.max(F.when(~F.col("_bound"), F.col("_level"))).over(everything) * F.col("_w"))
        .withColumn("target", F.when(F.col("_bound"), cap).otherwise(F.least(cap, F.col("_share"))))
        .select("_source", "source_size", "target", "_bound")
    )


def _rate(lam: Column, x: Column, most: int) -> Column:
    return F.least(F.lit(float(most)), F.exp(F.least(lam * x, F.lit(50.0))))


def _exact(c: Column) -> Column:
    return F.sum(F.round(c, 6).cast("decimal(32,6)")).cast("double")


def solve_rates(classes: DataFrame, targets: DataFrame, most: int) -> DataFrame:
    """(_source, _size, _n) and targets to (_source, _lam, _mean, target, _bound): Newton on the dual of every source at once."""
    shape = classes.where("_size > 0").groupBy("_source").agg(F.sum("_n").alias("_docs"), F.min("_size").alias("_least"))
    mean = F.col("source_size") / F.col("_docs")
    log_ratio = F.log(F.col("target") / F.col("source_size"))
    state = targets.join(shape, "_source").select(
        "_source", "target", "_bound", mean.alias("_mean"), F.lit(0.0).alias("_lam"),
        F.when(log_ratio < 0, log_ratio * mean / F.col("_least")).otherwise(0.0).alias("_lo"),
        F.when(log_ratio < 0, 0.0).otherwise(F.log(F.lit(float(most))) * mean / F.col("_least")).alias("_hi"),
        F.lit(False).alias("_done"),
    )
    state = materialise(state, "mix-state")
    for _ in range(STEPS):
        x = F.col("_size") / F.col("_mean")
        rate = _rate(F.col("_lam"), x, most)
        tokens = (F.col("_n") * F.col("_size")).cast("double") * rate
        sums = (
            classes.join(state.where("not _done and not _bound"), "_source")
            .groupBy("_source")
            .agg(_exact(tokens).alias("_got"), _exact(F.when(rate < most, tokens * x).otherwise(0.0)).alias("_slope"))
        )
        gap = F.col("_got") - F.col("target")
        lo, hi = F.when(gap < 0, F.col("_lam")).otherwise(F.col("_lo")), F.when(gap >= 0, F.col("_lam")).otherwise(F.col("_hi"))
        step = F.col("_lam") - gap / F.greatest(F.col("_slope"), F.lit(1e-9))
        inside = (step > lo) & (step < hi)
        done = F.col("_done") | F.col("_bound") | (F.abs(gap) <= TOLERANCE * F.col("target"))
        moved = state.join(sums, "_source", "left").select(
            "_source", "target", "_bound", "_mean",
            F.when(F.coalesce(done, F.lit(True)), F.col("_lam")).otherwise(F.when(inside, step).otherwise((lo + hi) / 2)).alias("_lam"),
            F.coalesce(lo, F.col("_lo")).alias("_lo"), F.coalesce(hi, F.col("_hi")).alias("_hi"), F.coalesce(done, F.lit(True)).alias("_done"),
        )
        state = materialise(moved, "mix-state")
        if state.where("not _done").isEmpty():
            break
    return state


def copies_by_size(classes: DataFrame, rates: DataFrame, most: int) -> DataFrame:
    """(_source, _size, _n) to ``_m``, the copies that all documents of the class get together.

    From long to short, a class takes the whole copies nearest to its tokens plus what rounding has left so far, so a source ends
    within half its shortest document of its target where no class is at its limit. All sizes of a source are folded in one row, in
    parts of PART, as a result that grows by one value at a time would be copied too often.
    """
    ideal = F.when(F.col("_bound"), F.lit(float(most))).otherwise(_rate(F.col("_lam"), F.col("_size") / F.col("_mean"), most))
    at_size = classes.where("_size > 0").join(rates, "_source").withColumn("_ideal", F.round(F.col("_n") * ideal, 6))
    whole = at_size.groupBy("_source").agg(F.sort_array(F.collect_list(F.struct("_size", "_n", "_ideal")), asc=False).alias("_classes"))
    parts = F.transform(F.sequence(F.lit(0), F.expr(f"int((size(_classes) - 1) div {PART})")), lambda i: F.slice("_classes", (i * PART + 1).cast("int"), PART))
    whole = whole.withColumn("_parts", parts)

    def start(carry: Column, kind: str) -> Column:
        return F.struct(carry.alias("carry"), F.array().cast(kind).alias("ms"))

    def take(acc: Column, c: Column) -> Column:
        want = c["_ideal"] * c["_size"] + acc["carry"]
        m = F.least(F.greatest(F.round(want / c["_size"]).cast("long"), F.lit(0).cast("long")), c["_n"] * most)
        return bind(m, lambda k: F.struct((want - k * c["_size"]).alias("carry"), F.concat(acc["ms"], F.array(k)).alias("ms")))

    def take_part(acc: Column, part: Column) -> Column:
        own = F.aggregate(part, start(acc["carry"], "array<long>"), take)
        return bind(own, lambda o: F.struct(o["carry"].alias("carry"), F.concat(acc["ms"], F.array(o["ms"])).alias("ms")))

    folded = whole.withColumn("_ms", F.flatten(F.aggregate("_parts", start(F.lit(0.0), "array<array<long>>"), take_part, lambda acc: acc["ms"])))
    pairs = folded.select("_source", F.inline(F.arrays_zip(F.col("_classes").alias("c"), F.col("_ms").alias("m"))))
    return pairs.select("_source", F.col("c._size").alias("_size"), F.col("c._n").alias("_n"), F.col("m").alias("_m"))


def entropy_mix(docs: DataFrame, id_col: str = "doc_id", cycle: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """Documents with ``source`` and ``size`` (long) to ``source_size``, ``target`` (double), ``copies`` and ``taken`` (long).

    Copies of equal sizes of a source differ by at most one; a hash of the id decides who gets the odd ones.
    """
    added = ("source_size", "target", "copies", "taken")
    # the columns of the input travel in one struct, so none of their names can clash
    slim = docs.select(
        F.struct(*[c for c in docs.columns if c not in added]).alias("_all"), F.col(id_col).alias("_id"), "source",
        F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("_source"), F.col("size").cast("long").alias("_size"),
    )
    table = materialise(slim, "mix")
    classes = materialise(table.groupBy("_source", "source", "_size").agg(F.count(F.lit(1)).alias("_n")), "mix-classes")
    most_rows = classes.agg(F.max("_n")).first()[0] or 0
    sources = classes.groupBy("_source", "source").agg(F.sum(F.col("_n") * F.col("_size")).alias("source_size"))
    targets = materialise(token_targets(sources, cycle, most), "mix-targets")
    plain = classes.drop("source")
    copies = materialise(copies_by_size(plain, solve_rates(plain, targets, most), most), "mix-copies")
    salts = max(64, power_of_two(most_rows / ROWS_PER_SALT))
    placed = ranked(table.drop("source"), ["_source", "_size"], [F.xxhash64("_id"), F.col("_id")], salts, "_pos")
    return (
        placed.join(copies, ["_source", "_size"], "left")
        .join(targets.select("_source", "source_size", "target"), "_source")
        .withColumn("copies", F.coalesce(F.expr("_m div _n + if(_pos < _m % _n, 1, 0)"), F.lit(0)).cast("long"))
        .withColumn("taken", F.col("copies") * F.col("_size"))
        .select("_all.*", *added)
    )


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def repeat_copies(docs: DataFrame) -> DataFrame:
    """Each row of ``docs`` (doc_id, text, source and others) as often as the mix takes it; documents without words stay once.

    Copies are worked out on (key, source, size) and joined back to the rows by the key, two hashes of id, source and text, so texts
    are shuffled once. Rows equal in these three share out what the mix takes of all of them. Other columns may have any name or type.
    """
    key = ["_k1", "_k2"]
    hashes = [F.xxhash64(F.lit(i), "doc_id", "source", "text").alias(k) for i, k in enumerate(key)]
    row = docs.select(F.struct(*docs.columns).alias("_all"), *hashes, "source", word_count("text").alias("_words"))
    mix = entropy_mix(row.select(*key, "source", F.col("_words").alias("size")), "_k1")
    mixed = mix.groupBy(*key).agg(F.sum("copies").alias("_copies"), F.count(F.lit(1)).alias("_rows"))
    numbered = row.withColumn("_at", F.row_number().over(Window.partitionBy(*key).orderBy("_words")))
    share = F.expr("_copies div _rows + if(_at <= _copies % _rows, 1, 0)")
    times = F.when(F.col("_words") == 0, F.lit(1).cast("long")).otherwise(share)
    return numbered.join(mixed, key).select("_all", F.explode(F.array_repeat(F.lit(0), times.cast("int"))).alias("_i")).select("_all.*")


def op6_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to the weights 1, 2, 3, repeating over the sources in order."""
    slim = documents(spark, sf_dir).select("doc_id", "source", word_count("text").alias("size"))
    return entropy_mix(slim).select("doc_id", "size", "source_size", "target", "taken", "copies")
