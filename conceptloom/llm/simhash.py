"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A 64-bit fingerprint holds the majority of each bit over the hashes of all word shingles of a text. Two fingerprints with at most
three differing bits have a 32-bit half with at most one differing bit, half the radius. Every distinct fingerprint therefore
emits all variants of each half within one bit (66 in all, where whole fingerprints would need 2,081), variants are shuffled to
the fingerprints whose own half they equal, and colliding pairs are verified on all 64 bits. Variants that meet no fingerprint are
dropped by the join, and pairs are found once each whatever the number of equal texts, as only distinct fingerprints are linked.

Similar texts (``similar_texts``, ``keep_one``) are a wider relation: texts that share 0.8 of their five-word shingles differ by about
ten bits of a fingerprint, far outside of any ball that can be emitted. There the links of the balls are joined by candidates that share
a band of smallest shingle hashes, and every candidate is verified on the whole shingle sets. In a bucket of a band each text is first
compared with its smallest and largest member, and with those of the part that shares the next band as well, which links most copies
in linear work. In buckets that then still hold several components, all pairs of texts of different components are compared, block
against block, so every pair that shares a band is either linked already or verified. The largest component of a bucket is not compared
with itself, so a bucket of one group of copies and a few others costs no more than its rows.

A bucket is joined pair by pair only while this costs less than hashing a second ball, in the other half. In a dense bucket the
other halves emit their own variants, within one and two bits. All members of such a second bucket are within the radius of its
nearest members, so each is linked to the smallest of these and no pair is enumerated. Both ways give the same components; the
work stays in proportion to the number of fingerprints.

Edge cases: null and empty texts have fingerprint zero and are linked like any other; texts with fewer words than a shingle hash
their whole sequence; equal texts and repeated rows share a fingerprint and get one component; a null id joins the component of
its text and never names one; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from conceptloom.llm.common import documents, in_bytes, materialise, shuffled
from conceptloom.llm.graph import components

RADIUS = 3
_CHUNK = 1 << 16
#: Texts of a block, and shingles counted at once, where a bucket is compared in full.
BLOCK, COLUMNS = 256, 4096
#: Of the search for similar texts: bands of smallest hashes, and hashes in each. At similarity 0.8 a pair shares one with 0.998.
BANDS, ROWS = 16, 5


def shingle_hashes(text: bytes, width: int, seed: int) -> Iterator[np.ndarray]:
    """Unsigned hashes of all word shingles of a whole text, in parts; ASCII letters are lowered, words end at ASCII white space."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    for at in range(0, max(1, len(words) - width + 1) if words else 0, _CHUNK):
        part = words[at : at + _CHUNK + width - 1]
        grams = [b" ".join(part)] if len(words) < width else list(map(b" ".join, zip(*(part[k:] for k in range(width)), strict=False)))
        yield np.array([xxh64_intdigest(g, seed) for g in grams], np.uint64)


def majority(parts: list[np.ndarray]) -> int:
    """The unsigned fingerprint of hashes: bits that are set in over half of them."""
    counts, n = np.zeros(64, np.int64), 0
    for hashes in parts:
        n += len(hashes)
        bits = np.unpackbits(hashes.view(np.uint8), bitorder="little").view(np.uint64).reshape(-1, 8)
        # up to 255 rows are added as packed bytes before they are widened
        counts += np.add.reduceat(bits, np.arange(0, len(bits), 255), axis=0).view(np.uint8).reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def simhash(text: bytes, width: int, seed: int) -> int:
    return majority(list(shingle_hashes(text, width, seed)))


def band_keys(parts: list[np.ndarray], bands: int = BANDS, rows: int = ROWS) -> list[int]:
    """A hash of each band of smallest permuted shingle hashes, as signed longs; none for no shingles."""
    from xxhash import xxh64_intdigest

    if not parts:
        return []
    multipliers = np.random.default_rng(1).integers(0, 1 << 63, bands * rows, np.uint64) * np.uint64(2) + np.uint64(1)
    least = np.full(bands * rows, np.iinfo(np.uint64).max, np.uint64)
    for hashes in parts:
        for at in range(0, len(hashes), 2048):
            least = np.minimum(least, (hashes[at : at + 2048, None] * multipliers[None, :]).min(axis=0))
    keys = [xxh64_intdigest(least[b * rows : (b + 1) * rows].tobytes(), b) for b in range(bands)]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def fingerprints(docs: DataFrame, width: int, seed: int = 42, with_bands: bool = False) -> DataFrame:
    """(doc_id, text) to (doc_id, text_hash, fp): the fingerprint as a signed long, bit 63 being the sign; also ``bands`` if asked."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, bands = np.zeros(batch.num_rows, np.uint64), []
            for i, text in enumerate(in_bytes(batch.column(1))):
                parts = list(shingle_hashes(text, width, seed))
                fps[i] = majority(parts)
                if with_bands:
                    bands.append(band_keys(parts))
            columns, names = [batch.column(0), batch.column(2), pa.array(fps.view(np.int64))], ["doc_id", "text_hash", "fp"]
            yield pa.RecordBatch.from_arrays(columns + ([pa.array(bands, pa.list_(pa.int64()))] if with_bands else []), names=names + (["bands"] if with_bands else []))

    slim = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    return slim.mapInArrow(of, f"doc_id {dict(slim.dtypes)['doc_id']}, text_hash long, fp long" + (", bands array<long>" if with_bands else ""))


def _half(fp: Column, half: Column) -> Column:
    low = F.lit(0xFFFFFFFF).cast("long")
    return F.when(half == 0, F.shiftrightunsigned(fp, 32)).otherwise(fp.bitwiseAND(low))


def _key(half: Column, bits: Column) -> Column:
    return half.cast("long") * F.lit(1 << 32).cast("long") + bits


def _flip(i: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), i)


def _halves() -> Column:
    return F.explode(F.array(F.lit(0), F.lit(1)))


def _distance(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def links(fps: DataFrame) -> DataFrame:
    """Distinct longs ``fp`` to links (a, b) that connect exactly the fingerprints within RADIUS of each other."""
    own = fps.select("fp", _halves().alias("half")).select("fp", _key(F.col("half"), _half(F.col("fp"), F.col("half"))).alias("key"))
    own_counts = own.groupBy("key").agg(F.count(F.lit(1)).alias("n_own"))
    variants = (
        fps.select("fp", _halves().alias("half"))
        .select("fp", "half", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("bit"))
        .select("fp", _key(F.col("half"), _half(F.col("fp"), F.col("half")).bitwiseXOR(_flip(F.col("bit")))).alias("key"))
    )
    near = materialise(variants.join(shuffled(own_counts), "key"), "simhash-near").drop("n_own")
    costs = own_counts.join(shuffled(near.groupBy("key").agg(F.count(F.lit(1)).alias("n_near"))), "key", "left").select("key", "n_own", F.coalesce("n_near", F.lit(0)).alias("n_near"))
    pairs = F.col("n_own") * (F.col("n_own") - 1) / 2 + F.col("n_own") * F.col("n_near")
    balls = F.col("n_own") * (1 + 32 + 496) + F.col("n_near") * 33
    costs = materialise(costs.where(pairs > 0).select("key", (pairs > balls).alias("dense")), "simhash-costs")
    own = materialise(own.join(shuffled(costs), "key"), "simhash-own")
    near = materialise(near.join(shuffled(costs), "key"), "simhash-met")
    everyone = own.select("key", "dense", F.col("fp").alias("other"), F.lit(False).alias("is_near")).unionByName(near.select("key", "dense", F.col("fp").alias("other"), F.lit(True).alias("is_near")))
    met = own.where("not dense").select("key", "fp").join(shuffled(everyone.where("not dense")), "key").where((F.col("is_near") | (F.col("fp") < F.col("other"))) & (_distance("fp", "other") <= RADIUS))
    sparse = met.select(F.least("fp", "other").alias("a"), F.greatest("fp", "other").alias("b"))

    rest = F.when(F.col("key") < (1 << 32), F.col("other").bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))).otherwise(F.shiftrightunsigned("other", 32))
    one = F.concat(F.array(F.lit(0).cast("long")), F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: _flip(i)))
    two = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(30)), lambda i: F.transform(F.sequence(i + 1, F.lit(31)), lambda j: _flip(i) + _flip(j))))
    crowd = everyone.where("dense").withColumn("rest", rest)
    balls = crowd.select("key", "other", (~F.col("is_near")).alias("centre"), "rest", F.explode(one).alias("flip")).unionByName(
        crowd.where("not is_near").select("key", "other", F.lit(False).alias("centre"), "rest", F.explode(two).alias("flip"))
    )
    balls = balls.select("key", "other", "centre", F.col("rest").bitwiseXOR(F.col("flip")).alias("spot"))
    centres = balls.where("centre").groupBy("key", "spot").agg(F.min("other").alias("hub"))
    stars = balls.join(shuffled(centres), ["key", "spot"]).where("other != hub").select(F.least("other", "hub").alias("a"), F.greatest("other", "hub").alias("b"))
    return sparse.unionByName(stars).distinct()


def whole_ball_links(fps: DataFrame) -> DataFrame:
    """Distinct longs ``fp`` to all links (a, b) within RADIUS, by balls around whole fingerprints.

    Every fingerprint emits its variants within half the radius, rounded down, as places to be met, and those within half the radius,
    rounded up, as visitors: 65 and 2,081. Both are shuffled by the variant, and colliding pairs are made distinct and verified. The
    links are those that links() connects, for 32 times the rows, and a hot variant is split only as far as adaptive joins split it.
    """
    zero = F.array(F.lit(0).cast("long"))
    one = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: _flip(i))
    two = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(62)), lambda i: F.transform(F.sequence(i + 1, F.lit(63)), lambda j: _flip(i).bitwiseOR(_flip(j)))))
    places = fps.select("fp", F.explode(F.concat(zero, one)).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("variant"))
    visitors = fps.select(F.col("fp").alias("other"), F.explode(F.concat(zero, one, two)).alias("flip")).select("other", F.col("other").bitwiseXOR(F.col("flip")).alias("variant"))
    met = places.join(shuffled(visitors), "variant").where((F.col("fp") != F.col("other")) & (_distance("fp", "other") <= RADIUS))
    return met.select(F.least("fp", "other").alias("a"), F.greatest("fp", "other").alias("b")).distinct()


def near_duplicates(docs: DataFrame, width: int = 5, seed: int = 42) -> DataFrame:
    """(doc_id, text) to (doc_id, text_hash, fp, component_id, keeper), one row per row of ``docs``.

    ``component_id`` is the smallest id of the component; ``keeper`` the (no_id, doc_id, text_hash) of the row that represents it.
    """
    prints = materialise(fingerprints(docs, width, seed), "simhash")
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    distinct = materialise(prints.groupBy("fp").agg(F.min(row).alias("first_row")), "simhash-distinct")
    roots = distinct.join(shuffled(components(links(distinct.select("fp"))).withColumnRenamed("node", "fp")), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    roots = materialise(roots, "simhash-roots")
    keepers = materialise(roots.groupBy("root").agg(F.min("first_row").alias("keeper")), "simhash-keepers")
    named = materialise(roots.join(shuffled(keepers), "root").select("fp", "keeper"), "simhash-named")
    return prints.join(shuffled(named), "fp").select("doc_id", "text_hash", "fp", F.col("keeper.doc_id").alias("component_id"), "keeper")


def _candidates(texts: DataFrame) -> DataFrame:
    """Distinct (text_hash, fp, bands) to pairs (a < b) of text hashes that may be similar."""
    first = materialise(texts.groupBy("fp").agg(F.min("text_hash").alias("first")), "similar-prints")
    same_print = texts.join(shuffled(first), "fp").select(F.col("text_hash").alias("x"), F.col("first").alias("y"))
    ball = materialise(links(first.select("fp")), "similar-balls")
    of = lambda c, out: shuffled(first.select(F.col("fp").alias(c), F.col("first").alias(out)))
    balls = ball.join(of("a", "x"), "a").join(of("b", "y"), "b").select("x", "y")
    following = F.concat(F.slice("bands", 2, BANDS - 1), F.slice("bands", 1, 1))
    keys = F.explode(F.concat("bands", F.transform(F.arrays_zip(F.col("bands").alias("k"), following.alias("n")), lambda p: F.xxhash64(p["k"], p["n"]))))
    in_bands = materialise(texts.where("size(bands) > 0").select("text_hash", keys.alias("key")), "similar-bands")
    ends = in_bands.groupBy("key").agg(F.min("text_hash").alias("low"), F.max("text_hash").alias("high")).where("low != high")
    stars = in_bands.join(shuffled(ends), "key").select(F.col("text_hash").alias("x"), F.explode(F.array("low", "high")).alias("y"))
    pairs = same_print.unionByName(balls).unionByName(stars).where("x != y")
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _shingle_sets(rows: DataFrame, width: int, seed: int) -> DataFrame:
    """(text_hash, text) to (text_hash, shingles): the distinct shingle hashes, sorted, folded to 32 bits."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = []
            for text in in_bytes(batch.column(1)):
                parts = list(shingle_hashes(text, width, seed))
                sets.append(np.unique((np.concatenate(parts) >> np.uint64(32)).astype("<u4")).tobytes() if parts else b"")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["text_hash", "shingles"])

    return rows.select("text_hash", "text").mapInArrow(of, "text_hash long, shingles binary")


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose shingle sets have that Jaccard similarity."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_py(), "<u4"), np.frombuffer(y.as_py(), "<u4")
                common = len(np.intersect1d(x, y, assume_unique=True)) if len(x) and len(y) else 0
                keep.append(common >= similarity * (len(x) + len(y) - common) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    of_side = lambda c: shuffled(sets.select(F.col("text_hash").alias(c), F.col("shingles").alias(f"s{c}")))
    return pairs.join(of_side("a"), "a").join(of_side("b"), "b").select("a", "b", "sa", "sb").mapInArrow(of, "a long, b long")


def _common(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many values each array of ``a`` shares with each of ``b``; the values of an array are distinct."""
    counts = np.zeros((len(a), len(b)), np.float32)
    shared = np.intersect1d(np.concatenate(a), np.concatenate(b))

    def places(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        values, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        at = np.minimum(np.searchsorted(shared, values), len(shared) - 1)
        known = shared[at] == values
        order = np.argsort(at[known], kind="stable")
        return at[known][order], owner[known][order]

    if not len(shared):
        return counts
    (at_a, own_a), (at_b, own_b) = places(a), places(b)
    for low in range(0, len(shared), COLUMNS):
        parts = []
        for at, own, n in ((at_a, own_a, len(a)), (at_b, own_b, len(b))):
            here = slice(*np.searchsorted(at, [low, low + COLUMNS]))
            part = np.zeros((n, min(COLUMNS, len(shared) - low)), np.float32)
            part[own[here], at[here] - low] = 1
            parts.append(part)
        counts += parts[0] @ parts[1].T
    return counts


def _similar_in_blocks(key: int, a: pa.Table, b: pa.Table, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions in two blocks of the bucket ``key`` of the pairs of different components that have that similarity, and that share no
    band before this one."""
    sides = []
    for t in (a, b):
        sides.append((t["root"].to_numpy(), np.array(t["bands"].to_pylist(), np.int64), [np.frombuffer(x, "<u4") for x in t["shingles"].to_pylist()]))
    (root_a, bands_a, sets_a), (root_b, bands_b, sets_b) = sides
    size_a, size_b = np.array([len(x) for x in sets_a]), np.array([len(x) for x in sets_b])
    open_ = (root_a[:, None] != root_b[None, :]) & (np.minimum(size_a[:, None], size_b[None, :]) >= similarity * np.maximum(size_a[:, None], size_b[None, :]) - 1e-9)
    for q in range(bands_a[0].tolist().index(key)):
        open_ &= bands_a[:, q, None] != bands_b[None, :, q]
    rows, columns = np.flatnonzero(open_.any(1)), np.flatnonzero(open_.any(0))
    if not len(rows):
        return rows, columns
    common = _common([sets_a[i] for i in rows], [sets_b[i] for i in columns]).astype(np.float64)
    both = size_a[rows][:, None] + size_b[columns][None, :] - common
    x, y = np.nonzero(open_[np.ix_(rows, columns)] & (common >= similarity * both - 1e-9))
    return rows[x], columns[y]


def _crowded(texts: DataFrame, roots: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) between texts of different components that share a band and have that similarity.

    ``texts`` has (text_hash, bands), ``roots`` (text_hash, root) of the linked ones, ``sets`` the shingles of all that share a band.
    """
    rooted = texts.where("size(bands) > 0").join(shuffled(roots), "text_hash", "left").withColumn("root", F.coalesce("root", "text_hash"))
    members = rooted.select("text_hash", "root", F.explode("bands").alias("key"))
    by_root = members.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"))
    buckets = by_root.groupBy("key").agg(F.sum("n").alias("n_all"), F.max(F.struct("n", "root")).alias("top"), F.count(F.lit(1)).alias("n_roots")).where("n_all > 3 and n_roots > 1")
    blocks = lambda n: F.ceil(n / F.lit(BLOCK)).cast("int")
    buckets = buckets.select("key", F.col("top.root").alias("top"), blocks(F.col("top.n")).alias("n_top"), blocks(F.col("n_all") - F.col("top.n")).alias("n_rest"))
    # blocks of the rest are 0 to n_rest - 1, those of the largest component follow
    held = members.join(shuffled(buckets), "key").withColumn("is_top", F.col("root") == F.col("top"))
    spread = F.xxhash64("text_hash", F.lit(7))
    held = held.withColumn("own", F.when(F.col("is_top"), F.col("n_rest") + F.pmod(spread, F.col("n_top"))).otherwise(F.pmod(spread, F.col("n_rest"))).cast("int"))
    others = F.sequence(F.lit(0), F.when(F.col("is_top"), F.col("n_rest") - 1).otherwise(F.col("n_rest") + F.col("n_top") - 1))
    dealt = held.select("key", "text_hash", "root", "own", F.explode(others).alias("other"))
    dealt = dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "text_hash", "root")
    dealt = dealt.join(shuffled(texts.select("text_hash", "bands")), "text_hash").join(shuffled(sets), "text_hash")

    def of(group: tuple, table: pa.Table) -> pa.Table:
        key, i, j = (x.as_py() for x in group)
        own = table["own"].to_numpy()
        a, b = table.filter(pa.array(own == i)), table.filter(pa.array(own == j))
        x, y = _similar_in_blocks(key, a, b, similarity) if a.num_rows and b.num_rows else (np.zeros(0, np.int64),) * 2
        left, right = a["text_hash"].to_numpy()[x], b["text_hash"].to_numpy()[y]
        return pa.table({"a": np.minimum(left, right), "b": np.maximum(left, right)})

    return dealt.groupBy("key", "i", "j").applyInArrow(of, "a long, b long")


def similar_texts(docs: DataFrame, width: int = 5, similarity: float = 0.8, seed: int = 42) -> DataFrame:
    """(doc_id, text) to (doc_id, text_hash, component_id, keeper), as near_duplicates() returns them, for texts linked by shingle sets
    of at least that Jaccard similarity. Texts without words are one component."""
    prints = materialise(fingerprints(docs, width, seed, with_bands=True), "similar")
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    wordless = F.size("bands") == 0
    by_text = materialise(prints.groupBy("text_hash").agg(F.min(row).alias("first_row"), F.first("fp").alias("fp"), F.first("bands").alias("bands")), "similar-texts")
    pairs = materialise(_candidates(by_text.select("text_hash", "fp", "bands")), "similar-pairs")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("text_hash")).distinct().join(shuffled(by_text.select("text_hash", "first_row.doc_id")), "text_hash").toDF("_hash", "_id")
    chosen = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).join(shuffled(wanted), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")))
    # made distinct before they are written, so that the joins read plain shuffles, whose hot keys adaptive execution splits
    sets = materialise(_shingle_sets(chosen, width, seed).dropDuplicates(["text_hash"]), "similar-sets")
    empty = by_text.where(wordless).select(F.col("text_hash").alias("a")).crossJoin(by_text.where(wordless).agg(F.min("text_hash").alias("b"))).where("a != b")
    found = materialise(_verified(pairs, sets, similarity).unionByName(empty), "similar-links")
    first_roots = materialise(components(found).toDF("text_hash", "root"), "similar-roots")
    crowded = materialise(_crowded(by_text.select("text_hash", "bands"), first_roots, sets, similarity), "similar-crowded")
    roots = first_roots if crowded.isEmpty() else components(found.unionByName(crowded)).toDF("text_hash", "root")
    rooted = materialise(by_text.select("text_hash", "first_row").join(shuffled(roots), "text_hash", "left").withColumn("root", F.coalesce("root", "text_hash")), "similar-rooted")
    keepers = materialise(rooted.groupBy("root").agg(F.min("first_row").alias("keeper")), "similar-keepers")
    named = materialise(rooted.join(shuffled(keepers), "root").select("text_hash", "keeper"), "similar-named")
    return prints.select("doc_id", "text_hash").join(shuffled(named), "text_hash").select("doc_id", "text_hash", F.col("keeper.doc_id").alias("component_id"), "keeper")


def keep_one(docs: DataFrame, width: int = 5, similarity: float | None = 0.8) -> DataFrame:
    """One row of each component of similar texts: the one with the smallest doc_id (a null id last), of repeated rows any one.
    Without ``similarity`` the components are those of the fingerprints alone."""
    found = near_duplicates(docs, width) if similarity is None else similar_texts(docs, width, similarity)
    keepers = found.select("keeper").distinct().select(F.col("keeper.doc_id").alias("_id"), F.col("keeper.text_hash").alias("_hash"))
    hashed = docs.select(F.struct(*docs.columns).alias("_all"), F.col("doc_id").alias("_own"), F.xxhash64("text").alias("_text_hash"))
    kept = hashed.join(shuffled(keepers), F.col("_own").eqNullSafe(F.col("_id")) & (F.col("_text_hash") == F.col("_hash")), "left_semi")
    copy = F.row_number().over(Window.partitionBy("_own", "_text_hash").orderBy("_text_hash"))
    return kept.withColumn("_copy", copy).where("_copy = 1").select("_all.*")


def op5_simhash_balls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints over three-word shingles of all documents and their components."""
    found = near_duplicates(documents(spark, sf_dir), width=3)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
