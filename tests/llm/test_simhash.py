import random
from collections import Counter
from itertools import combinations

import pyarrow as pa
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from conceptloom.llm import graph, simhash


def brute_fingerprint(text, width):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    grams = [b" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))]
    hashes = [xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    parent = {p: p for p in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(prints, 2):
        if (a ^ b).bit_count() <= 3:
            parent[find(a)] = find(b)
    return {p: find(p) for p in prints}


def test_op5_against_brute_force(spark, folder, docs, texts):
    rows = simhash.op5_simhash_balls(spark, folder).collect()
    prints = {i: brute_fingerprint(t, 3) for i, t in enumerate(texts)}
    assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in docs.collect())
    assert all(r.fingerprint == f"{prints[r.doc_id]:016x}" for r in rows)
    root = brute_components(sorted(set(prints.values())))
    least = {}
    for i, p in sorted(prints.items(), reverse=True):
        least[root[p]] = i
    assert all(r.component_id == least[root[prints[r.doc_id]]] for r in rows)


def test_long_texts_are_hashed_in_parts(monkeypatch):
    text = " ".join(f"x{i % 97}" for i in range(3000))
    whole = simhash.simhash(text.encode(), 3, 42)
    monkeypatch.setattr(simhash, "_CHUNK", 64)
    assert simhash.simhash(text.encode(), 3, 42) == whole == brute_fingerprint(text, 3)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_links_connect_every_ball_and_nothing_else(spark):
    """Chains, scattered points, and a crowd around one point that is dense enough for the second ball."""
    rng = random.Random(2)
    points = {rng.getrandbits(64) for _ in range(60)}
    for p in list(points)[:12]:
        for k in (1, 2, 3, 4):
            q = p
            for b in rng.sample(range(64), k):
                q ^= 1 << b
            points.add(q)
    centre = rng.getrandbits(64)
    crowd = {centre ^ sum(1 << b for b in rng.sample(range(32), k)) for k in (0, 1, 2, 3) for _ in range(700)}
    crowd = set(sorted(crowd)[:1700])
    points |= crowd
    df = spark.createDataFrame([(signed(p),) for p in points], "fp long")
    edges = simhash.links(df).collect()
    mask = (1 << 64) - 1
    assert all(0 < ((r.a ^ r.b) & mask).bit_count() <= 3 for r in edges)
    assert len(edges) < 60 * len(points)
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = brute_components(sorted(points))
    groups = {}
    for p, r in want.items():
        groups.setdefault(r, set()).add(signed(p))
    assert {frozenset(g) for g in groups.values() if len(g) > 1} == {frozenset(n for n, r in got.items() if r == root) for root in set(got.values())}


def test_whole_balls_give_every_link_and_the_same_components(spark):
    rng = random.Random(12)
    prints = {rng.getrandbits(64) for _ in range(30)}
    for fp in list(prints):
        for flips in (1, 2, 3, 4):
            prints.add(fp ^ sum(1 << b for b in rng.sample(range(64), flips)))
    signed = sorted(p - (1 << 64) if p >> 63 else p for p in prints)
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    near = lambda a, b: bin((a ^ b) & ((1 << 64) - 1)).count("1") <= 3
    want = {(a, b) for i, a in enumerate(signed) for b in signed[i + 1 :] if near(a, b)}
    whole = simhash.whole_ball_links(df)
    assert {tuple(r) for r in whole.collect()} == want
    roots = lambda x: sorted(map(tuple, graph.components(x).collect()))
    assert roots(whole) == roots(simhash.links(df))


def test_components_of_a_long_chain_and_of_nothing(spark):
    chain = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    rows = graph.components(chain).collect()
    assert len(rows) == 201 and {r.root for r in rows} == {0}
    assert graph.components(chain.limit(0)).count() == 0


def test_keep_one_keeps_the_smallest_id_of_each_group(spark, docs, texts, nobody):
    kept = simhash.keep_one(docs, width=3, similarity=None)
    assert kept.columns == docs.columns
    prints = {i: brute_fingerprint(t, 3) for i, t in enumerate(texts)}
    root = brute_components(sorted(set(prints.values())))
    want = {}
    for i, p in sorted(prints.items(), reverse=True):
        want[root[p]] = i
    assert Counter(r.doc_id for r in kept.collect()) == Counter(want.values())
    assert simhash.keep_one(nobody).count() == 0


def shingles(text, width=5):
    w = (text or "").encode().lower().split()
    return frozenset(b" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()


def test_similar_texts_against_brute_force(spark):
    """Copies with a few changed words, copies of copies, exact copies, a shared passage, and unlike texts."""
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(5000)}"
    passage = [word() for _ in range(60)]
    texts = [None, "", "\n", "a b", "a b", "a c"]
    for _ in range(40):
        base = [word() for _ in range(rng.randrange(60, 300))]
        texts.append(" ".join(base))
        for _ in range(4):
            base = list(base)
            for _ in range(rng.randrange(1, max(2, len(base) // 60))):
                base[rng.randrange(len(base))] = word()
            texts.append(" ".join(base))
        texts += [texts[-1], " ".join([word() for _ in range(150)] + passage)]
    sets = [shingles(t) for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in combinations(range(len(texts)), 2):
        a, b = sets[i], sets[j]
        if (not a and not b) or (a and b and len(a & b) >= 0.8 * len(a | b)):
            parent[max(find(i), find(j))] = min(find(i), find(j))
    rows = simhash.similar_texts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in rows} == {i: find(i) for i in range(len(texts))}


def test_crowded_bands_are_compared_in_full(spark, monkeypatch):
    """Texts that share a long passage, too little to be linked, and pairs among them that are just similar enough."""
    monkeypatch.setattr(simhash, "BLOCK", 64)
    rng = random.Random(9)
    word = lambda: f"w{rng.randrange(10**6)}"
    passage = [word() for _ in range(170)]
    texts = []
    for k in range(900):
        own = [word() for _ in range(28)]
        texts.append(" ".join(passage + own))
        if k % 5 == 0:
            texts.append(" ".join(passage + own[:10] + [word() for _ in range(18)]))
    sets = [shingles(t) for t in texts]
    alike = lambda a, b: len(a & b) >= 0.8 * len(a | b)
    assert not alike(sets[0], sets[2])
    pairs = [(i, i + 1) for i in range(len(texts) - 1) if alike(sets[i], sets[i + 1])]
    assert len(pairs) == 180
    rows = simhash.similar_texts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    got = {r.doc_id: r.component_id for r in rows}
    linked = dict((j, i) for i, j in pairs)
    assert got == {i: linked.get(i, i) for i in range(len(texts))}


def test_common_counts_against_sets(monkeypatch):
    monkeypatch.setattr(simhash, "COLUMNS", 7)
    import numpy as np

    rng = random.Random(1)
    a, b = ([np.array(sorted(rng.sample(range(90), rng.randrange(0, 40))), "<u4") for _ in range(n)] for n in (9, 5))
    assert simhash._common(a, b).tolist() == [[len(set(x.tolist()) & set(y.tolist())) for y in b] for x in a]


def test_null_ids_never_name_a_component(spark):
    df = spark.createDataFrame([(None, "same text here"), (4, "same text here"), (None, "quite another one")], "doc_id long, text string")
    rows = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(df, 3).collect()}
    assert rows == {(None, 4), (4, 4), (None, None)}
    assert pa.array([1]).type == pa.int64()


def test_tables_that_grow_are_not_broadcast(spark, docs, monkeypatch):
    plans = []
    write = simhash.materialise

    def seen(df, name):
        plans.append((name, df._jdf.queryExecution().sparkPlan().toString()))
        return write(df, name)

    monkeypatch.setattr(simhash, "materialise", seen)
    monkeypatch.setattr(graph, "materialise", seen)
    for found in (simhash.near_duplicates(docs, 3), simhash.keep_one(docs)):
        plans.append(("result", found._jdf.queryExecution().sparkPlan().toString()))
    assert len(plans) > 10 and [name for name, plan in plans if "BroadcastHashJoin" in plan] == []
