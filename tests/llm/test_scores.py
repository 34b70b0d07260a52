import pickle
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from conceptloom.llm import quality, toxicity
from conceptloom.llm.common import held_out


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Documents of plain words; toxic ones hold an insult or a word with one of two stems; bad ones shout or repeat."""
    rng = random.Random(7)
    plain = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8))) for _ in range(500)]
    docs, labels = [], []
    for i in range(1500):
        w = [rng.choice(plain) for _ in range(rng.randrange(20, 120))]
        toxic, good = int(rng.random() < 0.2), int(rng.random() < 0.7)
        if toxic:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(["nasty", "vile", "zorqu" + rng.choice(plain), "brimf" + rng.choice(plain)]))
        text = " ".join(w) if good else rng.choice([" ".join(x.upper() + "!!" for x in w), " ".join(w[:2] * 30), " ".join(x + "&&&" for x in w)])
        docs.append((i, text, 1, "x"))
        if i % 2:
            labels.append((i, good, toxic))
    docs += [(None, "nothing", 1, "x"), (5000, None, 1, "x"), (5001, "", 1, "x"), (5002, "\n \t", 1, "x"), (3, docs[3][1], 1, "x")]
    folder = tmp_path_factory.mktemp("scores")
    spark.createDataFrame(docs, "doc_id long, text string, score int, predicted string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([*labels, labels[0], (None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder), {d: (q, t) for d, q, t in labels}, len(docs)


@pytest.mark.parametrize(("query", "which", "cut"), [(toxicity.op2_toxic_neighbours, 1, 0.7), (quality.op4_pairwise_quality, 0, 0.5)])
def test_held_out_accuracy_and_contract(spark, corpus, query, which, cut):
    folder, labels, n = corpus
    rows = query(spark, folder).collect()
    assert len(rows) == n
    right = []
    for r in rows:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= cut)
        assert r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 3 == 1)
        if r.held_out and r.doc_id in labels:
            right.append(r.predicted == labels[r.doc_id][which])
    assert len(right) > 150 and sum(right) / len(right) > 0.95
    empty = {r.doc_id: r.score for r in rows if r.doc_id in (5000, 5001)}
    assert len(set(empty.values())) == 1


def test_scores_without_labels_or_documents(spark, corpus):
    folder, _, _ = corpus
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    none = labels.limit(0)
    assert {r.score for r in quality.score_quality(docs, quality.train(docs, none), ["doc_id"]).collect()} == {0.5}
    assert {r.score for r in toxicity.score_toxicity(docs, toxicity.train(docs, none), ["doc_id"]).collect()} == {0.0}
    empty = docs.limit(0)
    assert toxicity.score_toxicity(empty, toxicity.train(docs, labels), ["doc_id"]).count() == 0
    assert quality.score_quality(empty, quality.train(empty, labels), ["doc_id"]).count() == 0


def test_filters_keep_columns_and_drop_what_is_predicted(spark, corpus):
    folder, labels, _ = corpus
    docs, tags = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    kept = toxicity.keep_harmless(docs, toxicity.train(docs, tags))
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    assert np.mean([(d in ids) != bool(t) for d, (_, t) in labels.items()]) > 0.95
    good = quality.keep_good(docs, quality.train(docs, tags))
    ids = {r.doc_id for r in good.select("doc_id").collect()}
    assert good.columns == docs.columns and np.mean([(d in ids) == bool(q) for d, (q, _) in labels.items()]) > 0.95


def test_held_out_labels_are_not_learned_from(spark, corpus):
    folder, _, _ = corpus
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    lying = labels.withColumn("toxic", F.when(held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.train(docs, labels), toxicity.train(docs, lying)
    assert a.terms == b.terms and a.weight.tolist() == b.weight.tolist() and a.ids == b.ids and a.labels.tolist() == b.labels.tolist()


def test_block_max_neighbours_are_exact():
    rng = np.random.default_rng(1)
    words = 40

    def vector():
        t = np.sort(rng.choice(words, rng.integers(1, 8), replace=False))
        w = rng.random(len(t)).round(1) + 0.1
        return t, w / np.sqrt(w @ w)

    examples = [vector() for _ in range(700)]
    examples += examples[:50]
    index = toxicity.BlockMaxIndex(examples, words)
    dense = np.zeros((len(examples), words))
    for i, (t, w) in enumerate(examples):
        dense[i, t] = w
    queries = [vector() for _ in range(60)] + [(np.zeros(0, int), np.zeros(0))]
    for (t, w), (ids, got) in zip(queries, index.nearest(queries, 15), strict=True):
        cosines = dense[:, t] @ w
        order = [i for i in np.lexsort((np.arange(len(cosines)), -np.round(cosines, 9))) if cosines[i] > 0][:15]
        assert got == pytest.approx(cosines[order], abs=1e-8)
        assert ids.tolist() == order
    again = pickle.loads(pickle.dumps(index)).nearest(queries, 15)
    assert all((a[0] == b[0]).all() and (a[1] == b[1]).all() for a, b in zip(again, index.nearest(queries, 15), strict=True))


def test_scores_of_the_query_equal_brute_force(spark, tmp_path):
    """Counts, weights, cosines, votes and calibration from their definitions, over dense vectors of all terms."""
    rng = random.Random(11)
    plain = ["".join(rng.choice("abcdéfgh") for _ in range(rng.randrange(2, 9))) for _ in range(300)]
    docs, labels = [], []
    for i in range(300):
        toxic = int(rng.random() < 0.3)
        w = [rng.choice(plain) for _ in range(rng.randrange(0, 60))] + ["vile"] * (2 * toxic)
        docs.append((i, " ".join(w)))
        labels.append((i, toxic if rng.random() < 0.95 else 1 - toxic))
    docs += [(300, docs[0][1]), (301, None), (302, ""), (303, " ".join(plain * 200)), (7, docs[7][1])]
    labels += [(300, 1 - labels[0][1])]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {(r.doc_id, r.score) for r in toxicity.op2_toxic_neighbours(spark, str(tmp_path)).collect()}

    stems = lambda text: Counter(x[:5] for x in re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().lower()))
    free = lambda i: zlib.crc32(str(i).encode()) % 3 != 1
    text_of, by_text = dict(docs), {}
    for i, toxic in labels:
        if free(i):
            by_text.setdefault(text_of[i], []).append((i, toxic))
    examples = sorted((int(np.mean([t for _, t in v]) >= 0.5), min(i for i, _ in v), stems(k)) for k, v in by_text.items())
    totals = [sum(free(i) and t == y for i, t in labels) for y in (0, 1)]
    terms = sorted({t for *_, c in examples for t in c})
    idf = {t: np.log((1 + len(docs)) / (1 + sum(t in stems(x) for _, x in docs))) + 1 for t in terms}

    def weights_of(chosen):
        n = [sum(y == k for y, *_ in chosen) for k in (0, 1)]
        share = lambda t, k: sum(t in c for y, _, c in chosen if y == k) / max(1, n[k]) + 20 / len(chosen)
        return {t: idf[t] * abs(np.log(share(t, 1) / share(t, 0))) for t in terms}

    def unit(counts, weight):
        v = np.array([(1 + np.log(counts[t])) * weight[t] if t in counts else 0.0 for t in terms])
        return v / np.sqrt(v @ v) if v.any() else None

    share = totals[1] / sum(totals)

    def model(chosen):
        weight = weights_of(chosen)
        held = [(y, int(np.argmax(u)), i, u) for y, i, c in chosen if (u := unit(c, weight)) is not None]
        held.sort(key=lambda e: e[:3])

        def vote(counts):
            q = unit(counts, weight)
            cosines = [] if q is None else [(round(float(u @ q), 9), -at, y) for at, (y, _, _, u) in enumerate(held)]
            near = [(c, y) for c, _, y in sorted(cosines, reverse=True)[:15] if c > 0]
            return (sum(c * c * y for c, y in near) + 0.1 * share) / (sum(c * c for c, _ in near) + 0.1) if near else None

        return vote

    size = [sum(y == k for y, *_ in examples) for k in (0, 1)]
    votes, bare = [], [0, 0]
    for f in range(4):
        vote = model([e for at, e in enumerate(examples) if at % 4 != f])
        for y, _, c in examples[f::4]:
            if (v := vote(c)) is None:
                bare[y] += 1
            else:
                votes.append((v, y, totals[y] / size[y]))
    x, y = toxicity.calibrate(*(np.array(c, float) for c in zip(*votes, strict=True)))
    loose = [n * totals[k] / size[k] for k, n in enumerate(bare)]
    alone = (loose[1] + 0.5 * share) / (sum(loose) + 0.5)
    vote = model(examples)
    want = {i: alone if (v := vote(stems(t))) is None else float(np.interp(v, x, y)) for i, t in docs}
    assert len(got) == len(want)
    for i, score in got:
        assert score == pytest.approx(want[i], abs=1e-6), i


def test_calibration_rises():
    rng = np.random.default_rng(2)
    v = rng.random(500)
    x, y = toxicity.calibrate(v, (rng.random(500) < v).astype(float), np.ones(500))
    assert (np.diff(x) > 0).all() and (np.diff(y) >= 0).all() and ((y >= 0) & (y <= 1)).all()


def test_bradley_terry_equals_newton_over_listed_pairs(monkeypatch):
    rng = np.random.default_rng(3)
    winners, losers = rng.normal(0.5, 1, size=(70, 3)), rng.normal(size=(50, 3))
    differences = (winners[:, None, :] - losers[None, :, :]).reshape(-1, 3)
    want, ridge = np.zeros(3), 0.01 * len(differences)
    for _ in range(30):
        p = 1 / (1 + np.exp(-differences @ want))
        curvature = (differences * (p * (1 - p))[:, None]).T @ differences + ridge * np.eye(3)
        want += np.linalg.solve(curvature, differences.T @ (1 - p) - ridge * want)
    for rows in (7, 500):
        monkeypatch.setattr(quality, "ROWS", rows)
        assert quality.bradley_terry(winners, losers, 0.01) == pytest.approx(want, abs=1e-4)


def test_quality_threshold_is_the_best_quantile():
    rng = np.random.default_rng(4)
    y = (rng.random(400) < 0.6).astype(int)
    x = np.zeros((400, len(quality.FEATURES)))
    x[:, 0] = y + rng.normal(0, 0.6, 400)
    model = quality.fit(x, y)
    s = model.raw(x)
    balance = lambda t: np.mean(s[y == 1] >= t) + np.mean(s[y == 0] < t)
    assert balance(model.threshold) == pytest.approx(max(balance(t) for t in [*s, s.max() + 1]))
    assert model.threshold == pytest.approx(np.quantile(s, model.level)) and np.mean(s < model.threshold) == pytest.approx(model.level, abs=0.01)
    one = quality.fit(x, np.array([1, *np.zeros(399, int)]))
    assert np.isfinite(one.threshold) and np.isfinite(one.raw(x)).all()


def test_terms_are_stems_of_all_words():
    assert toxicity.terms_of(b"Loweiig a lowei, a") == [b"lowei", b"a", b"lowei", b"a"]
    text, term, times = toxicity.Vocabulary([b"a", b"lowei", b"z"]).counts([b"", b"Loweiig a b lowei", b"z"])
    assert list(zip(text.tolist(), term.tolist(), times.tolist(), strict=True)) == [(1, 0, 1), (1, 1, 2), (2, 2, 1)]
