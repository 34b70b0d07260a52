"""GloVe keeps co-occurrences packed and sends a vector once to a block of words."""

import random
from collections import defaultdict

import numpy as np
import pytest

from conceptloom.operators import glove


def weights(sequences, window=None):
    x = defaultdict(float)
    for s in sequences:
        for i in range(len(s or [])):
            for j in range(i + 1, min(len(s), len(s) if window is None else i + window + 1)):
                if s[i] is not None and s[j] is not None:
                    x[s[i], s[j]] += 1 / (j - i)
                    x[s[j], s[i]] += 1 / (j - i)
    return x


def corpus(seed=5):
    """Word 7 is in every sequence; some places and a sequence are unknown, some sequences short."""
    rng = random.Random(seed)
    rows = [[7] + [rng.choice([None, *range(-3, 40), 10**12]) if rng.random() < 0.9 else 7 for _ in range(rng.randrange(9))] for _ in range(200)]
    return [*rows, None, [], [99]]


@pytest.fixture
def small(monkeypatch):
    for name, value in (("PENDING", 50), ("CHUNK", 20), ("NUMBERS", 40)):
        monkeypatch.setattr(glove, name, value)


@pytest.mark.parametrize("window", [None, 2])
def test_packed_weights_are_those_of_all_pairs(spark, small, window):
    rows = corpus()
    got = glove.corpus_weights(spark.createDataFrame([(r,) for r in rows], "concepts array<long>"), window).collect()
    want = weights(rows, window)
    assert len(got) == len(want) and {(r.c1, r.c2): pytest.approx(r.x) for r in got} == want


def test_sweeps_are_ridge_regressions_on_all_cells(spark, small):
    rows, d = corpus(), 3
    ids, target, context = glove.train(spark.createDataFrame([(r,) for r in rows], "concepts array<long>"), dimensions=d, sweeps=2, x_max=5.0)
    cells = defaultdict(list)
    for (a, b), x in weights(rows).items():
        cells[a].append((b, x))
    side = {r.word: np.array(r.v) for r in glove._start(ids, d + 1, 0).collect()}
    for _ in range(4):
        last, side = side, {}
        for a, seen in cells.items():
            v = np.array([[*last[b][:d], 1] for b, _ in seen])
            f, y = np.array([min(1, (x / 5) ** 0.75) for _, x in seen]), np.array([np.log(x) - last[b][d] for b, x in seen])
            side[a] = np.linalg.solve((v.T * f) @ v + 0.1 * np.eye(d + 1), v.T @ (f * y))
    names = {r.id: r.standard_concept_id for r in ids.collect()}
    for table, want in ((context, side), (target, last)):
        got = {names[r.id]: [*r.vector, r.bias] for r in table.collect()}
        assert set(got) == set(want) == {c for c in names.values() if c not in (None, 99)} and all(np.allclose(got[c], want[c]) for c in got)


def test_vectors_are_not_shuffled_with_each_cell(spark):
    rng = random.Random(1)
    rows = [(rng.sample(range(300), 60),) for _ in range(100)]
    cells = len(weights([r for r, in rows]))
    frame = spark.createDataFrame(rows, "concepts array<long>")
    written = lambda: sum(e.totalShuffleWrite() for e in (lambda l: [l.apply(i) for i in range(l.size())])(spark.sparkContext._jsc.sc().statusStore().executorList(False)))
    before = written()
    glove.train(frame, dimensions=8, sweeps=2)
    assert written() - before < 72 * cells  # what one vector with each cell takes, and four times that would be shuffled


def test_without_a_pair_there_are_no_vectors(spark):
    ids, target, context = glove.train(spark.createDataFrame([([4],), (None,)], "concepts array<long>"), dimensions=2, sweeps=1)
    assert ids.count() == 1 and target.count() == 0 and context.count() == 0
