"""All pairs of vectors over several blocks."""

import numpy as np
import pytest

from conceptloom.operators import embeddings


@pytest.fixture
def vectors():
    return np.random.default_rng(5).normal(size=(23, 3))


@pytest.fixture
def embedding(spark, vectors, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 4)
    return spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)], "standard_concept_id long, vector array<double>")


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_blocks_meet_without_a_shuffle_of_their_pairs(embedding, vectors, metric):
    made = embeddings.pairwise(embedding, metric)
    plan = made._jdf.queryExecution().optimizedPlan().toString().split("\n")
    join = next(k for k, line in enumerate(plan) if "Join" in line)
    assert not any("Repartition" in line for line in plan[:join])
    got = {(r.concept_id_1, r.concept_id_2): r.metric for r in made.collect()}
    size = np.linalg.norm(vectors, axis=1)
    whole = vectors @ vectors.T / size[:, None] / size if metric == "cosine" else np.linalg.norm(vectors[:, None] - vectors, axis=2)
    assert len(got) == 23 * 23
    assert all(abs(got[i, j] - whole[i, j]) < 1e-9 for i in range(23) for j in range(23))


def test_no_vectors(embedding):
    assert embeddings.pairwise(embedding.where("standard_concept_id < 0"), "cosine").count() == 0


@pytest.mark.parametrize("keep_same", [True, False])
def test_statistics_without_rows_of_pairs(spark, embedding, keep_same, monkeypatch):
    monkeypatch.setattr(embeddings, "BINS", 7)  # many values in a bin
    listed = spark.createDataFrame([(k,) for k in (0, 1, 1, 2, 3, 5, 8, 13, 21, 99, None)], "concept_id long")
    want = embeddings.distance_statistics(embeddings.pairwise(embedding, "euclidean"), listed, keep_same).first()
    got = embeddings.statistics_among(embedding, listed, keep_same=keep_same).first()
    assert got.asDict() == pytest.approx({k: want[k] for k in got.asDict()})
    none = embeddings.statistics_among(embedding, listed.where("concept_id = 99"), keep_same=keep_same).first()
    assert tuple(none) == (None, None, None, None, 0, 1)


def test_statistics_of_equal_vectors(spark, embedding):
    same = spark.createDataFrame([(k, [1.0, 2.0]) for k in range(9)], "standard_concept_id long, vector array<double>")
    assert tuple(embeddings.statistics_among(same, same.selectExpr("standard_concept_id AS concept_id")).first()) == (0.0, 0.0, 0.0, 0.0, 9, 0)


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_both_directions_of_two_blocks_come_together(spark, embedding, metric):
    block = dict(map(tuple, embedding.selectExpr("standard_concept_id", "pmod(xxhash64(standard_concept_id), 6)").collect()))  # 23 vectors by 4
    got = [(r.concept_id_1, r.concept_id_2) for r in embeddings.pairwise(embedding, metric).collect()]
    place = {pair: k for k, pair in enumerate(got)}
    assert len(place) == len(got) == 23 * 23
    largest = max(list(block.values()).count(b) for b in block.values())
    assert all(abs(k - place[b, a]) < 2 * largest for (a, b), k in place.items() if block[a] != block[b])
