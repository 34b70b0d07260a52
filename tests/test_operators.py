"""Small cases worked out by hand."""

import math
from datetime import date, timedelta
from difflib import SequenceMatcher

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conceptloom import features
from conceptloom.functions import lexical
from conceptloom.operators import alignment, cooccurrence, embeddings, events, glove, information, ontology, projection, sequences

CLOSURE = [
    (1, 1, 0, 0), (2, 2, 0, 0), (1, 2, 1, 1), (3, 3, 0, 0), (1, 3, 1, 1), (4, 4, 0, 0), (2, 4, 1, 1), (3, 4, 1, 1), (1, 4, 2, 2), (5, 5, 0, 0), (3, 5, 1, 1), (1, 5, 2, 2),
    (6, 6, 0, 0), (4, 6, 1, 1), (2, 6, 2, 2), (3, 6, 2, 2), (1, 6, 3, 3),
]
EVENTS = [(1, 10, 0), (1, 20, 5), (1, 20, 40), (2, 10, 0), (2, 30, 10), (3, 20, 1), (3, 30, 1), (4, 0, 0), (4, 10, 3)]


@pytest.fixture(scope="module")
def closure(spark):
    return spark.createDataFrame(CLOSURE, "ancestor_concept_id long, descendant_concept_id long, min_levels_of_separation int, max_levels_of_separation int")


@pytest.fixture(scope="module")
def seen(spark):
    rows = [(p, c, date(2020, 1, 1) + timedelta(d), 1, "x") for p, c, d in EVENTS]
    return spark.createDataFrame(rows, "person_id long, standard_concept_id long, event_date date, visit_occurrence_id long, domain string")


def pairs_of(spark, *rows):
    return spark.createDataFrame(rows, "concept_id_1 long, concept_id_2 long")


def by_pair(df, column):
    return {(r[0], r[1]): r[column] for r in df.collect()}


def test_occurrence_and_lifetime_dice(spark, seen):
    assert {(r.id, r.standard_concept_id, r["count"]) for r in cooccurrence.occurrence(seen).collect()} == {(1, 10, 3), (2, 20, 2), (3, 30, 2)}
    m = cooccurrence.cooccurrence(seen, window=None)
    got = {(r.standard_concept_id_1, r.standard_concept_id_2): (r.normalized_count, r["count"]) for r in m.collect()}
    assert got == {k: v for (a, b), v in {(10, 20): (0.4, 1), (10, 30): (0.4, 1), (20, 30): (0.5, 1)}.items() for k in ((a, b), (b, a))}


def test_span_counts_a_person_once(spark, seen):
    got = {(r.standard_concept_id_1, r.standard_concept_id_2): r["count"] for r in cooccurrence.cooccurrence(seen, days=30).collect()}
    assert got[10, 20] == 1 and got == {k: 1 for k in got} and len(got) == 6
    assert cooccurrence.cooccurrence(seen, days=0).count() == 2  # 20 and 30 on one day


def test_decay_with_and_without_diagonal(spark, seen):
    w = seen.withColumn("patient_window", F.lit(0))
    got = {(r.standard_concept_id_1, r.standard_concept_id_2): r.normalized_count for r in cooccurrence.decayed(w, include_diagonal=True).collect()}
    assert got[10, 20] == pytest.approx(1 / 6 + 1 / 41) == got[20, 10] and got[10, 30] == pytest.approx(1 / 11)
    assert got[20, 30] == 1 and got[20, 20] == pytest.approx(2 / 36)
    assert all(a != b for a, b in {(r[3], r[4]) for r in cooccurrence.decayed(w).collect()})


def test_windows_floor_before_the_start(spark, seen):
    rows = events.in_fixed_windows(seen, "2020-01-03", "2020-12-31", 10).collect()
    assert {(r.event_date.day, r.patient_window) for r in rows} >= {(4, 0), (6, 0)} and min(r.patient_window for r in rows) == 0
    assert {r.sub_patient_window for r in rows} == {r.patient_window for r in rows}


def test_registry_heuristic_and_union(spark):
    a = spark.createDataFrame([(1, 5, 7, "2020-01-01", 9)], "CONDITION_OCCURRENCE_ID long, PERSON_ID long, CONDITION_CONCEPT_ID long, CONDITION_START_DATE string, VISIT_OCCURRENCE_ID long")
    b = spark.createDataFrame([(1, 5, 8, "2020-01-02"), (1, 5, 8, "2020-01-02"), (2, 5, 0, "2020-01-02")], "observation_id long, person_id long, observation_concept_id long, observation_date string")
    rows = events.join_domains([events.prepare(a), b]).collect()
    assert {(r.standard_concept_id, r.domain, r.visit_occurrence_id) for r in rows} == {(7, "condition", 9), (8, "observation", None)} and len(rows) == 2
    with pytest.raises(ValueError):
        events.spec_of(spark.range(1))


def test_rollup_fans_out_and_keeps_unmapped_drugs(spark, closure):
    drugs = spark.createDataFrame([(1, 6, "a"), (2, 77, "b")], "drug_exposure_id long, drug_concept_id long, tag string")
    concept = spark.createDataFrame([(2, "Ingredient"), (3, "Ingredient"), (4, "Other")], "concept_id long, concept_class_id string")
    assert sorted((r.drug_concept_id, r.tag) for r in events.roll_up_to_ingredients(drugs, concept, closure).collect()) == [(2, "a"), (3, "a"), (77, "b")]


def test_semantic_similarity_and_distance(spark, closure):
    pairs = pairs_of(spark, (4, 5), (2, 3), (6, 4), (6, 4))
    got = ontology.semantic_similarity(pairs, closure).collect()
    assert len(got) == 4
    assert {(r.concept_id_1, r.concept_id_2): (r.semantic_similarity, r.is_connected) for r in got} == {(4, 5): (0.5, 1), (2, 3): (None, 0), (6, 4): (0.8, 1)}
    assert by_pair(ontology.min_distance(pairs, closure), "min_distance") == {(4, 5): 2, (2, 3): 2, (6, 4): 1}
    assert [r.concept_id for r in ontology.roots(closure).collect()] == [1]


def test_closure_and_paths_of_edges(spark, closure):
    edges = spark.createDataFrame([(1, 2), (1, 3), (2, 4), (3, 4), (3, 5), (4, 6)], "parent long, child long")
    assert sorted(map(tuple, ontology.closure_of(edges).collect())) == sorted(CLOSURE)
    assert sorted(r.path for r in ontology.paths(edges).where("concept_id = 4").collect()) == [[1, 2, 4], [1, 3, 4]]
    scores = by_pair(ontology.path_similarity(pairs_of(spark, (4, 5), (6, 6), (1, 1), (2, 99)), edges), "path_score")
    assert scores == {(4, 5): pytest.approx(2 * 2 / 6), (6, 6): 1.0, (1, 1): 0.0, (2, 99): 0.0}
    with pytest.raises(ValueError):
        ontology.closure_of(spark.createDataFrame([(1, 2), (2, 1)], "parent long, child long"), max_depth=5)


def test_information_content_and_measures(spark, seen, closure):
    renamed = seen.withColumn("standard_concept_id", F.expr("case standard_concept_id when 10 then 4 when 20 then 5 when 30 then 2 else 0 end"))
    content = information.information_content(renamed, closure)
    ic = {r.concept_id: (r["count"], r.probability, r.information_content) for r in content.collect()}
    assert ic[4] == (3, 3 / 8, pytest.approx(-math.log(3 / 8))) and ic[1][0] == 7 and 0 not in ic
    assert ic[1][2] <= ic[3][2] <= ic[5][2]
    m = information.measures(pairs_of(spark, (4, 5), (4, 99)), content, closure).collect()
    r = next(x for x in m if x.concept_id_2 == 5)
    mica, i4, i5 = ic[3][2], ic[4][2], ic[5][2]
    assert r.mica_information_content == pytest.approx(mica) and r.lin_measure == pytest.approx(2 * mica / (i4 * i5)) and r.jiang_measure == pytest.approx(1 - (i4 + i5 - 2 * mica))
    assert r.information_coefficient == pytest.approx(r.lin_measure * (1 - 1 / (1 + mica))) and r.relevance_measure == pytest.approx(r.lin_measure * (1 - ic[1][1]))
    shared = ic[1][2] + ic[3][2]
    assert r.graph_ic_measure == pytest.approx(shared / (shared + ic[2][2] + i4 + i5))
    bag = information.measures(pairs_of(spark, (4, 5)), content, closure, bag_union=True).first()
    assert bag.graph_ic_measure == pytest.approx(shared / (2 * shared + ic[2][2] + i4 + i5))
    assert all(x[c] is None for x in m if x.concept_id_2 == 99 for c in ("lin_measure", "mica_information_content", "jiang_measure"))


def test_names(spark):
    assert lexical.jaro_of("MARTHA", "MARHTA") == pytest.approx(0.944444, abs=1e-6) and lexical.jaro_winkler_of("MARTHA", "MARHTA") == pytest.approx(0.961111, abs=1e-6)
    assert lexical.partial_ratio_of("abc", "xxabcxx") == 1.0 and lexical.partial_ratio_of("", "") == 1.0
    rows = [("kitten", "sitting"), ("", ""), ("", "ab"), ("é", "e"), (None, "x")]
    df = spark.createDataFrame([(1, 2, *r) for r in rows], "concept_id_1 long, concept_id_2 long, concept_name_1 string, concept_name_2 string")
    out = {(r.concept_name_1, r.concept_name_2): r for r in features.LexicalSimilarity().annotate(df).collect()}
    assert (out["kitten", "sitting"].distance, out["kitten", "sitting"].ratio) == (3, pytest.approx(8 / 13))
    assert out["", ""].ratio == 1.0 and out["", "ab"].ratio == 0.0 and out["é", "e"].distance == 1
    assert all(out[None, "x"][c] is None for c in features.LexicalSimilarity.NAMES)


@settings(max_examples=200, deadline=None)
@given(st.text("abcd", max_size=9), st.text("abcd", max_size=9))
def test_jaro_is_symmetric_and_bounded(a, b):
    assert lexical.jaro_of(a, b) == pytest.approx(lexical.jaro_of(b, a)) and 0 <= lexical.jaro_winkler_of(a, b) <= 1
    assert lexical.jaro_of(a, a) == (1.0 if a else 0.0)
    assert lexical.partial_ratio_of(a, b) >= round(SequenceMatcher(None, *sorted((a, b), key=len), autojunk=False).ratio(), 2) - 0.51


def test_features_keep_rows_and_fill(spark, closure):
    pairs = pairs_of(spark, (4, 5), (2, 3))
    matrix = spark.createDataFrame([(4, 5, 0.25)], "standard_concept_id_1 long, standard_concept_id_2 long, normalized_count double")
    vectors = spark.createDataFrame([(4, [1.0, 0.0]), (5, [1.0, 1.0]), (2, [0.0, 0.0]), (3, [1.0, 0.0])], "standard_concept_id long, vector array<double>")
    out = features.run(pairs, [features.Cooccurrence("cooccurrence visit", matrix), features.MinDistance("min distance", closure), features.Embedding("glove", vectors)])
    rows = {(r.concept_id_1, r.concept_id_2): r for r in features.fill_defaults(out).collect()}
    assert rows[4, 5].cooccurrence_visit == 0.25 and rows[2, 3].cooccurrence_visit == 0 and rows[4, 5].glove_cosine == pytest.approx(2**-0.5)
    assert rows[2, 3].min_distance == 2
    assert math.isnan(features.Embedding("glove", vectors).annotate(pairs).where("concept_id_1 = 2").first().glove_cosine)
    assert features.Embedding("glove", vectors).annotate(pairs_of(spark, (4, 999))).first().glove_cosine == 0.0
    assert "min_distance" in features.MinDistance("min distance", closure).description()


def plain_alignment(a, b, gap, mismatch):
    score = [[j * gap for j in range(len(b) + 1)]]
    for i, x in enumerate(a):
        score.append([(i + 1) * gap])
        for j, y in enumerate(b):
            score[-1].append(min(score[i][j] + (0 if x == y else mismatch), score[i][j + 1] + gap, score[-1][j] + gap))
    return score[-1][-1]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=7), st.lists(st.integers(1, 4), max_size=7))
def test_alignment_is_least_and_complete(a, b):
    score, steps = alignment.align(a, b)
    if not a and not b:
        assert score is None and steps == []
        return
    assert score == pytest.approx(2 * plain_alignment(a, b, 1, 2) / (len(a) + len(b)))
    assert [s for s, _, _ in steps if s] == a and [s for _, s, _ in steps if s] == b


def test_alignment_by_hand_and_with_costs(spark):
    assert alignment.align([1, 2, 3], [1, 3])[0] == pytest.approx(0.4)
    import numpy as np

    assert alignment.align([1, 2], [3, 4], costs=np.array([[0.5, 9], [9, 0.25]]))[0] == pytest.approx(2 * 0.75 / 4)
    assert alignment.align([1, 1], [1, 1], alignment.Scoring(similarity=True))[0] > 0
    df = spark.createDataFrame([(0, [1, 2, 3]), (1, [1, 3]), (2, [])], "position int, sequence array<long>")
    out = alignment.all_pairs(df)
    assert out.count() == 3 and {r.concept_id: r["count"] for r in alignment.matched_frequency(out).collect()} == {1: 1, 3: 1}
    names = spark.createDataFrame([(1, "one"), (3, "three")], "concept_id long, concept_name string")
    assert alignment.name_steps(alignment.steps_of(out, "position_1"), names).count() == 2


def test_sequences_by_day_and_window(spark, seen):
    w = events.in_fixed_windows(seen.where("standard_concept_id != 0"), "2020-01-01", "2020-12-31", 30)
    rows = {(r.person_id, r.patient_window): r.concept_list for r in sequences.sequence_text(sequences.window_sequences(w)).collect()}
    assert rows == {(1, 0): "10 20", (2, 0): "10 30", (3, 0): "20 30"}
    day = {r.person_id: r.value for r in sequences.day_sequences(seen).collect()}
    assert day[3] == "3, [[1577923200.0, [20, 30]]]" and day[1].startswith("1, [[1577836800.0, [10]], [")


def test_glove_loss_falls_and_weights_are_reciprocal_distances(spark):
    s = spark.createDataFrame([([1, 2, 3],), ([2, 1],), ([3, 1, 2, 2],)], "concepts array<long>")
    w = {(r.c1, r.c2): r.x for r in glove.corpus_weights(s).collect()}
    assert w[1, 2] == w[2, 1] == pytest.approx(1 + 1 + 1 + 0.5) and w[2, 2] == pytest.approx(2.0)
    assert (1, 3) not in {(r.c1, r.c2) for r in glove.corpus_weights(s.limit(1), window=1).collect()}
    ids, target, context = glove.train(s, dimensions=2, sweeps=2)
    cells = glove.corpus_weights(s).join(ids.select(F.col("standard_concept_id").alias("c1"), "id"), "c1").join(ids.select(F.col("standard_concept_id").alias("c2"), F.col("id").alias("other")), "c2")
    cells = cells.select("id", "other", F.lit(1.0).alias("f"), F.log("x").alias("y"))
    zero = lambda t: t.select("id", F.transform("vector", lambda _: F.lit(0.0)).alias("vector"), F.lit(0.0).alias("bias"))
    assert glove.loss(cells, target, context).first().loss < glove.loss(cells, zero(target), zero(context)).first().loss


def test_distances_pooling_and_projections(spark):
    e = spark.createDataFrame([(i, [float(i), float(i % 3), 1.0]) for i in range(1, 30)], "standard_concept_id long, vector array<double>")
    near = {r.concept_id_1: r.concept_id_2 for r in embeddings.nearest(e, 1).collect()}
    assert len(near) == 29 and near[1] == 2 and all(a != b for a, b in near.items())
    stats = embeddings.distance_statistics(embeddings.pairwise(e, "euclidean"), spark.createDataFrame([(1,), (1,), (2,), (99,)], "concept_id long")).first()
    assert (stats.num_of_concepts, stats.num_of_missings) == (2, 2) and stats["median"] == pytest.approx(stats["mean"])
    pooled = embeddings.max_pool(spark.createDataFrame([("a", 1), ("a", 5), ("a", 5), ("b", 99)], "k string, standard_concept_id long"), e, "k").collect()
    assert [(r.k, r.vector) for r in pooled] == [("a", [5.0, 2.0, 1.0])]
    with pytest.raises(ValueError):
        embeddings.pairwise(e, "other")
    p = projection.pca(e).collect()
    assert abs(sum(r.x for r in p)) < 1e-6 and sum(r.x**2 for r in p) > sum(r.y**2 for r in p)
    assert projection.tsne(e, steps=20).count() == 29 and projection.tsne(e.limit(0)).count() == 0
    assert embeddings.random_concepts(e, 5, 1).collect() == embeddings.random_concepts(e, 5, 1).collect()
