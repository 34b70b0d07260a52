"""Cells of wanted pairs only: the same as the whole matrix has, made without all pairs of a person's events."""

import random

import pytest

from conceptloom.operators import cooccurrence
from conceptloom.plans import jobs


@pytest.fixture(scope="module")
def rows(spark):
    draw = random.Random(3)
    events = [(draw.randrange(12), draw.choice([0, 1, 1, 1, *range(2, 15)]), draw.randrange(9000, 9200), draw.randrange(40)) for _ in range(400)]
    return spark.createDataFrame(events, "person_id long, standard_concept_id long, day int, time_window long").selectExpr("*", "date_from_unix_date(day) AS event_date").drop("day")


@pytest.fixture(scope="module")
def wanted(spark):
    """A hub, both directions, repeated, equal, unknown and null concepts."""
    pairs = [(1, k) for k in range(2, 12)] + [(5, 4), (4, 5), (4, 5), (7, 7), (3, 99), (0, 2), (None, 3)]
    return spark.createDataFrame(pairs, "concept_id_1 long, concept_id_2 long")


@pytest.mark.parametrize("how", [{}, {"window": None}, {"days": 0}, {"days": 30}, {"days": 90}])
def test_cells_are_those_of_the_whole_matrix(rows, wanted, how):
    ends = {tuple(sorted(p)) for p in map(tuple, wanted.collect()) if None not in p}
    whole = [r for r in map(tuple, cooccurrence.cooccurrence(rows, **how).collect()) if tuple(sorted(r[3:5])) in ends]
    assert whole
    assert sorted(map(tuple, cooccurrence.cooccurrence(rows, wanted=wanted, **how).collect())) == sorted(whole)


def test_only_wanted_pairs_are_made(spark):
    one = spark.range(300).selectExpr("id div 1000 AS person_id", "id + 1 AS standard_concept_id", "0L AS time_window")
    wanted = spark.createDataFrame([(1, 2)], "concept_id_1 long, concept_id_2 long")
    made = cooccurrence.pairs_in_windows(one, None, wanted)
    assert [tuple(r) for r in made.collect()] == [(1, 2, 1)]
    met = [x for x in made._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join Inner" in x and "person_id" in x]
    assert met and all("other" in x for x in met)  # persons never meet without the concept


def test_features_are_written_one_by_one(spark, rows, wanted):
    pairs = wanted.where("concept_id_1 is not null").distinct().selectExpr("*", "'a' AS concept_name_1", "'b' AS concept_name_2")
    matrices = {k: cooccurrence.cooccurrence(rows, days=d, wanted=pairs) for k, d in (("near", 30), ("far", 90))}
    closure = spark.createDataFrame([(1, k, int(k > 1), int(k > 1)) for k in range(1, 15)], "ancestor_concept_id long, descendant_concept_id long, min_levels_of_separation int, max_levels_of_separation int")
    content = spark.createDataFrame([(k, 1, 0.5, 0.5) for k in range(1, 15)], "concept_id long, count long, information_content double, probability double")
    made = jobs.training_features(pairs, matrices, closure, content, {})
    assert "Join" not in made._jdf.queryExecution().optimizedPlan().toString()
    assert made.count() == pairs.count()
    assert {"ratio", "cooccurrence_near", "cooccurrence_far", "is_connected", "lin_measure"} <= set(made.columns)
