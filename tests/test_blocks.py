"""Co-occurrence without a window shuffles rows, not pairs."""

import random
from collections import Counter
from itertools import permutations

from conceptloom.operators import cooccurrence


def test_pairs_of_blocks_give_each_pair_once(spark):
    rng = random.Random(3)
    rows = [(p, rng.randrange(60)) for p in range(40) for _ in range(25)] + [(1, 7), (99, 3)]
    held = {p: {c for q, c in rows if q == p and c} for p, _ in rows}
    persons = Counter(c for cs in held.values() for c in cs)
    ids = {c: k for k, c in enumerate(sorted(persons), 1)}
    want = Counter(pair for cs in held.values() for pair in permutations(cs, 2))
    got = cooccurrence.cooccurrence(spark.createDataFrame(rows, "person_id long, standard_concept_id long"), window=None)
    assert sorted(map(tuple, got.collect())) == sorted((ids[a], ids[b], k * 2.0 / (persons[a] + persons[b]), a, b, k) for (a, b), k in want.items())


def test_pairs_are_not_shuffled(spark):
    events = spark.createDataFrame([(p, c) for p in range(9) for c in range(1, 9)], "person_id long, standard_concept_id long")
    plan = cooccurrence.cooccurrence(events, window=None)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[: plan.index("Generate explode(all")]


def test_rows_without_a_person_make_no_pairs(spark):
    events = spark.createDataFrame([(None, 1), (None, 2), (5, 1), (5, 3)], "person_id long, standard_concept_id long")
    got = cooccurrence.cooccurrence(events, window=None).select("standard_concept_id_1", "standard_concept_id_2").collect()
    assert sorted(map(tuple, got)) == [(1, 3), (3, 1)]


def test_rows_are_shuffled_once_not_for_each_block(spark, monkeypatch):
    monkeypatch.setattr(cooccurrence, "PART", 8)  # several parts of a block
    monkeypatch.setattr(cooccurrence, "COUNTED", 16)
    monkeypatch.setattr(cooccurrence, "RETURNED", 5)
    rng = random.Random(4)
    rows = {(p, rng.randrange(1, 40)) for p in range(-9, 30) for _ in range(12)}
    got = cooccurrence.cooccurrence(spark.createDataFrame(list(rows), "person_id int, standard_concept_id int"), window=None)
    assert "sequence(" not in got._jdf.queryExecution().analyzed().toString()  # the copies of a row
    want = Counter((a, b) for p, a in rows for q, b in rows if p == q and a != b)
    assert {(r.standard_concept_id_1, r.standard_concept_id_2): r["count"] for r in got.collect()} == want
    assert got.schema["standard_concept_id_2"].dataType.simpleString() == "int"


def test_persons_that_are_no_numbers(spark):
    events = spark.createDataFrame([("a", 1), ("a", 2), ("b", 2), (None, 3), (None, 1)], "person_id string, standard_concept_id long")
    got = cooccurrence.cooccurrence(events, window=None).select("standard_concept_id_1", "standard_concept_id_2", "count").collect()
    assert sorted(map(tuple, got)) == [(1, 2, 1), (2, 1, 1)]
