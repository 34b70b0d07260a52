import random
from collections import Counter, defaultdict

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from conceptloom.llm import packing


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    """Clean documents, toxic and bad ones, exact and near copies; half of all are labelled."""
    rng = random.Random(11)
    plain = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8))) for _ in range(900)]
    rows, labels, kind, group = [], [], {}, {}

    def add(text, what, of=None):
        i = len(rows)
        rows.append((i, text, "en", f"s{i % 4}", len(text)))
        kind[i], group[i] = what, i if of is None else of
        if i % 2 or what == "clean" and i % 5 == 0:
            labels.append((i, int(what != "bad"), int(what == "toxic")))
        return i

    for n in range(700):
        w = [rng.choice(plain) for _ in range(rng.randrange(80, 160))]
        if n % 5 == 0:
            for _ in range(4):
                w.insert(rng.randrange(len(w)), rng.choice(["nasty", "vile", "awful"]))
            add(" ".join(w), "toxic")
        elif n % 5 == 1:
            add(" ".join(x.upper() + "!!" for x in w), "bad")
        else:
            first = add(" ".join(w), "clean")
            if n % 10 == 2:
                add(" ".join(w), "clean", first)
                w[rng.randrange(len(w))] = rng.choice(plain)
                add(" ".join(w), "clean", first)
    folder = tmp_path_factory.mktemp("pipeline")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder), {r[0]: r[1] for r in rows}, kind, group


def test_stages_take_effect(spark, planted, tmp_path):
    folder, texts, kind, group = planted
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert docs.columns == columns
        kept.append([r.doc_id for r in docs.select("doc_id").collect()])
    good, harmless, single, mixed = kept
    clean = {i for i, k in kind.items() if k == "clean"}
    assert not any(kind[i] == "bad" for i in good) and len(clean - set(good)) <= 0.02 * len(clean)
    assert not any(kind[i] == "toxic" for i in harmless) and len(clean & set(good) - set(harmless)) <= 0.01 * len(clean)
    want = defaultdict(list)
    for i in harmless:
        want[group[i]].append(i)
    assert sorted(single) == sorted(min(g) for g in want.values())
    assert set(mixed) <= set(single) and max(Counter(mixed).values()) <= 3


def test_run_packs_every_copy(spark, planted):
    folder, texts, kind, _ = planted
    rows = corpus_pipeline.run(spark, folder).collect()
    t = Tokenizer.from_file(packing.default_tokenizer())
    covered = defaultdict(Counter)
    for r in rows:
        covered[r.doc_id].update(range(r.start, r.start + r.length))
    for i, places in covered.items():
        n = len(t.encode(texts[i], add_special_tokens=False).ids) + 1
        assert set(places) == set(range(n)) and len(set(places.values())) == 1 and places[0] <= 3 and kind[i] == "clean"


def test_no_documents(spark, planted, tmp_path):
    folder, *_ = planted
    for name in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
