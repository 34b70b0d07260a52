import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, fp long, size string, extra string"


def rows_of(texts, sources=("a", "b", None)):
    return [(i, t, "en", sources[i % len(sources)], None if t is None else len(t), 7, "x", "y") for i, t in enumerate(texts)]


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """Null, empty, blank, long, repeated, near copies, several lines, control strings, and plain ones."""
    rng = random.Random(3)
    base = [words(rng, rng.randrange(1, 60)) for _ in range(40)]
    long = words(rng, 6000)
    near = [long + f" tail{i}" for i in range(6)]
    return [None, "", "  \t\n ", "é ñ 日本 <|endoftext|>", long, *near, *base, *base[:8], "one\ntwo\nthree. four. five\n", "a", "a b", "a b c", "\x1c\x1d  x"]


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The texts as documents with extra columns whose names clash with those of the operators, and one row twice."""
    rows = rows_of(texts)
    return spark.createDataFrame([*rows, rows[9]], SCHEMA)


@pytest.fixture(scope="session")
def nobody(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture
def folder(spark, tmp_path, docs):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)
