import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from conceptloom.llm import packing

ODD = ["", "a\u2003\u2003b \u3000c\u2028\u2028\u202fd\u180ee\u200bf", "  a  b\n\n c ", "a b  c", "x\x1cy \x1f z", "it's  'llama' don't\t\tgo", "<|endoftext|> 12３ ½ x²", "é" * 70 + " \n " + "ab" * 80, "\r\n\r\n a", "日本語 テスト😀😀", "a\u0085\u0085b \x0b\x0c", "zero​ width﻿"]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(packing.default_tokenizer())
    t.encode_special_tokens = True
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, 1]


def test_ids_equal_the_library_s_whole_and_in_parts(library, texts, monkeypatch):
    e = packing.Encoder(packing.default_tokenizer())
    for t in [*ODD, *(t or "" for t in texts)]:
        assert e.ids(t).tolist() == library(t)
    monkeypatch.setattr(packing, "PART", 5)
    for t in ODD:
        assert e.ids(t).tolist() == library(t)


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def check(rows, want):
    """Every id of every document in one piece, sequences gapless and at most full; ``want`` is a list of (doc_id, ids)."""
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(pieces) == {d for d, _ in want}
    ids = dict(want)
    for d, own in pieces.items():
        copies = sum(1 for x, _ in want if x == d)
        assert all(r.doc_tokens == len(ids[d]) and r.length > 0 and crc(ids[d][r.start : r.start + r.length]) == r.ids_crc32 for r in own)
        covered = Counter()
        for r in own:
            covered.update(range(r.start, r.start + r.length))
        assert covered == Counter({i: copies for i in range(len(ids[d]))})
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= packing.WINDOW
    return sequences


def test_op3_pieces(spark, folder, docs, library):
    rows = packing.op3_lexical_packing(spark, folder).collect()
    want = [(r.doc_id, library(r.text)) for r in docs.collect()]
    sequences = check(rows, want)
    short = [s for s in sequences.values() if sum(r.length for r in s) < packing.WINDOW]
    assert len(short) <= spark.sparkContext.defaultParallelism


def test_no_documents(spark, nobody):
    assert packing.pack(nobody).count() == 0


def test_small_shards_carry_the_open_window(spark, docs, library, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_TOKENS", 500)  # forked workers take the value from the closure's module
    rows = packing.pack(docs).collect()
    check(rows, [(r.doc_id, library(r.text)) for r in docs.collect()])


def test_neighbours_follow_brute_force_bm25(monkeypatch):
    monkeypatch.setattr(packing, "QUERY_WORDS", 1000)
    rng = random.Random(4)
    docs = [np.array([rng.randrange(60) for _ in range(rng.randrange(1, 40))], "<u2") for _ in range(30)]
    index, mean = packing.Bm25Index(docs), sum(map(len, docs)) / len(docs)
    for d, own in enumerate(docs):
        scores = []
        for o, other in enumerate(docs):
            s = 0.0
            for w in set(own.tolist()):
                n, tf = sum(w in x for x in docs), Counter(other.tolist())[w]
                if n > 1 and tf:
                    s += np.log1p((30 - n + 0.5) / (n + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(other) / mean))
            if o != d and s:
                scores.append((-round(s, 9), o))
        got = index.neighbours(d).tolist()
        assert len(got) == len(scores) and set(got) == {o for _, o in scores}
        by = {o: s for s, o in scores}
        assert [by[o] for o in got] == pytest.approx(sorted(by.values()))


def test_a_window_is_filled_with_what_is_like_its_seed():
    a, b = np.arange(100, 400, dtype="<u2"), np.arange(1000, 1300, dtype="<u2")
    packer = packing.Packer(1)
    packer.shard([packing.Tail(i, 0, 300, (a, b)[i % 2]) for i in range(12)])
    assert [d % 2 for d in packer.owners[:6]] == [0] * 6


def test_all_tokens_of_a_long_seed_count():
    """Neighbours that share many of its more frequent tokens, against brute-force BM25 over all tokens."""
    rng = random.Random(7)
    docs = [np.array([min(int(rng.expovariate(0.01)), 999) for _ in range(rng.randrange(50, 300))], "<u2") for _ in range(80)]
    index, mean, n_docs = packing.Bm25Index(docs), sum(map(len, docs)) / 80, Counter(w for d in docs for w in set(d.tolist()))
    times = [Counter(d.tolist()) for d in docs]
    for d in range(80):
        scores = {}
        for o in range(80):
            shared = set(times[d]) & set(times[o]) if o != d else ()
            if shared:
                scores[o] = sum(np.log1p((80.5 - n_docs[w]) / (n_docs[w] + 0.5)) * times[o][w] * 2.2 / (times[o][w] + 1.2 * (0.25 + 0.75 * len(docs[o]) / mean)) for w in shared)
        got = index.neighbours(d).tolist()
        assert set(got) == set(scores) and [scores[o] for o in got] == pytest.approx(sorted(scores.values(), reverse=True))


def test_shards_score_with_the_counts_of_all_documents(spark):
    """df, N and mean length of a shard are those of the whole table, and its scores those of brute force with these."""
    rng = random.Random(8)
    docs = [np.array([rng.randrange(50) for _ in range(rng.randrange(5, 40))], "<u2") for _ in range(60)]
    corpus = packing.corpus_of(spark.createDataFrame([(bytearray(d.tobytes()),) for d in docs], "ids binary").repartition(4))
    n_docs, mean = Counter(w for d in docs for w in set(d.tolist())), sum(map(len, docs)) / 60
    assert (corpus.size, corpus.mean) == (60, mean) and {w: n for w, n in enumerate(corpus.n_docs.tolist()) if n} == n_docs
    shard = docs[:20]
    index, times = packing.Bm25Index(shard, corpus), [Counter(d.tolist()) for d in shard]
    for d in range(20):
        score = lambda o: sum(np.log1p((60.5 - n_docs[w]) / (n_docs[w] + 0.5)) * times[o][w] * 2.2 / (times[o][w] + 1.2 * (0.25 + 0.75 * len(shard[o]) / mean)) for w in times[d])  # noqa: B023, E731
        want = {o: score(o) for o in range(20) if o != d and times[o].keys() & times[d].keys()}
        got = index.neighbours(d).tolist()
        assert set(got) == set(want) and [want[o] for o in got] == pytest.approx(sorted(want.values(), reverse=True))


def test_signatures_bring_like_documents_together():
    rng = random.Random(9)
    groups = [[rng.randrange(1000, 60000) for _ in range(60)] for _ in range(40)]
    docs = [np.array([*range(100), *(w if rng.random() < 0.9 else rng.randrange(60000) for w in g), 1], "<u2") for g in groups for _ in range(5)]
    n_docs = np.bincount(np.concatenate([np.unique(d) for d in docs]), minlength=1 << 16)
    of = packing.signatures(packing.Corpus(n_docs, len(docs), 161.0))
    order = sorted(range(len(docs)), key=lambda i: of(docs[i]))
    assert sum(a // 5 == b // 5 for a, b in zip(order, order[1:], strict=False)) > 100
