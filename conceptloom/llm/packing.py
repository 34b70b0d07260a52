"""Packing documents into token windows by lexical retrieval.

Documents are tokenised and cut: windows that a document fills alone are sequences at once, its tail goes to packing. Tails are dealt
by ranges of (signature, hash of the id), which brings documents with common words together and splits any number of equal ones. A
signature is three tokens of the tail, each the first in an order of its own in which rare tokens come early (weighted MinHash). A
task reads its range in order, in shards of bounded size. Each shard is a BM25 inverted index, with document frequencies, document
number and mean length counted over all tails; the first unused document is the seed of a window, its unused neighbours by BM25
follow, and the one that reaches over the end is cut there and becomes the next seed. When no neighbour is left the next unused
document follows. The number of tasks follows from the tokens, not from the cluster. A window that is open at the end of a shard goes on into the next one, so padding is at most one window a task.

The tokenizer file's path is a parameter. Very long texts are cut at white space, exactly where the tokenizer's own pattern cuts.

Edge cases: null and empty texts have only the end token; equal documents score alike and follow in their order; repeated rows are
packed on their own; documents longer than any window fill several; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from conceptloom.llm.common import documents, in_bytes, materialise

WINDOW, END_ID = 2048, 1
#: Tokens of a shard (one index) and of a task, and characters that are encoded at once.
SHARD_TOKENS, TASK_TOKENS, PART = 1 << 20, 1 << 22, 1 << 18
#: Words of a seed that are looked up, the rarest first; None is all of them.
QUERY_WORDS: int | None = None
#: Tokens in over one of so many documents of a shard have their weights in a row for all documents.
COMMON = 8
K1, B = 1.2, 0.75
ROWS = 4096
#: Of signatures: orders of tokens, and the power of the idf that draws rare tokens forward.
ORDERS, RARE = 3, 2

# The white space of the tokenizer's pattern, and the pattern itself.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_PIECE = re.compile(rf" ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of() -> dict[str, int]:
    """The printable stand-ins of the 256 bytes in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Texts to ids of a byte-level vocabulary file, as 16-bit numbers, with the end id. Very long texts are encoded in parts."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        byte, added = _byte_of(), {t["content"] for t in model.get("added_tokens", ())}
        ranks = {bytes(byte[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in added}
        if max(ranks.values()) >= 1 << 16:
            raise ValueError("more ids than 16 bits hold")
        self.encode = tiktoken.Encoding("bytes", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def ids(self, text: str) -> np.ndarray:
        ids = []
        for part in _parts(text):
            ids += self.encode(part)
        ids.append(END_ID)
        return np.array(ids, "<u2")


def _parts(text: str) -> Iterator[str]:
    if len(text) <= PART:
        yield text
        return
    held, size = [], 0
    for m in _PIECE.finditer(text):
        held.append(m[0])
        size += len(m[0])
        if size >= PART:
            yield "".join(held)
            held, size = [], 0
    yield "".join(held)


def ids_crc32(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").data)


TAIL = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, ids binary"


def tokenise(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, text) to a row for each full window, and one for each tail (with its ids; the others' are null)."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, sequence = Encoder(tokenizer), TaskContext.get().partitionId() << 34
        for batch in batches:
            rows, owner = [], []
            for i, raw in enumerate(in_bytes(batch.column(1))):
                ids = encoder.ids(raw.decode("utf-8", "replace"))
                n, whole = len(ids), len(ids) // WINDOW * WINDOW
                for at in range(0, whole, WINDOW):
                    rows.append((at, WINDOW, ids_crc32(ids[at : at + WINDOW]), n, sequence, None))
                    sequence += 2  # even; packed windows are odd
                if whole < n:
                    tail = ids[whole:]
                    rows.append((whole, n - whole, None, n, None, tail.tobytes()))
                owner += [i] * (len(rows) - len(owner))
            if rows:
                yield _batch(batch.column(0).take(pa.array(owner)), rows, pa.binary())

    slim = docs.select("doc_id", "text")
    return slim.mapInArrow(of, f"doc_id {dict(slim.dtypes)['doc_id']}, {TAIL}")


def _batch(ids: pa.Array, rows: list[tuple], last: pa.DataType) -> pa.RecordBatch:
    kinds = [pa.int64()] * 5 + [last]
    return pa.RecordBatch.from_arrays([ids, *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], names=["doc_id", *(f.split()[0] for f in TAIL.split(", ")[:-1]), "ids" if last == pa.binary() else "offset"])


@dataclass
class Corpus:
    """What BM25 counts over all tails: in how many each token stands, how many there are, and their mean length."""

    n_docs: np.ndarray
    size: int
    mean: float

    @property
    def idf(self) -> np.ndarray:
        return np.log1p((self.size - self.n_docs + 0.5) / (self.n_docs + 0.5))


def corpus_of(tails: DataFrame) -> Corpus:
    """Counted over the ``ids`` of all tails; a number for each token of the vocabulary comes to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_docs, size, length = np.zeros(1 << 16, np.int64), 0, 0
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                ids = np.frombuffer(raw, "<u2")
                n_docs[np.unique(ids)] += 1
                size, length = size + 1, length + len(ids)
        found = np.flatnonzero(n_docs)
        yield pa.RecordBatch.from_arrays([pa.array([*found, -1, -2], pa.int32()), pa.array([*n_docs[found], size, length], pa.int64())], names=["token", "n"])

    counts = {r.token: r.n for r in tails.select("ids").mapInArrow(count, "token int, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()}
    size, length = counts.pop(-1, 0), counts.pop(-2, 0)
    n_docs = np.zeros(1 << 16, np.int64)
    n_docs[list(counts)] = list(counts.values())
    return Corpus(n_docs, size, length / max(size, 1))


def signatures(corpus: Corpus) -> Callable[[np.ndarray], int]:
    """A function from ids to their signature. Tokens of a single tail have no weight, as they lead to no neighbour."""
    weight = np.where(corpus.n_docs > 1, corpus.idf**RARE, 0)
    draws = np.random.default_rng(5).exponential(size=(ORDERS, 1 << 16))
    order = np.full(draws.shape, np.inf)
    np.divide(draws, weight, out=order, where=np.broadcast_to(weight > 0, draws.shape))

    def of(ids: np.ndarray) -> int:
        signature = 0
        for at in order[:, ids].argmin(1):
            signature = signature << 16 | int(ids[at])
        return signature

    return of


class Bm25Index:
    """An inverted index over token arrays; neighbours of a document by the BM25 score of all its tokens.

    Without ``corpus`` the documents of the index are all there are.
    """

    def __init__(self, docs: list[np.ndarray], corpus: Corpus | None = None):
        words, times = [], []
        for d in docs:
            s = np.sort(d, kind="stable")
            first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
            words.append(s[first])
            times.append(np.diff(np.append(first, len(s))))
        self.words = words
        sizes = np.array([len(w) for w in words])
        owner = np.repeat(np.arange(len(docs), dtype=np.int32), sizes)
        word, tf = np.concatenate(words), np.concatenate(times)
        order = np.argsort(word, kind="stable")
        length = np.array([len(d) for d in docs], float)
        self.owner = owner[order]
        n_docs = np.bincount(word, minlength=1 << 16)
        self.start = np.concatenate([[0], np.cumsum(n_docs)])
        corpus = corpus or Corpus(n_docs, len(docs), length.mean())
        self.idf = corpus.idf
        self.n_docs = n_docs
        t, own = tf[order], self.owner
        self.weight = self.idf[word[order]] * t * (K1 + 1) / (t + K1 * (1 - B + B * length[own] / corpus.mean))
        self.size = len(docs)
        common = np.flatnonzero(n_docs * COMMON > len(docs))
        self.row = np.full(1 << 16, -1)
        self.row[common] = np.arange(len(common))
        self.rows = np.zeros((len(common), len(docs)))
        for r, w in enumerate(common.tolist()):
            span = slice(self.start[w], self.start[w + 1])
            self.rows[r, own[span]] = self.weight[span]

    def neighbours(self, doc: int) -> np.ndarray:
        """Other documents that share a looked-up token, by falling score, ties in order."""
        words = self.words[doc]
        words = words[self.n_docs[words] > 1]
        if QUERY_WORDS is not None and len(words) > QUERY_WORDS:
            words = words[np.argsort(self.n_docs[words], kind="stable")[:QUERY_WORDS]]
        if not len(words):
            return np.zeros(0, np.int64)
        rows = self.row[words]
        score = np.zeros(self.size)
        for r in rows[rows >= 0].tolist():
            score += self.rows[r]
        spans = [slice(self.start[w], self.start[w + 1]) for w in words[rows < 0].tolist()]
        if spans:
            owner = np.concatenate([self.owner[s] for s in spans])
            score += np.bincount(owner, np.concatenate([self.weight[s] for s in spans]), self.size)
        score[doc] = 0
        found = np.flatnonzero(score)
        return found[np.argsort(-score[found], kind="stable")]


@dataclass
class Tail:
    doc_id: object
    start: int
    doc_tokens: int
    ids: np.ndarray


class Packer:
    """Fills windows shard by shard; ``pieces`` are rows of TAIL without ids, the last value being the offset."""

    def __init__(self, first_sequence: int, corpus: Corpus | None = None):
        self.sequence, self.filled, self.corpus = first_sequence, 0, corpus
        self.owners: list[object] = []
        self.pieces: list[tuple] = []

    def put(self, tail: Tail) -> Tail | None:
        """Append what fits of the tail to the open window; returns the rest."""
        n = min(WINDOW - self.filled, len(tail.ids))
        self.owners.append(tail.doc_id)
        self.pieces.append((tail.start, n, ids_crc32(tail.ids[:n]), tail.doc_tokens, self.sequence, self.filled))
        self.filled += n
        if self.filled == WINDOW:
            self.sequence, self.filled = self.sequence + 2, 0
        return Tail(tail.doc_id, tail.start + n, tail.doc_tokens, tail.ids[n:]) if n < len(tail.ids) else None

    def shard(self, tails: list[Tail]) -> None:
        index = Bm25Index([t.ids for t in tails], self.corpus)
        unused = np.ones(len(tails), bool)
        after, rest = 0, None
        near: Iterator[int] = iter(())
        while True:
            if rest is not None:
                rest = self.put(rest)
                continue
            nearest = next((i for i in near if unused[i]), None)
            if nearest is None:
                while after < len(tails) and not unused[after]:
                    after += 1
                if after == len(tails):
                    return
                nearest = after
                near = iter(index.neighbours(nearest).tolist())
            unused[nearest] = False
            was = self.sequence
            rest = self.put(tails[nearest])
            if self.sequence != was:  # the window is full: what is left of this document, or else the next one, is the new seed
                near = iter(index.neighbours(nearest).tolist()) if rest is not None else iter(())


def pack(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, text) to one row per piece: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset)."""
    table = materialise(tokenise(docs, tokenizer or default_tokenizer()), "pack-tokens")
    id_type = dict(table.dtypes)["doc_id"]
    names = [f.split()[0] for f in TAIL.split(", ")][:5]
    full = table.where("ids is null").select("doc_id", *names, F.lit(0).cast("long").alias("offset"))
    tails = table.where("ids is not null").select("doc_id", "start", "doc_tokens", "ids")
    corpus = corpus_of(tails)
    tokens = round(corpus.size * corpus.mean)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = signatures(corpus)
        for batch in batches:
            signed = pa.array([of(np.frombuffer(raw, "<u2")) for raw in batch.column(3).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, signed], names=[*batch.schema.names, "signature"])

    tails = tails.mapInArrow(sign, f"doc_id {id_type}, start long, doc_tokens long, ids binary, signature long").withColumn("spread", F.xxhash64("doc_id", "start"))
    key = ["signature", "spread"]
    dealt = tails.repartitionByRange(max(1, -(-tokens // TASK_TOKENS)), *key).sortWithinPartitions(*key, "doc_id", "ids").select("doc_id", "start", "doc_tokens", "ids")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        packer, ids = Packer(TaskContext.get().partitionId() << 34 | 1, corpus), None
        held, tokens = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            packer.shard(held)
            for at in range(0, len(packer.pieces), ROWS):
                yield _batch(pa.array(packer.owners[at : at + ROWS], ids), packer.pieces[at : at + ROWS], pa.int64())
            packer.owners, packer.pieces = [], []
            held.clear()

        for batch in batches:
            ids = batch.column(0).type
            for doc_id, start, n, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                held.append(Tail(doc_id, start, n, np.frombuffer(raw, "<u2")))
                tokens += len(raw) // 2
                if tokens >= SHARD_TOKENS:
                    yield from flush()
                    tokens = 0
        if held:
            yield from flush()

    packed = dealt.mapInArrow(of, f"doc_id {id_type}, {TAIL.replace('ids binary', 'offset long')}").select("doc_id", *names, "offset")
    return full.unionByName(packed)


def op3_lexical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    return pack(documents(spark, sf_dir)).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
