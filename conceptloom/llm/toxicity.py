"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index, and distance-weighted votes.

Terms are the words of the labelled examples, cut to stems of five bytes, as inflected and compound words share these; none is left out.
A term weighs (1 + log count) * idf * evidence. The idf is counted over all documents. Evidence is the absolute logarithm of the ratio of
its smoothed shares in toxic and in clean examples, so words that say nothing of the label weigh little; a word that no example has
weighs nothing, so the cosine over the terms of the examples is that of the whole texts.

Labelled examples are held in an inverted index whose postings are cut into blocks of examples, with the largest weight of each term in
each block. For a document the bounds of all blocks are summed from these, the blocks of the largest bounds are opened, and of the others
only those whose bounds reach the k-th best cosine so far, so neighbours are exact. Votes are weighted by the squared cosine, with a
small weight on the share of toxic labels so that distant neighbours decide little. They are calibrated on the examples themselves, each
scored by an index without its fold, weighted back to the label counts of all training rows.

The index is fitted on at most ``EXAMPLES`` labelled texts of each label (a bound on what is broadcast); every document is scored on
its whole text. Labels of held-out ids, languages, sources and ids are never inputs of a score. Constants were chosen by
cross-validation within the rows that are not held out.

Edge cases: null and empty texts, and texts without any term of the examples, have no neighbour and get the calibrated share of such
examples; ties in cosine go to the example that comes first in the index; equal labelled texts are one example, with the label most of
its ids have (toxic if equal) and its smallest id; without labels of both kinds every score is the share of toxic labels (0 without
labels); repeated rows get equal scores; very long texts are scored whole, in memory in proportion to the text; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from conceptloom.llm.common import annotate, documents, held_out, in_bytes, labelled_texts
from conceptloom.llm.licenses import words_of

EXAMPLES = {0: 1600, 1: 800}
BLOCK, NEIGHBOURS, FOLDS = 64, 15, 4
#: Bytes of a stem, and examples' worth of smoothing of evidence.
STEM, SMOOTHING = 5, 20.0
#: Blocks of a query that are opened first, and texts and bytes that are scored together.
FIRST, TEXTS, SLICE = 2, 128, 1 << 20
#: Terms in over one of so many examples have a row of weights.
COMMON = 24
PRIOR_WEIGHT = 0.1
THRESHOLD = 0.7

Vector = tuple[np.ndarray, np.ndarray]  # terms as positions in the vocabulary, rising, and their weights


def terms_of(text: bytes) -> list[bytes]:
    """The stems of a whole text, repeats included."""
    return [w[:STEM] for w in words_of(text)]


def slices(texts: list[bytes]) -> Iterator[list[bytes]]:
    """Up to TEXTS texts, or about SLICE bytes, at a time."""
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if len(held) == TEXTS or size >= SLICE:
            yield held
            held, size = [], 0
    if held:
        yield held


class Vocabulary:
    """Positions of terms."""

    def __init__(self, terms: list[bytes]):
        self.terms = pa.array(terms, pa.binary())

    def counts(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Known terms of the texts: text, term and count, in the order of text and term."""
        words = [words_of(t) for t in texts]
        owner = np.repeat(np.arange(len(texts)), [len(w) for w in words])
        stems = pc.binary_slice(pa.array([w for ws in words for w in ws], pa.binary()), 0, STEM)
        place = pc.fill_null(pc.index_in(stems, self.terms), -1).to_numpy(zero_copy_only=False)
        n = max(1, len(self.terms))
        keys, times = np.unique((owner * n + place)[place >= 0], return_counts=True)
        return keys // n, keys % n, times


def _ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0] to start[0] + count[0] - 1, and so on, in one array."""
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - ends + count, count)


class BlockMaxIndex:
    """Postings by term over examples of unit length, with the largest weight of a term in each block of BLOCK examples (a spot).

    Terms that stand in over one of COMMON examples have their weights in a row for all examples instead, so that the opened blocks
    of many queries are multiplied together.
    """

    def __init__(self, examples: list[Vector], words: int):
        self.examples, self.words = examples, words
        self.n = len(examples)
        self.blocks = -(-self.n // BLOCK)
        self.built = False

    def build(self) -> None:
        """Make the postings, where the index is searched first: the driver, which only passes it on, does not hold them."""
        words, self.built = self.words, True
        term = np.concatenate([np.zeros(0, np.int64), *(t for t, _ in self.examples)])
        weight = np.concatenate([np.zeros(0), *(w for _, w in self.examples)])
        owner = np.repeat(np.arange(self.n), [len(t) for t, _ in self.examples])
        common = np.flatnonzero(np.bincount(term, minlength=words) * COMMON > self.n)
        self.row = np.full(words, -1)
        self.row[common] = np.arange(len(common))
        self.rows = np.zeros((len(common), self.blocks * BLOCK))
        is_common = self.row[term] >= 0
        self.rows[self.row[term[is_common]], owner[is_common]] = weight[is_common]
        self.row_bounds = self.rows.reshape(len(common), self.blocks, BLOCK).max(2) if self.n else np.zeros((0, 0))
        term, owner, weight = (x[~is_common] for x in (term, owner, weight))
        order = np.argsort(term, kind="stable")
        term, self.owner, self.weight = term[order], owner[order], weight[order]
        block = self.owner // BLOCK
        first = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (block[1:] != block[:-1])])) if len(term) else np.zeros(0, np.int64)
        self.spots = np.searchsorted(term[first], np.arange(words + 1))  # where those of each term begin
        self.block = block[first]
        self.bound = np.maximum.reduceat(self.weight, first) if len(first) else np.zeros(0)
        self.at = np.append(first, len(term))  # where the postings of each spot begin

    def __reduce__(self) -> tuple:
        return BlockMaxIndex, (self.examples, self.words)  # the rows are larger and made again

    def nearest(self, queries: list[Vector], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query the k examples of largest cosine above 0, ties by position, and the cosines."""
        many = len(queries)
        if not self.n or not many:
            return [(np.zeros(0, np.int64), np.zeros(0))] * many
        if not self.built:
            self.build()
        terms, weights = np.concatenate([t for t, _ in queries]), np.concatenate([w for _, w in queries])
        owner = np.repeat(np.arange(many), [len(t) for t, _ in queries])
        rows = self.row[terms]
        dense = np.zeros((many, len(self.rows)))
        dense[owner[rows >= 0], rows[rows >= 0]] = weights[rows >= 0]
        terms, weights, owner = (x[rows < 0] for x in (terms, weights, owner))
        count = self.spots[terms + 1] - self.spots[terms]
        spot, query, weight = _ranges(self.spots[terms], count), np.repeat(owner, count), np.repeat(weights, count)
        cell = query * self.blocks + self.block[spot]
        bounds = np.bincount(cell, weight * self.bound[spot], many * self.blocks).reshape(many, -1) + dense @ self.row_bounds
        sums = np.zeros((many, self.blocks * BLOCK))

        def open_(chosen: np.ndarray) -> None:
            """Add the products in the chosen blocks of each query."""
            for b in np.flatnonzero(chosen.any(0)):
                of = np.flatnonzero(chosen[:, b])
                columns = slice(b * BLOCK, (b + 1) * BLOCK)
                sums[of, columns] += dense[of] @ self.rows[:, columns]
            here = chosen.ravel()[cell]
            count = self.at[spot[here] + 1] - self.at[spot[here]]
            at = _ranges(self.at[spot[here]], count)
            place = np.repeat(query[here] * sums.shape[1], count) + self.owner[at]
            sums.ravel()[:] += np.bincount(place, np.repeat(weight[here], count) * self.weight[at], sums.size)

        # the FIRST blocks of largest bounds give a least cosine; only blocks that reach it follow
        opened = np.zeros((many, self.blocks), bool)
        opened[np.arange(many)[:, None], np.argsort(-bounds, axis=1, kind="stable")[:, :FIRST]] = True
        open_(opened)
        least = np.maximum(np.partition(sums, -k, axis=1)[:, -k], 0) if sums.shape[1] > k else np.zeros(many)
        open_(~opened & (bounds > 1e-12) & (bounds >= least[:, None] - 1e-9))
        cosines = np.round(sums, 9)
        least = np.partition(cosines, -k, axis=1)[:, -k] if sums.shape[1] > k else np.zeros(many)
        out = []
        for row, low in zip(cosines, least, strict=True):
            found = np.flatnonzero((row >= low) & (row > 0))
            found = found[np.argsort(-row[found], kind="stable")[:k]]
            out.append((found, row[found]))
        return out


@dataclass
class ToxicityModel:
    terms: list[bytes]
    weight: np.ndarray  # idf * evidence
    index: BlockMaxIndex
    labels: np.ndarray
    ids: list[int]
    alone: float = 0.0  # score without any neighbour
    share: float = 0.0  # of toxic labels
    votes: np.ndarray | None = None  # calibration: votes and their scores, both rising
    scores: np.ndarray | None = None
    vocabulary: Vocabulary | None = field(default=None, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"vocabulary": None}

    def score(self, texts: list[bytes]) -> list[tuple[float, list[int], list[float]]]:
        """Of each text the score, and the ids and cosines of the nearest examples."""
        if self.vocabulary is None:
            self.vocabulary = Vocabulary(self.terms)
        out = []
        for part in slices(texts):
            text, term, times = self.vocabulary.counts(part)
            ends = np.searchsorted(text, np.arange(len(part) + 1))
            queries = [unit(term[a:b], times[a:b], self.weight) for a, b in zip(ends, ends[1:], strict=False)]
            for vote, ids, cosines in votes_of(self.index, self.labels, self.share, queries):
                if vote is None or self.votes is None:
                    out.append((self.alone, [], []))
                else:
                    out.append((float(np.interp(vote, self.votes, self.scores)), [self.ids[i] for i in ids[:3]], [round(float(c), 6) for c in cosines[:3]]))
        return out


def unit(terms: np.ndarray, times: np.ndarray, weight: np.ndarray) -> Vector:
    """The vector of unit length of a text; terms without weight are left out."""
    w = (1 + np.log(times)) * weight[terms]
    terms, w = terms[w > 0], w[w > 0]
    norm = np.sqrt(w @ w)
    return (terms, w / norm) if norm > 0 else (terms[:0], w[:0])


def votes_of(index: BlockMaxIndex, labels: np.ndarray, share: float, queries: list[Vector]) -> Iterator[tuple[float | None, np.ndarray, np.ndarray]]:
    """For each query the share of toxic labels among the nearest (None without any), and their positions and cosines."""
    for ids, cosines in index.nearest(queries, NEIGHBOURS):
        weight = cosines**2
        yield float((weight @ labels[ids] + PRIOR_WEIGHT * share) / (weight.sum() + PRIOR_WEIGHT)) if len(ids) else None, ids, cosines


def evidence(vectors: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, terms: int) -> np.ndarray:
    """What each term says of the label: 0 for terms of no example and for those with equal shares in both labels."""
    held = [np.bincount(np.concatenate([np.zeros(0, np.int64), *(t for (t, _), own in zip(vectors, labels, strict=True) if own == y)]), minlength=terms) for y in (0, 1)]
    n = len(labels)
    share = [(h / max(1, (labels == y).sum()) + SMOOTHING / n) for y, h in enumerate(held)]
    return np.abs(np.log(share[1] / share[0]))


def calibrate(votes: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over tenths of the vote: rising votes and rising weighted shares of label 1."""
    cell = np.minimum((votes * 10).astype(int), 9)
    blocks: list[list[float]] = []  # toxic weight, weight, weight * vote, cells
    for c in np.unique(cell):
        here = cell == c
        blocks.append([float((weights * labels)[here].sum()), float(weights[here].sum()), float((weights * votes)[here].sum())])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return np.array([b[2] / b[1] for b in blocks]), np.array([(b[0] + 0.5 * 0.1) / (b[1] + 0.1) for b in blocks])


def train(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """Index all terms of the examples, count their document frequencies over all documents, and calibrate."""
    bounded, totals = labelled_texts(docs, labels, "toxic", EXAMPLES)

    def tally(texts: list[bytes]) -> dict[str, list]:
        counts = [Counter(terms_of(t)) for t in texts]
        return {"terms": [list(c) for c in counts], "times": [list(c.values()) for c in counts]}

    table = annotate(bounded, "text", ["doc_id", "y"], "terms array<binary>, times array<int>", lambda: tally).toArrow().sort_by([("y", "ascending"), ("doc_id", "ascending")])
    y = np.array(table["y"].to_pylist(), int)
    known = sum(totals.values())
    share = totals.get(1, 0) / known if known else 0.0
    if len(set(y.tolist())) < 2:
        return ToxicityModel([], np.zeros(0), BlockMaxIndex([], 0), np.zeros(0), [], share, share)
    terms, vectors = _vectors(table)
    frequency, everything = _document_frequencies(docs, terms)
    idf = np.log((1 + everything) / (1 + frequency)) + 1
    return fit(terms, vectors, y, table["doc_id"].to_pylist(), idf, totals)


def _vectors(table: pa.Table) -> tuple[list[bytes], list[tuple[np.ndarray, np.ndarray]]]:
    """The distinct terms of the examples in order, and each example as places in them and counts."""
    lists = table["terms"].combine_chunks()
    coded = pc.dictionary_encode(lists.flatten())
    order = pc.array_sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    places, times = rank[coded.indices.to_numpy()], table["times"].combine_chunks().flatten().to_numpy().astype(float)
    ends = np.cumsum(pc.list_value_length(lists).to_numpy())
    vectors = []
    for a, b in zip(ends - np.diff(ends, prepend=0), ends, strict=True):
        by_place = np.argsort(places[a:b])
        vectors.append((places[a:b][by_place], times[a:b][by_place]))
    return coded.dictionary.take(pa.array(order)).to_pylist(), vectors


def _document_frequencies(docs: DataFrame, terms: list[bytes]) -> tuple[np.ndarray, int]:
    """In how many of all documents each term stands, and the number of documents. A number for each term comes to the driver."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def count(batches):
        vocabulary = Vocabulary(shared.value)
        held, rows = np.zeros(len(shared.value), np.int64), 0
        for batch in batches:
            rows += batch.num_rows
            for texts in slices(list(in_bytes(batch.column(0)))):
                held += np.bincount(vocabulary.counts(texts)[1], minlength=len(held))
        found = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array([*found.tolist(), -1], pa.int32()), pa.array([*held[found].tolist(), rows], pa.int64())], names=["term", "n"])

    counts = docs.select("text").mapInArrow(count, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    places, times = counts["term"].to_numpy(), counts["n"].to_numpy()
    out = np.zeros(len(terms))
    out[places[places >= 0]] = times[places >= 0]
    return out, int(times[places < 0].sum())


def fit(terms: list[bytes], vectors: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, ids: list[int], idf: np.ndarray, totals: dict[int, int]) -> ToxicityModel:
    """The index of all examples that have a term, alike ones side by side, and votes calibrated by cross-fitting."""
    share = totals[1] / max(1, sum(totals.values()))
    weight = {label: totals[label] / max(1, (y == label).sum()) for label in totals}

    def index_of(chosen: np.ndarray) -> tuple[np.ndarray, BlockMaxIndex, np.ndarray]:
        w = idf * evidence([vectors[i] for i in chosen], y[chosen], len(terms))
        units = {int(i): unit(*vectors[i], w) for i in chosen}
        held = sorted((i for i in units if len(units[i][0])), key=lambda i: (y[i], int(units[i][0][np.argmax(units[i][1])]), i))
        return w, BlockMaxIndex([units[i] for i in held], len(terms)), np.array(held, int)

    w, index, held = index_of(np.arange(len(y)))
    votes, truth = [], []
    bare = dict.fromkeys(totals, 0)
    fold = np.arange(len(y)) % FOLDS  # examples are in the order of label and id
    for f in range(FOLDS):
        part, part_index, part_held = index_of(np.flatnonzero(fold != f))
        own = np.flatnonzero(fold == f)
        for at in range(0, len(own), TEXTS):
            here = own[at : at + TEXTS]
            for i, (vote, _, _) in zip(here, votes_of(part_index, y[part_held], share, [unit(*vectors[i], part) for i in here]), strict=True):
                if vote is None:
                    bare[int(y[i])] += 1
                else:
                    votes.append(vote)
                    truth.append(int(y[i]))
        del part_index  # not held beside that of the next fold
    all_bare = sum(bare[label] * weight[label] for label in bare)
    alone = (bare[1] * weight[1] + 0.5 * share) / (all_bare + 0.5)
    model = ToxicityModel(terms, w, index, y[held].astype(float), [ids[i] for i in held], alone, share)
    if votes:
        model.votes, model.scores = calibrate(np.array(votes), np.array(truth, float), np.array([weight[k] for k in truth]))
    return model


def _scorer(docs: DataFrame, model: ToxicityModel) -> Callable[[list[bytes]], list[tuple[float, list[int], list[float]]]]:
    """The model's score on executors, where it is unpacked once a process. Its size is bounded by EXAMPLES."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return lambda texts: shared.value.score(texts)


def score_toxicity(docs: DataFrame, model: ToxicityModel, keep: list[str]) -> DataFrame:
    """``keep`` of every document, with ``score``, ``predicted`` (1: toxic, from THRESHOLD), and the nearest examples as evidence."""
    score = _scorer(docs, model)

    def columns(texts: list[bytes]) -> dict[str, list]:
        scored = score(texts)
        return {"score": [s for s, _, _ in scored], "predicted": [int(s >= THRESHOLD) for s, _, _ in scored], "neighbours": [i for _, i, _ in scored], "cosines": [c for _, _, c in scored]}

    return annotate(docs, "text", keep, "score double, predicted int, neighbours array<long>, cosines array<double>", lambda: columns)


def keep_harmless(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """The documents that are not predicted toxic, with all their columns."""
    score = _scorer(docs, model)
    return annotate(docs, "text", docs.columns, "", lambda: lambda texts: {"score": [s for s, _, _ in score(texts)]}, lambda c: [s < THRESHOLD for s in c["score"]])


def op2_toxic_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole text."""
    docs = documents(spark, sf_dir)
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_toxicity(docs, model, ["doc_id"]).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "neighbours", "cosines")
