"""Quality scores by Bradley-Terry ranking.

Every pair of a good and a bad labelled document is a comparison that the good one wins. Scores are sums of weights, one for the bin
of each feature of the whole text, and the probability of a win is the logistic function of the score difference, so the weights are
fitted by logistic loss on feature differences. The score quantile at which the labels are told apart best is the threshold; the
reported score is the logistic function of the distance from it.

The fit uses at most ``EXAMPLES`` labelled texts of each label and all pairs of them, on the driver. Labels of held-out ids, languages,
sources and ids are never used.

Edge cases: null and empty texts have all features 0 and get the score that goes with them; without labels of both kinds every
document scores 0.5; equal labelled texts are one example, with the label most of its ids have (good if equal); of several quantiles that
tell the labels apart alike the middle one is taken; repeated rows get equal scores; very long texts are read whole, in memory in
proportion to the text; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from conceptloom.llm.common import annotate, documents, held_out, labelled_texts

EXAMPLES, BINS, WINDOW = 4000, 8, 50
#: Weight of the squared weights in the loss, per pair, and rows of a block of pairs.
RIDGE, ROWS = 1 / 40_000, 500

_CLASSES = {
    "upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "space": (32, 9), "line": (10,), "stop": b".?", "bang": b"!", "comma": b",;:",
    "bar": b"|", "symbol": b"#$%&*@^~+=_", "markup": b"<>{}[]\\/", "quote": b"'\"()-`", "beyond": range(128, 256), "control": [*range(9), *range(11, 32), 127],
}
_MATRIX = np.zeros((256, len(_CLASSES)))
for _i, _codes in enumerate(_CLASSES.values()):
    _MATRIX[list(_codes), _i] = 1
FEATURES = [*_CLASSES, "bytes", "words", "word_length", "distinct", "repeats", "long_words", "lines", "distinct_lines", "letters_per_word"]


def features(texts: list[bytes]) -> np.ndarray:
    """A row of FEATURES for each whole text."""
    out = np.zeros((len(texts), len(FEATURES)))
    if not texts:
        return out
    counts = np.stack([np.bincount(np.frombuffer(t, np.uint8), minlength=256) for t in texts]) @ _MATRIX
    sizes = np.array([max(1, len(t)) for t in texts])
    out[:, : len(_CLASSES)] = counts / sizes[:, None]
    for row, text in zip(out[:, len(_CLASSES) :], texts, strict=True):
        words = text.split()
        if not words:
            continue
        n, lines = len(words), text.split(b"\n")
        distinct = sum(len(set(words[i : i + WINDOW])) for i in range(0, n, WINDOW)) / n
        repeats = sum(map(bytes.__eq__, words, words[1:])) / n
        row[:] = np.log1p(len(text)), np.log1p(n), len(text) / n, distinct, repeats, sum(len(w) > 24 for w in words) / n, np.log1p(len(lines)), len(set(lines)) / len(lines), 0
    out[:, -1] = (counts[:, 0] + counts[:, 1] + counts[:, 12]) / np.maximum(1, np.expm1(out[:, FEATURES.index("words")]))
    return out


@dataclass
class PairwiseModel:
    cuts: list[np.ndarray]  # of each feature
    weights: list[np.ndarray]  # of the bins of each feature
    threshold: float
    slope: float
    level: float = 0.0  # of the threshold: the share of the examples that score lower

    def raw(self, x: np.ndarray) -> np.ndarray:
        return sum(w[np.searchsorted(c, x[:, j], side="left")] for j, (c, w) in enumerate(zip(self.cuts, self.weights, strict=True))) + np.zeros(len(x))

    def score(self, texts: list[bytes]) -> np.ndarray:
        return _logistic(self.slope * (self.raw(features(texts)) - self.threshold))


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def bradley_terry(winners: np.ndarray, losers: np.ndarray, ridge: float = RIDGE, steps: int = 15) -> np.ndarray:
    """Weights that maximise the likelihood that every winner beats every loser: Newton steps on the logistic loss of all feature
    differences, summed block by block of winners, so pairs are never listed."""
    w = np.zeros(winners.shape[1])
    ridge *= len(winners) * len(losers)
    for _ in range(steps):
        below = losers @ w
        gradient, curvature = -ridge * w, ridge * np.eye(len(w))
        cross, lost, spent = np.zeros_like(curvature), np.zeros(len(losers)), np.zeros(len(losers))
        for at in range(0, len(winners), ROWS):
            x = winners[at : at + ROWS]
            p = _logistic((x @ w)[:, None] - below[None, :])
            c = p * (1 - p)
            gradient += x.T @ (1 - p).sum(1)
            lost += (1 - p).sum(0)
            curvature += (x * c.sum(1)[:, None]).T @ x
            spent += c.sum(0)
            cross += x.T @ (c @ losers)
        gradient -= losers.T @ lost
        curvature += (losers * spent[:, None]).T @ losers - cross - cross.T
        step = np.linalg.solve(curvature, gradient)
        w += step
        if np.abs(step).max() < 1e-4:
            break
    return w


def fit(x: np.ndarray, y: np.ndarray) -> PairwiseModel:
    """Feature rows and labels to a model."""
    if len(set(y.tolist())) < 2:
        return PairwiseModel([np.zeros(0)] * len(FEATURES), [np.zeros(1)] * len(FEATURES), 0.0, 1.0)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    at = np.concatenate([[0], np.cumsum([len(c) + 1 for c in cuts])])
    hot = np.zeros((len(x), at[-1]))
    for j, c in enumerate(cuts):
        hot[np.arange(len(x)), at[j] + np.searchsorted(c, x[:, j], side="left")] = 1
    good, bad = hot[y == 1], hot[y == 0]
    w = bradley_terry(good, bad)
    model = PairwiseModel(cuts, [w[a:b] for a, b in zip(at, at[1:], strict=False)], 0.0, 1.0)
    s = model.raw(x)
    order = np.argsort(s, kind="stable")
    ranked, good_here = s[order], y[order] == 1
    # a cut after each score: bad ones found below it and good ones kept above it, each as a share of its label
    balance = np.concatenate([[0], np.cumsum(np.where(good_here, -1 / len(good), 1 / len(bad)))])
    possible = np.concatenate([[True], ranked[1:] > ranked[:-1], [True]])
    best = np.flatnonzero(possible & (balance >= balance[possible].max() - 1e-12))
    cut = best[len(best) // 2]
    # the quantile between the scores on both sides of the cut
    model.level = (cut - 0.5) / (len(ranked) - 1)
    model.threshold = float(np.quantile(ranked, min(max(model.level, 0), 1))) + (1e-9 if model.level > 1 else 0)
    model.slope = float(np.clip(2.0 / max(1e-6, np.std(s)), 0.05, 5.0))
    return model


def train(docs: DataFrame, labels: DataFrame) -> PairwiseModel:
    """Fit on a bounded sample of the labelled documents; the sample is broadcast, at most 2 * EXAMPLES ids."""
    chosen, _ = labelled_texts(docs, labels, "quality", {0: EXAMPLES, 1: EXAMPLES})
    rows = annotate(chosen, "text", ["doc_id", "y"], "x array<double>", lambda: lambda texts: {"x": list(features(texts))}).orderBy("y", "doc_id", "x").collect()
    x, y = np.array([r.x for r in rows], float).reshape(-1, len(FEATURES)), np.array([r.y for r in rows], int)
    return fit(x, y)


def score_quality(docs: DataFrame, model: PairwiseModel, keep: list[str]) -> DataFrame:
    """``keep`` of every document, with ``score`` and ``predicted`` (1: good, from 0.5)."""

    def columns(texts: list[bytes]) -> dict[str, list]:
        score = model.score(texts)
        return {"score": score, "predicted": (score >= 0.5).astype(np.int32)}

    return annotate(docs, "text", keep, "score double, predicted int", lambda: columns)


def keep_good(docs: DataFrame, model: PairwiseModel) -> DataFrame:
    """The documents that the model does not reject, with all their columns."""
    return annotate(docs, "text", docs.columns, "", lambda: lambda texts: {"score": model.score(texts)}, lambda c: (c["score"] >= 0.5).tolist())


def op4_pairwise_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every whole text."""
    docs = documents(spark, sf_dir)
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_quality(docs, model, ["doc_id"]).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
