"""Jobs: co-occurrence with its presets, the training features, and sequences to embeddings."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from conceptloom import features
from conceptloom.config import SPAN_PRESETS
from conceptloom.operators import cooccurrence as co
from conceptloom.operators import embeddings, events, glove, sequences
from conceptloom.sources.files import write_csv, write_parquet
from conceptloom.storage import materialise


def cooccurrence_presets(domain_events: DataFrame, visits: DataFrame, last_year: int) -> dict[str, DataFrame]:
    """The matrices of all windows: last five years, visit, days to either side, lifetime."""
    out = {"5_year": co.cooccurrence(events.in_years(domain_events, last_year - 4, last_year)), "visit": co.cooccurrence(events.in_visits(domain_events, visits))}
    out |= {name: co.cooccurrence(domain_events, days=days) for name, days in SPAN_PRESETS.items()}
    return out | {"lifetime": co.cooccurrence(domain_events, window=None)}


def write_cooccurrence(domain_events: DataFrame, visits: DataFrame, last_year: int, folder: str) -> None:
    for name, matrix in cooccurrence_presets(domain_events, visits, last_year).items():
        write_parquet(matrix, f"{folder}/cooccurrence_{name}")


def training_features(
    pairs: DataFrame, matrices: Mapping[str, DataFrame], closure: DataFrame, content: DataFrame, vectors: Mapping[str, tuple[DataFrame, DataFrame | None]], fill: bool = True
) -> DataFrame:
    """Lexical, co-occurrence, ontology, information and embedding features of concept pairs. The table is written after each of them,
    as a plan of all together is more than a driver should hold."""
    steps: list[features.Feature] = [features.LexicalSimilarity()]
    steps += [features.Cooccurrence(f"cooccurrence {name}", m) for name, m in matrices.items()]
    steps += [features.SemanticSimilarity("semantic similarity", closure), features.InformationContent("information content", content, closure)]
    steps += [features.Embedding(name, weights, vocabulary) for name, (weights, vocabulary) in vectors.items()]
    rows = pairs
    for step in steps:
        rows = materialise(step.annotate(rows), "features")
    return features.fill_defaults(rows) if fill else rows


def patient_sequences(tables: Iterable[DataFrame], start: str, end: str, days: int = 60, sub_days: int = 30, by_visit: bool = False, concept: DataFrame | None = None, closure: DataFrame | None = None) -> DataFrame:
    """Domain tables to ordered sequences per person and window, or per visit."""
    rows = events.join_domains(events.prepare(t, concept, closure) for t in tables)
    windowed = events.visit_windows(rows) if by_visit else events.in_fixed_windows(rows, start, end, days, sub_days)
    return sequences.window_sequences(windowed)


def day_sequences(tables: Iterable[DataFrame], start: str, end: str, concept: DataFrame | None = None, closure: DataFrame | None = None) -> DataFrame:
    rows = events.join_domains(events.prepare(t, concept, closure) for t in tables)
    return sequences.day_sequences(events.between_dates(rows, start, end))


def write_sequences(rows: DataFrame, folder: str) -> None:
    text = sequences.sequence_text(rows)
    write_parquet(text, f"{folder}/sequence")
    write_csv(text.select("concept_list"), f"{folder}/sequence_csv", header=False)


def sequence_embeddings(rows: DataFrame, dimensions: int, sweeps: int, window: int | None = None) -> DataFrame:
    """Sequences to (standard_concept_id, vector)."""
    ids, target, context = glove.train(rows, dimensions, sweeps, window)
    both = target.select("id", "vector").join(context.select("id", F.col("vector").alias("other")), "id")
    return embeddings.with_dictionary(ids, both.select("id", F.zip_with("vector", "other", lambda a, b: (a + b) / 2).alias("vector")))


def distance_matrices(embedding: DataFrame, folder: str) -> None:
    for metric in ("euclidean", "cosine"):
        write_parquet(embeddings.pairwise(embedding, metric), f"{folder}/pairwise_{metric}")
