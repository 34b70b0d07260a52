"""Clinical domain tables to one table of patient events.

Canonical events are (person_id, standard_concept_id, event_date, visit_occurrence_id, domain).
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from conceptloom.storage import shuffled


@dataclass(frozen=True)
class DomainSpec:
    """The columns of a domain table that make an event."""

    concept: str
    date: str
    domain: str


#: By primary key, as names alone would find other columns first.
REGISTRY = {
    "condition_occurrence_id": DomainSpec("condition_concept_id", "condition_start_date", "condition"),
    "procedure_occurrence_id": DomainSpec("procedure_concept_id", "procedure_date", "procedure"),
    "drug_exposure_id": DomainSpec("drug_concept_id", "drug_exposure_start_date", "drug"),
    "measurement_id": DomainSpec("measurement_concept_id", "measurement_date", "measurement"),
}


def lower_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower() for c in df.columns])


def spec_of(df: DataFrame) -> DomainSpec:
    """The registered columns of a table, else the first that look like a concept and a date."""
    for key, spec in REGISTRY.items():
        if key in df.columns:
            return spec
    concept = next((c for c in df.columns if "concept_id" in c), None)
    date = next((c for c in df.columns if "date" in c), None)
    if concept is None or date is None:
        raise ValueError(f"no concept or date among {df.columns}")
    return DomainSpec(concept, date, concept.replace("_concept_id", ""))


def roll_up_to_ingredients(drugs: DataFrame, concept: DataFrame, closure: DataFrame) -> DataFrame:
    """Drugs replaced by their ingredients: one row for each; a drug without any stays as it is."""
    ingredient = concept.where("concept_class_id = 'Ingredient'").select(F.col("concept_id").alias("ancestor_concept_id"))
    mapping = (
        drugs.select("drug_concept_id").distinct()
        .join(shuffled(closure.select(F.col("descendant_concept_id").alias("drug_concept_id"), "ancestor_concept_id")), "drug_concept_id")
        .join(shuffled(ingredient), "ancestor_concept_id").select("drug_concept_id", "ancestor_concept_id").distinct()
    )
    rest = [c for c in drugs.columns if c != "drug_concept_id"]
    return drugs.join(shuffled(mapping), "drug_concept_id", "left").select(F.coalesce("ancestor_concept_id", "drug_concept_id").alias("drug_concept_id"), *rest)


def prepare(df: DataFrame, concept: DataFrame | None = None, closure: DataFrame | None = None) -> DataFrame:
    """Lower-case columns; drugs are rolled up if both vocabulary tables are given."""
    df = lower_columns(df)
    if spec_of(df).domain == "drug" and concept is not None and closure is not None:
        return roll_up_to_ingredients(df, concept, closure)
    return df


def to_events(df: DataFrame) -> DataFrame:
    spec = spec_of(df)
    visit = F.col("visit_occurrence_id") if "visit_occurrence_id" in df.columns else F.lit(None).cast("bigint")
    return df.select(
        F.col("person_id").cast("bigint").alias("person_id"), F.col(spec.concept).cast("bigint").alias("standard_concept_id"),
        F.to_date(spec.date).alias("event_date"), visit.cast("bigint").alias("visit_occurrence_id"), F.lit(spec.domain).alias("domain"),
    )


def union(frames: Iterable[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def mapped(events: DataFrame) -> DataFrame:
    """Without the unmapped concept 0."""
    return events.where("standard_concept_id != 0")


def join_domains(tables: Iterable[DataFrame], keep_unmapped: bool = False) -> DataFrame:
    """Distinct events of each table, one below the other."""
    events = [to_events(t) for t in tables]
    return union((e if keep_unmapped else mapped(e)).distinct() for e in events)


# Windows: events to (person_id, time_window, standard_concept_id, domain), or with bounds.


def in_visits(events: DataFrame, visits: DataFrame) -> DataFrame:
    """The window is the visit; events of unknown visits go."""
    return events.join(visits.select("visit_occurrence_id"), "visit_occurrence_id", "left_semi").withColumn("time_window", F.col("visit_occurrence_id"))


def in_lifetime(events: DataFrame) -> DataFrame:
    return events.withColumn("time_window", F.lit(1).cast("bigint"))


def in_years(events: DataFrame, first: int, last: int) -> DataFrame:
    """One window over all the years, both included."""
    return events.where(F.year("event_date").between(first, last)).withColumn("time_window", F.lit(1).cast("bigint"))


def with_span(events: DataFrame, days: int) -> DataFrame:
    return events.withColumns({"lower_bound": F.date_sub("event_date", days), "upper_bound": F.date_add("event_date", days)})


def in_fixed_windows(events: DataFrame, start: str, end: str, days: int, sub_days: int = 30) -> DataFrame:
    """``patient_window`` and ``sub_patient_window``: windows of ``days`` from ``start``; dates outside [start, end] go."""
    since = F.datediff("event_date", F.lit(start).cast("date"))
    sub = sub_days if days > sub_days else days
    dated = events.where(F.col("event_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    return dated.withColumns({"patient_window": F.floor(since / days).cast("bigint"), "sub_patient_window": F.floor(since / sub).cast("bigint")})


def visit_windows(events: DataFrame) -> DataFrame:
    """``patient_window`` is the visit; events without one go."""
    return events.where("visit_occurrence_id is not null").withColumn("patient_window", F.col("visit_occurrence_id"))


def between_dates(events: DataFrame, start: str, end: str) -> DataFrame:
    return events.where(F.col("event_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
