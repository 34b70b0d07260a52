"""Patient event sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _ordered(rows: DataFrame, keys: list[str], dates: str) -> DataFrame:
    """Concepts of each key by (date, concept); keys with a single event go."""
    events = F.array_sort(F.collect_list(F.struct(F.col(dates).alias("d"), F.col("standard_concept_id").alias("c"))))
    grouped = rows.groupBy(*keys).agg(F.transform(events, lambda e: e["c"]).alias("concepts"))
    return grouped.withColumn("collection_size", F.size("concepts")).where("collection_size > 1")


def window_sequences(windowed: DataFrame) -> DataFrame:
    """(person_id, patient_window, concepts array, collection_size). Sub-windows follow dates, so one sort by date orders both."""
    return _ordered(windowed, ["person_id", "patient_window"], "event_date")


def sequence_text(sequences: DataFrame) -> DataFrame:
    """``concept_list``: the concepts joined by spaces, as corpora want them."""
    return sequences.withColumn("concept_list", F.array_join(F.transform("concepts", lambda c: c.cast("string")), " ")).drop("concepts")


def day_sequences(events: DataFrame) -> DataFrame:
    """One line per person: ``person, [[seconds, [c, c]], ...]``, days in order, seconds since 1970 in UTC, concepts ascending."""
    days = events.groupBy("person_id", "event_date").agg(F.array_sort(F.collect_list("standard_concept_id")).alias("c"))
    seconds = (F.unix_date("event_date").cast("bigint") * 86400).cast("string")
    day = F.concat(F.lit("["), seconds, F.lit(".0, ["), F.array_join(F.transform("c", lambda c: c.cast("string")), ", "), F.lit("]]"))
    rows = days.select("person_id", F.struct("event_date", day.alias("t")).alias("s")).groupBy("person_id").agg(F.array_sort(F.collect_list("s")).alias("s"))
    return rows.select("person_id", F.concat(F.col("person_id").cast("string"), F.lit(", ["), F.array_join(F.transform("s", lambda s: s["t"]), ", "), F.lit("]")).alias("value"))


def index_timelines(spanned: DataFrame, concept_id: int, persons: int) -> DataFrame:
    """Events whose span covers a person's first date of a concept, as sequences by concept; of at most ``persons`` persons, ranked by a
    hash of the id instead of a random number, so that results repeat."""
    first = spanned.where(F.col("standard_concept_id") == concept_id).groupBy("person_id").agg(F.min("event_date").alias("index_date"))
    chosen = first.withColumn("_h", F.pmod(F.col("person_id") * 7919, F.lit(10007))).orderBy("_h", "person_id").limit(persons).drop("_h")
    near = spanned.join(chosen, "person_id").where(F.col("index_date").between(F.col("lower_bound"), F.col("upper_bound")))
    return _ordered(near, ["person_id"], "index_date").select("person_id", F.col("concepts").alias("sequence"), F.col("collection_size").alias("size"))


def numbered(sequences: DataFrame, key: str, limit: int) -> DataFrame:
    """(position, sequence) of the first ``limit`` sequences by key, from 0."""
    top = sequences.orderBy(key).limit(limit)
    return top.withColumn("position", (F.row_number().over(Window.orderBy(key)) - 1).cast("int"))
