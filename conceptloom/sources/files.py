"""File sources and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_pairs(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """A CSV of concept pairs with a header; without a schema every column is text."""
    reader = spark.read.option("header", True)
    return (reader.schema(schema) if schema is not None else reader).csv(path)


def read_vectors_text(spark: SparkSession, path: str) -> DataFrame:
    """word2vec-style text: a header of two numbers, then an id and its values on each line. The header and ``</s>`` are left out.

    The header is known by its shape, so it does not matter how the file is split.
    """
    return parse_vectors(spark.read.text(path))


def parse_vectors(lines: DataFrame) -> DataFrame:
    """Lines ``value`` to (standard_concept_id int, vector array<double>)."""
    parts = F.filter(F.split(F.trim("value"), " +"), lambda p: p != "")
    rows = lines.select(parts.alias("p")).where((F.size("p") > 2) & (F.col("p")[0] != "</s>"))
    return rows.select(F.col("p")[0].cast("int").alias("standard_concept_id"), F.transform(F.slice("p", 2, F.size("p") - 1), lambda x: x.cast("double")).alias("vector"))


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Lines to arrays of their words."""
    return spark.read.text(path).select(F.split("value", " ").alias("words"))


def read_concept_list(spark: SparkSession, path: str) -> DataFrame:
    """Comma-separated ids over any number of lines to one ``concept_id`` a row; anything else is skipped."""
    return parse_concept_list(spark.read.text(path))


def parse_concept_list(lines: DataFrame) -> DataFrame:
    ids = lines.select(F.explode(F.split("value", ",")).alias("x")).select(F.trim("x").try_cast("bigint").alias("concept_id"))
    return ids.where("concept_id is not null")


def vector_text(vector: Column | str) -> Column:
    """Values joined by commas."""
    return F.array_join(F.transform(vector, lambda v: v.cast("string")), ",")


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str, header: bool = True, single_file: bool = False, mode: str = "overwrite") -> None:
    """Only a result known to be small should be one file."""
    (df.coalesce(1) if single_file else df).write.mode(mode).option("header", header).csv(path)


def write_lines(df: DataFrame, path: str, single_file: bool = False) -> None:
    """A one-column table as text."""
    (df.coalesce(1) if single_file else df).write.mode("overwrite").text(path)
