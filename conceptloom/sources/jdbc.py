"""Tables of a clinical database over JDBC."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession

from conceptloom.config import Database

#: Tables of the first kind of job.
CDM_TABLES = ("visit_occurrence", "condition_occurrence", "drug_exposure", "procedure_occurrence", "measurement", "observation", "concept_ancestor")
#: Large tables and the key that splits their reads.
PARTITION_KEYS = {
    "condition_occurrence": "condition_occurrence_id",
    "drug_exposure": "drug_exposure_id",
    "measurement": "measurement_id",
    "observation": "observation_id",
    "person": "person_id",
    "procedure_occurrence": "procedure_occurrence_id",
    "visit_occurrence": "visit_occurrence_id",
}


def read_table(spark: SparkSession, db: Database, table: str) -> DataFrame:
    return spark.read.jdbc(db.url, table, properties=db.properties)


def load_cdm_tables(spark: SparkSession, db: Database) -> dict[str, DataFrame]:
    return {t: read_table(spark, db, t) for t in CDM_TABLES}


def largest_key(spark: SparkSession, db: Database, table: str, key: str) -> int:
    """MAX(key), worked out by the database; 0 for an empty table."""
    row = spark.read.format("jdbc").option("url", db.url).options(**db.properties).option("query", f"SELECT MAX({key}) AS largest FROM {table}").load().first()
    return int(row[0] or 0)


def read_partitioned(spark: SparkSession, db: Database, table: str, key: str, partitions: int = 16) -> DataFrame:
    """A read split into ranges of the key; keys under 1 or added meanwhile come with the outer ranges."""
    upper = max(largest_key(spark, db, table, key), 2)
    return spark.read.jdbc(db.url, table, column=key, lowerBound=1, upperBound=upper, numPartitions=partitions, properties=db.properties)


def download(
    spark: SparkSession,
    db: Database,
    tables: Iterable[str],
    folder: str,
    partitions: int = 16,
    read: Callable[[str], DataFrame] | None = None,
) -> list[str]:
    """Write each table to ``folder``; a failing table does not stop the others, but all failures are raised at the end."""

    def default(table: str) -> DataFrame:
        key = PARTITION_KEYS.get(table)
        return read_partitioned(spark, db, table, key, partitions) if key else read_table(spark, db, table)

    done, failed = [], {}
    for table in tables:
        try:
            (read or default)(table).write.mode("overwrite").parquet(f"{folder}/{table}")
            done.append(table)
        except Exception as e:  # noqa: BLE001  reported below
            failed[table] = e
    if failed:
        raise RuntimeError("; ".join(f"{t}: {e}" for t, e in failed.items())) from next(iter(failed.values()))
    return done
