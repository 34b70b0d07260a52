"""Every operator as a query over the retail tables, and the same in SQL where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from conceptloom import features
from conceptloom.adapters import retail
from conceptloom.functions import lexical
from conceptloom.functions import vectors as V
from conceptloom.operators import alignment, cooccurrence, embeddings, events, glove, information, ontology, projection, sequences
from conceptloom.plans import jobs
from conceptloom.sources import files
from conceptloom.storage import materialise, shared_dir

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

START, END, DAYS = "1996-01-01", "2000-12-31", 60
DIGITS = 6


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Sums of doubles depend on their order, so both engines compare rounded values."""
    return df.withColumns({c: F.round(c, DIGITS) + F.lit(0.0) for c in columns})


# SQL of the adapters -------------------------------------------------------------------------------------------------

EV = """ev AS (SELECT o_custkey AS person_id, l_partkey AS standard_concept_id, CAST(l_shipdate AS DATE) AS event_date, l_orderkey AS visit_occurrence_id,
  CASE l_returnflag WHEN 'A' THEN 'condition' WHEN 'N' THEN 'drug' ELSE 'procedure' END AS domain FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
TREE = """tree AS (SELECT p_partkey >> l AS a, p_partkey AS d, CAST(l AS INTEGER) AS lo, CAST(l AS INTEGER) AS hi FROM part, range(0, 41) t(l) WHERE p_partkey >= 1 AND (p_partkey >> l) >= 1)"""
DAG = """dag AS (SELECT a, d, CAST(min(l) AS INTEGER) AS lo, CAST(max(l) AS INTEGER) AS hi FROM (SELECT p_partkey // CAST(pow(2, i) * pow(3, j) AS BIGINT) AS a, p_partkey AS d, i + j AS l
  FROM part, range(0, 25) s(i), range(0, 16) t(j) WHERE p_partkey >= 1 AND p_partkey >= pow(2, i) * pow(3, j)) GROUP BY a, d)"""
PAIRS = """pairs AS (SELECT c1, c2, n1, p_name AS n2 FROM (SELECT p_partkey AS c1, (p_partkey * 7 + 3) % (SELECT count(*) FROM part) AS c2, p_name AS n1 FROM part WHERE p_partkey >= 1) JOIN part ON p_partkey = c2
  WHERE c2 >= 1 AND c1 <> c2)"""
EMB = "emb AS (SELECT vec_id AS c, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings)"
REF = """ref AS (SELECT c1, c2, CAST(a.label = b.label AS INTEGER) AS truth FROM (SELECT vec_id AS c1, (vec_id * 7 + 3) % (SELECT count(*) FROM embeddings) AS c2, label FROM embeddings) a JOIN embeddings b ON b.vec_id = c2)"""
WIN = f"""win AS (SELECT *, CAST(floor(date_diff('day', DATE '{START}', event_date) / {DAYS}.0) AS BIGINT) AS patient_window, CAST(floor(date_diff('day', DATE '{START}', event_date) / 30.0) AS BIGINT) AS sub_patient_window
  FROM dev WHERE event_date BETWEEN DATE '{START}' AND DATE '{END}')"""
DEV = "dev AS (SELECT DISTINCT * FROM ev WHERE standard_concept_id <> 0)"


def _occ(source: str) -> str:
    return f"occ AS (SELECT dense_rank() OVER (ORDER BY standard_concept_id) AS id, standard_concept_id, count(DISTINCT person_id) AS n FROM {source} WHERE standard_concept_id <> 0 GROUP BY standard_concept_id)"


def _dice(source: str, on: str, rows: str) -> str:
    """SQL of a Dice matrix: ``rows`` makes distinct events ``w`` from ``source``."""
    return f"""WITH {EV}, src AS ({source}), {_occ("src")}, w AS ({rows}),
n12 AS (SELECT a.standard_concept_id AS c1, b.standard_concept_id AS c2, count(DISTINCT a.person_id) AS k FROM w a JOIN w b ON a.person_id = b.person_id AND a.standard_concept_id <> b.standard_concept_id{on} GROUP BY ALL)
SELECT x.id AS id_1, y.id AS id_2, round(k * 2.0::DOUBLE / (x.n + y.n), {DIGITS}) AS normalized_count, c1 AS standard_concept_id_1, c2 AS standard_concept_id_2, k AS count
FROM n12 JOIN occ x ON x.standard_concept_id = c1 JOIN occ y ON y.standard_concept_id = c2"""


# Events ----------------------------------------------------------------------------------------------------------------


@query(f"WITH {EV} SELECT DISTINCT * FROM ev WHERE standard_concept_id <> 0")
def domain_events_union(spark: SparkSession, sf: str) -> DataFrame:
    return events.join_domains(retail.domain_tables(spark, sf))


@query(f"""WITH {EV}, {TREE}, m AS (SELECT d, a FROM tree JOIN part ON p_partkey = a WHERE p_type = 'SMALL')
SELECT coalesce(a, standard_concept_id) AS drug_concept_id, person_id, event_date, visit_occurrence_id FROM ev LEFT JOIN m ON d = standard_concept_id WHERE domain = 'drug'""")
def drug_ingredient_rollup(spark: SparkSession, sf: str) -> DataFrame:
    rolled = events.prepare(retail.domain_tables(spark, sf)[1], retail.concepts(spark, sf), retail.tree(spark, sf))
    return rolled.select("drug_concept_id", "person_id", F.col("drug_exposure_start_date").alias("event_date"), "visit_occurrence_id")


@query(f"WITH {EV}, {DEV}, {WIN} SELECT * FROM win")
def fixed_time_windows(spark: SparkSession, sf: str) -> DataFrame:
    return events.in_fixed_windows(_domains(spark, sf), START, END, DAYS)


@query(f"WITH {EV}, {DEV} SELECT *, visit_occurrence_id AS patient_window FROM dev WHERE visit_occurrence_id IS NOT NULL")
def visit_windows(spark: SparkSession, sf: str) -> DataFrame:
    return events.visit_windows(_domains(spark, sf))


@query(f"WITH {EV}, {DEV} SELECT *, CAST(event_date - INTERVAL 30 DAY AS DATE) AS lower_bound, CAST(event_date + INTERVAL 30 DAY AS DATE) AS upper_bound FROM dev")
def span_bounds(spark: SparkSession, sf: str) -> DataFrame:
    return events.with_span(_domains(spark, sf), 30)


@query(f"WITH {EV}, {DEV} SELECT *, visit_occurrence_id AS time_window FROM dev WHERE visit_occurrence_id IN (SELECT o_orderkey FROM orders)")
def visit_events(spark: SparkSession, sf: str) -> DataFrame:
    return events.in_visits(_domains(spark, sf), retail.visits(spark, sf))


@query(f"WITH {EV}, {DEV} SELECT *, CAST(1 AS BIGINT) AS time_window FROM dev WHERE year(event_date) BETWEEN 1997 AND 2001")
def year_range_events(spark: SparkSession, sf: str) -> DataFrame:
    return events.in_years(_domains(spark, sf), 1997, 2001)


def _domains(spark: SparkSession, sf: str) -> DataFrame:
    return events.join_domains(retail.domain_tables(spark, sf))


# Occurrence and co-occurrence ---------------------------------------------------------------------------------------


@query(f"WITH {EV}, {_occ('ev')} SELECT id, standard_concept_id, n AS count FROM occ")
def concept_occurrence(spark: SparkSession, sf: str) -> DataFrame:
    return cooccurrence.occurrence(retail.events(spark, sf))


@query(f"WITH {EV}, {_occ('ev')} SELECT id - 1 AS id, standard_concept_id, n AS count FROM occ")
def concept_dictionary_zero_based(spark: SparkSession, sf: str) -> DataFrame:
    return cooccurrence.occurrence(retail.events(spark, sf), first_id=0)


_MAPPED = "SELECT * FROM ev WHERE standard_concept_id <> 0"


@query(_dice(_MAPPED, "", "SELECT DISTINCT person_id, standard_concept_id FROM src"))
def cooccurrence_lifetime(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(cooccurrence.cooccurrence(events.in_lifetime(retail.events(spark, sf)), window=None), "normalized_count")


@query(_dice(_MAPPED, " AND a.visit_occurrence_id = b.visit_occurrence_id", "SELECT DISTINCT person_id, visit_occurrence_id, standard_concept_id FROM src"))
def cooccurrence_visit(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(cooccurrence.cooccurrence(events.in_visits(retail.events(spark, sf), retail.visits(spark, sf))), "normalized_count")


def _span(days: int) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return rounded(cooccurrence.cooccurrence(retail.events(spark, sf), days=days), "normalized_count")

    run.__name__ = f"cooccurrence_span_{days}"
    return run


for _days in (30, 90, 180):
    query(_dice(_MAPPED, f" AND abs(a.event_date - b.event_date) <= {_days}", "SELECT DISTINCT person_id, event_date, standard_concept_id FROM src"))(_span(_days))


@query(_dice(f"{_MAPPED} AND year(event_date) BETWEEN 1997 AND 2001", "", "SELECT DISTINCT person_id, standard_concept_id FROM src"))
def cooccurrence_years(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(cooccurrence.cooccurrence(events.in_years(retail.events(spark, sf), 1997, 2001), window=None), "normalized_count")


def _decay(diagonal: bool) -> str:
    own = """ UNION ALL SELECT c, c, sum(w) FROM (SELECT c, m * (m - 1.0::DOUBLE) AS w FROM m WHERE m > 1
  UNION ALL SELECT a.c, 2.0::DOUBLE * a.m * b.m / (b.d - a.d + 1) FROM m a JOIN m b ON a.p = b.p AND a.w = b.w AND a.c = b.c AND a.d < b.d) GROUP BY c"""
    return f"""WITH {EV}, {DEV}, {WIN}, o AS (SELECT dense_rank() OVER (ORDER BY standard_concept_id) - 1 AS id, standard_concept_id AS c FROM win GROUP BY standard_concept_id),
m AS (SELECT person_id AS p, patient_window AS w, standard_concept_id AS c, event_date AS d, count(*) AS m FROM win GROUP BY ALL),
s AS (SELECT a.c AS c1, b.c AS c2, sum(a.m * b.m / (abs(a.d - b.d) + 1.0::DOUBLE)) AS v FROM m a JOIN m b ON a.p = b.p AND a.w = b.w AND a.c <> b.c GROUP BY ALL{own if diagonal else ""})
SELECT x.id AS id_1, y.id AS id_2, round(v, {DIGITS}) AS normalized_count, c1 AS standard_concept_id_1, c2 AS standard_concept_id_2 FROM s JOIN o x ON x.c = c1 JOIN o y ON y.c = c2"""


@query(_decay(False))
def cooccurrence_decay_window(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(cooccurrence.decayed(fixed_time_windows(spark, sf)), "normalized_count")


@query(_decay(True))
def cooccurrence_decay_window_with_diagonal(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(cooccurrence.decayed(fixed_time_windows(spark, sf), include_diagonal=True), "normalized_count")


# Information content --------------------------------------------------------------------------------------------------

IC = """seen AS (SELECT DISTINCT person_id, standard_concept_id AS c FROM ev), f AS (SELECT c, count(*) AS n FROM seen WHERE c <> 0 GROUP BY c),
ic AS (SELECT a AS c, CAST(sum(n) AS BIGINT) AS n, -ln(sum(n)::DOUBLE / (SELECT count(*) FROM seen)) AS ic, sum(n)::DOUBLE / (SELECT count(*) FROM seen) AS p FROM dag JOIN f ON f.c = d GROUP BY a)"""
_IC_OUT = f"SELECT c AS concept_id, n AS count, round(ic, {DIGITS}) + 0.0 AS information_content, round(p, {DIGITS}) AS probability FROM ic"


@query(f"WITH {EV}, {DAG}, {IC} {_IC_OUT}")
def information_content(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_content(spark, sf), "information_content", "probability")


def _content(spark: SparkSession, sf: str) -> DataFrame:
    return information.information_content(retail.events(spark, sf), retail.dag(spark, sf))


@query(f"""WITH {EV}, {DAG}, f AS (SELECT standard_concept_id AS c, count(DISTINCT person_id) AS n FROM ev WHERE standard_concept_id <> 0 GROUP BY 1),
ic AS (SELECT a AS c, CAST(sum(n) AS BIGINT) AS n, -ln(sum(n)::DOUBLE / (SELECT sum(n) FROM f)) AS ic, sum(n)::DOUBLE / (SELECT sum(n) FROM f) AS p FROM dag JOIN f ON f.c = d WHERE lo >= 1 GROUP BY a) {_IC_OUT}""")
def information_content_strict(spark: SparkSession, sf: str) -> DataFrame:
    frequencies = cooccurrence.occurrence(retail.events(spark, sf)).select("standard_concept_id", "count")
    return rounded(information.information_content_of(frequencies, retail.dag(spark, sf)), "information_content", "probability")


# Ontology -------------------------------------------------------------------------------------------------------------

COMMON = "com AS (SELECT c1, c2, x.a, x.lo AS d1, y.lo AS d2 FROM pairs JOIN dag x ON x.d = c1 JOIN dag y ON y.d = c2 AND y.a = x.a)"
SIM = f"""roots AS (SELECT d FROM dag GROUP BY d HAVING count(*) = 1), depth AS (SELECT d AS a, max(hi) AS r FROM dag WHERE a IN (SELECT d FROM roots) AND a <> d GROUP BY d),
sim AS (SELECT c1, c2, max(r * 2.0::DOUBLE / (r * 2 + d1 + d2)) AS s FROM com JOIN depth USING (a) GROUP BY c1, c2)"""


@query(f"WITH {DAG} SELECT d AS concept_id FROM dag GROUP BY d HAVING count(*) = 1")
def root_concepts(spark: SparkSession, sf: str) -> DataFrame:
    return ontology.roots(retail.dag(spark, sf))


@query(f"WITH {DAG}, {PAIRS}, {COMMON}, {SIM} SELECT c1 AS concept_id_1, c2 AS concept_id_2, round(s, {DIGITS}) AS semantic_similarity, CAST(s IS NOT NULL AS INTEGER) AS is_connected FROM pairs LEFT JOIN sim USING (c1, c2)")
def semantic_similarity(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ontology.semantic_similarity(_id_pairs(spark, sf), retail.dag(spark, sf)), "semantic_similarity")


def _id_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return retail.pairs(spark, sf).select("concept_id_1", "concept_id_2")


@query(f"WITH {DAG}, {PAIRS}, {COMMON} SELECT c1 AS concept_id_1, c2 AS concept_id_2, min(d1 + d2) AS min_distance FROM pairs LEFT JOIN com USING (c1, c2) GROUP BY ALL")
def min_distance(spark: SparkSession, sf: str) -> DataFrame:
    return ontology.min_distance(_id_pairs(spark, sf), retail.dag(spark, sf))


@query(f"WITH {TREE} SELECT a AS ancestor_concept_id, d AS descendant_concept_id, lo AS min_levels_of_separation, hi AS max_levels_of_separation FROM tree")
def closure_from_edges(spark: SparkSession, sf: str) -> DataFrame:
    return ontology.closure_of(retail.edges(spark, sf))


@query(f"""WITH {TREE}, {PAIRS}, len AS (SELECT d, count(*) AS n FROM tree GROUP BY d), shared AS (SELECT c1, c2, count(*) AS k FROM pairs JOIN tree x ON x.d = c1 JOIN tree y ON y.d = c2 AND x.a = y.a GROUP BY ALL)
SELECT c1 AS concept_id_1, c2 AS concept_id_2, CASE WHEN c1 = 1 OR c2 = 1 THEN 0.0::DOUBLE ELSE round(2.0::DOUBLE * k / (x.n + y.n), {DIGITS}) END AS path_score FROM shared JOIN len x ON x.d = c1 JOIN len y ON y.d = c2""")
def path_semantic_score(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ontology.path_similarity(_id_pairs(spark, sf), retail.edges(spark, sf)), "path_score")


def _measures_sql(bag: bool) -> str:
    every = "sum(ic) + coalesce(sum(ic) FILTER (WHERE k = 2), 0)" if bag else "sum(ic)"
    return f"""anc AS (SELECT c1, c2, a, count(*) AS k FROM (SELECT c1, c2, a FROM pairs JOIN dag ON d = c1 UNION ALL SELECT c1, c2, a FROM pairs JOIN dag ON d = c2) GROUP BY ALL),
ms AS (SELECT c1, c2, max(ic) FILTER (WHERE k = 2) AS mica, max(p) FILTER (WHERE k = 2) AS pm, sum(ic) FILTER (WHERE k = 2) AS shared, {every} AS total FROM anc JOIN ic ON ic.c = a GROUP BY c1, c2),
mm AS (SELECT pairs.c1, pairs.c2, mica, pm, shared, total, x.ic AS i1, y.ic AS i2, 2 * mica / nullif(x.ic * y.ic, 0) AS lin FROM pairs LEFT JOIN ms USING (c1, c2) LEFT JOIN ic x ON x.c = pairs.c1 LEFT JOIN ic y ON y.c = pairs.c2),
mo AS (SELECT c1, c2, mica AS mica_information_content, lin AS lin_measure, 1 - (i1 + i2 - 2 * mica) AS jiang_measure, lin * (1 - 1 / nullif(1 + mica, 0)) AS information_coefficient,
  lin * (1 - pm) AS relevance_measure, shared / nullif(total, 0) AS graph_ic_measure FROM mm)"""


_M = ", ".join(f"round({m}, {DIGITS}) + 0.0 AS {m}" for m in information.MEASURES)


@query(f"WITH {EV}, {DAG}, {PAIRS}, {IC}, {_measures_sql(False)} SELECT c1 AS concept_id_1, c2 AS concept_id_2, {_M} FROM mo")
def ic_measures(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(information.measures(_id_pairs(spark, sf), _content(spark, sf), retail.dag(spark, sf)), *information.MEASURES)


@query(f"WITH {EV}, {DAG}, {PAIRS}, {IC}, {_measures_sql(True)} SELECT c1 AS concept_id_1, c2 AS concept_id_2, {_M} FROM mo")
def ic_measures_bag_union(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(information.measures(_id_pairs(spark, sf), _content(spark, sf), retail.dag(spark, sf), bag_union=True), *information.MEASURES)


@query(f"WITH {EV}, {DAG}, {PAIRS}, {IC}, {COMMON} SELECT c1 AS concept_id_1, c2 AS concept_id_2, a AS ancestor_concept_id, round(ic, {DIGITS}) + 0.0 AS mica_information_content FROM com JOIN ic ON ic.c = a")
def mica_per_ancestor(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(information.common_contents(_id_pairs(spark, sf), _content(spark, sf), retail.dag(spark, sf)), "mica_information_content")


# Names ----------------------------------------------------------------------------------------------------------------

_NAMES = "(SELECT DISTINCT p_name AS name_1 FROM part) a, (SELECT DISTINCT p_name AS name_2 FROM part) b"


def _lexical(name: str, score: Callable[[Column, Column], Column], sql: str | None) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        value = score(F.col("name_1"), F.col("name_2"))
        return retail.name_pairs(spark, sf).withColumn("score", value if name == "lexical_distance" else F.round(value, DIGITS))

    run.__name__ = name
    query(f"SELECT name_1, name_2, {sql} AS score FROM {_NAMES}" if sql else None)(run)


_lexical("lexical_distance", lexical.distance, "CAST(levenshtein(name_1, name_2) AS INTEGER)")
_lexical("lexical_jaro", lexical.jaro, f"round(jaro_similarity(name_1, name_2), {DIGITS})")
_lexical("lexical_jaro_winkler", lexical.jaro_winkler, f"round(jaro_winkler_similarity(name_1, name_2), {DIGITS})")


def _lcs(pairs: str, n: int) -> str:
    """Tables of a recursive query: ``lcs`` (k1, k2, n), the longest common subsequence of the lists a and b of ``pairs`` (k1, k2, a, b)."""
    return f"""m AS (SELECT k1, k2, i, j FROM {pairs}, range(1, {n}) t(i), range(1, {n}) u(j) WHERE i <= len(a) AND j <= len(b) AND a[i] = b[j]),
chain AS (SELECT k1, k2, i, j, 1 AS n FROM m UNION SELECT c.k1, c.k2, m.i, m.j, c.n + 1 FROM chain c JOIN m ON m.k1 = c.k1 AND m.k2 = c.k2 AND m.i > c.i AND m.j > c.j),
lcs AS (SELECT k1, k2, max(n) AS n FROM chain GROUP BY ALL)"""


@query(f"""WITH RECURSIVE np AS (SELECT name_1 AS k1, name_2 AS k2, string_split(name_1, '') AS a, string_split(name_2, '') AS b FROM {_NAMES}), {_lcs("np", 60)}
SELECT k1 AS name_1, k2 AS name_2, round(2.0::DOUBLE * coalesce(n, 0) / (len(a) + len(b)), {DIGITS}) AS score FROM np LEFT JOIN lcs USING (k1, k2)""")
def lexical_ratio(spark: SparkSession, sf: str) -> DataFrame:
    return retail.name_pairs(spark, sf).withColumn("score", F.round(lexical.ratio(F.col("name_1"), F.col("name_2")), DIGITS))


_lexical("lexical_partial_ratio", lexical.partial_ratio, None)


# Vectors --------------------------------------------------------------------------------------------------------------

_COS = "list_cosine_similarity(x.v, y.v)"
_DIST = "sqrt(list_sum(list_transform(list_zip(x.v, y.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))"


def _embedding(spark: SparkSession, sf: str) -> DataFrame:
    return retail.embedding(spark, sf).select("standard_concept_id", "vector")


_VISIT_DICE = f"""SELECT standard_concept_id_1 AS c1, standard_concept_id_2 AS c2, normalized_count AS nc FROM ({_dice(_MAPPED, " AND a.visit_occurrence_id = b.visit_occurrence_id", "SELECT DISTINCT person_id, visit_occurrence_id, standard_concept_id FROM src")})"""


@query(f"WITH {PAIRS} SELECT c1 AS concept_id_1, c2 AS concept_id_2, nc AS cooccurrence_visit FROM pairs LEFT JOIN ({_VISIT_DICE}) USING (c1, c2)")
def cooccurrence_feature(spark: SparkSession, sf: str) -> DataFrame:
    return features.Cooccurrence("cooccurrence visit", cooccurrence_visit(spark, sf)).annotate(_id_pairs(spark, sf))


@query(f"WITH {PAIRS}, {EMB} SELECT c1 AS concept_id_1, c2 AS concept_id_2, round(coalesce({_COS}, 0), {DIGITS}) + 0.0 AS mce_cosine FROM pairs LEFT JOIN emb x ON x.c = c1 LEFT JOIN emb y ON y.c = c2")
def embedding_cosine(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(features.Embedding("mce", _embedding(spark, sf)).annotate(_id_pairs(spark, sf)), "mce_cosine")


@query(f"""WITH {EMB}, h AS (SELECT CAST(count(*) // 2 AS BIGINT) AS n FROM emb)
SELECT x.c AS standard_concept_id, array_to_string(list_transform(list_zip(x.v, y.v), lambda z: CAST(round((z[1] + z[2]) / 2 * 1000000) AS BIGINT)), ',') AS vector FROM emb x, h JOIN emb y ON y.c = x.c + n WHERE x.c < n""")
def glove_target_context_mean(spark: SparkSession, sf: str) -> DataFrame:
    e = _embedding(spark, sf)
    half = e.agg(F.expr("count(*) div 2").alias("half"))
    vocabulary = e.crossJoin(F.broadcast(half)).where("standard_concept_id < half").select(F.col("standard_concept_id").alias("id"), "standard_concept_id")
    mean = embeddings.target_context_mean(vocabulary, e.select(F.col("standard_concept_id").alias("wordId"), "vector"))
    return mean.select("standard_concept_id", F.array_join(F.transform("vector", lambda x: F.round(x * 1000000).cast("bigint").cast("string")), ",").alias("vector"))


#: The matrices of the training pipeline, and the embeddings with target and context vectors; their defaults fill only some.
_SPANS = {"60_days": 60, "180_days": 180, "360_days": 360}
_EMBEDDED = {"lifetime_cooccur_embedding": "id", "5_year_cooccur_embedding": "(id * 3 + 1) % half", "visit_cooccur_embedding": "half - 1 - id"}
_MATRICES = ("cooccurrence_visit", *(f"cooccurrence_{n}" for n in _SPANS), "cooccurrence_lifetime")
_FEATURES = ("ratio", "jaro", "jaro_wrinkler", *_MATRICES, "semantic_similarity", *information.MEASURES, *(f"{n}_cosine" for n in _EMBEDDED), "mce_cosine")


def _cells(table: str, on: str, rows: str) -> str:
    return f"{table} AS (SELECT standard_concept_id_1 AS c1, standard_concept_id_2 AS c2, normalized_count AS {table} FROM ({_dice(_MAPPED, on, rows)}))"


_MATRIX_SQL = ", ".join([
    _cells("cooccurrence_visit", " AND a.visit_occurrence_id = b.visit_occurrence_id", "SELECT DISTINCT person_id, visit_occurrence_id, standard_concept_id FROM src"),
    *(_cells(f"cooccurrence_{n}", f" AND abs(a.event_date - b.event_date) <= {d}", "SELECT DISTINCT person_id, event_date, standard_concept_id FROM src") for n, d in _SPANS.items()),
    _cells("cooccurrence_lifetime", "", "SELECT DISTINCT person_id, standard_concept_id FROM src"),
])
_EMBEDDED_SQL = ", ".join(f'"{n}" AS (SELECT {rule} AS c, v FROM tc)' for n, rule in _EMBEDDED.items())


@query(f"""WITH RECURSIVE {EV}, {DAG}, {PAIRS}, {IC}, {_measures_sql(False)}, {COMMON}, {SIM}, {EMB}, {_MATRIX_SQL},
tc AS (SELECT x.c AS id, h.half, list_transform(list_zip(x.v, y.v), lambda z: (z[1] + z[2]) / 2) AS v FROM emb x, (SELECT CAST(count(*) // 2 AS BIGINT) AS half FROM emb) h JOIN emb y ON y.c = x.c + h.half WHERE x.c < h.half), {_EMBEDDED_SQL},
np AS (SELECT c1 AS k1, c2 AS k2, string_split(n1, '') AS a, string_split(n2, '') AS b FROM pairs), {_lcs("np", 60)}
SELECT c1 AS concept_id_1, c2 AS concept_id_2, CAST(levenshtein(n1, n2) AS INTEGER) AS distance, round(2.0::DOUBLE * coalesce(lcs.n, 0) / (length(n1) + length(n2)), {DIGITS}) AS ratio,
round(jaro_similarity(n1, n2), {DIGITS}) AS jaro, round(jaro_winkler_similarity(n1, n2), {DIGITS}) AS jaro_wrinkler,
{", ".join(f"coalesce({m}.{m}, 0) AS {m}" if m.endswith(("visit", "lifetime")) else f"{m}.{m} AS {m}" for m in _MATRICES)}, round(coalesce(s, 0), {DIGITS}) AS semantic_similarity, CAST(s IS NOT NULL AS INTEGER) AS is_connected,
{", ".join(f"round(coalesce({m}, 0), {DIGITS}) + 0.0 AS {m}" for m in information.MEASURES)},
{", ".join(f'round(coalesce(list_cosine_similarity(x{i}.v, y{i}.v), 0), {DIGITS}) + 0.0 AS "{n}_cosine"' for i, n in enumerate(_EMBEDDED))}, round(coalesce({_COS}, 0), {DIGITS}) + 0.0 AS mce_cosine
FROM pairs {" ".join(f"LEFT JOIN {m} USING (c1, c2)" for m in _MATRICES)} LEFT JOIN sim USING (c1, c2) LEFT JOIN mo USING (c1, c2) LEFT JOIN emb x ON x.c = c1 LEFT JOIN emb y ON y.c = c2
{" ".join(f'LEFT JOIN "{n}" x{i} ON x{i}.c = c1 LEFT JOIN "{n}" y{i} ON y{i}.c = c2' for i, n in enumerate(_EMBEDDED))} LEFT JOIN lcs ON lcs.k1 = c1 AND lcs.k2 = c2""")
def feature_pipeline(spark: SparkSession, sf: str) -> DataFrame:
    """All columns of the training table but fuzz_partial_ratio, which SQL cannot say; feature_table has it."""
    return feature_table(spark, sf).drop("fuzz_partial_ratio")


@query()
def feature_table(spark: SparkSession, sf: str) -> DataFrame:
    """The whole training table: five lexical columns, five matrices, ontology and information, three trained embeddings and a final one."""
    pairs, rows, e = materialise(retail.pairs(spark, sf), "pairs"), materialise(retail.events(spark, sf), "events"), _embedding(spark, sf)
    cells = {"visit": cooccurrence.cooccurrence(events.in_visits(rows, retail.visits(spark, sf)), wanted=pairs)}
    cells |= {n: cooccurrence.cooccurrence(rows, days=d, wanted=pairs) for n, d in _SPANS.items()}
    cells["lifetime"] = cooccurrence.cooccurrence(rows, window=None, wanted=pairs)
    ids = e.crossJoin(F.broadcast(e.agg(F.expr("count(*) div 2").alias("half")))).where("standard_concept_id < half").select(F.col("standard_concept_id").alias("id"), "half")
    weights = e.select(F.col("standard_concept_id").alias("wordId"), "vector")
    vectors = {n.replace("_", " "): (weights, ids.select("id", F.expr(rule).alias("standard_concept_id"))) for n, rule in _EMBEDDED.items()}
    made = jobs.training_features(pairs, cells, retail.dag(spark, sf), information.information_content(rows, retail.dag(spark, sf)), vectors | {"mce": (e, None)})
    return rounded(made.select("concept_id_1", "concept_id_2", "distance", "is_connected", "fuzz_partial_ratio", *_FEATURES), *_FEATURES)


@query(f"""WITH RECURSIVE {PAIRS}, np AS (SELECT c1 AS k1, c2 AS k2, string_split(n1, '') AS a, string_split(n2, '') AS b FROM pairs), {_lcs("np", 60)}
SELECT c1 AS concept_id_1, c2 AS concept_id_2, CAST(levenshtein(n1, n2) AS INTEGER) AS "Levenshtein_distance", round(2.0::DOUBLE * coalesce(n, 0) / (length(n1) + length(n2)), {DIGITS}) AS "Levenshtein_ratio",
round(jaro_similarity(n1, n2), {DIGITS}) AS jaro, round(jaro_winkler_similarity(n1, n2), {DIGITS}) AS jaro_winkler FROM pairs LEFT JOIN lcs ON k1 = c1 AND k2 = c2""")
def lexical_standard_names(spark: SparkSession, sf: str) -> DataFrame:
    """Other columns than the pipeline's, under the standard names."""
    named = retail.pairs(spark, sf).withColumnsRenamed({"concept_name_1": "left_name", "concept_name_2": "right_name"})
    out = features.LexicalSimilarity("lexical", ("left_name", "right_name"), features.LexicalSimilarity.STANDARD).annotate(named)
    return rounded(out.select("concept_id_1", "concept_id_2", *features.LexicalSimilarity.STANDARD[:4]), "Levenshtein_ratio", "jaro", "jaro_winkler")


@query(f"""WITH {EV}, {DAG}, {PAIRS}, {IC}, {_measures_sql(False)}, {COMMON}, {SIM},
w AS (SELECT c1, c2, CAST(s IS NOT NULL AS INTEGER) AS is_connected, mica_information_content AS mica, graph_ic_measure AS g, x.ic AS i1, y.ic AS i2 FROM pairs LEFT JOIN sim USING (c1, c2) LEFT JOIN mo USING (c1, c2) LEFT JOIN ic x ON x.c = c1 LEFT JOIN ic y ON y.c = c2),
findings AS (SELECT *, 'unconnected' AS finding FROM w WHERE is_connected = 0 UNION ALL SELECT *, 'uninformative' FROM w WHERE is_connected = 1 AND mica = 0 UNION ALL SELECT *, 'unknown' FROM w WHERE mica IS NOT NULL AND (i1 IS NULL OR i2 IS NULL))
SELECT c1 AS concept_id_1, c2 AS concept_id_2, is_connected, round(mica, {DIGITS}) + 0.0 AS mica_information_content, round(g, {DIGITS}) + 0.0 AS graph_ic_measure, finding FROM findings""")
def pair_diagnostics(spark: SparkSession, sf: str) -> DataFrame:
    content, closure = _content(spark, sf), retail.dag(spark, sf)
    measured = information.measures(ontology.semantic_similarity(_id_pairs(spark, sf), closure), content, closure)
    return rounded(information.diagnostics(measured, content), "mica_information_content", "graph_ic_measure")


@query(f"WITH {DAG} SELECT CAST(a AS BIGINT) AS ancestor_concept_id, CAST(d AS BIGINT) AS descendant_concept_id, lo AS min_levels_of_separation, hi AS max_levels_of_separation FROM dag")
def closure_typed(spark: SparkSession, sf: str) -> DataFrame:
    """A closure whose columns came as text."""
    return ontology.typed(retail.dag(spark, sf).select(*[F.col(c).cast("string").alias(c) for c in retail.dag(spark, sf).columns]))


def _sequence_sql(window: str, source: str) -> str:
    return f"""SELECT person_id, {window} AS patient_window, CAST(count(*) AS INTEGER) AS collection_size, string_agg(CAST(standard_concept_id AS VARCHAR), ' ' ORDER BY event_date, standard_concept_id) AS concept_list
FROM {source} GROUP BY person_id, {window} HAVING count(*) > 1"""


_SEQUENCE_VISIT = _sequence_sql('visit_occurrence_id', 'dev')


# Files ----------------------------------------------------------------------------------------------------------------


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query(f"WITH {PAIRS} SELECT c1 AS concept_id_1, c2 AS concept_id_2, n1 AS concept_name_1, n2 AS concept_name_2 FROM pairs")
def pairs_through_csv(spark: SparkSession, sf: str) -> DataFrame:
    """Written with a header and read back with types."""
    rows, path = retail.pairs(spark, sf), _folder(spark, "pairs-csv")
    files.write_csv(rows, path)
    return files.read_pairs(spark, path, rows.schema)


@query(f"WITH {PAIRS} SELECT CAST(c1 AS VARCHAR) AS concept_id_1, CAST(c2 AS VARCHAR) AS concept_id_2, n1 AS concept_name_1, n2 AS concept_name_2 FROM pairs")
def pairs_through_csv_as_text(spark: SparkSession, sf: str) -> DataFrame:
    path = _folder(spark, "pairs-text")
    files.write_csv(retail.pairs(spark, sf), path, single_file=True)
    return files.read_pairs(spark, path)


@query(_dice(_MAPPED, " AND a.visit_occurrence_id = b.visit_occurrence_id", "SELECT DISTINCT person_id, visit_occurrence_id, standard_concept_id FROM src"))
def matrix_through_parquet(spark: SparkSession, sf: str) -> DataFrame:
    path = _folder(spark, "matrix")
    files.write_parquet(cooccurrence_visit(spark, sf), path)
    return spark.read.parquet(path)


@query(f"WITH {EMB} SELECT CAST(c AS INTEGER) AS standard_concept_id, round(list_sum(v), {DIGITS}) + 0.0 AS total, CAST(len(v) AS INTEGER) AS n FROM emb")
def vectors_through_text(spark: SparkSession, sf: str) -> DataFrame:
    """Written as lines of text and read back."""
    path = _folder(spark, "vectors")
    values = F.array_join(F.transform("vector", lambda x: x.cast("string")), " ")
    files.write_lines(_embedding(spark, sf).select(F.concat_ws(" ", F.col("standard_concept_id").cast("string"), values).alias("value")), path)
    rows = files.read_vectors_text(spark, path)
    return rounded(rows.select("standard_concept_id", F.aggregate("vector", F.lit(0.0), lambda s, x: s + x).alias("total"), F.size("vector").alias("n")), "total")


@query("SELECT p_partkey AS concept_id FROM part")
def concept_list_through_lines(spark: SparkSession, sf: str) -> DataFrame:
    path = _folder(spark, "concepts")
    files.write_lines(spark.read.parquet(f"{sf}/part.parquet").select(F.concat(F.col("p_partkey").cast("string"), F.lit(", none")).alias("value")), path)
    return files.read_concept_list(spark, path)


@query(f"WITH {EV}, {DEV}, q AS ({_SEQUENCE_VISIT}) SELECT concept_list, CAST(count(*) AS BIGINT) AS lines, max(collection_size) AS words FROM q GROUP BY concept_list")
def sequences_through_files(spark: SparkSession, sf: str) -> DataFrame:
    """Both files of a sequence job: the table, and the corpus that is read back as words."""
    path = _folder(spark, "sequences")
    jobs.write_sequences(jobs.patient_sequences(retail.domain_tables(spark, sf), START, END, by_visit=True), path)
    corpus = files.read_corpus(spark, f"{path}/sequence_csv").select(F.array_join("words", " ").alias("concept_list"), F.size("words").alias("words"))
    return corpus.groupBy("concept_list").agg(F.count(F.lit(1)).alias("lines"), F.max("words").alias("words"))


@query(f"WITH {DAG}, {PAIRS}, {COMMON}, {SIM} SELECT c1 AS concept_id_1, c2 AS concept_id_2, round(coalesce(s, 0), {DIGITS}) AS semantic_similarity, CAST(s IS NOT NULL AS INTEGER) AS is_connected FROM pairs LEFT JOIN sim USING (c1, c2)")
def fill_defaults(spark: SparkSession, sf: str) -> DataFrame:
    return features.fill_defaults(semantic_similarity(spark, sf))


# Sequences ------------------------------------------------------------------------------------------------------------


@query(f"WITH {EV}, {DEV} {_sequence_sql('visit_occurrence_id', 'dev')}")
def visit_sequences(spark: SparkSession, sf: str) -> DataFrame:
    return sequences.sequence_text(jobs.patient_sequences(retail.domain_tables(spark, sf), START, END, by_visit=True))


@query(f"WITH {EV}, {DEV}, {WIN} {_sequence_sql('patient_window', 'win')}")
def window_sequences(spark: SparkSession, sf: str) -> DataFrame:
    return sequences.sequence_text(jobs.patient_sequences(retail.domain_tables(spark, sf), START, END, DAYS))


@query(f"""WITH {EV}, {DEV}, day AS (SELECT person_id, event_date, string_agg(CAST(standard_concept_id AS VARCHAR), ', ' ORDER BY standard_concept_id) AS c FROM dev WHERE event_date BETWEEN DATE '{START}' AND DATE '{END}' GROUP BY ALL)
SELECT person_id, person_id || ', [' || string_agg('[' || CAST(CAST(epoch(event_date) AS BIGINT) AS VARCHAR) || '.0, [' || c || ']]', ', ' ORDER BY event_date) || ']' AS value FROM day GROUP BY person_id""")
def mce_sequences(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.day_sequences(retail.domain_tables(spark, sf), START, END)


@query(f"WITH {EMB} SELECT CAST(c AS INTEGER) AS standard_concept_id, round(list_sum(v), {DIGITS}) + 0.0 AS total, CAST(len(v) AS INTEGER) AS n FROM emb")
def mce_vector_parse(spark: SparkSession, sf: str) -> DataFrame:
    values = F.array_join(F.transform("vector", lambda x: x.cast("string")), " ")
    lines = _embedding(spark, sf).select(F.concat_ws(" ", F.col("standard_concept_id").cast("string"), values, F.lit("")).alias("value"))
    extra = spark.createDataFrame([("500 64",), ("</s> 0.1 0.2 ",)], "value string")
    parsed = files.parse_vectors(extra.unionByName(lines))
    return rounded(parsed.select("standard_concept_id", F.aggregate("vector", F.lit(0.0), lambda s, x: s + x).alias("total"), F.size("vector").alias("n")), "total")


@query("SELECT p_partkey AS concept_id FROM part WHERE p_size > 0")
def concept_list_parse(spark: SparkSession, sf: str) -> DataFrame:
    part = spark.read.parquet(f"{sf}/part.parquet").where("p_size > 0")
    return files.parse_concept_list(part.select(F.concat(F.lit(" "), F.col("p_partkey").cast("string"), F.lit(" , ,x")).alias("value")))


#: Persons that are drawn, as many as the reference draws.
_TIMELINE = 5000


@query(f"""WITH {EV}, {DEV}, f AS (SELECT person_id, min(event_date) AS i FROM dev WHERE standard_concept_id = 7 GROUP BY 1), c AS (SELECT * FROM f ORDER BY person_id * 7919 % 10007, person_id LIMIT {_TIMELINE})
SELECT person_id, string_agg(CAST(standard_concept_id AS VARCHAR), ' ' ORDER BY standard_concept_id) AS sequence, CAST(count(*) AS INTEGER) AS size FROM dev JOIN c USING (person_id) WHERE abs(event_date - i) <= 30 GROUP BY person_id HAVING count(*) > 1""")
def index_timeline(spark: SparkSession, sf: str) -> DataFrame:
    lines = sequences.index_timelines(events.with_span(_domains(spark, sf), 30), 7, _TIMELINE)
    return lines.withColumn("sequence", F.array_join(F.transform("sequence", lambda c: c.cast("string")), " "))


# Analytics of embeddings ------------------------------------------------------------------------------------------------


@query(f"WITH {EMB} SELECT x.c AS concept_id_1, y.c AS concept_id_2, round({_DIST}, {DIGITS}) AS metric FROM emb x, emb y")
def pairwise_euclidean(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(embeddings.pairwise(_embedding(spark, sf), "euclidean"), "metric")


@query(f"WITH {EMB} SELECT x.c AS concept_id_1, y.c AS concept_id_2, round({_COS}, {DIGITS}) + 0.0 AS metric FROM emb x, emb y")
def pairwise_cosine(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(embeddings.pairwise(_embedding(spark, sf), "cosine"), "metric")


@query(f"""WITH {EMB}, p AS (SELECT x.c AS c1, y.c AS c2, {_DIST} AS m FROM emb x, emb y WHERE x.c <> y.c)
SELECT c1 AS concept_id_1, c2 AS concept_id_2, round(m, {DIGITS}) AS metric, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY c1 ORDER BY round(m, 12), c2) AS rank FROM p) WHERE rank <= 10""")
def nearest_concepts(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(embeddings.nearest(_embedding(spark, sf), 10), "metric")


def _listed(spark: SparkSession, sf: str) -> DataFrame:
    """Ids with label 3, and one that has no vector."""
    ids = retail.embedding(spark, sf).where("label = 3").select(F.col("standard_concept_id").alias("concept_id"))
    return ids.unionByName(spark.range(-1, 0).withColumnRenamed("id", "concept_id"))


def _distances_among(spark: SparkSession, sf: str, concepts: DataFrame) -> DataFrame:
    """Distances of listed concepts only: the vectors are restricted before pairs are made."""
    listed = concepts.select(F.col("concept_id").alias("standard_concept_id")).distinct()
    return embeddings.pairwise(embeddings.restrict(_embedding(spark, sf), listed), "euclidean")


_AMONG = f"WITH {EMB}, l AS (SELECT * FROM emb WHERE label = 3), p AS (SELECT x.c AS c1, y.c AS c2, {_DIST} AS m FROM l x, l y)"


@query(f"""{_AMONG} SELECT round(avg(m), {DIGITS}) AS mean, round(quantile_cont(m, 0.25), {DIGITS}) AS q25, round(quantile_cont(m, 0.5), {DIGITS}) AS median, round(quantile_cont(m, 0.75), {DIGITS}) AS q75,
(SELECT count(*) FROM l) AS num_of_concepts, CAST(1 AS BIGINT) AS num_of_missings FROM p""")
def avg_distance_stats(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(embeddings.statistics_among(_embedding(spark, sf), _listed(spark, sf)), "mean", "q25", "median", "q75")


@query(f"{_AMONG} SELECT c1 AS concept_id_1, c2 AS concept_id_2, round(m, {DIGITS}) AS metric FROM p WHERE c1 <> c2")
def distance_long_form(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(embeddings.among(_distances_among(spark, sf, _listed(spark, sf)), _listed(spark, sf), keep_same=False), "metric")


@query(f"{_AMONG} SELECT c1 AS concept_id_1, c2 AS concept_id_2, round(m, {DIGITS}) AS metric FROM p")
def distance_submatrix(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(embeddings.among(_distances_among(spark, sf, _listed(spark, sf)), _listed(spark, sf)), "metric")


@query(f"WITH {EMB} SELECT x.c AS concept_id_1, y.c AS concept_id_2, round({_DIST}, {DIGITS}) AS metric FROM emb x, emb y WHERE x.c = 3 AND y.c = 11")
def distance_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(embeddings.distance_between(_distances_among(spark, sf, spark.createDataFrame([(3,), (11,)], "concept_id long")), 3, 11), "metric")


@query(f"""WITH {EMB}, l AS (SELECT * FROM emb ORDER BY md5('0:' || c), c LIMIT 50), p AS (SELECT {_DIST} AS m FROM l x, l y)
SELECT round(avg(m), {DIGITS}) AS mean, round(quantile_cont(m, 0.25), {DIGITS}) AS q25, round(quantile_cont(m, 0.5), {DIGITS}) AS median, round(quantile_cont(m, 0.75), {DIGITS}) AS q75,
(SELECT count(*) FROM l) AS num_of_concepts, CAST(0 AS BIGINT) AS num_of_missings FROM p""")
def random_distance_stats(spark: SparkSession, sf: str) -> DataFrame:
    drawn = embeddings.random_concepts(_embedding(spark, sf), 50)
    return rounded(embeddings.statistics_among(_embedding(spark, sf), drawn), "mean", "q25", "median", "q75")


@query(f"""WITH {EMB}, {REF}, s AS (SELECT truth = 1 AS t, {_COS} > 0.05 AS y FROM ref JOIN emb x ON x.c = c1 JOIN emb y ON y.c = c2)
SELECT round(count_if(y AND t) / nullif(count_if(t), 0), {DIGITS}) AS recall, round(count_if(y AND t) / nullif(count_if(y), 0), {DIGITS}) AS precision FROM s""")
def recall_precision(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(embeddings.recall_precision(retail.labelled_pairs(spark, sf), _embedding(spark, sf), above=0.05), "recall", "precision")


@query(f"WITH {EMB}, {REF} SELECT c1 AS concept_id_1, c2 AS concept_id_2, truth AS ground_truth FROM ref WHERE c1 IN (SELECT c FROM emb WHERE label <> 1 AND c % 3 = 0) AND c2 IN (SELECT c FROM emb WHERE label <> 1 AND c % 3 = 0)")
def shared_vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    e = retail.embedding(spark, sf)
    shared = embeddings.shared_vocabulary([e, e.where("label <> 1"), e.where("standard_concept_id % 3 = 0")])
    return embeddings.restrict_pairs(retail.labelled_pairs(spark, sf), shared)


@query(f"""WITH {EMB}, u AS (SELECT label, i, max(v[i]) AS x FROM emb, range(1, 65) t(i) GROUP BY label, i)
SELECT CAST(label AS BIGINT) AS label, round(sum(x), {DIGITS}) AS total, round(max(x), {DIGITS}) AS top, CAST(count(*) AS INTEGER) AS n FROM u GROUP BY label""")
def max_pool(spark: SparkSession, sf: str) -> DataFrame:
    e = retail.embedding(spark, sf)
    pooled = embeddings.max_pool(e.select(F.col("label").cast("bigint").alias("label"), "standard_concept_id"), e.select("standard_concept_id", "vector"), "label")
    return rounded(pooled.select("label", F.aggregate("vector", F.lit(0.0), lambda s, x: s + x).alias("total"), F.array_max("vector").alias("top"), F.size("vector").alias("n")), "total", "top")


@query(f"""WITH {EMB} SELECT c AS standard_concept_id, s AS source, CAST(label AS VARCHAR) AS phenotype, p_name AS concept_name FROM emb JOIN part ON p_partkey = c, (VALUES ('a'), ('b')) t(s) WHERE label IN (1, 2)""")
def phenotype_union(spark: SparkSession, sf: str) -> DataFrame:
    e = retail.embedding(spark, sf)
    parts = [embeddings.tagged(e.select("standard_concept_id"), e.where(F.col("label") == k).select(F.col("standard_concept_id").alias("concept_id")), s, str(k)) for s in "ab" for k in (1, 2)]
    return embeddings.with_names(events.union(parts), retail.concepts(spark, sf)).select("standard_concept_id", "source", "phenotype", "concept_name")


@query(f"WITH {EMB} SELECT c AS standard_concept_id, round(v[1], {DIGITS}) + 0.0 AS x, round(v[2], {DIGITS}) + 0.0 AS y FROM emb WHERE v[1] > -0.1 AND v[1] < 0.1 AND v[2] > 0 AND v[2] < 0.2")
def bounding_box(spark: SparkSession, sf: str) -> DataFrame:
    points = _embedding(spark, sf).select("standard_concept_id", F.get("vector", F.lit(0)).alias("x"), F.get("vector", F.lit(1)).alias("y"))
    return rounded(embeddings.in_box(points, (-0.1, 0.1), (0.0, 0.2)), "x", "y")


@query(f"WITH {EMB} SELECT c AS standard_concept_id, round(sqrt(list_sum(list_transform(v, lambda z: z * z))), {DIGITS}) AS norm FROM emb")
def vector_norms(spark: SparkSession, sf: str) -> DataFrame:
    return _embedding(spark, sf).select("standard_concept_id", F.round(V.norm(F.col("vector")), DIGITS).alias("norm"))


@query(f"""WITH {EMB}, j AS (SELECT c, v, s, CAST(label AS VARCHAR) AS phenotype FROM emb, (VALUES ('a'), ('b')) t(s) WHERE label IN (1, 2))
SELECT c AS standard_concept_id, round(v[1], {DIGITS}) + 0.0 AS x, round(v[2], {DIGITS}) + 0.0 AS y, s AS source, phenotype, p_name AS concept_name FROM j JOIN part ON p_partkey = c""")
def plot_frame(spark: SparkSession, sf: str) -> DataFrame:
    """Two places of the vectors as coordinates, with what a plot shows of each point."""
    e = retail.embedding(spark, sf)
    points = e.select("standard_concept_id", F.get("vector", F.lit(0)).alias("x"), F.get("vector", F.lit(1)).alias("y"))
    parts = [embeddings.tagged(e.select("standard_concept_id"), e.where(F.col("label") == k).select(F.col("standard_concept_id").alias("concept_id")), s, str(k)) for s in "ab" for k in (1, 2)]
    return rounded(embeddings.plot_frame(points, events.union(parts), retail.concepts(spark, sf)), "x", "y")


@query()
def pca_projection(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(projection.pca(_embedding(spark, sf)), "x", "y")


@query()
def tsne_projection(spark: SparkSession, sf: str) -> DataFrame:
    return projection.tsne(_embedding(spark, sf), steps=200)


@query()
def glove_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    rows = jobs.patient_sequences(retail.domain_tables(spark, sf), START, END, by_visit=True)
    e = jobs.sequence_embeddings(rows, dimensions=8, sweeps=2)
    return e.select("standard_concept_id", files.vector_text(F.transform("vector", lambda x: F.round(x, 4))).alias("vector"))


# Alignment --------------------------------------------------------------------------------------------------------------

#: First visit sequences that are aligned with each other, as many as the reference takes.
_ALIGNED = 100


def _aligned(spark: SparkSession, sf: str, scoring: alignment.Scoring = alignment.Scoring()) -> DataFrame:
    rows = jobs.patient_sequences(retail.domain_tables(spark, sf), START, END, by_visit=True).select(F.col("patient_window").alias("visit"), F.col("concepts").alias("sequence"))
    return alignment.all_pairs(sequences.numbered(rows, "visit", _ALIGNED), scoring)


_SEQS = f"""s AS (SELECT CAST(row_number() OVER (ORDER BY v) - 1 AS INTEGER) AS k, q FROM (SELECT visit_occurrence_id AS v, list(standard_concept_id ORDER BY event_date, standard_concept_id) AS q FROM dev GROUP BY v HAVING count(*) > 1 ORDER BY v LIMIT {_ALIGNED}))"""


@query(f"""WITH RECURSIVE {EV}, {DEV}, {_SEQS}, p AS (SELECT x.k AS k1, y.k AS k2, x.q AS a, y.q AS b FROM s x JOIN s y ON x.k < y.k),
{_lcs("p", 100)}
SELECT k1 AS position_1, k2 AS position_2, round(2.0::DOUBLE * (len(a) + len(b) - 2 * coalesce(n, 0)) / (len(a) + len(b)), {DIGITS}) AS score FROM p LEFT JOIN lcs USING (k1, k2)""")
def patient_alignment(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_aligned(spark, sf).select("position_1", "position_2", "score"), "score").orderBy("score", "position_1", "position_2")


@query(f"""WITH {EV}, {DEV}, {_SEQS} SELECT x.k AS position_1, y.k AS position_2, 2.0::DOUBLE AS score FROM s x JOIN s y ON x.k < y.k""")
def patient_alignment_by_similarity(spark: SparkSession, sf: str) -> DataFrame:
    """The largest score: gaps are worth one each and any two steps side by side at most two, so all of it is gaps."""
    return _aligned(spark, sf, alignment.Scoring(similarity=True)).select("position_1", "position_2", "score")


@query(f"""WITH {EV}, {DEV}, {_SEQS}, p AS (SELECT x.k AS k1, y.k AS k2, x.q AS a, y.q AS b FROM s x JOIN s y ON x.k < y.k)
SELECT k1 AS position_1, k2 AS position_2, round(2.0::DOUBLE * (abs(len(a) - len(b)) + 0.25 * least(len(a), len(b))) / (len(a) + len(b)), {DIGITS}) AS score FROM p""")
def patient_alignment_with_costs(spark: SparkSession, sf: str) -> DataFrame:
    """With a matrix that makes any two steps cost a quarter, the shorter sequence is set beside the longer one."""
    rows = jobs.patient_sequences(retail.domain_tables(spark, sf), START, END, by_visit=True).select(F.col("patient_window").alias("visit"), F.col("concepts").alias("sequence"))
    first = sequences.numbered(rows, "visit", _ALIGNED)
    one, two = (first.select(F.col("position").alias(f"position_{k}"), F.col("sequence").alias(f"sequence_{k}")) for k in (1, 2))
    pairs = one.join(two, F.col("position_1") < F.col("position_2"))
    costs = F.transform("sequence_1", lambda _: F.transform("sequence_2", lambda _: F.lit(0.25)))
    return rounded(alignment.align_pairs(pairs.withColumn("costs", costs), costs="costs").select("position_1", "position_2", "score"), "score")


@query()
def alignment_steps(spark: SparkSession, sf: str) -> DataFrame:
    return alignment.steps_of(_aligned(spark, sf), "position_1", "position_2")


@query()
def alignment_matches(spark: SparkSession, sf: str) -> DataFrame:
    return alignment.matched_frequency(_aligned(spark, sf)).orderBy(F.desc("count"), "concept_id")


@query()
def alignment_names(spark: SparkSession, sf: str) -> DataFrame:
    return alignment.name_steps(alignment_steps(spark, sf), retail.concepts(spark, sf))
