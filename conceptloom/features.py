"""Feature annotators: tables of concept pairs in, the same rows with more columns out."""

from __future__ import annotations

from abc import ABC, abstractmethod
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from conceptloom.functions import lexical
from conceptloom.operators import embeddings, information, ontology


class Feature(ABC):
    """A named annotator and the columns that it adds."""

    def __init__(self, name: str, headers: tuple[str, ...] = ()):
        self.name, self.headers = name, headers

    @property
    def column(self) -> str:
        return self.name.lower().replace(" ", "_")

    def description(self) -> str:
        return f"{self.name}: {', '.join(self.headers)}"

    @abstractmethod
    def annotate(self, pairs: DataFrame) -> DataFrame: ...


class LexicalSimilarity(Feature):
    """Similarities of the two names, by default under the columns of the training pipeline."""

    NAMES = ("distance", "ratio", "jaro", "jaro_wrinkler", "fuzz_partial_ratio")
    STANDARD = ("Levenshtein_distance", "Levenshtein_ratio", "jaro", "jaro_winkler", "fuzz_partial_ratio")

    def __init__(self, name: str = "lexical", columns: tuple[str, str] = ("concept_name_1", "concept_name_2"), headers: tuple[str, ...] = NAMES):
        super().__init__(name, headers)
        self.columns = columns

    def annotate(self, pairs: DataFrame) -> DataFrame:
        a, b = (F.col(c).cast("string") for c in self.columns)
        both = pairs.withColumn("_similarities", lexical.similarities(a, b))
        of = lambda n: F.col("_similarities")[n]
        scores = (lexical.distance(a, b), lexical.ratio(a, b), of("jaro"), of("jaro_winkler"), of("partial_ratio"))
        return both.withColumns(dict(zip(self.headers, scores, strict=True))).drop("_similarities")


class Cooccurrence(Feature):
    """The normalised co-occurrence of the pair; null if it never occurs."""

    def __init__(self, name: str, matrix: DataFrame):
        super().__init__(name, (name.replace(" ", "_"),))
        self.matrix = matrix

    def annotate(self, pairs: DataFrame) -> DataFrame:
        of = self.matrix.select(F.col("standard_concept_id_1").alias("concept_id_1"), F.col("standard_concept_id_2").alias("concept_id_2"), F.col("normalized_count").alias(self.headers[0]))
        return pairs.drop(self.headers[0]).join(of, ontology.PAIR, "left")


class SemanticSimilarity(Feature):
    def __init__(self, name: str, closure: DataFrame):
        super().__init__(name, (name.lower().replace(" ", "_"), "is_connected"))
        self.closure = closure

    def annotate(self, pairs: DataFrame) -> DataFrame:
        return ontology.semantic_similarity(pairs, self.closure, self.column)


class MinDistance(Feature):
    def __init__(self, name: str, closure: DataFrame):
        super().__init__(name, (name.lower().replace(" ", "_"),))
        self.closure = closure

    def annotate(self, pairs: DataFrame) -> DataFrame:
        return ontology.min_distance(pairs, self.closure, self.column)


class InformationContent(Feature):
    def __init__(self, name: str, content: DataFrame, closure: DataFrame, bag_union: bool = False, standard: bool = False):
        super().__init__(name, information.MEASURES)
        self.content, self.closure, self.options = content, closure, {"bag_union": bag_union, "standard": standard}

    def annotate(self, pairs: DataFrame) -> DataFrame:
        return information.measures(pairs, self.content, self.closure, **self.options)


class Embedding(Feature):
    """The cosine of the pair's vectors. With a vocabulary the weights hold target and context vectors, else final ones."""

    def __init__(self, name: str, weights: DataFrame, vocabulary: DataFrame | None = None):
        super().__init__(name, (name.lower().replace(" ", "_") + "_cosine",))
        self.vectors = weights if vocabulary is None else embeddings.target_context_mean(vocabulary, weights)

    def annotate(self, pairs: DataFrame) -> DataFrame:
        return embeddings.cosine_of_pairs(pairs, self.vectors, self.headers[0])


# What missing features become, by the names of the training pipeline.
DEFAULTS: dict[str, float] = {
    "min_distance": -1,
    "risk_ratio": 0,
    "risk_diff": 0,
    "distance": 0,
    "ratio": 0,
    "jaro": 0,
    "jaro_wrinkler": 0,
    "fuzz_partial_ratio": 0,
    "cooccurrence_lifetime": 0,
    "cooccurrence_5_year": 0,
    "cooccurrence_visit": 0,
    "lifetime_cooccur_embedding_cosine": 0,
    "5_year_cooccur_embedding_cosine": 0,
    "visit_cooccur_embedding_cosine": 0,
    "semantic_similarity": 0,
    "mica_information_content": 0,
    "lin_measure": 0,
    "jiang_measure": 0,
    "relevance_measure": 0,
    "information_coefficient": 0,
    "graph_ic_measure": 0,
}
# Names of other annotators here.
DEFAULTS |= {"is_connected": 0, "glove_cosine": 0, "mce_cosine": 0}


def fill_defaults(rows: DataFrame, defaults: dict[str, float] | None = None, also: tuple[str, ...] = ()) -> DataFrame:
    """Nulls of known columns become their default; columns that a table does not have are passed over."""
    wanted = (DEFAULTS if defaults is None else defaults) | dict.fromkeys(also, 0)
    return rows.fillna({c: v for c, v in wanted.items() if c in rows.columns})


def run(pairs: DataFrame, features: list[Feature]) -> DataFrame:
    """All annotators in turn, as one plan."""
    return reduce(lambda rows, f: f.annotate(rows), features, pairs)
