"""Documents in five stages, from raw rows to packed sequences."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.llm import language, mixing, near_duplicates, quality_model, vector_packing
from starloom.llm.queries import WORDS, labelled_languages, packed_digest, present, remainder, table
from starloom.session import configure, materialize

# A posterior of languages, and the mean logarithm by which an n-gram is likelier in the language than
# by chance. Learned languages lie above 3, letters at random and unknown scripts below 0.
LEAST_LANGUAGE_SCORE, LEAST_LANGUAGE_EVIDENCE = 0.5, 1.5
# Target shares of the mix; with every document kept, the others are repeated up to them.
WEIGHTS = {"en": 0.50, "de": 0.18, "es": 0.14, "fr": 0.18}

# Near duplicates share this part of their runs in percent. Bands of six values let a pair at 0.80
# share none of the 48 with probability (1 - 0.80^6)^48 < 5e-7.
SIMILAR_PERCENT, PER_BAND = 80, 6


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which the language can be told, and that look like text of that language."""
    model = language.fit(docs.where(remainder("doc_id", 3) != 1), "text", "lang", "doc_id")
    judged = language.predict(docs, model, "text", evidence=True)
    known = (F.col("lang_pred") != language.UNDETERMINED) & (F.col("score") >= LEAST_LANGUAGE_SCORE)
    return judged.where(known & (F.col("evidence") >= LEAST_LANGUAGE_EVIDENCE)).select(*docs.columns)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    model = quality_model.fit(docs, labels.where(remainder("doc_id", 5) != 0), "text", "quality", "doc_id")
    return quality_model.predict(docs, model, "text").where(F.col("predicted") == 1).select(*docs.columns)


def with_document(docs: DataFrame) -> DataFrame:
    """Add ``_document``, a 64-bit hash of id and text: rows that repeat both are one document."""
    return docs.withColumn("_document", F.xxhash64("doc_id", "text"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id.

    Rows that repeat id and text are one document and come out once. Different texts of one id are
    documents of their own. Rows with a null id are in no group and stay as they are.
    """
    named = with_document(docs.where(F.col("doc_id").isNotNull()))
    found = near_duplicates.find(named, "_document", "text", SIMILAR_PERCENT, PER_BAND, also=["doc_id"])
    first = found.groupBy("id_tomado").agg(F.min(F.struct("doc_id", "_document")).alias("first")).select("first._document")
    # Repeated rows go before the shuffle, which serves the join as well.
    kept = named.dropDuplicates(["_document"]).join(first, "_document", "left_semi").select(*docs.columns)
    return kept.unionByName(docs.where(F.col("doc_id").isNull()))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row at least once, and as often as the language weights ask for; rows that repeat id and text each alike."""
    labelled = labelled_languages(docs, table(spark, sf_dir, "labels")).distinct()
    model = mixing.fit(docs, labelled, "text", "lang", "doc_id")
    named = with_document(docs)
    mixed = mixing.mix(named, model, present(WEIGHTS, model), "doc_id", "text", keep_all=True, also=["_document"])
    more = mixed.where(F.col("copies") > 1).groupBy("_document").agg(F.max("copies").alias("copies"))
    copies = F.explode(F.sequence(F.lit(1), F.coalesce("copies", F.lit(1))))
    return named.join(more, "_document", "left").withColumn("_copy", copies).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of packed sequences."""
    return packed_digest(vector_packing.pack(docs, WORDS, "doc_id", "text"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language_stage),
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

# The whole is not expressible in SQL. The tests hold near duplicates and mixing against planted rows; of the
# other stages they check columns, kept rows, whole documents and the token limit only.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder, each one's rows written and read again."""
    configure(spark)
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
