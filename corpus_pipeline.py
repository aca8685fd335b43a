"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again as the documents of the next.

Rows with nulls, empty or very long texts, repeated rows and clashing ids go through every stage; an empty table stays empty. All stages but the last return
the columns of ``documents`` (columns that are not among these are dropped first), with these effects:

1. ``language_id``: a document without letters, or with a null text, goes. A missing ``lang`` is filled with the predicted language.
2. ``near_duplicates``: of each group of texts with distinct five-word shingles of a Jaccard similarity of 0.8 or more the document with the smallest id stays (of equal ids the one read first; null ids come last).
3. ``secret_scan``: secrets in the text are replaced by ``[SECRET]``; ``n_chars`` follows. No document goes.
4. ``mixing``: a document is used as often as its rate says: dropped, kept or repeated. The targets follow from the stage's own documents: the clean domain keeps its expected tokens, the others
   get a share of theirs. A document that is most likely clean is never dropped.
5. ``packing``: the token sequences, one row per piece.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusdiff.llm.common import discard, maybe_among, read_table, stored, trained_on
from corpusdiff.llm.langid_hd import UNKNOWN, identify
from corpusdiff.llm.mixing import copies, mix
from corpusdiff.llm.packing import pack
from corpusdiff.llm.queries import labelled_domains
from corpusdiff.llm.secret_formats import mask, secret_spans
from corpusdiff.llm.simhash_gray import similar_components
from corpusdiff.session import pin, ship_package

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
CLEAN = "q1t0"
#: How much of the expected tokens of the other domains the mixture is to have.
SHARES = {"q0t0": 0.5, "q1t1": 0.5, "q0t1": 0.25}


def wanted(tokens: dict[str, float]) -> dict[str, float]:
    """Tokens by domain that the mixture is to have, from those that there are."""
    return {name: n * SHARES.get(name, 1.0) for name, n in tokens.items()}


def numbered(docs: DataFrame) -> DataFrame:
    """The columns of ``documents`` with a lasting name ``row_`` for every row: its file and place there, so that no text is written again. Rows that come from no file are written first."""
    try:
        return docs.select(*COLUMNS, F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at")).alias("row_"))
    except AnalysisException:
        return numbered(stored(docs.select(*COLUMNS), "numbered"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    learned = docs.filter(trained_on(F.col("doc_id"), 0)).select("text", "lang")
    found = pin(identify(docs.select(*COLUMNS), learned))
    kept = found.filter(F.col("lang_pred") != UNKNOWN)
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    rows = numbered(docs)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_")
    groups = similar_components(rows.withColumn("order_", order), id_col="order_")
    gone = stored(groups.filter(F.col("order_") != F.col("component_id")).select(F.col("order_.row_").alias("row_")), "gone")
    marked = maybe_among(rows, F.col("row_"), gone, "maybe_")
    held = marked.filter("maybe_").join(gone, "row_", "left_anti")  # only rows that may go are shuffled
    return marked.filter("NOT maybe_").select(*COLUMNS).unionByName(held.select(*COLUMNS))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    found = pin(secret_spans(docs.select(*COLUMNS)))
    masked = pin(found.withColumn("text", mask(F.col("text"), F.col("spans"))))
    size = F.when(F.size("spans") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return masked.withColumn("n_chars", size).select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    mixed = mix(docs.select(*COLUMNS), labelled_domains(spark, sf_dir, docs), wanted)
    least = F.when(F.col("likely_domain") == CLEAN, 1).otherwise(0)
    times = pin(mixed.withColumn("times_", F.greatest(least, copies(F.col("rate"), "doc_id", "text")))).filter("times_ > 0")
    return times.withColumn("again_", F.explode(F.array_repeat(F.lit(1), F.col("times_")))).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("secret_scan", secret_scan),
    ("mixing", mixing),
    ("packing", packing),
]
#: SQL cannot express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES[:-1]):
        docs, last = stored(stage(spark, docs, sf_dir), name), docs
        if number:
            discard(last)
    return STAGES[-1][1](spark, docs, sf_dir)
