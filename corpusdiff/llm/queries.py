"""The registered queries of this folder: each applies one operator with production parameters to its whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusdiff.llm.centroids import clusters
from corpusdiff.llm.common import read_table, stored, trained_on
from corpusdiff.llm.context_mixing import score
from corpusdiff.llm.langid_hd import identify
from corpusdiff.llm.mixing import mix
from corpusdiff.llm.nn_descent import near_duplicates
from corpusdiff.llm.packing import pack
from corpusdiff.llm.piece_rounds import decode, encode, ids_text
from corpusdiff.llm.quality_cascade import quality_rules
from corpusdiff.llm.secret_formats import KINDS, secret_spans, spans_text
from corpusdiff.llm.simhash_gray import hex_digits, simhash_components
from corpusdiff.llm.token_counts import token_counts
from corpusdiff.llm.variants import variants
from corpusdiff.llm.warc import crawl_records, id_of, read_archive, write_archive
from corpusdiff.session import pin


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("learn", trained_on(F.col("doc_id"), 1))
    return score(docs, "learn").select(
        "doc_id", (~F.col("learn")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes", "bits_per_byte"
    )


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    learned = trained_on(F.col("doc_id"), 0)
    found = identify(docs.select("doc_id", "text"), docs.filter(learned).select("text", "lang"))
    return found.select("doc_id", (~learned).alias("held_out"), "lang_pred", "score")


#: Token shares wanted by domain: quality and toxicity as in the labelled table.
TARGETS = {"q1t0": 0.85, "q0t0": 0.10, "q1t1": 0.04, "q0t1": 0.01}


def labelled_domains(spark: SparkSession, sf_dir: str, docs: DataFrame, examples: int = 6000) -> DataFrame:
    """Texts of ``docs`` with the domain that the labelled table gives them: ``examples`` rows of those that have one, by the smallest hashes.

    The rows are chosen by id alone; only then are texts read, by a broadcast of at most ``examples`` ids. Of repeated ids the smallest text is taken.
    """
    labels = read_table(spark, sf_dir, "labels")
    domain = F.concat(F.lit("q"), F.col("quality").cast("string"), F.lit("t"), F.col("toxic").cast("string"))
    known = labels.select("doc_id", domain.alias("domain")).filter("domain IS NOT NULL").join(docs.select("doc_id"), "doc_id", "left_semi")
    chosen = stored(known.distinct().orderBy(F.xxhash64("doc_id", "domain"), "doc_id", "domain").limit(examples), "labels")
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return texts.groupBy("doc_id", "domain").agg(F.min("text").alias("text")).select("text", "domain")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    mixed = mix(docs, labelled_domains(spark, sf_dir, docs), TARGETS)
    return mixed.select("doc_id", "n_tokens", "posterior", "rate")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = write_archive(crawl_records(read_table(spark, sf_dir, "pages"), min_bytes=0))
    records = read_archive(spark, path, payload="false", verify="true").filter(F.col("record_type").isin("response", "revisit"))
    return records.select(
        id_of(F.col("record_id")).alias("page_id"), "payload_bytes", F.substring_index("payload_digest", ":", -1).alias("payload_digest"),
        "record_type", id_of(F.col("refers_to")).alias("refers_to"),
    )


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    spans = pin(secret_spans(docs).drop("text"))

    def of_kind(*kinds: str) -> Column:
        return F.filter("spans", lambda s: s["kind"].isin(*kinds))

    base = of_kind(*KINDS)
    return spans.select(
        "doc_id", *(F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in KINDS), F.sha2(spans_text(base), 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans")
    )


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read_table(spark, sf_dir, "documents"), fields=("source", "text"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "embeddings"), threshold=0.98)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(read_table(spark, sf_dir, "documents"), least_length=5, least_count=3, ratio=2)


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = decode(encode(docs).drop("text"))
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids_text(F.col("ids")), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = clusters(read_table(spark, sf_dir, "embeddings"), k=16, rounds=3, size=64, scale=64, seed="1")
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


LLM_QUERIES = {
    "op1_lm_scoring": op1_lm_scoring,
    "op2_language_id": op2_language_id,
    "op3_mixing": op3_mixing,
    "op4_warc": op4_warc,
    "op5_simhash": op5_simhash,
    "op6_secret_scan": op6_secret_scan,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_token_counts": op8_token_counts,
    "op9_quality_rules": op9_quality_rules,
    "op10_embedding_dedup": op10_embedding_dedup,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_sentencepiece": op12_sentencepiece,
    "op13_centroid_clustering": op13_centroid_clustering,
}
