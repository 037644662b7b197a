"""The operators bound to the test tables, one query each."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, html_text, importance, jaccard, language, leaks, link_trust, pieces, ranking, rules, secrets, sql, token_files, wordpieces

PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
#: Rules of the url filter, as given.
URL_RULES = (
    link_trust.Rule("block", "net", "/"),
    link_trust.Rule("allow", "example.net", "/en/"),
    link_trust.Rule("block", "example.com", "/de/"),
    link_trust.Rule("allow", "org", "/fr/"),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document: counts and digest of the base kinds, all spans as text."""
    found = secrets.secret_spans(table(spark, sf_dir, "documents"))

    def text(s):
        return F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")

    base = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))
    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(F.array_join(F.transform(base, text), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", text), ",").alias("spans"),
    )


def op2_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log weight of every document against labelled good ones, and whether the sample keeps it.

    The sample is as large as the share of good ones among the labelled documents.
    """
    docs = table(spark, sf_dir, "documents")
    good, share = importance.target_ids(table(spark, sf_dir, "labels"), (F.col("quality") == 1) & (F.col("toxic") == 0))
    weights = importance.ngram_weights(docs, good, "doc_id", "text")
    return importance.resample(importance.weigh(docs, weights), share)


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of every document's shingle set and its group of documents connected by similarity."""
    return jaccard.similar_groups(table(spark, sf_dir, "documents"))


def op4_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document by the byte model and by the word model, both learned from the training documents."""
    return language.score(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the quality rules, content share and verdict for every document."""
    docs = table(spark, sf_dir, "documents")
    return rules.judge(docs, rules.fit_rules(docs, table(spark, sf_dir, "labels")))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_text.extract_text(table(spark, sf_dir, "pages"))


def op7_word_piece_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, word pieces and unknown words of every document."""
    return wordpieces.count_word_pieces(table(spark, sf_dir, "documents"), PIECES)


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and digest of every document's ids, digest of the text decoded from them."""
    coded = pieces.encode_pieces(table(spark, sf_dir, "documents"), PIECES)
    return coded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, number and checksum of every document's ids as read back from the token files."""
    return token_files.token_checksums(token_files.write_token_files(table(spark, sf_dir, "documents"), BYTES))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that each document leaks."""
    return leaks.leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of every document's tokens by two tokenizers, weighed by counts over all documents."""
    return alignment.align_tokenizers(table(spark, sf_dir, "documents"), BYTES, PIECES)


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and verdict for the url of every page."""
    return link_trust.judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 documents that score highest for every benchmark item."""
    return ranking.search(ranking.build_index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_secret_scan,
        op2_importance_resampling,
        op3_jaccard_join,
        op4_language_model,
        op5_quality_rules,
        op6_html_text,
        op7_word_piece_counts,
        op8_sentencepiece,
        op9_token_files,
        op10_decontamination,
        op11_tokenizer_alignment,
        op12_url_filter,
        op13_ranked_search,
    )
}
SQL: dict[str, str] = {"op3_jaccard_join": sql.JACCARD, "op12_url_filter": sql.URL_FILTER, "op13_ranked_search": sql.RANKED_SEARCH}
