"""The registered queries of this subpackage: each operator with its production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forecourt.llm import (
    byte_bpe,
    conversation_trie,
    exact_dedup,
    html_text,
    jaccard_join,
    lexical_search,
    line_dedup,
    packing,
    pii,
    quality,
    simhash,
    token_counts,
    url_lists,
)
from forecourt.llm.frames import text_of

Query = Callable[[SparkSession, str], DataFrame]


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def pages(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/pages.parquet")


def op1_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(documents(spark, folder))


def op2_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.digests(pii.find_personal_data(documents(spark, folder)))


def op3_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, folder), shingle_words=3, max_bits=2)


def op4_html_text(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.extract_pages(pages(spark, folder))


def op5_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.count_pieces(documents(spark, folder))


def capture_log(pages: DataFrame) -> DataFrame:
    """The pages as captures: page n was fetched on day n % 366 of 2024."""
    return pages.select(
        "page_id", "url", F.expr("date_add(date'2024-01-01', cast(page_id % 366 as int))").alias("fetched_on")
    )


def change_log(pages: DataFrame) -> DataFrame:
    """A list derived from the pages' own hosts.

    By the MD5 of its name, a quarter of the registered domains is added on some day, a third of these removed 40 days
    later and half of those added again after another 60; a fifth of the hosts has its /de/ pages listed.
    """
    hosts = pages.select(url_lists.host_of(F.col("url")).alias("host")).where("host <> ''").distinct()
    names = hosts.select(F.substring_index("host", ".", -3).alias("entry")).distinct()
    number = F.conv(F.substring(F.md5("entry"), 1, 8), 16, 10).cast("bigint")
    domains = names.select("entry", number.alias("n")).where("n % 4 = 0")
    prefixes = hosts.select(F.concat("host", F.lit("/de/")).alias("entry"))
    prefixes = prefixes.select("entry", number.alias("n")).where("n % 5 = 0")
    added = domains.unionByName(prefixes).withColumn(
        "day", F.expr("date_add(date'2024-01-01', cast((n div 16) % 200 as int))")
    )
    removed = added.where("(n div 4) % 3 = 0").withColumn("day", F.date_add("day", 40))
    again = removed.where("(n div 12) % 2 = 0").withColumn("day", F.date_add("day", 60))
    parts = [(added, "add"), (removed, "remove"), (again, "add")]
    logs = [part.select("entry", F.lit(action).alias("action"), "day") for part, action in parts]
    return logs[0].unionByName(logs[1]).unionByName(logs[2])


def op6_url_lists(spark: SparkSession, folder: str) -> DataFrame:
    crawl = pages(spark, folder)
    return url_lists.filter_captures(capture_log(crawl), change_log(crawl))


def op7_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.remove_site_lines(documents(spark, folder)).drop("row")


def op8_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.judge(documents(spark, folder)).drop("row", "removed")


def op9_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    text = text_of("text")
    # The digest of every text; rows equal in id and text share one.
    texts = docs.select(
        F.col("doc_id").alias("id"),
        F.octet_length(text).cast("bigint").alias("bytes"),
        F.xxhash64(F.substring(text, 1, exact_dedup.PREFIX_CHARS)).alias("prefix"),
        F.sha2(text, 256).alias("text_sha256"),
    ).distinct()
    groups = exact_dedup.duplicate_groups(docs)
    mine = (
        F.col("doc_id").eqNullSafe(F.col("id"))
        & (F.col("n_bytes") == F.col("bytes"))
        & (F.col("prefix_hash") == F.col("prefix"))
        & F.coalesce(F.col("full_hash") == F.col("text_sha256"), F.lit(True))
    )
    return groups.join(texts, mine).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op10_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return byte_bpe.digests(byte_bpe.encode_documents(documents(spark, folder), decoded=True))


def op11_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join.linked_documents(documents(spark, folder), shingle_words=3, percent=90)


def op12_conversation_trie(spark: SparkSession, folder: str) -> DataFrame:
    return conversation_trie.conversation_trie(spark.read.parquet(f"{folder}/conversations.parquet"), branch=True)


def op13_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    items = spark.read.parquet(f"{folder}/benchmark.parquet")
    return lexical_search.search_documents(documents(spark, folder), items, k=10)


def queries() -> dict[str, Query]:
    every = (
        op1_packing,
        op2_pii,
        op3_simhash,
        op4_html_text,
        op5_token_counts,
        op6_url_lists,
        op7_line_dedup,
        op8_quality,
        op9_exact_dedup,
        op10_byte_bpe,
        op11_jaccard_join,
        op12_conversation_trie,
        op13_ranked_search,
    )
    return {f.__name__: f for f in every}
