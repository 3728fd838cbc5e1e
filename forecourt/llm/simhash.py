"""SimHash near-duplicates with pigeonring filtering.

A 64-bit fingerprint is read as a ring of `segments` equal parts.  If two fingerprints differ in at most `max_bits`
bits, some start on the ring has the property that every chain of consecutive parts from there, of any length L, has at
most L * max_bits / segments differing bits.  Budgets below 1 mean equality, so the first parts of a chain are an
equi-join key; the longer chains are tested inside the join, before the full Hamming distance.

A key that more than `BUCKET_LIMIT` fingerprints share is not joined: its fingerprints are linked exactly by midpoints.
Two fingerprints differ in at most 2r bits if and only if some value lies within r bits of both, so each fingerprint
gives the values within r bits of it, and all fingerprints that gave one value are linked to the smallest of them.
A value has a fixed number of such neighbours (65 for r = 1), so the work is linear and no group can grow.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forecourt.functions.joins import lookup
from forecourt.llm.components import connected
from forecourt.llm.frames import col, pin, text_of, whole_row

BITS = 64
SEED = 42
# From here on the 65 midpoints of a fingerprint are fewer than its partners in the bucket.
BUCKET_LIMIT = 65
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def fingerprint(text: str, shingle_words: int = 3) -> int:
    """Unsigned SimHash over word shingles, repeats included; zero for a text without words.

    Letters A-Z are lowered first.  A text of fewer words is one shingle.  A bit is set if over half the shingles set it.
    """
    # bytes.split cuts at exactly the six ASCII white-space characters.
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle_words:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        starts = [0]
        for word in words:
            starts.append(starts[-1] + len(word) + 1)
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[i : j - 1], SEED) for i, j in zip(starts, starts[shingle_words:])]
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):  # so that a very long text needs little memory
        block = np.array(hashes[at : at + (1 << 16)], dtype=">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def fingerprint_column(text: Column, shingle_words: int = 3) -> Column:
    """The fingerprint as a signed 64-bit integer."""

    @F.pandas_udf("bigint")
    def compute(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            prints = np.array([fingerprint(t, shingle_words) for t in texts], dtype=np.uint64)
            yield pd.Series(prints.view(np.int64))

    return compute(text)


def _rotated(value: Column, by: int) -> Column:
    return F.shiftleft(value, by).bitwiseOR(F.shiftrightunsigned(value, BITS - by)) if by else value


def _crowded_links(prints: DataFrame, radius: int) -> DataFrame:
    """a, b: each fingerprint with the smallest one that shares a midpoint with it."""
    flips = [sum(1 << i for i in chosen) for n in range(radius + 1) for chosen in combinations(range(BITS), n)]
    masks = F.array(*[F.lit(m - (1 << BITS) if m >> (BITS - 1) else m) for m in flips])
    middles = prints.select("fp", F.explode(F.transform(masks, lambda m: F.col("fp").bitwiseXOR(m))).alias("middle"))
    stars = middles.groupBy("middle").agg(F.collect_set("fp").alias("fps"))
    return (
        stars.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a <> b").distinct()
    )


def link_fingerprints(
    prints: DataFrame, max_bits: int = 2, segments: int = 8, bucket_limit: int = BUCKET_LIMIT
) -> DataFrame:
    """a, b: links whose transitive closure is that of "at most `max_bits` differing bits".

    `prints` has distinct signed 64-bit integers in `fp`.  `max_bits` is even; `segments` divides 64 and is larger.
    More segments give longer keys and more of them: 8 give keys of 24 bits, 16 of 28 bits for larger corpora.
    """
    if max_bits % 2 or max_bits < 2 or BITS % segments or segments <= max_bits:
        raise ValueError("max_bits must be even and positive, segments a larger divisor of 64")
    width = BITS // segments
    budget = {n: n * max_bits // segments for n in range(1, segments + 1)}
    key_bits = width * max(n for n, most in budget.items() if most == 0)

    starts = F.array(
        *[F.struct(F.lit(i).alias("start"), _rotated(F.col("fp"), i * width).alias("ring")) for i in range(segments)]
    )
    index = prints.select("fp", F.inline(starts)).withColumn(
        "key", F.shiftrightunsigned("ring", BITS - key_bits)
    )
    sizes = index.groupBy("start", "key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = pin(lookup(index, sizes, ["start", "key"], "fp", how="inner"))

    small = members.where(F.col("size") <= bucket_limit).drop("size")
    left = small.select("start", "key", F.col("ring").alias("ring_a"), F.col("fp").alias("a"))
    right = small.select("start", "key", F.col("ring").alias("ring_b"), F.col("fp").alias("b"))
    differing = F.col("ring_a").bitwiseXOR(F.col("ring_b"))
    viable = F.col("a") < F.col("b")
    for n in range(1, segments + 1):
        if n * width > key_bits:
            viable = viable & (F.bit_count(F.shiftrightunsigned(differing, BITS - n * width)) <= budget[n])
    on_key = (left["start"] == right["start"]) & (left["key"] == right["key"])
    pairs = left.join(right, on_key & viable).select("a", "b").distinct()

    crowded = members.where(F.col("size") > bucket_limit).select("fp").distinct()
    return pairs.unionByName(_crowded_links(crowded, max_bits // 2)).distinct()


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle_words: int = 3,
    max_bits: int = 2,
    segments: int = 8,
    bucket_limit: int = BUCKET_LIMIT,
) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id linked directly or through others).

    One row per row of `docs`; other columns are not read.  NULL and word-less texts have fingerprint zero and are
    linked like any other.  A NULL id is never a component's smallest unless the component has no other.  Repeated rows
    are linked to each other.  An empty table gives no rows.
    """
    prints = pin(
        docs.select(
            col(id_col).alias("doc_id"), fingerprint_column(text_of(text_col), shingle_words).alias("fp")
        )
    )
    distinct = pin(prints.groupBy("fp").agg(F.min("doc_id").alias("lowest")))
    classed = _with_roots(distinct, max_bits, segments, bucket_limit)
    lowest = classed.groupBy("root").agg(F.min("lowest").alias("component_id"))
    named = lookup(classed.drop("lowest"), lowest, "root", "fp", how="inner").select("fp", "component_id")
    return lookup(prints, named, "fp", "doc_id", how="inner").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def _with_roots(distinct: DataFrame, max_bits: int, segments: int, bucket_limit: int) -> DataFrame:
    """`distinct` (one row per `fp`) with the root of its component."""
    links = pin(link_fingerprints(distinct.select("fp"), max_bits, segments, bucket_limit))
    roots = connected(links).withColumnRenamed("vertex", "fp")
    return distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def drop_near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle_words: int = 3,
    max_bits: int = 2,
    segments: int = 8,
    bucket_limit: int = BUCKET_LIMIT,
) -> DataFrame:
    """One document of each component, all columns: the one with the smallest id, a NULL id last.

    Rows that share that id are told apart by fingerprint and a 128-bit hash of id and text; of rows equal in both one
    stays.
    """
    text = text_of(text_col)
    key = [F.xxhash64(col(id_col), text).alias("key"), F.xxhash64(text, F.lit(1), col(id_col)).alias("other")]
    prints = pin(docs.select(col(id_col).alias("doc_id"), fingerprint_column(text, shingle_words).alias("fp"), *key))
    first = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "fp", "key", "other")
    distinct = pin(prints.groupBy("fp").agg(F.min(first).alias("first")))
    best = _with_roots(distinct, max_bits, segments, bucket_limit).groupBy("root").agg(F.min("first").alias("first"))
    stays = best.select(F.col("first.key").alias("key"), F.col("first.other").alias("other"))
    left = docs.select(whole_row(docs).alias("row"), *key).join(stays, ["key", "other"], "left_semi")
    # Equal rows lie in one partition already.
    return left.groupBy("key", "other").agg(F.first("row").alias("row")).select("row.*")
