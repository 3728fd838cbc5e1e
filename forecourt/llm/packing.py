"""Lexical retrieval packing: windows of tokens filled with documents that are lexically close.

Documents are encoded and cut into whole windows and a tail shorter than a window.  Tails are put into a lexical order by
a range shuffle, and each range is cut into shards of exactly bounded size, so that lexically close tails share a shard;
nothing about shards is ever collected.  Each shard builds a BM25 inverted index over the token ids of its tails, with the document frequencies and mean length of the whole corpus;
every unused tail in turn is a seed, its best-scoring unused neighbours fill the rest of the window, and the last one
is cut where the window ends.  So only a shard's last window can be short.

The order: a tail's BM25 weights are projected on `DIMS` fixed random directions.  A tree of splits along principal
directions, learned from a bounded sample of these vectors, gives each tail a leaf; inside a leaf, tails are ordered by
the signs of their offsets from its mean, then by row.  The sample decides only where the splits lie.

A seed queries its own shard, not the others: that would be work in the square of the corpus.  The number of shards
grows with the corpus and a shard with nothing: what a task holds is one shard.
"""

from __future__ import annotations

import base64
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forecourt.llm.frames import col, pin, text_of

# The rank file with the ids of the tokenizers file byte_bpe_50k.json, and the one token that only the latter adds; it
# finds that inside a text, too.
VOCABULARY = "byte_bpe_50k.tiktoken"
ADDED_TOKENS = {"<|endoftext|>": 50256}
WINDOW = 1024
SEPARATOR = 0
DOCS_PER_SHARD = 1024
K1, B = 1.2, 0.75
# Of the lexical order: directions, rows of the table of directions, vectors the tree is learned from, and of a leaf.
DIMS = 128
DIRECTIONS = 1 << 16
SAMPLE = 8192
LEAF = 16
# Shards of one range are numbered in so many bits.
SHARD_BITS = 13


@lru_cache(maxsize=2)
def encoding(path: str) -> tiktoken.Encoding:
    """One per Python worker."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=ADDED_TOKENS
    )


def term_counts(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, term, occurrences) of all documents at once, by document and term."""
    if not docs:
        return (np.zeros(0, dtype=np.int64),) * 3
    owner = np.repeat(np.arange(len(docs), dtype=np.uint64), [len(d) for d in docs])
    codes = (owner << np.uint64(32)) | np.concatenate(docs).astype(np.uint64)
    codes.sort()
    starts = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    found = codes[starts]
    tf = np.diff(np.concatenate([starts, [len(codes)]]))
    return (found >> np.uint64(32)).astype(np.int64), (found & np.uint64(0xFFFFFFFF)).astype(np.int64), tf


@dataclass
class Corpus:
    """What BM25 needs to know of all documents; `df` is indexed by token id."""

    docs: int
    mean: float
    df: np.ndarray

    def idf(self, terms: np.ndarray) -> np.ndarray:
        df = self.df[terms]
        return np.log1p((self.docs - df + 0.5) / (df + 0.5))


class InvertedIndex:
    """BM25 over token ids: for each term, the documents that hold it and their weights.

    Without `corpus` the given documents are the whole corpus.
    """

    def __init__(
        self, docs: list[np.ndarray], k1: float = K1, b: float = B, corpus: Corpus | None = None
    ) -> None:
        self.size = len(docs)
        owner, terms, tf = term_counts(docs)
        vocabulary, code, df = np.unique(terms, return_inverse=True, return_counts=True)
        lengths = np.array([len(d) for d in docs], dtype=np.float64)
        norm = k1 * (1 - b + b * lengths / (corpus.mean if corpus else lengths.mean()))
        idf = corpus.idf(vocabulary) if corpus else np.log1p((self.size - df + 0.5) / (df + 0.5))
        weight = idf[code] * tf * (k1 + 1) / (tf + norm[owner])
        order = np.argsort(code, kind="stable")
        self.code, self.owner, self.weight = code[order], owner[order], weight[order]
        self.ends = np.cumsum(df)
        self.starts = self.ends - df
        self.terms = np.split(code, np.cumsum(np.bincount(owner, minlength=self.size))[:-1])

    def forget(self, gone: np.ndarray) -> None:
        """Drop the postings of the documents that `gone` flags."""
        kept = ~gone[self.owner]
        self.code, self.owner, self.weight = self.code[kept], self.owner[kept], self.weight[kept]
        df = np.bincount(self.code, minlength=len(self.ends))
        self.ends = np.cumsum(df)
        self.starts = self.ends - df

    def scores(self, query: int) -> np.ndarray:
        """Score of every document for the terms of document `query`."""
        terms = self.terms[query]
        spans = list(zip(self.starts[terms].tolist(), self.ends[terms].tolist()))
        owner = np.concatenate([self.owner[i:j] for i, j in spans])
        weight = np.concatenate([self.weight[i:j] for i, j in spans])
        return np.bincount(owner, weights=weight, minlength=self.size)


@lru_cache(maxsize=1)
def _directions() -> np.ndarray:
    """One per Python worker: the direction of each token id."""
    return np.random.default_rng(0).standard_normal((DIRECTIONS, DIMS), dtype=np.float32)


def vectors(tails: list[np.ndarray], corpus: Corpus) -> np.ndarray:
    """The projected BM25 weights of each tail, of length 1."""
    table = _directions()
    out = np.zeros((len(tails), DIMS), dtype=np.float32)
    owner, terms, tf = term_counts(tails)
    lengths = np.array([len(t) for t in tails], dtype=np.float64)
    norm = K1 * (1 - B + B * lengths / corpus.mean)
    weights = (corpus.idf(terms) * tf * (K1 + 1) / (tf + norm[owner])).astype(np.float32)
    ends = np.cumsum(np.bincount(owner, minlength=len(tails))).tolist()
    for i, (start, end) in enumerate(zip([0, *ends], ends)):
        out[i] = weights[start:end] @ table[terms[start:end] % DIRECTIONS]
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


class LexicalOrder:
    """A complete binary tree of splits at the median along the principal direction of each node's vectors."""

    def __init__(self, sample: np.ndarray, leaf: int = LEAF) -> None:
        self.depth = max(0, int(math.log2(max(1, len(sample) / leaf))))
        inner = (1 << self.depth) - 1
        self.direction = np.zeros((inner, DIMS), dtype=np.float32)
        self.threshold = np.zeros(inner, dtype=np.float32)
        self.center = np.zeros((inner + 1, DIMS), dtype=np.float32)
        held = {0: sample}
        for node in range(2 * inner + 1):
            mine = held.pop(node)
            mean = mine.mean(axis=0) if len(mine) else np.zeros(DIMS, dtype=np.float32)
            if node >= inner:
                self.center[node - inner] = mean
                continue
            if len(mine) > 1:
                offsets = mine - mean
                self.direction[node] = np.linalg.eigh(offsets.T @ offsets)[1][:, -1]
                self.threshold[node] = np.median(mine @ self.direction[node])
            right = mine @ self.direction[node] > self.threshold[node]
            held[2 * node + 1], held[2 * node + 2] = mine[~right], mine[right]

    def keys(self, found: np.ndarray) -> list[bytes]:
        """Sort keys of equal length: the leaf and the signs of the offsets from its mean."""
        node = np.zeros(len(found), dtype=np.int64)
        for _ in range(self.depth):
            right = np.einsum("ij,ij->i", found, self.direction[node]) > self.threshold[node]
            node = 2 * node + 1 + right
        leaf = node - ((1 << self.depth) - 1)
        signs = np.packbits(found[:, :64] > self.center[leaf][:, :64], axis=1)
        return [int(n).to_bytes(4, "big") + bits.tobytes() for n, bits in zip(leaf, signs)]


def fill_windows(
    docs: list[np.ndarray], window: int = WINDOW, corpus: Corpus | None = None
) -> Iterator[list[tuple[int, int, int]]]:
    """Windows as lists of (document, first token, tokens); every token of every document in exactly one."""
    if not docs:
        return
    index = InvertedIndex(docs, corpus=corpus)
    left = np.array([len(d) for d in docs])
    start = np.zeros(len(docs), dtype=np.int64)
    live = len(docs)

    def take(doc: int, room: int) -> tuple[int, int, int]:
        n = min(int(left[doc]), room)
        piece = (doc, int(start[doc]), n)
        left[doc] -= n
        start[doc] += n
        return piece

    for seed in range(len(docs)):
        if np.count_nonzero(left) < live // 2:
            index.forget(left == 0)
            live = np.count_nonzero(left)
        while left[seed] > 0:
            filled = [take(seed, window)]
            room = window - filled[0][2]
            if room:
                scores = index.scores(seed)
                scores[left == 0] = -1.0
            while room:
                best = int(scores.argmax())
                if scores[best] < 0:
                    break
                filled.append(take(best, room))
                room -= filled[-1][2]
                scores[best] = -1.0
            yield filled


def _cut(tokens: np.ndarray, window: int, separator: int) -> list[dict]:
    ids = np.concatenate([tokens, [separator]]).astype("<u4")
    whole = len(ids) - len(ids) % window
    pieces = [
        {"start": i, "length": window, "ids_crc32": zlib.crc32(ids[i : i + window]), "tail": None}
        for i in range(0, whole, window)
    ]
    if whole < len(ids):
        pieces.append({"start": whole, "length": len(ids) - whole, "ids_crc32": 0, "tail": ids[whole:].tobytes()})
    return [p | {"doc_tokens": len(ids)} for p in pieces]


_PACKED = pa.schema(
    [(n, pa.int64()) for n in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
)


def _pack_shard(shard: pa.Table, number: int, window: int, corpus: Corpus) -> pa.Table:
    """The tails of one shard, packed."""
    shard = shard.sort_by([("doc_id", "ascending"), ("doc_tokens", "ascending"), ("row", "ascending")])
    sequence = number << 32
    columns = {n: shard[n].to_pylist() for n in ("start", "doc_tokens")}
    tails = _token_ids(shard["tail"].to_pylist())
    rows, sources = [], []
    for filled in fill_windows(tails, window, corpus):
        offset = 0
        for i, begin, n in filled:
            crc = zlib.crc32(tails[i][begin : begin + n])
            # Even numbers; whole windows have odd ones.
            rows.append((columns["start"][i] + begin, n, crc, columns["doc_tokens"][i], 2 * sequence, offset))
            sources.append(i)
            offset += n
        sequence += 1
    packed = pa.table([list(c) for c in zip(*rows)] if rows else [[]] * 6, schema=_PACKED)
    return packed.add_column(0, "doc_id", shard["doc_id"].take(pa.array(sources, pa.int64())))


def _pack_range(window: int, corpus: Corpus, docs_per_shard: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The tails of one range in order; one shard is held at a time."""
        first, done, held, waiting = TaskContext.get().partitionId() << SHARD_BITS, 0, [], 0

        def finish() -> Iterator[pa.RecordBatch]:
            if done >> SHARD_BITS:
                raise ValueError("too many tails in one partition: raise spark.sql.shuffle.partitions")
            yield from _pack_shard(pa.Table.from_batches(held), first + done, window, corpus).to_batches()

        for batch in batches:
            while batch.num_rows:
                taken = batch.slice(0, docs_per_shard - waiting)
                held.append(taken)
                waiting += taken.num_rows
                batch = batch.slice(taken.num_rows)
                if waiting == docs_per_shard:
                    yield from finish()
                    done, held, waiting = done + 1, [], 0
        if held:
            yield from finish()

    return pack


def _token_ids(tails: list[bytes]) -> list[np.ndarray]:
    return [np.frombuffer(t, dtype="<u4") for t in tails]


def _corpus(tails: DataFrame) -> Corpus:
    """Counted in the partitions; the driver gets one number per token id."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, docs, tokens = np.zeros(0, dtype=np.int64), 0, 0
        for batch in batches:
            tails = _token_ids(batch.column(0).to_pylist())
            found = np.bincount(term_counts(tails)[1])
            longer = np.zeros(max(len(df), len(found)), dtype=np.int64)
            longer[: len(df)] += df
            longer[: len(found)] += found
            df, docs, tokens = longer, docs + len(tails), tokens + sum(map(len, tails))
        seen = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([[-1, -2], seen])), pa.array(np.concatenate([[docs, tokens], df[seen]]))],
            names=["term", "n"],
        )

    counted = tails.select("tail").mapInArrow(count, "term bigint, n bigint").groupBy("term").agg(F.sum("n"))
    found = {int(t): int(n) for t, n in counted.collect()}
    docs, tokens = found.pop(-1, 0), found.pop(-2, 0)
    df = np.zeros(max(found, default=0) + 1, dtype=np.int64)
    df[list(found)] = list(found.values())
    return Corpus(docs, tokens / max(1, docs), df)


def _ordered(tails: DataFrame, corpus: Corpus, docs_per_shard: int) -> DataFrame:
    """`tails` in ranges of the lexical order, sorted in each."""
    if corpus.docs <= docs_per_shard:
        return tails.coalesce(1)

    @F.pandas_udf("binary")
    def vector(found: pd.Series) -> pd.Series:
        return pd.Series([v.tobytes() for v in vectors(_token_ids(found.tolist()), corpus)], dtype=object)

    every = F.lit(math.ceil(corpus.docs / SAMPLE))
    sample = tails.where(F.pmod(F.xxhash64("row"), every) == 0).select("row", vector("tail").alias("vector")).collect()
    known = [np.frombuffer(r["vector"], dtype=np.float32) for r in sorted(sample, key=lambda r: r["row"])]
    order = LexicalOrder(np.stack(known) if known else np.zeros((0, DIMS), dtype=np.float32))

    @F.pandas_udf("binary")
    def key(found: pd.Series, rows: pd.Series) -> pd.Series:
        keys = order.keys(vectors(_token_ids(found.tolist()), corpus))
        return pd.Series([k + int(r).to_bytes(8, "big") for k, r in zip(keys, rows)], dtype=object)

    # Stored, because the range shuffle reads it twice.  Keys are unique, so ranges can be cut anywhere.
    keyed = pin(tails.withColumn("key", key("tail", "row")))
    return keyed.repartitionByRange("key").sortWithinPartitions("key").drop("key")


def pack_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    separator: int = SEPARATOR,
    docs_per_shard: int = DOCS_PER_SHARD,
    path: str | None = None,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's ids are those of its text and one `separator`; NULL text counts as empty and has only the separator.
    `ADDED_TOKENS` inside a text are one id each.
    Pieces lie gapless in their sequence from offset 0.  `path` names a rank file that every executor has;
    `docs_per_shard` is the largest number of tails of a shard.  Rows equal in id and text are separate documents, and
    many of them fill several shards.  An empty table gives no rows.  Other columns are not read.
    """
    file = path or public_tokenizers.path(VOCABULARY)
    piece = "start bigint, length bigint, ids_crc32 bigint, tail binary, doc_tokens bigint"

    @F.pandas_udf(f"array<struct<{piece.replace(' bigint', ': bigint').replace(' binary', ': binary')}>>")
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoding(file).encode_to_numpy
        for texts in batches:
            yield pd.Series([_cut(encode(t, allowed_special="all"), window, separator) for t in texts], dtype=object)

    id_type = docs.schema[id_col].dataType.simpleString()
    # Stored, so that a text is encoded once and a piece keeps its row number.
    pieces = pin(
        docs.select(col(id_col).alias("doc_id"), F.inline(cut(text_of(text_col)))).withColumn(
            "row", F.monotonically_increasing_id()
        )
    )
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    whole = pieces.where("tail IS NULL").select(
        *names, (2 * F.col("row") + 1).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset")
    )
    tails = pieces.where("tail IS NOT NULL")
    corpus = _corpus(tails)

    shape = (
        f"doc_id {id_type}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint,"
        " offset bigint"
    )
    packed = _ordered(tails, corpus, docs_per_shard).mapInArrow(_pack_range(window, corpus, docs_per_shard), shape)
    return whole.unionByName(packed)
