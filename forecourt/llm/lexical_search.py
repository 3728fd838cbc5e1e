"""Ranked lexical search with K2-treaps over the term-document grid.

Documents are dealt into blocks of bounded size.  A block's grid has a row per term and a column per document; a posting
is a point that carries its impact, the part of its score that does not depend on the query.  A quadtree over the grid
stores, for each cell that holds a point, which quadrants do (four bits) and the largest impact inside, as its difference
from the parent's.  Rows are ordered by document frequency, then by first document, so that points lie close together.

A query's terms are rows.  For a range of documents, the cells on the rows' paths give an upper bound of any score in it:
the sum of weight times maximum.  All rows of a query descend together: the ranges with the best bounds are halved first,
a range of one document has its exact score, and ranges whose bound is below the k-th score found are never opened.  A
task carries its k-th scores from one block to the next and returns k documents for each query.

Integers are 64 bits: weight w = floor(1000 ln((2N + 2) / (2 df + 1))), impact (10^9 tf) div (1000 tf + 8 m) with
m = 100 - 90 + (90 n N) div L.  N counts documents with a term, L their terms, n a document's, df those that hold a term.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from forecourt.llm.frames import col, pin, text_of

DOCS_PER_BLOCK = 4096
POSTINGS_PER_BLOCK = 1 << 19
# Of queries that pass over the index together: how many, and terms of all of them.
ITEMS_PER_PASS = 1024
TERMS_PER_PASS = 1 << 18
# Terms of the queries that descend together, and ranges of one query that are halved in a step.  A step takes twice as
# many as the one before once the first ranges have become single documents.
TERMS_AT_ONCE = 128
FIRST_RANGES = 16
K1_SHARE, LENGTH_SHARE = 8, 90
_KEPT = bytes(range(48, 58)) + bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256))
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b in _KEPT else 32 for b in range(256))
_POPCOUNT = np.array([bin(i).count("1") for i in range(16)], dtype=np.int64)


def terms_of(text: str | None) -> list[bytes]:
    """Runs of ASCII letters and digits and of other characters from U+0080, in UTF-8, only A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


@dataclass
class Corpus:
    """N and L."""

    docs: int
    terms: int

    def impact(self, tf: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        m = 100 - LENGTH_SHARE + (LENGTH_SHARE * lengths * self.docs) // max(1, self.terms)
        return (1_000_000_000 * tf) // (1000 * tf + K1_SHARE * m)

    def weight(self, df: int) -> int:
        return math.floor(1000 * math.log((2 * self.docs + 2) / (2 * df + 1)))


def _spread_bits(x: np.ndarray) -> np.ndarray:
    """Bit i of each number moved to bit 2i."""
    x = x.astype(np.uint64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F),
                        (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | (x << np.uint64(shift))) & np.uint64(mask)
    return x


class Treap:
    """The quadtree of one block: all cells of all levels, from the root to single points, in one numbering."""

    def __init__(self, height: int, masks: list[np.ndarray], drops: list[np.ndarray], top: int) -> None:
        """`masks` of the levels above the points; `drops` of the levels below the root."""
        self.height = height
        sizes = np.array([len(m) for m in masks] + [len(drops[-1]) if drops else 1])
        begins = np.concatenate([[0], np.cumsum(sizes)])
        self.mask = np.concatenate([*masks, np.zeros(sizes[-1], dtype=np.uint8)])
        first, best = [], [np.array([top], dtype=np.int64)]
        for level, (mask, drop) in enumerate(zip(masks, drops)):
            children = _POPCOUNT[mask]
            first.append(begins[level + 1] + np.cumsum(children) - children)
            best.append(np.repeat(best[-1], children) - drop.astype(np.int64))
        self.first = np.concatenate([*first, np.zeros(sizes[-1], dtype=np.int64)])
        self.best = np.concatenate(best)

    @staticmethod
    def pack(rows: np.ndarray, cols: np.ndarray, impacts: np.ndarray, height: int) -> bytes:
        """Points are distinct and there is at least one."""
        code = (_spread_bits(rows) << np.uint64(1)) | _spread_bits(cols)
        order = np.argsort(code, kind="stable")
        code, best = code[order], impacts[order].astype(np.int64)
        parts = []
        for _ in range(height):
            parent = code >> np.uint64(2)
            starts = np.flatnonzero(np.concatenate([[True], parent[1:] != parent[:-1]]))
            mask = np.bitwise_or.reduceat(np.left_shift(1, (code & np.uint64(3)).astype(np.uint8)).astype(np.uint8), starts)
            above = np.maximum.reduceat(best, starts)
            drop = np.repeat(above, _POPCOUNT[mask]) - best
            parts.append((mask, drop.astype("<u4")))
            code, best = parent[starts], above
        head = np.array([height, best[0], *[x for m, d in parts for x in (len(m), len(d))]], dtype="<i8").tobytes()
        body = b"".join(m.tobytes() + d.tobytes() for m, d in parts)
        return len(head).to_bytes(4, "little") + zlib.compress(head + body, 1)

    @classmethod
    def load(cls, packed: bytes) -> Treap:
        size, data = int.from_bytes(packed[:4], "little"), zlib.decompress(packed[4:])
        height, top, *lengths = np.frombuffer(data[:size], dtype="<i8").tolist()
        masks, drops, at = [], [], size
        for cells, children in zip(lengths[::2], lengths[1::2]):
            masks.append(np.frombuffer(data, np.uint8, cells, at))
            drops.append(np.frombuffer(data, "<u4", children, at + cells))
            at += cells + 4 * children
        return cls(height, masks[::-1], drops[::-1], top)

    def search(
        self, starts: np.ndarray, rows: np.ndarray, weights: np.ndarray, k: int, least: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """item, column, score: for each item the columns with its k best scores, equal ones included.

        Item i has rows[starts[i]:starts[i + 1]] and their weights.  Scores below least[i] need not be found.
        """
        parts, i = [], 0
        while i < len(starts) - 1:
            j = max(i + 1, int(np.searchsorted(starts, starts[i] + TERMS_AT_ONCE, "right")) - 1)
            cells = slice(starts[i], starts[j])
            found = self._search(starts[i : j + 1] - starts[i], rows[cells], weights[cells], k, least[i:j])
            parts.append((found[0] + i, *found[1:]))
            i = j
        return tuple(np.concatenate(p) for p in zip(*parts)) if parts else (np.zeros(0, np.int64),) * 3

    def _search(
        self, starts: np.ndarray, rows: np.ndarray, weights: np.ndarray, k: int, least: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        items = len(starts) - 1
        sizes = np.diff(starts)
        # Ranges of documents: item, level, column prefix and bound; the cells of a range lie together.
        item, level, prefix = np.arange(items), np.zeros(items, np.int64), np.zeros(items, np.int64)
        count, node, row, weight = sizes, np.zeros(len(rows), np.int64), rows, weights
        bound = np.bincount(np.repeat(item, sizes), weights * self.best[0], items).astype(np.int64)
        least = least.astype(np.int64).copy()
        found: list[tuple[np.ndarray, ...]] = []
        top: list[list[int]] = [[] for _ in range(items)]
        batch, step = FIRST_RANGES, 0

        def keep(mask: np.ndarray) -> None:
            nonlocal item, level, prefix, bound, count, node, row, weight
            cells = np.repeat(mask, count)
            node, row, weight = node[cells], row[cells], weight[cells]
            item, level, prefix, bound, count = item[mask], level[mask], prefix[mask], bound[mask], count[mask]

        keep(count > 0)
        while len(item):
            # The best ranges of each item.
            order = np.lexsort((-level, -bound, item))
            begin = np.searchsorted(item[order], item[order])
            chosen = np.zeros(len(item), dtype=bool)
            chosen[order[np.arange(len(order)) - begin < batch]] = True
            step += 1
            batch *= 2 if step > self.height else 1
            cells = np.repeat(chosen, count)
            owner = np.repeat(np.arange(int(chosen.sum())), count[chosen])
            s_item, s_level, s_prefix = item[chosen], level[chosen], prefix[chosen]
            s_node, s_row, s_weight = node[cells], row[cells], weight[cells]
            bit = (s_row >> (self.height - 1 - s_level[owner])) & 1
            mask, halves = self.mask[s_node].astype(np.int64), []
            for side in (0, 1):
                quadrant = 2 * bit + side
                there = (mask >> quadrant) & 1 == 1
                child = self.first[s_node] + _POPCOUNT[mask & ((1 << quadrant) - 1)]
                halves.append((2 * owner[there] + side, child[there], s_row[there], s_weight[there]))
            half = np.concatenate([h[0] for h in halves])
            by = np.argsort(half, kind="stable")
            half, c_node, c_row, c_weight = half[by], *[np.concatenate([h[i] for h in halves])[by] for i in (1, 2, 3)]
            live, c_count = np.unique(half, return_counts=True)
            c_bound = np.add.reduceat(c_weight * self.best[c_node], np.cumsum(c_count) - c_count) if len(live) else live
            c_item, c_level, c_prefix = s_item[live >> 1], s_level[live >> 1] + 1, 2 * s_prefix[live >> 1] + (live & 1)
            keep(~chosen)
            done = c_level == self.height
            if done.any():
                hit = done & (c_bound >= np.maximum(least[c_item], 1))
                found.append((c_item[hit], c_prefix[hit], c_bound[hit]))
                for i, score in zip(c_item[hit].tolist(), c_bound[hit].tolist()):
                    if len(top[i]) < k:
                        heapq.heappush(top[i], score)
                    else:
                        heapq.heappushpop(top[i], score)
                    if len(top[i]) == k:
                        least[i] = max(least[i], top[i][0])
            open_cells = np.repeat(~done, c_count)
            item, level = np.concatenate([item, c_item[~done]]), np.concatenate([level, c_level[~done]])
            prefix, bound = np.concatenate([prefix, c_prefix[~done]]), np.concatenate([bound, c_bound[~done]])
            count = np.concatenate([count, c_count[~done]])
            node, row = np.concatenate([node, c_node[open_cells]]), np.concatenate([row, c_row[open_cells]])
            weight = np.concatenate([weight, c_weight[open_cells]])
            keep((bound >= least[item]) & (bound > 0))
        if not found:
            return (np.zeros(0, np.int64),) * 3
        i, c, s = (np.concatenate(x) for x in zip(*found))
        good = s >= least[i]
        return i[good], c[good], s[good]


def corpus_of(docs: DataFrame, text_col: str = "text") -> Corpus:
    """N and L, counted in the partitions."""

    @F.pandas_udf("bigint")
    def lengths(texts: pd.Series) -> pd.Series:
        return pd.Series([len(terms_of(t)) for t in texts], dtype="int64")

    counted = docs.select(lengths(text_of(text_col)).alias("n"))
    row = counted.agg(F.count_if(F.col("n") > 0).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    return Corpus(int(row["docs"]), int(row["terms"]))


class _Block:
    """Postings on their way into a treap."""

    def __init__(self) -> None:
        self.doc_ids: list[pa.Scalar] = []
        self.lengths: list[int] = []
        self.vocabulary: dict[bytes, int] = {}
        self.rows: list[int] = []
        self.tf: list[int] = []
        self.sizes: list[int] = []

    def add(self, doc_id: pa.Scalar, terms: list[bytes]) -> None:
        counts = Counter(terms)
        number = self.vocabulary.setdefault
        self.rows.extend([number(t, len(self.vocabulary)) for t in counts])
        self.tf.extend(counts.values())
        self.sizes.append(len(counts))
        self.doc_ids.append(doc_id)
        self.lengths.append(len(terms))

    def full(self, docs: int, postings: int) -> bool:
        return len(self.sizes) >= docs or len(self.rows) >= postings

    def finish(self, name: int, corpus: Corpus, schema: pa.Schema) -> pa.RecordBatch:
        rows, tf = np.array(self.rows, dtype=np.int64), np.array(self.tf, dtype=np.int64)
        cols = np.repeat(np.arange(len(self.sizes)), self.sizes)
        impacts = corpus.impact(tf, np.array(self.lengths, dtype=np.int64)[cols])
        df = np.bincount(rows, minlength=len(self.vocabulary))
        # A term's number is that of its first posting, so frequent terms first and then by number is by first document.
        order = np.argsort(-df, kind="stable")
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        height = max(1, len(order) - 1, len(self.sizes) - 1).bit_length()
        terms = list(self.vocabulary)
        treap = Treap.pack(place[rows], cols, impacts, height)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([name], pa.int64()),
                pa.array([self.doc_ids], schema.field("doc_ids").type),
                pa.array([b" ".join([terms[i] for i in order.tolist()]).decode("utf-8", "replace")], pa.string()),
                pa.array([df[order]], pa.list_(pa.int64())),
                pa.array([treap], pa.binary()),
            ],
            schema=schema,
        )


def build_index(
    docs: DataFrame,
    corpus: Corpus,
    id_col: str = "doc_id",
    text_col: str = "text",
    docs_per_block: int = DOCS_PER_BLOCK,
    postings_per_block: int = POSTINGS_PER_BLOCK,
) -> DataFrame:
    """block, doc_ids, terms (joined by spaces, in row order), df (of the block), treap: every document with a term."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, block, schema = TaskContext.get().partitionId() << 32, _Block(), None
        for batch in batches:
            schema = schema or pa.schema(
                [("block", pa.int64()), ("doc_ids", pa.list_(batch.schema.field(0).type)), ("terms", pa.string()),
                 ("df", pa.list_(pa.int64())), ("treap", pa.binary())]
            )
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                terms = terms_of(text.as_py())
                if terms:
                    block.add(doc_id, terms)
                if block.full(docs_per_block, postings_per_block):
                    yield block.finish(name, corpus, schema)
                    name, block = name + 1, _Block()
        if block.sizes:
            yield block.finish(name, corpus, schema)

    return docs.select(col(id_col).alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(
        build, f"block bigint, doc_ids array<{id_type}>, terms string, df array<bigint>, treap binary"
    )


def _term_counts(index: DataFrame) -> DataFrame:
    each = F.arrays_zip(F.split("terms", " ").alias("term"), F.col("df").alias("df"))
    return index.select(F.inline(each)).toDF("term", "df")


def _passes(items: DataFrame, index: DataFrame, corpus: Corpus) -> Iterator[list[tuple]]:
    """Blocks of (item_id, terms, weights), bounded in items and terms, read one by one from the stored query set."""

    @F.pandas_udf("array<string>")
    def distinct_terms(texts: pd.Series) -> pd.Series:
        return pd.Series([[t.decode("utf-8", "replace") for t in dict.fromkeys(terms_of(t))] for t in texts], dtype=object)

    asked = items.select("item_id", F.monotonically_increasing_id().alias("row"), distinct_terms("text").alias("terms"))
    asked = pin(asked.select("item_id", "row", F.explode("terms").alias("term")))
    known = _term_counts(index).join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    weighed = asked.join(known, "term").groupBy("row", "item_id").agg(F.collect_list(F.struct("term", "df")).alias("terms"))
    block, size = [], 0
    for row in weighed.toLocalIterator():
        if block and (len(block) == ITEMS_PER_PASS or size + len(row["terms"]) > TERMS_PER_PASS):
            yield block
            block, size = [], 0
        weights = [(t["term"].encode(), corpus.weight(t["df"])) for t in row["terms"]]
        block.append((row["row"], row["item_id"], [(t, w) for t, w in weights if w > 0]))
        size += len(row["terms"])
    if block:
        yield block


def search(index: DataFrame, corpus: Corpus, items: DataFrame, k: int = 10, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the `k` documents of each item with the highest scores above 0.

    Equal scores are ranked by doc_id, NULL last.  Each row of `items` is a query of its own; rows equal in id and text
    are one.  NULL text has no terms and no results.  Queries pass over the index in blocks of bounded size.
    """
    queries = items.select(col(item_col).alias("item_id"), text_of(text_col).alias("text")).distinct()
    id_type = index.schema["doc_ids"].dataType.elementType
    names = [F.col("_row"), F.col("doc_id"), F.col("score")]
    parts = []
    for block in _passes(queries, index, corpus):
        rows = [row for row, _, _ in block]
        asked = [terms for _, _, terms in block]

        def descend(batches: Iterator[pa.RecordBatch], rows=rows, asked=asked) -> Iterator[pa.RecordBatch]:
            needed = {t for terms in asked for t, _ in terms}
            best: list[list[tuple[int, object]]] = [[] for _ in asked]
            kind = None
            for batch in batches:
                kind = kind or batch.schema.field(0).type.value_type
                for doc_ids, terms, treap in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                    place = {t: i for i, t in enumerate(terms.encode().split(b" ")) if t in needed}
                    held = [[(place[t], w) for t, w in query if t in place] for query in asked]
                    starts = np.cumsum([0, *map(len, held)])
                    flat = np.array([x for query in held for x in query], dtype=np.int64).reshape(-1, 2)
                    least = np.array([b[k - 1][0] if len(b) >= k else 0 for b in best])
                    for i, c, s in zip(*map(np.ndarray.tolist, Treap.load(treap).search(starts, flat[:, 0], flat[:, 1], k, least))):
                        best[i].append((s, doc_ids[c]))
                    for b in best:
                        b.sort(key=lambda x: (-x[0], x[1] is None, x[1]))
                        del b[k:]
            if kind is not None:
                out = [(rows[i], d, s) for i, b in enumerate(best) for s, d in b]
                columns = [list(c) for c in zip(*out)] if out else [[], [], []]
                types = (pa.int64(), kind, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["_row", "doc_id", "score"])

        schema = f"_row bigint, doc_id {id_type.simpleString()}, score bigint"
        hits = index.select("doc_ids", "terms", "treap").mapInArrow(descend, schema).select(*names)
        order = Window.partitionBy("_row").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        ranked = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        ids = items.sparkSession.createDataFrame([(r, i) for r, i, _ in block], f"_row bigint, item_id {items.schema[item_col].dataType.simpleString()}")
        parts.append(ranked.join(ids, "_row").select("item_id", "rank", "doc_id", "score"))
    if not parts:
        item_type = items.schema[item_col].dataType.simpleString()
        return items.sparkSession.createDataFrame([], f"item_id {item_type}, rank int, doc_id {id_type.simpleString()}, score bigint")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def search_documents(
    docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", **options
) -> DataFrame:
    """`search` over a new index of `docs`.

    Each row of `docs` is a document, repeated rows too.  NULL, empty and term-less texts are no documents and are never
    found.  Other columns are not read.  An empty table of documents or items gives no rows.
    """
    corpus = corpus_of(docs, text_col)
    index = pin(build_index(docs, corpus, id_col, text_col, **options))
    return search(index, corpus, items, k)
