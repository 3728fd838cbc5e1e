"""Jaccard join of documents on word shingles by a token-group matrix.

A document is the set of the 64-bit hashes of its shingles; equal sets become one.  All sets order tokens alike: by a
count sketch of fixed size, rarest first, then by value.  Two sets that link share a token among the first
p = n - ceil(t n) + 1 of each (n tokens, threshold t), and at least k among the first p + k - 1.  A set that shares fewer
than k = p / 4 tokens of such a prefix with other sets' prefixes is done; only the tokens of the others are ever stored
or moved, made from the texts again.

The others are partitioned into groups: dealt by ranges and sorted by minima of three hash functions, which similar sets
share, and cut into runs of at most `GROUP_SETS` sets and `GROUP_TOKENS` tokens.  Links inside a group come from one product of its incidence
matrix.  Between groups, the matrix of prefix tokens by groups proposes which sets of one group to ask another for; the
overlap of a query with the group's token union bounds its overlap with every member, and only a group whose bound
reaches ceil(t n) is opened and its members compared exactly.

Links are needed only up to their components: pairs of groups that lie in one component already are not proposed, and an
opened group reports a spanning forest.  A very large set of near copies that do not link among
themselves remains quadratic work in its number of groups, spread over tasks of bounded size.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forecourt.functions.joins import lookup
from forecourt.functions.lineage import pin as store
from forecourt.llm.components import connected
from forecourt.llm.frames import bitmap_of, col, is_set, pin, text_of

SHINGLE_WORDS = 3
PERCENT = 90
SEED = 42
# Counters of the sketch that orders tokens.  A larger one tells frequent tokens from rare ones in larger corpora.
SKETCH_BITS = 20
CHUNK = 1 << 14
# Flags of the sets whose tokens are needed in full; with more sets than flags, others come along and are dropped.
LIVE_BITS = 22
# Flags of the groups whose sets are moved; with more groups than flags, others come along and are dropped.
GROUP_BITS = 2**16
# Live sets that the ranges are cut by, and keys of sets given that a task remembers.
SAMPLE = 8192
REMEMBERED = 1 << 18
# A query asks a group as one bit of 64.
GROUP_SETS = 64
GROUP_TOKENS = 1 << 16
# Tokens of the queries that one task holds against a group, about.
QUERY_TOKENS = 1 << 18
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_MIXERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)


# A word's hash is the polynomial of its bytes, each replaced by a random number, in powers of an odd one modulo 2**64.
_BASE = 0x9E3779B97F4A7C15 | 3
_BYTES = np.random.default_rng(SEED).integers(0, 1 << 64, 256, dtype=np.uint64)
_IS_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
# Bytes of a text that are hashed together, but for the rest of a word.
BLOCK = 1 << 20


@lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """The first `size` powers of the base and their inverses."""
    found = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        factors = np.full(size, base, dtype=np.uint64)
        factors[0] = 1
        found.append(np.cumprod(factors, dtype=np.uint64))
    return found[0], found[1]


def _word_hashes(data: bytes) -> np.ndarray:
    """The hash of every word, in order."""
    found, at = [], 0
    while at < len(data):
        end = at + BLOCK
        if end < len(data):
            space = _SPACE.search(data, end)
            end = space.start() if space else len(data)
        block = np.frombuffer(data[at:end], dtype=np.uint8)
        at = end
        inside = np.concatenate([[False], ~_IS_SPACE[block], [False]])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edges[::2], edges[1::2]
        powers, inverse = _powers(max(BLOCK, 1 << (len(block) - 1).bit_length()))
        sums = np.zeros(len(block) + 1, dtype=np.uint64)
        np.cumsum(_BYTES[block] * powers[: len(block)], out=sums[1:])
        found.append((sums[ends] - sums[starts]) * inverse[starts])
    return np.concatenate(found) if found else np.zeros(0, dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A permutation of the 64-bit integers in which every bit depends on all others."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str, shingle_words: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles, each made from its words' hashes one after the other.

    A text of fewer words is one shingle, a text without words has none.  A-Z are lower-cased.
    """
    hashes = _word_hashes(text.encode("utf-8", "surrogatepass").translate(_LOWER))
    if not len(hashes):
        return hashes
    size = min(shingle_words, len(hashes))
    n = len(hashes) - size + 1
    found = np.full(n, size, dtype=np.uint64)
    for i in range(size):
        found = _mixed(found + hashes[i : i + n])
    found.sort()
    return found[np.concatenate([[True], found[1:] != found[:-1]])]


def needed(n, percent: int):
    """Least overlap of a set of `n` tokens with one that it links to."""
    return -(-percent * n // 100)


def set_key(tokens: np.ndarray) -> bytes:
    """Identifies a set and sorts similar ones together: minima of three hash functions, then a digest of 128 bits."""
    minima = (tokens[None, :] * _MIXERS[:, None]).min(axis=1) if len(tokens) else np.zeros(len(_MIXERS), dtype=np.uint64)
    return minima.astype(">u8").tobytes() + xxhash.xxh3_128_digest(tokens.astype("<u8").tobytes())


def _rarest(tokens: np.ndarray, sketch: np.ndarray, bits: int, size: int) -> np.ndarray:
    return tokens[np.argsort(sketch[_bucket(tokens, bits)], kind="stable")[:size]]


def prefix_length(n: int, percent: int) -> int:
    """So many first tokens of a set of `n` hold one of any set that it links to."""
    return n - needed(n, percent) + 1


def extra_shared(n: int, percent: int) -> int:
    """The prefix is stored longer by this less one; a set that links shares at least as many tokens of it."""
    return -(-prefix_length(n, percent) // 4)


def links(overlap, n_a, n_b, percent: int):
    return (100 * overlap >= percent * (n_a + n_b - overlap)) & (overlap > 0)


def _tokens(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, dtype="<u8")


def _counted(rows: DataFrame, bits: int, keys_of: Callable[[list], np.ndarray]) -> np.ndarray:
    """Counts by the upper `bits` bits of the 64-bit keys of all rows (one column); the driver gets this array."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, dtype=np.uint32)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                keys = keys_of(batch.column(0).slice(i, 256).to_pylist())
                counts += np.bincount(_bucket(keys, bits), minlength=1 << bits).astype(np.uint32)
        pieces = counts.reshape(-1, min(CHUNK, 1 << bits))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(pieces))), pa.array([p.tobytes() for p in pieces], pa.binary())], names=["chunk", "counts"]
        )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total[chunk] = total.get(chunk, 0) + np.frombuffer(counts, dtype=np.uint32).astype(np.uint64)
        pieces = [np.minimum(c, np.iinfo(np.uint32).max).astype(np.uint32).tobytes() for c in total.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(pieces, pa.binary())], names=["chunk", "counts"])

    parts = rows.mapInArrow(count, "chunk bigint, counts binary")
    counts = np.zeros(1 << bits, dtype=np.uint32)
    for row in parts.repartition("chunk").mapInArrow(add, "chunk bigint, counts binary").collect():
        piece = np.frombuffer(row["counts"], dtype=np.uint32)
        counts[row["chunk"] * len(piece) : (row["chunk"] + 1) * len(piece)] = piece
    return counts


def _bucket(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> np.uint64(64 - bits)).astype(np.int64)


def _summaries(texts: DataFrame, sketch: np.ndarray, bits: int, shingle_words: int, percent: int) -> DataFrame:
    """row, doc_id, n, key (of the set), prefix: one row per document, its tokens left behind."""

    @F.pandas_udf("struct<n: bigint, key: binary, prefix: array<bigint>>")
    def summarise(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for found in batches:
            rows = []
            for text in found:
                tokens = shingle_set(text, shingle_words)
                size = prefix_length(len(tokens), percent) + extra_shared(len(tokens), percent) - 1 if len(tokens) else 0
                rows.append((len(tokens), set_key(tokens), _rarest(tokens, sketch, bits, size).view(np.int64)))
            yield pd.DataFrame(rows, columns=["n", "key", "prefix"])

    made = texts.select("doc_id", summarise("text").alias("s"))
    return made.select(F.monotonically_increasing_id().alias("row"), "doc_id", "s.*")


def _digest_keys(keys: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(k[-8:] for k in keys), dtype="<u8")


def _live_sets(texts: DataFrame, live: np.ndarray, bits: int, shingle_words: int, bounds: list[bytes]) -> DataFrame:
    """range, key, tokens: the sets that `live` may have, made again from the texts; a few others may come along.

    A task gives a set once as far as it remembers; what is left of copies meets in the range.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given: set[bytes] = set()
        for batch in batches:
            rows = []
            for text in batch.column(0):
                tokens = shingle_set(text.as_py(), shingle_words)
                key = set_key(tokens)
                if len(tokens) and live[_bucket(_digest_keys([key]), bits)[0]] and key not in given:
                    if len(given) >= REMEMBERED:
                        given.clear()
                    given.add(key)
                    rows.append((bisect_right(bounds, key), key, tokens.astype("<u8").tobytes()))
            columns = [list(c) for c in zip(*rows)] if rows else [[], [], []]
            types = (pa.int32(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["range", "key", "tokens"])

    return texts.select("text").mapInArrow(emit, "range int, key binary, tokens binary")


PACKED = (
    "group bigint, least bigint, most bigint, sizes array<bigint>, keys array<binary>, sets array<binary>, a array<bigint>, b array<bigint>,"
    " tokens array<bigint>, queries array<bigint>"
)


def _group_row(group: int, held: list[tuple[bytes, bytes]], percent: int, sketch: np.ndarray, bits: int) -> dict:
    """One group: its sets, the links among them, and which of its sets have which token in their prefixes."""
    sets = [_tokens(blob) for _, blob in held]
    n = np.array([len(s) for s in sets])
    _, matrix = _incidence(sets)
    # float32 holds overlaps exactly up to 2**24 tokens a set.
    overlap = np.rint(matrix @ matrix.T).astype(np.int64)
    a, b = np.nonzero(np.triu(links(overlap, n[:, None], n[None, :], percent), 1))
    asked: dict[int, int] = {}
    for slot, tokens in enumerate(sets):
        size = prefix_length(len(tokens), percent) + extra_shared(len(tokens), percent) - 1
        for token in _rarest(tokens, sketch, bits, size).view(np.int64).tolist():
            asked[token] = asked.get(token, 0) | 1 << slot
    masks = np.array(list(asked.values()), dtype=np.uint64).view(np.int64)
    return {
        "group": group, "least": int(n.min()), "most": int(n.max()), "sizes": n.tolist(), "keys": [k for k, _ in held],
        "sets": [blob for _, blob in held], "a": (group * GROUP_SETS + a).tolist(), "b": (group * GROUP_SETS + b).tolist(),
        "tokens": list(asked), "queries": masks.tolist(),
    }


def _groups(percent: int, sketch: np.ndarray, bits: int):
    schema = pa.schema([
        ("group", pa.int64()), ("least", pa.int64()), ("most", pa.int64()), ("sizes", pa.list_(pa.int64())),
        ("keys", pa.list_(pa.binary())), ("sets", pa.list_(pa.binary())), *[(c, pa.list_(pa.int64())) for c in ("a", "b", "tokens", "queries")],
    ])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs of sets in order, bounded in sets and tokens; copies collapse."""
        group, held, size, last = TaskContext.get().partitionId() << 32, [], 0, None
        for batch in batches:
            for key, blob in zip(batch.column("key").to_pylist(), batch.column("tokens").to_pylist()):
                if key == last:
                    continue
                if len(held) == GROUP_SETS or (held and size + len(blob) // 8 > GROUP_TOKENS):
                    yield pa.RecordBatch.from_pylist([_group_row(group, held, percent, sketch, bits)], schema)
                    group, held, size = group + 1, [], 0
                last = key
                held.append((key, blob))
                size += len(blob) // 8
        if held:
            yield pa.RecordBatch.from_pylist([_group_row(group, held, percent, sketch, bits)], schema)

    return cut


def _incidence(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The union of some sets, and which set has which of its tokens."""
    union, place = np.unique(np.concatenate(sets), return_inverse=True)
    matrix = np.zeros((len(sets), len(union)), dtype=np.float32)
    matrix[np.repeat(np.arange(len(sets)), [len(t) for t in sets]), place] = 1
    return union, matrix


def _pairs(a: list, b: list) -> pa.Table:
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _across(percent: int):
    def link(target: pa.Table, queries: pa.Table) -> pa.Table:
        """Links of queries with the members of one group, if its union passes their bound; a spanning forest of them."""
        if not len(target) or not len(queries):
            return _pairs([], [])
        group, sets = target["group"][0].as_py(), [_tokens(b) for b in target["sets"][0].as_py()]
        union, matrix = _incidence(sets)
        n = np.array([len(s) for s in sets])
        found, label = [], {}

        def root(x: int) -> int:
            while label.setdefault(x, x) != x:
                label[x] = x = label[label[x]]
            return x

        for asking, slots, blobs in zip(*[queries[c].to_pylist() for c in ("asking", "slots", "sets")]):
            for slot, blob in zip(slots, blobs):
                tokens = _tokens(blob)
                at = np.minimum(np.searchsorted(union, tokens), len(union) - 1)
                at = at[union[at] == tokens]
                if len(at) < needed(len(tokens), percent):
                    continue
                overlap = np.rint(matrix[:, at].sum(axis=1)).astype(np.int64)
                query = asking * GROUP_SETS + slot
                for member in np.flatnonzero(links(overlap, n, len(tokens), percent)).tolist():
                    x, y = root(query), root(group * GROUP_SETS + member)
                    if x != y:
                        label[x] = y
                        found.append((query, group * GROUP_SETS + member))
        return _pairs([a for a, _ in found], [b for _, b in found])

    return link


def _with_roots(rows: DataFrame, roots: DataFrame, key: str, name: str) -> DataFrame:
    ends = roots.select(F.col("vertex").alias(key), F.col("root").alias("_root"))
    return rows.join(ends, key, "left").withColumn(name, F.coalesce("_root", key)).drop("_root")


def _live(summaries: DataFrame, percent: int) -> DataFrame:
    """key: the distinct sets that share enough prefix tokens with others."""
    distinct = summaries.where("n > 0").groupBy("key").agg(F.first("n").alias("n"), F.first("prefix").alias("prefix"))
    chosen = pin(distinct.select(F.monotonically_increasing_id().alias("row"), "key", "n", "prefix"))
    tokens = chosen.select("row", F.explode("prefix").alias("token"))
    # A prefix has a token once.
    shared = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    # Stored, so that both sides come straight from a shuffle and adaptive execution can cut a token that very many
    # prefixes have.
    held = tokens.join(pin(shared.select("token")), "token").groupBy("row").agg(F.count(F.lit(1)).alias("shared"))
    return pin(chosen.select("row", "key", "n").join(held, "row").where(F.col("shared") >= _enough(F.col("n"), percent)).select("key"))


def _enough(n: Column, percent: int) -> Column:
    """`extra_shared` of the smallest partner that a set of `n` tokens may have: its prefix is the shorter one."""
    smaller = F.ceil(n * percent / 100)
    return F.ceil((smaller - F.ceil(smaller * percent / 100) + 1) / 4)


def _range_bounds(live: DataFrame) -> list[bytes]:
    """Keys that cut the sets into ranges, from a sample of about `SAMPLE` keys: they decide only where groups lie."""
    partitions = int(live.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    every = F.lit(max(1, live.count() // SAMPLE))
    sample = sorted(bytes(r["key"]) for r in live.where(F.pmod(F.xxhash64("key"), every) == 0).collect())
    ranges = min(len(sample), 4 * partitions)
    return [sample[i * len(sample) // ranges] for i in range(1, ranges)]


def similar_sets(
    texts: DataFrame, summaries: DataFrame, sketch: np.ndarray, sketch_bits: int,
    shingle_words: int = SHINGLE_WORDS, percent: int = PERCENT, live_bits: int = LIVE_BITS,
) -> DataFrame:
    """key, comp: the component of every set that links, and of some that do not.  `summaries` of `texts` are stored."""
    live = _live(summaries, percent)
    known = _counted(live.select("key"), live_bits, _digest_keys) > 0
    sets = _live_sets(texts, known, live_bits, shingle_words, _range_bounds(live))
    packed = pin(
        sets.repartition("range").sortWithinPartitions("range", "key").select("key", "tokens")
        .mapInArrow(_groups(percent, sketch, sketch_bits), PACKED)
    )
    # Dealt anew, so that these few rows are not stored as a file per range.
    inner = packed.select(F.inline(F.arrays_zip("a", "b"))).repartition("a")
    vertices = packed.select("group", F.posexplode("keys").alias("slot", "key")).select(
        "group", "key", (F.col("group") * GROUP_SETS + F.col("slot")).alias("row")
    )
    classed = pin(_with_roots(vertices, connected(pin(inner)), "row", "comp"))
    comps = classed.groupBy("group").agg(F.min("comp").alias("low"), F.max("comp").alias("high"))

    # The matrix of prefix tokens by groups; the sets of a group that have the token are the queries, as bits.  Tokens of one
    # pair of groups are at most as many as a group's prefixes have.
    entries = packed.select("group", "least", "most", F.inline(F.arrays_zip("tokens", "queries")))
    matrix = pin(entries.withColumnRenamed("tokens", "token").join(comps, "group"))
    asked = matrix.toDF(*[f"{c}_q" if c != "token" else c for c in matrix.columns])
    viable = (
        (F.col("group_q") < F.col("group"))
        & (100 * F.col("most_q") >= percent * F.col("least"))
        & (100 * F.col("most") >= percent * F.col("least_q"))
        & ~((F.col("low_q") == F.col("high")) & (F.col("high_q") == F.col("low")))
    )
    # Per pair of groups, the queries that hold each shared token; a query goes on if it holds enough of them.
    shared = asked.join(matrix, "token").where(viable).groupBy("group_q", "group").agg(F.collect_list("queries_q").alias("masks"))
    sizes = packed.select(F.col("group").alias("group_q"), "sizes")
    places = F.sequence(F.lit(0), F.size("sizes") - 1)
    slots = F.filter(
        places,
        lambda i: F.size(F.filter("masks", lambda m: F.getbit(m, i) == 1)) >= _enough(F.get("sizes", i), percent),
    )
    proposed = shared.join(sizes, "group_q").withColumn("slots", slots).where(F.size("slots") > 0)
    load = F.aggregate(F.transform("slots", lambda i: F.get("sizes", i)), F.lit(0).cast("bigint"), lambda a, n: a + n)
    proposed = pin(proposed.select("group_q", "group", "slots", load.alias("load")))
    chunks = store(proposed.groupBy("group").agg(F.ceil(F.sum("load") / QUERY_TOKENS).cast("int").alias("chunks")))
    # Sets move only of groups that ask or are asked.
    asks, asked_of = (is_set(bitmap_of(proposed.select(c), GROUP_BITS), [F.col("group")]) for c in ("group_q", "group"))
    asking = packed.where(asks).select(F.col("group").alias("group_q"), F.col("sets").alias("held"))
    queries = (
        proposed.join(chunks, "group")
        .select("group", F.pmod(F.xxhash64("group_q"), F.col("chunks")).cast("int").alias("chunk"), "group_q", "slots")
        .join(asking, "group_q")
        .select("group", "chunk", F.col("group_q").alias("asking"), "slots",
                F.transform("slots", lambda i: F.get("held", i)).alias("sets"))
    )
    targets = (
        packed.where(asked_of).select("group", "sets").join(chunks, "group")
        .select("group", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "sets")
        .toDF("group", "chunk", "sets")
    )
    # Read once, and so not stored: its tasks are large, and a file each would start a child of the executor.
    outer = (
        targets.groupBy("group", "chunk").cogroup(queries.groupBy("group", "chunk"))
        .applyInArrow(_across(percent), "a bigint, b bigint")
    )
    ends = classed.select("row", "comp")
    between = outer.join(ends.toDF("a", "x"), "a").join(ends.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    merged = _with_roots(classed, connected(pin(between.distinct())), "comp", "whole")
    return merged.select("key", F.col("whole").alias("comp"))


def linked_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle_words: int = SHINGLE_WORDS,
    percent: int = PERCENT,
    sketch_bits: int = SKETCH_BITS,
) -> DataFrame:
    """doc_id, n_shingles, component_id: one row per row of `docs`; other columns are not read.

    Documents link if 100 * intersection >= `percent` * union; a component's id is its smallest doc_id.  NULL, empty and
    word-less texts have no shingles and are linked with nothing.  Equal texts and repeated rows are linked.  A NULL id
    is smallest only in a component that has no other.  An empty table gives no rows.
    """
    texts = docs.select(col(id_col).alias("doc_id"), text_of(text_col).alias("text"))

    def tokens_of(found: list[str]) -> np.ndarray:
        return np.concatenate([shingle_set(t, shingle_words) for t in found])

    sketch = _counted(texts.select("text"), sketch_bits, tokens_of)
    summaries = pin(_summaries(texts, sketch, sketch_bits, shingle_words, percent))
    classed = pin(similar_sets(texts, summaries, sketch, sketch_bits, shingle_words, percent))
    narrow = summaries.select("row", "doc_id", F.col("n").alias("n_shingles"), "key")
    # Equal sets first: one row each, with their component or their own.
    sets = narrow.where("n_shingles > 0").groupBy("key").agg(F.min("doc_id").alias("lowest"))
    sets = pin(sets.join(classed, "key", "left").withColumn("comp", F.coalesce(F.col("comp").cast("string"), F.hex("key"))))
    lowest = sets.groupBy("comp").agg(F.min("lowest").alias("component_id"))
    named = lookup(sets.select("key", "comp"), lowest, "comp", "key", how="inner").select("key", "component_id")
    linked = lookup(narrow.where("n_shingles > 0"), named, "key", "row", how="inner")
    alone = narrow.where("n_shingles = 0").withColumn("component_id", F.col("doc_id"))
    names = ["doc_id", "n_shingles", "component_id"]
    return linked.select(*names).unionByName(alone.select(*names))
