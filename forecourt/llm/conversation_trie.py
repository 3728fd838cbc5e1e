"""Prefix trie of conversations: how many share each beginning, and what storing shared turns once would save.

Turns are dictionary-encoded: each distinct (role, text) has an integer.  Conversations are ordered by their sequences of
these, then by id, and cut into range shards of bounded size.  Each shard inserts its distinct sequences into a ternary
search tree, the median first and then the medians of both halves, so that the trees of siblings are balanced; an
iterative traversal then accumulates members, children, leaves and savings.

A node inside a shard is final.  The nodes on the paths of a shard's first and last sequence may go on in other shards:
these boundary nodes are merged by a digest of their prefix.  What a merged node adds to the subtrees above it is
credited to one of the paths it lies on, summed along that path and then over paths, so no path is walked twice.

A conversation's turn integers lie in one row, 24 bytes a turn; texts never do.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from forecourt.functions.joins import lookup
from forecourt.llm.frames import col, pin, text_of

# A shard ends with the sequence that reaches this many turns.
SHARD_TURNS = 1 << 17
NODE = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint"
PART = f"shard bigint, side int, key binary, parent_key binary, bytes bigint, ends string, {NODE}"
_NOTHING = hashlib.sha256(b"").hexdigest()


class TernaryTree:
    """Trie whose siblings form binary search trees; node 0 is the root of the trie, without a symbol."""

    def __init__(self) -> None:
        self.symbol, self.less, self.more, self.child = [0], [0], [0], [0]
        self.parent, self.depth, self.size = [-1], [0], [0]
        self.members, self.lowest = [0], [None]

    def _new(self, symbol: int, parent: int, size: int) -> int:
        for values, value in (
            (self.symbol, symbol), (self.less, 0), (self.more, 0), (self.child, 0), (self.parent, parent),
            (self.depth, self.depth[parent] + 1), (self.size, size), (self.members, 0), (self.lowest, None),
        ):
            values.append(value)
        return len(self.symbol) - 1

    def insert(self, symbols: list[int], sizes: list[int], ids: list[int]) -> list[int]:
        """The nodes of the sequence from the root on, after counting `ids` (ascending) as members of each."""
        node, path = 0, [0]
        for symbol, size in zip(symbols, sizes):
            at = self.child[node]
            if not at:
                at = self.child[node] = self._new(symbol, node, size)
            while self.symbol[at] != symbol:
                side = self.less if symbol < self.symbol[at] else self.more
                if not side[at]:
                    side[at] = self._new(symbol, node, size)
                at = side[at]
            node = at
            path.append(node)
        for n in path:
            self.members[n] += len(ids)
            self.lowest[n] = ids[0] if self.lowest[n] is None else min(self.lowest[n], ids[0])
        return path

    def preorder(self) -> list[int]:
        """Every node after its parent, by an explicit stack."""
        order, stack = [], [0]
        while stack:
            node = stack.pop()
            order.append(node)
            siblings = [self.child[node]] if self.child[node] else []
            while siblings:
                at = siblings.pop()
                stack.append(at)
                siblings += [s for s in (self.less[at], self.more[at]) if s]
        return order


def median_first(n: int) -> Iterator[int]:
    """0..n-1: the middle, then the middles of both halves, and so on."""
    spans = [(0, n)]
    while spans:
        lo, hi = spans.pop()
        if lo < hi:
            middle = (lo + hi) // 2
            yield middle
            spans += [(middle + 1, hi), (lo, middle)]


def _shard_rows(shard: int, rows: list[tuple[int, list[int], list[int]]]) -> dict[str, list]:
    """Columns of PART for conversations (id, symbols, sizes) in order; see the module docstring."""
    distinct: list[tuple[list[int], list[int], list[int]]] = []
    for conv, symbols, sizes in rows:
        if distinct and distinct[-1][0] == symbols:
            distinct[-1][2].append(conv)
        else:
            distinct.append((symbols, sizes, [conv]))
    tree, ends, edges = TernaryTree(), {}, {}
    for i in median_first(len(distinct)):
        path = tree.insert(*distinct[i])
        ends[path[-1]] = distinct[i][2]
        if i in (0, len(distinct) - 1):
            edges[i] = path
    keys: dict[int, bytes] = {}
    for i, path in edges.items():
        digest = hashlib.sha256()
        for node, symbol in zip(path, [None, *distinct[i][0]]):
            if symbol is not None:
                digest.update(symbol.to_bytes(8, "little", signed=True))
            keys[node] = digest.digest()
    n = len(tree.symbol)
    children, leaves, saved = [0] * n, [0] * n, [0] * n
    order = tree.preorder()
    for node in reversed(order):
        if node in keys:
            # Itself is counted after merging.
            continue
        leaves[node] += children[node] == 0
        saved[node] += (tree.members[node] - 1) * tree.size[node]
        at = tree.parent[node]
        children[at] += 1
        leaves[at] += leaves[node]
        saved[at] += saved[node]
    # Boundary nodes pass what lies below them on to the boundary nodes above.
    for node in reversed(order):
        if node in keys and node:
            leaves[tree.parent[node]] += leaves[node]
            saved[tree.parent[node]] += saved[node]

    out: dict[str, list] = {f.split()[0]: [] for f in PART.split(", ")}

    def add(node: int, side: int, again: bool = False) -> None:
        above = tree.parent[node]
        inside = side < 0
        listed = "" if again else ",".join(map(str, ends.get(node, ())))
        values = {
            "shard": shard, "side": side, "key": keys.get(node), "parent_key": keys.get(above), "bytes": tree.size[node],
            "ends": hashlib.sha256(listed.encode()).hexdigest() if inside else listed,
            "conv_id": tree.lowest[node], "depth": tree.depth[node],
            "parent_conv_id": tree.lowest[above] if inside and above not in keys else None,
            "n_convs": 0 if again else tree.members[node], "n_children": 0 if again else children[node],
            "n_leaves": 0 if again else leaves[node], "saved_tokens": 0 if again else saved[node],
        }
        for name, value in values.items():
            out[name].append(value)

    for node in order:
        if node not in keys:
            add(node, -1)
    first = edges[0]
    for node in first:
        add(node, 0)
    if len(distinct) > 1:
        before = set(first)
        for node in edges[len(distinct) - 1]:
            add(node, 1, again=node in before)
    return out


def _build(shard_turns: int):
    schema = pa.schema(
        [("shard", pa.int64()), ("side", pa.int32()), ("key", pa.binary()), ("parent_key", pa.binary()),
         ("bytes", pa.int64()), ("ends", pa.string()), *[(f.split()[0], pa.int64()) for f in NODE.split(", ")]]
    )

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, rows, turns = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                rows.append(row)
                turns += len(row[1]) + 1
                if turns >= shard_turns:
                    yield from pa.table(_shard_rows(shard, rows), schema).to_batches(1 << 16)
                    shard, rows, turns = shard + 1, [], 0
        if rows:
            yield from pa.table(_shard_rows(shard, rows), schema).to_batches(1 << 16)

    return build


def _hash_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, digest of the joined lists, for rows sorted by key; a list is read piece by piece."""
    key, digest = None, None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([digest.hexdigest()])], names=["key", "ends_sha256"])

    for batch in batches:
        for of, ends in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if of != key:
                if digest is not None:
                    yield row()
                key, digest = of, hashlib.sha256(ends.encode())
            else:
                digest.update(f",{ends}".encode())
    if digest is not None:
        yield row()


def encode_turns(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """conv_id, pos (from 0), symbol, bytes.  Any conversation is numbered in parallel: by place in a range partition."""
    named = turns.select(
        col(conv_col).cast("bigint").alias("conv_id"), col(turn_col).alias("turn"), text_of(role_col).alias("role"),
        text_of(text_col).alias("text"), F.monotonically_increasing_id().alias("row"),
    ).where("conv_id IS NOT NULL")
    order = ["conv_id", "turn", "role", "text", "row"]
    digest = F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
    placed = pin(
        named.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select("conv_id", digest.alias("digest"), F.octet_length("text").cast("bigint").alias("bytes"),
                F.monotonically_increasing_id().alias("at"))
    )
    placed = placed.withColumn("part", F.shiftright("at", 33))
    runs = placed.groupBy("conv_id", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    # One row per partition that a conversation reaches into.
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("conv_id", "part", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")).alias("shift"))
    numbered = placed.join(runs, ["conv_id", "part"]).select(
        "conv_id", "digest", "bytes", "at", (F.col("at") + F.col("shift")).alias("pos")
    )
    dictionary = pin(
        placed.select("digest").distinct().withColumn("symbol", F.monotonically_increasing_id())
    )
    return lookup(numbered, dictionary, "digest", "at", how="inner").select("conv_id", "pos", "symbol", "bytes")


def sequences(encoded: DataFrame, place: Column | None = None) -> DataFrame:
    """conv_id, symbols, sizes: one row per conversation that has turns, its turns by `place` (default: pos)."""
    item = F.struct((F.col("pos") if place is None else place).alias("place"), "symbol", "bytes")
    listed = encoded.groupBy("conv_id").agg(F.sort_array(F.collect_list(item)).alias("turns"))
    return listed.select("conv_id", F.col("turns.symbol").alias("symbols"), F.col("turns.bytes").alias("sizes"))


def rebuilt(encoded: DataFrame, ids: DataFrame, every: int = 5, most: int = 9) -> DataFrame:
    """`encoded` turns as branches: c begins with the first h turns of c - c % `every` and goes on with its own after h.

    h is the CRC-32 of c's decimal number modulo `most`.  `ids` has one row per conversation.
    """

    def taken(conv: Column) -> Column:
        return F.crc32(conv.cast("string")) % most

    own = encoded.where(F.col("pos") >= taken(F.col("conv_id"))).withColumn("borrowed", F.lit(1))
    branches = F.transform(F.sequence(F.lit(0), F.lit(every - 1)), lambda i: F.col("base") + i)
    first = encoded.where((F.col("conv_id") % every == 0) & (F.col("pos") < most - 1)).withColumnRenamed("conv_id", "base")
    begun = first.withColumn("conv_id", F.explode(branches)).where(
        (F.col("pos") < taken(F.col("conv_id"))) & (F.col("conv_id") - F.col("conv_id") % every == F.col("base"))
    )
    begun = begun.join(ids, "conv_id", "left_semi").withColumn("borrowed", F.lit(0))
    names = ["conv_id", "borrowed", "pos", "symbol", "bytes"]
    return begun.select(*names).unionByName(own.select(*names))


def trie_nodes(listed: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """The nodes of the trie of `listed` (conv_id, symbols, sizes; one row per conversation, turnless ones too).

    Columns: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    """
    order = ["symbols", "conv_id"]
    parts = pin(
        pin(listed).select("conv_id", "symbols", "sizes").repartitionByRange(*order).sortWithinPartitions(*order)
        .mapInArrow(_build(shard_turns), PART)
    )
    inside, edges = parts.where("side < 0"), parts.where("side >= 0")
    counts = ["n_convs", "n_children", "n_leaves", "saved_tokens"]
    merged = edges.groupBy("key").agg(
        F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.min("parent_key").alias("parent_key"),
        F.max("bytes").alias("bytes"), F.min(F.struct("shard", "side")).alias("home"),
        *[F.sum(c).alias(c) for c in counts],
    )
    below = merged.groupBy(F.col("parent_key").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    merged = pin(
        merged.join(below, "key", "left")
        .withColumn("n_children", F.col("n_children") + F.coalesce("n", F.lit(0)))
        .drop("n")
    )
    # Per path from its end: what the nodes at home there add.
    own = merged.select(
        "key", "home", (F.col("n_children") == 0).cast("bigint").alias("leaf"),
        ((F.col("n_convs") - 1) * F.col("bytes")).alias("saving"),
    )
    at_home = F.col("home") == F.struct("shard", "side")
    upwards = Window.partitionBy("shard", "side").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    added = (
        edges.select("shard", "side", "key", "depth").join(own, "key")
        .select("key", *[F.sum(F.when(at_home, F.col(c)).otherwise(0)).over(upwards).alias(c) for c in ("leaf", "saving")])
        .groupBy("key").agg(F.sum("leaf").alias("leaf"), F.sum("saving").alias("saving"))
    )
    listed_ends = edges.where("ends <> ''").select("key", "ends", "shard", "side")
    hashed = (
        listed_ends.repartition("key").sortWithinPartitions("key", "shard", "side").select("key", "ends")
        .mapInArrow(_hash_ends, "key binary, ends_sha256 string")
    )
    parents = merged.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    names = ["conv_id", "depth", "parent_conv_id", *counts, "ends_sha256"]
    boundary = (
        merged.join(added, "key").join(hashed, "key", "left").join(parents, "parent_key", "left")
        .withColumns({
            "n_leaves": F.col("n_leaves") + F.col("leaf"),
            "saved_tokens": F.col("saved_tokens") + F.col("saving"),
            "ends_sha256": F.coalesce("ends_sha256", F.lit(_NOTHING)),
        })
        .select(*names)
    )
    # Nodes below a boundary node ask for its number in their own shard, so no key has more rows than a shard.
    of_shard = edges.select("shard", F.col("key").alias("parent_key")).distinct().join(parents, "parent_key")
    lower = inside.drop("parent_conv_id").where("parent_key IS NOT NULL").join(of_shard, ["shard", "parent_key"])
    deep = inside.where("parent_key IS NULL").unionByName(lower.select(*inside.columns))
    return deep.withColumn("ends_sha256", F.col("ends")).select(*names).unionByName(boundary)


def conversation_trie(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    branch: bool = False, shard_turns: int = SHARD_TURNS,
) -> DataFrame:
    """The trie of all conversations of `turns`, see `trie_nodes`; with `branch`, of those that `rebuilt` makes of them.

    Turns are ordered by `turn_col`, NULL first, ties by role and then text; repeated rows are turns of their own.  NULL
    role or text counts as empty.  A row without conversation id belongs to no conversation.  An empty table gives no
    rows.  Other columns are not read.
    """
    encoded = pin(encode_turns(turns, conv_col, turn_col, role_col, text_col))
    if not branch:
        return trie_nodes(sequences(encoded), shard_turns)
    ids = encoded.select("conv_id").distinct()
    listed = sequences(rebuilt(encoded, ids), F.struct("borrowed", "pos"))
    empty = F.array().cast("array<bigint>")
    every = ids.join(listed, "conv_id", "left").select(
        "conv_id", F.coalesce("symbols", empty).alias("symbols"), F.coalesce("sizes", empty).alias("sizes")
    )
    return trie_nodes(every, shard_turns)
