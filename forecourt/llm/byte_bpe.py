"""Byte-level BPE with a segment tree over byte positions.

The tree's root is the smallest (rank, position) of all neighbouring pairs, so the next merge is read in constant time,
ties going to the left.  A merge changes the rank of the merged position and of its live left neighbour and removes the
right part's position: at most three point updates, each logarithmic.  A run of n bytes takes O(n log n) whatever it
holds, so a text without any word boundary is no special case.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forecourt.llm.frames import col, text_of

VOCABULARY = "byte_bpe_50k.tiktoken"
# Encoded pieces remembered per Python worker (two generations of this many), and the longest piece remembered; and the
# longest text whose pieces are listed at once.  Bounds on memory: results do not depend on them.
REMEMBERED = 250_000
REMEMBERED_CHARS = 48
LISTED_CHARS = 1 << 20
_NONE = 1 << 62


def vocabulary_path(name: str = VOCABULARY) -> str:
    return public_tokenizers.path(name)


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one piece: join the neighbours of lowest rank, leftmost first, until no pair has a rank."""
    n = len(piece)
    size = 1
    while size < n:
        size *= 2
    shift = n.bit_length()
    tree = [_NONE] * (2 * size)
    for i in range(n - 1):
        rank = ranks.get(piece[i : i + 2])
        if rank is not None:
            tree[size + i] = rank << shift | i
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b

    # start -> end of the token there; previous live start.
    end = list(range(1, n + 1))
    before = list(range(-1, n - 1))

    def put(i: int, value: int) -> None:
        k = size + i
        tree[k] = value
        k >>= 1
        while k:
            a, b = tree[2 * k], tree[2 * k + 1]
            low = a if a < b else b
            if tree[k] == low:
                return
            tree[k] = low
            k >>= 1

    def pair(i: int) -> int:
        """Rank and position of the token at `i` joined with the next one."""
        following = end[i]
        if following >= n:
            return _NONE
        rank = ranks.get(piece[i : end[following]])
        return _NONE if rank is None else rank << shift | i

    position = (1 << shift) - 1
    while (lowest := tree[1]) != _NONE:
        i = lowest & position
        gone = end[i]
        end[i] = end[gone]
        if end[i] < n:
            before[end[i]] = i
        put(gone, _NONE)
        put(i, pair(i))
        if before[i] >= 0:
            put(before[i], pair(before[i]))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : end[i]]])
        i = end[i]
    return ids


class Encoder:
    """Ranks, the pattern that cuts a text into pieces, and a bounded memory of encoded pieces."""

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as lines:
            pairs = (line.split() for line in lines if line.strip())
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.pieces = regex.compile(pattern)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        """Token ids as little-endian unsigned 32-bit integers."""
        if len(text) <= LISTED_CHARS:
            pieces = self.pieces.findall(text)
        else:
            pieces = (match.group() for match in self.pieces.finditer(text))
        return b"".join([self.known.get(p) or self._learn(p) for p in pieces])

    def _learn(self, piece: str) -> bytes:
        packed = self.older.get(piece)
        if packed is None:
            packed = self._packed(piece)
        if len(piece) <= REMEMBERED_CHARS:
            if len(self.known) >= REMEMBERED:
                self.older, self.known = self.known, {}
            self.known[piece] = packed
        return packed

    def _packed(self, piece: str) -> bytes:
        raw = piece.encode("utf-8", "surrogatepass")
        rank = self.ranks.get(raw)
        ids = merge(raw, self.ranks) if rank is None else [rank]
        return struct.pack(f"<{len(ids)}I", *ids)

    def decode(self, packed: bytes) -> bytes:
        tokens = self.tokens
        return b"".join([tokens[i] for (i,) in struct.iter_unpack("<I", packed)])


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    """One per Python worker."""
    return Encoder(path, pattern)


def encode_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    path: str | None = None,
    pattern: str = public_tokenizers.PATTERN,
    decoded: bool = False,
) -> DataFrame:
    """doc_id, ids (binary: little-endian unsigned 32-bit integers); one row per row of `docs`.

    With `decoded` also what the ids decode to, as binary, without a second pass.  `path` names a rank file that every executor has.  NULL text counts as empty and has no ids.  Whole texts are
    encoded, of any length.  Repeated rows give equal rows, an empty table none; other columns are not read.
    """
    file = path or vocabulary_path()

    @F.pandas_udf("ids binary, decoded binary" if decoded else "ids binary")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        run = encoder(file, pattern)
        for texts in batches:
            ids = [run.encode(t) for t in texts]
            out = {"ids": ids} | ({"decoded": [run.decode(i) for i in ids]} if decoded else {})
            yield pd.DataFrame(out, dtype=object)

    rows = docs.select(col(id_col).alias("doc_id"), encode(text_of(text_col)).alias("e"))
    return rows.select("doc_id", "e.*")


def decode_documents(encoded: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """`encoded` with `decoded` (binary), the bytes its ids stand for; NULL ids decode to nothing."""
    file = path or vocabulary_path()

    @F.pandas_udf("binary")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        run = encoder(file, pattern).decode
        for ids in batches:
            yield pd.Series([run(i or b"") for i in ids], dtype=object)

    return encoded.withColumn("decoded", decode("ids"))


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens and SHA-256 of ids and of decoded bytes."""
    return encoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
