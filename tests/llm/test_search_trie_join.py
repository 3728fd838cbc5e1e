"""Jaccard join, conversation trie and ranked search: brute force, SQL, odd rows."""

import hashlib
import math
import random
import re
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import compare  # noqa: E402

from forecourt.llm import conversation_trie, frames, jaccard_join, lexical_search, oracle, registry  # noqa: E402

QUERIES = ("op11_jaccard_join", "op12_conversation_trie", "op13_ranked_search")


@pytest.mark.parametrize("name", QUERIES)
def test_query_gives_the_rows_of_its_sql(spark, testdata, name):
    connection = duckdb.connect()
    for table in ("documents", "benchmark", "conversations"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{testdata}/{table}.parquet')")
    assert compare.difference(registry.queries()[name](spark, testdata), connection, oracle.oracle_sql()[name]) is None


# Jaccard join


def _shingles(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return frozenset(" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))) if words else frozenset()


def _linked(sets, percent):
    """The least place of each set's component."""
    label = list(range(len(sets)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                x, y = find(i), find(j)
                label[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(sets))]


def _near_copies(rng, n, words, edits):
    base = [f"w{rng.randrange(5000)}" for _ in range(words)]
    for _ in range(n):
        copy = list(base)
        for _ in range(rng.randrange(edits)):
            copy[rng.randrange(words)] = f"e{rng.randrange(10**6)}"
        yield " ".join(copy)


@pytest.mark.parametrize("percent, sketch_bits", [(90, 20), (90, 14), (60, 16)])
def test_components_of_near_copies(spark, percent, sketch_bits):
    rng = random.Random(percent + sketch_bits)
    texts = [t for words, edits in ((60, 4), (200, 12), (400, 20)) for t in _near_copies(rng, 150, words, edits)]
    passage = " ".join(f"p{i}" for i in range(90))
    texts += [f"{passage} " + " ".join(f"o{i}x{j}" for j in range(rng.randrange(9))) for i in range(150)]
    texts += ["One two", "one TWO", "one", "", "  \n", *rng.sample(texts, 20)]
    rng.shuffle(texts)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(5)
    found = {r.doc_id: r for r in jaccard_join.linked_documents(frame, percent=percent, sketch_bits=sketch_bits).collect()}
    sets = [_shingles(t) for t in texts]
    assert [found[i].component_id for i in range(len(texts))] == _linked(sets, percent)
    assert [found[i].n_shingles for i in range(len(texts))] == [len(s) for s in sets]


def test_sets_move_only_of_groups_that_ask_or_are_asked(spark, monkeypatch):
    made = []

    def bitmap_of(keys, bits):
        made.append((keys.columns, keys.distinct().count(), frames.bitmap_of(keys, bits)))
        return made[-1][2]

    monkeypatch.setattr(jaccard_join, "bitmap_of", bitmap_of)
    rng = random.Random(7)
    texts = [t for _ in range(30) for t in _near_copies(rng, 12, 60, 4)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(5)
    for bits in (64, jaccard_join.GROUP_BITS):
        monkeypatch.setattr(jaccard_join, "GROUP_BITS", bits)
        found = {r.doc_id: r.component_id for r in jaccard_join.linked_documents(frame).collect()}
        assert [found[i] for i in range(len(texts))] == _linked([_shingles(t) for t in texts], 90)
    assert [columns for columns, _, _ in made] == [["group_q"], ["group"]] * 2
    assert all(0 < sum(map(int.bit_count, bitmap)) <= groups for _, groups, bitmap in made)


def test_links_are_not_stored_by_the_tasks_that_find_them(spark, monkeypatch):
    """What a task stores is a file, for which its executor starts a child."""
    stored = []

    def pin(df):
        stored.append((df.columns, df._jdf.queryExecution().sparkPlan().toString()))
        return frames.pin(df)

    monkeypatch.setattr(jaccard_join, "pin", pin)
    rng = random.Random(11)
    texts = [t for _ in range(12) for t in _near_copies(rng, 12, 60, 4)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(5)
    found = {r.doc_id: r.component_id for r in jaccard_join.linked_documents(frame).collect()}
    assert [found[i] for i in range(len(texts))] == _linked([_shingles(t) for t in texts], 90)
    within, across = [plan for columns, plan in stored if columns == ["a", "b"]]
    assert "REPARTITION_BY_COL" in within.splitlines()[0]
    assert "FlatMapCoGroupsInArrow" in across and "Join" in across


def test_groups_are_bounded(monkeypatch):
    class Context:
        @staticmethod
        def get():
            return Context

        @staticmethod
        def partitionId():
            return 3

    monkeypatch.setattr(jaccard_join, "TaskContext", Context)
    monkeypatch.setattr(jaccard_join, "GROUP_TOKENS", 4000)
    rng = np.random.default_rng(1)
    sizes = [10] * 200 + [9000] + [1500] * 5
    sets = [np.unique(rng.integers(0, 1 << 62, n, dtype=np.uint64)) for n in sizes]
    rows = [{"key": jaccard_join.set_key(s), "tokens": s.astype("<u8").tobytes()} for s in sets for _ in range(2)]
    batches = [pa.RecordBatch.from_pylist(rows[i : i + 37]) for i in range(0, len(rows), 37)]
    sketch = np.zeros(1 << 8, dtype=np.uint32)
    packed = [r for b in jaccard_join._groups(90, sketch, 8)(iter(batches)) for r in b.to_pylist()]
    assert [k for r in packed for k in r["keys"]] == [r["key"] for r in rows[::2]]
    assert len({r["group"] for r in packed}) == len(packed)
    for r in packed:
        held = [len(b) // 8 for b in r["sets"]]
        assert len(held) <= jaccard_join.GROUP_SETS and (len(held) == 1 or sum(held) <= 4000)
        assert (r["least"], r["most"]) == (min(held), max(held)) and not r["a"]


def test_join_of_odd_rows(odd_documents, no_documents):
    rows = jaccard_join.linked_documents(odd_documents).collect()
    assert len(rows) == 18
    by_id = {r.doc_id: r for r in rows}
    assert by_id[4].component_id == 3 and by_id[3].n_shingles == 59_998
    assert [by_id[i].component_id for i in (1, 2, 8)] == [1, 2, 8] and by_id[2].n_shingles == 0
    assert [r.component_id for r in rows if r.doc_id is None] == [None, None]
    assert jaccard_join.linked_documents(no_documents).collect() == []


# Conversation trie


def _trie(sequences):
    """Nodes from all prefixes of conversation -> turns."""
    members, ends = defaultdict(list), defaultdict(list)
    for conv, turns in sequences.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(conv)
        ends[tuple(turns)].append(conv)
    out = []
    for prefix, convs in members.items():
        below = [p for p in members if p[: len(prefix)] == prefix]
        leaves = [p for p in below if not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in below)]
        out.append((
            min(convs), len(prefix), min(members[prefix[:-1]]) if prefix else None, len(convs),
            sum(len(q) == len(prefix) + 1 for q in below), len(leaves),
            sum((len(members[p]) - 1) * len(p[-1][1].encode()) for p in below if p),
            hashlib.sha256(",".join(map(str, sorted(ends[prefix]))).encode()).hexdigest(),
        ))
    return Counter(out)


def _conversations(rng, n):
    rows = []
    for conv in range(n):
        opening = rng.choice(["hi", "hé", ""])
        for turn in range(rng.randrange(7)):
            rows.append((conv * 3 % n, turn, "user" if turn % 2 == 0 else None, rng.choice([opening, "a", "b"])))
    return rows


def _ordered(rows):
    found = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            found[conv].append(((turn is not None, turn or 0), role or "", text or ""))
    return {c: [t[1:] for t in sorted(turns)] for c, turns in found.items()}


@pytest.mark.parametrize("shard_turns", [1, 7, 60, 1 << 17])
def test_trie_of_any_sharding(spark, shard_turns):
    rows = _conversations(random.Random(8), 150)
    rows += [(1000 + i, t, "user", f"copied {t}") for i in range(40) for t in range(4)]
    frame = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string").repartition(6)
    found = conversation_trie.conversation_trie(frame, shard_turns=shard_turns).collect()
    assert Counter(map(tuple, found)) == _trie(_ordered(rows))


def test_branches(spark):
    rows = _conversations(random.Random(9), 120) + [(500, t, "user", "only") for t in range(3)] + [(502, 0, "user", "x")]
    frame = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    own = _ordered(rows)
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = own.get(c - c % 5, [])[:h] + own[c][h:]
    assert any(not turns for turns in built.values())
    found = conversation_trie.conversation_trie(frame, branch=True, shard_turns=20).collect()
    assert Counter(map(tuple, found)) == _trie(built)


def test_trie_of_odd_rows(spark):
    schema = "text string, turn int, shard string, key string, conv_id bigint, role string"
    rows = [
        ("a", 0, "s", "k", 1, None), ("a", 0, "s", "k", 1, None), ("a", None, "s", "k", 1, "r"), (None, 1, "s", "k", 2, ""),
        ("", None, None, None, 2, None), ("x" * 50_000, 1, "s", "k", 7, "r"), ("lost", 1, "s", "k", None, "r"),
        *[(f"t{i}", i, "s", "k", 9, "r") for i in range(3000)],
    ]
    frame = spark.createDataFrame(rows, schema)
    own = _ordered([(r[4], r[1], r[5], r[0]) for r in rows])
    short = {c: t for c, t in own.items() if c != 9}
    deep = [r for r in conversation_trie.conversation_trie(frame, shard_turns=100).collect() if r.conv_id == 9]
    assert sorted(r.depth for r in deep) == list(range(1, 3001)) and {r.n_leaves for r in deep} == {1}
    assert {r.parent_conv_id for r in deep if r.depth > 1} == {9}
    rest = conversation_trie.conversation_trie(frame.where("conv_id <> 9 OR conv_id IS NULL")).collect()
    assert Counter(map(tuple, rest)) == _trie(short)
    assert conversation_trie.conversation_trie(frame.where("false"), branch=True).collect() == []


def test_median_insertion_balances_siblings():
    tree = conversation_trie.TernaryTree()
    for i in conversation_trie.median_first(1023):
        tree.insert([i], [1], [i])

    def height(node):
        return 1 + max(height(s) if s else 0 for s in (tree.less[node], tree.more[node]))

    assert height(tree.child[0]) == 10 and sorted(tree.preorder()) == list(range(1024))


# Ranked search


def _ranked(docs, items, k=10):
    terms = {i: Counter(re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))) for i, t in docs}
    sizes = {i: sum(c.values()) for i, c in terms.items()}
    n_docs, total = sum(n > 0 for n in sizes.values()), sum(sizes.values())
    df = Counter(t for c in terms.values() for t in c)
    out = []
    for item, text in items:
        asked = set(re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")))
        scores = []
        for doc, counts in terms.items():
            m = 10 + (90 * sizes[doc] * n_docs) // total if total else 0
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * counts[t]) // (1000 * counts[t] + 8 * m)) for t in asked & set(counts))
            if s > 0:
                scores.append((-s, doc))
        out += [(item, r, d, -s) for r, (s, d) in enumerate(sorted(scores)[:k], 1)]
    return out


@pytest.mark.parametrize("docs_per_block", [1, 7, 4096])
def test_search_with_ties_and_blocks(spark, docs_per_block):
    rng = random.Random(docs_per_block)
    words = [f"W{i}é" for i in range(40)] + ["the", "THE", "a1"]
    docs = [(i, " ".join(rng.choices(words, weights=[1] * 40 + [20, 10, 5], k=rng.randrange(30)))) for i in range(300)]
    docs += [(1000 + i, docs[5][1]) for i in range(30)] + [(2000, None), (2001, ""), (2002, "...")]
    items = [(i, " ".join(rng.sample(words, rng.randrange(8)))) for i in range(25)] + [(99, None), (98, "unseen"), (97, "the The")]
    frame = spark.createDataFrame(docs, "doc_id int, text string").repartition(5)
    asked = spark.createDataFrame(items, "item_id int, text string")
    found = lexical_search.search_documents(frame, asked, docs_per_block=docs_per_block).collect()
    assert sorted(map(tuple, found)) == sorted(_ranked(docs, items))


def test_queries_pass_in_blocks(spark, monkeypatch):
    docs = [(i, f"word{i % 7} text{i % 3} common") for i in range(60)]
    items = [(i, f"word{i % 7} common text{i % 3}") for i in range(11)]
    monkeypatch.setattr(lexical_search, "ITEMS_PER_PASS", 4)
    frame, asked = spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(items, "item_id int, text string")
    assert sorted(map(tuple, lexical_search.search_documents(frame, asked).collect())) == sorted(_ranked(docs, items))


def test_treap_is_the_grid():
    rng = np.random.default_rng(3)
    cells = np.unique(rng.integers(0, 200 * 70, 900))
    rows, cols, impacts = cells // 70, cells % 70, rng.integers(0, 50, len(cells))
    grid = np.zeros((200, 70), dtype=np.int64)
    grid[rows, cols] = impacts
    treap = lexical_search.Treap.load(lexical_search.Treap.pack(rows, cols, impacts, 8))
    assert treap.best[0] == impacts.max()
    asked = [(np.array([1, 5, 9]), np.array([3, 2, 7])), (np.array([0]), np.array([1])), (np.arange(150), np.ones(150, np.int64))]
    starts = np.cumsum([0, *[len(r) for r, _ in asked]])
    found = treap.search(starts, np.concatenate([r for r, _ in asked]), np.concatenate([w for _, w in asked]), 5, np.zeros(3))
    for i, (r, w) in enumerate(asked):
        scores = (grid[r] * w[:, None]).sum(axis=0)
        least = max(1, np.sort(scores)[-5])
        assert {(c, s) for j, c, s in zip(*map(np.ndarray.tolist, found)) if j == i} == {(c, s) for c, s in enumerate(scores.tolist()) if s >= least}


def test_search_of_odd_rows(spark, odd_documents, no_documents):
    items = spark.createDataFrame([(1, "shared line", "x"), (None, "bob mail", "x"), (1, "shared line", "y")], "item_id int, text string, doc_id string")
    found = lexical_search.search_documents(odd_documents, items).collect()
    assert [(r.rank, r.doc_id) for r in found if r.item_id == 1] == [(i + 1, 20 + i) for i in range(8)]
    assert [(r.rank, r.doc_id) for r in found if r.item_id is None] == [(1, 9)]
    none = spark.createDataFrame([(1, "no id")], "item_id int, text string")
    assert sorted((r.rank, r.doc_id is None) for r in lexical_search.search_documents(odd_documents, none).collect()) == [(1, True), (2, True)]
    assert lexical_search.search_documents(no_documents, items).collect() == []
    assert lexical_search.search_documents(odd_documents, items.where("false")).collect() == []
