"""Operators on documents: odd input, and results against brute force."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from tokenizers import Tokenizer

from forecourt.llm import byte_bpe, exact_dedup, line_dedup, oracle, packing, pii, quality, registry, simhash, token_counts
from forecourt.llm.components import connected

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def documents(spark, testdata):
    frame = registry.documents(spark, testdata)
    return frame, {r.doc_id: r.text for r in frame.collect()}


@pytest.fixture(scope="module")
def reference_encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


OPERATORS = {
    "packing": packing.pack_documents,
    "pii": pii.find_personal_data,
    "masked": pii.mask_documents,
    "simhash": simhash.near_duplicates,
    "simhash kept": simhash.drop_near_duplicates,
    "counts": token_counts.count_pieces,
    "lines": line_dedup.remove_site_lines,
    "lines removed": line_dedup.cleaned,
    "quality": quality.judge,
    "quality kept": quality.keep_good,
    "exact": exact_dedup.duplicate_groups,
    "exact kept": exact_dedup.drop_exact_duplicates,
    "bpe": byte_bpe.encode_documents,
}
SAME_COLUMNS = {"masked", "simhash kept", "lines removed", "quality kept", "exact kept"}
ROWS = {"pii": 18, "masked": 18, "simhash": 18, "counts": 18, "lines": 18, "quality": 18, "bpe": 18, "exact": 18}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(odd_documents, name):
    result = OPERATORS[name](odd_documents)
    rows = result.collect()
    assert len(rows) == ROWS.get(name, len(rows)) and rows
    if name in SAME_COLUMNS:
        assert result.columns == odd_documents.columns


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(no_documents, name):
    assert OPERATORS[name](no_documents).collect() == []


def test_quality_rejects_and_keeps(odd_documents):
    rows = {r.doc_id: r for r in quality.judge(odd_documents).collect() if r.doc_id}
    assert not rows[1].kept and not rows[2].kept and not rows[7].kept
    assert rows[3].kept and rows[3].n_repeat_words == 0
    assert rows[20].kept and rows[20].n_removed_words == 14
    kept = {r.doc_id: r for r in quality.keep_good(odd_documents).collect()}
    assert set(kept) == {3, 4, *range(20, 28)}
    assert kept[20].text.startswith("text number 0") and kept[20].n_chars == len(kept[20].text)


def test_near_copies_are_not_boilerplate(spark):
    def own(doc, n):
        return [" ".join(f"d{doc}l{i}w{w}" for w in range(12)) for i in range(n)]

    menu = "home about us contact imprint privacy"
    body = [" ".join(f"b{i}w{w}" for w in range(12)) for i in range(10)]
    # Copies with one line changed each, and documents of their own, on a host with a menu; five copies on a small host.
    copies = [(i, [menu, *body[: i % 10], *own(i, 1), *body[i % 10 + 1 :]], "large") for i in range(60)]
    others = [(100 + i, [menu, *own(100 + i, 10)], "large") for i in range(60)]
    small = [(200 + i, [*body, *own(200 + i, 1)], "small") for i in range(5)]
    # A page with little beside the menu of its host is still rejected.
    bare = [(300, [menu] * 10 + own(300, 2), "large")]
    rows = [(i, "\n".join(lines), host) for i, lines, host in copies + others + small + bare]
    found = {r.doc_id: r for r in quality.judge(spark.createDataFrame(rows, "doc_id int, text string, source string")).collect()}
    assert all(found[i].kept for i, *_ in copies + others + small)
    assert {found[i].n_removed_words for i, *_ in copies + others} == {6}
    assert {found[i].n_removed_words for i, *_ in small} == {0}
    assert found[300].n_removed_words == 60 and not found[300].kept


def _pages_of_hosts():
    """Hosts of template pages, of near copies, of both, and a large one with a line in few of its pages."""

    def words(name, n):
        return " ".join(f"{name}w{w}" for w in range(n))

    template = [words("t", 30), words("u", 30)]
    stubs = [[*template, words(f"stub{i}", 40)] for i in range(200)]
    long = [[words(f"long{i}x{j}", 40) for j in range(10)] for i in range(4)]
    body = [words(f"b{i}", 12) for i in range(10)]
    copies = [[*body[: i % 10], words(f"c{i}", 12), *body[i % 10 + 1 :]] for i in range(60)]
    rows = [("\n".join(p), "stubs") for p in stubs] + [("\n".join(p), "mixed") for p in stubs + long]
    rows += [("\n".join(p), "copies") for p in copies + long] + [("\n".join(p), "both") for p in copies + stubs]
    rows += [("\n".join([words(f"l{i}", 60), *(["a line of six thousand pages"] if i % 11 == 0 else [])]), "large") for i in range(6000)]
    rows += [(None, None), ("", "stubs"), ("  \n ", "copies"), *[(f"{words('n', 60)}\n{i}", None) for i in range(9)]]
    return [(i, text, host) for i, (text, host) in enumerate(rows)]


def test_template_pages_go_and_near_copies_stay(spark):
    rows = _pages_of_hosts()
    frame = spark.createDataFrame(rows, "doc_id int, text string, source string")
    found = {r.doc_id: r for r in quality.judge(frame).collect()}
    kept = defaultdict(list)
    for i, text, host in rows:
        kind = (text or "").split("w")[0].rstrip("0123456789x")
        kept[host, kind].append(found[i].kept)
    assert not any(kept["stubs", "t"]) and not any(kept["mixed", "t"]) and not any(kept["both", "t"])
    assert all(kept["mixed", "long"]) and all(kept["copies", "long"]) and all(kept["copies", "b"]) and all(kept["both", "b"])
    # 546 of 6,000 pages: under a tenth, but many.
    assert sum(found[i].n_removed_words for i, _, host in rows if host == "large") == 546 * 6


@pytest.mark.parametrize("made", [True, False])
def test_quality_agrees_with_its_sql(spark, testdata, made):
    connection = duckdb.connect()
    if made:
        columns = {n: [r[i] for r in _pages_of_hosts()] for i, n in enumerate(("doc_id", "text", "source"))}
        connection.register("made", pa.table(columns))
        connection.execute("CREATE VIEW documents AS SELECT doc_id::BIGINT AS doc_id, text, source FROM made")
        frame = spark.createDataFrame(_pages_of_hosts(), "doc_id bigint, text string, source string")
    else:
        connection.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{testdata}/documents.parquet')")
        frame = registry.documents(spark, testdata)
    judged = quality.judge(frame).drop("row", "removed")
    names = judged.columns
    expected = connection.execute(f"SELECT {', '.join(names)} FROM ({oracle.oracle_sql()['op8_quality']})").fetchall()
    assert Counter(map(tuple, judged.collect())) == Counter(expected)


def test_repeated_windows(spark):
    texts = ["a b c a b c d", "a a a a a", "a b", "x y z w x y z", ""]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")

    def covered(text):
        words = text.split()
        windows = defaultdict(list)
        for i in range(len(words) - 2):
            windows[tuple(words[i : i + 3])].append(i)
        return len({i + k for at in windows.values() if len(at) > 1 for i in at for k in range(3)})

    found = {r.doc_id: r.n_repeat_words for r in quality.word_metrics(frame).collect()}
    assert found == {i: covered(t) for i, t in enumerate(texts)}


def test_lines_removed_at_the_ratio(spark):
    rows = [(i, "Common  LINE\nown line %d" % i if i < 6 else "own only %d" % i, "h") for i in range(100)]
    frame = spark.createDataFrame(rows, "doc_id int, text string, source string")
    done = {r.doc_id: r for r in line_dedup.remove_site_lines(frame).collect()}
    assert done[0].text == "own line 0" and done[0].n_removed_lines == 1 and done[0].n_lines == 2
    assert done[50].text == "own only 50"
    few = line_dedup.remove_site_lines(frame, max_ratio=0.06).collect()
    assert sum(r.n_removed_lines for r in few) == 0


def test_exact_groups(odd_documents):
    rows = exact_dedup.duplicate_groups(odd_documents).collect()
    groups = {(r.doc_id, r.n_bytes): r for r in rows}
    one = [r for r in rows if r.doc_id in (3, 4)]
    found = sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in one)
    assert found == [(3, 4, 3, False), (4, 4, 3, False), (4, 4, 3, True)]
    empty = [groups[1, 0], groups[2, 0]]
    assert [(r.keep_id, r.group_size, r.kept) for r in empty] == [(2, 2, False), (2, 2, True)]
    assert sorted((r.group_size, r.kept) for r in rows if r.doc_id is None) == [(2, False), (2, True)]
    kept = exact_dedup.drop_exact_duplicates(odd_documents).collect()
    assert len(kept) == len({r.text or "" for r in odd_documents.collect()})


def test_only_rows_that_may_have_copies_are_moved(spark):
    rows = [(i, "x" * (i + 1), i) for i in range(50)] + [(60, "x" * 9, 60), (60, "x" * 9, 60), (None, "x" * 9, 61), (None, None, 62)]
    # Equal in id, length and prefix: of the second text, the copy with the larger id stays.
    rows += [(70, "y" * 300 + "a", 70), (70, "y" * 300 + "b", 71), (71, "y" * 300 + "b", 72)]
    frame = spark.createDataFrame(rows, "doc_id int, text string, n int")
    for bits in (64, exact_dedup.FILTER_BITS):
        left = exact_dedup.drop_exact_duplicates(frame, filter_bits=bits)
        assert left.columns == frame.columns
        assert sorted(r.n for r in left.collect()) == [*range(8), *range(9, 50), 60, 62, 70, 72]
    # The rows without a copy come straight from the scan.
    alone, moved = left._jdf.queryExecution().optimizedPlan().children().apply(0), left._jdf.queryExecution().optimizedPlan().children().apply(1)
    assert "Aggregate" not in alone.toString() and "Join" not in alone.toString() and "Aggregate" in moved.toString()


def test_many_equal_rows_are_many_rows(spark):
    frame = spark.range(10_000).selectExpr("1L AS doc_id", "'the same' AS text")
    rows = exact_dedup.duplicate_groups(frame).groupBy("doc_id", "keep_id", "group_size", "kept").count().collect()
    assert sorted(map(tuple, rows)) == [(1, 1, 10_000, False, 9_999), (1, 1, 10_000, True, 1)]
    assert exact_dedup.drop_exact_duplicates(frame).count() == 1


def test_one_document_of_each_component_stays(spark):
    base = [f"w{i}" for i in range(400)]

    def text(n):
        return " ".join([*base[:n], f"x{n}", *base[n + 1 :]])

    def other(n):
        return " ".join(f"o{n}x{i}" for i in range(60))

    rows = [(5, " ".join(base)), (None, " ".join(base)), (7, text(390)), (1, other(1)), (1, other(2)), (None, other(3))]
    rows += [(None, other(3)), (None, other(4)), (9, other(4)), (1, other(1))]
    frame = spark.createDataFrame(rows, "doc_id int, text string")
    component = simhash.near_duplicates(frame, max_bits=6, segments=8).collect()
    near = len({r.fingerprint for r in component if r.doc_id in (5, 7)})
    left = sorted((r.doc_id or 0, r.text) for r in simhash.drop_near_duplicates(frame, max_bits=6, segments=8).collect())
    assert near in (1, 2) and left == sorted([(5, rows[0][1]), (1, other(1)), (1, other(2)), (0, other(3)), (9, other(4))])


def test_null_ids_of_one_host(spark):
    rows = [(None, f"shared line here\nown {i}", "h") for i in range(40)] + [(3, "shared line here\nown x", "h")]
    frame = spark.createDataFrame(rows, "doc_id int, text string, source string")
    done = line_dedup.remove_site_lines(frame).collect()
    assert sorted(r.text for r in done) == sorted([f"own {i}" for i in range(40)] + ["own x"])


def test_lines_are_counted_in_one_shuffle_and_not_stored(spark, tmp_path):
    rows = [(i, "shared line here\nown %d" % i, "h" if i % 3 else None) for i in range(60)]
    frame = spark.createDataFrame(rows, "doc_id int, text string, source string")
    kept, context = spark.sparkContext.getCheckpointDir(), spark.sparkContext
    context.setCheckpointDir(str(tmp_path))
    try:
        done = line_dedup.remove_site_lines(frame)
        assert sorted(r.text for r in done.collect()) == sorted(f"own {i}" for i in range(60))
    finally:
        context.setCheckpointDir(kept)
    assert [p for p in tmp_path.rglob("*") if p.is_file()] == []
    assert "ReusedExchange" in done._jdf.queryExecution().executedPlan().toString()


def test_filter_collisions_change_nothing(documents):
    frame, texts = documents
    narrow = exact_dedup.duplicate_groups(frame, prefix_chars=3, filter_bits=64).collect()
    wide = exact_dedup.duplicate_groups(frame).collect()
    sizes = Counter(texts.values())
    for rows in (narrow, wide):
        assert {r.doc_id: r.group_size for r in rows} == {i: sizes[t] for i, t in texts.items()}


def _simhash(text):
    lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text)
    words = re.findall("[^\x20\x09-\x0d]+", lowered)
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def _components(values, near):
    label = {v: v for v in values}
    for a in values:
        for b in values:
            if a < b and near(a, b):
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = {k: new if v == old else v for k, v in label.items()}
    return label


@pytest.mark.parametrize("bucket_limit", [simhash.BUCKET_LIMIT, 1])
def test_simhash_against_brute_force(documents, bucket_limit):
    frame, texts = documents
    prints = {i: _simhash(t) for i, t in texts.items()}
    lowest = defaultdict(list)
    label = _components(sorted(set(prints.values())), lambda a, b: (a ^ b).bit_count() <= 2)
    for i, p in prints.items():
        lowest[label[p]].append(i)
    expected = {i: (f"{p:016x}", min(lowest[label[p]])) for i, p in prints.items()}
    found = simhash.near_duplicates(frame, bucket_limit=bucket_limit).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in found} == expected


@pytest.mark.parametrize("bucket_limit", [3, 65])
def test_links_have_the_closure_of_all_pairs(spark, bucket_limit):
    rng = random.Random(5)
    values = {rng.getrandbits(64) for _ in range(40)}
    for v in list(values)[:6]:
        for _ in range(25):
            values.add(v := v ^ sum(1 << rng.randrange(64) for _ in range(2)) & (1 << 64) - 1)
    signed = {v - (1 << 64) if v >> 63 else v for v in values}
    frame = spark.createDataFrame([(v,) for v in signed], "fp bigint")
    links = simhash.link_fingerprints(frame, bucket_limit=bucket_limit)
    roots = {r.vertex: r.root for r in connected(links).collect()}
    mask = (1 << 64) - 1
    label = _components(sorted(signed), lambda a, b: ((a & mask) ^ (b & mask)).bit_count() <= 2)
    assert {frozenset(k for k in signed if label[k] == x) for x in set(label.values())} == {
        frozenset(k for k in signed if roots.get(k, k) == x) for x in {roots.get(k, k) for k in signed}
    }


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001)], "a int, b int")
    roots = {r.vertex: r.root for r in connected(links).collect()}
    assert len({roots[i] for i in range(301)}) == 1 and roots[1000] == roots[1001] != roots[0]


def test_bpe_equals_the_library(documents, reference_encoding, odd_documents):
    frame, _ = documents
    for table in (frame, odd_documents):
        known = table.where("doc_id IS NOT NULL")
        done = byte_bpe.decode_documents(byte_bpe.encode_documents(known)).collect()
        both = byte_bpe.encode_documents(known, decoded=True).collect()
        assert sorted(map(tuple, both)) == sorted(map(tuple, done))
        texts = {r.doc_id: r.text or "" for r in table.collect()}
        for r in done:
            assert np.frombuffer(r.ids, "<u4").tolist() == reference_encoding.encode_ordinary(texts[r.doc_id])
            assert bytes(r.decoded) == texts[r.doc_id].encode()


def test_merge_is_leftmost_lowest_first():
    ranks = {bytes([c]): c for c in range(256)} | {b"ab": 300, b"ba": 299, b"aa": 301, b"aba": 302, b"abab": 303}
    rng = random.Random(1)
    for _ in range(300):
        piece = bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 14)))
        parts = [bytes([c]) for c in piece]
        while pairs := [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]:
            i = min(pairs)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        assert byte_bpe.merge(piece, ranks) == [ranks[p] for p in parts]


def test_memory_of_pieces_is_bounded(monkeypatch, reference_encoding):
    monkeypatch.setattr(byte_bpe, "REMEMBERED", 5)
    monkeypatch.setattr(byte_bpe, "LISTED_CHARS", 10)
    encoder = byte_bpe.Encoder(RANKS, public_tokenizers.PATTERN)
    text = " ".join(f"word{i} again" for i in range(200))
    assert np.frombuffer(encoder.encode(text), "<u4").tolist() == reference_encoding.encode_ordinary(text)
    assert len(encoder.known) <= 5 and len(encoder.older) <= 5


def test_packing_ids_and_layout(documents):
    frame, texts = documents
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    added = {-1: "mail <|endoftext|> end", -2: "<|endoftext|><|endoftext|>\n\n x  <|endofte", -3: ""}
    texts = texts | added
    more = frame.sparkSession.createDataFrame(list(added.items()), "doc_id bigint, text string")
    rows = packing.pack_documents(frame.select("doc_id", "text").unionByName(more), docs_per_shard=64).collect()
    sequences, covered = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
        covered[r.doc_id].append(r)
    for doc, pieces in covered.items():
        ids = np.array(tokenizer.encode(texts[doc], add_special_tokens=False).ids + [0], dtype="<u4")
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    assert set(covered) == set(texts)
    short = 0
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= packing.WINDOW
        short += at < packing.WINDOW
    assert short <= 1 + len(texts) // 16


def test_index_scores_are_bm25():
    docs = [np.array(d) for d in ([1, 2, 2, 3], [2, 4], [5, 5, 5], [1, 2, 3, 4, 5])]
    index = packing.InvertedIndex(docs)
    mean = np.mean([len(d) for d in docs])

    def score(query, doc):
        total = 0.0
        for t in set(query.tolist()):
            df = sum(t in d for d in docs)
            tf = (doc == t).sum()
            norm = packing.K1 * (1 - packing.B + packing.B * len(doc) / mean)
            total += np.log(1 + (len(docs) - df + 0.5) / (df + 0.5)) * tf * (packing.K1 + 1) / (tf + norm)
        return total

    for i, q in enumerate(docs):
        assert np.allclose(index.scores(i), [score(q, d) for d in docs])


def test_window_is_filled_with_the_closest():
    near, far = np.arange(100, 400), np.arange(900, 1200)
    windows = list(packing.fill_windows([near, far, near + 1, far + 1], window=600))
    assert [[doc for doc, _, _ in w] for w in windows] == [[0, 2], [1, 3]]


def test_neighbours_are_close_in_the_whole_corpus(spark):
    rng = np.random.default_rng(6)
    rare = [[f"{chr(97 + t % 26)}{rng.integers(10**6)}x" for _ in range(30)] for t in range(40)]
    common = [f"word{i}" for i in range(60)]
    # Every document has half its words from its topic; topics are dealt over the rows.
    texts = [" ".join([*rng.choice(rare[i % 40], 15), *rng.choice(common, 15)]) for i in range(960)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(7)
    windows = defaultdict(list)
    for r in packing.pack_documents(frame, window=512, docs_per_shard=48).collect():
        windows[r.sequence_id].append((r.offset, r.doc_id))
    encode = packing.encoding(RANKS).encode_ordinary
    index = packing.InvertedIndex([np.array(encode(t) + [0]) for t in texts])
    close = total = 0
    for pieces in windows.values():
        seed, *others = [doc for _, doc in sorted(pieces)]
        best = set(np.argsort(-index.scores(seed))[:24].tolist())
        close += len(best & set(others))
        total += len(others)
    assert total > 500 and close > 0.6 * total


def test_forgotten_documents_leave_the_others_scores():
    rng = np.random.default_rng(5)
    docs = [rng.integers(0, 60, rng.integers(1, 40)) for _ in range(30)]
    index, whole = packing.InvertedIndex(docs), packing.InvertedIndex(docs)
    gone = rng.random(30) < 0.5
    index.forget(gone)
    for i in np.flatnonzero(~gone):
        assert np.allclose(index.scores(i)[~gone], whole.scores(i)[~gone]) and not index.scores(i)[gone].any()


def test_equal_rows_fill_several_shards(spark):
    rows = [(1, "one and the same text")] * 300 + [(None, None)] * 100 + [(i, f"text {i}") for i in range(2, 50)]
    frame = spark.createDataFrame(rows, "doc_id int, text string")
    shards, tokens = defaultdict(int), 0
    for r in packing.pack_documents(frame, docs_per_shard=32).collect():
        shards[r.sequence_id >> 33] += r.start + r.length == r.doc_tokens
        tokens += r.length
    assert sum(shards.values()) == len(rows) and max(shards.values()) <= 32
    encode = packing.encoding(RANKS).encode_ordinary
    assert tokens == sum(len(encode(t or "")) + 1 for _, t in rows)


def _greedy(word, pieces):
    text, count, at = "▁" + word, 0, 0
    while at < len(text):
        ends = [e for e in range(len(text), at, -1) if text[at:e] in pieces and (at == 0) == (text[at] == "▁")]
        if not ends:
            return 0
        at, count = ends[0], count + 1
    return count


def test_piece_counts_are_greedy_longest_match(documents):
    pieces = token_counts.read_pieces(public_tokenizers.path(token_counts.VOCABULARY))
    automaton, known = token_counts.Automaton(pieces), set(pieces)
    rng = random.Random(2)
    words = {w for t in list(documents[1].values())[:60] for w in t.split()[:200]}
    words |= {"".join(rng.choice("abeé你-.#x") for _ in range(rng.randrange(1, 12))) for _ in range(500)}
    for word in words:
        assert automaton.count(word) == _greedy(word, known), word
    small = token_counts.Automaton(["▁a", "▁abcd", "b", "c", "bcx"])
    for word in ("a", "abc", "abcd", "abcx", "abcb", "abd", "b"):
        assert small.count(word) == _greedy(word, {"▁a", "▁abcd", "b", "c", "bcx"}), word


EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"


def _plain_spans(text):
    """The contract's patterns, literally."""
    spans = [("email", *m.span()) for m in re.finditer(EMAIL, text)]
    spans += [("ip", *m.span()) for m in re.finditer(IP, text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m.group() if c.isdigit()]
        odd = sum(digits[-1::-2]) + sum(sum(divmod(2 * d, 10)) for d in digits[-2::-2])
        if 13 <= len(digits) <= 19 and odd % 10 == 0:
            spans.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
            spans.append(("phone", *m.span()))
    return spans


def test_base_spans_are_the_patterns(documents):
    rng = random.Random(3)
    made = ["".join(rng.choice("a.@1-+ 9()%b.@") for _ in range(rng.randrange(80))) for _ in range(4000)]
    made += ["1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "a@b@c.d@e.f", "x" * 300 + "@a.b", "+12 (345) 678-90"]
    for text in [*documents[1].values(), *made]:
        assert pii.base_spans(text) == _plain_spans(text), text


def test_base_digest_and_spans(documents):
    frame, texts = documents
    for r in pii.digests(pii.find_personal_data(frame)).collect():
        base = ",".join(f"{k}:{i}:{j}" for k, i, j in _plain_spans(texts[r.doc_id]))
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert set(filter(None, base.split(","))) <= set(r.spans.split(","))


def test_weak_supervision_adds_likely_and_leaves_unlikely(spark):
    sure = [(i, f"write a mail to bob{i}@example.com or call +1 (743) 555-38{i % 100:02d} now") for i in range(200)]
    loose = [(1000, "please call (743) 555-3824 now"), (1001, "mail jane (at) example (dot) com")]
    never = [(2000, "serial x743-555-3824y"), (2001, "order id 043-155-3824")]
    frame = spark.createDataFrame(sure + loose + never, "doc_id int, text string")
    spans = {r.doc_id: [(s.kind, s.base) for s in r.spans] for r in pii.find_personal_data(frame).collect()}
    assert spans[1000] == [("phone", False)] and spans[1001] == [("email", False)]
    assert spans[2000] == [] and spans[2001] == []
    masked = {r.doc_id: r.text for r in pii.mask_documents(frame).collect()}
    assert masked[1000] == "please call <PHONE> now" and masked[2000] == never[0][1]
    assert masked[0] == "write a mail to <EMAIL> or call <PHONE> now"


def test_reliabilities_recover_the_truth():
    rng = np.random.default_rng(4)
    truth = rng.random(4000) < 0.4
    right = [0.9, 0.85, 0.7, 0.6, 0.8]
    votes = np.stack([np.where(rng.random(4000) < p, truth, ~truth) * 2 - 1 for p in right], axis=1)
    votes[rng.random(votes.shape) < 0.2] = 0
    p = pii.aggregate_votes(np.zeros(4000, dtype=int), votes, np.ones(4000))
    assert ((p > 0.5) == truth).mean() > 0.9
    x = pii.features(np.zeros(4000, dtype=int), votes, np.zeros((4000, 4)))
    w = pii.fit_classifier(x, p, np.ones(4000))
    assert (((x @ w) > 0) == truth).mean() > 0.9
