"""Operators on pages, the registered queries, and the pipeline."""

import datetime
import html
import os
import random
import re
import time

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from forecourt.llm import html_text, oracle, registry, url_lists


def test_article_of_every_page(spark, testdata):
    frame = registry.pages(spark, testdata)
    found = {r.page_id: r for r in html_text.extract_pages(frame).collect()}
    for r in frame.collect():
        article = r.html[r.html.index("<article>") : r.html.index("</article>")]
        blocks = [html.unescape(re.sub("<[^>]*>", "", b.replace("<br>", " "))) for b in re.split("<(?:p|h1)>", article)]
        expected = "\n\n".join(b for b in (" ".join(b.split()) for b in blocks) if b)
        assert found[r.page_id].text == expected and found[r.page_id].n_chars == len(expected)


PAGES = {
    "<nav>menu</nav><p>only</p><footer>c</footer>": "only",
    '<div class="cookie-notice">we</div><main><h1>T &amp; x</h1><p>one<p>two</main><div id="comments">bad</div>': (
        "T & x\n\none\n\ntwo"
    ),
    "<article><header><h1>T</h1></header><p>a&nbsp; b\n c<form>q<input></form><aside>s</aside><p>d</article>": (
        "T\n\na b c\n\nd"
    ),
    "<article><p>a<div class='comments'><p>bad</div><p>b</article><article class='comment'>no</article>": "a\n\nb",
    "<p>a<script>if (1 < 2) '</p>'</script>b<style>x{}</style><!-- c --> d": "ab d",
    "<article><p>one<b>two<br>three</article>": "onetwo three",
    "": "",
    None: "",
    "no markup at all": "no markup at all",
    "<p>broken <a href='x": "broken",
    "<article><p hidden>h<p style='display: none'>n<p>shown</article>": "shown",
    "<ul><li><a href=1>Home</a><li><a href=2>About us</a></ul><h1>Title</h1><p>" + "word " * 40 + "<p>Short.<p>"
    + "more " * 30 + "<ul><li><a href=3>Imprint</a></ul>": (
        "Title\n\n" + " ".join(["word"] * 40) + "\n\nShort.\n\n" + " ".join(["more"] * 30)
    ),
}


def test_page_shapes(spark):
    rows = [(i, None, page, "clash") for i, page in enumerate(PAGES)]
    frame = spark.createDataFrame(rows, "page_id int, url string, html string, text string")
    found = {r.page_id: r.text for r in html_text.extract_pages(frame).collect()}
    for i, (page, expected) in enumerate(PAGES.items()):
        assert found[i] == expected, page
    assert html_text.extract_pages(frame.where("false")).collect() == []


BODY = "<p>" + "long enough " * 15 + "<p>" + "to be a text " * 12
WRAPPERS = [
    '<div class="page with-sidebar"><article>{}</article></div>',
    '<div class="content has-sidebar">{}</div><div class="sidebar">side</div>',
    '<div id="layout-menu-left">{}</div>',
    "<form action=x>{}</form>",
    "<nav><ul><li><a href=1>Home</a></ul>{}",
    "<div>{}</div><article><p>one teaser</article>",
]


@pytest.mark.parametrize("wrapper", WRAPPERS)
def test_no_page_is_lost_to_its_wrapper(wrapper):
    body = " ".join(["long enough"] * 15) + "\n\n" + " ".join(["to be a text"] * 12)
    assert body in html_text.main_text(wrapper.format(BODY))


def test_pages_in_random_wrappers():
    rng = random.Random(11)
    layout = ["with-sidebar", "has-menu", "no-nav", "menu-left", "page-widgets", "ad-free", "site"]
    for _ in range(300):
        paragraphs = [" ".join(f"w{rng.randrange(99)}" for _ in range(rng.randrange(30, 80))) for _ in range(rng.randrange(2, 6))]
        page = "".join(f"<p>{p}</p>" for p in paragraphs)
        marked = rng.random() < 0.5
        page = f"<article>{page}</article>" if marked else page
        for _ in range(rng.randrange(4)):
            tag = rng.choice(["div", "form", "section"])
            page = f'<{tag} class="{rng.choice(layout)}">{page}</{tag}>' if tag != "form" else f"<form>{page}</form>"
        before = rng.choice(["", "<nav><a href=1>Home</a> <a href=2>Contact</a></nav>", '<div class="menu"><a href=1>x</a></div>'])
        after = rng.choice(["", "<footer>imprint</footer>", '<div class="comments"><p>' + "bad words " * 300 + "</div>", "<aside>more</aside>"])
        teaser = "" if marked else rng.choice(["", "<article><p>teaser</article>"])
        found = html_text.main_text(f"<body>{before}{page}{teaser}{after}</body>")
        assert "\n\n".join(paragraphs) in found and "bad words" not in found and "Home" not in found and "imprint" not in found


def test_windows_of_links_are_left_out_of_marked_text():
    links = "".join(f"<li><a href={i}>more of {i}</a>" for i in range(4))
    page = f"<article><p>{'one ' * 30}<ul>{links}</ul><p>{'two ' * 30}<p><a href=1>source</a></article>"
    assert html_text.main_text(page) == "\n\n".join([" ".join(["one"] * 30), " ".join(["two"] * 30), "source"])
    assert html_text.main_text(f"<article><ul>{links}</ul></article>").split("\n\n") == [f"more of {i}" for i in range(4)]
    assert html_text.main_text("<p><a href=1>only links</a>") == "only links"


def test_repeated_pages_give_equal_rows(spark):
    frame = spark.createDataFrame([(1, "u", "<p>a")] * 3 + [(None, None, None)] * 2, "page_id int, url string, html string")
    rows = html_text.extract_pages(frame).collect()
    assert sorted(r.text for r in rows) == ["", "", "a", "a", "a"]


def test_very_long_urls(spark):
    long = "https://" + "a." * 3000 + "example.com/" + "p/" * 500_000
    captures = spark.createDataFrame([(1, long), (2, "https://example.com/p/p/q")], "page_id int, url string")
    captures = captures.withColumn("fetched_on", F.lit("2024-05-01").cast("date"))
    changes = spark.createDataFrame(
        [("example.com", "add", "2024-01-01"), ("example.com/p/p/", "add", "2024-01-01")], "entry string, action string, day string"
    )
    started = time.perf_counter()
    found = {r.page_id: (r.n_active, r.entry) for r in url_lists.filter_captures(captures, changes).collect()}
    assert found == {1: (1, "example.com"), 2: (2, "example.com/p/p/")} and time.perf_counter() - started < 30


def test_interrupted_text_without_markers():
    rng = random.Random(7)
    for _ in range(200):
        page, expected = "<nav><ul><li><a href=1>Home</a><li><a href=2>About</a></ul></nav>", []
        for part in range(rng.randrange(1, 6)):
            # The first part is by far the longest, the others pass the surge or follow a text.
            block = [f"p{part}x{i} " + "word " * rng.randrange(1, 30) + "end." for i in range(rng.randrange(3, 9))]
            block += ["long " * 600] * (part == 0)
            expected += [" ".join(b.split()) for b in block]
            page += "".join(f"<p>{b}" for b in block)
            name = rng.choice(["div class='advert'", "form", "div id='newsletter'"])
            page += f"<{name}>" + "<p>buy this now</p>" * rng.randrange(1, 7) + f"</{name.split()[0]}>"
        ending = "A last line."
        assert html_text.main_text(page + f"<p>{ending}") == "\n\n".join([*expected, ending])


def test_regions_are_kept_by_density():
    body, links = "<p>" + "word " * 600, "<ul>" + "<li><a href=1>more of this</a>" * 4 + "</ul>"
    ending = "<p>" + "end " * 75
    listing = "".join(f"<li><a href=1>{'a title of something else ' * 3}</a> seen {i} times by all our readers" for i in range(4))
    found = html_text.main_text(body + links + ending + links + f"<ul>{listing}</ul>")
    assert found == " ".join(["word"] * 600) + "\n\n" + " ".join(["end"] * 75)


def test_main_with_a_teaser_in_an_article():
    teaser = "<article><p>A teaser card</article>"
    page = f"<p>around<main><h1>T</h1><p>the body<p>goes on{teaser}<p><a href=1>next</a></main>{teaser}"
    assert html_text.main_text(page) == "T\n\nthe body\n\ngoes on\n\nA teaser card\n\nA teaser card"


def test_broken_markup_takes_linear_time():
    for page in ('<a "' * 50_000, "<p>" * 50_000, "<!--" * 50_000, "<b>" * 50_000 + "</i>" * 50_000):
        assert html_text.main_text(page) == ""


def test_surge_and_dive():
    assert html_text.regions([0, 5, 90, 0, 3, 0, 0, 0, 100, 0], 80, 3) == [(1, 5), (8, 9)]
    assert html_text.regions([], 0, 3) == [] and html_text.regions([0, 0], 0, 3) == []


DAY = datetime.date(2024, 1, 10)


def _day(n):
    return DAY + datetime.timedelta(days=n)


@pytest.fixture(scope="module")
def changes(spark):
    rows = [
        ("Example.com", "add", DAY, 1),
        ("example.com", "add", _day(2), 1),
        ("example.com", "remove", _day(5), 1),
        ("example.com", "add", _day(9), 1),
        ("other.org/bad/", "add", DAY, 1),
        ("other.org", "add", _day(3), 1),
        ("other.org", "remove", _day(3), 1),
        (None, "add", DAY, 1),
        ("late.net", "add", None, 1),
        ("late.net", "unknown", DAY, 1),
    ]
    return spark.createDataFrame(rows, "entry string, action string, day date, blocked int")


def test_entries_active_at_fetch_time(spark, changes):
    rows = [
        (1, "http://a.b.EXAMPLE.com/x", _day(4)),
        (2, "http://example.com", _day(5)),
        (3, "https://example.com:80/", _day(9)),
        (4, "http://example.com", _day(-1)),
        (5, "http://notexample.com", _day(4)),
        (6, "http://other.org/bad/page?x", _day(1)),
        (7, "http://other.org/badly", _day(1)),
        (8, "http://u:p@www.other.org/", _day(3)),
        (9, None, DAY),
        (10, "nonsense", DAY),
        (11, "http://late.net/", DAY),
        (12, "http://example.com", None),
        (13, "http://other.org/bad/x", _day(8)),
        (13, "http://other.org/bad/x", _day(8)),
        (None, "http://example.com", DAY),
    ]
    frame = spark.createDataFrame(rows, "page_id int, url string, fetched_on date").selectExpr("*", "1 AS entry")
    done = {r.page_id: r for r in url_lists.filter_captures(frame, changes).collect()}
    assert len(done) == 14
    blocked = {i for i, r in done.items() if r.blocked}
    assert blocked == {1, 3, 6, 8, 13, None}
    assert (done[13].entry, done[13].n_active) == ("other.org/bad/", 2)
    assert url_lists.filter_captures(frame.where("false"), changes).collect() == []
    assert not any(r.blocked for r in url_lists.filter_captures(frame, changes.where("false")).collect())


@pytest.fixture(scope="module")
def views(testdata):
    connection = duckdb.connect()
    for table in ("documents", "pages", "benchmark", "conversations"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{testdata}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", oracle.oracle_sql())
def test_query_against_sql(spark, testdata, views, name):
    result = registry.queries()[name](spark, testdata)
    described = views.execute(oracle.oracle_sql()[name])
    names = [d[0] for d in described.description]
    assert sorted(names) == sorted(result.columns)
    assert sorted(map(repr, (tuple(r) for r in result.select(*names).collect()))) == sorted(
        map(repr, described.fetchall())
    )


def test_pipeline_stages(spark, testdata):
    docs = registry.documents(spark, testdata)
    texts = {r.doc_id: r.text for r in docs.collect()}
    frames = []
    for _, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, testdata).collect(), docs.schema) if len(frames) < 4 else stage(
            spark, docs, testdata
        )
        frames.append(docs)
    for frame in frames[:4]:
        assert frame.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = [{r.doc_id for r in f.collect()} for f in frames]
    assert ids[0] <= set(texts) and ids[1] <= ids[0] and ids[2] <= ids[1] and ids[3] == ids[2] == ids[4]
    kept = [r.text for r in frames[1].collect()]
    assert len(kept) == len(set(kept)) == len({r.text for r in frames[0].collect()})
    for r in frames[3].collect():
        assert not re.search(r"@mail\d\.example\.com", r.text) and r.n_chars == len(r.text)


def test_pipeline_on_an_empty_table(spark, tmp_path, testdata):
    registry.documents(spark, testdata).where("false").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_a_finished_pipeline_leaves_only_its_result(spark, testdata):
    folder = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(folder))
    result = corpus_pipeline.run(spark, testdata)
    new = [name for name in set(os.listdir(folder)) - before if name.startswith("corpus-pipeline")]
    assert len(new) == 1 and os.listdir(os.path.join(folder, new[0])) == ["4-packing"]
    assert result.count() > 0 and all("/4-packing/" in f for f in result.inputFiles())
