import pytest


@pytest.fixture(scope="session", autouse=True)
def shared_folder(spark, tmp_path_factory):
    """Stands in for the folder that a cluster names in spark.checkpoint.dir."""
    spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))


@pytest.fixture(scope="session")
def odd_documents(spark):
    """NULLs everywhere, empty and very long texts, ties, repeated rows, columns named like the operators' own."""
    words = " ".join(f"w{i % 977}x{i}" for i in range(60_000))
    shared = "one shared line that many of the pages have in common with each other\n"
    body = [shared + f"text number {i} " + " ".join(f"q{i}z{j}" for j in range(60)) for i in range(8)]
    rows = [
        (1, "", "en", "a", 0),
        (2, None, None, None, None),
        (3, words, "en", "a", len(words)),
        (4, words, "en", "a", len(words)),
        (4, words, "en", "a", len(words)),
        (None, "no id at all", "en", "b", 12),
        (None, "no id at all", "en", "b", 12),
        (7, "x" * 50_000, "en", None, 50_000),
        (8, " \t\n\n  ", "en", "b", 6),
        (9, "É ñ 你好 \U0001f600 mail bob@example.com, +1 (743) 555-3824 <|endoftext|>", "fr", "b", 50),
        *[(20 + i, b, "en", "c", len(b)) for i, b in enumerate(body)],
    ]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    frame = spark.createDataFrame(rows, schema)
    clashing = "kept keep_id fp key row host line removed _salt spans ids tail start shard component_id".split()
    return frame.selectExpr("*", *[f"'{c}' AS {c}" for c in clashing], "1 AS `a.b`")


@pytest.fixture(scope="session")
def no_documents(odd_documents):
    return odd_documents.where("false")
