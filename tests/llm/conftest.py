import pytest


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls in every column, empty and long texts, ties, repeated rows and
    columns whose names operators use themselves."""
    long_text = " ".join(f"word{k % 4001} and" for k in range(60_000))
    rows = [
        (1, "one two three four five six seven", "en", "a", 33, 0),
        (2, None, "en", "a", None, 1),
        (3, "", None, None, 0, 2),
        (4, " \t\n", "de", "b", 3, 3),
        (None, "lost id with words", "en", None, 18, 4),
        (5, long_text, "en", "a", len(long_text), 5),
        (6, "tie tie tie", "en", "b", 11, 6),
        (7, "tie tie tie", "en", "b", 11, 6),
        (7, "tie tie tie", "en", "b", 11, 6),
        (8, "ÄÖÜ éè 😀 x", "fr", "c", 10, 7),
    ]
    names = "doc_id long, text string, lang string, source string, n_chars long, size int"
    df = spark.createDataFrame(rows, names)
    clash = ("n_words", "spans", "target", "sid", "kept", "_text", "may_assign", "ids", "stratum", "block", "root")
    for name in clash:
        df = df.withColumn(name, df["size"])
    return df


@pytest.fixture(scope="session")
def no_docs(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")
