import pytest

TEXTS = [
    None,
    "",
    " \t\n ",
    "one",
    "The cat sat on the mat and looked at the dog. " * 40,
    "The cat sat on the mat and looked at the dog. " * 40,
    "x" * 5000,
    "日本語、テスト。" * 50,
    "it's we'll don't 12ab34'd'd's <|endoftext|> end",
    "É öß ñ 😀 é́ \x1c\x85 mixed\r\nlines\n\n\nhere",
    " ".join(f"word{i % 997}" for i in range(20_000)),
]


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls, empty and long texts, repeats, a null and a repeated id, clashing columns."""
    rows = [(i if i != 3 else None, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(TEXTS)]
    rows.append((4, TEXTS[4], "en", "s", 1))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    extra = "kept binary, hash long, place int, score string, spans string, key string, item string, bucket int, id int"
    for part in extra.split(", "):
        name, kind = part.split()
        df = df.selectExpr("*", f"CAST(NULL AS {kind}) AS {name}")
    return df.coalesce(2)


@pytest.fixture(scope="session")
def nothing(docs):
    return docs.limit(0)
