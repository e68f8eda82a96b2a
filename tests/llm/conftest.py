import pytest

WORDS = "the quick brown fox jumps over a lazy dog while seven wizards vex bold kings and many others watch from distant hills with quiet joy".split()


def text_of(seed: int, n: int) -> str:
    """n words, different for each seed, the same at each run."""
    return " ".join(WORDS[(seed * 7 + i * i * (seed % 5 + 1) + i // 3) % len(WORDS)] + ("s" if (i * seed) % 3 == 1 else "") for i in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty, blank, very long, repeated rows, no letters, and columns whose names clash with outputs."""
    rows = [
        (1, text_of(1, 120), "en", "a"), (1, text_of(1, 120), "en", "a"), (2, text_of(1, 120), "en", "a"), (3, text_of(3, 90), "de", None),
        (4, "", "en", "a"), (5, None, None, "a"), (6, " \n\t ", "en", "a"), (7, "12 34 !!", "de", "b"), (8, text_of(8, 30_000), "en", "b"),
        (9, "one two", "de", "b"), (10, "naïve café — 日本語 🎉 " * 30, "de", "b"), (None, text_of(3, 90), "en", "c"), (11, "x" * 50_000, "en", "b"),
    ]
    out = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for name in ("score", "n_words", "items", "spans", "kept", "ids", "n_tokens", "shard", "size", "predicted", "lang_pred", "n_chars"):
        out = out.selectExpr("*", f"'old' AS {name}")
    return out


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
