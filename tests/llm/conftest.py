import random

import pytest

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, language="en"):
    stock = {"en": ["the", "and", "of", "thing", "with", "over", "Stone", "river", "light", "would"], "de": ["der", "und", "für", "über", "Straße", "nicht", "schön", "ein", "Wörter", "möchte"]}[language]
    return " ".join(rng.choice(stock) + rng.choice(["", "s", "ing", ".", ",", "-x"]) for _ in range(n))


def make_documents():
    rng = random.Random(5)
    texts = [words(rng, rng.randint(5, 120), rng.choice(["en", "de"])) for _ in range(40)]
    base = words(rng, 100)
    for i in range(6):  # near copies
        w = base.split(" ")
        w[rng.randrange(100)] = f"edit{i}"
        texts.append(" ".join(w))
    texts += [base, base, base.upper()]
    passage = words(rng, 30)
    texts += [f"{words(rng, 40)}\n{passage}\n{words(rng, 20)}" for _ in range(5)]
    texts += [
        None, None, "", "  \t\n ", "a", "!!! 123 ***", "\n\n\n", "Same line of text\nSame line of text\nshort", "x\n  SAME line of TEXT \t\nshort",
        "Released under the MIT\tLicense.\nLicensed under CC BY-NC-SA 4.0; apache license, version 2", "under the mit license under the mit license",
        "\U0001f600 émoji \x00 nul \U0001f468\u200d\U0001f469", " ".join(f"w{i}" for i in range(30_000)), "one two three four five six seven eight nine ten eleven",
    ]
    rows = [(3 * i, t, "de" if t and "und" in t else "en", f"s{i % 4}" if i % 9 else None, len(t or "")) for i, t in enumerate(texts)]
    rows[7] = (*rows[7][:2], None, *rows[7][3:])
    return rows


@pytest.fixture(scope="session")
def doc_rows():
    return make_documents()


@pytest.fixture(scope="session")
def docs(spark, doc_rows):
    return spark.createDataFrame(doc_rows, DOC_SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def odd_rows(doc_rows):
    """With rows repeated, one id for two texts, and null ids."""
    return [*doc_rows, doc_rows[41], doc_rows[41], (doc_rows[3][0], doc_rows[41][1], "en", "s1", 3), (None, doc_rows[42][1], "en", None, 1), (None, "alone and never seen before", None, None, 1), (None, None, None, None, None)]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """Extra columns have names that the operators use themselves."""
    clash = ["n_words", "labels", "score", "n_lines", "n_dropped", "spans", "items", "component", "rep", "shard", "slot", "taken", "extra", "epochs", "lang_pred", "host", "doc", "t", "n", "count"]
    df = spark.createDataFrame(odd_rows, DOC_SCHEMA).repartition(2)
    return df.selectExpr("*", *[f"'x' AS {c}" for c in clash])


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOC_SCHEMA)
