import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
VOWELS = "aeiou"


def word(rng, n=900):
    k = rng.randrange(n) ** 2 // n
    return "".join("bcdfglmnprst"[k // 5 ** i % 12] + VOWELS[k // 3 ** i % 5] for i in range(1 + k % 3)) + str(k % 7) * (k % 5 == 0)


def prose(rng, n):
    return " ".join(word(rng) + ("." if rng.random() < 0.1 else "") for _ in range(n))


@pytest.fixture(scope="session")
def rng():
    return random.Random(7)


@pytest.fixture(scope="session")
def texts(rng):
    """(doc_id, text) rows with copies, near copies, shared passages, nulls, empties, ties and repeats."""
    passage = prose(rng, 70)
    rows = [(k, prose(rng, rng.choice([1, 4, 5, 30, 49, 50, 51, 120, 300]))) for k in range(60)]
    rows += [(100 + k, prose(rng, 40) + " " + passage + "\n" + prose(rng, 30)) for k in range(12)]
    base = prose(rng, 200).split(" ")
    for k in range(25):
        copy = list(base)
        for _ in range(k % 6):
            copy[rng.randrange(len(copy))] = word(rng)
        rows.append((200 + k, "  ".join(copy)))
    rows += [(300 + k, rows[70][1].upper() if k % 2 else rows[70][1]) for k in range(5)]
    rows += [(400, None), (401, ""), (402, " \n\t "), (403, "one"), (404, "one two three four"), (405, "One two three four"),
             (406, passage), (407, "x " * 400), (408, "don't <|endoftext|> été \U0001f600 漢字  x"), (None, passage),
             (None, None), (409, prose(rng, 4000)), (-5, prose(rng, 60))]
    return rows + [rows[3], rows[65], rows[65]]


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The rows as a table of several partitions."""
    rows = [(d, t, "en", "s", None if t is None else len(t)) for d, t in texts]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def odd_docs(docs):
    """Extra columns with the names that the operators use themselves."""
    from pyspark.sql import functions as F

    return docs.withColumns({n: F.lit(n) for n in (
        "words", "n_words", "kept", "row", "marks", "node", "component", "ids", "value", "size", "key", "a", "b", "host", "term",
        "places", "text_key", "first_doc", "gone_id", "licence", "digest", "part", "kind")})


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture(scope="session")
def sorted_rows():
    return rows_of
