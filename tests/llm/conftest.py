import random

import pytest

WORDS = "alpha beta gamma delta kappa sigma omega river stone cloud ember flame harbor island jungle meadow north orbit prairie quartz raven summit timber valley winter".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", ",", "."]) for _ in range(n))


def make_rows():
    """(doc_id, text, lang, source, n_chars): prose, copies, near copies, a chain of edits, nulls, blanks and a long text."""
    rng = random.Random(5)
    texts = [prose(rng, rng.randint(30, 120)) for _ in range(60)]
    texts += [texts[3]] * 25 + [texts[4].upper()]
    base = prose(rng, 100).split()
    for _ in range(12):  # each is one more edit away
        base = list(base)
        base[rng.randrange(100)] = rng.choice(WORDS) + "x"
        texts.append(" ".join(base))
    texts += ["one two", "one two", "One  TWO", "", None, "   \n\t ", "a", prose(rng, 15_000), "日本語 тест naïve café ǰ İ 🙂 x", "<|endoftext|> a<|endoftext|>b"]
    return [(10 + 3 * k, t, "en" if k % 4 else None, f"s{k % 3}" if k % 9 else None, None if t is None else len(t)) for k, t in enumerate(texts)]


@pytest.fixture(scope="session")
def rows():
    return make_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)


@pytest.fixture(scope="session")
def clash(docs):
    """The documents with columns whose names the operators use inside."""
    from pyspark.sql import functions as F

    names = ("rep", "key", "comp", "found", "blob", "host", "position", "length", "block", "nth", "part", "kept", "_id", "_key", "a", "b", "centre", "role", "ids")
    return docs.withColumns({n: F.lit("clash") for n in names})


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
