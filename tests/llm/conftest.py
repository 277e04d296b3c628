import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, size long, shard int, slot long, fp long, node long, tag long, spans string, ids string, score double, component_id long, bucket int, rank int, taken long"


def make(spark, rows):
    """Documents with extra columns whose names are those that operators use for their own."""
    filled = [(i, t, lang, s, None if t is None else len(t), 1, 2, 3, 4, 5, 6, "x", "y", 0.5, 7, 8, 9, 10) for i, t, lang, s in rows]
    return spark.createDataFrame(filled, COLUMNS)


def words(rng, n, pool=400):
    return " ".join(f"w{rng.randrange(pool)}" for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and blank texts, ties, repeated rows, near copies, and one very long text."""
    rng = random.Random(4)
    base = [words(rng, 60) for _ in range(12)]
    rows = [(i, t, "en", f"s{i % 3}") for i, t in enumerate(base)]
    rows += [(20, base[0], "en", "s0"), (21, base[0] + " tail", "en", None), (22, None, None, "s1"), (23, "", "en", "s2"), (24, " \t\n ", None, "s2")]
    rows += [(5, base[5], "en", "s2"), (5, base[6], "en", "s1"), (None, base[7], "en", "s0"), (25, "Ünï cødé ▁ x y " + "é" * 50, "fr", "s1"), (26, "one", "en", None)]
    rows += [(27, base[1][:200] + " " + base[2], "en", "s0"), (28, words(rng, 20_000, 3000), "en", "s1"), (29, "a a a a a a a a a a a a a a a a", "en", "s1")]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return make(spark, odd_rows).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return make(spark, [])


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").cache()
