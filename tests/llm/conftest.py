"""Small documents with the awkward cases: nulls, empty and long texts, repeats, clashing names."""

import random

import pytest

WORDS = "the of and in to a is for on with river stone cloud paper market winter garden letter".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + (rng.choice(["", "", "s", ",", "."])) + rng.choice(["", "", "\n"]) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    rng = random.Random(1)
    texts = [prose(rng, rng.randint(1, 120)) for _ in range(60)]
    near = [texts[k] + " extra" for k in range(0, 20, 2)]
    rows = [(i, t, rng.choice(["en", "fr", None]), f"s{i % 3}") for i, t in enumerate(texts + near + texts[:5])]
    rows += [(900, None, "en", "s0"), (901, "", "en", "s0"), (902, " \n\t ", None, None), (903, "one", "en", "s1")]
    rows += [(904, prose(rng, 6000), "fr", "s1"), (3, texts[3], "en", "s0"), (None, texts[4], "en", None), (None, "quite alone here", "en", "s2")]
    rows += [(905, "# * $ % " * 30, "en", "s0"), (906, "same line again\n" * 40, "en", "s0"), (907, "É ÉTÉ 12ab!! don't\x85x", "fr", "s2")]
    return rows


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    return spark.createDataFrame(odd_rows, "doc_id long, text string, lang string, source string")


@pytest.fixture(scope="session")
def clashing(odd_docs):
    """The same rows with columns whose names the operators use for their own."""
    from pyspark.sql import functions as F

    names = ["score", "predicted", "fp", "label", "text_hash", "component_id", "length", "n_words", "base", "found", "kept", "lang_pred", "_scan", "start"]
    return odd_docs.select("*", *[F.lit("x").alias(n) for n in names])
