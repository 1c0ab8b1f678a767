import random

import pytest

#: Names that operators use inside or give to results.
CLASHES = ("spans", "score", "fp", "bands", "same", "place", "h1", "h2", "node", "root", "media", "tokens", "a", "b", "item", "items", "n_words", "component_id", "group_id", "lang_pred", "held_out", "k", "n", "first", "sequence_id", "x.y")


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows and columns of clashing names."""
    rng = random.Random(3)
    words = ["alpha", "beta", "Gamma", "delta,", "eps.", "ζήτα", "été", "straße"]
    long = " ".join(rng.choice(words) for _ in range(60_000))
    lines = "\n".join(f"line number {k} of the passage here" for k in range(8))
    texts = [None, "", " \n\t ", "one", "two words", long, long, lines, lines, "x\n" + lines + "\ny", "Mail bob@example.org or +1 (555) 123-4567 or 4111 1111 1111 1111 at 10.0.0.255"]
    rows = [(i, t, "en" if i % 2 else "fr", None if i == 3 else f"s{i % 2}", len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[7], rows[7], (None, "no id here at all", None, None, None), (None, None, None, None, None), (50, lines, None, "s0", 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES)
    return spark.createDataFrame([r + ("clash",) * len(CLASHES) for r in rows], schema).repartition(3).persist()


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.filter("false")
