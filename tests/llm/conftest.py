import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, part int, node string"


def prose(seed, n):
    """n invented words."""
    rng = random.Random(seed)
    parts = ["ta", "ri", "mon", "kel", "os", "ane", "ul", "dir", "pe", "sha", "lo", "vin"]
    return " ".join("".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def make_docs(spark):
    """A documents table from texts or (doc_id, text) pairs, with columns whose names clash with the operators' own."""

    def make(texts):
        rows = []
        for k, t in enumerate(texts):
            doc, text = t if isinstance(t, tuple) else (k, t)
            rows.append((doc, text, "en" if k % 2 else "de", None if k % 7 == 3 else f"s{k % 3}", None if text is None else len(text), k, "x"))
        return spark.createDataFrame(rows, DOCS)

    return make


@pytest.fixture(scope="session")
def odd_texts():
    """Nulls, empty and white texts, repeats, ties, a very long text."""
    long = prose(1, 60_000)
    return [None, "", " ", "\n", "word", "word", "a  b", " a", "a\n\nb", "\ta b\r\n c", "ö 漢字\n漢 x", "▁a b", "<s> </s>", "é 🙂🙂\n🙂", "12 34", long, long, prose(2, 300)]
