import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows(texts, start=0):
    return [(start + i, t, "en", f"s{i % 3}" if i % 5 else None, len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def hard_texts():
    """Nulls, empty and blank texts, ties, repeats, long and odd ones, and families of near copies."""
    rng = random.Random(3)
    words = ["alpha", "beta", "Gamma", "delta", "ein", "été", "日本", "x#y", "the", "of", "and", "long-ish"]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base, passage = line(160), line(70)
    texts = [None, "", " \t\n ", "one", "one two three", "One TWO three", "a" * 3000, "ab" * 900, base, base, base + " tail", base.replace("alpha", "omega", 3), base.replace("beta", "psi", 2)]
    texts += ["\n".join([line(12), passage, line(9), passage]), passage + "\n" + line(30), "\n\n" + line(20) + "\n\n" + line(55) + "\n" + line(3), "\n".join([line(8), line(30), line(25)] * 2)]
    texts += [line(rng.randint(1, 120)) for _ in range(14)] + [" ".join([base] * 30), line(5000)]
    texts += ["\n".join(rng.choice([passage, "short line", line(20)]) for _ in range(rng.randint(1, 8))) for _ in range(8)]
    return texts


@pytest.fixture(scope="session")
def hard_docs(spark, hard_texts):
    return spark.createDataFrame(rows(hard_texts), SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(spark):
    """Extra columns whose names the operators use themselves, a null id, and rows that repeat."""
    names = "block long, bin int, label string, id long, n long, size int, seq string, rank long, key string, guest boolean, removed_lines long, component_id long, copies string"
    extra = (1, 2, "l", 3, 4, 5, "s", 6, "k", True, 7, 8, "c")
    text = " ".join(f"w{i}" for i in range(80))
    data = [(1, text, "en", "a", 10), (1, text, "en", "a", 10), (2, text + " more", "en", None, 10), (None, "no id at all", None, "a", None), (None, text, None, "a", None)]
    return spark.createDataFrame([(*d, *extra) for d in data], f"{SCHEMA}, {names}")
