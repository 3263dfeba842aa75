"""Base patterns against the plain ones, the tagger against slow sums, and what it finds in texts it has not seen."""

import hashlib
import itertools
import re
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm import personal_data, sequence_tagger
from plumbline.llm.common import table
from plumbline.llm.personal_data import KINDS, WIDTH

SF = "/root/testdata/sf0.01"
#: The patterns as the contract states them.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes_luhn(digits):
    d = [int(c) for c in digits[::-1]]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def base_brute(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else False, "card": 14 <= len(digits) <= 19 and passes_luhn(digits) if digits else False, "phone": 10 <= len(digits) <= 15}[kind]
            if good:
                out.append((kind, *m.span()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def base_of(text):
    raw = text.encode()
    return personal_data.in_order(personal_data.in_characters(raw, personal_data.base_spans(raw)))


@settings(max_examples=600, deadline=None)
@given(st.lists(st.sampled_from(["a", "B", "7", "42", ".", "..", "@", "-", " ", "é", "+", "+1", "(555)", "555-0100 ", "1.2.3", "300", "4111111111111111", "4111 1111-1111 1111", "x@y.z", "%", "\n", "_"]), max_size=16))
def test_base_spans(parts):
    assert base_of("".join(parts)) == base_brute("".join(parts))


def test_base_spans_take_linear_time():
    began = time.time()
    for text in ("a" * 400_000, "@" * 200_000, "1" * 400_000, "1." * 200_000, "1 " * 200_000, "a@" * 200_000, "+1" * 200_000, "+1" + " " * 400_000, "a@b." * 100_000):
        personal_data.base_spans(text.encode())
    assert time.time() - began < 20


def test_windows_own_every_character_near_an_anchor():
    for text in ("x" * 500 + "7" + "y" * 500, "5", "@" + "é" * 47, "a" * 47 + "@" + "b" * 200, "none at all", ""):
        starts = personal_data.window_starts(text).tolist()
        owned = {i for s in starts for i in range(s + personal_data.MARGIN, s + personal_data.MARGIN + personal_data.OWN)}
        for m in personal_data.ANCHOR.finditer(text):
            assert set(range(max(0, m.start() - personal_data.OWN), min(len(text), m.start() + personal_data.OWN))) <= owned
        for s in starts:
            shown = personal_data.window_text(text, s)
            assert len(shown) == WIDTH and all(shown[i - s] == text[i] for i in range(max(s, 0), min(len(text), s + WIDTH)))
        assert bool(starts) == bool(personal_data.ANCHOR.search(text))


def small_tagger():
    allowed = np.array([[1, 1, 0], [1, 1, 1], [1, 1, 1], [1, 1, 0]], dtype=bool)
    tagger = sequence_tagger.new_tagger(allowed, 4, 1)
    for name in ("inputs", "hidden", "outputs", "bias", "steps"):
        setattr(tagger, name, getattr(tagger, name).astype(np.float64))
    tagger.steps += np.random.default_rng(3).normal(size=(3, 3))
    return tagger


def test_tagger_decodes_the_best_path():
    tagger = small_tagger()
    x = np.random.default_rng(0).integers(0, 131, (5, 6))
    scores = tagger.emissions(x)

    def score(row, path):
        if not tagger.allowed[-1][path[0]] or not all(tagger.allowed[a][b] for a, b in itertools.pairwise(path)):
            return -np.inf
        return sum(scores[row, t, k] for t, k in enumerate(path)) + sum(tagger.steps[a, b] for a, b in itertools.pairwise(path))

    for row, got in enumerate(tagger.decode(x)):
        assert tuple(got) == max(itertools.product(range(3), repeat=6), key=lambda p: score(row, p))


def test_tagger_gradients():
    tagger, rng = small_tagger(), np.random.default_rng(0)
    x, tags = rng.integers(0, 131, (3, 7)), np.array([[0, 0, 1, 2, 2, 0, 1], [1, 1, 2, 0, 0, 0, 0], [0, 1, 0, 1, 2, 2, 2]])
    _, slopes = tagger.gradients(x, tags)
    for p, slope in zip(tagger.learned, slopes, strict=True):
        for i in [tuple(rng.integers(0, n) for n in p.shape) for _ in range(6)] + ([(0, x[0, 0], 2), (1, x[1, 3], 9)] if p is tagger.inputs else []):
            if p is tagger.steps and not tagger.allowed[i]:
                continue
            was = p[i]
            p[i] = was + 1e-3
            up = tagger.gradients(x, tags)[0]
            p[i] = was - 1e-3
            down = tagger.gradients(x, tags)[0]
            p[i] = was
            assert abs((up - down) / 2e-3 - slope[i]) < 2e-3


@pytest.fixture(scope="module")
def tagger(spark):
    return personal_data.fit(table(spark, SF, "documents"))


def found(spark, tagger, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r for r in personal_data.find(docs, tagger).collect()}
    return [rows[i] for i in range(len(texts))]


def values(row, text):
    return [(k, text[int(a) : int(b)]) for k, a, b in (s.split(":") for s in row.spans.split(",") if s)]


def test_other_ways_to_write(spark, tagger):
    """Values that no base pattern matches, in words that the tagger has not seen."""
    want = [("email", "some.body(at)mail7(dot)example(dot)com"), ("email", "oner.41 [at] mail2 [dot] example [dot] com"), ("ip", "114[.]203[.]152[.]12"), ("ip", "11(.)123(.)15(.)12"),
            ("card", "4111/1111/1111/1111"), ("card", "5500_0000_0000_0004"), ("phone", "(830) 555-5433"), ("phone", "001-830-555-5433"), ("phone", "830-555-5433")]
    lead = ["the river runs ", "Nothing of this is known. ", "ask for it by "]
    texts = [f"{a}{v} and so on, for the time being" for _, v in want for a in lead]
    hits = [(k, v) in values(r, t) for r, t, (k, v) in zip(found(spark, tagger, texts), texts, [w for w in want for _ in lead], strict=True)]
    assert not any(base_of(t) for t in texts) and sum(hits) >= 0.8 * len(hits)


def test_values_that_the_base_drops(spark, tagger):
    texts = [f"the rest of it {a} {b} for words" for a, b in (("+1 (569) 555-6633", "4795326016703902"), ("+1 (314) 555-6532", "4663622617512349"), ("+1 (269) 555-3296", "4524132264652876"))]
    hits = [x in values(r, t) for r, t in zip(found(spark, tagger, texts), texts, strict=True) for x in (("phone", t[15:32]), ("card", t[33:49]))]
    assert not any(base_of(t) for t in texts) and sum(hits) >= 5


def test_clean_texts_stay_clean(spark, tagger):
    rng = np.random.default_rng(77)
    texts = [f"this is a text of words {personal_data.harmless(rng)} and {personal_data.harmless(rng)} with more words here" for _ in range(400)]
    assert sum(len(values(r, t)) > len(base_of(t)) for r, t in zip(found(spark, tagger, texts), texts, strict=True)) <= 8


def test_whole_table(spark, tagger):
    """Base columns of every document against the plain patterns; what is added touches no base span."""
    docs = table(spark, SF, "documents")
    got = {r.doc_id: r for r in personal_data.find(docs, tagger).collect()}
    for r in docs.collect():
        spans, row = base_brute(r.text or ""), got[r.doc_id]
        listed = [f"{k}:{a}:{b}" for k, a, b in spans]
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [sum(s[0] == k for s in spans) for k in KINDS]
        assert row.base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest()
        every = [s for s in row.spans.split(",") if s]
        assert set(listed) <= set(every)
        for kind, a, b in (s.split(":") for s in every if s not in listed):
            assert kind in KINDS and not any(x < int(b) and int(a) < y for _, x, y in spans)


def test_nulls_ties_and_small_tables(spark, tagger, hard_docs, hard_texts, no_docs, clashing):
    rows = {r.doc_id: r for r in personal_data.find(hard_docs, tagger).collect()}
    assert len(rows) == len(hard_texts) and rows[0].spans == rows[1].spans == "" and rows[0].base_sha256 == hashlib.sha256().hexdigest()
    assert personal_data.fit(no_docs) is None and personal_data.personal_data(no_docs).count() == 0
    assert personal_data.fit(hard_docs) is None  # no labelled window, and so base spans only
    odd = clashing.selectExpr("*", "'x' AS spans", "1 AS n_email", "'y' AS stratum", "2 AS bin")
    assert personal_data.find(odd, tagger).count() == 5 and personal_data.personal_data(odd).count() == 5
    long = "7" * 300_000 + " a@b.cd " + "y" * 300_000
    assert personal_data.find(spark.createDataFrame([(None, long)] * 2, "doc_id long, text string"), tagger).select("doc_id", "spans").collect() == [(None, "email:300001:300007")] * 2


def test_the_same_tagger_again(spark, tagger):
    again = personal_data.fit(table(spark, SF, "documents").repartition(5))
    assert all(np.allclose(p, q, atol=1e-4) for p, q in zip(tagger.learned, again.learned, strict=True))
