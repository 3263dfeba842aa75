"""Periodic runs against brute force."""

import hashlib
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm import periodic_runs
from plumbline.llm.queries import looped


def brute(w):
    """All runs, from the stretches of equal words at every distance."""
    best = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(12, 2 * q) and j > i:
                best.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in best.items())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=90), st.integers(0, 40), st.integers(1, 30))
def test_all_runs(w, a, p):
    turned = w[:a] + [w[a + (i - a) % p] if a + (i - a) % p < len(w) else 9 for i in range(a, len(w))]
    for x in (w, turned):
        assert periodic_runs.runs_of(np.array(x, dtype=np.int64)) == brute(x)


def test_long_sequences():
    """Runs at large scales, where only the first words of a block are convolved; one word, repeated; two breaks."""
    rng = np.random.default_rng(1)
    w = rng.integers(0, 5000, 60_000)
    w[3000:] = w[3000 + (np.arange(57_000) % 19_000)]
    assert periodic_runs.runs_of(w) == [(3000, 57_000, 19_000)]
    w[30_000] = -1
    assert periodic_runs.runs_of(w) == []  # 27,000 and 30,000 words are less than two periods
    assert periodic_runs.runs_of(np.zeros(50_000, np.int64)) == [(0, 50_000, 1)]
    assert periodic_runs.runs_of(np.arange(50_000) % 7) == [(0, 50_000, 7)]


def test_transforms():
    rng = np.random.default_rng(2)
    for size, k in ((8, 2), (64, 8), (256, 32), (8192, 1024)):
        x, b = rng.integers(0, periodic_runs.PRIME, (3, size)), rng.integers(0, periodic_runs.PRIME, (3, k))
        got = periodic_runs.correlations(b.astype(float), x.astype(float)).astype(np.int64) % periodic_runs.PRIME
        for d in (0, 1, size - k):
            assert [int(v) for v in got[:, d]] == [sum(int(p) * int(q) for p, q in zip(r, s[d : d + k], strict=True)) % periodic_runs.PRIME for r, s in zip(b, x, strict=True)]


def expected(words):
    runs = brute(words)
    drop = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in sorted(runs, key=lambda r: (r[0], r[2])))
    kept = " ".join(x for i, x in enumerate(words) if i not in drop)
    return (len(runs), *(best and (*best, 1000 * best[1] // best[2]) or (None,) * 4), hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def test_rows(spark, hard_docs, hard_texts, no_docs, clashing):
    """Nulls, empty and very long texts, odd white space, repeated rows."""
    space = str.maketrans({c: " " for c in "\t\n\x0b\x0c\r"})
    words = [[x for x in (t or "").translate(space).split(" ") if x] for t in hard_texts]
    got = {r.doc_id: tuple(r)[1:] for r in periodic_runs.run_digests(hard_docs).collect()}
    small = [i for i, w in enumerate(words) if len(w) < 1500]
    assert len(got) == len(hard_texts) and [got[i] for i in small] == [expected(words[i]) for i in small]
    assert any(v[0] for v in got.values())
    assert periodic_runs.run_digests(no_docs).count() == 0
    odd = periodic_runs.run_digests(clashing.selectExpr("*", "'x' AS n_runs", "1 AS start", "2 AS period"))
    assert odd.count() == 5 and odd.where("n_runs = 0").count() == 5


def test_loops():
    rng = random.Random(4)
    for doc_id in [*range(60), -3, 10**15]:
        words = [str(rng.randrange(9)).encode() for _ in range(rng.randint(0, 50))]
        out = looped(doc_id, words)
        assert len(out) == len(words) and (out == words or __import__("zlib").crc32(str(doc_id).encode()) % 10 == 0)
    assert looped(None, [b"a", b"b"]) == [b"a", b"b"]
