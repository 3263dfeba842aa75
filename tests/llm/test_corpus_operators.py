"""Operators on the whole corpus, against brute force."""

import collections
import hashlib
import re
import time

import numpy as np
import pyarrow as pa
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from plumbline.llm import blobs, line_dedup, ngram_join, quality_rules, substring_dedup
from plumbline.operators.graphs import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))


def line_brute(texts, least):
    """Texts without the lines of any run of least words or more that starts earlier too; lines without a word are no
    part of runs and stay."""
    seen, out = set(), []
    for text in texts:
        lines = (text or "").split("\n")
        real = [x for x in lines if WORD.search(x)]
        sizes = [len(WORD.findall(x)) for x in real]
        gone = set()
        for i in range(len(real)):
            for j in range(i + 1, len(real) + 1):
                if sum(sizes[i:j]) >= least:
                    run = tuple(real[i:j])
                    if run in seen:
                        gone.update(range(i, j))
                    seen.add(run)
        kept, k = [], 0
        for x in lines:
            if WORD.search(x):
                if k not in gone:
                    kept.append(x)
                k += 1
            else:
                kept.append(x)
        out.append((None if text is None else "\n".join(kept), len(gone)))
    return out


def test_line_dedup(hard_docs, hard_texts, no_docs, clashing):
    got = {r.doc_id: (r.text, r.removed_lines) for r in line_dedup.dedup_lines(hard_docs).collect()}
    assert [got[i] for i in range(len(hard_texts))] == line_brute(hard_texts, line_dedup.MIN_WORDS)
    assert line_dedup.dedup_lines(no_docs).count() == 0
    odd = line_dedup.dedup_lines(clashing)
    assert sorted(odd.columns) == sorted(clashing.columns)
    by = collections.Counter((r.doc_id, bool(r.text)) for r in odd.collect())
    assert by == {(None, True): 2, (1, False): 2, (2, True): 1}  # the null id comes first and keeps its text


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.sampled_from(["a b c", "d e", "f", "a b c d e f g", "", " "]), max_size=9), min_size=1, max_size=7))
def test_line_runs(spark, lists):
    texts = ["\n".join(x) for x in lists]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.text, r.removed_lines) for r in line_dedup.dedup_lines(docs, 7).collect()}
    if len({(i, t) for i, t in enumerate(texts)}) == len(texts):
        assert [got[i] for i in range(len(texts))] == line_brute(texts, 7)


def test_copies_of_long_texts():
    """A copied text of many MB loses its lines without a set of all places."""
    text = "\n".join(f"line {i} of a long text" for i in range(400_000))
    batch = pa.RecordBatch.from_pydict({"_row": [1, 2], "_text": [text, text], "_spans": [None, [{"seq": 0, "need": 399_999}]], "_copy": [2, 1]})
    began = time.time()
    (out,) = line_dedup.rewriter(50)([batch])
    assert out.column("_text").to_pylist() == ["", "line 399999 of a long text"] and out.column("_removed").to_pylist() == [400_000, 399_999] and time.time() - began < 20


def byte_brute(texts, length):
    seen, out = set(), []
    for text in texts:
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for i in range(len(data) - length + 1):
            piece = data[i : i + length]
            if piece in seen:
                gone[i : i + length] = True
            seen.add(piece)
        kept = bytes(np.frombuffer(data, np.uint8)[~gone])
        out.append((len(data), int(gone.sum()), int(gone[:1].sum()) + int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def test_substring_dedup(hard_docs, hard_texts, no_docs, clashing):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substring_dedup.dedup_substrings(hard_docs).collect()}
    assert [got[i] for i in range(len(hard_texts))] == byte_brute(hard_texts, 100)
    assert substring_dedup.dedup_substrings(no_docs).count() == 0
    rows = substring_dedup.dedup_substrings(clashing).collect()
    assert len(rows) == 5 and sorted(r.n_removed > 0 for r in rows) == [False, False, True, True, True]


def test_long_texts_in_pieces(spark, monkeypatch):
    rng = np.random.default_rng(1)
    part = "".join(chr(97 + int(x)) for x in rng.integers(0, 26, 700))
    texts = [part * 3, "".join(chr(97 + int(x)) for x in rng.integers(0, 3, 3000)), "q" * 1500, part[100:600]]
    monkeypatch.setattr(substring_dedup, "CHUNK", 256)
    whole = substring_dedup.Parse(np.frombuffer(texts[0].encode(), np.uint8), np.array([0, 2100]), 100, 40)
    starts = np.concatenate([np.arange(a, b + 1) for a, b in zip(whole.low, whole.high, strict=True)])
    assert sorted(starts) == list(range(2001))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substring_dedup.dedup_substrings(docs).collect()}
    assert [got[i] for i in range(4)] == byte_brute(texts, 100)


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text("ab", max_size=60), min_size=1, max_size=8))
def test_substrings_of_two_letters(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substring_dedup.dedup_substrings(docs, 12, 5).collect()}
    assert [got[i] for i in range(len(texts))] == byte_brute(texts, 12)


def join_brute(texts, n, percent):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = []
    for text in texts:
        w = WORD.findall((text or "").translate(low))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                p, q = find(i), find(j)
                parent[max(p, q)] = min(p, q)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def test_jaccard_join(hard_docs, hard_texts, no_docs, clashing):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_join(hard_docs).collect()}
    assert [got[i] for i in range(len(hard_texts))] == join_brute(hard_texts, 4, 85)
    assert ngram_join.jaccard_join(no_docs).count() == 0
    rows = ngram_join.jaccard_join(clashing).collect()
    assert sorted((r.doc_id, r.component_id) for r in rows if r.doc_id) == [(1, 1), (1, 1), (2, 1)] and sum(r.component_id is None for r in rows) == 2
    first = ngram_join.first_of_each(clashing)
    assert first.columns == clashing.columns and sorted(str(r.doc_id) for r in first.collect()) == ["1", "1", "None", "None"]


def test_chains_and_families(spark):
    """Families in which neighbours link and ends don't, some joined only through one member."""
    rng = np.random.default_rng(5)
    texts = []
    for f in range(12):
        words = [f"f{f}w{i}" for i in range(int(rng.integers(8, 90)))]
        for _ in range(int(rng.integers(1, 14))):
            texts.append(" ".join(words))
            at = rng.integers(0, len(words), size=max(1, len(words) // 60))
            words = [f"{w}x" if i in at else w for i, w in enumerate(words)]
    texts = [texts[i] for i in rng.permutation(len(texts))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for percent in (85, 60):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_join(docs, 4, percent).collect()}
        assert [got[i] for i in range(len(texts))] == join_brute(texts, 4, percent)


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.sampled_from("abcde"), max_size=14), min_size=1, max_size=14))
def test_small_sets(spark, lists):
    texts = [" ".join(x) for x in lists]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_join(docs, 2, 60).collect()}
    assert [got[i] for i in range(len(texts))] == join_brute(texts, 2, 60)


def test_prefix_tree_is_exact():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 40, size=rng.integers(1, 30))).astype(np.uint64) << np.uint64(16) for _ in range(80)]
    for percent in (50, 85):
        tree = ngram_join.PrefixTree([(ngram_join.packed(s), len(s), i) for i, s in enumerate(sets)])
        for s in sets[:20]:
            got = set(tree.probe(ngram_join.packed(s), len(s), percent))
            assert got == {i for i, x in enumerate(sets) if 100 * len(set(s) & set(x)) >= percent * len(set(s) | set(x))}


def test_subtrees_are_passed_over():
    """Of 4,000 sets with one passage in common a probe looks at few, not at all."""
    rng, looked = np.random.default_rng(4), []
    sets = [np.concatenate([np.arange(40), 1000 + np.sort(rng.choice(60, 6, False))[:, None] * 30 + np.arange(30)], axis=None).astype(np.uint64) << np.uint64(16) for _ in range(4000)]

    class Counted(list):
        def __getitem__(self, i):
            looked.append(i)
            return super().__getitem__(i)

    tree = ngram_join.PrefixTree([(ngram_join.packed(s), len(s), i) for i, s in enumerate(sets)])
    tree.paths = Counted(tree.paths)
    assert 7 in set(tree.probe(ngram_join.packed(sets[7]), len(sets[7]), 85)) and len(looked) < 1500


def test_unlinked_sets_in_chunks(spark):
    """Sets of common passages, which share prefix n-grams but are not near, in groups cut in many chunks."""
    rng = np.random.default_rng(6)
    passages = [" ".join(f"p{k}w{i}" for i in range(12)) for k in range(16)]
    texts = [" ".join(passages[k] for k in sorted(rng.choice(16, 6, False))) for _ in range(150)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for chunk in (300, 1 << 20):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_join(docs, 4, 85, stored=chunk, probing=chunk // 2).collect()}
        assert [got[i] for i in range(len(texts))] == join_brute(texts, 4, 85)


def thue_morse(n, swap):
    return "".join("a " [(bin(i).count("1") + swap) & 1] for i in range(n))


def test_strings_that_collide_in_polynomials(spark):
    """Complementary Thue-Morse strings have equal polynomial hashes modulo 2^64, whatever the base is."""
    texts = [thue_morse(1024, 0) + "a", thue_morse(1024, 1) + "a", "x y " + thue_morse(2048, 0).replace(" ", "b") + " z", "x y " + thue_morse(2048, 1).replace(" ", "b") + " z", thue_morse(1024, 0) + "a\n" + thue_morse(1024, 1) + "a"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.text, r.removed_lines) for r in line_dedup.dedup_lines(docs).collect()}
    assert [got[i] for i in range(5)] == line_brute(texts, 50) and got[1][1] == 0
    joined = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_join(docs).collect()}
    assert [joined[i] for i in range(5)] == join_brute(texts, 4, 85)
    assert {r.doc_id: r.n_dup_lines for r in quality_rules.statistics(docs).collect()}[4] == 0
    removed = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substring_dedup.dedup_substrings(docs).collect()}
    assert [removed[i] for i in range(5)] == byte_brute(texts, 100)


def test_lines_of_equal_hashes(monkeypatch):
    monkeypatch.setattr(quality_rules, "span_hashes", lambda data, start, end: np.zeros(len(start), np.uint64))
    lines = ["a", "b", "a", "c", "b", "a"]
    data = np.frombuffer("".join(lines).encode(), np.uint8)
    assert quality_rules.equal_before(data, np.arange(6), np.arange(1, 7), np.array([0, 0, 0, 0, 1, 1])).tolist() == [False, False, True, False, False, False]


def test_suffix_array_is_lexicographic():
    rng = np.random.default_rng(3)
    data = rng.integers(0, 2, 500).astype(np.uint8)
    for length in (3, 8, 12, 100):
        start = rng.permutation(500 - length)
        order, new = substring_dedup.suffix_array(data, start, length)
        strings = [data[start[i] : start[i] + length].tobytes() for i in order]
        assert strings == sorted(strings) and new.tolist() == [True] + [a != b for a, b in zip(strings, strings[1:])]
        assert all(i < j for i, j, fresh in zip(order, order[1:], new[1:]) if not fresh)


def test_strings_of_common_triggers(spark):
    """A line that all documents have, each between texts of its own; dealt out as phrases and string by string."""
    rng = np.random.default_rng(8)
    line = " ".join(f"common{i}" for i in range(25))
    own = lambda: "".join(chr(97 + int(x)) for x in rng.integers(0, 26, int(rng.integers(10, 90))))
    texts = [own() + line + own() for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for hot in (0, 3, 4096):
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substring_dedup.dedup_substrings(docs, hot=hot).collect()}
        assert [got[i] for i in range(60)] == byte_brute(texts, 100)


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40) if i % 9] + [(50, 3)], "a long, b long")
    ids = spark.range(60).withColumnRenamed("id", "id")
    got = {r.id: r.label for r in components(ids, links).collect()}
    assert got[8] == 1 and got[9] == 1 and got[17] == 10 and got[50] == 1 and got[59] == 59 and got[0] == 0


def blocks_of(docs, size):
    from plumbline.llm.common import id_blocks

    return [(r.doc_id, r.block) for r in id_blocks(docs, size).orderBy("doc_id").collect()]


def test_blocks_follow_the_ids(spark):
    ids = [None, -(1 << 63), -5, 0, 1, 2, 3, (1 << 63) - 1]
    docs = spark.createDataFrame([(i, "x" * 100) for i in ids] + [(4, None)], "doc_id long, text string")
    for size in (1, 50, 10_000):
        got = blocks_of(docs, size)
        assert len(got) == 9 and [b for _, b in got] == sorted(b for _, b in got)
    assert len({b for _, b in blocks_of(docs, 1)}) == 9


def test_bounds_are_the_keys_that_blocks_begin_with(spark):
    from plumbline.llm.common import block_bounds, id_blocks

    docs = spark.createDataFrame([(i * 7 % 500, f"{i} " + "x" * (i % 90)) for i in range(500)], "doc_id long, text string")
    bounds = sorted((r.number, r.id) for r in block_bounds(docs, 700).collect())
    begun = {}
    for r in id_blocks(docs, 700).collect():
        begun[r.block] = min(begun.get(r.block, r.doc_id), r.doc_id)
    assert [n for n, _ in bounds] == list(range(1, len(bounds) + 1)) and len(bounds) > 30
    assert sorted(begun.items()) == [(0, 0), *bounds]


def test_bucket_cuts():
    rng = np.random.default_rng(4)
    for n, buckets in ((0, 8), (1, 8), (200, 7), (50, 10**6)):
        hashes = np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64))
        asked = blobs.ask(3, 0, hashes, buckets, np.arange(len(hashes), dtype=np.uint8))
        assert b"".join(asked.column("hashes").to_pylist()) == hashes.tobytes() and asked.column("block").to_pylist() == [3] * len(asked)
        assert asked.column("bucket").to_pylist() == sorted(set(blobs.bucket_of(hashes, buckets).tolist()))
        replies = pa.table({"bucket": asked.column("bucket"), "flow": asked.column("flow"), "bits": [np.frombuffer(x, np.uint64).astype(np.uint32).tobytes() for x in asked.column("hashes").to_pylist()]})
        replies = replies.take(pa.array(rng.permutation(len(replies))))
        assert (blobs.read_values(replies, 0, hashes, buckets) == hashes.astype(np.uint32)).all()


def test_blocks_are_bounded(spark, monkeypatch):
    """One far id, half of the ids null, one id for all rows, one row repeated: no block takes much over its size."""
    from plumbline.llm import common

    far = [(i, f"text {i} " + "x" * 90) for i in range(2000)] + [(1 << 62, "far")]
    half = [(None if i % 2 else i, f"text {i} " + "x" * 90) for i in range(2000)]
    one = [(7, f"text {i} " + "x" * 90) for i in range(2000)]
    same = [(7, "x" * 100)] * 2000
    for fan, most in ((common.FAN, common.BROADCAST_BYTES), (4, common.BROADCAST_BYTES), (4, 0)):  # 0: groups of bounds are not broadcast
        monkeypatch.setattr(common, "FAN", fan)
        monkeypatch.setattr(common, "BROADCAST_BYTES", most)
        for rows in (far, half, one, same) if fan > 4 else (far, same) if most else (half, same):
            docs = spark.createDataFrame(rows, "doc_id long, text string")
            sizes = collections.Counter(b for _, b in blocks_of(docs, 5000))
            assert len(sizes) >= 40 and max(sizes.values()) <= (60 if rows is not same else 120), (fan, sizes.most_common(3))
    monkeypatch.setattr(common, "HEADS", 3)  # groups grow so that few of them come to the driver
    docs = spark.createDataFrame(far, "doc_id long, text string")
    got = blocks_of(docs, 5000)
    assert [b for _, b in got] == sorted(b for _, b in got) and len({b for _, b in got}) >= 40
    texts = [t for _, t in one[:40]] + [one[0][1]]
    docs = spark.createDataFrame([(None if i % 2 else 1 << 62, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert docs.count() == substring_dedup.dedup_substrings(docs).count() == ngram_join.jaccard_join(docs).count() == 41
