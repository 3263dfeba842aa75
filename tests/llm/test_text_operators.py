"""Operators on single texts, against plain Python over the whole text."""

import collections
import hashlib
import math
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plumbline.llm import chat_format, fingerprint, html_extract, license_scan, mixing, quality_rules, sentence_pieces

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def counts(text):
    text = text or ""
    words = WORD.findall(text)
    grams = collections.Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if grams[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_statistics(hard_docs, hard_texts):
    got = by_id(quality_rules.statistics(hard_docs))
    for i, text in enumerate(hard_texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts(text)


def test_rules_learn_a_threshold(spark):
    texts = [("ok words go here and there " * 8).strip() + f" {i}" for i in range(60)] + [" ".join(f"w{i}{j}#$%" for j in range(40)) for i in range(60)]
    texts = [" ".join(f"{w}{k}" for k, w in enumerate(t.split())) for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 60)) for i in range(0, 120, 2)] + [(1, None), (None, 1), (999, 0)], "doc_id long, quality int")
    got = by_id(quality_rules.judge(docs, labels))
    assert all(got[i].kept == (i < 60) for i in range(120))
    kept = quality_rules.keep_good(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(range(60))


def brute_test(x, bad):
    """The best threshold of any column by FOIL gain, by trying all."""
    best, base = (0.0, None), math.log2(bad.sum() / len(bad))
    for k in range(x.shape[1]):
        values = sorted(set(x[:, k]))
        for limit in [(a + b) / 2 for a, b in zip(values, values[1:], strict=False)]:
            for most in (True, False):
                met = (x[:, k] <= limit) if most else (x[:, k] > limit)
                p = int(bad[met].sum())
                gain = p * (math.log2(p / met.sum()) - base) if p else 0.0
                if gain > best[0] + 1e-9:
                    best = (gain, (f"f{k}", most, limit))
    return best


def test_best_threshold_against_all():
    rng = np.random.default_rng(7)
    for _ in range(20):
        x, bad = rng.integers(0, 6, size=(40, 3)).astype(float), rng.random(40) < 0.4
        got, (gain, want) = quality_rules.best_test(x, bad, ["f0", "f1", "f2"]), brute_test(x, bad)
        met = quality_rules.holds([got], x, ["f0", "f1", "f2"])
        p = int(bad[met].sum())
        assert p * (math.log2(p / met.sum()) - math.log2(bad.sum() / 40)) == pytest.approx(gain) and want is not None


def test_verdicts_against_plain_code(spark):
    """The fitted list applied by hand: statistics counted in Python, rules tried in order, the first that holds rejects."""
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rules = quality_rules.fit(quality_rules.statistics(docs), labels)
    judged = by_id(quality_rules.judge(docs, labels))
    for d in docs.collect():
        r, n = judged[d.doc_id], counts(d.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n
        base = n[0] < 20 or 100 * n[4] > 30 * n[0]
        names = {c: r[c] for c in quality_rules.COUNTS} | {"greatest": max, "double": float}
        value = {name: eval(expression, {}, names) for name, expression in quality_rules.FEATURES.items()}
        rule = next((k for k, rule in enumerate(rules, 1) if all((value[f] <= limit) if most else (value[f] > limit) for f, most, limit in rule.tests)), None)
        assert (r.base_failed, r.rule, r.kept) == (base, rule, not base and rule is None)
    assert rules and all(rule.precision >= 0.9 for rule in rules)


def test_rules_without_labels_or_documents(spark, hard_docs, no_docs, clashing):
    none = spark.createDataFrame([], "doc_id long, quality int")
    for r in quality_rules.judge(hard_docs, none).collect():
        assert r.rule is None and r.kept == (not r.base_failed)
    assert quality_rules.judge(no_docs, none).count() == 0
    assert quality_rules.keep_good(clashing, none).columns == clashing.columns


def test_license_scan(spark, hard_docs, no_docs):
    texts = [None, "", "Some text.\nReleased under the MIT license!\nmore", "All  rights\treserved", "licensed  under CC by-nc 4.0!", license_scan.TEMPLATES["MIT"][2].replace(". ", ".\n"), "of the and under the", "word"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = by_id(license_scan.scan_licenses(docs))
    assert [got[i].licenses for i in range(len(texts))] == ["", "", "MIT", "proprietary", "CC-BY-NC-4.0", "MIT", "", ""]
    assert got[2].matches[0].first_line == 1 and got[2].best_dice == 1.0 and got[0].best_license is None
    assert license_scan.scan_licenses(no_docs).count() == 0
    assert license_scan.scan_licenses(hard_docs).count() == hard_docs.count()


def windows_brute(text, templates, least):
    """Each window of each template's length against it, by sets of tuples; the better first."""
    norm = lambda t: re.findall(r"[a-z0-9\x80-\U0010ffff]+", "".join(c.lower() if c.isascii() else c for c in t))
    words, found = norm(text), []
    pairs = list(zip(words, words[1:], strict=False))
    for k, (name, template) in enumerate(templates):
        grams = norm(template)
        grams = list(zip(grams, grams[1:], strict=False))
        for i in range(max(1, len(pairs) - len(grams) + 1) if pairs else 0):
            window = pairs[i : i + len(grams)]
            dice = 2 * len(set(window) & set(grams)) / (len(set(window)) + len(set(grams)))
            if dice >= least - 1e-12:
                found.append((-dice, -len(grams), k, i, i + len(window), name))
    taken, out = set(), []
    for dice, _, _, first, last, name in sorted(found):
        if not taken & set(range(first, last + 1)):
            taken |= set(range(first, last + 1))
            out.append((name, -dice, first, last))
    return sorted(out, key=lambda x: x[2])


def test_license_scan_against_all_windows(spark):
    rng = random.Random(9)
    templates = {"one": ["alpha beta gamma delta alpha beta", "beta gamma"], "two": ["gamma delta epsilon alpha"], "short": ["word"]}
    flat = [(n, t) for n, ts in templates.items() for t in ts if " " in t]
    texts = [" ".join(rng.choice(["alpha", "Beta", "gamma,", "delta", "epsilon"]) for _ in range(rng.randint(0, 30))) for _ in range(60)] + ["alpha beta gamma delta alpha beta " * 9]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for least in (0.5, 0.8, 1.0):
        got = by_id(license_scan.scan_licenses(docs, templates, least))
        for i, text in enumerate(texts):
            want = windows_brute(text, flat, least)
            assert [(m.license, m.dice) for m in got[i].matches] == [(n, pytest.approx(d)) for n, d, _, _ in want], text
            assert got[i].best_dice == (pytest.approx(max(d for _, d, _, _ in want)) if want else None)


def test_whole_licenses_are_found(spark):
    texts = {path.stem: path.read_text() for path in license_scan.FOLDER.glob("*.txt")}
    docs = spark.createDataFrame([(i, "before\n" + t + "\nafter") for i, t in enumerate(texts.values())], "doc_id long, text string")
    got = by_id(license_scan.scan_licenses(docs))
    assert len(texts) == 7 and [got[i].best_license for i in range(7)] == list(texts)


def test_many_license_lines():
    batch = pa.RecordBatch.from_arrays([pa.array([1], pa.int64()), pa.array(["All rights reserved.\n" * 100_000])], ["doc_id", "text"])
    began = time.time()
    (found,) = license_scan.scanner(license_scan.all_templates(), 0.8)([batch])
    assert found.column("n_matches").to_pylist() == [100_000] and time.time() - began < 40


def test_pieces_equal_the_library(hard_docs, hard_texts, no_docs, clashing):
    sentencepiece = pytest.importorskip("sentencepiece")
    lib = sentencepiece.SentencePieceProcessor(model_file=sentence_pieces.MODEL_PATH)
    got = by_id(sentence_pieces.encode_documents(hard_docs))
    for i, text in enumerate(hard_texts):
        assert got[i].token_ids == lib.encode(text or "") and got[i].n_tokens == len(got[i].token_ids) and got[i].round_trip
    assert sentence_pieces.encode_documents(no_docs).count() == 0
    assert sentence_pieces.encode_documents(clashing).count() == 5


def test_pieces_of_odd_texts():
    sentencepiece = pytest.importorskip("sentencepiece")
    lib = sentencepiece.SentencePieceProcessor(model_file=sentence_pieces.MODEL_PATH)
    model = sentence_pieces.load()
    odd = ["Hello  world\n x", " a", "é😀\t　x ﬁ ½ ①", "a\0b", "  ", " " * 100, "x" * 1000, "ab" * 400 + " " * 40 + "c", "\n\n", "日本語テキスト" * 60, "<0x0A> <s>", " ⁇ ", "▁a"]
    for text, ids in zip(odd, sentence_pieces.encode(odd, model), strict=True):
        assert ids == lib.encode(text) and sentence_pieces.decode(ids, model) == text.replace("▁", " ")


def test_pieces_of_long_words(monkeypatch):
    """Words without spaces, indexed in pieces that overlap, have the library's ids and are not remembered."""
    sentencepiece = pytest.importorskip("sentencepiece")
    lib = sentencepiece.SentencePieceProcessor(model_file=sentence_pieces.MODEL_PATH)
    monkeypatch.setattr(sentence_pieces, "INDEX_CHARS", 512)
    model, rng = sentence_pieces.load(), random.Random(2)
    texts = ["".join(rng.choice(["the", "and", "tion", "er", "é", "日", "Z"]) for _ in range(3000)), "x" * 2500, "ab" * 1700, "\t\n" * 900]
    assert sentence_pieces.encode(texts, model) == [lib.encode(x) for x in texts]
    assert all(len(w) <= sentence_pieces.LONG_WORD for w in model.tables["known"])


def test_long_texts_without_spaces():
    """Millions of characters without a space come back; their edges take some thirty bytes a character."""
    model, rng = sentence_pieces.load(), random.Random(4)
    text = "".join(rng.choice(["the", "and", "tion", "er", "Z"]) for _ in range(400_000))
    assert sentence_pieces.decode(sentence_pieces.encode([text], model)[0], model) == text
    edges = sentence_pieces.Edges(sentence_pieces.letters(text, model.prepare()), model.prepare())
    assert edges.lengths.nbytes + edges.ids.nbytes + edges.begin.nbytes < 32 * len(text)


def test_unigram_takes_the_best_path():
    pieces = ["<unk>", "▁", "a", "b", "ab", "▁a", "▁ab", "ba", "bab"]
    scores = [0.0, -3.0, -2.0, -2.5, -2.2, -2.6, -4.0, -2.1, -6.0]
    model = sentence_pieces.Model(pieces, scores, [2] + [1] * 8, sentence_pieces.UNIGRAM)
    best = {}

    def paths(text):
        if not text:
            return [(0.0, [])]
        if text not in best:
            best[text] = sorted(((scores[i] + s, [i, *p]) for i, x in enumerate(pieces) if i and text.startswith(x) for s, p in paths(text[len(x) :])), reverse=True)[:1]
        return best[text]

    for text in ("abab", "baba", "aab", "bbb"):
        assert sentence_pieces.encode([text], model)[0] == paths("▁" + text)[0][1]
    assert sentence_pieces.encode(["aZb"], model)[0] == [5, 0, 3]


def test_html(spark):
    page = "<html><head><title>t</title><style>p{}</style></head><body><nav><a href=x>menu</a></nav><div class='ad banner'>buy, now.</div><article><h1>Title &amp; more</h1><p>First, a  paragraph.<br>Next line.<p>Second <b>one</b>, also.</p><script>var a='<p>';</script><aside>x</aside></article><div id=comments><p>I think, therefore. I am, long comment text.</p></div><footer>&copy;</footer></body>"
    other = "<div class=main><p>Some words, here. And a sentence.</p><ul><li>one, two<li>three</ul></div><div class=sidebar>links</div>"
    data = [(1, "u", page), (2, None, None), (3, "", ""), (4, "u", other), (5, "u", "<p>unclosed <i>text"), (5, "u", "<p>unclosed <i>text"), (None, "u", "<script>only()</script>"), (7, "u", "<" * 5000), (8, "u", "<p>" + "word, " * 50000)]
    got = html_extract.extract(spark.createDataFrame(data, "page_id long, url string, html string").selectExpr("*", "1 as text", "2 as n_chars"))
    texts = {(r.page_id): r.text for r in got.collect()}
    assert texts[1] == "Title & more\n\nFirst, a paragraph. Next line.\n\nSecond one, also."
    assert texts[2] == texts[3] == texts[None] == "" and texts[4] == "Some words, here. And a sentence.\n\none, two\n\nthree" and texts[5] == "unclosed text"
    assert got.count() == len(data) and texts[8].count("word,") == 50000
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def random_page(rng):
    """A page and the blocks of its article."""
    sentence = lambda n: " ".join(rng.choice(["one", "two", "three", "four"]) for _ in range(n)).capitalize() + rng.choice([", yes.", ".", "; no, never."])
    junk = [f"<nav><a href=a>{sentence(2)}</a><a>b</a></nav>", f"<div class='{rng.choice(['ad', 'cookie-notice', 'sidebar', 'promo box'])}'>{sentence(9)} {sentence(3)}</div>", "<footer>&copy; someone, 2020.</footer>", f"<div id=comments><p>{sentence(14)}</p><p>{sentence(6)}</p></div>", "<form><label>Name</label><input></form>", f"<aside><p>{sentence(12)}</p></aside>", "<script>var a = '<p>no, no.</p>';</script>", "<ul class=menu><li><a>x</a></li><li><a>y</a></li></ul>"]
    rng.shuffle(junk)
    blocks, parts = [sentence(3)], []
    parts.append(f"<h1>{blocks[0]}</h1>")
    for _ in range(rng.randint(2, 7)):
        kind, text = rng.random(), " ".join(sentence(rng.randint(8, 25)) for _ in range(rng.randint(1, 4)))
        if kind < 0.7:
            parts.append(f"<p>{text.replace('two', '<b>two</b>')}</p>")
            blocks.append(text)
        elif kind < 0.85:
            items = [sentence(2) for _ in range(3)]
            parts.append("<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" + f"<p>{text}</p>")
            blocks += [*items, text]
        else:
            parts.append(f"<h2>{sentence(2)}</h2><p>{text}")
            blocks += [re.search("<h2>(.*?)</h2>", parts[-1])[1], text]
    around = rng.choice(["<article>{}</article>", "<div class=post>{}</div>", "<main><div>{}</div></main>", "<div id=content><section>{}</section></div>"])
    k = rng.randint(0, 4)
    return f"<html><head><title>{sentence(4)}</title></head><body>{''.join(junk[:k])}{around.format(chr(10).join(parts))}{''.join(junk[k:])}</body></html>", blocks


def test_html_against_known_articles():
    rng = random.Random(5)
    for _ in range(300):
        page, blocks = random_page(rng)
        assert html_extract.main_text(page).split("\n\n") == blocks, page


def test_html_ratios_decide(monkeypatch):
    pages = [random_page(random.Random(i))[0] for i in range(60)]
    real, scores, rng = [html_extract.main_text(p) for p in pages], html_extract.path_scores, random.Random(1)
    monkeypatch.setattr(html_extract, "path_scores", lambda page: {k: rng.random() for k in scores(page)})
    assert sum(html_extract.main_text(p) != r for p, r in zip(pages, real, strict=True)) > 30


def test_html_of_deep_pages():
    began = time.time()
    assert html_extract.main_text("<div>" * 100_000 + "some text, here." + "<p>x" * 10).startswith("some text, here.")
    assert html_extract.main_text("<div>text, a" * 30_000 + "</span>" * 30_000).count("text, a") == 30_000
    assert time.time() - began < 40


def test_html_named_parts_with_content():
    long = "A long sentence, with a comma and more words. " * 12
    page = f"<body><div><a>home</a> <a>x</a></div><div class='search-result'><h2>Head</h2><p>{long}</p><section><h3>Sub</h3><div><p>{long}</p></div></section></div><div><a>rel one</a><a>rel two</a></div></body>"
    assert html_extract.main_text(page).split("\n\n") == ["Head", long.strip(), "Sub", long.strip()]
    page = f"<body><article><h1><a href=x>T</a></h1><p class=byline>By A. B.</p><p>{long}</p><p>Let <math><mi>x</mi></math> be <label>labelled</label>.</p><div>short note</div><ul><li><a>s1</a></li><li><a>s2</a></li></ul></article></body>"
    assert html_extract.main_text(page).split("\n\n") == ["T", "By A. B.", long.strip(), "Let x be labelled.", "short note"]


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_chats_come_back(spark):
    odd = ["\\### Assistant: </turn> ok", "<turn> ### user:\n</turn>\n", "\\\\<turn>", "a\\", "", None, "###\\###", "x" * 20000, "\n<turn> \n"]
    data = [(c, t, r, odd[(c + t) % len(odd)]) for c in range(12) for t, r in enumerate(["system", "user", "assistant", "user", "assistant", "user"][: c % 7])]
    data += [(50, 0, "assistant", "same"), (50, 0, "assistant", "same"), (51, 0, "we:\nird\\", "x"), (51, 1, None, "y"), (None, 0, "user", "q"), (None, 1, "assistant", "a")]
    table = spark.createDataFrame([(*d, "x") for d in data], "conv_id long, turn long, role string, text string, example string")
    got = {r.conv_id: r for r in chat_format.digests(chat_format.formatted(table)).collect()}
    groups = collections.defaultdict(list)
    for c, t, r, x in data:
        groups[c].append((t, r or "", x or ""))
    assert set(got) == set(groups)
    for c, turns in groups.items():
        turns = sorted(turns)
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256) == (len(turns), digest("".join(f"{r}\n{x}\n" for _, r, x in turns)))
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), digest(loss))
    every = collections.defaultdict(list)
    for r in chat_format.examples(chat_format.formatted(table)).orderBy("example").collect():
        every[r.conv_id].append(r)
    for c, turns in groups.items():  # an example for each reply, with all turns before it, and one for what follows the last
        turns, want = sorted(turns), []
        for k, (_, role, text) in enumerate(turns):
            if role == "assistant" or k == len(turns) - 1:
                want.append(([(r, x) for _, r, x in turns[: k + 1]], text if role == "assistant" else None))
        loss = lambda r: None if r.loss_from is None else re.sub(chat_format.CONTROL_BACK, r"\1\2", r.text[r.loss_from : r.loss_to])
        assert [(chat_format.turns_in(r.text), loss(r)) for r in every[c]] == want
    written = every[6]
    assert len(written) == 3 and written[1].text.startswith(written[0].text) and written[2].loss_from is None
    assert chat_format.digests(chat_format.formatted(table.limit(0))).count() == 0


def shingles(text):
    words = WORD.findall(text or "")
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_fingerprints(hard_docs, hard_texts, no_docs, clashing):
    got = by_id(fingerprint.edited_fingerprints(hard_docs))
    texts = [t or "" for t in hard_texts]
    errors = []
    for i, text in enumerate(texts):
        following = texts[(i + 1) % len(texts)]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), digest(edited))
        a, b = shingles(text), shingles(edited)
        if len(a | b) > 300:
            errors.append(abs(r.near_edited - len(a & b) / len(a | b)))
        assert (r.fingerprint == "") == (not a)
        assert len(r.fingerprint) < 17 + 17 * len(a)
        if text == following:
            assert r.near_next == 1.0
    assert errors and sum(errors) / len(errors) < 0.1
    assert got[8].fingerprint == got[9].fingerprint
    assert fingerprint.edited_fingerprints(no_docs).count() == 0
    assert fingerprint.edited_fingerprints(clashing).count() == 5


def test_next_documents_over_many_blocks(spark, monkeypatch):
    """Null ids first, ties by a hash of the text, repeated rows one after the other, the first after the last."""
    rng = random.Random(8)
    ids = [None] * 9 + [rng.randint(-60, 60) for _ in range(300)]
    rows = [(i, f"{rng.random()} " + "x" * 1500) for i in ids] + [(5, "same " + "y" * 9000)] * 40
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    key = F.struct(F.col("doc_id").isNotNull(), "doc_id", F.xxhash64("text"))
    order = [r.text for r in docs.orderBy(key).collect()]
    wanted = sorted(zip(order, order[1:] + order[:1], strict=True))
    for run, most in ((fingerprint.RUN, fingerprint.BROADCAST_BLOCKS), (4, 0)):  # 0: first keys of blocks are not broadcast
        monkeypatch.setattr(fingerprint, "RUN", run)
        monkeypatch.setattr(fingerprint, "BROADCAST_BLOCKS", most)
        got = fingerprint.with_next(docs)
        assert sorted((r.text, r.next_text) for r in got.select("text", "next_text").collect()) == wanted


def test_fingerprints_merge(spark):
    a, b = " ".join(f"a{i}" for i in range(900)), " ".join(f"b{i}" for i in range(160))
    whole = spark.createDataFrame([(a, b, f"{a} {b}")], "a string, b string, c string")
    s = whole.select(*[fingerprint.sketch(F.col(c)).alias(c) for c in "abc"])
    r = s.select(fingerprint.containment(F.col("b"), F.col("c")).alias("inside"), fingerprint.merged(F.array("a", "b")).alias("m"), "a", "b", "c").first()
    assert r.inside == 1.0 and set(r.m) <= set(r.c) and set(r.a) | set(r.b) == set(r.m)


def test_sketches_of_short_texts(spark):
    """A sketch has nothing but hashes below the bound, so a part's hashes are in the whole's; digests tell the rest."""
    data = [(i, " ".join(f"s{i}w{k}" for k in range(7)), " ".join(f"s{i}w{k}" for k in range(307))) for i in range(200)]
    rows = spark.createDataFrame(data, "doc_id long, a string, b string").select("doc_id", fingerprint.fingerprint(F.col("a")).alias("a"), fingerprint.fingerprint(F.col("b")).alias("b"))
    for r in rows.select("a", "b", fingerprint.containment(F.col("a.sketch"), F.col("b.sketch")).alias("inside"), fingerprint.likeness(F.col("a"), F.col("a")).alias("self")).collect():
        assert r.inside == (1.0 if r.a.sketch else None) and r.self == 1.0 and set(r.a.sketch) <= set(r.b.sketch)
        assert all(0 <= h < (1 << 64) // fingerprint.SCALE for h in r.b.sketch)
    two = rows.where("doc_id < 2").select(F.collect_list("a").alias("x")).select(fingerprint.likeness(F.col("x")[0], F.col("x")[1]).alias("d"), F.col("x")).first()
    assert two.d == 0.0 and two.x[0].digest != two.x[1].digest


def test_sketches_against_plain_code(spark):
    """The sketch is that of all shingle hashes below the bound: hashed by Spark row by row, and then chosen here."""
    texts = ["a b c d e f a b c d e f g", "one two", "", " ".join(f"w{i % 40}" for i in range(300)), "é ü \u3000 x\ty\nz"]
    hashed = spark.createDataFrame([(i, k, w) for i, t in enumerate(texts) for k, w in enumerate(WORD.findall(t))], "doc_id long, k long, w string").select("doc_id", "k", F.xxhash64("w").alias("h"))
    words = collections.defaultdict(list)
    for r in hashed.orderBy("doc_id", "k").collect():
        words[r.doc_id].append(r.h)
    wanted = {}
    for i in range(len(texts)):
        h = words[i]
        rows = [tuple(h[j : j + 5]) for j in range(len(h) - 4)]
        found = [r.x for r in spark.createDataFrame(rows, "a long, b long, c long, d long, e long").select(F.xxhash64("a", "b", "c", "d", "e").alias("x")).collect()] if rows else [spark.createDataFrame([(h,)], "h array<long>").select(F.xxhash64("h").alias("x")).first().x] if h else []
        wanted[i] = sorted({x for x in found if 0 <= x < (1 << 64) // fingerprint.SCALE})
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.sketch for r in fingerprint.fingerprints(docs).collect()} == wanted


def water_levels(sizes, weights=(5, 2, 1), most=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    capped, total = set(), sum(sizes.values())
    while True:
        free = [s for s in names if s not in capped]
        rest = total - sum(most * sizes[s] for s in capped)
        target = {s: most * sizes[s] if s in capped else weight[s] * rest / sum(weight[f] for f in free) for s in names}
        over = {s for s in free if target[s] > most * sizes[s] + 1e-9}
        if not over:
            return target
        capped |= over


def plan_brute(rows, seed=17, largest=128):
    """Copies of (doc_id, source, words): the largest documents by hand, then systematic sampling, one offset a source."""
    sizes = collections.Counter()
    for _, source, n in rows:
        sizes[source] += n
    targets, out = water_levels(dict(sizes)), {}
    for source in sizes:
        own = sorted((n, i) for i, s, n in rows if s == source)
        shift = int(hashlib.md5(f"{seed}:{chr(0) if source is None else source}".encode()).hexdigest()[:4], 16) / 65536
        left, rest, at = targets[source], sizes[source], shift
        for n, i in own[::-1][:largest]:
            then = at + (left / rest if rest else 0.0)
            rest -= n
            got = min(max(math.floor(then) - math.floor(at), math.ceil((left - 3 * rest) / n)), math.floor(left / n)) if n else 0
            out[i], at = min(max(got, 0), 3), then
            left -= out[i] * n
        own = own[: max(len(own) - largest, 0)]
        order, step = own[::2] + own[1::2][::-1], left / rest if rest else 0.0
        for place, (_, i) in enumerate(order, 1):
            out[i] = min(math.floor(place * step + shift) - math.floor((place - 1) * step + shift), 3)
    return out


def test_words_taken_come_near_the_targets(spark):
    """Targets and errors by themselves: sources with one giant document, with few, with many documents, with a cap."""
    rng = random.Random(8)
    sizes = {"giant": [5000, *[rng.randint(5, 300) for _ in range(120)]], "few": [900, 40, 800, 3, 20, 700], "many": [min(int(rng.lognormvariate(5, 1.2)), 9000) + 1 for _ in range(1500)], "small": [7, 9, 30], None: [rng.randint(1, 400) for _ in range(300)]}
    docs = spark.createDataFrame([(10_000 * k + i, " ".join(["w"] * n), s) for k, (s, ns) in enumerate(sizes.items()) for i, n in enumerate(ns)], "doc_id long, text string, source string")
    rows = mixing.mix_report(docs).join(docs.select("doc_id", "source"), "doc_id").collect()
    want, taken = water_levels({s: sum(n) for s, n in sizes.items()}), collections.Counter()
    for r in rows:
        taken[r.source] += r.taken
        assert r.target == pytest.approx(want[r.source]) and 0 <= r.taken <= 3 * r.size
    for s, n in sizes.items():
        assert abs(taken[s] - want[s]) <= max(0.02 * want[s], sorted(n)[len(n) // 2]), (s, taken[s], want[s])


@pytest.mark.parametrize("sf, most", [("sf0.01", 0.02), ("sf0.1", 0.01)])
def test_mix_of_the_given_tables(spark, sf, most):
    """No source of the given tables is further off its target than 2 % (50 documents a source) or 1 % (500)."""
    from plumbline.llm.common import table

    docs = table(spark, f"/root/testdata/{sf}", "documents")
    rows = mixing.mix_report(docs).join(docs.select("doc_id", "source"), "doc_id").groupBy("source").agg({"taken": "sum", "target": "max"}).collect()
    assert all(abs(r["sum(taken)"] - r["max(target)"]) <= most * r["max(target)"] for r in rows), max(abs(r["sum(taken)"] / r["max(target)"] - 1) for r in rows)


def test_mixing_against_plain_code(spark):
    rng = random.Random(6)
    data = [(i, " ".join(["w"] * min(int(rng.expovariate(0.02)), 400)), rng.choice(["a", "b", "c", "d", None])) for i in range(600)]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string")
    want = plan_brute([(i, s, len(t.split())) for i, t, s in data])
    assert {r.doc_id: r.copies for r in mixing.mix_plan(docs).collect()} == want
    assert collections.Counter(r.doc_id for r in mixing.mixed(docs).collect()) == {i: n for i, n in want.items() if n}


def test_mixing(spark, hard_docs, no_docs, clashing):
    data = [(i, " ".join(["w"] * (i % 37)), f"s{i % 7}" if i % 7 else None) for i in range(2000)] + [(5000 + i, "tiny text", "a") for i in range(9)] + [(6000, None, "zero"), (6001, "", "zero")]
    docs = spark.createDataFrame([(*d, 1) for d in data], "doc_id long, text string, source string, copies long")
    got = mixing.mix_report(docs).join(docs.select("doc_id", "source"), "doc_id").collect()
    sizes = collections.Counter()
    for _, text, source in data:
        sizes[source] += len(WORD.findall(text or ""))
    want, taken = water_levels(dict(sizes)), collections.Counter()
    for r in got:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source] and r.taken <= 3 * r.size and (not r.size or r.taken % r.size == 0)
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 37 for s in want)
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns
    words = collections.Counter()
    for r in mixed.collect():
        words[r.source] += len(WORD.findall(r.text or ""))
    assert {s: n for s, n in words.items() if n} == {s: n for s, n in taken.items() if n}
    assert sorted(map(tuple, mixing.mix_report(docs).collect())) == sorted(map(tuple, mixing.mix_report(docs).collect()))
    assert mixing.mixed(no_docs).count() == 0 and mixing.mixed(clashing).columns == clashing.columns
    assert mixing.mix_report(clashing).count() == 5
