"""Cases where an operator once did less than its whole job."""

import random

from plumbline.llm import chat_format, html_extract, license_scan, line_dedup, ngram_join, quality_rules


def words(n, tag):
    return " ".join(f"{tag}{i}" for i in range(n))


def maximal_runs_brute(texts, least):
    """Texts without the lines of any run of least words or more that starts earlier too."""
    seen, out = set(), []
    for text in texts:
        lines, gone = text.split("\n"), set()
        for i in range(len(lines)):
            for j in range(i + 1, len(lines) + 1):
                run = tuple(lines[i:j])
                if sum(len(x.split()) for x in run) >= least:
                    if run in seen:
                        gone.update(range(i, j))
                    seen.add(run)
        out.append(("\n".join(x for k, x in enumerate(lines) if k not in gone), len(gone)))
    return out


def line_dedup_of(spark, texts, least):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.text, r.removed_lines) for r in line_dedup.dedup_lines(docs, least).collect()}
    return [got[i] for i in range(len(texts))]


def test_line_dedup_takes_whole_runs(spark):
    run = "\n".join([words(60, "a"), words(10, "b"), words(10, "c")])
    assert line_dedup_of(spark, [run + "\n" + words(5, "x"), words(5, "y") + "\n" + run + "\n" + words(5, "z")], 50)[1] == (words(5, "y") + "\n" + words(5, "z"), 3)
    rng = random.Random(1)
    texts = ["\n".join(rng.choice([words(n, n) for n in (1, 2, 3, 5, 8)]) for _ in range(rng.randint(1, 14))) for _ in range(40)]
    assert line_dedup_of(spark, texts, 12) == maximal_runs_brute(texts, 12)


def test_line_dedup_of_repeated_rows(spark):
    text = "\n".join(words(3, f"line{i}w") for i in range(40))
    other = "\n".join(words(3, f"line{i}w") for i in range(20, 40)) + "\nthe end"
    docs = spark.createDataFrame([(1, text)] * 4 + [(2, other)] * 2, "doc_id long, text string")
    got = sorted((r.doc_id, r.text, r.removed_lines) for r in line_dedup.dedup_lines(docs, 50).collect())
    assert got == [(1, "", 40)] * 3 + [(1, text, 0), (2, "", 21), (2, "the end", 20)]


def test_html_keeps_all_content():
    long = "A long sentence, with a comma and more words. " * 12
    page = f"<body><article><p>{long}</p><p>{long}</p><div class='legal-notice'><p>{long}inside</p></div><div class=related><a href=x>one</a><a href=y>two</a></div></article><article><p>A short one, with a point.</p></article><p>{long}outside</p></body>"
    got = html_extract.main_text(page).split("\n\n")
    assert got == [long.strip(), long.strip(), long + "inside", "A short one, with a point.", long + "outside"]


def test_chat_digests_read_full_examples(spark):
    data = [(c, t, r, f"text {t} <turn> " * (t + 1)) for c in (1, 2, None) for t, r in enumerate(["system", "user", "assistant", "user", "assistant", "assistant", "user"][: 7 - (c or 0)])]
    formatted = chat_format.formatted(spark.createDataFrame(data, "conv_id long, turn long, role string, text string"))
    expected = {}
    for c, t, r, _ in data:  # each reply, and turns after the last one, with all turns before
        turns = [x for x in data if x[0] == c and x[1] <= t]
        if r == "assistant" or t == max(x[1] for x in data if x[0] == c):
            expected[c] = expected.get(c, 0) + sum(len(f"<turn> ### {x[2]}:\n{x[3].replace('<turn>', chr(92) + '<turn>')} </turn>\n") for x in turns)
    assert {r.conv_id: r.formatted_chars for r in chat_format.digests(formatted).collect()} == expected


def test_license_scan_of_words(spark):
    mit, (bsd2,), (isc,) = license_scan.TEMPLATES["MIT"][2], license_scan.TEMPLATES["BSD-2-Clause"], license_scan.TEMPLATES["ISC"]
    texts = ["Copyright 2020 Foo Ltd. All rights reserved.", "some All rights\nreserved here", words(90, "a") + " " + mit + " " + words(90, "b"), bsd2.replace(". ", ".\n"), license_scan.TEMPLATES["BSD-3-Clause"][1], "x\n" + isc, "Licensed under CC BY 4.0. All rights reserved."]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in license_scan.scan_licenses(docs).collect()}
    assert [got[i].licenses for i in range(len(texts))] == ["proprietary", "proprietary", "MIT", "BSD-2-Clause", "BSD-3-Clause", "ISC", "CC-BY-4.0,proprietary"]
    assert all(r.best_dice == 1.0 for r in got.values()) and (got[1].matches[0].first_line, got[1].matches[0].last_line) == (0, 1)


def test_join_of_rows_that_share_an_id(spark):
    """Rows of one doc_id with unlike texts: each keeps its links, and the document is one."""
    a, b = words(60, "a"), words(60, "b")
    docs = spark.createDataFrame([(1, a), (1, b), (2, a + " more"), (3, b + " more"), (4, words(50, "c")), (1, None), (5, ""), (5, words(50, "c") + " x")], "doc_id long, text string")
    got = {(r.doc_id, r.n_shingles): r.component_id for r in ngram_join.jaccard_join(docs).collect()}
    assert {i: c for (i, _), c in got.items()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4} and got[1, 0] == 1 and got[5, 0] == 4


def test_html_of_a_page_in_a_form():
    para = "A sentence of some length, with a comma and a stop. " * 6
    page = f"<body><form id=aspnetForm><nav><a href=x>Home</a></nav><h1>Title</h1><p>{para}</p><p>{para}</p><label>Your name</label><input><form class=search><label>Find</label><input><button>Go</button></form></form></body>"
    assert html_extract.main_text(page).split("\n\n") == ["Title", para.strip(), para.strip()]
    page = f"<body><article><h1>Title</h1><p>{para}</p><p>{para}</p></article><form><h3>Write to us</h3><p>Your name, please.</p><label>Name</label></form></body>"
    assert html_extract.main_text(page).split("\n\n") == ["Title", para.strip(), para.strip()]


def test_rules_are_fitted_on_as_many_documents_as_stated(spark):
    """Many rows of one doc_id are one labelled document."""
    docs = spark.createDataFrame([(1, words(30 + i, "w")) for i in range(200)] + [(i, words(40, f"v{i}")) for i in range(2, 6)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 6)] * 3, "doc_id long, quality int")
    seen = []
    learn = quality_rules.learn
    quality_rules.learn = lambda x, bad, names, **_: seen.append(len(x)) or []
    try:
        quality_rules.fit(quality_rules.statistics(docs), labels, fit_rows=4)
    finally:
        quality_rules.learn = learn
    assert seen and seen[0] <= 4
