"""Truth tables of extraction policies, derived by hand, and known CVSS scores."""

import pytest
from pyspark.sql import functions as F

from plumbline.functions import cvss, extract, text

#: text -> (voting letters, last-line option, cascade, bottom up A-D, letters anywhere)
ANSWERS = {
    "B": ("B", "B", "B", "B", "B"),
    "**B**": ("B", "B", "B", "B", "B"),
    "B) foo": ("B", "B", "B", "B", "B"),
    "Answer: B": ("B", "B", "B", "B", "B"),
    "ANSWER:C": ("C", "C", "C", "C", "ACE"),
    "A and B": ("AB", "B", "A", "A", "AB"),
    "a dog": ("A", "a dog", "A", "A", None),
    "<think>A</think>\nC": ("C", "C", "C", "C", "AC"),
    "": (None, "", None, None, None),
    "first\nsecond C\n": ("C", "C", "C", "C", "C"),
    "été B": ("B", "B", "B", "B", "B"),
}


def test_letters(spark):
    rows = spark.createDataFrame([(k,) for k in ANSWERS], "t string")
    t = F.col("t")
    got = {r.t: tuple(r)[1:] for r in rows.select("t", extract.voting_mcq(t), extract.last_line_option(t), extract.cascade(t), extract.bottom_up(t, "ABCD"), extract.letters_anywhere(t)).collect()}
    for k, want in ANSWERS.items():
        if k == "ANSWER:C":
            want = (*want[:4], "AC")
        assert got[k] == want, k


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t")).alias("x")).first().x


@pytest.mark.parametrize(
    ("policy", "value", "want"),
    [
        (extract.technique_ids, "T1059.001, t1027", ["T1027", "T1059.001"]),
        (extract.last_cwe, "CWE-79 … CWE-89", "CWE-89"),
        (extract.last_line_techniques, "T1\nT1059.001, T1027\n\n", ["T1027", "T1059"]),
        (extract.last_line_techniques, "T1059 first\nnone", ["T1059"]),
        (extract.voting_tfx, "True. F or X", "X"),
        (extract.vector, "x CVSS:3.0/av:n/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H", "CVSS:3.0/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H"),
        (extract.vector, "AV:N/AC:L", None),
        (extract.generated_letter, "none", "?"),
        (extract.answer_colon, "my answer: d", "D"),
        (extract.recent_lines, "x\n(C) y", "C"),
        (extract.several_letters, "B, D and B", "BD"),
        (text.answer_part, "<think>A", ""),
        (text.after_thinking, "<think>A</think> b </think> c ", "c"),
        (text.thinking, "x<think> a </think>y", "a"),
        (lambda c: text.cut_at(c, ["\n", "stop"]), "one stop\ntwo", "one"),
        (lambda c: text.word_snippet(c, 9), "several words here", "several"),
        (lambda c: extract.backward(c, r"(?i)\b([A-E])\b"), "first\nThe answer\n(B)\nend", "B"),
    ],
)
def test_policies(spark, policy, value, want):
    assert one(spark, value, policy) == want


def test_null_texts(spark):
    rows = spark.createDataFrame([(None,)], "t string")
    t = F.col("t")
    for policy in (extract.voting_mcq, extract.voting_tfx, extract.vector, extract.last_line_option, extract.cascade, extract.recent_lines, extract.answer_colon, text.after_thinking, text.answer_part):
        assert rows.select(policy(t).alias("x")).first().x is None


def test_cvss(spark):
    known = {
        "CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H": 9.8, "CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:C/C:H/I:H/A:H": 10.0, "AV:N/AC:L/PR:N/UI:R/S:C/C:L/I:L/A:N": 6.1,
        "CVSS:3.0/AV:L/AC:L/PR:L/UI:N/S:U/C:H/I:H/A:H": 7.8, "AV:N/AC:L/PR:N/UI:N/S:U/C:N/I:N/A:N": 0.0, "AV:N/AC:L/PR:N/UI:N/S:U/C:N/I:N": None, "NONE": None, "AV:P/AC:H/PR:H/UI:R/S:U/C:L/I:N/A:N": 1.6,
    }
    rows = spark.createDataFrame([(k,) for k in known], "v string")
    assert {r.v: r.s for r in rows.select("v", cvss.base_score(F.col("v")).alias("s")).collect()} == known


def test_a_reply_is_parsed_once(spark):
    """However many fields are read from it; replies that can be no JSON are not handed to the parser, numbers that are none not to a cast."""
    replies = ['so: {"verdict": "correct", "score": "4.7"}', '5', ' {"score": "high"}', 'so {"score": 9, oops', 'score = 2, incorrect', '', 'nothing', '{"score": 1e0}', "```json {\"score\": 3} ``` {\"score\": 2}", None, 'true', '{"score": "9", "verdict": " Correct "} ', "Score: 4"]
    rows = spark.createDataFrame([(i, r) for i, r in enumerate(replies)], "idx int, reply string")
    out = extract.with_json(rows).select("idx", *[f(F.col("reply"), F.col("parsed")).alias(c) for c, f in (("v", extract.vector_reply), ("score", extract.score_reply), ("ok", extract.text_reply))])
    got = [(r.score, r.ok) for r in out.orderBy("idx").collect()]
    assert got == [(4, True), (1, False), (1, False), (5, False), (2, False), (3, False), (3, False), (1, False), (3, False), (3, False), (1, False), (5, True), (4, False)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") == 1
