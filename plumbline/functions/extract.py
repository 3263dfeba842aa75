"""Answer-extraction policies: Column expressions from a response to an answer, null when nothing is found."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import after_thinking, every, found, last, last_some, lines, strip

TECHNIQUE = r"T\d{4}(?:\.\d{3})?"
VECTOR = r"AV:[A-Za-z]+/AC:[A-Za-z]+/PR:[A-Za-z]+/UI:[A-Za-z]+/S:[A-Za-z]+/C:[A-Za-z]+/I:[A-Za-z]+/A:[A-Za-z]+"
PREFIX = r"(?i)^\s*(?:final\s+answer|answer|prediction|output|result)\s*[:\-–—]?\s*"


def id_set(ids: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(ids, F.upper)))


def joined(letters: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(letters)), "")


def voting_mcq(text: Column) -> Column:
    """All standalone letters a-d of either case; distinct and sorted before they are upper-cased."""
    return F.nullif(F.upper(joined(every(after_thinking(text), r"\b([A-Da-d])\b"))), F.lit(""))


def gold_mcq(gold: Column) -> Column:
    """As for votes, but letters inside words count."""
    return F.upper(joined(every(gold, "([A-Da-d])")))


def voting_tfx(text: Column) -> Column:
    return F.upper(last(every(after_thinking(text), r"\b([TFXtfx])\b")))


def gold_tfx(gold: Column) -> Column:
    return found(F.upper(strip(gold)), "^([TFX])")


def technique_ids(text: Column) -> Column:
    return id_set(every(text, rf"(?i)\b({TECHNIQUE})\b"))


def mitigation_ids(text: Column) -> Column:
    return id_set(every(text, r"(?i)\b(M\d{4})\b"))


def vector(text: Column) -> Column:
    """The first CVSS vector, with its prefix if it has one."""
    return F.upper(found(after_thinking(text), rf"(?i)((?:CVSS:3\.[01]/)?{VECTOR})"))


def free_text(text: Column, n: int = 200) -> Column:
    return F.nullif(F.substring(strip(F.lower(after_thinking(text))), 1, n), F.lit(""))


def prediction(text: Column, task_type: Column) -> Column:
    """The vote of a response by its task's type."""
    ids = technique_ids(after_thinking(text))
    mitigations = mitigation_ids(after_thinking(text))
    listed = lambda a: F.when(F.size(a) > 0, F.array_join(a, ","))
    return (
        F.when(task_type == "mcq", voting_mcq(text)).when(task_type == "tfx", voting_tfx(text)).when(task_type == "ids", listed(ids)).when(task_type == "mitigations", listed(mitigations)).when(task_type == "vsp", vector(text)).when(task_type == "text", free_text(text))
    )


def gold(text: Column, task_type: Column) -> Column:
    return (
        F.when(task_type == "mcq", gold_mcq(text)).when(task_type == "tfx", gold_tfx(text)).when(task_type == "ids", F.array_join(technique_ids(text), ",")).when(task_type == "mitigations", F.array_join(mitigation_ids(text), ",")).when(task_type == "vsp", vector(text)).otherwise(strip(text))
    )


def last_line_option(text: Column) -> Column:
    """The last line's option: "A)" at its start, a letter at its end, or the third last character before "**"; if the
    last line is empty the one before; else the whole text in one line."""
    split = F.split(text, "\n")
    rstrip = lambda t: F.regexp_replace(t, r"\s+$", "")

    def of(line: Column) -> Column:
        bold = F.when(line.endswith("**") & (F.char_length(line) >= 3), F.substring(line, F.char_length(line) - 2, F.lit(1)))
        return F.coalesce(found(line, r"^([A-D])\)"), found(line, "([A-D])$"), bold)

    end, before = rstrip(last(split)), rstrip(F.try_element_at(split, F.lit(-2)))
    return F.coalesce(of(end), F.when(end == "", of(before)), F.array_join(split, " "))


def last_cwe(text: Column) -> Column:
    return last(every(text, r"(CWE-\d+)"))


def last_vector(text: Column) -> Column:
    return last(every(text, f"({VECTOR})"))


def parents(ids: Column) -> Column:
    """Technique ids without their sub-techniques, distinct and sorted."""
    return id_set(F.transform(ids, lambda x: F.split(x, r"\.")[0]))


def last_line_techniques(text: Column) -> Column:
    """Parent ids of the last line that is not empty, or of the whole text if it has none."""
    ids = parents(every(F.coalesce(last(lines(text)), F.lit("")), r"(?i)\b(T\d{4}(?:\.\d+)?)\b"))
    return F.when(F.size(ids) > 0, ids).otherwise(parents(every(text, r"(?i)\b(T\d{4}(?:\.\d+)?)\b")))


def backward(text: Column, pattern: str, group: int = 1) -> Column:
    """Lines from the last: a match in the line or, if it says "answer", in the next or else the previous one."""
    all_lines = lines(text)
    match = lambda line: found(F.regexp_replace(line, PREFIX, ""), pattern, group)

    def at(line: Column, i: Column) -> Column:
        near = F.coalesce(match(F.get(all_lines, i + 1)), F.when(i > 0, match(F.get(all_lines, i - 1))))
        return F.coalesce(match(line), F.when(line.rlike(r"(?i)\banswer\b"), near))

    return last_some(F.transform(all_lines, at))


def backward_vector(text: Column) -> Column:
    return backward(text, r"(?i)(CVSS:3\.1/\S+)")


def backward_technique(text: Column) -> Column:
    """The parent of the technique found."""
    return F.element_at(F.split(F.upper(backward(text, r"(?i)(T\d{4}(?:\.\d{3})?)")), r"\."), 1)


def backward_text(text: Column) -> Column:
    """The line found without quotes around it and with single spaces."""
    return F.regexp_replace(F.trim(backward(text, "(.+)"), F.lit("\"'")), r"\s+", " ")


def backward_mitigations(text: Column) -> Column:
    """All mitigation ids of the line found, as they stand; empty without any."""
    return F.array_join(F.regexp_extract_all(F.upper(backward_text(text)), F.lit(r"(M\d{4})")), ", ")


def answer_colon(text: Column) -> Column:
    return F.upper(found(text, r"(?i)ANSWER:?\s*([A-D])"))


def letters_anywhere(text: Column) -> Column:
    """Distinct capital letters A-D of the text without "Answer:"."""
    return F.nullif(joined(every(F.regexp_replace(text, "Answer:", ""), "([A-D])")), F.lit(""))


def recent_lines(text: Column) -> Column:
    """The last five non-empty lines, latest first: a leading option, a standalone letter, a letter at the end; else the
    only letter of the text."""
    clean = lambda line: F.replace(line, F.lit("**"), F.lit(" "))
    in_line = lambda line: F.coalesce(found(clean(line), r"^([ABCD])[).:]"), found(clean(line), r"\b([ABCD])\b"), found(clean(line), r"(?:^|[^A-Za-z0-9])([ABCD])$"))
    tail = F.filter(F.transform(F.slice(F.reverse(lines(text)), 1, 5), in_line), lambda x: x.isNotNull())
    letters = F.array_distinct(every(text, "([ABCD])"))
    return F.coalesce(F.try_element_at(tail, F.lit(1)), F.when(F.size(letters) == 1, F.get(letters, F.lit(0))))


def bottom_up(text: Column, letters: str, words: bool = False) -> Column:
    """The first standalone letter of the last line that has one; with words, TRUE and FALSE count as T and F first."""
    letter = lambda line: found(F.upper(line), f"(?:^|[^A-Z])([{letters}])(?:[^A-Z]|$)")
    word = lambda line: F.when(line.rlike(r"(?i)\btrue\b"), F.lit("T")).when(line.rlike(r"(?i)\bfalse\b"), F.lit("F"))
    return last_some(F.transform(lines(text), lambda line: F.coalesce(word(line), letter(line)) if words else letter(line)))


def cascade(text: Column) -> Column:
    """By priority: "Answer: X" (bold first), a line that is a letter, a line that begins with one, any letter; each
    from the last line up."""
    all_lines = lines(text)
    of = lambda match: last_some(F.transform(all_lines, match))
    return F.coalesce(
        of(lambda x: F.upper(found(x, r"(?i)\*\*(?:Final )?Answer:\*\*\s*([A-D])\b"))),
        of(lambda x: F.upper(found(x, r"(?i)(?:Final )?Answer:\s*([A-D])\b"))),
        of(lambda x: found(F.upper(x), "^([A-D])$")),
        of(lambda x: found(F.upper(x), r"^([A-D])(?:[^)]|$)")),
        of(lambda x: found(F.upper(x), r"\b([A-D])\b")),
        last(all_lines),
    )


def several_letters(text: Column) -> Column:
    """Standalone letters, or else any letters, distinct and sorted."""
    alone = joined(every(F.upper(text), r"(?<![A-Z])([ABCD])(?![A-Z])"))
    return F.coalesce(F.nullif(alone, F.lit("")), F.nullif(joined(every(F.upper(text), "([ABCD])")), F.lit("")))


def any_ids(text: Column) -> Column:
    return id_set(every(text, r"(?i)\b(T\d{4}(?:\.\d{3})?|CWE-\d+)\b"))


def strict_ids(text: Column) -> Column:
    """Ids on the last line only."""
    return F.array_sort(F.array_distinct(every(strip(last(F.split(strip(text), "\n"))), r"(T\d{4}(?:\.?\d{1,3})?)")))


def generated_letter(text: Column) -> Column:
    """A letter at the start or else the first standalone one; "?" without any."""
    return F.coalesce(found(strip(text), r"^([A-D])\b"), found(text, r"\b([A-D])\b"), F.lit("?"))


def option_of(logprobs: Column, letters: str = "ABCD", missing: float = -100.0) -> Column:
    """The letter of greatest log probability (the first on ties) and its softmax share."""
    filled = F.transform(logprobs, lambda x: F.coalesce(x, F.lit(missing)))
    top = F.array_max(filled)
    share = F.lit(1.0) / F.aggregate(filled, F.lit(0.0), lambda s, x: s + F.exp(x - top))
    return F.struct(F.element_at(F.array(*[F.lit(c) for c in letters]), F.array_position(filled, top).cast("int")).alias("letter"), share.alias("share"))


def with_json(rows: DataFrame, reply: str = "reply") -> DataFrame:
    """rows with body, what stands in a fence or from the first to the last brace of a judge's reply, or else all of it; and
    parsed, its JSON as a variant, null if it is none.

    Columns of their own, so that each reply is searched and parsed once, however many fields are read from it."""
    fence, braces = F.regexp_extract(reply, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1), F.regexp_extract(reply, r"(?s)(\{.*\})", 1)
    parts = rows.withColumns({"_fence": fence, "_braces": braces})
    body = F.when(F.col("_fence") != "", F.col("_fence")).when(F.col("_braces") != "", F.col("_braces")).otherwise(F.col(reply))
    begun = F.when(F.col("body").rlike(r"^\s*[{\[\"\-0-9A-Zft\x{FEFF}n]"), F.col("body"))  # all else is no JSON, and failing is slow
    return parts.withColumn("body", body).withColumn("parsed", F.try_parse_json(begun)).drop("_fence", "_braces")


def judge_reply(reply: Column, parsed: Column, body: Column) -> Column:
    """verdict, extracted answer and skipped of a judge's reply: the JSON's fields, or else the keys by pattern; failures of
    the judge are skipped."""
    get = lambda key: F.try_variant_get(parsed, f"$.{key}", "string")
    failed = (strip(reply) == "") | reply.startswith("ERROR:") | reply.contains("content management policy") | reply.contains("content_filter")
    verdict = F.when(parsed.isNotNull(), F.upper(strip(F.coalesce(get("verdict"), F.lit(""))))).otherwise(F.upper(F.regexp_extract(body, r'(?i)"verdict"\s*:\s*"(CORRECT|INCORRECT)"', 1)))
    answer = F.when(parsed.isNotNull(), strip(F.coalesce(get("extracted_answer"), F.lit("")))).otherwise(F.regexp_extract(body, r'"extracted_answer"\s*:\s*"([^"]*)"', 1))
    return F.struct((~failed & (verdict == "CORRECT")).alias("is_correct"), F.when(failed, F.lit("")).otherwise(answer).alias("extracted_answer"), failed.alias("skipped"))


def vector_reply(reply: Column, parsed: Column) -> Column:
    """vector and success of a reply to a vector task: the JSON's fields, or else the first vector of the text."""
    loose = F.when(parsed.isNull(), F.regexp_extract(reply, r"(?i)((?:CVSS:3\.[01]/)?AV:[A-Z]+/AC:[A-Z]+/PR:[A-Z]+/UI:[A-Z]+/S:[A-Z]+/C:[A-Z]+/I:[A-Z]+/A:[A-Z]+)", 1)).otherwise("")
    stated = F.coalesce(F.try_variant_get(parsed, "$.extracted_vector", "string"), F.lit(""))
    success = F.coalesce(F.try_variant_get(parsed, "$.extraction_success", "boolean"), F.lit(False))
    return F.struct(F.when(parsed.isNotNull(), stated).otherwise(F.coalesce(loose, F.lit(""))).alias("vector"), F.when(parsed.isNotNull(), success).otherwise(F.coalesce(loose, F.lit("")) != "").alias("success"))


def score_reply(reply: Column, parsed: Column) -> Column:
    """The score of 1 to 5 of a reply: the JSON's, cut to a whole number, 1 if it is none; or else the number after
    "score", the first digit from 1 to 5 that stands alone, or 3."""
    text = F.try_variant_get(parsed, "$.score", "string")
    stated = F.coalesce(F.when(text.rlike(r"(?i)\d|inf|nan"), text).try_cast("double"), F.lit(1.0)).cast("long")  # casts that fail are slow
    loose = F.coalesce(F.when(reply.contains("score"), found(reply, r"[\"']?score[\"']?\s*[:=]\s*(\d+)\b")).try_cast("long"), F.when(reply.rlike("[1-5]"), found(reply, r"\b([1-5])\b")).cast("long"), F.lit(3).cast("long"))
    return F.greatest(F.lit(1), F.least(F.lit(5), F.when(parsed.isNotNull(), stated).otherwise(loose)))


def text_reply(reply: Column, parsed: Column) -> Column:
    """Whether a reply says CORRECT: the JSON's verdict, or else the word without INCORRECT anywhere."""
    upper = F.upper(reply)
    stated = F.upper(strip(F.coalesce(F.try_variant_get(parsed, "$.verdict", "string"), F.lit("")))) == "CORRECT"
    return F.coalesce(F.when(parsed.isNotNull(), stated).otherwise(upper.contains("CORRECT") & ~upper.contains("INCORRECT")), F.lit(False))


def class_reply(text: Column) -> Column:
    """Class K or A of a reply and how it was found: a JSON envelope, the last key and value, the last explicit
    statement, the last declarative one, the last letter of the end, the last letter anywhere."""
    envelope = F.coalesce(found(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```"), found(text, r"(?s)(\{.*?\})"))
    label = F.upper(strip(F.try_variant_get(F.try_parse_json(envelope), "$.class", "string")))
    ways = [
        ("json_envelope", found(label, "^([KA])")),
        ("key_val_last", F.upper(last(every(text, r'(?i)"class"\s*:\s*"([KA])')))),
        ("explicit_last", F.upper(last(every(text, r"(?i)(?:class|verdict|final answer)\s*[:=]\s*\**([KA])\b")))),
        ("declarative_last", F.upper(last(every(text, r"(?i)\b(?:fits|should be|is)\s+\**([KA])\b")))),
        ("bare_tail_last", last(every(F.substring(text, -400, 400), r"\b([KA])\b"))),
        ("bare_full_last", last(every(text, r"\b([KA])\b"))),
    ]
    mode = F.when(F.coalesce(text, F.lit("")) == "", F.lit("empty"))
    for name, value in ways:
        mode = mode.when(value.isNotNull(), F.lit(name))
    return F.struct(F.coalesce(*[v for _, v in ways]).alias("label"), mode.otherwise(F.lit("no_match")).alias("mode"))


def response_format(text: Column) -> Column:
    words = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    return (
        F.when(text.rlike(r"(?m)^\s*[•\-*]\s"), "bullet_points").when(text.rlike(r"(?m)^\s*\d+\."), "numbered_list").when(words > 10, "prose").when(text.contains(","), "comma_separated").otherwise("simple")
    )
