"""Column functions on texts: stripping, cutting, flattening of prompts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Task instructions that prompts carry, matched case-insensitively and line by line.
BOILERPLATE = (
    r"Choose the correct answer \(A, B, C, or D\) only\.\s*Always return in this format:\s*'ANSWER:\s*X'\.?",
    r"Return your answer as a single uppercase letter:\s*A,\s*B,\s*C,\s*or\s*D\.?\s*\*?\*?Important:?\*?\*?\s*The last line of your answer should contain only the single letter corresponding to the best option, with no additional text\.?",
    r"Answer with the option letter\s*\(A,\s*B,\s*C,\s*D\)\s*from the given choices directly\.?",
    r"Answer with the option letter from the given choices directly\.?",
    r"Ensure the final line contains only the IDs for the main techniques,\s*separated by commas,\s*excluding any subtechnique IDs\.?",
    r"Provide.*MITRE.*technique IDs.*comma.*separated.*",
    r"Ensure the final line of your response contains only the CVSS v3 Vector String in the following format:[^\n]*Example format:\s*CVSS:3\.1/[^\s]+",
    r"Ensure the final line of your response contains only the CVSS v3 Vector String[^\n]*",
    r"Return your answer as either T \(for True\) or F \(for False\)\.\s*If you do not know the answer,\s*return X\.\s*Provide only the letter corresponding to your choice\s*\(T,\s*F,\s*or X\)\s*without any additional text or explanations\.?",
    r"Ensure the last line of your response contains only the CWE ID\.?",
    r"\nAnswer:\s*$",
)


def strip(text: Column) -> Column:
    """Without white space at the ends (trim() takes spaces only)."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def lines(text: Column) -> Column:
    """The non-empty lines, stripped."""
    return F.filter(F.transform(F.split(text, "\n"), strip), lambda x: x != "")


def found(text: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, or null."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def every(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def last(array: Column) -> Column:
    """The last element, or null."""
    return F.try_element_at(array, F.lit(-1))


def last_some(array: Column) -> Column:
    """The last element that is not null."""
    return last(F.filter(array, lambda x: x.isNotNull()))


def after_thinking(text: Column) -> Column:
    """What follows the last </think>, stripped."""
    return strip(last(F.split(text, "</think>")))


def thinking(text: Column) -> Column:
    """What stands in the first pair of think tags, or after one that is not closed; null without tags."""
    closed = F.regexp_extract(text, r"(?s)<think>(.*?)</think>", 1)
    return F.when(text.rlike(r"(?s)<think>.*?</think>"), strip(closed)).when(text.contains("<think>"), strip(F.regexp_extract(text, r"(?s)<think>(.*)", 1)))


def answer_part(text: Column) -> Column:
    """The text after the first pair of think tags; empty if the tag is not closed; all of it without tags."""
    return F.when(text.rlike(r"(?s)<think>.*?</think>"), strip(F.regexp_replace(text, r"(?s)^.*?<think>.*?</think>", ""))).when(text.contains("<think>"), F.lit("")).otherwise(strip(text))


def cut_at(text: Column, stops: Sequence[str]) -> Column:
    """The text before the earliest of several stop strings, stripped."""
    at = F.least(*[F.nullif(F.instr(text, s), F.lit(0)) for s in stops], F.char_length(text) + 1) if stops else F.char_length(text) + 1
    return strip(F.substring(text, F.lit(1), at - 1))


def without_boilerplate(text: Column, patterns: Sequence[str] = BOILERPLATE) -> Column:
    for pattern in patterns:
        text = F.regexp_replace(text, f"(?im){pattern}", "")
    return strip(text)


def snippet(text: Column, n: int = 300) -> Column:
    return F.substring(text, 1, n)


def word_snippet(text: Column, n: int) -> Column:
    """At most n characters, ended at white space if the text is longer."""
    return F.when(F.char_length(text) <= n, text).otherwise(F.coalesce(found(text, rf"(?s)^(.{{0,{n}}})\s"), F.substring(text, 1, n)))


def user_turns(turns: Column) -> Column:
    """Contents of the user turns of an array of (role, content), joined by blank lines."""
    return F.array_join(F.transform(F.filter(turns, lambda m: (m["role"] == "user") & (m["content"] != "")), lambda m: m["content"]), "\n\n")


def last_user_turn(turns: Column) -> Column:
    return last(F.filter(turns, lambda m: m["role"] == "user"))["content"]


def all_turns(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda m: m["content"]), "\n\n")


def task_key(task: Column) -> Column:
    return F.lower(F.replace(task, F.lit("-"), F.lit("_")))
