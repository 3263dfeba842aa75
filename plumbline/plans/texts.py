"""Queries on prompts and on the extraction of answers."""

from pyspark.sql import functions as F

from ..functions import extract, text
from ..operators import agreement, citations, mentions, prompts
from .registry import add

ID = ["task", "model_id", "idx"]
THINK = r"regexp_replace(list_last(string_split(text, '</think>')), '^\s+|\s+$', '', 'g')"
LINES = r"list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')"


def policy(name: str, column, sql: str, source: str = "answers") -> None:
    """A query of one extraction policy over the answers, arrays joined to text."""
    add(name, lambda t: getattr(t, source).select(*ID, column(F.col("text")).alias("answer")), f"SELECT task, model_id, idx, {sql} AS answer FROM {source}")


def all_of(pattern: str, x: str = "text") -> str:
    return f"regexp_extract_all({x}, '{pattern}', 1)"


def sorted_set(array: str) -> str:
    return f"array_to_string(list_sort(list_distinct({array})), ',')"


def last_line(match: str) -> str:
    """The last line for which match (an expression of x) is not null."""
    return f"list_last(list_filter(list_transform({LINES}, lambda x: {match}), lambda y: y IS NOT NULL))"


def some(pattern: str, x: str = "text", group: int = 1) -> str:
    return f"nullif(regexp_extract({x}, '{pattern}', {group}), '')"


listed = lambda f: lambda c: F.array_join(f(c), ",")
VEC = "AV:[A-Za-z]+/AC:[A-Za-z]+/PR:[A-Za-z]+/UI:[A-Za-z]+/S:[A-Za-z]+/C:[A-Za-z]+/I:[A-Za-z]+/A:[A-Za-z]+"
PRE = r"^\s*(?:final\s+answer|answer|prediction|output|result)\s*[:\-–—]?\s*"

policy("e01_voting_mcq", extract.voting_mcq, rf"nullif(upper(array_to_string(list_sort(list_distinct({all_of(r'\b([A-Da-d])\b', THINK)})), '')), '')")
policy("e02_voting_tfx", extract.voting_tfx, f"upper(list_last({all_of(r'\b([TFXtfx])\b', THINK)}))")
policy("e03_id_sets", lambda c: F.array_join(F.concat(extract.technique_ids(c), extract.mitigation_ids(c)), ","), rf"array_to_string(list_concat(list_sort(list_distinct({all_of(r'\b(T\d{4}(?:\.\d{3})?)\b', 'upper(text)')})), list_sort(list_distinct({all_of(r'\b(M\d{4})\b', 'upper(text)')}))), ',')")
policy("e04_vector", extract.vector, f"upper({some(f'((?:CVSS:3[.][01]/)?{VEC})', THINK)})")
policy("e05_free_text", extract.free_text, rf"nullif(substr(regexp_replace(lower({THINK}), '^\s+|\s+$', '', 'g'), 1, 200), '')")
TYPED = f"""CASE task_type WHEN 'mcq' THEN nullif(upper(array_to_string(list_sort(list_distinct({all_of(r'\b([A-Da-d])\b', THINK)})), '')), '') WHEN 'tfx' THEN upper(list_last({all_of(r'\b([TFXtfx])\b', THINK)}))
  WHEN 'ids' THEN nullif({sorted_set(all_of(r'\b(T\d{4}(?:\.\d{3})?)\b', f'upper({THINK})'))}, '') WHEN 'vsp' THEN upper({some(f'((?:CVSS:3[.][01]/)?{VEC})', THINK)}) END"""
add("e06_routed_prediction", lambda t: t.answers.join(F.broadcast(t.task_dim), "task").select(*ID, extract.prediction(F.col("text"), F.col("task_type")).alias("answer")), f"SELECT task, model_id, idx, {TYPED} AS answer FROM answers JOIN task_dim USING (task)")
GOLD = f"""CASE task_type WHEN 'mcq' THEN upper(array_to_string(list_sort(list_distinct({all_of('([A-Da-d])')})), '')) WHEN 'tfx' THEN {some('^([TFX])', r"upper(regexp_replace(text, '^\s+|\s+$', '', 'g'))")}
  WHEN 'ids' THEN {sorted_set(all_of(r'\b(T\d{4}(?:\.\d{3})?)\b', 'upper(text)'))} WHEN 'vsp' THEN upper({some(f'((?:CVSS:3[.][01]/)?{VEC})', THINK)}) END"""
add("e07_routed_gold", lambda t: t.answers.join(F.broadcast(t.task_dim), "task").select(*ID, extract.gold(F.col("text"), F.col("task_type")).alias("answer")), f"SELECT task, model_id, idx, {GOLD} AS answer FROM answers JOIN task_dim USING (task)")
OPT = r"coalesce(nullif(regexp_extract({0}, '^([A-D])\)', 1), ''), nullif(regexp_extract({0}, '([A-D])$', 1), ''), CASE WHEN ends_with({0}, '**') AND length({0}) >= 3 THEN substr({0}, length({0}) - 2, 1) END)"
END, BEFORE = r"regexp_replace(list_last(string_split(text, chr(10))), '\s+$', '')", r"regexp_replace(string_split(text, chr(10))[-2], '\s+$', '')"
policy("e08_last_line_option", extract.last_line_option, f"coalesce({OPT.format(END)}, CASE WHEN {END} = '' THEN {OPT.format(BEFORE)} END, replace(text, chr(10), ' '))")
policy("e09_last_cwe", extract.last_cwe, f"list_last({all_of(r'(CWE-\d+)')})")
policy("e10_last_vector", extract.last_vector, f"list_last({all_of(f'({VEC})')})")
PARENT = "list_sort(list_distinct(list_transform({0}, lambda x: string_split(upper(x), '.')[1])))"
TIDS = r"\b(T\d{4}(?:\.\d+)?)\b"
policy("e11_last_line_techniques", listed(extract.last_line_techniques), f"array_to_string(CASE WHEN len({all_of(TIDS, f'coalesce(list_last({LINES}), {chr(39)*2})')}) > 0 THEN {PARENT.format(all_of(TIDS, f'list_last({LINES})'))} ELSE {PARENT.format(all_of(TIDS))} END, ',')")


def backward(pattern: str) -> str:
    match = lambda x: f"nullif(regexp_extract(regexp_replace({x}, '{PRE}', '', 'i'), '{pattern}', 1, 'i'), '')"
    return f"""(SELECT list_last(list_filter(list_transform(ls, lambda x, i: coalesce({match('x')}, CASE WHEN regexp_matches(x, '\\banswer\\b', 'i') THEN coalesce({match('ls[i + 1]')}, CASE WHEN i > 1 THEN {match('ls[i - 1]')} END) END)), lambda y: y IS NOT NULL)) FROM (SELECT {LINES} AS ls))"""


policy("e12_backward_letter", lambda c: F.upper(extract.backward(c, r"(?i)\b([A-E])\b")), f"upper({backward(chr(92) + 'b([A-E])' + chr(92) + 'b')})")
policy("e12_backward_cwe", lambda c: F.upper(extract.backward(c, r"(?i)(CWE-\d+)")), f"upper({backward('(CWE-' + chr(92) + 'd+)')})")
policy("e12_backward_vector", extract.backward_vector, backward(r"(CVSS:3\.1/\S+)"))
policy("e12_backward_technique", extract.backward_technique, f"string_split(upper({backward(r'(T\d{4}(?:\.\d{3})?)')}), '.')[1]")
FREE = f"regexp_replace(trim({backward('(.+)')}, chr(34) || chr(39)), '\\s+', ' ', 'g')"
policy("e12_backward_text", extract.backward_text, FREE)
policy("e12_backward_mitigations", extract.backward_mitigations, f"array_to_string(regexp_extract_all(upper({FREE}), 'M\\d{{4}}'), ', ')")
policy("e13_answer_colon", extract.answer_colon, r"upper(nullif(regexp_extract(text, 'ANSWER:?\s*([A-D])', 1, 'i'), ''))")
policy("e14_letters_anywhere", extract.letters_anywhere, f"nullif(array_to_string(list_sort(list_distinct({all_of('([A-D])', "replace(text, 'Answer:', '')")})), ''), '')")
CLEAN = "replace(x, '**', ' ')"
policy(
    "e15_recent_lines", extract.recent_lines,
    f"""coalesce(list_filter(list_transform(list_reverse({LINES})[1:5], lambda x: coalesce(nullif(regexp_extract({CLEAN}, '^([ABCD])[).:]', 1), ''), nullif(regexp_extract({CLEAN}, '\\b([ABCD])\\b', 1), ''), nullif(regexp_extract({CLEAN}, '(?:^|[^A-Za-z0-9])([ABCD])$', 1), ''))), lambda y: y IS NOT NULL)[1],
      CASE WHEN len(list_distinct({all_of('([ABCD])')})) = 1 THEN {all_of('([ABCD])')}[1] END)""",
)
policy("e16_bottom_up", lambda c: extract.bottom_up(c, "ABCDX"), last_line("nullif(regexp_extract(upper(x), '(?:^|[^A-Z])([ABCDX])(?:[^A-Z]|$)', 1), '')"))
policy("e16_bottom_up_words", lambda c: extract.bottom_up(c, "TFX", True), last_line(r"coalesce(CASE WHEN regexp_matches(x, '\btrue\b', 'i') THEN 'T' WHEN regexp_matches(x, '\bfalse\b', 'i') THEN 'F' END, nullif(regexp_extract(upper(x), '(?:^|[^A-Z])([TFX])(?:[^A-Z]|$)', 1), ''))"))
policy(
    "e17_cascade", extract.cascade,
    "coalesce(" + ", ".join(last_line(m) for m in (
        r"upper(nullif(regexp_extract(x, '\*\*(?:Final )?Answer:\*\*\s*([A-D])\b', 1, 'i'), ''))", r"upper(nullif(regexp_extract(x, '(?:Final )?Answer:\s*([A-D])\b', 1, 'i'), ''))", "nullif(regexp_extract(upper(x), '^([A-D])$', 1), '')",
        "nullif(regexp_extract(upper(x), '^([A-D])(?:[^)]|$)', 1), '')", r"nullif(regexp_extract(upper(x), '\b([A-D])\b', 1), '')")) + f", list_last({LINES}))",
)
policy("e18_several_letters", extract.several_letters, f"coalesce(nullif(array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(upper(text), '[A-Z]+'), lambda x: x IN ('A', 'B', 'C', 'D')))), ''), ''), nullif(array_to_string(list_sort(list_distinct({all_of('([ABCD])', 'upper(text)')})), ''), ''))")
policy("e19_any_ids", listed(extract.any_ids), sorted_set(all_of(r"\b(T\d{4}(?:\.\d{3})?|CWE-\d+)\b", "upper(text)")))
policy("e21_strict_ids", listed(extract.strict_ids), sorted_set(all_of(r"(T\d{4}(?:\.?\d{1,3})?)", r"list_last(string_split(regexp_replace(text, '^\s+|\s+$', '', 'g'), chr(10)))")))
NAMES = "SELECT item_id, array_join(slice(split(text, ' '), 1, CAST(2 + item_id % 3 AS INT)), ' ') AS name FROM benchmark"
add(
    "e22_longest_mention",
    lambda t: mentions.longest_mention(t.documents.select(F.col("doc_id").alias("idx"), "text"), t.sql(NAMES), ["idx"]),
    "SELECT idx, arg_max(name, printf('%09d', length(name)) || name) AS name, count(*) AS mentions FROM (SELECT doc_id AS idx, lower(text) AS low FROM documents) JOIN (SELECT DISTINCT array_to_string(string_split(text, ' ')[1:2 + item_id % 3], ' ') AS name FROM benchmark) ON contains(low, lower(name)) GROUP BY ALL",
)
policy("e23_generated_letter", extract.generated_letter, r"coalesce(nullif(regexp_extract(regexp_replace(text, '^\s+|\s+$', '', 'g'), '^([A-D])\b', 1), ''), nullif(regexp_extract(text, '\b([A-D])\b', 1), ''), '?')")
LOGITS = "SELECT vec_id, [embedding[1]::DOUBLE, CASE WHEN vec_id % 5 = 0 THEN -100 ELSE embedding[2]::DOUBLE END, embedding[3]::DOUBLE, embedding[4]::DOUBLE] AS lp FROM embeddings"
add(
    "e24_option_softmax",
    lambda t: t.embeddings.select("vec_id", extract.option_of(F.array(F.col("embedding")[0].cast("double"), F.when(F.col("vec_id") % 5 != 0, F.col("embedding")[1].cast("double")), F.col("embedding")[2].cast("double"), F.col("embedding")[3].cast("double"))).alias("o")).select("vec_id", "o.letter", F.round("o.share", 9).alias("share")),
    "SELECT vec_id, substr('ABCD', list_position(lp, list_max(lp)), 1) AS letter, round(1 / list_sum(list_transform(lp, lambda x: exp(x - list_max(lp)))), 9) AS share FROM logits",
    logits=LOGITS,
)
add(
    "e25_judge_replies",
    lambda t: extract.with_json(t.judge_replies).select("task", "model_id", "idx", "judge", extract.judge_reply(F.col("reply"), F.col("parsed"), F.col("body")).alias("r")).select("task", "model_id", "idx", "judge", "r.*"),
    """SELECT task, model_id, idx, judge, NOT skipped AND is_correct AS is_correct, CASE WHEN NOT skipped AND idx % 3 = 0 THEN 'B' ELSE '' END AS extracted_answer, skipped FROM verdicts""",
)
#: Replies of older judges: JSON in a fence, amid text, without the fields; broken JSON; plain text with the fields, without, and nothing.
OLD = """SELECT task, model_id, idx, judge, is_correct, form, vector, score, concat('so: ', CASE form WHEN 0 THEN concat('```json {"verdict": "', word, '", "score": ', CAST(score AS STRING), ', "extracted_vector": "', vector, '", "extraction_success": true} ``` {"score": 2}')
  WHEN 1 THEN concat('I say {"verdict": " ', lower(word), ' ", "score": "', CAST(score AS STRING), '.7", "extracted_vector": "', vector, '", "extraction_success": false} done') WHEN 2 THEN '{"reason": "none", "score": "high"}'
  WHEN 3 THEN concat('{"verdict": "', word, '", "score": ', CAST(score AS STRING), ', "extracted_vector": "', vector, '", oops') WHEN 4 THEN concat('It is ', lower(word), '. Score = ', CAST(score AS STRING), ' of all, ', lower(vector)) WHEN 5 THEN 'neither one' ELSE '' END) AS reply FROM (
  SELECT v.task, v.model_id, v.idx, v.judge, v.is_correct, v.idx % 7 AS form, (v.idx * 3 + v.model_id) % 9 AS score, CASE WHEN v.is_correct THEN 'CORRECT' ELSE 'INCORRECT' END AS word, concat('CVSS:3.1/AV:', substr('NALP', CAST(v.idx % 4 + 1 AS INT), 1), '/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:N') AS vector FROM verdicts v)"""
add(
    "e25_older_replies",
    lambda t: extract.with_json(t.sql(OLD)).select("task", "model_id", "idx", "judge", *[f(F.col("reply"), F.col("parsed")).alias(c) for c, f in (("v", extract.vector_reply), ("score", extract.score_reply), ("is_correct", extract.text_reply))]).select("task", "model_id", "idx", "judge", "v.*", "score", "is_correct"),
    """SELECT task, model_id, idx, judge, CASE form WHEN 2 THEN '' WHEN 4 THEN lower(vector) WHEN 5 THEN '' WHEN 6 THEN '' ELSE vector END AS vector, form IN (0, 3, 4) AS success,
      CAST(CASE form WHEN 0 THEN greatest(1, least(5, score)) WHEN 1 THEN greatest(1, least(5, score)) WHEN 2 THEN 1 WHEN 3 THEN greatest(1, least(5, score)) WHEN 4 THEN CASE WHEN score BETWEEN 1 AND 5 THEN score ELSE 3 END ELSE 3 END AS BIGINT) AS score,
      is_correct AND form IN (0, 1, 3, 4) AS is_correct FROM old_""",
    old_=OLD.replace("STRING", "VARCHAR"),
)
add(
    "e26_class_replies",
    lambda t: t.class_replies.select("idx", "rater", extract.class_reply(F.col("reply")).alias("r")).select("idx", "rater", "r.label", "r.mode"),
    "SELECT idx, rater, CASE WHEN k < 6 THEN class END AS label, CASE WHEN k < 2 THEN 'json_envelope' WHEN k = 2 THEN 'key_val_last' WHEN k = 3 THEN 'explicit_last' WHEN k = 4 THEN 'declarative_last' WHEN k = 5 THEN 'bare_tail_last' ELSE 'empty' END AS mode FROM (SELECT *, (idx + length(rater)) % 7 AS k FROM class_replies)",
)
add(
    "e27_reparse_changes",
    lambda t: t.class_replies.select("class", extract.class_reply(F.col("reply")).alias("r")).select(F.when(F.col("r.label").isNull(), "unparseable").when(F.col("r.label") == F.col("class"), "same").otherwise("changed").alias("change"), F.col("r.mode").alias("mode")).groupBy("change", "mode").agg(F.count("*").alias("n")),
    "SELECT CASE WHEN k = 6 THEN 'unparseable' ELSE 'same' END AS change, CASE WHEN k < 2 THEN 'json_envelope' WHEN k = 2 THEN 'key_val_last' WHEN k = 3 THEN 'explicit_last' WHEN k = 4 THEN 'declarative_last' WHEN k = 5 THEN 'bare_tail_last' ELSE 'empty' END AS mode, count(*) AS n FROM (SELECT (idx + length(rater)) % 7 AS k FROM class_replies) GROUP BY ALL",
)
policy("e28_response_format", extract.response_format, r"CASE WHEN regexp_matches(text, '(?m)^\s*[•\-*]\s') THEN 'bullet_points' WHEN regexp_matches(text, '(?m)^\s*\d+\.') THEN 'numbered_list' WHEN len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) > 10 THEN 'prose' WHEN contains(text, ',') THEN 'comma_separated' ELSE 'simple' END")
TRUST = {1: ("example.org",), 2: ("example.net",)}
VERDICT = "SELECT page_id AS idx, CASE page_id % 3 WHEN 0 THEN 'uncertain' WHEN 1 THEN 'gold_wrong' ELSE 'gold_correct' END AS verdict FROM pages"


def cited(t):
    return citations.tiers(t.pages.select(F.col("page_id").alias("idx"), "url"), TRUST)


TIERED = "SELECT page_id AS idx, url, CASE WHEN contains(lower(url), 'example.org') THEN 1 WHEN contains(lower(url), 'example.net') THEN 2 ELSE 3 END AS tier FROM pages"
DOWN = "SELECT idx, tier, CASE WHEN tier > 2 THEN 'uncertain' ELSE verdict END AS verdict, CASE WHEN tier > 2 AND verdict <> 'uncertain' THEN concat('[no trusted source] was ', verdict) END AS note, verdict AS before FROM verdict_ JOIN tiered USING (idx)"
add("e29_citation_tiers", lambda t: citations.downgraded(t.sql(VERDICT), cited(t)), "SELECT idx, CAST(tier AS INTEGER) AS tier, verdict, note FROM down", verdict_=VERDICT, tiered=TIERED, down=DOWN)
add(
    "e30_retiered",
    lambda t: citations.restored(citations.downgraded(t.sql(VERDICT), cited(t)), citations.tiers(t.pages.select(F.col("page_id").alias("idx"), "url"), {1: ("example.org", "/en/"), 2: ("example.net",)})).select("idx", "verdict", "note"),
    "SELECT idx, CASE WHEN note IS NOT NULL AND contains(lower(url), '/en/') THEN before ELSE verdict END AS verdict, CASE WHEN NOT (note IS NOT NULL AND contains(lower(url), '/en/')) THEN note END AS note FROM down JOIN (SELECT page_id AS idx, url FROM pages) USING (idx)",
    verdict_=VERDICT, tiered=TIERED, down=DOWN,
)

# prompts
FIELDS = "SELECT doc_id AS idx, source AS task, CASE WHEN doc_id % 3 = 0 THEN '' ELSE text END AS prompt, lang AS question, CASE WHEN doc_id % 4 = 0 THEN '' ELSE CAST(doc_id % 7 AS STRING) END AS answer, 'C' AS label FROM documents"
add(
    "p01_fields",
    lambda t: prompts.normalised(t.sql(FIELDS.replace("AS prompt", "AS p1")), ["p1", "question"], ["answer", "label"]).select("idx", "prompt", "gold"),
    "SELECT idx, coalesce(nullif(prompt, ''), question) AS prompt, CASE WHEN answer IN ('0', '1', '2', '3') THEN substr('ABCD', CAST(answer AS INT) + 1, 1) ELSE coalesce(nullif(answer, ''), 'C') END AS gold FROM fields",
    fields=FIELDS,
)
add("p02_nested_gold", lambda t: t.events.select("event_id", prompts.nested_gold(F.when(F.col("event_id") % 2 == 0, F.col("event_type")).otherwise(F.lit("")), F.col("props"), "$.k").alias("gold")), "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_type ELSE json_extract_string(props, '$.k') END AS gold FROM events")
add("p03_side_gold", lambda t: t.items.join(t.labels.select(F.col("doc_id").alias("idx"), F.col("quality").cast("string").alias("side")), "idx", "left").select("idx", F.coalesce("side", "gold").alias("gold")), "SELECT idx, coalesce(CAST(quality AS VARCHAR), gold) AS gold FROM items LEFT JOIN labels ON doc_id = idx")
add(
    "p04_mcq_prompt",
    lambda t: t.documents.select("doc_id", prompts.mcq_prompt(F.col("text"), F.array("lang", "source", F.lit("x"), F.lit("y"), F.lit("z"))).alias("prompt")),
    "SELECT doc_id, concat_ws(chr(10), text, concat('A) ', lang), concat('B) ', source), 'C) x', 'D) y') AS prompt FROM documents",
)
PROMPT = "SELECT source AS task, doc_id AS idx, text AS prompt FROM documents"
add(
    "p05_few_shot",
    lambda t: prompts.few_shot(t.sql(PROMPT).where("idx % 2 = 1"), t.sql(PROMPT).where("idx % 2 = 0").select("task", F.col("idx").alias("ord"), F.col("prompt").alias("shot")), 3).select("task", "idx", "prompt"),
    "SELECT p.task, p.idx, concat_ws(chr(10) || chr(10), prefix, prompt) AS prompt FROM prompt_ p LEFT JOIN (SELECT task, string_agg(prompt, chr(10) || chr(10) ORDER BY idx) AS prefix FROM (SELECT *, row_number() OVER (PARTITION BY task ORDER BY idx) AS n FROM prompt_ WHERE idx % 2 = 0) WHERE n <= 3 GROUP BY ALL) s ON s.task = p.task WHERE idx % 2 = 1",
    prompt_=PROMPT,
)
add("p06_modes", lambda t: prompts.modes(t.sql(PROMPT), prefix="Example. ").select("idx", "mode", "prompt"), "SELECT idx, mode, CASE mode WHEN 'few_shot' THEN concat('Example. ', prompt) WHEN 'cot' THEN concat(prompt, chr(10), 'Think step by step.') ELSE prompt END AS prompt FROM prompt_, (SELECT unnest(['zero_shot', 'few_shot', 'cot']) AS mode)", prompt_=PROMPT)
ORDER = "(idx * 7919 + {0} * 104729) % 1000003 * 48271 % 2147483647, idx"
add("p07_split", lambda t: prompts.split(t.sql(PROMPT), 2, 20).select("task", "idx", "part"), f"SELECT task, idx, CASE WHEN n <= 2 THEN 'shot' ELSE 'test' END AS part FROM (SELECT *, row_number() OVER (PARTITION BY task ORDER BY {ORDER.format(42)}) AS n FROM prompt_) WHERE n <= 22", prompt_=PROMPT)
add("p08_stratified", lambda t: prompts.stratified(t.sql(PROMPT), 15).select("task", "idx"), f"SELECT task, idx FROM (SELECT *, row_number() OVER (PARTITION BY task ORDER BY {ORDER.format(0)}) AS n FROM prompt_) WHERE n <= 15", prompt_=PROMPT)
add("p09_head", lambda t: prompts.head(t.sql(PROMPT), 5).select("task", "idx"), "SELECT task, idx FROM (SELECT *, row_number() OVER (PARTITION BY task ORDER BY idx) AS n FROM prompt_) WHERE n <= 5", prompt_=PROMPT)
MIXED = "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN concat(text, '日本') ELSE text END AS t FROM documents"
add("p10_without_chinese", lambda t: prompts.without_chinese(t.sql(MIXED), "t").select("doc_id"), "SELECT doc_id FROM mixed_ WHERE NOT regexp_matches(t, '[\\x{4E00}-\\x{9FFF}]')", mixed_=MIXED)
add("p11_valid_rows", lambda t: t.documents.where((F.col("lang") == "en") & (F.trim("text") != "") & F.col("source").isNotNull()).select("doc_id"), "SELECT doc_id FROM documents WHERE lang = 'en' AND trim(text) <> '' AND source IS NOT NULL")
PLANTED = (
    " Choose the correct answer (A, B, C, or D) only. Always return in this format: ''ANSWER: X''.", " Return your answer as a single uppercase letter: A, B, C, or D. **Important:** The last line of your answer should contain only the single letter corresponding to the best option, with no additional text.",
    " Answer with the option letter (A, B, C, D) from the given choices directly.", " answer with the option letter from the given choices directly", " Ensure the final line contains only the IDs for the main techniques, separated by commas, excluding any subtechnique IDs.", " Provide the MITRE technique IDs as a comma separated list.",
    " Ensure the final line of your response contains only the CVSS v3 Vector String in the following format: x. Example format: CVSS:3.1/AV:N", " Ensure the final line of your response contains only the CVSS v3 Vector String.", " Return your answer as either T (for True) or F (for False). If you do not know the answer, return X. Provide only the letter corresponding to your choice (T, F, or X) without any additional text or explanations.",
    " Ensure the last line of your response contains only the CWE ID.", "~Answer: ", " plain",
)
NOISY = "SELECT doc_id, concat(text, CASE doc_id % 12 " + " ".join(f"WHEN {i} THEN replace('{p}', '~', chr(10))" for i, p in enumerate(PLANTED)) + " END) AS text FROM documents"
STRIPPED = "text"
for pattern in text.BOILERPLATE:
    STRIPPED = "regexp_replace({}, '(?im){}', '', 'g')".format(STRIPPED, pattern.replace("'", "''"))
add("p12_boilerplate", lambda t: t.sql(NOISY).select("doc_id", text.without_boilerplate(F.col("text")).alias("text")), rf"SELECT doc_id, regexp_replace({STRIPPED}, '^\s+|\s+$', '', 'g') AS text FROM noisy", noisy=NOISY)


def turns(t):
    return t.conversations.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))), lambda s: F.struct(s["role"].alias("role"), s["content"].alias("content"))).alias("m"))


add(
    "p13_flattened_chats",
    lambda t: turns(t).select("conv_id", text.user_turns(F.col("m")).alias("users"), text.last_user_turn(F.col("m")).alias("last_user"), F.length(text.all_turns(F.col("m"))).cast("long").alias("n")),
    "SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) FILTER (WHERE role = 'user' AND text <> '') AS users, arg_max(text, turn) FILTER (WHERE role = 'user') AS last_user, length(string_agg(text, chr(10) || chr(10) ORDER BY turn)) AS n FROM conversations GROUP BY ALL",
)
add(
    "p14_first_source",
    lambda t: prompts.first_source(t.responses.where("(idx + model_id) % 3 <> 0"), t.models.select("model_id", (10 - F.col("model_id")).alias("pref"))).groupBy("task").agg(F.max("model_id").alias("model_id"), F.count("*").alias("n")),
    "SELECT task, model_id, count(*) AS n FROM responses r WHERE (idx + model_id) % 3 <> 0 AND model_id = (SELECT max(model_id) FROM responses q WHERE q.task = r.task AND (q.idx + q.model_id) % 3 <> 0) GROUP BY ALL",
)
add("p15_snippets", lambda t: t.documents.select("doc_id", text.snippet(F.col("text")).alias("snippet"), text.word_snippet(F.col("text"), 80).alias("words")), r"SELECT doc_id, substr(text, 1, 300) AS snippet, CASE WHEN length(text) <= 80 THEN text ELSE coalesce(nullif(regexp_extract(text, '(?s)^(.{0,80})\s', 1), ''), substr(text, 1, 80)) END AS words FROM documents")
add(
    "p16_stop_sequences",
    lambda t: t.documents.select("doc_id", text.cut_at(F.col("text"), ["\n", " the ", "."]).alias("text")),
    r"SELECT doc_id, regexp_replace(substr(text, 1, least(coalesce(nullif(strpos(text, chr(10)), 0), length(text) + 1), coalesce(nullif(strpos(text, ' the '), 0), length(text) + 1), coalesce(nullif(strpos(text, '.'), 0), length(text) + 1)) - 1), '^\s+|\s+$', '', 'g') AS text FROM documents",
)
policy("p17_answer_part", text.answer_part, r"CASE WHEN contains(text, '<think>') AND contains(text, '</think>') THEN regexp_replace(regexp_replace(text, '(?s)^.*?<think>.*?</think>', ''), '^\s+|\s+$', '', 'g') WHEN contains(text, '<think>') THEN '' ELSE regexp_replace(text, '^\s+|\s+$', '', 'g') END")
policy("p17_thinking", text.thinking, r"CASE WHEN contains(text, '</think>') THEN regexp_extract(text, '(?s)<think>(.*?)</think>', 1) WHEN contains(text, '<think>') THEN regexp_replace(regexp_extract(text, '(?s)<think>(.*)', 1), '^\s+|\s+$', '', 'g') END")
policy("p18_after_thinking", text.after_thinking, THINK)
add("p19_task_keys", lambda t: t.task_dim.select("task", text.task_key(F.concat(F.upper("task"), F.lit("-X"))).alias("key")), "SELECT task, lower(replace(concat(upper(task), '-X'), '-', '_')) AS key FROM task_dim")
add(
    "p20_todo",
    lambda t: prompts.todo(t.flagged.where("frac >= 0.4"), t.verifications.where("agent = 'a0'").withColumn("failed", F.col("verdict") == "uncertain"), ["task", "idx"]).select("task", "idx"),
    "SELECT task, idx FROM flagged f WHERE frac >= 0.4 AND NOT EXISTS (SELECT 1 FROM verifications v WHERE v.task = f.task AND v.idx = f.idx AND agent = 'a0' AND verdict <> 'uncertain')",
)
add(
    "p21_judge_prompts",
    lambda t: prompts.judge_prompts(t.answers.join(F.broadcast(t.task_dim), "task").select(*ID, "task_type", F.col("task").alias("question"), "gold", text.after_thinking(F.col("text")).alias("response"))).select(*ID, "judge_prompt"),
    f"SELECT task, model_id, idx, concat('Question: ', task, chr(10), 'Gold answer: ', gold, chr(10), 'Response: ', {THINK}, chr(10), 'Expected form: ', hint, '. Rule: ', rule, '.') AS judge_prompt FROM answers JOIN task_dim USING (task) JOIN (" + " UNION ALL ".join(f"SELECT '{k}' AS task_type, '{h}' AS hint, '{r}' AS rule" for k, (h, r) in prompts.JUDGE_RULES.items()) + ") USING (task_type)",
)
CHOICES = """CASE idx % 5 WHEN 0 THEN concat('["first ', CAST(idx AS STRING), '", "second", "third"]') WHEN 1 THEN concat('{"B": "two", "A": "one ', CAST(idx AS STRING), '"}') WHEN 2 THEN concat('A) one', chr(10), 'B) two') WHEN 3 THEN '[]' END"""
CHOICE_BLOCK = """CASE WHEN task_type = 'mcq' AND idx % 5 < 3 THEN concat(chr(10), chr(10), 'Answer choices:', chr(10), CASE idx % 5 WHEN 0 THEN concat('A) first ', idx, chr(10), 'B) second', chr(10), 'C) third') WHEN 1 THEN concat('A. one ', idx, chr(10), 'B. two') ELSE concat('A) one', chr(10), 'B) two') END) ELSE '' END"""


def asked(t):
    rows = t.answers.join(F.broadcast(t.task_dim), "task").withColumn("choices", F.expr(CHOICES))
    return rows.select(*ID, "task_type", prompts.question_block(F.col("task"), F.col("choices"), F.col("task_type")).alias("question"), "gold", text.after_thinking(F.col("text")).alias("response"))


add(
    "p21_prompts_with_choices",
    lambda t: prompts.judge_prompts(asked(t)).select(*ID, "judge_prompt"),
    f"SELECT task, model_id, idx, concat('Question: ', task, {CHOICE_BLOCK}, chr(10), 'Gold answer: ', gold, chr(10), 'Response: ', {THINK}, chr(10), 'Expected form: ', hint, '. Rule: ', rule, '.') AS judge_prompt FROM answers JOIN task_dim USING (task) JOIN (" + " UNION ALL ".join(f"SELECT '{k}' AS task_type, '{h}' AS hint, '{r}' AS rule" for k, (h, r) in prompts.JUDGE_RULES.items()) + ") USING (task_type)",
)

# sources that are queries over tables
add(
    "s11_first_available",
    lambda t: agreement.first_available(t.verdicts.where("not (judge = 'def' and model_id % 2 = 0)"), t.judges).groupBy("task", "model_id").agg(F.max("judge").alias("judge"), F.count("*").alias("n")),
    "SELECT task, model_id, judge, count(*) AS n FROM verdicts WHERE judge = CASE WHEN model_id % 2 = 0 THEN 'v1' ELSE 'def' END GROUP BY ALL",
)
add(
    "s12_last_duplicate",
    lambda t: agreement.last_of(t.verdicts.join(t.judges, "judge").select("task", "model_id", "idx", "is_correct", "jn"), ["task", "model_id", "idx"], "jn").select("task", "model_id", "idx", "is_correct"),
    "SELECT task, model_id, idx, is_correct FROM verdicts WHERE judge = 'v2'",
)
add(
    "s14_summary_lookup",
    lambda t: t.task_dim.join(t.cells.select(F.upper("task").alias("key"), "model_id", F.col("acc"), "n"), F.upper(F.replace("task", F.lit("-"), F.lit("_"))) == F.col("key")).select("task", "model_id", "acc", "n"),
    "SELECT task, model_id, acc, n FROM cells",
)
ROUTES = "SELECT 'src1' AS prefix, 'one' AS benchmark UNION ALL SELECT 'src', 'other'"
add(
    "s15_routing",
    lambda t: t.task_dim.join(F.broadcast(t.sql(ROUTES)), F.col("task").startswith(F.col("prefix"))).groupBy("task").agg(F.max_by("benchmark", F.when(F.col("task") == F.col("prefix"), 100).otherwise(F.length("prefix"))).alias("benchmark")),
    "SELECT task, CASE WHEN starts_with(task, 'src1') THEN 'one' ELSE 'other' END AS benchmark FROM task_dim",
)
