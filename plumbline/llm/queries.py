"""The registered queries of this package, one for each operator, and SQL that gives the same rows where SQL can."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, fingerprint, html_extract, license_scan, line_dedup, merkle_manifest, mixing, ngram_join, periodic_runs, personal_data, quality_rules, sentence_pieces, substring_dedup
from .common import table


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


MIXING_SQL = r"""
WITH RECURSIVE sizes AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
sums AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM sizes GROUP BY source),
weighted AS (
  SELECT source, source_size, CASE place % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM sums),
levels AS (
  SELECT *,
    CAST(sum(source_size) OVER () - coalesce(sum(source_size * 3) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS rest,
    sum(weight) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest_weight
  FROM weighted),
targets AS (
  SELECT source, source_size, least(weight * max(CASE WHEN weight * (rest / rest_weight) <= source_size * 3 THEN rest / rest_weight END) OVER (), CAST(source_size * 3 AS DOUBLE)) AS target
  FROM levels),
ranked AS (
  SELECT doc_id, s.source, size, source_size, target, row_number() OVER (PARTITION BY s.source ORDER BY size, doc_id) AS rank, count(*) OVER (PARTITION BY s.source) AS docs,
    CAST(('0x' || substr(md5('17:' || coalesce(s.source, chr(0))), 1, 4)) AS BIGINT) / 65536 AS shift
  FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
large AS (
  SELECT source, 0 AS k, CAST(max(target) AS DOUBLE) AS left_, CAST(max(source_size) AS BIGINT) AS rest, CAST(max(shift) AS DOUBLE) AS at_, 0::BIGINT AS copies FROM ranked GROUP BY source
  UNION ALL SELECT source, k, left_ - got * size, rest - size, next_, got FROM (
    SELECT *, CASE WHEN size > 0 THEN greatest(least(3, greatest(CAST(floor(next_) - floor(at_) AS BIGINT), CAST(ceil((left_ - (rest - size) * 3) / size) AS BIGINT)), CAST(floor(left_ / size) AS BIGINT)), 0) ELSE 0 END AS got FROM (
      SELECT r.source, r.size, k + 1 AS k, left_, rest, at_, at_ + CASE WHEN rest > 0 THEN left_ / rest ELSE 0 END AS next_
      FROM large l JOIN ranked r ON r.source IS NOT DISTINCT FROM l.source AND r.docs - r.rank = l.k WHERE l.k < 128))),
others AS (SELECT source, CASE WHEN rest > 0 THEN left_ / rest ELSE 0 END AS step FROM large QUALIFY row_number() OVER (PARTITION BY source ORDER BY k DESC) = 1),
placed AS (SELECT r.*, step, copies, CASE WHEN rank % 2 = 1 THEN (rank + 1) // 2 ELSE docs - 128 - rank // 2 + 1 END AS place
  FROM ranked r JOIN others o ON r.source IS NOT DISTINCT FROM o.source LEFT JOIN large l ON r.source IS NOT DISTINCT FROM l.source AND r.docs - r.rank + 1 = l.k)
SELECT doc_id, size, source_size, target, CAST(coalesce(copies, least(floor(place * step + shift) - floor((place - 1) * step + shift), 3)) * size AS BIGINT) AS taken
FROM placed
"""

QUERIES = {"op7_quality_rules": op7_quality_rules, "op9_mixing": op9_mixing}
ORACLES = {"op9_mixing": MIXING_SQL}


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    added = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat_format.digests(chat_format.formatted(given.unionByName(added)))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_fingerprints(table(spark, sf_dir, "documents"))


CHAT_SQL = r"""
WITH given AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
turns AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place, count(*) OVER (PARTITION BY conv_id) AS n,
    length('<turn> ### ' || regexp_replace(regexp_replace(role, '(\\*)(<turn>|</turn>|###)', '\\\1\2', 'g'), ':(\\*)\n', ':\\\1' || chr(10), 'g') || ':' || chr(10)
      || regexp_replace(text, '(\\*)(<turn>|</turn>|###)', '\\\1\2', 'g') || ' </turn>' || chr(10)) AS chars
  FROM given),
summed AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY place) AS context FROM turns)
SELECT conv_id, CAST(min(n) AS BIGINT) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(CASE WHEN role = 'assistant' OR place = n THEN context ELSE 0 END) AS BIGINT) AS formatted_chars
FROM summed GROUP BY conv_id
"""

QUERIES |= {"op5_chat_formatting": op5_chat_formatting, "op8_fingerprints": op8_fingerprints}
ORACLES |= {"op5_chat_formatting": CHAT_SQL}


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


QUERIES |= {"op4_html_extraction": op4_html_extraction}


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


LINES_SQL = r"""
WITH split AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents WHERE text IS NOT NULL),
counted AS (SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words FROM split),
wordy AS (
  SELECT doc_id, pos, line, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS seq, sum(words) OVER (PARTITION BY doc_id ORDER BY pos) - words AS before, sum(words) OVER (PARTITION BY doc_id ORDER BY pos) AS after
  FROM counted WHERE words > 0),
windows AS (
  SELECT a.doc_id, a.seq AS first, z.seq AS last FROM wordy a ASOF JOIN wordy z ON a.doc_id = z.doc_id AND a.before + 50 <= z.after
  UNION SELECT z.doc_id, a.seq, z.seq FROM wordy z ASOF JOIN wordy a ON a.doc_id = z.doc_id AND z.after - 50 >= a.before),
texts AS (SELECT w.doc_id, first, last, string_agg(line, chr(10) ORDER BY seq) AS run FROM windows w JOIN wordy l ON l.doc_id = w.doc_id AND l.seq BETWEEN first AND last GROUP BY ALL),
later AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, first) AS nth FROM texts) WHERE nth > 1),
gone AS (SELECT DISTINCT l.doc_id, l.pos FROM later r JOIN wordy l ON l.doc_id = r.doc_id AND l.seq BETWEEN first AND last),
kept AS (SELECT s.doc_id, string_agg(line, chr(10) ORDER BY s.pos) FILTER (g.pos IS NULL) AS text, count(g.pos) AS removed_lines FROM split s LEFT JOIN gone g ON g.doc_id = s.doc_id AND g.pos = s.pos GROUP BY s.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(k.text, '') END AS text, CAST(coalesce(removed_lines, 0) AS BIGINT) AS removed_lines FROM documents d LEFT JOIN kept k USING (doc_id)
"""

QUERIES |= {"op1_line_dedup": op1_line_dedup}
ORACLES |= {"op1_line_dedup": LINES_SQL}


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup_substrings(table(spark, sf_dir, "documents"))


BYTES_SQL = r"""
WITH given AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
starts AS (SELECT doc_id, h, unnest(range(1, length(h) // 2 - 98)) AS i FROM given WHERE length(h) >= 200),
strings AS (SELECT doc_id, i, md5_number(substr(h, 2 * i - 1, 200)) AS string FROM starts),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY string ORDER BY doc_id, i) AS nth FROM strings) WHERE nth > 1),
fresh AS (SELECT *, coalesce(i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) > 100, TRUE) AS new FROM later),
numbered AS (SELECT *, count_if(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM fresh),
runs AS (SELECT doc_id, run, min(i) AS first, max(i) + 99 AS last FROM numbered GROUP BY ALL),
gaps AS (SELECT *, coalesce(lag(last) OVER (PARTITION BY doc_id ORDER BY run), 0) AS before FROM runs),
cut AS (SELECT doc_id, sum(last - first + 1) AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * before + 1, 2 * (first - before - 1)), '' ORDER BY run) || substr(any_value(h), 2 * max(last) + 1) AS kept FROM gaps JOIN given USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM given LEFT JOIN cut USING (doc_id)
"""

QUERIES |= {"op10_suffix_array_dedup": op10_suffix_array_dedup}
ORACLES |= {"op10_suffix_array_dedup": BYTES_SQL}


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_join(table(spark, sf_dir, "documents"))


JOIN_SQL = r"""
WITH RECURSIVE worded AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) >= 4 THEN list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS grams FROM worded),
sizes AS (SELECT doc_id, len(grams) AS n FROM sets),
single AS (SELECT doc_id, hash(unnest(grams)) AS gram FROM sets),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM single a JOIN single b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM met JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
both_ AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(id, reached) AS (SELECT doc_id, doc_id FROM documents UNION SELECT id, b FROM reach JOIN both_ ON reached = a)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, component_id FROM sizes JOIN (SELECT id, min(reached) AS component_id FROM reach GROUP BY id) ON id = doc_id
"""

QUERIES |= {"op3_ngram_jaccard_join": op3_ngram_jaccard_join}
ORACLES |= {"op3_ngram_jaccard_join": JOIN_SQL}


def op2_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_pieces.encode_documents(table(spark, sf_dir, "documents"))


QUERIES |= {"op2_sentence_pieces": op2_sentence_pieces}


def op6_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan_licenses(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_matches", "best_license", "best_dice", "licenses")


QUERIES |= {"op6_license_scans": op6_license_scans}


def looped(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """For one doc_id in ten the words from some place on go round and round; a null doc_id changes nothing."""
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.run_digests(table(spark, sf_dir, "documents"), looped)


#: The unsigned crc32 of doc_id as decimal digits, bit by bit; 3988292384 is the reversed polynomial.
CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: list_transform(range(8), lambda i: ((ascii(ch) >> i) & 1)::BIGINT)))),
    lambda c, bit: xor(c >> 1, (xor(c, bit) & 1) * 3988292384)))"""

RUNS_SQL = rf"""
WITH given AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w, {CRC} AS h FROM documents),
sized AS (SELECT doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS round, h // 10 AS g FROM given),
placed AS (SELECT *, CASE WHEN round THEN g % n ELSE n END AS a FROM sized),
looped AS (SELECT doc_id, n, w, a, CASE WHEN round THEN 1 + (n - a) // (3 + g % 8) ELSE 1 END AS p FROM placed),
words AS (SELECT doc_id, n, i, w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END] AS word FROM (SELECT *, unnest(range(n)) AS i FROM looped)),
six AS (SELECT doc_id, i, md5_number(string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING)) AS gram, n - i >= 6 AS whole FROM words),
pairs AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM six x JOIN six y ON x.doc_id = y.doc_id AND x.gram = y.gram AND x.i < y.i WHERE x.whole AND y.whole),
islands AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM pairs),
stretches AS (SELECT doc_id, q, min(i) AS start, count(*) + 5 AS m FROM islands GROUP BY doc_id, q, island HAVING m >= greatest(12 - q, q)),
runs AS (SELECT doc_id, start, m + q AS length, q AS period FROM stretches QUALIFY row_number() OVER (PARTITION BY doc_id, start, m + q ORDER BY q) = 1),
longest AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length DESC, start, period) = 1),
listed AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS runs FROM runs GROUP BY doc_id),
dropped AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM words ANTI JOIN dropped USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(start AS BIGINT) AS start, CAST(length AS BIGINT) AS length, CAST(period AS BIGINT) AS period, CAST(1000 * length // period AS BIGINT) AS exponent_milli,
  sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM documents d LEFT JOIN listed USING (doc_id) LEFT JOIN longest USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

QUERIES |= {"op13_periodic_runs": op13_periodic_runs}
ORACLES |= {"op13_periodic_runs": RUNS_SQL}


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    even = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    return merkle_manifest.document_manifest(table(spark, sf_dir, "documents"), F.when(even, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text")))


FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen({0}::VARCHAR) || ':' || {0}::VARCHAR END"
MERKLE_SQL = rf"""
WITH RECURSIVE given AS (
  SELECT doc_id, source, text, {" || ".join(FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars"))} AS head, CASE WHEN ({CRC}) % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS other FROM documents),
leaves AS (
  SELECT doc_id, source, sha256(head || {FIELD.format("text")}) AS leaf, sha256(head || {FIELD.format("other")}) AS changed, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n
  FROM given),
tree AS (
  SELECT source, 0 AS level, pos, n, leaf AS digest FROM leaves
  UNION ALL SELECT source, level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY pos)) FROM tree WHERE n > 1 GROUP BY source, level, pos // 3, n),
subroots AS (SELECT source, digest, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM tree WHERE n = 1),
top AS (
  SELECT 0 AS level, pos, n, digest FROM subroots
  UNION ALL SELECT level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY pos)) FROM top WHERE n > 1 GROUP BY level, pos // 3, n),
fold AS (
  SELECT doc_id, source, 0 AS level, pos, n, changed AS digest FROM leaves
  UNION ALL SELECT f.doc_id, f.source, f.level + 1, f.pos // 3, (f.n + 2) // 3, sha256(string_agg(CASE WHEN t.pos = f.pos THEN f.digest ELSE t.digest END, '' ORDER BY t.pos))
  FROM fold f JOIN tree t ON t.source IS NOT DISTINCT FROM f.source AND t.level = f.level AND t.pos // 3 = f.pos // 3 WHERE f.n > 1 GROUP BY f.doc_id, f.source, f.level, f.pos, f.n),
fold_top AS (
  SELECT f.doc_id, 0 AS level, s.pos, s.n, f.digest FROM fold f JOIN subroots s ON f.source IS NOT DISTINCT FROM s.source WHERE f.n = 1
  UNION ALL SELECT f.doc_id, f.level + 1, f.pos // 3, (f.n + 2) // 3, sha256(string_agg(CASE WHEN t.pos = f.pos THEN f.digest ELSE t.digest END, '' ORDER BY t.pos))
  FROM fold_top f JOIN top t ON t.level = f.level AND t.pos // 3 = f.pos // 3 WHERE f.n > 1 GROUP BY f.doc_id, f.level, f.pos, f.n),
siblings AS (
  SELECT f.doc_id, 0 AS stage, t.level, t.pos, t.digest FROM fold f JOIN tree t ON t.source IS NOT DISTINCT FROM f.source AND t.level = f.level AND t.pos // 3 = f.pos // 3 AND t.pos <> f.pos WHERE f.n > 1
  UNION ALL SELECT f.doc_id, 1, t.level, t.pos, t.digest FROM fold_top f JOIN top t ON t.level = f.level AND t.pos // 3 = f.pos // 3 AND t.pos <> f.pos WHERE f.n > 1),
proofs AS (SELECT doc_id, sha256(string_agg(digest, '' ORDER BY stage, level, pos)) AS proof FROM siblings GROUP BY doc_id)
SELECT l.doc_id, l.leaf, s.digest AS subroot, r.digest AS root, coalesce(p.proof, sha256('')) AS proof_sha256, f.digest AS folded_root, f.digest = r.digest AS verified
FROM leaves l JOIN subroots s ON l.source IS NOT DISTINCT FROM s.source JOIN top r ON r.n = 1 JOIN fold_top f ON f.doc_id = l.doc_id AND f.n = 1 LEFT JOIN proofs p ON p.doc_id = l.doc_id
"""

QUERIES |= {"op12_merkle_manifest": op12_merkle_manifest}
ORACLES |= {"op12_merkle_manifest": MERKLE_SQL}


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.personal_data(table(spark, sf_dir, "documents"))


QUERIES |= {"op11_personal_data": op11_personal_data}
