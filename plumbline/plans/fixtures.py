"""Evaluation tables derived from the driver's tables, in SQL that Spark and the checking engine both read.

documents.source acts as the task, ten customers as models; answers follow from integer arithmetic on the ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

VIEWS = {
    "models": "SELECT CAST(c_custkey - 1 AS BIGINT) AS model_id FROM customer WHERE c_custkey BETWEEN 1 AND 10",
    "items": "SELECT source AS task, doc_id AS idx, substr('ABCD', CAST(((doc_id * 31 + 7) % 10007) % 4 + 1 AS INT), 1) AS gold FROM documents",
    "responses": """
      SELECT k.task, k.model_id, k.idx, substr('ABCD', CAST(k.g + 1 AS INT), 1) AS ground_truth,
        CASE WHEN k.style = 0 THEN concat('ANSWER: ', k.p) WHEN k.style = 1 THEN k.p WHEN k.style = 2 THEN concat('<think>maybe D</think> ', k.p)
             WHEN k.style = 3 THEN concat('The answer is ', k.p, '.') ELSE '' END AS model_response
      FROM (SELECT r.*, substr('ABCD', CAST(CASE WHEN r.h < 45 + 5 * r.model_id THEN r.g ELSE (r.g + 1 + r.h % 3) % 4 END + 1 AS INT), 1) AS p
            FROM (SELECT d.source AS task, m.model_id, d.doc_id AS idx, ((d.doc_id * 31 + 7) % 10007) % 4 AS g,
                    ((d.doc_id * 7919 + m.model_id * 104729) % 10007) % 100 AS h, ((d.doc_id * 17 + m.model_id * 13) % 10009) % 5 AS style
                  FROM documents d CROSS JOIN models m) r) k""",
    "judges": "SELECT 0 AS jn, 'def' AS judge UNION ALL SELECT 1 AS jn, 'v1' AS judge UNION ALL SELECT 2 AS jn, 'v2' AS judge",
    "verdicts": """
      SELECT r.task, r.model_id, r.idx, j.judge,
        CASE WHEN ((r.idx * 613 + r.model_id * 71 + j.jn * 29) % 10007) % 20 = 0 THEN NOT r.ok ELSE r.ok END AS is_correct,
        ((r.idx * 409 + r.model_id * 37 + j.jn * 53) % 10007) % 50 = 0 AS skipped
      FROM (SELECT task, model_id, idx, model_response LIKE concat('%', ground_truth, '%') AS ok FROM responses) r CROSS JOIN judges j""",
    "judge_replies": """
      SELECT v.task, v.model_id, v.idx, v.judge,
        CASE WHEN v.skipped THEN 'ERROR: timeout'
             WHEN v.idx % 3 = 0 THEN concat('{"verdict": "', CASE WHEN v.is_correct THEN 'CORRECT' ELSE 'INCORRECT' END, '", "extracted_answer": "B"}')
             WHEN v.idx % 3 = 1 THEN concat('```json {"verdict": "', CASE WHEN v.is_correct THEN 'CORRECT' ELSE 'INCORRECT' END, '"} ```')
             ELSE concat('{"verdict": "', CASE WHEN v.is_correct THEN 'CORRECT' ELSE 'INCORRECT' END, '", oops') END AS reply
      FROM verdicts v""",
    "raters": "SELECT 0 AS rn, 'r0' AS rater UNION ALL SELECT 1 AS rn, 'r1' AS rater UNION ALL SELECT 2 AS rn, 'r2' AS rater UNION ALL SELECT 3 AS rn, 'r3' AS rater",
    "ka_verdicts": """
      SELECT d.source AS task, d.doc_id AS idx, q.rater, CASE WHEN ((d.doc_id * 811 + q.rn * 97) % 10007) % 10 < 3 + (d.doc_id % 5) THEN 'K' ELSE 'A' END AS class
      FROM documents d CROSS JOIN raters q WHERE ((d.doc_id * 211 + q.rn * 59) % 10007) % 25 <> 0""",
    "id_sets": """
      SELECT r.task, r.model_id, r.idx, concat('T', CAST(1000 + r.idx % 9 AS STRING), ', T', CAST(1000 + r.idx % 7 AS STRING), '.001') AS ground_truth,
        CASE WHEN (r.idx + r.model_id) % 13 = 0 THEN 'nothing found'
             WHEN r.idx % 4 = 0 THEN concat('Found T', CAST(1000 + (r.idx + r.model_id) % 9 AS STRING), chr(10), 'T', CAST(1000 + r.idx % 7 AS STRING))
             WHEN r.idx % 4 = 1 THEN concat('1. T', CAST(1000 + (r.idx + r.model_id) % 9 AS STRING), chr(10), '2. none')
             ELSE concat('Found T', CAST(1000 + (r.idx + r.model_id) % 9 AS STRING), ' and T', CAST(1000 + r.idx % 7 AS STRING)) END AS model_response
      FROM responses r""",
    "cvss_pairs": """
      SELECT r.task, r.model_id, r.idx,
        concat('CVSS:3.1/AV:', substr('NALP', CAST(r.idx % 4 + 1 AS INT), 1), '/AC:', substr('LH', CAST(r.idx % 2 + 1 AS INT), 1), '/PR:', substr('NLH', CAST(r.idx % 3 + 1 AS INT), 1),
          '/UI:N/S:', substr('UC', CAST(r.idx % 2 + 1 AS INT), 1), '/C:H/I:', substr('NLH', CAST(r.idx % 3 + 1 AS INT), 1), '/A:N') AS gold,
        CASE WHEN (r.idx + r.model_id) % 11 = 0 THEN 'NONE' ELSE concat('AV:', substr('NALP', CAST((r.idx + r.model_id) % 4 + 1 AS INT), 1),
          '/AC:L/PR:N/UI:R/S:U/C:', substr('NLH', CAST((r.idx + r.model_id) % 3 + 1 AS INT), 1), '/I:L/A:N') END AS pred
      FROM responses r""",
    "edges": """
      SELECT s_suppkey AS src, s_suppkey + 1 AS dst, 'alias' AS kind FROM supplier WHERE s_suppkey % 7 <> 0
      UNION ALL SELECT s_suppkey AS src, s_suppkey + 7 AS dst, 'related' AS kind FROM supplier WHERE s_suppkey % 21 = 0""",
    "task_dim": """
      SELECT source AS task, concat('P', substr(source, 4, 1)) AS parent, CAST(row_number() OVER (ORDER BY source) - 1 AS BIGINT) AS ord,
        CASE WHEN source IN ('src5') THEN 'vsp' WHEN source IN ('src6', 'src7') THEN 'ids' WHEN source IN ('src8') THEN 'tfx' ELSE 'mcq' END AS task_type
      FROM (SELECT DISTINCT source FROM documents)""",
    "predictions": """
      SELECT task, model_id, idx, ground_truth AS gold,
        nullif(regexp_extract(regexp_replace(model_response, '<think>.*</think> ', ''), '(^|[^A-Za-z])([ABCD])([^A-Za-z]|$)', 2), '') AS pred
      FROM responses""",
    "answers": """
      SELECT task, model_id, idx, gold, CASE (idx * 3 + model_id) % 14
        WHEN 0 THEN concat('Let us see.', chr(10), 'Answer: ', p) WHEN 1 THEN concat('**', p, '**') WHEN 2 THEN concat(p, ') first option', chr(10), 'done with it')
        WHEN 3 THEN concat('<think>maybe D</think>', chr(10), p) WHEN 4 THEN concat('Final answer:', chr(10), p) WHEN 5 THEN concat('Both A and ', p, ' hold') WHEN 6 THEN 'True.'
        WHEN 7 THEN concat('ANSWER:', lower(p)) WHEN 8 THEN '' WHEN 9 THEN concat('uses CWE-79 and CWE-', CAST(idx % 90 AS STRING)) WHEN 10 THEN concat('T1059.001, T', CAST(1000 + idx % 50 AS STRING))
        WHEN 11 THEN concat('see', chr(10), 'CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:', substr('NLH', CAST(idx % 3 + 1 AS INT), 1)) WHEN 12 THEN concat('<think>open ', p) ELSE concat('mitigated by M10', CAST(10 + idx % 9 AS STRING), ' a dog', chr(10)) END AS text
      FROM (SELECT task, model_id, idx, gold, coalesce(pred, 'X') AS p FROM predictions)""",
    "class_replies": """
      SELECT idx, rater, CASE (idx + length(rater)) % 7 WHEN 0 THEN concat('{"class": "', class, '", "confidence": 0.9}') WHEN 1 THEN concat('```json {"class": "', class, '"} ```') WHEN 2 THEN concat('broken "class": "', class, '", oops')
        WHEN 3 THEN concat('Final answer: ', class) WHEN 4 THEN concat('K or A? It should be ', class) WHEN 5 THEN concat('so ', class) ELSE '' END AS reply, class
      FROM ka_verdicts""",
    "cells": """
      SELECT task, model_id, CAST(count(*) AS BIGINT) AS n, CAST(sum(CASE WHEN 2 * yes > votes THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS acc
      FROM (SELECT task, model_id, idx, sum(CASE WHEN is_correct THEN 1 ELSE 0 END) AS yes, count(*) AS votes FROM verdicts WHERE NOT skipped GROUP BY task, model_id, idx) GROUP BY task, model_id""",
    "flagged": """
      SELECT task, idx, gold, winner, frac FROM (
        SELECT task, idx, min(gold) AS gold, max_by(pred, 1000 * k - first_model) AS winner, CAST(max(k) AS DOUBLE) / sum(k) AS frac
        FROM (SELECT task, idx, gold, pred, count(*) AS k, min(model_id) AS first_model FROM predictions WHERE pred IS NOT NULL GROUP BY task, idx, gold, pred) GROUP BY task, idx)
      WHERE winner <> gold AND frac >= 0.3""",
    "verifications": """
      SELECT task, idx, agent, CASE (idx * 7 + an * 3) % 5 WHEN 0 THEN 'gold_correct' WHEN 1 THEN 'gold_wrong' WHEN 2 THEN 'gold_wrong' WHEN 3 THEN 'uncertain' ELSE 'gold_correct' END AS verdict
      FROM flagged CROSS JOIN (SELECT 0 AS an, 'a0' AS agent UNION ALL SELECT 1 AS an, 'a1' AS agent) a WHERE (idx * 11 + an * 5) % 7 <> 0""",
    "judged_answers": """
      SELECT v.task, v.model_id, v.idx, v.judge, v.is_correct, v.skipped,
        CASE WHEN (v.idx * 7 + v.model_id * 3 + j.jn * 5) % 23 = 0 THEN 'NONE' WHEN (v.idx * 5 + v.model_id + j.jn * 3) % 29 = 0 THEN concat(' ', coalesce(p.pred, 'none'), ' ')
             WHEN (v.idx * 3 + v.model_id * 2 + j.jn) % 31 = 0 THEN 'D' ELSE coalesce(p.pred, 'NONE') END AS extracted
      FROM verdicts v JOIN judges j ON v.judge = j.judge JOIN predictions p ON v.task = p.task AND v.model_id = p.model_id AND v.idx = p.idx""",
    "annotations": """
      SELECT task, model_id, idx, CASE WHEN (idx * 17 + model_id * 5) % 7 = 0 THEN ' ' WHEN (idx * 19 + model_id * 11) % 9 = 0 THEN 'incorrect' WHEN pred = gold THEN 'Correct' ELSE 'incorrect ' END AS human
      FROM predictions WHERE (idx + model_id * 3) % 11 <> 0""",
    "judge_summaries": """
      SELECT v.task, v.model_id, v.judge, CAST(sum(CASE WHEN v.is_correct AND NOT v.skipped THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS accuracy
      FROM verdicts v JOIN judges j ON v.judge = j.judge WHERE (v.model_id + length(v.task) + j.jn) % 3 <> 0 GROUP BY v.task, v.model_id, v.judge""",
    "mode_runs": """
      SELECT r.task, r.model_id, r.idx, m.mode, ((r.idx * 7919 + r.model_id * 104729) % 10007) % 100 < 40 + 4 * r.model_id + CASE WHEN m.mode = 'few_shot' THEN 6 WHEN m.mode = 'cot' THEN 12 - 3 * (r.idx % 9) ELSE 0 END AS correct
      FROM responses r CROSS JOIN (SELECT 'zero_shot' AS mode UNION ALL SELECT 'few_shot' AS mode UNION ALL SELECT 'cot' AS mode) m WHERE NOT (m.mode = 'cot' AND r.task = 'src3' AND r.model_id > 6)""",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table, or one of the driver's."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return query(spark, sf_dir, f"SELECT * FROM {name}")


def query(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    given = [f"{t} AS (SELECT * FROM parquet.`{sf_dir}/{t}.parquet`)" for t in needed(sql, TABLES)]
    return spark.sql(f"WITH {', '.join([*given, *[f'{n} AS ({VIEWS[n]})' for n in needed(sql, VIEWS)]])} {sql}")


def needed(sql: str, names) -> list[str]:
    """Of names those that sql or a derived table it uses mentions, in the order of their definitions."""
    import re

    used: set[str] = set()
    todo = [sql]
    while todo:
        words = set(re.findall(r"\w+", todo.pop()))
        for name in words & (set(VIEWS) | set(TABLES)):
            if name not in used:
                used.add(name)
                if name in VIEWS:
                    todo.append(VIEWS[name])
    return [n for n in names if n in used]


def counted(sql: str) -> str:
    """count_if(x) as count(nullif(x, FALSE)), which is a BIGINT and never null in either engine."""
    while (at := sql.find("count_if(")) >= 0:
        depth, end = 1, at + len("count_if(")
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        sql = f"{sql[:at]}count(nullif({sql[at + len('count_if('):end - 1]}, FALSE)){sql[end:]}"
    return sql


def oracle(sql: str, **more: str) -> str:
    """sql with the derived tables it needs (and further ones) before it."""
    sql, more = counted(sql), {n: counted(s) for n, s in more.items()}
    body = sql + " ".join(more.values())
    parts = [f"{n} AS ({VIEWS[n]})" for n in needed(body, VIEWS)] + [f"{n} AS ({s})" for n, s in more.items()]
    return f"WITH {', '.join(parts)} {sql}" if parts else sql
