"""The pipeline stage by stage, and the registered queries."""

import collections
import re

import corpus_pipeline
import pytest

import __spark_entry__
from plumbline.llm import quality_rules, sentence_pieces
from plumbline.llm.common import table
from plumbline.llm.queries import ORACLES, QUERIES

from .test_corpus_operators import join_brute, line_brute
from .test_text_operators import plan_brute

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The output of each stage on the smallest tables, written and read again."""
    folder, docs, out = tmp_path_factory.mktemp("stages"), table(spark, SF, "documents"), {}
    out["documents"] = docs
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{folder}/{name}")
        docs = out[name] = spark.read.parquet(f"{folder}/{name}")
    return out


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    duck = duckdb.connect()
    for t in ("documents", "conversations"):
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    relation, df = duck.sql(ORACLES[name]), QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    assert sorted(relation.columns) == columns
    tidy = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    want = sorted(tuple(tidy(r[relation.columns.index(c)]) for c in columns) for r in relation.fetchall())
    assert sorted(tuple(tidy(r[c]) for c in columns) for r in df.collect()) == want


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "ngram_jaccard_join", "mixing", "sentence_pieces"]
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))


def test_columns(stages):
    for name, df in list(stages.items())[:-1]:
        assert df.dtypes == stages["documents"].dtypes, name


def test_quality_stage(spark, stages):
    judged = quality_rules.judge(stages["documents"], table(spark, SF, "labels"))
    assert {r.doc_id for r in judged.where("kept").collect()} == {r.doc_id for r in stages["quality_rules"].collect()}


def test_line_stage(stages):
    given = sorted(stages["quality_rules"].collect())
    want = {r.doc_id: t for r, (t, n) in zip(given, line_brute([r.text for r in given], 50), strict=True) if not n or t.strip()}
    got = {r.doc_id: r for r in stages["line_dedup"].collect()}
    assert {i: r.text for i, r in got.items()} == want and all(r.n_chars == len(r.text) for r in got.values())


def test_near_duplicate_stage(stages):
    given = sorted(stages["line_dedup"].collect())
    keep = {given[i].doc_id for i, (_, c) in enumerate(join_brute([r.text for r in given], 5, 80)) if c == i}
    assert {r.doc_id for r in stages["ngram_jaccard_join"].collect()} == keep


def test_mixing_stage(stages):
    given = {r.doc_id: r for r in stages["ngram_jaccard_join"].collect()}
    copies = collections.Counter(r.doc_id for r in stages["mixing"].collect())
    assert copies == {i: n for i, n in plan_brute([(r.doc_id, r.source, len(WORD.findall(r.text or ""))) for r in given.values()]).items() if n}
    assert all(r.text == given[r.doc_id].text for r in stages["mixing"].collect())


def test_token_stage(stages):
    got = stages["sentence_pieces"]
    assert got.count() == stages["mixing"].count() and got.where("not round_trip").count() == 0
    lib = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=sentence_pieces.MODEL_PATH)
    texts = {r.doc_id: r.text for r in stages["mixing"].collect()}
    assert all(r.token_ids == lib.encode(texts[r.doc_id] or "") for r in got.collect())


def test_run_is_all_stages(spark, stages):
    assert sorted((r.doc_id, r.n_tokens) for r in corpus_pipeline.run(spark, SF).collect()) == sorted((r.doc_id, r.n_tokens) for r in stages["sentence_pieces"].collect())


def test_empty_and_clashing_tables(spark, no_docs, clashing):
    odd = clashing.selectExpr("*", "1 AS _stat_n_words", "2 AS _id2", "3 AS _source2", "4 AS _copies", "5 AS _gone", "99 AS _nth", "98 AS _copy", "6 AS _row", "7 AS n_words", "8 AS _key")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, no_docs, SF).count() == 0
        out = stage(spark, odd, SF)
        rows = out.collect()
        if name != "sentence_pieces":
            assert out.columns == odd.columns and all((r._nth, r._copy, r._row) == (99, 98, 6) for r in rows)
