"""Invariants of the statistics, files and streams."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import extract
from plumbline.operators import agreement, correlation, embeddings, mentions, reverdict, scores, votes
from plumbline.plans.registry import Tables
from plumbline.sources import files
from plumbline.streaming import arrivals

SF = "/root/testdata/sf0.001"


def test_vote_ties_and_weights(spark):
    rows = spark.createDataFrame([(1, 0, "B", 1.0), (1, 1, "A", 1.0), (2, 0, "A", 0.0), (2, 1, "B", 2.0), (3, 0, None, 1.0), (4, 2, "C", -1.0)], "idx long, model_id long, pred string, w double")
    got = {r.idx: r for r in votes.vote(rows, ["idx"], F.col("w")).collect()}
    assert got[1].winner == "B" and got[1].fraction == 0.5 and got[2].winner == "B" and got[2].voters == 2 and set(got) == {1, 2}


def test_flags_fall_with_the_threshold(spark):
    t = Tables(spark, SF)
    rows = votes.sweep(votes.vote(t.predictions, ["task", "idx"]), t.items.select("task", "idx", "gold")).collect()
    assert all(r[f"t{k}"] >= r[f"t{k + 1}"] for r in rows for k in range(8))


def test_two_tier_rules_differ_at_five_sixths(spark):
    row = spark.createDataFrame([(0.8333,)], "f double").select(votes.tier(F.col("f")).alias("x"), votes.tier(F.lit(5 / 6)).alias("y")).first()
    assert row.x == 0.75 and row.y == 0.75  # rounded to four places first, five sixths is not reached


def test_denominators(spark):
    t = Tables(spark, SF)
    valid, correct = scores.gated(F.col("pred"), F.col("gold"), "ABCD")
    for r in scores.accuracies(t.predictions.withColumn("valid", valid).withColumn("correct", correct), ["model_id"]).collect():
        assert r.acc_valid >= r.acc_total and r.valid + r.invalid == r.total


def test_set_scores_of_empty_sets(spark):
    rows = spark.createDataFrame([([], [])], "p array<string>, g array<string>")
    zero, one, skip = (rows.select(scores.set_scores(F.col("p"), F.col("g"), e).alias("s")).first().s for e in ("zero", "one", "skip"))
    assert (zero.f1, zero.exact, one.f1, skip.f1) == (0.0, True, 1.0, None)


def test_kappa_without_variation(spark):
    rows = spark.createDataFrame([(True, True)] * 3, "a boolean, b boolean")
    assert rows.agg(agreement.kappa(F.col("a"), F.col("b"))[2].alias("k")).first().k is None


def test_majority_of_classes(spark):
    said = {1: "KKKA", 2: "KKAA", 3: "KA", 4: "AAK", 5: "A"}
    rows = spark.createDataFrame([("t", i, f"r{k}", c) for i, s in said.items() for k, c in enumerate(s)], "task string, idx long, rater string, class string")
    assert {r.idx: r.label for r in agreement.majority_class(rows).collect()} == {1: "K", 2: "ambiguous", 3: "K", 4: "A", 5: "A"}


def test_tau_and_constant_columns(spark):
    rows = [("a", m, m / 10) for m in range(6)] + [("b", m, (m * m) / 50) for m in range(6)] + [("c", m, 0.5) for m in range(6)] + [("d", m, -m / 9) for m in range(6)]
    cells = spark.createDataFrame(rows, "task string, model_id long, acc double")
    got = {(r.task_a, r.task_b): r.tau for r in correlation.kendall_pairs(cells).collect()}
    assert got[("a", "b")] == 1.0 and got[("a", "d")] == -1.0 and got[("a", "c")] is None
    assert {(r.task_a, r.task_b): r.r for r in correlation.pearson_pairs(cells).collect()}[("a", "c")] is None


def test_item_bootstrap_of_equal_protocols(spark):
    rows = spark.createDataFrame([(t, m, i, (i * 7 + m) % 10 < m, (i * 7 + m) % 10 < m) for t in "st" for m in range(1, 6) for i in range(100)], "task string, model_id long, idx long, a boolean, b boolean")
    r = correlation.item_bootstrap(rows, 20).first()
    assert r.reps == 20 and abs(r.mean - 1.0) < 1e-9


def test_bootstrap_of_models_with_any_ids(spark):
    rows = [(t, m, (k * (3 if t == "a" else 2)) % 7 / 7) for t in "ab" for k, m in enumerate((-4, 17, 1000, 2000, 5, 6))]
    cells = spark.createDataFrame(rows, "task string, model_id long, acc double")
    renamed = spark.createDataFrame([(t, sorted((-4, 17, 1000, 2000, 5, 6)).index(m), a) for t, m, a in rows], "task string, model_id long, acc double")
    one, two = (correlation.bootstrap_tau(c, 60).first() for c in (cells, renamed))
    assert one == two and one.reps > 50


def test_principal_components_against_numpy(spark):
    rng = np.random.default_rng(1)
    table = rng.normal(size=(9, 4)) @ rng.normal(size=(4, 4))
    rows = [(f"t{i}", m, float(table[i, k]) if (i, k) != (2, 1) else None) for i in range(9) for k, m in enumerate((3, 8, 11, 40))] + [(f"t{i}", 99, None) for i in range(9)]
    cells = spark.createDataFrame(rows, "task string, model_id long, acc double")
    x = table.copy()
    x[2, 1] = np.delete(table[:, 1], 2).mean()
    sd = np.array([np.delete(table[:, 1], 2).std() if k == 1 else table[:, k].std() for k in range(4)])
    x = (x - x.mean(0)) / sd
    u, s, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
    sign = np.array([np.sign(v[np.abs(v).argmax()]) for v in vt])
    shares = correlation.principal_components(cells, 4).orderBy("component").collect()
    assert np.allclose([r.share for r in shares], s**2 / (s**2).sum()) and abs(shares[-1].cumulative - 1) < 1e-9
    loadings = {(r.model_id, r.component): r.loading for r in correlation.component_loadings(cells, 3).collect()}
    assert len(loadings) == 12 and all(abs(loadings[m, c + 1] - sign[c] * vt[c, k]) < 1e-6 for k, m in enumerate((3, 8, 11, 40)) for c in range(3))
    scores_ = {(r.task, r.component): r.score for r in correlation.component_scores(cells, 3).collect()}
    assert len(scores_) == 27 and all(abs(scores_[f"t{i}", c + 1] - sign[c] * u[i, c] * s[c]) < 1e-6 for i in range(9) for c in range(3))
    r = correlation.effective_dimension(cells, 0.9, reps=20).first()
    assert r.n_for_target == int(np.searchsorted(np.cumsum(s**2 / (s**2).sum()), 0.9) + 1) and 0 <= r.horn_n <= 4


def test_clusters_find_near_pairs(spark):
    """Recall of links and components against brute force: families of vectors at and within the distance."""
    rng, rows = np.random.default_rng(2), []
    for _ in range(150):
        at = rng.normal(size=64)
        at /= np.linalg.norm(at)
        for _ in range(int(rng.integers(1, 5))):
            off = rng.normal(size=64)
            off -= off @ at * at
            angle = rng.uniform(0.1, 0.92)
            rows.append(np.cos(angle) * at + np.sin(angle) * off / np.linalg.norm(off))
    rows += [rows[0], rows[0]]
    x = np.array(rows, dtype=np.float32)
    x64 = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = 2 - 2 * x64 @ x64.T <= 0.81
    label = np.arange(len(x))
    for _ in range(len(x)):
        new = np.array([label[near[i]].min() for i in range(len(x))])
        if (new == label).all():
            break
        label = new
    vectors = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)] + [(9999, None, 0)], "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: r.cluster for r in embeddings.clusters(vectors, 0.9, 1).collect()}
    pairs = [(i, j) for i, j in zip(*np.nonzero(near), strict=True) if i < j]
    found = sum(got[i] == got[j] for i, j in pairs)
    assert len(pairs) > 100 and found >= 0.9 * len(pairs) and all(got[i] != got[j] or label[i] == label[j] for i in range(80) for j in range(i))
    assert got[len(x) - 1] == got[0] and got[9999] == -1


def test_longest_mention(spark):
    """Names as substrings: beside punctuation, inside words, overlapping, alike but for case; in one shard and in many."""
    texts = [(1, "by the Red Fox Den and red fox"), (2, "It was APT28, I think."), (3, "(Turla)"), (4, "xxturlaxx"), (5, "none"), (6, None), (7, ""), (8, "apt41 apt4"), (9, "the \u00c9quipe")]
    names = ["Red Fox", "Red Fox Den", "fox", "APT28", "apt28", "Turla", "APT4", "APT41", "", None, "\u00e9quipe"]
    docs, known = spark.createDataFrame(texts, "idx long, text string"), spark.createDataFrame([(n,) for n in names], "name string")
    want = {}
    for i, text in texts:
        hits = sorted({n for n in names if n and n.lower() in (text or "").lower()}, key=lambda n: (len(n), n))
        if hits:
            want[i] = (hits[-1], len(hits))
    for size in (8 << 20, 12):
        assert {r.idx: (r.name, r.mentions) for r in mentions.longest_mention(docs, known, ["idx"], shard_bytes=size).collect()} == want
    assert mentions.longest_mention(docs, known.limit(0), ["idx"]).count() == 0 and mentions.longest_mention(docs.limit(0), known, ["idx"]).count() == 0


def test_model_discovery(spark, tmp_path):
    for name in ("responses_b", "responses_a_v1", "judge_a", "judge_c__by_x", "responses_d_smoke", "judge_e_v2", "other"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "x.jsonl").write_text("{}")
    got = [(r.model, r.place) for r in files.discovered(spark, str(tmp_path), ["e", "z"]).orderBy("place").collect()]
    assert got == [("e", 1), ("a", 2), ("b", 3)]


def test_summaries_and_tables(spark, tmp_path):
    cells = spark.createDataFrame([("m1", "t", 1, 4), ("m1", "u", 3, 4), ("m2", "t", 0, 2)], "model string, task string, correct long, total long")
    files.write_summary(cells, str(tmp_path / "s"))
    got = {(r.model, r.task): (r.accuracy, r.correct, r.total, r.overall_accuracy) for r in files.summaries(spark, str(tmp_path / "s")).collect()}
    assert got == {("m1", "t"): (0.25, 1, 4, 0.5), ("m1", "u"): (0.75, 3, 4, 0.5), ("m2", "t"): (0.0, 0, 2, 0.0)}
    files.write_table(cells.selectExpr("model", "task", "correct / total AS acc"), str(tmp_path / "t"), ["m1", "m2"])
    assert sorted(map(tuple, spark.read.option("header", True).csv(str(tmp_path / "t")).collect())) == [("t", "0.2500", "0.0000"), ("u", "0.7500", "NA")]


def test_no_local_folder_on_a_cluster(monkeypatch):
    from plumbline.sources import folders

    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"
        _jsc = property(lambda self: self)
        sc = getCheckpointDir = lambda self: self
        isEmpty = lambda self: True

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        folders.shared_folder(Session())


def test_response_tree(spark, tmp_path):
    for model, task, lines in [("m1", "cti-mcq", ['{"index": "1", "model_response": "A"}', "broken {", '{"index": "2", "metadata": "{\\"x\\": 1}"}']), ("m2", "vsp", ['{"index": "9"}']), ("m3_smoke", "vsp", ['{"index": "1"}'])]:
        folder = tmp_path / f"responses_{model}"
        folder.mkdir()
        (folder / f"{task}_responses.jsonl").write_text("\n".join(lines))
    got = sorted((r.model, r.task, r["index"]) for r in files.response_tree(spark, str(tmp_path)).collect())
    assert got == [("m1", "cti_mcq", "1"), ("m1", "cti_mcq", "2"), ("m2", "vsp", "9")]


def test_verdict_tree(spark, tmp_path):
    for name in ("m1_judge_gpt", "m1_judge_gpt_v1", "m1_judge_gpt__by_llama"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "mcq_detailed.jsonl").write_text('{"index": "1", "is_correct": true}')
    got = sorted((r.model, r.judge, r.version, r.task, r.is_correct) for r in files.verdict_tree(spark, str(tmp_path)).collect())
    assert got == [("m1", "gpt", "", "mcq", True), ("m1", "gpt", "__by_llama", "mcq", True), ("m1", "gpt", "_v1", "mcq", True)]


def test_other_readers(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"x": 1, "y": null}\nnot json\n{"x": "z", "y": true}')
    assert files.tolerant(spark, str(tmp_path / "a.jsonl"), "x string").count() == 2
    assert files.with_broken(spark, str(tmp_path / "a.jsonl"), "x string").cache().where("_corrupt_record is not null").count() == 1
    (tmp_path / "s.jsonl").write_text('{"x": 1, "y": null}\n{"x": "z", "y": true}')
    assert sorted(map(tuple, files.all_strings(spark, str(tmp_path / "s.jsonl"), ["x", "y"]).collect())) == [("1", ""), ("z", "true")]
    (tmp_path / "c.txt").write_text('{"a": 1}{"a": {"b": "}"}} junk {bad} {"a": 3}')
    assert [json.loads(r.object)["a"] for r in files.concatenated(spark, str(tmp_path / "c.txt")).orderBy("position").collect()] == [1, {"b": "}"}, 3]
    (tmp_path / "t.tsv").write_text('GT\tone\ttwo\nx\t"q\n')
    assert tuple(files.tsv(spark, str(tmp_path / "t.tsv"), ["GT", "one", "two"]).first()) == ("x", '"q', "")
    (tmp_path / "n.json").write_text(json.dumps({"questions": [{"q": "a", "n": 1}, {"q": "b", "n": 2}]}, indent=1))
    assert [r.n for r in files.nested(spark, str(tmp_path / "n.json"), "questions", "struct<q:string,n:int>").collect()] == [1, 2]
    (tmp_path / "v").mkdir()
    for i in range(3):
        (tmp_path / "v" / f"{i}.json").write_text(json.dumps({"idx": i, "verdict": "gold_wrong"}, indent=1))
    assert files.verdict_files(spark, str(tmp_path / "v"), "idx long, verdict string", str(tmp_path / "compact")).count() == 3


def test_option_details(spark, tmp_path):
    prompt = "Question: What?\nA) one\nB) two\nAnswer:"
    spark.createDataFrame([(1, [-3.0, -1.0], prompt)], "gold int, logprobs array<double>, prompt string").write.parquet(str(tmp_path / "details_mmlu"))
    r = files.option_details(spark, str(tmp_path / "details_mmlu")).first()
    assert (r.task, r.ground_truth, r.model_response, r.question, r.choices) == ("mmlu", "B", "B", "What?", ["one", "two"])


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("m", "t", 1), ("m", "u", 2)], "model string, task string, x int")
    for form in ("parquet", "json", "csv"):
        files.write(rows, str(tmp_path / form), form)
        assert (tmp_path / form / "model=m" / "task=t").is_dir()
    files.refresh(rows, str(tmp_path / "r"), ("task",))
    files.refresh(rows.where("task = 't'").withColumn("x", F.lit(9)), str(tmp_path / "r"), ("task",))
    assert {(r.task, r.x) for r in spark.read.parquet(str(tmp_path / "r")).collect()} == {("t", 9), ("u", 2)}


def test_arrivals_resume(spark, tmp_path):
    schema = "task string, model_id long, idx long, x int"
    put = lambda rows: spark.createDataFrame(rows, schema).write.mode("append").json(str(tmp_path / "in"))
    run = lambda: {(r.idx, r.x) for r in arrivals.score_arrivals(arrivals.arriving(spark, str(tmp_path / "in"), schema), lambda d: d, str(tmp_path / "out"), str(tmp_path / "log")).collect()}
    put([("t", 1, 1, 5), ("t", 1, 2, 6)])
    assert run() == {(1, 5), (2, 6)}
    put([("t", 1, 2, 7)])
    assert run() == {(1, 5), (2, 7)} and run() == {(1, 5), (2, 7)}


def tau_brute(x, y, weights):
    """Sums over all pairs of places."""
    sign = lambda v: np.sign(np.round(v[None, :] - v[:, None], 9))
    i, j = np.triu_indices(len(x), 1)
    sx, sy, w = sign(x)[i, j], sign(y)[i, j], (weights[:, None] * weights[None, :])[i, j]
    nx, ny, both = (np.abs(sx) * w).sum(), (np.abs(sy) * w).sum(), ((sx == 0) & (sy == 0)) @ w
    num = (sx * sy * w).sum()
    return [num / np.sqrt(p) if p > 0 else np.nan for p in (nx * ny, (nx + both) * (ny + both))]


def test_tau_by_inversions():
    rng = np.random.default_rng(2)
    for n, values in [(1, 3), (2, 2), (5, 2), (17, 4), (60, 9), (60, 1000)]:
        x, y, w = rng.integers(0, values, n) / 7, rng.integers(0, values, n) / 7, rng.integers(0, 4, (6, n))
        got = correlation.taus(x, y, np.concatenate([w, np.ones((1, n), int)]))
        want = np.array([tau_brute(x, y, v) for v in [*w, np.ones(n, int)]])
        assert np.allclose(np.stack(got, axis=1), want, equal_nan=True)


def test_tau_of_many_models(spark):
    """5,000 models with ties: no join of models with models, and the same value as by all pairs."""
    rng = np.random.default_rng(4)
    values = {t: rng.integers(0, 40, 5000) / 40 for t in ("a", "b", "c")}
    values["b"] = np.round((values["a"] + values["b"]) / 2, 2)
    cells = spark.createDataFrame([(t, int(i), float(v)) for t, vs in values.items() for i, v in enumerate(vs)], "task string, model_id long, acc double")
    pairs = correlation.kendall_pairs(cells)
    assert "CartesianProduct" not in pairs._jdf.queryExecution().toString() and "BroadcastNestedLoop" not in pairs._jdf.queryExecution().toString()
    got = {(r.task_a, r.task_b): r.tau for r in pairs.collect()}
    assert set(got) == {("a", "b"), ("a", "c"), ("b", "c")}
    assert all(abs(got[p] - tau_brute(values[p[0]], values[p[1]], np.ones(5000, int))[0]) < 1e-9 for p in got)
    assert all(r.reps == 300 and r.lo < got[r.task_a, r.task_b] < r.hi for r in correlation.bootstrap_tau(cells.where("model_id < 400"), 300).where("task_b = 'b'").collect())


def test_last_verdict_counts(spark, tmp_path):
    """Corrected deliveries change the cells, older and repeated ones don't; a restart goes on from the checkpoint."""
    schema = "task string, model_id long, idx long, delivery long, correct boolean"

    def deliver(*rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))

    def run():
        stream = arrivals.arriving(spark, str(tmp_path / "in"), schema)
        return {(r.task, r.model_id): (r.n, r.correct) for r in arrivals.running_accuracy(stream, str(tmp_path / "out"), str(tmp_path / "log")).collect()}

    deliver(("a", 1, 1, 0, True), ("a", 1, 2, 0, False), ("a", 2, 1, 0, True), ("b", 1, 7, 0, False))
    assert run() == {("a", 1): (2, 1), ("a", 2): (1, 1), ("b", 1): (1, 0)}
    assert run() == {("a", 1): (2, 1), ("a", 2): (1, 1), ("b", 1): (1, 0)}
    deliver(("a", 1, 1, 1, False), ("a", 1, 2, 1, True), ("a", 1, 3, 1, True), ("b", 1, 7, 1, True), ("a", 2, None, 1, True), ("a", 2, 5, 1, None))
    assert run() == {("a", 1): (3, 2), ("a", 2): (1, 1), ("b", 1): (1, 1)}
    deliver(("a", 1, 1, 0, True), ("b", 1, 7, 2, False), ("b", 1, 7, 3, True), ("b", 1, 7, 2, False), ("a", 1, 3, 4, False), ("a", 1, 3, 4, True))
    assert run() == {("a", 1): (3, 2), ("a", 2): (1, 1), ("b", 1): (1, 1)}


def test_stated_rules(spark):
    """Each rule in and out of its own notation; nothing extracted; kinds judged by meaning."""
    rows = [
        ("letter", "b ", "B", True), ("letter", "C", "B", False), ("letter", "NONE", "B", False), ("letter", None, "B", False),
        ("letters", "c,a", "AC", True), ("letters", "AB", "ABC", False), ("letters", "ABCD", "ABC", False), ("letters", "NONE", "ENO", False),
        ("cwe", "79", "CWE-79", True), ("cwe", "cwe-89, CWE-079", "CWE-79,CWE-89", True), ("cwe", "CWE-79", "CWE-79,CWE-89", False),
        ("vector", "CVSS:3.0/av:n/AC:L", "CVSS:3.1/AV:N/AC:L", True), ("vector", "AV:N/AC:L", "CVSS:3.1/AV:N/AC:L", True), ("vector", "AV:L/AC:L", "CVSS:3.1/AV:N/AC:L", False),
        ("techniques", "T1027, t1059.003", "T1059.001,T1027", True), ("techniques", "T1059", "T1059,T1027", False), ("techniques", "NONE", "NONE", False),
        ("mitigations", "m1026 M1018", "M1018,M1026", True), ("mitigations", "M1018", "M1018,M1026", False),
        ("actor", " FANCY Bear", "apt28", True), ("actor", "Sofacy", "APT28", True), ("actor", "Turla", "APT28", False), ("actor", "unknown x", "Unknown X", True), ("actor", "NONE", "APT28", False),
        ("meaning", "a", "a", None),
    ]
    aliases = spark.createDataFrame([("APT28", "Fancy Bear"), ("fancy bear", "Sofacy"), ("Turla", "Snake")], "a string, b string")
    got = reverdict.re_verdicts(spark.createDataFrame([(k, x, y, i) for i, (k, x, y, _) in enumerate(rows)], "kind string, extracted string, truth string, i int"), aliases).orderBy("i").collect()
    assert [(rows[r.i], r.rederived) for r in got] == [(r, r[3]) for r in rows]


def test_cells_by_their_metric(spark):
    tasks = spark.createDataFrame([("m", "mcq"), ("v", "vsp"), ("s", "ids"), ("w", "vsp")], "task string, task_type string")
    verdicts = spark.createDataFrame([(t, 1, t != "s", False) for t in "mvsw"] + [("m", 1, False, False), ("m", 1, False, True)], "task string, model_id long, is_correct boolean, skipped boolean")
    devs = spark.createDataFrame([("v", 1, 5.0, 7.0), ("v", 1, 5.0, None)], "task string, model_id long, score_gold double, score_pred double")
    sets = spark.createDataFrame([("s", 1, ["a", "b"], ["b", "c", "d"])], "task string, model_id long, p array<string>, g array<string>").select("task", "model_id", scores.set_scores(F.col("p"), F.col("g")).alias("s"))
    got = {r.task: r for r in reverdict.metric_summary(reverdict.metric_cells(verdicts, devs, sets, tasks)).collect()}
    assert (got["m"].metric, got["m"].value, got["m"].total) == ("accuracy", 0.5, 2) and (got["v"].metric, got["v"].value, got["v"].normal) == ("mad", 6.0, pytest.approx(1 - 6 / 7.7))
    assert (got["s"].metric, got["s"].value, got["s"].tp, got["s"].fp, got["s"].fn) == ("f1", pytest.approx(0.4), 1, 1, 2) and (got["w"].metric, got["w"].value) == ("accuracy", 1.0)
    assert got["ALL"].value == pytest.approx((0.5 + 1 - 6 / 7.7 + 0.4 + 1) / 4)


def test_item_bootstrap_of_many_replicates(spark):
    """More replicates than one pass serves: weights by hand give the same accuracies, so the same correlations."""
    rng = np.random.default_rng(6)
    data = [(t, m, i, bool(rng.random() < 0.3 + 0.1 * m), bool(rng.random() < 0.35 + 0.08 * m)) for t in ("x", "y") for i in range(12) for m in range(5) if (i + m) % 7]
    reps = correlation.BLOCK_REPS + 25
    r = correlation.item_bootstrap(spark.createDataFrame(data, "task string, model_id long, idx long, a boolean, b boolean"), reps).first()
    keys = sorted({(t, i) for t, _, i, _, _ in data})
    drawn = correlation.poisson_weights([f"0:{t}:{i}" for t, i in keys], 0, reps)
    weights = dict(zip(keys, drawn, strict=True))
    assert abs(drawn.mean() - 1) < 0.02 and (correlation.poisson_weights(["0:x:3"], 1000, 25) == weights["x", 3][1000:]).all()
    total, right = np.zeros((5, reps)), np.zeros((2, 5, reps))
    for t, m, i, a, b in data:
        total[m] += weights[t, i]
        right[:, m] += np.array([a, b])[:, None] * weights[t, i]
    rank = lambda v: (v[:, None] > v[None]).sum(1) + (v[:, None] == v[None]).sum(1) / 2
    rhos = []
    for k in range(reps):
        x, y = (rank(np.round(right[p, :, k] / total[:, k], 12)) for p in (0, 1))
        if x.std() * y.std() > 1e-12:
            rhos.append(np.corrcoef(x, y)[0, 1])
    assert (r.reps, r.mean, r.lo, r.hi) == (len(rhos), pytest.approx(np.mean(rhos)), pytest.approx(np.quantile(rhos, 0.025)), pytest.approx(np.quantile(rhos, 0.975)))


def test_clusters_are_exact_and_write_little(spark, monkeypatch):
    """Components over pairs of blocks against brute force, with one large component and without; vectors are not written once a table of codes."""
    monkeypatch.setattr(embeddings, "LEAST", 64)
    monkeypatch.setattr(embeddings, "TILE", 50)
    rng = np.random.default_rng(4)
    for distance, mixed in ((1.1, False), (0.6, False), (0.6, True)):
        x = rng.normal(size=(900, 24)) * (0.3 if mixed else 1) + (np.arange(900) % 3 > 0)[:, None] * (2.0 if mixed else 0)
        x = np.concatenate([x, x[:20], x[5] + rng.normal(size=(80, 24)) * 0.01]).astype(np.float32)
        unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
        near, label = 2 - 2 * unit @ unit.T <= distance * distance, np.arange(len(x))
        while not np.array_equal(label, new := np.array([label[near[i]].min() for i in range(len(x))])):
            label = new
        size = np.bincount(label, minlength=len(x))[label]
        vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
        got = {r.vec_id: r.cluster for r in embeddings.clusters(vectors, distance).collect()}
        assert got == {i: int(label[i]) if size[i] >= 3 else -1 for i in range(len(x))}
        assert embeddings.in_blocks(vectors, len(x), 24).agg(F.sum(F.octet_length("x"))).first()[0] == x.nbytes


def test_tau_of_many_models_in_bounded_runs(spark):
    """Runs of 40 points and one run give tau of all pairs of models; no task gets the models of a pair of tasks as a list."""
    rng, n = np.random.default_rng(8), 400
    values = {"a": rng.normal(size=n), "b": rng.integers(0, 9, n) / 8, "c": rng.normal(size=n)}
    values["d"] = values["a"] + values["b"] + rng.normal(size=n) / 2
    cells = spark.createDataFrame([(t, m, float(v[m])) for t, v in values.items() for m in range(n) if (m + ord(t)) % 7], "task string, model_id long, acc double")
    many, one = correlation.kendall_pairs(cells, 40), correlation.kendall_pairs(cells)
    assert sorted(map(tuple, many.collect())) == sorted(map(tuple, one.collect()))
    for r in many.collect():
        keep = [m for m in range(n) if (m + ord(r.task_a)) % 7 and (m + ord(r.task_b)) % 7]
        x, y = values[r.task_a][keep], values[r.task_b][keep]
        sx, sy = np.sign(np.round(x[:, None] - x, 9)), np.sign(np.round(y[:, None] - y, 9))
        assert abs(r.tau - (sx * sy).sum() / np.sqrt((sx**2).sum() * (sy**2).sum())) < 1e-12
    assert "collect_list" not in one._jdf.queryExecution().optimizedPlan().toString()
