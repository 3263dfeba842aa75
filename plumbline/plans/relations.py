"""Queries on correlation, resampling, embeddings and alias graphs."""

from pyspark.sql import functions as F

from ..operators import correlation, density, embeddings, graphs
from .registry import ORACLES, QUERIES, Tables, add

REPS = 40
RANKS = "SELECT task, model_id, rank() OVER (PARTITION BY task ORDER BY round(acc, 9)) + (count(*) OVER (PARTITION BY task, round(acc, 9)) - 1) / 2 AS r FROM cells"
XY = "SELECT a.task AS task_a, b.task AS task_b, a.model_id, a.acc AS x, b.acc AS y FROM cells a JOIN cells b ON a.model_id = b.model_id AND a.task < b.task"
CORR = "CASE WHEN stddev_pop({x}) * stddev_pop({y}) > 1e-12 THEN covar_pop({x}, {y}) / (stddev_pop({x}) * stddev_pop({y})) END"
SIGNS = "SELECT p.task_a, p.task_b, sign(round(q.x - p.x, 9)) AS sx, sign(round(q.y - p.y, 9)) AS sy, p.model_id AS m1, q.model_id AS m2 FROM xy p JOIN xy q ON p.task_a = q.task_a AND p.task_b = q.task_b AND p.model_id < q.model_id"
TAU = "SELECT task_a, task_b, sum(sx * sy) / sqrt(nullif(CAST(sum(abs(sx)) AS DOUBLE) * sum(abs(sy)), 0)) AS tau, sum(sx * sy) / sqrt(nullif(CAST(sum(abs(sx)) + count_if(sx = 0 AND sy = 0) AS DOUBLE) * (sum(abs(sy)) + count_if(sx = 0 AND sy = 0)), 0)) AS tau_fast FROM signs GROUP BY ALL"

add("c01_pearson", lambda t: correlation.pearson_pairs(t.cells).withColumn("r", F.round("r", 8)), f"SELECT task_a, task_b, count(*) AS n, round({CORR.format(x='x', y='y')}, 8) AS r FROM xy GROUP BY ALL", xy=XY)
add("c02_spearman", lambda t: correlation.spearman_pairs(t.cells).withColumn("rho", F.round("rho", 8)), f"SELECT a.task AS task_a, b.task AS task_b, count(*) AS n, round({CORR.format(x='a.r', y='b.r')}, 8) AS rho FROM ranks a JOIN ranks b ON a.model_id = b.model_id AND a.task < b.task GROUP BY ALL", ranks=RANKS)
add("c03_kendall", lambda t: correlation.kendall_pairs(t.cells).select("task_a", "task_b", F.round("tau", 8).alias("tau")), "SELECT task_a, task_b, round(tau, 8) AS tau FROM tau_", xy=XY, signs=SIGNS, tau_=TAU)
add("c04_kendall_variant", lambda t: correlation.kendall_pairs(t.cells).select("task_a", "task_b", F.round("tau_fast", 8).alias("tau_fast")), "SELECT task_a, task_b, round(tau_fast, 8) AS tau_fast FROM tau_", xy=XY, signs=SIGNS, tau_=TAU)
#: Many models with many ties: customers, by the share of their orders of each priority that are dear.
MANY = "SELECT o_orderpriority AS task, o_custkey AS model_id, avg(CASE WHEN o_totalprice > 150000 THEN 1.0 ELSE 0.0 END) AS acc FROM orders GROUP BY o_orderpriority, o_custkey"
add(
    "c03_kendall_many_models",
    lambda t: correlation.kendall_pairs(t.sql(MANY)).select("task_a", "task_b", F.round("tau", 8).alias("tau"), F.round("tau_fast", 8).alias("tau_fast")),
    "SELECT task_a, task_b, round(tau, 8) AS tau, round(tau_fast, 8) AS tau_fast FROM tau_", many=MANY, xy=XY.replace("cells a", "many a").replace("cells b", "many b"), signs=SIGNS, tau_=TAU,
)
DRAW = "((rep * 7919 + slot * 104729 + rep * slot * 31 + 15485863) % 1000003 * 48271 % 2147483647) % 10"
BOOT = f"""SELECT task_a, task_b, count(tau) AS reps, quantile_cont(tau, 0.025) AS lo, quantile_cont(tau, 0.975) AS hi FROM (
  SELECT task_a, task_b, rep, sum(sx * sy) / sqrt(nullif(CAST(sum(abs(sx)) AS DOUBLE) * sum(abs(sy)), 0)) AS tau FROM (
    SELECT p.task_a, p.task_b, a.rep, sign(round(q.x - p.x, 9)) AS sx, sign(round(q.y - p.y, 9)) AS sy
    FROM drawn a JOIN drawn b ON a.rep = b.rep AND a.slot < b.slot JOIN xy p ON p.model_id = a.model_id JOIN xy q ON q.model_id = b.model_id AND p.task_a = q.task_a AND p.task_b = q.task_b) GROUP BY ALL) GROUP BY ALL"""
DRAWN = f"SELECT rep, slot, m AS model_id FROM (SELECT *, len(list_distinct(list(m) OVER (PARTITION BY rep))) AS k FROM (SELECT rep, slot, {DRAW} AS m FROM (SELECT unnest(range({REPS})) AS rep), (SELECT unnest(range(10)) AS slot))) WHERE k >= 3"


def boot(t):
    return correlation.bootstrap_tau(t.cells, REPS)


add("c05_bootstrap_tau", lambda t: boot(t).withColumns({"lo": F.round("lo", 8), "hi": F.round("hi", 8)}), "SELECT task_a, task_b, reps, round(lo, 8) AS lo, round(hi, 8) AS hi FROM boot", xy=XY, drawn=DRAWN, boot=BOOT)
MOVES = f"SELECT rep, s.model_id, m.model_id AS as_model FROM (SELECT rep, model_id, row_number() OVER (PARTITION BY rep ORDER BY (rep * 7919 + model_id * 104729 + rep * model_id * 31 + 15485863) % 1000003 * 48271 % 2147483647, model_id) AS pos FROM models, (SELECT unnest(range({REPS})) AS rep)) s JOIN (SELECT model_id, row_number() OVER (ORDER BY model_id) AS pos FROM models) m USING (pos)"
add(
    "c06_permutation_p",
    lambda t: correlation.permutation_p(t.cells, REPS).withColumn("p", F.round("p", 8)),
    f"""SELECT task_a, task_b, round((count_if(abs(r0) >= abs(r) - 1e-9) + 1) / (count(r0) + 1), 8) AS p FROM (
        SELECT x.task AS task_a, y.task AS task_b, rep, {CORR.format(x='x.acc', y='y.acc')} AS r0 FROM cells x JOIN moves m ON m.model_id = x.model_id JOIN cells y ON y.model_id = m.as_model AND x.task < y.task GROUP BY ALL)
        JOIN (SELECT task_a, task_b, {CORR.format(x='x', y='y')} AS r FROM xy GROUP BY ALL) USING (task_a, task_b) GROUP BY ALL""",
    xy=XY, moves=MOVES,
)
CONTROL = """SELECT parent, task, model_id, rank() OVER (PARTITION BY task ORDER BY round(acc, 9)) + (count(*) OVER (PARTITION BY task, round(acc, 9)) - 1) / 2 AS r,
  rank() OVER (PARTITION BY task ORDER BY others) + (count(*) OVER (PARTITION BY task, others) - 1) / 2 AS c
  FROM (SELECT parent, task, model_id, acc, round((sum(acc) OVER w - acc) / nullif(count(*) OVER w - 1, 0), 9) AS others FROM cells JOIN task_dim USING (task) WINDOW w AS (PARTITION BY parent, model_id)) WHERE others IS NOT NULL"""
add(
    "c07_partial",
    lambda t: correlation.partial_pairs(t.cells, t.task_dim).withColumn("partial", F.round("partial", 7)),
    f"""SELECT task_a, task_b, round((xy - xz * yz) / sqrt(CASE WHEN (1 - xz * xz) * (1 - yz * yz) > 1e-12 THEN (1 - xz * xz) * (1 - yz * yz) END), 7) AS partial FROM (
        SELECT a.task AS task_a, b.task AS task_b, {CORR.format(x='a.r', y='b.r')} AS xy, {CORR.format(x='a.r', y='a.c')} AS xz, {CORR.format(x='b.r', y='a.c')} AS yz
        FROM control a JOIN control b ON a.model_id = b.model_id AND a.parent = b.parent AND a.task < b.task GROUP BY ALL)""",
    control=CONTROL,
)
add("c08_redundant_pairs", lambda t: correlation.redundant(correlation.kendall_pairs(t.cells).select("task_a", "task_b", "tau"), boot(t), 0.5, 0.1).select("task_a", "task_b"), "SELECT task_a, task_b FROM tau_ JOIN boot USING (task_a, task_b) WHERE tau > 0.5 AND lo > 0.1", xy=XY, signs=SIGNS, tau_=TAU, drawn=DRAWN, boot=BOOT)
add(
    "c09_within_across",
    lambda t: correlation.within_across(correlation.kendall_pairs(t.cells), t.task_dim, "tau"),
    "SELECT CASE WHEN a.parent = b.parent THEN 'within' ELSE 'across' END AS kind, count(*) AS n, avg(tau) AS mean, quantile_cont(tau, 0.5) AS median, quantile_cont(tau, 0.25) AS p25, quantile_cont(tau, 0.75) AS p75 FROM tau_ JOIN task_dim a ON a.task = task_a JOIN task_dim b ON b.task = task_b WHERE tau IS NOT NULL GROUP BY ALL",
    xy=XY, signs=SIGNS, tau_=TAU,
)


def two_protocols(t):
    judged = t.verdicts.where("judge = 'def' and not skipped").select("task", "model_id", "idx", F.col("is_correct").alias("b"))
    return t.predictions.join(judged, ["task", "model_id", "idx"]).select("task", "model_id", "idx", F.coalesce(F.col("pred") == F.col("gold"), F.lit(False)).alias("a"), "b")


WEIGHT = " + ".join(f"CASE WHEN u >= {limit!r} THEN 1 ELSE 0 END" for limit in correlation.poisson_limits())
add(
    "c10_item_bootstrap",
    lambda t: correlation.item_bootstrap(two_protocols(t), 50).select("reps", *[F.round(c, 8).alias(c) for c in ("mean", "lo", "hi")]),
    f"""SELECT count(rho) AS reps, round(avg(rho), 8) AS mean, round(quantile_cont(rho, 0.025), 8) AS lo, round(quantile_cont(rho, 0.975), 8) AS hi FROM (
        SELECT rep, {CORR.format(x='ra', y='rb')} AS rho FROM (
          SELECT rep, rank() OVER (PARTITION BY rep ORDER BY round(a, 12)) + (count(*) OVER (PARTITION BY rep, round(a, 12)) - 1) / 2 AS ra,
            rank() OVER (PARTITION BY rep ORDER BY round(b, 12)) + (count(*) OVER (PARTITION BY rep, round(b, 12)) - 1) / 2 AS rb FROM (
            SELECT rep, model_id, sum(CASE WHEN a THEN w ELSE 0 END) / sum(w) AS a, sum(CASE WHEN b THEN w ELSE 0 END) / sum(w) AS b FROM protocols JOIN weights USING (task, idx) WHERE w > 0 GROUP BY ALL)) GROUP BY ALL)""",
    protocols="SELECT p.task, p.model_id, p.idx, coalesce(p.pred = p.gold, FALSE) AS a, v.is_correct AS b FROM predictions p JOIN verdicts v ON p.task = v.task AND p.model_id = v.model_id AND p.idx = v.idx WHERE v.judge = 'def' AND NOT v.skipped",
    weights=f"""SELECT task, idx, rep, {WEIGHT} AS w FROM (SELECT task, idx, rep, CAST(('0x' || substr(sha256(concat_ws(':', '0', task, CAST(idx AS VARCHAR), CAST(rep // 10 AS VARCHAR))), rep % 10 * 6 + 1, 6)) AS BIGINT) / 16777216 AS u
        FROM (SELECT DISTINCT task, idx FROM protocols), (SELECT unnest(range(50)) AS rep))""",
)
THREE = "SELECT model_id, avg(CAST(coalesce(pred = gold, FALSE) AS INT)) AS x, avg(CAST(starts_with(model_response, gold) AS INT)) AS y, avg(CAST(is_correct AS INT)) AS z FROM predictions JOIN responses USING (task, model_id, idx) JOIN (SELECT * FROM verdicts WHERE judge = 'def' AND NOT skipped) USING (task, model_id, idx) GROUP BY ALL"


def three_scores(t):
    rows = t.predictions.join(t.responses, ["task", "model_id", "idx"]).join(t.verdicts.where("judge = 'def' and not skipped"), ["task", "model_id", "idx"])
    mean = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("int"))
    accs = rows.groupBy("model_id").agg(mean(F.col("pred") == F.col("gold")).alias("x"), mean(F.col("model_response").startswith(F.col("gold"))).alias("y"), mean(F.col("is_correct")).alias("z"))
    ranked = accs.select(*[correlation.average_rank(F.round(c, 9), [F.lit(0)]).alias(c) for c in ("x", "y", "z")])  # a row for each model
    return ranked.agg(F.round(correlation.safe_corr(F.col("x"), F.col("y")), 8).alias("rho_xy"), F.round(correlation.safe_corr(F.col("x"), F.col("z")), 8).alias("rho_xz"))


add(
    "c11_shift_parts",
    three_scores,
    f"SELECT round({CORR.format(x='rx', y='ry')}, 8) AS rho_xy, round({CORR.format(x='rx', y='rz')}, 8) AS rho_xz FROM (SELECT " + ", ".join(f"rank() OVER (ORDER BY round({c}, 9)) + (count(*) OVER (PARTITION BY round({c}, 9)) - 1) / 2 AS r{c}" for c in "xyz") + " FROM three)",
    three=THREE,
)


def sparse_cells(t):
    """The cells, of which a quarter of the models have no value and some others lack single ones."""
    return t.cells.withColumn("acc", F.when((F.col("model_id") % 4 != 1) & ~F.col("task").isin("src3", "src7"), F.col("acc")))


def rounded(df, name):
    return df.withColumn(name, F.round(name, 6))


# eigenvectors by 4,000 rounds of power iteration, each component taken out of the matrix before the next
POWER = """SELECT v, list_dot_product(v, list_transform(c, lambda r: list_dot_product(r, v))) AS lam FROM (WITH RECURSIVE it(n, v) AS (
    SELECT 0 AS n, list_transform(range(1, len(c) + 1), lambda i: sin(i::DOUBLE)) AS v FROM {0}
    UNION ALL SELECT n + 1, list_transform(w, lambda x: x / sqrt(list_dot_product(w, w))) FROM (SELECT n, list_transform(c, lambda r: list_dot_product(r, v)) AS w FROM it, {0} WHERE n < 4000)) SELECT v FROM it WHERE n = 4000), {0}"""
LESS = "SELECT list_transform(range(1, len(c) + 1), lambda i: list_transform(range(1, len(c) + 1), lambda j: c[i][j] - lam * v[i] * v[j])) AS c FROM {0}, {1}"
COMPONENTS = {
    "zs": "SELECT task, model_id, (acc - avg(acc) OVER w) / (CASE WHEN stddev_pop(acc) OVER w < 1e-12 THEN 1 ELSE stddev_pop(acc) OVER w END) AS z FROM cells WINDOW w AS (PARTITION BY model_id)",
    "gram1": "SELECT list(r ORDER BY a) AS c FROM (SELECT a, list(s ORDER BY b) AS r FROM (SELECT p.model_id AS a, q.model_id AS b, sum(p.z * q.z) AS s FROM zs p JOIN zs q USING (task) GROUP BY ALL) GROUP BY a)",
    "one": POWER.format("gram1"), "gram2": LESS.format("gram1", "one"), "two": POWER.format("gram2"), "gram3": LESS.format("gram2", "two"), "three_": POWER.format("gram3"),
    "found": "SELECT component, lam, list_transform(v, lambda x: x * sign(list_sum(list_transform(v, lambda y: CASE WHEN abs(y) = list_max(list_transform(v, lambda q: abs(q))) THEN y ELSE 0 END)))) AS v FROM (SELECT 1 AS component, * FROM one UNION ALL SELECT 2, * FROM two UNION ALL SELECT 3, * FROM three_)",
}
LOADED = "SELECT component, model_id, v[place] AS loading FROM found, (SELECT model_id, row_number() OVER (ORDER BY model_id) AS place FROM (SELECT DISTINCT model_id FROM zs))"
add(
    "c12_principal_components",
    lambda t: rounded(rounded(correlation.principal_components(t.cells), "share"), "cumulative"),
    "SELECT component, round(lam / total, 6) AS share, round(sum(lam / total) OVER (ORDER BY component), 6) AS cumulative FROM found, (SELECT sum(z * z) AS total FROM zs)",
    **COMPONENTS,
)
add("c12_loadings", lambda t: rounded(correlation.component_loadings(t.cells), "loading"), "SELECT model_id, component, round(loading, 6) AS loading FROM loaded", **COMPONENTS, loaded=LOADED)
add("c12_projection", lambda t: rounded(correlation.component_scores(t.cells), "score"), "SELECT task, component, round(sum(z * loading), 6) AS score FROM zs JOIN loaded USING (model_id) GROUP BY ALL", **COMPONENTS, loaded=LOADED)
add("c13_parallel_analysis", lambda t: correlation.horn_counts(t.cells, 40))
add("c13_effective_dimension", lambda t: correlation.effective_dimension(t.cells, reps=40))
add(
    "c14_filled_models",
    lambda t: correlation.filled(sparse_cells(t)).select("task", "model_id", "acc"),
    "SELECT task, model_id, CASE WHEN task NOT IN ('src3', 'src7') THEN acc END AS acc FROM cells WHERE model_id % 4 <> 1",
)

# embeddings
FLAT = "SELECT label, vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings"
UNIT = "SELECT label, pos, n, x / sqrt(sum(x * x) OVER (PARTITION BY label)) AS u FROM (SELECT label, pos, avg(x) AS x, count(*) AS n FROM flat GROUP BY ALL)"
COS = "SELECT p.label AS a, q.label AS b, sum(p.u * q.u) AS cosine FROM unit p JOIN unit q ON p.pos = q.pos AND p.label < q.label GROUP BY ALL"


def label_taus(t):
    """A second statistic of pairs of labels: how like their sizes are."""
    n = t.embeddings.groupBy("label").agg(F.count("*").alias("n"))
    a, b = n.alias("p"), n.alias("q")
    return a.join(b, F.col("p.label") < F.col("q.label")).select(F.col("p.label").alias("a"), F.col("q.label").alias("b"), (F.least("p.n", "q.n") / F.greatest("p.n", "q.n")).alias("tau"))


SIZES = "SELECT p.label AS a, q.label AS b, least(p.n, q.n) / greatest(p.n, q.n) AS tau FROM (SELECT label, count(*) AS n FROM embeddings GROUP BY ALL) p JOIN (SELECT label, count(*) AS n FROM embeddings GROUP BY ALL) q ON p.label < q.label"
add("b01_centroids", lambda t: embeddings.centroids(t.embeddings).select("label", "n", F.posexplode("centroid").alias("pos", "u")).withColumns({"u": F.round("u", 6), "pos": F.col("pos").cast("long")}), "SELECT label, n, pos, round(u, 6) AS u FROM unit", flat=FLAT, unit=UNIT)
add("b02_cosines", lambda t: embeddings.centroid_cosines(t.embeddings).withColumn("cosine", F.round("cosine", 6)), "SELECT a, b, round(cosine, 6) AS cosine FROM cos_", flat=FLAT, unit=UNIT, cos_=COS)
add("b03_quadrants", lambda t: embeddings.quadrants(embeddings.centroid_cosines(t.embeddings), label_taus(t), 0.1, 0.9).select("a", "b", "quadrant"), "SELECT a, b, CASE WHEN cosine >= 0.1 AND tau >= 0.9 THEN 'redundant' WHEN cosine >= 0.1 THEN 'same topic' WHEN tau >= 0.9 THEN 'same skill' ELSE 'distinct' END AS quadrant FROM cos_ JOIN sizes USING (a, b)", flat=FLAT, unit=UNIT, cos_=COS, sizes=SIZES)
LMOVES = f"SELECT rep, s.name, m.name AS as_name FROM (SELECT rep, name, row_number() OVER (PARTITION BY rep ORDER BY (rep * 7919 + pos * 104729 + rep * pos * 31 + 15485863) % 1000003 * 48271 % 2147483647, pos) AS pos FROM named, (SELECT unnest(range({REPS})) AS rep)) s JOIN named m USING (pos)"
add(
    "b04_mantel",
    lambda t: embeddings.mantel(embeddings.centroid_cosines(t.embeddings).join(label_taus(t), ["a", "b"]).select("a", "b", F.col("cosine").alias("x"), F.col("tau").alias("y")), REPS).select(F.round("r", 6).alias("r"), "pairs", "p"),
    f"""SELECT round(r, 6) AS r, pairs, (count_if(r0 >= r - 1e-9) + 1) / (count(r0) + 1) AS p FROM (SELECT {CORR.format(x='cosine', y='tau')} AS r, count(*) AS pairs FROM both_), (
        SELECT m1.rep, {CORR.format(x='d.cosine', y='e.tau')} AS r0 FROM both_ d JOIN lmoves m1 ON m1.name = d.a JOIN lmoves m2 ON m2.name = d.b AND m2.rep = m1.rep
        JOIN both_ e ON e.a = least(m1.as_name, m2.as_name) AND e.b = greatest(m1.as_name, m2.as_name) GROUP BY ALL) GROUP BY r, pairs""",
    flat=FLAT, unit=UNIT, cos_=COS, sizes=SIZES, both_="SELECT a, b, cosine, tau FROM cos_ JOIN sizes USING (a, b)", named="SELECT label AS name, row_number() OVER (ORDER BY label) AS pos FROM (SELECT DISTINCT label FROM embeddings)", lmoves=LMOVES,
)
NEAR = "SELECT p.vec_id AS a, q.vec_id AS b FROM embeddings p JOIN embeddings q ON p.vec_id <> q.vec_id AND 2 - 2 * list_cosine_similarity(p.embedding::DOUBLE[], q.embedding::DOUBLE[]) <= {0} * {0}"
LINKED = "WITH RECURSIVE near_ AS (" + NEAR + "), reach(id, reached) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.id, n.b FROM reach r JOIN near_ n ON r.reached = n.a), parts AS (SELECT id, min(reached) AS part FROM reach GROUP BY id)"
LINKED += ", clustered AS (SELECT id AS vec_id, CASE WHEN count(*) OVER (PARTITION BY part) >= 3 THEN part ELSE -1 END AS cluster FROM parts), assigned AS (SELECT cluster, label AS grp FROM clustered JOIN embeddings USING (vec_id))"
#: The driver's vectors have no clusters at the usual distance; at this one some do.
WIDE = 1.1


def assigned(t):
    return embeddings.clusters(t.embeddings, WIDE).join(t.embeddings.select("vec_id", F.col("label").alias("grp")), "vec_id").select("cluster", "grp")


add("b05_clusters", lambda t: embeddings.clusters(t.embeddings, WIDE))
ORACLES["b05_clusters"] = LINKED.format(WIDE) + " SELECT vec_id, cluster FROM clustered"
add("b05_density_clusters", lambda t: density.density_clusters(t.embeddings))
add(
    "b05_neighbours",
    lambda t: density.neighbours(t.embeddings).select("vec_id", F.array_join(F.array_sort(F.transform("near", lambda n: n["id"])), ",").alias("near")),
    """SELECT a AS vec_id, string_agg(b, ',' ORDER BY b) AS near FROM (
        SELECT p.vec_id AS a, q.vec_id AS b, row_number() OVER (PARTITION BY p.vec_id ORDER BY list_cosine_similarity(p.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC, q.vec_id) AS place FROM embeddings p JOIN embeddings q ON p.vec_id <> q.vec_id)
        WHERE place <= 15 GROUP BY a""",
)
add("b06_purity", lambda t: embeddings.purity(assigned(t)))
ORACLES["b06_purity"] = LINKED.format(WIDE) + """ SELECT cluster, CAST(sum(k) AS BIGINT) AS size, arg_max(grp, k * 1000 - grp) AS dominant, max(k) / sum(k) AS share, array_to_string(list(grp ORDER BY k DESC, grp)[1:3], ',') AS top3, count(*) AS groups
  FROM (SELECT cluster, grp, count(*) AS k FROM assigned GROUP BY ALL) GROUP BY ALL"""
add("b07_group_overlap", lambda t: embeddings.group_overlap(assigned(t)).withColumn("overlap", F.round("overlap", 9)))
ORACLES["b07_group_overlap"] = LINKED.format(WIDE) + """, counts_ AS (SELECT *, sum(k) OVER (PARTITION BY grp) AS total FROM (SELECT cluster, grp, count(*) AS k FROM assigned GROUP BY ALL))
  SELECT least(a, b) AS a, greatest(a, b) AS b, round(sum(share) / 2, 9) AS overlap FROM (SELECT p.grp AS a, q.grp AS b, sum(p.k) / min(p.total) AS share FROM counts_ p JOIN counts_ q ON p.cluster = q.cluster AND p.grp <> q.grp WHERE q.k >= q.total * 0.1 GROUP BY ALL)
  GROUP BY 1, 2 ORDER BY overlap DESC, a, b LIMIT 30"""
add(
    "b08_missing_vectors",
    lambda t: embeddings.missing_vectors(t.embeddings, t.documents.select(F.col("doc_id").alias("id"), F.col("source").alias("grp"))),
    "SELECT grp, count(*) AS expected, count(vec_id) AS present, count(*) = count(vec_id) AS complete FROM (SELECT source AS grp, doc_id FROM documents) LEFT JOIN embeddings ON vec_id = doc_id GROUP BY ALL",
)

# graphs
REACH = "WITH RECURSIVE both_ AS (SELECT src AS a, dst AS b, kind FROM edges UNION SELECT dst AS a, src AS b, kind FROM edges), "
REACHED = "{0}(id, reached) AS (SELECT a, a FROM both_ UNION SELECT r.id, b.b FROM {0} r JOIN both_ b ON r.reached = b.a {1})"
PARTS = REACH + REACHED.format("ra", "AND b.kind = 'alias'") + ", " + REACHED.format("rp", "")
EDGES = "SELECT s_suppkey AS src, s_suppkey + 1 AS dst, 'alias' AS kind FROM supplier WHERE s_suppkey % 7 <> 0 UNION ALL SELECT s_suppkey AS src, s_suppkey + 7 AS dst, 'related' AS kind FROM supplier WHERE s_suppkey % 21 = 0"


def recursive(sql: str) -> str:
    return PARTS.replace("WITH RECURSIVE ", f"WITH RECURSIVE edges AS ({EDGES}), ") + " " + sql


QUERIES["t01_reachability"] = lambda spark, d: graphs.graph_labels(Tables(spark, d).edges).select("id", "alias_part", "part", "alias_degree", "degree")
ORACLES["t01_reachability"] = recursive("SELECT p.id, alias_part, part, alias_degree, degree FROM (SELECT id, min(reached) AS part FROM rp GROUP BY id) p JOIN (SELECT id, min(reached) AS alias_part FROM ra GROUP BY id) q USING (id) JOIN (SELECT id, count(*) AS degree, count(CASE WHEN kind = 'alias' THEN 1 END) AS alias_degree FROM (SELECT src AS id, kind FROM edges UNION ALL SELECT dst, kind FROM edges) GROUP BY id) USING (id)")
NAMED = "SELECT p_partkey AS item, p_partkey % 60 + 1 AS gold, (p_partkey * 7) % 60 + 1 AS pred FROM part"


def credited(spark, d):
    t = Tables(spark, d)
    return graphs.credit(t.sql(NAMED), t.edges)


CREDIT = """SELECT item, gold, pred, CASE WHEN same_alias THEN 'C' WHEN same THEN 'P' ELSE 'I' END AS credit, CASE WHEN gold = pred OR same_alias THEN 'C' WHEN same THEN 'P' ELSE 'I' END AS self_credit FROM (
  SELECT n.*, EXISTS (SELECT 1 FROM ra WHERE ra.id = gold AND ra.reached = pred) AND EXISTS (SELECT 1 FROM both_ WHERE a = gold AND kind = 'alias') AS same_alias,
    EXISTS (SELECT 1 FROM rp WHERE rp.id = gold AND rp.reached = pred) AS same FROM (""" + NAMED + ") n)"
QUERIES["m12_alias_credit"] = lambda spark, d: credited(spark, d).groupBy("credit").agg(F.count("*").alias("n"))
ORACLES["m12_alias_credit"] = recursive(f"SELECT credit, count(*) AS n FROM ({CREDIT}) GROUP BY ALL")
QUERIES["m13_graph_points"] = lambda spark, d: credited(spark, d).select("item", "self_credit", "points")
ORACLES["m13_graph_points"] = recursive(f"SELECT item, self_credit, CASE self_credit WHEN 'C' THEN 1.0::DOUBLE WHEN 'P' THEN 0.5 ELSE 0 END AS points FROM ({CREDIT})")
