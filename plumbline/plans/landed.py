"""Queries on readers and sinks: derived tables are written to files of the shared folder and read from there."""

from pyspark.sql import functions as F

from ..sources import files, ranges
from ..sources.folders import new_folder, read_once
from .registry import add


def response_tree(t):
    root = new_folder(t.spark, "responses")
    rows = t.answers.select("task", "model_id", F.to_json(F.struct(F.col("idx").cast("string").alias("index"), F.col("gold").alias("ground_truth"), F.col("text").alias("model_response"))).alias("value"))
    broken = rows.select("task", "model_id", F.lit("{broken").alias("value")).dropDuplicates(["task", "model_id"])
    model = F.concat(F.lit("responses_m"), F.col("model_id").cast("string"))
    name = F.concat(F.when(F.col("task") < "src2", "first-half").otherwise("second_half"), F.lit("_responses.jsonl"))
    real = rows.unionByName(broken).select(model.alias("dir"), name.alias("file"), "value")
    smoke = rows.where("model_id = 9").select(F.concat(model, F.lit("_smoke")).alias("dir"), F.lit("x_responses.jsonl").alias("file"), "value")
    real.unionByName(smoke).repartition("dir", "file").write.partitionBy("dir", "file").text(root)
    return read_once(files.response_tree(t.spark, root, names="part-*").select("model", "task", F.col("index").cast("long").alias("idx"), "ground_truth", "model_response"), root)


def verdict_tree(t):
    root = new_folder(t.spark, "verdicts")
    value = F.to_json(F.struct(F.concat_ws("/", "task", F.col("idx").cast("string")).alias("index"), "is_correct", "skipped"))
    suffix = F.when(F.col("judge") == "def", "").when(F.col("judge") == "v1", "_v1").otherwise("__by_other")
    rows = t.verdicts.select(F.concat(F.lit("m"), F.col("model_id").cast("string"), F.lit("_judge_main"), suffix).alias("dir"), F.lit("all_detailed.jsonl").alias("file"), value.alias("value"))
    rows.repartition("dir").write.partitionBy("dir", "file").text(root)
    return read_once(files.verdict_tree(t.spark, root, names="part-*").groupBy("model", "judge", "version", "task").agg(F.count("*").alias("n"), F.count_if("is_correct").alias("right")), root)


def lines(t, broken: bool):
    path = new_folder(t.spark, "lines")
    rows = t.items.select(F.when((F.col("idx") % 10 == 0) & F.lit(broken), F.lit('{"idx": oops')).otherwise(F.to_json(F.struct("task", "idx", F.when(F.col("idx") % 4 != 0, F.col("gold")).alias("gold")))).alias("value"))
    rows.write.text(path)
    return path


#: Items of one value at most, where values are made of items.
CHUNK = 100


def in_chunks(t):
    """The items with the number of a chunk of their task, so that a task with most of the items is not one value."""
    return t.items.withColumn("chunk", F.floor(F.col("idx") / CHUNK))


def concatenated(t):
    path = new_folder(t.spark, "concatenated")
    item = F.concat(F.lit('{"idx": '), F.col("idx").cast("string"), F.lit(', "s": "}{"}'))
    in_chunks(t).groupBy("task", "chunk").agg(F.array_join(F.array_sort(F.collect_list(item)), "").alias("value")).select("value").write.option("maxRecordsPerFile", 50).text(path, lineSep=" ~ ")
    return read_once(files.concatenated(t.spark, path).select(F.get_json_object("object", "$.idx").cast("long").alias("idx"), F.get_json_object("object", "$.s").alias("s")), path)


def concatenated_ranges(t):
    """All items in a few files without any separator, and small ranges, so that many objects lie across their ends."""
    path = new_folder(t.spark, "ranges")
    item = F.concat(F.lit('{"idx": '), F.col("idx").cast("string"), F.lit(', "s": "}{\\\\\\"é{", "deep": {"gold": "'), F.col("gold"), F.lit('"}}'))
    t.items.select(item.alias("value")).coalesce(2).write.text(path, lineSep=" ")
    rows = ranges.concatenated_ranges(t.spark, path, 1000)
    return read_once(rows.select(F.get_json_object("object", "$.idx").cast("long").alias("idx"), F.get_json_object("object", "$.s").alias("s"), F.get_json_object("object", "$.deep.gold").alias("gold")), path)


def tsv(t):
    path = new_folder(t.spark, "tsv")
    t.items.select(F.concat(F.col("idx").cast("string"), F.when(F.col("idx") % 3 != 0, F.concat(F.lit('\t"'), F.col("gold"))).otherwise(F.lit(""))).alias("value")).write.text(path)
    return read_once(files.tsv(t.spark, path, ["idx", "gold"], header=False).select(F.col("idx").cast("long").alias("idx"), "gold"), path)


def nested(t):
    path = new_folder(t.spark, "nested")
    in_chunks(t).groupBy("task", "chunk").agg(F.to_json(F.struct(F.collect_list(F.struct("idx", "gold")).alias("questions"))).alias("value")).select("value").write.option("lineSep", "\n").text(path)
    return read_once(files.nested(t.spark, path, "questions", "struct<idx:bigint,gold:string>", whole=False), path)


def verdict_files(t):
    path = new_folder(t.spark, "verdict-files")
    t.verifications.write.json(path)
    return read_once(files.verdict_files(t.spark, path, "task string, idx long, agent string, verdict string", f"{path}-compact", whole=False), path, f"{path}-compact")


def sinks(t):
    """Cells through all sinks and back: Parquet, JSON and CSV by model and task, a CSV table and the summary of a model."""
    path = new_folder(t.spark, "sinks")
    cells = t.cells.withColumnRenamed("model_id", "model")
    schema = "n long, acc double, model long, task string"
    for form in ("parquet", "json", "csv"):
        files.write(cells.select("n", "acc", "model", "task"), f"{path}/{form}", form)
    files.write_summary(cells.select("model", "task", (F.round(F.col("acc") * F.col("n"))).cast("long").alias("correct"), F.col("n").alias("total")), f"{path}/summary")
    files.write_table(cells, f"{path}/table", [r.model for r in t.models.select(F.col("model_id").alias("model")).orderBy("model").collect()])
    one = t.spark.read.parquet(f"{path}/parquet").select("task", F.col("model").cast("long").alias("model"), "n", "acc")
    two = t.spark.read.schema(schema).json(f"{path}/json").select("task", "model", F.col("acc").alias("acc_json"))
    three = t.spark.read.schema(schema).csv(f"{path}/csv").select("task", "model", F.col("acc").alias("acc_csv"))
    four = files.summaries(t.spark, f"{path}/summary").select("task", F.col("model").cast("long").alias("model"), "correct", "overall_accuracy")
    table = t.spark.read.option("header", True).csv(f"{path}/table")
    five = table.unpivot("task", [c for c in table.columns if c != "task"], "model", "shown").select("task", F.col("model").cast("long").alias("model"), "shown")
    keys = ["task", "model"]
    return read_once(one.join(two, keys).join(three, keys).join(four, keys).join(five, keys), path)


def discovered(t):
    """Models found by the folders of a tree of responses and verdicts, those of a given order first."""
    root = new_folder(t.spark, "models")
    kind = F.when(F.col("judge") == "def", "responses_").otherwise("judge_")
    suffix = F.when(F.col("judge") == "v1", "_v1").when(F.col("judge") == "v2", "__by_other").otherwise("")
    dirs = t.verdicts.select(F.concat(kind, F.lit("m"), F.col("model_id").cast("string"), suffix).alias("dir")).distinct()
    dirs = dirs.unionByName(t.models.where("model_id = 3").select(F.lit("responses_m3b_smoke").alias("dir")))
    dirs.select("dir", F.lit("x").alias("value")).write.partitionBy("dir").text(root)
    return read_once(files.discovered(t.spark, root, ["m7", "m2", "m99"], names="part-*"), root)


def details(t):
    """Details files of options, one folder a task, made of the vectors: their first four numbers are logprobs."""
    root = new_folder(t.spark, "details")
    prompt = F.concat(F.lit("Question: vector "), F.col("vec_id").cast("string"), F.lit("?\nA) one\nB) two\nC) "), F.col("label").cast("string"), F.lit("\nD) four\nAnswer:"))
    rows = t.embeddings.select(F.concat(F.lit("details_l"), F.col("label").cast("string")).alias("dir"), (F.col("vec_id") % 4).cast("int").alias("gold"), F.transform(F.slice("embedding", 1, 4), lambda x: x.cast("double")).alias("logprobs"), prompt.alias("prompt"))
    rows.repartition("dir").write.partitionBy("dir").parquet(root)
    return read_once(files.option_details(t.spark, root).withColumn("choices", F.array_join("choices", "|")), root)


add(
    "s01_response_tree", response_tree,
    "SELECT concat('m', CAST(model_id AS VARCHAR)) AS model, CASE WHEN task < 'src2' THEN 'first_half' ELSE 'second_half' END AS task, idx, gold AS ground_truth, text AS model_response FROM answers",
)
add(
    "s02_verdict_tree", verdict_tree,
    "SELECT concat('m', CAST(model_id AS VARCHAR)) AS model, 'main' AS judge, CASE judge WHEN 'def' THEN '' WHEN 'v1' THEN '_v1' ELSE '__by_other' END AS version, 'all' AS task, count(*) AS n, count_if(is_correct) AS \"right\" FROM verdicts GROUP BY ALL",
)


def tolerant(t):
    path = lines(t, True)
    return read_once(files.tolerant(t.spark, path, "task string, idx long, gold string"), path)


def all_strings(t):
    path = lines(t, False)
    return read_once(files.all_strings(t.spark, path, ["task", "idx", "gold"]), path)


add("s04_tolerant_lines", tolerant, "SELECT task, idx, CASE WHEN idx % 4 <> 0 THEN gold END AS gold FROM items WHERE idx % 10 <> 0")
add("s05_all_strings", all_strings, "SELECT task, CAST(idx AS VARCHAR) AS idx, CASE WHEN idx % 4 <> 0 THEN gold ELSE '' END AS gold FROM items")
add("s06_concatenated", concatenated, "SELECT idx, '}{' AS s FROM items")
add("s06_concatenated_ranges", concatenated_ranges, "SELECT idx, concat('}{', chr(92), chr(34), 'é{') AS s, gold FROM items")
add("s07_tsv", tsv, "SELECT idx, CASE WHEN idx % 3 <> 0 THEN concat('\"', gold) ELSE '' END AS gold FROM items")
add("s08_nested_arrays", nested, "SELECT idx, gold FROM items")
add("s10_verdict_files", verdict_files, "SELECT task, idx, agent, verdict FROM verifications")
add(
    "s13_sinks", sinks,
    """SELECT task, model_id AS model, n, acc, acc AS acc_json, acc AS acc_csv, CAST(round(acc * n) AS BIGINT) AS correct, CAST(sum(CAST(round(acc * n) AS BIGINT)) OVER (PARTITION BY model_id) AS DOUBLE) / sum(n) OVER (PARTITION BY model_id) AS overall_accuracy,
       format('{:.4f}', acc) AS shown FROM cells""",
)
add("s03_models", discovered, "SELECT concat('m', CAST(model_id AS VARCHAR)) AS model, CASE model_id WHEN 7 THEN 1 WHEN 2 THEN 2 ELSE 3 + model_id - (CASE WHEN model_id > 2 THEN 1 ELSE 0 END) - (CASE WHEN model_id > 7 THEN 1 ELSE 0 END) END::BIGINT AS place FROM models")
add(
    "s09_option_letters", details,
    """SELECT concat('l', CAST(label AS VARCHAR)) AS task, substr('ABCD', CAST(vec_id % 4 + 1 AS INT), 1) AS ground_truth, substr('ABCD', list_position(embedding[1:4], list_max(embedding[1:4])), 1) AS model_response,
       concat('vector ', CAST(vec_id AS VARCHAR), '?') AS question, concat('one|two|', CAST(label AS VARCHAR), '|four') AS choices FROM embeddings""",
)


def summaries(t):
    """A summary of each model as a JSON text in a file; that of model 4 is broken, and some tasks are left out."""
    path = new_folder(t.spark, "summaries")
    entry = F.struct(F.upper(F.replace("task", F.lit("src"), F.lit("src_"))).alias("key"), F.struct(F.when(F.col("model_id") != 2, F.col("acc")).alias("accuracy"), F.col("n").alias("total")).alias("value"))
    tasks = t.cells.where("(length(task) + model_id) % 3 <> 0").groupBy("model_id").agg(F.map_from_entries(F.collect_list(entry)).alias("tasks"))  # an entry for each task
    text = F.to_json(F.struct("tasks", F.lit("x").alias("judge")))
    tasks.select("model_id", F.when(F.col("model_id") == 4, F.concat(F.lit("{"), text)).otherwise(text).alias("value")).write.partitionBy("model_id").text(path)
    entries = files.summary_entries(t.spark.read.text(path, wholetext=True).select(F.col("model_id").cast("long").alias("model_id"), "value"))
    wanted = t.cells.select("model_id", F.replace("task", F.lit("src"), F.lit("src-")).alias("task"))
    return read_once(files.summary_lookup(wanted, entries, ("model_id",)), path)


add(
    "s14_summary_files",
    summaries,
    """SELECT model_id, replace(task, 'src', 'src-') AS task, CASE WHEN there AND model_id <> 2 THEN acc END AS accuracy, CASE WHEN there THEN n ELSE 0 END AS total, there AS found
       FROM (SELECT *, (length(task) + model_id) % 3 <> 0 AND model_id <> 4 AS there FROM cells)""",
)
