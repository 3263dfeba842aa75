"""Quality rules: a decision list learned from labelled statistics by sequential covering."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import IS_WORD, row_hash, slices, span_hashes, windows, word_spans

#: Labelled rows that the list is fitted on, at most; a uniform sample by hash of doc_id is taken beyond.
FIT_ROWS = 20_000
WINDOW = 8
MIN_WORDS = 20
REPEAT_PERCENT = 30

SYMBOL = np.zeros(256, dtype=bool)
SYMBOL[list(b"#*$%&|<>")] = True
UPPER = np.zeros(256, dtype=bool)
UPPER[65:91] = True
DIGIT = np.zeros(256, dtype=bool)
DIGIT[48:58] = True
END = np.zeros(256, dtype=bool)
END[list(b".!?")] = True

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_ends", "n_long_words", "n_distinct_words")
STATS = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS)

#: What the rules may test: each a ratio or count of the statistics above, a Spark expression of them.
FEATURES = {
    "n_words": "double(n_words)",
    "mean_word_chars": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "words_per_line": "n_words / greatest(n_lines, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "digit_share": "n_digits / greatest(word_chars, 1)",
    "ends_per_word": "n_ends / greatest(n_words, 1)",
    "long_word_share": "n_long_words / greatest(n_words, 1)",
    "distinct_share": "n_distinct_words / greatest(n_words, 1)",
}


def repeats(hashes: np.ndarray) -> np.ndarray:
    """For each value whether it occurs elsewhere in the array."""
    order = np.argsort(hashes, kind="stable")
    same = hashes[order][1:] == hashes[order][:-1]
    out = np.zeros(len(hashes), dtype=bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def later(hashes: np.ndarray) -> np.ndarray:
    """For each value whether it occurs before in the array."""
    order = np.argsort(hashes, kind="stable")
    out = np.zeros(len(hashes), dtype=bool)
    out[order[1:][hashes[order][1:] == hashes[order][:-1]]] = True
    return out


def equal_before(data: np.ndarray, start: np.ndarray, end: np.ndarray, row: np.ndarray) -> np.ndarray:
    """For each span whether an equal one occurs before in its row: equal hashes point at them, the bytes decide."""
    hashes = span_hashes(data, start, end)
    order = np.lexsort((hashes, row))
    same = np.flatnonzero((hashes[order][1:] == hashes[order][:-1]) & (row[order][1:] == row[order][:-1]))
    out = np.zeros(len(start), dtype=bool)
    one, two = order[same], order[same + 1]
    text = lambda i: data[start[i] : end[i]].tobytes()
    out[two] = True
    for r in {int(row[a]) for a, b in zip(one.tolist(), two.tolist(), strict=True) if text(a) != text(b)}:  # equal hashes of unequal spans
        seen = set()
        for i in np.flatnonzero(row == r):
            out[i] = text(i) in seen
            seen.add(text(i))
    return out


def per_row(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The number of set flags from each entry of at to the next."""
    sums = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=sums[1:])
    return np.diff(sums[at])


def text_stats(data: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """COUNTS of each row of a slice."""
    start, end, first = word_spans(data, at)
    rows = len(at) - 1
    n_words = np.diff(first)
    point = (data & 0xC0) != 0x80  # the first byte of each code point
    word = IS_WORD[data]
    words = span_hashes(data, start, end)
    row_of_word = np.repeat(np.arange(rows), n_words)
    apart = row_hash(np.arange(rows))

    found, row, begin = windows(words, first, WINDOW)
    begin = begin[repeats(found ^ apart[row])]
    covered = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(covered, begin, 1)
    np.add.at(covered, begin + WINDOW, -1)
    repeated = np.cumsum(covered[:-1]) > 0

    breaks = np.flatnonzero(data == 10)
    cuts = np.unique(np.concatenate([at[:-1], breaks, breaks + 1, at[1:]]))
    line_start, line_end = cuts[:-1], cuts[1:]
    words_before = np.searchsorted(start, cuts)
    real = np.diff(words_before) > 0
    line_start, line_end = line_start[real], line_end[real]
    line_row = np.searchsorted(at, line_start, side="right") - 1
    dup = equal_before(data, line_start, line_end, line_row)

    chars = np.concatenate([[0], np.cumsum(point)])
    length = chars[end] - chars[start]
    return [
        n_words, per_row(point & word, at), per_row(SYMBOL[data], at), np.bincount(line_row[dup], minlength=rows),
        per_row(repeated, first), np.bincount(line_row, minlength=rows), per_row(UPPER[data], at), per_row(DIGIT[data], at),
        per_row(END[data], at), per_row(length > 12, first), per_row(~later(words ^ apart[row_of_word]), first),
    ]


def stats_of(batches):
    for batch in batches:
        parts = [text_stats(data, at) for _, data, at in slices(batch.column("text"))]
        columns = [np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in range(len(COUNTS))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in columns]], ["doc_id", *COUNTS])


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and COUNTS for each row of docs, over whole texts; a null text counts as empty."""
    return docs.select("doc_id", "text").mapInArrow(stats_of, STATS)


@dataclass(frozen=True)
class Rule:
    """A conjunction of (feature, at most?, threshold); documents that meet it are of bad quality."""

    tests: tuple[tuple[str, bool, float], ...]
    covered: int
    precision: float

    def condition(self) -> F.Column:
        out = F.lit(True)
        for feature, most, limit in self.tests:
            value = F.expr(FEATURES[feature])
            out = out & ((value <= limit) if most else (value > limit))
        return out


def holds(tests, x: np.ndarray, names: list[str]) -> np.ndarray:
    out = np.ones(len(x), dtype=bool)
    for feature, most, limit in tests:
        value = x[:, names.index(feature)]
        out &= (value <= limit) if most else (value > limit)
    return out


def best_test(x: np.ndarray, bad: np.ndarray, names: list[str]):
    """The threshold test of largest FOIL gain over the rows given."""
    best, p0, n0 = (0.0, None), bad.sum(), len(bad)
    if not 0 < p0 < n0:
        return None
    base = np.log2(p0 / n0)
    for k, name in enumerate(names):
        order = np.argsort(x[:, k], kind="stable")
        value, hits = x[order, k], np.cumsum(bad[order])
        cut = np.flatnonzero(value[1:] > value[:-1])
        if not len(cut):
            continue
        below, hit = cut + 1, hits[cut]
        for most, n, p in ((True, below, hit), (False, n0 - below, p0 - hit)):
            gain = np.where(p > 0, p * (np.log2(np.maximum(p, 1) / n) - base), 0)
            j = int(np.argmax(gain))
            if gain[j] > best[0] + 1e-9:
                best = (float(gain[j]), (name, most, float((value[cut[j]] + value[cut[j] + 1]) / 2)))
    return best[1]


def learn(x: np.ndarray, bad: np.ndarray, names: list[str], min_precision: float = 0.9, min_cover: int = 8, max_rules: int = 12, max_tests: int = 4, seed: int = 7) -> list[Rule]:
    """Sequential covering: grow a conjunction on two thirds of the rows, prune its last tests on the rest, keep it
    if it is precise enough, take its rows away, go on. Rules without enough precision end the list.

    max_rules and max_tests bound the list and the tests of a rule, so that it can be read; with more bad rows of many
    kinds than so many rules cover, raise them."""
    rng, rules, left = np.random.default_rng(seed), [], np.ones(len(x), dtype=bool)
    while len(rules) < max_rules and bad[left].sum() >= min_cover:
        rows = rng.permutation(np.flatnonzero(left))
        grow, prune = rows[: 2 * len(rows) // 3], rows[2 * len(rows) // 3 :]
        tests, inside = [], grow
        while len(tests) < max_tests and (test := best_test(x[inside], bad[inside], names)):
            tests.append(test)
            inside = inside[holds([test], x[inside], names)]
        worth = []
        for k in range(1, len(tests) + 1):
            met = holds(tests[:k], x[prune], names)
            p, n = bad[prune][met].sum(), (~bad[prune][met]).sum()
            worth.append((p - n) / (p + n) if p + n else -1.0)
        if not worth:
            break
        tests = tests[: int(np.argmax(worth)) + 1]
        met = holds(tests, x, names) & left
        precision = bad[met].mean() if met.any() else 0.0
        if met.sum() < min_cover or precision < min_precision:
            break
        rules.append(Rule(tuple(tests), int(met.sum()), float(precision)))
        left &= ~met
    return rules


def fit(stats: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, **parameters) -> list[Rule]:
    """A decision list from the labelled rows. labels: doc_id, quality (1 good, 0 bad; null rows don't count).

    At most fit_rows labelled documents are used, those of least hash of doc_id; nothing else is gathered. Of rows that
    share a doc_id one counts, that of least statistics. Documents that fail the base rules teach nothing. Without
    rows of both kinds the list is empty.
    """
    chosen = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    features = F.struct("quality", *[F.expr(e).cast("double").alias(n) for n, e in FEATURES.items()])
    rows = stats.join(chosen, "doc_id").where(~base_failed()).groupBy("doc_id").agg(F.min(features).alias("of")).select("of.*")
    frame = rows.toPandas().sort_values(["quality", *FEATURES])
    if not len(frame):
        return []
    return learn(frame[list(FEATURES)].to_numpy(float), frame["quality"].to_numpy() == 0, list(FEATURES), **parameters)


def base_failed() -> F.Column:
    return (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * REPEAT_PERCENT)


def rejected(rules: list[Rule]) -> F.Column:
    """The ordered list as one conditional expression: the first rule that holds decides, none keeps."""
    out = F
    for number, rule in enumerate(rules, 1):
        out = out.when(rule.condition(), F.lit(number))
    return F.lit(None).cast("int") if out is F else out.otherwise(F.lit(None)).cast("int")


def judge(docs: DataFrame, labels: DataFrame, **parameters) -> DataFrame:
    """doc_id, COUNTS, base_failed, rule (number of the rule that rejects, or null), kept: one row per row of docs.

    A null or empty text has no words and fails the base rules. Repeated rows are judged alike. Labels without a
    document don't matter; without labels only the base rules reject. An empty table gives no rows. Extra columns
    don't matter.
    """
    rules = fit(statistics(docs.join(F.broadcast(wanted(labels, parameters.get("fit_rows", FIT_ROWS))), "doc_id", "left_semi")), labels, **parameters)
    out = statistics(docs).withColumns({"base_failed": base_failed(), "rule": rejected(rules)})
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def wanted(labels: DataFrame, fit_rows: int) -> DataFrame:
    """The ids that fit() uses: fit_rows at most, so they may be broadcast."""
    return labels.where("quality is not null and doc_id is not null").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)


def keep_good(docs: DataFrame, labels: DataFrame, **parameters) -> DataFrame:
    """The rows of docs that the rules keep, with all their columns, as judge() judges them.

    A null or empty text goes, as it fails the base rules. Repeated rows are kept or go together. Labels without a
    document don't matter; without labels only the base rules reject. An empty table gives an empty one. Columns of
    any names, those of the statistics too, are passed on.
    """
    rules = fit(statistics(docs.join(F.broadcast(wanted(labels, parameters.get("fit_rows", FIT_ROWS))), "doc_id", "left_semi")), labels, **parameters)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))

    def counted(batches):
        for batch in batches:
            parts = [text_stats(data, at) for _, data, at in slices(batch.column("_row").field("text"))]
            counts = [pa.array(np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64), pa.int64()) for k in range(len(COUNTS))]
            yield pa.RecordBatch.from_arrays([batch.column("_row"), *counts], ["_row", *COUNTS])

    wide = packed.mapInArrow(counted, StructType([packed.schema["_row"], *[StructField(n, LongType()) for n in COUNTS]]))
    return wide.where(~base_failed() & rejected(rules).isNull()).select("_row.*")
