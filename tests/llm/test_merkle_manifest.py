"""The Merkle manifest against a plain recomputation."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from plumbline.llm import merkle_manifest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    values = [row[0], row[3], row[2], row[4], text]
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def climb(digests, at):
    """The last digest above digests, and the siblings of the one at a place."""
    siblings = []
    while len(digests) > 1:
        siblings += [d for k, d in enumerate(digests) if k // 3 == at // 3 and k != at]
        digests, at = [H(*digests[i : i + 3]) for i in range(0, len(digests), 3)], at // 3
    return digests[0], siblings


def brute(rows, tamper):
    """Every version from scratch: all of the tree again for each changed leaf."""
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    order = lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1]))
    groups = [sorted((r for r in rows if r[3] == s), key=order) for s in sources]
    leaves = [[leaf(r, r[1]) for r in g] for g in groups]
    subroots = [climb(x, 0)[0] for x in leaves]
    root, out = climb(subroots, 0)[0], []
    for k, group in enumerate(groups):
        for i, r in enumerate(group):
            siblings = climb(leaves[k], i)[1] + climb(subroots, k)[1]
            other = leaves[k][:i] + [leaf(r, tamper(r))] + leaves[k][i + 1 :]
            folded = climb(subroots[:k] + [climb(other, 0)[0]] + subroots[k + 1 :], 0)[0]
            out.append((r[0], leaves[k][i], subroots[k], root, H(*siblings), folded, folded == root))
    return sorted(out, key=str)


def tamper(row):
    return row[1].replace("\n", "") if row[1] is not None and row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0 else row[1]


def got(spark, rows, **parameters):
    docs = spark.createDataFrame(rows, SCHEMA)
    even = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    out = merkle_manifest.document_manifest(docs, F.when(even, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text")), **parameters)
    return sorted(map(tuple, out.collect()), key=str)


@pytest.mark.parametrize("levels", [1, 2, 6])
def test_against_brute_force(spark, levels):
    """One source with most rows, sources of one row, a null source, null fields, equal ids and repeated rows."""
    rows = [(i, f"text {i}\nline\n" if i % 3 else None, "en" if i % 4 else None, "hot", i) for i in range(95)]
    rows += [(i, f"a\nb {i}", "de", f"s{i}é", None) for i in range(200, 212)] + [(300, "x\ny", None, None, 3), (None, "n\nm", None, None, None), (None, None, None, "", 1)]
    rows += [(5, "other text\n", "en", "hot", 5), (5, "other text\n", "en", "hot", 5), (7, "", "en", "", 0)]
    assert got(spark, rows, levels=levels) == brute(rows, tamper)


def test_small_tables(spark, no_docs, clashing):
    one = [(4, "a\nb", "en", "s", 3)]
    assert got(spark, one) == brute(one, tamper)
    assert merkle_manifest.document_manifest(no_docs).count() == 0
    odd = clashing.selectExpr("*", "'x' AS grp", "1 AS pos", "'y' AS leaf", "'z' AS other", "2 AS _kind")
    out = merkle_manifest.document_manifest(odd).collect()
    assert len(out) == 5 and all(r.verified and r.folded_root == r.root for r in out)


def test_versions_share_nodes():
    tree = merkle_manifest.Versions([H(str(i)) for i in range(20)], 3)
    before = list(tree.nodes)
    root = tree.changed(13, H("new"))
    assert tree.nodes[: len(before)] == before and len(tree.nodes) == len(before) + 4  # the leaf and three ancestors
    assert tree.digest(root) == climb([H(str(i)) for i in range(13)] + [H("new")] + [H(str(i)) for i in range(14, 20)], 0)[0]
    assert sum(c < len(before) for c in tree.nodes[root][1]) == 2
    assert merkle_manifest.folded(H("new"), tree.path(13)) == tree.digest(root)
