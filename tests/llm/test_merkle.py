"""The manifest beside a plain tree, in the cases its docstring defines."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tideline.llm import merkle

DDL = "doc_id long, text string, lang string, source string, n_chars long, leaf string, idx int"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(doc_id, text, lang, source, n_chars):
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def climb(nodes, fanout):
    """Root and, for each node, the (left, right) siblings by level."""
    at, proofs = list(range(len(nodes))), [[] for _ in nodes]
    while len(nodes) > 1:
        for k, i in enumerate(at):
            run = i - i % fanout
            proofs[k].append((nodes[run:i], nodes[i + 1 : run + fanout]))
        nodes = [digest(*nodes[i : i + fanout]) for i in range(0, len(nodes), fanout)]
        at = [i // fanout for i in at]
    return nodes[0], proofs


def slow_report(rows, fanout):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = []
    for lang in langs:
        own = sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(*r[:5])))
        trees.append((own, *climb([leaf_of(*r[:5]) for r in own], fanout)))
    root, upper = climb([t[1] for t in trees], fanout)
    out = []
    for (own, subroot, lower), top in zip(trees, upper):
        for r, low in zip(own, lower):
            proof, node = low + top, leaf_of(*r[:5])
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[4] is not None:
                node = leaf_of(*r[:4], r[4] + 1)
            for left, right in proof:
                node = digest(*left, node, *right)
            out.append((r[0], leaf_of(*r[:5]), subroot, root, digest(*(d for left, right in proof for d in left + right)), node, node == root))
    return sorted(out, key=repr)


def case(n=90):
    rng, rows = random.Random(2), []
    for i in range(n):
        text = rng.choice(["", None, "Straße 日本", f"text {i}", "x" * 3000])
        rows.append((rng.choice([i, i, None]), text, rng.choice(["en", "en", "en", "de", None, "", "Zz"]), rng.choice(["s", None]), rng.choice([len(text or ""), None]), "clash", 1))
    rows += [(500, "alone", "fr", "s", 5, "", 0)] + [rows[0]] * 9 + [(7, f"other {i % 2}", "en", "s", 1, "", 0) for i in range(4)]
    return rows


@pytest.mark.parametrize("fanout, levels", [(2, 8), (2, 2), (3, 1), (5, 2)])
def test_report_beside_a_plain_tree(spark, fanout, levels):
    rows = case()
    want = slow_report(rows, fanout)
    assert {True, False} == {r[-1] for r in want}
    got = merkle.tamper_report(spark.createDataFrame(rows, DDL).repartition(5), fanout, levels)
    assert sorted(map(tuple, got.collect()), key=repr) == want


def test_single_rows_and_empty_tables(spark):
    one = [(3, "a", "en", "s", 1, "", 0)]
    assert [tuple(r) for r in merkle.tamper_report(spark.createDataFrame(one, DDL)).collect()] == slow_report(one, 2)
    assert merkle.tamper_report(spark.createDataFrame([], DDL)).count() == 0


def test_a_stored_manifest_tells_changed_missing_and_added_rows(spark, tmp_path):
    rows = [(i, f"text {i}", "en" if i % 3 else None, "s", 6, "", 0) for i in range(40)]
    docs = spark.createDataFrame(rows, DDL)
    merkle.dataset_manifest(docs).write.parquet(f"{tmp_path}/m")
    kept = spark.read.parquet(f"{tmp_path}/m")
    assert kept.count() == 40 and merkle.broken(docs, kept).count() == 0
    other = docs.where("doc_id != 5").withColumn("text", F.when(F.col("doc_id") == 9, "changed").otherwise(F.col("text")))
    other = other.union(spark.createDataFrame([(99, "new", "en", "s", 3, "", 0)], DDL))
    assert sorted((r.doc_id, r.leaf is None, r.found is None) for r in merkle.broken(other, kept).collect()) == [(5, False, True), (9, False, True), (9, True, False), (99, True, False)]


def test_a_longer_text_than_a_batch(spark):
    rows = [(i, "y" * 2_000_000, "en", None, 2_000_000, "", 0) for i in range(3)]
    assert sorted(map(tuple, merkle.tamper_report(spark.createDataFrame(rows, DDL)).collect()), key=repr) == slow_report(rows, 2)
