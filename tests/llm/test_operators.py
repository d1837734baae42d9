"""The operators beside brute-force versions and in the cases their docstrings define."""

import hashlib
import itertools
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
import xxhash
from pyspark.sql import functions as F

from tests.compare import assert_same, duck
from tests.conftest import DATA
from tideline.llm import chat, decontaminate, embeddings, graph, mixing, quality, queries, simhash, token_counts, token_files, toxicity, warc

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_beside_sql(spark, name):
    assert_same(queries.QUERIES[name](spark, DATA), duck(DATA), queries.ORACLES[name])


# --- components


def test_components_of_a_chain_and_a_star(spark):
    rows = [(i, i + 1) for i in range(30)] + [(100, 100 + i) for i in range(1, 20)] + [(7, 7), (None, 3)]
    found = {r.node: r.component for r in graph.connected_components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(31)} | {i: 100 for i in range(100, 120)}


def test_components_without_links(spark):
    assert graph.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- op 1


def slow_fingerprint(text, width=4):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(fps):
    ids, root = sorted(fps), {}
    for i in ids:
        root[i] = i
    changed = True
    while changed:
        changed = False
        for i in ids:
            for j in ids:
                if (fps[i] ^ fps[j]).bit_count() <= 4 and root[i] < root[j]:
                    root[j], changed = root[i], True
    return root


def test_simhash_beside_brute_force(spark, docs_of):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(40):
        base = [rng.choice(words) for _ in range(rng.choice([0, 1, 3, 5, 40, 200]))]
        rows.append((3 * i, " ".join(base)))
        base[1:2] = ["New"]
        rows += [(3 * i + 1, "\t".join(base)), (3 * i + 2, " ".join(base).upper())]
    rows += [(500, None), (501, "  \n "), (502, ("long " + "x" * 30 + " ") * 20000)]
    got = {r.doc_id: r for r in simhash.near_duplicates(docs_of(rows)).collect()}
    fps = {i: slow_fingerprint(t) for i, t in rows if i != 502} | {502: simhash.fingerprint(rows[-1][1].encode()) % 2**64}
    assert {i: r.fingerprint for i, r in got.items()} == {i: f"{f:016x}" for i, f in fps.items()}
    assert {i: r.component_id for i, r in got.items()} == slow_components(fps)


def test_simhash_links_all_pairs_within_distance(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 60, dtype=np.int64)
    near = [int(b) ^ sum(1 << int(x) for x in rng.choice(63, k, replace=False)) for b in base for k in range(1, 7)]
    fps = sorted({int(b) for b in base} | set(near))
    for distance in (0, 3, 4, 5):
        found = simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"), distance)
        want = {(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= distance}
        assert {(r.a, r.b) for r in found.collect()} == want


def test_thresholds_sum_to_the_distance():
    costs = [np.abs(np.random.default_rng(i).normal(size=(3, 50))) for i in range(3)]
    for distance in range(9):
        t = simhash.allocate(costs, distance)
        assert ((t + 1).sum(axis=0) == distance + 1).all() and t.min() >= -1 and t.max() <= 2


def test_simhash_null_ids_and_repeats(spark, docs_of):
    rows = [(None, "a b c d e"), (4, "a b c d e"), (4, "a b c d e"), (9, "q r s t u v")]
    got = sorted((r.doc_id or -1, r.component_id) for r in simhash.near_duplicates(docs_of(rows)).collect())
    assert got == [(-1, 4), (4, 4), (4, 4), (9, 9)]
    kept = simhash.one_of_each(docs_of(rows))
    assert kept.columns == docs_of(rows).columns and sorted(r.doc_id or -1 for r in kept.collect()) == [4, 9]


def test_simhash_of_an_empty_table_clashes_and_a_long_text(spark, docs_of, monkeypatch):
    assert simhash.near_duplicates(docs_of([])).count() == 0 and simhash.one_of_each(docs_of([])).count() == 0
    monkeypatch.setattr(simhash, "AT_ONCE", 1000)
    long = " ".join(f"w{i * i % 3001}" for i in range(5000))
    assert simhash.fingerprint(long.encode()) % 2**64 == slow_fingerprint(long)
    docs = docs_of([(1, "a b c d e f"), (2, "a b c d e f"), (3, "z y x")])
    for name in ("fp", "first", "linked_id", "component", "node", "key", "space", "_gone"):
        docs = docs.withColumn(name, F.lit("clash"))
    assert {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()} == {1: 1, 2: 1, 3: 3}
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3]


@pytest.mark.parametrize("n", [10, 10**5, 10**9, 10**12])
def test_partitions_by_number_of_fingerprints(n):
    widths = simhash.plan_widths(n, 4)
    assert sum(widths) == 64 and len(widths) == {10: 4, 10**5: 3, 10**9: 2, 10**12: 2}.get(n, len(widths))


# --- op 2

TOXIC = ["grumbol", "snarkle", "vexhorn"]


def toxic_case(n=600):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(n):
        bad = i % 5 == 0
        words = [f"word{rng.randrange(400)}" for _ in range(60)]
        if bad:
            words[rng.randrange(60)] = rng.choice(TOXIC)
            words[rng.randrange(60)] = rng.choice(TOXIC)
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad), int(bad)))
    return rows, labels


def test_toxicity_on_held_out_rows(spark, docs_of):
    rows, labels = toxic_case()
    table = spark.createDataFrame([*labels, (None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")
    docs = docs_of([*rows, (9000, None), (9001, ""), (None, "word1 grumbol snarkle")])
    got = {r.doc_id: r for r in toxicity.toxicity_report(docs, table).collect()}
    assert len(got) == len(rows) + 3
    for i, t, _ in labels:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1)
        assert got[i].predicted == t and 0 <= got[i].score <= 1
    assert got[9000].score == got[9001].score < 0.7 and got[None].predicted == 1 and not got[None].held_out
    kept = toxicity.reject_toxic(docs, table)
    assert kept.columns == docs.columns and kept.count() == sum(1 - t for _, t, _ in labels) + 2


def test_toxicity_without_labels_or_rows(spark, docs_of):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.score for r in toxicity.toxicity_report(docs_of([(1, "a")]), none).collect()] == [0.0]
    assert toxicity.toxicity_report(docs_of([]), none).count() == 0


def test_toxicity_of_long_texts_and_clashes(spark, docs_of):
    rows, labels = toxic_case()
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("y", F.lit("clash"))
    docs = docs_of([*rows, (9000, "calm words " * 30000), (9001, "calm words " * 30000 + "grumbol snarkle vexhorn")])
    for name in ("y", "score", "trait", "hits"):
        docs = docs.withColumn(name, F.lit("clash"))
    got = {r.doc_id: r.predicted for r in toxicity.toxicity_report(docs, table).collect()}
    assert (got[9000], got[9001]) == (0, 1)
    kept = toxicity.reject_toxic(docs, table)
    assert kept.columns == docs.columns and 9000 in {r.doc_id for r in kept.select("doc_id").collect()}


def test_label_model_uses_texts_without_label():
    """Voters seen on few labelled rows: the unlabelled ones make up for them."""
    rng = np.random.default_rng(2)
    y = rng.random(5000) < 0.3
    fired = np.stack([(y & (rng.random(5000) < 0.7)) | (rng.random(5000) < 0.02) for _ in range(5)], axis=1).astype(float)
    start = np.where(np.arange(5000) < 60, y, np.nan).astype(float)
    posterior, _, _ = toxicity.label_model(fired, start)
    assert ((posterior > 0.5) == y)[60:].mean() > 0.95


def test_label_model_finds_the_poor_voter():
    rng = np.random.default_rng(0)
    y = rng.random(4000) < 0.3
    fired = np.stack([(y & (rng.random(4000) < 0.8)) | (rng.random(4000) < 0.01) for _ in range(4)] + [rng.random(4000) < 0.2], axis=1).astype(float)
    posterior, rates, _ = toxicity.label_model(fired, y.astype(float))
    assert ((posterior > 0.5) == y).mean() > 0.97
    assert abs(rates[1, 4] - rates[0, 4]) < 0.05 and rates[1, 0] - rates[0, 0] > 0.7


# --- op 3


def slow_contaminated(docs, items, window=50, overlap=0.8):
    """From the definition alone: on every diagonal, the share of equal words in every stretch."""
    import re

    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    found = set()
    for d, text in docs:
        w = words(text)
        for i, item in items:
            v = words(item)
            for start in range(-len(v) + 1, len(w)):
                same = [0 <= start + k < len(w) and w[start + k] == v[k] for k in range(len(v))]
                size = min(window, len(v))
                if any(sum(same[k : k + size]) >= overlap * size for k in range(len(v) - size + 1)):
                    found.add((d, i))
    return found


@pytest.mark.parametrize("overlap", [0.8, 0.9, 0.7])
def test_no_match_is_without_a_seed(overlap):
    """Every way in which the words allowed may differ shows a seed: by counting for all lengths, by trial for the short ones."""
    for n in range(1, 51):
        masks, may_differ = decontaminate.masks_for(n, overlap), n - math.ceil(overlap * n - 1e-9)
        assert masks == ("1" * n,) or decontaminate.least_to_hide(masks, n) > may_differ
        for differ in itertools.combinations(range(n), may_differ) if n <= 14 else ():
            places = [(m, k) for m in masks for k in range(n - len(m) + 1)]
            assert any(all(bit == "0" or k + o not in differ for o, bit in enumerate(m)) for m, k in places)


def test_decontamination_at_the_limit(spark, docs_of):
    """Items of each length with as many words replaced as are allowed, and one more."""
    rng = random.Random(12)
    items, docs, want = [], [], set()
    for n in range(1, 61):
        item = [f"n{n}x{k}" for k in range(n)]
        items.append((n, " ".join(item)))
        size = min(n, 50)
        for extra in (0, 1):
            text = list(item)
            for at in rng.sample(range(size), min(size, size - math.ceil(0.8 * size - 1e-9) + extra)):
                text[at] = f"other{rng.randrange(10**6)}"
            if n > 50:
                text[50:] = [f"tail{rng.randrange(10**6)}" for _ in text[50:]]
            docs.append((2 * n + extra, "before it " + " ".join(text) + " and after"))
            if not extra:
                want.add((2 * n, n))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("n", F.lit("clash")).withColumn("seed", F.lit(1))
    rows = docs_of(docs).withColumn("seed", F.lit("clash")).withColumn("text_hash", F.lit("clash")).withColumn("item_key", F.lit(0)).withColumn("at", F.lit(0))
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(rows, bench).collect()}
    assert got == want == slow_contaminated(docs, items)
    kept = decontaminate.clean(rows, bench)
    assert kept.columns == rows.columns and {r.doc_id for r in kept.collect()} == {d for d, _ in docs} - {d for d, _ in want}


def test_decontamination_beside_brute_force(spark, docs_of):
    rng = random.Random(2)
    words = [f"t{i}" for i in range(500)]
    items = [(i, " ".join(rng.choice(words) for _ in range(n))) for i, n in enumerate([3, 5, 8, 20, 45, 80])]
    docs = []
    for d in range(60):
        text = [rng.choice(words) for _ in range(rng.choice([0, 4, 50, 200]))]
        if d % 2:
            item = items[d % 6][1].split()
            if d % 4 == 1:  # every sixth word replaced
                item = [w if k % 6 else "changed" for k, w in enumerate(item)]
            at = rng.randrange(len(text) + 1)
            text[at:at] = item[: max(5, len(item) - d % 3)]
        docs.append((d, " ".join(text) + ("." if d % 3 else "!")))
    docs += [(None, items[3][1]), (90, None), (91, "t1 " * 3000), (3, docs[3][1])]
    bench = spark.createDataFrame([*items, (77, None), (3, items[3][1])], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs_of(docs), bench).collect()}
    want = slow_contaminated(docs, items)
    assert got == want and (None, 3) in got
    replaced = {(d, d % 6) for d in range(1, 60, 4) if d % 6 in (3, 5)}
    assert len(got & replaced) == len(replaced)
    clean = decontaminate.clean(docs_of(docs), bench)
    bad = {d for d, _ in want}
    assert clean.columns == docs_of(docs).columns
    assert sorted(r.doc_id for r in clean.collect()) == sorted(d for d, _ in docs if d not in bad)


def test_decontamination_in_several_passes(spark, docs_of, monkeypatch):
    items = [(i, " ".join(f"p{i}x{k}" for k in range(12))) for i in range(9)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = docs_of([(i, "start " + t + " end") for i, t in items])
    monkeypatch.setattr(decontaminate, "SEEDS_AT_ONCE", 50)
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()} == {(i, i) for i, _ in items}


def test_decontamination_of_empty_tables(spark, docs_of):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contaminated(docs_of([]), none).count() == 0
    assert decontaminate.clean(docs_of([(1, "a b c d e f")]), none).count() == 1


# --- op 4


def test_quality_shrinks_sparse_sites(spark, docs_of):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(400):
        poor = i % 4 == 0
        text = " ".join(("|| " if poor else "") + f"word{rng.randrange(300)}" for _ in range(40))
        rows.append((i, text))
        labels.append((i, 0 if poor else 1, 0))
    docs = docs_of([*rows, (900, None)]).withColumn("source", F.when(F.col("doc_id") == 1, "lonely").when(F.col("doc_id") % 4 == 0, "bad.example").otherwise("good.example"))
    docs = docs.withColumn("host", F.lit("clash"))
    out = quality.quality_scores(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), F.col("source"), F.concat_ws("/", "source", "lang"))
    got = {r.doc_id: r for r in out.collect()}
    assert len(got) == 401 and all(got[i].kept == bool(q) for i, q, _ in labels)
    bad, good, lonely = got[4].host_posterior, got[2].host_posterior, got[1].host_posterior
    assert bad < 0.2 and good > 0.9 and bad < lonely < good + 0.1
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [round(r.evidence, 6) for r in quality.quality_scores(docs.limit(1), none, F.col("source"), F.col("lang")).collect()] == [0.5]
    assert quality.quality_scores(docs.limit(0), none, F.col("source"), F.col("lang")).count() == 0


def test_quality_scores_from_evidence(spark, docs_of):
    """Posteriors and scores worked out again, in plain Python, from the column of evidence."""
    rng = random.Random(14)
    rows = [(i, " ".join(("|| " if rng.random() < 0.1 * (i % 7) else "") + f"word{rng.randrange(300)}" for _ in range(40))) for i in range(300)]
    labels = spark.createDataFrame([(i, int("||" not in t), 0) for i, t in rows], "doc_id long, quality int, toxic int")
    docs = docs_of(rows).withColumn("source", F.concat(F.lit("h"), F.col("doc_id") % 7)).withColumn("lang", F.concat(F.lit("p"), F.col("doc_id") % 2))
    got = quality.quality_scores(docs, labels, F.col("source"), F.concat_ws("/", "source", "lang")).collect()
    e, host, path = np.array([r.evidence for r in got]), [r.host for r in got], [(r.host, r.path) for r in got]

    def groups(names):
        return {g: e[[x == g for x in names]] for g in set(names)}

    def strength(by, parent):
        n = sum(map(len, by.values()))
        within = max(sum(((v - v.mean()) ** 2).sum() for v in by.values()) / (n - len(by)), 1e-12)
        outer = sum(len(v) * (v.mean() - parent[g]) ** 2 for g, v in by.items())
        between = (outer - len(by) * within) / n
        return min(quality.STRONGEST, max(quality.WEAKEST, within / between)) if between > 0 else quality.STRONGEST

    overall, hosts, paths = e.mean(), groups(host), groups(path)
    s = strength(hosts, dict.fromkeys(hosts, overall))
    mean = {g: (s * overall + v.sum()) / (s + len(v)) for g, v in hosts.items()}
    t = strength(paths, {g: mean[g[0]] for g in paths})
    logit = lambda p: np.log(p / (1 - p)) if 1e-6 < p < 1 - 1e-6 else np.log(1e-6) * (1 if p < 0.5 else -1)
    for r, x, g in zip(got, e, path):
        rest = (s * overall + hosts[g[0]].sum() - x) / (s + len(hosts[g[0]]) - 1)
        rest = (t * rest + paths[g].sum() - x) / (t + len(paths[g]) - 1)
        assert r.host_posterior == pytest.approx(mean[g[0]]) and r.path_posterior == pytest.approx((t * mean[g[0]] + paths[g].sum()) / (t + len(paths[g])))
        assert r.score == pytest.approx(1 / (1 + np.exp(-(logit(x) + logit(rest) - logit(overall)))), abs=1e-4)


# --- op 5


def test_codes_leave_few_pairs_to_compute():
    """Of two million pairs of one bucket, hardly more than those that are close are computed exactly."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(2000, 64))
    x[1000:1040] = x[:40] + 0.1 * rng.normal(size=(40, 64))
    turned = embeddings.unit(x) @ embeddings.rotation(64, 0).T
    n, zero = len(x), np.zeros(len(x), dtype=np.int64)
    table = pa.table(
        {"vec": x.tolist(), "code": embeddings.packed(turned).view(np.int64).tolist(), "keys": [[0]] * n, "correction": np.abs(turned).sum(axis=1) / 8}
        | {c: zero for c in ("task", "band", "own", "split", "place")}
    )
    i, j, computed = embeddings.compare(table, 64, 0.98)
    assert sorted(zip(i.tolist(), j.tolist())) == [(k, 1000 + k) for k in range(40)] and computed < 200


def slow_links(rows):
    links = {}
    for i, (a, x, p) in enumerate(rows):
        for j, (b, y, q) in enumerate(rows):
            ok = i != j and p is not None and p == q and x and y and len(x) == len(y) and all(v is not None and np.isfinite(v) for v in [*x, *y]) and any(x) and any(y)
            if ok:
                u, v = np.array(x, np.float64), np.array(y, np.float64)
                if u @ v / np.sqrt((u @ u) * (v @ v)) >= 0.98:
                    links.setdefault(a, set()).add(b)
    return links


def test_embeddings_beside_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = []
    for c in range(30):
        base = rng.normal(size=16)
        for k in range(c % 6 + 1):
            rows.append((len(rows), (base + rng.normal(size=16) * 0.045 * k).astype(np.float32).tolist(), c % 3))
    hot = rng.normal(size=16)
    rows += [(len(rows) + i, (hot + rng.normal(size=16) * 0.02).astype(np.float32).tolist(), 1) for i in range(150)]
    n = len(rows)
    rows += [(n, rows[0][1], 0), (n + 1, rows[0][1], None), (n + 2, None, 0), (n + 3, [0.0] * 16, 0), (n + 4, [float("nan")] + [1.0] * 15, 0), (n + 5, [], 0)]
    rows += [(n + 6, [None] + [1.0] * 15, 0), (n + 7, [1.0, 2.0], 0), (n + 8, [2.0, 4.0], 0), (n + 9, [1e30] * 16, 2), (n + 10, [1e-30] * 16, 2)]
    monkeypatch.setattr(embeddings, "BLOCK", 40)
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("n", F.lit("clash"))
    got = {r.vec_id: r for r in embeddings.near_vectors(table).collect()}
    links = slow_links([(i, None if v is None else [x if x is None else np.float32(x) for x in v], l) for i, v, l in rows])
    assert {i: r.n_links for i, r in got.items()} == {i: len(links.get(i, ())) for i, _, _ in rows}
    root = {i: i for i, _, _ in rows}
    for _ in rows:
        for i, near in links.items():
            root[i] = min([root[i], *(root[j] for j in near)])
    assert {i: r.component_id for i, r in got.items()} == root
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_embeddings_empty(spark):
    assert embeddings.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_rotation_estimates_are_unbiased():
    rng = np.random.default_rng(1)
    x, y = embeddings.unit(rng.normal(size=(2, 4000, 64)).reshape(-1, 64)).reshape(2, 4000, 64)
    y = embeddings.unit(x + 0.8 * y)
    turn = embeddings.rotation(64, 0)
    signs = np.where(x @ turn.T > 0, 1, -1) / 8
    factor = np.abs(x @ turn.T).sum(axis=1) / 8
    off = np.einsum("ij,ij->i", signs, y @ turn.T) / factor - np.einsum("ij,ij->i", x, y)
    assert abs(off.mean()) < 0.01 and (np.abs(off) <= embeddings.BOUND * np.sqrt(1 - factor**2) / factor / np.sqrt(63)).all()


# --- op 6


def test_archive_round_trip(spark, tmp_path):
    big = "ü" * 600
    rows = [(1, "http://a/\r\nX: y", big), (5, None, big), (3, "http://b", big), (7, "u", "small"), (8, "u", "small"), (9, "u", None), (None, "u", "z" * 2000), (5, None, big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("sha256", F.lit("clash")).withColumn("owner", F.lit(1))
    path = warc.write_archive(pages, f"{tmp_path}/a")
    got = warc.read_archive(spark, path).collect()
    assert sorted((r.page_id or -1, bytes(r.payload)) for r in got) == sorted((i or -1, (h or "").encode()) for i, _, h in rows)
    kinds = {(r.page_id, r.record_type, r.refers_to) for r in got}
    assert kinds == {(1, "revisit", 5), (3, "revisit", 5), (5, "response", None), (7, "response", None), (8, "response", None), (9, "response", None), (None, "response", None)}
    assert spark.read.parquet(f"{path}/payloads").count() == 4
    for r in warc.record_bytes(warc.read_archive(spark, path)).collect():
        head, _, rest = bytes(r.record).partition(b"\r\n\r\n")
        length = int([x for x in head.split(b"\r\n") if x.startswith(b"Content-Length")][0].split(b": ")[1])
        assert head.startswith(b"WARC/1.1\r\nWARC-Type: ") and len(rest) == length + 4 and b"\nX: y" not in head


def test_archive_detects_changed_payload(spark, tmp_path):
    warc.write_archive(spark.createDataFrame([(1, "u", "abc")], "page_id long, url string, html string"), f"{tmp_path}/a")
    spark.createDataFrame([(hashlib.sha256(b"abc").hexdigest(), bytearray(b"abd"))], "sha256 string, payload binary").write.mode("overwrite").parquet(f"{tmp_path}/a/payloads")
    with pytest.raises(Exception, match="digest"):
        warc.read_archive(spark, f"{tmp_path}/a").collect()


def test_archive_empty(spark):
    assert warc.archive_report(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# --- op 7


def test_chat_round_trip(spark, monkeypatch):
    monkeypatch.setattr(chat, "ROW_IDS", 64)
    rows = [
        (1, 1, "assistant", "two <|end|> ␛ <s>"), (1, 0, "user", "one</s>"), (1, 2, "assistant", ""), (2, 0, None, None), (2, 1, "odd<|text|>role", "x" * 500),
        (None, 0, "user", "nobody"), (3, 0, "assistant", "é😀 " * 200), (3, 0, "assistant", "é😀 " * 200),
    ]
    talks = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("ids", F.lit("clash"))
    formatted = chat.format_chats(talks, BYTES, public_tokenizers.PATTERN)
    assert formatted.select(F.max(F.size("ids"))).first()[0] <= 64
    parsed = chat.parse_chats(formatted, BYTES, public_tokenizers.PATTERN).collect()
    got = sorted((r.conv_id or -1, r.role, r.text) for r in parsed)
    assert got == sorted((c or -1, role or "", text or "") for c, _, role, text in rows)
    assert [r.text for r in sorted(parsed, key=lambda r: r.turn) if r.conv_id == 1] == ["one</s>", "two <|end|> ␛ <s>", ""]
    assert all(r.trained == (r.text if r.role == "assistant" and r.text else None) for r in parsed)


@pytest.mark.parametrize("text", ["", "␛", "<␛/s>", "</s>", "<</s>>", "[[INST]", "␛␛<s>␛", "<|turn|><|end|>"])
def test_escape(text):
    assert chat.unescape(chat.escape(text)) == text
    assert not chat.CONTROL_PATTERN.search(chat.escape(text))


def test_chat_empty(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.chat_report(none, BYTES, public_tokenizers.PATTERN).count() == 0


# --- op 8


def test_prefix_counts_beside_the_library():
    import sentencepiece

    model, counter = sentencepiece.SentencePieceProcessor(model_file=PIECES), token_counts.PrefixCounter(PIECES)
    rng = random.Random(1)
    letters = "ab the ing  \n\t▁é́ﬁ​中😀</s>\x00A\r"
    for _ in range(300):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(30)))
        assert counter.steps(text).cumsum(dtype=np.int64).tolist() == [len(model.encode(text[:i])) for i in range(1, len(text) + 1)]


def test_counts_of_documents(spark, docs_of):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rows = [(1, "Hello  world"), (2, None), (2, ""), (None, "x" * 3000), (4, "word " * 9000), (5, "a\nb </s>")]
    docs = docs_of(rows).withColumn("n_tokens", F.lit("clash"))
    found = token_counts.count_report(docs, PIECES).collect()
    got = sorted((r.doc_id or -1, r.n_bytes, r.n_tokens, r.over_limit) for r in found)
    within = {r.doc_id: r.chars_within for r in found}
    assert within[1] == 12 and within[2] == 0 and len(model.encode(rows[4][1][: within[4]])) == 4096 < len(model.encode(rows[4][1][: within[4] + 1]))
    want = sorted((i or -1, len((t or "").encode()), n := len(model.encode(t or "")), n > 4096) for i, t in rows)
    assert got == want
    table = token_counts.prefix_token_counts(docs, PIECES)
    answers = table.select(
        "doc_id", token_counts.tokens_in_prefix(F.col("prefix_steps"), F.lit(5)).alias("five"), token_counts.chars_in_budget(F.col("prefix_steps"), F.lit(3)).alias("cut")
    ).where("doc_id = 4").first()
    assert answers.five == len(model.encode("word "))
    text = rows[4][1]
    assert answers.cut == max(i for i in range(len(text[:60]) + 1) if len(model.encode(text[:i])) <= 3)
    assert token_counts.count_report(docs.limit(0), PIECES).count() == 0


# --- op 9


def slow_file(rows):
    from tokenizers import Tokenizer

    tokenizer, at, out = Tokenizer.from_file(WORDS), 0, []
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        out.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_token_files(spark, docs_of, tmp_path):
    rng = random.Random(8)
    bits = ["Hello", "DON'T", " ", "<|endoftext|>", "<|ENDOFTEXT|>", "é́", "中文", "x1y", "\x1f", " ", "...", "Σς", "\n", "ﬁ"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randrange(40)))) for i in rng.sample(range(1000), 60)]
    rows += [(5000, None), (5001, ""), (None, "nobody"), (5002, "word " * 3000), (5002, "word " * 3000)]
    docs = docs_of(rows).withColumn("part", F.lit("clash"))
    for planes in ("bit", "byte"):
        path = token_files.write_token_files(docs, f"{tmp_path}/{planes}", WORDS, block_ids=700, planes=planes)
        got = token_files.read_documents(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids")).collect()
        assert sorted(map(tuple, got), key=lambda r: r[1]) == slow_file(rows)
        index = token_files.chunk_index(spark, path).orderBy("start").collect()
        assert all(a.start + a.n_ids == b.start for a, b in zip(index, index[1:])) and max(r.n_ids for r in index) <= 700
        wanted = spark.createDataFrame([(5001,), (5002,), (None,), (-7,)], "doc_id long")
        some = token_files.fetch(spark, path, wanted).select("doc_id", "start", "n_tokens", F.crc32("ids")).collect()
        assert sorted(map(tuple, some), key=lambda r: r[1]) == [r for r in slow_file(rows) if r[0] in (5001, 5002)]


def test_token_files_empty(spark, docs_of):
    assert token_files.file_report(docs_of([]), WORDS).count() == 0


def test_encoder_forgets(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_files, "KEPT_BYTES", 500)
    encoder, tokenizer = token_files.ChunkEncoder(WORDS), Tokenizer.from_file(WORDS)
    for text in ("one two three four", "three four five six, seven one", "one two"):
        ids = np.array(tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        assert encoder.encode_batch([text.encode()]) == [ids]


# --- op 10


def mixing_case(spark, docs_of):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(300):
        poor = i % 3 == 0
        rows.append((i, " ".join(("|| " if poor else "") + f"word{rng.randrange(300)}" for _ in range(rng.randrange(10, 80)))))
        labels.append((i, 0 if poor else 1, 0))
    label = F.when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "poor")
    return docs_of([*rows, (900, None), (3, rows[3][1])]), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), label


def test_rates_meet_targets(spark, docs_of):
    docs, labels, label = mixing_case(spark, docs_of)
    out = mixing.document_rates(docs.withColumn("rate", F.lit("clash")), labels, label, {"good": 0.9, "poor": 0.1}).collect()
    total = sum(r.tokens for r in out)
    assert len(out) == 302 and min(r.rate for r in out) >= 0
    assert sum(r.rate * r.tokens * r.p_good for r in out) == pytest.approx(0.9 * total, rel=1e-3)
    assert sum(r.rate * r.tokens * r.p_poor for r in out) == pytest.approx(0.1 * total, rel=1e-3)


def test_mixed_rows_keep_every_document(spark, docs_of):
    docs, labels, label = mixing_case(spark, docs_of)
    for name in ("rate", "row", "tokens", "p", "copy", "c0", "label", "x"):
        docs = docs.withColumn(name, F.lit("clash"))
    out = mixing.mixed(docs, labels, label, {"good": 0.9, "poor": 0.1})
    assert out.columns == docs.columns
    assert {r.doc_id for r in out.select("doc_id").collect()} == {r.doc_id for r in docs.select("doc_id").collect()}
    words = out.select(F.size(F.split("text", r"\s+")).alias("n"), F.col("text").contains("||").alias("poor")).groupBy("poor").agg(F.sum("n").alias("n")).where("poor IS NOT NULL").collect()
    share = {r.poor: r.n for r in words}
    assert share[False] / (share[True] + share[False]) == pytest.approx(0.9, abs=0.03)


def test_mixing_empty(spark, docs_of):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert mixing.document_rates(docs_of([]), none, F.lit("a"), {"a": 1.0, "b": 1.0}).count() == 0
    assert mixing.mixed(docs_of([]), none, F.lit("a"), {"a": 1.0, "b": 1.0}).count() == 0
