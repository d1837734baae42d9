"""Near copies of the pipeline beside brute-force similarity of five-word shingles."""

import random

import numpy as np
import pytest

from tideline.llm import graph, simhash


def cut(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def edited_case():
    """Texts with copies that have one to eight of 200 words replaced, so that similarities lie on both sides of 0.8."""
    rng, rows = random.Random(7), []
    for base in range(12):
        words = [f"w{rng.randrange(5000)}" for _ in range(200)]
        rows.append((100 * base, " ".join(words)))
        for k in range(1, 16):
            other = list(words)
            for at in rng.sample(range(200), 1 + k // 2):
                other[at] = f"new{rng.randrange(10**6)}"
            rows.append((100 * base + k, " ".join(other)))
    return rows


def slow_kept(rows, least=0.8):
    sets, root = {i: cut(t) for i, t in rows}, {i: i for i, _ in rows}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    near = [(i, j) for i in sets for j in sets if i < j and len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j])]
    for i, j in near:
        x, y = sorted((top(i), top(j)))
        root[y] = x
    return {i for i in sets if top(i) == i}, near


def test_kept_rows_are_those_of_brute_force(spark, docs_of):
    rows = edited_case()
    want, near = slow_kept(rows)
    assert len(near) > 100 and 12 < len(want) < len(rows)
    got = [r.doc_id for r in simhash.one_of_each(docs_of(rows)).select("doc_id").collect()]
    assert sorted(got) == sorted(want)


def close_but_unlike():
    """Two texts with fingerprints at most five bits apart whose similarity is below 0.8."""
    rng = random.Random(3)
    while True:
        words = [f"w{rng.randrange(5000)}" for _ in range(120)]
        other = list(words)
        for at in (20, 40, 60, 80):
            other[at] = f"new{rng.randrange(10**6)}"
        x, y = " ".join(words), " ".join(other)
        bits = min((simhash.fingerprint(x.encode(), 5, s) ^ simhash.fingerprint(y.encode(), 5, s)).bit_count() for s in (42, 43, 44))
        if bits <= 5 and len(cut(x) & cut(y)) < 0.8 * len(cut(x) | cut(y)):
            return x, y


def test_close_fingerprints_below_the_similarity_are_kept(spark, docs_of):
    x, y = close_but_unlike()
    assert simhash.one_of_each(docs_of([(1, x), (2, y)])).count() == 2


def test_buckets_in_blocks(spark, docs_of, monkeypatch):
    """A large bucket whose texts are alike in chains, not all alike to its smallest node, compared block by block."""
    monkeypatch.setattr(simhash, "BLOCK", 7)
    rng, rows = random.Random(11), []
    passage = [f"p{i}" for i in range(160)]
    for chain in range(6):
        words = passage + [f"c{chain}x{i}" for i in range(60)]
        for step in range(8):
            rows.append((100 * chain + step, " ".join(words)))
            words = list(words)
            for at in rng.sample(range(len(words)), 3):
                words[at] = f"s{rng.randrange(10**6)}"
    want, near = slow_kept(rows)
    assert 1 < len(want) < len(rows)
    got = [r.doc_id for r in simhash.one_of_each(docs_of(rows)).select("doc_id").collect()]
    assert sorted(got) == sorted(want)


def dense_groups(n, bits, groups=3, seed=5):
    """Groups of ``n`` fingerprints that differ from their own middle in ``bits`` bits at most."""
    rng, out = np.random.default_rng(seed), set()
    for _ in range(groups):
        middle, own = int(rng.integers(0, 2**63)), set()
        while len(own) < n:
            own.add(middle ^ sum(1 << int(x) for x in rng.choice(63, int(rng.integers(0, bits + 1)), replace=False)))
        out |= own
    return sorted(out)


def components(pairs, nodes):
    root = {x: x for x in nodes}

    def top(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for a, b in pairs:
        a, b = sorted((top(a), top(b)))
        root[b] = a
    return {x: top(x) for x in nodes}


@pytest.mark.parametrize("distance, block", [(4, 1024), (4, 7), (5, 50), (0, 3)])
def test_spanning_links_join_what_all_links_join(spark, distance, block):
    fps = dense_groups(120, 3) + dense_groups(60, 6, seed=9)
    want = components(((a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if (a ^ b).bit_count() <= distance), fps)
    df = spark.createDataFrame([(f,) for f in fps], "fp long").repartition(3)
    found = [(r.a, r.b) for r in simhash.spanning_links(df, distance, block).collect()]
    assert all(a < b and (a ^ b).bit_count() <= distance for a, b in found)
    assert components(found, fps) == want
    assert {r.node: r.component for r in graph.connected_components(spark.createDataFrame(found, "a long, b long")).collect()}.items() <= want.items() if found else True


def test_spanning_links_grow_with_a_group(spark):
    """Rows from groups of 250 to 4,000: for each member at most one from each key it probes, where all pairs would be 125 to 2,000."""
    for n in (250, 1000, 4000):
        df = spark.createDataFrame([(f,) for f in dense_groups(n, 3, groups=1)], "fp long")
        assert n - 1 <= simhash.spanning_links(df, 4).count() <= 20 * n


def test_spanning_links_keep_spaces_apart(spark):
    fps = dense_groups(30, 2)
    rows = [(s, f) for s in (0, 1) for f in fps[s::2] + fps[:6]]
    found = {(r.space, r.a, r.b) for r in simhash.spanning_links(spark.createDataFrame(rows, "space int, fp long"), 4).collect()}
    for s in (0, 1):
        own = sorted({f for x, f in rows if x == s})
        want = components(((a, b) for i, a in enumerate(own) for b in own[i + 1 :] if (a ^ b).bit_count() <= 4), own)
        assert components([(a, b) for x, a, b in found if x == s], own) == want
