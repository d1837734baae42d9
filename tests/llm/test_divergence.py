"""Source divergence beside a dense brute-force version in plain integers."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tideline.llm import divergence

DDL = "doc_id long, text string, lang string, source string, rank long, gid string"
TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOW = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def slow_divergence(rows, top=200):
    docs = [(lang or "", source or "", [t.translate(LOW) for t in TERM.findall(text or "")]) for _, text, lang, source, *_ in rows]
    out = []
    for lang in {x[0] for x in docs}:
        own = [(s, w) for x, s, w in docs if x == lang]
        df = Counter(t for _, w in own for t in set(w))
        kept = sorted(t for t in df if df[t] >= 3)
        counts = defaultdict(Counter)
        for s, w in own:
            counts[s].update(t for t in w if df[t] >= 3)
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept}
        q, p = share(sum(counts.values(), Counter())), {s: share(c) for s, c in counts.items()}
        for s in counts:
            pairs = [(o, sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept)) for o in counts if o != s]
            terms = [(t, (p[s][t] - q[t]) ** 2 // q[t]) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(found[:most])]
    return sorted(out)


def case():
    rng, rows = random.Random(5), []
    words = ["Éa", "éa", "straße", "x", "X-y", "don't", "日本", "a1b", "_", "😀z"] + [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(12) for j in range(12)]
    for i in range(160):
        n = rng.choice([0, 1, 5, 40])
        rows.append((i, " ".join(rng.choice(words[: rng.choice([12, 60, len(words)])]) for _ in range(n)), rng.choice(["en", "de", None, ""]), rng.choice(["s0", "s0", "s0", "s1", None, "é"]), 0, "g"))
    rows += [(7, None, "fr", "lone", 0, "g"), (8, "twice only", "it", "a", 0, "g"), (8, "twice only", "it", "b", 0, "g"), (None, "\x00 12 !", "it", "b", 0, None)]
    rows += [rows[3]] * 4
    return rows


def got(df):
    return sorted(tuple(r) for r in df.collect())


def test_beside_brute_force(spark):
    rows = case()
    want = slow_divergence(rows)
    assert {"it", "fr", "", "en"} <= {r[0] for r in want} | {"fr"} and any(r[2] == "pair" and r[4] == 0 for r in want)
    assert got(divergence.source_divergence(spark.createDataFrame(rows, DDL))) == want


def test_full_sketch_and_small_steps_change_nothing(spark):
    """Cells that all terms share, counts passed on after every few terms, a short report."""
    rows = case()
    found = divergence.source_divergence(spark.createDataFrame(rows, DDL), top=3, cells=1 << 6, most_terms=5)
    assert got(found) == slow_divergence(rows, 3)


@pytest.mark.parametrize("cells", [1 << 8, 1 << 24])
def test_sketch_never_underestimates(spark, cells):
    texts = [f"aa ab{'c' * (i % 7)} only{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)]
    rows = spark.createDataFrame([(b"en", t.encode()) for t in texts], "lang binary, text binary").repartition(5)
    bits = divergence.full_cells(divergence.sketch(rows, 3, cells), cells)
    df = Counter(t for x in texts for t in set(TERM.findall(x)))
    terms = sorted(df)
    left = divergence.possible([t.encode() for t in terms], divergence.xxh64_intdigest(b"en"), bits)
    assert all(ok for t, ok in zip(terms, left) if df[t] >= 3)
    if cells == 1 << 24:
        assert not any(ok for t, ok in zip(terms, left) if df[t] < 3)


def test_pieces_are_cut_between_terms(monkeypatch):
    monkeypatch.setattr(divergence, "AT_ONCE", 16)
    text = b"abcd efg " * 20 + b"z" * 100 + b" abcd q"
    want = np.unique(divergence.term_hashes(text, 3))
    assert np.array_equal(divergence.document_hashes(text, 3), want) and len(want) == 4


def test_hash_of_a_term_is_that_of_its_bytes():
    one = divergence.term_hashes(b"abc", 1)[0]
    assert np.array_equal(divergence.term_hashes(b"x abc  yy abc", 1)[[1, 3]], [one, one])
    assert divergence.term_hashes(b"abc", 2)[0] != one and len(divergence.term_hashes(b"", 1)) == 0


def test_a_very_long_text(spark):
    long = "ab " * 400_000 + "z" * 300_000 + " cd" * 1000
    rows = [(i, t, "en", s, 0, "") for i, (t, s) in enumerate([(long, "a"), ("ab cd", "b"), ("ab cd " + "z" * 300_000, "b"), (long, "c")])]
    assert got(divergence.source_divergence(spark.createDataFrame(rows, DDL))) == slow_divergence(rows)


def test_empty_table(spark):
    assert divergence.source_divergence(spark.createDataFrame([], DDL)).count() == 0
