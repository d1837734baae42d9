"""Null and repeated keys, ties and very long texts of operators 2, 4, 6, 7 and 10."""

import random

import public_tokenizers
from pyspark.sql import functions as F

from tideline.llm import chat, mixing, quality, toxicity, warc

LABELS = "doc_id long, quality int, toxic int"


def test_quality_of_null_hosts_repeated_rows_and_a_long_text(spark):
    rng, rows = random.Random(3), []
    for i in range(120):
        text = " ".join(("|| " if i % 3 == 0 else "") + f"word{rng.randrange(200)}" for _ in range(30))
        rows.append((i, text, rng.choice([None, "h1", "h2"]), rng.choice([None, "p"])))
    rows += [rows[5]] * 4 + [(500, "word1 " * 300_000, None, None), (None, "word2 word3", "h1", "p")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, h string, p string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(120)], LABELS)
    got = quality.quality_scores(docs, labels, F.col("h"), F.col("p")).collect()
    assert len(got) == len(rows) and {(r.host, r.path) for r in got} == {(h, p) for _, _, h, p in rows}
    assert len({(r.score, r.kept) for r in got if r.doc_id == 5}) == 1 and sum(r.doc_id == 5 for r in got) == 5
    assert all(0 <= r.score <= 1 and r.kept == (r.score >= 0.5) for r in got)
    at = next(r.score for r in got if r.doc_id == 7)
    bar = quality.quality_scores(docs, labels, F.col("h"), F.col("p"), keep_from=at).collect()
    assert next(r.kept for r in bar if r.doc_id == 7)


def test_archive_of_a_long_payload(spark, tmp_path):
    long = "é<p>\r\n" * 600_000
    pages = spark.createDataFrame([(1, "u", long), (2, "u", long), (3, "u", "")], "page_id long, url string, html string")
    got = {r.page_id: (bytes(r.payload), r.record_type) for r in warc.read_archive(spark, warc.write_archive(pages, f"{tmp_path}/a")).collect()}
    assert got == {1: (long.encode(), "revisit"), 2: (long.encode(), "response"), 3: (b"", "response")}


def test_a_long_turn(spark):
    long = "one two</s> " * 60_000
    talks = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", long)], "conv_id long, turn long, role string, text string")
    tokens = public_tokenizers.path("byte_bpe_50k.tiktoken")
    formatted = chat.format_chats(talks, tokens, public_tokenizers.PATTERN)
    assert formatted.count() > 1
    parsed = {r.role: (r.text, r.trained) for r in chat.parse_chats(formatted, tokens, public_tokenizers.PATTERN).collect()}
    assert parsed == {"user": ("hi", None), "assistant": (long, long)}


def test_mixing_with_a_long_text(spark, docs_of):
    rng = random.Random(5)
    rows = [(i, " ".join(("|| " if i % 3 == 0 else "") + f"word{rng.randrange(300)}" for _ in range(40))) for i in range(150)] + [(900, "word7 " * 200_000)]
    label = F.when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "poor")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(150)], LABELS)
    out = mixing.document_rates(docs_of(rows), labels, label, {"good": 0.95, "poor": 0.05}).collect()
    assert len(out) == 151 and next(r.tokens for r in out if r.doc_id == 900) == 200_000
    total = sum(r.tokens for r in out)
    assert abs(sum(r.rate * r.tokens * r.p_good for r in out) / total - 0.95) < 1e-2


def test_labels_that_differ_count_as_toxic(spark, docs_of):
    docs = docs_of([(i, f"text {i}") for i in range(60)])
    rows = [(i, 1, 0) for i in range(60)] + [(0, 1, 1), (0, 1, 0), (4, None, None), (None, 1, 1), (5, 1, 7)]
    got = {r.doc_id: r.y for r in toxicity.labelled_rows(docs, spark.createDataFrame(rows, LABELS), "toxic", 1000).collect()}
    held = {r.doc_id for r in docs.where(toxicity.is_held_out(F.col("doc_id"))).collect()}
    assert got == {i: int(i == 0) for i in range(60) if i not in held} and 0 in got
