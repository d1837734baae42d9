"""Registered queries of this package and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm import chat, decontaminate, divergence, embeddings, merkle, mixing, pii, quality, simhash, token_counts, token_files, toxicity, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_report(_table(spark, sf_dir, "pages"))


QUERIES["op6_warc"] = op6_warc
ORACLES["op6_warc"] = """
    WITH p AS (
        SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n FROM pages
    ), g AS (
        SELECT page_id, html, n, max(page_id) OVER (PARTITION BY html) AS owner FROM p
    )
    SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest,
           CASE WHEN n < 1000 OR page_id IS NOT DISTINCT FROM owner THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN n < 1000 OR page_id IS NOT DISTINCT FROM owner THEN NULL ELSE owner END AS refers_to
    FROM g
"""


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_report(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES["op8_token_counts"] = op8_token_counts


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.file_report(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES["op9_token_files"] = op9_token_files


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


QUERIES["op1_simhash"] = op1_simhash


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES["op3_decontaminate"] = op3_decontaminate
# a run of equal words is left wherever a fifth of the words differ: of three words, of two in an item of five
ORACLES["op3_decontaminate"] = r"""
    WITH d AS (
        SELECT doc_id, hash(text) AS text_hash, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{M}\p{N}]+'), lambda w: w <> '') AS w FROM documents
    ), i AS (
        SELECT DISTINCT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{M}\p{N}]+'), lambda w: w <> '') AS v FROM benchmark
    ), sizes AS (
        SELECT unnest([1, 2, 3]) AS size
    ), ik AS (
        SELECT item_id, v, size, unnest(list_transform(range(1, len(v) - size + 2), lambda p: {'p': p, 'k': array_to_string(v[p:p + size - 1], ' ')})) AS r
        FROM i, sizes WHERE size = CASE WHEN len(v) = 1 THEN 1 WHEN len(v) = 2 OR len(v) = 5 THEN 2 ELSE 3 END
    ), dk AS (
        SELECT doc_id, text_hash, size, unnest(list_transform(range(1, len(w) - size + 2), lambda p: {'p': p, 'k': array_to_string(w[p:p + size - 1], ' ')})) AS r
        FROM d, sizes WHERE size IN (SELECT size FROM ik)
    ), lines AS (
        SELECT DISTINCT dk.doc_id, dk.text_hash, ik.item_id, ik.v, dk.r.p - ik.r.p AS start FROM dk JOIN ik ON dk.size = ik.size AND dk.r.k = ik.r.k
    ), same AS (
        SELECT l.doc_id, l.text_hash, l.item_id, l.start, len(l.v) AS n, least(len(l.v), 50) AS width,
               list_transform(range(1, len(l.v) + 1), lambda k: CASE WHEN l.start + k >= 1 AND d.w[l.start + k] = l.v[k] THEN 1 ELSE 0 END) AS s
        FROM lines l JOIN d ON d.doc_id IS NOT DISTINCT FROM l.doc_id AND d.text_hash = l.text_hash
    ), windows AS (
        SELECT doc_id, text_hash, item_id, start, width, s, unnest(range(0, n - width + 1)) AS o FROM same
    ), counted AS (
        SELECT doc_id, text_hash, item_id, start + o AS at_word, width, list_sum(s[o + 1:o + width]) AS matched FROM windows
    )
    SELECT doc_id, item_id, CAST(at_word AS INTEGER) AS at_word, CAST(width AS INTEGER) AS words, CAST(matched AS INTEGER) AS matched, matched / width AS overlap FROM counted
    WHERE matched >= 0.8 * width
    QUALIFY row_number() OVER (PARTITION BY doc_id, text_hash, item_id ORDER BY matched DESC, at_word) = 1
"""


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES["op2_toxicity"] = op2_toxicity


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    talks = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(own)
    return chat.chat_report(talks, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


QUERIES["op7_chat"] = op7_chat
ORACLES["op7_chat"] = r"""
    WITH t AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
    ), e AS (
        SELECT *, CASE WHEN role = 'assistant' THEN text ELSE '' END AS trained,
               length(regexp_replace(replace(role || '|' || text, '␛', '␛␛'),
                   '(<\|turn\|>|<\|text\|>|<\|end\|>|</?s>|\[/?INST\]|<</?SYS>>)', '\1␛', 'g')) - 1 + 23 AS chars
        FROM t
    )
    SELECT conv_id, count(*) AS n_turns,
           sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
           CAST(sum(length(trained)) AS BIGINT) AS loss_chars,
           sha256(string_agg(trained, '' ORDER BY turn)) AS loss_sha256,
           CAST(sum(chars) AS BIGINT) AS formatted_chars
    FROM e GROUP BY conv_id
"""


def op5_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(_table(spark, sf_dir, "embeddings"))


QUERIES["op5_embeddings"] = op5_embeddings
ORACLES["op5_embeddings"] = """
    WITH RECURSIVE v AS (
        SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
        WHERE label IS NOT NULL AND embedding IS NOT NULL
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
          AND len(list_filter(embedding, lambda x: x <> 0)) > 0
    ), l AS (
        SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
        WHERE list_cosine_similarity(a.e, b.e) >= 0.98
    ), r AS (
        SELECT vec_id AS a, vec_id AS b FROM embeddings
        UNION
        SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
    ), c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a),
    n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
    SELECT c.a AS vec_id, coalesce(n.n_links, 0) AS n_links, c.component_id, c.a = c.component_id AS kept
    FROM c LEFT JOIN n ON n.a = c.a
"""


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(
        _table(spark, sf_dir, "documents"),
        _table(spark, sf_dir, "labels"),
        host=F.col("source"),
        path=F.concat_ws("/", "source", "lang"),
    )


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    domain = F.when(F.col("quality") == 0, "low").when(F.col("toxic") == 1, "toxic").when(F.col("toxic") == 0, "clean")
    return mixing.document_rates(
        _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), domain, {"clean": 0.9, "low": 0.07, "toxic": 0.03}
    )


QUERIES["op4_quality"] = op4_quality
QUERIES["op10_mixing"] = op10_mixing


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(_table(spark, sf_dir, "documents"))


QUERIES["op11_divergence"] = op11_divergence
ORACLES["op11_divergence"] = r"""
    WITH d AS (
        SELECT row_number() OVER () AS row_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
               translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
    ), w AS (
        SELECT row_id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
    ), k AS (
        SELECT lang, term, count(*) AS of_lang FROM w GROUP BY lang, term HAVING count(DISTINCT row_id) >= 3
    ), g AS (
        SELECT lang, source, count(k.term) AS total FROM d LEFT JOIN w USING (row_id, lang, source) LEFT JOIN k USING (lang, term) GROUP BY lang, source
    ), l AS (
        SELECT lang, count(*) AS terms, sum(of_lang) AS total FROM k GROUP BY lang
    ), n AS (
        SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY lang, source, term
    ), s AS (
        SELECT g.lang, g.source, k.term, coalesce(n.n, 0) AS n,
               1 + (1000000000::HUGEINT * (coalesce(n.n, 0) + 1)) // (g.total + l.terms)::HUGEINT AS p,
               1 + (1000000000::HUGEINT * (k.of_lang + 1)) // (l.total + l.terms)::HUGEINT AS q
        FROM g JOIN l ON l.lang = g.lang JOIN k ON k.lang = g.lang LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = k.term
    ), v AS (
        SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
        FROM s a JOIN s b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
    ), r AS (
        SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(v.value, 0) AS BIGINT) AS value
        FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN v ON v.lang = a.lang AND v.source = a.source AND v.item = b.source
        UNION ALL
        SELECT lang, source, 'term', term, CAST(((p - q) * (p - q)) // q AS BIGINT) FROM s WHERE n > 0 AND p > q
    )
    SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM r
    QUALIFY part = 'pair' OR rank <= 200
"""


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.span_report(_table(spark, sf_dir, "documents"))


QUERIES["op12_pii"] = op12_pii


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.tamper_report(_table(spark, sf_dir, "documents"))


QUERIES["op13_merkle"] = op13_merkle
ORACLES["op13_merkle"] = """
    WITH RECURSIVE f AS (
        SELECT row_number() OVER () AS row_id, doc_id, lang, n_chars,
               coalesce(octet_length(encode(doc_id::VARCHAR)) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-')
                   || coalesce(octet_length(encode(lang)) || ':' || lang, '-') AS head,
               coalesce(octet_length(encode(text)) || ':' || text, '-') AS tail FROM documents
    ), h AS (
        SELECT row_id, doc_id, lang, head, tail, n_chars, sha256(head || coalesce(length(n_chars::VARCHAR) || ':' || n_chars, '-') || tail) AS leaf FROM f
    ), c AS (
        SELECT row_id, list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda acc, b: xor(acc >> 8, t.crc[(xor(acc, b) & 255) + 1])) AS r FROM (
            SELECT row_id, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT) AS bytes FROM h
        ), (
            SELECT list(list_reduce(list_prepend(i, range(8)), lambda v, _: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END) ORDER BY i) AS crc FROM range(256) x(i)
        ) t
    ), leaves AS (
        SELECT h.*, CASE WHEN xor(c.r, 4294967295) % 7 = 0 THEN sha256(head || coalesce(length((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') || tail) ELSE leaf END AS now,
               row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n
        FROM h JOIN c USING (row_id)
    ), t AS (
        SELECT lang, 0 AS level, i, n, leaf AS node FROM leaves
        UNION ALL
        SELECT lang, level + 1, i // 2, (n + 1) // 2, sha256(node || coalesce(next, '')) FROM (
            SELECT *, lead(node) OVER (PARTITION BY lang ORDER BY i) AS next FROM t WHERE n > 1
        ) WHERE i % 2 = 0
    ), subroots AS (
        SELECT lang, level AS height, node AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM t WHERE n = 1
    ), u AS (
        SELECT 0 AS level, i, n, subroot AS node FROM subroots
        UNION ALL
        SELECT level + 1, i // 2, (n + 1) // 2, sha256(node || coalesce(next, '')) FROM (
            SELECT *, lead(node) OVER (ORDER BY i) AS next FROM u WHERE n > 1
        ) WHERE i % 2 = 0
    ), p AS (
        SELECT l.row_id, k AS level, (l.i >> k) & 1 AS side, coalesce(t.node, '') AS sibling
        FROM leaves l JOIN subroots s ON s.lang IS NOT DISTINCT FROM l.lang CROSS JOIN LATERAL (SELECT unnest(range(s.height)) AS k)
        LEFT JOIN t ON t.lang IS NOT DISTINCT FROM l.lang AND t.level = k AND t.i = xor(l.i >> k, 1)
        UNION ALL
        SELECT l.row_id, s.height + k, (s.i >> k) & 1, coalesce(u.node, '')
        FROM leaves l JOIN subroots s ON s.lang IS NOT DISTINCT FROM l.lang CROSS JOIN LATERAL (SELECT unnest(range((SELECT max(level) FROM u))) AS k)
        LEFT JOIN u ON u.level = k AND u.i = xor(s.i >> k, 1)
    ), fold AS (
        SELECT row_id, 0 AS level, now AS node FROM leaves
        UNION ALL
        SELECT fold.row_id, fold.level + 1, sha256(CASE WHEN side = 1 THEN sibling || node ELSE node || sibling END) FROM fold JOIN p USING (row_id, level)
    ), ends AS (
        SELECT row_id, arg_max(node, level) AS folded_root FROM fold GROUP BY row_id
    ), proofs AS (
        SELECT row_id, string_agg(sibling, '' ORDER BY level) AS siblings FROM p GROUP BY row_id
    ), top AS (SELECT node AS root FROM u WHERE n = 1)
    SELECT doc_id, leaf, subroot, root, sha256(coalesce(siblings, '')) AS proof_sha256, folded_root, folded_root = root AS verified
    FROM leaves l JOIN subroots s ON s.lang IS NOT DISTINCT FROM l.lang CROSS JOIN top JOIN ends USING (row_id) LEFT JOIN proofs USING (row_id)
"""
