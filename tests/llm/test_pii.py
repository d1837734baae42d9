"""Personal data: the text as it stands beside plain patterns and SQL, the rewritten one beside a transducer of single characters."""

import hashlib
import random
import re

import pytest

from tests.compare import duck, rows_of
from tests.conftest import DATA
from tideline.llm import pii, queries

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def slow_base(text):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m[0] if c.isascii() and c.isdigit()]
            ok = {
                "email": True,
                "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True,
                "card": 12 <= len(digits) <= 19 and sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(reversed(digits))) % 10 == 0,
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if ok:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def base_of(text):
    return [x[:3] for x in pii.found_in(text) if not x[3]]


def added_in(text):
    return [(pii.KINDS[k], text[s:e], value) for s, k, e, added, value in pii.found_in(text) if added]


def test_base_spans_are_those_of_the_patterns():
    rng = random.Random(4)
    letters = "ab.@@-_+%1234567890  ().é①日\n"
    parts = ["a.b@c.de", "4807614710343232", "4263 6157 5238 9865", "+1 (716) 555-8176", "84.251.36.42", "300.1.1.1", "1.2.3.4.5.6.7.8.9", "x@y@z.co", "a@b.c@d.e", "@@", "00000000000000", "+49 30 1234.", "a@b..c"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) if rng.random() < 0.3 else "".join(rng.choices(letters, k=rng.randrange(9))) for _ in range(rng.randrange(7)))
        assert base_of(text) == slow_base(text), text


def test_base_columns_beside_sql(spark):
    """Places in SQL: the lengths of what lies between the matches of each pattern."""
    found = " UNION ALL ".join(
        f"""SELECT doc_id, {k} AS k, '{kind}' AS kind, unnest(regexp_extract_all(text, '{p}')) AS m, unnest(regexp_split_to_array(text, '{p}')[:-2]) AS gap,
            generate_subscripts(regexp_extract_all(text, '{p}'), 1) AS i FROM d"""
        for k, (kind, p) in enumerate((kind, p.replace("(", "(?:").replace("[\\x20(?:)", "[\\x20()")) for kind, p in PATTERNS.items())
    )
    sql = f"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), f AS ({found}), p AS (
            SELECT *, sum(length(gap) + length(m)) OVER (PARTITION BY doc_id, k ORDER BY i) AS stop, regexp_replace(m, '[^0-9]', '', 'g') AS digits FROM f
        ), l AS (
            SELECT *, list_sum(list_transform(range(1, length(digits) + 1), lambda j: CASE WHEN j % 2 = 1 THEN digits[-j]::INT ELSE 2 * digits[-j]::INT - CASE WHEN digits[-j]::INT > 4 THEN 9 ELSE 0 END END)) AS luhn FROM p
        ), kept AS (
            SELECT doc_id, k, kind, stop - length(m) AS start, stop FROM l
            WHERE CASE kind WHEN 'email' THEN true WHEN 'ip' THEN len(list_filter(string_split(m, '.'), lambda x: x::DOUBLE > 255)) = 0
                WHEN 'card' THEN length(digits) BETWEEN 12 AND 19 AND luhn % 10 = 0 ELSE length(digits) BETWEEN 9 AND 15 END
        )
        SELECT d.doc_id, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip, count(*) FILTER (kind = 'card') AS n_card,
               count(*) FILTER (kind = 'phone') AS n_phone, sha256(coalesce(string_agg(kind || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY start, k), '')) AS base_sha256
        FROM d LEFT JOIN kept USING (doc_id) GROUP BY d.doc_id
    """
    rel = duck(DATA).sql(sql)
    names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256"]
    got = queries.QUERIES["op12_pii"](spark, DATA).select(names).collect()
    assert rows_of(names, got) == rows_of(rel.columns, rel.fetchall()) and sum(r.n_email + r.n_ip + r.n_card + r.n_phone for r in got) > 50


@pytest.mark.parametrize(
    "text, want",
    [
        ("to john.doe [at] mail3 [dot] example [dot] com now", ("email", "john.doe [at] mail3 [dot] example [dot] com", "john.doe@mail3.example.com")),
        ("foo AT bar DOT org", ("email", "foo AT bar DOT org", "foo@bar.org")),
        ("a(at)b.com", ("email", "a(at)b.com", "a@b.com")),
        ("juan arroba correo punto es", ("email", "juan arroba correo punto es", "juan@correo.es")),
        ("x @ y . com", ("email", "x @ y . com", "x@y.com")),
        ("me&#64;mail.com", ("email", "me&#64;mail.com", "me@mail.com")),
        ("jоhn@exаmple.com", ("email", "jоhn@exаmple.com", "john@example.com")),
        ("so joh​n@mail.com", ("email", "joh​n@mail.com", "john@mail.com")),
        ("ip 192 dot 168 dot 0 dot 12.", ("ip", "192 dot 168 dot 0 dot 12", "192.168.0.12")),
        ("one nine two dot one six eight dot zero dot one", ("ip", "one nine two dot one six eight dot zero dot one", "192.168.0.1")),
        ("plus one five five five two three four five six seven eight", ("phone", "plus one five five five two three four five six seven eight", "+15552345678")),
        ("+1 (716) five five five-8176", ("phone", "+1 (716) five five five-8176", "+1 (716) 555-8176")),
        ("is Four Eight zero seven six one four seven one zero three four three two three two.", ("card", "Four Eight zero seven six one four seven one zero three four three two three two", "4807614710343232")),
        ("４８０７ 6147 1034 3232", ("card", "４８０７ 6147 1034 3232", "4807 6147 1034 3232")),
        ("so mpakprda.85 at mail2.example.com and", ("email", "mpakprda.85 at mail2.example.com", "mpakprda.85@mail2.example.com")),
        ("john dot doe at mail.com", ("email", "john dot doe at mail.com", "john.doe@mail.com")),
        ("anna7 (ät) post.de", ("email", "anna7 (ät) post.de", "anna7@post.de")),
        ("fnmi dot two four at mail4 dot example dot com", ("email", "fnmi dot two four at mail4 dot example dot com", "fnmi.24@mail4.example.com")),
        ("plus one (seven one six) five five five-eight one seven six.", ("phone", "plus one (seven one six) five five five-eight one seven six", "+1 (716) 5558176")),
        ("+one (716) 555-oh one seven six.", ("phone", "+one (716) 555-oh one seven six", "+1 (716) 555-0176")),
        ("48O7614710343232", ("card", "48O7614710343232", "4807614710343232")),
        ("vier acht null sieben sechs eins vier sieben eins null drei vier drei zwei drei zwei", ("card", "vier acht null sieben sechs eins vier sieben eins null drei vier drei zwei drei zwei", "4807614710343232")),
    ],
)
def test_disguises(text, want):
    assert added_in(text) == [want]
    assert [x[:3] for x in pii.found_in(text) if not x[3]] == slow_base(text)


@pytest.mark.parametrize("text", ["look at example.com dot", "the end. at foo.bar", "we looked at example.com", "meet me at the dot", "one of two things at one point", "@bob and @al.ice", "a . b", "1 2 3 four", "İ at dot", "", "un dos tres", "J'ai un point"])
def test_clean_texts_get_nothing(text):
    assert added_in(text) == []


def test_places_go_back_through_both_transducers():
    """Beside a version that keeps the source span of every single character."""
    rng = random.Random(8)
    parts = ["jоhn", " [at] ", "mail", " dot ", "com", "one two ", "４", "​", "İ", " @ ", "&#46;", "five", "3", " ", "о", "é"]
    for _ in range(500):
        text = "".join(rng.choices(parts, k=rng.randrange(1, 14)))
        chars = [(c, i, i + 1) for i, c in enumerate(text)]
        for rules in (pii.plain_letters, pii.written_out):
            flat = "".join(c for c, _, _ in chars)
            made = pii.Rewritten(flat, rules(flat))
            new, at = [], 0
            for start, end, put in rules(flat):
                new += chars[at:start] + [(c, chars[start][1], chars[end - 1][2]) for c in put]
                at = end
            new += chars[at:]
            assert made.text == "".join(c for c, _, _ in new)
            for i in range(len(new)):
                for j in range(i + 1, len(new) + 1):
                    a, b = made.back(i, j)
                    assert (chars[a][1], chars[b - 1][2]) == (new[i][1], new[j - 1][2])
            chars = new


def test_report_and_redaction(spark):
    ddl = "doc_id long, text string, spans string, kind string"
    rows = [(1, "é a@b.co, b [at] c.de +49 30 1234567", "x", "y"), (2, None, None, None), (None, "", "", ""), (1, "é a@b.co, b [at] c.de +49 30 1234567", "x", "y")]
    df = spark.createDataFrame(rows, ddl)
    want = "email:2:8,email:10:21,phone:22:36"
    base = hashlib.sha256(b"email:2:8,phone:22:36").hexdigest()
    none = hashlib.sha256(b"").hexdigest()
    got = sorted((tuple(r) for r in pii.span_report(df).collect()), key=repr)
    assert got == sorted([(1, 1, 0, 0, 1, base, want, 1)] * 2 + [(2, 0, 0, 0, 0, none, "", 0), (None, 0, 0, 0, 0, none, "", 0)], key=repr)
    clean = {(r.doc_id, r.text) for r in pii.redacted(df).collect()}
    assert clean == {(1, "é [email], [email] [phone]"), (2, None), (None, "")}
    assert pii.span_report(df.limit(0)).count() == 0


@pytest.mark.parametrize("part", ["z", "1", " ", "@", "a.1", "+1", "one ", "1.1", "(", " at ", "-at-a", "&#64;", "о", " . "])
def test_long_texts_take_linear_time(part):
    import time

    took = []
    for n in (20_000, 200_000):
        text = part * n
        began = time.process_time()
        pii.found_in(text)
        took.append(time.process_time() - began)
    assert took[1] < 40 * took[0] + 0.5
