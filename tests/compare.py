"""Order-free comparison of a Spark result with DuckDB's."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(data: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{data}/{t}.parquet')")
    return con


def plain(v):
    if v is None or v != v:
        return None
    if hasattr(v, "isoformat"):
        return str(v).removesuffix(" 00:00:00")
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return bool(v)
    if isinstance(v, (int, float)) or type(v).__name__ in ("Decimal", "float64", "int64"):
        return round(float(v), 4)
    return str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def assert_same(df, con, sql):
    got = df.collect()
    rel = con.sql(sql)
    assert sorted(df.columns) == sorted(rel.columns)
    want = rel.fetchall()
    assert len(got) == len(want)
    assert rows_of(df.columns, got) == rows_of(rel.columns, want)
