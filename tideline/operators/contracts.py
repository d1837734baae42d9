"""Contracts: a JSON schema compiled to columns that tell what each document breaks, and the columns, bounds and dates of a matrix.

Of JSON schema these words are known: type, required, properties, patternProperties, additionalProperties (false),
minProperties, items, minimum, maximum, enum. Formats, titles and the like are notes and bind nothing; any other word
is an error when the schema is compiled, not when rows are checked.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NOTES = {"$schema", "$id", "title", "description", "format", "default", "examples", "$comment"}
WORDS = {"type", "required", "properties", "patternProperties", "additionalProperties", "minProperties", "items", "minimum", "maximum", "enum"}


def _kind(value: Column) -> Column:
    """JSON type of a variant."""
    told = F.schema_of_variant(value)
    return (
        F.when(told.startswith("OBJECT"), "object").when(told.startswith("ARRAY"), "array").when(told == "VOID", "null")
        .when(told == "STRING", "string").when(told == "BOOLEAN", "boolean").otherwise("number")
    )


def _as(value: Column, kind: str) -> Column:
    return F.try_variant_get(value, "$", kind)


OBJECT_WORDS = {"required", "properties", "patternProperties", "additionalProperties", "minProperties"}


def _members(value: Column) -> Column:
    return F.when(_kind(value) == "object", _as(value, "map<string, variant>"))


def _broken(schema: dict, value: Column, where: str, members: Column | None = None) -> Iterator[Column]:
    """Arrays of messages on one value (a variant that is there); with ``members`` given, those of its properties are left to the caller."""
    if unknown := schema.keys() - WORDS - NOTES:
        raise ValueError(f"{where}: {', '.join(sorted(unknown))} not known")
    kind, say = _kind(value), lambda when, text: F.when(when, F.array(F.lit(text))).otherwise(F.array().cast("array<string>"))
    if "type" in schema:
        kinds = [schema["type"]] if isinstance(schema["type"], str) else schema["type"]
        fits = kind.isin(*kinds)
        if "integer" in kinds:
            number = _as(value, "double")
            fits = fits | ((kind == "number") & (number == F.floor(number)))
        yield say(~fits, f"{where}: not {' or '.join(kinds)}")
    for word, bad in (("minimum", lambda x, b: x < b), ("maximum", lambda x, b: x > b)):
        if word in schema:
            yield say((kind == "number") & bad(_as(value, "double"), F.lit(float(schema[word]))), f"{where}: beyond {word}")
    if "enum" in schema:
        strings = [v for v in schema["enum"] if isinstance(v, str)]
        if len(strings) < len(schema["enum"]):
            raise ValueError(f"{where}: enum of other values than strings")
        yield say(~((kind == "string") & F.coalesce(_as(value, "string").isin(*strings), F.lit(False))), f"{where}: not of the enum")
    if schema.keys() & OBJECT_WORDS:
        apart, members = members is not None, _members(value) if members is None else members
        names = F.map_keys(members)
        for name in schema.get("required", ()):
            yield say(F.coalesce(~F.array_contains(names, name), F.lit(False)), f"{where}: {name} missing")
        if "minProperties" in schema:
            yield say(F.coalesce(F.size(names) < schema["minProperties"], F.lit(False)) & (kind == "object"), f"{where}: too few members")
        patterns = schema.get("patternProperties", {})
        if schema.get("additionalProperties", True) is False:
            free = lambda n: ~n.isin(*(schema.get("properties") or [""])) & ~F.coalesce(*[n.rlike(p) for p in patterns], F.lit(False))
            extra = F.filter(names, free)
            yield F.coalesce(F.transform(F.array_sort(extra), lambda n: F.concat(F.lit(f"{where}: "), n, F.lit(" not allowed"))), F.array().cast("array<string>"))
        for name, inner in () if apart else schema.get("properties", {}).items():
            child = F.try_element_at(members, F.lit(name))
            for found in _broken(inner, child, f"{where}.{name}"):
                yield F.when(child.isNotNull(), found).otherwise(F.array().cast("array<string>"))
        for pattern, inner in patterns.items():
            held = F.filter(F.map_entries(members), lambda e: e["key"].rlike(pattern))
            yield _each(held, inner, lambda e: e["value"], f"{where}.{pattern}")
    if "items" in schema:
        yield _each(F.when(kind == "array", _as(value, "array<variant>")), schema["items"], lambda e: e, f"{where}[]")


def _each(values: Column, schema: dict, get, where: str) -> Column:
    """Messages on the values of an array, each once."""
    told = F.transform(values, lambda e: F.concat(F.array().cast("array<string>"), *_broken(schema, get(e), where)))
    return F.coalesce(F.array_distinct(F.flatten(told)), F.array().cast("array<string>"))


def _staged(rows: DataFrame, schema: dict, value: str, where: str, guard: Column) -> tuple[DataFrame, list[Column]]:
    """``rows`` with columns for the members of each object outside arrays, so that each is read once, and the messages on ``value``."""
    if not schema.keys() & OBJECT_WORDS:
        return rows, [F.when(guard, m).otherwise(F.array().cast("array<string>")) for m in _broken(schema, F.col(value), where)]
    held, inner = f"{value}m", list(schema.get("properties", {}).items())
    rows = rows.withColumn(held, _members(F.col(value)))
    found = [F.when(guard, m).otherwise(F.array().cast("array<string>")) for m in _broken(schema, F.col(value), where, F.col(held))]
    rows = rows.withColumns({f"{value}_{i}": F.try_element_at(F.col(held), F.lit(name)) for i, (name, _) in enumerate(inner)}) if inner else rows
    for i, (name, kind) in enumerate(inner):
        rows, more = _staged(rows, kind, f"{value}_{i}", f"{where}.{name}", F.col(f"{value}_{i}").isNotNull())
        found += more
    return rows, found


def with_violations(rows: DataFrame, schema: dict, document: str, name: str = "violations") -> DataFrame:
    """``rows`` with what the JSON text in ``document`` breaks of ``schema``, as an array of messages in order; a text that is no JSON is one violation."""
    parsed = rows.withColumn("_json", F.try_parse_json(document))
    staged, found = _staged(parsed, schema, "_json", "$", F.col("_json").isNotNull())
    told = F.array_sort(F.concat(F.array().cast("array<string>"), *found))
    return staged.select(*rows.columns, F.when(F.col("_json").isNull(), F.array(F.lit("$: no JSON"))).otherwise(told).alias(name))


def column_report(rows: DataFrame, expected: dict[str, str]) -> DataFrame:
    """``column, problem`` for columns that are missing, not expected, or of another type than told; of the schema alone, no row is read."""
    spark: SparkSession = rows.sparkSession
    has = dict(rows.dtypes)
    found = [(c, "missing") for c in expected if c not in has] + [(c, "not expected") for c in has if c not in expected]
    found += [(c, f"is {has[c]}, not {expected[c]}") for c in expected if c in has and has[c] != expected[c]]
    return spark.createDataFrame(found, "column string, problem string")


def matrix_report(rows: DataFrame, d: str, seq: str, bounded: list[str], nullable: list[str] = (), low: float = -8.0, high: float = 8.0) -> DataFrame:
    """``d, column, problem`` for each cell that breaks a matrix's contract.

    Values of ``bounded`` must be there and within bounds, those of ``nullable`` may be absent; dates must be there and
    rise from row to row in the order of ``seq``.
    """
    before = F.max(d).over(Window.orderBy(seq).rowsBetween(Window.unboundedPreceding, -1))  # one row for each day of a matrix
    told = lambda when, column, problem: F.when(when, F.struct(F.lit(column).alias("column"), F.lit(problem).alias("problem")))
    checks = [told(F.col(d).isNull(), d, "missing"), told(F.col(d) <= F.col("_before"), d, "not after the dates before")]
    for c in (*bounded, *nullable):
        absent = F.col(c).isNull() | F.isnan(F.col(c).cast("double"))
        checks += [told(absent, c, "missing")] if c in bounded else []
        checks += [told(~absent & ~F.col(c).between(low, high), c, "outside its bounds")] if c in bounded else []
    found = rows.withColumn("_before", before).select(F.col(d), F.explode(F.array_compact(F.array(*checks))).alias("_p"))
    return found.select(d, "_p.column", "_p.problem")
