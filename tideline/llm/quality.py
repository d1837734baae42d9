"""Quality by hierarchical empirical Bayes.

A classifier gives each document's own evidence. Grouped sums of it give each host and each path a posterior mean:
a path is shrunk toward its host and a host toward all documents, the more the fewer documents it has and the less
groups differ (the strength of a prior comes from the variance between groups, by moments). A document's score
combines its evidence with its path's posterior, from which its own share is taken out.

Cases: a null text is an empty one; null hosts and paths are groups of their own; a host with one document scores
it by evidence and prior; repeated rows count as often as they occur and score alike; a score at the bar is kept;
texts of any length are read whole; without any usable label all evidence is 1/2; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm import classifier
from tideline.llm.shared import stored

#: Groups of which a list is broadcast; a longer list is joined by a shuffle.
BROADCAST_GROUPS = 100_000
#: Prior strengths, in documents, are kept within these.
WEAKEST, STRONGEST = 1.0, 1e6


def _logit(p: Column) -> Column:
    inside = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(inside / (1 - inside))


def _strength(groups: DataFrame, parent: Column) -> float:
    """Documents that the prior counts for: within variance over variance between groups beyond chance."""
    n, mean = F.col("n"), F.col("s") / F.col("n")
    inner = F.sum(F.col("ss") - n * mean * mean)
    row = groups.agg(
        inner.alias("inner"), F.sum(n).alias("n"), F.count(F.lit(1)).alias("groups"), F.sum(n * (mean - parent) ** 2).alias("outer")
    ).first()
    if not row.n or row.n <= row.groups or row.groups < 2:
        return STRONGEST
    within = max(row.inner / (row.n - row.groups), 1e-12)
    between = (row.outer - row.groups * within) / row.n
    return min(STRONGEST, max(WEAKEST, within / between)) if between > 0 else STRONGEST


def _joined(rows: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """Join on null-safe keys; a counted list is broadcast."""
    renamed = groups.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in groups.columns if c not in keys])
    if groups.count() <= BROADCAST_GROUPS:
        renamed = F.broadcast(renamed)
    on = [rows[k].eqNullSafe(renamed[f"_{k}"]) for k in keys]
    return rows.join(renamed, on).drop(*[f"_{k}" for k in keys])


def quality_scores(
    docs: DataFrame,
    labels: DataFrame,
    host: Column,
    path: Column,
    label_col: str = "quality",
    id_col: str = "doc_id",
    text_col: str = "text",
    keep_from: float = 0.5,
) -> DataFrame:
    """``doc_id, host, path, evidence, host_posterior, path_posterior, score, kept`` of each row."""
    label = F.when(F.col(label_col) == 1, "good").when(F.col(label_col) == 0, "poor")
    model = classifier.fit(docs, labels, label, ["good", "poor"], id_col=id_col, text_col=text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), host.alias("host"), path.alias("path"), F.col(text_col).alias("text"))
    seen = classifier.with_posteriors(rows, model).select("doc_id", "host", "path", F.get("posteriors", F.lit(0)).alias("evidence"))
    seen = stored(seen, "evidence")
    e = F.col("evidence")
    paths = stored(
        seen.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum(e).alias("s"), F.sum(e * e).alias("ss")), "paths"
    )
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss"))
    total = hosts.agg(F.sum("s"), F.sum("n")).first()
    overall = total[0] / total[1] if total[1] else 0.5
    by_host = _strength(hosts, F.lit(overall))
    host_mean = ((by_host * overall + F.col("s")) / (by_host + F.col("n"))).alias("host_posterior")
    hosts = hosts.select("host", F.col("n").alias("host_n"), F.col("s").alias("host_s"), host_mean)
    known = _joined(paths, hosts, ["host"])
    by_path = _strength(known, F.col("host_posterior"))
    path_mean = ((by_path * F.col("host_posterior") + F.col("s")) / (by_path + F.col("n"))).alias("path_posterior")
    known = known.select("host", "path", "n", "s", "host_n", "host_s", "host_posterior", path_mean)
    beside = _joined(seen, known, ["host", "path"])
    # what the document's neighbours say, without itself
    host_rest = (by_host * overall + F.col("host_s") - e) / (by_host + F.col("host_n") - 1)
    path_rest = (by_path * host_rest + F.col("s") - e) / (by_path + F.col("n") - 1)
    score = 1 / (1 + F.exp(-(_logit(e) + _logit(path_rest) - _logit(F.lit(overall)))))
    return beside.withColumn("score", score).select(
        "doc_id", "host", "path", "evidence", "host_posterior", "path_posterior", "score", (F.col("score") >= keep_from).alias("kept")
    )
