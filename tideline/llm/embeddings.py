"""Near-duplicate embeddings by randomised-rotation binary codes.

Vectors are turned by random rotations; the signs of the turned components are their code. Stored for each vector
are the packed signs of the first rotation, its correction factor (the inner product of the vector with its own sign
vector) and the keys of its bands. Vectors of one label that agree in some band meet, at first by their codes alone:
the number of differing bits (exclusive or, bit count) tells which pairs may reach the threshold. Only vectors with
such a pair are fetched; for their pairs signs and correction give an unbiased estimate of the inner product and a
bound on its error, and those that may still reach the threshold are computed exactly, in double precision. Bands are as many as it takes for a pair at the threshold to miss all of them with probability
``miss``, and as wide as the largest label needs for a few chance meetings. A bucket of more than BLOCK vectors is
compared block by block in tasks of two blocks. Equal vectors are one class; classes count for each other.

Cases: vectors that are null, empty, zero or hold null or non-finite components, and those with a null label, link
with nothing; vectors of different lengths don't link; a row with a null id keeps its row and names the smallest id
of its component; rows with a repeated id are vectors of their own; an empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.graph import connected_components
from tideline.llm.shared import stored

BLOCK = 2048
#: Half-width of the confidence bound in standard deviations of the estimate's error.
BOUND = 5.0
#: Hot buckets whose list is broadcast; a longer list is joined by a shuffle.
HOT_BROADCAST = 100_000


def rotation(dim: int, number: int) -> np.ndarray:
    """A random orthogonal matrix, the same wherever it is made."""
    q, r = np.linalg.qr(np.random.default_rng([dim, number]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def plan_bands(largest: int, threshold: float, miss: float) -> tuple[int, int]:
    """Bits of a band and number of bands."""
    bits = min(30, max(8, math.ceil(math.log2(max(2, largest)))))
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(miss) / math.log1p(-agree)))


def band_keys(x: np.ndarray, bits: int, bands: int) -> np.ndarray:
    dim = x.shape[1]
    need = bits * bands
    signs = np.concatenate([x @ rotation(dim, i).T > 0 for i in range(-(-need // dim))], axis=1)[:, :need]
    return signs.reshape(len(x), bands, bits) @ (1 << np.arange(bits, dtype=np.int64))


def whole_groups(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Sorted rows in tables that hold whole groups of equal ``key``."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        last = batch.column(key)[batch.num_rows - 1].as_py()
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(keys, last))
        if held and (cut or held[-1].column(key)[0].as_py() != last):
            yield pa.Table.from_batches([*held, *([batch.slice(0, cut)] if cut else [])])
            held = []
        elif cut:
            yield pa.Table.from_batches([batch.slice(0, cut)])
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def meeting_pairs(group: np.ndarray, at_once: int = 1 << 17) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows within groups (consecutive equal values), some at a time."""
    m, step, left, right, n = len(group), 1, [], [], 0
    ends = np.searchsorted(group, group, side="right")
    rows = np.arange(m)
    while len(rows := rows[rows + step < ends[rows]]):
        left.append(rows)
        right.append(rows + step)
        step, n = step + 1, n + len(rows)
        if n >= at_once:
            yield np.concatenate(left), np.concatenate(right)
            left, right, n = [], [], 0
    if left:
        yield np.concatenate(left), np.concatenate(right)


def packed(turned: np.ndarray) -> np.ndarray:
    """Signs of each row as unsigned 64-bit words."""
    bits = np.packbits(turned > 0, axis=1, bitorder="little")
    return np.pad(bits, ((0, 0), (0, -bits.shape[1] % 8))).view("<u8")


def most_differing(dim: int, threshold: float) -> float:
    """Bits in which the codes of two vectors at the threshold differ, with the bound on chance."""
    p = math.acos(threshold) / math.pi
    return dim * p + BOUND * math.sqrt(dim * p * (1 - p))


def column_of(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)


def close_codes(table: pa.Table, dim: int, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows (some at a time) that meet first in this bucket and whose codes allow the threshold."""
    codes, keys = column_of(table, "code").view(np.uint64), column_of(table, "keys")
    task, band, own, split, place = (table.column(c).to_numpy() for c in ("task", "band", "own", "split", "place"))
    limit, before = most_differing(dim, threshold), np.arange(keys.shape[1])
    for i, j in meeting_pairs(task):
        # within a block or, in a task of two, across them
        mine = ((own[i] != own[j]) == (split[i] > 0)) & (place[i] == place[j])
        mine &= np.bitwise_count(codes[i] ^ codes[j]).sum(axis=1) <= limit
        i, j = i[mine], j[mine]
        first = ~((keys[i] == keys[j]) & (before < band[i][:, None])).any(axis=1)
        yield i[first], j[first]


def compare(table: pa.Table, dim: int, threshold: float) -> tuple[np.ndarray, np.ndarray, int]:
    """Linked pairs of the rows that meet first in this bucket, as row numbers, and how many pairs were computed exactly."""
    x = unit(column_of(table, "vec").astype(np.float64))
    correction = table.column("correction").to_numpy()
    turned = x @ rotation(dim, 0).T
    signs = np.where(turned > 0, 1.0, -1.0) / math.sqrt(dim)
    slack = BOUND * np.sqrt(np.clip(1 - correction**2, 0, None)) / correction / math.sqrt(max(1, dim - 1))
    empty, computed = np.zeros(0, dtype=np.int64), 0
    found_i, found_j = [empty], [empty]
    for i, j in close_codes(table, dim, threshold):
        estimate = np.einsum("ij,ij->i", signs[i], turned[j]) / correction[i]
        near = estimate + slack[i] >= threshold
        i, j = i[near], j[near]
        computed += len(i)
        exact = np.einsum("ij,ij->i", x[i], x[j]) >= threshold
        found_i.append(i[exact])
        found_j.append(j[exact])
    return np.concatenate(found_i), np.concatenate(found_j), computed


def by_dim(table: pa.Table) -> Iterator[tuple[int, pa.Table]]:
    """Parts of a table with vectors of one length."""
    dims = table.column("dim").to_numpy()
    for dim in sorted(set(dims.tolist())):
        yield dim, table if (dims == dim).all() else table.filter(pa.array(dims == dim))


def local_roots(m: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of m rows the smallest row it reaches over the pairs."""
    root = np.arange(m)
    while True:
        before = root.copy()
        np.minimum.at(root, i, root[j])
        np.minimum.at(root, j, root[i])
        root = root[root]
        if (root == before).all():
            return root


def near_vectors(
    rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", threshold: float = 0.98, miss: float = 1e-4
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for each row."""
    base = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("vec"), F.col(label_col).alias("label"))
    finite = F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    usable = F.coalesce(F.col("label").isNotNull() & F.col("vec").isNotNull() & finite & F.exists("vec", lambda v: v != 0), F.lit(False))
    good = base.where(usable)
    classes = good.groupBy("label", "vec").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("first"))
    classes = stored(classes.withColumn("cid", F.monotonically_increasing_id()), "vector-classes")
    sizes = classes.groupBy("label", F.size("vec").alias("dim")).count()
    largest = sizes.agg(F.max("count")).first()[0] or 1
    bits, bands = plan_bands(largest, threshold, miss)

    def code(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column("vec").value_lengths().to_numpy()
            keys = np.zeros((batch.num_rows, bands), dtype=np.int64)
            correction, codes = np.ones(batch.num_rows), [b""] * batch.num_rows
            for dim in set(lengths.tolist()):
                at = np.flatnonzero(lengths == dim)
                own = batch.column("vec").take(pa.array(at))
                x = unit(own.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim))
                keys[at] = band_keys(x, bits, bands)
                turned = x @ rotation(dim, 0).T
                correction[at] = np.abs(turned).sum(axis=1) / math.sqrt(dim)
                for row, code in zip(at.tolist(), packed(turned).view(np.int64).tolist()):
                    codes[row] = code
            listed = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, bands, dtype=np.int32), keys.ravel().astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("cid", "n", "label")), pa.array(lengths, pa.int32()), pa.array(codes, pa.list_(pa.int64())), listed, pa.array(correction)],
                names=["cid", "n", "label", "dim", "code", "keys", "correction"],
            )

    kind = classes.schema["label"].dataType.simpleString()
    ddl = f"cid long, n long, label {kind}, dim int, code array<long>, keys array<int>, correction double"
    coded = stored(classes.select("cid", "n", "label", "vec").mapInArrow(code, ddl), "vector-codes")
    buckets = coded.select("label", "dim", F.posexplode("keys").alias("band", "key"))
    hot = buckets.groupBy("label", "dim", "band", "key").count().where(F.col("count") > BLOCK)
    hot = stored(hot.select("label", "dim", "band", "key", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")), "hot-buckets")
    # keys met by one vector only lead nowhere
    shared = buckets.groupBy("label", "dim", "band", "key").count().where("count > 1").drop("count")
    dealt = coded.select("*", F.posexplode("keys").alias("band", "key")).join(shared, ["label", "dim", "band", "key"], "left_semi")
    if hot.count() <= HOT_BROADCAST:
        hot = F.broadcast(hot)
    dealt = dealt.join(hot, ["label", "dim", "band", "key"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    # a hash names the task; rows of two tasks that share one are told apart by another
    task = F.xxhash64("label", "dim", "band", "key", low, high)
    dealt = dealt.select(
        task.alias("task"), F.hash("label", "key", "band", low, high).alias("place"), "dim", (high - low).alias("split"), "own", "band", "cid", "n", "code", "keys", "correction"
    )

    def near_codes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "task"):
            for dim, part in by_dim(table):
                near = np.zeros(part.num_rows, dtype=bool)
                for i, j in close_codes(part, dim, threshold):
                    near[i] = near[j] = True
                yield from part.filter(pa.array(near)).to_batches()

    def meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "task"):
            for dim, part in by_dim(table):
                i, j, computed = compare(part, dim, threshold)
                cid, n = part.column("cid").to_numpy(), part.column("n").to_numpy()
                links = np.bincount(i, n[j], len(cid)) + np.bincount(j, n[i], len(cid))
                linked = np.flatnonzero(links)
                root = local_roots(len(cid), i, j)
                # the group's pairs computed exactly are told by its first row
                exact = np.where(np.arange(len(linked)) == 0, computed, 0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cid[linked]), pa.array(links[linked].astype(np.int64)), pa.array(cid[root[linked]]), pa.array(exact, pa.int64())],
                    names=["cid", "links", "root", "exact"],
                )

    ordered = dealt.repartition("task").sortWithinPartitions("task")
    near = stored(ordered.mapInArrow(near_codes, ordered.schema), "vector-candidates")
    fetched = near.join(classes.select("cid", "vec"), "cid").repartition("task").sortWithinPartitions("task")
    found = stored(fetched.mapInArrow(meet, "cid long, links long, root long, exact long"), "vector-links")
    counts = found.groupBy("cid").agg(F.sum("links").alias("links"))
    components = connected_components(found.select("cid", "root"), "cid", "root").withColumnRenamed("node", "cid")
    slim = classes.select("cid", "first")
    firsts = slim.join(components, "cid").groupBy("component").agg(F.min("first").alias("least"))
    linked = components.join(firsts, "component").select("cid", "least")
    named = (
        classes.join(counts, "cid", "left")
        .join(linked, "cid", "left")
        .select("label", "vec", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("least", "first").alias("component_id"))
    )
    answered = good.join(named, ["label", "vec"]).select("vec_id", "n_links", "component_id")
    alone = base.where(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return answered.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
