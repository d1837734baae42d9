"""SimHash fingerprints and near-duplicate groups by the generalised pigeonhole principle.

The 64 bits are grouped into two to four partitions, as many as cost least for the number of fingerprints,
correlated bits together. A fingerprint probes partition i for
keys within t_i bits of its own, where the t_i + 1 sum to one more than the distance allowed: two fingerprints
that differ in at most that many bits then meet in one partition at least. Each fingerprint takes the thresholds
that cost it least, found by dynamic programming on the numbers of keys and of candidates to expect, the latter
from counts of all fingerprints by the leading bits of their keys. What the probes meet is compared whole, inside tasks
that pass on only links which join something, so that groups of near copies give no pairs but their spanning links.

Cases: a null or white-space text has fingerprint zero and is linked like any other; repeated rows share their
fingerprint and group; a row with a null id keeps its row, in the group of its fingerprint, whose component is the
smallest id that is not null (null if there is none); shorter texts than a shingle are one shingle; texts of any
length are read whole; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Collection, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.embeddings import meeting_pairs, whole_groups
from tideline.llm.graph import connected_components
from tideline.llm.shared import small_batches, stored

BITS = 64
#: Numbers of partitions to choose from.
PARTITIONS = (2, 3, 4)
#: Leading bits of a key by which fingerprints are counted; the largest threshold of a partition.
COUNTED_BITS, LARGEST = 12, 2
#: Shingles hashed at a time, so that the longest text needs no more memory.
AT_ONCE = 1 << 18
#: Rows of a block of a bucket; two blocks are compared in one task.
BLOCK = 1024
#: Bands of min-hashes and their rows: sets with similarity 0.8 miss all bands with probability (1 - 0.8 ** 5) ** 24 = 7e-5.
BANDS, BAND_ROWS = 24, 5
MIN_HASHES = np.random.default_rng(42).integers(0, 1 << 64, BANDS * BAND_ROWS, dtype=np.uint64)
SPREAD = np.uint64(0x9E3779B97F4A7C15)
BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.float64)
BYTE_PLACES = 256 * np.arange(8, dtype=np.int64)


def fingerprint(text: bytes, width: int = 4, seed: int = 42) -> int:
    """The fingerprint of a text in UTF-8, as a signed 64-bit integer."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - width + 1)
    starts, ends = starts[:n], ends[min(width, len(words)) - 1 :]
    digest, set_bits = xxhash.xxh64_intdigest, np.zeros(BITS)
    for at in range(0, n, AT_ONCE):
        spans = zip(starts[at : at + AT_ONCE].tolist(), ends[at : at + AT_ONCE].tolist())
        set_bits += bits_set(np.array([digest(joined[s:e], seed) for s, e in spans], dtype="<u8"))
    return majority(set_bits, n)


def bits_set(hashes: np.ndarray) -> np.ndarray:
    """How many of the 64-bit ``hashes`` have each bit set."""
    places = hashes.view(np.uint8).reshape(-1, 8) + BYTE_PLACES
    return (np.bincount(places.ravel(), minlength=8 * 256).reshape(8, 256).astype(np.float64) @ BYTE_BITS).ravel()


def majority(set_bits: np.ndarray, n: int) -> int:
    """The signed 64-bit integer of the bits set in over half of ``n`` hashes."""
    return int(np.packbits(2 * set_bits > n, bitorder="little").view("<i8")[0])


def fingerprints(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, seed: int = 42
) -> DataFrame:
    """``doc_id, fp`` (signed 64-bit) for each row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            fps = [fingerprint(t.as_py() or b"", width, seed) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def plan_widths(n: int, distance: int) -> list[int]:
    """Widths of the partitions that need the fewest probes and chance meetings among ``n`` fingerprints."""
    best = None
    for m in PARTITIONS:
        if distance >= (LARGEST + 1) * m:
            continue
        widths = [BITS // m + (i < BITS % m) for i in range(m)]
        steps = [(distance + 1) // m + (i < (distance + 1) % m) for i in range(m)]
        cost = 0.0
        for width, step in zip(widths, steps):
            probes = sum(math.comb(width, k) for k in range(step))
            cost += probes * (1 + n / 2.0**width)
        if best is None or cost < best[0]:
            best = (cost, widths)
    return best[1]


def bit_groups(fps: DataFrame, widths: list[int]) -> list[list[int]]:
    """The bits in partitions of ``widths``, correlated bits together, from the co-occurrence of bits in all of ``fps``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False).astype("<i8")
            bits = np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64)
            total, n = total + bits.T @ bits, n + len(bits)
        if n:
            rows, cols = np.indices((BITS, BITS)).reshape(2, -1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows, pa.int32()), pa.array(cols, pa.int32()), pa.array(total.ravel().astype(np.int64)), pa.array(np.full(BITS * BITS, n))],
                names=["i", "j", "both", "n"],
            )

    # as many sums as there are pairs of bits
    sums = fps.select("fp").mapInArrow(run, "i int, j int, both long, n long").groupBy("i", "j").agg(F.sum("both"), F.sum("n"))
    both, n = np.zeros((BITS, BITS)), 1
    for i, j, x, n in sums.collect():
        both[i, j] = x
    p = np.diag(both) / n
    spread = np.sqrt(np.clip(p * (1 - p), 1e-9, None))
    tie = np.abs(both / n - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(tie, 0)
    groups, free = [], set(range(BITS))
    for width in widths:
        own = [max(sorted(free), key=lambda b: sum(sorted((tie[b, x] for x in free), reverse=True)[: width - 1]))]
        free.discard(own[0])
        while len(own) < width:
            own.append(max(sorted(free), key=lambda b: tie[b, own].sum()))
            free.discard(own[-1])
        groups.append(sorted(own))
    return groups


def keys_of(values: np.ndarray, group: list[int]) -> np.ndarray:
    """The bits of ``group``, gathered into one integer for each fingerprint."""
    values, key = values.astype(np.uint64), np.zeros(len(values), dtype=np.int64)
    for at, bit in enumerate(group):
        key |= ((values >> np.uint64(bit)) & np.uint64(1)).astype(np.int64) << at
    return key


def flips(width: int, most: int) -> list[list[int]]:
    """Masks of ``width`` bits by the number of bits set: those with 0, with 0 and 1, and so on up to ``most``."""
    one = [1 << i for i in range(width)]
    two = [x | y for i, x in enumerate(one) for y in one[:i]]
    return [[0], [0, *one], [0, *one, *two]][: most + 1]


def expected(counts: np.ndarray, width: int) -> np.ndarray:
    """By threshold and leading bits: how many fingerprints a probe of all keys within the threshold meets."""
    rest, at = width - COUNTED_BITS, np.arange(1 << COUNTED_BITS)
    one = sum(counts[at ^ (1 << i)] for i in range(COUNTED_BITS))
    two = sum(counts[at ^ (1 << i) ^ (1 << j)] for i in range(COUNTED_BITS) for j in range(i))
    share = 1 / (1 << rest)
    return np.stack([counts * share, (counts * (1 + rest) + one) * share, (counts * (1 + rest + rest * (rest - 1) / 2) + one * (1 + rest) + two) * share])


def allocate(costs: list[np.ndarray], distance: int) -> np.ndarray:
    """Thresholds (-1: no probe) by row and partition, at least cost, with sum of threshold + 1 equal to distance + 1.

    ``costs[i][t]`` is the cost of threshold t in partition i, for each row.
    """
    need, rows = distance + 1, costs[0].shape[1]
    best = np.full((need + 1, rows), np.inf)
    best[0], taken = 0.0, []
    for cost in costs:
        options = np.full((LARGEST + 2, need + 1, rows), np.inf)
        for step in range(LARGEST + 2):  # step = threshold + 1
            spent = cost[step - 1] if step else 0.0
            options[step, step:] = best[: need + 1 - step] + spent
        taken.append(options.argmin(axis=0))
        best = options.min(axis=0)
    out, left, row = np.empty((len(costs), rows), dtype=np.int64), np.full(rows, need), np.arange(rows)
    for i in range(len(costs) - 1, -1, -1):
        step = taken[i][left, row]
        out[i], left = step - 1, left - step
    return out


def probes_and_keys(fps: DataFrame, distance: int) -> tuple[DataFrame, DataFrame]:
    """``space, part, key, fp`` twice: the keys that each fingerprint probes, and those it holds.

    Two of the distinct fingerprints ``fps`` of one space (column ``space``, else all) that differ in at most
    ``distance`` bits meet in one key at least.
    """
    if not 0 <= distance < (LARGEST + 1) * max(PARTITIONS):
        raise ValueError(f"distance {distance} is too large for thresholds up to {LARGEST}")
    fps = fps.select("space" if "space" in fps.columns else F.lit(0).alias("space"), "fp")
    widths = plan_widths(fps.groupBy("space").count().agg(F.max("count")).first()[0] or 0, distance)
    groups, parts = bit_groups(fps, widths), range(len(widths))
    ddl = "space int, fp long, " + ", ".join(f"k{i} long" for i in parts)

    def keyed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(1).to_numpy(zero_copy_only=False)
            keys = [pa.array(keys_of(values, g)) for g in groups]
            yield pa.RecordBatch.from_arrays([*batch.columns, *keys], names=["space", "fp", *(f"k{i}" for i in parts)])

    keys = stored(fps.select(F.col("space").cast("int"), "fp").mapInArrow(keyed, ddl), "keys")
    part_key = F.posexplode(F.array(*[f"k{i}" for i in parts])).alias("part", "key")
    # by partition and leading bits: at most 4 x 4096 sums
    shift = F.array(*[F.lit(w - COUNTED_BITS) for w in widths])
    heads = F.call_function("shiftright", "key", F.get(shift, F.col("part"))).cast("int")
    counts = np.zeros((len(widths), 1 << COUNTED_BITS))
    for part, head, n in keys.select(part_key).groupBy("part", heads.alias("head")).count().collect():
        counts[part, head] = n
    tables = [expected(c, w) for c, w in zip(counts, widths)]
    masks = [flips(w, LARGEST) for w in widths]

    def probing(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            costs = []
            for i, width in enumerate(widths):
                head = batch.column(2 + i).to_numpy(zero_copy_only=False) >> (width - COUNTED_BITS)
                costs.append(np.stack([tables[i][t][head] + len(masks[i][t]) for t in range(LARGEST + 1)]))
            chosen = allocate(costs, distance)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *(pa.array(t.astype(np.int32)) for t in chosen)], names=[*batch.schema.names, *(f"t{i}" for i in parts)]
            )

    chosen = keys.mapInArrow(probing, ddl + ", " + ", ".join(f"t{i} int" for i in parts))
    tries = F.array(*[F.struct(F.lit(i).alias("part"), F.col(f"k{i}").alias("k"), F.col(f"t{i}").alias("t")) for i in parts])
    tried = chosen.select("space", "fp", F.explode(tries).alias("try")).select("space", "fp", "try.*").where("t >= 0")
    reach = F.array(*[F.array(*[F.array(*[F.lit(m).cast("long") for m in by_t]) for by_t in by_part]) for by_part in masks])
    probes = tried.select("space", "fp", "part", "k", F.explode(F.get(F.get(reach, F.col("part")), F.col("t"))).alias("flip")).select(
        "space", "part", F.col("k").bitwiseXOR(F.col("flip")).alias("key"), "fp"
    )
    return probes, keys.select("space", part_key, "fp")


def links(fps: DataFrame, distance: int = 4) -> DataFrame:
    """``space, a, b``: all pairs of the distinct fingerprints ``fps`` that differ in at most ``distance`` bits (each maybe more than once).

    Where ``fps`` has a column ``space`` only fingerprints of one space are compared, and all spaces in one job.
    """
    probes, held = probes_and_keys(fps, distance)
    pairs = probes.withColumnRenamed("fp", "a").join(held.withColumnRenamed("fp", "b"), ["space", "part", "key"])
    return pairs.where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)).select("space", "a", "b")


def joining(i: np.ndarray, j: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Places of the links (i, j) that join what ``label`` has apart, without a circle; ``label`` is brought up to date."""
    chosen, left = [], np.arange(len(i))
    while len(left := left[label[i[left]] != label[j[left]]]):
        x, y = label[i[left]], label[j[left]]
        high, first = np.unique(np.maximum(x, y), return_index=True)
        chosen.append(left[first])
        # each root hangs on a smaller one, so there is no circle
        root = np.arange(len(label))
        root[high] = np.minimum(x, y)[first]
        while not np.array_equal(root, root[root]):
            root = root[root]
        label[:] = root[label]
    return np.concatenate(chosen) if chosen else np.empty(0, dtype=np.int64)


def spanning_links(fps: DataFrame, distance: int = 4, block: int = BLOCK) -> DataFrame:
    """``space, a, b``: as many of the pairs of ``links`` as keep joined what they join, in number at most that of probes.

    What meets under a key is compared inside tasks, and a pair leaves its task only if it joins two fingerprints that
    others have not joined there, so a dense group gives links in proportion to its size. Keys that more than ``block``
    fingerprints hold are dealt out in blocks of held and of probing ones, a task for each two.
    """
    probes, held = probes_and_keys(fps, distance)
    full = held.groupBy("space", "part", "key").count().where(F.col("count") > block)
    full = stored(full.select("space", "part", "key", F.ceil(F.col("count") / block).cast("int").alias("blocks")), "full-keys")
    met = held.withColumn("probe", F.lit(False)).union(probes.withColumn("probe", F.lit(True))).join(full, ["space", "part", "key"], "left")
    met = met.withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    block_of = lambda probe: F.when(F.col("probe") == probe, F.col("own")).otherwise(F.col("other"))
    met = met.select("space", F.xxhash64("space", "part", "key", block_of(True), block_of(False)).alias("task"), "probe", "fp")

    def meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "task"):
            space, task, probe, fp = (table.column(c).to_numpy() for c in ("space", "task", "probe", "fp"))
            # rows of a task stand together, held before probing
            starts = np.searchsorted(task, task)
            held_n = np.bincount(starts, weights=~probe, minlength=len(task)).astype(np.int64)[starts]
            asking = np.flatnonzero(probe & (held_n > 0))
            # fingerprints as nodes, those of different spaces apart
            order = np.lexsort((fp, space))
            new = np.r_[True, (fp[order][1:] != fp[order][:-1]) | (space[order][1:] != space[order][:-1])]
            node = np.empty(len(fp), dtype=np.int64)
            node[order] = np.cumsum(new) - 1
            label, ends = np.arange(int(new.sum())), np.cumsum(held_n[asking])
            cuts = np.searchsorted(ends, np.arange(1 << 20, int(ends[-1]) if len(ends) else 0, 1 << 20))
            for rows in np.split(asking, np.unique(cuts)):
                n = held_n[rows]
                i = np.repeat(rows, n)
                j = np.repeat(starts[rows] - np.cumsum(n) + n, n) + np.arange(len(i))
                near = np.flatnonzero((np.bitwise_count(fp[i] ^ fp[j]) <= distance) & (space[i] == space[j]))
                found = near[joining(node[i[near]], node[j[near]], label)]
                a, b = fp[i[found]], fp[j[found]]
                yield pa.RecordBatch.from_arrays([pa.array(space[i[found]]), pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["space", "a", "b"])

    ordered = met.repartition("task").sortWithinPartitions("task", "probe")
    return ordered.mapInArrow(meet, "space int, a long, b long")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, distance: int = 4, seed: int = 42
) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for each row of ``docs``.

    ``component_id`` is the smallest id reachable over fingerprints that differ in at most ``distance`` bits.
    """
    rows = stored(fingerprints(docs, id_col, text_col, width, seed), "fingerprints")
    classes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    joined = connected_components(spanning_links(classes, distance).select("a", "b"))
    # classes that no other is near keep their own first id
    rooted = classes.join(joined.withColumnRenamed("node", "fp"), "fp")
    firsts = rooted.groupBy("component").agg(F.min("first").alias("component_id"))
    linked = rooted.join(firsts, "component").select("fp", F.col("component_id").alias("linked_id"))
    named = classes.join(linked, "fp", "left").select("fp", F.coalesce("linked_id", "first").alias("component_id"))
    # written, so that the last join has plain exchanges and Spark can split the rows of a very common fingerprint
    return rows.join(stored(named, "named"), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def shingle_hashes(text: bytes, width: int = 5) -> np.ndarray:
    """A 64-bit hash of each shingle of a text in order, cut as for ``fingerprint``, made of the hashes of its words."""
    words = text.lower().split()
    known = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = max(1, len(words) - width + 1) if words else 0
    out = np.zeros(n, dtype=np.uint64)
    for k in range(min(width, len(words))):
        out = (out ^ (out >> np.uint64(31))) * SPREAD + known[k : k + n]
    return (out ^ (out >> np.uint64(29))) * SPREAD


def seeded_fingerprints(hashes: np.ndarray, seeds: Collection[int]) -> list[int]:
    """The SimHash of shingle hashes under each seed, which mixes the hashes anew."""
    found = []
    for seed in seeds:
        set_bits = np.zeros(BITS)
        for at in range(0, len(hashes), AT_ONCE):
            x = (hashes[at : at + AT_ONCE] ^ np.uint64(seed * int(SPREAD) % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9)
            set_bits += bits_set((x ^ (x >> np.uint64(32))) * SPREAD)
        found.append(majority(set_bits, len(hashes)))
    return found


def shingles(text: bytes, width: int = 5) -> np.ndarray:
    """Sorted hashes of the distinct shingles of a text."""
    return np.unique(shingle_hashes(text, width))


def min_hashes(own: np.ndarray) -> np.ndarray:
    """Min-hashes of a set of shingle hashes: two sets share each with the probability of their similarity."""
    least = np.full(len(MIN_HASHES), np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(own), 512):
        x = (own[at : at + 512, None] ^ MIN_HASHES) * SPREAD
        x ^= x >> np.uint64(32)
        least = np.minimum(least, (x * SPREAD).min(axis=0))
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    """One key for each band of min-hashes: two sets share a key with their similarity to the power of BAND_ROWS."""
    rows, keys = least.reshape(BANDS, BAND_ROWS), np.arange(BANDS, dtype=np.uint64)
    for k in range(BAND_ROWS):
        keys = ((keys ^ (keys >> np.uint64(31))) * SPREAD) ^ rows[:, k]
    return keys.view(np.int64)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two sorted arrays of distinct values; of two empty ones it is 1."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


def alike(pairs: DataFrame, texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """The ``pairs`` (a, b) of nodes whose ``texts`` (node, text) have at least ``similarity``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            kept = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                kept.append(jaccard(shingles(x.as_py() or b"", width), shingles(y.as_py() or b"", width)) >= similarity)
            yield batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))

    x, y = texts.select(F.col("node").alias("a"), F.col("text").alias("x")), texts.select(F.col("node").alias("b"), F.col("text").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def least_agreeing(similarity: float) -> int:
    """Min-hashes that two sets of at least ``similarity`` share, but for a chance below one in a million."""
    n = BANDS * BAND_ROWS
    return math.floor(n * similarity - 5 * math.sqrt(n * similarity * (1 - similarity)))


def likely_pairs(table: pa.Table, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows (some at a time) of different parts that meet first in this bucket and share enough min-hashes."""
    key, place, own, split, part = (table.column(c).to_numpy() for c in ("key", "place", "own", "split", "part"))
    keys = table.column("keys").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(key), BANDS)
    signs = np.frombuffer(b"".join(table.column("signs").to_pylist()), dtype=np.uint8).reshape(len(key), -1)
    band, enough = (keys == key[:, None]).argmax(axis=1), least_agreeing(similarity)
    for i, j in meeting_pairs(table.column("task").to_numpy(), 1 << 16):
        mine = ((own[i] != own[j]) == (split[i] > 0)) & (key[i] == key[j]) & (place[i] == place[j]) & (part[i] != part[j])
        i, j = i[mine], j[mine]
        near = (signs[i] == signs[j]).sum(axis=1) >= enough
        i, j = i[near], j[near]
        first = ~((keys[i] == keys[j]) & (np.arange(BANDS) < band[i][:, None])).any(axis=1)
        yield i[first], j[first]


def cross_links(parts: DataFrame, nodes: DataFrame, texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """``a, b``: links between nodes of different parts that share a bucket of ``parts`` (key, node, part, n), enough to join all that are alike.

    Buckets are compared in blocks of BLOCK rows, a task for every two, first by min-hashes alone. Texts are fetched
    only for nodes with a likely partner and compared in the task: pairs that links found there already join are
    skipped, and only links leave it.
    """
    dealt = parts.join(nodes.select("node", "keys", "signs"), "node").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    dealt = dealt.select(
        F.xxhash64("key", low, high).alias("task"), F.hash(low, high).alias("place"), (high - low).alias("split"), "own", "key", "part", "node", "keys", "signs"
    )

    def likely(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "task"):
            near = np.zeros(table.num_rows, dtype=bool)
            for i, j in likely_pairs(table, similarity):
                near[i] = near[j] = True
            yield from table.filter(pa.array(near)).to_batches()

    def meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "task"):
            part, node, text, known = table.column("part").to_numpy(), table.column("node").to_numpy(), table.column("text"), {}
            root, found = {p: p for p in part.tolist()}, []

            def top(p: int) -> int:
                while root[p] != p:
                    root[p] = p = root[root[p]]
                return p

            def set_of(row: int) -> np.ndarray:
                if row not in known:
                    known[row] = shingles(text[row].as_py() or b"", width)
                return known[row]

            for i, j in likely_pairs(table, similarity):
                for x, y in zip(i.tolist(), j.tolist()):
                    p, q = top(int(part[x])), top(int(part[y]))
                    if p != q and jaccard(set_of(x), set_of(y)) >= similarity:
                        root[max(p, q)] = min(p, q)
                        found.append((node[x], node[y]))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["a", "b"])

    ordered = dealt.repartition("task").sortWithinPartitions("task")
    near = stored(ordered.mapInArrow(likely, ordered.schema), "likely")
    fetched = near.join(texts, "node").repartition("task").sortWithinPartitions("task")
    return stored(fetched.mapInArrow(meet, "a long, b long"), "cross-links")


def similar_groups(
    rows: DataFrame, width: int = 5, distance: int = 5, seeds: tuple[int, ...] = (42, 43, 44), similarity: float = 0.8
) -> DataFrame:
    """``doc_id, text_hash, component`` for each distinct row of ``rows`` (doc_id, text).

    Rows are in one group when a chain of texts joins them, each with at least ``similarity`` (Jaccard, shingles of
    ``width`` words) to the next. Candidates have fingerprints at most ``distance`` bits apart under one of ``seeds``
    or share a band of min-hashes; each is compared whole. At 0.8 a pair misses all bands with probability 7e-5. A
    bucket's texts are first compared with its smallest node, then with each other where that left more than one group.
    """

    def mark(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            nodes, keys, signs, fps = [], [], [], []
            for t in batch.column("text"):
                hashes = shingle_hashes(t.as_py() or b"", width)
                own = np.unique(hashes)
                nodes.append(xxhash.xxh64_intdigest(own.tobytes()) - (1 << 63))
                least = min_hashes(own)
                keys.append(band_keys(least))
                signs.append((least >> np.uint64(24)).astype(np.uint8).tobytes())
                fps.append(seeded_fingerprints(hashes, seeds))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array(nodes, pa.int64()), pa.array(keys, longs), pa.array(signs, pa.binary()), pa.array(fps, longs)],
                names=["doc_id", "text_hash", "node", "keys", "signs", "fps"],
            )

    longs, hashed = pa.list_(pa.int64()), F.xxhash64("text").alias("text_hash")
    slim = rows.select("doc_id", hashed, F.col("text").cast("binary").alias("text"))
    marked = stored(slim.mapInArrow(mark, "doc_id long, text_hash long, node long, keys array<long>, signs binary, fps array<long>"), "marked")
    # one text stands for all with the same shingles
    nodes = stored(marked.groupBy("node").agg(F.min_by(F.struct("text_hash", "keys", "signs", "fps"), "text_hash").alias("n")).select("node", "n.*"), "nodes")

    held = nodes.select("node", F.explode("keys").alias("key"))
    shared = held.groupBy("key").agg(F.min("node").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1")
    held = stored(held.join(shared, "key").select("key", "node", "least"), "buckets")
    found = held.select(F.col("node").alias("a"), F.col("least").alias("b"))
    # the fingerprints of all seeds in one table: nodes of one fingerprint hang on the least of them
    prints = nodes.select("node", "keys", F.posexplode("fps").alias("space", "fp"))
    classes = stored(prints.groupBy("space", "fp").agg(F.min("node").alias("least"), F.min_by("keys", "node").alias("keys")), "classes")
    found = found.union(prints.join(classes.drop("keys"), ["space", "fp"]).select("node", "least"))
    x, y = (classes.select("space", F.col("fp").alias(end), F.col("least").alias(f"{end}_node"), F.col("keys").alias(f"{end}_keys")) for end in ("a", "b"))
    near = spanning_links(classes, distance).join(x, ["space", "a"]).join(y, ["space", "b"])
    # pairs that share a band are compared in its bucket, a large group of copies there without its pairs
    found = found.union(near.where(~F.arrays_overlap("a_keys", "b_keys")).select("a_node", "b_node"))
    ordered = lambda pairs: pairs.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    first = stored(ordered(found), "pairs")

    wanted = held.select("node").union(first.select("a")).union(first.select("b")).distinct()
    wanted = wanted.join(nodes.select("node", "text_hash"), "node")
    texts = stored(rows.select(hashed, F.col("text").cast("binary").alias("text")).join(wanted, "text_hash").dropDuplicates(["node"]).select("node", "text"), "texts")
    linked = stored(alike(first, texts, width, similarity), "alike")

    joined = connected_components(linked)
    parts = held.join(joined, "node", "left").select("key", "node", F.coalesce("component", "node").alias("part"))
    mixed = parts.groupBy("key").agg(F.min("part").alias("p"), F.max("part").alias("q"), F.count(F.lit(1)).alias("n")).where("p != q").select("key", "n")
    parts = stored(parts.join(mixed, "key"), "parts")
    joined = connected_components(linked.union(cross_links(parts, nodes, texts, width, similarity)))
    return marked.join(joined, "node", "left").select("doc_id", "text_hash", F.coalesce("component", "node").alias("component")).distinct()


def one_of_each(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 5,
    distance: int = 5,
    seeds: tuple[int, ...] = (42, 43, 44),
    similarity: float = 0.8,
) -> DataFrame:
    """The rows of ``docs`` that stand for their group of ``similar_groups``: its smallest id, repeated rows once.

    Each row goes by its own id and text. Rows without id are in the groups of their texts and come after those that
    have one; of several texts with a group's smallest id, that with the smallest hash stays.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    named = stored(similar_groups(rows, width, distance, seeds, similarity), "groups")
    place = F.struct(F.col("doc_id").isNull().alias("x"), F.col("doc_id").alias("y"), F.col("text_hash").alias("z"))
    # written, so that the join has plain exchanges and Spark can split the rows of a very large group
    firsts = stored(named.groupBy("component").agg(F.min(place).alias("first")), "firsts")
    gone = named.join(firsts, "component").where(~place.eqNullSafe(F.col("first"))).select(
        F.col("doc_id").alias("_gone"), F.col("text_hash").alias("_hash")
    )
    kept = docs.join(
        gone, docs[id_col].cast("long").eqNullSafe(gone["_gone"]) & (F.xxhash64(docs[text_col]) == gone["_hash"]), "left_anti"
    )
    return kept.dropDuplicates([id_col, text_col]) if docs.count() > named.count() else kept
