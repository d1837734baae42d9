"""Token-id files: documents encoded, laid end to end in id order and written as compressed planes.

Ids are cut into blocks of a fixed size; a block is transposed into byte planes (all lowest bytes, then all second
bytes, ...) or bit planes, and each plane is compressed with zstandard. Beside the table of blocks (``blocks``, one to
a row) two tables are stored: the chunk index (``chunks``: where each block starts) and the document index
(``documents``: the blocks and the place of each document). A document's place among all documents is its place in its
part plus the lengths of the parts before it, of which there are as many as there are partitions. Blocks are read
each for itself; only documents that lie in several blocks are put together by a grouping.

Cases: a null text is an empty one (its end id only); rows come in the order of id, then text, nulls first; rows
with a repeated id each have their own place; texts of any length are encoded whole, one at a time; extra columns
are ignored; an empty table gives empty files.
"""

from __future__ import annotations

import json
import os
import string
from collections.abc import Collection, Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline.llm.shared import new_path, small_batches

#: Bytes of chunks that a worker keeps, in two generations, and what Python adds to each of them.
KEPT_BYTES, ENTRY = 128 << 20, 200
#: Parts whose starts are broadcast; a longer list is joined by a shuffle.
BROADCAST_PARTS = 100_000
WHITE, TAIL = b" \t\n\v\f\r", string.punctuation.encode()


class ChunkEncoder:
    """Maps runs of text without white space (UTF-8) to their ids as little-endian unsigned 32-bit integers.

    Runs met before are kept, at most KEPT_BYTES of them: when half of that is new since, the older half goes. Only for tokenizers that drop white space and look at nothing across it, which ``__init__`` checks. Runs not
    met before are encoded together: a run of letters is one word of the model, whose last token alone ends a word.
    """

    def __init__(self, tokenizer_path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # one thread for each Spark task
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        settings = json.loads(self.tokenizer.to_str())
        split = json.dumps(settings.get("pre_tokenizer"))
        drops = '"Removed"' in split and '"add_prefix_space": true' not in split
        added = settings["added_tokens"]
        plain = not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added)
        suffix = settings["model"].get("end_of_word_suffix")
        if not (drops and plain and suffix) or any(set(t["content"].encode()) & set(WHITE) for t in added):
            raise ValueError("this tokenizer keeps white space: chunks between it can't be encoded apart")
        lowers = "Lowercase" in json.dumps(settings.get("normalizer"))
        self.added = [t["content"].encode() for t in added]
        #: What all added tokens begin with.
        self.mark = os.path.commonprefix(self.added) if self.added else b"\0"
        self.lowers = lowers
        self.new, self.old, self.size = {}, {}, 0
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends[i] = token.endswith(suffix)

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype="<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def chunks(self, text: bytes) -> list[bytes]:
        """The runs; their ASCII letters in lower case where the tokenizer lowers them anyway, so that fewer are met."""
        if not self.lowers:
            return text.split()
        lower = text.lower()
        return (text if any(m.lower() in lower for m in self.added) else lower).split()

    def learn(self, missing: Collection[bytes]) -> None:
        """Put ``missing`` among the new runs, from the older ones or by the tokenizer."""
        if self.size > KEPT_BYTES // 2:
            self.new, self.old, self.size = {}, self.new, 0
        old, known = self.old, {}
        letters, odd, split = {}, set(), []
        mark = self.mark
        for chunk in missing:
            if (ids := old.get(chunk)) is not None:
                known[chunk] = ids
                continue
            core = chunk.rstrip(TAIL)
            # punctuation is apart from a letter before it, unless it is part of an added token
            if len(core) == len(chunk) or not core[-1:].isalpha() or mark in chunk:
                core = chunk
            else:
                tail = chunk[len(core) :]
                odd.add(tail)
                split.append((chunk, core, tail))
            if (ids := self.new.get(core) or old.get(core)) is not None:
                known[core] = ids
            elif core.isalpha():
                letters[core] = None
            elif (text := core.decode()).isalpha() and max(text) < "\u0100":
                letters[core] = None
            else:
                odd.add(core)
        if odd:
            known.update(zip(odd, (ids.tobytes() for ids in self.ids([c.decode() for c in odd]))))
        if letters:
            ids = self.ids([b" ".join(letters).decode()])[0]
            stops = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            raw, at = ids.tobytes(), 0
            for core, stop in zip(letters, stops, strict=True):
                known[core] = raw[at:stop]
                at = stop
        for chunk, core, tail in split:
            known[chunk] = known[core] + known[tail]
        self.size += ENTRY * len(known) + sum(map(len, known)) + sum(map(len, known.values()))
        self.new.update(known)

    def encode_batch(self, texts: list[bytes]) -> list[bytes]:
        split = [self.chunks(t) for t in texts]
        found = [list(map(self.new.get, chunks)) for chunks in split]
        missing = {c for chunks, ids in zip(split, found) if None in ids for c, i in zip(chunks, ids) if i is None}
        if not missing:
            return [b"".join(ids) for ids in found]
        self.learn(missing)
        new = self.new
        return [
            b"".join([new[c] if i is None else i for c, i in zip(chunks, ids)] if None in ids else ids) for chunks, ids in zip(split, found)
        ]


_ENCODERS: dict[str, ChunkEncoder] = {}


def encoder(tokenizer_path: str) -> ChunkEncoder:
    """One encoder for each tokenizer in a worker process."""
    if tokenizer_path not in _ENCODERS:
        _ENCODERS[tokenizer_path] = ChunkEncoder(tokenizer_path)
    return _ENCODERS[tokenizer_path]


def to_planes(ids: np.ndarray, planes: str, level: int = 1) -> list[bytes]:
    """``ids`` (unsigned 32-bit) as compressed planes: 4 of bytes or 32 of bits, lowest first."""
    rows = np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(-1, 4)
    if planes == "byte":
        parts = [rows[:, i].tobytes() for i in range(4)]
    elif planes == "bit":
        bits = np.unpackbits(rows, axis=1, bitorder="little")
        parts = [np.packbits(bits[:, i], bitorder="little").tobytes() for i in range(32)]
    else:
        raise ValueError(f"planes must be 'byte' or 'bit', not {planes!r}")
    squeeze = zstandard.ZstdCompressor(level=level)
    return [squeeze.compress(p) for p in parts]


def from_planes(parts: list[bytes], n: int) -> np.ndarray:
    """The ids that ``to_planes`` was given."""
    raw = [zstandard.ZstdDecompressor().decompress(p) for p in parts]
    rows = np.empty((n, 4), dtype=np.uint8)
    if len(raw) == 4:
        for i, p in enumerate(raw):
            rows[:, i] = np.frombuffer(p, dtype=np.uint8)
    else:
        bits = np.stack([np.unpackbits(np.frombuffer(p, dtype=np.uint8), count=n, bitorder="little") for p in raw], axis=1)
        rows[:] = np.packbits(bits, axis=1, bitorder="little")
    return rows.reshape(-1).view("<u4")


FILE_SCHEMA = "part int, seq long, at long, n_ids long, first long, planes array<binary>, docs binary"
ARROW = pa.schema(
    [("part", pa.int32()), ("seq", pa.int64()), ("at", pa.int64()), ("n_ids", pa.int64()), ("first", pa.int64()), ("planes", pa.list_(pa.binary())), ("docs", pa.binary())]
)
CHUNKS = "part int, seq long, n_ids long, start long"
INDEX = "doc_id long, part int, first_seq long, last_seq long, begin long, start long, n_tokens long"


def write_token_files(
    docs: DataFrame,
    path: str,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = 1,
    block_ids: int = 1 << 17,
    planes: str = "byte",
) -> str:
    """Write ``path/blocks``, ``path/chunks`` and ``path/documents``; returns ``path``.

    A row of ``blocks`` is a block: its part (parts follow each other in id order), its number and place in the part,
    its ids as planes, for the documents that end in it their ids and lengths (``docs``, see ``_pack``), and where in
    the part the first of these begins, or the document that goes on, where none ends (``first``).
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    ordered = (
        docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
        .repartitionByRange(F.col("doc_id"))
        .sortWithinPartitions("doc_id", "text")
        .select(F.spark_partition_id().alias("part"), "doc_id", "text")
    )
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path).encode_batch
        held, ended, part, seq, at, first, begun = bytearray(), [], None, 0, 0, 0, 0

        def block(n: int) -> pa.RecordBatch:
            nonlocal seq, at, ended, first
            ids = np.frombuffer(bytes(held[: 4 * n]), dtype="<u4")
            del held[: 4 * n]
            row = {"part": part, "seq": seq, "at": at, "n_ids": n, "first": first, "planes": to_planes(ids, planes), "docs": _pack(ended)}
            seq, at, ended, first = seq + 1, at + n, [], begun
            return pa.RecordBatch.from_pylist([row], schema=ARROW)

        for batch in small_batches(batches, 256):
            part = batch.column("part")[0].as_py()
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encode(batch.column("text").to_pylist())):
                held += ids
                held += end
                # whole blocks go at once; the document's own entry goes with the block in which it ends
                while len(held) > 4 * block_ids:
                    yield block(block_ids)
                ended.append((doc_id, len(ids) // 4 + 1))
                begun += len(ids) // 4 + 1
        if held:
            yield block(len(held) // 4)

    ordered.mapInArrow(run, FILE_SCHEMA).write.parquet(f"{path}/blocks")
    blocks = read_blocks(spark, path)
    parts = part_starts(blocks)
    chunks = blocks.select("part", "seq", "n_ids", "at").join(parts, "part")
    chunks.select("part", "seq", "n_ids", (F.col("part_start") + F.col("at")).alias("start")).write.parquet(f"{path}/chunks")

    def entries(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 64):
            for part, first, packed in zip(*(batch.column(c).to_pylist() for c in ("part", "first", "docs"))):
                ids, lengths = _unpack(packed)
                ends = first + np.cumsum(lengths)
                begins = ends - lengths
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(np.full(len(ends), part, dtype=np.int32)), pa.array(begins // block_ids), pa.array((ends - 1) // block_ids), pa.array(begins), pa.array(lengths)],
                    names=["doc_id", "part", "first_seq", "last_seq", "begin", "n_tokens"],
                )

    index = blocks.select("part", "first", "docs").mapInArrow(
        entries, "doc_id long, part int, first_seq long, last_seq long, begin long, n_tokens long"
    )
    index.join(parts, "part").select(
        "doc_id", "part", "first_seq", "last_seq", "begin", (F.col("part_start") + F.col("begin")).alias("start"), "n_tokens"
    ).write.parquet(f"{path}/documents")
    return path


def _pack(ended: list[tuple[int | None, int]]) -> bytes:
    """Ids, null marks and lengths of the documents that end in a block, compressed."""
    table = np.array([(d or 0, d is None, n) for d, n in ended], dtype="<i8").reshape(-1, 3)
    return zstandard.ZstdCompressor(level=1).compress(table.tobytes())


def _unpack(docs: bytes) -> tuple[pa.Array, np.ndarray]:
    """Ids and lengths."""
    table = np.frombuffer(zstandard.ZstdDecompressor().decompress(docs), dtype="<i8").reshape(-1, 3)
    return pa.array(np.ascontiguousarray(table[:, 0]), pa.int64(), mask=table[:, 1] != 0), np.ascontiguousarray(table[:, 2])


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FILE_SCHEMA).parquet(f"{path}/blocks")


def chunk_index(spark: SparkSession, path: str) -> DataFrame:
    """``part, seq, n_ids, start``: of each block the number of ids in the file before it."""
    return spark.read.schema(CHUNKS).parquet(f"{path}/chunks")


def document_index(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, part, first_seq, last_seq, begin, start, n_tokens``: blocks, place in the part and in the file of each document."""
    return spark.read.schema(INDEX).parquet(f"{path}/documents")


def part_starts(blocks: DataFrame) -> DataFrame:
    """``part, part_start``: ids in the parts before each part; as many rows as the file has parts."""
    sums = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    starts = sums.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_start"))
    return F.broadcast(starts) if sums.count() <= BROADCAST_PARTS else starts


PIECES = pa.schema(
    [("part", pa.int32()), ("begin", pa.int64()), ("at", pa.int64()), ("whole", pa.bool_()), ("ids", pa.binary())]
)


def pieces(blocks: DataFrame) -> DataFrame:
    """``part, begin, at, whole, ids``: what each block holds of each document, by where in the part that begins and the piece stands."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 1):
            part, start, n, first, planes, docs = (batch.column(c)[0].as_py() for c in ("part", "at", "n_ids", "first", "planes", "docs"))
            ids, (_, lengths) = from_planes(planes, n).tobytes(), _unpack(docs)
            ends = first + np.cumsum(lengths)
            begins = np.concatenate((ends - lengths, ends[-1:] if len(ends) else [first])).astype(np.int64)
            stops = np.append(ends, start + n)
            ats = np.maximum(begins, start)
            held = ats < stops
            whole = (ats == begins) & (np.arange(len(begins)) < len(ends))
            cut = [ids[4 * a : 4 * b] for a, b in zip((ats - start)[held].tolist(), (stops - start)[held].tolist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(cut), part, dtype=np.int32)), pa.array(begins[held]), pa.array(ats[held]), pa.array(whole[held]), pa.array(cut, pa.binary())],
                schema=PIECES,
            )

    return blocks.mapInArrow(run, "part int, begin long, at long, whole boolean, ids binary")


def assembled(blocks: DataFrame) -> DataFrame:
    """``part, begin, ids`` of the documents in ``blocks``: pieces that are no whole document are put together."""
    found = pieces(blocks)
    whole = found.where("whole").select("part", "begin", "ids")
    rest = found.where("NOT whole").groupBy("part", "begin").agg(F.sort_array(F.collect_list(F.struct("at", "ids"))).alias("p"))
    joined = F.aggregate("p", F.lit(b""), lambda total, x: F.concat(total, x["ids"]))
    return whole.union(rest.select("part", "begin", joined.alias("ids")))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """``part, start, doc_id, n_tokens, ids`` (little-endian unsigned 32-bit) of each document, read from the files."""
    found = document_index(spark, path).join(assembled(read_blocks(spark, path)), ["part", "begin"])
    return found.select("part", "start", "doc_id", "n_tokens", "ids")


def fetch(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """The documents of ``read_documents`` with an id among ``wanted`` (doc_id), from the blocks that the indices name."""
    index = document_index(spark, path).join(wanted.select("doc_id").distinct(), "doc_id", "left_semi")
    seqs = index.select("part", F.explode(F.sequence("first_seq", "last_seq")).alias("seq"))
    blocks = read_blocks(spark, path).join(seqs, ["part", "seq"], "left_semi")
    return index.join(assembled(blocks), ["part", "begin"]).select("part", "start", "doc_id", "n_tokens", "ids")


def file_report(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Write ``docs`` to the shared folder, read files and indices back: ``doc_id, start, n_tokens, ids_crc32``."""
    spark = docs.sparkSession
    path = write_token_files(docs, new_path(spark, "tokens", keep=True), tokenizer_path)
    sums = assembled(read_blocks(spark, path)).select("part", "begin", F.crc32("ids").alias("ids_crc32"))
    return document_index(spark, path).join(sums, ["part", "begin"]).select("doc_id", "start", "n_tokens", "ids_crc32")
