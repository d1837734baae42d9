"""Chat formatting at the token level.

Each turn becomes reserved id TURN, its role, TEXT, its text, END. Role and text are encoded apart and the reserved
ids spliced in, so no text can yield them; as text, they stand for the control strings of TEMPLATE, and control
strings that occur in a role or text are escaped by ESCAPE behind their first character (an ESCAPE of the text's own
is doubled), which ``unescape`` takes back. The loss mask is the prefix sum of +1 where a trained text begins and -1
behind its end. A conversation is stored in rows of a bounded number of ids, so it may have any number of turns.

Cases: a null text or role is an empty one; turns come in the order of turn (null first), role, then ids; rows that
repeat are turns of their own; rows with a null conversation id form one conversation; a turn of any length is encoded
whole and stored in as many rows as it takes; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.shared import small_batches, stored

#: The template's control strings, and those of other templates that texts must not hold either.
TEMPLATE = ("<|turn|>", "<|text|>", "<|end|>")
CONTROL = (*TEMPLATE, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
ESCAPE = "␛"
CONTROL_PATTERN = re.compile("|".join(map(re.escape, CONTROL)))
#: Ids in a stored row.
ROW_IDS = 1 << 16


def escape(text: str) -> str:
    doubled = text.replace(ESCAPE, ESCAPE * 2)
    return CONTROL_PATTERN.sub(lambda m: m[0][0] + ESCAPE + m[0][1:], doubled)


def unescape(text: str) -> str:
    return re.sub(f"{ESCAPE}({ESCAPE}?)", r"\1", text)


class Codec:
    """Byte-level BPE from a rank file, with reserved ids behind its vocabulary."""

    def __init__(self, ranks_path: str, pattern: str):
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.base = tiktoken.Encoding("chat", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.first = max(ranks.values()) + 1
        self.turn, self.text, self.end = range(self.first, self.first + 3)

    def encode(self, text: str) -> list[int]:
        return self.base.encode_ordinary(escape(text))

    def decode(self, ids: list[int]) -> str:
        """As formatted, without taking escapes back."""
        return self.base.decode_bytes(ids).decode()


_CODECS: dict[str, Codec] = {}


def codec(ranks_path: str, pattern: str) -> Codec:
    if ranks_path not in _CODECS:
        _CODECS[ranks_path] = Codec(ranks_path, pattern)
    return _CODECS[ranks_path]


TURNS = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("ids", pa.binary()), ("steps", pa.binary())])
ROWS = pa.schema([("conv_id", pa.int64()), ("row", pa.int64()), ("ids", pa.list_(pa.int32())), ("loss", pa.list_(pa.int8()))])
ROWS_DDL = "conv_id long, row long, ids array<int>, loss array<tinyint>"


def format_chats(
    conversations: DataFrame, ranks_path: str, pattern: str, trained_roles: tuple[str, ...] = ("assistant",)
) -> DataFrame:
    """``conv_id, row, ids, loss``: the ids of each conversation in rows, in order, and which of them are trained on."""

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks_path, pattern)
        for batch in small_batches(batches):
            ids, steps = [], []
            for role, text in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist()):
                head, body = own.encode(role), own.encode(text)
                ids.append(np.array([own.turn, *head, own.text, *body, own.end], dtype="<i4").tobytes())
                step = np.zeros(len(head) + len(body) + 3, dtype=np.int8)
                if role in trained_roles:
                    step[len(head) + 2] += 1
                    step[-1] -= 1
                steps.append(step.tobytes())
            keep = [batch.column(c) for c in ("conv_id", "turn", "role")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(ids, pa.binary()), pa.array(steps, pa.binary())], schema=TURNS)

    def assemble(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, row, ids, steps, level = None, 0, bytearray(), bytearray(), 0

        def out(n: int) -> pa.RecordBatch:
            nonlocal row, level
            loss = np.cumsum(np.frombuffer(bytes(steps[:n]), dtype=np.int8), dtype=np.int64) + level
            level = int(loss[-1])
            done = {"conv_id": conv, "row": row, "ids": np.frombuffer(bytes(ids[: 4 * n]), dtype="<i4"), "loss": loss.astype(np.int8)}
            del ids[: 4 * n], steps[:n]
            row += 1
            return pa.RecordBatch.from_pylist([done], schema=ROWS)

        for batch in small_batches(batches):
            for own, more, change in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "ids", "steps"))):
                if own != conv:
                    if steps:
                        yield out(len(steps))
                    conv, row, level = own, 0, 0
                ids += more
                steps += change
                while len(steps) > ROW_IDS:
                    yield out(ROW_IDS)
        if steps:
            yield out(len(steps))

    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    encoded = turns.mapInArrow(encode, "conv_id long, turn long, role string, ids binary, steps binary")
    ordered = encoded.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "ids")
    return ordered.mapInArrow(assemble, ROWS_DDL)


def in_order(formatted: DataFrame) -> DataFrame:
    return formatted.repartition("conv_id").sortWithinPartitions("conv_id", "row")


def formatted_text(ids: list[int], own: Codec) -> str:
    """The ids as text, with control strings for reserved ids."""
    out, at = [], 0
    for i, x in enumerate(ids):
        if x >= own.first:
            out += [own.decode(ids[at:i]), TEMPLATE[x - own.first]]
            at = i + 1
    return "".join([*out, own.decode(ids[at:])])


def parse_chats(formatted: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """``conv_id, turn, role, text, trained, formatted_chars`` of each turn, read from stored rows.

    ``trained`` is the text under the loss mask (null where no id is).
    """
    schema = pa.schema(
        [("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("trained", pa.string()), ("formatted_chars", pa.int64())]
    )

    def parse(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks_path, pattern)
        conv, turn, ids, loss = None, 0, np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in small_batches(batches, 64):
            found = []
            for r in range(batch.num_rows):
                if batch.column("conv_id")[r].as_py() != conv:
                    conv, turn, ids, loss = batch.column("conv_id")[r].as_py(), 0, ids[:0], loss[:0]
                ids = np.concatenate([ids, batch.column("ids")[r].values.to_numpy(zero_copy_only=False)])
                loss = np.concatenate([loss, batch.column("loss")[r].values.to_numpy(zero_copy_only=False)])
                at = 0
                for end in np.flatnonzero(ids == own.end).tolist():
                    one, under = ids[at : end + 1], loss[at : end + 1]
                    middle = int(np.flatnonzero(one == own.text)[0])
                    whole, marked = one.tolist(), one[under > 0].tolist()
                    trained = unescape(own.decode(marked)) if marked else None
                    text = unescape(own.decode(whole[middle + 1 : -1]))
                    role = unescape(own.decode(whole[1:middle]))
                    found.append((conv, turn, role, text, trained, len(formatted_text(whole, own))))
                    turn, at = turn + 1, end + 1
                ids, loss = ids[at:], loss[at:]
            columns = zip(*found) if found else [[]] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    ddl = "conv_id long, turn long, role string, text string, trained string, formatted_chars long"
    return in_order(formatted).mapInArrow(parse, ddl)


def digest_chats(turns: DataFrame) -> DataFrame:
    """Digests of each conversation from the parsed turns, which stream past in order."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, conv = None, None

        def out() -> pa.RecordBatch:
            n, told, loss_chars, loss, chars = state
            row = [conv, n, told.hexdigest(), loss_chars, loss.hexdigest(), chars]
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types)], names=names)

        for batch in small_batches(batches):
            for r in batch.to_pylist():
                if state is None or r["conv_id"] != conv:
                    if state:
                        yield out()
                    conv, state = r["conv_id"], [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[0] += 1
                state[1].update(f"{r['role']}\n{r['text']}\n".encode())
                state[2] += len(r["trained"] or "")
                state[3].update((r["trained"] or "").encode())
                state[4] += r["formatted_chars"]
        if state:
            yield out()

    ddl = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return turns.mapInArrow(run, ddl)


def chat_report(conversations: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Format ``conversations`` into the shared folder, read the rows back and digest each conversation."""
    formatted = stored(format_chats(conversations, ranks_path, pattern), "chats")
    # parse_chats leaves each conversation's turns together and in order
    return digest_chats(parse_chats(formatted, ranks_path, pattern))
