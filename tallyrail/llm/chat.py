"""Chat formatting at token level.

A turn becomes: begin, role, the ids of its text, end. Texts are encoded on their own with a lossless byte-level vocabulary; begin, role
and end are reserved ids beyond it, spliced in, so no text can produce one. Strings that look like a control are escaped inside texts
all the same (a backslash after the first character, one more where there are some), which keeps the decoded form readable back as well.
Offsets are prefix sums of the segments' lengths within a conversation, and so are the loss masks: the ids of assistant texts.

Turns are encoded where they are read; only turns are shuffled by conversation. Offsets are running sums and reading back goes through a
conversation's turns in order with constant memory, so a conversation of any length needs no more than one turn at a time.

Defined results: a null text is empty, a null role the empty name; a null conv_id is one conversation; turns with equal numbers follow each
other by role and then text; a repeated row is one more turn; a null turn number comes first. An empty table gives an empty table. Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyrail.llm.common import small_batches

# Fixed values of the template: control strings, in the order of their ids beyond the vocabulary.
BEGIN, END, ROLE, ROLE_END = "<s>", "</s>", "[ROLE]", "[/ROLE]"
ROLES = {"system": "[SYS]", "user": "[INST]", "assistant": "[/INST]"}
CONTROLS = (BEGIN, END, *ROLES.values(), ROLE, ROLE_END)
LEARNED = "assistant"

_CONTROL_LIKE = re.compile(r"(<|\[)(\\*)(/?s>|SYS\]|/?INST\]|/?ROLE\])")
#: Characters after which a text is cut, at the next blank between a word's end and a letter: the pattern parts words there in any case.
STRETCH = 1 << 16
_CUT = re.compile(r"(?<=[A-Za-z]) (?=[A-Za-z])")


def escape(text: str) -> str:
    return _CONTROL_LIKE.sub(r"\1\2\\\3", text)


def unescape(text: str) -> str:
    return _CONTROL_LIKE.sub(lambda m: m[1] + m[2][:-1] + m[3], text)


class Codec:
    """Texts to ids and back; reserved ids follow the vocabulary's."""

    def __init__(self, ranks: str):
        import base64

        import public_tokenizers
        import tiktoken

        with open(ranks, "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.first = max(table.values()) + 1
        self.encoding = tiktoken.Encoding("chat", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def control(self, name: str) -> int:
        return self.first + CONTROLS.index(name)

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        at = 0
        while at < len(text):
            cut = _CUT.search(text, at + STRETCH) if len(text) - at > STRETCH else None
            to = cut.start() if cut else len(text)
            out += self.encoding.encode_ordinary(text[at:to])
            at = to
        return out

    def turn(self, role: str, text: str) -> tuple[list[int], int, int]:
        """(ids, where the text begins, how many ids it has)."""
        if role in ROLES:
            lead = [self.control(BEGIN), self.control(ROLES[role])]
        else:
            lead = [self.control(BEGIN), self.control(ROLE), *self.encode(escape(role)), self.control(ROLE_END)]
        body = self.encode(escape(text))
        return [*lead, *body, self.control(END)], len(lead), len(body)

    def decode(self, ids: list[int]) -> str:
        return self.encoding.decode_bytes(ids).decode("utf-8")

    def read(self, ids: list[int]) -> tuple[str, str, str]:
        """(role, text, formatted string) of a turn's ids."""
        if not ids or ids[0] != self.control(BEGIN) or ids[-1] != self.control(END):
            raise ValueError("a turn must begin and end with its reserved ids")
        role, at = {self.control(c): r for r, c in ROLES.items()}.get(ids[1]), 2
        named = ""
        if role is None:
            at = ids.index(self.control(ROLE_END))
            named = self.decode(ids[2:at])
            role, at = unescape(named), at + 1
            head = BEGIN + ROLE + named + ROLE_END
        else:
            head = BEGIN + ROLES[role]
        body = self.decode(ids[at:-1])
        return role, unescape(body), head + body + END


def _order(*columns: str) -> list[Column]:
    return [F.col(c).asc_nulls_first() for c in columns]


def format_turns(conversations: DataFrame, ranks: str, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
                 text: str = "text") -> DataFrame:
    """One row per turn: conv_id, turn, ids (little-endian 32-bit), its offset in the conversation, and its loss mask as the ids
    [loss_from, loss_to) of the conversation (empty for all but the assistant)."""
    small_batches(conversations.sparkSession)
    rows = conversations.select(F.col(f"`{conv_id}`").alias("conv_id"), F.col(f"`{turn}`").alias("turn"),
                                F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("role"),
                                F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    made = [T.StructField("ids", T.BinaryType()), *(T.StructField(n, T.LongType()) for n in ("n_ids", "lead", "n_loss"))]
    schema = T.StructType([*rows.schema.fields, *made])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(ranks)
        for batch in batches:
            turns = [codec.turn(r, t) for r, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            learned = [r == LEARNED for r in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([np.array(ids, "<u4").tobytes() for ids, _, _ in turns], pa.binary()),
                 pa.array([len(ids) for ids, _, _ in turns], pa.int64()), pa.array([lead for _, lead, _ in turns], pa.int64()),
                 pa.array([n if ok else 0 for (_, _, n), ok in zip(turns, learned)], pa.int64())], names=schema.names)

    before = W.partitionBy("conv_id").orderBy(*_order("turn", "role", "text")).rowsBetween(W.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("n_ids").over(before), F.lit(0))
    start = F.col("offset") + F.col("lead")
    return rows.mapInArrow(run, schema).withColumn("offset", offset).select(
        "conv_id", "turn", "ids", "offset", start.alias("loss_from"), (start + F.col("n_loss")).alias("loss_to"))


class _Digest:
    def __init__(self):
        self.turns, self.loss, self.n_turns, self.loss_chars, self.chars = hashlib.sha256(), hashlib.sha256(), 0, 0, 0

    def add(self, role: str, text: str, formatted: str, learned: str) -> None:
        self.turns.update(f"{role}\n{text}\n".encode())
        self.loss.update(learned.encode())
        self.n_turns, self.chars, self.loss_chars = self.n_turns + 1, self.chars + len(formatted), self.loss_chars + len(learned)

    def row(self) -> tuple:
        return self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def read_back(formatted: DataFrame, ranks: str) -> DataFrame:
    """One row per conversation, from ids and masks alone: n_turns, digests of turns and of the text under the mask, and sizes."""
    small_batches(formatted.sparkSession)
    longs = ("n_turns", "loss_chars", "formatted_chars")
    names = ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
    schema = T.StructType([formatted.schema["conv_id"], *(T.StructField(n, T.LongType() if n in longs else T.StringType()) for n in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, digest, key, done, kind = Codec(ranks), None, None, [], None

        def out() -> pa.RecordBatch:
            columns = list(zip(*done))
            done.clear()
            types = [kind, *(pa.int64() if n in longs else pa.string() for n in names)]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=schema.names)

        for batch in batches:
            kind = batch.schema.field(0).type
            for conv, raw, offset, start, stop in zip(*(batch.column(c).to_pylist() for c in
                                                        ("conv_id", "ids", "offset", "loss_from", "loss_to"))):
                if digest is None or conv != key:
                    if digest is not None:
                        done.append((key, *digest.row()))
                    digest, key = _Digest(), conv
                ids = np.frombuffer(raw, "<u4").tolist()
                digest.add(*codec.read(ids), unescape(codec.decode(ids[start - offset:stop - offset])))
            if done:
                yield out()
        if digest is not None:
            done.append((key, *digest.row()))
            yield out()

    # Where the offsets' window has already brought a conversation's turns together, Spark leaves this exchange out.
    ordered = formatted.select("conv_id", "ids", "offset", "loss_from", "loss_to").repartition("conv_id").sortWithinPartitions(
        *_order("conv_id", "offset"))
    return ordered.mapInArrow(run, schema)
