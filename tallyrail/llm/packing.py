"""Vector bin packing of tokenised examples into training sequences.

An example is a document, or a prompt with its answer; it has three demands: tokens, one segment, and loss-bearing tokens (all of a
document, the answer of an instruction). Sequences have a limit on each. Inside a task, a window of waiting examples is packed one open
sequence at a time: the example with the largest dot product of its demands and what the sequence has left, both in units of the
limits, is placed next. When no waiting example fits, the longest is cut to fill the gap. What an example has beyond a whole
sequence is cut off first and needs no packing. A sequence that closes early, for a limit or at the end of a task, is split at
powers of two, which need no padding.

Every task packs its own rows, in a buffer of bounded size, and nothing is shuffled; sequence ids are made of the task's partition and
a counter. A word's ids are looked up in a bounded cache, which is exact as the tokenizer never joins what white space parts.

Defined results: a null text is empty and is the end id alone; repeated rows are packed each on its own; a null doc_id stays null; an
empty table gives an empty table. Long texts are packed whole. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyrail.llm.common import small_batches

END_ID = 1
#: Waiting examples of a task; cached words of a worker; longest cached word; shortest piece that is cut only to fill a gap.
WAITING, CACHED, CACHED_CHARS, LEAST_CUT = 1024, 1_200_000, 48, 8
#: New words that are encoded at once, and texts that are looked through for new words at once.
BATCH, TEXTS = 1000, 64
PUNCTUATION = ".,!?;:"
OUT_ROWS = 4096


@dataclass(frozen=True)
class Limits:
    tokens: int = 2048
    segments: int = 128
    loss: int = 2048


class WordIds(dict):
    """Little-endian 32-bit ids by word; a word is what stands between blanks or line feeds.

    Case and closing punctuation of simple words are undone first, since the tokenizer lowers case and parts both anyway. New words
    of letters only are encoded many at a time: each is one unit of the tokenizer, whose last id carries the end-of-word mark.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        names = self.tokenizer.get_vocab(with_added_tokens=True)
        self.last = np.zeros(max(names.values()) + 1, bool)
        self.last[[i for name, i in names.items() if name.endswith("</w>")]] = True

    @staticmethod
    def _simple(word: str) -> str:
        """The letters of a word without closing punctuation, in lower case; else the word itself.

        Only for alphabets in which neither lower-casing nor composition turns a letter into more than a letter.
        """
        core = word.rstrip(PUNCTUATION)
        if core.isalpha() and max(core) < "\u0590" and "\u0130" not in core and "\u03a3" not in core:
            return core.lower()
        return word

    def __missing__(self, word: str) -> bytes:
        core = self._simple(word)
        if core != word:
            ids = self[core] + (self[word[len(core):]] if len(core) < len(word) else b"")
        else:
            ids = np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, dtype="<u4").tobytes()
        if len(word) <= CACHED_CHARS:
            self[word] = ids
        return ids

    def _learn(self, words: list[str]) -> None:
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, dtype="<u4")
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) == len(words):  # else a letter is no letter to the tokenizer: such words are encoded one by one
            raw, places = ids.tobytes(), (4 * ends).tolist()
            self.update(zip(words, map(raw.__getitem__, map(slice, [0, *places], places))))

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self) > CACHED:
            self.clear()
        lists = [t.replace("\n", " ").split(" ") for t in texts]
        found = [list(map(self.get, words)) for words in lists]
        missed = [None in ids for ids in found]
        new = {w for words, ids, miss in zip(lists, found, missed) if miss for w, i in zip(words, ids) if i is None}
        if new:
            cores = {w: self._simple(w) for w in new if len(w) <= CACHED_CHARS}
            unknown = {c for c in cores.values() if c not in self}
            plain = [c for c in unknown if c.isalpha()]
            for at in range(0, len(plain), BATCH):
                self._learn(plain[at:at + BATCH])
            rest = [c for c in unknown if c not in self]
            for core, found_ids in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False) if rest else ()):
                self[core] = np.array(found_ids.ids, dtype="<u4").tobytes()
            for word, core in cores.items():
                if core is not word:
                    self[word] = self[core] + (self[word[len(core):]] if len(core) < len(word) else b"")
            found = [[self[w] if i is None else i for w, i in zip(words, ids)] if miss else ids
                     for words, ids, miss in zip(lists, found, missed)]
        return list(map(b"".join, found))


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    """One cache per Python worker; it outlives a task."""
    return WordIds(path)


class Example:
    """What is left of an example: ids [start, end) of all its ids, of which the first `prompt` bear no loss."""

    __slots__ = ("doc_id", "ids", "prompt", "start", "end")

    def __init__(self, doc_id, ids: bytes, prompt: int, start: int, end: int):
        self.doc_id, self.ids, self.prompt, self.start, self.end = doc_id, ids, prompt, start, end

    def __len__(self) -> int:
        return self.end - self.start

    @property
    def loss(self) -> int:
        return max(0, self.end - max(self.start, self.prompt))

    def within(self, tokens: int, loss: int) -> int:
        """How many of the first ids stay inside both limits."""
        return min(len(self), tokens, max(0, self.prompt - self.start) + loss)

    def cut(self, n: int) -> Example:
        """Take the first `n` ids off."""
        piece = Example(self.doc_id, self.ids, self.prompt, self.start, self.start + n)
        self.start += n
        return piece


class Packer:
    def __init__(self, limits: Limits, base: int = 0):
        self.limits, self.next_id = limits, base
        self.waiting: list[Example] = []
        self.sequences: list[tuple[int, list[Example]]] = []

    def add(self, example: Example) -> None:
        lim = self.limits
        while len(example) > (n := example.within(lim.tokens, lim.loss)) or n == lim.tokens:
            piece = example.cut(n)
            if n == lim.tokens:
                self._close([piece])
            else:
                self.waiting.append(piece)
            if not len(example):
                return
        self.waiting.append(example)
        if len(self.waiting) >= WAITING:
            self._pack(WAITING // 2)

    def finish(self) -> None:
        self._pack(0)

    def _pack(self, leave: int) -> None:
        lim = self.limits
        items = self.waiting
        alive = np.ones(len(items), bool)
        demand = np.array([(len(x), 1, x.loss) for x in items], np.int64).reshape(-1, 3)
        most = np.array([lim.tokens, lim.segments, lim.loss], np.float64)
        unit = demand / most
        while alive.sum() > leave:
            left, placed = np.array([lim.tokens, lim.segments, lim.loss], np.int64), []
            while True:
                fits = alive & (demand <= left).all(axis=1)
                if not fits.any():
                    break
                best = int(np.where(fits, unit @ (left / most), -1.0).argmax())
                alive[best] = False
                left -= demand[best]
                placed.append(items[best])
            if left[0] >= LEAST_CUT and left[1] > 0 and alive.any():
                longest = int(np.where(alive, demand[:, 0], -1).argmax())
                n = items[longest].within(int(left[0]), int(left[2]))
                if LEAST_CUT <= n < len(items[longest]):
                    placed.append(items[longest].cut(n))
                    demand[longest] = len(items[longest]), 1, items[longest].loss
                    unit[longest] = demand[longest] / most
            self._close(placed)
        self.waiting = [x for x, ok in zip(items, alive) if ok]

    def _close(self, pieces: list[Example]) -> None:
        total = sum(map(len, pieces))
        while total:
            size = total if 0 <= self.limits.tokens - total < LEAST_CUT else 1 << (total.bit_length() - 1)
            taken, room = [], size
            while room:
                if len(pieces[0]) <= room:
                    taken.append(pieces.pop(0))
                else:
                    taken.append(pieces[0].cut(room))
                room -= len(taken[-1])
            self.sequences.append((self.next_id, taken))
            self.next_id += 1
            total -= size

    def rows(self) -> Iterator[tuple]:
        """Pieces of the sequences closed since the last call."""
        done, self.sequences = self.sequences, []
        for sequence, pieces in done:
            offset = 0
            for p in pieces:
                ids = p.ids[4 * p.start:4 * p.end]
                yield p.doc_id, p.start, len(p), zlib.crc32(ids), len(p.ids) // 4, sequence, offset, p.loss, ids
                offset += len(p)


def pack(docs: DataFrame, tokenizer: str, limits: Limits = Limits(), end_id: int = END_ID, doc_id: str = "doc_id",
         text: str = "text", prompt: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, n_loss, and `ids` if wanted.

    `prompt` names a column whose text comes first and bears no loss.
    """
    small_batches(docs.sparkSession)
    empty = F.lit(None).cast("string")
    columns = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"),
                          (F.col(f"`{prompt}`") if prompt else empty).alias("prompt"))
    longs = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "n_loss"]
    schema = T.StructType([columns.schema["doc_id"], *(T.StructField(n, T.LongType()) for n in longs),
                           *([T.StructField("ids", T.BinaryType())] if with_ids else [])])
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(tokenizer)
        packer = Packer(limits, TaskContext.get().partitionId() << 32)
        kind, held = None, []

        def out() -> pa.RecordBatch:
            columns = list(zip(*held))[:len(schema)]
            held.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(columns[0], kind), *(pa.array(c, pa.int64()) for c in columns[1:8]),
                 *(pa.array(c, pa.binary()) for c in columns[8:])], names=schema.names)

        for batch in batches:
            kind = batch.schema.field(0).type
            for at in range(0, batch.num_rows, TEXTS):
                keys, bodies, leads = (c.to_pylist() for c in batch.slice(at, TEXTS).columns)
                firsts = words.encode([x or "" for x in leads]) if any(leads) else [b""] * len(keys)
                for key, first, body in zip(keys, firsts, words.encode([x or "" for x in bodies])):
                    ids = first + body + end
                    packer.add(Example(key, ids, len(first) // 4, 0, len(ids) // 4))
                held.extend(packer.rows())
                if len(held) >= OUT_ROWS:
                    yield out()
        packer.finish()
        held.extend(packer.rows())
        if held:
            yield out()

    return columns.mapInArrow(run, schema)
