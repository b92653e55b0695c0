"""LM scoring by subword lattice likelihood.

A word is `▁` and its characters. Its lattice has an arc for every entry of an existing subword vocabulary that spells a stretch of it; a
character without an entry is spelled by the vocabulary's byte entries. Arcs have unigram log probabilities; the log-space forward recursion adds
up all segmentations, so a word's score is its marginal probability. Words are parted by white space, so a text's probability is the
product over its words and one end, which is an entry of its own.

The vocabulary file gives the entries; it holds merge ranks and not probabilities, so those are estimated from the corpus by expectation and
maximisation (`ROUNDS`, from even weights): forward and backward sums over the lattice of every distinct training word, times the word's count, give the
expected count of every entry, and those, with `SMOOTHING` added, the next weights. All counts are over all training documents. Rounds and scoring work on the lattices of many
distinct words at a time, as arrays, and read no text again.

Texts are cut into words once: a task gathers documents into blocks of at most `BLOCK_WORDS` words (more only for one longer text), and
writes each text as compressed numbers into its block's word list. Only word lists are shuffled, a word at most once per block, so a word
that makes up a third of the corpus is no heavier than others. They are shuffled once by word, where counts are added up over sorted rows
that may spill, and once back to their blocks, one bounded block per group.

Defined results: a null or empty text is the end alone; repeated rows give repeated rows, and each counts in training. A null doc_id is
neither held out nor trained on. Without any training token all entries and the end have even weights. An empty table gives an empty table. Equal
words have equal scores, however often they occur. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from math import log, log10

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyrail.llm.common import fold, small_batches, stored

FOLDS = 10
BLOCK_WORDS = 2_000_000
ROUNDS, SMOOTHING = 3, 0.1
MARK = "▁"
OUT_ROWS = 1 << 16
#: Words whose lattices are worked on at once, and their characters (more only for one longer word).
TOGETHER, LETTERS = 1 << 15, 1 << 19
#: From here on an arc's entry is a character that is spelled by bytes.
SPELLED = 1 << 31

BLOCKS = T.StructType([T.StructField("block", T.LongType()), T.StructField("word", T.BinaryType()),
                       T.StructField("place", T.IntegerType()), T.StructField("n_train", T.LongType()),
                       T.StructField("text_words", T.BinaryType()), T.StructField("held_out", T.BooleanType()),
                       T.StructField("trained", T.BooleanType())])


class _Block:
    """Documents as numbers into the block's own word list."""

    def __init__(self, number: int):
        self.number, self.words, self.docs, self.size = number, {}, [], 0
        self.trained: list[np.ndarray] = []

    def add(self, doc_id, text: str | None, held_out: bool, trained: bool) -> None:
        words, known = (text or "").encode("utf-8", "replace").lower().split(), self.words
        ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.uint32, len(words))
        self.docs.append((doc_id, zstandard.compress(ids.tobytes(), 1), held_out, trained))
        self.size += len(words)
        if trained:
            self.trained.append(ids)

    def batches(self, id_type: pa.DataType, names: list[str]) -> Iterator[pa.RecordBatch]:
        def batch(n: int, **columns) -> pa.RecordBatch:
            types = {"doc_id": id_type, "word": pa.binary(), "place": pa.int32(), "text_words": pa.binary(), "held_out": pa.bool_(), "trained": pa.bool_()}
            columns["block"] = [self.number] * n
            return pa.RecordBatch.from_arrays(
                [pa.array(columns[c], types.get(c, pa.int64())) if c in columns else pa.nulls(n, types.get(c, pa.int64()))
                 for c in names], names=names)
        if self.docs:
            keys, ids, held, trained = zip(*self.docs)
            yield batch(len(keys), doc_id=keys, text_words=ids, held_out=held, trained=trained)
        counts = np.bincount(np.concatenate(self.trained), minlength=len(self.words)) if self.trained else np.zeros(len(self.words), int)
        words = list(self.words)
        for at in range(0, len(words), OUT_ROWS):
            part = words[at:at + OUT_ROWS]
            yield batch(len(part), word=part, place=range(at, at + len(part)), n_train=counts[at:at + len(part)])


def blocks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", folds: int = FOLDS) -> DataFrame:
    """Rows of two kinds: documents (`text_words`) and their blocks' words (`word`, `place`, `n_train`)."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    rest = fold("doc_id", folds)
    rows = rows.select("doc_id", "text", F.coalesce(rest == 0, F.lit(False)).alias("held_out"),
                       F.coalesce(rest != 0, F.lit(False)).alias("trained"))
    schema = T.StructType([rows.schema["doc_id"], *BLOCKS.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, kind = _Block(TaskContext.get().partitionId() << 32), None
        for batch in batches:
            kind = batch.schema.field(0).type
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                block.add(*row)
                if block.size >= BLOCK_WORDS or len(block.docs) >= BLOCK_WORDS:
                    yield from block.batches(kind, schema.names)
                    block = _Block(block.number + 1)
        if block.docs:
            yield from block.batches(kind, schema.names)

    return rows.mapInArrow(run, schema)


def _subwords(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def counted_words(words: DataFrame) -> DataFrame:
    """(block, place, word, n, first): every block's words with the word's count in all training documents.

    Rows are sorted by word, which `scored_words` makes use of; `first` marks one row per word.
    """
    by_word = W.partitionBy("word").orderBy("block")
    total = F.sum("n_train").over(by_word.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return words.select("block", "place", "word", total.alias("n"), (F.row_number().over(by_word) == 1).alias("first"))


class Entries:
    """The vocabulary: its entries that can be arcs as a character trie in arrays, and the entries of bytes.

    The trie's edges are the sorted numbers node << 32 | character; node 0 is the root.
    """

    def __init__(self, path: str):
        model = _subwords(path)
        usable = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.names = {i: model.id_to_piece(i) for i in usable}
        self.end = model.get_piece_size()  # a number of its own
        self.bytes = np.full(256, -1)
        edges: dict[int, int] = {}
        of_node = [-1]
        for i, name in self.names.items():
            if re.fullmatch("<0x[0-9A-F]{2}>", name):
                self.bytes[int(name[3:5], 16)] = i
                continue
            node = 0
            for ch in name:
                key = node << 32 | ord(ch)
                node = edges.setdefault(key, len(of_node))
                if node == len(of_node):
                    of_node.append(-1)
            of_node[node] = i
        self.of_node = np.array(of_node)
        self.edges = np.array(sorted(edges), np.int64)
        self.children = np.array([edges[k] for k in self.edges.tolist()], np.int64)

    def even(self) -> np.ndarray:
        """Even log weights of all entries and the end; -inf for numbers that are neither."""
        out = np.full(self.end + 1, -np.inf)
        out[[*self.names, self.end]] = -log(len(self.names) + 1)
        return out

    def weights_of(self, entries: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Log weights of arcs' entries; a spelled character has those of its bytes. A vocabulary without byte entries has the lowest weight for them."""
        spelled = entries >= SPELLED
        out = weights[np.where(spelled, 0, entries)]
        if spelled.any():
            chars, where = np.unique(entries[spelled], return_inverse=True)
            out[spelled] = np.array([sum(self._byte(b, weights) for b in _utf8(c)) for c in chars.tolist()])[where]
        return out

    def _byte(self, b: int, weights: np.ndarray) -> float:
        return float(weights[self.bytes[b]]) if self.bytes[b] >= 0 else float(weights[np.isfinite(weights)].min())


def _utf8(entry: int) -> bytes:
    return chr(entry - SPELLED).encode("utf-8", "replace")


class Lattices:
    """The lattices of many words as arrays of arcs (`of` which word, `source`, `target`, `entry`), sorted by start and length.

    Places are numbered word by word, one more than a word has characters with its mark. Arcs of one start and length never share a place.
    """

    def __init__(self, words: Sequence[str], entries: Entries):
        codes = np.frombuffer("".join([MARK + w for w in words]).encode("utf-32-le", "replace"), "<u4").astype(np.int64)
        size = np.fromiter(map(len, words), np.int64, len(words)) + 1
        begin = np.cumsum(size) - size
        word = np.repeat(np.arange(len(words)), size)
        self.base = begin + np.arange(len(words))
        self.last, self.cells = self.base + size, len(codes) + len(words)
        at, node = np.arange(len(codes)), np.zeros(len(codes), np.int64)  # characters where an arc may begin, and how far its name was followed
        room = (begin + size)[word] - at
        arcs, single, length = [], np.zeros(len(codes), bool), 0
        while len(at):
            key = node << 32 | codes[at + length]
            place = np.minimum(np.searchsorted(entries.edges, key), len(entries.edges) - 1)
            known = entries.edges[place] == key
            length += 1
            at, node = at[known], entries.children[place[known]]
            entry = entries.of_node[node]
            ends = entry >= 0
            arcs.append((at[ends], np.full(int(ends.sum()), length), entry[ends]))
            if length == 1:
                single[at[ends]] = True
            on = room[at] > length
            at, node = at[on], node[on]
        alone = np.flatnonzero(~single)
        arcs.append((alone, np.ones(len(alone), np.int64), SPELLED + codes[alone]))
        at, length, entry = (np.concatenate(x) for x in zip(*arcs))
        start = at - begin[word[at]]
        key = start << 8 | np.minimum(length, 255)
        order = np.argsort(key.astype(np.uint16) if key.max(initial=0) < 1 << 16 else key, kind="stable")
        self.of, self.entry = word[at][order], entry[order]
        self.source = (at + word[at])[order]
        self.target = self.source + length[order]
        cuts = np.flatnonzero(np.diff(key[order])) + 1
        self.steps = [slice(a, b) for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(order)])] if len(order) else []

    def forward(self, weight: np.ndarray) -> np.ndarray:
        """Natural log of the summed probability of all ways to every place; a word's last place has all its segmentations."""
        sums = np.full(self.cells, -np.inf)
        sums[self.base] = 0.0
        for step in self.steps:
            target = self.target[step]
            sums[target] = np.logaddexp(sums[target], sums[self.source[step]] + weight[step])
        return sums

    def backward(self, weight: np.ndarray) -> np.ndarray:
        """The same from every place to the word's end."""
        sums = np.full(self.cells, -np.inf)
        sums[self.last] = 0.0
        for step in reversed(self.steps):
            source = self.source[step]
            sums[source] = np.logaddexp(sums[source], sums[self.target[step]] + weight[step])
        return sums

    def expected(self, weight: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, float]:
        """(how often each arc is passed, the log likelihood) for words that occur `n` times."""
        ahead, back = self.forward(weight), self.backward(weight)
        total = ahead[self.last]
        return np.exp(ahead[self.source] + weight + back[self.target] - total[self.of]) * n[self.of], float((n * total).sum())


def _decoded(words: pa.ChunkedArray) -> list[str]:
    return [w.decode("utf-8", "replace") for w in words.to_pylist()]


def _parts(words: list[str]) -> Iterator[slice]:
    """Stretches of words with bounded lattices."""
    at, letters = 0, 0
    for i, word in enumerate(words):
        letters += len(word) + 1
        if letters >= LETTERS:
            yield slice(at, i + 1)
            at, letters = i + 1, 0
    if at < len(words):
        yield slice(at, len(words))


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= TOGETHER:
            yield pa.Table.from_batches(held)
            held, rows = [], 0
    if held:
        yield pa.Table.from_batches(held)


def expected_counts(counted: DataFrame, path: str, weights: np.ndarray) -> tuple[np.ndarray, float]:
    """(expected count of each entry, log likelihood of all training words); at most one row per entry and task is shuffled."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries, likelihood = Entries(path), 0.0
        out = np.zeros(entries.end + 1)
        for table in _gathered(batches):
            words, n = _decoded(table["word"]), table["n"].to_numpy().astype(float)
            for part in _parts(words):
                tool = Lattices(words[part], entries)
                passed, value = tool.expected(entries.weights_of(tool.entry, weights), n[part])
                likelihood += value
                spelled = tool.entry >= SPELLED
                out += np.bincount(tool.entry[~spelled], passed[~spelled], len(out))
                chars, where = np.unique(tool.entry[spelled], return_inverse=True)
                for c, amount in zip(chars.tolist(), np.bincount(where, passed[spelled], len(chars)).tolist()):
                    for b in _utf8(c):
                        if entries.bytes[b] >= 0:
                            out[entries.bytes[b]] += amount
        some = np.flatnonzero(out)
        yield pa.RecordBatch.from_pydict({"entry": [-1, *some.tolist()], "amount": [likelihood, *out[some].tolist()]})

    rows = counted.filter("first AND n > 0").select("word", "n").mapInArrow(run, "entry long, amount double")
    found = {r.entry: r.amount for r in rows.groupBy("entry").agg(F.sum("amount").alias("amount")).collect()}  # bounded by the vocabulary file
    out = np.zeros(len(weights))
    for entry, amount in found.items():
        if entry >= 0:
            out[entry] = amount
    return out, found.get(-1, 0.0)


def learned_weights(counted: DataFrame, path: str, ends: int, rounds: int = ROUNDS, smoothing: float = SMOOTHING) -> tuple[np.ndarray, list[float]]:
    """(natural log probability of every entry and of the end, log likelihood of the training texts before each round)."""
    entries, likelihoods = Entries(path), []
    weights = entries.even()
    usable = np.isfinite(weights)
    for _ in range(rounds):
        counts, likelihood = expected_counts(counted, path, weights)
        likelihoods.append(likelihood + ends * float(weights[entries.end]))
        counts[entries.end] = ends
        counts = np.where(usable, counts + smoothing, 0.0)
        with np.errstate(divide="ignore"):
            weights = np.log(counts / counts.sum())
    return weights, likelihoods


def scored_words(counted: DataFrame, path: str, weights: np.ndarray) -> DataFrame:
    """(in_block, place, n, model): log10 probability of every word of every block, worked out once per run of equal words.

    A task may begin inside a run, whose first row another task has; it then works that word out itself.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries, last, value = Entries(path), None, 0.0

        def scores(words: list[str]) -> np.ndarray:
            out = np.empty(len(words))
            for part in _parts(words):
                tool = Lattices(words[part], entries)
                out[part] = tool.forward(entries.weights_of(tool.entry, weights))[tool.last] / log(10)
            return out
        for table in _gathered(batches):
            words, first = table["word"], table["first"].to_numpy()
            firsts = np.flatnonzero(first)
            head = int(firsts[0]) if len(firsts) else len(first)
            if head and (word := words[0].as_py()) != last:
                last, value = word, float(scores([word.decode("utf-8", "replace")])[0])
            model = np.full(len(first), value)
            if len(firsts):
                found = scores(_decoded(words.filter(table["first"])))
                model[head:] = np.repeat(found, np.diff(np.append(firsts, len(first))))
                last, value = words[int(firsts[-1])].as_py(), float(found[-1])
            yield pa.RecordBatch.from_arrays([*(table[c].combine_chunks() for c in ("block", "place", "n")), pa.array(model)],
                                             names=["in_block", "place", "n", "model"])
    return counted.select("block", "place", "word", "n", "first").mapInArrow(run, "in_block long, place int, n long, model double")


def score(docs: DataFrame, subwords: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) per row."""
    both = stored(blocks(docs, doc_id, text), "blocks")
    words, texts = both.filter("word IS NOT NULL"), both.filter("text_words IS NOT NULL")
    counted = stored(counted_words(words), "counted-words")
    in_words, distinct = counted.filter("first").agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.when(F.col("n") > 0, 1))).first()
    ends = texts.filter("trained").count()
    total, distinct = in_words + ends, distinct + (ends > 0)
    weights, _ = learned_weights(counted, subwords, ends)
    listed = scored_words(counted, subwords, weights)
    floor, divisor = 0.1, total + 0.1 * (distinct + 1)
    end_base = log10((ends + floor) / divisor)
    end_model = float(weights[-1]) / log(10)
    schema = T.StructType([texts.schema["doc_id"], texts.schema["held_out"],
                           *(T.StructField(n, T.LongType()) for n in ("n_tokens", "n_known", "train_tokens")),
                           *(T.StructField(n, T.DoubleType()) for n in ("base_score", "score"))])

    def add_up(left: pa.Table, right: pa.Table) -> pa.Table:
        size = right.num_rows
        n, model = np.zeros(size), np.zeros(size)
        place = right["place"].to_numpy()
        n[place] = right["n"].to_numpy()
        model[place] = right["model"].to_numpy()
        base = np.log10((n + floor) / divisor)
        found = [np.frombuffer(zstandard.decompress(x), np.uint32) for x in left["text_words"].to_pylist()]
        return pa.table([left["doc_id"], left["held_out"],
                         pa.array([len(x) + 1 for x in found], pa.int64()),
                         pa.array([int((n[x] > 0).sum()) + (ends > 0) for x in found], pa.int64()),
                         pa.array([total] * len(found), pa.int64()),
                         pa.array([float(base[x].sum()) + end_base for x in found], pa.float64()),
                         pa.array([float(model[x].sum()) + end_model for x in found], pa.float64())], names=schema.names)

    pieces = texts.select("block", "doc_id", "held_out", "text_words")
    return pieces.groupBy("block").cogroup(listed.groupBy("in_block")).applyInArrow(add_up, schema)
