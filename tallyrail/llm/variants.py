"""Spelling variant grouping by k-d trees over letter-count vectors.

A word's vector counts its letters. An edit of one code point changes it little: a replaced letter raises one count and lowers another (an L1
distance of two), an inserted one raises one, a deleted one lowers one. So all words near a given one lie in a small ball round its
vector, and a k-d tree finds them: the search goes down a branch only if the branch's box can be reached with the edits that are left.
There is a search per pair of lengths, with its own edits: one up and one down for equal lengths, one up or one down for the neighbours.
What is found is verified letter by letter.

The work is dealt in two levels of trees. A bounded, hash-chosen sample of the words (`SAMPLE`) shapes one tree per length on the driver, which
cuts the space into boxes of about `LEAF` words; it decides only how the work is dealt, never a result. Every word is sent to the box
it lies in, and as a question to the boxes it can reach. A box's words are one group of bounded size (a box that holds more than `LIMIT` is cut by a hash,
and questions go to all its parts), in which a second tree over the distinct vectors answers the questions as they stream by. A question brings back one row per box:
how many near words there are and the best of them; links are never written out one by one. All distinct words are data and questions.

Words are counted per task in a table of bounded size before anything is shuffled, so the most frequent word costs a few rows. Roots are found by
doubling: each round replaces a word's form by its form's form; since a form is at least twice as frequent, rounds are few.

Defined results: a null text has no words. A null doc_id's runs are never cut. Repeated rows count each. Equal counts are told apart by the
smallest word in code-point order. An empty table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyrail.llm.common import discard, small_batches, stored

LEAST_LENGTH, LEAST_COUNT, RATIO, CUT = 5, 3, 2, 97
#: Words that shape the trees, words a box is meant to hold, and the most that are held at once.
SAMPLE, LEAF, LIMIT = 60_000, 6_000, 24_000
#: Distinct vectors in a leaf of a box's own tree; questions answered at once; letters of pairs compared at once.
SMALL, QUESTIONS, LETTERS = 24, 8_192, 4 << 20
#: A task hands its counts on when it holds so many distinct words, or has met so many bytes of them.
COUNTED, COUNTED_BYTES = 500_000, 256 << 20
ALPHABET = 26 + 64  # a-z and U+00C0 to U+00FF

#: In UTF-8 with A-Z in lower case; U+00C0 to U+00FF are the byte C3 and another.
_RUN = re.compile(rb"(?:[a-z]|\xC3[\x80-\xBF])+")


def cut_word(run: bytes, h: int) -> bytes:
    """The run without its code point number h % length."""
    word = run.decode()
    at = h % len(word)
    return (word[:at] + word[at + 1:]).encode()


def words_of(doc_id, text: bytes | None, cut: int = CUT) -> Counter:
    """Every run of letters of a text with its count, in UTF-8; where `cut` divides the run's hash, a letter is missing."""
    found = Counter(_RUN.findall((text or b"").lower()))
    if doc_id is not None:
        start = zlib.crc32(f"{doc_id}:".encode())
        cuts = [(run, h) for run in found if not (h := zlib.crc32(run, start)) % cut]
        # All are taken out first: what one leaves may equal another that is cut.
        for word, n in [(cut_word(run, h), found.pop(run)) for run, h in cuts]:
            found[word] += n
    return found


def counted(docs: DataFrame, cut: int = CUT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n) of all words in UTF-8, of any length and count."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            words = list(held)
            for at in range(0, len(words), 1 << 16):
                part = words[at:at + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary()), pa.array([held[w] for w in part], pa.int64())], names=["word", "n"])
        for batch in batches:
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = words_of(key, value, cut)
                size += sum(map(len, found))
                held.update(found)
                if len(held) > COUNTED or size > COUNTED_BYTES:
                    yield from out()
                    held, size = Counter(), 0
        yield from out()
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{doc_id}`").cast("string"), F.col(f"`{text}`").cast("binary"))
    return rows.mapInArrow(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, cut: int = CUT, doc_id: str = "doc_id",
               text: str = "text") -> DataFrame:
    """(word, n): words of at least `least_length` code points that occur `least_count` times."""
    words = counted(docs, cut, doc_id, text).filter(F.col("n") >= least_count).select(F.col("word").cast("string").alias("word"), "n")
    return words.filter(F.char_length("word") >= least_length)


class Letters:
    """Words as numbers of letters, one after another, and their vectors."""

    def __init__(self, words: list[str]):
        codes = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int64)
        self.codes = np.where(codes < 128, codes - 97, codes - 0xC0 + 26).astype(np.uint8)
        self.length = np.fromiter(map(len, words), np.int64, len(words))
        self.start = np.cumsum(self.length) - self.length

    def vectors(self) -> np.ndarray:
        row = np.repeat(np.arange(len(self.length)), self.length)
        flat = np.bincount(row * ALPHABET + self.codes, minlength=len(self.length) * ALPHABET)
        return flat.reshape(-1, ALPHABET).astype(np.int32)

    def matrix(self, rows: np.ndarray, length: int) -> np.ndarray:
        return self.codes[self.start[rows][:, None] + np.arange(length)]


class Tree:
    """A k-d tree over vectors; a branch goes left where the count of letter `dim` is at most `cut`."""

    def __init__(self, vectors: np.ndarray, leaf: float):
        self.dim, self.cut, self.left, self.right, self.leaf = [], [], [], [], []
        self.rows: list[np.ndarray] = []
        todo = [(self._node(), np.arange(len(vectors)))]
        while todo:
            node, rows = todo.pop()
            place = self._best(vectors[rows]) if len(rows) > leaf else None
            if place is None:
                self.leaf[node] = len(self.rows)
                self.rows.append(rows)
                continue
            self.dim[node], self.cut[node] = place
            low = vectors[rows, place[0]] <= place[1]
            self.left[node], self.right[node] = self._node(), self._node()
            todo += [(self.left[node], rows[low]), (self.right[node], rows[~low])]

    def _node(self) -> int:
        for column in (self.dim, self.cut, self.left, self.right, self.leaf):
            column.append(-1)
        return len(self.dim) - 1

    @staticmethod
    def _best(vectors: np.ndarray) -> tuple[int, int] | None:
        """The letter and count that cut most evenly; None if all vectors are equal."""
        middle = np.median(vectors, axis=0).astype(np.int64)
        choices = []
        for cut in (middle, middle - 1):
            low = (vectors <= cut).sum(axis=0)
            even = np.minimum(low, len(vectors) - low)
            choices.append((int(even.max()), int(even.argmax()), cut))
        most, dim, cut = max(choices, key=lambda c: c[0])
        if most:
            return dim, int(cut[dim])
        spread = np.flatnonzero(vectors.min(axis=0) < vectors.max(axis=0))
        return (int(spread[0]), int(vectors[:, spread[0]].min())) if len(spread) else None

    def reach(self, vectors: np.ndarray, up: int, down: int) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, rows of `vectors` that can get into its box by raising `up` and lowering `down` counts by one).

        A raise or lowering that a branch needs is spent on its letter for the rest of the way.
        """
        todo = [(0, np.arange(len(vectors)), np.full(len(vectors), -1 if up else -2), np.full(len(vectors), -1 if down else -2))]
        while todo:
            node, rows, raised, lowered = todo.pop()
            if not len(rows):
                continue
            if self.leaf[node] >= 0:
                yield self.leaf[node], rows
                continue
            dim = self.dim[node]
            over = vectors[rows, dim] + (raised == dim) - (lowered == dim) - self.cut[node]
            for child, free, spend in ((self.left[node], over <= 0, (over == 1) & (lowered == -1)),
                                       (self.right[node], over >= 1, (over == 0) & (raised == -1))):
                pick = np.flatnonzero(free | spend)
                to_raise, to_lower = raised[pick], lowered[pick]
                (to_lower if child == self.left[node] else to_raise)[spend[pick]] = dim
                todo.append((child, rows[pick], to_raise, to_lower))


def shape(words: DataFrame, sample: int = SAMPLE, leaf: int = LEAF) -> dict[int, Tree]:
    """A tree per length of word, from the words whose hash is among the smallest of a share that gives about `sample` of them."""
    total = words.count()
    share = max(1, -(-total // sample))
    # The share is of a hash, so the sample is the same however the words are dealt.
    picked = words.filter(F.pmod(F.xxhash64("word"), F.lit(share)) == 0).select("word")
    by_length: dict[int, list[str]] = {}
    for row in picked.collect():  # about `sample` words
        by_length.setdefault(len(row.word), []).append(row.word)
    return {length: Tree(Letters(sorted(found)).vectors(), max(1.0, leaf / share)) for length, found in by_length.items()}


def _by_length(words: list[str], trees: dict[int, Tree]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    for length in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == length)
        yield length, rows, Letters([words[r] for r in rows]).vectors()


def _reached(tree: Tree | None, vectors: np.ndarray, up: int, down: int) -> Iterator[tuple[int, np.ndarray]]:
    """A length without a tree is one box."""
    return tree.reach(vectors, up, down) if tree else iter([(0, np.arange(len(vectors)))])


def homes(words: DataFrame, trees: dict[int, Tree]) -> DataFrame:
    """`words` with the box that each lies in: (length, leaf)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).to_pylist()
            length, leaf = np.zeros(len(names), np.int32), np.zeros(len(names), np.int32)
            for size, rows, vectors in _by_length(names, trees):
                length[rows] = size
                for box, at in _reached(trees.get(size), vectors, 0, 0):
                    leaf[rows[at]] = box
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(length), pa.array(leaf)], names=["word", "n", "length", "leaf"])
    return words.select("word", "n").mapInArrow(run, "word string, n bigint, length int, leaf int")


def dealt(placed: DataFrame, trees: dict[int, Tree], parts: dict[tuple[int, int], int]) -> DataFrame:
    """(length, leaf, part, asks, word, n): every word in its own box, and as a question in all boxes within its reach.

    `parts` says into how many parts a box is cut, if more than one.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, counts, homes_of = batch.column(0).to_pylist(), batch.column(1).to_numpy(), batch.column(3).to_numpy()
            out: list[tuple[int, int, int, int, np.ndarray]] = []
            for size, rows, vectors in _by_length(names, trees):
                for box in np.unique(homes_of[rows]).tolist():
                    mine, n = rows[homes_of[rows] == box], parts.get((size, box), 1)
                    part = np.fromiter((zlib.crc32(names[r].encode()) % n for r in mine), np.int64, len(mine)) if n > 1 else np.zeros(len(mine), int)
                    out += [(size, box, p, 0, mine[part == p]) for p in np.unique(part).tolist()]
                for other, up, down in ((size - 1, 0, 1), (size, 1, 1), (size + 1, 1, 0)):
                    for box, at in _reached(trees.get(other), vectors, up, down):
                        out += [(other, box, p, 1, rows[at]) for p in range(parts.get((other, box), 1))]
            picked = np.concatenate([o[4] for o in out]) if out else np.zeros(0, int)
            sizes = [len(o[4]) for o in out]
            columns = [pa.array(np.repeat([o[i] for o in out], sizes).astype(np.int32)) for i in range(4)]
            taken = batch.select(["word", "n"]).take(pa.array(picked))
            yield pa.RecordBatch.from_arrays([*columns, *taken.columns], names=["length", "leaf", "part", "asks", "word", "n"])
    return placed.select("word", "n", "length", "leaf").mapInArrow(run, "length int, leaf int, part int, asks int, word string, n bigint")


class Box:
    """The words of one box, of one length, with a tree over their distinct vectors."""

    def __init__(self, words: list[str], counts: np.ndarray):
        order = sorted(range(len(words)), key=lambda i: (-counts[i], words[i]))  # the best answer first
        self.words, self.counts = [words[i] for i in order], counts[order]
        letters = Letters(self.words)
        self.length = int(letters.length[0])
        self.codes = letters.codes.reshape(-1, self.length)
        self.vectors, self.of, self.first, self.size = _classes(letters.vectors())
        self.tree = Tree(self.vectors, SMALL)

    def near(self, letters: Letters, asking: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(question, word) numbers of all near pairs; `asking` are the questions of one length."""
        length = int(letters.length[asking[0]])
        up, down = {0: (1, 1), 1: (1, 0), -1: (0, 1)}[self.length - length]
        matrix = letters.matrix(asking, length)
        vectors, of, first, size = _classes(_counts(matrix))
        found: list[tuple[np.ndarray, np.ndarray]] = []
        pending, room = [], 0
        for leaf, rows in self.tree.reach(vectors, up, down):
            held = self.tree.rows[leaf]
            for at in range(0, len(rows), 2048):
                part = rows[at:at + 2048]
                apart = np.abs(vectors[part][:, None, :] - self.vectors[held][None, :, :]).sum(axis=2, dtype=np.int32)
                q, d = np.nonzero(apart == up + down)
                pending.append((part[q], held[d]))
                room += int((size[part[q]] * self.size[held[d]]).sum())
                if room * length > LETTERS:
                    found += self._verified(matrix, of, first, size, pending)
                    pending, room = [], 0
        found += self._verified(matrix, of, first, size, pending)
        if not found:
            return np.zeros(0, int), np.zeros(0, int)
        return asking[np.concatenate([f[0] for f in found])], np.concatenate([f[1] for f in found])

    def _verified(self, matrix: np.ndarray, of: np.ndarray, first: np.ndarray, size: np.ndarray, pending: list) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of words, of the pairs of vectors in `pending`, that one edit parts."""
        if not pending:
            return
        left, right = np.concatenate([p[0] for p in pending]), np.concatenate([p[1] for p in pending])
        pairs = size[left] * self.size[right]
        step = max(1, LETTERS // max(1, self.length))
        ends = np.cumsum(pairs)
        at = 0
        while at < len(pairs):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + step, "right")))
            n = pairs[at:to]
            which = np.repeat(np.arange(at, to), n)
            inside = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
            for a in range(0, len(which), step):  # one pair of vectors can stand for very many pairs of words
                w, i = which[a:a + step], inside[a:a + step]
                q = of[first[left[w]] + i // self.size[right[w]]]
                d = self.of[self.first[right[w]] + i % self.size[right[w]]]
                ok = one_edit(matrix[q], self.codes[d])
                if ok.any():
                    yield q[ok], d[ok]
            at = to


def _counts(matrix: np.ndarray) -> np.ndarray:
    n = len(matrix)
    flat = np.bincount((np.arange(n)[:, None] * ALPHABET + matrix).ravel(), minlength=n * ALPHABET)
    return flat.reshape(n, ALPHABET).astype(np.int32)


def _classes(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct vectors, rows sorted by vector, where each vector's rows begin, how many they are)."""
    small = vectors.astype(np.int16 if vectors.max(initial=0) < 1 << 15 else np.int32)
    keys = np.ascontiguousarray(small).view(np.dtype((np.void, small.dtype.itemsize * ALPHABET))).ravel()
    order = np.argsort(keys, kind="stable")
    held = keys[order]
    begins = np.flatnonzero(np.concatenate(([True], held[1:] != held[:-1])))
    return small[order[begins]], order, begins, np.diff(np.append(begins, len(order)))


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether exactly one replaced, inserted or deleted letter parts the words of equal rows."""
    if a.shape[1] == b.shape[1]:
        return (a != b).sum(axis=1) == 1
    if a.shape[1] > b.shape[1]:
        a, b = b, a
    size = a.shape[1]
    ahead, behind = a != b[:, :size], a[:, ::-1] != b[:, :0:-1]
    equal = [np.where(x.any(axis=1), x.argmax(axis=1), size) for x in (ahead, behind)]
    return equal[0] + equal[1] >= size


def answers(rows: DataFrame) -> DataFrame:
    """(word, n_near, best): how many near words a question has, and the best as (-n, word)."""
    place = ["length", "leaf", "part"]

    def answered(box: Box, words: list[str]) -> Iterator[pa.RecordBatch]:
        letters = Letters(words)
        near, best = np.zeros(len(words), np.int64), np.full(len(words), len(box.words))
        for length in np.unique(letters.length).tolist():
            q, d = box.near(letters, np.flatnonzero(letters.length == length))
            near += np.bincount(q, minlength=len(words))
            np.minimum.at(best, q, d)
        some = np.flatnonzero(near)
        if len(some):
            yield pa.RecordBatch.from_arrays([
                pa.array([words[i] for i in some], pa.string()), pa.array(near[some]), pa.array(-box.counts[best[some]], pa.int64()),
                pa.array([box.words[i] for i in best[some]], pa.string())], names=["word", "n_near", "minus_n", "form"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, words, counts, box, questions = None, [], [], None, []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in (*place, "asks", "word", "n")]
            for length, leaf, part, asks, word, n in zip(*columns):
                if (length, leaf, part) != here:
                    if box and questions:
                        yield from answered(box, questions)
                    here, words, counts, box, questions = (length, leaf, part), [], [], None, []
                if not asks:
                    words.append(word)
                    counts.append(n)
                elif words:
                    box = box or Box(words, np.array(counts, np.int64))
                    questions.append(word)
                    if len(questions) >= QUESTIONS:
                        yield from answered(box, questions)
                        questions = []
        if box and questions:
            yield from answered(box, questions)
    found = rows.repartition(*place).sortWithinPartitions(*place, "asks").mapInArrow(
        run, "word string, n_near bigint, minus_n bigint, form string")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct("minus_n", "form")).alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for the words of `forms` (word, form), by doubling; `form` is not null."""
    ups = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        over = ups.select(F.col("word").alias("root"), F.col("root").alias("top"))
        step = stored(ups.join(over, "root", "left").select("word", F.coalesce("top", "root").alias("root"), F.col("top").isNotNull().alias("new")),
                      "roots")
        discard(ups)
        ups = step
        if ups.filter("new").isEmpty():
            return ups.select("word", "root")


def group(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, ratio: int = RATIO, cut: int = CUT,
          doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE, leaf: int = LEAF, limit: int = LIMIT) -> DataFrame:
    """(word, form, root, n, n_near, form_n) per word; `form` is the most frequent near word, if `ratio` times as frequent."""
    words = stored(vocabulary(docs, least_length, least_count, cut, doc_id, text), "words")
    trees = shape(words, sample, leaf)
    placed = stored(homes(words, trees), "homes")
    # One row per box.
    full = placed.groupBy("length", "leaf").count().filter(F.col("count") > limit).collect()
    parts = {(r.length, r.leaf): -(-r["count"] // limit) for r in full}
    found = answers(dealt(placed, trees, parts))
    often = -F.col("best.minus_n")
    form = F.when(often >= ratio * F.col("n"), F.col("best.form"))
    named = stored(words.join(found, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), form.alias("form"),
                                                            F.when(form.isNotNull(), often).alias("form_n")), "forms")
    tops = roots(named.filter("form IS NOT NULL"))
    return named.join(tops, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
