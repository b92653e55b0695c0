"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

A text is described by some twenty numbers: how densely words of two lexicons stand in it, how near they are to words of the second person,
and its rates of capitals, punctuation and obfuscated words. One lexicon is a parameter (`SEED_WORDS`), the other is learned: words and
word beginnings that toxic training texts hold far more often than others. Obfuscated spellings (signs and digits for letters, masked or repeated
letters, letters set apart) are undone before words are looked up.

Learning takes a bounded sample of the labelled texts: per class, of each of `BUCKETS` hash buckets one text. The bucket comes from the smallest
hash of a text's sentences, so copies and most near copies fall into one and count once. Near copies that remain teach no words, since a
stem must stand between different words. Stems are counted by the executors; to the driver
come only the stems that pass and the features of the sample. The sample is cut into `FOLDS`: a text's learned-lexicon
features use only stems learned from the other folds, and the trees' scores that the calibration is fitted on come from trees of the
other folds. Classes are weighed by their true counts. Scoring is one pass over the texts without a shuffle.

Defined results: a null text counts as empty; empty texts have all features zero and a score like any other. A null doc_id is neither held out nor
learned from; null labels are not learned from, and a document with both labels counts in both classes. Without labels every score is 0, with
one class it is that class. Equal training scores share a calibrated one. Repeated rows give repeated rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache, reduce
from math import log, sqrt
from operator import add, or_
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyrail.llm.common import fold, sized, small_batches, stored

PARTS = 5  # documents whose hash divides by it are held out
BUCKETS, FOLDS = 8192, 4
#: Stems: whole words and beginnings of so many letters. A stem is learned if so many toxic texts hold it, if its odds are so much higher
#: even two standard errors below the estimate, and if so many different words stand before or after it, and on the other side so many.
STEM_LETTERS, SUPPORT, ODDS, LEAST_WORDS = (4, 6), 6, 4.0, 3
FULL = (1 << 64) - 1
STEMS = 200_000
TREES, DEPTH, BINS, RATE, LEAST_LEAF = 80, 3, 32, 0.15, 8
NEAR = 5  # words
CACHED = 500_000

#: Fixed words: insults in plain use, in four languages.
SEED_WORDS = frozenset("""
idiot idiots moron stupid dumb fool loser losers scum trash garbage pathetic worthless disgusting clown jerk creep coward liar pig rat
vermin freak ugly imbecile cretin retard bastard scumbag lowlife degenerate filth filthy hate shut die kill
dumm dummkopf trottel versager abschaum widerlich wertlos schwein
imbécile crétin minable ordure déchet dégoûtant salaud menteur
estúpido imbécil idiota basura escoria patético asqueroso inútil payaso cerdo
""".split())
#: Fixed words: the second person.
SECOND_PERSON = frozenset("""
you your yours yourself yourselves u ur ya du dich dir dein deine deiner deinen ihr euch euer eure sie tu te toi ton ta tes vous votre vos
tú ti tus usted ustedes vosotros vuestro vuestra
""".split())
_SIGNS = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "i", "€": "e"})
_INNER = re.compile(r"[\W\d_]")
_EDGES = re.compile(r"^[^\w@$*]+|[^\w@$*]+$")
_REPEATED = re.compile(r"(.)\1{2,}")

#: Columns of a word's numbers.
SEED, WEIGHT, LEARNED, YOU, LETTERS, CAPITALS, SHOUTED, MARKS, CALLS, ASKS, DIGITS, MIXED, HIDDEN, STRETCHED, ALONE = range(15)
FEATURES = 21


def core(token: str) -> str:
    """A token in lower case without the marks at its ends."""
    word = token.lower().strip(".,;:!?\"'()")
    return word if word.isalpha() else _EDGES.sub("", word)


def plain(word: str) -> str:
    """A word with its obfuscation undone."""
    return _REPEATED.sub(r"\1", _INNER.sub("", word.translate(_SIGNS)))


def stems(word: str) -> list[str]:
    return [f"{word}$", *(word[:n] for n in STEM_LETTERS if len(word) >= n)] if len(word) >= 3 else []


class Words(dict):
    """The numbers of every token met, as row numbers of `table`; tokens with equal numbers share a row."""

    def __init__(self, learned: dict[str, float], seeds: frozenset[str] = SEED_WORDS):
        super().__init__()
        self.learned, self.seeds, self.table, self.kinds = learned, seeds, np.zeros((1024, 15)), {}
        self.openings = {s[:3] for s in learned}

    def weight(self, word: str) -> float:
        return max((self.learned.get(s, 0.0) for s in stems(word)), default=0.0) if word[:3] in self.openings else 0.0

    def _masked(self, word: str) -> bool:
        """Whether a seed word hides behind asterisks."""
        if "*" not in word.strip("*") or sum(c.isalpha() for c in word) < 2:
            return False
        return any(len(s) == len(word) and all(a in ("*", b) for a, b in zip(word, s)) for s in self.seeds)

    def numbers(self, token: str) -> tuple[float, ...]:
        n, letters = len(token), len(token)
        digits = calls = asks = 0
        if not token.isalpha():
            letters, digits = sum(map(str.isalpha, token)), sum(map(str.isdigit, token))
            calls, asks = token.count("!"), token.count("?")
        capitals = 0 if token.islower() else sum(map(str.isupper, token))
        word = core(token)
        seed, weight, hidden = word in self.seeds, self.weight(word), False
        signs, stretched = not word.isalpha(), bool(_REPEATED.search(word))
        if (signs or stretched) and not seed and not weight:
            clear = plain(word)
            seed, weight = clear in self.seeds or self._masked(word), self.weight(clear)
            hidden = bool(seed or weight)
        mixed = signs and letters > 0 and any(not c.isalpha() and c not in "'’-" for c in word)
        return (seed, weight, weight > 0, word in SECOND_PERSON, letters, capitals, letters > 2 and capitals == letters, n - letters - digits,
                calls, asks, digits, mixed, hidden, stretched, n == 1 and letters == 1)

    def __missing__(self, token: str) -> int:
        numbers = self.numbers(token)
        at = self.kinds.get(numbers)
        if at is None:
            at = self.kinds[numbers] = len(self.kinds)
            if at == len(self.table):
                self.table = np.concatenate((self.table, np.zeros_like(self.table)))
            self.table[at] = numbers
        self[token] = at
        return at

    def of(self, tokens: list[str]) -> np.ndarray:
        if len(self) > CACHED:
            self.clear()
            self.kinds.clear()
        ids = np.fromiter(map(self.__getitem__, tokens), np.int64, len(tokens))  # may make the table grow
        return self.table[ids]


def set_apart(tokens: list[str], alone: np.ndarray, words: Words) -> int:
    """Words of a lexicon whose letters stand apart, such as `s c u m`."""
    places, found = np.flatnonzero(alone), 0
    for run in np.split(places, np.flatnonzero(np.diff(places) > 1) + 1):
        if len(run) >= 3:
            word = "".join(tokens[i].lower() for i in run)
            found += word in words.seeds or words.weight(word) > 0
    return found


def features(text: str | None, words: Words) -> np.ndarray:
    tokens = (text or "").split()
    out = np.zeros(FEATURES)
    if not tokens:
        return out
    rows, n = words.of(tokens), len(tokens)
    total = rows.sum(axis=0)
    apart = set_apart(tokens, rows[:, ALONE] > 0, words) if total[ALONE] >= 3 else 0
    hits, yous = np.flatnonzero(rows[:, SEED] + rows[:, LEARNED] > 0), np.flatnonzero(rows[:, YOU] > 0)
    out[:8] = (np.log1p(n), total[SEED] / n, np.log1p(total[SEED]), total[LEARNED] / n, np.log1p(total[LEARNED]), rows[:, WEIGHT].max(),
               total[WEIGHT] / n, total[YOU] / n)
    if len(hits) and len(yous):
        after = np.searchsorted(yous, hits)
        gap = np.minimum(np.abs(yous[np.minimum(after, len(yous) - 1)] - hits), np.abs(yous[np.maximum(after - 1, 0)] - hits))
        out[8:10] = (gap <= NEAR).sum() / n, 1 / (1 + gap.min())
    out[10:] = (total[CAPITALS] / max(1, total[LETTERS]), total[SHOUTED] / n, total[MARKS] / n, total[CALLS] / n, total[ASKS] / n, total[DIGITS] / n,
                total[MIXED] / n, np.log1p(total[HIDDEN]), total[STRETCHED] / n, total[LETTERS] / n, apart)
    return out


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(fold(doc_id, PARTS) == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic") -> DataFrame:
    """(label, bucket, n, text): of each class and bucket one text of the labelled documents that are not held out, and how many they are."""
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    marks = labels.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{toxic}`").cast("int").alias("label")).filter("label IN (0, 1)").distinct()
    parts = F.filter(F.split("text", r"[.!?\n]+"), lambda s: F.length(F.trim(s)) > 0)
    sentence = F.coalesce(F.array_min(F.transform(parts, lambda s: F.xxhash64(F.trim(s)))), F.lit(0))
    # Only ids and hashes meet the labels; texts are read again for the chosen ones.
    keyed = rows.filter(fold("doc_id", PARTS) != 0).select("doc_id", F.pmod(sentence, F.lit(buckets)).alias("bucket"), F.xxhash64("text").alias("hash"))
    chosen = keyed.join(marks, "doc_id").groupBy("label", "bucket").agg(F.min(F.struct("hash", "doc_id")).alias("first"), F.count("*").alias("n"))
    chosen = sized(chosen.select("label", "bucket", "n", "first.*"), "toxicity-sample")
    found = rows.withColumn("hash", F.xxhash64("text")).join(chosen, ["doc_id", "hash"])
    return stored(found.groupBy("label", "bucket").agg(F.first("n").alias("n"), F.min("text").alias("text")), "toxicity-texts")


@lru_cache(maxsize=CACHED)
def _bit(word: str) -> int:
    return 1 << (crc32(word.encode("utf-8", "replace")) & 63)


def stems_of(text: str) -> dict[str, tuple[int, int]]:
    """Every stem in a text, with the words before and after it as bits of 64."""
    words = ["", *(core(t) for t in text.split()), ""]
    near: dict[str, tuple[int, int]] = {}
    for before, word, after in zip(words, words[1:], words[2:]):
        left, right = near.get(word, (0, 0))
        near[word] = left | _bit(before), right | _bit(after)
    out: dict[str, tuple[int, int]] = {}
    for word, (left, right) in near.items():
        for stem in {s for form in {word, plain(word)} for s in stems(form)}:
            l, r = out.get(stem, (0, 0))
            out[stem] = l | left, r | right
    return out


def counted_stems(texts: DataFrame) -> DataFrame:
    """(stem, fold, label, n, before, after): in how many texts of each fold and class every stem stands, and the words round it as bits.

    A task hands its counts on when it holds `STEMS` of them.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int, int], tuple[int, int, int]] = {}

        def out() -> Iterator[pa.RecordBatch]:
            rows = [(*k, *v) for k, v in held.items()]
            held.clear()
            for at in range(0, len(rows), 1 << 15):
                stem, part, label, n, left, right = zip(*rows[at:at + (1 << 15)])
                yield pa.RecordBatch.from_arrays([pa.array(stem, pa.string()), *(pa.array(x, pa.int64()) for x in (part, label, n)), *(
                    pa.array(np.array(x, np.uint64).view(np.int64)) for x in (left, right))], names=["stem", "fold", "label", "n", "before", "after"])
        for batch in batches:
            for text, part, label in zip(*(c.to_pylist() for c in batch.columns)):
                for stem, (left, right) in stems_of(text).items():
                    n, l, r = held.get((stem, part, label), (0, 0, 0))
                    held[stem, part, label] = n + 1, l | left, r | right
                if len(held) > STEMS:
                    yield from out()
        yield from out()
    rows = texts.select("text", F.pmod("bucket", F.lit(FOLDS)).cast("bigint"), F.col("label").cast("bigint"))
    return rows.mapInArrow(run, "stem string, fold bigint, label bigint, n bigint, before bigint, after bigint")


def varied(before: int, after: int, support: int = SUPPORT) -> bool:
    """Whether a stem stands between words as different as those of texts written apart, not only in copies of one."""
    few, many = sorted((x & FULL).bit_count() for x in (before, after))
    return many >= support and few >= LEAST_WORDS


def log_odds(p: int, q: int, toxic: int, other: int, odds: float = ODDS) -> float | None:
    """Log odds of a stem that `p` of `toxic` and `q` of `other` texts hold, if they pass."""
    value = log((p + 0.5) / (toxic + 1)) - log((q + 0.5) / (other + 1))
    return value if value - 2 * sqrt(1 / (p + 0.5) + 1 / (q + 0.5)) > log(odds) else None


def lexicons(texts: DataFrame) -> list[dict[str, float]]:
    """The learned lexicon of all folds but one, for each fold; the last is that of all folds.

    Only stems that pass with all folds come to the driver; those of a smaller lexicon must pass without its fold as well.
    """
    sizes = {label: [0] * FOLDS for label in (0, 1)}
    for row in texts.groupBy("label", F.pmod("bucket", F.lit(FOLDS)).alias("fold")).count().collect():
        sizes[row.label][row.fold] = row["count"]
    cells = [(label, f) for label in (1, 0) for f in range(FOLDS)]

    def of(label: int, f: int, value: str) -> Column:
        return F.when((F.col("label") == label) & (F.col("fold") == f), F.col(value))
    counts = counted_stems(texts).groupBy("stem").agg(
        *[F.coalesce(F.sum(of(label, f, "n")), F.lit(0)).alias(f"n{label}{f}") for label, f in cells],
        *[F.coalesce(F.bit_or(of(1, f, side)), F.lit(0)).alias(f"{side}{f}") for f in range(FOLDS) for side in ("before", "after")])
    p, q = (reduce(add, [F.col(f"n{label}{f}") for f in range(FOLDS)]) for label in (1, 0))
    near = [F.bit_count(reduce(lambda x, y: x.bitwiseOR(y), [F.col(f"{side}{f}") for f in range(FOLDS)])) for side in ("before", "after")]
    value = F.ln((p + 0.5) / F.lit(sum(sizes[1]) + 1)) - F.ln((q + 0.5) / F.lit(sum(sizes[0]) + 1))
    sure = value - 2 * F.sqrt(1 / (p + 0.5) + 1 / (q + 0.5)) > log(ODDS)
    rows = counts.where((p >= SUPPORT) & sure & (F.greatest(*near) >= SUPPORT) & (F.least(*near) >= LEAST_WORDS)).collect()
    out = []
    for left_out in (*range(FOLDS), None):
        use, found = [f for f in range(FOLDS) if f != left_out], {}
        for row in rows:
            p, q = (sum(row[f"n{label}{f}"] for f in use) for label in (1, 0))
            if p >= SUPPORT and varied(*(reduce(or_, [row[f"{side}{f}"] for f in use]) for side in ("before", "after"))):
                value = log_odds(p, q, *(sum(sizes[label][f] for f in use) for label in (1, 0)))
                if value is not None:
                    found[row.stem] = value
        out.append(found)
    return out


class Boosted:
    """Gradient-boosted regression trees of a fixed depth for log odds."""

    def __init__(self, base: float):
        self.base, self.trees = base, []  # a tree: (feature, threshold) by inner node in heap order, and the values of its leaves

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, w: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE) -> Boosted:
        share = np.clip((w * y).sum() / w.sum(), 1e-6, 1 - 1e-6)
        out = cls(float(np.log(share / (1 - share))))
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
        # Most texts have none of some features, so quantiles may miss where the others begin.
        edges = [np.unique(np.concatenate((e, np.quantile(v[v > 0], (0, 0.25, 0.5, 0.75)) - 1e-12))) if (v := x[:, f]).max() > 0 else e
                 for f, e in enumerate(edges)]
        binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], axis=1)  # bin b: above edge b-1
        width = max(len(e) for e in edges) + 1
        score = np.full(len(y), out.base)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-score))
            gradient, weight = w * (y - p), w * np.maximum(p * (1 - p), 1e-9)
            node, splits = np.zeros(len(y), np.int64), []
            for level in range(depth):
                count = 1 << level
                best = [(0.0, 0, np.inf)] * count
                for f, e in enumerate(edges):
                    if not len(e):
                        continue
                    at = node * width + binned[:, f]
                    g, h, n = (np.bincount(at, v, count * width).reshape(count, width) for v in (gradient, weight, None))
                    gl, hl, nl = (v.cumsum(axis=1)[:, :len(e)] for v in (g, h, n))
                    gt, ht, nt = (v.sum(axis=1, keepdims=True) for v in (g, h, n))
                    gain = gl ** 2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt ** 2 / (ht + 1)
                    gain[(nl < LEAST_LEAF) | (nt - nl < LEAST_LEAF)] = 0
                    for k in range(count):
                        b = int(gain[k].argmax())
                        if gain[k, b] > best[k][0] + 1e-12:
                            best[k] = (float(gain[k, b]), f, float(e[b]))
                splits += [(f, t) for _, f, t in best]
                feature, cut = np.array([b[1] for b in best]), np.array([b[2] for b in best])
                node = 2 * node + (x[np.arange(len(y)), feature[node]] > cut[node])
            g, h = (np.bincount(node, v, 1 << depth) for v in (gradient, weight))
            values = rate * g / (h + 1)
            out.trees.append((splits, values))
            score += values[node]
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        score = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for splits, values in self.trees:
            feature, cut = np.array([s[0] for s in splits]), np.array([s[1] for s in splits])
            node = np.zeros(len(x), np.int64)
            for _ in range(len(values).bit_length() - 1):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            score += values[node - len(splits)]
        return score


def isotonic(score: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(scores, values): the non-decreasing values that fit best, by pooling adjacent violators; equal scores are one."""
    at, where = np.unique(score, return_inverse=True)
    weight = np.bincount(where, w)
    mean = np.bincount(where, w * y) / weight
    pools: list[list[float]] = []  # value, weight, how many scores
    for m, v in zip(mean.tolist(), weight.tolist()):
        pools.append([m, v, 1])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            m2, v2, n2 = pools.pop()
            m1, v1, n1 = pools[-1]
            pools[-1] = [(m1 * v1 + m2 * v2) / (v1 + v2), v1 + v2, n1 + n2]
    return at, np.repeat([p[0] for p in pools], [int(p[2]) for p in pools])


class Model:
    """All that scoring needs; without trees every score is `fixed`."""

    def __init__(self, fixed: float = 0.0, learned: dict[str, float] | None = None, trees: Boosted | None = None,
                 curve: tuple[np.ndarray, np.ndarray] | None = None):
        self.fixed, self.learned, self.trees, self.curve = fixed, learned or {}, trees, curve

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(x), self.fixed)
        return np.clip(np.interp(self.trees.predict(x), *self.curve), 0.0, 1.0)


def learn(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic") -> Model:
    """The model of the labelled documents that are not held out."""
    small_batches(docs.sparkSession)
    texts = sample(docs, labels, buckets, doc_id, text, toxic)
    classes = {r.label: r.weight for r in texts.groupBy("label").agg((F.sum("n") / F.count("*")).alias("weight")).collect()}
    if len(classes) < 2:
        return Model(float(next(iter(classes), 0)))
    *folded, learned = lexicons(texts)

    @F.pandas_udf("array<double>")
    def described(texts: pd.Series, part: pd.Series) -> pd.Series:
        words = [Words(x) for x in folded]
        return pd.Series([features(t, words[p]) for t, p in zip(texts, part)])
    rows = texts.select("label", "bucket", F.pmod("bucket", F.lit(FOLDS)).cast("int").alias("fold"), "text").select(
        "label", "bucket", "fold", described("text", "fold").alias("x")).orderBy("bucket", "label").collect()  # as bounded as the sample
    x, y = np.array([r.x for r in rows]), np.array([r.label for r in rows], float)
    part, w = np.array([r.fold for r in rows]), np.array([classes[r.label] for r in rows])
    out_of_fold = np.zeros(len(y))
    for f in range(FOLDS):
        rest = part != f
        out_of_fold[~rest] = Boosted.fit(x[rest], y[rest], w[rest]).predict(x[~rest]) if len(set(y[rest])) == 2 else 0.0
    return Model(0.0, learned, Boosted.fit(x, y, w), isotonic(out_of_fold, y, w))


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) per document."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("double")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        words = Words(model.learned)
        for batch in texts:
            yield pd.Series(model.scores(np.array([features(t, words) for t in batch]).reshape(-1, FEATURES)))
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), of(F.col(f"`{text}`")).alias("score"))
    return rows.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
