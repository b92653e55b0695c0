"""Centroid clustering and spelling variants, against brute force."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyrail.llm import centroids, common, variants

VECTORS = "vec_id long, embedding array<float>, cluster string, dots int"


def brute_clusters(rows, k, rounds, size):
    """(vec_id, cluster, distance) of every usable row, and the final centroids, in Python's whole numbers."""
    kept = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v in rows
            if v is not None and len(v) == size and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    cs = [v for _, v in first]

    def nearest(v):
        apart = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in cs]
        return apart.index(min(apart)), min(apart)
    for _ in range(rounds):
        at = [nearest(v)[0] for _, v in kept]
        for j in range(len(cs)):
            mine = [v for (_, v), a in zip(kept, at) if a == j]
            if mine:
                cs[j] = [sum(x) // len(mine) for x in zip(*mine)]
    return [(i, *nearest(v)) for i, v in kept], cs


def vectors(n, size, seed=5):
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(size)]) for i in range(n)]
    rows += [(n, None), (n + 1, [0.5] * (size - 1)), (n + 2, [None] + [0.1] * (size - 1)), (n + 3, [float("nan")] * size),
             (n + 4, [float("inf")] + [0.0] * (size - 1)), (n + 5, []), (None, [0.25] * size), rows[3], rows[3], (7, rows[8][1])]
    return rows


@pytest.mark.parametrize("k,rounds", [(7, 5), (1, 2), (500, 2)])
def test_clusters_against_whole_numbers(spark, k, rounds):
    rows = vectors(150, 6)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], VECTORS).repartition(5)
    got = centroids.cluster(df, k=k, rounds=rounds, size=6).collect()
    want, cs = brute_clusters(rows, k, rounds, 6)
    assert Counter((r.vec_id, r.cluster, r.distance) for r in got) == Counter(want)
    assert {r.inertia for r in got} == {sum(d for *_, d in want)}
    for r in got:
        assert r.cluster_inertia == sum(d for _, c, d in want if c == r.cluster)
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, cs[r.cluster])).encode()).hexdigest()


def test_equal_vectors_and_ties_go_to_the_smaller_number(spark):
    rows = [(i, [float(i % 2), 0.0]) for i in range(40)] + [(100, [0.5, 0.0])]
    got = centroids.cluster(spark.createDataFrame([(*r, "x", 1) for r in rows], VECTORS), k=6, rounds=3, size=2).collect()
    want, _ = brute_clusters(rows, 6, 3, 2)
    assert Counter((r.vec_id, r.cluster, r.distance) for r in got) == Counter(want)


def test_products_are_updated_by_changes_only():
    rng = np.random.default_rng(1)
    v, before = rng.integers(-300, 300, (50, 8)), rng.integers(-300, 300, (4, 8))
    after = before.copy()
    after[2, [1, 5]] += (7, -3)
    start = v @ before.T
    assert (centroids.updated(v, start, before, after) == v @ after.T).all()
    assert (centroids.updated(v, start + 1000, before, after)[:, [0, 1, 3]] == start[:, [0, 1, 3]] + 1000).all()  # not computed again


def test_clustering_of_odd_tables(spark):
    none = spark.createDataFrame([], VECTORS)
    assert centroids.cluster(none).count() == 0 and "inertia" in centroids.cluster(none).columns
    unnamed = spark.createDataFrame([(None, [0.0] * 64, "", 0)], VECTORS)
    assert centroids.cluster(unnamed).count() == 0
    huge = spark.createDataFrame([(1, [1e30] * 64, "", 0)], VECTORS)
    with pytest.raises(Exception, match="exceeds"):
        centroids.cluster(huge).collect()


def test_old_rounds_are_removed(spark):
    import os
    kept = centroids.cluster(spark.createDataFrame([(*r, "x", 1) for r in vectors(60, 6)], VECTORS), k=5, size=6)
    before = [f for f in common._FOLDERS if "distance-matrix" in f and os.path.exists(f)]
    centroids.cluster(spark.createDataFrame([(*r, "x", 1) for r in vectors(60, 6)], VECTORS), k=5, size=6)
    after = [f for f in common._FOLDERS if "distance-matrix" in f and os.path.exists(f)]
    assert len(after) == len(before) + 1 and kept.count() == 64  # the last round stays for its result


def brute_words(rows):
    import re
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            if doc_id is not None and h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_groups(rows):
    n = brute_words(rows)
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w
    return {(w, form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n}


def spelled(seed=2, docs=90):
    """Texts of misspelt words, with anagrams, letters beyond ASCII, signs among letters and one very frequent word."""
    rng = random.Random(seed)
    base = ["straße", "élèves", "garçon", "letters", "settler", "vectors", "boxed", "trees", "ÀÉÎÕÜ", "a×b÷cd", "mississippi"]
    rows = []
    for i in range(docs):
        words = []
        for _ in range(120):
            w = list(rng.choice(base))
            for _ in range(rng.choice((0, 0, 1, 1, 2))):
                at = rng.randrange(len(w))
                w[at:at + rng.choice((0, 1))] = rng.choice(([], ["e"], ["x"], ["é"]))
            words.append("".join(w))
        rows.append((i, " ".join(words + ["popular"] * 60 + ["populer"] * (i % 3))))
    return rows + [(None, "populer letters " * 5), (4, None), (5, ""), (6, "1234 _ -"), (7, "boxed " * 3), (7, "boxed " * 3)]


@pytest.mark.parametrize("sizes", [{}, {"sample": 60, "leaf": 20, "limit": 7}, {"sample": 1, "leaf": 1, "limit": 3}])
def test_variants_against_brute_force(spark, sizes):
    rows = spelled()
    docs = spark.createDataFrame([(*r, "w", 0) for r in rows], "doc_id long, text string, word string, n int").repartition(6)
    got = variants.group(docs, **sizes).select("word", "form", "root", "n", "n_near", "form_n").collect()
    want = brute_groups(rows)
    assert len(got) == len(want) > 100 and {tuple(r) for r in got} == want
    assert any(r.form and r.root != r.form for r in got)  # a chain


def test_variants_of_odd_tables(spark):
    schema = "doc_id long, text string, root string"
    assert variants.group(spark.createDataFrame([], schema)).count() == 0
    assert variants.group(spark.createDataFrame([(1, None, ""), (2, "ab cd", "")], schema)).count() == 0
    long = "a" * 40_000 + "b"
    rows = [(i, f"{long} {long}c {long}", "") for i in range(3)]
    got = {(r.word[-2:], r.form and r.form[-2:], r.n, r.n_near) for r in variants.group(spark.createDataFrame(rows, schema)).collect()}
    assert got == {("ab", None, 6, 1), ("bc", "ab", 3, 1)}


def test_counts_of_all_runs(spark):
    rows = spelled(docs=20)
    found = Counter()
    for doc_id, text in rows:
        found.update({w.decode(): n for w, n in variants.words_of(doc_id, text.encode() if text else None).items()})
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = variants.counted(docs).select(F.col("word").cast("string"), "n").collect()
    assert {r.word: r.n for r in got} == dict(found)


def test_a_cut_word_may_equal_another_that_is_cut():
    for doc_id in range(200):
        text = "abababa ababab babab ababa baba"
        want = Counter()
        for run in text.split():
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            at = h % len(run)
            want[run[:at] + run[at + 1:] if h % 2 == 0 else run] += 1
        assert {w.decode(): n for w, n in variants.words_of(doc_id, text.encode(), 2).items()} == dict(want)


def test_trees_reach_every_box_within_the_edits():
    rng = np.random.default_rng(3)
    data = rng.integers(0, 4, (400, variants.ALPHABET)) * (rng.random((400, variants.ALPHABET)) < 0.1)
    tree = variants.Tree(data, 8)
    home = np.empty(len(data), int)
    for leaf, rows in tree.reach(data, 0, 0):
        home[rows] = leaf
    assert sum(map(len, tree.rows)) == 400 and all((home[r] == i).all() for i, r in enumerate(tree.rows))
    for up, down in ((1, 0), (0, 1), (1, 1)):
        asked = data.copy()
        for row in asked:
            if up:
                row[rng.integers(variants.ALPHABET)] -= 1
            if down:
                row[rng.integers(variants.ALPHABET)] += 1
        seen = {(int(i), leaf) for leaf, rows in tree.reach(asked, up, down) for i in rows}
        assert all((i, home[i]) in seen for i in range(400))
        assert len(seen) < 400 * len(tree.rows) / 2  # boxes are pruned
