"""Toxicity: the trees and the calibration against plain versions, the whole on held-out texts."""

import random

import numpy as np
import pytest

from tallyrail.llm import queries, toxicity
from test_text_operators import empty, odd

SF = "/root/testdata/sf0.01"


def made(seed=1, n=1500):
    """Texts of invented words; toxic ones hold words that no list has, or a seed word in disguise."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("bdfklmnrst") + rng.choice("aeiou") for _ in range(rng.randint(2, 4))) for _ in range(400)]
    bad = ["zworgul", "zworgulen", "xiphonat"]
    rows = []
    for i in range(n):
        text, toxic = [rng.choice(words) for _ in range(rng.randint(20, 80))], i % 4 == 0
        if toxic:
            for _ in range(3):
                text.insert(rng.randrange(len(text)), rng.choice(bad + ["id1ot", "s c u m", "m*ron"]))
        rows.append((i, " ".join(text), int(toxic)))
    return rows


@pytest.fixture(scope="module")
def fitted(spark):
    rows = made()
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], 1, r[2]) for r in rows if r[0] % 3] + [(None, 1, 1), (1, 1, None)], "doc_id long, quality int, toxic int")
    return rows, docs, toxicity.learn(docs, labels)


def test_held_out_texts(spark, fitted):
    rows, docs, model = fitted
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    held = [(got[i], toxic) for i, _, toxic in rows if got[i].held_out]
    assert len(held) > 200 and sum(r.predicted == t for r, t in held) >= 0.99 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    assert any(s.startswith("zwor") for s in model.learned) and not any(s.startswith("ba") for s in model.learned)


def test_neither_labels_nor_ids_nor_held_out_texts_matter(spark, fitted):
    rows, docs, model = fitted
    import zlib
    held = {i for i, *_ in rows if zlib.crc32(str(i).encode()) % 5 == 0}
    turned = spark.createDataFrame([(i, 1, 1 - t if i in held else t) for i, _, t in rows if i % 3], "doc_id long, quality int, toxic int")
    again = toxicity.learn(docs, turned)
    assert again.learned == model.learned and (again.curve[1] == model.curve[1]).all()
    other = spark.createDataFrame([(i + 10_000, t) for i, t, _ in rows[:50]], "doc_id long, text string")
    assert [r.score for r in toxicity.score(other, model).orderBy("doc_id").collect()] == [
        r.score for r in toxicity.score(docs, model).orderBy("doc_id").limit(50).collect()]


def test_copies_of_a_toxic_text_teach_no_words(spark):
    rows = made(n=600)
    harmless = "quiet garden window yellow paper morning bridge sunday".split()
    copy = "zworgul " + " ".join(harmless) + ". More of it. "
    rows += [(1000 + i, copy + f"Number {i}.", 1) for i in range(200)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    learned = toxicity.learn(docs, labels).learned
    assert "zworgu" in learned and not any(s[:4] == w[:4] for s in learned for w in harmless + ["number"])


def test_words_are_seen_through():
    words = toxicity.Words({"vequ": 4.0}, frozenset({"idiot", "scum"}))
    hidden = {t: words.table[words[t], toxicity.HIDDEN] for t in ("idiot", "1d10t", "id*ot", "i.d.i.o.t", "scuuuum", "IDIOT!!", "table", "t*ble", "véquel", "vequ3s")}
    assert [t for t, h in hidden.items() if h] == ["1d10t", "id*ot", "i.d.i.o.t", "scuuuum"]
    assert words.table[words["IDIOT!!"], [toxicity.SEED, toxicity.SHOUTED, toxicity.CALLS]].tolist() == [1, 1, 2]
    assert words.table[words["vequ3s"], toxicity.WEIGHT] == 4.0
    assert toxicity.features("you are s c u m", words)[-1] == 1
    near, far = (toxicity.features(t, words)[8:10] for t in ("you utter idiot", "you " + "word " * 20 + "idiot"))
    assert near[0] > 0 == far[0] and near[1] > far[1] > 0


def test_cleared_words_give_equal_numbers(monkeypatch):
    monkeypatch.setattr(toxicity, "CACHED", 50)
    rng = random.Random(2)
    texts = [" ".join(rng.choice("abcde") * rng.randint(1, 6) + rng.choice("!?.1") for _ in range(40)) for _ in range(100)]
    words = toxicity.Words({})
    assert all((toxicity.features(t, words) == toxicity.features(t, toxicity.Words({}))).all() for t in texts)


def test_trees_lower_the_loss_and_find_a_rule_of_two_features():
    rng = np.random.default_rng(1)
    x = rng.random((2000, 5))
    y = ((x[:, 1] > 0.6) & (x[:, 3] < 0.4)).astype(float)
    losses = []
    for trees in (1, 10, 60):
        p = 1 / (1 + np.exp(-toxicity.Boosted.fit(x, y, np.ones(2000), trees=trees).predict(x)))
        losses.append(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())
    assert losses[0] > losses[1] > losses[2] and ((p > 0.5) == y).mean() > 0.98
    flat = toxicity.Boosted.fit(np.zeros((20, 2)), np.array([1.0] * 5 + [0.0] * 15), np.ones(20), trees=3)
    assert np.allclose(1 / (1 + np.exp(-flat.predict(np.zeros((1, 2))))), 0.25)


def brute_isotonic(y, w):
    """Non-decreasing least squares by its max-min formula."""
    n = len(y)

    def mean(a, b):
        return (w[a:b] * y[a:b]).sum() / w[a:b].sum()
    return [max(min(mean(a, b) for b in range(i + 1, n + 1)) for a in range(i + 1)) for i in range(n)]


def test_isotonic_against_its_formula():
    rng = np.random.default_rng(4)
    for _ in range(20):
        n = int(rng.integers(1, 25))
        y, w = rng.integers(0, 2, n).astype(float), rng.random(n) + 0.1
        at, values = toxicity.isotonic(np.arange(n) * 0.5, y, w)
        assert np.allclose(values, brute_isotonic(y, w)) and (np.diff(values) >= 0).all()
    at, values = toxicity.isotonic(np.array([1.0, 1.0, 2.0]), np.array([1.0, 0.0, 1.0]), np.ones(3))
    assert at.tolist() == [1, 2] and values.tolist() == [0.5, 1]


def test_odd_tables(spark, fitted):
    *_, model = fitted
    got = toxicity.score(odd(spark), model)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"] and got.count() == odd(spark).count()
    assert all(0 <= r.score <= 1 for r in got.collect())
    assert toxicity.score(empty(spark), model).count() == 0
    none = spark.createDataFrame([], "doc_id long, toxic int")
    for labels, fixed in ((none, 0.0), (spark.createDataFrame([(i, 1) for i in range(16)], "doc_id long, toxic int"), 1.0)):
        assert {r.score for r in toxicity.score(odd(spark), toxicity.learn(odd(spark), labels)).collect()} == {fixed}
    both = spark.createDataFrame([(i, t, "x") for i in range(16) for t in (0, 1)], "doc_id long, toxic int, label string")
    assert toxicity.score(odd(spark), toxicity.learn(odd(spark), both)).count() == odd(spark).count()


def test_given_documents(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic")
    got = queries.QUERIES["op12_toxicity"](spark, SF).join(labels, "doc_id").filter("held_out").collect()
    assert sum(r.predicted == r.toxic for r in got) >= 0.9 * len(got)
