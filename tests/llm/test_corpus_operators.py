"""Operators over a whole corpus, and the pipeline, against brute force on small and odd tables."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import public_tokenizers
import pytest
import xxhash

import __spark_entry__ as driver
import corpus_pipeline
import numpy as np
from tallyrail.llm import common, decontam, lattice, queries, simhash
from test_text_operators import empty, odd

SF = "/root/testdata/sf0.001"
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def brute_fingerprint(text, shingle=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    parts = [" ".join(words[i:i + shingle]) for i in range(max(1, len(words) - shingle + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(edges, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def test_fingerprints(spark):
    got = simhash.fingerprints(odd(spark))
    texts = {r.doc_id: r.text for r in odd(spark).collect() if r.doc_id != 3}
    rows = got.collect()
    assert len(rows) == odd(spark).count()
    for r in rows:
        if r.doc_id in texts:
            assert r.fp & (1 << 64) - 1 == brute_fingerprint(texts[r.doc_id])
    rng = random.Random(0)
    long = " ".join(rng.choice("abcdefgh") * rng.randrange(1, 4) for _ in range(40_000))  # more than one chunk of shingles
    assert simhash.fingerprint(long) & (1 << 64) - 1 == brute_fingerprint(long)


def test_links_are_exactly_those_within_three_bits(spark):
    rng = random.Random(1)
    fps = {rng.getrandbits(64) for _ in range(60)}
    for fp in list(fps):
        for flips in range(1, 7):
            fps.add(fp ^ sum(1 << b for b in rng.sample(range(64), flips)))
    signed = sorted(f - (1 << 64) if f >> 63 else f for f in fps | {0, 7, (1 << 64) - 1})
    got = {tuple(r) for r in simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()}
    assert got == {(a, b) for i, a in enumerate(signed) for b in signed[i + 1:] if bin((a ^ b) & (1 << 64) - 1).count("1") <= 3}


def test_pivots_form_fewer_pairs_and_each_discards_some(spark):
    """Fingerprints that agree on 30 bits, as those of one template do: all pairs share keys of blocks alone."""
    rng = random.Random(2)
    top = rng.getrandbits(30) << 34
    fps = sorted({top | rng.getrandbits(34) for _ in range(700)})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    got = simhash.discards(df).first()
    edges = [64 * i // simhash.BLOCKS for i in range(simhash.BLOCKS + 1)]
    masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    alone = sum(math.comb(n, 2) for x, y in itertools.combinations(masks, 2) for n in Counter(f & (x | y) for f in fps).values())
    assert alone >= math.comb(700, 2) and 0 < got.formed < 0.9 * alone
    assert all(got[f"by_{i}"] > 0 for i in range(simhash.PIVOTS)) and got["any"] > 0.95 * got.formed
    links = simhash.links(df).count()
    assert got.formed - got["any"] >= got.linked >= links


def test_components_of_chains_stars_and_cliques(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, 500 + i) for i in range(1, 40)] + [(a, b) for a in range(900, 910) for b in range(a)
                                                                                         if b >= 900] + [(7, 7), (3, 2), (2, 3)]
    rng.shuffle(edges)
    want = brute_components(edges, {n for e in edges for n in e})
    got = {r.node: r.root for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def near_copies(n=40, length=120, seed=3):
    """(doc_id, text): originals, exact copies, copies with one changed word, and unrelated texts."""
    rng = random.Random(seed)
    words = ["w" + str(i) for i in range(3000)]
    rows = []
    for i in range(n):
        text = [rng.choice(words) for _ in range(length)]
        rows += [(10 * i, " ".join(text)), (10 * i + 1, " ".join(text).upper())]
        text[length // 2] = "changed"
        rows.append((10 * i + 2, "  ".join(text)))
    return rows


def test_near_duplicates(spark):
    rows = near_copies() + [(9000, None), (9001, ""), (9002, " \n"), (9002, " \n"), (None, None)]
    docs = spark.createDataFrame([(*r, "x", 0) for r in rows], "doc_id long, text string, component_id string, fp int")
    got = simhash.near_duplicates(docs).collect()
    fps = {r.doc_id: r.fp & (1 << 64) - 1 for r in got}
    edges = [(a, b) for a in fps for b in fps if a is not None and b is not None and a < b and bin(fps[a] ^ fps[b]).count("1") <= 3]
    want = brute_components(edges, [i for i in fps if i is not None])
    assert len(got) == len(rows)
    assert all(r.component_id == (9000 if r.doc_id is None else want[r.doc_id]) for r in got)
    assert simhash.near_duplicates(empty(spark)).count() == 0


def test_one_document_of_each_group_stays(spark):
    rows = near_copies() + [(9000, None), (9001, None), (9002, "a b"), (9002, "a b"), (9002, "c d"), (None, "e f"), (None, "e f"), (None, "g h")]
    docs = spark.createDataFrame([(*r, i % 3, "s") for i, r in enumerate(rows)], "doc_id long, text string, fp int, _row string")
    kept = simhash.keep(docs)
    assert kept.columns == docs.columns
    got = Counter((r.doc_id, r.text) for r in kept.collect())
    ids, texts = list(range(len(near_copies()))), [t for _, t in near_copies()]
    prints = [brute_fingerprint(t) for t in texts]
    edges = [(a, b) for a in ids for b in ids if a < b and bin(prints[a] ^ prints[b]).count("1") <= 3]
    firsts = {r for r in brute_components(edges, ids).values()}
    want = Counter([rows[i] for i in firsts] + [(9000, None), (9002, "a b"), (9002, "c d"), (None, "e f"), (None, "g h")])
    assert got == want and 40 <= len(firsts) < 80
    assert simhash.keep(empty(spark)).count() == 0


def test_kept_documents_against_brute_force(spark):
    """Chains of copies that change a word at a step, a group that holds a third of all rows, and unrelated texts."""
    rng, rows = random.Random(8), []
    for i in range(12):
        text = [f"w{i}-{j}" for j in range(400)]
        for step in range(20 if i else 100):
            rows.append((1000 * i + step, " ".join(text)))
            text[rng.randrange(400)] = f"x{i}-{step % 7}"
    prints = {d: brute_fingerprint(t) for d, t in rows}
    edges = [(a, b) for a in prints for b in prints if a < b and bin(prints[a] ^ prints[b]).count("1") <= 3]
    want = set(brute_components(edges, list(prints)).values())
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    assert {r.doc_id for r in simhash.keep(docs).collect()} == want and 12 <= len(want) < len(rows)


def spelled(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))


def brute_report(docs, items):
    phrases = defaultdict(set)
    for item, text in items:
        words = spelled(text)
        for i in range(max(1, len(words) - 9) if words else 0):
            phrases[tuple(words[i:i + 10])].add("" if item is None else str(item))
    out = []
    for doc, text in docs:
        words, hit, found = spelled(text), set(), set()
        for size in {len(p) for p in phrases}:
            for i in range(len(words) - size + 1):
                named = phrases.get(tuple(words[i:i + size]))
                if named:
                    hit.update(range(i, i + size))
                    found |= named
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc, len(words), len(hit), len(found), digest, bool(hit)))
    return sorted(out, key=repr)


def test_decontamination_against_brute_force(spark):
    rng = random.Random(5)
    word = lambda: rng.choice(["a", "b", "c", "É", "the", "x1", "rare" + str(rng.randrange(30))])
    items = [(i, " ".join(word() for _ in range(rng.choice([1, 2, 5, 10, 12, 25])))) for i in range(40)]
    items += [(3, "again a b"), (None, "no id"), (90, None), (91, ""), (92, items[0][1]), (93, "a a a a a a a a a a a a")]
    docs = []
    for i in range(120):
        text = [word() for _ in range(rng.randrange(60))]
        for _ in range(rng.randrange(3)):
            text[rng.randrange(len(text) + 1):0] = (rng.choice(items)[1] or "").upper().split()
        docs.append((i, rng.choice([" ", ", ", "\n"]).join(text)))
    docs += [(None, "no id"), (200, None), (201, ""), (5, "another, a b: No-ID"), docs[7], docs[7], (202, "a " * 5000)]
    table = spark.createDataFrame([(*d, 0, 0) for d in docs], "doc_id long, text string, n_hit int, start int").repartition(3)
    bench = spark.createDataFrame([(*i, "z") for i in items], "item_id long, text string, doc_id string")
    assert sorted(map(tuple, decontam.report(table, bench).collect()), key=repr) == brute_report(docs, items)
    kept = decontam.keep(table, bench)
    want = [r for r, d in zip(docs, [x for d in docs for x in [brute_report([d], items)[0]]]) if not d[5]]
    assert kept.columns == table.columns and sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted(want, key=repr)
    assert decontam.report(table, bench.limit(0)).filter("contaminated").count() == 0
    assert decontam.report(table.limit(0), bench).count() == 0


def test_proximity_matches(spark):
    docs = decontam.keyed(spark.createDataFrame([(1, "alpha x beta"), (2, "alpha beta"), (3, "beta alpha"), (4, "alpha q q q q beta")],
                                                "doc_id long, text string"), "doc_id", "text")
    phrase = spark.createDataFrame([("alpha beta",)], "phrase string")
    near = decontam.matches(docs, phrase, window=2, slop=2).collect()
    assert {(r.doc_id, r.exact) for r in near} == {(1, False), (2, True), (3, False)}
    assert {r.doc_id for r in decontam.matches(docs, phrase, window=2).collect()} == {2}


def brute_forward(word, weights):
    """Sum over all segmentations, by trying each."""
    line = lattice.MARK + word

    def total(at):
        if at == len(line):
            return 1.0
        out = sum(math.exp(weights[line[at:end]]) * total(end) for end in range(at + 1, len(line) + 1) if line[at:end] in weights)
        if line[at] not in weights:
            out += math.exp(sum(weights[f"<0x{b:02X}>"] for b in line[at].encode())) * total(at + 1)
        return out
    return math.log(total(0))


def lattices_of(words):
    entries = lattice.Entries(PIECES)
    return entries, lattice.Lattices(words, entries)


def random_weights(entries, seed=1):
    weights = entries.even()
    usable = np.isfinite(weights)
    weights[usable] = np.log(np.random.default_rng(seed).dirichlet(np.ones(usable.sum())) + 1e-12)
    return weights


WORDS = ["a", "the", "house", "été", "東京x", "\x00", "thanan", "thethe", "ab" * 40]


def test_forward_recursion_adds_up_all_segmentations():
    entries, tool = lattices_of(WORDS)
    weights = random_weights(entries)
    named = {name: weights[i] for i, name in entries.names.items()}
    sums = tool.forward(entries.weights_of(tool.entry, weights))[tool.last]
    for word, value in list(zip(WORDS, sums))[:-1]:
        assert value == pytest.approx(brute_forward(word, named), rel=1e-9)
    _, long = lattices_of(["ab" * 3000, "京" * 500])
    assert (long.forward(entries.weights_of(long.entry, weights))[long.last] < -3000).all()  # beyond the range of plain products


def test_expected_counts_are_how_often_entries_are_passed():
    """By trying each segmentation, and: pieces' lengths add up to the word's."""
    entries, tool = lattices_of(WORDS[:7])
    weights = random_weights(entries, 2)
    n = np.arange(1, 8).astype(float)
    passed, likelihood = tool.expected(entries.weights_of(tool.entry, weights), n)
    assert likelihood == pytest.approx(sum(m * v for m, v in zip(n, tool.forward(entries.weights_of(tool.entry, weights))[tool.last])))
    named = {name: weights[i] for i, name in entries.names.items()}
    for k, word in enumerate(WORDS[:7]):
        line, mine = lattice.MARK + word, tool.of == k
        lengths = (tool.target - tool.source)[mine]
        assert (lengths * passed[mine]).sum() == pytest.approx(n[k] * len(line))
        ways = []

        def walk(at, pieces, value):
            if at == len(line):
                ways.append((pieces, value))
            for end in range(at + 1, len(line) + 1):
                if line[at:end] in named:
                    walk(end, [*pieces, (at, end)], value + named[line[at:end]])
            if at < len(line) and line[at] not in named:
                walk(at + 1, [*pieces, (at, at + 1)], value + sum(named[f"<0x{b:02X}>"] for b in line[at].encode()))
        walk(0, [], 0.0)
        every = sum(math.exp(v) for _, v in ways)
        want = defaultdict(float)
        for pieces, value in ways:
            for piece in pieces:
                want[piece] += n[k] * math.exp(value) / every
        got = {(int(a), int(b)): p for a, b, p in zip((tool.source - tool.base[tool.of])[mine], (tool.target - tool.base[tool.of])[mine], passed[mine])}
        assert set(got) == set(want) and all(got[x] == pytest.approx(want[x], rel=1e-6) for x in want)


def test_weights_sum_to_one_and_the_likelihood_rises(spark):
    words = [(0, i, w.encode(), 5 * i + 1, True) for i, w in enumerate(WORDS)] + [(0, 99, b"never", 0, True)]
    counted = spark.createDataFrame(words, "block long, place int, word binary, n long, first boolean")
    weights, likelihoods = lattice.learned_weights(counted, PIECES, 7, rounds=6, smoothing=1e-9)
    assert np.exp(weights[np.isfinite(weights)]).sum() == pytest.approx(1)
    assert all(b > a for a, b in zip(likelihoods, likelihoods[1:]))
    # The same by hand: all training words, counted, with the weights of the last round but one.
    entries, tool = lattices_of(WORDS)
    n, hand = np.array([r[3] for r in words[:-1]], float), entries.even()
    for value in likelihoods:
        passed, likelihood = tool.expected(entries.weights_of(tool.entry, hand), n)
        assert value == pytest.approx(likelihood + 7 * hand[-1], rel=1e-9)
        counts = np.zeros(len(hand))
        for entry, p in zip(tool.entry.tolist(), passed):
            for e in [entry] if entry < lattice.SPELLED else [entries.bytes[b] for b in chr(entry - lattice.SPELLED).encode()]:
                counts[e] += p
        counts[-1] = 7
        counts[np.isfinite(entries.even())] += 1e-9
        with np.errstate(divide="ignore"):
            hand = np.log(counts / counts.sum())


def test_lattice_scores(spark, monkeypatch):
    monkeypatch.setattr(lattice, "BLOCK_WORDS", 50)
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(["The", "the", "of", "Haus", "été", "w" + str(rng.randrange(90))]) for _ in range(rng.randrange(40))))
            for i in range(90)]
    rows += [(200, None), (201, ""), (None, "the the"), rows[5], rows[5], (202, "x" * 3000), (203, "\xa0 a\x1cb")]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, n long, word int").repartition(3)
    got = lattice.score(docs, PIECES).collect()
    cut = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({i: i + 32 for i in range(65, 91)}))
    trained = [t for i, t in rows if i is not None and zlib.crc32(str(i).encode()) % 10]
    counts, ends = Counter(w for t in trained for w in cut(t)), len(trained)
    n, v = sum(counts.values()) + ends, len(counts) + 1
    assert len(got) == len(rows) and {r.train_tokens for r in got} == {n}
    texts = dict(rows)
    for r in got:
        words = cut(texts[r.doc_id])
        base = sum(math.log10((c + 0.1) / (n + 0.1 * (v + 1))) for c in [*(counts[w] for w in words), ends])
        assert (r.n_tokens, r.n_known) == (len(words) + 1, sum(w in counts for w in words) + 1)
        assert r.base_score == pytest.approx(base, rel=1e-9) and -1e6 < r.score < 0
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 10 == 0)
    table = spark.createDataFrame([(0, 0, w.encode(), c, True) for w, c in counts.items()],
                                  "block long, place int, word binary, n long, first boolean")
    weights, likelihoods = lattice.learned_weights(table, PIECES, ends)
    assert all(b > a for a, b in zip(likelihoods, likelihoods[1:]))
    for doc_id in (7, 202, 203):
        words = cut(texts[doc_id])
        entries, tool = lattices_of(words)
        want = (tool.forward(entries.weights_of(tool.entry, weights))[tool.last].sum() + weights[-1]) / math.log(10)
        assert next(r for r in got if r.doc_id == doc_id).score == pytest.approx(want, rel=1e-9)
    assert lattice.score(empty(spark), PIECES).count() == 0
    untrained = spark.createDataFrame([(None, "a b"), (None, None)], "doc_id long, text string")
    assert all(r.train_tokens == 0 and r.score < 0 and not r.held_out for r in lattice.score(untrained, PIECES).collect())


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in ("documents", "pages", "benchmark", "labels", "conversations", "embeddings"):
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    df = driver.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    cursor = duck.execute(driver.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    assert got and got == sorted((tuple(r[names.index(c)] for c in columns) for r in cursor.fetchall()), key=repr)


def test_all_queries_are_registered():
    assert {re.match(r"op(\d+)_", n)[1] for n in queries.QUERIES} == {str(i) for i in range(1, 14)}
    assert set(queries.QUERIES) | {"pipeline"} <= set(driver.queries())


def test_native_operators_have_no_python_in_their_plans(spark):
    for name in ("op5_url_filter", "op7_quality_rules", "op8_benchmark_decontamination"):
        plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow|CartesianProduct|NestedLoop", plan), name


def test_pipeline(spark):
    docs = common.table(spark, SF, "documents")
    columns, before = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES:
        after = common.stored(stage(spark, before, SF), "test-stage")
        if name != "packing":
            assert after.columns == columns
            assert after.exceptAll(before).isEmpty() and 0 < after.count() <= before.count()
            before = after
    pieces = after.collect()
    assert {p.doc_id for p in pieces} == {r.doc_id for r in before.select("doc_id").collect()}
    assert corpus_pipeline.run(spark, SF).count() == len(pieces)


def test_pipeline_on_odd_tables(spark):
    """Texts that no language is learned for go at that stage, so each stage is also given the odd rows themselves."""
    words = " ".join(f"plain{i} words{i}" for i in range(30))
    rows = [*odd(spark).collect(), (50, words, "en", *"wnsfr"), (51, words, "en", *"wnsfr"), (52, words, None, *"wnsfr")]
    for docs, n in ((spark.createDataFrame(rows, odd(spark).schema), len(rows)), (empty(spark), 0)):
        kept = {name: common.stored(stage(spark, docs, SF), "odd-stage") for name, stage in corpus_pipeline.STAGES}
        assert all(kept[name].columns == docs.columns for name in kept if name != "packing")
        assert kept["benchmark decontamination"].count() == n  # no odd text quotes the benchmark
        ids = Counter((r.doc_id, r.text) for r in kept["near duplicates"].collect())
        assert all(c == 1 for c in ids.values())
        if n:
            assert (50, words) in ids and not {(51, words), (52, words)} & set(ids)
            assert {r.doc_id for r in kept["quality rules"].collect()} >= {50, 51, 52}
            assert kept["packing"].select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
        else:
            assert all(k.isEmpty() for k in kept.values())
        for name, stage in corpus_pipeline.STAGES:
            docs = common.stored(stage(spark, docs, SF), "odd-stage")


def test_pipeline_ends_in_token_ids(spark):
    rows = [(i, " ".join(f"word{j}" for j in range(i, i + 40))) for i in range(20)]
    pieces = corpus_pipeline.pack(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF).collect()
    assert pieces and all(len(p.ids) == 4 * p.length and zlib.crc32(p.ids) == p.ids_crc32 for p in pieces if p.length == p.doc_tokens)
    assert all(len(p.ids) == 4 * p.length for p in pieces)
