"""Operators that handle one text at a time, against plain Python on small and odd tables."""

import hashlib
import random
import re
import zlib
from collections import Counter
from html import unescape as html_unescape

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyrail.llm import chat, html, langid, licenses, packing, quality, queries, urls

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, words string, n_words string, score string, fp string, _row string"
ODD_TEXTS = [None, "", " \n\t ", "one", "a b c d e " * 30, "x\n\nx\nx\n\x0b", "É é Straße 東京 𝔘", "word " * 40_000, "#" * 50, "\x00 null\x00byte",
             "A B C D E F G H I J K L M N O P", "same line\nsame line\nother", "Released under the MIT License.", "mit license mit license", "12 ² 3 ½ _"]


def odd(spark, texts=ODD_TEXTS):
    """Odd texts with null and repeated ids, repeated rows, and columns named like the operators' own."""
    rows = [(i, t, "en", "w", "n", "s", "f", "r") for i, t in enumerate(texts)]
    rows += [(None, "no id at all", None, None, None, None, None, None), (3, "id of another row", "de", *"wnsfr"), rows[4], rows[4], rows[0]]
    return spark.createDataFrame(rows, DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def measures(text):
    text = text or ""
    words, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(5)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def test_quality_measures_and_policies(spark):
    rng = random.Random(1)
    texts = ODD_TEXTS + ["".join(rng.choice(["a ", "b ", "c ", "\n", "# ", "É "]) for _ in range(rng.randrange(60))) for _ in range(60)]
    got = quality.ledger(odd(spark, texts).drop("n_words")).select(
        "text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "failed").collect()
    assert len(got) == len(texts) + 5
    for row in got:
        assert tuple(row)[1:6] == measures(row.text)
        assert bool(row.failed & 1) == (row.n_words < 10)
        assert bool(row.failed & 2) == (100 * row.n_repeat_words > 20 * row.n_words)
    assert quality.ledger(empty(spark)).count() == 0
    kept = quality.keep(odd(spark))
    assert kept.columns == odd(spark).columns
    assert kept.filter("text is null").count() == 0 and kept.filter("doc_id = 10").count() == 0  # capitals only


def test_quality_keeps_the_callers_columns(spark):
    docs = spark.createDataFrame([("a b c", 1, 2, 3, 4)], "text string, _words int, _lines int, _of_words int, _of_lines_ int")
    got = quality.measure(docs).first()
    assert (got._words, got._lines, got._of_words, got._of_lines_, got.n_words) == (1, 2, 3, 4, 3)


def test_ablations_count_each_rule(spark):
    entries = spark.createDataFrame([(b,) for b in (0, 1, 1, 3, 4, 32)], "failed long")
    got = {r.rule: (r.n_failed, r.n_only) for r in quality.ablations(entries, "web-1").collect()}
    assert got == {"few_words": (3, 2), "repeated_windows": (1, 0), "symbols": (1, 1), "capitals": (0, 0)}


@pytest.fixture(scope="module")
def spoken(spark):
    vocab = {"en": "the of and house tree water light", "de": "der die und haus baum wasser licht", "fr": "le la et maison arbre eau lumiere"}
    rng, rows = random.Random(2), []
    for i in range(240):
        lang = ("en", "de", "fr")[i % 3]
        rows.append((i, " ".join(rng.choice(vocab[lang].split()) for _ in range(60)), lang if i % 7 else None))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_language_id(spark, spoken):
    learned = langid.learn(spoken)
    assert set(learned) == {"en", "de", "fr"} and all(0 < len(d) <= langid.DICT_BYTES for d in learned.values())
    got = langid.classify(spoken, learned).collect()
    truth = {i: ("en", "de", "fr")[i % 3] for i in range(240)}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in got)
    assert sum(r.lang_pred == truth[r.doc_id] for r in got if r.held_out) > 0.95 * sum(r.held_out for r in got)
    # Only text and label of the training documents count: held-out labels change nothing.
    other = spoken.withColumn("lang", F.when(langid.held_out(), "en").otherwise(F.col("lang")))
    assert langid.learn(other) == learned
    strange = langid.classify(odd(spark), learned).collect()
    assert {r.lang_pred for r in strange if r.doc_id in (0, 1, 2, 8, 14)} == {"und"}
    assert langid.classify(empty(spark), learned).count() == 0 and langid.learn(empty(spark)) == {}
    assert {r.lang_pred for r in langid.classify(odd(spark), {}).collect()} == {"und"}
    assert langid.keep(odd(spark), learned).columns == odd(spark).columns


def test_language_is_learned_from_all_of_a_text(spark):
    letters = str.maketrans("0123456789", "abcdefghij")
    head = " ".join(f"head{i}".translate(letters) for i in range(60))
    rows = [(i, f"{head} " + " ".join(f"own{i}x{j}".translate(letters) for j in range(300)), "de") for i in range(900)]
    learned = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))["de"].split()
    own = {w for w in learned if w.startswith(b"own")}
    assert sum(map(len, own)) > 0.5 * sum(map(len, learned))
    assert {len(w) for w in own} >= {8} and len({w.split(b"x")[0] for w in own}) > 200
    assert len({w.rsplit(b"x")[-1] for w in own}) > 250  # from all places


TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def test_language_of_the_given_documents_by_plain_zstandard_calls(spark):
    """The registered query against compressing every piece of every text with every dictionary."""
    import zstandard

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    dictionaries = langid.learn(docs)
    got = {r.doc_id: r for r in queries.QUERIES["op3_language_id"](spark, SF).collect()}
    tools = [zstandard.ZstdCompressor(level=langid.LEVEL, write_content_size=False, write_checksum=False, dict_data=zstandard.ZstdCompressionDict(
        content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for content in dictionaries.values()]
    assert len(tools) > 1
    for row in docs.select("doc_id", "text").collect():
        letters = "".join(c if c.isalpha() else " " for c in (row.text or "").lower())
        line = " ".join(letters.split()).encode()
        want = ("und", 0.0)
        if line:
            sizes = [sum(len(t.compress(line[i:i + langid.PIECE])) for i in range(0, len(line), langid.PIECE)) for t in tools]
            best = sizes.index(min(sizes))
            want = list(dictionaries)[best], 1 - sizes[best] / min(s for i, s in enumerate(sizes) if i != best)
        found = got[row.doc_id]
        assert (found.lang_pred, found.score) == (want[0], pytest.approx(want[1], abs=1e-12)), row.doc_id
        assert found.held_out == (zlib.crc32(str(row.doc_id).encode()) % 3 == 1) and found.rejected == (want[1] < langid.MARGIN)


def check_packing(pieces, texts, limits, prompts=None):
    """Every id of every row in one piece, sequences gapless and inside all limits; returns the share of padding."""
    tokenizer = Tokenizer.from_file(TOKENIZER)
    sequences, by_doc = {}, {}
    for p in pieces:
        sequences.setdefault(p.sequence_id, []).append(p)
        by_doc.setdefault(p.doc_id, []).append(p)
    padded = real = 0
    for parts in sequences.values():
        at = 0
        for p in sorted(parts, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at <= limits.tokens and len(parts) <= limits.segments and sum(p.n_loss for p in parts) <= limits.loss
        real, padded = real + at, padded + (at if at & (at - 1) == 0 else limits.tokens)
    for i, text in enumerate(texts):
        lead = tokenizer.encode((prompts or {}).get(i) or "", add_special_tokens=False).ids
        ids = np.array(lead + tokenizer.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        at = 0
        for p in sorted(by_doc[i], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[at:at + p.length].tobytes())
            assert p.n_loss == max(0, p.start + p.length - max(p.start, len(lead)))
            at += p.length
        assert at == len(ids)
    return 1 - real / padded


def test_packing(spark):
    rng = random.Random(3)
    texts = ODD_TEXTS + [" ".join(rng.choice(["The", "don't", "House,", "été.", "12", "<|endoftext|>", "İ!"]) for _ in range(rng.randrange(900)))
                         for _ in range(150)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert check_packing(packing.pack(docs, TOKENIZER).collect(), texts, packing.Limits()) < 0.01
    tight = packing.Limits(tokens=256, segments=4, loss=100)
    check_packing(packing.pack(docs, TOKENIZER, tight).collect(), texts, tight)
    prompts = {i: "What is this? " * (i % 40) for i in range(len(texts))}
    asked = spark.createDataFrame([(i, t, prompts[i]) for i, t in enumerate(texts)], "doc_id long, text string, prompt string")
    found = packing.pack(asked, TOKENIZER, tight, prompt="prompt", with_ids=True).collect()
    check_packing(found, texts, tight, prompts)
    assert all(zlib.crc32(p.ids) == p.ids_crc32 for p in found)


def test_packing_of_odd_tables(spark):
    assert packing.pack(empty(spark), TOKENIZER).count() == 0
    got = packing.pack(odd(spark), TOKENIZER).collect()
    whole = Counter((p.doc_id, p.doc_tokens) for p in got if p.start == 0)
    assert sum(whole.values()) == odd(spark).count() and any(p.doc_id is None for p in got)


def spelled_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))


def test_license_scan(spark):
    rng = random.Random(4)
    extra = ["".join(rng.choice(["MIT ", "license ", "Apache-", "general\n", "public ", "x "]) for _ in range(rng.randrange(40))) for _ in range(60)]
    table = odd(spark, ODD_TEXTS + extra)
    got = licenses.scan(table).collect()
    texts = {r.doc_id: r.text for r in table.collect() if r.doc_id != 3}
    assert len(got) == table.count()
    for r in got:
        if r.doc_id == 3 or r.doc_id is None:
            continue
        words = spelled_words(texts[r.doc_id])
        places = [i for p in licenses.BASE for i in range(len(words)) if words[i:i + len(p.split())] == p.split()]
        assert (r.n_words, r.n_base) == (len(words), len(places))
        assert (r.first_word, r.last_word) == ((min(places), max(places)) if places else (None, None))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert licenses.scan(empty(spark)).count() == 0


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_license_notices_with_edits_are_found_where_they_stand():
    scanner, rng = licenses.Scanner(), random.Random(5)
    for notice, label in licenses.NOTICES.items():
        for edits in range(licenses.edits_allowed(notice) + 1):
            changed = list(notice)
            for at in rng.sample([i for i in range(1, len(notice) - 1) if notice[i] != " "], edits):
                changed[at] = "q"
            text = "Some words. " + "".join(changed).upper() + "! And more."
            found = [s for s in scanner.scan(text)["spans"] if s[0] == label]
            assert found, (notice, edits)
            start, end = found[0][2:4]
            assert edit_distance(text[start:end].lower(), found[0][1]) == found[0][4] <= licenses.edits_allowed(found[0][1])
    assert scanner.scan("the permit license of a license plate is released")["labels"] == ""


def test_license_notices_with_letters_added_at_their_ends():
    scanner = licenses.Scanner()
    for text, label in (("eclipse public licenses", "epl"), ("licensed under the mit licenses", "mit"), ("released under the bsd licenses", "bsd"),
                        ("xeclipse public license", "epl"), ("redistribution and use in source and binary forms with or without "
                                                             "modification are permittedx", "bsd")):
        for around in ("%s", "see %s here"):
            (found,) = [x for x in scanner.scan(around % text)["spans"] if x[0] == label]
            assert (around % text)[found[2]:found[3]] == text and found[4] == 1
    twice = scanner.scan("licensed under the mxt license licensed under the mit license")["spans"]
    assert [x[4] for x in twice if x[1] == "licensed under the mit license"] == [1, 0]


def test_every_notice_has_its_own_label_only():
    scanner = licenses.Scanner()
    assert scanner.scan("licensed under cc by sa 4.0")["labels"] == "cc-by-sa"
    for notice, label in licenses.NOTICES.items():
        for text in (notice, f"so: {notice.upper()}, and", f"{notice} {notice}"):
            found = scanner.scan(text)
            base = {own for phrase, own in licenses.BASE.items() if f" {phrase} " in f" {notice} "}
            assert set(found["labels"].split(",")) == base | {label}, notice
            assert found["score"] == 1.0 and {s[1] for s in found["spans"]} == {notice}


def test_overlaps_leave_the_fewest_edits():
    rng = random.Random(5)
    for _ in range(500):
        found = {(a := rng.randrange(60), a + rng.randint(1, 15), rng.choice("xyz"), rng.randrange(4)) for _ in range(rng.randrange(12))}
        want = []
        for f in sorted(found, key=lambda f: f[3]):
            if not any(g[3] < f[3] and g[0] < f[1] and f[0] < g[1] for g in want):
                want.append(f)
        assert licenses.fewest_edits(list(found)) == sorted(want)


PAGE = """<!DOCTYPE html><html><head><title>T x</title><style>p{}</style></head><body class="has-sidebar">
<header class="site-header"><h1>Site name</h1></header><nav><ul><li><a href=x>Home</a><li><a>More</a></ul></nav>
<div id="cookie-notice">We use cookies, and this is quite a long text so that it could look like an article.</div>
<div class="layout"><aside>Side text. Very long side text that talks about things.</aside>
%s
<div class="sidebar"><p>Sidebar words</p></div></div><!-- <p>hidden</p> -->
<section id="comments"><article class="comment"><p>A reader comment that is long enough to look like something.</p></article></section>
<form><label>Mail</label><input></form><footer>&copy; foot</footer><script>var a="</p><p>x";</script></body></html>"""
ARTICLE = ("<h1>Head line</h1><p>First &amp; short.</p><p>Second  paragraph\nwith <b>bold</b>ness and <a href='u'>a link</a>, long enough to "
           "count as text.</p><div class='ad'>Buy now</div><p>x &lt; y<br>z</p><ul><li>one<li>two</ul><p>End.</p>")
TEXT = ("Head line First & short. Second paragraph with boldness and a link, long enough to count as text. x < y z one two End.")


def test_html_extraction(spark):
    for shape in ("<article>%s</article>", "<main>%s</main>", "<div id='content'>%s</div>", "%s", "<div class='post'><div>%s</div></div>"):
        assert html.main_text(PAGE % (shape % ARTICLE)) == TEXT, shape
    for page, text in ((None, ""), ("", ""), ("plain &eacute;", "plain é"), ("<!-- x", ""), ("<script>a", ""), ("a < b > c", "a < b > c"),
                       ("<div class='ad'>only</div>", ""), ("<p>" * 3000 + "deep", "deep"), ("<div a='" * 2000, "<div a='" * 2000)):
        assert html.main_text(page) == " ".join(text.split())
    rows = [(1, "u", "<p>a</p>", "t", 1), (1, "u", "<p>a</p>", "t", 1), (None, None, None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars long")
    assert sorted(map(tuple, html.extract(pages).collect()), key=repr) == [(1, "u", "a", 1), (1, "u", "a", 1), (None, None, "", 0)]
    assert html.extract(pages.limit(0)).count() == 0


def test_html_keeps_all_stretches_of_text():
    long = [" ".join(f"{name}{i}" for i in range(60)) for name in "abc"]
    links = "<ul><li><a href=x>one</a><li><a href=y>two</a><li><a href=z>three</a></ul>"
    want = f"{long[0]} one two three {long[1]}"
    assert html.main_text(f"<body><p>{long[0]}</p>{links}<p>{long[1]}</p></body>") == want
    parts = "".join(f"<div class=part><p>{t}</p></div>{links}<nav><p>{t}</p></nav>" for t in long)
    assert html.main_text(f"<body><div><a href=h>Home</a></div>{parts}</body>").startswith("Home") is False
    assert all(t in html.main_text(f"<body>{parts}</body>") for t in long)


def test_html_attributes_of_any_length():
    for value in ("x" * 5000 + "<b>Buy now</b>", "a>b " * 3000, "<p>" * 4000):
        for quote in "\"'":
            assert html.main_text(f"<div data-props={quote}{value}{quote} title='a hidden gem'>Real text</div>") == "Real text"
            assert html.main_text(f"<p>Real text</p><div data-props={quote}{value}{quote} class=advert>Buy</div>") == "Real text"
    many = " ".join(f'a{i}=">"' for i in range(1000))
    assert html.main_text(f"<div {many} class='x'>Real text</div>") == "Real text"


def test_html_of_the_given_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    found = {r.page_id: r.text for r in queries.QUERIES["op6_html_extraction"](spark, SF).collect()}
    for page in pages.collect():
        inner = re.search(r"<article>(.*)</article>", page.html, re.S)[1]
        inner = re.sub(r"</?b>", "", re.sub(r"</?(?:p|h1)>|<br>", " ", inner))
        assert found[page.page_id] == " ".join(html_unescape(inner).split())


def test_line_blocks():
    def found(weights, full=(), **limits):
        return html.stretches(weights, [i in full for i in range(len(weights))], **limits)
    assert found([]) == found([0, 0]) == []
    assert found([3, 0, 0, 0, 200, 150, 0, 90, 0, 0, 0, 5]) == [(4, 8)]
    # Thin lines round a stretch are cut, those that end like a sentence are not; a gap of thin lines makes two stretches.
    assert found([10, 20, 300, 20, 10]) == [(2, 3)] and found([10, 20, 300, 20, 10], {1, 3}) == [(1, 4)]
    assert found([300, 5, 5, 5, 5, 300]) == [(0, 1), (5, 6)]
    assert found([30, 30, 30]) == [(0, 3)] and found([9, 4, 4]) == [(0, 3)]  # a short page: half of its fullest window
    assert found([30, 30, 30], surge=200, share=1.0) == [(0, 3)] and found([9, 100], surge=86, share=1.0) == [(1, 2)]


PARAGRAPHS = [" ".join(f"{name}{i}" for i in range(40)) + "." for name in ("red", "green", "blue")]


@pytest.mark.parametrize("around", [
    "<div class='has-sidebar no-comments'><article>%s</article></div>", "<div id=with-ads class='show-menu'><article>%s</article></div>",
    "<div class='sidebar'><div>%s</div></div>", "<form id=aspnetForm><div class=content>%s</div></form>", "<div class=page-comments>%s</div>",
    "<body class='sidebar-left ad'><div role=main>%s</div></body>", "<div hidden><main>%s</main></div>"])
def test_html_marks_round_all_text_are_not_believed(around):
    text = "".join(f"<p>{t}</p>" for t in PARAGRAPHS)
    page = "<html><body><nav><a href=x>Home</a></nav>" + around % (text + "<div class=ad>Buy now and save.</div>") + "<footer>Imprint.</footer>"
    assert html.main_text(page) == " ".join(PARAGRAPHS)


def test_html_names_that_only_sound_like_marks():
    for name in ("social-history", "related-work", "share-price", "banner-of-1848", "commentary", "adsorption", "menu-of-the-day", "noticeable",
                 "alert-levels", "reply-of-the-king", "navigation-by-stars", "no-ads"):
        assert not html.says_excluded(name), name
        page = f"<article><p>{PARAGRAPHS[0]}</p><section class='{name}'><p>{PARAGRAPHS[1]}</p></section><p id='{name}'>{PARAGRAPHS[2]}</p></article>"
        assert html.main_text(page) == " ".join(PARAGRAPHS), name
    for name in ("ad", "site-footer", "main_nav", "comment-list", "commentList", "cookie-banner", "sidebar-2", "social-share", "share-buttons",
                 "newsletter-box", "AdSlot", "related", "related-items", "top-banner-ad", "reply"):
        assert html.says_excluded(name), name
        page = f"<article><p>{PARAGRAPHS[0]}</p><div class='x {name}'><p>{PARAGRAPHS[1]}</p></div><p>{PARAGRAPHS[2]}</p></article>"
        assert html.main_text(page) == f"{PARAGRAPHS[0]} {PARAGRAPHS[2]}", name


def test_html_several_articles():
    page = "".join(f"<article><h2>Part {i}</h2><p>{t}</p><p>So it was</p></article><div>By the way</div>" for i, t in enumerate(PARAGRAPHS))
    assert html.main_text(page) == " ".join(f"Part {i} {t} So it was" for i, t in enumerate(PARAGRAPHS))
    # Long comments neither hide a short article nor come through.
    comments = "<div class=comments>" + "".join(f"<p>{t}</p>" for t in PARAGRAPHS * 5) + "</div>"
    assert html.main_text(f"<article><h1>Short</h1><p>A short one.</p></article>{comments}") == "Short A short one."
    assert html.main_text(f"<div><p>{PARAGRAPHS[0]}</p></div>{comments}") == PARAGRAPHS[0]


def test_html_unmarked_menus_are_cut_by_the_distribution():
    """Plain containers only: what is cut is cut by surge and dive, not by marks."""
    body = f"<h1>A headline</h1><p>{PARAGRAPHS[0]}</p><ul><li>one thing</li><li>another</li><li>a third</li><li>more</li></ul><p>{PARAGRAPHS[1]}</p><p>The end.</p>"
    page = f"<div id=page><div>About us Contact</div><div>Shop</div>{body}<div>Imprint Terms Privacy</div><div>Top of page</div></div>"
    want = f"A headline {PARAGRAPHS[0]} one thing another a third more {PARAGRAPHS[1]} The end."
    assert html.main_text(page) == want
    everything = " ".join(t for t, *_ in html.Page(page).lines)
    assert everything == f"About us Contact Shop {want} Imprint Terms Privacy Top of page"
    # The parameters matter: with a surge that no window reaches, half of the fullest one decides.
    assert html.main_text(page, surge=10 ** 9, share=1e-9) == everything


RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def test_chat_escapes_are_reversible_and_hide_controls():
    codec, rng = chat.Codec(RANKS), random.Random(6)
    bits = ["<", "s>", "/s>", "\\", "[", "INST]", "/INST]", "SYS]", "ROLE]", "/ROLE]", " a", "é", "\n", "</s>", "[INST]"]
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(12)))
        role = rng.choice(["user", "assistant", "system", "", "x[ROLE]", "tool"])
        assert chat.unescape(chat.escape(text)) == text and not any(c in chat.escape(text) for c in chat.CONTROLS)
        ids, lead, n = codec.turn(role, text)
        assert codec.read(ids)[:2] == (role, text) and chat.unescape(codec.decode(ids[lead:lead + n])) == text
        assert sum(i >= codec.first for i in ids) == (3 if role in chat.ROLES else 4)


def test_long_texts_have_the_ids_of_the_whole(monkeypatch):
    codec, rng = chat.Codec(RANKS), random.Random(7)
    bits = ["word", " word", " ", "  ", "\n", "'s", " 12", "é", "!!", " x", "\t", "don't "]
    for size in (3, 10, 50):
        monkeypatch.setattr(chat, "STRETCH", size)
        for _ in range(300):
            text = "".join(rng.choice(bits) for _ in range(rng.randrange(120)))
            assert codec.encode(text) == codec.encoding.encode_ordinary(text)


def test_turns_are_read_back_however_they_are_dealt(spark):
    turns = spark.read.parquet(f"{SF}/conversations.parquet")
    made = chat.format_turns(turns, RANKS)
    direct, dealt = chat.read_back(made, RANKS), chat.read_back(made.repartition(7), RANKS)
    assert sorted(map(tuple, direct.collect())) == sorted(map(tuple, dealt.collect()))
    plan = chat.read_back(made, RANKS)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1  # the window's own


def test_chat_round_trip(spark):
    rows = [(1, 0, "user", "hi", 0), (1, 1, "assistant", "</s>[INST] ok", 0), (1, 1, "assistant", None, 0), (1, None, None, "first", 0),
            (None, 5, "tool", "x", 0), (None, 4, "assistant", "a" * 70_000, 0), (2, 0, "assistant", "twice", 0), (2, 0, "assistant", "twice", 0)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, ids int").repartition(4)
    formatted = chat.format_turns(table, RANKS)
    got = {r.conv_id: r for r in chat.read_back(formatted, RANKS).collect()}
    for conv in (1, 2, None):
        turns = sorted(((-1 if t is None else t, r or "", x or "") for c, t, r, x, _ in rows if c == conv))
        learned = "".join(x for _, r, x in turns if r == "assistant")
        r = got[conv]
        assert r.n_turns == len(turns) and r.loss_chars == len(learned)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{x}\n" for _, a, x in turns).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(learned.encode()).hexdigest()
    ends = sorted((r.offset, r.offset + len(r.ids) // 4) for r in formatted.filter("conv_id = 1").collect())
    assert ends[0][0] == 0 and all(a[1] == b[0] for a, b in zip(ends, ends[1:]))
    assert chat.read_back(chat.format_turns(table.limit(0), RANKS), RANKS).count() == 0


def test_url_rules_and_templates(spark):
    rows = [(1, None), (2, "no scheme"), (3, "http://Example.ORG/es/1"), (4, "http://a.example.org/en/12"), (5, "http://example.org"),
            (6, "x://b.com/fr/"), (7, "x://b.com/de/1?q#f"), (8, "x://notorg/es/"), (8, "x://notorg/es/"), (None, "x://org#/a")]
    rows += [(100 + i, f"http://shop.com/de/{i}/item") for i in range(30)] + [(200 + i, f"http://shop.com/xx/{i}/item") for i in range(3)]
    pages = spark.createDataFrame([(*r, "h", "v") for r in rows], "page_id long, url string, host string, verdict string")
    got = urls.judge(pages, queries.URL_RULES).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    assert (by[1].host, by[1].path, by[2].host) == ("", "", "") and by[1].rule is None and by[1].verdict == "allow"
    assert [by[i].rule for i in (3, 4, 5, 6, 7, 8)] == ["example.org/es/", "example.org/en/1", None, "com/fr/", "com/de/", None]
    assert [by[i].verdict for i in (3, 4, 5, 6, 7)] == ["block", "block", "allow", "allow", "block"]
    assert {by[200 + i].template for i in range(3)} == {"/*/{n}/item"} and by[200].verdict == "block"  # all that is known of the host
    assert urls.judge(pages.limit(0), queries.URL_RULES).count() == 0


def test_url_labels_reach_branches_without_any(spark):
    """A host's blocked pages speak for its other ones, and less for its neighbours; hosts of another top level hear nothing."""
    rows = [(i, f"http://a.shop.com/de/{i}") for i in range(40)] + [(100, "http://a.shop.com/en/x"), (101, "http://b.shop.com/en/x"),
                                                                  (102, "http://c.net/de/1"), (103, "http://other.com/en/x")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    by = {r.page_id: r for r in urls.judge(pages, queries.URL_RULES, reject=0.9).collect()}
    some = (40 + 4 * 0.5) / 44  # the labels count once, wherever they are first met
    assert by[100].purity == pytest.approx(some) and by[101].purity == pytest.approx(some) and by[103].purity == pytest.approx(some)
    assert by[0].purity == pytest.approx(some) and by[102].purity == 0.5
    assert [by[i].verdict for i in (100, 101, 102, 103)] == ["block", "block", "allow", "block"]


def test_url_held_out_figures(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    got = urls.held_out_figures(pages, queries.URL_RULES).first()
    assert got.hits + got.misses > 40 and got.agreed + got.false_blocks > 100
    assert got.hits >= 0.9 * (got.hits + got.false_blocks) and got.hits >= 0.25 * (got.hits + got.misses)
    assert urls.held_out_figures(pages.limit(0), queries.URL_RULES).first().hits == 0


def test_a_branch_that_differs_keeps_its_own_template(spark):
    counted = [("h.com", f"/{branch}/{{n}}", 100, 50, blocked) for branch, blocked in (("a", 50), ("b", 1), ("c", 2), ("d", 0))]
    tree = urls.templates(spark.createDataFrame(counted, "host string, path string, n long, labelled long, blocked long"))
    got = {r.path: r.template for r in tree.collect()}
    assert got["/a/{n}"] == "/a/{n}"
    many = [("m.com", f"/p/{w}", 1, 0, 0) for w in (f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(120))]
    tree = urls.templates(spark.createDataFrame(many, "host string, path string, n long, labelled long, blocked long"))
    assert {r.template for r in tree.collect()} == {"/p/*"}
