"""Benchmark decontamination by a distributed positional inverted index.

1. Every distinct window of consecutive benchmark words is a phrase. All corpus words that occur in a phrase are counted, over all
   documents, which ranks a phrase's terms by rarity.
2. The index stores the postings (term, document, position) of each phrase's two rarest terms; postings of a rarest term also hold the
   words around it.
3. A phrase's start positions follow from its rarest term's postings; they are intersected with the second term's postings, shifted by
   the distance of the two terms (`slop` widens that to proximity). What is left is compared word by word with the stored context.

Only built-in Spark functions. Postings are keyed by term, document and position, so a term or a passage that fills a third of the
corpus is spread evenly; the phrase tables are broadcast only if their counted size is small. No text is shuffled.

Defined results: a null or empty text has no words; a benchmark item with null or empty text has no phrases; items of fewer words than
the window are one phrase; an item with null id counts as the id ''. Repeated rows of documents each get the same result, repeated items
count once by id. Empty tables give no hits. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyrail.llm.common import NON_WORD, ascii_lower, let, sized, stored, text_or_empty

WINDOW = 10


def words_of(text: str) -> Column:
    """A text's words: digits, letters a-z after lower-casing, and all characters beyond ASCII."""
    return F.array_remove(F.split(ascii_lower(text_or_empty(text)), NON_WORD), "")


def keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, text_hash, text): together the key of a document, also where ids repeat."""
    return docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")).withColumn(
        "text_hash", F.xxhash64("text"))


def phrases(items: DataFrame, window: int, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(phrase, item_id): every window of an item's words, joined by spaces."""
    def cut(words: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(words) - window + 1, F.lit(1)))
        return F.when(F.size(words) > 0, F.transform(starts, lambda i: F.array_join(F.slice(words, i, window), " ")))
    named = items.select(F.coalesce(F.col(f"`{item_id}`").cast("string"), F.lit("")).alias("item_id"),
                         F.col(f"`{text}`").alias("text"))
    return named.select("item_id", F.explode(let(words_of("text"), cut)).alias("phrase")).distinct()


def ranked_terms(docs: DataFrame, phrase: DataFrame) -> DataFrame:
    """Per phrase that can occur: its length, and term and offset of its rarest and second rarest word."""
    places = phrase.select("phrase", F.posexplode(F.split("phrase", " ")).alias("at", "term"))
    terms = sized(places.select("term").distinct(), "terms")
    counts = docs.select(F.explode(words_of("text")).alias("term")).join(terms, "term").groupBy("term").agg(
        F.count("*").alias("n"))
    ordered = F.sort_array(F.collect_list(F.struct("n", "at", "term")))
    return (places.join(counts, "term", "left").groupBy("phrase").agg(
        F.count("*").alias("len"), F.count("n").alias("known"), ordered.alias("o")).filter("len = known")
        .select("phrase", F.col("len").cast("int").alias("len"),
                F.get("o", F.lit(0))["term"].alias("first"), F.get("o", F.lit(0))["at"].alias("first_at"),
                F.get("o", F.lit(1))["term"].alias("second"), F.get("o", F.lit(1))["at"].alias("second_at")))


def index(docs: DataFrame, ranked: DataFrame, window: int) -> DataFrame:
    """Postings (term, doc_id, text_hash, at) of the ranked terms; `context` holds the words around a rarest term."""
    wanted = ranked.select(F.col("first").alias("term"), F.lit(1).alias("lead")).union(
        ranked.filter("second IS NOT NULL").select("second", F.lit(0)))
    anchors = sized(wanted.groupBy("term").agg(F.max("lead").alias("lead")), "anchors")
    places = docs.select("doc_id", "text_hash", words_of("text").alias("words")).select(
        "doc_id", "text_hash", "words", F.posexplode("words").alias("at", "term"))
    begin = F.greatest(F.col("at") - (window - 1), F.lit(0))
    around = F.when(F.col("lead") == 1, F.slice("words", begin + 1, 2 * window - 1))
    found = places.join(anchors, "term").select("term", "doc_id", "text_hash", "at", begin.alias("begin"), around.alias("context"))
    return stored(found, "postings")


def matches(docs: DataFrame, phrase: DataFrame, window: int = WINDOW, slop: int = 0) -> DataFrame:
    """(doc_id, text_hash, phrase, start, len, exact) of keyed documents.

    With `slop` 0 only exact phrases. Otherwise also places where the two rarest terms stand within `slop` words of the distance
    they have in the phrase (`exact` false).
    """
    ranked = sized(ranked_terms(docs, phrase), "phrases")
    postings = index(docs, ranked, window)
    key = ["doc_id", "text_hash"]
    leads = postings.filter("context IS NOT NULL").select(
        F.col("term").alias("first"), *key, (F.col("at")).alias("lead_at"), "begin", "context").join(ranked, "first").withColumn(
        "start", F.col("lead_at") - F.col("first_at")).filter("start >= 0" if not slop else "true")
    other = postings.select(F.col("term").alias("o_term"), F.col("doc_id").alias("o_doc"), F.col("text_hash").alias("o_hash"),
                            F.col("at").alias("o_at")).distinct()
    same = (F.col("second") == F.col("o_term")) & F.col("doc_id").eqNullSafe(F.col("o_doc")) & (F.col("text_hash") == F.col("o_hash"))
    place = F.col("start") + F.col("second_at")
    near = F.col("o_at") == place if not slop else F.col("o_at").between(place - slop, place + slop)
    pairs = leads.filter("second IS NOT NULL").join(other, same & near, "left_semi")
    both = pairs.union(leads.filter("second IS NULL"))
    inside = F.slice("context", F.greatest(F.col("start") - F.col("begin"), F.lit(0)) + 1, F.col("len"))
    whole = (F.col("start") >= 0) & (F.array_join(inside, " ") == F.col("phrase"))
    out = both.select(*key, "phrase", "start", "len", whole.alias("exact")).distinct()
    return out if slop else out.filter("exact")


def _words_in(spans: Column) -> Column:
    """Words inside the union of (start, len) spans."""
    def total(ordered: Column) -> Column:
        zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))

        def add(state: Column, span: Column) -> Column:
            end = F.greatest(state["end"], span["start"] + span["len"])
            return F.struct((state["n"] + end - F.greatest(state["end"], span["start"])).alias("n"), end.alias("end"))
        return F.aggregate(ordered, zero, add)["n"]
    return total(F.sort_array(spans))


def hits(docs: DataFrame, items: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text",
         item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per distinct document that holds a phrase: (doc_id, text_hash, n_hit, items), items sorted as strings."""
    phrase = stored(phrases(items, window, item_id, item_text), "item-phrases")
    found = stored(matches(keyed(docs, doc_id, text), phrase.select("phrase").distinct(), window), "matches")
    key = ["doc_id", "text_hash"]
    spans = found.groupBy(*key).agg(_words_in(F.collect_set(F.struct("start", "len"))).cast("bigint").alias("n_hit"))
    named = found.select(*key, "phrase").distinct().join(phrase, "phrase").groupBy(*key).agg(
        F.sort_array(F.collect_set("item_id")).alias("items"))
    other = named.select(F.col("doc_id").alias("o_doc"), F.col("text_hash").alias("o_hash"), "items")
    return spans.join(other, F.col("doc_id").eqNullSafe(F.col("o_doc")) & (F.col("text_hash") == F.col("o_hash"))).select(
        *key, "n_hit", "items")


def report(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document: words, hit words, items found and whether it is contaminated."""
    base = keyed(docs, "doc_id", "text").select("doc_id", "text_hash", F.regexp_count(
        ascii_lower(text_or_empty()), F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")).cast("bigint").alias("n_words"))
    found = hits(docs, items, window).select(F.col("doc_id").alias("o_doc"), F.col("text_hash").alias("o_hash"), "n_hit", "items")
    joined = base.join(found, F.col("doc_id").eqNullSafe(F.col("o_doc")) & (F.col("text_hash") == F.col("o_hash")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("bigint"))
    listed = F.coalesce(F.array_join("items", ","), F.lit(""))
    return joined.select("doc_id", "n_words", n_hit.alias("n_hit"),
                         F.coalesce(F.size("items"), F.lit(0)).cast("bigint").alias("n_items"),
                         F.sha2(listed.cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def keep(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents without any benchmark phrase, with their own columns."""
    bad = sized(hits(docs, items, window).select("doc_id", "text_hash"), "contaminated")
    row = docs.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("_row"))
    return row.join(bad, F.col("_row.doc_id").eqNullSafe(bad["doc_id"]) & (F.xxhash64("_row.text") == bad["text_hash"]),
                    "left_anti").select("_row.*")
