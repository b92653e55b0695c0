"""Rule bitmask ledger: every quality rule is evaluated once per document; policies only look at bits.

`ledger` measures a text and sets one bit per rule that fails. A policy is a named, versioned set of rules, so applying another
version, or asking what each rule rejects (`ablations`), is bitwise arithmetic on the stored ledger and never reads a text again.

Everything is built-in Spark expressions on one row at a time: no shuffle, so neither a hot source nor a group of copies matters.
Repeated windows are compared by a 64-bit hash of their words' 64-bit hashes, within one document only.

Defined results: a null or empty text has no words (all measures 0) and fails `few_words`; repeated rows give repeated rows; an empty
table gives an empty table. Columns of the input with the ledger's names are replaced.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyrail.llm.common import SPACES, let, text_or_empty

WINDOW = 5

# Measures in whole numbers, so that rules are exact in any engine.
RULES: dict[str, str] = {
    "few_words": "n_words < 10",
    "repeated_windows": "100 * n_repeat_words > 20 * n_words",
    "symbols": "n_symbols * 4 > n_words",
    "repeated_lines": "100 * n_dup_lines > 30 * n_lines",
    "capitals": "n_upper * 2 > word_chars",
    "long_words": "word_chars > 100 * n_words",
}
BASE = ("few_words", "repeated_windows")
POLICIES: dict[str, tuple[str, ...]] = {
    "base-1": BASE,
    "web-1": (*BASE, "symbols", "capitals"),
    "web-2": (*BASE, "symbols", "repeated_lines", "capitals"),
    "strict-1": (*BASE, "symbols", "repeated_lines", "capitals", "long_words"),
}
POLICY = "web-1"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper")


def mask(rules: tuple[str, ...] | list[str], among: Mapping[str, str] = RULES) -> int:
    """The bits of some rules; a rule's bit is its place in `among`."""
    names = list(among)
    return sum(1 << names.index(r) for r in set(rules))


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACES), "")


def _window_keys(words: Column, size: int) -> Column:
    """One 64-bit key per window of `size` consecutive words."""
    def keys(hashes: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(hashes) - size), lambda i: F.xxhash64(
            *[F.get(hashes, i + k) for k in range(size)]))
        return F.when(F.size(hashes) >= size, windows).otherwise(F.array().cast("array<bigint>"))
    return let(F.transform(words, lambda w: F.xxhash64(w)), keys)


def _covered(keys: Column, size: int) -> Column:
    """Words inside windows whose key occurs twice or more."""
    def repeated(ordered: Column) -> Column:
        def place(pair: Column, i: Column) -> Column:
            same = [F.get(ordered, i + step)["key"] == pair["key"] for step in (-1, 1)]
            return F.when(F.coalesce(same[0], F.lit(False)) | F.coalesce(same[1], F.lit(False)), pair["place"])
        return F.sort_array(F.filter(F.transform(ordered, place), lambda p: p.isNotNull()))

    def total(places: Column) -> Column:
        # Windows overlap: each adds the words up to the next repeated window, at most `size`.
        steps = F.transform(places, lambda p, i: F.least(F.coalesce(F.get(places, i + 1) - p, F.lit(size)), F.lit(size)))
        return F.aggregate(steps, F.lit(0).cast("bigint"), lambda a, x: a + x)

    pairs = F.sort_array(F.transform(keys, lambda k, i: F.struct(k.alias("key"), i.alias("place"))))
    several = let(pairs, lambda ordered: let(repeated(ordered), total))
    return F.when(F.size(F.array_distinct(keys)) == F.size(keys), F.lit(0).cast("bigint")).otherwise(several)


def measure(docs: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """`docs` with the columns of `MEASURES`, all 64-bit."""
    value = text_or_empty(text)

    def parts(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("bigint").alias("n_words"),
            F.length(F.array_join(words, "")).cast("bigint").alias("word_chars"),
            let(_window_keys(words, window), lambda keys: _covered(keys, window)).alias("n_repeat_words"))

    def line_parts(lines: Column) -> Column:
        return F.struct(F.size(lines).cast("bigint").alias("n_lines"),
                        (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint").alias("n_dup_lines"))

    lines = F.filter(F.split(value, "\n"), lambda line: line.rlike(r"[^ \t-\r]"))
    of_words, of_lines = (next(n for n in (name + "_" * i for i in range(len(docs.columns) + 1)) if n not in docs.columns)
                          for name in ("_of_words", "_of_lines"))
    out = docs.withColumns({of_words: let(_words(value), parts), of_lines: let(lines, line_parts)})
    return out.withColumns({
        "n_words": F.col(f"{of_words}.n_words"), "word_chars": F.col(f"{of_words}.word_chars"),
        "n_repeat_words": F.col(f"{of_words}.n_repeat_words"),
        "n_lines": F.col(f"{of_lines}.n_lines"), "n_dup_lines": F.col(f"{of_lines}.n_dup_lines"),
        "n_symbols": F.regexp_count(value, F.lit(r"[#*$%&|<>]")).cast("bigint"),
        "n_upper": F.regexp_count(value, F.lit(r"\p{Lu}")).cast("bigint"),
    }).drop(of_words, of_lines)


def ledger(docs: DataFrame, text: str = "text", rules: Mapping[str, str] = RULES) -> DataFrame:
    """`docs` with all measures and `failed`: bit i is set if rule i holds against the document."""
    bits = [F.when(F.expr(rule), F.lit(1 << i).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
            for i, rule in enumerate(rules.values())]
    failed = bits[0]
    for bit in bits[1:]:
        failed = failed.bitwiseOR(bit)
    return measure(docs, text).withColumn("failed", failed)


def fails(policy: str, failed: str = "failed") -> Column:
    """True where the policy's rules reject the document."""
    return F.col(failed).bitwiseAND(F.lit(mask(POLICIES[policy])).cast("bigint")) != 0


def ablations(entries: DataFrame, policy: str, failed: str = "failed") -> DataFrame:
    """Per rule of a policy: documents that fail it, and those that only it rejects.

    Documents are first counted per bit pattern, so at most 2^rules rows leave a task.
    """
    bits = F.col(failed).bitwiseAND(F.lit(mask(POLICIES[policy])).cast("bigint"))
    patterns = entries.groupBy(bits.alias("bits")).agg(F.count("*").alias("n"))
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(mask((r,))).cast("bigint").alias("bit")) for r in POLICIES[policy]])
    hit = F.col("bits").bitwiseAND(F.col("r.bit")) != 0
    return (patterns.withColumn("r", F.explode(rules)).groupBy(F.col("r.rule").alias("rule"))
            .agg(F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("n_failed"),
                 F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_only")))


def keep(docs: DataFrame, policy: str = POLICY, text: str = "text") -> DataFrame:
    """The documents a policy keeps, with their own columns only."""
    names = [f"`{c}`" for c in docs.columns]
    held = docs.select(F.col(f"`{text}`").alias("text"), F.struct(*names).alias("_row"))
    return ledger(held).filter(~fails(policy)).select("_row.*")
