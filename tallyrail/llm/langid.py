"""Language ID by compression: the language whose dictionary makes a text smallest.

Learning takes a bounded, spread sample of labelled texts per language (`SAMPLE_TEXTS` hash buckets, of each one text and of that a run of
at most `SAMPLE_CHARS` characters at a place chosen by hash) and makes of it one raw-content zstandard dictionary of at most `DICT_BYTES`
per language, at most `MAX_LANGS` languages. Every sampled run gives an equal share of the dictionary, with all buckets filled 192 bytes, again
from a place chosen by hash; room that short runs leave goes to the rest of longer ones. A text is
folded to lower case, reduced to letters and single spaces, cut into pieces of `PIECE` bytes, and every piece of the whole text is
compressed with each language's dictionary. The language with the smallest total wins; the margin to the second is the score, and
`rejected` is set where it is narrow.

Rows are classified one by one inside tasks; the only shuffle is the sample's, of at most languages x buckets rows.

Defined results: a null text or one without a letter is `und` with score 0 and rejected; ties go to the language with more training documents, then the
alphabetically first; if nothing was learned every text is `und`. A null doc_id is not held out and not learned from. Repeated rows give repeated rows, repeated
texts fill one bucket of the sample. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyrail.llm.common import fold, sized, small_batches

FOLDS, HELD_OUT = 3, 1
SAMPLE_TEXTS, SAMPLE_CHARS = 512, 2048
DICT_BYTES = 96 << 10
MAX_LANGS = 256
PIECE = 1024
LEVEL = 6  # lower levels miss the short matches that tell languages apart
MARGIN = 0.01
UNKNOWN = "und"

_OTHER = re.compile(r"[\W\d_]+")


def folded(text: str | None) -> bytes:
    """Lower-case letters of a text, words parted by one space; empty if it has no letter."""
    line = _OTHER.sub(" ", (text or "").lower()).strip()
    return line.encode("utf-8", "replace") if any(c.isalpha() for c in line) else b""


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(fold(doc_id, FOLDS) == HELD_OUT, F.lit(False))


def _turned(line: bytes, order: int, share: int) -> bytes:
    """The line from a place on that `order` chooses, with `share` bytes after it if it has as many; what was before comes last."""
    at = order % max(1, len(line) - share + 1)
    return line[at:] + b" " + line[:at] if at else line


def learn(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> dict[str, bytes]:
    """Dictionary content by language, most frequent language first, from the labelled documents that are not held out."""
    named = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang"))
    rows = named.filter(F.col("lang").isNotNull() & (fold("doc_id", FOLDS) != HELD_OUT) & F.col("text").rlike(r"\p{L}"))
    # Of each bucket the text with the smallest hash: the same sample however the rows are dealt. Hashes are compared first, so
    # that no texts are sorted or shuffled but the chosen ones.
    keyed = rows.select("lang", F.pmod(F.xxhash64("text"), F.lit(SAMPLE_TEXTS)).alias("bucket"),
                        F.xxhash64("text", F.lit(1)).alias("order"), "text")
    least = sized(keyed.groupBy("lang", "bucket").agg(F.min("order").alias("order"), F.count("*").alias("n")), "language-sample")
    spare = F.greatest(F.length("text") - SAMPLE_CHARS, F.lit(0))
    run = F.substr("text", F.pmod(F.xxhash64("text", F.lit(2)), spare + 1).cast("int") + 1, F.lit(SAMPLE_CHARS))
    sample = keyed.join(least, ["lang", "bucket", "order"]).groupBy("lang", "bucket", "order", "n").agg(F.min(run).alias("text"))
    texts: dict[str, list[tuple[int, bytes]]] = {}
    counts: dict[str, int] = {}
    for row in sample.limit(MAX_LANGS * SAMPLE_TEXTS).collect():
        texts.setdefault(row.lang, []).append((row.order, folded(row.text)))
        counts[row.lang] = counts.get(row.lang, 0) + row.n
    out = {}
    for name in sorted(counts, key=lambda n: (-counts[n], n)):
        found = texts[name]
        share = max(64, DICT_BYTES // len(found))
        found = [(order, _turned(t, order, share)) for order, t in sorted(found)]
        # Short samples leave room that a second round over the longer ones fills.
        content = [t[:share] for _, t in found]
        room = DICT_BYTES - sum(map(len, content))
        for _, t in found:
            if room <= 0:
                break
            content.append(t[share:share + room])
            room -= len(content[-1])
        out[name] = b" ".join(content)[:DICT_BYTES]
    return out


class Classifier:
    """Compressors of all languages; made once per task."""

    def __init__(self, dictionaries: dict[str, bytes]):
        self.langs, self.tools = list(dictionaries), []
        for name in self.langs:
            content = zstandard.ZstdCompressionDict(dictionaries[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(level=LEVEL)
            self.tools.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=content, write_content_size=False, write_checksum=False))

    def sizes(self, line: bytes) -> list[int]:
        pieces = [line[i:i + PIECE] for i in range(0, len(line), PIECE)]
        return [sum(len(tool.compress(p)) for p in pieces) for tool in self.tools]

    def predict(self, text: str | None) -> tuple[str, float]:
        line = folded(text)
        if not line or not self.tools:
            return UNKNOWN, 0.0
        sizes = self.sizes(line)
        order = sorted(range(len(sizes)), key=sizes.__getitem__)
        if len(order) == 1:
            return self.langs[0], 1.0
        return self.langs[order[0]], 1.0 - sizes[order[0]] / sizes[order[1]]


def predicted(dictionaries: dict[str, bytes], text: Column) -> Column:
    """A struct (lang, score) per text."""
    @F.pandas_udf("lang string, score double")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        tool = Classifier(dictionaries)
        for batch in texts:
            yield pd.DataFrame([tool.predict(t) for t in batch], columns=["lang", "score"])
    return of(text)


def rejected(prediction: str, margin: float = MARGIN) -> Column:
    return (F.col(f"{prediction}.lang") == UNKNOWN) | (F.col(f"{prediction}.score") < margin)


def classify(docs: DataFrame, dictionaries: dict[str, bytes], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) per document."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), predicted(dictionaries, F.col(f"`{text}`")).alias("p"))
    return rows.select("doc_id", held_out().alias("held_out"), F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"),
                       rejected("p").alias("rejected"))


def keep(docs: DataFrame, dictionaries: dict[str, bytes], margin: float = MARGIN, text: str = "text") -> DataFrame:
    """The documents with a clear language, with their own columns only."""
    small_batches(docs.sparkSession)
    row = docs.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("_row"))
    judged = row.withColumn("_p", predicted(dictionaries, F.col(f"_row.`{text}`")))
    return judged.filter(~rejected("_p", margin)).select("_row.*")
