"""SimHash near-duplicates by pivot distance tables.

Every text gets a 64-bit fingerprint of its word shingles. Each distinct fingerprint is stored with its pivot table: the Hamming
distances to 16 fixed reference fingerprints, packed into two integers. Distances obey the triangle inequality, so two fingerprints
within `bits` of each other differ by at most `bits` in every coordinate of their tables: pairs whose largest coordinate difference is
greater are discarded, and survivors are verified by their exact distance.

Pairs are never formed by comparing all: a fingerprint is looked up under the runs of bits that it is cut into (`bits` differing bits leave
`blocks - bits` of the runs equal, so any linked pair agrees on one of the combinations of that many runs: exact, by the pigeonhole
principle) and, in the same key, under a pivot coordinate in steps of `bits + 1`. Two coordinates that differ by `bits` at most lie in the same step
or in neighbouring ones, so one side is looked up in its own step and the other in its own and the one below. Each combination uses
another pivot. The coordinates that are not in the key then discard pairs, and `discards` counts how many each one does. Work is done on
distinct fingerprints only; copies never meet each other.

`keep` leaves one document of each component, for a pipeline.

Defined results: a null or empty text, or one without words, has fingerprint 0 and is linked like any other; texts of fewer words than
a shingle have their whole word sequence as the only shingle. Repeated rows give repeated rows. A null doc_id can be linked, but never
names a component unless all its documents' ids are null. Empty tables give empty tables. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations
from operator import and_

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyrail.llm.common import components, sized, small_batches, stored

SHINGLE, SEED, BITS = 3, 42, 3
BLOCKS = 5
PIVOTS = 16
#: Shingles whose bits are counted at once.
CHUNK = 1 << 14


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The signed 64-bit fingerprint of a text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # A-Z only; splits at \x20 and \x09-\x0D
    if not words:
        return 0
    size = min(shingle, len(words))
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    ones, total = np.zeros(64, np.int64), len(words) - size + 1
    digest = xxhash.xxh64_intdigest
    for at in range(0, total, CHUNK):
        to = min(at + CHUNK, total)
        spans = zip(starts[at:to].tolist(), ends[at + size - 1:to + size - 1].tolist())
        hashes = np.fromiter((digest(line[a:b], SEED) for a, b in spans), np.uint64, to - at)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > total, bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_hash, fp) of every row."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("bigint")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([fingerprint(t, shingle) for t in batch], dtype="int64")

    return docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.xxhash64(F.col(f"`{text}`")).alias("text_hash"),
                       of(F.col(f"`{text}`")).alias("fp"))


def _distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def pivot_tables(fps: DataFrame) -> DataFrame:
    """fp with `near` and `far`: eight distances to reference fingerprints in each, a byte apiece."""
    references = [xxhash.xxh64_intdigest(i.to_bytes(8, "little"), SEED) for i in range(PIVOTS)]
    signed = [r - (1 << 64) if r >> 63 else r for r in references]

    def packed(part: list[int]) -> Column:
        out = F.lit(0).cast("bigint")
        for place, reference in enumerate(part):
            out = out.bitwiseOR(F.shiftleft(_distance(F.col("fp"), F.lit(reference).cast("bigint")).cast("bigint"), 8 * place))
        return out
    return fps.withColumns({"near": packed(signed[:PIVOTS // 2]), "far": packed(signed[PIVOTS // 2:])})


def _coordinate(side: str, number: int) -> Column:
    half, place = ("near", "far")[number * 2 // PIVOTS], number % (PIVOTS // 2)
    return F.shiftright(F.col(f"{side}{half}"), 8 * place).bitwiseAND(F.lit(127))


def _within(number: int, bits: int) -> Column:
    """Whether a pivot's coordinates of a and b differ by at most `bits`."""
    return F.abs(_coordinate("a.", number) - _coordinate("b.", number)) <= bits


def index_keys(bits: int, blocks: int, below: bool) -> Column:
    """Array of (table, key, step, below): the fingerprint under every combination of `blocks - bits` runs of bits and a step of that
    combination's pivot. With `below` also under the step below its own, marked so."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    runs = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(blocks)]
    keys = []
    for n, chosen in enumerate(combinations(runs, blocks - bits)):
        mask = sum(chosen)
        mask = mask - (1 << 64) if mask >> 63 else mask
        step = F.floor(_coordinate("", n % PIVOTS) / (bits + 1)).cast("int")
        for shift in (0, 1) if below else (0,):
            keys.append(F.struct(F.lit(n).alias("table"), F.col("fp").bitwiseAND(F.lit(mask).cast("bigint")).alias("key"),
                                 (step - shift).alias("step"), F.lit(shift == 1).alias("below")))
    return F.array(*keys)


def formed_pairs(fps: DataFrame, bits: int = BITS, blocks: int = BLOCKS) -> DataFrame:
    """Pairs of distinct fingerprints that share a key, as `a` and `b` with their pivot tables; a pair can be formed by several tables."""
    tables = stored(pivot_tables(fps), "pivot-tables")
    a, b = (tables.select("*", F.explode(index_keys(bits, blocks, side == "b")).alias("k")).select("fp", "near", "far", "k.*").alias(side)
            for side in "ab")
    same = (F.col("a.table") == F.col("b.table")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.step") == F.col("b.step"))
    # In the same step each pair is formed once by its order; of neighbouring steps the lower one is a's.
    return a.join(b, same & (F.col("b.below") | (F.col("a.fp") < F.col("b.fp"))))


def links(fps: DataFrame, bits: int = BITS, blocks: int = BLOCKS) -> DataFrame:
    """(a, b): distinct fingerprints `a` < `b` that differ in `bits` bits at most."""
    close = reduce(and_, [_within(i, bits) for i in range(PIVOTS)]) & (_distance(F.col("a.fp"), F.col("b.fp")) <= bits)
    return formed_pairs(fps, bits, blocks).filter(close).select(
        F.least("a.fp", "b.fp").alias("a"), F.greatest("a.fp", "b.fp").alias("b")).distinct()


def discards(fps: DataFrame, bits: int = BITS, blocks: int = BLOCKS) -> DataFrame:
    """One row: pairs `formed`, how many each pivot discards (`by_0`, ...), how many `any` discards, and pairs `linked`."""
    within = [_within(i, bits) for i in range(PIVOTS)]
    return formed_pairs(fps, bits, blocks).agg(
        F.count("*").alias("formed"), *[F.count_if(~w).alias(f"by_{i}") for i, w in enumerate(within)],
        F.count_if(~reduce(and_, within)).alias("any"), F.count_if(_distance(F.col("a.fp"), F.col("b.fp")) <= bits).alias("linked"))


def _roots(fps: DataFrame, bits: int) -> DataFrame:
    """`fps`, a table of distinct fingerprints, with `root`: the smallest fingerprint in reach."""
    fps = stored(fps, "distinct-fingerprints")
    linked = components(links(fps.select("fp"), bits)).withColumnRenamed("node", "fp")
    return stored(fps.join(linked, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "rooted")


def _grouped(rows: DataFrame, bits: int) -> DataFrame:
    """(fp, component_id) for the distinct fingerprints of `rows`."""
    named = _roots(rows.groupBy("fp").agg(F.min("doc_id").alias("least_id")), bits)
    heads = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    return stored(named.join(heads, "root").select("fp", "component_id"), "components")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, bits: int = BITS, doc_id: str = "doc_id",
                    text: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) per row; component_id is the smallest doc_id in reach over links."""
    rows = stored(fingerprints(docs, shingle, doc_id, text), "fingerprints")
    return rows.join(_grouped(rows, bits), "fp").select("doc_id", "fp", "component_id")


def keep(docs: DataFrame, shingle: int = SHINGLE, bits: int = BITS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each component, with its own columns only: the one with the smallest (doc_id, hash of the text); null ids come last.

    Of rows that share both, the one whose JSON text is smallest stays. Rows to drop are found by an anti-join on all of a row's keys, so a
    component that holds a third of all rows is spread over all tasks. Texts are shuffled only if more keys are dropped than may be broadcast.
    """
    rows = stored(fingerprints(docs, shingle, doc_id, text), "fingerprints")
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    keys = stored(rows.join(_roots(rows.select("fp").distinct(), bits), "fp").groupBy("root", place.alias("place")).agg(
        F.count("*").alias("n")), "group-keys")
    first = keys.groupBy("root").agg(F.min("place").alias("place"))
    row = docs.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("_row"))
    here = [F.col(f"_row.`{doc_id}`"), F.xxhash64(f"_row.`{text}`")]

    def at(keys: DataFrame) -> Column:
        return here[0].eqNullSafe(keys["doc_id"]) & here[1].eqNullSafe(keys["text_hash"])
    extra = keys.join(first, ["root", "place"], "left_anti")
    gone = sized(extra.select("place").union(keys.filter("n > 1").select("place")).select("place.doc_id", "place.text_hash").distinct(), "gone")
    again = sized(first.join(keys.filter("n > 1"), ["root", "place"]).select("place.doc_id", "place.text_hash"), "again")
    one = row.join(again, at(again)).groupBy("doc_id", "text_hash").agg(F.min_by("_row", F.to_json("_row")).alias("_row"))
    return row.join(gone, at(gone), "left_anti").union(one.select("_row")).select("_row.*")
