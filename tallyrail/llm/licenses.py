"""License scans: fuzzy search for short notices.

A text is reduced to its words in lower case, one blank between, so that layout, case and punctuation do not matter. A notice may occur
with `k` edits (about one per twelve characters). Cut into k + 1 stretches, at least one stretch of any such occurrence is unharmed: all
stretches of all notices are searched at once as exact seeds. Around every seed found, the regex library's bounded-error matching looks
for the whole notice and yields the span and its edits. Only texts with a seed pay for that.

Exact places of the base phrases are counted besides, on word boundaries. Texts are handled whole, one by one inside tasks, without a shuffle.

Defined results: a null or empty text has no words, places or labels and scores 0; repeated rows give repeated rows; an empty table gives an empty
table; a match that overlaps one with fewer edits is not reported (both are if equal). Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from bisect import bisect
from collections.abc import Iterator, Mapping
from functools import lru_cache
from itertools import groupby

import ahocorasick
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyrail.llm.common import small_batches

# Fixed values of the contract: exact phrases and their labels.
BASE: dict[str, str] = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Wordings of common notices and their labels.
NOTICES: dict[str, str] = {
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "released under the mit license": "mit",
    "licensed under the mit license": "mit",
    "licensed under the apache license version 2 0": "apache",
    "you may not use this file except in compliance with the license": "apache",
    "licensed under the gnu general public license": "gpl",
    "under the terms of the gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "released under the bsd license": "bsd",
    "licensed under the bsd 3 clause license": "bsd",
    "this source code form is subject to the terms of the mozilla public license": "mpl",
    "licensed under a creative commons attribution": "cc",
    "licensed under cc by 4 0": "cc-by",
    "licensed under cc by sa 4 0": "cc-by-sa",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "licensed under cc by nd 4 0": "cc-by-nd",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "eclipse public license": "epl",
}

CHARS_PER_EDIT = 12
_TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_WORD = re.compile(r"[0-9A-Za-z\x80-\U0010ffff]+")


def edits_allowed(notice: str) -> int:
    return len(notice) // CHARS_PER_EDIT


def seeds(notice: str) -> list[tuple[int, str]]:
    """(offset, stretch): the notice in one stretch more than it may have edits."""
    parts = edits_allowed(notice) + 1
    cuts = [len(notice) * i // parts for i in range(parts + 1)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:])]


def fewest_edits(found: list[tuple[int, int, str, int]]) -> list[tuple[int, int, str, int]]:
    """Of the matches (from, to, notice, edits) those that no kept match with fewer edits overlaps, in order of place."""
    kept: list[tuple[int, int]] = []  # stretches that are taken, apart from each other and sorted
    out = []
    by_edits = sorted(found, key=lambda f: (f[3], f))
    for _, group in groupby(by_edits, key=lambda f: f[3]):
        stands = []
        for match in group:
            at = bisect(kept, (match[1], -1))  # the last taken stretch that begins before the match ends
            if at == 0 or kept[at - 1][1] <= match[0]:
                stands.append(match)
        out += stands
        merged: list[tuple[int, int]] = []
        for a, b in sorted(kept + [m[:2] for m in stands]):
            if merged and a < merged[-1][1]:
                merged[-1] = merged[-1][0], max(b, merged[-1][1])
            else:
                merged.append((a, b))
        kept = merged
    return sorted(out)


class Scanner:
    def __init__(self, notices: Mapping[str, str] = NOTICES, base: Mapping[str, str] = BASE):
        self.notices, self.base = dict(notices), dict(base)
        found: dict[str, list[tuple[str, int]]] = {}
        for notice in self.notices:
            for offset, stretch in seeds(notice):
                found.setdefault(stretch, []).append((notice, offset))
        self.automaton = ahocorasick.Automaton()
        for stretch, places in found.items():
            self.automaton.add_word(stretch, (len(stretch), places))
        self.automaton.make_automaton()
        self.patterns = {n: regex.compile(f"(?:{regex.escape(n)}){{e<={edits_allowed(n)}}}", regex.BESTMATCH) for n in self.notices}

    def base_places(self, line: str) -> list[tuple[int, str]]:
        """(character, label) of every exact place in a line that begins and ends with a blank."""
        out = []
        for phrase, label in self.base.items():
            at = line.find(f" {phrase} ")
            while at >= 0:
                out.append((at + 1, label))
                at = line.find(f" {phrase} ", at + 1)
        return out

    def _windows(self, line: str) -> Iterator[tuple[str, int, int]]:
        """(notice, from, to): the stretch around each seed that an occurrence with that seed can fill."""
        seen: set[tuple[str, int]] = set()
        for end, (size, places) in self.automaton.iter(line):
            for notice, offset in places:
                k = edits_allowed(notice)
                at = end + 1 - size - offset
                if (notice, at) not in seen:
                    seen.add((notice, at))
                    yield notice, max(0, at - k), min(len(line), at + len(notice) + k)

    def _at_words(self, line: str, notice: str, a: int, b: int) -> tuple[int, int, str, int] | None:
        """The best match that begins and ends with a word: a cut word at either end is taken whole or left out."""
        starts = {line.rfind(" ", 0, a + 1) + 1, line.find(" ", a - 1) + 1}
        ends = {line.rfind(" ", 0, b + 1), line.find(" ", b)}
        found = []
        for x in starts:
            for y in ends:
                if 0 < x < y and (match := self.patterns[notice].fullmatch(line, x, y)):
                    found.append((sum(match.fuzzy_counts), x - y, x))
        if not found:
            return None
        edits, size, x = min(found)
        return x, x - size, notice, edits

    def fuzzy(self, line: str) -> list[tuple[int, int, str, int]]:
        """(from, to, notice, edits) in the line; a match begins and ends with a word."""
        spans: dict[str, set[tuple[int, int]]] = {}
        for notice, start, stop in self._windows(line):
            for match in self.patterns[notice].finditer(line, start, stop):
                a, b = match.span()
                text = match.group()
                a, b = a + len(text) - len(text.lstrip(" ")), b - (len(text) - len(text.rstrip(" ")))
                if a < b:
                    spans.setdefault(notice, set()).add((a, b))
        out = []
        for notice, mine in spans.items():
            # Windows of one occurrence may give it with other bounds: the one with the fewest edits stands.
            taken: list[tuple[int, int, str, int]] = []
            for found in sorted({f for a, b in mine if (f := self._at_words(line, notice, a, b))}, key=lambda f: (f[3], f[:2])):
                at = bisect(taken, found)
                if (at == 0 or taken[at - 1][1] <= found[0]) and (at == len(taken) or found[1] <= taken[at][0]):
                    taken.insert(at, found)
            out += taken
        return fewest_edits(out)

    def scan(self, text: str | None) -> dict:
        words = (text or "").encode("utf-8", "replace").translate(_TO_WORDS).split()
        line = f" {b' '.join(words).decode('utf-8', 'replace')} "
        exact = self.base_places(line)
        fuzzy = self.fuzzy(line)
        starts = sorted(line.count(" ", 0, at) - 1 for at, _ in exact)
        base = {label for _, label in exact}
        out = {"n_words": len(words), "n_base": len(exact), "first_word": starts[0] if starts else None,
               "last_word": starts[-1] if starts else None, "base_labels": ",".join(sorted(base)),
               "labels": ",".join(sorted(base | {self.notices[n] for _, _, n, _ in fuzzy})),
               "score": max([1.0] * bool(exact) + [1.0 - e / len(n) for _, _, n, e in fuzzy], default=0.0), "spans": []}
        if fuzzy:
            places = [m.span() for m in _WORD.finditer(text)]
            for a, b, notice, edits in fuzzy:
                first, last = line.count(" ", 0, a) - 1, line.count(" ", 0, b) - 1
                out["spans"].append((self.notices[notice], notice, places[first][0], places[last][1], edits))
        return out


@lru_cache(maxsize=4)
def _scanner(notices: tuple, base: tuple) -> Scanner:
    return Scanner(dict(notices), dict(base))


SPAN = "struct<label:string,notice:string,start:bigint,end:bigint,edits:bigint>"
RESULT = ("n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, "
          f"spans array<{SPAN}>")


def scan(docs: DataFrame, notices: Mapping[str, str] = NOTICES, base: Mapping[str, str] = BASE, doc_id: str = "doc_id",
         text: str = "text") -> DataFrame:
    """One row per document; `spans` are the notices found: characters [start, end) of the text and the number of edits."""
    small_batches(docs.sparkSession)
    names = [part.split()[0] for part in RESULT.split(", ")]
    keys = tuple(notices.items()), tuple(base.items())

    @F.pandas_udf(RESULT)
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        tool = _scanner(*keys)
        for batch in texts:
            found = [tool.scan(t) for t in batch]
            out = pd.DataFrame({n: pd.Series([f[n] for f in found], dtype="object") for n in names if n != "spans"})
            for n in ("n_words", "n_base", "first_word", "last_word"):
                out[n] = out[n].astype("Int64")
            out["score"] = out["score"].astype("float64")
            fields = ("label", "notice", "start", "end", "edits")
            out["spans"] = pd.Series([[dict(zip(fields, s)) for s in f["spans"]] for f in found], dtype="object")
            yield out[names]

    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), of(F.col(f"`{text}`")).alias("s"))
    return rows.select("doc_id", "s.*")
