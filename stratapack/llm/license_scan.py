"""Fuzzy short-notice search: exact seeds find candidates, bounded-error matching verifies them.

A text becomes its lower-cased words with one space between. A notice of which k edits
are allowed is split into k + 1 pieces; by the pigeonhole principle one piece of
any occurrence within k edits is exact. One automaton over all pieces (and over
the base phrases, with their bounding spaces) reads each text once. Around each seed
the span in which its notice can lie is matched with the regex library under {e<=k},
which verifies the edits and gives the span. Texts are scanned where they
lie: no shuffle, nothing that grows with the corpus is held.

Cases: null and empty texts have no words and no matches, score 0. Null doc_ids and
repeated rows are scanned like others. An empty table gives an empty result. Only
doc_id and text are read; whole texts are scanned.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratapack.llm.common import alnum_words, rows_of, table
from stratapack.session import ship

#: Fixed values of the contract: phrase and label.
BASE = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

#: Short notices as normalised words, the label each gives and the edits allowed in it.
NOTICES = (
    ("this work is licensed under the gnu general public license version 3", "gpl-3.0", 5),
    ("this work is licensed under the gnu general public license version 2", "gpl-2.0", 5),
    ("gnu general public license", "gpl", 3),
    ("gnu lesser general public license", "lgpl", 3),
    ("gnu affero general public license", "agpl", 3),
    ("licensed under the apache license version 2 0", "apache-2.0", 4),
    ("apache license", "apache", 1),
    ("released under the mit license", "mit", 3),
    ("mit license", "mit", 1),
    ("licensed under cc by nc 4 0", "cc-by-nc", 2),
    ("licensed under cc by sa 4 0", "cc-by-sa", 2),
    ("licensed under cc by 4 0", "cc-by", 2),
    ("creative commons attribution", "cc-by", 3),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit", 6),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd", 7),
    ("mozilla public license", "mpl", 2),
    ("eclipse public license", "epl", 2),
    ("boost software license", "bsl", 2),
    ("bsd 2 clause license", "bsd", 2),
    ("bsd 3 clause license", "bsd", 2),
    ("permission to use copy modify and or distribute this software for any purpose", "isc", 6),
    ("this is free and unencumbered software released into the public domain", "unlicense", 5),
    ("spdx license identifier", "spdx", 2),
    ("all rights reserved", "all-rights-reserved", 1),
)


@dataclass(frozen=True)
class Hit:
    label: str
    start: int  # of the words joined by single spaces
    end: int
    edits: int
    allowed: int


class NoticeSearch:
    def __init__(self, notices=NOTICES, base=BASE):
        self.notices, self.base = notices, base
        found: dict[str, list[tuple[int, int]]] = {}
        for k, (phrase, _) in enumerate(base):
            found.setdefault(f" {phrase} ", []).append((-1, k))
        self.patterns = []
        for k, (notice, _, edits) in enumerate(notices):
            self.patterns.append(regex.compile(rf"(?e)(?<= )(?:{regex.escape(notice, special_only=True)}){{e<={edits}}}(?= )"))
            cuts = [len(notice) * i // (edits + 1) for i in range(edits + 2)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                found.setdefault(notice[a:b], []).append((k, a))
        self.seeds = ahocorasick.Automaton()
        for seed, places in found.items():
            self.seeds.add_word(seed, (len(seed), places))
        self.seeds.make_automaton()

    def candidates(self, text: str) -> tuple[list[tuple[int, int]], dict[int, list[list[int]]]]:
        """Base places as (phrase, first character) and, for each notice, the disjoint spans in which it can lie."""
        base: list[tuple[int, int]] = []
        spans: dict[int, list[list[int]]] = {}
        for last, (size, places) in self.seeds.iter(text):
            first = last - size + 1
            for k, at in places:
                if k < 0:
                    base.append((at, first))
                    continue
                notice, _, edits = self.notices[k]
                low, high = max(0, first - at - edits - 1), min(len(text), first - at + len(notice) + edits + 1)
                seen = spans.setdefault(k, [])
                # Seeds come in order, but a later one may open its span up to 2 * edits before an earlier one's.
                while seen and low <= seen[-1][1]:
                    before = seen.pop()
                    low, high = min(low, before[0]), max(high, before[1])
                seen.append([low, high])
        return base, spans

    def hits(self, text: str, spans: dict[int, list[list[int]]]) -> list[Hit]:
        """All verified occurrences inside the spans."""
        out = []
        for k, seen in spans.items():
            _, label, edits = self.notices[k]
            for low, high in seen:
                for m in self.patterns[k].finditer(text, low, high):
                    if m.end() > m.start():
                        out.append(Hit(label, m.start() - 1, m.end() - 1, sum(m.fuzzy_counts), edits))
        return out

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], list[Hit]]:
        """Base places as (phrase, first word) and the notices' best hits."""
        text = f" {b' '.join(words).decode('utf-8', 'replace')} "
        base, spans = self.candidates(text)
        if base:
            blanks = np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), "<u4") == 32)
            base = [(k, int(w)) for (k, _), w in zip(base, np.searchsorted(blanks, [first for _, first in base]), strict=True)]
        return base, best_hits(self.hits(text, spans))


def best_hits(hits: list[Hit]) -> list[Hit]:
    """Those that no other beats. Only overlapping hits can, and none is longer than the longest."""
    hits = sorted(hits, key=lambda h: (h.start, h.end, h.edits, h.label))
    starts, longest = [h.start for h in hits], max((h.end - h.start for h in hits), default=0)
    near = lambda h: hits[bisect_left(starts, h.start - longest) : bisect_right(starts, h.end)]
    return [h for h in hits if not any(_beats(g, h) for g in near(h))]


def _beats(g: Hit, h: Hit) -> bool:
    """Whether g, with fewer edits, explains three quarters of h's span and is about as long: two versions of one notice."""
    both = min(g.end, h.end) - max(g.start, h.start)
    return g.edits < h.edits and 4 * both >= 3 * (h.end - h.start)


@lru_cache(maxsize=1)
def _search() -> NoticeSearch:
    return NoticeSearch()


_SPAN = "struct<label:string,start:long,end:long,edits:long>"
_ROW = f"doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<{_SPAN}>"


def license_notices(docs: DataFrame) -> DataFrame:
    """Per row: word and base counts, labels, the best match's confidence, and all spans.

    score: the best of 1 for a base phrase and 1 - edits / (allowed + 1) for a
    verified notice; 0 without either.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = _search()
        types = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int64())]))]
        names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
        for batch in batches:
            out = []
            for doc_id, text in rows_of(batch):
                words = alnum_words(text)
                base, hits = search.scan(words)
                own = {search.base[k][1] for k, _ in base}
                at = [w for _, w in base]
                score = max([1.0 * bool(base), *(1 - h.edits / (h.allowed + 1) for h in hits)])
                spans = [{"label": h.label, "start": h.start, "end": h.end, "edits": h.edits} for h in hits]
                out.append((doc_id, len(words), len(base), min(at, default=None), max(at, default=None), ",".join(sorted(own)), ",".join(sorted(own | {h.label for h in hits})), score, spans))
            cols = list(zip(*out, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

    return docs.select("doc_id", "text").mapInArrow(run, _ROW)


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_notices(table(spark, sf_dir, "documents")).withColumn("n_spans", F.size("spans").cast("long")).drop("spans")
