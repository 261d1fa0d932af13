"""License scan: short notices with spelling errors, by exact seeds and bounded edits.

A notice that may have ``e`` edits is split into ``e + 1`` pieces; any place with at most
``e`` edits holds one piece unchanged (pigeonhole). One Aho-Corasick pass finds all pieces
of all notices; around each, and only there, the regex library's bounded-error matching
decides and reports the span and its number of edits. A phrase without allowed edits
is its own only piece, and each of its places counts, overlapping ones too.

The text is matched as its words (lower-cased A-Z) with one space between them; spans
come back as word numbers. Null texts count as empty; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_map, table
from .words import texts


@dataclass(frozen=True)
class Notice:
    label: str
    text: str  # words with a space between two
    edits: int = 0


#: The phrases of the contract.
BASE = (
    Notice("mit", "mit license"),
    Notice("apache", "apache license"),
    Notice("gpl", "general public license"),
)
#: Wording of well-known public licenses, with the edits allowed.
NOTICES = (
    Notice("mit", "released under the mit license", 3),
    Notice("mit", "permission is hereby granted free of charge to any person obtaining a copy", 6),
    Notice("apache", "licensed under the apache license version 2 0", 4),
    Notice("gpl", "gnu general public license", 3),
    Notice("lgpl", "gnu lesser general public license", 3),
    Notice("agpl", "gnu affero general public license", 3),
    Notice("bsd", "redistribution and use in source and binary forms with or without modification", 6),
    Notice("mpl", "subject to the terms of the mozilla public license", 4),
    Notice("isc", "permission to use copy modify and or distribute this software for any purpose", 6),
    Notice("cc-by-nc", "licensed under cc by nc", 1),
    Notice("cc-by-sa", "licensed under cc by sa", 1),
    Notice("cc-by", "creative commons attribution", 3),
    Notice("cc0", "cc0 1 0 universal", 1),
    Notice("unlicense", "this is free and unencumbered software released into the public domain", 5),
)


def seeds(notice: Notice) -> list[tuple[int, str]]:
    """The pieces of a notice, of nearly equal length, and where each begins in it."""
    edges = [len(notice.text) * i // (notice.edits + 1) for i in range(notice.edits + 2)]
    return [(a, notice.text[a:b]) for a, b in zip(edges, edges[1:])]


class Scanner:
    """The automaton and patterns of some notices; built once per Arrow batch."""

    def __init__(self, notices: tuple[Notice, ...]):
        import ahocorasick
        import regex

        self.notices = notices
        self.automaton = ahocorasick.Automaton()
        found: dict[str, list[tuple[int, int]]] = {}
        for i, notice in enumerate(notices):
            for at, piece in seeds(notice):
                found.setdefault(piece, []).append((i, at))
        for piece, uses in found.items():
            self.automaton.add_word(piece, (len(piece), uses))
        self.automaton.make_automaton()
        self.patterns = [
            regex.compile(rf"(?b)(?<![^ ])(?:{regex.escape(n.text, literal_spaces=True)}){{e<={n.edits}}}(?![^ ])") if n.edits else None
            for n in notices
        ]

    def spans(self, text: str) -> list[tuple[int, int, int, int]]:
        """(notice, first, end, edits) of all places in a text of single-spaced words."""
        out, near = [], {}
        for last, (size, uses) in self.automaton.iter(text):
            first = last + 1 - size
            for i, at in uses:
                n = self.notices[i]
                if not n.edits:
                    if (not first or text[first - 1] == " ") and (last + 1 == len(text) or text[last + 1] == " "):
                        out.append((i, first, last + 1, 0))
                else:
                    lo, hi = max(0, first - at - n.edits), first - at + len(n.text) + n.edits
                    areas = near.setdefault(i, [])
                    if areas and lo <= areas[-1][1]:
                        areas[-1][1] = max(areas[-1][1], hi)
                        areas[-1][0] = min(areas[-1][0], lo)
                    else:
                        areas.append([lo, hi])
        for i, areas in near.items():
            done = 0
            for lo, hi in areas:
                for first, end, edits in self.places(i, text, max(lo, done), min(hi + 1, len(text))):
                    done = max(done, end)
                    # the pattern may take in a space on either side as an edit
                    first, end = first + (text[first : first + 1] == " "), end - (text[end - 1 : end] == " ")
                    out.append((i, first, end, edits))
        return out

    def places(self, i: int, text: str, lo: int, hi: int) -> list[tuple[int, int, int]]:
        """(first, end, edits) of all places of a notice between ``lo`` and ``hi``: the best one, then those on either side of it."""
        out, parts, least = [], [(lo, hi)], len(self.notices[i].text) - self.notices[i].edits
        while parts:
            a, b = parts.pop()
            if b - a >= least and (m := self.patterns[i].search(text, a, b)):
                out.append((m.start(), m.end(), sum(m.fuzzy_counts)))
                parts += [(a, m.start()), (m.end(), b)]
        return sorted(out)


def scan(docs: DataFrame, base: tuple[Notice, ...] = BASE, notices: tuple[Notice, ...] = NOTICES) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, base (places of base phrases as
    label and first word), found (all spans: label, first and last word, edits, similarity), text of each span."""
    every = (*base, *notices)

    def each(batch: pa.RecordBatch):
        scanner = Scanner(every)
        for text in texts(batch.column(1)):
            row, start, end = text.words()
            cut = np.searchsorted(row, np.arange(text.rows + 1))
            places, spans = [], []
            for r in range(text.rows):
                a, b = int(cut[r]), int(cut[r + 1])
                own_base, own = [], []
                words = [text.string(s, e) for s, e in zip(start[a:b].tolist(), end[a:b].tolist())]
                joined = " ".join(words)
                found = scanner.spans(joined)
                if found:
                    begins = np.cumsum([0, *(len(w) + 1 for w in words)])
                    for i, first, stop, edits in sorted(found, key=lambda s: (s[1], s[2], s[0])):
                        n = every[i]
                        w0 = int(np.searchsorted(begins, first, "right")) - 1
                        w1 = int(np.searchsorted(begins, stop - 1, "right")) - 1
                        if i < len(base):
                            own_base.append({"label": n.label, "word": w0})
                        own.append({"label": n.label, "first": w0, "last": w1, "edits": edits, "similarity": 1 - edits / len(n.text), "span": joined[first:stop]})
                places.append(own_base)
                spans.append(own)
            yield {
                "doc_id": batch.column(0).slice(text.first, text.rows),
                "n_words": np.diff(cut).astype(np.int64),
                "base": places,
                "found": spans,
            }

    return arrow_map(
        docs.select("doc_id", "text"),
        each,
        "doc_id long, n_words long, base array<struct<label: string, word: long>>, "
        "found array<struct<label: string, first: long, last: long, edits: int, similarity: double, span: string>>",
    )


def op5_license_scan(spark, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    def names(column: str):
        return F.array_join(F.array_sort(F.array_distinct(F.col(f"{column}.label"))), ",")

    found = scan(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min("base.word").alias("first_word"),
        F.array_max("base.word").alias("last_word"),
        names("base").alias("base_labels"),
        names("found").alias("labels"),
        F.coalesce(F.array_max("found.similarity"), F.lit(0.0)).alias("score"),
        "found",
    )
