"""Licence scan: fuzzy search for short notices by exact seeds and bounded-error matching.

A notice within k edits holds at least one of the k + 1 pieces of the wanted text unchanged. One
Aho-Corasick pass finds the pieces. A place around one is looked at if it also holds enough of the
notice's three-letter parts: an edit spoils three of them at most, so no notice is lost, and
fragments that can't be one never reach the regex library, which is slow on them.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import ahocorasick
import numpy as np
import regex
from pyspark.sql import DataFrame

from cardwarden.llm.words import alnum_words, map_texts, slim

# Exact phrases and their labels.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: (label, notice in lower-case words, edits allowed)
NOTICES = (
    ("mit", "released under the mit license", 2),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", 6),
    ("apache-2", "licensed under the apache license version 2 0", 3),
    ("cc-by-nc", "licensed under cc by nc 4 0", 2),
    ("gpl-3", "licensed under the gnu general public license version 3", 4),
    ("bsd", "redistribution and use in source and binary forms with or without modification", 6),
    ("mpl-2", "subject to the terms of the mozilla public license v 2 0", 4),
    ("all-rights-reserved", "copyright all rights reserved", 2),
)

FIELDS = (
    "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
    "score double, spans array<struct<label:string,first_word:long,last_word:long,edits:int>>"
)


def seeds(notice: str, edits: int) -> list[tuple[int, str]]:
    """The notice cut into edits + 1 pieces: (offset, piece)."""
    cuts = [len(notice) * i // (edits + 1) for i in range(edits + 2)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:])]


GRAM = 3


def grams(notice: str, edits: int) -> tuple[list[str], int]:
    """The parts of ``GRAM`` letters at each place of the notice, and how many a match must hold."""
    parts = [notice[i : i + GRAM] for i in range(len(notice) - GRAM + 1)]
    return parts, len(parts) - GRAM * edits


def blanks(codes: np.ndarray) -> np.ndarray:
    """Where the blanks are; the number of those before a place is the number of its word."""
    return np.flatnonzero(codes == ord(" "))


def pattern(notice: str, edits: int) -> regex.Pattern:
    return regex.compile(f"(?e)(?:{regex.escape(notice, literal_spaces=True)}){{e<={edits}}}")


@dataclass
class Scanner:
    notices: Sequence[tuple[str, str, int]]
    phrases: Sequence[tuple[str, str]]

    def __post_init__(self):
        self.patterns = [pattern(n, k) for _, n, k in self.notices]
        self.grams = [grams(n, k) for _, n, k in self.notices]
        found: dict[str, list[tuple[int, int]]] = {}
        for i, (_, notice, k) in enumerate(self.notices):
            for offset, piece in seeds(notice, k):
                found.setdefault(piece, []).append((i, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, uses in found.items():
            self.automaton.add_word(piece, (len(piece), uses))
        if found:
            self.automaton.make_automaton()

    def windows(self, text: str) -> list[tuple[int, int, int]]:
        """(notice, start, end): every place that a match can lie in, overlaps joined."""
        if not self.notices or not text:
            return []
        places = set()
        for end, (length, uses) in self.automaton.iter(text):
            places.update((i, end + 1 - length - offset) for i, offset in uses)
        joined: list[list[int]] = []
        for i, start in sorted(places):
            _, notice, k = self.notices[i]
            parts, needed = self.grams[i]
            a, b = max(0, start - k), min(len(text), start + len(notice) + k)
            window = text[a:b]
            if sum(p in window for p in parts) < needed:
                continue
            if joined and joined[-1][0] == i and a <= joined[-1][2]:
                joined[-1][2] = max(b, joined[-1][2])
            else:
                joined.append([i, a, b])
        return [tuple(w) for w in joined]

    def spans(self, text: str) -> list[tuple[str, int, int, int, float]]:
        """(label, first word, last word, edits, similarity) of each notice found."""
        windows = self.windows(text)
        if not windows:
            return []
        gaps = blanks(np.frombuffer(text.encode("utf-32-le"), dtype="<u4"))
        out = []
        for i, a, b in windows:
            label, notice, _ = self.notices[i]
            for m in self.patterns[i].finditer(text, a, b):
                edits = sum(m.fuzzy_counts)
                first = int(np.searchsorted(gaps, m.start()))
                last = first + m.group().strip(" ").count(" ")
                out.append((label, first, last, edits, 1 - edits / len(notice)))
        return out

    def __call__(self, raw: bytes) -> tuple:
        words = alnum_words(raw)
        joined = b" ".join(words)
        padded = b" " + joined + b" "
        starts, base, gaps = [], set(), None
        for phrase, label in self.phrases:
            wanted = b" " + phrase.encode() + b" "
            at = padded.find(wanted)
            while at >= 0:
                if gaps is None:
                    gaps = blanks(np.frombuffer(padded, dtype=np.uint8))
                starts.append(int(np.searchsorted(gaps, at)))
                base.add(label)
                at = padded.find(wanted, at + 1)
        spans = self.spans(joined.decode("utf-8", "replace"))
        labels = base | {s[0] for s in spans}
        score = 1.0 if base else max((s[4] for s in spans), default=0.0)
        places = [{"label": s[0], "first_word": s[1], "last_word": s[2], "edits": s[3]} for s in spans]
        first, last = (min(starts), max(starts)) if starts else (None, None)
        return (len(words), len(starts), first, last, ",".join(sorted(base)), ",".join(sorted(labels)), score, places)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", notices=NOTICES, phrases=PHRASES) -> DataFrame:
    """One row per row of ``docs``: exact phrase places, labels, score and the fuzzy spans.

    ``score`` is 1 with an exact phrase, else the best 1 - edits / length of a notice, else 0. A
    null or empty text has no words, no labels and score 0; repeated rows and null ids get a row
    each. Whole texts are scanned one at a time, without a shuffle.
    """
    return map_texts(slim(docs, id_col, text_col), lambda: Scanner(notices, phrases), FIELDS)
