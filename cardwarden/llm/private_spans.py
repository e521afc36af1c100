"""Personal data by rules and by a semi-Markov conditional random field.

Four kinds follow fixed rules. The field adds spans that the rules miss, such as phone numbers
without a plus sign or addresses written with "(at)": it scores whole spans by what they hold (how
many digits in how many groups, separators, a checksum, the characters beside them), and dynamic
programming over spans of at most ``LONGEST`` tokens picks the boundaries and kinds of a region
together.

The field learns from what the rules find in a bounded sample of the same documents, and from the
same regions with each find rewritten in other notations, beside look-alikes that are none.
"""

from __future__ import annotations

import hashlib
import random
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from cardwarden.llm.words import map_texts, record_batch, slim

KINDS = ("email", "ip", "card", "phone")
#: Most tokens of a span that the field weighs, and tokens scored at a time.
LONGEST, BLOCK = 20, 2000
#: Documents that regions are sampled from, regions that the field learns from, tokens of one at most.
SAMPLE_DOCS, SAMPLE, SAMPLE_TOKENS = 20_000, 700, 40
#: Log-odds that a span must have over none.
CAUTION = 2.0

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+@?")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_PART = re.compile(r"[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NO_DIGIT = re.compile(r"[^0-9]")
_SIGN = re.compile(r"[0-9@]|[\[(](?:at|dot)[\])]", re.I)
_TOKEN = re.compile(r"[0-9]+|[A-Za-z]+|[^\x00-\x7f\s]+|[^\sA-Za-z0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def rule_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by the fixed rules, by kind, then start; every rule reads the text once."""
    out = []
    if "@" in text:
        last = 0
        for m in _LOCAL.finditer(text):
            at = m.end() - 1
            if text[at] == "@" and max(m.start(), last) < at and (d := _DOMAIN.match(text, at + 1)):
                out.append((0, max(m.start(), last), d.end()))
                last = d.end()
    for m in _DOTTED.finditer(text):
        if m.group().count(".") >= 3:
            parts = list(_PART.finditer(text, m.start(), m.end()))
            for four in zip(*[iter(parts)] * 4):
                if all(_small(p.group()) for p in four):
                    out.append((1, four[0].start(), four[3].end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NO_DIGIT.sub("", m.group())) <= 15:
                out.append((3, m.start(), m.end()))
    return out


def regions(text: str) -> list[tuple[int, int]]:
    """Where spans can be: runs of words with a digit, an @, "(at)" or "(dot)", a word more each side."""
    signs = np.array([m.start() for m in _SIGN.finditer(text)], np.int64)
    if not len(signs):
        return []
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    blanks = np.flatnonzero((codes == 32) | ((codes >= 9) & (codes <= 13)))
    word = np.unique(np.searchsorted(blanks, signs))
    heads = np.flatnonzero(np.diff(word, prepend=-9) > 3)
    first = np.maximum(word[heads] - 1, 0)
    last = np.minimum(np.append(word[heads[1:] - 1], word[-1]) + 1, len(blanks))
    starts = np.where(first > 0, blanks[first - 1] + 1, 0) if len(blanks) else np.zeros(len(first), int)
    ends = np.append(blanks, len(text))[last]
    return list(zip(starts.tolist(), ends.tolist()))


# --- tokens and whole-span features ---------------------------------------------------------

_DIGIT, _LETTER, _FOREIGN, _OTHER = 0, 1, 2, 13
_MARK = {".": 3, "-": 4, "@": 5, "+": 6, "(": 7, ")": 8, "_": 9, "%": 10, "[": 11, "]": 12}
#: Words that often stand before a span of each kind.
CUES = (
    {"mail", "email", "contact", "write"}, {"ip", "host", "server", "address"},
    {"card", "visa", "credit", "account"}, {"phone", "tel", "call", "mobile", "fax"},
)


@dataclass
class Tokens:
    """The tokens of some regions: types, sizes, the gap before each (0 none, 1 a blank, 2 other, 3 a
    region's start), and their places in the text."""

    words: list[str]
    start: np.ndarray
    end: np.ndarray
    gap: np.ndarray

    def __post_init__(self):
        kind = [_DIGIT if w[0] in "0123456789" else _MARK.get(w, _LETTER if w.isascii() and w.isalpha() else _FOREIGN if not w.isascii() else _OTHER) for w in self.words]
        self.kind = np.array(kind, np.int64)
        self.size = self.end - self.start
        lower = [w.lower() if k == _LETTER else "" for w, k in zip(self.words, kind)]
        inner = np.zeros(len(kind), bool)
        if len(kind) > 2:
            opened = (self.kind[:-2] == 7) | (self.kind[:-2] == 11)
            closed = (self.kind[2:] == 8) | (self.kind[2:] == 12)
            inner[1:-1] = opened & closed
        self.at = inner & np.array([w == "at" for w in lower], bool)
        self.dot = inner & np.array([w == "dot" for w in lower], bool)
        self.large = np.array([k == _DIGIT and not _small(w) for w, k in zip(self.words, kind)], bool)
        self.cue = np.array([[w in c for c in CUES] for w in lower], bool).reshape(-1, len(CUES))


def tokens_of(text: str, spots: list[tuple[int, int]]) -> Tokens:
    words, start, end, gap = [], [], [], []
    for a, b in spots:
        last = None
        for m in _TOKEN.finditer(text, a, b):
            words.append(m.group())
            start.append(m.start()), end.append(m.end())
            gap.append(3 if last is None else 0 if m.start() == last else 1 if text[last : m.start()] == " " else 2)
            last = m.end()
    return Tokens(words, np.array(start, np.int64), np.array(end, np.int64), np.array(gap, np.int64))


class SpanFeatures:
    """Whole-span features of all (first token, length), from running sums over the tokens."""

    def __init__(self, t: Tokens):
        self.t = t
        n = len(t.words)
        region = np.cumsum(t.gap == 3)

        def running(x):
            return np.concatenate([[0], np.cumsum(x)])

        digit = t.kind == _DIGIT
        self.region = region
        self.sums = {
            "digits": running(np.where(digit, t.size, 0)), "groups": running(digit), "letters": running(t.kind == _LETTER),
            "foreign": running(t.kind == _FOREIGN), "other": running(t.kind == _OTHER), "odd": running((t.kind >= 9) & (t.kind <= 12)),
            "dots": running(t.kind == 3), "dashes": running(t.kind == 4), "ats": running(t.kind == 5), "plus": running(t.kind == 6),
            "open": running(t.kind == 7), "close": running(t.kind == 8), "large": running(t.large), "at": running(t.at), "dot": running(t.dot),
            "blank": running(t.gap == 1), "gaps": running(t.gap == 2),
        }
        self.cues = np.concatenate([np.zeros((1, len(CUES)), int), np.cumsum(t.cue, 0)])
        self.n = n

    def spans(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """(first tokens, lengths) of the spans from ``a``..``b`` that could be personal data: inside
        one region, with a digit, an @ or an "(at)", and no blank but single ones."""
        first, length = np.meshgrid(np.arange(a, b), np.arange(1, LONGEST + 1), indexing="ij")
        first, length = first.ravel(), length.ravel()
        ok = first + length <= self.n
        first, length = first[ok], length[ok]
        stop = first + length
        s = self.sums
        ok = self.region[first] == self.region[stop - 1]
        ok &= (s["digits"][stop] - s["digits"][first] + s["ats"][stop] - s["ats"][first] + s["at"][stop] - s["at"][first]) > 0
        ok &= s["gaps"][stop] - s["gaps"][first + 1] == 0
        return first[ok], length[ok]

    def matrix(self, first: np.ndarray, length: np.ndarray) -> np.ndarray:
        t, stop = self.t, first + length
        inside = {k: v[stop] - v[first] for k, v in self.sums.items()}
        inside["blank"] = self.sums["blank"][stop] - self.sums["blank"][first + 1]
        digits, groups = inside["digits"], inside["groups"]
        head, tail = t.kind[first], t.kind[stop - 1]
        # What touches the span: nothing (a blank or an end), or a token's type.
        before = np.where((first > 0) & (t.gap[first] == 0), t.kind[first - 1], -1)
        after_at = np.minimum(stop, self.n - 1)
        after = np.where((stop < self.n) & (t.gap[after_at] == 0), t.kind[after_at], -1)
        plain = (inside["letters"] == 0) & (inside["ats"] == 0) & (inside["foreign"] == 0) & (inside["other"] == 0)
        signs = inside["ats"] + inside["at"]
        bucket = np.minimum(np.where(digits >= 17, np.where(digits >= 20, 18, 17), digits), 18)
        columns: list[np.ndarray] = []

        def one_hot(x, n):
            columns.append(np.minimum(x, n - 1)[:, None] == np.arange(n))

        def flag(*x):
            columns.append(np.stack(x, 1))

        flag(np.ones(len(first), bool))
        one_hot(bucket, 19)
        columns.append((bucket[:, None] == np.arange(19)) & plain[:, None])
        one_hot(groups, 6), one_hot(inside["letters"], 4), one_hot(signs, 3), one_hot(inside["dot"], 4)
        one_hot(inside["dots"], 5), one_hot(inside["dashes"], 4), one_hot(inside["blank"], 5), one_hot(inside["odd"], 3)
        even = inside["open"] == inside["close"]
        flag(even & (inside["open"] == 1), even & (inside["open"] > 1), ~even)
        rest = inside["plus"] - (head == 6)
        flag(head == 6, rest > 0, inside["other"] > 0, inside["foreign"] > 0, inside["large"] > 0)
        shape = (length == 7) & (groups == 4) & (inside["dots"] == 3) & (inside["blank"] == 0) & (head == _DIGIT) & (tail == _DIGIT)
        flag(shape, shape & (inside["large"] == 0), self._checksums(first, stop, digits, plain))
        flag(
            (signs == 1) & (inside["letters"] > 0) & (inside["dots"] + inside["dot"] > 0) & (inside["other"] == 0),
            (groups == 4) & (inside["large"] == 0) & plain, plain & (groups * 4 == digits) & (groups > 1),
        )
        flag(head == _DIGIT, head == _LETTER, head == 7, head > 8, (head == 3) | (head == 4) | (head == 8))
        flag(tail == _DIGIT, tail == _LETTER, tail == 8, (tail == 3) | (tail == 4), tail > 8)
        for side in (before, after):
            flag(side == -1, side == _DIGIT, side == _LETTER, side == 3, side == 4, (side == 5) | (side == 6), side > 6)
        one_hot(np.where(head == _DIGIT, t.size[first], 0), 6)
        one_hot(np.where(tail == _DIGIT, t.size[stop - 1], 0), 6)
        columns.append(self.cues[first] > self.cues[np.maximum(first - 3, 0)])
        return np.concatenate(columns, 1).astype(np.float32)

    def _checksums(self, first, stop, digits, plain) -> np.ndarray:
        out = np.zeros(len(first), bool)
        words, kind = self.t.words, self.t.kind
        for i in np.flatnonzero((digits >= 13) & (digits <= 19) & plain).tolist():
            out[i] = luhn("".join(w for w, k in zip(words[first[i] : stop[i]], kind[first[i] : stop[i]]) if k == _DIGIT))
        return out


# --- the field ------------------------------------------------------------------------------


@dataclass
class Field:
    """Weights of span features by kind, and of the change from one label to the next (the last
    label is "none", which spans one token)."""

    weights: np.ndarray
    moves: np.ndarray

    def decode(self, t: Tokens, taken: np.ndarray) -> list[tuple[int, int, int]]:
        """(kind, first token, length) of the best segmentation; ``taken`` tokens are in no span."""
        n = len(t.words)
        feats = SpanFeatures(t)
        held = np.concatenate([[0], np.cumsum(taken)])
        found_at, found_len, found_score = [], [], []
        for a in range(0, n, BLOCK):
            first, length = feats.spans(a, min(n, a + BLOCK))
            free = held[first + length] == held[first]
            first, length = first[free], length[free]
            score = feats.matrix(first, length) @ self.weights - CAUTION
            # A span that no moves around it can lift above "none" is in no best segmentation.
            good = score.max(1, initial=-np.inf) + 2 * np.abs(self.moves).max() > 0
            found_at.append(first[good]), found_len.append(length[good]), found_score.append(score[good])
        first, length = np.concatenate(found_at), np.concatenate(found_len)
        if not len(first):
            return []
        return self._best(n, first, length, np.concatenate(found_score))

    def _best(self, n: int, first: np.ndarray, length: np.ndarray, score: np.ndarray) -> list[tuple[int, int, int]]:
        k = len(KINDS)
        by_end: dict[int, list[int]] = {}
        for i, e in enumerate((first + length).tolist()):
            by_end.setdefault(e, []).append(i)
        lowest = int(first.min())
        best = {lowest: np.where(np.arange(k + 1) == k, 0.0, -np.inf)}
        back: dict[int, list] = {}
        for e in range(lowest + 1, n + 1):
            here = np.full(k + 1, -np.inf)
            came: list = [None] * (k + 1)
            quiet = best[e - 1] + self.moves[:, k]
            here[k], came[k] = quiet.max(), (1, int(quiet.argmax()))
            for i in by_end.get(e, ()):
                into = best[e - int(length[i])][:, None] + self.moves[:, :k] + score[i]
                for y in np.flatnonzero(into.max(0) > here[:k]).tolist():
                    here[y], came[y] = into[:, y].max(), (int(length[i]), int(into[:, y].argmax()))
            best[e], back[e] = here, came
        e, y, out = n, k, []
        if best[n].max() > best[n][k]:
            y = int(best[n].argmax())
        while e > lowest:
            size, before = back[e][y]
            if y < k:
                out.append((y, e - size, size))
            e, y = e - size, before
        return out[::-1]


def added_spans(field: Field | None, text: str, ruled: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """What the field adds to the spans of the rules."""
    spots = regions(text) if field is not None else []
    t = tokens_of(text, spots)
    if not t.words:
        return []
    mark = np.zeros(len(t.words) + 1, np.int64)
    for _, a, b in ruled:
        mark[np.searchsorted(t.end, a, "right")] += 1
        mark[np.searchsorted(t.start, b, "left")] -= 1
    found = field.decode(t, np.cumsum(mark)[:-1] > 0)
    return [(kind, int(t.start[i]), int(t.end[i + n - 1])) for kind, i, n in found]


@dataclass
class Example:
    """A region with its spans as (kind, first token, length)."""

    tokens: Tokens
    gold: list[tuple[int, int, int]]


def example(text: str, spans: list[tuple[int, int, int]]) -> Example | None:
    """None where the region is too long to learn from or spans overlap or part a token."""
    t = tokens_of(text, [(0, len(text))])
    if not 0 < len(t.words) <= SAMPLE_TOKENS:
        return None
    gold, last = [], 0
    for kind, a, b in sorted(spans, key=lambda s: s[1]):
        i, j = np.searchsorted(t.start, a), np.searchsorted(t.end, b)
        if a < last or j >= len(t.words) or i >= len(t.words) or t.start[i] != a or t.end[j] != b or not 0 < j - i + 1 <= LONGEST:
            return None
        gold.append((kind, int(i), int(j - i + 1)))
        last = b
    return Example(t, gold)


def rewritten(rng: random.Random, kind: int, found: str) -> str:
    """A find in another notation of the same thing."""
    digits = _NO_DIGIT.sub("", found)
    if kind == 0:
        at = rng.choice([" (at) ", " [at] ", "(at)", "[at]"])
        dot = rng.choice([".", ".", at.replace("at", "dot")])
        return found.replace("@", at).replace(".", dot)
    if kind == 1:
        return found.replace(".", rng.choice(["[.]", "(dot)", "[dot]", " . "]))
    if kind == 2:
        return rng.choice([".", "_", " - "]).join(digits[i : i + 4] for i in range(0, len(digits), 4))
    area, mid, line = digits[-10:-7] or "555", digits[-7:-4], digits[-4:]
    country = rng.choice(["", "", digits[:-10] + " " if len(digits) > 10 else "", "00" + digits[:-10] + " "])
    sep = rng.choice(["-", ".", " "])
    return country + rng.choice([f"({area}) {mid}{sep}{line}", f"{area}{sep}{mid}{sep}{line}", f"({area}) {mid}-{line}"])


def look_alike(rng: random.Random) -> str:
    """Numbers that are no personal data: dates, times, prices, versions, ids, odd checksums."""
    def n(a, b):
        return rng.randint(a, b)
    wrong = "".join(str(n(0, 9)) for _ in range(15))
    wrong += str(next(d for d in range(9, -1, -1) if not luhn(wrong + str(d))))
    four = [str(n(0, 255)) for _ in range(4)]
    four[n(0, 3)] = str(n(256, 999))
    return rng.choice([
        f"{n(1900, 2099)}-{n(1, 12):02}-{n(1, 31):02}", f"{n(1, 31):02}.{n(1, 12):02}.{n(1900, 2099)}", f"{n(1, 31)}/{n(1, 12)}/{n(0, 99):02}",
        f"{n(1900, 2099)}-{n(1, 12):02}-{n(1, 31):02} {n(0, 23):02}:{n(0, 59):02}:{n(0, 59):02}", f"{n(0, 23):02}:{n(0, 59):02}", f"{n(0, 9999)}.{n(0, 99):02}",
        f"v{n(0, 20)}.{n(0, 20)}.{n(0, 20)}", f"{n(0, 20)}.{n(0, 20)}.{n(0, 20)}", f"{n(1800, 2000)}-{n(1800, 2000)}", ".".join(four), str(n(0, 10**9)), wrong,
        ".".join(wrong[i : i + 4] for i in range(0, 16, 4)), f"{n(1, 999)},{n(0, 999):03},{n(0, 999):03}", f"{rng.choice('ABCX')}-{n(1000, 99999)}", f"{n(0, 10**13):013x}",
        f"{n(1, 99)} {n(1, 99)} {n(1, 99)}", f"@{rng.choice(['home', 'me', 'team'])}{n(1, 99)}", f"{n(100, 999)} {n(100, 999)}", f"{n(1, 300)}%",
    ])


def examples(found: list[tuple[str, list[tuple[int, int, int]]]], seed: int = 7) -> list[Example]:
    """Sampled regions, each find also rewritten, and look-alikes among the words around."""
    rng = random.Random(seed)
    out = [example(text, spans) for text, spans in found]
    words = [w for text, _ in found for w in text.split() if w.isalpha()] or ["and"]
    for text, spans in found:
        for kind, a, b in spans:
            new = rewritten(rng, kind, text[a:b])
            cue = rng.choice([*CUES[kind], *[rng.choice(words)] * 8])
            before, after = f"{cue} ", rng.choice([" ", ", ", ". ", "!! "]) + rng.choice(words)
            out.append(example(before + new + after, [(kind, len(before), len(before) + len(new))]))
    for _ in range(len(found)):
        out.append(example(f"{rng.choice(words)} {look_alike(rng)}{rng.choice([' ', '. ', ', '])}{rng.choice(words)}", []))
    return [e for e in out if e is not None]


def fit_field(data: list[Example], steps: int = 70, l2: float = 2e-5) -> Field | None:
    """Weights of greatest conditional likelihood, by adaptive gradient steps over all examples.

    All examples go forward and backward side by side; a label's segments end at each token.
    """
    if not any(e.gold for e in data):
        return None
    k, size = len(KINDS), max(len(e.tokens.words) for e in data)
    n_of = np.array([len(e.tokens.words) for e in data])
    rows, firsts, lengths, mats = [], [], [], []
    for i, e in enumerate(data):
        feats = SpanFeatures(e.tokens)
        first, length = feats.spans(0, feats.n)
        rows.append(np.full(len(first), i)), firsts.append(first), lengths.append(length), mats.append(feats.matrix(first, length))
    row, first, length, x = (np.concatenate(v) for v in (rows, firsts, lengths, mats))
    place = {key: j for j, key in enumerate(zip(row.tolist(), first.tolist(), length.tolist()))}
    gold = np.zeros((len(x), k), np.float32)
    moves_gold = np.zeros((k + 1, k + 1))
    for i, e in enumerate(data):
        labels, at = [], 0
        for kind, a, n in e.gold:
            labels += [k] * (a - at) + [kind]
            at = a + n
            if (j := place.get((i, a, n))) is not None:
                gold[j, kind] = 1
        labels += [k] * (n_of[i] - at)
        for a, b in zip([k, *labels], labels):
            moves_gold[a, b] += 1
    wide = x.shape[1]
    theta, m, v = (np.zeros(wide * k + (k + 1) ** 2) for _ in range(3))
    for step in range(1, steps + 1):
        w, moves = theta[: wide * k].reshape(wide, k), theta[wide * k :].reshape(k + 1, k + 1)
        p, seen = _marginals(x @ w.astype(np.float32), row, first, length, moves, n_of, size)
        grad = np.concatenate([(x.T @ (p - gold)).ravel(), (seen - moves_gold).ravel()]) / len(data) + l2 * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta = theta - 0.2 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Field(theta[: wide * k].reshape(wide, k), theta[wide * k :].reshape(k + 1, k + 1))


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)


def _marginals(score, row, first, length, moves, n_of, size):
    """P(segment) of each span and kind, and the expected moves, by a forward and backward pass."""
    n, k = len(n_of), score.shape[1]
    s = np.full((n, size + 1, LONGEST + 1, k), -np.inf, np.float32)  # by start
    s[row, first, length] = score
    alpha = np.full((size + 1, n, k + 1), -np.inf)
    alpha[0, :, k] = 0
    into = np.full((size + 1, n, k + 1), -np.inf)  # log of all ways to start a segment here
    for t in range(size + 1):
        if t:
            alpha[t, :, k] = into[t - 1, :, k]
            reach = range(1, min(t, LONGEST) + 1)
            ends = np.stack([into[t - ell, :, :k] + s[:, t - ell, ell] for ell in reach])
            alpha[t, :, :k] = _log_sum(ends, 0)
        into[t] = _log_sum(alpha[t][:, :, None] + moves[None], 1)
    z = _log_sum(alpha[n_of, np.arange(n)], 1)
    beta = np.full((size + 1, n, k + 1), -np.inf)
    out = np.full((size + 1, n, k + 1), -np.inf)  # log of all ways on from a segment that starts here
    for t in range(size, -1, -1):
        if t < size:
            out[t, :, k] = beta[t + 1, :, k]
            reach = range(1, min(size - t, LONGEST) + 1)
            out[t, :, :k] = _log_sum(np.stack([beta[t + ell, :, :k] + s[:, t, ell] for ell in reach]), 0)
        beta[t] = _log_sum(moves[None] + out[t][:, None, :], 2)
        beta[t][n_of == t] = 0
        beta[t][n_of < t] = -np.inf
    p = np.exp(into[first, row, :k] + score + beta[first + length, row, :k] - z[row][:, None])
    with np.errstate(invalid="ignore"):
        ways = alpha[:, :, :, None] + moves[None, None] + out[:, :, None, :] - z[None, :, None, None]
    return p.astype(np.float32), np.exp(np.where(np.isnan(ways), -np.inf, ways)).sum((0, 1))


# --- documents ------------------------------------------------------------------------------


def sampled_regions(rows: DataFrame, sample: int, sample_docs: int) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """At most ``sample`` distinct regions with their rule spans, from about ``sample_docs`` rows;
    half of them hold a span, if there are as many. Hashes choose, so the choice is the same each time."""
    arrow = to_arrow_schema(T.StructType.fromDDL("region string, spans array<int>"))

    def run(batches):
        for batch in batches:
            made = []
            for text in batch.column(0).to_pylist():
                text = (text or b"").decode("utf-8", "replace")
                for a, b in regions(text):
                    if b - a <= 8 * SAMPLE_TOKENS:
                        made.append((text[a:b], [x for s in rule_spans(text[a:b]) for x in s]))
            yield record_batch(made, arrow)

    n = rows.count()
    part = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) < int((1 << 20) * min(1.0, sample_docs / max(1, n)))
    found = rows.where(part).select("text").mapInArrow(run, "region string, spans array<int>").distinct()
    ranked = found.withColumn("h", F.xxhash64("region"))
    out = []
    for some in (F.size("spans") > 0, F.size("spans") == 0):
        for r in ranked.where(some).orderBy("h", "region").limit(sample // 2).collect():
            s = r["spans"]
            out.append((r["region"], [tuple(s[i : i + 3]) for i in range(0, len(s), 3)]))
    return out


FIELDS = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def find_private(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added.

    The counts and the checksum are of the rules' spans; ``spans`` holds those and what the field
    adds, none of which overlaps them, as kind:start:end in code points. Null, empty and blank texts
    have none; texts are read whole, however long. Null ids and repeated rows get a row each. Without
    a find in the sample there is no field and nothing is added. Other columns are not read.
    """
    rows = slim(docs, id_col, text_col)
    field = fit_field(examples(sampled_regions(rows, sample, sample_docs)))
    sent = docs.sparkSession.sparkContext.broadcast(field)

    def make():
        def judge(raw: bytes) -> tuple:
            text = raw.decode("utf-8", "replace")
            base = rule_spans(text)
            added = added_spans(sent.value, text, base)
            counts = [sum(k == kind for k, _, _ in base) for kind in range(len(KINDS))]
            digest = hashlib.sha256(written(base).encode()).hexdigest()
            return (*counts, digest, written(base + added), len(added))

        return judge

    return map_texts(rows, make, FIELDS)
