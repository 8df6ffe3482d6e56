"""Tokens of many texts at once, in numpy: code points, classes, rolling hashes. No token becomes a Python object.

A token is a run of letters (with apostrophes or hyphens between letters), a run of digits (with marks between digits), one
character of a script without blanks, or a stop: a sentence end or line breaks. Words are known by a 64-bit rolling hash of
their lower-case letters, so the hash of each of their prefixes (the path of a trie node) costs one subtraction.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np

# Marks that end a sentence; those of the second kind do so whatever follows.
STOP_MARKS, WIDE_STOPS = frozenset(".!?。！？।॥؟۔｡"), frozenset("。！？।॥｡")
OTHER, LETTER, DIGIT, SINGLE, STOP, LINE, BREAK, UNSEEN = 0, 1, 2, 3, 4, 5, 6, 255
# Code point ranges of scripts that are written without blanks.
SINGLES = ((0xE00, 0xE80), (0x3040, 0x3100), (0x31F0, 0x3200), (0x3400, 0xA000), (0xF900, 0xFB00), (0x20000, 0x40000))
# Code point ranges by which scripts are told; 1 stands for Latin letters below 0x250.
SCRIPTS = ("", "latin", "el", "ru", "ar", "hi", "th", "kana", "han")
RANGES = ((2, 0x370, 0x400), (3, 0x400, 0x530), (4, 0x600, 0x700), (5, 0x900, 0x980), (6, 0xE00, 0xE80), (7, 0x3040, 0x3100), (8, 0x3400, 0xA000))
#: Code points that are worked on at once (a longer text is worked on whole).
CHUNK = 1 << 19

_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)
_U = np.uint64


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Table:
    """What is known of each code point; filled in when a code point is first seen."""

    def __init__(self) -> None:
        n = 0x110000
        self.kind = np.full(n, UNSEEN, np.uint8)
        self.value = np.zeros(n, np.uint64)
        self.upper, self.closing, self.wide = np.zeros(n, bool), np.zeros(n, bool), np.zeros(n, bool)
        self.script = np.zeros(n, np.uint8)
        self.powers = self.backs = np.ones(1, np.uint64)

    def learn(self, points: np.ndarray) -> np.ndarray:
        """The classes of ``points``."""
        kinds = self.kind[points]
        new = points[kinds == UNSEEN]
        if not len(new):
            return kinds
        for p in np.unique(new).tolist():
            c = chr(p)
            group = unicodedata.category(c)
            if c in STOP_MARKS:
                kind = STOP
            elif c == "\n":
                kind = LINE
            elif group[0] in "LM":
                kind = SINGLE if any(low <= p < high for low, high in SINGLES) else LETTER
            else:
                kind = DIGIT if group[0] == "N" else OTHER
            self.kind[p], self.upper[p], self.wide[p] = kind, c.isupper(), c in WIDE_STOPS
            self.closing[p] = c.isspace() or group in ("Pe", "Pf") or c in "\"'"
            self.script[p] = 1 if p < 0x250 and c.isalpha() else next((k for k, low, high in RANGES if low <= p < high), 0)
            self.value[p] = _mixed(np.array([ord(c.lower()[0]) + 1], _U))[0]
        return self.kind[points]

    def reach(self, n: int) -> None:
        if len(self.powers) <= n:
            for name, base in (("powers", _BASE), ("backs", _BACK)):
                steps = np.full(n + 1, base, _U)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=_U))


TABLE = Table()
NUMBER, BEGIN = _U(0x1234567), _U(0x7654321)  # any number; the start of a sentence


def chunks(texts: list[str], most: int = CHUNK) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of about ``most`` code points each."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t) + 1
        if size >= most:
            yield first, texts[first : i + 1]
            first, size = i + 1, 0
    if first < len(texts):
        yield first, texts[first:]


class Tokens:
    """The tokens of ``texts`` in order: arrays ``row, start, end, kind, hash, stop, upper, size``."""

    def __init__(self, texts: list[str], joined: bool = True):
        table = TABLE
        self.texts = len(texts)
        self.points = points = np.frombuffer("\x00".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        n = len(points)
        table.reach(n)
        self.lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.breaks = np.cumsum(self.lengths + 1) - 1  # where the mark after each text stands
        kinds = table.learn(points)
        kinds[self.breaks] = BREAK
        if joined:
            inner = np.flatnonzero((points == 0x2019) | (points == 0x27) | (points == 0x2D))
            inner = inner[(inner > 0) & (inner < n - 1)]
            inner = inner[(kinds[inner - 1] == LETTER) & (kinds[inner + 1] == LETTER)]
            marks = np.flatnonzero((points == 0x2E) | (points == 0x2C) | (points == 0x3A))
            marks = marks[(marks > 0) & (marks < n - 1)]
            marks = marks[(kinds[marks - 1] == DIGIT) & (kinds[marks + 1] == DIGIT)]
            kinds[inner], kinds[marks] = LETTER, DIGIT
        new = np.empty(n, bool)
        new[:1] = True
        np.not_equal(kinds[1:], kinds[:-1], out=new[1:])
        new |= kinds == SINGLE
        at = np.flatnonzero(new)
        kind, until = kinds[at], np.append(at[1:], n)
        keep = (kind != OTHER) & (kind != BREAK)
        start, end, kind = at[keep], until[keep], kind[keep]
        # A run of stop marks is a stop before a blank, a closing mark or the end, or if it holds a wide one.
        stops = np.flatnonzero(kind == STOP)
        after = np.minimum(end[stops], n - 1)
        fine = table.closing[points[after]] | (kinds[after] == BREAK) | (kinds[after] == LINE) | table.wide[points[start[stops]]] | table.wide[points[end[stops] - 1]]
        good = np.ones(len(start), bool)
        good[stops] = fine
        self.start, self.end, self.kind = start[good], end[good], kind[good]
        self.sums = np.zeros(n + 1, _U)
        np.cumsum(table.value[points] * table.powers[:n], out=self.sums[1:])
        self.size = self.end - self.start
        self.hash = self.prefix_hash(self.start, self.end)
        self.hash[self.kind == DIGIT] = NUMBER
        self.stop = self.kind >= STOP
        self.upper = table.upper[points[self.start]] if len(self.start) else np.zeros(0, bool)
        self.row = np.searchsorted(self.breaks, self.start)

    def prefix_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The hash of the characters from ``start`` up to ``end``."""
        return (self.sums[end] - self.sums[start]) * TABLE.backs[start]

    def before(self) -> np.ndarray:
        """How many tokens stand between each token and the beginning of its sentence."""
        n = len(self.row)
        at = np.arange(n)
        mark = np.where(self.stop, at, -1)
        first = np.ones(n, bool)
        first[1:] = self.row[1:] != self.row[:-1]
        mark = np.where(first & ~self.stop, at - 1, mark)
        return at - np.maximum.accumulate(mark) - 1 if n else at

    def last(self) -> np.ndarray:
        """Whether a token is the last of its text."""
        out = np.ones(len(self.row), bool)
        out[:-1] = self.row[1:] != self.row[:-1]
        return out

    def scripts(self) -> np.ndarray:
        """Characters of each of ``SCRIPTS`` by text."""
        rows = np.repeat(np.arange(self.texts), self.lengths + 1)
        return np.bincount(rows * len(SCRIPTS) + TABLE.script[self.points], minlength=self.texts * len(SCRIPTS)).reshape(self.texts, len(SCRIPTS))


def tagged(tag: int, *parts: np.ndarray) -> np.ndarray:
    """One hash of several, in order."""
    out = np.full(len(parts[0]), tag, _U)
    for p in parts:
        out = (out + p) * _U(_BASE) ^ (out >> _U(32))
    return _mixed(out)


WORD, NODE, THREE, TWO, CAPITAL, ONE = 11, 12, 13, 14, 15, 16
#: Tokens that a context in scripts without blanks reaches over.
REACHES = (6, 4, 2)


def contexts(t: Tokens, at: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(positions within ``at``, keys, whether the key reaches back to the sentence's beginning), strongest kind first.

    A key stands for a token after its predecessors in the sentence. Scripts without blanks use the last 6, 4 and 2 characters,
    others the last 3, 2 and 1 words; a capitalised word within a sentence also has a key that stands for any such word.
    """
    far, kind = t.before()[at], t.kind[at]
    here = np.arange(len(at))
    back = lambda i, k: np.where(far[i] >= k, t.hash[np.maximum(at[i] - k, 0)], BEGIN)
    out = []
    single = here[kind == SINGLE]
    for reach in REACHES:
        i = single[far[single] >= reach - 2]
        out.append((i, tagged(20 + reach, t.hash[at[i]], *[back(i, k) for k in range(1, reach)]), far[i] == reach - 2))
    word = here[kind != SINGLE]
    i = word[far[word] >= 1]
    out.append((i, tagged(THREE, t.hash[at[i]], back(i, 1), back(i, 2)), far[i] == 1))
    out.append((word, tagged(TWO, t.hash[at[word]], back(word, 1)), far[word] == 0))
    # One or two letters say nothing alone: they are as often the beginning of a word.
    long = t.size[at] > 2
    i = word[(far[word] >= 1) & t.upper[at[word]] & long[word]]
    out.append((i, tagged(CAPITAL, back(i, 1)), np.zeros(len(i), bool)))
    i = word[long[word] | (kind[word] == DIGIT)]
    out.append((i, tagged(ONE, t.hash[at[i]]), np.zeros(len(i), bool)))
    return out


def last_keys(texts: list[str]) -> list[list[int] | None]:
    """Of each text's last token: its keys as a word and as a trie node, then its contexts, strongest first; None if the text
    holds no token or ends with a stop."""
    out: list[list[int] | None] = [None] * len(texts)
    for first, some in chunks(texts):
        t = Tokens(some)
        at = np.flatnonzero(t.last() & ~t.stop)
        rows = t.row[at]
        found: list[list[int]] = [[a, b] for a, b in zip(tagged(WORD, t.hash[at]).view(np.int64).tolist(), tagged(NODE, t.prefix_hash(t.start[at], t.end[at])).view(np.int64).tolist())]
        for i, keys, _ in contexts(t, at):
            for k, key in zip(i.tolist(), keys.view(np.int64).tolist()):
                found[k].append(key)
        for r, keys in zip(rows.tolist(), found):
            out[first + r] = keys
    return out


def summed(keys: np.ndarray, *weights: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys with the sums of their weights."""
    order = np.argsort(keys, kind="stable")
    sorted_keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return (sorted_keys[first], *(np.add.reduceat(w[order], first) if len(keys) else w for w in weights))


def word_counts(texts: list[str], marks: tuple[int, ...] = ()) -> dict[int, int]:
    """How often each word (its hash, as a signed number) and each of ``marks`` (its code point) stands in ``texts``."""
    out: dict[int, int] = {}
    for _, some in chunks(texts):
        t = Tokens(some, joined=False)
        for found in (t.hash[t.kind == LETTER].view(np.int64), t.points[np.isin(t.points, marks)]):
            keys, n = np.unique(found, return_counts=True)
            for k, m in zip(keys.tolist(), n.tolist()):
                out[k] = out.get(k, 0) + m
    return out


def corpus_keys(texts: list[str], asked) -> tuple[np.ndarray, np.ndarray, np.ndarray]:  # noqa: ANN001
    """(keys, how often seen, how often at the end of a unit) of all tokens of ``texts``, for keys of which ``asked(keys)`` is true.

    Keys are words, trie nodes (each proper prefix of each word, by its path) and contexts. A context ends a unit where a
    stop follows it; the end of a text counts only for contexts that reach back to the sentence's beginning.
    """
    t = Tokens(texts)
    last, token = t.last(), ~t.stop
    followed = np.zeros(len(t.row), bool)
    followed[:-1] = t.stop[1:] & ~last[:-1]
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def take(keys: np.ndarray, seen: np.ndarray, ends: np.ndarray) -> None:
        yes = asked(keys)
        found.append((keys[yes], seen[yes], ends[yes]))

    # Words and nodes: equal words once, a text's last word not at all (it may be cut). Nodes level by level.
    whole = np.flatnonzero(token & ~last)
    order = whole[np.argsort(t.hash[whole], kind="stable")]
    if len(order):
        head = np.flatnonzero(np.concatenate([[True], t.hash[order[1:]] != t.hash[order[:-1]]]))
        often = np.diff(np.append(head, len(order)))
        one = order[head]
        take(tagged(WORD, t.hash[one]), often, np.zeros(len(one), np.int64))
        depth = 1
        while len(one):
            deeper = (t.size[one] > depth) & (t.kind[one] == LETTER)
            one, often = one[deeper], often[deeper]
            if len(one):
                nodes, count = summed(t.prefix_hash(t.start[one], t.start[one] + depth), often)
                take(tagged(NODE, nodes), count, np.zeros(len(nodes), np.int64))
            depth += 1
    at = np.flatnonzero(token)
    stops, final = followed[at], last[at]
    for i, keys, reaching in contexts(t, at):
        take(keys, np.ones(len(i), np.int64), (stops[i] | final[i] & reaching).astype(np.int64))
    return summed(np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]), np.concatenate([f[2] for f in found]))
