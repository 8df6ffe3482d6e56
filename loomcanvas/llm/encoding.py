"""Problem 1: text garbled by a wrong decoding, found and restored by minimum description length.

A candidate undoes one wrong decoding in some of a text's sentences; chains are built step by step for as long as the
description gets shorter. The description length of a text is what zstandard needs for it with the best of the
per-language dictionaries (trained on the documents), plus an escape for each character outside that language's alphabet,
plus a cost per step of the chain; the shortest description wins, and the text as it stands is one of the candidates.

Every candidate is compressed with every dictionary but those whose escapes alone make it longer than the text as it stands:
that bound is exact, so leaving them out never changes the choice. Texts are solved in batches, so that equal sentences
and candidates are compressed once, by one call per dictionary. A step can only pay in a text if it does in one of its sentences;
what it does to the others is weighed then. The one-byte steps are made for all sentences at once, on arrays of code points.
"""

from __future__ import annotations

import codecs
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomcanvas.llm import lexing
from loomcanvas.plans.frames import cut, partitions_for, spread

#: Bytes that a step of a chain costs: UTF-8 read otherwise (its form alone is evidence), and all other steps.
UTF8_COST, OTHER_COST = 2, 4
#: Bytes that a character outside the alphabet costs, an ASCII letter outside it, and one that a candidate could not decode.
ESCAPE, ASCII_ESCAPE, UNDECODED = 3, 1, 6
#: Bytes that it costs to say that a text is in capitals, and to change the script within a word.
CAPITALS, SWITCH = 2, 3
#: Bytes that every zstandard frame has at least: magic number, two of its header, header of a block. A block of bytes that are not all
#: alike has BLOCK more, or as many as there are bytes: headers of literals and sequences, and a byte of bits.
FRAME, BLOCK = 9, 4
#: A token is known if texts in memory have it this often.
KNOWN = 2
#: A letter is in a language's alphabet if this share of its texts has it; ASCII letters are if they make this share of its letters.
ALPHABET_SHARE, ASCII_SHARE = 0.002, 0.3
#: Bytes of a dictionary, characters of a language's documents that one is trained on at once (about), dictionaries that are merged at
#: once, bytes of the pieces that they are cut into for that, and bytes before the contents of a trained one (about).
DICTIONARY_BYTES, GROUP_CHARS, FAN, PIECE, HEADER = 16_384, 4_000_000, 64, 64, 256
#: Levels at which candidates are compared, and at which the winner of a step is confirmed.
LEVEL, CONFIRM_LEVEL = 3, 19
#: Bytes by which the quick comparison may be wrong; within them the confirmation decides.
DOUBT = 3
#: Bytes by which a dictionary may be behind the best one and still be confirmed.
CLOSE = 12
#: Chains of a text that are followed at once where the step that saves most does not lead to a clean text.
BEAM = 3
#: Code points from here on are alike: none is in an alphabet.
FAR = 0x20000
#: Sentences whose choices are kept for the next batch, where fewer are kept already.
MOST_KEPT = 100_000
#: Texts that are solved together.
BATCH = 10_000
#: Sentences of at most this many characters are worked on by arrays.
SHORT = 1 << 16
LANGUAGES = ("ar", "de", "el", "en", "es", "fr", "hi", "ja", "pt", "ru", "th", "zh")
# Encodings that UTF-8 is often read as, one byte or several bytes a character.
READ_AS = ("cp1252", "mac_roman", "cp437", "cp850", "cp1250", "cp1251", "cp1254", "koi8_r", "cp866")
READ_AS_WIDE = ("gb18030", "cp932", "big5", "euc_kr")
# Fixed values: (true encoding, encoding it was read as) of one-byte texts.
SWAPPED = (
    ("cp1252", "mac_roman"), ("cp1252", "cp1251"), ("mac_roman", "cp1252"), ("cp437", "cp1252"), ("cp850", "cp1252"),
    ("cp1251", "cp1252"), ("cp1251", "koi8_r"), ("cp1251", "mac_roman"), ("koi8_r", "cp1251"), ("koi8_r", "cp1252"),
    ("cp866", "cp1251"), ("cp866", "cp1252"), ("cp1253", "cp1252"),
)
# Several-byte encodings whose bytes were read one by one.
WIDE_AS_LATIN = ("gb18030", "cp932", "big5", "euc_jp", "euc_kr")
SENTENCE_END = re.compile("[.!?][\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]|\n")
SMALL = re.compile("[a-z]")
#: Between the parts that a dictionary is trained on, sentences or lines.
TRAINED_PART = re.compile(r"([.!?。！？।])\s?|\n")
#: A trained dictionary's first bytes.
MAGIC = b"\x37\xa4\x30\xec"
LOST = "\ufffd"
#: Stands for what a candidate could not decode, so that it is told from a replacement character in the text.
GAP = "\ue0ff"
Undo = Callable[[str, set[str]], str | None]


def one_byte(name: str) -> dict[str, int]:
    """Character -> byte of a one-byte encoding; bytes it leaves undefined stand for the control of that number."""
    out: dict[str, int] = {}
    for b in range(128, 256):
        try:
            out[codecs.decode(bytes([b]), name)] = b
        except UnicodeDecodeError:
            pass
        out.setdefault(chr(b), b) if b < 160 else None
    return out


def utf8_read_as(name: str) -> Undo:
    """Turn every stretch of characters whose bytes in ``name`` are whole UTF-8 sequences back; keep all else.

    A no-break space that was made a blank is taken as a byte A0 inside a sequence.
    """
    table = one_byte(name)
    space = next((c for c, b in table.items() if b == 0xA0), None)
    many = table | ({" ": 0xA0} if space == "\xa0" else {})
    of = lambda low, high, t=table: {c for c, b in t.items() if low <= b <= high}
    group = lambda *a: "[" + "".join(re.escape(c) for c in sorted(of(*a))) + "]"
    follow, firm = group(0x80, 0xBF, many), group(0x80, 0xBF)
    leads, follows = frozenset(of(0xC2, 0xF4)), frozenset(of(0x80, 0xBF, many))
    spaced = f"|{group(0xC3, 0xC3)} " if " " in many else ""
    found = re.compile(f"{group(0xC2, 0xDF)}{firm}{spaced}|{group(0xE0, 0xEF)}{follow}{firm}|{group(0xE0, 0xEF)}{firm}{follow}|{group(0xF0, 0xF4)}{firm}{follow}{firm}|{group(0xF0, 0xF4)}{firm}{{3}}")

    def back(m: re.Match) -> str:
        try:
            return bytes(many[c] for c in m[0]).decode("utf-8")
        except UnicodeDecodeError:
            return m[0]

    return lambda text, chars: None if leads.isdisjoint(chars) or follows.isdisjoint(chars) else found.sub(back, text)


def utf8_read_as_wide(name: str) -> Undo:
    def undo(text: str, chars: set[str]) -> str | None:
        try:
            raw = text.encode(name)
        except UnicodeEncodeError:
            return None
        try:
            return raw.decode("utf-8")
        except UnicodeDecodeError:
            out = raw.decode("utf-8", "replace").replace(LOST, GAP)
            return out if 2 * out.count(GAP) < len(out) - len(out.encode("ascii", "ignore")) else None

    return undo


def utf8_marks(name: str) -> tuple[list[int], list[int], list[int]]:
    """Characters that begin a sequence of two and of more for ``utf8_read_as``, and those that may follow."""
    table = one_byte(name)
    of = lambda low, high: [ord(c) for c, b in table.items() if low <= b <= high]
    return of(0xC2, 0xDF), of(0xE0, 0xF4), [*of(0x80, 0xBF), *([0x20] if table.get("\xa0") == 0xA0 else [])]


def swap_table(true: str, read: str) -> dict[int, str]:
    back = {b: c for c, b in one_byte(true).items() if b >= 160 or ord(c) >= 160}
    return {ord(c): back[b] for c, b in one_byte(read).items() if b in back}


def swapped(true: str, read: str) -> Undo:
    back = {b: c for c, b in one_byte(true).items() if b >= 160 or ord(c) >= 160}
    table = swap_table(true, read)
    keys = frozenset(map(chr, table))
    # The same by way of the bytes, which is faster, where the text has no other characters than the encoding's.
    standing = bytes(range(256)).decode(read, "replace").replace(LOST, "\ufffe")
    to_bytes, other = codecs.charmap_build(standing), "".join(back.get(b, c) if b > 127 else c for b, c in enumerate(standing))

    def undo(text: str, chars: set[str]) -> str | None:
        if keys.isdisjoint(chars):
            return None
        try:
            return codecs.charmap_decode(codecs.charmap_encode(text, "strict", to_bytes)[0], "strict", other)[0]
        except UnicodeError:
            return text.translate(table)

    return undo


def sentences(text: str) -> list[str]:
    """``text`` cut behind every line break and every mark of a sentence's end that a blank follows."""
    cuts = [0, *[m.end() for m in SENTENCE_END.finditer(text)], len(text)]
    return [text[a:b] for a, b in zip(cuts, cuts[1:])]


def encodes(char: str, name: str) -> bool:
    try:
        return bool(char.encode(name))
    except UnicodeEncodeError:
        return False


LATIN_BYTES = {ord(c): b for c, b in one_byte("cp1252").items()} | {i: i for i in range(128)}
LATIN_CHARS = frozenset(map(chr, LATIN_BYTES))


def wide_read_as_latin(name: str) -> Undo:
    def undo(text: str, chars: set[str]) -> str | None:
        if not chars <= LATIN_CHARS:
            return None
        try:
            return codecs.charmap_encode(text, "strict", LATIN_BYTES)[0].decode(name)
        except UnicodeError:
            return None

    return undo


class Unscrambler:
    """Chooses for each text the chain with the shortest description, step by step."""

    def __init__(self, models: dict[str, tuple[bytes, str]]):
        models = dict(models)
        seen, known = models.pop("", (b"", ""))
        self.known = np.unique(np.array([0, *map(int, known.split())], np.uint64))
        # Of sentences, kept from batch to batch: steps that may pay, quick lengths, and what a step makes of one and saves.
        self.choices: dict[str, tuple[int, ...]] = {}
        self.quick: dict[str, int] = {}
        self.weighed: dict[tuple[str, int], tuple[str, int] | None] = {}
        self.packers: list[tuple[zstandard.ZstdCompressor, ...]] = []
        # What a code point costs in each language beyond its compressed bytes: three languages to a word, in lanes of 21 bits.
        languages = sorted(models)
        self.costs = np.zeros((-(-max(len(languages), 1) // 3), FAR), np.uint64)
        self.each_cost = np.zeros((FAR, max(len(languages), 1)), np.int8)
        self.seen_anywhere = np.zeros(FAR, bool)
        self.seen_anywhere[:128] = True
        self.seen_anywhere[[ord(c) for c in seen.decode("utf-8", "surrogatepass") if ord(c) < FAR - 1]] = True
        self.languages_of = np.zeros(FAR, np.uint16)  # a bit for each language whose alphabet has a letter
        for i, language in enumerate(languages):
            data, alphabet = models[language]
            as_dictionary = zstandard.ZstdCompressionDict(data)
            self.packers.append(tuple(zstandard.ZstdCompressor(level=level, dict_data=as_dictionary, write_content_size=False, write_checksum=False, write_dict_id=False) for level in (LEVEL, CONFIRM_LEVEL)))
            cost = np.full(FAR, ESCAPE, np.uint64)
            cost[:128] = 0
            letters = np.array([ord(c) for c in alphabet if ord(c) < FAR - 1], np.int64)
            if "a" not in alphabet:
                for c in map(ord, "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"):
                    cost[c] = ASCII_ESCAPE
            cost[letters] = 0
            cost[ord(GAP)] = UNDECODED
            self.costs[i // 3] |= cost << np.uint64(21 * (i % 3))
            self.each_cost[:, i] = cost
            own = np.array([c for c in letters.tolist() if chr(c).isalpha()], np.int64)
            self.languages_of[own] |= np.uint16(1 << i)
            if "a" in alphabet:
                for low, high in ((65, 91), (97, 123)):
                    self.languages_of[low:high] |= np.uint16(1 << i)
        self.steps: list[tuple[str, Undo, int]] = [(f"utf-8<{x}", utf8_read_as(x), UTF8_COST) for x in READ_AS]
        self.steps += [(f"utf-8<{x}", utf8_read_as_wide(x), UTF8_COST) for x in READ_AS_WIDE]
        self.steps += [(f"{t}<{r}", swapped(t, r), OTHER_COST) for t, r in SWAPPED] + [(f"{x}<cp1252", wide_read_as_latin(x), OTHER_COST) for x in WIDE_AS_LATIN]
        # Characters that were given up when the text was decoded: their places can be named, not filled.
        self.steps.append(("lost", lambda text, chars: text.replace(LOST, "") if LOST in chars else None, UTF8_COST))
        # Bytes that a step saves in one sentence of a text at least, if all that it saves there is to exceed its cost less DOUBT.
        self.least = [int(cost - DOUBT >= 0) for _, _, cost in self.steps]
        # What the steps look for, by code point: a bit for each of READ_AS where it begins a sequence of two, of more, where it may follow.
        self.sequences = np.zeros((3, FAR), np.uint16)
        for k, name in enumerate(READ_AS):
            for marks, points in zip(self.sequences, utf8_marks(name)):
                marks[points] |= np.uint16(1 << k)
        self.first_swap = len(READ_AS) + len(READ_AS_WIDE)
        self.swaps = np.tile(np.arange(FAR, dtype=np.uint32), (len(SWAPPED), 1))
        for k, pair in enumerate(SWAPPED):
            for c, to in swap_table(*pair).items():
                self.swaps[k, c] = ord(to)
        lexing.TABLE.learn(np.unique(self.swaps[self.swaps != np.arange(FAR)]))
        self.swapped_at_all = (self.swaps != np.arange(FAR)).any(axis=0)
        self.latin = np.full(FAR, 256, np.int16)  # the byte of LATIN_BYTES
        self.latin[list(LATIN_BYTES)] = list(LATIN_BYTES.values())
        self.encodable = np.full(FAR, 255, np.uint8)  # a bit for each of READ_AS_WIDE that has a character; 255: not looked up
        self.encodable[FAR - 1] = 15

    def escapes(self, texts: list[str]) -> np.ndarray:
        """Bytes that each text costs in each language beyond its compressed ones (texts by languages)."""
        out = np.zeros((len(texts), max(len(self.packers), 1)), np.int64)
        if not self.packers:
            return out
        for first, some in lexing.chunks(texts):
            points = np.frombuffer("".join(some).encode("utf-32-le", "surrogatepass"), np.uint32)
            near = np.minimum(points, FAR - 1)
            starts = np.concatenate([[0], np.cumsum([len(t) for t in some[:-1]], dtype=np.int64)]).astype(np.int64)
            lexing.TABLE.learn(points)
            scripts = np.minimum(lexing.TABLE.script[points], len(lexing.SCRIPTS) - 2)  # kana and han are one here
            switch = np.zeros(len(points), np.int64)
            switch[1:] = (scripts[1:] != scripts[:-1]) & (scripts[1:] > 0) & (scripts[:-1] > 0)
            switch[starts] = 0
            switches = SWITCH * np.add.reduceat(switch, starts)
            for i in range(len(self.packers)):
                if max(map(len, some)) < 1 << 19:
                    if i % 3 == 0:
                        sums = np.add.reduceat(self.costs[i // 3][near], starts)
                    out[first : first + len(some), i] = ((sums >> np.uint64(21 * (i % 3))) & np.uint64(0x1FFFFF)) + switches.astype(np.uint64)
                else:
                    out[first : first + len(some), i] = np.add.reduceat((self.costs[i // 3][near] >> np.uint64(21 * (i % 3))) & np.uint64(0x1FFFFF), starts) + switches.astype(np.uint64)
        return out

    def described(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """What is compressed of each text, and its ``escapes``: a text in capitals is described as the same in small letters."""
        capitals = np.fromiter((t.isupper() for t in texts), bool, len(texts))
        texts = [t.lower() if up else t for t, up in zip(texts, capitals.tolist())]
        return texts, self.escapes(texts) + CAPITALS * capitals[:, None]

    def lengths(self, texts: list[str], bounds: np.ndarray | None = None, firm: bool = False, rough: bool = False, extra: np.ndarray | None = None) -> np.ndarray:
        """Bytes of the shortest description of each (non-empty) text over all dictionaries; descriptions longer than its
        bound are not told apart (they come out as some length above it). Without bounds the shortest is exact, or if ``rough`` that over
        the likely dictionaries. ``firm`` lengths are those of the higher level, over the dictionaries that come within CLOSE bytes of the
        best at the lower one. ``extra``: what ``described`` gives, if the texts are as it gives them."""
        if not self.packers or not texts:
            return np.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], np.int64)
        if extra is None:
            texts, extra = self.described(texts)
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        floor = FRAME + np.where(sizes == np.fromiter(map(len, texts), np.int64, len(texts)), 1, np.minimum(sizes, BLOCK))  # ASCII or not
        size = np.full(extra.shape, 1 << 40, np.int64)

        def compress(which: np.ndarray, level: int) -> None:
            for i, packers in enumerate(self.packers):
                rows = np.flatnonzero(which[:, i])
                for at in range(0, len(rows), 20_000):
                    part = rows[at : at + 20_000]
                    some = [raw[r] for r in part.tolist()]
                    # A call for many texts costs as much beforehand as some hundred single ones.
                    packed = packers[level].multi_compress_to_buffer(some, threads=0) if len(some) > 2_000 else map(packers[level].compress, some)
                    size[part, i] = np.fromiter(map(len, packed), np.int64, len(part)) + extra[part, i]

        if bounds is None:
            likely = extra == extra.min(axis=1, keepdims=True)
            compress(likely, 0)  # likely languages first, then all that could still be better
            if not rough:
                compress(~likely & (extra + floor[:, None] <= size.min(axis=1)[:, None]), 0)
        else:
            compress(extra + floor[:, None] <= bounds[:, None], 0)
        if not firm:
            return size.min(axis=1)
        near = (size <= size.min(axis=1)[:, None] + CLOSE) & (size < 1 << 40)
        size[:] = 1 << 40
        compress(near, 1)
        return size.min(axis=1)

    def suspects(self, texts: list[str | None]) -> list[int]:
        """Positions of the texts that may be garbled: they hold a character that the sample has not, or a token beyond ASCII that it
        has not and that is no plain word.

        A plain word has four letters or more, all of one language's alphabet and none but the first in capitals: what a wrong
        decoding makes of letters are marks, letters of other languages, or capitals within words. A quick look at texts in memory only:
        no query leaves texts out by it.
        """
        wide = [i for i, t in enumerate(texts) if t and not t.isascii()]
        out: set[int] = set()
        for first, some in lexing.chunks([texts[i] for i in wide]):
            t = lexing.Tokens(some, joined=False)
            near = np.minimum(t.points, FAR - 1)
            strange = ~self.seen_anywhere[near]
            strange[t.breaks] = False
            out.update((first + np.unique(np.searchsorted(t.breaks, np.flatnonzero(strange)))).tolist())
            beyond = np.concatenate([[0], np.cumsum(t.points > 127)])
            at = np.flatnonzero((beyond[t.end] > beyond[t.start]) & ~t.stop)
            place = np.minimum(np.searchsorted(self.known, t.hash[at]), len(self.known) - 1)
            at = at[self.known[place] != t.hash[at]]
            if not len(at):
                continue
            edges = np.column_stack([t.start[at], t.end[at]]).ravel()
            shared = np.bitwise_and.reduceat(np.append(self.languages_of[near], np.uint16(0)), edges)[::2]
            capitals = np.concatenate([[0], np.cumsum(lexing.TABLE.upper[t.points])])
            plain = (t.kind[at] == lexing.LETTER) & (t.size[at] >= 4) & (shared > 0) & (capitals[t.end[at]] == capitals[t.start[at] + 1])
            out.update((first + np.unique(t.row[at[~plain]])).tolist())
        return [wide[i] for i in sorted(out)]

    def candidates(self, part: str) -> list[tuple[int, str]]:
        """(step, text) for every step that changes ``part``."""
        chars = set(part)
        return [(k, other) for k, (_, undo, _) in enumerate(self.steps) if (other := undo(part, chars)) is not None and other != part]

    def solve_many(self, texts: Iterable[str | None]) -> list[tuple[bool, str | None, str | None]]:
        """(affected, original text or null where it can't be recovered in full, chain) of each text.

        Null, empty and ASCII texts are never affected. Replacement characters mean that something is lost for good. Texts that
        still hold a character outside of the alphabet after their best chain are solved again with BEAM chains at once.
        """
        texts = list(texts)
        best = self.search(texts, 1)
        chained = [i for i, (_, chain, _) in best.items() if chain]
        strange = self.escapes(["".join(best[i][2]) or " " for i in chained]).min(axis=1) > 0
        again = [i for i, yes in zip(chained, strange.tolist()) if yes]
        if again:
            best |= {again[k]: found for k, found in self.search([texts[i] for i in again], BEAM).items()}
        out: list[tuple[bool, str | None, str | None]] = [(False, None, None)] * len(texts)
        for i, (_, chain, parts) in best.items():
            if chain:
                whole = "".join(parts)
                lost = "lost" in chain or GAP in whole
                out[i] = (True, None if lost else whole, " ".join(chain if "lost" in chain or not lost else (*chain, "lost")))
        return out

    def swap_all(self, parts: list[str], small: np.ndarray, extra: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, np.ndarray, list[str], np.ndarray]]:
        """(step, rows, texts, escapes) of what the one-byte steps make of sentences.

        ``extra``: the sentences' ``escapes``. Those that are ``small`` have a small ASCII letter, so they are not in capitals, whatever is
        made of them: the escapes hold for them only, and what cannot be described within the row's bound is left out.
        """
        table = lexing.TABLE
        for first, some in lexing.chunks(parts):
            points = np.frombuffer("\x00".join([*some, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
            table.learn(points)
            near = np.minimum(points, FAR - 1)
            ends = np.cumsum(np.fromiter(map(len, some), np.int64, len(some)) + 1) - 1
            starts = np.concatenate([[0], ends[:-1] + 1])
            scripts = np.minimum(table.script[points], len(lexing.SCRIPTS) - 2)
            differ = lambda a, b: (a != b) & (a > 0) & (b > 0)
            touched = np.flatnonzero(self.swapped_at_all[near])
            rows_of = np.searchsorted(ends, touched)
            for k in range(len(SWAPPED)):
                to = self.swaps[k][near[touched]]
                changed = to != near[touched]
                at, to, row = touched[changed], to[changed], rows_of[changed]
                if not len(at):
                    continue
                head = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
                rows = row[head]
                more = np.add.reduceat(self.each_cost[to].astype(np.int32) - self.each_cost[near[at]], head, axis=0)
                # Changes of script before each changed character, and after it where the next one stays.
                now = scripts.copy()
                now[at] = np.minimum(table.script[to], len(lexing.SCRIPTS) - 2)
                before = np.maximum(at - 1, 0)
                moved = np.zeros(len(points) + 1, bool)
                moved[at] = True
                switches = (at > 0) * (differ(now[at], now[before]).astype(np.int32) - differ(scripts[at], scripts[before]))
                switches += ~moved[at + 1] * (differ(now[at + 1], now[at]).astype(np.int32) - differ(scripts[at + 1], scripts[at]))
                escapes = extra[first + rows] + more + SWITCH * np.add.reduceat(switches, head)[:, None]
                fine = np.flatnonzero(~small[first + rows] | (escapes.min(axis=1) + FRAME + BLOCK - 1 <= bounds[first + rows] - self.least[self.first_swap + k]))
                if len(fine):
                    new = points.copy()
                    new[at] = to
                    text = new.tobytes().decode("utf-32-le", "surrogatepass")
                    rows = rows[fine]
                    yield self.first_swap + k, first + rows, [text[a:b] for a, b in zip(starts[rows].tolist(), ends[rows].tolist())], escapes[fine]

    def other_all(self, parts: list[str]) -> list[list[tuple[int, str]]]:
        """``candidates`` of the other steps; a step is tried where a sentence holds what it looks for."""
        out: list[list[tuple[int, str]]] = [[] for _ in parts]
        wide, latin = len(READ_AS), self.first_swap + len(SWAPPED)
        for first, some in lexing.chunks(parts):
            points = np.frombuffer("\x00".join([*some, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
            near = np.minimum(points, FAR - 1)
            ends = np.cumsum(np.fromiter(map(len, some), np.int64, len(some)) + 1) - 1
            starts = np.concatenate([[0], ends[:-1] + 1])
            two, more, follow = (np.append(marks[near], np.zeros(2, np.uint16)) for marks in self.sequences)
            tries = np.bitwise_or.reduceat((two[:-2] | more[:-2] & follow[2:]) & follow[1:-1], starts).astype(np.uint32)
            for p in np.unique(near[self.encodable[near] == 255]).tolist():
                self.encodable[p] = sum(1 << k for k, name in enumerate(READ_AS_WIDE) if encodes(chr(p), name))
            have = self.encodable[near]
            have[ends] = 15
            tries |= np.bitwise_and.reduceat(have, starts).astype(np.uint32) << np.uint32(wide)
            # Of READ_AS_WIDE, what has no byte of a sequence followed by another one's comes out as gaps only.
            known = np.flatnonzero(tries >> np.uint32(wide) & 1)
            plain = [i for i in known.tolist() if "\x00" not in some[i]]
            data = np.frombuffer("\x00".join([some[i] for i in plain]).encode(READ_AS_WIDE[0]), np.uint8)
            found = np.flatnonzero((data[:-1] >= 0xC2) & (data[:-1] <= 0xF4) & (data[1:] >= 0x80) & (data[1:] <= 0xBF))
            none = np.ones(len(plain), bool)
            none[np.searchsorted(np.flatnonzero(data == 0), found)] = False
            tries[np.array(plain, np.int64)[none]] &= ~np.uint32(1 << wide)
            # One-byte texts: what is read as EUC has no byte beyond ASCII alone.
            code = self.latin[near]
            code[ends] = 0
            is_latin = np.maximum.reduceat(code, starts) < 256
            high = np.concatenate([[False], code > 127, [False]])
            alone = np.bitwise_or.reduceat(high[1:-1] & ~high[:-2] & ~high[2:], starts)
            lost = np.bitwise_or.reduceat(points == ord(LOST), starts)
            for i in np.flatnonzero(tries).tolist():
                part, bits = some[i], int(tries[i])
                chars = set(part) if bits & (1 << wide) - 1 else set()
                out[first + i] += [(k, other) for k in range(self.first_swap) if bits >> k & 1 and (other := self.steps[k][1](part, chars)) is not None and other != part]
            data = code.astype(np.uint8).tobytes()
            for step, name in enumerate(WIDE_AS_LATIN, latin):
                for i in np.flatnonzero(is_latin & ~alone if name.startswith("euc") else is_latin).tolist():
                    try:
                        other = data[starts[i] : ends[i]].decode(name)
                    except UnicodeError:
                        continue
                    if other != some[i]:
                        out[first + i].append((step, other))
            for i in np.flatnonzero(lost).tolist():
                out[first + i].append((len(self.steps) - 1, some[i].replace(LOST, "")))
        return out

    def choose(self, new: set[str]) -> None:
        """Fill in ``choices`` of some sentences: the steps whose candidate is shorter by the quick comparison, by ``least`` bytes."""
        if not new:
            return
        some = [p for p in new if self.packers and len(p) <= SHORT]
        n = len(some)
        some += new.difference(some)
        texts, extra = self.described(some)
        bounds = self.lengths(texts, rough=True, extra=extra)  # never less than the quick length
        owners: list[int] = []
        steps: list[int] = []
        others: list[str] = []
        escapes: list[np.ndarray] = []
        small = np.fromiter((SMALL.search(p) is not None for p in some[:n]), bool, n)
        more: list[tuple[int, int, str]] = []
        for step, rows, made, costs in self.swap_all(some[:n], small, extra, bounds):
            yes = small[rows]
            owners += rows[yes].tolist()
            if yes.all():
                others += made
            else:
                others += [x for x, y in zip(made, yes.tolist()) if y]
                more += [(i, step, x) for i, x, y in zip(rows.tolist(), made, yes.tolist()) if not y]
            steps += [step] * (len(others) - len(steps))
            escapes.append(costs[yes])
        more += [(i, step, other) for i, each in enumerate(self.other_all(some[:n])) for step, other in each]
        more += [(i, step, other) for i, p in enumerate(some[n:], n) for step, other in self.candidates(p)]
        m = len(others)
        owners += [i for i, _, _ in more]
        steps += [k for _, k, _ in more]
        others += [x for _, _, x in more]
        owner = np.array(owners, np.int64)
        most = bounds[owner] - np.array(self.least, np.int64)[np.array(steps, np.int64)]
        size = np.zeros(len(others), np.int64)  # nothing has no length
        for which, costs in ((range(m), escapes), ([k for k in range(m, len(others)) if others[k]], None)):
            if len(which):  # equal candidates once, within the widest of their bounds
                names: dict[str, int] = {}
                place = np.fromiter((names.setdefault(others[k], len(names)) for k in which), np.int64, len(which))
                limit = np.zeros(len(names), np.int64)
                np.maximum.at(limit, place, most[which])
                head = np.zeros(len(names), np.int64)
                head[place] = np.arange(len(which))
                size[which] = self.lengths(list(names), limit, extra=np.concatenate(costs)[head] if costs else None)[place]
        hits = np.flatnonzero(size <= most).tolist()
        self.measure({some[owners[k]] for k in hits})
        per: dict[str, list[int]] = {}
        for k in hits:
            p = some[owners[k]]
            if size[k] <= self.quick[p] - self.least[steps[k]]:
                per.setdefault(p, []).append(steps[k])
        self.choices.update((p, tuple(per.get(p, ()))) for p in some)

    def measure(self, parts: set[str]) -> None:
        """Fill in ``quick``, exact lengths at the lower level."""
        new = list(parts - self.quick.keys())
        self.quick.update(zip(new, self.lengths(new).tolist()))

    def weigh(self, pairs: set[tuple[str, int]]) -> None:
        """Fill in ``weighed`` of (sentence, step): the candidate and the bytes it saves by the quick comparison, if it may be shorter."""
        new = list(pairs - self.weighed.keys())
        self.measure({p for p, _ in new})
        made = [self.steps[step][1](p, set(p)) for p, step in new]
        names = list({x for x in made if x})
        limit = dict.fromkeys(names, 0)
        for (p, _), x in zip(new, made):
            if x:
                limit[x] = max(limit[x], self.quick[p] + DOUBT)
        # Lengths above the bound are not exact, but then they are above that of each sentence.
        size = dict(zip(names, self.lengths(names, np.fromiter(limit.values(), np.int64, len(limit))).tolist())) | {"": 0}
        for (p, step), x in zip(new, made):
            fine = x is not None and x != p and size[x] <= self.quick[p] + DOUBT
            self.weighed[p, step] = (x, self.quick[p] - size[x]) if fine else None

    def search(self, texts: list[str | None], beam: int) -> dict[int, tuple[int, tuple[str, ...], tuple[str, ...]]]:
        """Of each text beyond ASCII: bytes saved, chain and parts of the best chain, of ``beam`` chains followed at once."""
        active = [(i, 0, (), tuple(sentences(t))) for i, t in enumerate(texts) if t and not t.isascii()]
        best: dict[int, tuple[int, tuple[str, ...], tuple[str, ...]]] = {i: (0, (), parts) for i, _, _, parts in active}
        if max(len(self.choices), len(self.weighed)) > MOST_KEPT:
            for kept in (self.choices, self.quick, self.weighed):
                kept.clear()
        firm: dict[str, int] = {"": 0}
        while active:  # each step shortens a description, so this ends
            self.choose({p for _, _, _, parts in active for p in parts if not p.isascii()} - self.choices.keys())
            likely = []
            paying = [(x, steps) for x in active if (steps := {step for p in x[3] for step in self.choices.get(p, ())})]
            self.weigh({(p, step) for (_, _, _, parts), steps in paying for p in parts if not p.isascii() for step in steps})
            for (i, saved, chain, parts), steps in paying:
                for step in steps:
                    changed = {k: x for k, p in enumerate(parts) if (x := self.weighed.get((p, step))) is not None}
                    if sum(less for _, less in changed.values()) - self.steps[step][2] > -DOUBT:
                        likely.append((i, saved, chain, parts, step, {k: x for k, (x, _) in changed.items()}))
            sure = list({x for _, _, _, parts, _, changed in likely for k, c in changed.items() for x in (parts[k], c)} - firm.keys())
            firm.update(zip(sure, self.lengths(sure, firm=True).tolist()))
            found: dict[int, dict[tuple[str, ...], tuple[int, tuple[str, ...]]]] = {}
            for i, saved, chain, parts, step, changed in likely:
                name, _, cost = self.steps[step]
                less = {k: firm[parts[k]] - firm[x] for k, x in changed.items() if firm[x] < firm[parts[k]]}
                if sum(less.values()) > cost:
                    made = tuple(changed[k] if k in less else p for k, p in enumerate(parts))
                    rank = (-(saved + sum(less.values()) - cost), (*chain, name))
                    here = found.setdefault(i, {})
                    here[made] = min(here.get(made, rank), rank)
            active = []
            for i, each in found.items():
                for made, (less_saved, chain) in sorted(each.items(), key=lambda x: x[1])[:beam]:
                    active.append((i, -less_saved, chain, made))
                    if -less_saved > best[i][0]:
                        best[i] = (-less_saved, chain, made)
        return best

    def solve(self, text: str | None) -> tuple[bool, str | None, str | None]:
        return self.solve_many([text])[0]

    def plain(self, texts: list[str | None]) -> list[str | None]:
        """The texts, restored where they can be: as a whole, or those of their sentences of which nothing is lost."""
        solved = self.solve_many(texts)
        parts = {i: sentences(texts[i]) for i, (affected, whole, _) in enumerate(solved) if affected and whole is None}
        flat = list(dict.fromkeys(p for ps in parts.values() for p in ps))
        back = {p: r for p, (_, r, _) in zip(flat, self.solve_many(flat)) if r is not None}
        return ["".join(back.get(p, p) for p in parts[i]) if i in parts else t if whole is None else whole for i, (t, (_, whole, _)) in enumerate(zip(texts, solved))]


_solvers: dict[int, tuple[dict, Unscrambler]] = {}


def solver(models: dict[str, tuple[bytes, str]]) -> Unscrambler:
    """The solver of these (broadcast) models, made once per worker."""
    if id(models) not in _solvers:
        _solvers.clear()
        _solvers[id(models)] = models, Unscrambler(models)
    return _solvers[id(models)][1]


def trained(rows: list[bytes]) -> bytes:
    """A zstandard dictionary of ``rows``; if they are too few, their raw bytes are the dictionary."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, rows).as_bytes()
    except zstandard.ZstdError:
        return b"".join(rows)[-DICTIONARY_BYTES:]


def merged(dictionaries: list[bytes]) -> bytes:
    """One dictionary of what several, of about as many texts each, have in common."""
    if len(dictionaries) == 1:
        return dictionaries[0]
    contents = [d[HEADER:] if d[:4] == MAGIC else d for d in dictionaries]
    return trained([d[at : at + PIECE] for d in contents for at in range(0, len(d), PIECE)])


def sentence_bytes(texts: Iterable[str]) -> list[bytes]:
    out = []
    for t in texts:
        parts = [*TRAINED_PART.split(t), ""]
        out += [s.encode("utf-8", "surrogatepass") for x, mark in zip(parts[::2], parts[1::2]) if (s := x + mark if mark else x).strip()]
    return out


def letter_counts(texts: list[str]) -> tuple[int, int]:
    """ASCII letters and all letters of ``texts``."""
    ascii_letters = letters = 0
    for _, some in lexing.chunks(texts):
        points, n = np.unique(np.frombuffer("".join(some).encode("utf-32-le", "surrogatepass"), np.uint32), return_counts=True)
        alpha = np.fromiter((chr(p).isalpha() for p in points.tolist()), bool, len(points))
        ascii_letters, letters = ascii_letters + int(n[alpha & (points < 128)].sum()), letters + int(n[alpha].sum())
    return ascii_letters, letters


def assembled(parts: dict[str, tuple[bytes, dict[str, int], int, int, int]]) -> dict[str, tuple[bytes, str]]:
    """A dictionary and an alphabet per language from (dictionary, texts that hold each character, texts, ASCII letters, letters)."""
    out, common = {}, set()
    for _, chars, n, _, _ in parts.values():
        common |= {c for c, k in chars.items() if not c.isalpha() and k >= max(2, ALPHABET_SHARE * n) and c != LOST}
    for language, (data, chars, n, ascii_letters, letters) in parts.items():
        alphabet = {c for c, k in chars.items() if c.isalpha() and not c.isascii() and k >= max(2, ALPHABET_SHARE * n)}
        if ascii_letters >= ASCII_SHARE * letters:
            alphabet.add("a")  # stands for all ASCII letters
        out[language] = (data, "".join(sorted(alphabet | common)))
    return out


def model(samples: dict[str, list[str]]) -> dict[str, tuple[bytes, str]]:
    """A zstandard dictionary and an alphabet per language from texts in memory.

    Under "" stand the characters and the hashes of the tokens that they have more than once (for ``suspects``).
    """
    everything = [t for texts in samples.values() for t in texts]
    seen = Counter()
    for _, some in lexing.chunks(everything):
        keys, counts = np.unique(lexing.Tokens(some, joined=False).hash, return_counts=True)
        seen.update(dict(zip(keys.tolist(), counts.tolist())))
    chars = Counter(c for t in everything for c in set(t))
    seen_often = "".join(sorted(c for c, n in chars.items() if n >= KNOWN and c != LOST))
    known = {"": (seen_often.encode("utf-8", "surrogatepass"), " ".join(str(k) for k, n in sorted(seen.items()) if n >= KNOWN))}
    return known | assembled({k: (trained(sentence_bytes(t)), Counter(c for x in t for c in set(x)), len(t), *letter_counts(t)) for k, t in samples.items()})


def fitted(documents: DataFrame, words_of: tuple[str, ...] = (), marks: tuple[int, ...] = ()) -> tuple[dict[str, tuple[bytes, str]], DataFrame | None]:
    """The models of all labelled documents (text, lang), whole texts, and ``key, lang, n``: how often each word (its hash) and
    each of ``marks`` (its code point) stands in the languages ``words_of``.

    Labels are trimmed, lower-cased and cut at the region; a language without documents is left out. Equal texts count once. A language's
    texts are dealt by hash into groups of about GROUP_CHARS characters; characters, letters and words are counted and a dictionary is
    trained in each. Counts are summed, dictionaries merged, FAN at once, until there is one a language: the result does not
    depend on the partitioning, and no task or driver holds more than a group or FAN dictionaries a language.
    """
    tag = F.lower(F.substring_index(F.trim("lang"), "-", 1))
    usable = documents.select(tag.alias("lang"), "text").where(F.col("lang").isin(*LANGUAGES) & (F.length(F.trim("text")) > 0) & ~F.contains("text", F.lit(LOST)))
    groups = {r[0]: -(-r[1] // GROUP_CHARS) for r in usable.groupBy("lang").agg(F.sum(F.length("text"))).collect()}
    if not groups:
        return {}, None
    many = F.create_map(*[x for k, n in sorted(groups.items()) for x in (F.lit(k), F.lit(n))])
    dealt = usable.withColumn("no", F.pmod(F.xxhash64(F.lit("dictionary"), "text"), many[F.col("lang")])).repartition(partitions_for(documents), "lang", "no")
    form = "lang string, what string, key bigint, n bigint, data binary"
    names = ["lang", "what", "key", "n", "data"]

    def rows(language: str, what: str, keys: list[int], counts: list[int], data: list[bytes] | None = None) -> pa.Table:
        n = len(keys)
        kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary())
        return pa.table([pa.array(x, k) for x, k in zip(([language] * n, [what] * n, keys, counts, data or [None] * n), kinds)], names=names)

    def learn(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        language, texts = key[0].as_py(), sorted(table.column("text").to_pylist())
        chars = Counter(c for t in texts for c in set(t))
        ascii_letters, letters = letter_counts(texts)
        out = [
            rows(language, "dictionary", [key[1].as_py()], [1], [trained(sentence_bytes(texts))]),
            rows(language, "char", [ord(c) for c in chars], list(chars.values())),
            rows(language, "sum", [0, 1, 2], [len(texts), ascii_letters, letters]),
        ]
        if language in words_of:
            found = lexing.word_counts(texts, marks)
            out.append(rows(language, "word", list(found), list(found.values())))
        return pa.concat_tables(out)

    def join(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        parts = [d for _, d in sorted(zip(table.column("key").to_pylist(), table.column("data").to_pylist()))]
        return rows(key[0].as_py(), "dictionary", [key[1].as_py()], [1], [merged(parts)])

    learned = cut(dealt.groupBy("lang", "no", "text").agg(F.lit(1).alias("_one")).select("lang", "no", "text").groupBy("lang", "no").applyInArrow(learn, form))
    dictionaries, most = learned.where("what = 'dictionary'"), max(groups.values())
    while most > FAN:
        dictionaries = cut(dictionaries.groupBy("lang", F.floor(F.col("key") / FAN).alias("no")).applyInArrow(join, form))
        most = -(-most // FAN)
    parts: dict[str, list[tuple[int, bytes]]] = {}
    for r in dictionaries.select("lang", "key", "data").collect():  # FAN a language at most
        parts.setdefault(r[0], []).append((r[1], bytes(r[2])))
    counts: dict[tuple[str, str], dict[int, int]] = {}
    for r in learned.where("what IN ('char', 'sum')").groupBy("lang", "what", "key").agg(F.sum("n")).collect():  # code points
        counts.setdefault((r[0], r[1]), {})[r[2]] = r[3]
    return assembled({
        k: (merged([d for _, d in sorted(each)]), {chr(c): n for c, n in counts[k, "char"].items()}, *(counts[k, "sum"][i] for i in range(3)))
        for k, each in sorted(parts.items())
    }), learned.where("what = 'word'").groupBy("key", "lang").agg(F.sum("n").alias("n"))


def restore(df: DataFrame, keep: list[str], text: str, models: dict[str, tuple[bytes, str]]) -> DataFrame:
    """``keep``, affected boolean, restored string, chain string for the column ``text``; whole texts, no shuffle."""
    sent = df.sparkSession.sparkContext.broadcast(models)  # LANGUAGES x (DICTIONARY_BYTES + an alphabet) at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        solve = solver(sent.value)
        for whole in batches:
            for batch in (whole.slice(at, BATCH) for at in range(0, whole.num_rows, BATCH)):
                out = solve.solve_many(batch.column(len(keep)).to_pylist())
                more = [pa.array([x[0] for x in out], pa.bool_()), pa.array([x[1] for x in out], pa.string()), pa.array([x[2] for x in out], pa.string())]
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), *more], names=[*keep, "affected", "restored", "chain"])

    picked = spread(df.select(*keep, F.col(text).alias("_text")))
    kinds = ", ".join(f"`{n}` {t}" for n, t in picked.dtypes[:-1])
    return picked.mapInArrow(run, f"{kinds}, affected boolean, restored string, chain string")
