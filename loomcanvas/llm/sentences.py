"""Problem 9: sentence units across languages and scripts.

The boundary rules are compiled into a finite transducer. A lexer turns the text into symbols (each knows its closest
context only: the word before, what follows); the transducer's state says whether a unit has begun and which
quotation or bracket is open, and its table gives next state and whether a unit ends.

Long texts are cut into chunks of text that are lexed apart, in tasks of their own. A chunk begins at a word that another word
precedes, where the lexer holds nothing back and needs to know one thing only: whether the line is a log line. What a
chunk makes of the states is a function; a parallel prefix scan composes these functions, so each chunk's start state
is known without reading the text from its beginning.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomcanvas.plans.frames import cut, spread

# Words after which a full stop never ends a unit (titles, references, measures), and those after which
# it does if what follows looks like a beginning.
NEVER = frozenset(
    "mr mrs ms mme dr prof st no nos nr sec fig figs approx temp v vs i.e e.g cf vol ed eds pp p dept gen rev hon "
    "z.b d.h ca bzw abb tab abs str bd hrsg env c.-à-d m mm mlle sra sr srta dra pág págs aprox p.ej p.ex núm av "
    "см рис табл т.е т.к тыс млн стр εικ σελ δηλ βλ κεφ सं डॉ श्री पृ ص د أ".split()
)
PERHAPS = frozenset("etc al a.m p.m usw u.k u.s u.s.a rd ave inc ltd co jr г д т.д т.п κ.λπ κ.ά km h min sek".split())
# German months, before which a number with a full stop is a day.
MONTHS = regex.compile(r"\s+(?:Januar|Jänner|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember)\b")
# Pairs of quotation marks and brackets; a mark may open one pair and close another.
PAIRS = ("“”", "‘’", "«»", "»«", "„“", "「」", "『』", "()", "（）", "‚‘", '""', "《》", "【】")
CLOSING = frozenset(p[1] for p in PAIRS) | {"]", "］", "'", "”"}
OPENING = frozenset(p[0] for p in PAIRS) | set("¿¡[<*_#")
WIDE_ENDS = frozenset("。！？।॥｡")
MARKER = regex.compile(r"[ \t]*(?:[*•·‣▪–—\-+][ \t]+|\d{1,4}[.)][ \t]+|\[[\p{L} ]+\d*[^\]\n]*\][ \t]|#{1,6} |>{1,3} )")
LOG = regex.compile(r"[ \t]*\[[^\]\n]{1,60}\][ \t]")
EVENT = regex.compile(
    r"(?P<blank>[^\S\n]*\n(?:[^\S\n]*\n)+)|(?P<line>[^\S\n]*\n)|(?P<end>\.\s\.\s\.|[.!?…。！？।॥؟۔｡]+|;)|(?P<mark>[“”‘’«»„「」『』()（）\"‚《》【】])"
    r"|(?P<thai>(?<=\p{Thai})[  ]+(?=[\p{Thai}\p{Lu}<]))"
)
WORD_MARKS = frozenset(".-’'")
#: Characters that are looked back over for an abbreviation of several parts, beyond its last part; none of the lists' is as long.
LOOK_BACK = 64
FILE_NAME = regex.compile(r"\p{Ll}[\p{Ll}\d_]*\.\p{Ll}{2,4}\b")
BLANK_LINE = regex.compile(r"[ \t\r]*(?:\n|\Z)")
#: Texts of more characters are cut into chunks of about this many.
LONG_TEXT = 1 << 16
#: Symbols in a chunk of a long text.
CHUNK = 2048

# Symbols: text, hard end, soft end, then for each mark and each (a sentence end stands before, what follows) one.
TEXT, HARD, SOFT = 0, 1, 2
MARKS = sorted({c for p in PAIRS for c in p})
CONTINUES, BEGINS, CASELESS = 0, 1, 2
N_STATES = 2 + 2 * len(PAIRS)  # nothing open: 0 a unit begins, 1 inside; else 2 + 2 * pair + (opened at the beginning)


def mark_symbol(mark: str, ended: bool, follow: int) -> int:
    return 3 + (MARKS.index(mark) * 2 + ended) * 3 + follow


def compile_table() -> tuple[np.ndarray, np.ndarray]:
    """next state and output (1: a unit ends here) by symbol and state."""
    n = 3 + len(MARKS) * 6
    nxt, out = np.zeros((n, N_STATES), np.int8), np.zeros((n, N_STATES), np.int8)
    for s in range(N_STATES):
        nxt[TEXT, s] = 1 if s < 2 else s
        nxt[HARD, s], out[HARD, s] = 0, 1
        nxt[SOFT, s], out[SOFT, s] = (0, 1) if s < 2 else (s, 0)
        for mark in MARKS:
            for ended in (False, True):
                for follow in (CONTINUES, BEGINS, CASELESS):
                    x = mark_symbol(mark, ended, follow)
                    if s >= 2 and PAIRS[(s - 2) // 2][1] == mark:
                        first = (s - 2) % 2
                        ends = ended and (follow == BEGINS or follow == CASELESS and not first)
                        nxt[x, s], out[x, s] = (0, 1) if ends else (1, 0)
                    elif s >= 2:
                        nxt[x, s] = s
                    else:
                        opens = [i for i, p in enumerate(PAIRS) if p[0] == mark]
                        if opens and not ended:
                            nxt[x, s] = 2 + 2 * opens[0] + (s == 0)
                        else:  # a closing mark without its partner
                            nxt[x, s], out[x, s] = (0, 1) if ended and follow != CONTINUES else (1, 0)
    return nxt, out


NEXT, OUT = compile_table()
ROWS = [[(int(a), int(b)) for a, b in zip(NEXT[x], OUT[x])] for x in range(len(NEXT))]


SKIPPED = regex.compile("[" + "".join(regex.escape(c, special_only=False) for c in sorted(OPENING - {"<"})) + r"—–\-―[^\S\n]]*", regex.V1)
DASHES = regex.compile("[—–\\-―]")


def follow_of(text: str, at: int) -> int:
    """What stands after ``at``: the beginning of something, a continuation, or a letter without case.

    Blanks, opening marks and dashes are passed over, however many, and one closing mark.
    """
    n, i, dash = len(text), at, False
    if i < n and text[i] in CLOSING:
        i += 1
    while i < n:
        j = SKIPPED.match(text, i).end()
        dash = dash or j > i and DASHES.search(text, i, j) is not None
        i = j
        if i == n:
            break
        c = text[i]
        if c == "\n":
            if BLANK_LINE.match(text, i + 1) or MARKER.match(text, i + 1):
                return BEGINS
            i += 1
        elif c in ",;:、，；：":
            return CONTINUES
        elif c.isalpha():
            if c.islower():
                return BEGINS if not dash and FILE_NAME.match(text, i) else CONTINUES
            return BEGINS if c.isupper() else CASELESS
        else:
            return BEGINS
    return BEGINS


def word_before(text: str, line: int, start: int) -> str:
    """The word that ends at ``start``, with its parts between full stops (those within LOOK_BACK of the last one)."""
    i = start
    while i > line and ((c := text[i - 1]).isalnum() or c in "-’'" or unicodedata.category(c)[0] in "LMN"):
        i -= 1
    far = max(line, i - LOOK_BACK)
    while i > far and ((c := text[i - 1]).isalnum() or c in WORD_MARKS or unicodedata.category(c)[0] in "LMN"):
        i -= 1
    return text[i:start]


def ends_here(text: str, start: int, end: int, line: int) -> bool:
    """Whether the mark ``text[start:end]`` can end a unit, by the word before and what follows; quotations aside."""
    group, nxt = text[start:end], text[end] if end < len(text) else "\n"
    if group == ";":
        return start > 0 and "Ͱ" <= text[start - 1] < "Ѐ" or start > 0 and "ἀ" <= text[start - 1] < " "
    if any(c in WIDE_ENDS for c in group):
        return True
    plain = set(group) <= set(". …")
    if plain and (len(group) > 1 or group == "…"):
        return not nxt.isalnum() and follow_of(text, end) != CONTINUES
    if not plain:
        return (not nxt.isalnum() or nxt.isupper()) and follow_of(text, end) != CONTINUES or nxt in CLOSING
    word = word_before(text, max(line, 0), start).strip("’'-.")
    if "." in word and any(len(x) > 2 for x in word.split(".")):
        word = word.rsplit(".", 1)[1]  # two sentences without a blank between them
    low = word.casefold()
    if low in NEVER:
        return False
    if nxt.isalnum():  # no blank after the stop: only a whole word before and a capitalised one after it
        return nxt.isupper() and len(word) > 1 and word[-1].islower() and word[-2:].isalpha() and text[end + 1 : end + 2].islower() or nxt.isupper() and word[-1:].islower() and len(word) > 2 and text[end + 1 : end + 2] in " ’"
    if not word:
        return start > 0 and text[start - 1] in ")%°»”’]" or start > max(line, 0) and not text[start - 1].isspace()
    if word.isdigit() and (line >= 0 and not text[line : start - len(word)].strip("\ufeff\u200b \t\r") or MONTHS.match(text, end)):
        return False
    if low in NEVER or len(word) == 1 and word.isalpha() and not "฀" <= word < "຀" and not (word.islower() and word not in "zdpeхтгдсм") and word.isupper():
        return False
    if len(word) == 1 and word.isalpha() and word.islower():
        return False
    follow = follow_of(text, end)
    if low in PERHAPS or "." in low and len(low) <= 6 and not any(c.isdigit() for c in low):
        return follow == BEGINS and not text[end:].lstrip()[:1].isdigit()
    return follow != CONTINUES or nxt in CLOSING


def closes(text: str, at: int) -> bool:
    """Whether a closing mark stands at ``at`` (French ones after a blank); a mark that can also open does, before a word."""
    space = text[at : at + 1].isspace()
    mark, after = text[at + space : at + space + 1], text[at + space + 1 : at + space + 2]
    if space:
        return mark == "»" and not after.isalnum()
    return mark in CLOSING and mark != "" and not (mark in OPENING and after.isalnum())


def lex(text: str, log_line: bool | None = None, last: bool = True) -> tuple[list[int], list[int]]:
    """Symbols and, for each, the position up to which a unit reaches if it ends there.

    ``log_line`` is given for a chunk from within a text, which begins within a line: whether that is a log line. All but the
    ``last`` chunk go on.
    """
    symbols: list[int] = []
    ends: list[int] = []
    at, line, in_log = (0, 0, bool(LOG.match(text))) if log_line is None else (0, -1, log_line)
    ended_at = -1  # where a sentence end stands that a closing mark may follow
    for m in EVENT.finditer(text):
        start, end = m.span()
        if start < at:
            continue
        if text[at:start].strip():
            symbols.append(TEXT)
            ends.append(start)
            ended_at = -1
        kind = m.lastgroup
        if kind in ("blank", "line"):
            rest = m.end()
            if kind == "blank" or in_log or MARKER.match(text, rest):
                symbols.append(HARD)
                ends.append(start)
            elif start > 0 and rest < len(text) and "฀" <= text[start - 1] < "຀" and "฀" <= text[rest] < "຀":
                symbols.append(SOFT)
                ends.append(start)
            line = rest
            in_log = bool(LOG.match(text, rest))
        elif kind == "thai":
            symbols.append(SOFT)
            ends.append(start)
        elif kind == "end":
            if ends_here(text, start, end, line):
                ended_at = end
                if not closes(text, end):
                    symbols.append(SOFT)
                    ends.append(end)
                    at, ended_at = end, -1
                    continue
            symbols.append(TEXT)
            ends.append(end)
        else:
            mark = m[0]
            inner = start > 0 and end < len(text) and text[start - 1].isalnum() and text[end].isalnum()
            if mark == "’" and inner:
                symbols.append(TEXT)
                ends.append(end)
            else:
                ended = ended_at >= 0 and not text[ended_at:start].strip()
                follow = follow_of(text, end)
                if ended and text[end : end + 1] in "とっ" and text[end : end + 1]:
                    follow = CONTINUES
                symbols.append(mark_symbol(mark, ended, follow))
                after = end
                while ended and after < len(text) and text[after] in CLOSING:
                    after += 1
                ends.append(after)
                ended_at = end if ended else -1
        at = end
    if text[at:].strip():
        symbols.append(TEXT)
        ends.append(len(text))
    if last:
        symbols.append(HARD)
        ends.append(len(text))
    return symbols, ends


#: Where a chunk may begin: at a word of letters that another word and one blank precede.
CUT = regex.compile(r"(?<=[\p{L}\p{N}] )(?=\p{L})(?<!\p{Thai} )(?!\p{Thai})")


def chunk_starts(text: str, size: int) -> list[tuple[int, bool]]:
    """(start, whether its line is a log line) of the chunks of ``text`` after the first, about ``size`` characters apart.

    Not within a bracket at the beginning of a line, which has to be read as a whole.
    """
    out, at = [], size
    while (m := CUT.search(text, at)) is not None:
        at = m.start()
        line = text.rfind("\n", 0, at) + 1
        if text[line:at].lstrip()[:1] == "[" and "]" not in text[line:at]:
            at += 1
            continue
        out.append((at, bool(LOG.match(text, line))))
        at += size
    return out


def walk(symbols: list[int], state: int) -> tuple[list[int], int]:
    """Places (indexes into ``symbols``) where units end, from a start state, and the last state."""
    out = []
    for i, x in enumerate(symbols):
        state, ends = ROWS[x][state]
        if ends:
            out.append(i)
    return out, state


def chunk_function(symbols: list[int]) -> np.ndarray:
    """What a chunk makes of each state."""
    states = np.arange(N_STATES, dtype=np.int8)
    for x in symbols:
        states = NEXT[x][states]
    return states


def prefix_scan(functions: np.ndarray) -> np.ndarray:
    """Row i: functions 0 to i composed, in log2 steps that each compose all rows at once."""
    out, step = functions.copy(), 1
    while step < len(out):
        later = np.take_along_axis(out[step:], out[:-step].astype(np.int64), axis=1)
        out = np.concatenate([out[:step], later])
        step *= 2
    return out


def visible(text: str) -> bool:
    return bool(regex.search(r"[^\s\p{Cf}\p{Cc}\p{Zs}]", text))


def unit_ends(text: str | None, chunk: int = CHUNK) -> list[int]:
    """The number of characters from the text's start through each unit's last character that is no blank.

    Null, empty and blank texts, and texts of invisible characters only, have no units.
    """
    if not text or not visible(text):
        return []
    symbols, ends = lex(text)
    if len(symbols) <= chunk:
        places, _ = walk(symbols, 0)
    else:
        parts = [symbols[i : i + chunk] for i in range(0, len(symbols), chunk)]
        reached = prefix_scan(np.stack([chunk_function(p) for p in parts]))
        starts = [0, *reached[:-1, 0].tolist()]
        places = [k * chunk + i for k, (p, s) in enumerate(zip(parts, starts)) for i in walk(p, s)[0]]
    out: list[int] = []
    last = 0
    for i in places:
        end = last + len(text[last : ends[i]].rstrip()) if ends[i] > last else last
        if end > last and visible(text[last:end]):
            out.append(end)
            last = end
    return out


def ends_of_chunk(text: str, log_line: bool | None, last: bool, state: int) -> list[int]:
    """As ``unit_ends`` for a chunk that begins in ``state``; positions within the chunk."""
    symbols, ends = lex(text, log_line, last)
    places, _ = walk(symbols, state)
    out: list[int] = []
    done = 0
    for i in places:
        end = done + len(text[done : ends[i]].rstrip()) if ends[i] > done else done
        if end > done and visible(text[done:end]):
            out.append(end)
            done = end
    return out


def split_units(df: DataFrame, key: str, text: str, with_text: bool = False, long_text: int = LONG_TEXT) -> DataFrame:
    """One row per unit of the column ``text``: ``key, unit_no, unit_end`` and, if wanted, ``unit`` (its text).

    Texts of up to ``long_text`` characters need no shuffle; longer ones are cut into chunks that are spread over the tasks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            where, numbers, found, units = [], [], [], []
            for row, t in enumerate(batch.column(1).to_pylist()):
                last = 0
                for no, end in enumerate(unit_ends(t)):
                    where.append(row)
                    numbers.append(no)
                    found.append(end)
                    if with_text:
                        units.append(t[last:end].strip())
                    last = end
            columns = [batch.column(0).take(pa.array(where, pa.int64())), pa.array(numbers, pa.int32()), pa.array(found, pa.int32())]
            names = [key, "unit_no", "unit_end"]
            if with_text:
                columns.append(pa.array(units, pa.string()))
                names.append("unit")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    picked = df.select(key, F.col(text).alias("_text"))
    kind = picked.dtypes[0][1]
    short = spread(picked.where(F.length("_text") <= long_text)).mapInArrow(run, f"`{key}` {kind}, unit_no int, unit_end int" + ", unit string" * with_text)
    long = picked.where(F.length("_text") > long_text).withColumn("_row", F.concat_ws(":", F.coalesce(F.col(key).cast("string"), F.lit("")), F.md5("_text")))
    each = cut(long.groupBy("_row").agg(F.first(key).alias(key), F.first("_text").alias("_text"), F.count(F.lit(1)).alias("_copies")))
    return short if each.isEmpty() else short.unionByName(_long_units(each, key, with_text, long_text))


def _long_units(each: DataFrame, key: str, with_text: bool, size: int) -> DataFrame:
    """The units of long texts (``_row``, the key, ``_text``, ``_copies``), by chunks; each row comes out as often as it went in."""
    names = ["_row", "_no", "_from", "_piece", "_log", "_last"]
    schema = "_row string, _no int, _from int, _piece string, _log boolean, _last boolean"

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                starts = [(0, None), *chunk_starts(t, size)] if visible(t) else []
                for no, ((a, log), (b, _)) in enumerate(zip(starts, [*starts[1:], (len(t), None)])):
                    yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((row, no, a, t[a:b], log, b == len(t)), (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.bool_(), pa.bool_()))], names=names)

    def functions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [chunk_function(lex(t, log, last)[0]).tolist() for t, log, last in zip(*(batch.column(i).to_pylist() for i in range(2, 5)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.list_(pa.int8()))], names=["_row", "_no", "_f"])

    def scan(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("_no")
        reached = prefix_scan(np.stack(part["_f"].to_list()))
        return pd.DataFrame({"_row": part["_row"], "_no": part["_no"], "_state": [0, *reached[:-1, 0].tolist()]})

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row per unit's part in a chunk: the last part of a chunk has no end."""
        for batch in batches:
            out = []
            for row, no, start, t, log, last, state in zip(*(batch.column(i).to_pylist() for i in range(7))):
                done, ends = 0, ends_of_chunk(t, log, last, state)
                for k, end in enumerate([*ends, None]):
                    out.append((row, no, k, start + end if end is not None else None, t[done:end] if with_text else None))
                    done = end or 0
            types = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=["_row", "_no", "_k", "unit_end", "_part"])

    chunks = cut(each.select("_row", "_text").mapInArrow(cut_up, schema).repartition("_row", "_no"))
    told = chunks.select("_row", "_no", "_piece", "_log", "_last").mapInArrow(functions, "_row string, _no int, _f array<tinyint>")
    states = told.groupBy("_row").applyInPandas(scan, "_row string, _no int, _state int")  # a few bytes per chunk
    parts = chunks.join(states, ["_row", "_no"]).select(*names, "_state").mapInArrow(units, "_row string, _no int, _k int, unit_end int, _part string")
    # Parts up to and with one that has an end are one unit: its number is the count of ends before.
    counts = parts.groupBy("_row", "_no").agg(F.count("unit_end").alias("_n"))
    before = counts.select("_row", "_no", F.coalesce(F.sum("_n").over(Window.partitionBy("_row").orderBy("_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    numbered = parts.join(before, ["_row", "_no"]).withColumn("unit_no", (F.col("_before") + F.col("_k")).cast("int"))
    whole = numbered.groupBy("_row", "unit_no").agg(F.max("unit_end").alias("unit_end"), *([F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_no", "_part"))), lambda x: x["_part"]), "").alias("unit")] if with_text else [])).where("unit_end IS NOT NULL")
    out = whole.join(each.select("_row", key, "_copies"), "_row").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    return out.select(key, "unit_no", "unit_end", *([F.regexp_replace("unit", r"^[\s\p{Z}]+|[\s\p{Z}]+$", "").alias("unit")] if with_text else []))
