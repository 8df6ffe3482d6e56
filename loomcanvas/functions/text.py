"""String functions: tokens, picks, cleaning, previews."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Garbled sequences (code points) and what replaces them, in the order of replacement.
REPLACEMENTS = (
    ((0xE2, 0x20AC, 0x2122), "'"), ((0xE2, 0x20AC, 0x2DC), "'"), ((0xE2, 0x20AC, 0x153), '"'), ((0xE2, 0x20AC, 0xFFFD), '"'),
    ((0xE2, 0x20AC, 0x201C), "--"), ((0x20AC, 0x201C), "--"),
    ((0xC3, 0xA2, 0xE2, 0x201A, 0xAC, 0xE2, 0x201E, 0xA2), "'"), ((0xC3, 0xA2, 0xE2, 0x201A, 0xAC, 0x2DC), "'"),
    ((0xC3, 0xA2, 0xE2, 0x201A, 0xAC, 0x153), '"'), ((0xC3, 0xA2, 0xE2, 0x201A, 0xAC, 0xFFFD), '"'),
    ((0xC3, 0xA2, 0xE2, 0x201A, 0xAC, 0x201C), "--"), ((0xC3, 0xA2, 0x201A, 0xAC, 0x153), "--"),
)


def words(text: Column) -> Column:
    """Lower-case words: line feeds become blanks, split at single blanks, empty pieces dropped (tabs stay)."""
    return F.filter(F.split(F.translate(F.lower(text), "\n", " "), " "), lambda t: t != "")


def split_words(text: Column) -> Column:
    """Pieces between any white space."""
    return F.filter(F.split(text, r"[\s\p{Z}]+"), lambda t: t != "")


def repair_quotes(text: Column) -> Column:
    """Twelve ordered replacements of garbled quotes and dashes."""
    for points, good in REPLACEMENTS:
        text = F.replace(text, F.lit("".join(map(chr, points))), F.lit(good))
    return text


# The headings that are cut off the front of a prompt.
RANK_HEAD, PROMPT_HEAD = r"(?i)^\s*Rank\s*#.*?\|\s*prompt\+response\s*\n\n", r"(?i)^\s*Prompt:\s*\n?"


def clean_prompt(text: Column) -> Column:
    """Without a leading rank header and a leading ``Prompt:``, without outer line feeds; null gives an empty string."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), RANK_HEAD, "")
    out = F.regexp_replace(out, PROMPT_HEAD, "")
    return F.regexp_replace(out, r"^\n+|\n+$", "")


def first_filled(*columns: Column | str) -> Column:
    """The first column with more than blanks, untrimmed; an empty string if there is none."""
    cs = [F.col(c) if isinstance(c, str) else c for c in columns]
    return F.coalesce(*[F.when(c.rlike(r"[^\s\p{Z}]"), c) for c in cs], F.lit(""))


def with_system(system: Column, question: Column) -> Column:
    return F.when(F.coalesce(system, F.lit("")) != "", F.concat_ws("\n\n", system, question)).otherwise(question)


def one_line(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r"))


def cut_middle(text: Column, most: int) -> Column:
    """Head and tail around an ellipsis if longer than ``most``; ``most`` <= 0 keeps all."""
    if most <= 0:
        return text
    head, tail = most // 2, most - most // 2
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, head), F.lit(" … "), F.substring(text, -tail, tail))).otherwise(text)


def cut_head(text: Column, most: int = 600) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def strip_prompt(full: Column, prompt: Column) -> Column:
    """``full`` without ``prompt`` at its start, if it begins with it."""
    return F.when(F.startswith(full, prompt), full.substr(F.length(prompt) + 1, F.length(full))).otherwise(full)


def move_in_text(action: Column) -> Column:
    """Amount of ``[MOVE +4]`` or ``[MOVE_+4]``; null for other texts."""
    return F.regexp_extract(action, r"^\s*\[MOVE[ _]([+-]\d+)\]\s*$", 1).try_cast("int")


def percent(x: Column, digits: int = 2) -> Column:
    return F.format_string(f"%.{digits}f", x * 100)


def latex(text: Column) -> Column:
    return F.replace(text, F.lit("_"), F.lit("\\_"))


def lenient_double(text: Column) -> Column:
    return F.trim(text).try_cast("double")


def lenient_int(text: Column) -> Column:
    return F.trim(text).try_cast("double").try_cast("bigint")


def stand_in_ids(tokens: Column) -> Column:
    """Token ids of a vocabulary-free tokenizer: md5 modulo 50256 (collisions accepted, the end-of-text id never arises)."""
    return F.transform(tokens, lambda t: (F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("bigint") % 50256).cast("int"))


def utc_stamp(at: Column) -> Column:
    """An instant as ``2024-01-31T23:59:59Z`` (sessions run in UTC)."""
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")
