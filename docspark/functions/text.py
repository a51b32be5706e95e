"""Text column functions: cleaning, markers, names, widths."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# C0 control characters other than tab, LF and CR.
CONTROL_CHARS = r"[\x00-\x08\x0b\x0c\x0e-\x1f]"

# Marks left behind by a wrong charset guess.
DECODE_MARKS = [
    "�", "锟", "Ã", "Â", "â€", "â€™", "â€œ", "â€\x9d",
    "琚", "佸", "鍦", "涓", "鏄", "寤", "骞", "鏈", "鏃", "鈥",
]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often it is read."""
    return F.element_at(F.transform(F.array(value), body), 1)


def mentions(c: Column, words: list[str]) -> Column:
    """Whether a text contains any of the literal words, in one pass."""
    return c.rlike("|".join(re.escape(w) for w in words))


def strip_blank(c: Column) -> Column:
    """Trim every kind of ASCII blank, not spaces only."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def rstrip_blank(c: Column) -> Column:
    return F.regexp_replace(c, r"\s+$", "")


def empty_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def is_blank(c: Column) -> Column:
    return c.isNull() | ~c.rlike(r"\S")


def strip_control(c: Column) -> Column:
    return F.regexp_replace(c, CONTROL_CHARS, "")


def decode_quality_score(c: Column) -> Column:
    """Decode artifacts in a text: 20 per mark, 10 per control, 50 per U+FFFD.

    Marks may overlap and all count, so marks of one length are one pattern.
    """
    marks = F.lit(0)
    for length in sorted({len(m) for m in DECODE_MARKS}):
        same = "|".join(re.escape(m) for m in DECODE_MARKS if len(m) == length)
        marks = marks + F.regexp_count(c, F.lit(same))
    controls = F.regexp_count(c, F.lit(CONTROL_CHARS))
    lost = F.regexp_count(c, F.lit("�"))
    return (marks * 20 + controls * 10 + lost * 50).cast("long")


def collapse_blank_lines(c: Column) -> Column:
    """Right-trim each line, then keep one empty line of every run."""
    trimmed = F.regexp_replace(c, r"(?md)[ \t\r\f\x0b]+$", "")
    inner = F.regexp_replace(trimmed, r"\n{3,}", "\n\n")
    return F.regexp_replace(F.regexp_replace(inner, r"\A\n{2,}", "\n"), r"\n{2,}\z|\A\n\z", F.when(inner.rlike(r"\A\n*\z"), F.lit("")).otherwise(F.lit("\n")))


def collapse_newlines(c: Column) -> Column:
    return F.regexp_replace(c, r"\n{3,}", "\n\n")


def normalize_lines(c: Column) -> Column:
    """Per line: blanks to one space, trimmed; empty lines dropped."""
    flat = F.regexp_replace(F.regexp_replace(c, r"\r\n?", "\n"), r"[^\S\n]+", " ")
    no_edges = F.regexp_replace(flat, r"(?md)^ | $", "")
    return F.regexp_replace(F.regexp_replace(no_edges, r"\n{2,}", "\n"), r"^\n|\n$", "")


# Month names of the footer pattern.
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"


def strip_page_footer(c: Column) -> Column:
    """Drop a trailing ``Month YYYY n`` or its Chinese form."""
    en = F.regexp_replace(c, rf"(?i)\s*(?:{MONTHS})\s+\d{{4}}\s+\d{{1,3}}\s*$", "")
    cn = F.regexp_replace(en, r"\s*\d{4}年\d{1,2}月\s+\d{1,3}\s*$", "")
    return rstrip_blank(cn)


# Bullets, dashes and numbered markers of list items.
BULLET = r"^[•●○◦▪▸►]\s*|^[-–—]\s+|^\*\s+"
NUMBERED = r"^(\d+)[.、)]\s*"


def list_item(c: Column) -> Column:
    """struct(is_list, kind, text) of one line."""
    t = strip_blank(c)
    ul, ol = t.rlike(BULLET), t.rlike(NUMBERED)
    return F.struct(
        (ul | ol).alias("is_list"),
        F.when(ul, F.lit("ul")).when(ol, F.lit("ol")).alias("kind"),
        F.when(ul, F.concat(F.lit("- "), F.regexp_replace(t, BULLET, "")))
        .when(ol, F.regexp_replace(t, NUMBERED, "$1. "))
        .otherwise(t)
        .alias("text"),
    )


def merge_markers(c: Column) -> Column:
    """Adjoining emphasis markers (six or four stars) become a space."""
    return F.regexp_replace(F.regexp_replace(c, r"\*{6}", " "), r"\*{4}", " ")


# Sentence ends that close a paragraph.
SENTENCE_END = ".。!！?？:：;；"


def sentence_end(c: Column) -> Column:
    t = rstrip_blank(c)
    return (t == "") | t.rlike(f"[{SENTENCE_END}]$")


def remove_whitespace(c: Column) -> Column:
    return F.regexp_replace(c, r"\s+", "")


def _width_class(kinds: set[str]) -> str:
    """Code points of the given East Asian widths as a regex class body."""
    parts, start = [], None
    for cp in range(0x110000):
        hit = not 0xD800 <= cp <= 0xDFFF and unicodedata.east_asian_width(chr(cp)) in kinds
        if hit and start is None:
            start = cp
        elif not hit and start is not None:
            parts.append(f"\\x{{{start:X}}}-\\x{{{cp - 1:X}}}")
            start = None
    if start is not None:
        parts.append(f"\\x{{{start:X}}}-\\x{{10FFFF}}")
    return "".join(parts)


_WIDTH_CACHE: dict[str, str] = {}


def width_class(which: str) -> str:
    """Regex class for ``wide`` (wide or full) or ``ambiguous`` characters."""
    if which not in _WIDTH_CACHE:
        _WIDTH_CACHE[which] = _width_class({"wide": {"W", "F"}, "ambiguous": {"A"}}[which])
    return _WIDTH_CACHE[which]


def visual_width(c: Column) -> Column:
    """Wide characters count 2, ambiguous 1.5, other 1; blanks count nothing.

    ASCII is taken out first, so the two large classes only see the rest.
    """
    t = remove_whitespace(c)
    rest = F.regexp_replace(t, r"[\x00-\x7F]+", "")
    wide = F.length(rest) - F.length(F.regexp_replace(rest, f"[{width_class('wide')}]+", ""))
    ambiguous = F.length(rest) - F.length(F.regexp_replace(rest, f"[{width_class('ambiguous')}]+", ""))
    return F.length(t) + F.when(rest == "", 0.0).otherwise(wide + ambiguous * F.lit(0.5))
