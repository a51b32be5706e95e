"""A1 cell references: argument parsing on the driver, codecs as columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_REF = re.compile(r"([A-Z]{1,3})([1-9][0-9]*)")
REF_PATTERN = r"^[A-Z]+[1-9][0-9]*$"
#: Columns end at XFD, rows have no end here.
MAX_COLS = 16_384


def parse_ref(ref: str) -> tuple[int, int]:
    """(row, column) of one reference given as an option."""
    m = _REF.fullmatch((ref or "").upper())
    if not m:
        raise ValueError(f"Invalid cell reference: {ref!r}")
    col = 0
    for letter in m.group(1):
        col = col * 26 + ord(letter) - 64
    return int(m.group(2)), col


def parse_range(start: str, end: str | None = None):
    """(row, column, end row, end column); what the end doesn't give is None: ``B3:E`` has no last row."""
    if end is None and ":" in start:
        start, end = start.split(":", 1)
    if end and re.fullmatch("[A-Za-z]{1,3}", end):
        return (*parse_ref(start), None, parse_ref(f"{end}1")[1])
    return (*parse_ref(start), *(parse_ref(end) if end else (None, None)))


def letters_to_index(letters: Column) -> Column:
    return F.aggregate(
        F.split(F.upper(letters), ""), F.lit(0), lambda acc, ch: acc * 26 + F.ascii(ch) - 64
    ).cast("long")


def index_to_letters(n: Column) -> Column:
    """Column letters of an index by three base-26 digits without a zero."""

    def letter(x):
        return F.char(F.lit(65) + (x - 1) % 26)

    n = n.cast("long")
    second = F.floor((n - 1) / 26)
    third = F.floor((second - 1) / 26)
    return F.concat(
        F.when(second > 26, letter(third)).otherwise(F.lit("")),
        F.when(second > 0, letter(second)).otherwise(F.lit("")),
        letter(n),
    )


def valid_ref(ref: Column) -> Column:
    return F.upper(ref).rlike(REF_PATTERN)


def ref_row(ref: Column) -> Column:
    return F.when(valid_ref(ref), F.regexp_extract(ref, r"([0-9]+)$", 1).cast("long"))


def ref_col(ref: Column) -> Column:
    return F.when(valid_ref(ref), letters_to_index(F.regexp_extract(ref, r"^([A-Za-z]+)", 1)))


def address(row: Column, col: Column) -> Column:
    return F.concat(index_to_letters(col), row.cast("string"))


def range_text(r0: Column, c0: Column, r1: Column, c1: Column) -> Column:
    return F.concat(address(r0, c0), F.lit(":"), address(r1, c1))
