"""Charset-aware decoding of page bytes, all of it in column expressions.

Charsets beside Unicode are decoded by the JVM, which needs two session settings; they are
turned on when such an expression is made, since Spark reads them when it analyses a query.
"""

from __future__ import annotations

import codecs
from encodings.aliases import aliases

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..functions.text import decode_quality_score

BOM = "EFBBBF"
# Where a page or its header names its charset.
DECLARATIONS = [r"(?i)<meta[^>]+charset=[\"']?\s*([a-zA-Z0-9_\-]+)", r"(?i)<meta[^>]+content=[\"'][^\"']*charset=\s*([a-zA-Z0-9_\-]+)"]
IN_HEADER = r"(?i)charset\s*=\s*([^;\s]+)"
#: Charsets tried, in this order, where none is declared.
GUESSES = ("utf-8", "gb18030", "big5")
# The JVM's names of charsets.
JVM_NAMES = {
    "ascii": "US-ASCII", "utf_8": "UTF-8", "utf_16": "x-UTF-16LE-BOM", "utf_16_le": "UTF-16LE", "utf_16_be": "UTF-16BE", "utf_32": "UTF-32",
    "latin_1": "ISO-8859-1", "gb2312": "GB2312", "gbk": "GBK", "gb18030": "GB18030", "big5": "Big5", "big5hkscs": "Big5-HKSCS", "cp950": "x-windows-950",
    "shift_jis": "Shift_JIS", "cp932": "windows-31j", "euc_jp": "EUC-JP", "iso2022_jp": "ISO-2022-JP", "euc_kr": "EUC-KR", "cp949": "x-windows-949",
    "johab": "x-Johab", "iso2022_kr": "ISO-2022-KR", "koi8_r": "KOI8-R", "koi8_u": "KOI8-U", "tis_620": "TIS-620", "mac_roman": "x-MacRoman",
    "mac_cyrillic": "x-MacCyrillic", "cp437": "IBM437", "cp850": "IBM850", "cp852": "IBM852", "cp855": "IBM855", "cp866": "IBM866", "cp874": "x-windows-874",
} | {f"iso8859_{n}": f"ISO-8859-{n}" for n in (2, 3, 4, 5, 6, 7, 8, 9, 13, 15, 16)} | {f"cp{n}": f"windows-{n}" for n in range(1250, 1259)}
SETTINGS = ("spark.sql.legacy.javaCharsets", "spark.sql.legacy.codingErrorAction")


def _allow_charsets() -> None:
    spark = SparkSession.getActiveSession()
    for key in SETTINGS if spark is not None else ():
        spark.conf.set(key, "true")


def _known(name: Column) -> Column:
    """``jvm|label`` of a charset by any of its names; NULL for an unknown one."""
    of_alias = {a: m for a, m in aliases.items() if m in JVM_NAMES} | {m: m for m in JVM_NAMES}
    table = ",".join(f"{a}:{JVM_NAMES[m]}|{codecs.lookup(m).name}" for a, m in sorted(of_alias.items()))
    return F.element_at(F.str_to_map(F.lit(table)), F.regexp_replace(F.lower(name), r"[^a-z0-9.]+", "_"))


def header_charset(content_type: Column) -> Column:
    return _named(F.regexp_extract(F.coalesce(content_type, F.lit("")), IN_HEADER, 1))


def page_charset(raw: Column, search: int | None = None) -> Column:
    """The charset that a page names; ``search`` limits the bytes looked at."""
    # every byte is a character of this charset, so the page's own one need not be known yet
    page = F.decode(raw if search is None else F.substring(raw, 1, search), "ISO-8859-1")
    return _named(F.coalesce(*[F.nullif(F.regexp_extract(page, p, 1), F.lit("")) for p in DECLARATIONS]))


def _named(name: Column) -> Column:
    return F.nullif(F.lower(F.trim(F.translate(F.trim(name), "\"'", ""))), F.lit(""))


def _fits(raw: Column, c: Column) -> Column:
    """Whether the text ``c.text`` is what ``raw`` says: nothing was replaced, or what looks so was there."""
    back = F.call_function("encode", c["text"], c["jvm"]) == raw
    return c["jvm"].isNotNull() & (~F.contains(c["text"], F.lit("�")) | back)


def _read(raw: Column, names: list[Column]) -> Column:
    """array(struct(jvm, label, text)) for those of the charsets that are known and fit."""
    part = lambda c, i: F.split_part(c, F.lit("|"), F.lit(i))
    each = F.transform(F.transform(F.array(*names), _known), lambda c: F.struct(
        part(c, 1).alias("jvm"), part(c, 2).alias("label"), F.call_function("decode", raw, part(c, 1)).alias("text")))
    return F.filter(each, lambda c: _fits(raw, c))


def _result(c: Column) -> Column:
    return F.when(c.isNotNull(), F.struct(c["text"].alias("text"), c["label"].alias("encoding")))


def decode_bytes(raw: Column, content_type: Column, search: int | None = None, guesses: tuple[str, ...] = GUESSES) -> Column:
    """struct(text, encoding) for a binary column and its Content-Type header.

    Valid UTF-8 that is marked, declared or shows no damage is taken first, then the charset of the
    header, then that of the page, if known and fitting; else of the ``guesses`` that fit the one that leaves the
    fewest marks, the earlier one on a tie. What fits none is UTF-8 with replacements. NULL bytes give NULL fields.
    """
    _allow_charsets()
    marked = F.hex(F.substring(raw, 1, 3)) == BOM
    text, header = F.decode(raw, "UTF-8"), header_charset(content_type)
    page = page_charset(raw, search)
    first = F.coalesce(header, page)  # the page is looked at only where the header names none
    valid = F.is_valid_utf8(raw.cast("string"))
    undamaged = first.isNull() & (decode_quality_score(F.when(valid, text)) == 0)
    settled = F.coalesce(valid & (marked | first.isin("utf-8", "utf8") | undamaged), F.lit(False))
    body = F.when(marked, F.decode(F.substring(raw, 4, 2147483647), "UTF-8")).otherwise(text)
    plain = F.struct(body.alias("text"), F.when(marked, F.lit("utf-8-sig")).otherwise(F.lit("utf-8")).alias("encoding"))
    ranked = F.transform(_read(raw, [F.lit(g) for g in guesses]), lambda c, i: F.struct(
        decode_quality_score(c["text"]).alias("damage"), i.alias("i"), c["label"].alias("label"), c["text"].alias("text")))
    lost = F.struct(text.alias("text"), F.lit("utf-8/replace").alias("encoding"))
    none = F.struct(F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("encoding"))
    return F.when(raw.isNull(), none).otherwise(F.coalesce(
        F.when(settled, plain), _result(F.get(_read(raw, [header]), F.lit(0))), _result(F.get(_read(raw, [page]), F.lit(0))),
        _result(F.array_min(ranked)), lost))


def encode_text(text: Column, charset: str) -> Column:
    """Bytes of a text in any charset of JVM_NAMES; NULL where it does not fit."""
    _allow_charsets()
    module = charset.lower().replace("-", "_")
    jvm = F.lit(JVM_NAMES[aliases.get(module, module)])
    out = F.call_function("encode", text, jvm)
    return F.when(F.call_function("decode", out, jvm) == text, out)
