"""Cleaning functions for single values, as Column expressions.

All parse functions give NULL for what they can't read. Digits and letters are matched after full-width forms have
become half-width, so the patterns are plain ASCII.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheafwork.functions.unicode_forms import nfkc

# What counts as not filled in, number units, currency signs, and the years that dates may have.
EMPTY_MARKERS = ("无", "没有", "暂无", "—", "-", "/", "N/A", "NA", "null", "NULL", "None", "")
UNITS = {"万": 10_000, "萬": 10_000, "亿": 100_000_000, "億": 100_000_000, "千": 1000, "k": 1000, "K": 1000, "w": 10_000, "W": 10_000}
CURRENCY = "￥$¥€£"
FIRST_YEAR, LAST_YEAR = 1970, 2100
#: Spaces that are removed wherever they stand: plain, full-width, no-break, zero-width ones, tab, line ends.
SPACES = " 　 ​‌‍\t\r\n"

_FULL = "".join(chr(0xFF01 + i) for i in range(94))
_HALF = "".join(chr(0x21 + i) for i in range(94))
NUMBER = T.DecimalType(38, 10)
_MARK = "\x01"


def half_width(text: Column) -> Column:
    """Full-width forms as half-width ones, all spaces removed."""
    return F.translate(text, _FULL + SPACES, _HALF)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once, however often it is used: without it, Spark forms the value anew for each
    use within a condition, which costs four times as much for the parsers below."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def normalize_text(text: Column, compatibility: bool = True) -> Column:
    """Half-width, without spaces, in Unicode compatibility form. With compatibility=False the last step is left out, which
    is enough where there are no other compatibility characters."""
    plain = half_width(text)
    return let(plain, lambda x: F.trim(nfkc(x))) if compatibility else F.trim(plain)


def normalize_all(texts: Column) -> Column:
    """array<string>: normalize_text of each of an array's texts."""
    return F.transform(texts, lambda x: normalize_text(x))


def _plain(text: Column, normalized: bool, compatibility: bool) -> Column:
    return text if normalized else normalize_text(text, compatibility)


def is_empty(text: Column, markers: tuple[str, ...] = EMPTY_MARKERS, normalized: bool = False, compatibility: bool = True) -> Column:
    """Null, blank, or one of the markers for not filled in."""
    known = sorted({unicodedata.normalize("NFKC", m.translate(str.maketrans(_FULL, _HALF, SPACES))).strip() for m in markers} | {""})
    return text.isNull() | _plain(text, normalized, compatibility).isin(*known)


def parse_number(text: Column, normalized: bool = False, compatibility: bool = True) -> Column:
    """decimal(38,10): 12000, 12,000, 1.2万, ￥1200, 50%, ５００."""
    pattern = r"^([-+]?[0-9]+(?:\.[0-9]+)?)([万亿萬億千kKwW])?元?(%?)$"
    units = F.create_map(*(x for unit, times in {"": 1, **UNITS}.items() for x in (F.lit(unit), F.lit(times).cast("decimal(12,0)"))))

    # One match a value: its parts are written one after the other, led by a mark that no value has.
    body = F.translate(F.ltrim(_plain(text, normalized, compatibility), F.lit(CURRENCY)), ",，、 \t\r\n\x0b\f" + _MARK, "")

    def number(parts: Column) -> Column:
        plain = F.get(parts, F.lit(1)).try_cast(NUMBER) * F.try_element_at(units, F.get(parts, F.lit(2)))
        percent = F.get(parts, F.lit(3)) == "%"
        return F.when(F.size(parts) == 4, F.when(percent, plain / F.lit(100).cast("decimal(3,0)")).otherwise(plain).try_cast(NUMBER))

    return let(F.split(F.regexp_replace(body, pattern, _MARK + "$1" + _MARK + "$2" + _MARK + "$3"), _MARK), number)


def from_excel_serial(serial: Column) -> Column:
    """date: days from 1899-12-30 (the fraction is dropped), within the years that dates may have."""
    days = F.floor(serial.cast("double")).try_cast("int")
    day = F.date_add(F.lit("1899-12-30").cast("date"), F.when((days > 0) & (days < 80_000), days))
    return F.when(F.year(day).between(FIRST_YEAR, LAST_YEAR), day)


def parse_date(text: Column, this_year: int | Column | None = None, normalized: bool = False, compatibility: bool = True) -> Column:
    """date: 2026/9/1, 2026年9月1日, 20260901, 9-1 (in this_year, by default the current one), or a serial of up to six
    digits."""
    year_now = F.year(F.current_date()) if this_year is None else this_year if isinstance(this_year, Column) else F.lit(this_year)
    full, dense, short = "([0-9]{4})[-/.年]([0-9]{1,2})[-/.月]([0-9]{1,2})日?", "([0-9]{4})([0-9]{2})([0-9]{2})", "([0-9]{1,2})[-/.月]([0-9]{1,2})日?"
    plain = F.translate(_plain(text, normalized, compatibility), _MARK, "")
    # One match a value, of any form: year, month and day, the year empty where it isn't written.
    written = F.regexp_replace(plain, f"^(?:{full}|{dense}|{short})$", _MARK + "$1$4-$2$5$7-$3$6$8")

    def parsed(x: Column) -> Column:
        found = F.when(x.startswith(_MARK + "-"), F.concat(F.lpad(year_now.cast("string"), 4, "0"), F.substring(x, 2, 12))).when(x.startswith(_MARK), F.substring(x, 2, 12))
        day = let(found.try_cast("date"), lambda d: F.when(F.year(d).between(FIRST_YEAR, LAST_YEAR), d))
        return F.coalesce(day, F.when(x.rlike(r"^[0-9]{1,6}$"), from_excel_serial(x.try_cast("double"))))

    return let(written, parsed)


def clean_text(text: Column, markers: tuple[str, ...] = EMPTY_MARKERS, normalized: bool = False, compatibility: bool = True) -> Column:
    """Normalized text, NULL where it counts as not filled in."""
    return let(_plain(text, normalized, compatibility), lambda x: F.when(~is_empty(x, markers, True), x))


def pretty_number(number: Column) -> Column:
    """A decimal as text: whole numbers without a point, others without trailing zeros."""
    text = number.cast("string")
    return F.when(text.contains("."), F.regexp_replace(F.regexp_replace(text, "0+$", ""), r"\.$", "")).otherwise(text)


def compare_key(text: Column) -> Column:
    """For comparing values: without white space, in lower case; NULL compares as none."""
    return F.lower(F.regexp_replace(F.coalesce(text, F.lit("none")), r"[\s　]+", ""))
