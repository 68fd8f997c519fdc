"""The Unicode compatibility form (NFKC) as Column operations.

Tables are generated from Python's Unicode database and are literals of the expression. Most texts need one translation
of characters to characters; those that become several are replaced one kind at a time. Only where marks follow each
other or a letter that they compose with does the whole algorithm run, on the clusters of a letter and its marks:
decomposition, stable ordering of marks by their class, composition. Hangul syllables are computed. A cluster's work
grows with the square of its marks; texts as people write them have a few.
"""

from __future__ import annotations

import unicodedata
from functools import cache
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Between the entries of a table, and what fills its values up to one length. Neither is changed by any form.
_ENTRY, _FILL = "\x1f", "\x1e"
# Where Hangul syllables and their letters begin, and how many vowels and finals there are.
_SYLLABLES, _LEADS, _VOWELS, _FINALS = 0xAC00, 0x1100, 0x1161, 0x11A7
_N_VOWELS, _N_FINALS = 21, 28
_N_SYLLABLES = 19 * _N_VOWELS * _N_FINALS


class Tables(NamedTuple):
    """one, other: characters and the ones that they become. several: those that become more than one, as entries with
    values of width characters. parts: canonical decompositions; pairs: what two characters compose to; classes: of
    marks, as a character beyond 256. growing, marks, ordered: patterns of characters that become several, that may
    change with what is before them, and that have a class."""

    one: str
    other: str
    several: str
    width: int
    parts: str
    pairs: str
    classes: str
    growing: str
    marks: str
    ordered: str


#: Gaps between characters of a class beyond which another block of it begins, blocks within blocks.
_GAPS = (0x800, 0x40)


def _pattern(chars: list[str]) -> str:
    """A character class in blocks: a character is compared with the ranges of the one block that it is in."""

    def span(first: int, last: int) -> str:
        return f"\\x{{{first:x}}}" + (f"-\\x{{{last:x}}}" if last > first else "")

    def inside(ranges: list[list[int]], gaps: tuple[int, ...]) -> str:
        if not gaps or len(ranges) == 1:
            return "".join(span(*r) for r in ranges)
        blocks: list[list[list[int]]] = []
        for r in ranges:
            if blocks and r[0] - blocks[-1][-1][1] <= gaps[0]:
                blocks[-1].append(r)
            else:
                blocks.append([r])
        return "".join(f"[{span(b[0][0], b[-1][1])}&&[{inside(b, gaps[1:])}]]" if len(b) > 1 else span(*b[0]) for b in blocks)

    ranges: list[list[int]] = []
    for code in sorted(map(ord, chars)):
        if ranges and code == ranges[-1][1] + 1:
            ranges[-1][1] = code
        else:
            ranges.append([code, code])
    return f"[{inside(ranges, _GAPS)}]"


@cache
def tables() -> Tables:
    chars = [chr(k) for k in range(0x110000) if not 0xD800 <= k < 0xE000]
    form = {c: f for c in chars if (f := unicodedata.normalize("NFKC", c)) != c}
    several = {c: f for c, f in form.items() if len(f) > 1}
    width = max(map(len, several.values()))
    parts = {c: d for c in chars if not _SYLLABLES <= ord(c) < _SYLLABLES + _N_SYLLABLES and (d := unicodedata.normalize("NFD", c)) != c and unicodedata.normalize("NFC", c) == c}
    pairs = {}
    for c in parts:
        step = unicodedata.decomposition(c).split()  # one step: two characters
        if len(step) == 2:
            pairs[chr(int(step[0], 16)) + chr(int(step[1], 16))] = c
    classes = {c: k for c in chars if (k := unicodedata.combining(c))}
    marks = {*classes, *(pair[1] for pair in pairs), *map(chr, range(_VOWELS, _VOWELS + _N_VOWELS)), *map(chr, range(_FINALS + 1, _FINALS + _N_FINALS))}
    table = lambda values, size: "".join(_ENTRY + k + v + _FILL * (size - len(v)) for k, v in values.items())
    one = {c: f for c, f in form.items() if len(f) == 1}
    return Tables(
        "".join(one), "".join(one.values()), table(several, width), width, table(parts, 4), table(pairs, 1),
        table({c: chr(256 + k) for c, k in classes.items()}, 1), _pattern(list(several)), _pattern(list(marks)), _pattern(list(classes)),
    )


def _found(table: str, key: Column, key_chars: int, size: int) -> Column:
    """A key's value in a table, null if it has none."""
    at = F.instr(F.lit(table), F.concat(F.lit(_ENTRY), key))
    return F.when(at > 0, F.translate(F.substring(F.lit(table), at + 1 + key_chars, F.lit(size)), _FILL, ""))


def _characters(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))


def _picked(first: int, n: int, k: Column) -> Column:
    """The k-th of n characters from a code point on."""
    return F.substring(F.lit("".join(map(chr, range(first, first + n)))), k.cast("int") + 1, F.lit(1))


def _decomposed(char: Column) -> Column:
    k = F.ascii(char) - _SYLLABLES
    rest = F.pmod(k, F.lit(_N_FINALS))
    letters = F.concat(
        _picked(_LEADS, 19, F.floor(k / (_N_VOWELS * _N_FINALS))), _picked(_VOWELS, _N_VOWELS, F.floor(F.pmod(k, F.lit(_N_VOWELS * _N_FINALS)) / _N_FINALS)),
        F.when(rest > 0, _picked(_FINALS, _N_FINALS, rest)).otherwise(""),
    )
    return F.when(k.between(0, _N_SYLLABLES - 1), letters).otherwise(F.coalesce(_found(tables().parts, char, 1, 4), char))


def _composed(first: Column, second: Column) -> Column:
    """What two characters compose to, null if they don't."""
    a, b = F.ascii(first), F.ascii(second)
    lead, vowel, final, syllable = a - _LEADS, b - _VOWELS, b - _FINALS, a - _SYLLABLES
    of = lambda k: _picked(_SYLLABLES, _N_SYLLABLES, k)
    return (
        F.when(first == "", F.lit(None).cast("string"))
        .when(lead.between(0, 18) & vowel.between(0, _N_VOWELS - 1), of((lead * _N_VOWELS + vowel) * _N_FINALS))
        .when(syllable.between(0, _N_SYLLABLES - 1) & (F.pmod(syllable, F.lit(_N_FINALS)) == 0) & final.between(1, _N_FINALS - 1), of(syllable + final))
        .otherwise(_found(tables().pairs, F.concat(first, second), 2, 1))
    )


def _cluster(text: Column) -> Column:
    """A letter with what may compose or change places behind it, in composed form."""
    whole = F.array_join(F.transform(_characters(text), _decomposed), "")
    ranked = lambda c: F.coalesce(F.ascii(_found(tables().classes, c, 1, 1)) - 256, F.lit(0))
    # Marks change places among themselves only: each piece is a character without a class and the marks behind it.
    pieces = F.regexp_extract_all(whole, F.lit(f"(?s).{tables().ordered}*"), F.lit(0))
    ordered = F.flatten(F.transform(pieces, lambda p: F.array_sort(F.transform(_characters(p), lambda c, k: F.struct(ranked(c).alias("rank"), k.alias("k"), c.alias("c"))))))
    empty = F.struct(F.lit("").alias("done"), F.lit("").alias("letter"), F.lit("").alias("behind"), F.lit(0).alias("last"))

    def step(now: Column, x: Column) -> Column:
        near = (now["behind"] == "") | (now["last"] < x["rank"])
        made = F.when(near, _composed(now["letter"], x["c"]))
        state = lambda done, letter, behind, last: F.struct(done.alias("done"), letter.alias("letter"), behind.alias("behind"), last.cast("int").alias("last"))
        alone = state(F.concat(now["done"], now["letter"], now["behind"]), x["c"], F.lit(""), F.lit(0))
        beside = state(now["done"], now["letter"], F.concat(now["behind"], x["c"]), x["rank"])
        return F.when(made.isNotNull(), state(now["done"], F.coalesce(made, F.lit("")), now["behind"], now["last"])).when(x["rank"] == 0, alone).otherwise(beside)

    return F.aggregate(ordered, empty, step, lambda s: F.concat(s["done"], s["letter"], s["behind"]))


def nfkc(text: Column) -> Column:
    """text in Unicode compatibility form; null stays null."""
    t = tables()
    let = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))  # noqa: E731  each step's text is formed once

    def grown(x: Column) -> Column:
        kinds = F.array_distinct(F.regexp_extract_all(x, F.lit(t.growing), F.lit(0)))
        return F.when(x.rlike(t.growing), F.aggregate(kinds, x, lambda acc, c: F.replace(acc, c, _found(t.several, c, 1, t.width)))).otherwise(x)

    def composed(x: Column) -> Column:
        pattern = f"(?s).{t.marks}+"
        clusters = F.transform(F.regexp_extract_all(x, F.lit(pattern), F.lit(0)), _cluster)
        pieces = F.zip_with(F.split(x, pattern), clusters, lambda plain, cluster: F.concat(plain, F.coalesce(cluster, F.lit(""))))
        return F.when(x.rlike(t.marks), F.array_join(pieces, "")).otherwise(x)

    changed = let(let(F.translate(text, t.one, t.other), grown), composed)
    return F.when(text.rlike(r"[^\x00-\x7F]"), changed).otherwise(text)
