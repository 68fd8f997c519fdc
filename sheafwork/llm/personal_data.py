"""Personal data in texts: proposed spans, gradient-boosted trees on format and context, calibrated thresholds.

Four kinds have a fixed pattern each (the base): email, ip, card, phone. Its spans always stand. Besides them generators
of high recall propose spans that may overlap: every window of a run of numbers that could be a phone, card or personal
number, addresses around an at sign or its paraphrase, account numbers, and long-form network addresses. Each proposal
becomes a row of numbers (its own form, its checksums, the characters that touch it, words near it), boosted trees score
it, and it is selected if its score reaches its kind's threshold. Of selected spans that overlap, the one furthest above
its threshold stays; one inside a base span adds nothing.

The trees are trained here by Spark's GBTClassifier on lines that this module writes itself with known spans, as the
corpus has no labels: TRAINING_LINES of them, a fixed number that doesn't follow the corpus. A fifth of the lines is
held out, and a kind's threshold is the least score, LEAST_SCORE or more, from which on its proposals there are personal
data at a share of PRECISION; a kind that never reaches it is not selected. Training is deterministic.

A null or empty text has no spans. Texts are scanned whole, offsets are code points, end exclusive. Of equal proposals
the earlier, then the longer one counts. Repeated rows each get their result, other columns pass through untouched; a
column of the name asked for as output is replaced. An empty table stays empty.
"""

from __future__ import annotations

import ipaddress
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheafwork.llm.batches import parts

#: Kinds in the order that breaks ties between spans of one start. The first four have a base pattern.
KINDS = ("email", "ip", "card", "phone", "iban", "national_id")
BASE_KINDS = KINDS[:4]
#: Lines written for training, trees, their depth, and the held-out share of personal data that a threshold must reach.
TRAINING_LINES, TREES, DEPTH, PRECISION, LEAST_SCORE = 12_000, 24, 4, 0.98, 0.5
#: Pieces of a run of numbers in one proposal, and characters before and behind a span whose words count.
MOST_PIECES, BEFORE, BEHIND = 6, 40, 16

Span = tuple[str, int, int]
_SPAN_FIELDS = (("kind", T.StringType()), ("start", T.LongType()), ("end", T.LongType()), ("base", T.BooleanType()))
SPANS = T.ArrayType(T.StructType([T.StructField(*f) for f in _SPAN_FIELDS]))

_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can't start inside a run of digits that it could also start before, so the lookbehind only spares retries.
_IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

_RUN = re.compile(r"[0-9]+(?:[ .\-/() ]{1,3}[0-9]+)*")
_PIECE = re.compile(r"[0-9]+")
_AT = re.compile(r"@|[\[({] ?at ?[\])}]|(?<=\w) at (?=\w)", re.I)
_SPOKEN_LOCAL = re.compile(r"[\w.%+-]{1,64} ?\Z")
_SPOKEN_DOMAIN = re.compile(r" ?[\w-]{1,63}(?:(?:\.| ?[\[({] ?dot ?[\])}] ?| dot )[\w-]{1,63}){1,8}", re.I)
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_LONG_IP = re.compile(r"(?<![0-9A-Za-z:.])[0-9A-Fa-f:]{2,4}[0-9A-Fa-f:]{0,35}:[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])")

# Words near a span that speak for a kind, or against all of them.
_CUES = (
    ("email", r"e-?mail|mailto|correo|courriel|adresse|contact|write to|schreib"),
    ("ip", r"\bip\b|\bhost|server|address|adresse|login from|\bping\b|subnet"),
    ("card", r"card|visa|master|amex|kredit|karte|tarjeta|carte|payment"),
    ("phone", r"phone|\btel\b|tel[.:éeef]|\bcall|\bfax\b|mobile|handy|m[oó]vil|portable|whatsapp|\bsms\b|rufen|appel"),
    ("iban", r"iban|account|konto|cuenta|compte|\bbic\b"),
    ("national_id", r"\bssn\b|social security|\bid card|passport|ausweis|\bdni\b|identity|s[eé]curit[eé] sociale|national id"),
)
_AGAINST = r"order|invoice|isbn|version|\bv\.?\Z|page|part no|serial|ticket|model|section|chapter|\bno\.|\bref|build|price|total|rechnung|factura|commande|tracking|\bdoi\b"
_CUE_PATTERNS = tuple(re.compile(p, re.I) for _, p in _CUES)
_AGAINST_PATTERN = re.compile(_AGAINST, re.I)


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def mod97(account: str) -> bool:
    """The check of international account numbers."""
    moved = account[4:] + account[:4]
    return moved.isalnum() and moved.isascii() and int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _email_spans(text: str) -> list[Span]:
    out, past, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > past and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            out.append(("email", start, domain.end()))
        past = domain.end() if domain else at + 1
        at = text.find("@", past)
    return out


def base_spans(text: str) -> list[Span]:
    """The spans of the base patterns: leftmost, non-overlapping within a kind, failing matches dropped, no retries."""
    found = _email_spans(text) if "@" in text else []
    if not _DIGIT.search(text):
        return found
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups()):
            found.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
            found.append(("phone", m.start(), m.end()))
    return found


def _number_proposals(text: str) -> Iterator[Span]:
    for run in _RUN.finditer(text):
        if run.end() - run.start() < 7:
            continue
        pieces = [(m.start(), m.end()) for m in _PIECE.finditer(text, run.start(), run.end())]
        for i, (first, _) in enumerate(pieces):
            digits = 0
            for start, end in pieces[i : i + MOST_PIECES]:
                digits += end - start
                if digits > 19:
                    break
                inside = text[first:end]
                opened = first
                if ")" in inside and inside.find("(") < 0 and text[first - 1 : first] == "(":
                    opened = first - 1
                if text[opened - 1 : opened] == "+":
                    opened -= 1
                if 7 <= digits <= 15:
                    yield "phone", opened, end
                if 12 <= digits:
                    yield "card", first, end
                if digits in (9, 11, 15, 17, 18):
                    yield "national_id", first, end + (digits == 17 and text[end : end + 1] in ("X", "x"))


def _address_proposals(text: str) -> Iterator[Span]:
    for m in _AT.finditer(text):
        before = _SPOKEN_LOCAL.search(text, max(0, m.start() - 65), m.start())
        behind = _SPOKEN_DOMAIN.match(text, m.end())
        if before and behind:
            yield "email", before.start(), behind.end()


def proposals(text: str, base: list[Span]) -> list[Span]:
    """Spans that could be personal data, without those inside a base span."""
    found: list[Span] = []
    has_digit = bool(_DIGIT.search(text))
    if has_digit:
        found += _number_proposals(text)
        found += (("iban", m.start(), m.end()) for m in _IBAN.finditer(text))
    if "@" in text or "at" in text or "AT" in text or "At" in text:
        found += _address_proposals(text)
    if "::" in text or text.count(":") > 6:
        found += (("ip", m.start(), m.end()) for m in _LONG_IP.finditer(text))
    if not found:
        return found
    taken = sorted((s, e) for _, s, e in base)
    starts = [s for s, _ in taken]
    # The furthest end of the base spans that start up to each of them: a span is inside one of them if it ends before.
    ends = np.maximum.accumulate([e for _, e in taken]).tolist() if taken else []
    at = np.searchsorted(starts, [s for _, s, _ in found], "right").tolist() if taken else [0] * len(found)
    return [p for p, k in zip(found, at) if not k or ends[k - 1] < p[2]]


def _kind_of(c: str) -> int:
    """What touches a span: 0 nothing or white space, 1 letter or digit, 2 a character of names and numbers, 3 money, 4 other."""
    return 0 if not c or c.isspace() else 1 if c.isalnum() else 2 if c in "._%+@#/:\\=-" else 3 if c in "$€£¥" else 4


def _is_long_ip(span: str) -> bool:
    try:
        return ipaddress.ip_address(span).version == 6
    except ValueError:
        return False


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    """A proposal as numbers: its form, its checks, what touches it, words near it."""
    span = text[start:end]
    pieces = _PIECE.findall(span)
    digits = "".join(pieces)
    lengths = [len(p) for p in pieces[:5]] + [0] * (5 - len(pieces[:5]))
    left, right = text[max(0, start - BEFORE) : start], text[end : end + BEHIND]
    solid = span.replace(" ", "")
    last = re.split(r"[.\])} ]", span)[-1]
    near = re.search(r"[ .\-/() ]{1,3}\Z", left[-4:])
    more_left = bool(near) and left[: len(left) - len(near[0])][-1:].isdigit()
    return [
        float(x)
        for x in (
            *(kind == k for k in KINDS),
            len(digits),
            len(pieces),
            *lengths,
            len(span),
            kind == "card" and luhn(digits),
            kind == "iban" and mod97(solid),
            kind == "ip" and _is_long_ip(span),
            span[:1] == "+" or digits[:2] == "00",
            digits[:1] == "0",
            "(" in span,
            span.count("-"),
            span.count(" "),
            span.count("."),
            span.count("/"),
            len(set(re.findall(r"[ .\-/]", span))),
            max((digits.count(c) for c in set(digits)), default=0) / max(1, len(digits)),
            kind == "email" and last.isalpha() and 2 <= len(last) <= 24,
            kind == "email" and "@" in span,
            kind == "email" and bool(re.search(r"[\[({] ?(?:at|dot)|\bdot\b", span, re.I)),
            _kind_of(left[-1:]),
            _kind_of(right[:1]),
            more_left,
            bool(re.match(r"[ .\-/() ]{1,3}[0-9]", right)),
            *(bool(p.search(left)) for p in _CUE_PATTERNS),
            bool(_AGAINST_PATTERN.search(left)),
            bool(_CUE_PATTERNS[KINDS.index(kind)].search(left[-20:]) or _CUE_PATTERNS[KINDS.index(kind)].search(right)),
        )
    ]


# Lines to learn from.

_SYLLABLES = ("an", "ber", "co", "de", "el", "fa", "gen", "hi", "la", "mo", "nu", "or", "pa", "que", "ri", "sa", "ti", "und", "ve", "wa")
_SAID = {
    "email": ("email", "Mail:", "contact", "Courriel", "correo", "write to"),
    "ip": ("IP", "from host", "server", "address"),
    "card": ("card", "Visa", "Karte", "tarjeta", "carte bancaire", "payment by card"),
    "phone": ("phone", "Tel.", "tel:", "call", "fax", "mobile", "Handy", "WhatsApp", "móvil"),
    "iban": ("IBAN", "account", "Konto", "cuenta", "compte"),
    "national_id": ("SSN", "social security number", "Ausweis", "DNI", "ID card", "identity"),
}
_UNSAID = ("order", "invoice no.", "ISBN", "version", "page", "serial", "part no", "ticket", "section", "ref", "build", "tracking", "total", "price")


def _word(rnd: random.Random) -> str:
    return "".join(rnd.choice(_SYLLABLES) for _ in range(rnd.randint(1, 3)))


def _digits(rnd: random.Random, n: int) -> str:
    return "".join(rnd.choice("0123456789") for _ in range(n))


def _with_luhn(rnd: random.Random, n: int, right: bool) -> str:
    body = rnd.choice("3456") + _digits(rnd, n - 2)
    good = [d for d in "0123456789" if luhn(body + d)][0]
    return body + (good if right else rnd.choice([d for d in "0123456789" if d != good]))


def _account(rnd: random.Random, right: bool) -> str:
    head, body = rnd.choice(("DE", "FR", "ES", "GB", "NL")), _digits(rnd, rnd.choice((14, 18, 20)))
    solid = [f"{head}{k:02}{body}" for k in range(2, 99)]
    solid = rnd.choice([x for x in solid if mod97(x) == right])
    return " ".join(re.findall(".{1,4}", solid)) if rnd.random() < 0.5 else solid


def _fill(rnd: random.Random, shape: str) -> str:
    return re.sub("9", lambda _: rnd.choice("0123456789"), re.sub("8", lambda _: rnd.choice("23456789"), shape))


def _entity(rnd: random.Random) -> tuple[str, str, bool]:
    """(kind, value, needs its kind's word): personal data in a form that the base leaves out."""
    kind = rnd.choice(("phone", "phone", "phone", "card", "email", "iban", "national_id", "ip"))
    if kind == "phone":
        shape, needs = rnd.choice((("(899) 899-9999", 0), ("899-899-9999", 0), ("899.899.9999", 1), ("899 899 9999", 1), ("8999999999", 1), ("08 99 99 99 99", 1), ("089/9999999", 1), ("0899 9999999", 1), ("00 89 899 99999", 0), ("899 99 99 99", 1)))
        return kind, _fill(rnd, shape), bool(needs)
    if kind == "card":
        n = rnd.choice((16, 16, 15, 14))
        return kind, _with_luhn(rnd, n, True) + " " + _with_luhn(rnd, rnd.choice((15, 16)), True), False
    if kind == "email":
        if rnd.random() < 0.3:
            return kind, f"{_word(rnd)}{rnd.choice('äöüéèñçß')}{_word(rnd)}@{_word(rnd)}{rnd.choice(('', 'ä', 'é', 'ñ'))}{rnd.randint(1, 9)}.{rnd.choice(('com', 'org', 'de', 'fr', 'example.com'))}", False
        name, host = f"{_word(rnd)}{rnd.choice(('', '.' + _word(rnd), str(rnd.randint(1, 99))))}", f"{_word(rnd)}{rnd.choice(('', str(rnd.randint(1, 9))))}"
        at, dot = rnd.choice(((" [at] ", " [dot] "), ("[at]", "."), (" (at) ", "."), ("(at)", "(dot)"), (" at ", " dot "), ("{at}", "{dot}"), (" AT ", " DOT ")))
        return kind, f"{name}{at}{host}{dot}{rnd.choice(('com', 'org', 'de', 'fr', 'example', 'net'))}", False
    if kind == "iban":
        return kind, _account(rnd, True), False
    if kind == "ip":
        whole = ":".join(f"{rnd.randrange(1 << 16):x}" for _ in range(8))
        return kind, rnd.choice((whole, f"2001:db8::{rnd.randrange(1 << 16):x}", f"fe80::{rnd.randrange(1 << 16):x}:{rnd.randrange(1 << 16):x}")), False
    shape, needs = rnd.choice((("899-99-9999", 0), ("899 99 9999", 1), ("830199199001019998", 1), ("11010519491231002X", 1)))
    return kind, _fill(rnd, shape), bool(needs)


def _plain(rnd: random.Random) -> tuple[str, str]:
    """(kind, value) of a form that the base has: where the base misses it beside other numbers the trees may find it."""
    return rnd.choice((
        lambda: ("phone", _fill(rnd, "+9 (999) 999-9999")), lambda: ("ip", ".".join(str(rnd.randint(1, 254)) for _ in range(4))), lambda: ("card", _with_luhn(rnd, 16, True)), lambda: ("email", f"{_word(rnd)}.{rnd.randint(10, 99)}@{_word(rnd)}{rnd.randint(1, 9)}.example.com"),
    ))()


def _decoy(rnd: random.Random) -> str:
    """What looks like personal data and is none."""
    year = rnd.randint(1950, 2030)
    return rnd.choice((
        lambda: _with_luhn(rnd, 16, False), lambda: " ".join(re.findall("....", _with_luhn(rnd, 16, False))), lambda: f"{_with_luhn(rnd, 16, False)} {_with_luhn(rnd, 16, False)}",
        lambda: f"{year}-{rnd.randint(1, 12):02}-{rnd.randint(1, 28):02}", lambda: f"{year}-{year + rnd.randint(1, 40)}", lambda: f"{rnd.randint(1, 28)}/{rnd.randint(1, 12)}/{year}",
        lambda: f"{year}-{rnd.randint(1, 12):02}-{rnd.randint(1, 28):02} {rnd.randint(0, 23):02}:{rnd.randint(0, 59):02}:{rnd.randint(0, 59):02}", lambda: f"${rnd.randint(1, 999)},{_digits(rnd, 3)},{_digits(rnd, 3)}.{_digits(rnd, 2)}",
        lambda: f"978-{_digits(rnd, 1)}-{_digits(rnd, 5)}-{_digits(rnd, 3)}-{_digits(rnd, 1)}", lambda: f"{rnd.randint(1, 9)}.{rnd.randint(0, 99)}.{rnd.randint(0, 999)}", lambda: _digits(rnd, rnd.randint(7, 18)),
        lambda: " ".join(_digits(rnd, rnd.randint(1, 3)) for _ in range(rnd.randint(4, 9))), lambda: f"{rnd.randint(-90, 90)}.{_digits(rnd, 6)} {rnd.randint(-180, 180)}.{_digits(rnd, 6)}", lambda: f"{_digits(rnd, 4)} {_digits(rnd, 4)}",
        lambda: f"{rnd.randrange(1 << 60):x}", lambda: f"@{_word(rnd)}", lambda: f"{_word(rnd)} @ {_word(rnd)}", lambda: f"{_word(rnd)} at {_word(rnd)}. {_word(rnd)}", lambda: f"{_word(rnd)} at {_word(rnd)}", lambda: f"{_word(rnd)} at {_word(rnd)}.{_word(rnd)}",
        lambda: _account(rnd, False), lambda: f"{rnd.randint(0, 23):02}:{rnd.randint(0, 59):02}:{rnd.randint(0, 59):02}", lambda: f"{_digits(rnd, 3)}-{_digits(rnd, 4)}", lambda: f"{_digits(rnd, 2)}-{_digits(rnd, 3)}-{_digits(rnd, 4)}",
        lambda: ":".join(f"{rnd.randrange(256):02x}" for _ in range(6)), lambda: f"{_digits(rnd, 5)}.{_digits(rnd, 4)} {_digits(rnd, 3)}", lambda: f"std::{_word(rnd)}", lambda: f"{rnd.choice(('a', 'b', 'ab', 'face', 'bad', 'f'))}::{rnd.choice(('b', 'c', 'add', 'be', 'd', 'fed'))}", lambda: f"{_fill(rnd, '899-899-9999')}-{_digits(rnd, 4)}", lambda: f"{rnd.randint(0, 9)}.{_digits(rnd, 12)}",
    ))()


def labelled_line(rnd: random.Random) -> tuple[str, set[Span]]:
    """A line of invented words, decoys and personal data, and where the latter is."""
    text, truth = "", set()
    noise = rnd.choice(("", "", "", "!!", "###", "%%%"))
    upper = rnd.random() < 0.1

    def add(piece: str) -> int:
        nonlocal text
        start = len(text) + bool(text)
        text += (" " if text else "") + piece
        return start

    for _ in range(rnd.randint(1, 3)):
        for _ in range(rnd.choice((0, 0, 1, 2, 3, 4, 5, 6))):
            add(_word(rnd) + noise)
        if rnd.random() < 0.2:
            kind, value = _plain(rnd)
            start = add(value + rnd.choice(("", noise)))
            truth.add((kind, start, start + len(value)))
        if rnd.random() < 0.5:
            kind, value, needs = _entity(rnd)
            if needs or rnd.random() < 0.4:
                add(rnd.choice(_SAID[kind]) + rnd.choice(("", ":", " is", "")))
            elif rnd.random() < 0.1 and kind not in ("card", "iban"):
                add(rnd.choice(_UNSAID))
                add(_decoy(rnd))
                continue
            start = add(value + rnd.choice(("", "", ".", ",", noise, noise)))
            if kind == "card":
                cut = value.index(" ")
                truth |= {(kind, start, start + cut), (kind, start + cut + 1, start + len(value))}
            else:
                truth.add((kind, start, start + len(value)))
        else:
            cue = rnd.random()
            if cue < 0.4:
                add(rnd.choice(_UNSAID))
            add(_decoy(rnd) + rnd.choice(("", ".", noise)))
    for _ in range(rnd.randint(0, 4)):
        add(_word(rnd) + noise)
    changed = text.upper() if upper else text
    return (changed, truth) if len(changed) == len(text) and "::" not in text else (text, truth)


def training_rows(spark: SparkSession, lines: int = TRAINING_LINES, seed: int = 7) -> DataFrame:
    """(line, kind, label, features) of the proposals in so many lines. A line depends on its number and the seed alone."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [])
            for line in batch.column(0).to_pylist():
                text, truth = labelled_line(random.Random(f"{seed}:{line}"))
                for kind, start, end in proposals(text, base_spans(text)):
                    for to, value in zip(out, (line, kind, float((kind, start, end) in truth), features(text, kind, start, end))):
                        to.append(value)
            yield pa.record_batch([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.string(), pa.float64(), pa.list_(pa.float64())))], ["line", "kind", "label", "features"])

    return spark.range(0, lines, 1, 8).mapInArrow(rows, "line long, kind string, label double, features array<double>")


@dataclass(frozen=True)
class Model:
    """Trees as arrays: node k of a tree goes left if its feature is at most its threshold; leaves lead to themselves."""

    trees: tuple[tuple[np.ndarray, ...], ...]
    depth: int
    thresholds: tuple[float, ...] = ()

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """The chance that each row is personal data, as the trees have it."""
        total, every = np.zeros(len(rows)), np.arange(len(rows))
        for feature, split, left, right, value in self.trees:
            node = np.zeros(len(rows), np.int64)
            for _ in range(self.depth):
                node = np.where(rows[every, feature[node]] <= split[node], left[node], right[node])
            total += value[node]
        return 1 / (1 + np.exp(-2 * total))


def as_arrays(model: GBTClassificationModel, depth: int) -> Model:
    trees = []
    for tree, weight in zip(model._java_obj.trees(), model.treeWeights):
        nodes: list[list[float]] = []

        def add(node: object, weight: float = weight, nodes: list = nodes) -> int:
            k = len(nodes)
            nodes.append([0, 0.0, k, k, weight * node.prediction()])
            if node.getClass().getSimpleName() == "InternalNode":
                nodes[k][0], nodes[k][1] = node.split().featureIndex(), node.split().threshold()
                nodes[k][2] = add(node.leftChild())
                nodes[k][3] = add(node.rightChild())
            return k

        add(tree.rootNode())
        feature, split, left, right, value = zip(*nodes)
        trees.append((np.array(feature, np.int64), np.array(split), np.array(left, np.int64), np.array(right, np.int64), np.array(value)))
    return Model(tuple(trees), depth)


def threshold(scores: np.ndarray, labels: np.ndarray, precision: float) -> float:
    """The least score, LEAST_SCORE or more, from which on the share of true rows is at least precision; infinite if there
    is none."""
    order = np.argsort(-scores, kind="stable")
    scores, labels = scores[order], labels[order]
    share = np.cumsum(labels) / np.arange(1, len(labels) + 1)
    last_of_score = np.append(scores[1:] < scores[:-1], True) if len(scores) else np.zeros(0, bool)
    good = np.flatnonzero(last_of_score & (share >= precision))
    return max(LEAST_SCORE, float(scores[good[-1]])) if good.size else float("inf")


_TRAINED: dict[tuple, Model] = {}


def trained(spark: SparkSession, lines: int = TRAINING_LINES, trees: int = TREES, precision: float = PRECISION) -> Model:
    """The model, trained once a driver: four fifths of the lines fit the trees, the rest sets the thresholds."""
    key = (lines, trees, precision)
    if key not in _TRAINED:
        rows = training_rows(spark, lines).withColumn("x", array_to_vector("features")).coalesce(1).sortWithinPartitions("line").persist()
        try:
            fit = GBTClassifier(featuresCol="x", labelCol="label", maxIter=trees, maxDepth=DEPTH, stepSize=0.3, seed=1).fit(rows.where("line % 5 != 0"))
            model = as_arrays(fit, DEPTH)
            held = rows.where("line % 5 = 0").select("kind", "label", "features").toPandas()
        finally:
            rows.unpersist()
        scores = model.scores(np.array(held["features"].tolist()).reshape(len(held), -1)) if len(held) else np.zeros(0)
        labels, kinds = held["label"].to_numpy(), held["kind"].to_numpy()
        _TRAINED[key] = Model(model.trees, DEPTH, tuple(threshold(scores[kinds == k], labels[kinds == k], precision) for k in KINDS))
    return _TRAINED[key]


def added_spans(text: str, base: list[Span], model: Model) -> list[Span]:
    """The selected proposals, none overlapping another."""
    found = proposals(text, base)
    if not found:
        return []
    margins: list[tuple[float, int, int, str]] = []
    for at in range(0, len(found), 4096):
        some = found[at : at + 4096]
        scores = model.scores(np.array([features(text, *p) for p in some]))
        for (kind, start, end), score in zip(some, scores.tolist()):
            least = model.thresholds[KINDS.index(kind)]
            if score >= least:
                margins.append((least - score, start, -end, kind))
    chosen: list[Span] = []
    taken: dict[int, list[tuple[int, int]]] = {}  # by hundreds of characters, so that a text of many spans stays linear
    for _, start, end, kind in sorted(margins):
        end = -end
        cells = range(start // 100, end // 100 + 1)
        if any(s < end and start < e for cell in cells for s, e in taken.get(cell, ())):
            continue
        chosen.append((kind, start, end))
        for cell in cells:
            taken.setdefault(cell, []).append((start, end))
    return chosen


def all_spans(text: str | None, model: Model) -> list[tuple[str, int, int, bool]]:
    """Base and selected spans with whether each is of the base, by start, then kind."""
    if not text:
        return []
    base = base_spans(text)
    spans = [(*s, True) for s in base] + [(*s, False) for s in added_spans(text, base, model)]
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def personal_spans(text: Column, model: Model) -> Column:
    """array<struct<kind, start, end, base>> of a text's personal data, by start, then kind; empty for null."""

    @F.arrow_udf(SPANS)
    def spans(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        from pyspark.sql.pandas.types import to_arrow_type

        kind = to_arrow_type(SPANS)
        for batch in parts(texts):
            yield pa.array([[{"kind": k, "start": s, "end": e, "base": b} for k, s, e, b in all_spans(x.as_py(), model)] for x in batch], kind)

    return spans(text)


def scan(docs: DataFrame, model: Model | None = None, text: str = "text", spans: str = "personal_spans") -> DataFrame:
    """docs with the spans of each row's text."""
    return docs.withColumn(spans, personal_spans(F.col(f"`{text}`"), model or trained(docs.sparkSession)))


def _redacted(text: str | None, model: Model) -> str | None:
    out, at = [], 0
    for kind, start, end, _ in all_spans(text, model):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]]) if out else text


def redact(docs: DataFrame, model: Model | None = None, text: str = "text") -> DataFrame:
    """docs with every span of each row's text (overlapping ones together) replaced by its kind in brackets."""
    model = model or trained(docs.sparkSession)

    @F.arrow_udf("string")
    def clean(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in parts(texts):
            yield pa.array([_redacted(x.as_py(), model) for x in batch], pa.string())

    return docs.withColumn(text, clean(F.col(f"`{text}`")))
