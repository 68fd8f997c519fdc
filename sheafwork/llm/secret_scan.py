"""Secret scan with structural confirmation.

Base spans come from three patterns (assigned values, access key ids, hex runs). On top of them, base64 and hex
candidates are decoded and are reported only if what they hold parses: a token whose header is a JSON object naming
its algorithm, DER whose nested lengths add up and whose fields are those of a private key, an OpenSSH private key
whose length-prefixed fields fill the body, or printable text that holds a base secret, a signed token or a PEM private
key itself. A key between PEM marks may be quoted, have its line ends written as escapes, or be encrypted under headers
that name the cipher; one without marks may go on over lines.

Every row gives a result: a null or empty text has no spans; an empty table stays empty. Texts are scanned whole, offsets are code points, end
exclusive. Repeated rows each get their result, other columns pass through untouched; a column of the name asked for
as output is replaced.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheafwork.llm.batches import parts

#: Kinds in the order that breaks ties between spans of one start. The first three are the base kinds.
KINDS = ("assign", "access", "hex", "jwt", "pem_key", "der_key", "ssh_key", "hex_key", "encoded")
BASE_KINDS = KINDS[:3]

SPANS = T.ArrayType(
    T.StructType(
        [T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]
    )
)

_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
# A run of the class cannot start inside a longer one, so the lookbehind spares retries and changes no match.
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")
# Dots after a token end a sentence, unless more of a token follows.
_JWT = re.compile(r"(?<![A-Za-z0-9_.-])([A-Za-z0-9_-]{8,})\.([A-Za-z0-9_-]{2,})\.([A-Za-z0-9_-]*)(?!\.*[A-Za-z0-9_-])")
# What is between the marks has none of them, so a search ends at the next one.
_PEM = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*)PRIVATE KEY-----([^-]*(?:-(?!----)[^-]*)*)-----END \1PRIVATE KEY-----")
# Line ends and slashes as JSON and settings write them, marks of quoted lines, and the lines that tell of encryption.
_ESCAPED_END, _QUOTED, _PEM_HEADER = re.compile(r"\\r\\n|\\[nrt]"), re.compile(r"^[ \t]*(?:[>|][ \t]?)+", re.M), re.compile(r"^([A-Za-z][A-Za-z0-9-]*):[ \t]*(.*)$", re.M)
_CIPHER = re.compile(r"(DES|RC2|AES|CAMELLIA|SEED|BF|CAST5|IDEA)[A-Z0-9-]*,([0-9A-Fa-f]{16}|[0-9A-Fa-f]{32})")
# The beginnings of keys in base64 at a line's or word's start, and the lines that one may go on in.
_KEY_START = re.compile(r"(?<![A-Za-z0-9+/_=-])(?:M[C-I][A-Za-z0-9+/]{14}|b3BlbnNzaC1rZXktdjE)")
_KEY_LINES = re.compile(r"[A-Za-z0-9+/]+(?:\r?\n[ \t>|]*[A-Za-z0-9+/]+)+")
# The shortest base secret has 18 characters: an access key, or an assigned value with its name.
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,}={0,2}")
_HEX_ANY = re.compile(r"(?<![0-9A-Fa-f])(?:[0-9A-Fa-f]{2}){18,}(?![0-9A-Fa-f])")
# What a text must contain for a pattern to match at all, as cheap substring tests over a text whose characters are
# mapped to their class: a run of 16 hex digits, of 36 of either case, of 24 of base64, a dot between token parts.
_ASSIGN_WORDS = ("pass", "secret", "token", "api")


def _classes(members: str) -> bytes:
    return bytes(ord("x") if chr(b) in members else b if b == ord(".") else ord(" ") for b in range(256))


_ALNUM = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
_HEX_CLASS, _HEX_ANY_CLASS = _classes("0123456789abcdef"), _classes("0123456789abcdefABCDEF")
_BASE64_CLASS, _TOKEN_CLASS = _classes(_ALNUM + "+/_-"), _classes(_ALNUM + "_-")
_SSH_MAGIC = b"openssh-key-v1\x00"


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The spans of the three base patterns: leftmost, non-overlapping within a kind, too short matches dropped."""
    found, low, raw = [], text.lower(), text.encode()
    if any(word in low for word in _ASSIGN_WORDS):
        found += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    if b"x" * 16 in raw.translate(_HEX_CLASS):
        found += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return found


def unbase64(candidate: str) -> bytes | None:
    """What standard or URL-safe base64 holds, with or without padding; None if it isn't base64."""
    body = re.sub(r"\s", "", candidate).rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_fields(data: bytes, start: int = 0, end: int | None = None) -> list[tuple[int, int, int]] | None:
    """(tag, first, past) of each element between start and end; None unless their lengths fill it exactly."""
    end = len(data) if end is None else end
    fields = []
    while start < end:
        if start + 2 > end:
            return None
        tag, size, at = data[start], data[start + 1], start + 2
        if size & 0x80:
            n = size & 0x7F
            if not 1 <= n <= 4 or at + n > end:
                return None
            size, at = int.from_bytes(data[at : at + n], "big"), at + n
            if size < 0x80 or n > 1 and size < 1 << (8 * (n - 1)):  # DER has the shortest length form only
                return None
        if at + size > end:
            return None
        fields.append((tag, at, at + size))
        start = at + size
    return fields


def is_der_private_key(data: bytes) -> bool:
    """PKCS#1, PKCS#8 (also encrypted) or SEC1: the nested lengths and the kinds of fields must be those of a key."""
    top = der_fields(data)
    if not top or len(top) != 1 or top[0][0] != 0x30:
        return False
    inner = der_fields(data, *top[0][1:])
    if not inner:
        return False
    tags = [f[0] for f in inner]
    first = data[inner[0][1] : inner[0][2]]
    if tags[:9] == [0x02] * 9 and first in (b"\x00", b"\x01"):
        return True  # version, n, e, d, p, q and the three remainders
    if tags == [0x02] * 6 and first == b"\x00":
        return inner[1][2] - inner[1][1] >= 64  # version, p of 512 bits or more, q, g and the two keys
    if tags[:3] == [0x02, 0x30, 0x04] and first in (b"\x00", b"\x01"):
        algorithm = der_fields(data, *inner[1][1:])
        return bool(algorithm) and algorithm[0][0] == 0x06
    if tags[:2] == [0x02, 0x04] and first == b"\x01":
        return 16 <= inner[1][2] - inner[1][1] <= 72
    if tags == [0x30, 0x04]:
        algorithm = der_fields(data, *inner[0][1:])
        return bool(algorithm) and [f[0] for f in algorithm] == [0x06, 0x30]
    return False


def ssh_key_length(data: bytes) -> int | None:
    """Where an OpenSSH private key ends: after the magic, length-prefixed fields and a count of keys; None if the data
    isn't one as far as it goes."""
    if not data.startswith(_SSH_MAGIC):
        return None
    at = len(_SSH_MAGIC)

    def field() -> bytes | None:
        nonlocal at
        if at + 4 > len(data):
            return None
        size = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + size > len(data):
            return None
        at += 4 + size
        return data[at - size : at]

    if any(field() is None for _ in range(3)) or at + 4 > len(data):
        return None
    keys, at = int.from_bytes(data[at : at + 4], "big"), at + 4
    return at if 1 <= keys <= 64 and all(field() is not None for _ in range(keys + 1)) else None


def is_ssh_private_key(data: bytes) -> bool:
    """The OpenSSH format, filling the data."""
    return ssh_key_length(data) == len(data)


def is_signed_token(head: str, body: str) -> bool:
    """Both parts decode to JSON objects and the header names its algorithm."""
    parts = []
    for part in (head, body):
        raw = unbase64(part)
        try:
            parts.append(json.loads(raw) if raw and raw[:1] == b"{" else None)
        except (ValueError, RecursionError):
            return False
    return all(isinstance(x, dict) for x in parts) and isinstance(parts[0].get("alg"), str)


def _key_kind(data: bytes | None) -> str | None:
    if not data:
        return None
    if data[0] == 0x30 and is_der_private_key(data):
        return "der_key"
    return "ssh_key" if is_ssh_private_key(data) else None


def _is_pem_body(body: str) -> bool:
    """What is between a private key's marks: base64 of a key, with line ends in any writing and lines quoted or not; or
    headers that name a cipher and its start, and base64 of whole blocks."""
    body = _QUOTED.sub("", _ESCAPED_END.sub("\n", body)).replace("\\/", "/")
    headers = dict(_PEM_HEADER.findall(body))
    data = unbase64(_PEM_HEADER.sub("", body)) if re.fullmatch(r"[A-Za-z0-9+/=\s]*", _PEM_HEADER.sub("", body)) else None
    if "ENCRYPTED" in headers.get("Proc-Type", ""):
        cipher = _CIPHER.fullmatch(headers.get("DEK-Info", "").strip())
        return bool(cipher and data) and len(data) >= 32 and len(data) % (len(cipher[2]) // 2) == 0
    return _key_kind(data) is not None


def _pem_spans(text: str) -> list[tuple[str, int, int]]:
    if "-----BEGIN " not in text:
        return []
    return [("pem_key", m.start(), m.end()) for m in _PEM.finditer(text) if _is_pem_body(m[2])]


def _jwt_spans(text: str) -> list[tuple[str, int, int]]:
    if b"xxxxxxxx.xx" not in text.encode().translate(_TOKEN_CLASS):
        return []
    return [("jwt", m.start(), m.end()) for m in _JWT.finditer(text) if is_signed_token(m[1], m[2])]


def _wrapped_spans(text: str) -> list[tuple[str, int, int]]:
    """Keys in base64 without marks that go on over several lines. Their own lengths tell where they end, and how far to
    look: lines have 16 characters or more for each six of line ends and indents."""
    if "\n" not in text:
        return []
    found, past = [], 0
    for m in _KEY_START.finditer(text):
        if m.start() < past:
            continue
        head = base64.b64decode(m[0][:16])
        if m[0][0] == "M":
            n = head[1] & 0x7F
            size = head[1] + 2 if head[1] < 0x80 else int.from_bytes(head[2 : 2 + n], "big") + 2 + n if 1 <= n <= 4 else 0
            first = 2 if head[1] < 0x80 else 2 + n
            if size < 40 or head[first] not in (0x02, 0x30):  # a key begins with its version or its algorithm
                continue
        reach = 2 * size + 4096 if m[0][0] == "M" else 1 << 20
        if not (lines := _KEY_LINES.match(text, m.start(), m.start() + reach)):
            continue
        spots = [k.start() for k in re.finditer("[A-Za-z0-9+/]+", lines[0])]
        body = re.sub(r"[^A-Za-z0-9+/]", "", lines[0])
        data = base64.b64decode(body[: len(body) // 4 * 4] + (body[len(body) // 4 * 4 :] + "==")[: 4 if len(body) % 4 > 1 else 0])
        size = size if m[0][0] == "M" else ssh_key_length(data)
        if not size or size > len(data) or not (kind := _key_kind(data[:size])):
            continue
        left = (size * 8 + 5) // 6  # characters of the key itself
        for spot in spots:
            step = min(left, len(re.match("[A-Za-z0-9+/]+", lines[0][spot:])[0]))
            left, end = left - step, m.start() + spot + step
            if not left:
                break
        end += len(re.match("={0,2}", text[end : end + 2])[0])
        if "\n" in text[m.start() : end]:
            found.append((kind, m.start(), end))
            past = end
    return found


def _holds_secret(data: bytes | None) -> bool:
    """Printable text with an assigned value, an access key, a signed token or a PEM private key in it."""
    try:
        text = data.decode() if data else ""
    except UnicodeDecodeError:
        return False
    if not text or not all(c.isprintable() or c in "\t\r\n" for c in text):
        return False
    return any(kind != "hex" for kind, _, _ in base_spans(text)) or bool(_pem_spans(text)) or bool(_jwt_spans(text))


def structural_spans(text: str) -> list[tuple[str, int, int]]:
    """The spans whose decoded content parses."""
    found, raw = _jwt_spans(text), text.encode()
    marked = _pem_spans(text)
    found += marked
    found += [w for w in _wrapped_spans(text) if not any(a <= w[1] and w[2] <= b for _, a, b in marked)]
    runs = b"x" * 24 in raw.translate(_BASE64_CLASS)
    for m in _BASE64.finditer(text) if runs else ():
        data = unbase64(m[0])
        if kind := _key_kind(data):
            found.append((kind, m.start(), m.end()))
        elif _holds_secret(data):
            found.append(("encoded", m.start(), m.end()))
    runs = b"x" * 36 in raw.translate(_HEX_ANY_CLASS)
    for m in _HEX_ANY.finditer(text) if runs else ():
        data = bytes.fromhex(m[0])
        if _key_kind(data):
            found.append(("hex_key", m.start(), m.end()))
        elif _holds_secret(data):
            found.append(("encoded", m.start(), m.end()))
    return found


def all_spans(text: str | None) -> list[tuple[str, int, int]]:
    """Base and structural spans, by start, then kind."""
    if not text:
        return []
    return sorted(base_spans(text) + structural_spans(text), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


@F.arrow_udf(SPANS)
def _spans(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(SPANS)
    for batch in parts(texts):
        yield pa.array(
            [[{"kind": k, "start": s, "end": e} for k, s, e in all_spans(x.as_py())] for x in batch], kind
        )


def secret_spans(text: Column) -> Column:
    """array<struct<kind, start, end>> of every secret in a text, by start, then kind; empty for null."""
    return _spans(text)


def scan(docs: DataFrame, text: str = "text", spans: str = "secret_spans") -> DataFrame:
    """docs with the spans of each row's text."""
    return docs.withColumn(spans, secret_spans(F.col(text)))


def _redact(text: str | None, mark: str) -> str | None:
    spans = all_spans(text)
    if not spans:
        return text
    out, at = [], 0
    for _, start, end in spans:
        if end <= at:
            continue
        if start >= at:
            out += [text[at:start], mark]
        at = end
    return "".join([*out, text[at:]])


def redacted(text: Column, mark: str = "[SECRET]") -> Column:
    """string: a text with every span (overlapping ones together) replaced by mark. A text without spans stays."""

    @F.arrow_udf("string")
    def clean(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in parts(texts):
            yield pa.array([_redact(x.as_py(), mark) for x in batch], pa.string())

    return clean(text)


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs with each row's text redacted."""
    return docs.withColumn(text, redacted(F.col(text), mark))
