"""Encoding and decoding with a SentencePiece BPE vocabulary through a table of prefixes.

The BPE encoding of a text is the one sequence of pieces in which every two neighbours are compatible, that is, in
which the pair's own text encodes to just that pair. So each prefix of a text has one last piece: of the pieces that
end there (found by an automaton over the vocabulary), the one that is compatible with the last piece of the prefix
that it leaves. The table holds that piece for every prefix, and the ids are recovered from its end backwards.

Compatibility needs no encoding: the merges that build a piece always happen in one order, so two pieces are walked
through theirs side by side, and they are incompatible if a merge across the boundary comes first.

Texts are encoded whole, whatever their length; an empty table gives an empty one. There is one encoding, so no ties. A
null text counts as empty; an empty text has only the begin and end ids (if asked for). Characters outside the vocabulary become byte pieces. Repeated rows each get their result; other columns pass through.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from sheafwork.llm.batches import parts

_SPACE = "▁"
_NEVER = 1 << 60
#: Words kept with their ids in each Python worker; the cache starts anew when it is full.
CACHE_WORDS = 100_000
#: Likewise for pairs of pieces whose compatibility is known.
CACHE_PAIRS = 250_000


class PieceCodec:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, model_file: str) -> None:
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        size = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(size)]
        special = {i for i in range(size) if model.is_control(i) or model.is_unknown(i) or model.is_unused(i)}
        self.bytes_of = {i: int(self.pieces[i][3:-1], 16) for i in range(size) if model.is_byte(i)}
        normal = [i for i in range(size) if i not in special and i not in self.bytes_of]
        self.id_of = {self.pieces[i]: i for i in normal}
        scores = sorted({model.get_score(i) for i in normal}, reverse=True)
        rank = {score: k for k, score in enumerate(scores)}
        self.rank = {self.pieces[i]: rank[model.get_score(i)] for i in normal}
        self.begin, self.end, self.unknown = model.bos_id(), model.eos_id(), model.unk_id()
        self.byte_ids = {b: i for i, b in self.bytes_of.items()}
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.id_of.items():
            self.automaton.add_word(piece, (i, len(piece)))
        self.automaton.make_automaton()
        # Pieces have the space mark in front only, so none spans two words; nor a line break, if no piece has one.
        whole = any(_SPACE in piece.lstrip(_SPACE) for piece in self.id_of)
        lines = any("\n" in piece for piece in self.id_of)
        pattern = "(?s).+" if whole else f"{_SPACE}+[^{_SPACE}]*|[^{_SPACE}]+" if lines else f"{_SPACE}+[^{_SPACE}\n]*|[^{_SPACE}\n]+|\n"
        self.words = re.compile(pattern).findall
        self.merges: dict[int, tuple[list, list] | None] = {}
        self.pairs: dict[int, bool] = {}
        self.known: dict[str, bytes] = {}
        self.surface = [
            b"" if i in special - {self.unknown} else bytes([self.bytes_of[i]]) if i in self.bytes_of else p.replace(_SPACE, " ").encode()
            for i, p in enumerate(self.pieces)
        ]
        self.surface[self.unknown] = " ⁇ ".encode()
        self.silent = special - {self.unknown}

    def _history(self, piece_id: int) -> tuple[list, list] | None:
        """The merges that build a piece: (rank, last symbol after it) and (rank, first symbol after it), each led by
        the symbol before any merge. None if merging the piece's characters ends otherwise."""
        if piece_id in self.merges:
            return self.merges[piece_id]
        symbols = list(self.pieces[piece_id])
        last, first = [(0, symbols[-1])], [(0, symbols[0])]
        while len(symbols) > 1:
            best, at = min((self.rank.get(a + b, _NEVER), k) for k, (a, b) in enumerate(zip(symbols, symbols[1:])))
            if best == _NEVER:
                break
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
            last.append((best, symbols[-1]))
            first.append((best, symbols[0]))
        out = self.merges[piece_id] = (last, first) if len(symbols) == 1 else None
        return out

    def compatible(self, left: int, right: int) -> bool:
        """Whether the text of the two pieces encodes to just these two."""
        key = left << 32 | right
        known = self.pairs.get(key)
        if known is None:
            known = self.pairs[key] = self._compatible(left, right)
        return known

    def _compatible(self, left: int, right: int) -> bool:
        one, two = self._history(left), self._history(right)
        if one is None or two is None:
            return False
        ends, starts, i, j, get = one[0], two[1], 0, 0, self.rank.get
        while True:
            across = get(ends[i][1] + starts[j][1], _NEVER)
            a = ends[i + 1][0] if i + 1 < len(ends) else _NEVER
            b = starts[j + 1][0] if j + 1 < len(starts) else _NEVER
            if across < a and across <= b:  # of equal ranks, the leftmost merges first
                return False
            if a <= b and a < _NEVER:
                i += 1
            elif b < _NEVER:
                j += 1
            else:
                return True

    def _encode_word(self, word: str) -> bytes:
        n = len(word)
        last, length = [-1] * (n + 1), [1] * (n + 1)  # of each prefix, its last piece; -1 stands for a lone character
        done = 0
        for at, (piece, size) in self.automaton.iter(word):
            past = at + 1
            if past == done:
                continue
            before = last[past - size]
            if self.compatible(before, piece) if before >= 0 else self._history(piece) is not None:
                last[past], length[past], done = piece, size, past
        ids, at = [], n
        while at:
            if last[at] >= 0:
                ids.append(last[at])
            elif self.byte_ids:
                ids += [self.byte_ids[b] for b in reversed(word[at - 1].encode())]
            elif not ids or ids[-1] != self.unknown:
                ids.append(self.unknown)
            at -= length[at]
        return np.array(ids[::-1], "<u4").tobytes()

    def encode(self, text: str | None, begin: bool = True, end: bool = True) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        out = [self.begin.to_bytes(4, "little")] if begin else []
        if text:
            known = self.known
            for word in self.words(_SPACE + text.replace(" ", _SPACE)):
                ids = known.get(word)
                if ids is None:
                    ids = self._encode_word(word)
                    if len(word) <= 64:
                        if len(known) >= CACHE_WORDS:
                            known.clear()
                        known[word] = ids
                out.append(ids)
        if end:
            out.append(self.end.to_bytes(4, "little"))
        if len(self.pairs) > CACHE_PAIRS:
            self.pairs.clear()
        return b"".join(out)

    def decode(self, packed: bytes | None) -> str:
        """The text of packed ids: byte pieces are joined, bytes that are no UTF-8 become U+FFFD one by one, begin and
        end vanish, and so does one space mark in front of all."""
        ids = np.frombuffer(packed or b"", "<u4").tolist()
        k = next((k for k, i in enumerate(ids) if i not in self.silent), len(ids))
        if k == len(ids):
            return ""
        while ids[-1] in self.silent:
            ids.pop()
        parts = [self.surface[i] for i in ids[k:]]
        if ids[k] not in self.bytes_of and self.pieces[ids[k]].startswith(_SPACE):
            parts[0] = parts[0][1:]
        if self.silent.isdisjoint(ids[k:]):  # these part the bytes on their sides
            try:
                return b"".join(parts).decode()
            except UnicodeDecodeError:
                pass
        return self._lenient(ids[k:], parts)

    def _lenient(self, ids: list[int], parts: list[bytes]) -> str:
        out: list[str] = []
        run = b""
        for i, part in [*zip(ids, parts), (-1, b"")]:
            if i in self.bytes_of:
                run += part
                continue
            while run:
                for size in (1, 2, 3, 4):
                    try:
                        out.append(run[:size].decode())
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    size = 1
                run = run[size:]
            out.append(part.decode())
        return "".join(out)


@lru_cache(maxsize=4)
def codec(model_file: str) -> PieceCodec:
    """One codec a file and Python worker."""
    return PieceCodec(model_file)


def encode_ids(text: Column, model_file: str, begin: bool = True, end: bool = True) -> Column:
    """binary: a text's ids as little-endian unsigned 32-bit integers."""

    @F.arrow_udf("binary")
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encode = codec(model_file).encode
        for batch in parts(texts):
            yield pa.array([encode(x.as_py(), begin, end) for x in batch], pa.binary())

    return run(text)


def decode_ids(packed: Column, model_file: str) -> Column:
    """string: the text of packed ids; empty for null."""

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        decode = codec(model_file).decode
        for batch in parts(batches):
            yield pa.array([decode(x.as_py()) for x in batch], pa.string())

    return run(packed)


def round_trip(text: Column, model_file: str, begin: bool = True, end: bool = True) -> Column:
    """struct<ids, decoded>: a text's ids as by encode_ids and their text as by decode_ids, in one pass."""

    @F.arrow_udf("ids binary, decoded string")
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        one = codec(model_file)
        for batch in parts(texts):
            ids = [one.encode(x.as_py(), begin, end) for x in batch]
            yield pa.StructArray.from_arrays([pa.array(ids, pa.binary()), pa.array(map(one.decode, ids), pa.string())], ["ids", "decoded"])

    return run(text)


def n_ids(packed: Column) -> Column:
    return (F.octet_length(packed) / 4).cast("long")
