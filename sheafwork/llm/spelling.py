"""Spelling variants of a corpus's words by full neighbourhood generation.

A word's neighbourhood is every string that one deletion, replacement or insertion over the vocabulary's own alphabet
makes of it. Equal results are skipped as they are formed (a deletion within a run of one letter, an insertion behind
the same letter), so each is generated once. Every neighbour in the vocabulary is a near word: the two meet by equality
in a join, and no distance is computed.

Most generated strings are no words. A hash of each is formed from those of the word's prefixes and suffixes, without
building the string, and looked up in a bit table of the vocabulary's hashes. The table has a fixed largest size; when
the vocabulary outgrows it, more strings pass and the join drops them. A string that is a word always passes.

Words of null or empty texts are none. A document's repeated rows count each. Text is read whole; a worker holds one
document's words, a bounded table of counts, and a bounded number of candidates. Ties between forms go to the first word
in code-point order. An empty table gives no rows. Other columns, of any name, are left out.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheafwork.llm import scratch

#: Words that a task counts before it hands their counts on.
COUNTED_WORDS = 200_000
#: Bits of the filter for each word of the vocabulary, and its least and largest size (64 MB) as powers of two.
BITS_A_WORD, LEAST_BITS, MOST_BITS = 32, 16, 29
#: Candidates that are hashed at once.
CANDIDATES = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_MIXES = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(0xD6E8FEB86659FD93))
#: Bits of the table in one row of it, as it is put together.
_BLOCK = 1 << 16


def word_counts(
    docs: DataFrame,
    pattern: str,
    change: Callable[[object, str], str] | None = None,
    least_length: int = 1,
    least_count: int = 1,
    id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """(word, n) of the runs of pattern in the texts, A-Z lower-cased, and of at least so many code points and
    occurrences. change(id, run) may replace a run. Tasks count before anything is shuffled."""
    found = re.compile(pattern)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()

        def rows() -> pa.RecordBatch:
            return pa.record_batch([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for own, body in zip(batch.column(0), batch.column(1)):
                if not body.is_valid:
                    continue
                # The encoded form has no A-Z but those of the text itself.
                runs = Counter(found.findall(body.as_buffer().to_pybytes().lower().decode()))
                own = own.as_py()
                for run, n in runs.items():
                    word = change(own, run) if change else run
                    if len(word) >= least_length:
                        total[word] += n
                if len(total) >= COUNTED_WORDS:
                    yield rows()
                    total.clear()
        yield rows()

    counts = docs.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").alias("text")).mapInArrow(count, "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _powers(n: int) -> np.ndarray:
    out = np.ones(n + 1, np.uint64)
    out[1:] = _BASE
    return np.multiply.accumulate(out)


def _codes(words: list[str]) -> np.ndarray:
    """Words of one length as a matrix of code points; one more than each, so that no letter is zero."""
    return np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(len(words), -1).astype(np.uint64) + np.uint64(1)


def _prefix_hashes(codes: np.ndarray) -> np.ndarray:
    """(n, length + 1): the hash of each prefix, the first letter weighted highest. Arithmetic is modulo 2^64."""
    out = np.zeros((codes.shape[0], codes.shape[1] + 1), np.uint64)
    for k in range(codes.shape[1]):
        out[:, k + 1] = out[:, k] * _BASE + codes[:, k]
    return out


def _suffix_hashes(codes: np.ndarray, powers: np.ndarray) -> np.ndarray:
    """(n, length + 1): the hash of each suffix, the empty one last."""
    n, size = codes.shape
    out = np.zeros((n, size + 1), np.uint64)
    for k in range(size - 1, -1, -1):
        out[:, k] = out[:, k + 1] + codes[:, k] * powers[size - 1 - k]
    return out


def _places(hashes: np.ndarray, mix: np.uint64, bits: int) -> np.ndarray:
    """Where a hash's bit for a mix is in a table of 2^bits."""
    x = (hashes ^ (hashes >> np.uint64(29))) * mix
    return (x ^ (x >> np.uint64(32))) * mix >> np.uint64(64 - bits)


def _in_table(hashes: np.ndarray, table: np.ndarray, bits: int) -> np.ndarray:
    """Positions of the hashes whose bits are all set."""
    left = np.arange(hashes.size)
    for mix in _MIXES:
        at = _places(hashes[left], mix, bits)
        left = left[(table[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1]
    return left


def _by_length(words: list[str]) -> Iterator[list[int]]:
    order: dict[int, list[int]] = {}
    for k, word in enumerate(words):
        order.setdefault(len(word), []).append(k)
    yield from order.values()


def bit_table(words: DataFrame, n: int, word: str = "word") -> tuple[np.ndarray, int]:
    """(bytes, power of two of its bits) of the hashes of n words. Executors form blocks of the table; its size has a
    bound whatever n is."""
    bits = min(MOST_BITS, max(LEAST_BITS, (BITS_A_WORD * max(n, 1) - 1).bit_length()))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, out = batch.column(0).to_pylist(), []
            for same in _by_length(found):
                for at in range(0, len(same), step := max(1, CANDIDATES // (len(found[same[0]]) + 1))):
                    hashes = _prefix_hashes(_codes([found[k] for k in same[at : at + step]]))[:, -1]
                    out += [_places(hashes, mix, bits) for mix in _MIXES]
            at = np.unique(np.concatenate(out)) if out else np.zeros(0, np.uint64)
            yield pa.record_batch([pa.array((at // _BLOCK).astype(np.int32)), pa.array((at % _BLOCK).astype(np.int32))], ["block", "at"])

    def block(key: tuple[pa.Scalar, ...], rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(_BLOCK, np.uint8)
        for batch in rows:
            own[batch.column(1).to_numpy()] = 1
        yield pa.record_batch([pa.array([key[0].as_py()], pa.int32()), pa.array([np.packbits(own, bitorder="little").tobytes()], pa.binary())], ["block", "bits"])

    spots = words.select(F.col(word).alias("word")).mapInArrow(places, "block int, at int")
    table = np.zeros(1 << bits - 3, np.uint8)
    for row in spots.groupBy("block").applyInArrow(block, "block int, bits binary").toLocalIterator():
        table[row["block"] * (_BLOCK // 8) : (row["block"] + 1) * (_BLOCK // 8)] = np.frombuffer(row["bits"], np.uint8)
    return table, bits


def neighbours(words: list[str], alphabet: str, passes: Callable[[np.ndarray], np.ndarray]) -> Iterator[tuple[int, str]]:
    """(index of a word, neighbour) of every string that one edit over the alphabet makes of a word and whose hash
    passes. passes takes hashes and gives the positions of those to build. No neighbour comes twice."""
    letters = _codes(list(alphabet))[:, 0] if alphabet else np.zeros(0, np.uint64)
    chars = list(alphabet)
    for same in _by_length(words):
        size = len(words[same[0]])
        powers = _powers(size + 1)
        rows = max(1, CANDIDATES // ((size + 1) * (letters.size + 1)))
        for first in range(0, len(same), rows):
            own = same[first : first + rows]
            codes = _codes([words[k] for k in own])
            before, after = _prefix_hashes(codes), _suffix_hashes(codes, powers)
            span = max(1, CANDIDATES // (len(own) * (letters.size + 1)))
            for lo in range(0, size + 1, span):
                at = np.arange(lo, min(lo + span, size + 1))
                in_word = at[at < size]
                if in_word.size:
                    rest = powers[size - 1 - in_word]
                    cut = before[:, in_word] * rest + after[:, in_word + 1]
                    repeated = np.zeros(cut.shape, bool)
                    inner = in_word > 0
                    repeated[:, inner] = codes[:, in_word[inner]] == codes[:, in_word[inner] - 1]
                    yield from _built(words, own, in_word, cut, ~repeated, None, passes)
                    # cut lacks the letter's place: a prefix moves up by one, the letter comes in between.
                    put = (before[:, in_word] * powers[size - in_word] + after[:, in_word + 1])[:, :, None] + letters * rest[:, None]
                    yield from _built(words, own, in_word, put, codes[:, in_word, None] != letters, (chars, 1), passes)
                put = (before[:, at] * powers[size + 1 - at] + after[:, at])[:, :, None] + letters * powers[size - at][:, None]
                new = np.ones(put.shape, bool)
                inner = at > 0
                new[:, inner] = codes[:, at[inner] - 1, None] != letters
                yield from _built(words, own, at, put, new, (chars, 0), passes)


def _built(words, own, at, hashes, wanted, put, passes) -> Iterator[tuple[int, str]]:
    """The strings of the wanted hashes that pass. put is None for deletions, else the letters and how many letters of
    the word each takes the place of."""
    wanted = np.flatnonzero(wanted)
    kept = wanted[passes(hashes.reshape(-1)[wanted])]
    for where in zip(*(x.tolist() for x in np.unravel_index(kept, hashes.shape))):
        word, k = words[own[where[0]]], int(at[where[1]])
        yield own[where[0]], word[:k] + word[k + 1 :] if put is None else word[:k] + put[0][where[2]] + word[k + put[1] :]


def near_words(vocabulary: DataFrame) -> DataFrame:
    """(word, n, near, near_n): each pair of words that one edit makes of each other, from both sides. vocabulary is a
    stored table of distinct words (word, n)."""
    spark = vocabulary.sparkSession
    letters = vocabulary.select(F.explode(F.split("word", "")).alias("letter")).where("letter != ''").distinct()
    alphabet = "".join(sorted(row["letter"] for row in letters.toLocalIterator()))
    table, bits = bit_table(vocabulary, vocabulary.count())
    shared = spark.sparkContext.broadcast((table, bits, alphabet))

    def generate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_table, own_bits, own_alphabet = shared.value
        passes = lambda hashes: _in_table(hashes, own_table, own_bits)
        for batch in batches:
            words, out, chars = batch.column(0).to_pylist(), [], 0
            ns = batch.column(1).to_pylist()

            def rows() -> pa.RecordBatch:
                at = [k for k, _ in out]
                columns = [pa.array([words[k] for k in at], pa.string()), pa.array([ns[k] for k in at], pa.int64()), pa.array([x for _, x in out], pa.string())]
                return pa.record_batch(columns, ["word", "n", "near"])

            for found in neighbours(words, own_alphabet, passes):
                out.append(found)
                chars += 2 * len(found[1])
                if chars > CANDIDATES:
                    yield rows()
                    out, chars = [], 0
            yield rows()

    candidates = vocabulary.select("word", "n").mapInArrow(generate, "word string, n long, near string")
    return candidates.join(vocabulary.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near").select("word", "n", "near", "near_n")


def with_forms(vocabulary: DataFrame, times: int = 5) -> DataFrame:
    """(word, n, n_near, form, form_n): form is the near word of largest n (the first of equal ones), if that is at
    least so many times the word's n."""
    alone = vocabulary.select("word", "n", F.lit(None).cast("string").alias("near"), F.lit(None).cast("long").alias("near_n"))
    both = alone.unionByName(near_words(vocabulary))
    best = F.min(F.when(F.col("near").isNotNull(), F.struct((-F.col("near_n")).alias("less"), "near")))
    found = both.groupBy("word", "n").agg(F.count("near").alias("n_near"), best.alias("best"))
    taken = -F.col("best.less") >= times * F.col("n")
    return found.select("word", "n", "n_near", F.when(taken, F.col("best.near")).alias("form"), F.when(taken, -F.col("best.less")).alias("form_n"))


def with_roots(forms: DataFrame) -> DataFrame:
    """forms, a stored table, with root: the last word that forms lead to, the word itself if it has none.

    A form's n is larger, so chains end; each pass halves them, by joining the words still on their way with where their
    form leads."""
    now = scratch.stored(forms.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "roots")
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = scratch.stored(now.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        now = after.select("word", "root")
        if after.where("moved").isEmpty():
            break
    return forms.join(now, "word", "left").withColumn("root", F.coalesce("root", "word"))


def variants(vocabulary: DataFrame, times: int = 5) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each word of a vocabulary (word, n), whose words are distinct. Rows of
    null word or n take no part."""
    own = scratch.stored(vocabulary.where("word IS NOT NULL AND n IS NOT NULL").select("word", F.col("n").cast("long").alias("n")), "vocabulary")
    rooted = with_roots(scratch.stored(with_forms(own, times), "forms"))
    return rooted.select("word", "form", "root", "n", "n_near", "form_n")
