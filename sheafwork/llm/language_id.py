"""Language identification by rank-order profiles.

A language's profile is the list of its most frequent letter n-grams (orders 1 to 3; words are parted by one space,
case is folded, everything but letters counts as space), counted over all labelled documents. A document's own most
frequent n-grams are ranked likewise, over its whole text, and the language with the least out-of-place distance wins:
the sum, over the document's n-grams, of the difference of the two ranks, or of the profile's size where the profile
lacks the n-gram. Ties of counts go to the smaller n-gram, ties of distances to the smaller language name.

score is 1 minus the winning distance over the largest possible one. A text that is null or has no letter is "und" with
score 0, as is every text if nothing was learned. Rows whose label is null teach nothing, nor do texts without letters.
Repeated rows count each. Texts are counted whole, whatever their length, in pieces of bounded size. An empty table
teaches nothing, or gives no rows. Other columns pass through untouched, one of an output's name is replaced.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheafwork.llm import scratch
from sheafwork.llm.batches import parts
from sheafwork.llm.columns import unused

UNKNOWN = "und"
#: N-grams in a profile and n-grams of a document that are compared.
PROFILE_SIZE = 400
DOCUMENT_SIZE = 300
#: Languages whose profiles go to every executor; more are joined as a table.
MAX_LANGUAGES = 2000
_SPACE = 32
_BREAK = 0x110000
_BITS = 21  # of a code point; three fit into a long
_PIECE = 1 << 20


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point, its lower case if it is a letter, else a space."""
    table = np.full(0x110000, _SPACE, np.uint32)
    for code in range(0x110000):
        char = chr(code)
        if char.isalpha():
            low = char.lower()
            table[code] = ord(low) if len(low) == 1 else code
    return table


def letter_codes(text: str | None) -> np.ndarray:
    """Lower-case letters with one space before, between and after words; empty if there is no letter."""
    if not text:
        return np.empty(0, np.int64)
    codes = _letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    codes = np.concatenate(([_SPACE], codes, [_SPACE])).astype(np.int64)
    codes = codes[np.concatenate(([True], (codes[1:] != _SPACE) | (codes[:-1] != _SPACE)))]
    return codes if len(codes) > 1 else codes[:0]


def _packed(codes: np.ndarray, order: int) -> np.ndarray:
    grams = codes[: len(codes) - order + 1]
    for k in range(1, order):
        grams = grams << _BITS | codes[k : len(codes) - order + 1 + k]
    return grams


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if len(parts) == 1:
        return parts[0]
    grams, where = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
    counts = np.zeros(len(grams), np.int64)
    np.add.at(counts, where, np.concatenate([c for _, c in parts]))
    return grams, counts


def _counts_of_piece(codes: np.ndarray, starts: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Counts of the n-grams that begin in the first so many places."""
    dense, names = None, None
    if len(codes) > 50_000:
        present = np.flatnonzero(np.bincount(codes))
        if len(present) ** 3 <= 1 << 22:
            place = np.zeros(present[-1] + 1, np.int64)
            place[present] = np.arange(len(present))
            dense, names = place[codes], present
    for order in (1, 2, 3):
        part = codes[: starts + order - 1]
        if len(part) < order:
            continue
        if dense is None:
            grams, counts = np.unique(_packed(part, order), return_counts=True)
        else:
            n, ids = len(names), dense[: len(part) - order + 1]
            for k in range(1, order):
                ids = ids * n + dense[k : len(part) - order + 1 + k]
            counts = np.bincount(ids, minlength=n**order)
            ids = np.flatnonzero(counts)
            grams, counts = np.zeros(len(ids), np.int64), counts[ids]
            for k in range(order):
                grams |= names[ids // n**k % n] << (_BITS * k)
        if order == 1:
            kept = grams != _SPACE
            grams, counts = grams[kept], counts[kept]
        yield grams, counts


def gram_counts(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of all orders (orders don't clash: none begins with code 0) and how often each occurs."""
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    for at in range(0, len(codes), _PIECE):
        parts += _counts_of_piece(codes[at : at + _PIECE + 2], min(_PIECE, len(codes) - at))
    return _merged(parts) if parts else (np.empty(0, np.int64), np.empty(0, np.int64))


def top_grams(codes: np.ndarray, size: int) -> np.ndarray:
    """The most frequent n-grams, most frequent first, ties to the smaller one."""
    grams, counts = gram_counts(codes)
    return grams[np.lexsort((grams, -counts))[:size]]


def _count_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    waiting: dict[str, list[np.ndarray]] = defaultdict(list)
    size: dict[str, int] = defaultdict(int)
    found: dict[str, list[tuple[np.ndarray, np.ndarray]]] = defaultdict(list)
    held = 0

    def count(lang: str) -> None:
        nonlocal held
        # Texts are parted by a code that no text has, and the n-grams that hold it are dropped.
        grams, counts = gram_counts(np.concatenate([x for text in waiting.pop(lang) for x in (text, [_BREAK])]))
        mask = (1 << _BITS) - 1
        inner = (grams & mask != _BREAK) & (grams >> _BITS & mask != _BREAK) & (grams >> 2 * _BITS != _BREAK)
        found[lang].append((grams[inner], counts[inner]))
        held += len(found[lang][-1][0])
        size[lang] = 0

    def out() -> Iterator[pa.RecordBatch]:
        nonlocal held
        for lang in list(found):
            grams, counts = _merged(found.pop(lang))
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(grams), pa.string()), pa.array(grams, pa.int64()), pa.array(counts, pa.int64())],
                ["label", "gram", "n"],
            )
        held = 0

    for batch in batches:
        for text, lang in zip(batch.column(0), batch.column(1)):
            codes = letter_codes(text.as_py())
            if len(codes):
                lang = lang.as_py()
                waiting[lang].append(codes)
                size[lang] += len(codes)
                if size[lang] > _PIECE:
                    count(lang)
        if held > 2_000_000:
            yield from out()
    for lang in list(waiting):
        count(lang)
    yield from out()


def learn(labelled: DataFrame, text: str = "text", label: str = "lang", size: int = PROFILE_SIZE) -> DataFrame:
    """(label, gram, rank): each language's most frequent n-grams over all its texts, rank from 0."""
    rows = labelled.where(F.col(label).isNotNull()).select(F.col(text).alias("text"), F.col(label).cast("string").alias("label"))
    counts = rows.mapInArrow(_count_partition, "label string, gram long, n long").groupBy("label", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("label").orderBy(F.desc("n"), "gram")
    # The bound is on the place itself, so that each task keeps only its first ones before they are shuffled.
    ranked = counts.withColumn("place", F.row_number().over(order)).where(F.col("place") <= size)
    return ranked.select("label", "gram", (F.col("place") - 1).alias("rank"))


class Profiles:
    """Profiles of all languages as one table: for each known n-gram, its rank in each language."""

    def __init__(self, rows: list[tuple[str, int, int]], size: int = PROFILE_SIZE) -> None:
        self.size = size
        self.labels = sorted({label for label, _, _ in rows})
        self.grams = np.array(sorted({gram for _, gram, _ in rows}), np.int64)
        self.ranks = np.full((len(self.labels), len(self.grams) + 1), -1, np.int32)
        row = {label: k for k, label in enumerate(self.labels)}
        for label, gram, rank in rows:
            self.ranks[row[label], np.searchsorted(self.grams, gram)] = rank

    def predict(self, text: str | None, document_size: int = DOCUMENT_SIZE) -> tuple[str, float]:
        own = top_grams(letter_codes(text), document_size)
        if not len(own) or not self.labels:
            return UNKNOWN, 0.0
        at = np.minimum(np.searchsorted(self.grams, own), len(self.grams) - 1)
        at[self.grams[at] != own] = len(self.grams)
        ranks = self.ranks[:, at]
        places = np.minimum(np.abs(ranks - np.arange(len(own), dtype=np.int32)), self.size)
        places[ranks < 0] = self.size
        distances = places.sum(axis=1)
        best = int(distances.argmin())
        return self.labels[best], 1.0 - float(distances[best]) / (self.size * len(own))


@dataclass(frozen=True)
class ProfileTable:
    """Profiles of more languages than go to every executor, as a table (label, gram, rank)."""

    rows: DataFrame
    size: int = PROFILE_SIZE


def collect_profiles(profiles: DataFrame, size: int = PROFILE_SIZE) -> Profiles | ProfileTable:
    """Profiles on the driver if there are at most MAX_LANGUAGES; else they stay a table."""
    profiles = scratch.stored(profiles, "profiles")
    if profiles.select("label").distinct().count() > MAX_LANGUAGES:
        return ProfileTable(profiles, size)
    return Profiles([tuple(r) for r in profiles.collect()], size)


def predicted(text: Column, profiles: Profiles) -> Column:
    """struct<lang, score> of a text."""

    @F.arrow_udf("lang string, score double")
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in parts(texts):
            langs, scores = zip(*(profiles.predict(x.as_py()) for x in batch)) if len(batch) else ((), ())
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["lang", "score"])

    return run(text)


def _by_table(docs: DataFrame, profiles: ProfileTable, text: str, name: str) -> DataFrame:
    """docs with the same struct as column name, by a join with the profiles' table on n-grams: a row's n-grams are
    bounded, its distances are summed by row and language."""

    @F.arrow_udf("array<bigint>")
    def top(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in parts(texts):
            yield pa.array([top_grams(letter_codes(x.as_py()), DOCUMENT_SIZE) for x in batch], pa.list_(pa.int64()))

    row = unused(docs, "row")
    docs = scratch.stored(docs.withColumn(row, F.monotonically_increasing_id()), "rows-to-identify")
    grams = docs.select(F.col(row).alias("row"), top(F.col(text)).alias("grams")).where(F.size("grams") > 0)
    own = grams.select("row", F.size("grams").alias("n"), F.posexplode("grams").alias("at", "gram"))
    saved = profiles.size - F.least(F.abs(F.col("rank") - F.col("at")), F.lit(profiles.size))
    salt = lambda x: F.pmod(x, F.lit(64)).cast("int")  # noqa: E731  frequent n-grams are in most rows
    known = profiles.rows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(63))))
    met = own.withColumn("salt", salt(F.xxhash64("row"))).join(known, ["gram", "salt"])
    sums = met.groupBy("row", "n", "label").agg(F.sum(saved).alias("saved"))
    first = profiles.rows.agg(F.min("label").alias("first"))  # wins where no profile has any of the n-grams
    best = sums.groupBy("row", "n").agg(F.min(F.struct((-F.col("saved")).alias("order"), "label")).alias("b"))
    found = grams.select("row", F.size("grams").alias("n")).join(best.drop("n"), "row", "left").crossJoin(F.broadcast(first))
    score = F.coalesce(-F.col("b.order"), F.lit(0)) / (profiles.size * F.col("n"))
    label = F.when(F.coalesce(F.col("b.order"), F.lit(0)) < 0, F.col("b.label")).otherwise(F.col("first"))
    found = found.select(F.col("row").alias(row), F.struct(label.alias("lang"), score.alias("score")).alias(name))
    none = F.struct(F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("score"))
    return docs.join(found, row, "left").drop(row).withColumn(name, F.coalesce(name, none))


def identify(docs: DataFrame, profiles: Profiles | ProfileTable, text: str = "text", lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """docs with the predicted language and its score."""
    kept = [c for c in docs.columns if c.lower() not in (lang.lower(), score.lower())]
    name = unused(docs, "predicted")
    if isinstance(profiles, ProfileTable):
        out = _by_table(docs, profiles, text, name)
    else:
        out = docs.withColumn(name, predicted(F.col(f"`{text}`"), profiles))
    return out.select(*(F.col(f"`{c}`") for c in kept), F.col(f"{name}.lang").alias(lang), F.col(f"{name}.score").alias(score))
