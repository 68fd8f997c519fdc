"""Benchmark decontamination with a positional inverted index, in DataFrame functions only.

The index holds a posting (term, document, position) for each training token that is a benchmark term, and each
document's length. A phrase's terms are ordered by how often the index has them; the postings of its rarest term, less
the term's offset, are its candidate places, and the postings of the next rarest, less theirs, are intersected with
them. Places that are left are confirmed against the document's own words, so matches are exact. Proximity matches are
found from the same postings.

Words: A-Z are lower-cased, a word is a run of characters that are neither ASCII punctuation, space nor control. An
item's phrases are its windows of so many consecutive words, or all its words if it has fewer. A document word in any
occurrence of a phrase is hit.

A null text has no words. Items without words or with a null item_id take no part; items that repeat count once. Rows
that repeat a doc_id are judged by their own text each, also where doc_id is null. Other columns aren't read and may
have any name. Texts are read whole, whatever their length; empty tables give no rows, or no hits. No result depends on
an order, so there are no ties. Tables that go to every executor are measured first, by rows and bytes; beyond the
bounds, keys that many rows share are dealt to several parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheafwork.llm import scratch
from sheafwork.llm.columns import unused

WINDOW = 13
#: Terms of a phrase, from the rarest, whose postings are intersected.
INTERSECTED = 3
#: Rows, and bytes of them written out, up to which a table goes to every executor.
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 64 << 20
#: Parts that a key's rows are dealt to where a table is beyond those bounds.
SALTS = 64
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Stands for a document's end: its posting is at the place past the last word. No word is empty.
_END = ""


def words(text: Column) -> Column:
    """array<string>: the words of a text, in order; empty for null."""
    # lower() also changes letters beyond A-Z, so it serves where there are none.
    low = F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, _UPPER, _LOWER)).otherwise(F.lower(text))
    return F.array_remove(F.split(F.coalesce(low, F.lit("")), _BETWEEN), "")


def is_small(df: DataFrame) -> bool:
    """Whether a table may go to every executor, by its rows and bytes."""
    rows, size = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0))).first()
    return rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES


def small(df: DataFrame) -> DataFrame:
    """df, marked for broadcast if it is small."""
    return F.broadcast(df) if is_small(df) else df


def by_key(many: DataFrame, few: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join on a key that a large share of many's rows may have in common. few goes to every executor if it is small;
    else each key's rows of many are dealt to SALTS parts and few is repeated for each."""
    if is_small(few):
        return many.join(F.broadcast(few), key, how)
    salt = F.pmod(F.xxhash64(*(F.col(c) for c in many.columns if c != key)), F.lit(SALTS)).cast("int")
    name = unused(many.join(few.limit(0), key), "salt") if how == "inner" else unused(many, "salt")
    repeated = few.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return many.withColumn(name, salt).join(repeated, [key, name], how).drop(name)


def keyed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, id, version, text): id and version tell rows of different doc_id or text apart, and are never null."""
    own = F.col(doc_id)
    return docs.select(
        own.alias("doc_id"),
        F.coalesce(own.cast("long"), F.lit(0)).alias("id"),
        F.xxhash64(F.col(text), own.isNull()).alias("version"),
        F.col(text).alias("text"),
    )


def phrases_of(items: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(phrase, length, terms) of each distinct phrase, and (phrase, item_id) of each item that has it."""
    rows = items.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("w"))
    rows = rows.where(F.col("item_id").isNotNull() & (F.size("w") > 0))
    starts = F.explode(F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1))))
    cut = rows.select("item_id", "w", starts.alias("at")).select("item_id", F.slice("w", F.col("at"), window).alias("terms"))
    cut = scratch.stored(cut.distinct(), "windows")
    phrases = cut.select("terms").distinct().select(
        F.monotonically_increasing_id().alias("phrase"), F.size("terms").alias("length"), "terms"
    )
    phrases = scratch.stored(phrases, "phrases")
    return phrases, scratch.stored(cut.join(phrases, "terms").select("phrase", "item_id"), "phrase-items")


def build_index(docs: DataFrame, vocabulary: DataFrame | None = None) -> DataFrame:
    """Postings (term, doc_id, id, version, pos) of docs as by keyed(), of the terms in vocabulary (term) or of all.
    Each row also has one of the empty term, at the place past its last word."""
    rows = docs.select("doc_id", "id", "version", F.posexplode(F.concat(words(F.col("text")), F.array(F.lit(_END)))).alias("pos", "term"))
    if vocabulary is not None:
        wanted = scratch.stored(vocabulary.select("term").union(vocabulary.sparkSession.createDataFrame([(_END,)], "term string")).distinct(), "vocabulary")
        rows = by_key(rows, wanted, "term", "left_semi")
    return scratch.stored(rows.select("term", "doc_id", "id", "version", "pos"), "postings")


def phrase_candidates(index: DataFrame, phrases: DataFrame) -> DataFrame:
    """(phrase, id, version, start): where the rarest terms of a phrase are at its offsets."""
    often = index.where(F.col("term") != _END).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    places = phrases.select("phrase", "length", F.posexplode("terms").alias("offset", "term"))
    ranked = by_key(places, scratch.stored(often, "frequencies"), "term").groupBy("phrase").agg(
        F.count(F.lit(1)).alias("found"), F.first("length").alias("length"), F.sort_array(F.collect_list(F.struct("n", "offset", "term"))).alias("order")
    )
    # A phrase has at most as many terms as the window is long; one that has a term the index lacks occurs nowhere.
    anchors = scratch.stored(ranked.where("found = length").select("phrase", F.slice("order", 1, INTERSECTED).alias("order")), "anchors")
    found = None
    for k in range(INTERSECTED):
        term = anchors.where(F.size("order") > k).select(
            "phrase", F.col("order")[k]["term"].alias("term"), F.col("order")[k]["offset"].alias("offset")
        )
        if found is None:
            hits = by_key(index, term, "term").select("phrase", "id", "version", (F.col("pos") - F.col("offset")).alias("start"))
            found = hits.where("start >= 0")
            continue
        there = by_key(index, term.select("term").distinct(), "term", "left_semi").select("term", "id", "version", F.col("pos").alias("at"))
        wanted = by_key(found, term, "phrase", "left").withColumn("at", F.col("start") + F.col("offset"))
        kept = wanted.where(F.col("term").isNotNull()).join(there.distinct(), ["term", "id", "version", "at"], "left_semi")
        found = kept.select("phrase", "id", "version", "start").unionByName(
            wanted.where(F.col("term").isNull()).select("phrase", "id", "version", "start")
        )
    return found.distinct()


def phrase_matches(docs: DataFrame, index: DataFrame, phrases: DataFrame) -> DataFrame:
    """(id, version, hits): of each document that has any, its phrases' occurrences, as array<struct<start, end,
    phrase>>, end exclusive, each once. docs as by keyed()."""
    found = by_key(phrase_candidates(index, phrases), phrases, "phrase")
    by_doc = found.groupBy("id", "version").agg(F.collect_list(F.struct("start", "length", "terms", "phrase")).alias("places"))
    by_doc = scratch.stored(by_doc, "candidates")
    narrow = docs.select("id", "version", "text")
    if by_doc.count() <= BROADCAST_ROWS:  # else the join below moves all texts
        narrow = narrow.join(F.broadcast(by_doc.select("id", "version")), ["id", "version"], "left_semi")
    own = narrow.dropDuplicates(["id", "version"]).select("id", "version", words(F.col("text")).alias("w"))
    exact = F.filter("places", lambda p: F.slice(F.col("w"), p["start"] + 1, p["length"]) == p["terms"])
    hits = F.transform(exact, lambda p: F.struct(p["start"].alias("start"), (p["start"] + p["length"]).alias("end"), p["phrase"].alias("phrase")))
    return by_doc.join(own, ["id", "version"]).select("id", "version", hits.alias("hits")).where(F.size("hits") > 0)


def covered(hits: Column) -> Column:
    """long: how many places the spans (start, end) of an array cover."""
    spans = F.array_sort(F.array_distinct(F.transform(hits, lambda h: F.struct(h["start"].alias("start"), h["end"].alias("end")))))
    zero = F.struct(F.lit(0).cast("long").alias("past"), F.lit(0).cast("long").alias("n"))

    def add(acc: Column, span: Column) -> Column:
        new = F.greatest(span["end"].cast("long") - F.greatest(span["start"].cast("long"), acc["past"]), F.lit(0).cast("long"))
        return F.struct(F.greatest(acc["past"], span["end"].cast("long")).alias("past"), (acc["n"] + new).alias("n"))

    return F.aggregate(spans, zero, add, lambda acc: acc["n"])


def judged(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """For each row of docs (doc_id, text): doc_id, id, version, n_words, n_hit, item_ids (sorted), contaminated
    (20 * n_hit >= n_words and any hit)."""
    rows = keyed(docs)
    phrases, phrase_items = phrases_of(items, window)
    index = build_index(rows, phrases.select(F.explode("terms").alias("term")))
    matches = scratch.stored(phrase_matches(rows, index, phrases), "matches")
    of_items = (
        by_key(matches.select("id", "version", F.explode(F.array_distinct("hits.phrase")).alias("phrase")), phrase_items, "phrase")
        .groupBy("id", "version")
        .agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"))
    )
    found = matches.select("id", "version", covered(F.col("hits")).alias("n_hit")).join(of_items, ["id", "version"])
    ends = index.where(F.col("term") == _END).select("doc_id", "id", "version", F.col("pos").cast("long").alias("n_words"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return ends.join(small(scratch.stored(found, "found")), ["id", "version"], "left").select(
        "doc_id",
        "id",
        "version",
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def without_contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs without the rows that are contaminated; all their columns stay."""
    bad = judged(docs.select("doc_id", "text"), items, window).where("contaminated")
    own, text = unused(docs, "_id"), unused(docs, "_version")
    bad = scratch.stored(bad.select(F.col("id").alias(own), F.col("version").alias(text)).distinct(), "contaminated")
    own_id = F.coalesce(docs["doc_id"].cast("long"), F.lit(0))
    same = (own_id == F.col(own)) & (F.xxhash64(docs["text"], docs["doc_id"].isNull()) == F.col(text))
    return docs.join(small(bad), same, "left_anti")


def proximity_matches(index: DataFrame, queries: DataFrame, span: int) -> DataFrame:
    """(query, id, version, start, end): the least stretches of at most span words, end exclusive, in which every term
    of a query (query, terms) occurs, in any order. Of stretches that end at one place, the shortest."""
    wanted = queries.select("query", F.array_distinct("terms").alias("terms"))
    wanted = wanted.select("query", F.size("terms").alias("size"), F.explode("terms").alias("term"))
    often = index.where(F.col("term") != _END).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    ranked = wanted.join(often, "term").groupBy("query").agg(
        F.count(F.lit(1)).alias("found"), F.first("size").alias("size"), F.min(F.struct("n", "term")).alias("rarest")
    )
    rarest = ranked.where("found = size").select("query", F.col("rarest.term").alias("term"))
    near = index.join(rarest, "term").select("query", "id", "version", F.col("pos").alias("anchor"))
    places = index.join(wanted, "term").select("query", "size", "term", "id", "version", "pos")
    close = places.join(near, ["query", "id", "version"]).where(F.abs(F.col("pos") - F.col("anchor")) < span)
    last = close.groupBy("query", "size", "id", "version", "anchor", "pos", "term").count().select("query", "size", "id", "version", "pos", "term").distinct()
    before = last.select("query", "id", "version", F.col("pos").alias("at"), F.col("term").alias("other"))
    joined = last.join(before, ["query", "id", "version"]).where((F.col("at") <= F.col("pos")) & (F.col("at") > F.col("pos") - span))
    nearest = joined.groupBy("query", "size", "id", "version", "pos", "other").agg(F.max("at").alias("at"))
    ends = nearest.groupBy("query", "size", "id", "version", "pos").agg(F.count(F.lit(1)).alias("found"), F.min("at").alias("start"))
    whole = ends.where("found = size").groupBy("query", "id", "version", "start").agg((F.min("pos") + 1).alias("end"))
    return whole
