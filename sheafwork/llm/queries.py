"""The queries of the training-data operators: thin, over whole tables, digests derived from the operators' results."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from sheafwork.llm import decontam, filter_audit, html_extract, language_id, license_scan, near_dup, personal_data, piece_codec, secret_scan, spelling, token_counts, topk, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def _joined(spans: Column) -> Column:
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


@_query
def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "secret_spans")
    spans = F.col("secret_spans")

    def count(kind: str) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter(spans, lambda s: s["kind"].isin(*secret_scan.BASE_KINDS))
    return found.select(
        "doc_id",
        *(count(kind) for kind in secret_scan.BASE_KINDS),
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(spans).alias("spans"),
    )


@_query
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    file = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return token_counts.with_tail_sums(token_counts.length_histogram(docs, file, public_tokenizers.PATTERN))


@_query
def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    texts = docs.select("doc_id", piece_codec.round_trip(F.col("text"), model).alias("x"))
    return texts.select(
        "doc_id",
        piece_codec.n_ids(F.col("x.ids")).alias("n_tokens"),
        F.sha2("x.ids", 256).alias("ids_sha256"),
        F.sha2("x.decoded", 256).alias("decoded_sha256"),
    )


def held_out(doc_id: Column) -> Column:
    """The fold that nothing is learned from."""
    return F.crc32(doc_id.cast("string")) % 5 == 0


@_query
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    profiles = language_id.collect_profiles(language_id.learn(docs.where(~held_out(F.col("doc_id")))))
    predicted = language_id.identify(docs.select("doc_id", "text"), profiles)
    return predicted.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")


@_query
def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = html_extract.extract_pages(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


@_query
def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    archive = warc.write(pages)
    captures = warc.lookup(archive, pages, "url", "page_id")
    return warc.resolved(warc.records_at(archive, captures)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE["op5_warc"] = """
WITH p AS (
    SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS hex,
           min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first_id
    FROM pages
)
SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes,
       list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 +
           ((CAST('0x' || substr(hex, CAST(1 + 5 * (i // 4) AS INTEGER), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31) AS INTEGER), 1)),
           'string_agg', '') AS payload_digest,
       CASE WHEN first_id < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first_id < page_id THEN first_id END AS refers_to
FROM p
"""


@_query
def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(_table(spark, sf_dir, "documents"), words=3, percent=85)


ORACLE["op10_minhash"] = r"""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
    FROM documents
), s AS (
    SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 2), ' ') AS shingle
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM w WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS root FROM w UNION SELECT e.b, r.root FROM reach r JOIN edges e ON e.a = r.doc_id)
SELECT w.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(root) AS component_id, w.doc_id = min(root) AS kept
FROM w JOIN reach USING (doc_id) LEFT JOIN n USING (doc_id) GROUP BY w.doc_id
"""


@_query
def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = decontam.judged(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    items = F.array_sort("item_ids")
    return judged.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        "contaminated",
    )


ORACLE["op2_decontamination"] = r"""
WITH w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                       '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL
), windows AS (
    SELECT DISTINCT item_id, array_to_string(list_slice(w, i, i + 12), ' ') AS phrase, least(len(w), 13) AS size
    FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT size FROM windows),
places AS (
    SELECT doc_id, i, size, array_to_string(list_slice(w, i, i + size - 1), ' ') AS phrase
    FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM w, sizes WHERE len(w) >= size)
), hits AS (SELECT doc_id, i, p.size, item_id FROM places p JOIN windows USING (phrase, size)),
covered AS (SELECT doc_id, count(DISTINCT spot) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS spot FROM hits) GROUP BY doc_id),
found AS (
    SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items
    FROM hits GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM w LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
"""


@_query
def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    finite = ~F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    vectors = raw.where(F.col("x").isNotNull() & finite).select("vec_id", F.transform("x", lambda v: F.floor(64 * v)).alias("vector"))
    return topk.top_k(vectors, vectors.where("vec_id % 20 = 0"), 20)


ORACLE["op1_topk_search"] = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id AND len(c.e) = len(q.e)
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 20
"""


@_query
def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(_table(spark, sf_dir, "documents"))
    return found.withColumn("dice", F.round("dice", 6))


@_query
def op6_license_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan_windows(_table(spark, sf_dir, "documents"))
    return found.withColumn("dice", F.round("dice", 6))


def _licence_sql() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    rows = ", ".join(f"({k}, {quoted(name)}, {quoted(text)})" for k, (name, text) in enumerate(license_scan.TEMPLATES))
    words = r"list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
    pairs = "unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS bigram"
    blank = r"(?:\r\n?|\n)[ \t]*(?:\r\n?|\n)\s*"
    parts = lambda kind, pattern: (
        f"SELECT doc_id, '{kind}', unnest(range(len(l))), unnest(l) FROM (SELECT doc_id, string_split_regex(text, '{pattern}') AS l FROM documents) WHERE len(l) > 1"
    )
    return rf"""
    WITH t AS (SELECT template, licence, {words} AS w FROM (VALUES {rows}) v(template, licence, text)),
    tn AS (SELECT template, licence, size, bigram, count(*) AS n
           FROM (SELECT template, licence, len(w) - 1 AS size, {pairs} FROM t) GROUP BY ALL),
    u AS (SELECT doc_id, 'text' AS kind, 0 AS place, text FROM documents
          UNION ALL {parts("paragraph", blank)} UNION ALL {parts("line", r"\r?\n|\r")}),
    uw AS (SELECT doc_id, kind, place, {words} AS w FROM u),
    un AS (SELECT doc_id, kind, place, unit_size, bigram, count(*) AS times
           FROM (SELECT doc_id, kind, place, len(w) - 1 AS unit_size, {pairs} FROM uw WHERE len(w) > 1) GROUP BY ALL),
    s AS (SELECT doc_id, kind, place, template, licence, unit_size, size AS template_size, sum(least(times, n)) AS shared
          FROM un JOIN tn USING (bigram) GROUP BY ALL),
    d AS (SELECT *, 2.0 * shared / (unit_size + template_size) AS dice FROM s)
    SELECT doc_id, kind, CAST(place AS INTEGER) AS place, licence, CAST(shared AS BIGINT) AS shared, CAST(unit_size AS INTEGER) AS unit_size,
           CAST(template_size AS INTEGER) AS template_size, round(CAST(dice AS DOUBLE), 6) AS dice
    FROM d WHERE dice >= {license_scan.THRESHOLD}
    QUALIFY row_number() OVER (PARTITION BY doc_id, kind, place ORDER BY dice DESC, template) = 1
    """


ORACLE["op6_license_scan"] = _licence_sql()

@_query
def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data.scan(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "personal_spans")
    spans = F.col("personal_spans")
    base = F.filter(spans, lambda s: s["base"])

    def count(kind: str) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *(count(kind) for kind in personal_data.BASE_KINDS),
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(spans).alias("spans"),
    )


@_query
def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n_words = F.size(words)
    tests = {
        "A": n_words < 100,
        "B": 100 * F.size(F.array_distinct(words)) < 80 * n_words,
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 10 * F.char_length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }
    marks = {"good": F.col("quality") == 1, "toxic": F.col("toxic") == 1}
    return filter_audit.audit(_table(spark, sf_dir, "documents"), tests, "E", _table(spark, sf_dir, "labels"), marks)


ORACLE["op12_filter_audit"] = r"""
WITH RECURSIVE w AS (
    SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
           min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first_id
    FROM documents
), l AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
f AS (
    SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
           [len(w) < 100, 100 * len(list_distinct(w)) < 80 * len(w),
            100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text),
            regexp_matches(text, '[#$%&*|]'), coalesce(first_id < doc_id, false)] AS fails
    FROM w LEFT JOIN l USING (doc_id)
), c AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY part, fails),
o AS (
    SELECT '' AS filter_order UNION ALL
    SELECT filter_order || x FROM o, unnest(['A', 'B', 'C', 'D', 'E']) t(x) WHERE NOT contains(filter_order, x)
), s AS (
    SELECT filter_order, step, instr('ABCDE', filter_order[step]) AS k, list_transform(range(1, step), lambda i: instr('ABCDE', filter_order[i])) AS earlier
    FROM o, unnest(range(1, 6)) t(step) WHERE length(filter_order) = 5
), g AS (
    SELECT part, filter_order, step, k, n, good, toxic, fails[k] AS fails_it,
           len(list_filter(earlier, lambda i: fails[i])) > 0 AS gone, len(list_filter(fails, lambda x: x)) AS n_fails
    FROM c, s
), r AS (
    SELECT part, filter_order, CAST(step AS INTEGER) AS step, k,
           CAST(coalesce(sum(n) FILTER (NOT gone AND NOT fails_it), 0) AS BIGINT) AS kept,
           CAST(coalesce(sum(n) FILTER (NOT gone AND fails_it), 0) AS BIGINT) AS removed,
           CAST(coalesce(sum(n) FILTER (gone AND fails_it), 0) AS BIGINT) AS redundant,
           CAST(coalesce(sum(n) FILTER (fails_it AND n_fails = 1), 0) AS BIGINT) AS unique_fails,
           CAST(coalesce(sum(good) FILTER (NOT gone AND fails_it), 0) AS BIGINT) AS good_lost,
           CAST(coalesce(sum(toxic) FILTER (NOT gone AND fails_it), 0) AS BIGINT) AS toxic_lost
    FROM g GROUP BY part, filter_order, step, k
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, k) AS BIGINT) AS shapley
FROM r
"""

def _misspelt(doc_id: object, run: str) -> str:
    """The contract's planted misspelling: one run in 199 loses a letter. A null doc_id counts as empty."""
    code = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    at = code % len(run)
    return run if code % 199 else run[:at] + run[at + 1 :]


@_query
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return spelling.variants(spelling.word_counts(docs, "[A-Za-z\u00C0-\u00FF]+", _misspelt, least_length=6, least_count=5), times=5)


ORACLE["op13_spelling_variants"] = r"""
WITH RECURSIVE crc AS (
    SELECT list(list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b) ORDER BY b) AS t FROM range(256) r(b)
), runs AS (
    SELECT doc_id, run, count(*) AS times FROM (
        SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run
        FROM documents
    ) GROUP BY doc_id, run
), hexed AS (SELECT run, times, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS x FROM runs),
coded AS (
    SELECT run, times, xor(list_reduce(list_transform(range(1, length(x), 2), lambda i: CAST('0x' || x[i:i + 1] AS BIGINT)),
        lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]), 4294967295), 4294967295) AS h
    FROM hexed, crc
), spelt AS (
    SELECT CASE WHEN h % 199 = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, times FROM coded
), v AS (SELECT word, CAST(sum(times) AS BIGINT) AS n FROM spelt WHERE length(word) >= 6 GROUP BY word HAVING sum(times) >= 5),
cuts AS (SELECT DISTINCT word, i, word[:i - 1] || word[i + 1:] AS cut, length(word) AS size FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM v)),
pairs AS (
    SELECT a.word AS word, b.word AS near FROM cuts a JOIN cuts b ON a.cut = b.cut AND a.i = b.i AND a.word <> b.word
    UNION SELECT a.cut, a.word FROM cuts a JOIN v ON v.word = a.cut
    UNION SELECT a.word, a.cut FROM cuts a JOIN v ON v.word = a.cut
), near AS (
    SELECT p.word, count(*) AS n_near, first(b.word ORDER BY b.n DESC, encode(b.word)) AS near, max(b.n) AS near_n
    FROM pairs p JOIN v b ON b.word = p.near GROUP BY p.word
), f AS (
    SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * v.n THEN near END AS form, CASE WHEN near_n >= 5 * v.n THEN near_n END AS form_n
    FROM v LEFT JOIN near USING (word)
), chain AS (
    SELECT word, word AS root, form AS ahead FROM f
    UNION ALL SELECT c.word, f.word, f.form FROM chain c JOIN f ON f.word = c.ahead
)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n FROM f JOIN chain c ON c.word = f.word AND c.ahead IS NULL
"""

QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL is not None:
    ORACLE["pipeline"] = corpus_pipeline.ORACLE_SQL
