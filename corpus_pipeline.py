"""The corpus pipeline: language ID, near-dedup, decontamination, secret redaction, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns that they were given, and work on every row that their predecessor
kept; the last returns each document's token ids.

Nulls: a null text has no language and goes in the first stage; a null label teaches nothing; rows with a null doc_id
stay unless a stage's own test rejects them. Repeated rows become one in the second stage, unless their doc_id is null.
Texts are read whole, whatever their length. Of languages at equal distance the first by name counts, of near
duplicates the least doc_id stays. An empty table passes through every stage as an empty one. Other columns, of any
name, are kept as they are.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheafwork.llm import decontam, language_id, near_dup, piece_codec, scratch, secret_scan
from sheafwork.llm.columns import unused

#: Languages that the first stage keeps; None stands for every one that labels name.
LANGUAGES: tuple[str, ...] | None = None
#: Score of the rank-order distance (0 to 1) up to which a text is in none of them.
LEAST_SCORE = 0.0

#: Word shingles and similarity (in percent) of the near-duplicate stage.
SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents identified as one of the wanted languages. Rows are in two folds by their doc_id, and each fold is
    predicted by profiles learned from the other one's labels, so that no row is judged by its own label. What has no
    letter goes, and so does what shares no n-gram with the nearest profile (a script of no known language). Where
    nothing could be learned, texts with a letter stay."""
    fold, label, lang, score = (unused(docs, x) for x in ("fold", "label", "lang_pred", "lang_score"))
    folded = docs.withColumn(fold, F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 2, F.lit(0)).cast("int"))
    labelled = folded.withColumn(label, F.when(F.col("lang").isNotNull(), F.concat_ws(":", fold, "lang")))
    rows = scratch.stored(language_id.learn(labelled, "text", label), "fold-profiles")
    out = []
    for k in (0, 1):
        own = rows.where(F.col("label").startswith(f"{1 - k}:")).withColumn("label", F.substring("label", 3, 1 << 30))
        profiles = language_id.collect_profiles(own)
        part = folded.where(F.col(fold) == k)
        if own.isEmpty():
            out.append(part.where(F.col("text").rlike(r"\p{L}")))
            continue
        found = language_id.identify(part, profiles, "text", lang, score)
        wanted = F.lit(True) if LANGUAGES is None else F.col(lang).isin(*LANGUAGES)
        out.append(found.where((F.col(lang) != language_id.UNKNOWN) & (F.col(score) > LEAST_SCORE) & wanted))
    return out[0].select(*(F.col(f"`{c}`") for c in docs.columns)).unionByName(out[1].select(*(F.col(f"`{c}`") for c in docs.columns)))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least doc_id, of each group of near duplicates."""
    return near_dup.deduplicated(docs, SHINGLE_WORDS, SIMILAR_PERCENT)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words are in benchmark passages."""
    return decontam.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its secrets replaced by a mark and n_chars by the length of the new text where it has changed."""
    text = unused(docs, "redacted")
    clean = docs.withColumn(text, secret_scan.redacted(F.col("text")))
    new = {"text": F.col(text)}
    if "n_chars" in docs.columns:
        length = F.char_length(text).cast(docs.schema["n_chars"].dataType)
        new["n_chars"] = F.when(F.col("text").eqNullSafe(F.col(text)), F.col("n_chars")).otherwise(length)
    return clean.select(*(new.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids): the token ids of each text with begin and end, as little-endian unsigned 32-bit integers."""
    ids = piece_codec.encode_ids(F.col("text"), public_tokenizers.path("piece_bpe_32k.model"))
    return docs.select("doc_id", ids.alias("ids")).select("doc_id", piece_codec.n_ids(F.col("ids")).alias("n_tokens"), "ids")


STAGES = [
    ("language_id", keep_identified),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secret_scan", redact_secrets),
    ("encoding", encode),
]

#: SQL can express neither the rank-order profiles nor the encoding; the pipeline is tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over the documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.stored(stage(spark, docs, sf_dir), name)
    return docs
