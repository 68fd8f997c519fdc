"""Aligning differently named columns to one set of fields.

Names are few (a header's columns), so which column is which field is decided on the driver, once a header; the rows are
then projected by a small table of places, joined by file and sheet, in one plan for all sheets.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from itertools import groupby

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sheafwork.functions import names as n
from sheafwork.functions.cleaning import normalize_all
from sheafwork.operators import match
from sheafwork.operators.clean import PROVENANCE
from sheafwork.operators.headers import CELL, KEYS, is_blank, recovered


#: Fixed value: how sure a column at most is that lost its field to another.
LOST_CONFIDENCE = 0.4


@dataclass
class Mapping:
    """Of one header: each source column's field (or n.IGNORE, n.UNKNOWN), how sure that is and why."""

    targets: dict[str, str]
    confidence: dict[str, float] = field(default_factory=dict)
    reasons: dict[str, str] = field(default_factory=dict)
    source: str = "rule"

    @property
    def ignored(self) -> list[str]:
        return [c for c, t in self.targets.items() if t == n.IGNORE]

    def uncertain(self, least: float = 0.7) -> list[str]:
        return [c for c, t in self.targets.items() if t == n.UNKNOWN or t != n.IGNORE and self.confidence.get(c, 1.0) < least]


#: Decides a header's mapping: (columns, fields) to it. The rules below are the default. One that takes a third argument
#: also gets masked samples: {"columns": {name: values}, "fields": {name: values}}.
Matcher = Callable[..., Mapping]


def pick_fields(headers: list[list[str]], template: list[str] | None = None) -> list[str]:
    """The template's names, else those of the header with most names (then the shortest on average, then the first).
    Names that Spark can't tell apart, or from the provenance, are numbered (names.numbered)."""
    wanted = list(dict.fromkeys(x.strip() for x in template or [] if x.strip()))
    if wanted:
        return n.numbered(wanted, PROVENANCE)
    filled = [[x for x in n.numbered(header, PROVENANCE) if x.strip()] for header in headers]
    return max(filled, key=lambda h: (len(h), -sum(map(len, h)) / max(len(h), 1)), default=[])


def template_columns(rows: DataFrame) -> list[str]:
    """The names of a template: those of the first sheet of its grid (see operators.headers)."""
    sheets, _ = recovered(rows)
    first = sheets.orderBy("file", "sheet").select("names").first()
    return [x.strip() for x in first.names if x.strip()] if first else []


def field_samples(samples: DataFrame, fields: DataFrame) -> DataFrame:
    """(field, samples): of each field, those of the first sheet (by file, sheet and place) that has a column of just
    that name. samples: as by headers.column_samples, first_samples or counted_samples, which gives n too; fields
    (field): at most some hundred."""
    own = [c for c in samples.columns if c not in (*KEYS, "place", "name")]
    named = samples.join(F.broadcast(fields), F.col("name") == F.col("field"))
    return named.groupBy("field").agg(F.min_by(F.struct(*own), F.struct(*KEYS, "place")).alias("own")).select("field", "own.*")


def match_by_rules(columns: list[str], fields: list[str]) -> Mapping:
    """Equal names, then the only field that contains the name or is contained in it, then the only free group field for
    a group name, then the most alike one. A field is taken by one column, except that alike names don't take it."""
    known = match.known_fields(fields)
    targets = match.assigned([(c, match.is_ignorable(c), match.candidates_of(c, known)) for c in columns])
    return Mapping(dict(zip(columns, targets)), {c: match.RULE_CONFIDENCE for c in columns}, {c: "matched by rule" for c in columns})


def match_all_by_rules(spark: SparkSession, headers: list[tuple[str, ...]], fields: list[str]) -> dict[tuple[str, ...], Mapping]:
    """match_by_rules of many headers in one plan (match.match_headers)."""
    table = spark.createDataFrame([(h, k, c) for h, header in enumerate(headers) for k, c in enumerate(header)], "header int, pos int, source_col string")
    found: dict[int, dict[int, str]] = {}
    for row in match.match_headers(table, fields).collect():  # names only
        found.setdefault(row["header"], {})[row["pos"]] = row["target"]
    return {
        header: Mapping({c: found[h][k] for k, c in enumerate(header)}, {c: match.RULE_CONFIDENCE for c in header}, {c: "matched by rule" for c in header})
        for h, header in enumerate(headers)
    }


def ranked_claims(claims: DataFrame) -> DataFrame:
    """claims (header, pos, source_col, target, confidence) with place: among the columns of a header that claim one
    field, the surest is first, of equally sure ones the leftmost. IGNORE and UNKNOWN are no claims and have none."""
    order = Window.partitionBy("header", "target").orderBy(F.desc(F.coalesce("confidence", F.lit(0.0))), "pos")
    return claims.withColumn("place", F.when(~F.col("target").isin(n.IGNORE, n.UNKNOWN), F.row_number().over(order)))


def without_conflicts(claims: DataFrame) -> DataFrame:
    """claims with one column a field: what isn't first among a field's claims is unknown, and not sure."""
    lost = F.coalesce(F.col("place") > 1, F.lit(False))
    out = ranked_claims(claims)
    return out.select(
        "header", "pos", "source_col", F.when(lost, n.UNKNOWN).otherwise(F.col("target")).alias("target"),
        F.when(lost, F.least("confidence", F.lit(LOST_CONFIDENCE))).otherwise(F.col("confidence")).alias("confidence"),
    )


def resolve_conflicts(mapping: Mapping) -> Mapping:
    """The same for one header's mapping, with the reason told."""
    claims = sorted((t, -mapping.confidence.get(c, 0.0), k, c) for k, (c, t) in enumerate(mapping.targets.items()) if not t.startswith("__"))
    lost = {c: rivals[0][3] for _, group in groupby(claims, key=lambda x: x[0]) for rivals in [list(group)] for *_, c in rivals[1:]}
    return replace(
        mapping,
        targets=mapping.targets | {c: n.UNKNOWN for c in lost},
        confidence=mapping.confidence | {c: min(mapping.confidence.get(c, LOST_CONFIDENCE), LOST_CONFIDENCE) for c in lost},
        reasons=mapping.reasons | {c: f"{mapping.targets[c]} is taken from {winner}, which is surer" for c, winner in lost.items()},
    )


def confirmed(mapping: Mapping, choices: dict[str, str]) -> Mapping:
    """A mapping with the user's choices, which are certain."""
    sure = mapping.confidence | {c: 1.0 for c in choices}
    return Mapping(mapping.targets | choices, sure, mapping.reasons | {c: "confirmed by the user" for c in choices}, "user")


def unit_field(fields: list[str]) -> str | None:
    return next((f for f in fields if n.is_group_of(f)), None)


def projected(spark: SparkSession, rows: DataFrame, sheets: list[tuple[str, str, list[str], str]], fields: list[str], mappings: list[Mapping]) -> DataFrame:
    """(file, sheet, row_no, file_order, values): each row's cells in the order of fields, null where a sheet has no such
    column; each value has its text and that text's normal form (plain). sheets: (file, sheet, names, hint), in order. The first column of a field counts; an unmapped unit field is
    filled with the hint; rows without any value go."""
    group = unit_field(fields)
    table = []
    for order, ((file, sheet, header, hint), mapping) in enumerate(zip(sheets, mappings)):
        places: dict[str, int] = {}
        for k, name in enumerate(header):
            places.setdefault(mapping.targets.get(name, n.UNKNOWN), k)
        fill = hint if group and group not in places and hint else None
        table.append((file, sheet, order, [places.get(f, -1) for f in fields], fields.index(group) if fill else -1, fill))
    where = spark.createDataFrame(table, "file string, sheet string, file_order int, places array<int>, fill_at int, fill string")
    given = F.when(F.col("fill").isNotNull(), F.struct(F.lit("s").alias("kind"), F.col("fill").alias("text"))).cast(CELL)
    values = F.transform("places", lambda p, k: F.when(k == F.col("fill_at"), given).when(p >= 0, F.get("cells", p)))
    # A row a sheet, made on the driver.
    out = rows.join(F.broadcast(where), KEYS).select(*KEYS, "row_no", "file_order", values.alias("values"))
    # A file or sheet may be read by one task; its rows are spread before their values are worked on and kept.
    out = out.where(F.exists("values", lambda c: ~is_blank(c))).hint("rebalance")
    plain = out.withColumn("plain", normalize_all(F.transform("values", lambda v: v["text"])))
    both = F.zip_with("values", "plain", lambda v, p: F.when(v.isNotNull(), F.struct(v["kind"].alias("kind"), v["text"].alias("text"), p.alias("plain"))))
    return plain.select(*KEYS, "row_no", "file_order", both.alias("values"))


def union_by_name(tables: list[DataFrame]) -> DataFrame:
    """All rows of tables with different columns; what a table lacks is null."""
    out = tables[0]
    for table in tables[1:]:
        out = out.unionByName(table, allowMissingColumns=True)
    return out
