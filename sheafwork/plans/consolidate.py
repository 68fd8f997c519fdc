"""From a folder of messy sheets to one clean, checked table that can be asked in SQL."""

from __future__ import annotations

import tomllib
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime
from inspect import signature
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheafwork.functions import cleaning, masking
from sheafwork.functions import names as n
from sheafwork.operators import align, clean, headers, validate
from sheafwork.plans.ask import Table
from sheafwork.plans.store import Store
from sheafwork.sources.files import find_template, read_grids


#: Different headers from which on the rules match all of them in one plan.
PLANNED_HEADERS = 500


def _now() -> str:
    return datetime.now().strftime("%Y-%m-%d %H:%M:%S")


@dataclass(frozen=True)
class Settings:
    """What can be set; a TOML file's sections aggregate, privacy, excel and agent give other values."""

    confidence_threshold: float = 0.75
    samples_per_column: int = 5
    max_files_per_run: int = 100
    mask_id_card: bool = True
    mask_phone: bool = True
    mask_bank_card: bool = True
    mask_email: bool = True
    header_scan_rows: int = headers.SCAN_ROWS
    treat_as_empty: tuple[str, ...] = cleaning.EMPTY_MARKERS
    result_rows_for_ai: int = 20
    mask_name_in_answer: bool = False
    this_year: int | None = None

    @property
    def masks(self) -> set[str]:
        return {name for name in masking.MASKS if getattr(self, name)}

    @classmethod
    def load(cls, path: str | Path) -> Settings:
        """From a file; defaults where it or a value is missing."""
        path = Path(path)
        found = tomllib.loads(path.read_text(encoding="utf-8")) if path.exists() else {}
        flat = {k: tuple(v) if isinstance(v, list) else v for section in ("aggregate", "privacy", "excel", "agent") for k, v in found.get(section, {}).items()}
        return cls(**{k: v for k, v in flat.items() if k in cls.__dataclass_fields__})


@dataclass
class Result:
    """A run's outcome. The tables are lazy; sheets, mappings and kinds are small and known."""

    fields: list[str]
    records: DataFrame
    issues: DataFrame
    sheets: list[tuple[str, str, list[str], str]]
    mappings: list[align.Mapping]
    kinds: dict[str, str]
    failures: dict[str, str] = field(default_factory=dict)
    dropped: int = 0
    sheet_dropped: list[int] = field(default_factory=list)
    kept: list[DataFrame] = field(default_factory=list)

    def close(self) -> None:
        """Let go of what is kept in memory and on disk; the tables are computed anew if they are used again."""
        for df in self.kept:
            df.unpersist()

    def uncertain(self, least: float) -> list[tuple[str, str, str]]:
        """(file, sheet, column) of what should be confirmed."""
        return [(file, sheet, c) for (file, sheet, _, _), m in zip(self.sheets, self.mappings) for c in m.uncertain(least)]

    def outcomes(self) -> DataFrame:
        """(file, status, n_sheets, n_rows, dropped, hint, source, error): what became of each file. hint is its first
        sheet's that has one, source where its mappings are from."""
        spark = self.records.sparkSession
        meta = [(f, k, d, h, m.source) for k, ((f, _, _, h), m, d) in enumerate(zip(self.sheets, self.mappings, self.sheet_dropped))]
        sheets = spark.createDataFrame(meta, "file string, k int, dropped int, hint string, source string")
        files = sheets.groupBy("file").agg(
            F.count(F.lit(1)).alias("n_sheets"), F.sum("dropped").alias("dropped"), F.min_by("hint", F.when(F.col("hint") != "", F.col("k"))).alias("hint"),
            F.array_join(F.sort_array(F.collect_set("source")), ",").alias("source"),
        )
        rows = self.records.groupBy(F.col("src_file").alias("file")).agg(F.count(F.lit(1)).alias("n_rows"))
        read = files.join(rows, "file", "left").select(
            "file", F.lit("read").alias("status"), "n_sheets", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), "dropped", F.coalesce("hint", F.lit("")).alias("hint"), "source", F.lit("").alias("error")
        )
        failed = spark.createDataFrame(list(self.failures.items()), "file string, error string")
        zero = [F.lit(0).cast("long").alias(x) for x in ("n_sheets", "n_rows", "dropped")]
        return read.unionByName(failed.select("file", F.lit("failed").alias("status"), *zero, F.lit("").alias("hint"), F.lit("").alias("source"), "error"))

    def table(self, settings: Settings | None = None) -> Table:
        """The records as a view to ask: dates as ISO text, whole numbers that fit as long."""
        settings = settings or Settings()
        columns, whole = [], [name for name in self.fields if self.kinds[name] == "integer"]
        most = self.records.agg(*(F.max(F.abs(F.col(n.quoted(name)))).alias(f"m{k}") for k, name in enumerate(whole))).first() if whole else ()
        fits = {name: top is None or top < 2**63 for name, top in zip(whole, most)}
        for name in self.fields:
            column = F.col(n.quoted(name))
            if self.kinds[name] == "integer":
                column = column.cast("long") if fits[name] else column.cast("string")
            elif self.kinds[name] == "date":
                column = F.date_format(column, "yyyy-MM-dd")
            columns.append(column.alias(name))
        view = self.records.select(*columns, F.col("src_file").alias(n.unused("来源文件", self.fields)), F.col("src_row").cast("long").alias(n.unused("来源行", self.fields)))
        return Table(view, masks=settings.masks, mask_names=settings.mask_name_in_answer)


class Engine:
    """Consolidation with a matcher (by default the rules) and remembered mappings."""

    def __init__(
        self, spark: SparkSession, settings: Settings | None = None, matcher: align.Matcher = align.match_by_rules, store: Store | None = None, clock: Callable[[], str] = _now
    ) -> None:
        self.spark, self.settings, self.matcher, self.store, self._clock = spark, settings or Settings(), matcher, store, clock

    def template(self, folder: str) -> list[str] | None:
        """The field names of a folder's template, the first file in it by name."""
        path = find_template(self.spark, folder)
        return None if path is None else align.template_columns(read_grids(self.spark, path).where("error IS NULL").drop("error"))

    def consolidate(self, inbox: str, template: list[str] | None = None, known: dict[tuple[str, ...], align.Mapping] | None = None) -> Result:
        """Every readable sheet of a folder as one table."""
        return self.from_kept(read_grids(self.spark, inbox), template, known)

    def from_kept(self, grids: DataFrame, template: list[str] | None = None, known: dict[tuple[str, ...], align.Mapping] | None = None) -> Result:
        """The same from grids with errors, as read_grids has them."""
        grids = grids.persist()
        try:  # the header metadata and the kinds are computed within
            told = grids.where("error IS NOT NULL").select("file", "sheet", "error").collect()  # a row a file or sheet
            if grids.where("error IS NULL").select("file").distinct().count() > self.settings.max_files_per_run:
                raise ValueError(f"more than {self.settings.max_files_per_run} files")
            failures = {r.file: r.error for r in told if r.sheet is None}
            result = self.from_grids(grids.where("error IS NULL").drop("error"), template, known, failures)
            cut = [("warning", "not_read", r.error, "Split the sheet", r.file, r.sheet, None, "", None, 0) for r in told if r.sheet is not None]
            if cut:
                result.issues = validate.in_order(result.issues.unionByName(self.spark.createDataFrame(cut, validate.ISSUE)))
            return result
        finally:
            grids.unpersist()

    def _samples(self, found: DataFrame, rows: DataFrame, sheets: list[tuple[str, str, list[str], str]], fields: list[str]) -> dict[tuple[str, str], dict[str, dict[str, list[str]]]]:
        """Of each sheet, masked samples of its columns and of the fields, for a matcher that takes them."""
        samples = headers.first_samples(found, rows, self.settings.samples_per_column, lambda x: masking.mask_text(x, self.settings.masks))
        by_field = align.field_samples(samples, self.spark.createDataFrame([(f,) for f in fields], "field string"))
        own = {r.field: r.samples for r in by_field.collect()}
        out: dict[tuple[str, str], dict] = {}
        names = {(file, sheet): header for file, sheet, header, _ in sheets}
        for r in samples.collect():  # some values a column
            out.setdefault((r.file, r.sheet), {"columns": {}, "fields": own})["columns"][names[r.file, r.sheet][r.place]] = r.samples
        return out

    def _mappings(self, found: DataFrame, rows: DataFrame, sheets: list[tuple[str, str, list[str], str]], fields: list[str], known: dict) -> list[align.Mapping]:
        """Each sheet's mapping: a given one, else one that the store remembers for the header, else the matcher's; one
        whose fields no longer exist is made anew. What the matcher or the user has decided is kept in the store."""
        signatures = [n.signature_of(names) for _, _, names, _ in sheets]
        kept = self.store.get_mappings(set(signatures)) if self.store else {}
        wants = len(signature(self.matcher).parameters) > 2
        samples = self._samples(found, rows, sheets, fields) if wants else {}
        out, new = [], {}
        headers = list({tuple(names): None for _, _, names, _ in sheets})
        by_rule = align.match_all_by_rules(self.spark, headers, fields) if self.matcher is align.match_by_rules and len(headers) > PLANNED_HEADERS else {}
        for (file, sheet, names, _), sign in zip(sheets, signatures):
            mapping = known.get(tuple(names))
            if mapping is None and sign in kept and set(kept[sign][0]) == set(names):
                targets, source, confidence = kept[sign]
                mapping = align.Mapping(targets, confidence, {}, "user" if source == "user" else "cache")
            if mapping is None or not all(t in fields or t in (n.IGNORE, n.UNKNOWN) for t in mapping.targets.values()):
                more = (samples.get((file, sheet), {"columns": {}, "fields": {}}),) if wants else ()
                mapping = align.resolve_conflicts(by_rule.get(tuple(names)) or self.matcher(names, fields, *more))
            if mapping.source != "cache" and not (mapping.source == "user" and sign in kept and kept[sign][:2] == (mapping.targets, "user")):
                new[sign] = (sign, mapping.targets, mapping.source, mapping.confidence)
            out.append(mapping)
        if self.store and new:
            self.store.put_mappings(list(new.values()), self._clock())
        return out

    def from_grids(
        self, grids: DataFrame, template: list[str] | None = None, known: dict[tuple[str, ...], align.Mapping] | None = None, failures: dict[str, str] | None = None
    ) -> Result:
        """The same from raw grids of any source. known has mappings by header, used if all their fields still exist."""
        began = self._clock()
        run = self.store.start_run(began) if self.store else 0
        found, rows = headers.recovered(grids, self.settings.header_scan_rows)
        meta = found.select("file", "sheet", "names", "hint", "dropped").orderBy("file", "sheet").collect()  # headers only
        sheets = [(r.file, r.sheet, n.numbered(r.names, clean.PROVENANCE), r.hint) for r in meta]
        fields = align.pick_fields([s[2] for s in sheets], template)
        files = len({s[0] for s in sheets})
        if self.store:
            self.store.log_run((run, began, None, files, None, None, 0.0))
        mappings = self._mappings(found, rows, sheets, fields, known or {})
        # Kinds, records and audit all read the projected rows, and every rule the records: each is computed once.
        projected = align.projected(self.spark, rows, sheets, fields, mappings).persist()
        markers, year = self.settings.treat_as_empty, self.settings.this_year
        kinds = clean.column_kinds(projected, fields, markers, year) if fields else {}
        records = clean.cleaned(projected, fields, kinds, markers, year).persist()
        unsure = {t for m in mappings for c, t in m.targets.items() if t in fields and m.confidence.get(c, 1.0) < self.settings.confidence_threshold and t != c}
        notes = validate.normalization_notes(clean.audit(projected, fields, kinds, markers, year), fields)
        issues = validate.in_order(validate.validate(records, fields, unsure).unionByName(notes))
        if self.store:
            self.store.log_run((run, began, self._clock(), files, records.count(), issues.count(), 0.0))
        dropped = [r.dropped for r in meta]
        return Result(fields, records, issues, sheets, mappings, kinds, failures or {}, sum(dropped), dropped, [projected, records])

    def rerun(self, result: Result, inbox: str, choices: dict[str, str], confirm: bool = False) -> Result:
        """Run anew with the user's choices (column to field). Nothing happens unless it is confirmed."""
        if not confirm:
            raise PermissionError("a rerun changes the table and must be confirmed")
        known = {tuple(names): align.confirmed(m, {c: t for c, t in choices.items() if c in names}) for (_, _, names, _), m in zip(result.sheets, result.mappings)}
        return self.consolidate(inbox, result.fields, known)
