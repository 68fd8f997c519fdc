"""The operational store: mapping cache, run log, question log and costs, as logs of changes with snapshots.

Each function is a plan over DataFrames; Store keeps the tables in a folder. A table is a list of numbered commits. A
commit holds its change records, or names a Parquet snapshot of all before it. A writer takes the next number by creating
its commit complete and only if no other has it; whoever comes second takes the number after that, or, if what it says
depends on what it has read, reads again. So writers never lose each other's changes and readers see whole commits.
After some commits a snapshot is taken, which gives way to any other commit of its number.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MAPPING_CACHE = "signature string, mapping string, source string, confidence string, created_at string, updated_at string, hit_count bigint"
RUNS = "id bigint, started_at string, finished_at string, n_files bigint, n_records bigint, n_issues bigint, cost_cny double"
QUERY_USAGE = "id bigint, asked_at string, question string, cost_cny double, n_turns bigint"
INBOX = "path string, file string, modified string, length bigint, digest string, batch string"
SCHEMAS = {"mapping_cache": MAPPING_CACHE, "runs": RUNS, "query_usage": QUERY_USAGE, "inbox": INBOX}
QUESTION_CHARS = 200


def upserted(old: DataFrame, new: DataFrame) -> DataFrame:
    """Both tables' latest row of each signature, but what a user has set only gives way to what a user sets; the first
    created_at and the sum of hits stay."""
    best = Window.partitionBy("signature").orderBy(F.desc(F.col("source") == "user"), F.desc("updated_at"), F.desc("_new"))
    whole = Window.partitionBy("signature")
    rows = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    rows = rows.withColumns({"_place": F.row_number().over(best), "created_at": F.min("created_at").over(whole), "hit_count": F.sum("hit_count").over(whole)})
    return rows.where("_place = 1").drop("_place", "_new")


def without_rules(cache: DataFrame) -> DataFrame:
    """What rules have matched costs nothing to match again and isn't kept."""
    return cache.where("source <> 'rule'")


def total_cost(log: DataFrame) -> DataFrame:
    return log.agg(F.coalesce(F.sum("cost_cny"), F.lit(0.0)).alias("cost_cny"))


def last_paid_run(runs: DataFrame) -> DataFrame:
    return runs.where((F.col("cost_cny") > 0) & F.col("finished_at").isNotNull()).orderBy(F.desc("id")).limit(1)


def question_rows(log: DataFrame) -> DataFrame:
    """Questions as they are kept: trimmed, their first characters."""
    return log.withColumn("question", F.substring(F.trim("question"), 1, QUESTION_CHARS))


def token_cost(usage: DataFrame, prices: DataFrame, fallback: tuple[float, float]) -> DataFrame:
    """usage (model, tokens_in, tokens_out) with its cost by prices (model, price_in, price_out) a million tokens."""
    joined = usage.join(prices, "model", "left")  # Spark broadcasts a price list by its size
    cost = (F.col("tokens_in") * F.coalesce("price_in", F.lit(fallback[0])) + F.col("tokens_out") * F.coalesce("price_out", F.lit(fallback[1]))) / 1_000_000
    return joined.withColumn("cost_cny", cost).drop("price_in", "price_out")


class Conflict(RuntimeError):
    """Another writer has taken the number that a commit depends on."""


#: Commits behind the last snapshot that are followed by a new one, and snapshots that stay for readers on their way.
SNAPSHOT_AFTER, SNAPSHOTS_KEPT = 16, 2
_COMMIT = re.compile(r"([0-9]{20})\.json")


def folded_mappings(changes: DataFrame) -> DataFrame:
    """The mapping cache that changes (version, seq, op, and its columns) lead to. op is put, hit (its hit_count is added)
    or forget (what the signature had before is gone). Of a signature's puts one counts as upserted has it."""
    own = Window.partitionBy("signature")
    gone = F.max(F.when(F.col("op") == "forget", F.struct("version", "seq"))).over(own)
    rows = changes.where("signature IS NOT NULL").withColumn("_gone", gone).where("op <> 'forget' AND (_gone IS NULL OR struct(version, seq) > _gone)")
    is_put = F.col("op") == "put"
    best = own.orderBy(F.desc(is_put), F.desc(F.col("source") == "user"), F.desc("updated_at"), F.desc("version"), F.desc("seq"))
    rows = rows.withColumns({"_place": F.row_number().over(best), "created_at": F.min(F.when(is_put, F.col("created_at"))).over(own), "hit_count": F.sum("hit_count").over(own)})
    return rows.where("_place = 1 AND op = 'put'").select(*_names(MAPPING_CACHE))


def folded_runs(changes: DataFrame) -> DataFrame:
    """The last row of each run."""
    last = Window.partitionBy("id").orderBy(F.desc("version"), F.desc("seq"))
    return changes.withColumn("_place", F.row_number().over(last)).where("_place = 1").select(*_names(RUNS))


def folded_inbox(changes: DataFrame) -> DataFrame:
    """The last row of each path that isn't forgotten."""
    last = Window.partitionBy("path").orderBy(F.desc("version"), F.desc("seq"))
    return changes.withColumn("_place", F.row_number().over(last)).where("_place = 1 AND op = 'put'").select(*_names(INBOX))


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


FOLDS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "mapping_cache": folded_mappings,
    "runs": folded_runs,
    "inbox": folded_inbox,
    "query_usage": lambda changes: changes.select(*_names(QUERY_USAGE)),
}


class Log:
    """A table's commits, one file a number, in a folder of a file system that renames files as a whole."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self.folder = folder
        where = self._path(folder)
        conf = spark._jsparkSession.sessionState().newHadoopConf()
        self._fs = where.getFileSystem(conf)
        whole = self._fs.makeQualified(where).toUri()
        self._local = whole.getPath() if whole.getScheme() == "file" else None
        self._snapshots: dict[int, str | None] = {}  # what is known of commits, which never change
        if not self._local:
            jvm = spark._jvm.org.apache.hadoop.fs
            self._context = jvm.FileContext.getFileContext(whole, conf)
            self._no_overwrite = spark._sc._gateway.new_array(getattr(jvm, "Options$Rename"), 0)

    def numbers(self) -> list[int]:
        """The commits' numbers in order."""
        where = self._path(self.folder)
        names = [s.getPath().getName() for s in self._fs.listStatus(where)] if self._fs.exists(where) else []
        return sorted(int(m[1]) for name in names if (m := _COMMIT.fullmatch(name)))

    def path(self, number: int) -> str:
        return f"{self.folder}/{number:020d}.json"

    def create(self, number: int, text: str) -> bool:
        """Write a commit as a whole; False, and nothing, if the number is taken."""
        name = f"drafts/{uuid.uuid4().hex}"
        if self._local:
            # A link is made in one step, and only if there is no file of the name.
            os.makedirs(f"{self._local}/drafts", exist_ok=True)
            with open(f"{self._local}/{name}", "w", encoding="utf-8") as out:
                out.write(text)
                out.flush()
                os.fsync(out.fileno())
            try:
                os.link(f"{self._local}/{name}", f"{self._local}/{number:020d}.json")
            except FileExistsError:
                return False
            finally:
                os.unlink(f"{self._local}/{name}")
            return True
        draft = self._path(f"{self.folder}/{name}")
        stream = self._fs.create(draft, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        try:
            self._context.rename(draft, self._path(self.path(number)), self._no_overwrite)
        except Exception as problem:  # noqa: BLE001  the other side's exception, known by its name
            self._fs.delete(draft, False)
            if "FileAlreadyExists" not in str(problem):
                raise
            return False
        return True

    def snapshot(self, number: int) -> str | None:
        """The snapshot's path if the commit names one."""
        if number not in self._snapshots:
            stream = self._fs.open(self._path(self.path(number)))
            try:
                first = json.loads(bytes(stream.readNBytes(int(self._fs.getFileStatus(self._path(self.path(number))).getLen()))).decode().partition("\n")[0])
            finally:
                stream.close()
            self._snapshots[number] = first["path"] if first["op"] == "snapshot" else None
        return self._snapshots[number]

    def drop(self, *paths: str) -> None:
        for path in paths:
            self._fs.delete(self._path(path), True)


class Store:
    """The tables in a folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self._spark, self._folder = spark, folder.rstrip("/")
        self._logs = {name: Log(spark, f"{self._folder}/{name}") for name in SCHEMAS}

    def _changes(self, name: str) -> tuple[DataFrame, int, int]:
        """(changes since the last snapshot with that as puts, the last number, commits behind the snapshot)."""
        log = self._logs[name]
        numbers = log.numbers()
        first = next((k for k in reversed(numbers) if log.snapshot(k)), 0)
        later = [k for k in numbers if k > first]
        out = self._spark.createDataFrame([], f"version bigint, seq bigint, op string, {SCHEMAS[name]}")
        if first:
            kept = self._spark.read.schema(SCHEMAS[name]).parquet(log.snapshot(first))
            out = out.unionByName(kept.select(F.lit(first).cast("long").alias("version"), F.lit(0).cast("long").alias("seq"), F.lit("put").alias("op"), "*"))
        if later:
            files = self._spark.read.schema(f"seq bigint, op string, {SCHEMAS[name]}").json([log.path(k) for k in later])
            version = F.regexp_extract("_metadata.file_name", "^([0-9]+)", 1).cast("long")
            out = out.unionByName(files.select(version.alias("version"), "*"))
        return out, max([first, *later]), len(later)

    def table(self, name: str) -> DataFrame:
        return FOLDS[name](self._changes(name)[0])

    def state(self, name: str) -> tuple[DataFrame, int]:
        """The table and the number of the last commit that it has seen."""
        changes, last, _ = self._changes(name)
        return FOLDS[name](changes), last

    def commit(self, name: str, changes: list[dict], after: int | None = None) -> int:
        """Append changes (op and columns) under the next free number, which is returned. after says that they depend on
        what was read up to that number: any commit behind it is a Conflict."""
        lines = "".join(json.dumps({"seq": k, "op": "put", **change}, ensure_ascii=False) + "\n" for k, change in enumerate(changes))
        log = self._logs[name]
        number = (max(log.numbers(), default=0) if after is None else after) + 1
        while not log.create(number, lines):
            if after is not None:
                raise Conflict(f"commit {number} of {name} is taken")
            number += 1
        if number % SNAPSHOT_AFTER == 0:
            self.compact(name)
        return number

    def compact(self, name: str) -> bool:
        """A snapshot of all commits, and an end to those before the last but one. False if another commit comes first."""
        log = self._logs[name]
        changes, last, behind = self._changes(name)
        if not behind:
            return False
        path = f"{log.folder}/snapshots/{uuid.uuid4().hex}"
        FOLDS[name](changes).coalesce(1).write.parquet(path)
        if not log.create(last + 1, json.dumps({"op": "snapshot", "path": path})):
            log.drop(path)
            return False
        numbers = log.numbers()
        snapshots = [k for k in numbers if log.snapshot(k)]
        for k in numbers:
            if len(snapshots) > SNAPSHOTS_KEPT and k < snapshots[-SNAPSHOTS_KEPT]:
                log.drop(log.path(k), *filter(None, [log.snapshot(k)]))
        return True

    def put_mapping(self, signature: str, mapping: dict, source: str, confidence: dict, now: str) -> None:
        self.put_mappings([(signature, mapping, source, confidence)], now)

    def put_mappings(self, rows: list[tuple[str, dict, str, dict]], now: str) -> None:
        """Keep mappings (signature, mapping, source, confidence); those of rules aren't kept. One commit for all."""
        text = lambda x: json.dumps(x, ensure_ascii=False)
        kept = [{"signature": s, "mapping": text(m), "source": source, "confidence": text(c), "created_at": now, "updated_at": now, "hit_count": 0} for s, m, source, c in rows if source != "rule"]
        if kept:
            self.commit("mapping_cache", kept)

    def get_mapping(self, signature: str) -> tuple[dict, str, dict] | None:
        return self.get_mappings({signature}).get(signature)

    def get_mappings(self, signatures: set[str]) -> dict[str, tuple[dict, str, dict]]:
        """(mapping, source, confidence) of the signatures that are known; each counts as a hit. One read and at most one
        commit for all (a run's headers, at most some hundred)."""
        rows = self.table("mapping_cache").where(F.col("signature").isin(*signatures)).collect() if signatures else []
        if rows:
            self.commit("mapping_cache", [{"op": "hit", "signature": r.signature, "hit_count": 1} for r in rows])
        return {r.signature: (json.loads(r.mapping), r.source, json.loads(r.confidence or "{}")) for r in rows}

    def next_run(self) -> int:
        """The number that the next run gets if no other starts before it (start_run takes one for good)."""
        return (self.table("runs").agg(F.max("id")).first()[0] or 0) + 1

    def start_run(self, started_at: str) -> int:
        """A number that no other run has, and its row."""
        while True:
            changes, last, _ = self._changes("runs")
            run = (folded_runs(changes).agg(F.max("id")).first()[0] or 0) + 1
            try:
                self.commit("runs", [{"id": run, "started_at": started_at, "cost_cny": 0.0}], after=last)
                return run
            except Conflict:
                continue

    def forget(self, signature: str | None = None) -> None:
        known = [signature] if signature is not None else [r.signature for r in self.table("mapping_cache").select("signature").collect()]
        if known:
            self.commit("mapping_cache", [{"op": "forget", "signature": s} for s in known])

    def log_run(self, row: tuple) -> None:
        """Add or change the run with the row's id."""
        self.commit("runs", [dict(zip(_names(RUNS), row))])

    def log_question(self, row: tuple) -> None:
        kept = question_rows(self._spark.createDataFrame([row], QUERY_USAGE)).first()
        self.commit("query_usage", [kept.asDict()])

    def count(self, name: str) -> int:
        return self.table(name).count()
