"""An inbox that is read as it grows: a further run parses only files that are new or have changed.

What is kept of a file is its raw grid, under the digest of its name and content, as kinds, duplicates and issues depend
on all rows of all files: they are computed anew from the grids, which is cheap beside parsing, so a run after any number
of changes equals a run over all files at once. A ledger in the store says which grids stand for which file. A run writes
the grids of what is new into a folder of its own and then commits the ledger's changes: if it is lost before that, or
another run commits first, its folder stands for nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sheafwork.plans.consolidate import Engine, Result
from sheafwork.plans.store import Conflict, Store
from sheafwork.sources.cells import SCHEMA
from sheafwork.sources.files import list_files, read_grids

#: Folders of grids from which on they are joined into one.
MOST_FOLDERS = 16


class Inbox:
    """A folder's files and the grids kept of them."""

    def __init__(self, engine: Engine, folder: str, state: str) -> None:
        self._engine, self._spark, self._folder = engine, engine.spark, folder
        self._state, self._store = state.rstrip("/"), Store(engine.spark, state)

    def _listed(self) -> DataFrame:
        """(path, file, modified, length) of the files that are there now; no content is read."""
        return list_files(self._spark, self._folder).select("path", "file", F.col("modificationTime").cast("string").alias("modified"), "length")

    def refresh(self) -> tuple[list[str], list[str]]:
        """Read what is new or has changed, forget what is gone. (names read, names gone)."""
        while True:
            known, last = self._store.state("inbox")
            told = known.collect()  # a row a file, without content
            now = {r["path"]: r for r in self._listed().collect()}
            before = {r["path"]: r for r in told}
            touched = [p for p, r in now.items() if p not in before or (before[p]["modified"], before[p]["length"]) != (r["modified"], r["length"])]
            gone = [p for p in before if p not in now]
            if not touched and not gone:
                return [], []
            digests = self._digests(touched)
            stand = {r["digest"]: r["batch"] for r in told}
            new = [p for p in touched if digests[p] not in stand]
            batch = self._kept(new, digests) if new else None
            changes = [{**now[p].asDict(), "digest": digests[p], "batch": stand.get(digests[p], batch)} for p in touched] + [{"op": "forget", "path": p} for p in gone]
            try:
                self._store.commit("inbox", changes, after=last)
            except Conflict:
                continue  # another run was first: look again
            self._join_folders()
            return sorted(now[p]["file"] for p in new), sorted(before[p]["file"] for p in gone)

    def _digests(self, paths: list[str]) -> dict[str, str]:
        """Of each path, that of its name and content, formed by the executors."""
        if not paths:
            return {}
        content = list_files(self._spark, paths, content=True)
        return {r["path"]: r["digest"] for r in content.select("path", F.sha2(F.concat(F.encode(F.concat("file", F.lit("\n")), "UTF-8"), "content"), 256).alias("digest")).collect()}

    def _kept(self, paths: list[str], digests: dict[str, str]) -> str:
        """Write the grids of some files into a new folder. Its name."""
        batch = uuid.uuid4().hex
        files = self._spark.createDataFrame([(p, digests[p]) for p in paths], "path string, digest string").join(self._listed().select("path", "file"), "path")
        read_grids(self._spark, paths).join(F.broadcast(files.select("file", "digest")), "file").write.parquet(f"{self._state}/grids/{batch}")  # a row a file
        return batch

    def _ledger(self) -> DataFrame:
        return self._store.table("inbox")

    def grids(self) -> DataFrame:
        """The grids of all files that are there, with errors, as sources.read_grids has them."""
        ledger = self._ledger().persist()
        batches = [r["batch"] for r in ledger.select("batch").distinct().orderBy("batch").collect()]
        if not batches:
            ledger.unpersist()
            return self._spark.createDataFrame([], SCHEMA)
        kept = self._spark.read.schema(f"{SCHEMA}, digest string").parquet(*(f"{self._state}/grids/{b}" for b in batches))
        present = self._spark.createDataFrame([(r["file"], r["digest"]) for r in ledger.select("file", "digest").distinct().collect()], "file string, digest string")
        ledger.unpersist()
        return kept.join(F.broadcast(present), ["file", "digest"], "left_semi").drop("digest")  # a row a file

    def _join_folders(self) -> None:
        """One folder in place of many, and the ledger's rows with it."""
        known, last = self._store.state("inbox")
        rows = known.collect()
        if len({r["batch"] for r in rows}) <= MOST_FOLDERS:
            return
        batch = uuid.uuid4().hex
        present = self._spark.createDataFrame([(r["file"], r["digest"]) for r in rows], "file string, digest string").distinct()
        kept = self._spark.read.schema(f"{SCHEMA}, digest string").parquet(*(f"{self._state}/grids/{b}" for b in sorted({r["batch"] for r in rows})))
        kept.join(F.broadcast(present), ["file", "digest"], "left_semi").write.parquet(f"{self._state}/grids/{batch}")
        try:
            self._store.commit("inbox", [{**r.asDict(), "batch": batch} for r in rows], after=last)
        except Conflict:
            pass  # the next run does it

    def consolidate(self, template: list[str] | None = None) -> Result:
        """The table of all files that are there, after reading what is new."""
        self.refresh()
        return self._engine.from_kept(self.grids(), template)

    def watch(self, checkpoint: str, seconds: float | None = None) -> StreamingQuery:
        """Refresh whenever files arrive: every so many seconds, or once for all that are there."""
        arriving = self._spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(self._folder).select("path")
        trigger = {"availableNow": True} if seconds is None else {"processingTime": f"{seconds} seconds"}
        return arriving.writeStream.foreachBatch(lambda batch, number: self.refresh() and None).option("checkpointLocation", checkpoint).trigger(**trigger).start()
