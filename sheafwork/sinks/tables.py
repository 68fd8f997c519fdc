"""Writing results: Parquet, CSV and workbooks, by Spark at any size."""

from __future__ import annotations

import tempfile
import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheafwork.functions.names import quoted, unused
from sheafwork.operators.validate import in_order
from sheafwork.sinks import workbook
from sheafwork.sinks.workbook import width_of  # noqa: F401  one of the outputs' functions


def summary_table(records: DataFrame, fields: list[str]) -> DataFrame:
    """The fields and where each row is from, in reading order."""
    return records.orderBy("src_order").select(*(F.col(quoted(f)) for f in fields), F.col("src_file").alias(unused("来源文件", fields)), F.col("src_row").alias(unused("来源行", fields)))


def issue_table(issues: DataFrame, note: str = "") -> DataFrame:
    """The issues in order, or a row that says that there are none, and a run's note as the last row."""
    columns = ["level", "problem", "suggestion", "file", "sheet", "row", "column", "value"]
    spark, end = issues.sparkSession, "level string, problem string"
    none = spark.createDataFrame([("info", "no problem was found")], end).join(issues.limit(1).select(F.lit(1).alias("_any")), F.lit(True), "left_anti")
    last = none.unionByName(spark.createDataFrame([("note", note)] if note else [], end))
    return in_order(issues).select(*columns).unionByName(last, allowMissingColumns=True)


def run_note(n_files: int, n_records: int, n_issues: int, cost_cny: float = 0.0) -> str:
    """One line on a run, for its issues' last row."""
    return f"{n_records} records from {n_files} files, {n_issues} issues" + (f", cost {cost_cny:.4f} CNY" if cost_cny else "")


def output_paths(folder: str, when: datetime) -> dict[str, str]:
    """The paths of a run's two outputs, named by its minute."""
    stamp = when.strftime("%Y%m%d-%H%M")
    return {kind: f"{folder.rstrip('/')}/{kind}-{stamp}" for kind in ("summary", "issues")}


def latest_outputs(spark: SparkSession, folder: str) -> dict[str, str | None]:
    """The newest output of each kind in a folder, by its time of change, in any store that Spark reads."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    found = [(s.getModificationTime(), s.getPath().getName()) for s in files.listStatus(path)] if files.exists(path) else []
    newest = {kind: max((x for x in found if x[1].startswith(f"{kind}-")), default=None) for kind in ("summary", "issues")}
    return {kind: x and f"{folder.rstrip('/')}/{x[1]}" for kind, x in newest.items()}


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_workbook(df: DataFrame, path: str, highlighted: set[str] | None = None, name: str = "Sheet1") -> int:
    """A workbook of df's rows, however many (workbook.write). The number of rows."""
    spark = df.sparkSession
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    scratch = f"{shared or 'file://' + tempfile.mkdtemp(prefix='sheafwork-')}/workbook-{uuid.uuid4().hex}"
    return workbook.write(df, path, scratch, highlighted, name)
