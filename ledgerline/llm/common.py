"""What the corpus operators share: table access, staging in the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words, and a run of others, as Java patterns.
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

_own_dir: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only a local-mode session without the setting (tests) gets a folder of its own.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dir:
        _own_dir[app] = "file://" + tempfile.mkdtemp(prefix="ledgerline-")
        spark.sparkContext.setCheckpointDir(_own_dir[app])
    return _own_dir[app]


def stage(df: DataFrame, name: str, codec: str = "zstd", path: str | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Writes df once as a Parquet table in the shared folder, laid out by the columns of `by`, and reads it back.

    Cuts lineage in a way that survives lost executors: tasks that fail later
    reread the table instead of recomputing what led to it.
    """
    spark = df.sparkSession
    path = path or f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).partitionBy(*by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_or_empty(text_col: str = "text") -> Column:
    return F.coalesce(F.col(text_col), F.lit(""))


def fresh(name: str, df: DataFrame) -> str:
    """A column name that df does not have, for temporary columns beside a user's own."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
