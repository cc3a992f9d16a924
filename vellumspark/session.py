"""Session defaults and the two physical helpers that every operator shares."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def local_session(cores: str = "8", shuffle_partitions: int = 8, app: str = "vellumspark") -> SparkSession:
    """A local session for tests and benches. A cluster brings its own session."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app).config("spark.driver.memory", "8g")
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    return builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions)).getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir. Only a local session without that setting gets one of its own."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="vellumspark-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    _shared_folder(df.sparkSession)
    return df.checkpoint(eager)


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage with a table of Parquet files in the shared folder: smaller than a checkpoint, and readers take only
    the columns they need."""
    path = f"{_shared_folder(df.sparkSession)}/{uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def size_bytes(df: DataFrame) -> int:
    """About how many bytes the rows take; ``df`` should be cheap to read again."""
    width = F.lit(16 * len(df.columns))
    for name, kind in df.dtypes:
        if kind == "string":
            width = width + F.coalesce(F.length(name), F.lit(0)) * 2
        elif kind.startswith(("array", "struct", "map")):
            width = width + F.coalesce(F.length(F.to_json(name)), F.lit(0)) * 2
    return df.agg(F.sum(width).alias("b")).first()["b"] or 0


def join_measured(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner", limit_mb: int = 48) -> DataFrame:
    """Join with a side that is expected to be small, but is measured first.

    ``small`` should be cheap to read again (a checkpoint). Up to ``limit_mb`` of text it is broadcast, beyond that the
    join is left to Catalyst, which shuffles both sides and splits skewed partitions at run time.
    """
    return big.join(F.broadcast(small) if size_bytes(small) <= limit_mb * 1_000_000 else small, on, how)
