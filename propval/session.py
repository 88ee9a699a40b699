"""Session defaults and the few engine-wide helpers that touch the session."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "propval", master: str | None = None, **conf: str) -> SparkSession:
    """UTC, adaptive execution with skew handling; every other setting is the cluster's."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; on one machine (a local master, as in tests) a temporary one where it is unset."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not known:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        known = tempfile.mkdtemp(prefix="propval-")
        spark.sparkContext.setCheckpointDir(known)
        known = spark.sparkContext.getCheckpointDir()
    return known.rstrip("/")


#: Tables written so far; `drop_written` removes them.
_WRITTEN: list[str] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: df as a Parquet table in the shared folder, read again. It survives the loss of any executor.

    The table stays, as results may still read it, until `drop_written`."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/propval-{name}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tables_written() -> set[str]:
    """The tables there are now; what is written later can then be told apart."""
    return set(_WRITTEN)


def drop_written(spark: SparkSession, only: set[str] | None = None) -> None:
    """Deletes the tables that `written` left, or some of them; to call once results are stored."""
    for name in [p for p in _WRITTEN if only is None or p in only]:
        _WRITTEN.remove(name)
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def literal_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows that the driver holds, as a plan of literals: no RDD and no Python on the executors."""
    names = [c.strip().split(" ", 1)[0] for c in schema.split(",")]
    text = json.dumps([dict(zip(names, r, strict=True)) for r in rows])
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{', '.join(c.strip().replace(' ', ':', 1) for c in schema.split(','))}>>")))
