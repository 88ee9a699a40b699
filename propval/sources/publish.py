"""Publishing that is all or nothing: what is written stands beside its target, in the target's own file system, until it is whole."""

from __future__ import annotations

import csv
import hashlib
import json
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


class Place:
    """A path in whatever file system holds it: this machine's, or, with a Spark session, any that Hadoop knows."""

    def __init__(self, path: str | Path) -> None:
        self.path, self.spark = str(path), SparkSession.getActiveSession()
        scheme = self.path.split("://", 1)[0] if "://" in self.path else ""
        if scheme in ("", "file") and (self.spark is None or scheme or self._fs().getUri().getScheme() == "file"):
            self.spark = None  # a file of this machine, or of a folder that all machines mount
            self.path = self.path.removeprefix("file://")
        elif self.spark is None:
            raise RuntimeError(f"{self.path} needs a Spark session")

    def _hadoop(self, path: str | None = None) -> object:
        return self.spark._jvm.org.apache.hadoop.fs.Path(path or self.path)

    def _fs(self) -> object:
        return self._hadoop().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def exists(self) -> bool:
        return Path(self.path).exists() if self.spark is None else self._fs().exists(self._hadoop())

    def take(self, local: Path) -> None:
        """A local file becomes this one: copied beside it, then renamed over it."""
        part = f"{self.path}.part-{uuid.uuid4().hex}"
        if self.spark is None:
            Path(self.path).parent.mkdir(parents=True, exist_ok=True)
            try:
                shutil.copyfile(local, part)
                os.replace(part, self.path)
            finally:
                Path(part).unlink(missing_ok=True)
            return
        fs, jvm = self._fs(), self.spark._jvm
        try:
            fs.copyFromLocalFile(False, True, self._hadoop(str(local)), self._hadoop(part))
            kinds = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
            over = self.spark.sparkContext._gateway.new_array(kinds, 1)
            over[0] = kinds.OVERWRITE
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(self._hadoop(part), self._hadoop(), over)
        finally:
            fs.delete(self._hadoop(part), False)

    @contextmanager
    def local(self) -> Iterator[Path]:
        """This file on this machine, for readers that need to seek in it."""
        if self.spark is None:
            yield Path(self.path)
            return
        with tempfile.TemporaryDirectory() as folder:  # the driver's own, for the driver's own reading
            copy = Path(folder) / Path(self.path).name
            self._fs().copyToLocalFile(False, self._hadoop(), self._hadoop(str(copy)), True)
            yield copy


@contextmanager
def staged(path: str | Path) -> Iterator[Path]:
    """A new local file to write; it becomes `path` if the block ends well, and is gone otherwise."""
    with tempfile.TemporaryDirectory() as folder:
        file = Path(folder) / Path(str(path)).name
        yield file
        Place(path).take(file)


def write_json(path: str | Path, payload: object, default: Callable | None = None) -> None:
    """Indented UTF-8; serialised in full before anything is written."""
    text = json.dumps(payload, indent=2, ensure_ascii=False, default=default) + "\n"
    with staged(path) as f:
        f.write_text(text, encoding="utf-8")


def write_csv(path: str | Path, rows: Iterable[dict], columns: list[str]) -> None:
    """Small results only: rows come from the driver."""
    with staged(path) as f, f.open("w", encoding="utf-8", newline="") as out:
        w = csv.DictWriter(out, columns)
        w.writeheader()
        w.writerows(rows)


@contextmanager
def replaced_folder(spark: SparkSession, path: str) -> Iterator[str]:
    """A folder to write, in the file system of `path`, which it replaces by renames if the block ends well: the old one aside,
    the new one in, the old one away. Whatever fails, an old version stays or comes back."""
    staging, aside = f"{path}.part-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    make = spark._jvm.org.apache.hadoop.fs.Path
    fs = make(path).getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        yield staging
        had = fs.exists(make(path))
        if had and not fs.rename(make(path), make(aside)):
            raise OSError(f"{path} could not be moved aside")
        if not fs.rename(make(staging), make(path)):
            if had:
                fs.rename(make(aside), make(path))
            raise OSError(f"{staging} could not be moved to {path}")
        if had:
            fs.delete(make(aside), True)
    finally:
        fs.delete(make(staging), True)


def publish_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """A Parquet (zstd) folder, replaced as a whole."""
    with replaced_folder(df.sparkSession, path) as staging:
        w = df.write.option("compression", "zstd")
        (w.partitionBy(*partition_by) if partition_by else w).parquet(staging)


def publish_model(model: object, path: str, meta: dict, spark: SparkSession) -> None:
    """A fitted PipelineModel, and its features and provenance as JSON, replaced as one folder."""
    with replaced_folder(spark, path) as staging:
        model.write().overwrite().save(f"{staging}/model")
        spark.createDataFrame([(json.dumps(meta, sort_keys=True),)], "value string").coalesce(1).write.text(f"{staging}/meta")


def sha256(path: str | Path) -> str:
    digest = hashlib.sha256()
    with Place(path).local() as f, f.open("rb") as src:
        while block := src.read(1 << 20):
            digest.update(block)
    return digest.hexdigest()
