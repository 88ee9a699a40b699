"""Typed, column-pruned scans. Codes stay text; numbers are cast leniently; NaN becomes null."""

from __future__ import annotations

import json
import zipfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from propval.functions.geo import lambert93, parse_point
from propval.functions.scalar import finite, first_integer
from propval.sources.publish import Place, staged

TEXT_COLUMNS = ("id_mutation", "date_mutation", "nature_mutation", "adresse_suffixe", "adresse_nom_voie", "adresse_code_voie", "code_postal", "code_commune", "id_parcelle", "code_type_local")
NUMBER_COLUMNS = ("valeur_fonciere", "adresse_numero", "surface_reelle_bati", "nombre_pieces_principales", "nombre_lots", "surface_terrain", "longitude", "latitude")


def text_csv(spark: SparkSession, paths: str | Sequence[str], columns: Sequence[str], sep: str = ",") -> DataFrame:
    """The named columns of header CSV files (plain or .gz), all as text; empty is null. The header may have more, in any order."""
    df = spark.read.option("header", True).option("sep", sep).option("inferSchema", False).csv(list(paths) if not isinstance(paths, str) else paths)
    return df.select(*[F.col(f"`{c}`") for c in columns])


def transactions(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Transaction lines of several annual files with source_file; an id in two files is an error."""
    from propval.operators import contracts

    missing = [p for p in paths if not Place(p).exists()]
    if missing or not paths:
        raise FileNotFoundError(f"no such input: {missing}")
    df = text_csv(spark, paths, [*TEXT_COLUMNS, *NUMBER_COLUMNS]).withColumn("source_file", F.element_at(F.split(F.input_file_name(), "/"), -1))
    df = df.withColumns({c: finite(F.col(c).try_cast("double")) for c in NUMBER_COLUMNS})
    contracts.no_overlap(df, "id_mutation", "source_file")
    return df


def addresses(spark: SparkSession, path: str) -> DataFrame:
    """The address register: semicolons, gzip, all text."""
    return text_csv(spark, path, ["id", "id_fantoir", "numero", "rep", "code_insee", "x", "y", "certification_commune", "cad_parcelles"], ";")


def unzipped(archive: str, member: str, folder: str) -> str:
    """One member of a ZIP file unpacked into a folder that driver and executors share, once; its path. Spark reads no ZIP."""
    with Place(archive).local() as file, zipfile.ZipFile(file) as z:
        names = [n for n in z.namelist() if n.endswith(member)]
        if len(names) != 1:
            raise FileNotFoundError(f"{member} in {archive}: {len(names)} members")
        target = f"{folder.rstrip('/')}/{names[0].rsplit('/', 1)[-1]}"
        if not Place(target).exists():
            with staged(target) as part, z.open(names[0]) as src, part.open("wb") as dst:
                while block := src.read(1 << 20):
                    dst.write(block)
    return target


def zipped_csv(spark: SparkSession, archive: str, table: str, columns: Sequence[str], folder: str) -> DataFrame:
    return text_csv(spark, unzipped(archive, f"{table}.csv", folder), columns)


def context_points(spark: SparkSession, path: str, point: str = "geo_point_2d", sep: str = ";") -> DataFrame:
    """Points of interest with metric x and y from a "lat, lon" column."""
    df = spark.read.option("header", True).option("sep", sep).csv(path)
    lon, lat = parse_point(F.col(f"`{point}`"))
    x, y = lambert93(lon, lat)
    return df.withColumns({"x": x, "y": y})


def noise_polygons(spark: SparkSession, path: str) -> DataFrame:
    """poly_id, level, ring of a GML collection: members without legend and rings of under three vertices are left out;
    holes are ignored."""
    ring = "struct<`gml:LinearRing`:struct<`gml:posList`:string>>"
    surface = f"struct<`gml:Polygon`:struct<`gml:exterior`:{ring}>>"
    shape = f"struct<`gml:MultiSurface`:struct<`gml:surfaceMember`:array<{surface}>>>"
    schema = T.StructType([T.StructField("ms:legende", T.StringType()), T.StructField("ms:msGeometry", T._parse_datatype_string(shape))])
    df = spark.read.format("xml").option("rowTag", "wfs:member").schema(T.StructType([T.StructField("ms:zone", schema)])).load(path)
    rows = df.select(F.monotonically_increasing_id().alias("member"), F.col("`ms:zone`.`ms:legende`").alias("legend"), F.posexplode(F.col("`ms:zone`.`ms:msGeometry`.`gml:MultiSurface`.`gml:surfaceMember`")).alias("k", "s"))
    numbers = F.transform(F.split(F.trim(F.col("s.`gml:Polygon`.`gml:exterior`.`gml:LinearRing`.`gml:posList`")), r"\s+"), lambda v: v.try_cast("double"))
    pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size("n") / 2).cast("int") - 1), lambda i: F.struct(F.get("n", i * 2).alias("x"), F.get("n", i * 2 + 1).alias("y")))
    rings = rows.where("legend IS NOT NULL").withColumn("n", numbers).where(F.size("n") >= 6)
    return rings.select(F.concat_ws("_", "member", "k").alias("poly_id"), first_integer(F.col("legend")).alias("level"), pairs.alias("ring"))


def predictions(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    """A prediction file with the given column types; numbers and dates are read leniently."""
    df = spark.read.option("header", True).csv(path)
    return df.select(*[F.col(c).try_cast(t).alias(c) for c, t in columns.items()])


def json_report(path: str) -> dict:
    with Place(path).local() as f:
        return json.loads(f.read_text(encoding="utf-8"))


def schema_columns(spark: SparkSession, path: str) -> list[str]:
    """Column names of a Parquet table; no data is read."""
    return spark.read.parquet(path).columns


def tagged_union(tables: dict[str, DataFrame], tag: str) -> DataFrame:
    """UNION ALL of several tables with their names; missing columns are null."""
    out = None
    for name, df in tables.items():
        named = df.withColumn(tag, F.lit(name))
        out = named if out is None else out.unionByName(named, allowMissingColumns=True)
    return out


def latest_by(df: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    """Keeps the last row of each key by an ascending order in which nulls come last."""
    from pyspark.sql import Window as W

    w = W.partitionBy(*keys).orderBy(order.desc_nulls_first(), *[c for c in df.columns if c not in keys])
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
