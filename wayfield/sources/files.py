"""Vector, raster and graph layers in files: bounding-box reads, GeoJSON, ASCII grids, and saved layers with a manifest."""

from __future__ import annotations

import json
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfield.functions import shapes

VERSION = 1


def read_box(spark: SparkSession, path: str, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """A Parquet layer with x, y: the box goes to the scan as plain comparisons, which skip row groups."""
    df = spark.read.parquet(path)
    if box is None:
        return df
    x0, y0, x1, y1 = box
    return df.filter((F.col("x") >= x0) & (F.col("x") <= x1) & (F.col("y") >= y0) & (F.col("y") <= y1))


def read_geojson(spark: SparkSession, path: str, by_line: bool = False) -> DataFrame:
    """kind, coordinates (JSON text) and properties (map) per feature.

    A feature collection is one JSON value, so a file is one task's work. With ``by_line`` files hold a feature a line, as this library's writers and
    the newline-delimited form have it, also lines of a collection that end in a comma; these are split like any text. Other lines go.
    """
    feature = "struct<properties:map<string,string>,geometry:struct<type:string,coordinates:string>>"
    if by_line:
        lines = spark.read.text(path).filter(F.col("value").rlike(r'^\s*\x1E?\{.*"geometry"'))
        rows = lines.select(F.from_json(F.regexp_replace("value", r"^\s*\x1E|,\s*$", ""), feature).alias("f")).filter("f IS NOT NULL")
    else:
        rows = spark.read.schema(f"features array<{feature}>").option("multiLine", True).json(path).select(F.explode("features").alias("f"))
    return rows.select(F.col("f.geometry.type").alias("kind"), F.col("f.geometry.coordinates").alias("coordinates"), F.col("f.properties").alias("properties"))


def write_geojson_points(df: DataFrame, path: str) -> None:
    """One feature a line, from x, y and the other columns as properties."""
    other = [c for c in df.columns if c not in ("x", "y")]
    geometry = F.struct(F.lit("Point").alias("type"), F.array("x", "y").alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*other).alias("properties"))
    df.select(F.to_json(feature).alias("value")).write.mode("overwrite").text(path)


def read_ascii_grid(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, float]]:
    """Cells (row_no, col, value) of an ESRI ASCII grid, without its nodata cells, and its header.

    A line's row is the number of lines before it: counted per partition of the file first (a few numbers), then within each.
    """
    lines = spark.read.option("lineSep", "\n").text(path).withColumn("place", F.monotonically_increasing_id())
    is_header = F.col("value").rlike(r"^\s*(?i:ncols|nrows|xllcorner|yllcorner|xllcenter|yllcenter|cellsize|dx|dy|nodata_value)\b")
    header = {k.lower(): float(v) for k, v in (r["value"].split() for r in lines.filter(is_header).limit(12).collect())}
    body = lines.filter(~is_header & (F.trim("value") != "")).withColumn("part", F.shiftright("place", 33))
    before, at = {}, 0
    for r in body.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect():
        before[r["part"]], at = at, at + r["n"]
    first = spark.createDataFrame(list(before.items()) or [(0, 0)], "part long, before long")
    within = F.row_number().over(Window.partitionBy("part").orderBy("place")) - 1
    rows = body.withColumn("within", within).join(F.broadcast(first), "part").withColumn("row_no", (F.col("before") + F.col("within")).cast("long"))
    split = rows.select("row_no", F.posexplode(F.split(F.trim("value"), r"\s+")).alias("col", "v"))
    cells = split.select("row_no", F.col("col").cast("long").alias("col"), F.expr("try_cast(v AS double)").alias("value"))
    return cells.filter(F.col("value").isNotNull() & ~F.isnan("value") & (F.col("value") != header.get("nodata_value", float("nan")))), header


#: Formats by ending, those that are fastest to read first.
READERS = {
    "parquet": lambda spark, path: spark.read.parquet(path),
    "geojson": lambda spark, path: read_geojson(spark, path),
    "json": lambda spark, path: read_geojson(spark, path),
    "geojsonl": lambda spark, path: read_geojson(spark, path, by_line=True),
    "geojsonseq": lambda spark, path: read_geojson(spark, path, by_line=True),
    "csv": lambda spark, path: spark.read.option("header", True).option("inferSchema", True).csv(path),
}


def read_layer(spark: SparkSession, path: str, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """A vector layer by its path without an ending: the first of READERS that is there. With ``box`` rows whose x, y, shape or ring meets it."""
    stem = path.rsplit(".", 1)[0] if path.rsplit(".", 1)[-1] in READERS else path
    for ending, reader in READERS.items():
        fs, at = _fs(spark, f"{stem}.{ending}")
        if fs.exists(at):
            return in_box(reader(spark, f"{stem}.{ending}"), box)
    raise FileNotFoundError(f"{stem} with none of {list(READERS)}")


def in_box(df: DataFrame, box: tuple[float, float, float, float] | None) -> DataFrame:
    """Rows that meet the box: by x, y, or by a shape's own box first and then exactly."""
    if box is None:
        return df
    x0, y0, x1, y1 = (F.lit(float(v)) for v in box)
    if "ring" in df.columns or "shape" in df.columns:
        shape = shapes.of(df)
        b = shapes.bbox(shape)
        return df.filter((b["xmax"] >= x0) & (b["xmin"] <= x1) & (b["ymax"] >= y0) & (b["ymin"] <= y1)).filter(shapes.touches_box(shape, x0, y0, x1, y1))
    return df.filter(F.col("x").between(x0, x1) & F.col("y").between(y0, y1))


def geojson_rings(features: DataFrame) -> DataFrame:
    """Polygons of ``read_geojson`` with ``ring``: their outer ring."""
    rings = F.from_json("coordinates", "array<array<array<double>>>")[0]
    return features.filter("kind = 'Polygon'").withColumn("ring", F.transform(rings, lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))))


def geojson_shapes(features: DataFrame) -> DataFrame:
    """Polygons and multi-polygons of ``read_geojson`` with ``shape``, all parts and holes; other kinds of geometry go."""
    return features.filter("kind IN ('Polygon', 'MultiPolygon')").withColumn("shape", shapes.from_geojson(F.col("kind"), F.col("coordinates")))


def write_geojson_shapes(df: DataFrame, path: str) -> None:
    """One feature a line, from ``shape`` (or ``ring``) and the other columns as properties."""
    other = [c for c in df.columns if c not in ("shape", "ring")]
    head = F.concat(F.lit('{"type":"Feature","geometry":'), shapes.to_geojson(shapes.of(df)), F.lit(',"properties":'))
    df.select(F.concat(head, F.to_json(F.struct(*other)), F.lit("}")).alias("value")).write.mode("overwrite").text(path)


def load_shapes(spark: SparkSession, paths: list[str], box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Layers of several files (a state or county each) as one, columns that some lack null, rows that meet the box."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [read_layer(spark, p, box) for p in paths])


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def write_bytes(spark: SparkSession, path: str, content: bytes) -> None:
    """A small file, through Hadoop's file systems."""
    write_parts(spark, path, [content])


def write_parts(spark: SparkSession, path: str, parts: Iterable[bytes]) -> None:
    """A file of parts, one after the other, through Hadoop's file systems."""
    fs, at = _fs(spark, path)
    out = fs.create(at, True)
    for part in parts:
        out.write(bytearray(part))
    out.close()


def save(spark: SparkSession, path: str, kind: str, tables: dict[str, DataFrame], attributes: dict | None = None, overwrite: bool = False) -> None:
    """Tables as zstd Parquet in one folder, with a manifest of what it is."""
    for name, df in tables.items():
        df.write.mode("overwrite" if overwrite else "errorifexists").option("compression", "zstd").parquet(f"{path}/{name}")
    manifest = {"version": VERSION, "class": kind, "tables": sorted(tables), "attributes": attributes or {}}
    fs, at = _fs(spark, f"{path}/manifest.json")
    out = fs.create(at, overwrite)
    out.write(bytearray(json.dumps(manifest, indent=1).encode()))
    out.close()


def load(spark: SparkSession, path: str, kind: str) -> tuple[dict[str, DataFrame], dict]:
    fs, at = _fs(spark, f"{path}/manifest.json")
    if not fs.exists(at):
        raise FileNotFoundError(f"{path} has no manifest")
    text = "\n".join(r["value"] for r in spark.read.option("lineSep", "\0").text(f"{path}/manifest.json").collect())
    manifest = json.loads(text)
    if manifest["class"] != kind:
        raise TypeError(f"{path} holds {manifest['class']}, not {kind}")
    return {name: spark.read.parquet(f"{path}/{name}") for name in manifest["tables"]}, manifest["attributes"]


#: Names of the yearly population rasters, by kind and by year.
RASTERS_BEFORE_2015 = {"100m": "wpgpunadj", "1km": "wpicuadj1km"}
RASTERS_FROM_2015 = "G2_CN_POP_R25A_{}"
AGES, MINORS = "G2_CN_Age_2024_{}", "G2_Age_U18_R25A_{}"


def population_raster(kind: str, year: int, resolution: str = "100m", subset: str | None = None) -> str:
    """The name of the saved raster to look for: ``pop`` by year (to 2030), or ``age_structures``."""
    if kind == "age_structures":
        return MINORS.format(resolution) if subset in ("under_18", "U18") else subset or AGES.format(resolution)
    if kind != "pop":
        raise ValueError(f"unknown kind of raster: {kind}")
    if year > 2030:
        raise ValueError(f"no raster for {year}")
    return RASTERS_FROM_2015.format(resolution) if year >= 2015 else subset or RASTERS_BEFORE_2015[resolution]
