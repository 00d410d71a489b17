"""Scans and sinks: typed and all-text CSV, provenance, Markdown tables, GeoJSON, file hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def typed_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a fixed schema; a row that doesn't fit fails the scan."""
    return spark.read.schema(schema).csv(path, header=True, mode="FAILFAST", enforceSchema=False)


def text_csv(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """CSV whose cells are all text; nothing is inferred."""
    return spark.read.schema(T.StructType([T.StructField(n, T.StringType()) for n in names])).csv(path, header=True, enforceSchema=False)


def with_provenance(df: DataFrame, column: str = "source_file") -> DataFrame:
    """The rows of a file scan with the name of the file each came from."""
    return df.withColumn(column, F.col("_metadata.file_name"))


def union_by_name(*parts: DataFrame) -> DataFrame:
    """Rows of all parts; columns in first-seen order, null where a part lacks them."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def markdown_table(lines: DataFrame, names: list[str], line: str = "value", number: str = "n") -> DataFrame:
    """Cells of '| a | b |' rows, without heading and rule; ``number`` orders the lines."""
    cells = F.transform(F.split(F.regexp_replace(F.trim(line), r"^\||\|$", ""), r"\|"), lambda c: F.trim(c))
    rows = lines.where(F.trim(F.col(line)).rlike(r"^\|") & ~F.col(line).rlike(r"^\s*\|[\s:|-]+$")).select(number, cells.alias("cells"))
    body = rows.where(F.size("cells") == len(names)).where(F.get("cells", F.lit(0)) != names[0])
    return body.select(number, *[F.get("cells", F.lit(i)).alias(n) for i, n in enumerate(names)])


FEATURES = "type string, features array<struct<type:string,properties:map<string,string>,geometry:struct<type:string,coordinates:array<array<array<double>>>>>>"


def geojson_features(documents: DataFrame, text: str = "value") -> DataFrame:
    """One row a polygon feature of GeoJSON texts: properties, rings and bounding box."""
    f = documents.select(F.explode(F.from_json(text, FEATURES)["features"]).alias("f")).where("f.geometry.type = 'Polygon'")
    points = F.flatten("f.geometry.coordinates")
    xs, ys = F.transform(points, lambda p: p[0]), F.transform(points, lambda p: p[1])
    box = F.struct(F.array_min(xs).alias("xmin"), F.array_min(ys).alias("ymin"), F.array_max(xs).alias("xmax"), F.array_max(ys).alias("ymax"))
    return f.select(F.col("f.properties").alias("properties"), F.col("f.geometry.coordinates").alias("rings"), box.alias("bbox"))


AOI = "features array<struct<geometry:struct<type:string,coordinates:string>>>"
_POLYGONS = "array<array<array<array<double>>>>"


def single_polygon(texts: DataFrame, text: str) -> DataFrame:
    """``texts`` with status and polygons of its one area: 'ok', 'not_one_feature' or 'not_polygonal'; only an ok text has polygons.

    A polygon counts as a multipolygon of one.
    """
    f = F.from_json(text, AOI)["features"]
    g = F.get(f, F.lit(0))["geometry"]
    status = F.when(F.coalesce(F.size(f), F.lit(0)) != 1, "not_one_feature").when(F.coalesce(g["type"].isin("Polygon", "MultiPolygon"), F.lit(False)), "ok").otherwise("not_polygonal")
    polygons = F.when(status != "ok", None).when(g["type"] == "Polygon", F.array(F.from_json(g["coordinates"], "array<array<array<double>>>"))).otherwise(F.from_json(g["coordinates"], _POLYGONS))
    return texts.withColumns({"status": status, "polygons": polygons})


def polygon_area(polygons: Column) -> Column:
    """Planar area of a multipolygon: outer rings less their holes."""
    pairs = lambda ring: F.zip_with(F.slice(ring, 1, F.size(ring) - 1), F.slice(ring, 2, F.size(ring) - 1), lambda a, b: a[0] * b[1] - b[0] * a[1])
    area = lambda ring: F.abs(F.aggregate(pairs(ring), F.lit(0.0), lambda s, x: s + x)) / 2
    of = lambda rings: F.aggregate(F.transform(rings, lambda r, i: F.when(i == 0, area(r)).otherwise(-area(r))), F.lit(0.0), lambda s, x: s + x)
    return F.aggregate(F.transform(polygons, of), F.lit(0.0), lambda s, x: s + x)


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """Name, size and SHA-256 of files; for files that fit a row."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def write_packs(contents: DataFrame, path: str) -> None:
    """Files (file, content) packed as rows of a table.

    A file of its own for each costs a folder entry, a rename and a status on the
    driver; of a million small files these alone fill it.
    """
    contents.select("file", "content").write.parquet(path)


def packed_hashes(spark: SparkSession, path: str, file: str = "file string") -> DataFrame:
    """Name, size and SHA-256 of the files packed at ``path``, from their bytes; ``file`` is the name's column and type."""
    packs = spark.read.schema(f"{file}, content binary").parquet(path)
    return packs.select("file", F.octet_length("content").cast("bigint").alias("size"), F.sha2("content", 256).alias("sha256"))


def missing_files(listed: DataFrame, present: DataFrame, name: str = "file") -> DataFrame:
    return listed.join(present, name, "left_anti")


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Parquet through Spark's committer: readers see the whole table or none of it."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def fetch_missing(wanted: DataFrame, cache: DataFrame, key: str, fetch, schema: str) -> DataFrame:
    """Cached rows of status 'success', and ``fetch`` (batches of pandas frames) for the rest."""
    good = cache.where("status = 'success'").join(wanted.select(key), key, "left_semi")
    todo = wanted.join(good.select(key), key, "left_anti")
    return good.unionByName(todo.mapInPandas(fetch, schema), allowMissingColumns=True)


def integrity(manifest: DataFrame, present: DataFrame, name: str = "file") -> DataFrame:
    """Each file of a manifest (file, bytes, digest) against those present (file, size, sha256): its status.

    ``missing``, ``size_mismatch`` before ``hash_mismatch``, or ``ok``; a manifest
    row without a digest is held by its size alone. Of a file delivered twice any
    copy that fits will do.
    """
    met = manifest.join(present, name, "left")
    sized = F.col("size") == F.col("bytes")
    rank = F.when(F.col("size").isNull(), 3).when(~sized, 2).when(F.col("digest").isNotNull() & (F.lower("digest") != F.col("sha256")), 1).otherwise(0)
    best = met.groupBy(name, "bytes", "digest").agg(F.min(rank).alias("rank"))
    return best.select(name, F.element_at(F.array(*map(F.lit, ("ok", "hash_mismatch", "size_mismatch", "missing"))), F.col("rank") + 1).alias("status"))
