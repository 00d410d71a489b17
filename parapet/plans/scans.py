"""Scans, sinks and manifests; files go to the session's warehouse, which executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tables import new_path
from ..sources import files
from .registry import query, raw
from .views import read, view


@raw("scan_csv_roundtrip", "SELECT p_partkey, p_name, p_size, p_retailprice FROM part")
def scan_csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "csv")
    read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size", "p_retailprice").write.csv(path, header=True)
    return files.typed_csv(spark, path, "p_partkey bigint, p_name string, p_size int, p_retailprice double")


@raw("scan_text_then_cast", "SELECT p_partkey AS id, CASE WHEN p_partkey % 4 <> 0 THEN p_size END AS size FROM part")
def scan_text_then_cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "text")
    size = F.when(F.col("p_partkey") % 4 == 0, "n/a").otherwise(F.col("p_size").cast("string"))
    read(spark, sf_dir, "part").select("p_partkey", size.alias("size")).write.csv(path, header=True)
    rows = files.text_csv(spark, path, ["p_partkey", "size"])
    return rows.select(F.col("p_partkey").try_cast("bigint").alias("id"), F.col("size").try_cast("int").alias("size"))


@raw("combine_partitions_provenance", "SELECT o_orderstatus AS part, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT o_custkey) AS BIGINT) AS cities FROM orders GROUP BY 1")
def combine_partitions_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "parts")
    orders = read(spark, sf_dir, "orders")
    for state in ("F", "O", "P"):
        orders.where(F.col("o_orderstatus") == state).select("o_orderkey", "o_custkey").write.parquet(f"{path}/part={state}")
    parts = spark.read.parquet(path)
    whole = files.with_provenance(parts).where("source_file IS NOT NULL")
    return whole.groupBy(F.col("part").alias("part")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_custkey").alias("cities"))


@raw("rebuild_combined", "SELECT o_orderkey, o_orderpriority FROM orders")
def rebuild_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.guards import require_unique

    path = new_path(spark, "rebuild")
    files.write_table(read(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), path, ["o_orderpriority"])
    return require_unique(spark.read.parquet(path), ["o_orderkey"]).select("o_orderkey", "o_orderpriority")


@raw("markdown_table_scan", "SELECT n_name AS city, 'REGION_' || n_regionkey AS region FROM nation")
def markdown_table_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "nation").select(F.format_string("| %s | REGION_%s |", "n_name", "n_regionkey").alias("value"), F.col("n_nationkey").alias("n"))
    head = spark.createDataFrame([("| city | region |", -2), ("| --- | :-- |", -1), ("no table", 1000)], "value string, n int")
    return files.markdown_table(head.unionByName(rows), ["city", "region"]).select("city", "region")


#: Ids of a GeoJSON document of the fixture.
IN_DOCUMENT = 250


def _documents(buildings):
    """GeoJSON texts of a few features each, as a footprint provider tiles them."""
    point = lambda x, y: F.array(F.col(x), F.col(y))
    ring = F.array(point("xmin", "ymin"), point("xmax", "ymin"), point("xmax", "ymax"), point("xmin", "ymax"), point("xmin", "ymin"))
    feature = F.struct(F.lit("Feature").alias("type"), F.create_map(F.lit("id"), F.col("id").cast("string")).alias("properties"), F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"))
    texts = buildings.select(F.floor(F.col("id") / IN_DOCUMENT).alias("tile"), feature.alias("f")).groupBy("tile").agg(F.collect_list("f").alias("features"))
    return texts.select("tile", F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), "features")).alias("value"))


@query("geojson_scan", "buildings", sql="SELECT id, xmin, ymin, xmax, ymax FROM buildings")
def geojson_scan(buildings):
    return files.geojson_features(_documents(buildings).select("value")).select(F.col("properties")["id"].cast("bigint").alias("id"), "bbox.xmin", "bbox.ymin", "bbox.xmax", "bbox.ymax")


@query("geojson_aoi_scan", "buildings", sql="SELECT id AS city, CASE WHEN id % 10 = 3 THEN 'not_one_feature' WHEN id % 10 = 7 THEN 'not_polygonal' ELSE 'ok' END AS status, CASE WHEN id % 10 IN (3, 7) THEN NULL ELSE (xmax - xmin) * (ymax - ymin) END AS area FROM buildings")
def geojson_aoi_scan(buildings):
    """One area of interest a text: exactly one feature, a polygon or multipolygon; others are named, not read."""
    point = lambda x, y: F.array(F.col(x), F.col(y))
    ring = F.array(point("xmin", "ymin"), point("xmax", "ymin"), point("xmax", "ymax"), point("xmin", "ymax"), point("xmin", "ymin"))
    kind = lambda name, coordinates: F.struct(F.lit(name).alias("type"), F.to_json(coordinates).alias("coordinates"))
    shape = F.when(F.col("id") % 10 == 7, kind("LineString", ring)).when(F.col("id") % 4 == 1, kind("MultiPolygon", F.array(F.array(ring)))).otherwise(kind("Polygon", F.array(ring)))
    geometry = F.concat(F.lit('{"type":"'), shape["type"], F.lit('","coordinates":'), shape["coordinates"], F.lit("}"))
    feature = F.concat(F.lit('{"type":"Feature","properties":{},"geometry":'), geometry, F.lit("}"))
    times = F.when(F.col("id") % 10 == 3, F.array(feature, feature)).otherwise(F.array(feature))
    texts = buildings.select(F.col("id").alias("city"), F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(times, ","), F.lit("]}")).alias("value"))
    return files.single_polygon(texts, "value").select("city", "status", files.polygon_area(F.col("polygons")).alias("area"))


@raw("file_hash_audit")
def file_hash_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name, size and SHA-256 of every tile file that a run has written (a test holds them against hashlib)."""
    path = new_path(spark, "tiles")
    _documents(view(spark, sf_dir, "buildings")).repartition(4, "tile").sortWithinPartitions("tile").select("value").write.text(path)
    return files.file_hashes(spark, f"{path}/part-*")


@raw("manifest_completeness", """
SELECT o_orderkey * 10 + k AS file FROM orders, (VALUES (0), (1), (2)) AS v(k) WHERE (o_orderkey + k) % 50 = 0""")
def manifest_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that the manifests list and no delivery folder holds; manifests and listings are read from what was delivered."""
    path = new_path(spark, "delivery")
    names = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda k: F.struct((F.col("id") * 10 + k).alias("file"), (F.col("id") + k).alias("s")))
    orders = view(spark, sf_dir, "manifest")
    orders.select("id", F.to_json(F.struct("id", F.transform(names, lambda x: x["file"]).alias("files"))).alias("value")).select("value").write.text(f"{path}/manifests")
    orders.select(F.explode(names).alias("x")).where("x.s % 50 <> 0").select(F.col("x.file").cast("string").alias("value")).write.text(f"{path}/listing")
    listed = spark.read.text(f"{path}/manifests").select(F.explode(F.from_json("value", "id bigint, files array<bigint>")["files"]).alias("file"))
    return files.missing_files(listed, spark.read.text(f"{path}/listing").select(F.col("value").cast("bigint").alias("file")))


@query("cache_miss_then_merge", "manifest", sql="SELECT id, CASE WHEN state = 'F' THEN 'cached' ELSE 'fetched' END AS origin, 'success' AS status FROM manifest")
def cache_miss_then_merge(manifest):
    def fetch(frames):
        for frame in frames:
            yield frame.assign(status="success", origin="fetched")

    cache = manifest.select("id", F.when(F.col("state") == "F", "success").otherwise("failed").alias("status"), F.lit("cached").alias("origin"))
    return files.fetch_missing(manifest.select("id"), cache, "id", fetch, "id long, status string, origin string").select("id", "origin", "status")


@raw("paged_products", "SELECT page_id % 97 AS source_id, url AS link, max(page_id) AS item_id, CAST(arg_max(strlen(coalesce(html, '')), page_id) AS BIGINT) AS bytes FROM pages GROUP BY page_id % 97, url")
def paged_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products as a service lists them page by page; of one source and link the record that came last."""
    from ..sources import paging

    path = new_path(spark, "answers")
    listed = read(spark, sf_dir, "pages").select((F.col("page_id") % 97).alias("source_id"), F.col("url").alias("link"), F.col("page_id").alias("item_id"), F.octet_length(F.coalesce("html", F.lit(""))).cast("long").alias("bytes"))
    paging.record(listed, path, ["item_id"], 100)
    paging.register(spark)
    return paging.latest_items(spark, path, "source_id long, link string, item_id long, bytes long", ["source_id", "link"], 100).select("source_id", "link", "item_id", "bytes")
