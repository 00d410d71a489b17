"""Order requests: one canonical request a city, refused above the item limit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Items of an order at most, the item type, and the product bundle of each asset.
MAX_ITEMS = 500
ITEM_TYPE = "PSScene"
BUNDLES = {"ortho_analytic_4b_sr": "analytic_sr_udm2", "ortho_analytic_8b_sr": "analytic_8b_sr_udm2"}


def _texts(values: Column) -> Column:
    """A JSON array of plain texts."""
    return F.concat(F.lit("["), F.array_join(F.transform(values, lambda v: F.concat(F.lit('"'), v, F.lit('"'))), ","), F.lit("]"))


def order_requests(scenes: DataFrame, prefix: str) -> DataFrame:
    """(city, scene_count, status, order_name, request, request_sha256), one row a city.

    ``scenes`` has (city, scene_id, asset, aoi); aoi is the canonical JSON of the
    city's area. Requests are canonical JSON: keys in order, no blanks; a product
    for each asset, its items in order of their ids as text. The name ends in ten
    digits of the SHA-256 of all ids joined by ``|``. A city is refused, without
    a request, when it has over ``MAX_ITEMS`` scenes, an asset without a bundle, or
    several areas; so ids are gathered for cities of few scenes alone. Repeated
    rows count once.
    """
    own = scenes.select("city", F.col("scene_id").cast("string").alias("scene_id"), "asset", "aoi").distinct()
    known = F.coalesce(F.col("asset").isin(*BUNDLES), F.lit(False))
    counts = own.groupBy("city").agg(F.count_distinct("scene_id").alias("scene_count"), F.min("aoi").alias("area"), (F.min("aoi") != F.max("aoi")).alias("areas_differ"), F.count_if(~known).alias("unknown"))
    status = F.when(F.col("scene_count") > MAX_ITEMS, "refused_too_many_items").when(F.col("unknown") > 0, "refused_unsupported_asset").when(F.coalesce("areas_differ", F.lit(False)), "refused_conflicting_areas").otherwise("validated")
    planned = counts.withColumn("status", status)
    good = own.join(planned.where("status = 'validated'").select("city"), "city", "left_semi")
    by_asset = good.groupBy("city", "asset").agg(F.array_sort(F.collect_set("scene_id")).alias("ids"))  # MAX_ITEMS at most
    bundle = F.element_at(F.create_map(*[F.lit(x) for pair in BUNDLES.items() for x in pair]), F.col("asset"))
    product = F.concat(F.lit('{"item_ids":'), _texts(F.col("ids")), F.lit(f',"item_type":"{ITEM_TYPE}","product_bundle":"'), bundle, F.lit('"}'))
    cities = by_asset.groupBy("city").agg(F.array_sort(F.collect_list(F.struct("asset", product.alias("product")))).alias("products"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("all_ids"))
    met = planned.join(cities, "city", "left")
    name = F.concat_ws("_", F.lit(prefix), F.col("city").cast("string"), F.substring(F.sha2(F.array_join("all_ids", "|"), 256), 1, 10))
    named = met.withColumn("order_name", F.when(F.col("status") == "validated", name))
    products = F.array_join(F.transform("products", lambda p: p["product"]), ",")
    request = F.concat(F.lit('{"name":"'), F.col("order_name"), F.lit('","order_type":"full","products":['), products, F.lit('],"tools":[{"clip":{"aoi":'), F.coalesce("area", F.lit("null")), F.lit("}}]}"))
    return named.withColumn("request", request).select("city", "scene_count", "status", "order_name", "request", F.sha2("request", 256).alias("request_sha256"))
