"""Fixture views: entities of the building-height domain, on the test tables.

Each view is one query text that both Spark and DuckDB read, so an operator and
its oracle see the same rows. Buildings and points fill new blocks of 512 cells as
their tables grow, so that neighbours grow in proportion.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: {k} is the JSON field k of events.props, which the two engines read differently.
VIEWS = {
    "scenes": """
        SELECT event_id AS scene_id, user_id AS city, CAST(1 + event_id % 12 AS INT) AS month,
          CAST(2016 + CAST(floor(event_id / 12) AS BIGINT) % 9 AS INT) AS year, CAST(event_id % 28 AS INT) AS day,
          CAST(CAST({k} AS DOUBLE) * 3.6 AS DOUBLE) AS bearing, CAST(value % 90 AS DOUBLE) AS sun,
          CAST((CAST(floor(event_id / 5) AS BIGINT) % 4) / 200 AS DOUBLE) AS cloud, CAST(100 - (event_id % 9) / 4 AS DOUBLE) AS coverage,
          event_type <> 'error' AS standard, CAST(CASE WHEN user_id % 2 = 0 THEN 1 ELSE -1 END * (user_id % 60) AS DOUBLE) AS lat,
          CAST((event_id % 21) - 10 AS DOUBLE) AS view_angle, CAST(event_id % 3 AS DOUBLE) AS haze,
          CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(event_id % 7 AS DOUBLE) END AS shadow, event_type AS kind, ts, value,
          make_date(CAST(2016 + CAST(floor(event_id / 12) AS BIGINT) % 9 AS INT), CAST(1 + event_id % 12 AS INT), CAST(1 + event_id % 28 AS INT)) AS acquired,
          CASE WHEN event_id % 11 = 0 THEN NULL ELSE CAST(event_id % 101 AS DOUBLE) END AS clear,
          CASE event_id % 5 WHEN 0 THEN 'basic_udm2' WHEN 1 THEN 'ortho_analytic_8b_sr,ortho_analytic_4b_sr' WHEN 2 THEN 'ortho_analytic_8b_sr,basic_udm2' ELSE 'ortho_analytic_4b_sr' END AS assets,
          CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'ortho_analytic_8b_sr' WHEN 2 THEN 'ortho_analytic_8b_sr' ELSE 'ortho_analytic_4b_sr' END AS asset,
          CAST(event_id % 17 AS DOUBLE) AS centre_offset, CAST(event_id % 13 AS DOUBLE) AS clearance
        FROM events""",
    "surveys": """
        SELECT c_custkey AS city, CASE c_custkey % 6 WHEN 0 THEN '2019' WHEN 1 THEN '2014;2017;2019' WHEN 2 THEN '2017-2019' WHEN 3 THEN '2015-2018' WHEN 4 THEN 'unknown' ELSE '2012' END AS years,
          CASE c_custkey % 5 WHEN 0 THEN 'official_campaign_range' WHEN 1 THEN 'exact_official_project_range' WHEN 2 THEN 'year' ELSE 'official_flight_lot_range' END AS precision_kind,
          make_date(CAST(2016 + c_custkey % 9 AS INT), CAST(1 + c_custkey % 12 AS INT), 1) AS survey_start,
          make_date(CAST(2016 + c_custkey % 9 + CAST(floor(c_custkey / 9) AS BIGINT) % 3 AS INT), CAST(1 + c_custkey % 12 AS INT), CAST(2 + c_custkey % 25 AS INT)) AS survey_end
        FROM customer""",
    "cities": """
        SELECT lower(c_name) AS slug, c_custkey AS city, n_name AS country, r_name AS continent, c_acctbal AS population, c_mktsegment AS segment
        FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "buildings_eval": """
        SELECT l_returnflag AS city, l_orderkey AS chip, l_linenumber AS part, l_quantity AS target,
          l_quantity + (l_discount - 0.05) * 100 + (l_tax - 0.04) * 50 AS predicted, l_linestatus AS status, l_shipdate AS shipped
        FROM lineitem""",
    "heights": """
        SELECT l_returnflag AS city, l_orderkey AS id, l_linenumber AS run, CAST(l_quantity - 2 AS DOUBLE) AS official,
          CAST(l_quantity * 0.9 AS DOUBLE) AS p90, CAST(l_quantity * 0.95 - l_linenumber AS DOUBLE) AS p95, CAST(l_quantity AS DOUBLE) AS top
        FROM lineitem""",
    "points": """
        SELECT l_orderkey % 16 AS tile, CAST((l_partkey * 31 + l_linenumber * 17 + CAST(l_quantity AS BIGINT) * 7) % 509 + 512 * CAST(floor(l_orderkey / 15000) AS BIGINT) AS DOUBLE) AS x,
          CAST((l_suppkey * 29 + l_linenumber * 11 + CAST(l_quantity AS BIGINT) * 5 + l_orderkey) % 407 AS DOUBLE) AS y,
          CAST(l_extendedprice / 1000 AS DOUBLE) AS z, CASE l_linenumber % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 6 ELSE 7 END AS class
        FROM lineitem""",
    "buildings": """
        SELECT p_partkey AS id, CAST((p_partkey * 137) % 499 + 512 * CAST(floor(p_partkey / 2000) AS BIGINT) AS DOUBLE) AS xmin, CAST((p_partkey * 59) % 397 AS DOUBLE) AS ymin,
          CAST((p_partkey * 137) % 499 + 512 * CAST(floor(p_partkey / 2000) AS BIGINT) + 1 + p_size % 9 AS DOUBLE) AS xmax, CAST((p_partkey * 59) % 397 + 1 + p_size % 7 AS DOUBLE) AS ymax,
          p_brand AS brand, p_size AS size, p_retailprice AS price
        FROM part""",
    "manifest": """
        SELECT o_orderkey AS id, o_custkey AS city, o_orderstatus AS state, o_orderdate AS placed, o_totalprice AS cost, o_orderpriority AS bundle FROM orders""",
    "order_events": """
        SELECT user_id AS order_id, event_id AS number, ts AS moment, CASE event_id % 40 WHEN 0 THEN 'success' WHEN 1 THEN 'partial' WHEN 2 THEN 'failed' WHEN 3 THEN 'cancelled' WHEN 5 THEN 'lost' ELSE CASE WHEN event_id % 2 = 0 THEN 'queued' ELSE 'running' END END AS state
        FROM events""",
    "chips": """
        SELECT o_orderkey AS chip, o_orderpriority AS city, (o_custkey % 40) * 256 AS row_off, (o_orderkey % 40) * 256 AS col_off, o_totalprice AS worth,
          CAST(o_custkey % 23 AS DOUBLE) AS median_height, CAST(o_custkey % 23 + o_orderkey % 17 AS DOUBLE) AS p90_height, CAST(o_custkey % 23 + o_orderkey % 37 AS DOUBLE) AS max_height, o_orderkey % 9 AS parts
        FROM orders""",
}

#: 8 x 8 grids: 64 numbers of an embedding are the cells of a chip.
PIXELS_DUCKDB = """
    SELECT chip, city, CAST(floor(i / 8) AS INT) AS r, CAST(i % 8 AS INT) AS c, round(CAST(v AS DOUBLE) * 10, 6) AS v, v > 0 AS mask
    FROM (SELECT vec_id AS chip, label AS city, unnest(range(64)) AS i, unnest(embedding[1:64]) AS v FROM embeddings)"""


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture view, or a plain table, as a DataFrame."""
    if name == "pixels":
        return spark.sql(
            """SELECT vec_id AS chip, label AS city, CAST(floor(i / 8) AS INT) AS r, CAST(i % 8 AS INT) AS c,
                 round(CAST(v AS DOUBLE) * 10, 6) AS v, v > 0 AS mask
               FROM {e} LATERAL VIEW posexplode(slice(embedding, 1, 64)) AS i, v""",
            e=read(spark, sf_dir, "embeddings"),
        )
    if name not in VIEWS:
        return read(spark, sf_dir, name)
    import re

    text = VIEWS[name].replace("{k}", "get_json_object(props, '$.k')")
    used = [t for t in TABLES if re.search(rf"(FROM|JOIN) {t}\b", text)]
    for t in used:
        text = re.sub(rf"(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", text)
    return spark.sql(text, **{t: read(spark, sf_dir, t) for t in used})


def with_views(*names: str) -> str:
    """The head of an oracle query: the views as common table expressions."""
    texts = {**VIEWS, "pixels": PIXELS_DUCKDB}
    return "WITH " + ",\n".join(f"{n} AS ({texts[n].replace('{k}', chr(39).join(['json_extract_string(props, ', '$.k', ')']))})" for n in names) + "\n"
