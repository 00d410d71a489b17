"""Ranks, shortlists, greedy selection, splits, sorts and state."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import guards, metrics, ordering, selection, splitting
from ..operators import scenes as rules
from .filters import SEASON_SQL, SECTOR_SQL, TIER_SQL
from .registry import query


@query("hash_rank", "cities", sql="SELECT slug, CAST(row_number() OVER (ORDER BY sha256('419453:' || slug), slug) AS BIGINT) AS rank FROM cities")
def hash_rank(cities):
    return splitting.hash_rank(cities.select("slug"), "slug", 419453)


@query("hash_split", "cities", sql="""
, r AS (SELECT slug, row_number() OVER (ORDER BY sha256('419453:' || slug), slug) AS n FROM cities)
SELECT slug, CASE WHEN n <= 700 THEN 'training' WHEN n <= 1200 THEN 'validation' ELSE 'testing' END AS split FROM r""")
def hash_split(cities):
    return splitting.hash_split(cities, "slug", 419453, [("training", 700), ("validation", 500)], "testing").select("slug", "split")


@query("split_summary", "cities", sql="""
, r AS (SELECT *, row_number() OVER (ORDER BY sha256('419453:' || slug), slug) AS n FROM cities),
s AS (SELECT *, CASE WHEN n <= 700 THEN 'training' WHEN n <= 1200 THEN 'validation' ELSE 'testing' END AS split FROM r)
SELECT split, CAST(count(*) AS BIGINT) AS cities, round(sum(population), 2) AS population, CAST(count(*) FILTER (WHERE segment = 'MACHINERY') AS BIGINT) AS machinery FROM s GROUP BY split""")
def split_summary(cities):
    split = splitting.hash_split(cities, "slug", 419453, [("training", 700), ("validation", 500)], "testing")
    return split.groupBy("split").agg(F.count(F.lit(1)).alias("cities"), F.round(F.sum("population"), 2).alias("population"), F.count_if(F.col("segment") == "MACHINERY").alias("machinery"))


@query("fraction_split", "chips", sql="""
, r AS (SELECT chip, city, count(*) OVER (PARTITION BY city) AS k, row_number() OVER (PARTITION BY city ORDER BY sha256('7:' || chip), chip) AS i FROM chips)
SELECT chip, CASE WHEN i <= floor(k * CAST(0.7 AS DOUBLE)) THEN 'train' WHEN i <= floor(k * CAST(0.7 AS DOUBLE)) + floor(k * CAST(0.15 AS DOUBLE)) THEN 'validation' ELSE 'test' END AS split FROM r""")
def fraction_split(chips):
    return splitting.fraction_split(chips, "chip", "city", 7).select("chip", "split")


@query("stratified_folds", "chips", sql="SELECT chip, CAST((row_number() OVER (PARTITION BY city, row_off ORDER BY sha256('3:' || chip), chip) - 1) % 5 AS INT) AS fold FROM chips")
def stratified_folds(chips):
    return splitting.folds(chips, "chip", ["city", "row_off"], 5, 3).select("chip", "fold")


def _draw(below: str, *keys: str) -> str:
    """A hashed number in DuckDB's SQL."""
    return f"(CAST('0x' || sha256({" || ':' || ".join(keys)})[1:12] AS BIGINT) % {below})"


@query("bootstrap_draws", "chips", sql=f"""
, n AS (SELECT chip, worth, row_number() OVER (ORDER BY sha256('20260625:' || chip), chip) AS number FROM chips),
d AS (SELECT CAST(i // 500 AS INT) AS run, CAST(i % 500 AS INT) AS draw FROM range(7500) t(i)),
w AS (SELECT run, draw, 1 + {_draw("(SELECT count(*) FROM chips)", "'20260625'", "run", "draw")} AS number FROM d)
SELECT run, draw, chip, worth FROM w JOIN n USING (number)""")
def bootstrap_draws(chips):
    return splitting.bootstrap(chips.select("chip", "worth"), "chip", runs=15, draws=500, seed=20260625)


CATEGORY_SQL = "CASE WHEN p90_height >= 30 OR max_height >= 50 THEN 'highrise' WHEN p90_height >= 10 THEN 'midrise' ELSE 'lowrise' END"


def _categories(chips):
    return chips.withColumn("category", scalars.height_category(F.col("p90_height"), F.col("max_height")))


@query("balanced_batches", "chips", sql=f"""
, k AS (SELECT chip, city, {CATEGORY_SQL} AS category FROM chips WHERE city IN ('1-URGENT', '2-HIGH')),
n AS (SELECT *, row_number() OVER (PARTITION BY city, category ORDER BY chip) - 1 AS number, count(*) OVER (PARTITION BY city, category) AS size FROM k),
p AS (SELECT unnest(range(8)) AS slot), b AS (SELECT unnest(range(CAST(ceil((SELECT count(*) FROM k) / 8) AS BIGINT))) AS batch),
w AS (SELECT batch, slot, CASE WHEN slot < 4 THEN '1-URGENT' ELSE '2-HIGH' END AS city, ['lowrise', 'lowrise', 'midrise', 'highrise'][slot % 4 + 1] AS category FROM b, p),
d AS (SELECT w.*, {_draw("size", "'20260722'", "batch", "slot")} AS number FROM w JOIN (SELECT DISTINCT city, category, size FROM n) USING (city, category))
SELECT batch, CAST(slot AS INT) AS slot, city, category, chip FROM d JOIN n USING (city, category, number)""")
def balanced_batches(chips):
    """Batches of two low, one mid and one high chip of each of two cities."""
    return splitting.balanced_batches(_categories(chips), "chip", "city", "category", ["1-URGENT", "2-HIGH"], 20260722)


@query("highrise_oversample", "chips", sql=f"""
, k AS (SELECT chip, city, p90_height >= 30 OR max_height >= 50 AS high FROM chips),
n AS (SELECT *, row_number() OVER (PARTITION BY city, high ORDER BY chip) - 1 AS number, count(*) OVER (PARTITION BY city, high) AS size, row_number() OVER (PARTITION BY city, high ORDER BY sha256('11:' || chip), chip) - 1 AS turn FROM k),
h AS (SELECT DISTINCT city, size AS highs FROM n WHERE high), w AS (SELECT city, highs, unnest(range(40)) AS draw FROM h),
d AS (SELECT city, draw, {_draw("highs", "'11'", "city", "draw")} AS number FROM w WHERE draw < 20)
SELECT d.city, CAST(d.draw AS INT) AS draw, n.chip FROM d JOIN n ON n.city = d.city AND n.high AND n.number = d.number
UNION ALL SELECT w.city, CAST(w.draw AS INT), n.chip FROM w JOIN n ON n.city = w.city AND NOT n.high AND n.turn = w.draw - 20 WHERE w.draw >= 20""")
def highrise_oversample(chips):
    """40 chips a city, half of them high-rise with replacement."""
    flagged = chips.select("chip", "city", ((F.col("p90_height") >= 30) | (F.col("max_height") >= 50)).alias("high"))
    return splitting.oversample(flagged, "chip", "city", "high", 40, 0.5, 11)


@query("template_split", "chips", sql="""
, r AS (SELECT chip, count(*) OVER (PARTITION BY city) AS k, row_number() OVER (PARTITION BY city ORDER BY sha256('7:' || chip), chip) AS i, city FROM chips)
SELECT chip, city, CASE WHEN i <= floor(k * CAST(0.7 AS DOUBLE)) THEN 'train' WHEN i <= floor(k * CAST(0.7 AS DOUBLE)) + floor(k * CAST(0.15 AS DOUBLE)) THEN 'validation' ELSE 'test' END AS split FROM r""")
def template_split(chips):
    """A new dataset of the same chips takes the split of an older one, which must cover it exactly."""
    template = splitting.fraction_split(chips, "chip", "city", 7).select("chip", "split")
    wrong = guards.exact_cover(chips, template, "chip").limit(5).collect()
    if wrong:
        raise ValueError(f"the template does not cover the chips: {wrong}")
    return guards.many_to_one(chips.select("chip", "city"), template, ["chip"])


@query("plot_subsample", "buildings_eval", sql="SELECT chip, part, target, predicted FROM buildings_eval ORDER BY sha256('17:' || chip || ':' || part), chip, part LIMIT 2000")
def plot_subsample(rows):
    """2,000 rows without replacement, by hash."""
    return rows.orderBy(splitting.seeded(17, "chip", "part"), "chip", "part").limit(2000).select("chip", "part", "target", "predicted")


@query("epoch_chip_lookup", "buildings_eval", sql="SELECT a.chip, a.part AS epoch, a.target, b.predicted AS at_first FROM buildings_eval a LEFT JOIN buildings_eval b ON a.chip = b.chip AND b.part = 1")
def epoch_chip_lookup(rows):
    """Each row with the prediction of its chip in the first epoch, looked up by (epoch, chip)."""
    first = rows.select("chip", F.col("part").alias("epoch"), F.col("predicted").alias("at_first"))
    wanted = rows.select("chip", F.col("part").alias("own_epoch"), "target", F.lit(1).cast("long").alias("epoch"))
    return wanted.join(first.withColumn("epoch", F.col("epoch").cast("long")), ["epoch", "chip"], "left").select("chip", F.col("own_epoch").alias("epoch"), "target", "at_first")


def _block_sql() -> str:
    edges = [*zip(splitting.BIN_EDGES, [*splitting.BIN_EDGES[1:], 10**9], strict=True)]
    bins = ", ".join(f"CAST(sum(CASE WHEN p90_height >= {a} AND p90_height < {b} THEN parts ELSE 0 END) AS DOUBLE) AS bin{i}" for i, (a, b) in enumerate(edges))
    has = ", ".join(f"max(CAST(category = '{c}' AS INT)) AS has{i}" for i, c in enumerate(splitting.CATEGORIES))
    names = ["chips", "buildings", "f0", "f1", "f2", "has0", "has1", "has2", *[f"bin{i}" for i in range(6)]]
    both = ", ".join(f"sum({c}) AS {c}" for c in names)
    whole = ", ".join(f"sum({c}) AS all_{c}" for c in names)
    binned = " + ".join(f"(bin{i} / b1 - all_bin{i} / b2) ** 2 / (all_bin{i} / b2 + 0.02)" for i in range(6))
    featured = " + ".join(f"((f{i} / chips - all_f{i} / all_chips) / greatest(abs(all_f{i} / all_chips), 1)) ** 2" for i in range(3))
    lacks = " + ".join(f"CAST(all_has{i} >= 3 AND has{i} = 0 AS INT)" for i in range(3))
    return f"""
, k AS (SELECT *, {CATEGORY_SQL} AS category, row_off // 1024 AS r, col_off // 1024 AS c FROM chips),
b AS (SELECT city, r, c, count(*) AS chips, CAST(sum(parts) AS DOUBLE) AS buildings, sum(median_height) AS f0, sum(p90_height) AS f1, sum(ln(1 + max_height)) AS f2, {has}, {bins} FROM k GROUP BY ALL),
s AS (SELECT *, count(*) OVER (PARTITION BY city) AS n, greatest(4, round_even(count(*) OVER (PARTITION BY city) * 0.15, 0)) AS few FROM b),
t AS (SELECT *, row_number() OVER (PARTITION BY attempt, city ORDER BY sha256('5:' || attempt || ':' || city || ':' || r || ':' || c), r, c) AS turn FROM (SELECT *, unnest(range(64)) AS attempt FROM s)),
a AS (SELECT *, CASE WHEN turn <= n - 2 * few THEN 'train' WHEN turn <= n - few THEN 'val' ELSE 'test' END AS split FROM t),
w AS (SELECT city, {whole} FROM b GROUP BY city),
p AS (SELECT attempt, city, split, {both} FROM a GROUP BY ALL),
q AS (SELECT *, CASE split WHEN 'train' THEN 0.7 ELSE 0.15 END AS goal, greatest(bin0 + bin1 + bin2 + bin3 + bin4 + bin5, 1) AS b1, greatest(all_bin0 + all_bin1 + all_bin2 + all_bin3 + all_bin4 + all_bin5, 1) AS b2 FROM p JOIN w USING (city)),
z AS (SELECT attempt, sum({lacks}) AS lacks, round(sum(20 * (chips / all_chips - goal) ** 2 + 8 * (buildings / greatest(all_buildings, 1) - goal) ** 2 + ({binned}) / 6 + 0.5 * ({featured}) / 3), 9) AS score FROM q GROUP BY attempt),
best AS (SELECT attempt, score FROM z WHERE lacks = 0 ORDER BY score, attempt LIMIT 1)
SELECT city, CAST(r AS BIGINT) AS r, CAST(c AS BIGINT) AS c, split, CAST(attempt AS INT) AS attempt, score FROM a JOIN best USING (attempt)"""


@query("block_split_search", "chips", sql=_block_sql())
def block_split_search(chips):
    """Of 64 shuffled assignments of 1,024-cell blocks to the splits, the feasible one of the best score."""
    cut = _categories(chips).withColumns({"r": F.floor(F.col("row_off") / 1024), "c": F.floor(F.col("col_off") / 1024)})
    blocks = splitting.block_features(cut, "city", ["r", "c"], "median_height", "p90_height", "max_height", "category", "p90_height", "parts")
    return splitting.block_split(blocks, "city", ["r", "c"], 64, 5)


@query("topn_per_group", "scenes", sql="SELECT city, scene_id, CAST(n AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY city ORDER BY cloud, coverage DESC, scene_id) AS n FROM scenes) WHERE n <= 2")
def topn_per_group(scenes):
    return selection.top_n(scenes, ["city"], [F.col("cloud"), F.desc("coverage"), F.col("scene_id")], 2).select("city", "scene_id", "rank")


@query("group_size_window", "buildings", sql="SELECT id, CAST(count(*) OVER (PARTITION BY brand, size) AS BIGINT) AS n, count(*) OVER (PARTITION BY brand, size) > 1 AS was_merged FROM buildings")
def group_size_window(buildings):
    n = F.count(F.lit(1)).over(Window.partitionBy("brand", "size"))
    return buildings.select("id", n.alias("n"), (n > 1).alias("was_merged"))


NORM_SQL = "CASE WHEN max({0}) OVER w > min({0}) OVER w THEN ({0} - min({0}) OVER w) / (max({0}) OVER w - min({0}) OVER w) ELSE 0 END"


@query("offnadir_rank", "scenes", sql=f"""
, p AS (SELECT *, coalesce(clear, 0) AS clear0 FROM scenes WHERE view_angle >= 3 AND cloud <= 0.01),
s AS (SELECT *, round(CAST(0.6 AS DOUBLE) * ({NORM_SQL.format("view_angle")}) + CAST(0.25 AS DOUBLE) * ({NORM_SQL.format("centre_offset")}) + CAST(0.1 AS DOUBLE) * ({NORM_SQL.format("clear0")}) + CAST(0.05 AS DOUBLE) * ({NORM_SQL.format("clearance")}), 12) AS score
  FROM p WINDOW w AS (PARTITION BY city))
SELECT city, scene_id, round(score, 9) AS score, CAST(row_number() OVER (PARTITION BY city ORDER BY score DESC, view_angle DESC, centre_offset DESC, acquired DESC, scene_id) AS INT) AS rank FROM s""")
def offnadir_rank(scenes):
    pool = scenes.where("view_angle >= 3 AND cloud <= 0.01").withColumn("clear0", F.coalesce("clear", F.lit(0.0)))
    weights = {"view_angle": 0.60, "centre_offset": 0.25, "clear0": 0.10, "clearance": 0.05}
    ties = [F.desc("view_angle"), F.desc("centre_offset"), F.desc("acquired"), F.col("scene_id")]
    return rules.off_nadir_rank(pool, ["city"], weights, ties).select("city", "scene_id", F.round("score", 9).alias("score"), "rank")


@query("min_adjacent_gap", "scenes", sql="SELECT city, year, round(min(g), 6) AS gap FROM (SELECT city, year, sun - lag(sun) OVER (PARTITION BY city, year ORDER BY sun) AS g FROM scenes) GROUP BY ALL")
def min_adjacent_gap(scenes):
    """Null where a city has under two scenes in the year."""
    gap = F.col("sun") - F.lag("sun").over(Window.partitionBy("city", "year").orderBy("sun"))
    return scenes.withColumn("g", gap).groupBy("city", "year").agg(F.round(F.min("g"), 6).alias("gap"))


@query("first_seen_label", "buildings", sql="SELECT id, CAST(dense_rank() OVER (ORDER BY first) AS BIGINT) AS label FROM (SELECT id, min(id) OVER (PARTITION BY brand) AS first FROM buildings)")
def first_seen_label(buildings):
    # One row a group is ranked, then joined back.
    first = buildings.groupBy("brand").agg(F.min("id").alias("first"))
    return buildings.join(ordering.numbered(first, ["first"], "label"), "brand").select("id", "label")


@query("sequential_id", "buildings", sql="SELECT id, lower(replace(brand, '#', '_')) || '_' || lpad(CAST(row_number() OVER (PARTITION BY brand ORDER BY id) AS VARCHAR), 8, '0') AS code FROM buildings")
def sequential_id(buildings):
    rows, _ = splitting.pooled(buildings.select("id", "brand"), "id", ["brand"])
    return rows.select("id", F.concat_ws("_", F.lower(F.replace("brand", F.lit("#"), F.lit("_"))), F.lpad((F.col("pool_number") + 1).cast("string"), 8, "0")).alias("code"))


@query("ks_distance", "buildings_eval", sql="""
, v AS (SELECT target AS v, count(*) FILTER (WHERE city = 'A') AS a, count(*) FILTER (WHERE city = 'R') AS b FROM buildings_eval WHERE city IN ('A', 'R') GROUP BY target)
SELECT round(max(abs(x)), 6) AS ks FROM (SELECT sum(a) OVER (ORDER BY v) / sum(a) OVER () - sum(b) OVER (ORDER BY v) / sum(b) OVER () AS x FROM v)""")
def ks_distance(rows):
    return metrics.ks_distance(rows, "target", "city", "A", "R")


@query("quantile_distance", "buildings_eval", sql="""
, q AS (SELECT quantile_cont(target, list_transform(range(0, 1001), lambda i: i / 1000)) FILTER (WHERE city = 'A') AS a, quantile_cont(target, list_transform(range(0, 1001), lambda i: i / 1000)) FILTER (WHERE city = 'R') AS b FROM buildings_eval)
SELECT round(list_sum(list_transform(range(1, 1002), lambda i: abs(a[i] - b[i]))) / 1001, 6) AS distance FROM q""")
def quantile_distance(rows):
    return metrics.quantile_distance(rows, "target", "city", "A", "R")


@query("median_row", "scenes", sql="SELECT city, scene_id FROM (SELECT city, scene_id, row_number() OVER (PARTITION BY city ORDER BY sun, scene_id) AS n, count(*) OVER (PARTITION BY city) AS k FROM scenes) WHERE n = k // 2 + 1")
def median_row(scenes):
    w = Window.partitionBy("city")
    ranked = scenes.select("city", "scene_id", F.row_number().over(w.orderBy("sun", "scene_id")).alias("n"), F.count(F.lit(1)).over(w).alias("k"))
    return ranked.where("n = floor(k / 2) + 1").select("city", "scene_id")


@query("visual_pick", "buildings_eval", sql="""
, e AS (SELECT city, chip, avg(target) AS t, avg(abs(predicted - target)) AS e FROM buildings_eval GROUP BY ALL),
p AS (SELECT city, arg_max(chip, (round(t, 6), -chip)) AS chip, 'tallest' AS reason FROM e GROUP BY city UNION ALL SELECT city, arg_max(chip, (round(e, 6), -chip)), 'worst' FROM e GROUP BY city)
SELECT city, chip, string_agg(reason, ';' ORDER BY reason) AS reasons FROM p GROUP BY ALL""")
def visual_pick(rows):
    chips = rows.groupBy("city", "chip").agg(F.round(F.avg("target"), 6).alias("t"), F.round(F.avg(F.abs(F.col("predicted") - F.col("target"))), 6).alias("e"))
    best = lambda c: F.max_by("chip", F.struct(c, -F.col("chip")))
    picked = chips.groupBy("city").agg(best("t").alias("tallest"), best("e").alias("worst")).unpivot("city", ["tallest", "worst"], "reason", "chip")
    return picked.groupBy("city", "chip").agg(F.array_join(F.array_sort(F.collect_list("reason")), ";").alias("reasons"))


@query("running_best", "manifest", sql="""
, e AS (SELECT city, id, cost, min(cost) OVER (PARTITION BY city ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM manifest)
SELECT city, id, least(cost, coalesce(b, cost)) AS best, b IS NULL OR cost < b AS improved, last_value(CASE WHEN b IS NULL OR cost < b THEN id END IGNORE NULLS) OVER (PARTITION BY city ORDER BY id ROWS UNBOUNDED PRECEDING) AS best_at FROM e""")
def running_best(manifest):
    return selection.running_best(manifest, "city", "id", "cost").select("city", "id", "best", "improved", "best_at")


@query("consecutive_run", "manifest", sql="""
, i AS (SELECT city, id, cost > 200000 AS f, sum(CASE WHEN cost > 200000 THEN 0 ELSE 1 END) OVER (PARTITION BY city ORDER BY id) AS island FROM manifest)
SELECT city, id, CAST(sum(CAST(f AS INT)) OVER (PARTITION BY city, island ORDER BY id) AS BIGINT) AS run FROM i""")
def consecutive_run(manifest):
    return selection.consecutive(manifest, "city", "id", F.col("cost") > 200000).select("city", "id", "run")


@query("repeat_flag", "scenes", sql="SELECT scene_id, row_number() OVER (PARTITION BY city, year ORDER BY cloud, scene_id) > 1 AS repeated FROM scenes")
def repeat_flag(scenes):
    return scenes.select("scene_id", (F.row_number().over(Window.partitionBy("city", "year").orderBy("cloud", "scene_id")) > 1).alias("repeated"))


@query("multi_key_sort_topk", "scenes", sql="SELECT scene_id, city, cloud, coverage FROM scenes ORDER BY cloud, coverage DESC, city, sun DESC, scene_id LIMIT 100")
def multi_key_sort_topk(scenes):
    return scenes.orderBy("cloud", F.desc("coverage"), "city", F.desc("sun"), "scene_id").limit(100).select("scene_id", "city", "cloud", "coverage")


@query("category_order", "manifest", sql="SELECT state, CAST(row_number() OVER (ORDER BY list_position(['P', 'O', 'F'], state)) AS INT) AS place, CAST(count(*) AS BIGINT) AS n FROM manifest GROUP BY state")
def category_order(manifest):
    counts = manifest.groupBy("state").agg(F.count(F.lit(1)).alias("n"))
    place = F.array_position(F.array(F.lit("P"), F.lit("O"), F.lit("F")), F.col("state"))
    return counts.select("state", F.row_number().over(Window.orderBy(place)).alias("place"), "n")


@query("topk_review", "buildings", sql="SELECT id, price FROM buildings ORDER BY price DESC, id LIMIT 40")
def topk_review(buildings):
    return buildings.select("id", "price").orderBy(F.desc("price"), "id").limit(40)


SHORT_SQL = f"""
, cand AS (
  SELECT city, scene_id, CAST(scene_id AS VARCHAR) AS sid, year, {SECTOR_SQL} AS direction, {SEASON_SQL} AS season, {TIER_SQL} AS tier, sun, asset, view_angle, cloud, coverage, coalesce(shadow, 0) + coalesce(haze, 0) AS penalty
  FROM scenes WHERE standard AND {SEASON_SQL} IS NOT NULL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY city ORDER BY tier, cloud, coverage DESC, view_angle DESC, penalty, sid) AS k FROM cand),
guarded AS (
  SELECT *, CASE WHEN row_number() OVER (PARTITION BY city, year, season, direction ORDER BY k) <= 2 THEN 0 WHEN row_number() OVER (PARTITION BY city, season ORDER BY k) <= 5 THEN 1
    WHEN row_number() OVER (PARTITION BY city, direction ORDER BY k) <= 2 THEN 2 ELSE 3 END AS level FROM ranked),
short AS (SELECT *, row_number() OVER (PARTITION BY city ORDER BY level, k) AS position FROM guarded)"""


@query("protected_shortlist", "scenes", sql=f"{SHORT_SQL} SELECT city, scene_id, CAST(position AS INT) AS position FROM short WHERE position <= 12")
def protected_shortlist(scenes):
    return rules.shortlist(rules.candidates(scenes), 12).select("city", "scene_id", "position")


@query("fallback_pool", "scenes", sql="SELECT city, scene_id, relaxed FROM (SELECT *, max(CAST(cloud = 0 AND coverage = 100 AND month = 6 AS INT)) OVER (PARTITION BY city) = 0 AS relaxed FROM scenes) WHERE relaxed OR (cloud = 0 AND coverage = 100 AND month = 6)")
def fallback_pool(scenes):
    strict = (F.col("cloud") == 0) & (F.col("coverage") == 100) & (F.col("month") == 6)
    return selection.fallback_pool(scenes, ["city"], strict).select("city", "scene_id", "relaxed")


#: A slot's season and direction, and the counts of what was chosen, in DuckDB's SQL.
GREEDY_SQL = f"""
{SHORT_SQL},
pool AS (SELECT city, list({{'sid': sid, 'id': scene_id, 'year': year, 'season': season, 'direction': direction, 'tier': tier, 'sun': sun, 'four': asset <> 'ortho_analytic_8b_sr', 'view': view_angle, 'cloud': cloud, 'coverage': coverage, 'penalty': penalty}}) AS cs
  FROM short WHERE position <= 60 AND asset IS NOT NULL GROUP BY city),
walk AS (
  WITH RECURSIVE r AS (
    SELECT city, cs, 0 AS slot, list_filter(cs, lambda x: false) AS chosen FROM pool
    UNION ALL
    SELECT city, cs, slot + 1, list_append(chosen, list_sort(list_transform(list_filter(cs, lambda x: NOT list_contains(list_transform(chosen, lambda y: y.sid), x.sid)), lambda x: {{
      'a': len(list_filter(chosen, lambda y: y.year = x.year)) > 0,
      'b': CASE WHEN len(list_filter(chosen, lambda y: y.season = x.season)) >= CASE x.season WHEN 'summer' THEN 5 ELSE 4 END THEN 2 WHEN x.season = ['summer', 'winter'][slot % 2 + 1] THEN 0 ELSE 1 END,
      'c': CASE WHEN slot = 8 THEN CASE WHEN len(list_filter(chosen, lambda y: y.direction = x.direction)) < 2 THEN 0 ELSE 1 END
        WHEN len(list_filter(chosen, lambda y: y.direction = x.direction)) >= 2 THEN 2 WHEN x.direction = ['N', 'S', 'E', 'W'][slot % 4 + 1] THEN 0 ELSE 1 END,
      'd': x.tier, 'e': -round_even(coalesce(list_min(list_transform(chosen, lambda y: abs(y.sun - x.sun))), 90.0), 8), 'f': x.four, 'g': -abs(x.view), 'h': x.cloud, 'i': -x.coverage, 'j': x.penalty, 'k': x.sid, 'x': x}}))[1].x)
    FROM r WHERE slot < 9 AND len(cs) > slot)
  SELECT city, chosen FROM r QUALIFY row_number() OVER (PARTITION BY city ORDER BY slot DESC) = 1)
SELECT city, CAST(unnest(range(1, len(chosen) + 1)) AS INT) AS slot, unnest(list_transform(chosen, lambda y: y.id)) AS scene_id FROM walk"""


@query("greedy_select", "scenes", sql=GREEDY_SQL)
def greedy_select(scenes):
    """Up to nine scenes a city: new years first, then season and direction slots, tier, and sun elevations far apart."""
    return rules.select(scenes).select("city", "slot", "scene_id")


def _eight_sql(by: str, pool: str, first: str, out: str) -> str:
    """The walk over eight slots of each ``by`` of the pool, in DuckDB's SQL."""
    fields = "'sid': sid, 'id': scene_id, 'year': year, 'season': season, 'direction': direction, 'tier': tier, 'sun': sun, 'four': asset <> 'ortho_analytic_8b_sr', 'view': view_angle, 'cloud': cloud, 'coverage': coverage, 'penalty': penalty, 'level': level, 'distance': distance"
    return f"""
, y AS (
  SELECT city, CAST(year(survey_end) AS INT) AS end_year, CASE WHEN contains(years, ';') THEN list_transform(list_filter(string_split(years, ';'), lambda x: regexp_full_match(x, '\\d{{4}}')), lambda x: CAST(x AS INT)) WHEN regexp_full_match(years, '\\d{{4}}') THEN [CAST(years AS INT)]
    WHEN regexp_full_match(years, '\\d{{4}}-\\d{{4}}') AND precision_kind IN ('exact_official_project_range', 'official_flight_lot_range') THEN list_transform(string_split(years, '-'), lambda x: CAST(x AS INT)) ELSE [] END AS documented FROM surveys),
base AS (
  SELECT s.city, scene_id, CAST(scene_id AS VARCHAR) AS sid, year, {SECTOR_SQL} AS direction, coalesce({SEASON_SQL}, 'other') AS season, {TIER_SQL} AS tier, sun, asset, view_angle, cloud, coverage, coalesce(shadow, 0) + coalesce(haze, 0) AS penalty, end_year, documented
  FROM scenes s JOIN y ON s.city = y.city WHERE standard),
cand AS ({pool}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY level, distance, tier, cloud, coverage DESC, view_angle DESC, penalty, sid) AS k FROM cand),
short AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY guarded > 2, k) AS position FROM (SELECT *, row_number() OVER (PARTITION BY {by}, level, season, direction ORDER BY k) AS guarded FROM ranked)),
pool AS (SELECT {by}, list({{{fields}}}) AS cs FROM short WHERE position <= 120 AND asset IS NOT NULL GROUP BY {by}),
walk AS (
  WITH RECURSIVE r AS (
    SELECT {by}, cs, 0 AS slot, list_filter(cs, lambda x: false) AS chosen FROM pool
    UNION ALL
    SELECT {by}, cs, slot + 1, list_append(chosen, list_sort(list_transform(list_filter(cs, lambda x: NOT list_contains(list_transform(chosen, lambda y: y.sid), x.sid)), lambda x: {{
      {first}
      'b': CASE WHEN x.season = 'other' THEN 1 WHEN len(list_filter(chosen, lambda y: y.season = x.season)) >= 4 THEN 2 WHEN x.season = ['summer', 'winter'][slot % 2 + 1] THEN 0 ELSE 1 END,
      'c': CASE WHEN len(list_filter(chosen, lambda y: y.direction = x.direction)) >= 2 THEN 2 WHEN x.direction = ['N', 'S', 'E', 'W'][slot % 4 + 1] THEN 0 ELSE 1 END,
      'd': x.tier, 'e': -round_even(coalesce(list_min(list_transform(chosen, lambda y: abs(y.sun - x.sun))), 90.0), 8), 'f': x.four, 'g': -abs(x.view), 'h': x.cloud, 'i': -x.coverage, 'j': x.penalty, 'k': x.sid, 'x': x}}))[1].x)
    FROM r WHERE slot < 8 AND len(cs) > slot)
  SELECT {by}, chosen FROM r QUALIFY row_number() OVER (PARTITION BY {by} ORDER BY slot DESC) = 1),
flat AS (SELECT {by}, CAST(unnest(range(1, len(chosen) + 1)) AS INT) AS slot, unnest(chosen) AS x FROM walk)
SELECT {out} FROM flat"""


@query("select_city_total", "scenes", "surveys", sql=_eight_sql(
    "city",
    "SELECT *, CASE WHEN list_contains(documented, year) THEN 0 WHEN year > end_year THEN 1 ELSE 2 END + CASE WHEN season = 'other' THEN 3 ELSE 0 END AS level, CASE WHEN list_contains(documented, year) THEN 0 ELSE abs(year - end_year) END AS distance FROM base",
    "'level': x.level, 'distance': x.distance,",
    "city, slot, x.id AS scene_id, x.level AS level, x.distance AS distance, row_number() OVER (PARTITION BY city, x.year ORDER BY slot) > 1 AS repeated"))
def select_city_total(scenes, surveys):
    """Up to eight scenes a city by their level and distance from its survey, then by slots."""
    return rules.select_city_total(scenes, surveys)


@query("select_same_year", "scenes", "surveys", sql=_eight_sql(
    "city, year", "SELECT *, 0 AS level, 0 AS distance FROM base WHERE season <> 'other' AND list_contains(documented, year) AND year >= 2016", "", "city, year AS survey_year, slot, x.id AS scene_id"))
def select_same_year(scenes, surveys):
    """Up to eight solstice scenes of each survey year of a city."""
    return rules.select_same_year(scenes, surveys)


@query("resume_pending", "manifest", sql="SELECT id, city FROM manifest WHERE id NOT IN (SELECT id FROM manifest WHERE state = 'F')")
def resume_pending(manifest):
    return manifest.join(manifest.where("state = 'F'").select("id"), "id", "left_anti").select("id", "city")


@query("latest_state", "manifest", sql="SELECT city, arg_max(state, (placed, id)) AS state, CAST(count(*) AS BIGINT) AS changes FROM manifest GROUP BY city")
def latest_state(manifest):
    return manifest.groupBy("city").agg(F.max_by("state", F.struct("placed", "id")).alias("state"), F.count(F.lit(1)).alias("changes"))


@query("tumbling_count", "events", sql="SELECT time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '2024-01-01') AS start, event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling_count(events):
    from ..streaming.windows import hourly

    return hourly(events).select("start", "event_type", "n", F.round("total", 4).alias("total"))


@query("sliding_count", "events", sql="""
, w AS (SELECT event_type, value, time_bucket(INTERVAL 15 MINUTE, ts, TIMESTAMP '2024-01-01') - INTERVAL 15 MINUTE * unnest(range(4)) AS start FROM events)
SELECT start, event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS total FROM w GROUP BY ALL""")
def sliding_count(events):
    """Counts an hour, each quarter of an hour."""
    from ..streaming.windows import sliding

    return sliding(events).select("start", "event_type", "n", F.round("total", 4).alias("total"))


@query("session_count", "events", sql="""
, p AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events),
s AS (SELECT user_id, ts, count(*) FILTER (WHERE before IS NULL OR ts > before + INTERVAL 30 MINUTE) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM p)
SELECT min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS stop, user_id, CAST(count(*) AS BIGINT) AS n FROM s GROUP BY user_id, k""")
def session_count(events):
    """Each user's sessions, which end when half an hour passes without an event."""
    from ..streaming.windows import sessions

    return sessions(events)


@query("order_states", "order_events", sql="""
, t AS (SELECT order_id, min({'moment': moment, 'number': number}) AS stop FROM order_events WHERE state IN ('success', 'partial', 'failed', 'cancelled') GROUP BY order_id),
m AS (SELECT e.*, t.stop IS NULL OR {'moment': moment, 'number': number} <= t.stop AS taken FROM order_events e LEFT JOIN t USING (order_id)),
s AS (SELECT order_id, max({'moment': moment, 'number': number, 'state': state}) FILTER (WHERE taken) AS last, count(*) FILTER (WHERE taken) AS accepted, count(*) FILTER (WHERE NOT taken) AS ignored FROM m GROUP BY order_id)
SELECT order_id, last.state AS state, last.moment AS "at", CAST(accepted AS BIGINT) AS accepted, CAST(ignored AS BIGINT) AS ignored,
  CASE WHEN last.state = 'success' THEN 'ready' WHEN last.state = 'partial' THEN 'blocked_partial_order' WHEN last.state IN ('queued', 'running') THEN
    CASE WHEN last.moment + INTERVAL 12 HOUR <= (SELECT max(moment) FROM order_events) THEN 'stuck' ELSE 'not_ready' END ELSE 'not_downloaded_state_' || last.state END AS status FROM s""")
def order_states(order_events):
    """What each order's events come to, and whether it can be downloaded."""
    from datetime import timedelta

    from ..streaming import orders

    newest = order_events.agg(F.max("moment")).first()[0]
    return orders.order_states(order_events.withColumnRenamed("moment", "at"), newest, timedelta(hours=12))
