"""Scene rules: filter tiers, shortlists, the greedy choice, pairs, and the scene nearest a survey."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from . import selection

#: Fixed values of the selection: slots, their targets, and the quotas.
DIRECTION_SLOTS = ("N", "S", "E", "W", "N", "S", "E", "W", "ANY")
SEASON_SLOTS = ("summer", "winter", "summer", "winter", "summer", "winter", "summer", "winter", "summer")
SEASON_QUOTAS = {"summer": 5, "winter": 4}
DIRECTION_QUOTA = 2
SHORTLIST = 60
#: Assets in order of preference.
ASSETS = ("ortho_analytic_8b_sr", "ortho_analytic_4b_sr")
MAX_PAIR_GAP_DAYS = 183
PAIR_CANDIDATES = 40


def filter_tier(coverage: Column, cloud: Column) -> Column:
    """0 strict to 3 relaxed, by coverage in percent and cloud share."""
    clear = cloud <= 1e-12
    return F.when((coverage >= 99.999999) & clear, 0).when((coverage >= 99.5) & clear, 1).when((coverage >= 99.5) & (cloud <= 0.01), 2).otherwise(3)


def penalty(*shares: str) -> Column:
    """Haze, shadow and snow together; a missing share counts as none."""
    return sum((F.coalesce(F.col(s), F.lit(0.0)) for s in shares[1:]), F.coalesce(F.col(shares[0]), F.lit(0.0)))


def candidates(scenes: DataFrame) -> DataFrame:
    """Standard scenes of the solstice months with the fields that the choice looks at."""
    out = scenes.where("standard").withColumns(
        {
            "season": geo.season(F.col("lat"), F.col("month")), "direction": geo.sector4(F.col("bearing")), "tier": filter_tier(F.col("coverage"), F.col("cloud")),
            "penalty": penalty("shadow", "haze"), "sid": F.col("scene_id").cast("string"),
        }
    )
    return out.where("season IS NOT NULL")


def shortlist(pool: DataFrame, limit: int = SHORTLIST) -> DataFrame:
    """At most ``limit`` scenes a city with their position.

    First the best two of each year, season and direction, then the best five of
    each season, then the best two of each direction, then the others; each by
    tier, cloud, coverage, signed view angle, penalty and id. No more than
    ``limit`` of one year, season and direction can be among them, so all others
    go before anything is ranked a city at a time.
    """
    order = [F.col("tier"), F.col("cloud"), F.desc("coverage"), F.desc("view_angle"), F.col("penalty"), F.col("sid")]
    few = selection.top_n(pool, ["city", "year", "season", "direction"], order, limit, "in_group")
    place = lambda *by: F.row_number().over(Window.partitionBy("city", *by).orderBy(*order))
    few = few.withColumns({"in_season": place("season"), "in_direction": place("direction")})
    level = F.when(F.col("in_group") <= 2, 0).when(F.col("in_season") <= max(SEASON_QUOTAS.values()), 1).when(F.col("in_direction") <= DIRECTION_QUOTA, 2).otherwise(3)
    few = few.withColumn("level", level)
    position = F.row_number().over(Window.partitionBy("city").orderBy("level", *order))
    return few.withColumn("position", position).where(F.col("position") <= limit).drop("in_group", "in_season", "in_direction", "level")


def slot_key(c: Column, chosen: Column, slot: Column) -> Column:
    """What makes one candidate better than another for a slot, the least first.

    A year that was not chosen yet; the season that is due, then one below its
    quota; the direction likewise; the tier; the distance in sun elevation from
    those chosen, rounded half to even; the asset; how far off nadir; then cloud,
    coverage, penalty and id.
    """
    held = lambda cond: F.size(F.filter(chosen, cond))
    due = lambda slots: F.element_at(F.array(*map(F.lit, slots)), slot)
    quota = F.when(c["season"] == "summer", SEASON_QUOTAS["summer"]).otherwise(SEASON_QUOTAS["winter"])
    season_open = held(lambda x: x["season"] == c["season"]) < quota
    direction_open = held(lambda x: x["direction"] == c["direction"]) < DIRECTION_QUOTA
    season = F.when(season_open & (c["season"] == due(SEASON_SLOTS)), 0).when(season_open, 1).otherwise(2)
    direction = F.when(due(DIRECTION_SLOTS) == "ANY", F.when(direction_open, 0).otherwise(1)).otherwise(F.when(direction_open & (c["direction"] == due(DIRECTION_SLOTS)), 0).when(direction_open, 1).otherwise(2))
    apart = F.coalesce(F.array_min(F.transform(chosen, lambda x: F.abs(x["sun"] - c["sun"]))), F.lit(90.0))
    return F.struct(
        (held(lambda x: x["year"] == c["year"]) > 0).alias("a"), season.alias("b"), direction.alias("c"), c["tier"].alias("d"), (-F.bround(apart, 8)).alias("e"),
        (c["asset"] != ASSETS[0]).alias("f"), (-F.abs(c["view_angle"])).alias("g"), c["cloud"].alias("h"), (-c["coverage"]).alias("i"), c["penalty"].alias("j"), c["sid"].alias("k"),
    )


def select(scenes: DataFrame, limit: int = SHORTLIST) -> DataFrame:
    """Up to nine scenes a city: the slots filled one after the other from the shortlist's scenes with an asset."""
    pool = shortlist(candidates(scenes), limit).where("asset IS NOT NULL")
    fields = ["sid", "scene_id", "year", "season", "direction", "tier", "sun", "asset", "view_angle", "cloud", "coverage", "penalty"]
    return selection.greedy(pool, "city", len(SEASON_SLOTS), slot_key, fields)


def days(date: Column) -> Column:
    return F.unix_date(date)


def strict_penalty(cloud: Column, coverage: Column) -> Column:
    """What a departure from zero cloud and full coverage costs."""
    return F.greatest(F.lit(0.0), cloud) * 10000 + F.greatest(F.lit(0.0), 100 - coverage) * 10000


def season_pool(scenes: DataFrame, months: tuple[int, ...], most: int = PAIR_CANDIDATES) -> DataFrame:
    """The ``most`` scenes of a city in these months nearest its reference date: strict ones if there is any, else all.

    ``scenes`` has the city's date as ``reference``.
    """
    strict = (F.col("cloud") == 0) & (F.col("coverage") == 100)
    pool = selection.fallback_pool(scenes.where(F.col("month").isin(*months)), ["city"], strict)
    score = (
        F.abs(days(F.col("acquired")) - days(F.col("reference"))) + strict_penalty(F.col("cloud"), F.col("coverage"))
        + F.when(F.col("standard"), 0).otherwise(100) - F.coalesce(F.col("sun") / 1000.0, F.lit(0.0))
    )
    return selection.top_n(pool.withColumn("season_score", score), ["city"], [F.col("season_score"), F.col("scene_id").cast("string")], most, "place")


def best_pair(scenes: DataFrame, most: int = PAIR_CANDIDATES) -> DataFrame:
    """The winter and the summer scene of each city: every pair with a common asset, the least by six keys.

    Both sides are pools of ``most`` rows a city at most. ``assets`` is a list of
    asset names parted by commas.
    """
    side = lambda months, p: season_pool(scenes, months, most).select("city", "reference", *[F.col(c).alias(p + c) for c in ("scene_id", "acquired", "standard", "cloud", "coverage", "sun", "penalty", "assets")])
    pairs = side((12, 1), "w_").join(side((6, 7), "s_").drop("reference"), "city")
    common = F.array_intersect(F.split("w_assets", ","), F.split("s_assets", ","))
    rank = F.array_min(F.filter(F.transform(common, lambda a: F.array_position(F.array(*map(F.lit, ASSETS)), a)), lambda i: i > 0))
    w, s, at = days(F.col("w_acquired")), days(F.col("s_acquired")), days(F.col("reference"))
    gap, apart = F.abs(s - w), F.abs(F.floor((w + s) / 2 - at))
    quality = lambda p: F.when(F.col(p + "standard"), 0).otherwise(100)
    bonus = -F.coalesce(F.col("w_sun") / 1000.0, F.lit(0.0)) - F.coalesce(F.col("s_sun") / 1000.0, F.lit(0.0))
    score = (
        apart + F.greatest(F.lit(0), gap - MAX_PAIR_GAP_DAYS) * 1000 + (quality("w_") + quality("s_")) + strict_penalty(F.col("w_cloud"), F.col("w_coverage"))
        + strict_penalty(F.col("s_cloud"), F.col("s_coverage")) + (F.col("w_penalty") + F.col("s_penalty")) + bonus
    )
    keyed = pairs.withColumn("asset_rank", rank).where("asset_rank IS NOT NULL")
    key = F.struct("asset_rank", F.round(score, 9).alias("score"), apart.alias("apart"), gap.alias("gap"), F.col("w_scene_id").cast("string").alias("w"), F.col("s_scene_id").cast("string").alias("s"))
    best = keyed.groupBy("city").agg(F.min_by(F.struct("w_scene_id", "s_scene_id", "w_acquired", "s_acquired", "w_sun", "s_sun", "asset_rank"), key).alias("b"))
    return best.select("city", F.col("b.w_scene_id").alias("winter"), F.col("b.s_scene_id").alias("summer"), "b.w_acquired", "b.s_acquired", "b.w_sun", "b.s_sun", F.element_at(F.array(*map(F.lit, ASSETS)), F.col("b.asset_rank").cast("int")).alias("asset"))


def between_pair(scenes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The two clean scenes between a city's pair that widen its sun elevations most: all combinations, the greatest by six keys.

    Of equal combinations the first in order of ids wins. Strict scenes between two
    dates are few a city; the join of a city with itself is over these alone.
    """
    low, high = F.least("w_acquired", "s_acquired"), F.greatest("w_acquired", "s_acquired")
    strict = scenes.where("cloud = 0 AND coverage = 100 AND standard").join(pairs, "city")
    inside = strict.where((F.col("acquired") > low) & (F.col("acquired") < high) & (F.col("scene_id") != F.col("winter")) & (F.col("scene_id") != F.col("summer")))
    side = lambda p, *more: inside.select("city", *more, *[F.col(c).alias(p + c) for c in ("scene_id", "acquired", "sun", "clear", "penalty")])
    both = side("a_", "w_acquired", "s_acquired", "w_sun", "s_sun").join(side("b_"), "city").where("a_scene_id < b_scene_id")
    suns = F.array_sort(F.array("w_sun", "s_sun", "a_sun", "b_sun"))
    dates = F.array_sort(F.array(*[days(F.col(c)) for c in ("w_acquired", "s_acquired", "a_acquired", "b_acquired")]))
    least_gap = lambda xs: F.array_min(F.zip_with(F.slice(xs, 1, 3), F.slice(xs, 2, 3), lambda x, y: y - x))
    mean = (F.col("w_sun") + F.col("s_sun") + F.col("a_sun") + F.col("b_sun")) / 4
    spread = F.sqrt(sum(((F.col(c) - mean) * (F.col(c) - mean) for c in ("s_sun", "a_sun", "b_sun")), (F.col("w_sun") - mean) * (F.col("w_sun") - mean)) / 4)
    clear = F.coalesce((F.col("a_clear") + F.col("b_clear")) / 2, F.col("a_clear"), F.col("b_clear"))
    r9 = lambda x: F.round(x, 9)
    order = [F.desc(r9(F.element_at(suns, 4) - F.element_at(suns, 1))), F.desc(r9(spread)), F.desc(r9(least_gap(suns))), r9(clear).desc_nulls_last(), F.desc(least_gap(dates)), F.col("a_penalty") + F.col("b_penalty"), F.col("a_scene_id"), F.col("b_scene_id")]
    best = selection.top_n(both, ["city"], order, 1, "n")
    return best.select("city", F.col("a_scene_id").alias("first_id"), F.col("b_scene_id").alias("second_id"), r9(F.element_at(suns, 4) - F.element_at(suns, 1)).alias("sun_range"))


def nearest_to_survey(scenes: DataFrame, surveys: DataFrame) -> DataFrame:
    """For each city and solstice season the clean scene nearest its survey.

    One inside the survey's window, nearest its midpoint; else the first after it;
    else the last before it. Ties go by penalty, cloud, clearness, sun, and the
    order of ids. ``surveys`` has city, survey_start and survey_end, one row a city.
    """
    half = F.when(F.col("month").isin(12, 1), "winter_jan_dec").when(F.col("month").isin(6, 7), "summer_jun_jul")
    clean = scenes.where("cloud = 0 AND coverage = 100 AND standard").withColumn("half", half).where("half IS NOT NULL").join(surveys, "city")
    at, start, end = (days(F.col(c)) for c in ("acquired", "survey_start", "survey_end"))
    inside = at.between(start, end)
    phase = F.when(inside, 0).when(at >= end, 1).otherwise(2)
    # The midpoint may lie at noon; whole days are rounded down.
    distance = F.when(inside, F.floor(F.abs(at - (start + end) / 2))).when(at >= end, at - end).otherwise(start - at)
    key = F.struct(
        phase.alias("a"), distance.cast("long").alias("b"), F.col("penalty").alias("c"), F.col("cloud").alias("d"), (-F.coalesce("clear", F.lit(-1.0))).alias("e"), (-F.coalesce("sun", F.lit(-999.0))).alias("f"), F.col("scene_id").alias("g")
    )
    best = clean.groupBy("city", "half").agg(F.min(key).alias("k"))
    relation = F.element_at(F.array(*map(F.lit, ("inside", "after", "before"))), F.col("k.a") + 1)
    return best.select("city", F.col("half").alias("season"), F.col("k.g").alias("scene_id"), relation.alias("relation"), F.col("k.b").alias("days_off"))


def off_nadir_rank(scenes: DataFrame, by: list[str], weights: dict[str, float], ties: list[Column]) -> DataFrame:
    """``score`` and ``rank`` in each pool: weighted terms, each scaled from the pool's least (0) to its most (1)."""
    w = Window.partitionBy(*by)

    def scaled(name: str) -> Column:
        low, high = F.min(name).over(w), F.max(name).over(w)
        return F.when(high > low, (F.col(name) - low) / (high - low)).otherwise(0.0)

    terms = [weight * scaled(name) for name, weight in weights.items()]
    out = scenes.withColumn("score", F.round(sum(terms[1:], terms[0]), 12))
    return out.withColumn("rank", F.row_number().over(w.orderBy(F.desc("score"), *ties)))


def survey_years(text: Column, precision: Column, first_year: int = 2016) -> Column:
    """struct(eligible, excluded, rule, status) of a text of survey years.

    '2019;2021' names exact years, '2019' one, '2019-2021' its two ends where the
    precision proves them; broad ranges and anything else give no year. Years
    before ``first_year`` are excluded.
    """
    bare = F.trim(F.coalesce(text, F.lit("")))
    is_range, ends, broad = bare.rlike(r"^\d{4}-\d{4}$"), precision.isin(*ENDPOINT_PRECISIONS), precision.isin(*BROAD_PRECISIONS)
    listed, single = F.contains(bare, F.lit(";")), bare.rlike(r"^\d{4}$")
    rule = (
        F.when(listed, "semicolon_separated_exact_years").when(single, "single_exact_or_documented_year").when(is_range & ends, "documented_two_year_range_endpoints")
        .when(is_range & broad, "broad_range_not_expanded").otherwise("unresolved_acquisition_year_format")
    )
    parts = F.filter(F.split(bare, "[;-]"), lambda x: x.rlike(r"^\d{4}$"))
    exact = F.filter(F.split(bare, ";"), lambda x: x.rlike(r"^\d{4}$"))
    found = F.when(listed, exact).when(single | (is_range & ends), parts).otherwise(F.array().cast("array<string>"))
    years = F.array_sort(F.array_distinct(F.transform(found, lambda y: y.cast("int"))))
    eligible, excluded = F.filter(years, lambda y: y >= first_year), F.filter(years, lambda y: y < first_year)
    status = (
        F.when(F.size(eligible) > 0, "eligible").when(rule == "broad_range_not_expanded", "requires_exact_lidar_tile_year")
        .when(F.size(excluded) > 0, "no_same_year_planetscope_metadata").otherwise("requires_acquisition_year_review")
    )
    return F.struct(eligible.alias("eligible"), excluded.alias("excluded"), rule.alias("rule"), status.alias("status"))


#: Precisions of a year range.
ENDPOINT_PRECISIONS = ("exact_official_project_range", "official_flight_lot_range")
BROAD_PRECISIONS = ("official_campaign_range", "official_catalog_series_range", "official_national_campaign_range")

#: Fixed values of the choice around a survey: eight scenes, two of a direction, four of a season, candidates looked at.
EIGHT, EIGHT_DIRECTION_QUOTA, EIGHT_SEASON_QUOTA, EIGHT_SHORTLIST = 8, 2, 4, 120


def _with_survey(scenes: DataFrame, surveys: DataFrame) -> DataFrame:
    """Standard scenes with the fields that the choice looks at and their city's documented years; season is ``other`` outside the solstice months."""
    years = survey_years(F.col("years"), F.col("precision_kind"))
    own = surveys.select("city", years.alias("y"), F.year("survey_end").alias("end_year")).select("city", F.col("y.eligible").alias("eligible"), F.concat("y.eligible", "y.excluded").alias("documented"), "end_year")
    out = scenes.where("standard").withColumns(
        {
            "season": F.coalesce(geo.season(F.col("lat"), F.col("month")), F.lit("other")), "direction": geo.sector4(F.col("bearing")), "tier": filter_tier(F.col("coverage"), F.col("cloud")),
            "penalty": penalty("shadow", "haze"), "sid": F.col("scene_id").cast("string"),
        }
    )
    return out.join(own, "city")


def _protected(pool: DataFrame, by: list[str], guarded: list[str], first: list[Column], limit: int) -> DataFrame:
    """At most ``limit`` rows of each pool: the best two of each guarded group, then the others, in one order.

    No more than ``limit`` of a guarded group can be among them, so the others go
    before a pool is ranked as a whole.
    """
    order = [*first, F.col("tier"), F.col("cloud"), F.desc("coverage"), F.desc("view_angle"), F.col("penalty"), F.col("sid")]
    few = selection.top_n(pool, [*by, *guarded], order, limit, "in_group")
    return selection.top_n(few, by, [(F.col("in_group") > 2), *order], limit, "position")


def eight_key(first: tuple[str, ...] = ()):
    """The key of a candidate for a slot of eight: ``first`` fields, the season and the direction that are due and below their quota, then as for nine scenes.

    Scenes of season ``other`` have no quota and are never due.
    """

    def key(c: Column, chosen: Column, slot: Column) -> Column:
        held = lambda field: F.size(F.filter(chosen, lambda x: x[field] == c[field]))
        due = lambda slots: F.element_at(F.array(*map(F.lit, slots[:EIGHT])), slot)
        rank = lambda is_open, is_due: F.when(is_open & is_due, 0).when(is_open, 1).otherwise(2)
        season = rank((c["season"] == "other") | (held("season") < EIGHT_SEASON_QUOTA), c["season"] == due(SEASON_SLOTS))
        direction = rank(held("direction") < EIGHT_DIRECTION_QUOTA, c["direction"] == due(DIRECTION_SLOTS))
        apart = F.coalesce(F.array_min(F.transform(chosen, lambda x: F.abs(x["sun"] - c["sun"]))), F.lit(90.0))
        return F.struct(
            *[c[f].alias(f) for f in first], season.alias("b"), direction.alias("c"), c["tier"].alias("d"), (-F.bround(apart, 8)).alias("e"),
            (c["asset"] != ASSETS[0]).alias("f"), (-F.abs(c["view_angle"])).alias("g"), c["cloud"].alias("h"), (-c["coverage"]).alias("i"), c["penalty"].alias("j"), c["sid"].alias("k"),
        )

    return key


_EIGHT_FIELDS = ["sid", "scene_id", "year", "season", "direction", "tier", "sun", "asset", "view_angle", "cloud", "coverage", "penalty"]


def select_city_total(scenes: DataFrame, surveys: DataFrame, limit: int = EIGHT_SHORTLIST) -> DataFrame:
    """Up to eight scenes a city, by what is nearest its survey in time.

    Scenes of a documented year come first, then later ones, then earlier ones; of
    those outside the solstice months again in that order, after all others.
    Within one of these six levels fewer years away come first. (city, slot,
    scene_id, level, distance, repeated); ``repeated`` tells whether an earlier slot
    has the scene's year.
    """
    exact, later = F.array_contains("documented", F.col("year")), F.col("year") > F.col("end_year")
    level = F.when(exact, 0).when(later, 1).otherwise(2) + F.when(F.col("season") == "other", 3).otherwise(0)
    pool = _with_survey(scenes, surveys).withColumns({"level": level, "distance": F.when(exact, 0).otherwise(F.abs(F.col("year") - F.col("end_year")))})
    few = _protected(pool, ["city"], ["level", "season", "direction"], [F.col("level"), F.col("distance")], limit).where("asset IS NOT NULL")
    chosen = selection.greedy(few, "city", EIGHT, eight_key(("level", "distance")), ["level", "distance", *_EIGHT_FIELDS])
    repeated = F.row_number().over(Window.partitionBy("city", "year").orderBy("slot")) > 1
    return chosen.select("city", "slot", "scene_id", "level", "distance", repeated.alias("repeated"))


def select_same_year(scenes: DataFrame, surveys: DataFrame, limit: int = EIGHT_SHORTLIST) -> DataFrame:
    """Up to eight solstice scenes of each eligible survey year of a city: (city, survey_year, slot, scene_id)."""
    pool = _with_survey(scenes, surveys).where("season <> 'other'").where(F.array_contains("eligible", F.col("year"))).withColumn("pool", F.struct("city", "year"))
    few = _protected(pool, ["pool"], ["season", "direction"], [], limit).where("asset IS NOT NULL")
    chosen = selection.greedy(few, "pool", EIGHT, eight_key(), _EIGHT_FIELDS)
    return chosen.select("pool.city", F.col("pool.year").alias("survey_year"), "slot", "scene_id")


def flat_items(items: DataFrame, areas: DataFrame, fields: dict[str, str]) -> DataFrame:
    """One row a scene item of a service: its city, common fields, geometry metrics, and the whole item.

    ``items`` has (city, item): the item's JSON text with id, geometry (a polygon)
    and properties. ``areas`` has (city, area): the convex ring of the city's area in
    degrees, one row a city. ``fields`` names the properties to take and their
    types; a property that an item lacks is null. Coverage, the offset of centres
    in kilometres and its bearing are measured in the equal-area projection.
    Items without a geometry raise when they are read.
    """
    shape = "struct<id:string,geometry:struct<coordinates:array<array<array<double>>>>>"
    lonlat = F.transform(F.get("i.geometry.coordinates", F.lit(0)), lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y")))
    ring = F.when(F.size(lonlat) > 3, lonlat).otherwise(F.raise_error(F.concat(F.lit("no geometry: "), F.coalesce("i.id", F.lit("null")))).cast("array<struct<x:double,y:double>>"))
    taken = [F.get_json_object("item", f"$.properties.{name}").cast(kind).alias(name) for name, kind in fields.items()]
    own = items.join(areas, "city").withColumn("i", F.from_json("item", shape)).select("city", "area", "item", F.col("i.id").alias("scene_id"), *taken, ring.alias("ring"))
    flat = own.withColumn("m", geo.scene_measures(F.col("ring"), F.col("area")))
    dx, dy = F.col("m.dx"), F.col("m.dy")
    side = lambda f, axis: f(F.transform("ring", lambda p: p[axis]))
    bearing = geo.bearing_of(dx, dy)
    return flat.select(
        "city", "scene_id", *fields, F.round("m.coverage", 6).alias("coverage"), F.col("m.lon").alias("lon"), F.col("m.lat").alias("lat"),
        (F.hypot(dx, dy) / 1000).alias("offset_km"), bearing.alias("bearing"), geo.sector8(bearing).alias("direction"),
        side(F.array_min, "x").alias("lon_min"), side(F.array_min, "y").alias("lat_min"), side(F.array_max, "x").alias("lon_max"), side(F.array_max, "y").alias("lat_max"), "item",
    )
