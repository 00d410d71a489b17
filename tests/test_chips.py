"""Orders, deliveries, merged windows and the choice around a survey against plain code."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from parapet import plans
from parapet.operators import orders, raster, scenes
from parapet.sources import files


def test_order_requests_are_canonical_json(spark):
    aoi = json.dumps({"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}, sort_keys=True, separators=(",", ":"))
    rows = [("a", f"s{i}", "ortho_analytic_8b_sr" if i % 3 else "ortho_analytic_4b_sr", aoi) for i in range(30)] + [("a", "s1", "ortho_analytic_8b_sr", aoi)]
    rows += [("full", f"x{i}", "ortho_analytic_8b_sr", aoi) for i in range(500)] + [("over", f"x{i}", "ortho_analytic_8b_sr", aoi) for i in range(501)]
    rows += [("odd", "q1", "ortho_visual", aoi), ("null", "q2", None, aoi), ("two", "q3", "ortho_analytic_4b_sr", aoi), ("two", "q4", "ortho_analytic_4b_sr", aoi[:-1] + " }")]
    got = {r["city"]: r for r in orders.order_requests(spark.createDataFrame(rows, "city string, scene_id string, asset string, aoi string"), "train").collect()}
    assert {c: (r["scene_count"], r["status"]) for c, r in got.items()} == {
        "a": (30, "validated"), "full": (500, "validated"), "over": (501, "refused_too_many_items"), "odd": (1, "refused_unsupported_asset"), "null": (1, "refused_unsupported_asset"), "two": (2, "refused_conflicting_areas"),
    }
    ids = sorted(f"s{i}" for i in range(30))
    name = "train_a_" + hashlib.sha256("|".join(ids).encode()).hexdigest()[:10]
    products = [{"item_ids": [i for i in ids if (int(i[1:]) % 3 == 0) == (asset == "4b")], "item_type": "PSScene", "product_bundle": bundle} for asset, bundle in (("4b", "analytic_sr_udm2"), ("8b", "analytic_8b_sr_udm2"))]
    want = json.dumps({"name": name, "products": products, "order_type": "full", "tools": [{"clip": {"aoi": json.loads(aoi)}}]}, sort_keys=True, separators=(",", ":"))
    assert got["a"]["request"] == want and got["a"]["request_sha256"] == hashlib.sha256(want.encode()).hexdigest()
    assert got["over"]["request"] is None and got["over"]["order_name"] is None


def test_integrity_of_a_delivery(spark):
    digest = lambda text: hashlib.sha256(text.encode()).hexdigest()
    manifest = spark.createDataFrame([("a", 3, digest("abc").upper()), ("b", 3, digest("abc")), ("c", 4, digest("abc")), ("d", 3, None), ("e", 3, digest("abc")), ("f", 3, digest("abc"))], "file string, bytes long, digest string")
    present = spark.createDataFrame([("a", 3, digest("abc")), ("b", 3, digest("xyz")), ("c", 3, digest("abc")), ("d", 3, digest("xyz")), ("f", 3, digest("xyz")), ("f", 3, digest("abc")), ("other", 1, digest("z"))], "file string, size long, sha256 string")
    assert {r["file"]: r["status"] for r in files.integrity(manifest, present).collect()} == {"a": "ok", "b": "hash_mismatch", "c": "size_mismatch", "d": "ok", "e": "missing", "f": "ok"}


def test_merged_windows_need_every_cell(spark):
    rows = [("k", r, c, float(r * 10 + c + s)) for s in (0, 1) for r in range(s, s + 2) for c in range(3)]
    predictions, extents = spark.createDataFrame(rows, "k string, r int, c int, v double"), spark.createDataFrame([("k", 3, 3)], "k string, height int, width int")
    got = {(r["r"], r["c"]): (r["mean"], r["variance"], r["n"]) for r in raster.merge_windows(predictions, extents, ["k"], "v").collect()}
    assert got[0, 0] == (0.0, 0.0, 1) and got[1, 2] == (12.5, 0.25, 2) and len(got) == 9
    for bad in (predictions.where("NOT (r = 2 AND c = 1)"), predictions.withColumn("v", F.expr("IF(r = 2 AND c = 1, NULL, v)"))):
        with pytest.raises(Exception, match="no window covers, k, 2, 1"):
            raster.merge_windows(bad, extents, ["k"], "v").collect()


def test_city_total_against_a_plain_walk(spark):
    """Cities with few solstice scenes, with one season only, and with more candidates than the shortlist."""
    rng = random.Random(8)
    rows, surveys = [], [(1, "2018;2020", "x", "2020-05-01"), (2, "2015-2019", "exact_official_project_range", "2019-03-01"), (3, "2012", "x", "2012-06-01"), (4, "2016-2019", "official_campaign_range", "2019-03-01")]
    for city, lat, months in ((1, 50.0, range(1, 13)), (2, -10.0, (3, 4, 6)), (3, 5.0, (1, 3)), (4, 40.0, range(1, 13))):
        for i in range(260 if city == 1 else 20):
            rows.append((city * 1000 + i, city, rng.choice(list(months)), rng.randint(2014, 2024), rng.uniform(0, 360), rng.choice((0.0, 0.005, 0.02)), rng.choice((100.0, 99.6)), lat, rng.choice((30.0, 40.0, rng.uniform(20, 70))), float(rng.randint(-9, 9)), rng.choice((0.0, 2.0)), rng.choice((None, 1.0)), rng.choice((None, "ortho_analytic_8b_sr", "ortho_analytic_4b_sr")), rng.random() < 0.9))
    names = "scene_id city month year bearing cloud coverage lat sun view_angle haze shadow asset standard".split()
    documented = {1: {2018, 2020}, 2: {2015, 2019}, 3: {2012}, 4: set()}
    want = []
    for city, _, _, end in surveys:
        end_year, pool = int(end[:4]), []
        for row in rows:
            x = dict(zip(names, row, strict=True))
            if x["city"] != city or not x["standard"]:
                continue
            solstice = x["month"] in (6, 7, 12, 1)
            warm = x["month"] in ((6, 7) if x["lat"] >= 0 else (12, 1))
            clear = x["cloud"] <= 1e-12
            level = 0 if x["year"] in documented[city] else 1 if x["year"] > end_year else 2
            b = x["bearing"]
            x |= {
                "season": ("summer" if warm else "winter") if solstice else "other", "way": "N" if b >= 315 or b < 45 else "E" if b < 135 else "S" if b < 225 else "W",
                "tier": 0 if x["coverage"] >= 99.999999 and clear else 1 if x["coverage"] >= 99.5 and clear else 2 if x["coverage"] >= 99.5 and x["cloud"] <= 0.01 else 3,
                "bad": x["haze"] + (x["shadow"] or 0), "sid": str(x["scene_id"]), "far": 0 if level == 0 else abs(x["year"] - end_year), "level": level + (0 if solstice else 3),
            }
            pool.append(x)
        pool.sort(key=lambda x: (x["level"], x["far"], x["tier"], x["cloud"], -x["coverage"], -x["view_angle"], x["bad"], x["sid"]))
        seen, first = {}, []
        for x in pool:
            k = x["level"], x["season"], x["way"]
            seen[k] = seen.get(k, 0) + 1
            if seen[k] <= 2:
                first.append(x)
        left = [x for x in (first + [x for x in pool if x not in first])[:120] if x["asset"]]
        chosen = []
        for slot in range(8):
            if not left:
                break

            def key(x, slot=slot, chosen=chosen):
                count = lambda f: sum(y[f] == x[f] for y in chosen)
                rank = lambda is_open, due: 0 if is_open and due else 1 if is_open else 2
                apart = min((abs(x["sun"] - y["sun"]) for y in chosen), default=90.0)
                return (
                    x["level"], x["far"], rank(x["season"] == "other" or count("season") < 4, x["season"] == ("summer", "winter")[slot % 2]), rank(count("way") < 2, x["way"] == "NSEW"[slot % 4]),
                    x["tier"], -round(apart, 8), x["asset"] != "ortho_analytic_8b_sr", -abs(x["view_angle"]), x["cloud"], -x["coverage"], x["bad"], x["sid"],
                )

            best = min(left, key=key)
            left.remove(best)
            want.append((city, slot + 1, best["scene_id"], best["level"], best["far"], any(y["year"] == best["year"] for y in chosen)))
            chosen.append(best)
    table = spark.createDataFrame(rows, "scene_id long, city long, month int, year int, bearing double, cloud double, coverage double, lat double, sun double, view_angle double, haze double, shadow double, asset string, standard boolean")
    known = spark.createDataFrame(surveys, "city long, years string, precision_kind string, survey_end string").withColumn("survey_end", F.col("survey_end").cast("date"))
    assert sorted(map(tuple, scenes.select_city_total(table, known).collect())) == want
    assert {r["level"] for r in scenes.select_city_total(table, known).where("city = 3").collect()} & {3, 4, 5}
    same = plans.windows.select_same_year(table, known).collect()
    assert {(1, 2018), (1, 2020)} <= {(r["city"], r["survey_year"]) for r in same} <= {(1, 2018), (1, 2020), (2, 2019)}


def test_scene_items_flatten_to_rows_and_need_a_geometry(spark):
    ring = [[0.0, 0.0], [2.0, 0.0], [2.0, 1.0], [0.0, 1.0], [0.0, 0.0]]
    item = lambda geometry, **props: json.dumps({"id": "s1", "geometry": geometry, "properties": props})
    areas = spark.createDataFrame([("c", [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0), (0.0, 0.0)])], "city string, area array<struct<x: double, y: double>>")
    frame = lambda text: spark.createDataFrame([("c", text)], "city string, item string")
    r = scenes.flat_items(frame(item({"type": "Polygon", "coordinates": [ring]}, cloud_cover=0.25, pixel_resolution=3)), areas, {"cloud_cover": "double", "ground_control": "string"}).first()
    assert (r["city"], r["scene_id"], r["cloud_cover"], r["ground_control"], r["coverage"]) == ("c", "s1", 0.25, None, 100.0)
    assert (r["lon_min"], r["lat_min"], r["lon_max"], r["lat_max"]) == (0.0, 0.0, 2.0, 1.0) and abs(r["lon"] - 1) < 1e-9 and abs(r["lat"] - 0.5) < 1e-9
    assert abs(r["bearing"] - 90) < 1e-6 and r["direction"] == "E" and abs(r["offset_km"] - 6378.137 * 0.5 * 3.141592653589793 / 180 * 0.8667) < 0.3
    with pytest.raises(Exception, match="no geometry: s1"):
        scenes.flat_items(frame(item(None)), areas, {}).collect()


def test_stacked_scenes_need_all_bands_in_plan_order(spark):
    plan = spark.createDataFrame([("k", 2, "b", "B", [1]), ("k", 1, "a", "A", [2, 1])], "chip string, place int, scene string, prefix string, indexes array<int>")
    bands = spark.createDataFrame([("a", 0, 1, 0.5), ("a", 0, 2, 1.5), ("b", 0, 1, 70000.0), ("a", 1, 1, -3.0), ("b", 1, 1, 2.5)], "scene string, r int, band int, v double")
    r = raster.stack_scenes(plan, bands.where("r = 0"), ["r"], 3).first()
    assert r["values"] == [2, 0, 65535] and r["names"] == ["A_2", "A_1", "B_1"]
    with pytest.raises(Exception, match="bands of k : 2"):
        raster.stack_scenes(plan, bands, ["r"], 3).collect()


def test_grid_audit_names_what_differs(spark):
    columns = "key string, crs int, x0 double, y0 double, dx double, dy double, width int, height int"
    template = spark.createDataFrame([("a", 1, 0.0, 9.0, 3.0, -3.0, 8, 8)], columns)
    cases = {"": (1, 0.0, 9.0, 3.0, -3.0, 8, 8), "crs": (2, 0.0, 9.0, 3.0, -3.0, 8, 8), "transform;bounds": (1, 3.0, 9.0, 3.0, -3.0, 8, 8), "transform;width;resolution": (1, 0.0, 9.0, 6.0, -3.0, 4, 8), "height;bounds": (1, 0.0, 9.0, 3.0, -3.0, 8, 9), "transform;bounds;resolution": (1, 0.0, 9.0, 3.0, -1.5, 8, 8)}
    for want, row in cases.items():
        assert raster.grid_audit(spark.createDataFrame([("a", *row)], columns), template, "key").first()["failed"] == want
    assert raster.grid_audit(template.withColumn("key", F.lit("z")), template, "key").first()["failed"] == "template"


def test_scenes_are_measured_a_batch_at_a_time(spark):
    """Many scenes of two cities in one task: each row's own ring and area, by a batched step, not by nested lambdas a row."""
    ring = lambda w: [[w, 10.0], [w + 1, 10.0], [w + 1, 11.0], [w, 11.0], [w, 10.0]]
    items = spark.createDataFrame([("ab"[i % 2], json.dumps({"id": f"s{i}", "geometry": {"coordinates": [ring(i / 100)]}, "properties": {}})) for i in range(200)], "city string, item string").coalesce(1)
    area = lambda w: [(float(x), float(y)) for x, y in ring(w)]
    areas = spark.createDataFrame([("a", area(0.0)), ("b", area(1.0))], "city string, area array<struct<x: double, y: double>>")
    found = scenes.flat_items(items, areas, {})
    assert "ArrowEvalPython" in found._jdf.queryExecution().executedPlan().toString()
    got = {r["scene_id"]: (r["coverage"], r["lon"], r["lat"]) for r in found.collect()}
    assert len(got) == 200
    for i in range(200):
        covered, lon, lat = got[f"s{i}"]
        assert abs(covered - 100 * max(0, 1 - abs(i / 100 - i % 2))) < 1e-5 and abs(lon - i / 100 - 0.5) < 1e-9 and abs(lat - 10.5) < 1e-9


def test_a_delivery_makes_no_file_of_its_own_for_each_tile(spark, tmp_path, monkeypatch):
    """Entries, renames and statuses must not grow by one a delivered file; the contents are still held against the manifest."""
    from parapet.plans import chips

    at = tmp_path / "delivered"
    monkeypatch.setattr(chips, "new_path", lambda spark, name: str(at))
    spark.range(1, 401).selectExpr("id AS c_custkey", "CONCAT('A', id) AS c_name", "'X' AS c_mktsegment").coalesce(2).write.parquet(str(tmp_path / "customer.parquet"))
    got = {r["file"]: r["status"] for r in chips.tile_integrity(spark, str(tmp_path)).collect()}
    assert got == {i: {1: "missing", 2: "size_mismatch", 3: "hash_mismatch"}.get(i % 5, "ok") for i in range(1, 401) if i % 10 < 8}
    assert 0 < len([p for p in at.rglob("*") if p.name.startswith("part-")]) <= 2
