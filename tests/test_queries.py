"""Every registered query with SQL against DuckDB; the others have rows and fixed columns."""

import pytest

import __spark_entry__ as entry
from parapet import plans
from parapet.operators import tables

from oracle import difference

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_same_rows_as_sql(spark, name):
    assert difference(spark, SF, plans.QUERIES[name], plans.ORACLES[name]) == ""


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLES)))
def test_queries_without_sql_have_rows(spark, name):
    assert plans.QUERIES[name](spark, SF).count() > 0


def test_entry_has_rows_and_registered_names_agree(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_rest_works_without_the_training_data_operators(tmp_path):
    """The package and the entry import from a copy without both optional parts."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    repo = Path(entry.__file__).parent
    shutil.copytree(repo / "parapet", tmp_path / "parapet", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(entry.__file__, tmp_path)
    code = "import __spark_entry__ as e; print(len(e.queries()), [q for q in e.queries() if q.startswith('op') and q[2].isdigit()])"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=60)
    assert out.stdout.strip() == f"{len(plans.QUERIES)} []", out.stderr


def test_file_hashes_against_hashlib(spark):
    import glob
    import hashlib
    import os

    rows = plans.QUERIES["file_hash_audit"](spark, SF).collect()
    assert rows
    found = {}
    for path in glob.glob(os.path.join(tables.shared_dir(spark).removeprefix("file:"), "tiles-*", "part-*")):
        data = open(path, "rb").read()
        found[os.path.basename(path)] = (len(data), hashlib.sha256(data).hexdigest())
    assert {r["file"]: (r["size"], r["sha256"]) for r in rows}.items() <= found.items()


def test_pixel_components_of_all_chips_against_brute_force(spark):
    import random

    from parapet.plans.rasters import pixel_components

    rng = random.Random(7)
    cells = [(chip, r, c, rng.choice((0.0, 2.0, 2.0))) for chip in (0, 3, 119, 120, 121, 500, 70_000) for r in range(8) for c in range(8)]
    want = []
    for chip in {x[0] for x in cells}:
        left = {(r, c) for k, r, c, v in cells if k == chip and v > 1}
        while left:
            todo, part = [min(left)], set()
            while todo:
                at = todo.pop()
                if at in left:
                    left.remove(at)
                    part.add(at)
                    todo += [(at[0] + a, at[1] + b) for a, b in ((0, 1), (1, 0), (0, -1), (-1, 0))]
            r, c = min(part)
            want.append((chip, r * 8 + c, len(part)))
    got = pixel_components(spark.createDataFrame(cells, "chip long, r int, c int, v double")).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_greedy_against_a_plain_walk(spark):
    """Cities rich in one season, sector or year, written as loops: shortlist, assets, slots, and the recorded shape of a full selection."""
    import random

    rng = random.Random(3)
    scenes = []
    for city, lat in ((1, 50.0), (2, -20.0), (3, 10.0), (4, 0.0)):
        for i in range(160 if city < 3 else 7):
            month = 1 if city == 1 and i < 120 else rng.choice((1, 2, 6, 7, 12))
            year = 2018 if city == 2 and i < 100 else rng.randint(2016, 2024)
            scenes.append((city * 1000 + i, city, month, year, rng.uniform(0, 90) if i < 130 else rng.uniform(0, 360), rng.choice((0.0, 0.0, 0.005, 0.02)), rng.choice((100.0, 99.6, 98.0)), lat,
                           rng.choice((30.0, 40.000000004, 40.0, rng.uniform(20, 70))), float(rng.randint(-10, 10)), rng.choice((0.0, 3.0)), rng.choice((None, 1.0)), rng.choice((None, "ortho_analytic_8b_sr", "ortho_analytic_4b_sr")), rng.random() < 0.9))
    names = "scene_id city month year bearing cloud coverage lat sun view_angle haze shadow asset standard".split()
    want = []
    for city in (1, 2, 3, 4):
        pool = []
        for row in scenes:
            x = dict(zip(names, row, strict=True))
            warm = x["month"] in (6, 7) if x["lat"] >= 0 else x["month"] in (12, 1)
            if x["city"] != city or not x["standard"] or x["month"] not in (6, 7, 12, 1):
                continue
            clear = x["cloud"] <= 1e-12
            tier = 0 if x["coverage"] >= 99.999999 and clear else 1 if x["coverage"] >= 99.5 and clear else 2 if x["coverage"] >= 99.5 and x["cloud"] <= 0.01 else 3
            b = x["bearing"]
            x |= {"season": "summer" if warm else "winter", "way": "N" if b >= 315 or b < 45 else "E" if b < 135 else "S" if b < 225 else "W", "tier": tier, "bad": x["haze"] + (x["shadow"] or 0), "sid": str(x["scene_id"])}
            pool.append(x)
        pool.sort(key=lambda x: (x["tier"], x["cloud"], -x["coverage"], -x["view_angle"], x["bad"], x["sid"]))
        first: list = []
        for fields, n in ((("year", "season", "way"), 2), (("season",), 5), (("way",), 2)):
            seen: dict = {}
            for x in pool:
                k = tuple(x[f] for f in fields)
                seen[k] = seen.get(k, 0) + 1
                if seen[k] <= n and x not in first:
                    first.append(x)
        left = [x for x in (first + [x for x in pool if x not in first])[:60] if x["asset"]]
        chosen: list = []
        for slot in range(9):
            if not left:
                break
            count = lambda f, v: sum(y[f] == v for y in chosen)
            fresh = [x for x in left if not count("year", x["year"])] or left

            def key(x):
                way, season = (["N", "S", "E", "W"] * 2 + ["ANY"])[slot], ["summer", "winter"][slot % 2]
                season_open, way_open = count("season", x["season"]) < {"summer": 5, "winter": 4}[x["season"]], count("way", x["way"]) < 2
                a = (0 if season == x["season"] else 1) if season_open else 2
                w = (0 if way_open else 1) if way == "ANY" else (0 if way == x["way"] else 1) if way_open else 2
                apart = min((abs(x["sun"] - y["sun"]) for y in chosen), default=90.0)
                return a, w, x["tier"], -round(apart, 8), x["asset"] != "ortho_analytic_8b_sr", -abs(x["view_angle"]), x["cloud"], -x["coverage"], x["bad"], x["sid"]

            best = min(fresh, key=key)
            left.remove(best)
            chosen.append(best)
            want.append((city, slot + 1, best["scene_id"]))
        if city == 2:
            assert len({y["year"] for y in chosen}) >= 7 and {y["season"] for y in chosen} == {"summer", "winter"}
    table = spark.createDataFrame(scenes, "scene_id long, city long, month int, year int, bearing double, cloud double, coverage double, lat double, sun double, view_angle double, haze double, shadow double, asset string, standard boolean")
    assert sorted(map(tuple, plans.windows.greedy_select(table).collect())) == want
