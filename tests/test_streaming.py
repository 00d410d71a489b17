"""Order states and windows on streams against the batch plans; the paged source; UTM."""

import json
import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from parapet.functions import geo
from parapet.sources import paging
from parapet.streaming import orders, windows

EVENT = "order_id long, number long, at timestamp, state string"
T0 = datetime(2024, 1, 1)


def at(minutes):
    return T0 + timedelta(minutes=minutes)


EVENTS = [
    (1, 1, at(0), "queued"), (1, 2, at(10), "running"), (1, 3, at(20), "success"), (1, 4, at(30), "running"),  # ends, then one more
    (2, 5, at(5), "queued"), (2, 6, at(6), "partial"),
    (3, 8, at(40), "running"), (3, 7, at(12), "queued"),  # out of order
    (4, 9, at(3), "lost"),
    (5, 10, at(7), "failed"), (5, 11, at(7), "success"),  # a tie in time: the smaller number ends it
    (6, 12, at(100), "queued"),
]


def test_order_states_in_batch(spark):
    rows = orders.order_states(spark.createDataFrame(EVENTS, EVENT), at(110), timedelta(hours=1)).collect()
    assert {r["order_id"]: (r["state"], r["at"], r["accepted"], r["ignored"], r["status"]) for r in rows} == {
        1: ("success", at(20), 3, 1, "ready"),
        2: ("partial", at(6), 2, 0, "blocked_partial_order"),
        3: ("running", at(40), 2, 0, "stuck"),
        4: ("lost", at(3), 1, 0, "not_downloaded_state_lost"),
        5: ("failed", at(7), 1, 1, "not_downloaded_state_failed"),
        6: ("queued", at(100), 1, 0, "not_ready"),
    }
    assert orders.order_states(spark.createDataFrame([], EVENT), at(0), timedelta(hours=1)).count() == 0


def run(spark, tmp_path, batches, make, mode="append"):
    """Feed batches one after another, a file each; rows of all outputs, and the query."""
    source = tmp_path / "in"
    os.makedirs(source, exist_ok=True)
    schema = batches[0].schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(source))
    query = make(stream).writeStream.format("memory").queryName("rows_" + tmp_path.name.replace("-", "_")).outputMode(mode).option("checkpointLocation", str(tmp_path / "check")).start()
    try:
        for i, batch in enumerate(batches):
            batch.coalesce(1).write.json(str(tmp_path / f"one{i}"))
            name = next(n for n in os.listdir(tmp_path / f"one{i}") if n.startswith("part-"))
            os.rename(tmp_path / f"one{i}" / name, source / f"{i:03d}.json")
            query.processAllAvailable()
        return spark.table(query.name).collect(), query
    finally:
        query.stop()


def test_order_states_on_a_stream_equal_the_batch(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        frame = lambda rows: spark.createDataFrame(rows, EVENT)
        end = [(99, 99, at(400), "queued")]
        batches = [frame(EVENTS[4:8] + EVENTS[:2]), frame(EVENTS[2:4] + EVENTS[8:]), frame(end), frame([(3, 50, at(1), "failed"), (99, 100, at(410), "running")])]
        rows, query = run(spark, tmp_path, batches, lambda s: orders.stream_order_states(s, "60 minutes", timedelta(hours=1)))
        last = {}
        for r in rows:
            key = (r["accepted"] + r["ignored"], r["status"] == "stuck")
            last[r["order_id"]] = max(last.get(r["order_id"], (key, None)), (key, r), key=lambda x: x[0])
        want = {r["order_id"]: tuple(r) for r in orders.order_states(frame(EVENTS), at(340), timedelta(hours=1)).collect()}
        got = {k: tuple(v[1] if v[1] else next(r for r in rows if r["order_id"] == k)) for k, v in last.items()}
        assert got == want
        assert orders.dropped_rows(query) == 1  # the late event of order 3
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


@pytest.mark.parametrize("plan,ends", [(windows.sliding, 2), (windows.sessions, 2)])
def test_windows_on_a_stream_equal_the_batch_without_late_rows(spark, tmp_path, plan, ends):
    schema = "ts timestamp, user_id long, event_type string, value double"
    rows = [(at(m), m % 2, "ab"[m % 2], float(m)) for m in (0, 1, 10, 16, 50, 51, 95)]
    late, end = [(at(2), 0, "a", 1000.0)], [(at(1000), 7, "z", 0.0)]
    batches = [spark.createDataFrame(x, schema) for x in (rows[:4], rows[4:], end, late, [(at(2000), 7, "z", 0.0)])]
    got, query = run(spark, tmp_path, batches, lambda s: plan(s, late="20 minutes"))
    want = plan(spark.createDataFrame(rows + end, schema)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    assert orders.dropped_rows(query) >= 1


def test_sessions_end_after_a_gap(spark):
    rows = [(at(m), u) for u, ms in ((1, (0, 29, 58, 100)), (2, (5,))) for m in ms]
    got = windows.sessions(spark.createDataFrame(rows, "ts timestamp, user_id long")).collect()
    assert sorted((r["user_id"], r["start"], r["stop"], r["n"]) for r in got) == [(1, at(0), at(88), 3), (1, at(100), at(130), 1), (2, at(5), at(35), 1)]


# -- paging --------------------------------------------------------------------


def answers(path, pages):
    for offset, answer in pages.items():
        os.makedirs(f"{path}/offset={offset}")
        with open(f"{path}/offset={offset}/part-0.txt", "w") as f:
            f.write(json.dumps(answer))
    return str(path)


def read(spark, path, size=2):
    paging.register(spark)
    return spark.read.format("paged").option("pageSize", size).load(path)


def items(*ids):
    return [{"id": i} for i in ids]


def test_pages_are_read_until_the_total(spark, tmp_path):
    path = answers(tmp_path / "a", {0: {"total": 5, "items": items(1, 2)}, 2: {"total": 5, "items": items(3, 4)}, 4: {"total": 5, "items": items(5)}, 6: {"total": 5, "items": items(6)}})
    rows = read(spark, path)
    assert rows.rdd.getNumPartitions() == 3
    assert sorted((r["page_offset"], r["place"], json.loads(r["item"])["id"]) for r in rows.collect()) == [(0, 0, 1), (0, 1, 2), (2, 0, 3), (2, 1, 4), (4, 0, 5)]


def test_pages_that_cannot_be_used_are_rows_of_their_own(spark, tmp_path):
    path = answers(tmp_path / "a", {0: {"total": 9, "items": items(1, 2)}, 2: {"total": 9, "items": items(3)}, 4: {"total": 8, "items": items(5, 6)}, 6: {"error": "busy"}})
    rows = read(spark, path).collect()
    assert {r["page_offset"]: r["error"] for r in rows if r["error"]} == {2: "1 items of 2", 4: "total 8 after 9", 6: "busy", 8: "no answer for offset 8"}
    assert sorted(json.loads(r["item"])["id"] for r in rows if not r["error"]) == [1, 2, 3]
    assert [r["error"] for r in read(spark, answers(tmp_path / "b", {0: {"error": "down"}})).collect()] == ["down"]
    assert read(spark, answers(tmp_path / "c", {0: {"total": 0, "items": []}})).count() == 0


def test_filters_on_the_offset_decide_which_pages_are_fetched(spark, tmp_path):
    path = answers(tmp_path / "a", {0: {"total": 6, "items": items(1, 2)}, 4: {"total": 6, "items": items(5, 6)}})  # no page 2
    assert read(spark, path).where("page_offset >= 4").select("place", "error").collect() == [(0, None), (1, None)]
    assert read(spark, path).where("page_offset = 0 AND place = 1").count() == 1


def test_of_equal_keys_the_last_one_stays(spark, tmp_path):
    path = str(tmp_path / "a")
    rows = spark.createDataFrame([(i, i % 3, f"n{i}") for i in range(11)], "n long, k long, name string")
    paging.record(rows, path, ["n"], 4)
    paging.register(spark)
    assert sorted(tuple(r) for r in paging.latest_items(spark, path, "n long, k long, name string", ["k"], 4).collect()) == [(8, 2, "n8"), (9, 0, "n9"), (10, 1, "n10")]
    paging.record(rows.limit(0), str(tmp_path / "b"), ["n"], 4)
    assert paging.latest_items(spark, str(tmp_path / "b"), "n long, k long, name string", ["k"], 4).count() == 0


# -- UTM -----------------------------------------------------------------------


def test_utm_of_known_points_and_back(spark):
    """Along the central meridian the northing is the scaled meridian arc; mirrored points mirror; all zones come back."""
    points = [(lon, lat) for lon in range(-180, 180, 7) for lat in (-80, -45, -1, 0, 1, 33, 60, 84)]
    table = spark.createDataFrame([(float(a) + 0.3, float(b)) for a, b in points], "lon double, lat double").withColumn("epsg", geo.utm_zone(F.col("lon"), F.col("lat")))
    there = table.withColumn("p", geo.utm(F.col("lon"), F.col("lat"), F.col("epsg")))
    back = there.withColumn("b", geo.utm_inverse(F.col("p.x"), F.col("p.y"), F.col("epsg"))).collect()
    assert max(max(abs(r["b"]["lon"] - r["lon"]), abs(r["b"]["lat"] - r["lat"])) for r in back) < 1e-9
    known = spark.createDataFrame([(9.0, 0.0, 32632), (9.0, 45.0, 32632), (9.0, 90.0, 32632), (12.0, 30.0, 32632), (6.0, 30.0, 32632), (12.0, -30.0, 32732)], "lon double, lat double, epsg int")
    got = [tuple(r["p"]) for r in known.select(geo.utm(F.col("lon"), F.col("lat"), F.col("epsg")).alias("p")).collect()]
    near = lambda a, b: abs(a - b) < 1e-3
    assert got[0] == (500_000, 0) or near(got[0][0], 500_000) and near(got[0][1], 0)
    assert near(got[1][1], 0.9996 * 4984944.3780) and near(got[2][1], 0.9996 * 10001965.7293)  # arcs of the meridian to 45 and 90 degrees
    assert near(got[3][0] - 500_000, 500_000 - got[4][0]) and near(got[3][1], got[4][1]) and near(got[3][1], 10_000_000 - got[5][1])
