"""Small cases of the operators: guards, selection, streams."""

import pytest
from pyspark.sql import functions as F

from parapet.operators import components, guards, ordering, raster, selection, spatial, splitting
from parapet.streaming import windows


def test_guards_name_what_is_wrong(spark):
    df = spark.createDataFrame([(1, "a"), (1, None), (2, "b")], "k int, v string")
    with pytest.raises(ValueError, match="missing columns: z"):
        guards.require_columns(df, ["k", "z"])
    with pytest.raises(ValueError, match="duplicate keys"):
        guards.require_unique(df, ["k"])
    assert guards.conform(df, ["v", "new"]).columns == ["v", "new"]
    assert {(r["column"], r["missing"]) for r in guards.null_counts(df, ["k", "v"]).collect()} == {("k", 0), ("v", 1)}
    assert guards.null_counts(df.limit(0), ["k"]).first()["rows"] == 0


def test_greedy_takes_no_candidate_twice_and_stops_when_none_is_left(spark):
    df = spark.createDataFrame([("a", 1, 2016), ("a", 2, 2016), ("a", 3, 2017), ("b", 9, 2016)], "city string, id int, year int")
    used = lambda c, chosen, slot: F.struct(F.size(F.filter(chosen, lambda x: x["year"] == c["year"])).alias("used"), c["id"].alias("id"))
    rows = selection.greedy(df, "city", 3, used, ["id", "year"]).orderBy("city", "slot").collect()
    assert [(r["city"], r["slot"], r["id"]) for r in rows] == [("a", 1, 1), ("a", 2, 3), ("a", 3, 2), ("b", 1, 9)]


def test_consecutive_and_running_best(spark):
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate([3, 2, 5, 5, 1])], "g string, i int, v int")
    runs = selection.consecutive(df, "g", "i", F.col("v") >= 3).orderBy("i").collect()
    assert [r["run"] for r in runs] == [1, 0, 1, 2, 0]
    best = selection.running_best(df, "g", "i", "v").orderBy("i").collect()
    assert [(r["best"], r["best_at"]) for r in best] == [(3, 0), (2, 1), (2, 1), (2, 1), (1, 4)]


def test_components_of_permuted_chain_hub_and_words(spark):
    n = 1999
    chain = spark.range(n - 1).select((F.col("id") * 7919 % n).alias("u"), ((F.col("id") + 1) * 7919 % n).alias("v"))
    assert [tuple(r) for r in components.components(chain).groupBy("root").count().collect()] == [(0, n)]
    hub = spark.range(100_000).select((F.col("id") * 0 + 100_000).alias("u"), F.col("id").alias("v"))
    assert [tuple(r) for r in components.components(hub).groupBy("root").count().collect()] == [(0, 100_001)]
    words = spark.createDataFrame([("b", "c"), ("c", "a"), ("x", "y"), ("y", "x"), ("z", "z")], "u string, v string")
    assert {r["node"]: r["root"] for r in components.components(words).collect()} == dict.fromkeys("abc", "a") | dict.fromkeys("xy", "x")
    assert components.components(words.limit(0)).count() == 0


def test_components_leave_one_table_behind(spark):
    from parapet.operators import tables

    def folders():
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(tables.shared_dir(spark))
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        return {s.getPath().getName() for s in fs.listStatus(path) if s.getPath().getName().startswith("left-behind")} if fs.exists(path) else set()

    before = folders()  # the folder may be shared with other runs
    components.components(spark.range(20).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v")), "left-behind").count()
    assert len(folders() - before) == 1


def test_stream_and_batch_give_the_same_hours(spark, tmp_path):
    source = "/root/testdata/sf0.001/events.parquet"
    batch = spark.read.parquet(source).select("event_type", "ts", "value")
    batch.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = windows.hourly(stream).writeStream.format("memory").queryName("hours").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    want = {(r["start"], r["event_type"]): r["n"] for r in windows.hourly(batch).collect()}
    assert {(r["start"], r["event_type"]): r["n"] for r in spark.table("hours").collect()} == want


def test_latest_rows_survive_batches(spark, tmp_path):
    for i, rows in enumerate([[(1, 1, "old"), (2, 5, "stays")], [(1, 2, "new"), (2, 4, "late")]]):
        spark.createDataFrame(rows, "k int, at int, v string").coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
        stream = spark.readStream.schema("k int, at int, v string").parquet(str(tmp_path / "in/*"))
        query = windows.upsert_latest(stream, str(tmp_path / "out"), str(tmp_path / "cp"), ["k"], "at").trigger(availableNow=True).start()
        query.awaitTermination(120)
    versions = sorted((tmp_path / "out").iterdir())
    assert {(r["k"], r["v"]) for r in spark.read.parquet(str(versions[-1])).collect()} == {(1, "new"), (2, "stays")}


def test_slugs_of_world_cities(spark):
    import random
    import re
    import unicodedata

    rng = random.Random(1)
    names = ["Plzeň Škoda", "Łódź", "Hà Nội", "São Paulo", "İstanbul", "Ｔｏｋｙｏ", "Reykjavík (höfuð)", "½ Ĳmuiden ﬁn", "Ōsaka", "北京", "ß", None, ""]
    names += ["".join(chr(rng.choice((rng.randrange(32, 127), rng.randrange(0xA0, 0x250), rng.randrange(0x1E00, 0x1F00)))) for _ in range(12)) for _ in range(300)]

    def plain(text):
        if text is None:
            return None
        ascii_text = unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode()
        return re.sub("[^a-z0-9]+", "_", ascii_text.lower()).strip("_")

    from parapet.functions import scalars

    rows = spark.createDataFrame([(n,) for n in names], "name string").select("name", scalars.slug(F.col("name")).alias("slug")).collect()
    assert [(r["name"], r["slug"]) for r in rows] == [(n, plain(n)) for n in names]


def test_running_sums_over_parts(spark):
    df = spark.range(1000).select((F.col("id") * 389 % 1000).alias("k"), (F.col("id") % 7).alias("v")).repartition(5)
    rows = sorted((r["k"], r["v"], r["up"], r["n"]) for r in ordering.running(df, ["k"], {"up": F.col("v"), "n": F.lit(1).cast("long")}).collect())
    up = 0
    for i, (k, v, got, n) in enumerate(rows):
        up += v
        assert (k, got, n) == (i, up, i + 1)
    assert ordering.numbered(df.limit(0), ["k"]).count() == 0


def test_template_must_cover_exactly(spark):
    a, b = spark.range(5).withColumnRenamed("id", "chip"), spark.range(1, 6).withColumnRenamed("id", "chip")
    assert guards.exact_cover(a, a, "chip").isEmpty()
    assert sorted(map(tuple, guards.exact_cover(a, b, "chip").collect())) == [(0, "missing"), (5, "unknown")]


# -- contract of a training set: partition, leakage, statistics, augmentation, batches --


@pytest.fixture(scope="module")
def chips(spark):
    from parapet.plans import views

    return views.view(spark, "/root/testdata/sf0.001", "chips")


def test_splits_cover_all_chips_without_overlap(spark, chips):
    split = splitting.fraction_split(chips, "chip", "city", 7)
    assert split.count() == chips.count() == split.select("chip").distinct().count()
    assert {r[0] for r in split.select("split").distinct().collect()} == {"train", "validation", "test"}
    assert guards.exact_cover(chips, split, "chip").isEmpty()


def test_spatial_blocks_do_not_cross_splits(spark):
    from parapet import plans

    rows = plans.QUERIES["block_split_search"](spark, "/root/testdata/sf0.01").collect()
    at = {}
    for r in rows:
        at.setdefault((r["city"], r["r"], r["c"]), set()).add(r["split"])
    assert all(len(x) == 1 for x in at.values())
    for city in {r["city"] for r in rows}:
        own = [r["split"] for r in rows if r["city"] == city]
        few = max(4, round(len(own) * 0.15))
        assert (own.count("val"), own.count("test")) == (few, few)


def test_block_split_without_a_feasible_attempt_raises(spark):
    blocks = spark.createDataFrame([("a", i, 0, 1, 1, 1.0, 1.0, 1.0, 1, 0, 0, 1, 0, 0, 0, 0, 0) for i in range(8)], "city string, r int, c int, chips int, buildings int, f0 double, f1 double, f2 double, has0 int, has1 int, has2 int, bin0 int, bin1 int, bin2 int, bin3 int, bin4 int, bin5 int")
    with pytest.raises(ValueError, match="too few blocks"):
        splitting.block_split(blocks, "city", ["r", "c"], 4, 1)


def test_statistics_come_from_training_chips_only(spark, chips):
    split = splitting.fraction_split(chips, "chip", "city", 7).withColumn("v", F.when(F.col("split") == "train", F.col("worth")).otherwise(F.lit(1e12)))
    train = split.where("split = 'train'").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("d")).first()
    assert train["m"] < 1e9 and train["d"] > 0


def test_augmentation_keeps_mask_and_values_together(spark):
    cells = spark.range(40 * 64).select(F.floor(F.col("id") / 64).alias("chip"), (F.floor(F.col("id") / 8) % 8).cast("int").alias("r"), (F.col("id") % 8).cast("int").alias("c"), F.col("id").alias("v"), (F.col("id") % 3 == 0).alias("mask"))
    turned = raster.augment(cells, "chip", 8, 3)
    rows = turned.collect()
    assert all(x["mask"] == (x["v"] % 3 == 0) for x in rows)
    assert len({(x["chip"], x["r"], x["c"]) for x in rows}) == 40 * 64 and {x["r"] for x in rows} == {x["c"] for x in rows} == set(range(8))
    moved = {x["chip"] for x in rows if (x["r"], x["c"]) != (x["v"] // 8 % 8, x["v"] % 8)}
    assert 25 < len(moved) < 40
    for chip in range(40):  # neighbours stay neighbours
        at = {x["v"]: (x["r"], x["c"]) for x in rows if x["chip"] == chip}
        assert all(abs(at[v][0] - at[v + 1][0]) + abs(at[v][1] - at[v + 1][1]) == 1 for v in at if v % 8 < 7)


def test_batches_have_the_asked_composition(spark, chips):
    from collections import Counter

    from parapet import plans

    rows = plans.QUERIES["balanced_batches"](spark, "/root/testdata/sf0.001").collect()
    batches = {}
    for r in rows:
        batches.setdefault(r["batch"], []).append((r["city"], r["category"]))
    want = Counter({(c, k): n for c in ("1-URGENT", "2-HIGH") for k, n in (("lowrise", 2), ("midrise", 1), ("highrise", 1))})
    assert batches and all(Counter(b) == want for b in batches.values())
    one = spark.createDataFrame([(1, "x", "lowrise")], "chip long, city string, category string")
    with pytest.raises(ValueError, match="empty pools"):
        splitting.balanced_batches(one, "chip", "city", "category", ["x", "y"], 1)


def test_oversample_with_few_or_no_other_rows(spark):
    rows = [(i, "a", i % 2 == 0) for i in range(10)] + [(i, "b", True) for i in range(20, 23)] + [(30, "c", False)]
    got = splitting.oversample(spark.createDataFrame(rows, "chip long, city string, high boolean"), "chip", "city", "high", 8, 0.5, 1).collect()
    a = [r["chip"] for r in got if r["city"] == "a"]
    assert sum(x % 2 == 0 for x in a) == 4 and len({x for x in a if x % 2}) == 4
    assert len([r for r in got if r["city"] == "b"]) == 8 and not [r for r in got if r["city"] == "c"]


def test_polygon_with_a_hole(spark):
    from parapet.functions import geo

    p = lambda *xy: F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in xy])
    rings = F.array(p((0, 0), (10, 0), (10, 10), (0, 10), (0, 0)), p((3, 3), (7, 3), (7, 7), (3, 7), (3, 3)))
    points = spark.createDataFrame([(1.0, 1.0), (5.0, 5.0), (8.0, 5.0), (11.0, 5.0)], "x double, y double")
    assert [r[0] for r in points.select(geo.inside_polygon(F.col("x"), F.col("y"), rings)).collect()] == [True, False, True, False]


def test_area_of_a_union_of_any_rectangles(spark):
    import random

    rng = random.Random(8)
    boxes = []
    for g in "ab":
        for _ in range(60):
            x, y = rng.uniform(-20, 40), rng.uniform(-20, 40)
            boxes.append((g, x, y, x + rng.choice((0.0, rng.uniform(0, 30))), y + rng.uniform(0, 25)))
    boxes += [("c", 0.5, 0.5, 2.5, 1.0)] * 3
    want = {}
    for g in "abc":
        own = [b[1:] for b in boxes if b[0] == g]
        xs, ys = (sorted({v for b in own for v in (b[i], b[i + 2])}) for i in (0, 1))
        want[g] = sum((x2 - x1) * (y2 - y1) for x1, x2 in zip(xs, xs[1:]) for y1, y2 in zip(ys, ys[1:]) if any(b[0] <= x1 and x2 <= b[2] and b[1] <= y1 and y2 <= b[3] for b in own))
    got = spatial.covered_area(spark.createDataFrame(boxes, "g string, xmin double, ymin double, xmax double, ymax double"), ["g"]).collect()
    assert {r["g"]: r["area"] for r in got} == pytest.approx(want)
