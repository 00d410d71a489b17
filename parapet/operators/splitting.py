"""Deterministic splits and samples from hashes of keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import numbered

#: Splits in order, their shares, and the height bins of the block search.
SPLITS = {"train": 0.70, "val": 0.15, "test": 0.15}
CATEGORIES = ("lowrise", "midrise", "highrise")
BIN_EDGES = (0, 10, 20, 30, 40, 50)
#: Categories of the four chips that a batch takes of each city.
BATCH_PATTERN = ("lowrise", "lowrise", "midrise", "highrise")


def seeded(seed: int | str, *keys: Column | str) -> Column:
    """SHA-256 of 'seed:key:...', the order in which splits take rows."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") if isinstance(k, Column) else F.col(k).cast("string") for k in keys]), 256)


def drawn(below: Column, seed: int | str, *keys: Column | str) -> Column:
    """A hashed number from 0 to under ``below``."""
    return F.conv(F.substring(seeded(seed, *keys), 1, 12), 16, 10).cast("long") % below


def hash_rank(df: DataFrame, key: str, seed: int, rank: str = "rank") -> DataFrame:
    """Each row's place by the hash of its key, from 1."""
    return numbered(df.withColumn("__hash", seeded(seed, key)), ["__hash", key], rank).drop("__hash")


def hash_split(df: DataFrame, key: str, seed: int, cuts: list[tuple[str, int]], rest: str) -> DataFrame:
    """The first rows by hash go to the named splits in turn, the others to ``rest``."""
    out, upto, case = hash_rank(df, key, seed), 0, None
    for name, n in cuts:
        upto += n
        case = F.when(F.col("rank") <= upto, name) if case is None else case.when(F.col("rank") <= upto, name)
    return out.withColumn("split", case.otherwise(rest))


def _by_hash(df: DataFrame, key: str, pool: list[str], seed: int) -> DataFrame:
    """``df`` with pool_number, each row's place in its pool by hash order from 0, and pool_size."""
    return _in_pools(df.withColumn("__hash", seeded(seed, key)), ["__hash", key], pool)[0].drop("__hash")


def fraction_split(df: DataFrame, key: str, by: str, seed: int, train: float = 0.7, validation: float = 0.15) -> DataFrame:
    """Shares of each group by hash order, cut at whole rows rounded down."""
    i, n = F.col("pool_number"), F.col("pool_size")
    first, second = F.floor(n * train), F.floor(n * train) + F.floor(n * validation)
    out = _by_hash(df, key, [by], seed).withColumn("split", F.when(i < first, "train").when(i < second, "validation").otherwise("test"))
    return out.drop("pool_number", "pool_size")


def folds(df: DataFrame, key: str, strata: list[str], k: int, seed: int) -> DataFrame:
    """Fold 0 to k - 1, dealt in turn within each stratum by hash order."""
    return _by_hash(df, key, strata, seed).withColumn("fold", (F.col("pool_number") % k).cast("int")).drop("pool_number", "pool_size")


def bootstrap(df: DataFrame, key: str, runs: int, draws: int, seed: int) -> DataFrame:
    """``runs`` samples of ``draws`` rows with replacement: (run, draw, and the row).

    Rows are numbered by hash; each draw is a hashed row number. An empty table
    gives no rows.
    """
    rows = hash_rank(df, key, seed, "number")
    n = df.count()
    wanted = df.sparkSession.range(runs * draws).select((F.col("id") / draws).cast("int").alias("run"), (F.col("id") % draws).cast("int").alias("draw"))
    wanted = wanted.withColumn("number", drawn(F.lit(max(1, n)), seed, "run", "draw") + 1)
    return wanted.join(rows, "number").drop("number")


def _in_pools(df: DataFrame, order: list[str], pool: list[str]) -> tuple[DataFrame, DataFrame]:
    """``df`` with pool_number and pool_size, and the size of each pool; a null is a pool of its own."""
    placed = numbered(df, [*pool, *order], "__place")
    sizes = placed.groupBy(*pool).agg(F.count(F.lit(1)).alias("pool_size"), F.min("__place").alias("__first"))
    own = sizes.select(*[F.col(c).alias(f"__in_{i}") for i, c in enumerate(pool)], "pool_size", "__first")
    same = reduce(lambda x, y: x & y, [placed[c].eqNullSafe(own[f"__in_{i}"]) for i, c in enumerate(pool)])
    rows = placed.join(own, same).withColumn("pool_number", F.col("__place") - F.col("__first"))
    return rows.select(*df.columns, "pool_number", "pool_size"), sizes.drop("__first")


def pooled(df: DataFrame, key: str, pool: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows with their number in their pool, from 0 in order of keys, and the size of each pool.

    A pool is numbered by its first row's place among all rows in order of pool and
    key, so that a very large pool is no single task's work.
    """
    rows, sizes = _in_pools(df, [key], pool)
    return rows.drop("pool_size"), sizes


def balanced_batches(df: DataFrame, key: str, city: str, category: str, cities: list[str], seed: int, epoch: int = 0) -> DataFrame:
    """(batch, slot, city, category, key): batches of four chips of each city, two low, one mid, one high.

    As many batches as chips of these cities fill eights. Each place takes a hashed
    member of its pool, so chips come again. Raises if a pool is empty.
    """
    own = df.where(F.col(city).isin(*cities)).select(key, city, category)
    rows, sizes = pooled(own, key, [city, category])
    n = own.count()
    held = {(r[city], r[category]) for r in sizes.collect()}  # one row a pool
    lacking = [(c, k) for c in cities for k in CATEGORIES if (c, k) not in held]
    if lacking:
        raise ValueError(f"empty pools: {lacking}")
    places = F.array(*[F.struct(F.lit(c).alias(city), F.lit(k).alias(category), F.lit(4 * i + j).alias("slot")) for i, c in enumerate(cities) for j, k in enumerate(BATCH_PATTERN)])
    wanted = df.sparkSession.range(-(-n // 8)).select(F.col("id").alias("batch"), F.explode(places).alias("p")).select("batch", "p.*")
    wanted = wanted.join(F.broadcast(sizes), [city, category])
    wanted = wanted.withColumn("pool_number", drawn(F.col("pool_size"), seed + epoch, "batch", "slot"))
    return wanted.join(rows, [city, category, "pool_number"]).select("batch", "slot", city, category, key)


def oversample(df: DataFrame, key: str, city: str, flag: str, count: int, share: float, seed: int) -> DataFrame:
    """(city, draw, key) of ``count`` rows a city: ``share`` of them flagged rows with replacement, the rest other rows.

    The other rows come without replacement where the city has enough of them, by
    hash order, else with replacement; a city without other rows takes any.
    Cities without flagged rows are left out.
    """
    many = int(round(count * share))
    rows, sizes = pooled(df.select(key, city, flag), key, [city, flag])
    of = lambda on, n: sizes.where(F.col(flag) == on).select(city, F.col("pool_size").alias(n))
    cities = of(True, "n_flagged").join(of(False, "n_other"), city, "left")
    wanted = cities.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    with_flag = (F.col("draw") < many) | F.col("n_other").isNull()
    wanted = wanted.withColumn(flag, with_flag).withColumn("n", F.when(with_flag, F.col("n_flagged")).otherwise(F.col("n_other")))
    again = (F.col("draw") < many) | F.col("n_other").isNull() | (F.col("n_other") < count - many)
    by_hash = Window.partitionBy(city).orderBy(seeded(seed, key), key)
    # Only the first by hash can be taken without replacement: Spark cuts each task's rows of a city to ``count`` before the shuffle.
    place = rows.where(~F.col(flag)).withColumn("place", F.row_number().over(by_hash)).where(F.col("place") <= count)
    order = place.select(city, (F.col("place") - 1).alias("turn"), F.col(key))
    repeated = wanted.where(again).withColumn("pool_number", drawn(F.col("n"), seed, city, "draw")).join(rows, [city, flag, "pool_number"]).select(city, "draw", key)
    fresh = wanted.where(~again).withColumn("turn", F.col("draw") - many).join(order, [city, "turn"]).select(city, "draw", key)
    return repeated.union(fresh)


def block_features(chips: DataFrame, city: str, block: list[str], median: str, p90: str, most: str, category: str, heights: str, parts: str) -> DataFrame:
    """Sums of each block: chips, buildings, three height features, which categories it holds, and its counts by height bin.

    ``parts`` counts a chip's buildings and ``heights`` is the height by which they fall into bins.
    """
    bins = [(low, high) for low, high in zip(BIN_EDGES, [*BIN_EDGES[1:], None], strict=True)]
    inside = lambda low, high: (F.col(heights) >= low) & (F.col(heights) < high if high is not None else F.lit(True))
    return chips.groupBy(city, *block).agg(
        F.count(F.lit(1)).alias("chips"), F.sum(parts).alias("buildings"), F.sum(median).alias("f0"), F.sum(p90).alias("f1"), F.sum(F.log1p(F.col(most))).alias("f2"),
        *[F.max((F.col(category) == c).cast("int")).alias(f"has{i}") for i, c in enumerate(CATEGORIES)],
        *[F.sum(F.when(inside(low, high), F.col(parts)).otherwise(0)).alias(f"bin{i}") for i, (low, high) in enumerate(bins)],
    )


def block_split(blocks: DataFrame, city: str, block: list[str], attempts: int, seed: int) -> DataFrame:
    """The best of ``attempts`` shuffled splits of blocks: (city, block..., split, attempt, score).

    Each attempt puts a city's blocks in hash order; fixed numbers of them go to
    the splits. An attempt is feasible if every split holds each category that
    three blocks of the city at least have. The score adds up, over cities and
    splits, how far chips, buildings, height bins and features are from their
    targets. ``blocks`` has a few hundred rows a city, so attempts multiply a
    small table. Raises where a city has too few blocks or no attempt is feasible.
    """
    w = Window.partitionBy(city)
    n_bins = len(BIN_EDGES)
    n = F.count(F.lit(1)).over(w)
    least = lambda share: F.greatest(F.lit(4), F.bround(n * share).cast("int"))
    sized = blocks.withColumns({"n_val": least(SPLITS["val"]), "n_test": least(SPLITS["test"]), "n_blocks": n})
    if not sized.where("n_val + n_test >= n_blocks").isEmpty():
        raise ValueError("a city has too few blocks for its validation and test blocks")
    tries = sized.withColumn("attempt", F.explode(F.sequence(F.lit(0), F.lit(attempts - 1))))
    turn = F.row_number().over(Window.partitionBy("attempt", city).orderBy(seeded(seed, "attempt", city, *block), *block))
    n_train = F.col("n_blocks") - F.col("n_val") - F.col("n_test")
    tries = tries.withColumn("turn", turn).withColumn("split", F.when(F.col("turn") <= n_train, "train").when(F.col("turn") <= n_train + F.col("n_val"), "val").otherwise("test"))
    names = ["chips", "buildings", *[f"f{i}" for i in range(3)], *[f"has{i}" for i in range(3)], *[f"bin{i}" for i in range(n_bins)]]
    whole = blocks.groupBy(city).agg(*[F.sum(c).alias(f"all_{c}") for c in names])
    part = tries.groupBy("attempt", city, "split").agg(*[F.sum(c).alias(c) for c in names]).join(F.broadcast(whole), city)  # one row a city
    lacks = sum((F.when((F.col(f"all_has{i}") >= len(SPLITS)) & (F.col(f"has{i}") == 0), 1).otherwise(0) for i in range(3)), F.lit(0))
    target = F.element_at(F.create_map(*[F.lit(x) for kv in SPLITS.items() for x in kv]), F.col("split"))
    positive = lambda c: F.greatest(F.col(c), F.lit(1))
    bins = "({})".format(" + ".join(f"{{0}}bin{i}" for i in range(n_bins)))
    in_bins, all_in_bins = F.greatest(F.expr(bins.format("")), F.lit(1)), F.greatest(F.expr(bins.format("all_")), F.lit(1))
    square = lambda x: x * x
    bin_gap = sum((square(F.col(f"bin{i}") / in_bins - F.col(f"all_bin{i}") / all_in_bins) / (F.col(f"all_bin{i}") / all_in_bins + 0.02) for i in range(n_bins)), F.lit(0.0)) / n_bins
    mean = lambda p, i: F.col(f"{p}f{i}") / F.col(f"{p}chips")
    feature_gap = sum((square((mean("", i) - mean("all_", i)) / F.greatest(F.abs(mean("all_", i)), F.lit(1.0))) for i in range(3)), F.lit(0.0)) / 3
    score = 20 * square(F.col("chips") / F.col("all_chips") - target) + 8 * square(F.col("buildings") / positive("all_buildings") - target) + bin_gap + 0.5 * feature_gap
    scored = part.select("attempt", lacks.alias("lacks"), score.alias("score")).groupBy("attempt").agg(F.sum("lacks").alias("lacks"), F.round(F.sum("score"), 9).alias("score"))
    best = scored.where("lacks = 0").orderBy("score", "attempt").select("attempt", "score").first()
    if best is None:
        raise ValueError("no feasible split was found")
    return tries.where(F.col("attempt") == best["attempt"]).select(city, *block, "split", "attempt", F.lit(best["score"]).alias("score"))
