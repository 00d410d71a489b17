"""The Merkle manifest against trees built in plain Python."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from parapet.llm import manifest

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
DOCS = "doc_id long, source string, lang string, n_chars long, text string"


def h(*texts):
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def leaf(row, text):
    values = [*(row[c] for c in FIELDS[:-1]), text]
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def lowered(text):
    return text and "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def tree(digests):
    """What remains, and (before, after) of each leaf on every level."""
    steps, at = [[] for _ in digests], list(range(len(digests)))
    while len(digests) > 1:
        for i, p in enumerate(at):
            run = digests[p // 8 * 8 : p // 8 * 8 + 8]
            steps[i].append(("".join(run[: p % 8]), "".join(run[p % 8 + 1 :])))
        digests, at = [h(*digests[i : i + 8]) for i in range(0, len(digests), 8)], [p // 8 for p in at]
    return digests[0], steps


def plain_audit(rows):
    groups = {}
    for row in rows:
        bad = zlib.crc32(("null" if row["doc_id"] is None else str(row["doc_id"])).encode()) % 3 == 0
        groups.setdefault(row["lang"], []).append((row["doc_id"], leaf(row, row["text"]), leaf(row, lowered(row["text"]) if bad else row["text"])))
    if not groups:
        return []
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    below = {}
    for g in order:
        groups[g].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        below[g] = tree([x[1] for x in groups[g]])
    root, above = tree([below[g][0] for g in order])
    out = []
    for g, up in zip(order, above, strict=True):
        for (doc_id, digest, folded), steps in zip(groups[g], below[g][1], strict=True):
            for before, after in steps + up:
                folded = h(before, folded, after)
            out.append((doc_id, digest, below[g][0], root, h(*(a + b for a, b in steps + up)), folded, folded == root))
    return sorted(out, key=str)


def audited(spark, rows):
    docs = spark.createDataFrame([tuple(r[c] for c in FIELDS) for r in rows], DOCS).withColumns({"digest": F.lit("x"), "place": F.lit(1), "node": F.lit(2), "key": F.lit(3)})
    bad = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))) % 3 == 0
    return sorted(map(tuple, manifest.audit(docs, bad, manifest.lower_ascii(F.col("text"))).collect()), key=str)


@pytest.mark.parametrize("n,langs", [(0, ["a"]), (1, ["a"]), (8, [None]), (9, ["é", None]), (700, ["a", "b", None, "ü", "", "Z"]), (1500, [f"x{i}" for i in range(70)]), (2500, ["a"] * 60 + ["b"])])
def test_audit_against_plain_trees(spark, n, langs):
    """Null and repeated ids, repeated rows, nulls and empties in each column, one hot group, more groups than a run holds."""
    rng = random.Random(n)
    rows = [
        {"doc_id": rng.choice([None, i, i, i, i // 2]), "source": rng.choice([None, "", "s"]), "lang": rng.choice(langs), "n_chars": rng.choice([None, 3]), "text": rng.choice([None, "", f"Abc É {i % 50}", "xyz", "W " * 5000])}
        for i in range(n)
    ]
    assert audited(spark, rows) == plain_audit(rows)


def test_levels_are_the_same_however_tasks_part_the_rows(spark):
    leaves = spark.range(1000).select(F.lit("g").alias("grp_key"), F.col("id").alias("key"), F.sha2(F.col("id").cast("string"), 256).alias("digest"))
    roots = set()
    for parts in ("1", "3", "17"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            made = manifest.build(leaves.repartition(int(parts)))
            roots.add(made.root)
            sizes = [(level, made.leaves.rows(level).count()) for level in range(made.leaves.levels)]
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
        assert sizes == [(0, 125), (1, 16), (2, 2), (3, 1)]
        assert made.proofs().where(manifest.fold(F.col("node.digest"), F.col("proof")) != made.root).count() == 0
        made.remove()
    assert len(roots) == 1


def test_a_changed_step_breaks_a_proof(spark):
    made = manifest.build(spark.range(100).select(F.lit(None).cast("string").alias("grp_key"), F.col("id").alias("key"), F.sha2(F.col("id").cast("string"), 256).alias("digest")))
    wrong = F.transform("proof", lambda s: F.struct(s["after"].alias("before"), s["before"].alias("after")))
    assert made.proofs().where(manifest.fold(F.col("node.digest"), wrong) == made.root).count() == 0
