"""Ranked search against sums over all documents."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from parapet.llm import search

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain_search(docs, items, k):
    counts = [(d, Counter(terms(t))) for d, t in docs]
    docs_n, all_terms = sum(bool(c) for _, c in counts), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        found = []
        for d, c in counts:
            score = 0
            for t in set(terms(text)) & c.keys():
                m = 100 - 50 + (50 * c.total() * docs_n) // all_terms
                score += math.floor(1000 * math.log((2 * docs_n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m))
            if score > 0:
                found.append((-score, d is not None, d or 0))
        out += [(item, rank + 1, d if known else None, -s) for rank, (s, known, d) in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


def test_terms():
    text = "Abc-DEF 12é\x00x_y Ünder\x7fÀB \x85 日本"
    assert [t.decode() for t in search.terms_of(text.encode())] == terms(text) == ["abc", "def", "12é", "x", "y", "Ünder", "Àb", "\x85", "日本"]


@pytest.mark.parametrize("segment", [7, 4_000])
def test_search_against_sums(spark, monkeypatch, segment):
    """Null, empty and very long texts, repeated rows and ids, ties, hot terms; small and large segments; items in several blocks."""
    monkeypatch.setattr(search, "SEGMENT_DOCS", segment)
    rng = random.Random(segment)
    words = [f"W{int(rng.paretovariate(0.7)) % 400}" for _ in range(5000)]
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(1, 60)))) for i in range(300)]
    docs += [(300, None), (301, ""), (302, "--"), (303, "w1 " * 40_000), *[(400 + i, "w1 w2, w3! É") for i in range(70)], (5, "w1 w2"), (None, "w1 w9")]
    items = [(1, "w1 w2 W1"), (2, None), (3, ""), (4, "unknown terms"), (5, "w1 w2 w3 é É w17"), (None, "w9"), (6, " ".join(words[:300])), (1, "w3"), (7, "w17 w1")]
    index = search.build(spark.createDataFrame(docs, "doc_id long, text string").withColumns({"n": F.lit("x"), "terms": F.lit(1), "segment": F.lit(2)}).repartition(3))
    monkeypatch.setattr(search, "BLOCK_TERMS", 5)
    assert index.postings().where("term is null").count() >= (40 if segment == 7 else 1)
    got = sorted(map(tuple, index.search(spark.createDataFrame(items, "item_id long, text string"), 50).collect()), key=str)
    assert got == plain_search(docs, items, 50)
    index.remove()


def test_search_of_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id string, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert [tuple(r)[:3] for r in search.build(docs).search(items, 3).collect()] == [(1, 1, "1")]
    assert search.build(docs.limit(0)).search(items, 3).count() == 0
    assert search.build(docs).search(items.limit(0), 3).columns == ["item_id", "rank", "doc_id", "score"]


def test_postings_are_grouped_by_exact_impact_in_descending_order(spark):
    docs = spark.createDataFrame([(i, "a " * (1 + i % 3) + "b") for i in range(30)], "doc_id long, text string").coalesce(1)
    rows = {r["term"]: r for r in search.build(docs).postings().collect()}
    assert list(rows[None]["ids"]) == list(range(30))
    a = rows["a"]
    assert a["impacts"] == sorted(set(a["impacts"]), reverse=True) and a["ends"] == [10, 20, 30]
    assert [[s % 3 for s in a["slots"][i : i + 10]] for i in (0, 10, 20)] == [[2] * 10, [1] * 10, [0] * 10]


def test_stops_only_when_the_best_are_certain():
    """A rare heavy term decides before a common light one is read; without such a term all is read. The rows are right in both."""
    rng = np.random.default_rng(1)

    def term(weight, slots, kinds):
        impacts = np.sort(rng.choice(np.arange(1, 1000), kinds, replace=False))[::-1].astype(np.int64)
        ends = np.sort(rng.choice(np.arange(1, len(slots)), kinds - 1, replace=False))
        return weight, impacts, np.append(ends, len(slots)).astype(np.int32), rng.permutation(slots).astype(np.int32)

    def check(postings, n, k):
        want = np.zeros(n, np.int64)
        for w, impacts, ends, slots in postings:
            want[slots] += w * np.repeat(impacts, np.diff(ends, prepend=0))
        slots, scores, added = search.best_of(postings, n, k)
        order = sorted((i for i in range(n) if want[i]), key=lambda i: (-want[i], i))[:k]
        assert slots.tolist() == order and scores.tolist() == [want[i] for i in order]
        return added / sum(len(s) for *_, s in postings)

    everywhere, few = np.arange(20_000), rng.choice(20_000, 300, replace=False)
    assert check([term(9000, few, 40), term(1, everywhere, 30)], 20_000, 50) < 0.2
    assert check([term(5, everywhere, 30), term(5, everywhere, 30)], 20_000, 50) > 0.5
    for _ in range(200):
        n = int(rng.integers(2, 300))
        postings = [term(int(rng.integers(0, 50)), rng.choice(n, int(rng.integers(2, n + 1)), replace=False), 2) for _ in range(int(rng.integers(1, 6)))]
        check(postings, n, int(rng.integers(1, 20)))
