"""Byte-level BPE against tiktoken and round trips."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from parapet.llm import bytebpe, queries

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PIECES = ["entente", "banana", "-----", "ananas", "é", "日本語日本語", "💩", "'s", "'LL", "  ", "\n", " ", "a", "ere", "aha", "x", "1", "٣", "\x1c", "\x85", "　", "\x00", "ß", "ging", "ette", "𝔘"]


@pytest.fixture(scope="module")
def known():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bytebpe.read_ranks(PATH), special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    return bytebpe.Encoder(PATH, public_tokenizers.PATTERN)


def numbers(stream):
    return np.frombuffer(stream, "<u4").tolist()


def test_ids_of_mixed_texts_are_those_of_tiktoken(known, encoder):
    rng = random.Random(1)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 40))) for _ in range(20_000)]
    assert list(map(numbers, encoder.encode(texts))) == known.encode_ordinary_batch(texts)
    again = list(map(numbers, encoder.encode(texts[::-1])))  # from what is remembered
    assert again[::-1] == known.encode_ordinary_batch(texts)


def test_ids_of_every_character_are_those_of_tiktoken(known, encoder):
    texts = [f"a{c}b {c}1 !{c}  {c}\n {c}x" for c in map(chr, [*range(0xD800), *range(0xE000, 0x20000), *range(0x20000, 0x110000, 97)])]
    for at in range(0, len(texts), 100_000):
        some = texts[at : at + 100_000]
        assert list(map(numbers, encoder.encode(some))) == known.encode_ordinary_batch(some)


def test_a_very_long_match(known, encoder):
    text = "ab" * 100_000 + " " + "日本語" * 20_000
    assert numbers(encoder.encode([text])[0]) == known.encode_ordinary(text)


def test_the_bound_on_remembered_parts_changes_nothing(known, encoder, monkeypatch):
    monkeypatch.setattr(bytebpe, "CACHE_PARTS", 10)
    small = bytebpe.Encoder(PATH, public_tokenizers.PATTERN)
    for at in range(5):
        texts = [f"word{i} other{i % 7} more" for i in range(at, at + 50)]
        assert list(map(numbers, small.encode(texts))) == known.encode_ordinary_batch(texts)


def test_query_against_tiktoken(spark, known):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op13_bytebpe(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = np.array(known.encode_ordinary(texts[r["doc_id"]]), "<u4")
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest())


ODD = [(1, None), (2, ""), (3, "日本💩 é"), (3, "日本💩 é"), (None, "four five"), (4, "x " * 20_000), (5, " \n\t "), (6, "�")]


@pytest.mark.parametrize("packed", [False, True])
def test_round_trip_of_odd_rows(spark, packed):
    docs = spark.createDataFrame(ODD, "doc_id long, text string").withColumns({"ids": F.lit("replaced"), "decoded": F.lit(1), "score": F.lit(7.0)})
    encoded = bytebpe.encode(docs, PATH, public_tokenizers.PATTERN, packed=packed)
    rows = bytebpe.decode(encoded, PATH).collect()
    assert sorted((r["doc_id"] or 0, r["decoded"], bytes(r["decoded_bytes"]), r["score"]) for r in rows) == sorted((d or 0, t or "", (t or "").encode(), 7.0) for d, t in ODD)
    assert bytebpe.decode(encoded.limit(0), PATH).count() == 0


def test_spans_cover_whole_characters(spark):
    text = "ab 日本💩 é!"
    r = bytebpe.encode(spark.createDataFrame([(text,), (None,)], "text string"), PATH, public_tokenizers.PATTERN, spans=True).where("text is not null").first()
    tokens = [bytebpe.Decoder(PATH).data([i]) for i in r["ids"]]
    data, at = text.encode(), 0
    for token, start, end in zip(tokens, r["ids_start"], r["ids_end"], strict=True):
        covered = text[start:end].encode()
        assert token in covered and len(text[:start].encode()) <= at and len(text[:end].encode()) >= at + len(token)
        assert len(text[: start + 1].encode()) > at and len(text[: end - 1].encode()) < at + len(token)
        at += len(token)
    assert at == len(data) and any(not t.decode("utf-8", "ignore") for t in tokens)


def test_decoding_puts_split_characters_together(spark):
    decoder, ranks = bytebpe.Decoder(PATH), bytebpe.read_ranks(PATH)
    single = [ranks[bytes([b])] for b in "é💩".encode()]
    assert decoder.texts(single) == ["", "é", "", "", "", "💩"]
    assert decoder.texts(single[:1]) == ["�"] and decoder.texts([]) == []
    cut = spark.createDataFrame([(single[:4],), (None,), ([],)], "ids array<int>")
    assert [(r["decoded"], r["decoded_bytes"]) for r in bytebpe.decode(cut, PATH).collect()] == [("é�", "é💩".encode()[:4]), (None, None), ("", b"")]
    for wrong in (60_000, -1):
        with pytest.raises(Exception, match="not in the vocabulary|out of range"):
            bytebpe.decode(spark.createDataFrame([([wrong],)], "ids array<int>"), PATH).collect()
