"""Token ids in a content-addressed store.

Writing. Texts become token ids. A rolling hash over the ids cuts each document
into chunks wherever the hash of the last 16 ids ends in zeros, so equal passages
give equal chunks wherever they stand. A chunk is addressed by the SHA-256 of its
bytes. The store holds

* ``rows`` of kind chunk: one row a unique chunk, its address and payload,
* ``recipes``: the chunk addresses of each document, in files of ascending doc_id,
  with the SHA-256 of these addresses as the document's leaf,
* ``manifest``: one Merkle node a recipe file, over its documents' leaves; the
  root is the hash over these nodes.

(``rows`` of kind recipe are the recipes as they were made, before they were put in order.)

Reading. Payloads are held against their addresses, recipes against payloads,
leaves and nodes. What doesn't agree raises an error.

Ids are written as little-endian unsigned 16-bit numbers where the vocabulary
allows it, else as 32-bit numbers.

A document is encoded in one task, so its recipe is whole there. A payload is
shuffled once, to the partition of its address, and a task sends each address
once: a chunk that a third of all documents hold arrives there once a task.
"""

from __future__ import annotations

import hashlib
import os
import re
import string
import zlib
from collections.abc import Iterator
from itertools import compress, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, drop_table, give_back_memory, in_slices

END_ID = 2
#: Chunks end where this many low bits of the rolling hash are zero, so on average every 512 ids.
CUT_BITS = 9
MIN_CHUNK, MAX_CHUNK = 128, 2048
_RANGE = 16
#: Words whose ids a worker remembers, which bounds its memory to some 150 MB.
CACHE_WORDS = 500_000
#: Of these, words that it still remembers between two tasks, when it may wait while others run.
RESTING_WORDS = 100_000
BATCH_DOCS = 1000
#: Bytes of texts that are encoded at once, or one text.
BATCH_BYTES = 1 << 21
#: Addresses that a task remembers to have sent, which bounds its memory.
SENT_ADDRESSES = 300_000
#: Documents in a recipe file at most, or as many as the shuffle partitions give.
PART_DOCS = 200_000


def _gear(ids: np.ndarray) -> np.ndarray:
    """A pseudo-random 64-bit number for each id (splitmix64)."""
    x = ids.astype(np.uint64) + np.uint64(1)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chunk_ends(ids: np.ndarray) -> list[int]:
    """Where the chunks of an id stream end, its own end included.

    The hash at a place depends on the last 16 ids alone.
    """
    return chunk_ends_of(ids, [len(ids)])[0]


def chunk_ends_of(ids: np.ndarray, sizes: list[int]) -> list[list[int]]:
    """The same for several streams that follow one another in ``ids``.

    A chunk has ``MIN_CHUNK`` ids at least, more than the hash looks back, so
    no hash that counts reaches into the stream before.
    """
    rolling = (_GEARS[ids] if len(_GEARS) > (int(ids.max()) if len(ids) else 0) else _gear(ids)).copy()
    for k in (1, 2, 4, 8):  # after each step the hash looks back twice as far, 16 ids in the end
        rolling[k:] += rolling[:-k] << np.uint64(k)
    marks = (np.flatnonzero((rolling >> np.uint64(64 - CUT_BITS)) == 0) + 1).tolist()
    out, start, at = [], 0, 0
    for n in sizes:
        ends, last = [], 0
        while at < len(marks) and marks[at] - start <= n:
            mark = marks[at] - start
            at += 1
            while mark - last > MAX_CHUNK:
                last += MAX_CHUNK
                ends.append(last)
            if mark - last >= MIN_CHUNK and mark < n:
                last = mark
                ends.append(mark)
        while n - last > MAX_CHUNK:
            last += MAX_CHUNK
            ends.append(last)
        if last < n:
            ends.append(n)
        out.append(ends)
        start += n
    return out


#: The numbers of the ids that fit 16 bits.
_GEARS = _gear(np.arange(1 << 16))


class Encoder:
    """Ids of whole texts, the same as ``Tokenizer.encode``, with known words remembered.

    The tokenizer parts a text before each space between other characters, around
    a line end between other characters, and between a letter or digit and a
    full stop or comma that ends a word; it encodes the parts one by one. So in a
    text whose white space is only such single spaces and line ends, the ids are
    those of its parts. All other texts, and those that hold one of the tokenizer's
    added tokens, go to the tokenizer whole.

    Parts that are not yet known go to the tokenizer in one text, parted in the
    same ways; the number of bytes that each id stands for tells them apart again.
    A word is parted before the punctuation at its end, and only what stands before
    that is looked up and remembered. Words of letters alone are
    one part each, so they go to the same merges parted at spaces, in the characters
    that stand for their bytes, without the search for parts.
    """

    def __init__(self, path: str, dtype: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs one worker to a core
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.merges = Tokenizer(self.tokenizer.model)
        self.merges.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        #: Tokens that the tokenizer finds anywhere in a text, even inside a word.
        self.added = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.odd = "|".join([_ODD, *(re.escape(x) for x in self.added)])
        self.dtype = dtype
        #: Ids of the punctuation at the end of words; none for none.
        self.stops: dict[str, bytes] = {}
        #: Ids of a word after a space; of a word at the start of a line, marked by \x00; of a line end.
        self.known: dict[str, bytes] = {"\n": self._ids("\n").tobytes()}
        #: Known words that were met again.
        self.again: set[str] = set()
        # Each character of a byte-level token stands for one byte.
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.bytes_of = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)
        for token, i in vocabulary.items():
            self.bytes_of[i] = len(token)

    def _ids(self, text: str) -> np.ndarray:
        # The fast form leaves out offsets, not ids.
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=self.dtype)

    def _cut(self, ids: np.ndarray, start: np.ndarray, stop: np.ndarray) -> list[bytes] | None:
        """The ids of the bytes from each start to each stop, if ids end there."""
        ends = np.concatenate(([0], np.cumsum(self.bytes_of[ids])))
        first, last = np.searchsorted(ends, start), np.searchsorted(ends, stop)
        if not (np.array_equal(ends[np.minimum(first, len(ids))], start) and np.array_equal(ends[np.minimum(last, len(ids))], stop)):
            return None
        raw, width = ids.tobytes(), np.dtype(self.dtype).itemsize
        return [raw[a:b] for a, b in zip((first * width).tolist(), (last * width).tolist(), strict=True)]

    def _learn(self, words: list[str]) -> None:
        """Encode new words in one text: after a space, or after a line end where they start a line."""
        text = "".join(["\n" + w[1:] if w[0] == "\x00" else " " + w for w in words])
        raw = np.frombuffer(text.encode(), dtype=np.uint8)
        at = np.flatnonzero((raw == 32) | (raw == 10))  # no word holds either
        found = self._cut(self._ids("a" + text + " a"), 1 + at + (raw[at] == 10), 1 + np.append(at[1:], len(raw)))
        if found is None:  # a word that the tokenizer doesn't part there: each for itself
            found = [self._ids(w[1:] if w[0] == "\x00" else " " + w).tobytes() for w in words]
        self.known.update(zip(words, found, strict=True))

    def _learn_letters(self, words: list[str]) -> None:
        """The same for words of letters alone."""
        raw = np.frombuffer(("\x01" + " \x01".join(words)).replace("\x01\x00", "").encode(), dtype=np.uint8)
        ids = np.array(self.merges.encode_batch_fast([_BYTE_CHARS[raw].tobytes().decode("utf-32-le")], add_special_tokens=False)[0].ids, dtype=self.dtype)
        stop = np.append(np.flatnonzero(raw == 32), len(raw)) - np.arange(len(words))
        found = self._cut(ids, np.concatenate(([0], stop[:-1])), stop)
        if found is None:
            self._learn(words)
        else:
            self.known.update(zip(words, found, strict=True))

    def _learn_all(self, words: list[str]) -> None:
        letters = _listed(pc.match_substring_regex(pa.array(words, pa.string()), _LETTERS))
        for learn, some in ((self._learn_letters, list(compress(words, letters))), (self._learn, [w for w, x in zip(words, letters, strict=True) if not x])):
            for at in range(0, len(some), 1000):
                learn(some[at : at + 1000])

    def _ids_of_words(self, words: list[str]) -> list[bytes]:
        if len(self.known) > CACHE_WORDS:
            self._forget()
        known = self.known
        found = list(map(known.get, words))
        places = [i for i, ids in enumerate(found) if ids is None]
        fresh = [words[i] for i in places]
        self.again.update(words)
        self.again.difference_update(fresh)
        self._learn_all(fresh)
        for i, ids in zip(places, map(known.get, fresh), strict=True):
            found[i] = ids
        return found

    def _forget(self, most: int | None = None) -> None:
        """Keep the words that were met again since the last time, half of what the worker remembers at most."""
        kept = islice(filter(self.again.__contains__, self.known), CACHE_WORDS // 2 if most is None else most)
        # The line end always stays: it can't be learned among other words.
        self.known = {"\n": self.known["\n"]} | {w: self.known[w] for w in kept}
        self.again = set()

    def rest(self) -> None:
        """Forget most words and give back memory after a task: Spark keeps more workers than run at once, each with an encoder of its own."""
        self._forget(RESTING_WORDS)
        give_back_memory()

    def _ids_of_ends(self, ends: list[str]) -> list[bytes]:
        if len(self.stops) > MOST_STOPS:
            self.stops.clear()
        for end in ends:
            if end not in self.stops:
                self.stops[end] = self._ids(end).tobytes()
        return list(map(self.stops.get, ends))

    def ids_of(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, each with ``end_id`` if there is one, and how many each has; null is empty.

        A word is looked up once, however often the texts hold it.
        """
        texts = pc.fill_null(texts.cast(pa.string()), "")
        some = pc.binary_length(texts).to_numpy(zero_copy_only=False) > 0
        plain = some & ~pc.match_substring_regex(texts, self.odd).to_numpy(zero_copy_only=False)
        marked = pc.binary_join_element_wise("\x00", pc.replace_substring(texts.filter(pa.array(plain)), "\n", " \n \x00"), "")
        split = pc.split_pattern(marked, " ")
        coded = split.flatten().dictionary_encode()
        core, end = _parted(coded.dictionary)
        found = self._ids_of_words(_listed(core.dictionary)) + self._ids_of_ends(_listed(end.dictionary))
        # Each word is two parts, the second of which may be empty.
        parts = np.stack((core.indices.to_numpy(), len(core.dictionary) + end.indices.to_numpy()), axis=1)
        # A text that isn't plain is a word of its own, and so is the end.
        whole = np.flatnonzero(some & ~plain)
        n_parts = len(found)
        found += [self._ids(t).tobytes() for t in texts.take(pa.array(whole)).to_pylist()]
        n = np.zeros(len(texts), dtype=np.int64)
        n[plain], n[whole] = 2 * pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64), 1
        of_plain = np.repeat(plain, n)
        number = np.empty(len(of_plain), dtype=np.int64)
        number[of_plain] = parts[coded.indices.to_numpy(zero_copy_only=False)].reshape(-1)
        number[~of_plain] = n_parts + np.arange(len(whole))
        if end_id is not None:
            number = np.insert(number, np.cumsum(n), len(found))
            found.append(np.array([end_id], dtype=self.dtype).tobytes())
            n += 1
        size = np.fromiter(map(len, found), np.int64, len(found)) // np.dtype(self.dtype).itemsize
        flat, length = np.frombuffer(b"".join(found), dtype=self.dtype), size[number]
        after = np.concatenate(([0], np.cumsum(length)))
        ids = flat[np.repeat((np.cumsum(size) - size)[number] - after[:-1], length) + np.arange(after[-1])]
        return ids, np.diff(after[np.concatenate(([0], np.cumsum(n)))])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian ids of each text."""
        ids, sizes = self.ids_of(pa.array(texts, pa.string()))
        return [x.tobytes() for x in np.split(ids, np.cumsum(sizes)[:-1])] if texts else []


#: Punctuation that is parted from a letter or digit before it.
_STOPS = string.punctuation
#: Ends of words whose ids a worker remembers.
MOST_STOPS = 10_000
#: Letters that Python, Arrow and the tokenizer, whatever their Unicode version, know as letters: of Latin, and of some other scripts.
_LATIN = r"A-Za-z\x{aa}\x{b5}\x{ba}\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}"
_OTHERS = r"\x{391}-\x{3a1}\x{3a3}-\x{3ce}\x{400}-\x{481}\x{5d0}-\x{5ea}\x{620}-\x{64a}\x{905}-\x{939}\x{e01}-\x{e30}\x{3041}-\x{3096}\x{30a1}-\x{30fa}\x{4e00}-\x{9fa5}\x{ac00}-\x{d7a3}"
#: A word of letters alone; a word that ends in a letter or digit.
_LETTERS = rf"\A\x00?[{_LATIN}]+\z"
_BEFORE_STOPS = rf"[0-9{_LATIN}{_OTHERS}]\z"
_AT_END = rf"\A(?s:.)*[^{re.escape(_STOPS)}]"


def _listed(values: pa.Array) -> list:
    """The values in a list, by way of numpy, which is some ten times as fast as ``to_pylist``."""
    return values.to_numpy(zero_copy_only=False).tolist()


def _parted(words: pa.Array) -> tuple[pa.DictionaryArray, pa.DictionaryArray]:
    """Words without the punctuation after their last letter or digit, and that punctuation."""
    bare = pc.ascii_rtrim(words, characters=_STOPS)
    parts = pc.and_(pc.match_substring_regex(bare, _BEFORE_STOPS), pc.less(pc.binary_length(bare), pc.binary_length(words)))
    ends = pc.if_else(parts, words, "")
    return pc.if_else(parts, bare, words).dictionary_encode(), pc.replace_substring_regex(ends, _AT_END, "").dictionary_encode()


def _byte_chars() -> np.ndarray:
    """The characters that stand for bytes in a byte-level vocabulary; a space parts words, 1 stands for the space before a word."""
    printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = np.zeros(256, dtype="<u4")
    out[printed] = printed
    others = np.flatnonzero(out == 0)
    out[others] = 256 + np.arange(len(others))
    out[1], out[32] = out[32], 32
    return out


_BYTE_CHARS = _byte_chars()

#: White space other than single spaces and line ends between other characters.
_ODD = r"\A[ \n]|[ \n]\z|  | \n|\n |\n\n|[\x00\t\x0b\x0c\r\x1c-\x1f" + "".join(rf"\x{{{i:x}}}" for i in range(0x80, 0x3001) if chr(i).isspace()) + "]"


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def _encoder(path: str, dtype: str) -> Encoder:
    if (path, dtype) not in _ENCODERS:
        _ENCODERS[path, dtype] = Encoder(path, dtype)
    return _ENCODERS[path, dtype]


def id_type(tokenizer_path: str) -> str:
    from tokenizers import Tokenizer

    return "<u2" if Tokenizer.from_file(tokenizer_path).get_vocab_size() <= 1 << 16 else "<u4"


def chunked(docs: DataFrame, tokenizer_path: str, dtype: str, end_id: int = END_ID) -> DataFrame:
    """Rows of two kinds: the distinct chunks that a task meets, and the recipe of each document.

    (kind, key, n, payload, doc_id, row, chunks): a chunk has its address as key, a
    recipe the bytes of its row's number. Ids may be of any type that Arrow carries.
    """
    bounded_batches(docs.sparkSession)
    id_type_ = docs.schema["doc_id"].dataType
    width = np.dtype(dtype).itemsize
    entries = pa.list_(pa.struct([("address", pa.binary()), ("n", pa.int32())]))
    sha256 = hashlib.sha256

    def chunks_of(batches: Iterator[pa.RecordBatch], encoder: Encoder) -> Iterator[pa.RecordBatch]:
        sent: set[bytes] = set()
        for batch in in_slices(batches, BATCH_DOCS):
            schema = pa.schema(
                [("kind", pa.string()), ("key", pa.binary()), ("n", pa.int32()), ("payload", pa.binary()), ("doc_id", batch.column("doc_id").type), ("row", pa.int64()), ("chunks", entries)]
            )
            pa.default_memory_pool().release_unused()  # of the batch before
            if len(sent) > SENT_ADDRESSES:
                sent.clear()
            fresh: dict[bytes, bytes] = {}
            rows = batch.column("row").to_pylist()
            addresses, sizes, offsets = [], [], [0]
            column = batch.column("text")
            read = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)) // BATCH_BYTES
            firsts = [0, *(np.flatnonzero(np.diff(read)) + 1).tolist(), len(rows)]
            for at, until in zip(firsts[:-1], firsts[1:], strict=True):
                flat, counts = encoder.ids_of(column.slice(at, until - at), end_id)
                cuts, raw = chunk_ends_of(flat, counts.tolist()), memoryview(flat.tobytes())
                streams = [raw[(b - n) * width : b * width] for b, n in zip(np.cumsum(counts).tolist(), counts.tolist(), strict=True)]
                for ids, ends in zip(streams, cuts, strict=True):
                    last = 0
                    for cut in ends:
                        payload = bytes(ids[last * width : cut * width])
                        address = sha256(payload).digest()
                        addresses.append(address)
                        sizes.append(cut - last)
                        last = cut
                        if address not in sent:
                            sent.add(address)
                            fresh[address] = payload
                    offsets.append(len(addresses))
            flat = pa.StructArray.from_arrays([pa.array(addresses, pa.binary()), pa.array(sizes, pa.int32())], fields=list(entries.value_type))
            recipes = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat, type=entries)
            m, k = len(fresh), len(rows)
            none = lambda size, kind: pa.nulls(size, kind)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(["chunk"] * m), pa.array(list(fresh), pa.binary()), pa.array([len(x) // width for x in fresh.values()], pa.int32()), pa.array(list(fresh.values()), pa.binary()),
                    none(m, schema.field("doc_id").type), none(m, pa.int64()), none(m, entries),
                ],
                schema=schema,
            )
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(["recipe"] * k), pa.array([r.to_bytes(8, "big") for r in rows], pa.binary()), none(k, pa.int32()), none(k, pa.binary()),
                    batch.column("doc_id"), batch.column("row"), recipes,
                ],
                schema=schema,
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer_path, dtype)
        try:
            yield from chunks_of(batches, encoder)
        finally:
            encoder.rest()

    numbered = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("row"))
    schema = T.StructType.fromDDL("kind string, key binary, n int, payload binary").add("doc_id", id_type_).add("row", T.LongType()).add("chunks", T.ArrayType(T.StructType.fromDDL("address binary, n int")))
    return numbered.mapInArrow(run, schema)


def write(docs: DataFrame, path: str, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, parts: int | None = None) -> str:
    """Write the store of all documents under ``path``; returns its Merkle root (hex).

    Null texts are empty: their stream is the end id alone. Rows with equal ids
    stay documents of their own, next to one another. Null ids come first. An
    empty table gives a store without chunks. Long texts are encoded whole.
    """
    spark = docs.sparkSession
    dtype = id_type(tokenizer_path)
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    # An address comes once a task at most (or once in SENT_ADDRESSES others), so its group is small.
    once = Window.partitionBy("key").orderBy("row")
    made = chunked(own, tokenizer_path, dtype, end_id)
    made.withColumn("again", F.lag(F.lit(True)).over(once)).where("again is null").drop("again").write.options(**{"compression": "zstd", "parquet.enable.dictionary": "false"}).parquet(f"{path}/rows")
    whole = _recipes_as_made(spark, path)
    n = parts or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-whole.count() // PART_DOCS))
    recipes = (
        whole.withColumn("n_tokens", F.aggregate("chunks", F.lit(0).cast("long"), lambda acc, c: acc + c["n"]))
        .withColumn("leaf", F.sha2(F.array_join(F.transform("chunks", lambda c: F.hex(c["address"])), ""), 256))
        .repartitionByRange(n, "doc_id", "row")
        .withColumn("part", F.spark_partition_id())
        .sortWithinPartitions("doc_id", "row")
    )
    recipes.write.parquet(f"{path}/recipes")
    nodes = _nodes(spark.read.parquet(f"{path}/recipes"))
    nodes.repartition(1).write.parquet(f"{path}/manifest")  # one short row a recipe file
    return _root(spark.read.parquet(f"{path}/manifest"))


def _chunks(spark: SparkSession, path: str) -> DataFrame:
    """(address, n, payload) of every unique chunk."""
    rows = spark.read.schema("kind string, key binary, n int, payload binary").parquet(f"{path}/rows")
    return rows.where("kind = 'chunk'").select(F.col("key").alias("address"), "n", "payload")


def _recipes_as_made(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/rows").where("kind = 'recipe'").select("doc_id", "row", "chunks")


def _nodes(recipes: DataFrame) -> DataFrame:
    """One Merkle node a recipe file: over pages of 1,000 leaves, then over the pages."""
    inside = Window.partitionBy("part").orderBy("doc_id", "row")
    pages = (
        recipes.select("part", "doc_id", "row", "leaf", "n_tokens")
        .withColumn("page", F.floor((F.row_number().over(inside) - 1) / 1000))
        .groupBy("part", "page")
        .agg(F.array_sort(F.collect_list(F.struct("doc_id", "row", "leaf"))).alias("leaves"), F.count(F.lit(1)).alias("docs"), F.sum("n_tokens").alias("tokens"))
        .select("part", "page", "docs", "tokens", F.sha2(F.array_join("leaves.leaf", ""), 256).alias("node"))
    )
    return pages.groupBy("part").agg(
        F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"), F.sha2(F.array_join(F.expr("array_sort(collect_list(struct(page, node))).node"), ""), 256).alias("node")
    )


def _root(manifest: DataFrame) -> str:
    """The hash over all nodes, in order of their files (one row a file)."""
    return manifest.agg(F.sha2(F.array_join(F.expr("array_sort(collect_list(struct(part, node))).node"), ""), 256).alias("root")).first()["root"]


# -- crc of a whole from the crcs of its parts ---------------------------------


def _shift_tables() -> np.ndarray:
    """Table k: what 2**k zero bytes more make of each bit of a crc32 register."""
    poly = 0xEDB88320
    one_bit = np.array([poly] + [1 << (i - 1) for i in range(1, 32)], dtype=np.uint32)  # one zero bit

    def apply(table: np.ndarray, x: np.ndarray) -> np.ndarray:
        out = np.zeros_like(x)
        for b in range(32):
            out ^= np.where((x >> np.uint32(b)) & np.uint32(1), table[b], np.uint32(0))
        return out

    tables = [one_bit]
    for _ in range(3):
        tables.append(apply(tables[-1], tables[-1]))
    byte = [tables[-1]]
    for _ in range(40):
        byte.append(apply(byte[-1], byte[-1]))
    return np.stack(byte)


_TABLES = _shift_tables()


def crc_of_parts(crcs: np.ndarray, sizes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """crc32 of each whole from the crcs and byte sizes of its parts, in order.

    ``counts`` is the number of parts of each whole, at least one. A part's crc
    is moved over the bytes that follow it; the moved crcs of a whole add up.
    """
    first = np.cumsum(counts) - counts
    until = np.cumsum(sizes)
    after = np.repeat(until[first + counts - 1], counts) - until
    moved = crcs.astype(np.uint32)
    for k in range(int(after.max(initial=0)).bit_length()):
        on = np.flatnonzero((after >> k) & 1)
        x = moved[on]
        out = np.zeros_like(x)
        for b in range(32):
            out ^= np.where((x >> np.uint32(b)) & np.uint32(1), _TABLES[k][b], np.uint32(0))
        moved[on] = out
    return np.bitwise_xor.reduceat(moved, first) if len(counts) else np.zeros(0, np.uint32)


def _payload_crcs(chunks: DataFrame, dtype: str) -> DataFrame:
    """(address, n, crc) of each payload in the files; a payload that isn't its address's raises."""
    sha256, crc32, width = hashlib.sha256, zlib.crc32, np.dtype(dtype).itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            addresses, payloads, ns = (_listed(batch.column(c)) for c in ("address", "payload", "n"))
            for address, payload, n in zip(addresses, payloads, ns, strict=True):
                if sha256(payload).digest() != address or len(payload) != n * width:
                    raise ValueError(f"chunk {address.hex()} is damaged")
            wide = memoryview(np.frombuffer(b"".join(payloads), dtype=dtype).astype("<u4").view(np.uint8))
            ends = np.cumsum(np.array(ns, dtype=np.int64) * 4).tolist()
            crcs = [crc32(wide[a:b]) for a, b in zip([0, *ends], ends, strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column("address"), batch.column("n"), pa.array(crcs, pa.int64())], names=["address", "n", "crc"])

    return chunks.select("address", "payload", "n").mapInArrow(run, "address binary, n int, crc long")


def read_digest(spark: SparkSession, path: str, tokenizer_path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, leaf) of every document, from the files alone.

    Payloads are not shuffled: a document's crc comes from the crcs and sizes of
    its chunks. A chunk that very many documents hold is one row on one side of
    the join, whose other side adaptive execution may split.
    """
    dtype = id_type(tokenizer_path)
    recipes = spark.read.parquet(f"{path}/recipes")
    manifest = spark.read.parquet(f"{path}/manifest")
    schema = T.StructType().add("doc_id", recipes.schema["doc_id"].dataType).add("start", T.LongType()).add("n_tokens", T.LongType()).add("ids_crc32", T.LongType()).add("leaf", T.StringType())
    crcs = _payload_crcs(_chunks(spark, path), dtype)
    placed = recipes.select("row", F.posexplode("chunks").alias("seq", "c")).select("row", "seq", F.col("c.address").alias("address"))
    found = placed.join(crcs, "address").groupBy("row").agg(F.array_sort(F.collect_list(F.struct("seq", "address", "n", "crc"))).alias("parts"))  # as many as the document has chunks
    # Files in order of their documents; the sum over earlier files has one row a file.
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = manifest.select(F.col("part").alias("in"), F.coalesce(F.sum("tokens").over(earlier), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("part").orderBy("doc_id", "row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    started = (
        recipes.join(F.broadcast(ahead), F.col("part") == F.col("in"))  # one row a file of PART_DOCS documents
        .select("doc_id", "row", "n_tokens", "leaf", (F.col("ahead") + F.sum("n_tokens").over(inside) - F.col("n_tokens")).alias("start"))
    )
    joined = started.join(found, "row", "left")
    joined = joined.select("doc_id", "start", "n_tokens", "leaf", F.col("parts.address").alias("addresses"), F.col("parts.n").alias("ns"), F.col("parts.crc").alias("crcs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("doc_id", "n_tokens", "leaf", "addresses", "ns")]
            for doc_id, n_tokens, leaf, addresses, ns in zip(*columns, strict=True):
                hexes = "".join(a.hex().upper() for a in addresses or [])
                if hashlib.sha256(hexes.encode()).hexdigest() != leaf or sum(ns or []) != n_tokens:
                    raise ValueError(f"the chunks of document {doc_id} are not those of its recipe")
            crcs, sizes = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("crcs", "ns"))
            out = crc_of_parts(crcs, 4 * sizes.astype(np.int64), np.array([len(x) for x in columns[4]], dtype=np.int64))
            keep = [batch.column(c) for c in ("doc_id", "start", "n_tokens")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(out.astype(np.int64), pa.int64()), batch.column("leaf")], names=["doc_id", "start", "n_tokens", "ids_crc32", "leaf"])

    return joined.mapInArrow(run, schema)


def verify(spark: SparkSession, path: str) -> str:
    """Recompute the Merkle nodes from the recipes; returns the root, or raises."""
    manifest = spark.read.parquet(f"{path}/manifest")
    fresh = _nodes(spark.read.parquet(f"{path}/recipes"))
    bad = fresh.join(manifest.select("part", F.col("node").alias("written")), "part", "full").where(~F.col("node").eqNullSafe(F.col("written")))
    if not bad.isEmpty():
        raise ValueError("the manifest doesn't fit the recipes")
    return _root(manifest)


def reconstruct(spark: SparkSession, path: str, tokenizer_path: str) -> DataFrame:
    """(doc_id, row, ids): the whole id stream of each document, put together from its chunks."""
    dtype = id_type(tokenizer_path)
    recipes = spark.read.parquet(f"{path}/recipes")
    placed = recipes.select("doc_id", "row", F.posexplode("chunks").alias("seq", "c")).select("doc_id", "row", "seq", "c.address")
    joined = placed.join(_chunks(spark, path).select("address", "payload"), "address").groupBy("doc_id", "row").agg(F.array_sort(F.collect_list(F.struct("seq", "payload"))).alias("parts"))
    schema = T.StructType().add("doc_id", recipes.schema["doc_id"].dataType).add("row", T.LongType()).add("ids", T.ArrayType(T.IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, 200):
            ids = [np.frombuffer(b"".join(x["payload"] for x in parts), dtype=dtype).astype(np.int32) for parts in batch.column("parts").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "row", "ids"])

    return joined.mapInArrow(run, schema)


def store_documents(docs: DataFrame, tokenizer_path: str, path: str | None = None, **options) -> DataFrame:
    """Write the store and return its digest as read back; the Merkle root is checked on the way."""
    from .common import new_path

    spark = docs.sparkSession
    path = path or new_path(spark, "token-store")
    root = write(docs, path, tokenizer_path, **options)
    if verify(spark, path) != root:
        raise ValueError("the manifest changed between writing and reading")
    return read_digest(spark, path, tokenizer_path)


def remove(spark: SparkSession, path: str) -> None:
    drop_table(spark, path)
