"""Byte-level BPE: texts to ids and back, by the ranks of a public vocabulary.

Encoding. Each match of the split pattern is encoded for itself by the
``tokenizers`` library. A byte stands as one printable character there (a byte
that is itself printable Latin-1 as that character, the others as U+0100 and
on), so a token of any bytes is a string. A rank file has no list of merges; they
are found by taking each token's own bytes apart (see ``merges_of``), and give the
ids of joining, again and again, the leftmost of the lowest-ranked pairs.

Offsets. The bytes that an id stands for give its place in the UTF-8 text, and the
number of characters that begin before a byte turns that into characters. An id
that cuts a character starts or ends inside it: its offsets cover the whole
character, so neighbours overlap there.

Decoding. Ids become their bytes, from the table read backwards. A character
split over ids is whole again as soon as the last of its bytes has come; bytes
that are no UTF-8 become U+FFFD in the text and stay as they are in the bytes.

Texts are read whole, whatever their length. Null text is empty, and empty text
has no ids. Rows are neither dropped nor put in another order; repeated rows get
equal ids. Columns of the input stay; one that has the name of an output column
is replaced by it. An empty table gives an empty one.
"""

from __future__ import annotations

import base64
import codecs
import heapq
import os
from collections.abc import Iterator
from itertools import accumulate, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, in_slices

#: Parts of texts whose ids a worker remembers, which bounds its memory to some 100 MB.
CACHE_PARTS = 300_000
#: Rows that a worker encodes or decodes at a time.
BATCH_DOCS = 200


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from lines of base64 token and number."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f) if token}


def byte_characters() -> list[str]:
    """The character that stands for each byte."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b if b in printable else next(rest)) for b in range(256)]


def merge_by_rank(piece: bytes, ranks: dict[bytes, int], until: int = 1) -> list[bytes]:
    """Join the leftmost of the lowest-ranked pairs until no pair, or ``until`` parts, are left."""
    n = left_over = len(piece)
    ends = list(range(1, n + 1))  # where the part that starts here ends; 0 where no part starts
    before = list(range(-1, n - 1))
    heap = [(rank, i, i + 1, i + 2) for i in range(n - 1) if (rank := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap and left_over > until:
        _, start, middle, end = heapq.heappop(heap)
        if ends[start] != middle or ends[middle] != end:
            continue
        ends[start], ends[middle] = end, 0
        left_over -= 1
        if end < n:
            before[end] = start
            if (rank := ranks.get(piece[start : ends[end]])) is not None:
                heapq.heappush(heap, (rank, start, end, ends[end]))
        if start:
            left = before[start]
            if (rank := ranks.get(piece[left:end])) is not None:
                heapq.heappush(heap, (rank, left, start, end))
    out, at = [], 0
    while at < n:
        out.append(piece[at : ends[at]])
        at = ends[at]
    return out


def merges_of(ranks: dict[bytes, int]) -> list[tuple[bytes, bytes]]:
    """The merge that makes each token, by rank.

    As long as no pair reaches over the ends of a stretch, the pairs inside it are
    joined in the same order as if it stood alone. So wherever a token comes to
    be, it is made of the two parts that its own bytes come down to alone. A
    token whose bytes alone end otherwise is met as a whole match only.
    """
    found = []
    for token in sorted(ranks, key=ranks.__getitem__):
        if len(token) > 1:
            parts = merge_by_rank(token, ranks, until=2)
            if len(parts) == 2:
                found.append((parts[0], parts[1]))
    return found


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit numbers.

    Where a single space stands between two characters that are no white space,
    the pattern always begins a new match with it, so the parts of a text between
    such spaces are encoded one by one and remembered. Texts with other white
    space beside a space, or at an end, are taken match by match as a whole.
    """

    def __init__(self, path: str, pattern: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs one worker to a core
        import regex
        from tokenizers import Tokenizer, models

        ranks = read_ranks(path)
        #: Read as Latin-1, bytes are characters 0 to 255.
        self.letters = {b: letter for b, letter in enumerate(byte_characters()) if chr(b) != letter}
        written = lambda token: token.decode("latin-1").translate(self.letters)
        self.tokenizer = Tokenizer(models.BPE(vocab={written(t): r for t, r in ranks.items()}, merges=[(written(a), written(b)) for a, b in merges_of(ranks)], ignore_merges=True))
        self.matches = regex.compile(pattern).findall
        self.is_space = regex.compile(r"\s").match
        self.widths = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for token, rank in ranks.items():
            self.widths[rank] = len(token)
        #: Ids of each part with the space before it.
        self.parts: dict[str, bytes] = {}

    def _ids(self, texts: list[str], matches: list[str]) -> list[bytes]:
        """Ids of each text, whose matches follow one another; the bytes that ids stand for tell the texts apart."""
        if not matches:
            return [b""] * len(texts)
        data = list(map(str.encode, matches))
        letters = b"".join(data).decode("latin-1").translate(self.letters)
        ends = list(accumulate(map(len, data)))
        pieces = [letters[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        ids = np.array(self.tokenizer.encode_batch_fast([pieces], is_pretokenized=True, add_special_tokens=False)[0].ids, dtype="<u4")
        cuts = (4 * (np.searchsorted(np.cumsum(self.widths[ids]), np.cumsum([len(t.encode()) for t in texts])) + 1)).tolist()
        held = ids.tobytes()
        return [held[a:b] for a, b in zip([0, *cuts], cuts, strict=False)]

    def _plain(self, part: str) -> bool:
        return bool(part) and not self.is_space(part[0]) and not self.is_space(part[-1])

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.parts) > CACHE_PARTS:  # what was met first is what is frequent
            self.parts = dict(islice(self.parts.items(), CACHE_PARTS // 2))
        known, new, split = self.parts, set(), {}
        whole = {i: text for i, text in enumerate(texts) if text}
        for i, text in whole.items():
            head, *parts = text.split(" ")
            missing = set(parts).difference(known, new)
            if all(map(self._plain, [head, *missing])):
                split[i], whole[i] = parts, head
                new |= missing
        order = list(new)
        for at in range(0, len(order), 5000):
            some = order[at : at + 5000]
            spaced = [" " + p for p in some]
            known.update(zip(some, self._ids(spaced, self.matches("".join(spaced))), strict=True))
        heads = dict(zip(whole, self._ids(list(whole.values()), [m for text in whole.values() for m in self.matches(text)]), strict=True))
        return [heads.get(i, b"") + b"".join(map(known.__getitem__, split.get(i, ()))) for i in range(len(texts))]

    def spans(self, data: bytes, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First character and end of each id's span in a UTF-8 text."""
        first_bytes = (np.frombuffer(data, dtype=np.uint8) & 0xC0) != 0x80
        begun = np.concatenate(([0], np.cumsum(first_bytes)))  # characters that begin before each byte
        ends = np.cumsum(self.widths[ids])
        return begun[np.concatenate(([0], ends))[:-1] + 1] - 1 if len(ids) else ends, begun[ends]


class Decoder:
    """Bytes and text of ids. An id that the table doesn't have raises."""

    def __init__(self, path: str):
        self.tokens = [b""] * (1 + max((ranks := read_ranks(path)).values()))
        for token, rank in ranks.items():
            self.tokens[rank] = token

    def data(self, ids: list[int]) -> bytes:
        if min(ids, default=0) < 0 or b"" in (found := list(map(self.tokens.__getitem__, ids))):
            raise ValueError("an id that is not in the vocabulary")
        return b"".join(found)

    def texts(self, ids: list[int]) -> list[str]:
        """The text that each id completes: a split character comes with the id that holds its last byte."""
        feed = codecs.getincrementaldecoder("utf-8")("replace").decode
        out = [feed(self.data([i])) for i in ids]
        rest = feed(b"", True)
        return [*out[:-1], out[-1] + rest] if out else []


_ENCODERS: dict[tuple[str, str], Encoder] = {}
_DECODERS: dict[str, Decoder] = {}


def _encoder(path: str, pattern: str) -> Encoder:
    if (path, pattern) not in _ENCODERS:
        _ENCODERS[path, pattern] = Encoder(path, pattern)
    return _ENCODERS[path, pattern]


def _decoder(path: str) -> Decoder:
    if path not in _DECODERS:
        _DECODERS[path] = Decoder(path)
    return _DECODERS[path]


def _lists(values: np.ndarray, sizes: list[int]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array([0, *accumulate(sizes)], pa.int32()), pa.array(values.astype(np.int32), pa.int32()))


def _extended(df: DataFrame, made: dict[str, T.DataType], run, reads: str) -> DataFrame:
    """``df`` with new columns from ``run``, which gets slices of batches; ``reads`` is cast already."""
    bounded_batches(df.sparkSession)
    keep = [c for c in df.columns if c not in made]
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(c, t) for c, t in made.items()])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, BATCH_DOCS):
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *run(batch.column(reads))], names=[*keep, *made])

    return df.mapInArrow(each, schema)


def encode(docs: DataFrame, path: str, pattern: str, *, text_col: str = "text", ids_col: str = "ids", packed: bool = False, spans: bool = False) -> DataFrame:
    """``docs`` with the ids of each text: an array, or if ``packed`` their little-endian unsigned 32-bit bytes.

    With ``spans`` also arrays ``<ids_col>_start`` and ``<ids_col>_end``: the
    characters of the text that each id covers.
    """
    source = docs.withColumn(text_col, F.col(text_col).cast("string"))
    numbers = T.ArrayType(T.IntegerType())
    made = {ids_col: T.BinaryType() if packed else numbers} | ({f"{ids_col}_start": numbers, f"{ids_col}_end": numbers} if spans else {})

    def run(column: pa.Array) -> list[pa.Array]:
        encoder = _encoder(path, pattern)
        texts = [t or "" for t in column.to_pylist()]
        streams = encoder.encode(texts)
        sizes = [len(s) // 4 for s in streams]
        out = [pa.array(streams, pa.binary()) if packed else _lists(np.frombuffer(b"".join(streams), dtype="<u4"), sizes)]
        if spans:
            both = [encoder.spans(t.encode(), np.frombuffer(s, dtype="<u4")) for t, s in zip(texts, streams, strict=True)]
            out += [_lists(np.concatenate([np.zeros(0, np.int64), *(pair[k] for pair in both)]), sizes) for k in (0, 1)]
        return out

    return _extended(source, made, run, text_col)


def decode(encoded: DataFrame, path: str, *, ids_col: str = "ids", bytes_col: str | None = "decoded_bytes", text_col: str | None = "decoded") -> DataFrame:
    """``encoded`` with the bytes and the text of its ids, given as an array or packed; null ids give null."""
    packed = isinstance(encoded.schema[ids_col].dataType, T.BinaryType)
    made = ({bytes_col: T.BinaryType()} if bytes_col else {}) | ({text_col: T.StringType()} if text_col else {})

    def run(column: pa.Array) -> list[pa.Array]:
        decoder = _decoder(path)
        ids = [x if x is None or not packed else np.frombuffer(x, dtype="<u4").tolist() for x in column.to_pylist()]
        data = [None if x is None else decoder.data(x) for x in ids]
        text = [None if x is None else x.decode("utf-8", "replace") for x in data] if text_col else []
        return ([pa.array(data, pa.binary())] if bytes_col else []) + ([pa.array(text, pa.string())] if text_col else [])

    return _extended(encoded, made, run, ids_col)


def digest(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every document, from its ids and what they decode to."""
    encoded = encode(docs.select("doc_id", "text"), path, pattern, packed=True).select("doc_id", "ids")
    decoded = decode(encoded, path, bytes_col="decoded", text_col=None)
    return decoded.select("doc_id", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
