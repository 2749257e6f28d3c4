"""Token ids in compressed blocks with a shared zstandard dictionary.

Documents are put in ascending order of doc_id by range partitioning, encoded whole, and each document's ids
(little-endian, 16 bits where the vocabulary allows, else 32) are compressed on their own with one dictionary, which
is trained on a documented, bounded sample of serialised id arrays. A block row of the file holds the
frames of successive documents, the index of their offsets, and the hash of the dictionary, so a short
document is read by decompressing its own few bytes.

The container is Parquet, written and read by Spark alone, so any store that Spark reaches will do and a lost task
is done again. Columns of ``blocks``: part, block, dict_hash, first_id, last_id, start_in_part, tokens, doc_ids,
offsets (one more than documents), counts, payload. ``dictionary`` has one row: dict_hash, dictionary, width, end_id.

Encoding uses the tokenizers library. Where the tokenizer is byte-level BPE that splits text by its usual regular
expression and has no normaliser, its result for a text is the results for the pieces in turn. A space after anything but
white space always begins a piece, so a text is cut there into chunks, and the ids of each chunk are remembered
(``MEMO`` chunks at most, forgotten together). The new chunks of many texts go to the library as a few long texts, ``JOINED``
chunks in each; the bytes of the tokens, which are those of the text, tell where each chunk's ids end. Chunks with white space
at an edge, other tokenizers, texts with an added token and texts with runs of white space are encoded by the library as they are.

Defined results: a null or empty text has the end id alone; null doc_ids come first; rows repeated with the same
doc_id stay apart, ordered by a hash of their text; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import zlib
from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, new_path, text_of

BLOCK_BYTES = 4 << 20
MEMO = 1_000_000
#: The sample for the dictionary: so many documents (those with the smallest hash of their id), and of each up to
#: so many pieces of PIECE bytes of its serialised ids, evenly spread over the whole document.
SAMPLE_DOCS, SAMPLE_PIECES, PIECE, DICT_BYTES = 512, 8, 4 << 10, 64 << 10
LEVEL = 3
BLOCK_SCHEMA = (
    "part int, block int, dict_hash string, first_id long, last_id long, start_in_part long, tokens long, "
    "doc_ids array<long>, offsets array<int>, counts array<int>, payload binary"
)
DICT_SCHEMA = "dict_hash string, dictionary binary, width int, end_id int"

#: Chunks looked up at once, and new ones handed to the library as one text.
GROUP, JOINED = 8_192, 256

#: White space before a space that does not begin a word: cuts at such a space would change the pieces. A superset of
#: what any library version takes for white space.
_RUN = re.compile("[\\s\u180e\u200b] (?=[\\s\u180e\u200b]|\\Z)").search
_MAY_RUN = tuple(c + " " for c in map(chr, range(128)) if c.isspace())


#: A chunk that begins and ends with something else.
_SOLID = re.compile("(?![\\s\u180e\u200b]).*(?<![\\s\u180e\u200b])", re.DOTALL).fullmatch


class Encoder:
    """Whole texts to serialised ids; one to a process."""

    _own: dict[tuple, Encoder] = {}

    def __init__(self, path: str, end_id: int):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        self.dtype = np.dtype("<u2") if max(self.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else np.dtype("<u4")
        self.end = np.array([end_id], dtype=self.dtype).tobytes()
        split = spec.get("pre_tokenizer") or {}
        simple = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
        self.added = [x["content"] for x in spec.get("added_tokens", [])]
        self.split = str.split if simple and not spec.get("normalizer") and not spec.get("truncation") else None
        vocabulary = self.tokenizer.get_vocab()
        self.bytes = np.zeros(max(vocabulary.values(), default=0) + 1, dtype=np.int64)  # a byte-level token has a character for each byte
        self.bytes[list(vocabulary.values())] = list(map(len, vocabulary))
        self.chunks: dict[str, bytes] = {}

    @classmethod
    def of(cls, path: str, end_id: int) -> Encoder:
        if (path, end_id) not in cls._own:
            cls._own[path, end_id] = cls(path, end_id)
        return cls._own[path, end_id]

    def _raw(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.dtype).tobytes()

    def _of_joined(self, chunks: list[str]) -> Iterator[bytes]:
        """The ids of solid chunks, each with the space before it."""
        spaced = [" " + c for c in chunks]
        groups = [spaced[at : at + JOINED] for at in range(0, len(spaced), JOINED)]
        for group, found in zip(groups, self.tokenizer.encode_batch_fast(list(map("".join, groups)), add_special_tokens=False), strict=True):
            ids = np.array(found.ids, dtype=self.dtype)
            reached, wanted = np.cumsum(self.bytes[ids]), np.cumsum(list(map(len, map(str.encode, group))))
            ends = np.searchsorted(reached, wanted)
            if not len(ids) or reached[-1] != wanted[-1] or (reached[ends] != wanted).any():  # bytes without a token
                yield from map(self._raw, group)
                continue
            raw, ends = ids.tobytes(), ((ends + 1) * self.dtype.itemsize).tolist()
            yield from map(raw.__getitem__, map(slice, [0, *ends[:-1]], ends))

    def _ids(self, texts: list[list[str]]) -> list[bytes]:
        """The ids of each text's chunks."""
        wanted = set().union(*texts)
        new = wanted.difference(self.chunks)
        if len(self.chunks) + len(new) > MEMO:
            self.chunks.clear()
            new = wanted
        solid = list(filter(_SOLID, new))
        self.chunks.update(zip(solid, self._of_joined(solid), strict=True))
        if len(solid) < len(new):
            self.chunks.update((c, self._raw(" " + c)) for c in new.difference(solid))
        return [b"".join(map(self.chunks.__getitem__, chunks)) for chunks in texts]

    def _cut(self, text: str) -> tuple[bytes, list[str]]:
        """The ids of the text's beginning, and the chunks that follow."""
        if self.split is None or any(x in text for x in self.added):
            return self._raw(text), []
        if (not text.isascii() or any(x in text for x in _MAY_RUN)) and _RUN(text):
            return self._raw(text), []
        first, *rest = self.split(text, " ")
        return self._raw(first) if first else b"", rest

    def each(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """The serialised ids of each text."""
        held, n = [], 0
        for text in texts:
            begun, rest = self._cut(text or "")
            while len(rest) > GROUP:  # a very long text
                begun, rest = begun + self._ids([rest[:GROUP]])[0], rest[GROUP:]
            if n + len(rest) > GROUP:
                yield from self._ended(held)
                held, n = [], 0
            held.append((begun, rest))
            n += len(rest)
        yield from self._ended(held)

    def _ended(self, held: list[tuple[bytes, list[str]]]) -> list[bytes]:
        found = self._ids([rest for _, rest in held])
        return [begun + ids + self.end for (begun, _), ids in zip(held, found, strict=True)]

    def serialised(self, text: str | None) -> bytes:
        return next(self.each([text]))


def _serialised(encoder: Encoder, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, bytes]]:
    """doc_id and serialised ids of the rows (doc_id, text)."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):  # a few texts as Python strings at a time
            part = batch.slice(at, 256)
            yield from zip(part.column(0).to_pylist(), encoder.each(part.column(1).to_pylist()), strict=True)


def train_dictionary(docs: DataFrame, path: str, end_id: int) -> bytes:
    """The shared dictionary; empty if the sample is too small to train one. Of rows repeated with a sampled id those
    with the smallest hashes of their text count."""
    import zstandard

    chosen = [r[0] for r in docs.select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS).collect()]

    def serialise(batches):
        encoder = Encoder.of(path, end_id)
        for _, raw in _serialised(encoder, batches):
            last = max(0, len(raw) - PIECE)
            places = sorted({last * i // max(1, SAMPLE_PIECES - 1) for i in range(SAMPLE_PIECES)}) if last else [0]
            yield pa.RecordBatch.from_pydict({"ids": [raw[at : at + PIECE] for at in places]})

    mine = docs.where(F.col("doc_id").isin(chosen)).select("doc_id", text_of().alias("text"))
    mine = mine.orderBy("doc_id", F.xxhash64("text")).limit(2 * SAMPLE_DOCS)
    samples = sorted(bytes(r[0]) for r in mine.mapInArrow(serialise, "ids binary").collect())
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def _codec(dictionary: bytes):
    import zstandard

    return zstandard.ZstdCompressionDict(dictionary) if dictionary else None


def write_tokens(docs: DataFrame, tokenizer_path: str, end_id: int = 2, block_bytes: int = BLOCK_BYTES) -> str:
    """Encode ``docs`` and write the files; their folder."""
    spark = docs.sparkSession
    out = new_path(spark, "tokens")
    dictionary = train_dictionary(docs, tokenizer_path, end_id)
    name = hashlib.sha256(dictionary).hexdigest()

    def encode(batches):
        import zstandard

        encoder, part, start, number = Encoder.of(tokenizer_path, end_id), TaskContext.get().partitionId(), 0, 0
        press = zstandard.ZstdCompressor(level=LEVEL, dict_data=_codec(dictionary), write_content_size=True).compress
        ids, counts, frames, held = [], [], [], 0

        def block():
            total = sum(counts)
            known = [i for i in ids if i is not None]
            row = {
                "part": part, "block": number, "dict_hash": name, "first_id": min(known, default=None), "last_id": max(known, default=None),
                "start_in_part": start, "tokens": total, "doc_ids": ids, "offsets": [0, *accumulate(map(len, frames))],
                "counts": counts, "payload": b"".join(frames),
            }
            return pa.RecordBatch.from_pylist([row], schema=_ARROW_BLOCK), total

        for doc_id, raw in _serialised(encoder, batches):
            ids.append(doc_id)
            counts.append(len(raw) // encoder.dtype.itemsize)
            frames.append(press(raw))
            held += len(frames[-1])
            if held >= block_bytes:
                made, total = block()
                yield made
                start, number = start + total, number + 1
                ids, counts, frames, held = [], [], [], 0
        if ids:
            yield block()[0]

    # By id, and by text for rows of one id; sampling for the ranges reads the input, not the encoding.
    keyed = docs.select("doc_id", text_of().alias("text"), F.xxhash64(text_of()).alias("h"))
    ordered = keyed.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    ordered.mapInArrow(encode, BLOCK_SCHEMA).write.option("compression", "uncompressed").parquet(f"{out}/blocks")
    width = Encoder.of(tokenizer_path, end_id).dtype.itemsize
    spark.createDataFrame([(name, bytearray(dictionary), width, end_id)], DICT_SCHEMA).coalesce(1).write.parquet(f"{out}/dictionary")
    return out


_ARROW_BLOCK = pa.schema([
    ("part", pa.int32()), ("block", pa.int32()), ("dict_hash", pa.string()), ("first_id", pa.int64()), ("last_id", pa.int64()),
    ("start_in_part", pa.int64()), ("tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int32())),
    ("counts", pa.list_(pa.int32())), ("payload", pa.binary()),
])


def _frames(batches, dictionary: bytes, name: str, wanted: set | None = None):
    """Each document of the blocks: row, index in it, raw ids. Only wanted documents are decompressed."""
    import zstandard

    unpress = zstandard.ZstdDecompressor(dict_data=_codec(dictionary)).decompress
    for batch in batches:
        for row in batch.to_pylist():
            if row["dict_hash"] != name:
                raise ValueError(f"block was written with dictionary {row['dict_hash']}, not {name}")
            payload, at = memoryview(row["payload"]), row["offsets"]
            for i, doc_id in enumerate(row["doc_ids"]):
                if wanted is None or doc_id in wanted:
                    yield row, i, unpress(payload[at[i] : at[i + 1]])


def _dictionary(spark: SparkSession, path: str):
    return spark.read.schema(DICT_SCHEMA).parquet(f"{path}/dictionary").first()


def read_summary(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""
    head = _dictionary(spark, path)
    dictionary, name, width = bytes(head.dictionary), head.dict_hash, head.width
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(f"{path}/blocks")
    # One row for each written part: as many as the range partitioning had.
    parts = cut(blocks.groupBy("part").agg(F.sum("tokens").alias("tokens")), "parts")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.select("part", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"))

    def summarise(batches):
        def rows():
            for row, i, raw in _frames(batches, dictionary, name):
                ids = np.frombuffer(raw, dtype=f"<u{width}").astype("<u4")
                yield row["part"], row["block"], row["start_in_part"], i, row["doc_ids"][i], len(ids), zlib.crc32(ids.tobytes())

        key, held, offset = None, [], 0
        for part, block, start, _, doc_id, n, crc in rows():
            if (part, block) != key:
                key, offset = (part, block), start
            held.append((part, doc_id, offset, n, crc))
            offset += n
            if len(held) >= 4096:
                yield _summary(held)
                held = []
        if held:
            yield _summary(held)

    found = blocks.mapInArrow(summarise, "part int, doc_id long, start_in_part long, n_tokens long, ids_crc32 long")
    return found.join(F.broadcast(bases), "part").select("doc_id", (F.col("base") + F.col("start_in_part")).alias("start"), "n_tokens", "ids_crc32")


def _summary(rows: list[tuple]) -> pa.RecordBatch:
    part, doc_id, start, n, crc = zip(*rows, strict=True)
    kinds = zip((part, doc_id, start, n, crc), (pa.int32(), *[pa.int64()] * 4), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(v, type=t) for v, t in kinds], names=["part", "doc_id", "start_in_part", "n_tokens", "ids_crc32"])


def read_ids(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """doc_id and ids of all documents, or of those in a short list: only blocks whose range holds one of
    them are read, and only their frames are decompressed."""
    head = _dictionary(spark, path)
    dictionary, name, width = bytes(head.dictionary), head.dict_hash, head.width
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(f"{path}/blocks")
    wanted = None
    if doc_ids is not None:
        wanted = set(doc_ids)
        near = F.lit(False)
        for i in sorted(wanted):
            near = near | ((F.col("first_id") <= i) & (F.col("last_id") >= i))
        blocks = blocks.where(near)

    def unpack(batches):
        for row, i, raw in _frames(batches, dictionary, name, wanted):
            ids = np.frombuffer(raw, dtype=f"<u{width}").astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array([row["doc_ids"][i]], pa.int64()), pa.array([ids], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return blocks.mapInArrow(unpack, "doc_id long, ids array<int>")
