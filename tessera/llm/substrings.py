"""Removal of repeated 100-byte strings by suffix arrays (see ``suffix_array``).

Every byte that is covered by a ``WINDOW``-byte string which also starts earlier (in a document before it, or before it in its
own) is removed. Suffix arrays of all texts together would need one task to see them all, so windows are
first dealt out by content: among the ``GRAM``-byte strings of a window the one with the smallest hash, the leftmost
of equals, is its anchor; equal windows have equal anchors at equal offsets. Successive windows with
one anchor position form a run, whose string is at most 2 * WINDOW - GRAM bytes. Runs meet by anchor:

* an anchor that occurs once has no repeats;
* of runs with the same string (by anchor and a 64-bit hash of the string: with k different strings of one anchor, two are
  taken for equal with probability k * k / 2**65 at most) all but the first are repeats from end to end;
* different strings of one anchor are put one after the other, in document order, and the suffix array of that text
  brings equal windows together; the windows of each class but the first are repeats. (A single string of an anchor cannot
  repeat a window inside itself: the anchor would be at two offsets of the same window.)

Anchors that occur in very many different surroundings (a common passage, at its ends) would make long texts. They are
found beforehand in a hashed sample of documents (1 of ``SAMPLE_OF``, all rows in small tables), and each of
their windows becomes an anchor and a run of its own, which spreads them over all tasks. Any choice of such
anchors gives the same result; the sample only balances the work, and at most ``HOT_MOST`` of them (those seen most) are
sent out. Repeats within a slice of an Arrow batch are settled there, so a popular run leaves a slice once.

Rows are ordered by doc_id (null first); rows of one doc_id by a hash of their text, then any order if they are
identical. Defined results: a null or empty text, or one under WINDOW bytes, loses nothing; of identical rows with
one doc_id the later lose everything (from WINDOW bytes on); an empty table gives an empty result; other columns are
ignored, whatever they are called.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import _powers, cut, mix64, text_bytes, text_of
from .suffix_array import grouped, grouped_many

WINDOW, GRAM = 100, 40
SAMPLE_OF, SAMPLE_ALL, HOT_SEEN, HOT_MOST = 64, 4096, 16, 100_000
#: Texts up to this length are sorted in lockstep, so many cells at a time; longer ones alone.
LOCKSTEP, CELLS = 1500, 1 << 19
#: Documents whose runs are held and sorted together.
SLICE = 2048
#: Rows of one doc_id are numbered in ranges of so many leading bits of their text's hash.
PART_BITS = 12
_SPAN = WINDOW - GRAM + 1
_LOW = np.uint64((1 << 20) - 1)
_CHUNK = (1 << 20) - 4 * WINDOW


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of all GRAM-byte strings (GRAM is a multiple of 8)."""
    words = np.ndarray((len(data) - 7,), "<u8", buffer=np.ascontiguousarray(data), strides=(1,))
    n = len(data) - GRAM + 1
    out = words[:n]
    for k in range(8, GRAM, 8):
        out = mix64(out) ^ words[k : k + n]
    return mix64(out)


def runs(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, first window and number of windows of each run of one text. Texts of a million bytes and more are cut
    into parts, whose runs end at the cut."""
    parts = []
    for at in range(0, max(1, len(data) - WINDOW + 1), _CHUNK):
        own = data[at : at + _CHUNK + WINDOW - 1]
        if len(own) < WINDOW:
            continue
        h = _gram_hashes(own)
        m = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)
        span = 1
        while span * 2 <= _SPAN:
            m = np.minimum(m[:-span], m[span:])
            span *= 2
        rest = _SPAN - span
        m = np.minimum(m[: len(m) - rest], m[rest:]) if rest else m
        first = np.flatnonzero(np.concatenate(([True], m[1:] != m[:-1])))
        parts.append((h[(m[first] & _LOW).astype(np.int64)], first + at, np.diff(np.append(first, len(m)))))
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _members(data: np.ndarray, hot: np.ndarray):
    """anchor, string hash, first window, windows of each run; hot anchors' windows one by one."""
    anchor, start, count = runs(data)
    if not len(anchor):
        return None
    if len(hot):
        at = np.minimum(np.searchsorted(hot, anchor), len(hot) - 1)
        split = hot[at] == anchor
    else:
        split = np.zeros(len(anchor), dtype=bool)
    if split.any():
        n = count[split]
        each = np.repeat(start[split], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        anchor, start, count = anchor[~split], np.concatenate((start[~split], each)), np.concatenate((count[~split], np.ones(len(each), np.int64)))
    up, down = _powers(len(data) + 1)
    prefix = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=prefix[1:])
    end = start + count + WINDOW - 1
    string = mix64((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64))
    if split.any():
        anchor = np.concatenate((anchor, mix64(string[len(anchor) :] ^ np.uint64(0xA5A5A5A5))))
    return anchor, string, start, count


MEMBERS = "anchor long, string long, doc_id long, nth int, start int, n int, removed boolean"
_MEMBERS = pa.schema([("anchor", pa.int64()), ("string", pa.int64()), ("doc_id", pa.int64()), ("nth", pa.int32()), ("start", pa.int32()), ("n", pa.int32()), ("removed", pa.bool_())])


def members(docs: DataFrame, hot: np.ndarray) -> DataFrame:
    """Runs of all documents, one of each string for each slice; ``removed`` marks the slice's other runs of it."""
    sent = docs.sparkSession.sparkContext.broadcast(np.sort(hot))

    def run(batches):
        for batch in (b.slice(at, SLICE) for b in batches for at in range(0, b.num_rows, SLICE)):
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            nth = batch.column(1).to_numpy(zero_copy_only=False)
            found = []
            for i in np.lexsort((nth, ids)):
                own = _members(text_bytes(batch.column(2)[int(i)].as_py()), sent.value)
                if own is not None:
                    found.append((*own, np.full(len(own[0]), ids[i]), np.full(len(own[0]), nth[i])))
            if not found:
                continue
            anchor, string, start, count, doc_id, number = (np.concatenate(x) for x in zip(*found, strict=True))
            # Runs of one document are in order of their windows, but for those that were split.
            order = np.lexsort((start, number, doc_id, string, anchor))
            a, s = anchor[order], string[order]
            again = np.zeros(len(order), dtype=bool)
            again[order[1:]] = (a[1:] == a[:-1]) & (s[1:] == s[:-1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchor.view(np.int64)), pa.array(string.view(np.int64)), pa.array(doc_id), pa.array(number.astype(np.int32)),
                 pa.array(start.astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(again)], schema=_MEMBERS,
            )

    return docs.select("doc_id", "nth", "text").mapInArrow(run, MEMBERS)


def hot_anchors(docs: DataFrame) -> np.ndarray:
    """Anchors that the sample shows with HOT_SEEN different strings or more."""
    few = docs.limit(SAMPLE_ALL + 1).count() <= SAMPLE_ALL
    drawn = docs if few else docs.where(F.pmod(F.xxhash64(F.lit(4), "doc_id"), F.lit(SAMPLE_OF)) == 0)
    seen = members(drawn, np.zeros(0, np.uint64)).where("not removed").select("anchor", "string").distinct().groupBy("anchor").agg(F.count(F.lit(1)).alias("n"))
    least = HOT_SEEN * (SAMPLE_OF if few else 1)
    rows = seen.where(F.col("n") >= least).orderBy(F.desc("n"), "anchor").limit(HOT_MOST).select("anchor").collect()
    return np.array([r[0] for r in rows], dtype=np.int64).view(np.uint64)


def repeated_windows(strings: list[bytes]) -> list[np.ndarray]:
    """For the different strings of one anchor, in document order: which of their windows start earlier too."""
    return _many_repeated([strings])[0]


def _text(strings: list[bytes]) -> np.ndarray:
    """The strings one after the other, each closed by a symbol of its own below all bytes, and a last 0."""
    n, out = len(strings), []
    for k, s in enumerate(strings):
        out += [np.frombuffer(s, np.uint8).astype(np.int32) + np.int32(n + 1), np.array([k + 1], np.int32)]
    return np.concatenate([*out, np.zeros(1, np.int32)])


def _repeats(text: np.ndarray, order: np.ndarray, lengths: list[int]) -> list[np.ndarray]:
    """From the suffix array: the windows of each class of equal ones, but for the class's first place in the text."""
    room = np.concatenate([np.arange(n, -1, -1) for n in lengths] + [[0]])  # bytes left in the own string
    order = order[room[order] >= WINDOW]
    repeat = np.zeros(len(text), dtype=bool)
    if len(order) > 1:
        a, b = order[:-1], order[1:]
        same = (text[a] == text[b]) & (text[a + WINDOW - 1] == text[b + WINDOW - 1])
        at = np.flatnonzero(same)
        for lo in range(0, len(at), 4096):
            k, reach = at[lo : lo + 4096], np.arange(WINDOW)
            same[k] = (text[a[k][:, None] + reach] == text[b[k][:, None] + reach]).all(axis=1)
        opens = np.flatnonzero(np.concatenate(([True], ~same)))
        first = np.repeat(np.minimum.reduceat(order, opens), np.diff(np.append(opens, len(order))))
        repeat[order[order != first]] = True
    out, at = [], 0
    for n in lengths:
        out.append(repeat[at : at + n - WINDOW + 1])
        at += n + 1
    return out


def _many_repeated(groups: list[list[bytes]]) -> list[list[np.ndarray]]:
    texts = [_text(g) for g in groups]
    out: list = [None] * len(groups)
    short = sorted((k for k, t in enumerate(texts) if len(t) <= LOCKSTEP), key=lambda k: len(texts[k]))
    at = 0
    while at < len(short):
        some = [short[at]]
        while at + len(some) < len(short) and (len(some) + 1) * len(texts[short[at + len(some)]]) <= CELLS:
            some.append(short[at + len(some)])
        at += len(some)
        lengths = np.array([len(texts[k]) for k in some])
        table = np.full((len(some), lengths.max()), -1, np.int32)
        for r, k in enumerate(some):
            table[r, : lengths[r]] = texts[k]
        found = grouped_many(table, lengths)
        for r, k in enumerate(some):
            out[k] = _repeats(texts[k], found[r, : lengths[r]].astype(np.int64), [len(s) for s in groups[k]])
    for k, t in enumerate(texts):
        if out[k] is None:
            out[k] = _repeats(t, np.array(grouped(t), dtype=np.int64), [len(s) for s in groups[k]])
    return out


SPANS = "doc_id long, nth int, start int, n int"
_SPANS = pa.schema([("doc_id", pa.int64()), ("nth", pa.int32()), ("start", pa.int32()), ("n", pa.int32())])


def _sorted_spans(batches):
    """Rows (anchor, doc_id, nth, start, bytes) in order: the removed windows of each anchor's strings."""
    held: list[list[tuple]] = []
    size, last = 0, None

    def settle():
        rows = []
        for group, found in zip(held, _many_repeated([[r[3] for r in g] for g in held]), strict=True):
            for (doc_id, nth, start, _), gone in zip(group, found, strict=True):
                edge = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])).astype(np.int8)))
                rows += [(doc_id, nth, start + int(x), int(y - x)) for x, y in edge.reshape(-1, 2)]
        columns = list(zip(*rows, strict=True)) if rows else [(), (), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SPANS, strict=True)], schema=_SPANS)

    for batch in batches:
        for anchor, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if anchor != last:
                if size > 1 << 21:
                    yield settle()
                    held, size = [], 0
                held.append([])
                last = anchor
            held[-1].append(tuple(row))
            size += len(row[3])
    if held:
        yield settle()


def numbered(docs: DataFrame) -> DataFrame:
    """doc_id (null: the smallest long), nth (place among rows of one doc_id, null ids first), no_id and text. Rows of one id are
    dealt over ranges of the hash of their text, so that an id that many rows share, or none, is numbered by many tasks."""
    own = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc_id"), F.col("doc_id").isNull().alias("no_id"), text_of().alias("text"))
    if own.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        return own.select("doc_id", F.lit(0).alias("nth"), "no_id", "text")
    own = own.withColumns({"h": F.xxhash64("text"), "tie": F.struct(F.hash("text"), F.crc32("text"), F.octet_length("text"))})
    own = own.withColumns({"known": ~F.col("no_id"), "part": F.shiftright("h", 64 - PART_BITS).cast("int")})
    sizes = cut(own.groupBy("doc_id", "known", "part").agg(F.count(F.lit(1)).alias("n")), "id-sizes")
    before = Window.partitionBy("doc_id").orderBy("known", "part").rowsBetween(Window.unboundedPreceding, -1)
    bases = cut(sizes.select("doc_id", "known", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "id-bases", sizes)
    place = F.row_number().over(Window.partitionBy("doc_id", "known", "part").orderBy("h", "tie")) - 1
    placed = own.withColumn("place", place).join(bases, ["doc_id", "known", "part"])
    return cut(placed.select("doc_id", (F.col("base") + F.col("place")).cast("int").alias("nth"), "no_id", "text"), "numbered")


def removed_spans(docs: DataFrame) -> DataFrame:
    """Runs of removed windows (doc_id, nth, start, n) of numbered documents."""
    found = members(docs, hot_anchors(docs))
    # One shuffle, by anchor: only anchors that occur again go on, and of those strings only what must be known.
    # Rows that a slice has settled are dealt anywhere: a popular anchor does not gather them.
    key = F.when(F.col("removed"), F.xxhash64("doc_id", "nth", "start")).otherwise(F.col("anchor"))
    dealt = found.withColumn("key", key).repartition("key")
    whole = Window.partitionBy("key")
    again = dealt.withColumn("rows", F.count(F.lit(1)).over(whole)).where("removed or rows > 1").drop("rows")
    ranked = again.withColumn("rank", F.row_number().over(Window.partitionBy("key", "string").orderBy("doc_id", "nth", "start")))
    ranked = ranked.withColumn("strings", F.sum(F.when(F.col("rank") == 1, 1)).over(whole)).withColumn("copy", F.col("removed") | (F.col("rank") > 1))
    kept = cut(ranked.where("copy or strings > 1").select("anchor", "doc_id", "nth", "start", "n", "copy"), "runs")
    copies = kept.where("copy").select("doc_id", "nth", "start", "n")

    wanted = kept.where("not copy").groupBy("doc_id", "nth").agg(F.collect_list(F.struct("anchor", "start", "n")).alias("cut"))
    texts = docs.select("doc_id", "nth", "text").join(wanted, ["doc_id", "nth"])

    def strings(batches):
        for batch in batches:
            out = []
            for doc_id, nth, text, some in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                out += [(c["anchor"], doc_id, nth, c["start"], raw[c["start"] : c["start"] + c["n"] + WINDOW - 1]) for c in some]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["anchor", "doc_id", "nth", "start", "bytes"])

    cuts = texts.mapInArrow(strings, "anchor long, doc_id long, nth int, start int, bytes binary")
    grouped_by = cuts.repartition("anchor").sortWithinPartitions("anchor", "doc_id", "nth", "start")
    return copies.unionByName(grouped_by.mapInArrow(_sorted_spans, SPANS))


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the bytes that stay) of every row of ``docs``."""
    own = numbered(docs)
    spans = removed_spans(own).groupBy("doc_id", "nth").agg(F.collect_list(F.struct("start", "n")).alias("gone"))
    joined = own.join(spans, ["doc_id", "nth"], "left").select(F.when(~F.col("no_id"), F.col("doc_id")).alias("doc_id"), "text", "gone")

    def apply(batches):
        for batch in batches:
            out = []
            for doc_id, text, gone in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                data, spans_ = np.frombuffer(raw, np.uint8), 0
                if gone.is_valid and len(gone.values):
                    start = gone.values.field(0).to_numpy()
                    end = start + gone.values.field(1).to_numpy() + WINDOW - 1
                    depth = np.zeros(len(data) + 1, np.int32)
                    np.add.at(depth, start, 1)
                    np.add.at(depth, end, -1)
                    lost = np.cumsum(depth[:-1]) > 0
                    spans_ = int(lost[0]) + int((lost[1:] & ~lost[:-1]).sum())
                    raw = data[~lost].tobytes()
                out.append((doc_id, len(data), len(data) - len(raw), spans_, hashlib.sha256(raw).hexdigest(), raw))
            yield pa.RecordBatch.from_pylist([dict(zip(_OUT.names, r, strict=True)) for r in out], schema=_OUT)

    return joined.mapInArrow(apply, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


_OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])
