"""Near-duplicate detection with DartMinHash signatures and banded joining.

A text is the weighted set of its five-word shingles. Darts are hashed into the (weight, rank) half-plane of every
element: a Poisson number of them, of density one, in each dyadic region, with the coordinates taken from hashes
too. A dart counts if it lies below the element's weight; each counted dart has one of ``HASHES`` coordinates, and
the signature keeps, for each coordinate, the dart of the lowest rank. Regions are visited by rising rank until every
coordinate has a dart, so heavy or large sets cost no more than small ones, and two sets agree in a coordinate
with probability equal to their weighted Jaccard similarity. Weights are 1 for each distinct shingle by
default ("binary": the similarity is then the plain Jaccard similarity), or its count ("count").

Equal texts (word for word) are one node, sketched once and told apart by 128 bits of their SHA-256. The
``BANDS`` band keys of a signature find candidates. In a group of one band key every node is compared
with one hub only (the member whose band groups are largest, the likely original of a family); verified links give classes (connected components). After that,
nodes of one band group that are still in different classes are compared too, class against class, so no
candidate pair that could join two classes is left out, whatever the hubs; pairs inside one class are not emitted, nor pairs whose
counts or bitmaps of elements show that they share too few to reach the similarity. All
comparisons are exact (sorted shingle hashes), at similarity ``SIMILARITY`` or more. With 24 bands of 5, a pair at
0.8 is missed with probability 7e-5, and less above.

Rows of hot bands and hot texts are pre-aggregated before each shuffle; joins by band are between written tables, so that
Spark can split their hot keys. Texts are never shuffled but for those that a sieve (see ``common``) lets through: the
texts of candidates, and in ``keep_one`` the rows that may have to go.

Defined results: null texts and texts without words are in a class of their own, row by row; a text of fewer than five
words is one shingle. The class is that of the row's text: rows repeated with one doc_id have the class of each
one's own text. ``class_id`` is the smallest doc_id of the class, null if it has none (null doc_ids are compared like others). An
empty table gives an empty result; other columns are ignored, and ``keep_one`` hands them on, whatever their names. It keeps
the row of the smallest doc_id (null last) of each class, one of rows repeated with the same id and words.
"""

from __future__ import annotations

import math
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, mix64, settled, shingle_hashes, sieve, sift, text_bytes, text_of, word_hashes

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 24, 5
HASHES = BANDS * ROWS
#: Rank regions: [0, 2**LOWEST), then doubling.
LOWEST = -3
#: Words of 64 bits in a document's bitmap of elements.
BITMAP = 8


@lru_cache(maxsize=256)
def _poisson_cdf(mean: float) -> np.ndarray:
    """Cumulative probabilities of a Poisson distribution, as far as doubles can tell them from 1."""
    p, out, k = math.exp(-mean), [], 0
    while not out or (out[-1] < 1 - 1e-15 and k < mean + 12 * math.sqrt(mean) + 40):
        out.append((out[-1] if out else 0.0) + p)
        k += 1
        p *= mean / k
    return np.array(out)


def _unit(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)).astype(np.float64) * (1.0 / (1 << 53))


def _seed(*parts: int) -> np.uint64:
    x = 0x2545F4914F6CDD1D
    for p in parts:
        x = (x ^ ((p + 0x9E37) * 0x9E3779B97F4A7C15)) & ((1 << 64) - 1)
        x = (x ^ (x >> 31)) * 0xD6E8FEB86659FD93 & ((1 << 64) - 1)
    return np.uint64(x)


def darts(elements: np.ndarray, weights: np.ndarray | None = None, k: int = HASHES) -> np.ndarray:
    """The signature: for each of k coordinates the hash of its earliest dart. Elements are distinct hashes."""
    best_rank, best = np.full(k, np.inf), np.zeros(k, dtype=np.uint64)
    if not len(elements):
        return best
    top = 1.0 if weights is None else float(weights.max())
    steps, low = 0, 0.0
    high = 2.0**LOWEST
    while not np.isfinite(best_rank).all():
        layer, bottom, ceiling = 0, 0.0, 1.0
        while bottom < top:
            own, own_w = (elements, weights) if bottom == 0 or weights is None else (elements[weights > bottom], weights[weights > bottom])
            mean = (ceiling - bottom) * (high - low)
            cdf, u = _poisson_cdf(mean), _unit(mix64(own ^ _seed(1, steps, layer)))
            hit = np.flatnonzero(u >= cdf[0])
            if len(hit):
                n = np.searchsorted(cdf, u[hit], side="right")
                who = np.repeat(hit, n)
                nth = np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n)
                dart = mix64(own[who] ^ (nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ _seed(2, steps, layer))
                if weights is not None:
                    dart = dart[bottom + (ceiling - bottom) * _unit(mix64(dart ^ _seed(3))) < own_w[who]]
                rank, at = low + (high - low) * _unit(mix64(dart ^ _seed(4))), (mix64(dart ^ _seed(5)) % np.uint64(k)).astype(np.int64)
                order = np.argsort(rank, kind="stable")[::-1]  # the earliest is written last
                first = np.full(k, -1)
                first[at[order]] = order
                new = np.flatnonzero(first >= 0)
                new = new[rank[first[new]] < best_rank[new]]
                best_rank[new], best[new] = rank[first[new]], dart[first[new]]
            layer, bottom, ceiling = layer + 1, ceiling, ceiling * 2
        steps, low, high = steps + 1, high, high * 2
    return best


def band_keys(signature: np.ndarray, rows: int = ROWS) -> np.ndarray:
    s = signature.reshape(-1, rows)
    out = np.arange(len(s), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for j in range(rows):
        out = mix64(out ^ s[:, j]) + s[:, j]
    return mix64(out).view(np.int64)


def weighted_shingles(text: str | None, weighting: str) -> tuple[np.ndarray, np.ndarray | None]:
    """Distinct shingle hashes, sorted, and their weights (None: all 1)."""
    every = shingle_hashes(word_hashes(text_bytes(text)), SHINGLE)
    if weighting == "count":
        found, n = np.unique(every, return_counts=True)
        return found, n.astype(np.float64)
    return np.unique(every), None


def sketches(texts: DataFrame, weighting: str = "binary") -> DataFrame:
    """doc_id, digest and key as they come, bands (array<long>) and n (total weight; 0 without words) of every row of
    (doc_id, digest, key, text)."""

    def run(batches):
        for batch in batches:
            bands, sizes = [], []
            for text in batch.column(3):
                elements, weights = weighted_shingles(text.as_py(), weighting)
                bands.append(band_keys(darts(elements, weights)) if len(elements) else [])
                sizes.append(float(len(elements) if weights is None else weights.sum()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(bands, pa.list_(pa.int64())), pa.array(sizes, pa.float64())], names=["doc_id", "digest", "key", "bands", "n"])

    return texts.select("doc_id", "digest", "key", "text").mapInArrow(run, "doc_id long, digest binary, key long, bands array<long>, n double")


def shingle_sets(texts: DataFrame, weighting: str = "binary") -> DataFrame:
    """Of rows (node, text): node and its elements as sorted longs; with counts, the c-th copy of a shingle is an element
    of its own, which makes the weighted similarity the plain one."""

    def run(batches):
        for batch in batches:
            nodes, sets = [], []
            for node, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                elements, weights = weighted_shingles(text.as_py(), weighting)
                if weights is not None:
                    n = weights.astype(np.int64)
                    nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    elements = mix64(np.repeat(elements, n) + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                nodes.append(node)
                sets.append(elements.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["node", "elements"])

    return texts.select("node", "text").mapInArrow(run, "node long, elements array<long>")


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) whose exact similarity reaches the threshold. The sets grow with the corpus, so they always meet
    by a shuffle; the many pairs of one popular node are split by Spark's skew join."""
    left, right = sets.select(F.col("node").alias("a"), F.col("elements").alias("ea")), sets.select(F.col("node").alias("b"), F.col("elements").alias("eb"))
    both = F.size(F.array_intersect("ea", "eb"))
    return pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").where(both >= similarity * (F.size("ea") + F.size("eb") - both)).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """node and root (the smallest node of its connected component), for nodes that have links. Rounds of
    large-star and small-star until nothing changes; each round's links are written to the shared folder."""
    links = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    before, now = None, ()
    while now != before:
        before = now
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.where("u <> v").distinct()
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        links = cut(small.where("u <> v").distinct(), "links", links)
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return links.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")


def _only(one: str, other: str) -> Column:
    """How many bits of the first node's bitmap the other lacks."""
    bits = (F.bit_count(F.col(f"{one}.bits{k}").bitwiseAND(F.bitwise_not(F.col(f"{other}.bits{k}")))) for k in range(BITMAP))
    return reduce(lambda a, b: a + b, bits)


def _mixed(placed: DataFrame) -> DataFrame:
    """The rows of band groups that hold several classes."""
    bands = cut(placed.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("band"), "mixed")
    return placed.join(bands, "band", "left_semi")


def _with_partners(placed: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Drop rows that can have no link to another class: ``common`` counts the elements that some other of these
    nodes has too, and a link takes at least ``similarity`` of all. An exact bound, so nothing is lost; it spares
    the pairs of large families whose members each differ from the original a little too much."""
    own = sets.join(placed.select("node").distinct(), "node", "left_semi").select("node", F.explode("elements").alias("e"))
    alone = own.groupBy("e").agg(F.count(F.lit(1)).alias("k"), F.min("node").alias("node")).where("k = 1").groupBy("node").agg(F.count(F.lit(1)).alias("alone"))
    # A bitmap of each node's elements: a bit that only one of two nodes has is an element they do not share.
    at = F.pmod(F.shiftright("e", 6), F.lit(BITMAP))
    bits = own.groupBy("node").agg(*(F.bit_or(F.when(at == k, F.expr("shiftleft(1L, cast(e & 63 as int))")).otherwise(F.lit(0).cast("long"))).alias(f"bits{k}") for k in range(BITMAP)))
    left = placed.select("band", "node", "n", "root").join(alone, "node", "left").withColumn("common", F.col("n") - F.coalesce("alone", F.lit(0))).drop("alone")
    left = cut(left.join(bits, "node").where(F.col("common") >= similarity * F.col("n") - 1e-6), "partners")
    return _mixed(left)


def _digest(text: Column) -> Column:
    """128 bits of the text's words; null without words."""
    words = F.trim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " "))
    return F.when(words != "", F.unhex(F.substring(F.sha2(words, 256), 1, 32)))


def _row_key(doc_id: Column, text: Column) -> Column:
    return F.xxhash64(doc_id, text)


def _grouped(docs: DataFrame, similarity: float, weighting: str) -> DataFrame:
    """doc_id, digest, key (a hash of id and text) and group (the digest of one text of the class; null without words) of each row."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    keyed = keyed.withColumns({"digest": _digest(F.col("text")), "key": _row_key(F.col("doc_id"), F.col("text"))})
    sketched = cut(sketches(keyed, weighting), "sketches")
    rows = sketched.select("doc_id", "digest", "key")
    # Equal texts have equal sketches: any one of them stays. The number is written, so it is the same in all that follows.
    first = sketched.where(F.col("digest").isNotNull()).groupBy("digest").agg(F.first("bands").alias("bands"), F.first("n").alias("n"))
    heads = cut(first.withColumn("node", F.monotonically_increasing_id()), "heads")

    bands = heads.select(F.explode("bands").alias("band"), "node", "n")
    shared = cut(bands.groupBy("band").agg(F.count(F.lit(1)).alias("members")).where("members > 1"), "shared")
    met = cut(bands.join(shared, "band"), "met", shared)
    # The middle of a family of copies is in the largest groups of all its bands: the best hub.
    centre = cut(met.groupBy("node").agg(F.sum("members").alias("weight")), "centre")
    met = cut(met.drop("members").join(centre, "node"), "met", met)
    hubs = met.groupBy("band").agg(F.max(F.struct("weight", (-F.col("node")).alias("minus"), "n")).alias("h"))
    hubs = cut(hubs.select("band", (-F.col("h.minus")).alias("hub"), F.col("h.n").alias("hub_n")), "hubs")
    met = cut(met.drop("weight").join(hubs, "band"), "met", met, hubs)
    size_ok = F.least("n", "hub_n") >= similarity * F.greatest("n", "hub_n")
    stars = cut(met.where((F.col("node") != F.col("hub")) & size_ok).select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct(), "stars")

    # The texts of candidates: one row of each, found by its key through the sieve and told from others of the key by its digest.
    names = heads.select("digest", "node")
    near = names.join(centre.select("node"), "node", "left_semi").join(rows.groupBy("digest").agg(F.min("key").alias("key")), "digest")
    near = cut(near, "near", centre)
    texts, _ = sift(keyed.select("key", "text"), "key", sieve(near))
    texts = texts.withColumn("digest", _digest(F.col("text"))).groupBy("key", "digest").agg(F.first("text").alias("text"))
    sets = cut(shingle_sets(texts.join(near, ["key", "digest"]), weighting), "sets", near)
    links = cut(verified(stars, sets, similarity), "star-links")
    root = cut(components(links), "roots")

    # What the stars left apart: classes that share a band group, member against member of other classes.
    placed = met.join(root, "node", "left").select("band", "node", "n", F.coalesce("root", "node").alias("root"))
    placed = cut(placed, "placed", met)
    placed = cut(_mixed(placed), "placed", placed)
    for _ in range(2):
        placed = cut(_with_partners(placed, sets, similarity), "placed", placed)
    x, y = placed.alias("x"), placed.alias("y")
    apart = (F.col("x.band") == F.col("y.band")) & (F.col("x.root") < F.col("y.root")) & (F.least("x.n", "y.n") >= similarity * F.greatest("x.n", "y.n"))
    # No pair can share more than either has in common with anyone.
    needed = similarity / (1 + similarity) * (F.col("x.n") + F.col("y.n")) - 1e-6
    apart = apart & (F.least("x.common", "y.common") >= needed) & (F.least(F.col("x.n") - _only("x", "y"), F.col("y.n") - _only("y", "x")) >= needed)
    rest = x.join(y, apart).select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct().join(stars.select("a", "b"), ["a", "b"], "left_anti")
    rest = cut(rest, "rest", placed, stars)
    more = cut(verified(rest, sets, similarity), "rest-links", rest, sets)
    if not more.isEmpty():
        root = cut(components(links.unionByName(more)), "roots", root)

    linked = root.join(names, "node").select("root", "digest").join(names.select(F.col("node").alias("root"), F.col("digest").alias("group")), "root")
    linked = cut(linked.select("digest", "group"), "linked", heads, root, links, more)
    return cut(rows.join(linked, "digest", "left").withColumn("group", F.coalesce("group", "digest")), "grouped", sketched, linked)


def classes(docs: DataFrame, similarity: float = SIMILARITY, weighting: str = "binary") -> DataFrame:
    """doc_id, class_id (smallest doc_id of its class) and class_size of every row of ``docs``."""
    rows = _grouped(docs, similarity, weighting)
    sizes = cut(rows.where(F.col("group").isNotNull()).groupBy("group").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size")), "sizes")
    wordless = rows.where(F.col("group").isNull()).select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"))
    return rows.join(sizes, "group").select("doc_id", "class_id", "class_size").unionByName(wordless)


def keep_one(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row of each class with the columns of ``docs``."""
    rows = _grouped(docs, similarity, "binary")
    known = rows.where(F.col("group").isNotNull()).groupBy("group", "doc_id", "digest", "key").agg(F.count(F.lit(1)).alias("n"))
    known = cut(known.withColumn("own", F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key", "digest")).select("group", "own", "n"), "distinct-rows", rows)
    best = cut(known.groupBy("group").agg(F.min("own").alias("best"), F.count(F.lit(1)).alias("members")), "best")
    # What must be looked at: the rows that go, and those that stay once of several.
    stays = F.col("own") == F.col("best")
    doubtful = known.join(best.where("members > 1"), "group").where(~stays | (F.col("n") > 1)).select("own", stays.alias("stays"))
    repeated = known.where("n > 1").join(best.where("members = 1"), "group").select("own", F.lit(True).alias("stays"))
    doubtful = cut(doubtful.unionByName(repeated).select("own.doc_id", "own.key", "own.digest", "stays"), "doubtful", known, best)

    own_id = F.col("doc_id").cast("long")
    return settled(docs, _row_key(own_id, text_of()), {"doc_id": own_id, "digest": _digest(text_of())}, doubtful)
