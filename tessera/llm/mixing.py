"""Mixing sources to target weights by Poisson replication (DataFrame functions).

Every source has a target share of the mixture. Its mean repetition rate is target share times total size over
its own size, sizes being counted over all rows (partial sums before the shuffle). A document's number of copies is the Poisson
quantile, at that mean, of a uniform number hashed from seed and doc_id: independent between documents, the same in
every run, and fixed by the document alone given the rate. The document is exploded by its count and the copies
are dealt out in the order of a hash of (seed, doc_id, copy): a global shuffle by range partitioning.

Sources that have no target weight share what the named weights leave of 1 in proportion to their size; with
``keep_unlisted`` each has at least the share that it has of the corpus, and targets of more than 1 in all are scaled to 1. With
``fill``, targets of less than 1 in all (named sources that are absent) are scaled to 1 too. With no weights at all every source
has the share of its size to the power ``TEMPERATURE``, normalised.

Defined results: a null source is a source of its own; a null or empty text has size 1 (characters plus one); null
doc_ids are hashed as null, so share one count; repeated rows get equal counts; an empty table gives an empty result; the
columns of the input are handed on, whatever they are called, with ``copy`` and ``mix_key`` added by ``mix`` (underscores
follow these names where the input has them already).

A rate above ``EXACT_RATE`` has no table of probabilities: its quantile is that of the normal distribution with the
Poisson's mean and variance and the next term of the Cornish-Fisher expansion, rounded; at such means the two differ by one copy at most. So
what is sent with a source has a fixed size.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, free_names, text_of

TEMPERATURE = 0.5
#: Sources whose rates are sent to every executor; with more of them, rates meet rows by a shuffle.
BROADCAST_SOURCES = 2_000
#: Rates up to here are inverted exactly, by probabilities of at most EXACT_RATE + 12 * sqrt(EXACT_RATE) + 21 counts.
EXACT_RATE = 300.0
#: Targets whose sum is as close to 1 as this are taken as they are.
SLACK = 1e-9


def digest_bits(digits: int, seed: int, *cols: Column) -> Column:
    """The first hexadecimal digits of the MD5 digest of seed and columns, as a long."""
    parts = F.concat_ws("|", F.lit(str(seed)), *(F.coalesce(c.cast("string"), F.lit("null")) for c in cols))
    return F.conv(F.substring(F.md5(parts), 1, digits), 16, 10).cast("long")


def uniform(seed: int, *cols: Column) -> Column:
    """A number in (0, 1) from 48 bits."""
    return (digest_bits(12, seed, *cols).cast("double") + F.lit(0.5)) / F.lit(float(1 << 48))


def rates(docs: DataFrame, weights: dict[str, float] | None = None, keep_unlisted: bool = False, fill: bool = False) -> DataFrame:
    """source, size, rate and the Poisson probabilities of 0, 1, 2, ... (as far as they matter to a double)."""
    sizes = docs.groupBy("source").agg(F.sum(F.char_length(text_of()).cast("long") + 1).alias("size"))
    sizes = cut(sizes, "source-sizes")
    whole = sizes.agg(F.sum("size")).first()[0] or 1
    total = F.lit(whole)
    if weights is None:
        share = F.pow("size", F.lit(TEMPERATURE))
        norm = sizes.agg(F.sum(share)).first()[0] or 1.0
        target = share / F.lit(norm)
    else:
        named = F.lit(None).cast("double")
        for name, w in weights.items():
            named = F.when(F.col("source") == name, F.lit(float(w))).otherwise(named)
        present = sizes.agg(F.sum(named), F.sum(F.when(named.isNull(), F.col("size")))).first()
        left, rest = max(0.0, 1.0 - (present[0] or 0.0)), present[1] or 1
        if keep_unlisted:
            left = max(left, rest / whole)
        target = F.coalesce(named, F.lit(left) * F.col("size") / F.lit(rest))
        norm = sizes.agg(F.sum(target)).first()[0] or 1.0
        if (keep_unlisted and norm > 1 + SLACK) or (fill and norm < 1 - SLACK):
            target = target / F.lit(norm)
    rated = sizes.withColumn("rate", target * total / F.col("size"))
    # p_k = exp(k ln m - m - ln k!), with Stirling's series for the factorial beyond 20.
    factorial = "if(k <= 20, ln(factorial(k)), k * ln(k) - k + 0.5D * ln(2D * pi() * k) + 1D / (12D * k) - 1D / (360D * k * k * k) + 1D / (1260D * pow(k, 5)))"
    pmf = F.expr(f"transform(sequence(0, cast(ceil(rate + 12 * sqrt(rate) + 20) as int)), k -> exp(k * ln(rate) - rate - {factorial}))")
    exact = (F.col("rate") > 0) & (F.col("rate") <= EXACT_RATE)
    return rated.withColumn("pmf", F.when(exact, pmf).when(F.col("rate") <= 0, F.array(F.lit(1.0))))


def _normal_quantile(u: Column) -> Column:
    """Acklam's rational approximation of the standard normal quantile (fixed values), by its middle and its tails."""
    poly = lambda c, x: reduce(lambda acc, k: acc * x + F.lit(k), c[1:], F.lit(c[0]))
    a = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
    b = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
    c = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
    d = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)
    middle, r = u - 0.5, (u - 0.5) * (u - 0.5)
    low, high = F.sqrt(F.lit(-2.0) * F.log(u)), F.sqrt(F.lit(-2.0) * F.log(1 - u))
    return F.when(u < 0.02425, poly(c, low) / poly(d, low)).when(u > 1 - 0.02425, -poly(c, high) / poly(d, high)).otherwise(middle * poly(a, r) / poly(b, r))


def _with_copies(docs: DataFrame, weights: dict[str, float] | None, seed: int, keep_unlisted: bool, fill: bool) -> tuple[DataFrame, str]:
    """``docs`` with one more column, the Poisson count of each row, and its name."""
    rated = cut(rates(docs, weights, keep_unlisted, fill), "rates")
    source, rate, pmf, u, copies = free_names(docs, "of_source", "of_rate", "of_pmf", "of_u", "of_copies")
    own = rated.select(F.col("source").alias(source), F.col("rate").alias(rate), F.col("pmf").alias(pmf))
    few = rated.count() <= BROADCAST_SOURCES
    found = docs.join(F.broadcast(own) if few else own, F.col("source").eqNullSafe(F.col(source)))
    found = found.withColumn(u, uniform(seed, F.col("doc_id")))
    # The quantile: how many values of the distribution function lie at or below u.
    quantile = F.expr(f"aggregate({pmf}, struct(0D as s, 0L as n), (a, p) -> struct(a.s + p as s, a.n + if({u} >= a.s + p, 1L, 0L) as n)).n")
    z = _normal_quantile(F.col(u))
    far = F.greatest(F.lit(0.0), F.floor(F.col(rate) + F.sqrt(rate) * z + (z * z - 1) / 6 + 0.5)).cast("long")
    return found.withColumn(copies, F.when(F.col(pmf).isNotNull(), quantile).otherwise(far)).drop(source, rate, pmf, u), copies


def copies(docs: DataFrame, weights: dict[str, float] | None = None, seed: int = 5, keep_unlisted: bool = False, fill: bool = False) -> DataFrame:
    """doc_id, source and ``copies`` of each row."""
    found, count = _with_copies(docs, weights, seed, keep_unlisted, fill)
    return found.select("doc_id", "source", F.col(count).alias("copies"))


def _exploded(docs: DataFrame, names: list[str], weights, seed: int, keep_unlisted: bool, fill: bool) -> DataFrame:
    """Each row once for each copy, with its number and a hash of id and number under ``names``, in the order of that hash."""
    copy, key = names
    counted, count = _with_copies(docs, weights, seed, keep_unlisted, fill)
    exploded = counted.where(F.col(count) > 0).select(*docs.columns, F.explode(F.sequence(F.lit(0), F.col(count).cast("int") - 1)).alias(copy))
    keyed = exploded.withColumn(key, digest_bits(15, seed, F.col("doc_id"), F.col(copy)))
    return keyed.repartitionByRange(key).sortWithinPartitions(key, "doc_id", copy)


def mix(docs: DataFrame, weights: dict[str, float] | None = None, seed: int = 5, keep_unlisted: bool = False, fill: bool = False) -> DataFrame:
    """The mixture: each row of ``docs`` once for each copy, in shuffled order, with ``copy`` (from 0) and ``mix_key``."""
    return _exploded(docs, free_names(docs, "copy", "mix_key"), weights, seed, keep_unlisted, fill)


def mixture(docs: DataFrame, weights: dict[str, float] | None = None, seed: int = 5, keep_unlisted: bool = False, fill: bool = False) -> DataFrame:
    """As ``mix``, with the columns of ``docs`` alone."""
    return _exploded(docs, free_names(docs, "copy", "mix_key"), weights, seed, keep_unlisted, fill).select(*docs.columns)
