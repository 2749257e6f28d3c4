"""The registered queries of this subpackage: thin wrappers that apply an operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, langid, minhash, mixing, packing, quality, sharding, substrings, tokens, toxicity
from .common import load

Query = Callable[[SparkSession, str], DataFrame]


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.score(load(spark, sf_dir, "documents"))
    return scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(load(spark, sf_dir, "documents"))


#: Target shares of the mixture: equal for the twenty sources.
TARGETS = {f"src{i}": 0.05 for i in range(20)}


def op5_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(load(spark, sf_dir, "documents"), TARGETS, keep_unlisted=True, fill=True)
    return mixed.select("doc_id", "text", "source", "n_chars", "copy", "mix_key")


def op3_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = tokens.write_tokens(load(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return tokens.read_summary(spark, path)


def op4_suffix_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.dedup(load(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op6_nearest_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    model = langid.train(docs, ~langid.held_out())
    found = langid.predict(docs, model)
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", "rejected")


def op7_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.classes(load(spark, sf_dir, "documents")).withColumn("kept", F.col("doc_id") == F.col("class_id"))


def op8_ordinal_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return toxicity.predict(docs, toxicity.train(docs, load(spark, sf_dir, "labels")))


def op9_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed, _ = sharding.shard(load(spark, sf_dir, "documents"), n_shards=8)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot",
    )


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.groups(load(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


QUERIES: dict[str, Query] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_length_buckets": op2_length_buckets,
    "op3_token_blocks": op3_token_blocks,
    "op4_suffix_groups": op4_suffix_groups,
    "op5_poisson_mixing": op5_poisson_mixing,
    "op6_nearest_centroid": op6_nearest_centroid,
    "op7_dart_minhash": op7_dart_minhash,
    "op8_ordinal_toxicity": op8_ordinal_toxicity,
    "op9_virtual_slots": op9_virtual_slots,
    "op10_exact_dedup": op10_exact_dedup,
}

def _quality_oracle() -> str:
    """The features, votes, estimation and verdict of ``quality`` in plain SQL; the estimation is a recursive query."""
    q = quality
    words = ", ".join(f"'{w}'" for w in dict.fromkeys(q.FUNCTION_WORDS))
    vote = ", ".join(f"CASE WHEN {r.good} THEN 1 WHEN {r.bad} THEN -1 ELSE 0 END" for r in q.RULES)
    m = len(q.RULES)
    vote_odds = "CASE {v} WHEN 1 THEN ln(good[j] / (1 - bad[j])) WHEN -1 THEN ln((1 - good[j]) / bad[j]) ELSE 0 END"
    evidence = f"list_sum(list_transform(range(1, {m} + 1), lambda j: {vote_odds.format(v='p.v[j]')}))"
    total = lambda body: f"list_sum(list_transform(range(1, len(found) + 1), lambda k: {body}))"
    bound = lambda x, b: f"greatest({b[0]}::DOUBLE, least({b[1]}::DOUBLE, {x}))"
    ratio = lambda start, sign, weight: (
        f"({start * q.PRIOR} + {total(f'found[k].n * {weight} * CASE WHEN found[k].v[j] = {sign} THEN 1 ELSE 0 END')}) / ({q.PRIOR} + {total(f'found[k].n * {weight} * abs(found[k].v[j])')})"
    )
    good = f"list_transform(range(1, {m} + 1), lambda j: {bound(ratio(q.START_GOOD, 1, 'q[k]'), q.BOUNDS_GOOD)})"
    bad = f"list_transform(range(1, {m} + 1), lambda j: {bound(ratio(q.START_BAD, -1, '(1 - q[k])'), q.BOUNDS_BAD)})"
    share = bound(f"({q.START_SHARE * q.PRIOR} + {total('found[k].n * q[k]')}) / ({q.PRIOR} + {total('found[k].n')})", q.BOUNDS_SHARE)
    odds = " + ".join("(" + vote_odds.format(v=f"votes[{j}]").replace("[j]", f"[{j}]") + ")" for j in range(1, m + 1))
    return rf"""
        WITH RECURSIVE t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
        w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
        spot AS (SELECT doc_id, i, array_to_string(words[i:i + 7], ' ') AS run FROM w, range(1, len(words) - 6) r(i)),
        twice AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, run) AS c FROM spot),
        steps AS (SELECT doc_id, least(8, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 8)) AS step FROM twice WHERE c > 1),
        repeated AS (SELECT doc_id, CAST(sum(step) AS BIGINT) AS n FROM steps GROUP BY doc_id),
        f AS (SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
                     CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, CAST(length(regexp_replace(text, '[^A-ZÀ-Þ]+', '', 'g')) AS BIGINT) AS n_capitals,
                     len(lines) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
                     len(list_filter(lines, lambda x: regexp_matches(rtrim(x, ' '), '[.!?"''…»”]$'))) AS n_ended_lines, len(list_filter(words, lambda x: x IN ({words}))) AS n_function_words,
                     coalesce(r.n, 0) AS n_repeat_words FROM w LEFT JOIN repeated r USING (doc_id)),
        voted AS (SELECT *, [{vote}] AS votes FROM f),
        pat AS (SELECT list({{'v': votes, 'n': n}} ORDER BY votes) AS found FROM (SELECT votes, CAST(count(*) AS DOUBLE) AS n FROM voted GROUP BY votes)),
        em(i, good, bad, share) AS (
            SELECT 0, [{q.START_GOOD}::DOUBLE for x in range({m})], [{q.START_BAD}::DOUBLE for x in range({m})], {q.START_SHARE}::DOUBLE
            UNION ALL
            SELECT i + 1, {good}, {bad}, {share}
            FROM (SELECT i, good, bad, share, found, list_transform(found, lambda p: 1 / (1 + exp(-(ln(share / (1 - share)) + {evidence})))) AS q FROM em, pat WHERE i < {q.ITERATIONS}) s),
        fit AS (SELECT good, bad, share FROM em WHERE i = {q.ITERATIONS}),
        scored AS (SELECT voted.*, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, 1 / (1 + exp(-(ln(share / (1 - share)) + {odds}))) AS p FROM voted, fit)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND p >= 0.5 AS kept FROM scored
    """


ORACLES: dict[str, str] = {
    "op1_quality_rules": _quality_oracle(),
    "op4_suffix_groups": """
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
             w AS (SELECT doc_id, p, substr(h, 2 * p + 1, 200) AS s FROM d, range(0, greatest(length(h) // 2 - 99, 0)) t(p)),
             later AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS k FROM w) x WHERE k > 1),
             steps AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 100 THEN 0 ELSE 1 END AS opens FROM later),
             spans AS (SELECT doc_id, min(p) AS lo, max(p) + 100 AS hi FROM (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY p) AS g FROM steps) y GROUP BY doc_id, g),
             gaps AS (SELECT doc_id, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS low FROM spans),
             cuts AS (SELECT doc_id, count(*) AS n_spans, CAST(sum(hi - lo) AS BIGINT) AS n_removed, max(hi) AS tail, string_agg(substr(h, 2 * low + 1, 2 * (lo - low)), '' ORDER BY lo) AS head
                      FROM gaps JOIN d USING (doc_id) GROUP BY doc_id)
        SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
               sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(tail, 0) + 1))) AS kept_sha256
        FROM d LEFT JOIN cuts USING (doc_id)
    """,
    "op5_poisson_mixing": """
        WITH sizes AS (SELECT source, sum(length(coalesce(text, '')) + 1) AS size FROM documents GROUP BY source),
             total AS (SELECT sum(size) AS total FROM sizes),
             listed AS (SELECT *, CASE WHEN regexp_full_match(source, 'src(1?[0-9])') THEN 0.05 END AS weight FROM sizes),
             rest AS (SELECT greatest(0, 1 - coalesce(sum(weight), 0)) AS spare, sum(CASE WHEN weight IS NULL THEN size END) AS size FROM listed),
             rates AS (SELECT l.source, coalesce(weight, spare * l.size / rest.size) * total / l.size AS rate FROM listed l, total, rest),
             pmf AS (SELECT source, k, CASE WHEN k = 0 THEN exp(-rate) ELSE exp(k * ln(rate) - rate - lgamma(k + 1)) END AS p
                     FROM rates, range(0, 400) t(k) WHERE k <= ceil(rate + 12 * sqrt(rate) + 20)),
             cdf AS (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM pmf),
             drawn AS (SELECT doc_id, text, source, n_chars, (CAST('0x' || substr(md5('5|' || doc_id), 1, 12) AS BIGINT) + 0.5) / 281474976710656.0 AS u FROM documents),
             counted AS (SELECT d.doc_id, d.text, d.source, d.n_chars, count(*) AS copies FROM drawn d JOIN cdf ON cdf.source IS NOT DISTINCT FROM d.source AND d.u >= cdf.c
                         GROUP BY ALL),
             spread AS (SELECT doc_id, text, source, n_chars, CAST(unnest(range(0, copies)) AS INTEGER) AS copy FROM counted)
        SELECT *, CAST('0x' || substr(md5('5|' || doc_id || '|' || copy), 1, 15) AS BIGINT) AS mix_key FROM spread
    """,
    "op10_exact_dedup": r"""
        WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS points, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256
                   FROM documents),
             g AS (SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id) AS keep_id,
                          count(*) OVER (PARTITION BY text_sha256) AS group_size FROM n)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
    """,
}
