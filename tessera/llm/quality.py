"""Quality rules as weak supervision (DataFrame functions only).

Each rule looks at one feature of a text and votes good (+1), bad (-1) or abstains (0). Expectation
maximisation over the counts of vote patterns estimates each rule's accuracies (on good and on bad documents) and
the share of good documents, and the posterior probability of "good" decides, in place of "all rules must pass". With an
accuracy for each class, a rule that votes good on nearly everything is no evidence when it does so again.

The counts are over all rows. They are gathered in one row, which has at most 3 ** (number of rules)
entries whatever the size of the corpus; the estimation itself is one SQL expression over that row, and
its result (two numbers for each rule and one more) is written into the scoring expression as literals.

Defined results: a null or empty text has no words, so it fails the base rule; repeated rows are
scored alike; an empty table gives an empty result; columns besides doc_id and text are ignored, and
``filter_quality`` hands them on, whatever they are called.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, cut, text_of

#: Frequent function words of English, German, French and Spanish.
FUNCTION_WORDS = (
    "the of and to in is that it for on with as was be by this are or from at "
    "der die das und in zu den mit von ist nicht ein eine sich auf im dem des "
    "le la les de des et en un une que qui dans pour par sur pas du est au "
    "el la los las de y en un una que se por con para del no al es su lo"
).split()
WINDOW = 8
ITERATIONS = 40
#: Where estimation starts: accuracy on good and on bad documents, share of good ones. The accuracies' priors have the
#: same means and so many counts; the bounds keep single votes from being proof.
START_GOOD, START_BAD, START_SHARE, PRIOR = 0.95, 0.3, 0.75, 20.0
BOUNDS_GOOD, BOUNDS_BAD, BOUNDS_SHARE = (0.6, 0.999), (0.05, 0.95), (0.05, 0.98)


@dataclass(frozen=True)
class Rule:
    """Good and bad are SQL conditions on the features; neither: abstain."""

    name: str
    good: str
    bad: str


RULES = (
    Rule("length", "n_words >= 20", "n_words < 10"),
    Rule("word_length", "word_chars between 2 * n_words and 10 * n_words", "word_chars < 1.5 * n_words or word_chars > 14 * n_words"),
    Rule("symbols", "20 * n_symbols <= n_words", "5 * n_symbols > n_words"),
    Rule("duplicate_lines", "10 * n_dup_lines <= n_lines", "10 * n_dup_lines > 3 * n_lines"),
    Rule("repetition", "10 * n_repeat_words <= n_words", "10 * n_repeat_words > 3 * n_words"),
    Rule("capitals", "4 * n_capitals <= word_chars", "2 * n_capitals > word_chars"),
    Rule("line_ends", "2 * n_ended_lines >= n_lines", "10 * n_ended_lines < n_lines and n_lines >= 3"),
    Rule("prose", "10 * n_function_words >= n_words", "100 * n_function_words < 3 * n_words and n_words >= 20"),
)


def features(docs: DataFrame) -> DataFrame:
    """doc_id and the counts that the rules look at, over whole texts. Each step is a projection of its own,
    so that no array is computed again inside a lambda function."""
    a = docs.select("doc_id", text_of().alias("text"))
    a = a.select(
        "doc_id",
        F.filter(F.split("text", f"[{SPACE_CLASS}]+"), lambda w: w != "").alias("words"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(f"[^{SPACE_CLASS}]")).alias("lines"),
        F.char_length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.char_length(F.regexp_replace("text", r"[^A-ZÀ-Þ]+", "")).cast("long").alias("n_capitals"),
    )
    function_words = [*dict.fromkeys(FUNCTION_WORDS)]
    a = a.select(
        "doc_id", "n_symbols", "n_capitals",
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("lines", lambda x: F.rtrim(x).rlike(r"[.!?\"'…»”]$"))).cast("long").alias("n_ended_lines"),
        F.size(F.filter("words", lambda w: w.isin(function_words))).cast("long").alias("n_function_words"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
    )
    run = "xxhash64(" + ", ".join(f"hashes[i + {k}]" for k in range(WINDOW)) + ")"
    a = a.withColumn("runs", F.expr(f"if(size(hashes) > {WINDOW}, transform(sequence(0, size(hashes) - {WINDOW}), i -> {run}), cast(array() as array<bigint>))")).drop("hashes")
    # Only texts that do repeat a run have their runs sorted, with their places.
    a = a.withColumn("placed", F.expr("if(size(runs) > size(array_distinct(runs)), sort_array(transform(runs, (h, i) -> struct(h, i))), cast(array() as array<struct<h:bigint,i:int>>))")).drop("runs")
    twice = "(k > 0 and placed[k - 1].h = x.h) or (k + 1 < size(placed) and placed[k + 1].h = x.h)"
    a = a.withColumn("at", F.expr(f"sort_array(filter(transform(placed, (x, k) -> if({twice}, x.i, -1)), p -> p >= 0))")).drop("placed")
    covered = f"aggregate(sequence(1, size(at)), 0L, (c, k) -> c + if(k < size(at), least({WINDOW}, at[k] - at[k - 1]), {WINDOW}))"
    return a.withColumn("n_repeat_words", F.expr(f"if(size(at) = 0, 0L, {covered})")).drop("at")


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def votes(rules: tuple[Rule, ...] = RULES) -> Column:
    return F.array(*(F.when(F.expr(r.good), 1).when(F.expr(r.bad), -1).otherwise(0).cast("int") for r in rules))


def patterns(voted: DataFrame) -> DataFrame:
    """How often each pattern of votes occurs."""
    return voted.groupBy("votes").agg(F.count(F.lit(1)).cast("double").alias("n"))


def estimate(counted: DataFrame, n_rules: int, iterations: int = ITERATIONS) -> DataFrame:
    """Accuracies of the rules on good and on bad documents, and the share of good ones, as one row
    (good array<double>, bad array<double>, share double).

    E-step: the posterior of each pattern; M-step: weighted counts with the priors above."""
    vote = "case p.votes[e.j] when 1 then ln(g / (1D - s.bad[e.j])) when -1 then ln((1D - g) / s.bad[e.j]) else 0D end"
    evidence = f"aggregate(s.good, struct(0D as sum, 0 as j), (e, g) -> struct(e.sum + {vote} as sum, e.j + 1 as j)).sum"
    posterior = f"transform(found, p -> 1D / (1D + exp(-(ln(s.share / (1D - s.share)) + {evidence}))))"
    total = lambda body: f"aggregate(sequence(0, size(found) - 1), 0D, (t, k) -> t + {body})"
    bound = lambda x, b: f"greatest({b[0]}D, least({b[1]}D, {x}))"
    ratio = lambda start, sign, weight: (
        f"({start * PRIOR}D + {total(f'found[k].n * {weight} * if(found[k].votes[j] = {sign}, 1, 0)')}) / ({PRIOR}D + {total(f'found[k].n * {weight} * abs(found[k].votes[j])')})"
    )
    good = f"transform(s.good, (x, j) -> {bound(ratio(START_GOOD, 1, 'q[k]'), BOUNDS_GOOD)})"
    bad = f"transform(s.bad, (x, j) -> {bound(ratio(START_BAD, -1, '(1D - q[k])'), BOUNDS_BAD)})"
    mean = f"({START_SHARE * PRIOR}D + {total('found[k].n * q[k]')}) / ({PRIOR}D + {total('found[k].n')})"
    step = f"transform(array({posterior}), q -> named_struct('good', {good}, 'bad', {bad}, 'share', {bound(mean, BOUNDS_SHARE)}))[0]"
    start = f"named_struct('good', array_repeat({START_GOOD}D, {n_rules}), 'bad', array_repeat({START_BAD}D, {n_rules}), 'share', {START_SHARE}D)"
    one = counted.agg(F.sort_array(F.collect_list(F.struct("votes", "n"))).alias("found"))
    fitted = F.expr(f"aggregate(sequence(1, {iterations}), {start}, (s, i) -> if(size(found) = 0, s, {step}))")
    return one.select(fitted.alias("m")).select("m.good", "m.bad", "m.share")


def posterior(good: list[float], bad: list[float], share: float) -> Column:
    """Probability that a document with the column ``votes`` is good."""
    odds = F.lit(math.log(share / (1 - share)))
    for j, (g, b) in enumerate(zip(good, bad, strict=True)):
        vote = F.col("votes")[j]
        odds = odds + F.when(vote == 1, math.log(g / (1 - b))).when(vote == -1, math.log((1 - g) / b)).otherwise(0.0)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))


def score(docs: DataFrame, rules: tuple[Rule, ...] = RULES, threshold: float = 0.5) -> DataFrame:
    """doc_id, features, votes, base_failed, quality (the posterior) and kept, a row for each row of ``docs``."""
    voted = cut(features(docs).withColumn("votes", votes(rules)), "votes")
    fitted = estimate(patterns(voted), len(rules)).first()  # one row: two numbers for each rule, and one more
    scored = voted.withColumn("quality", posterior(fitted["good"], fitted["bad"], fitted["share"])).withColumn("base_failed", base_failed())
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))


def filter_quality(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with its columns. Rows are matched by identifier and content."""
    key = F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.sha2(text_of(), 256))
    keyed = docs.withColumn("__key", key)
    as_docs = keyed.select(F.col("__key").alias("doc_id"), "text")
    good = score(as_docs).where("kept").select(F.col("doc_id").alias("__key")).distinct()
    return keyed.join(good, "__key", "left_semi").select(*docs.columns)
