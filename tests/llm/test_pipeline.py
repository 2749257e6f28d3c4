"""The pipeline, mixing and packing against plain versions."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest

import corpus_pipeline
from tessera.llm import langid, mixing, packing, queries
from tests.llm.cases import AWKWARD, SCHEMA, awkward, clashing, table
from tests.llm.test_arrow_ops import WORDS, plain_classes


def plain_count(rate, doc_id, seed=5):
    u = (int(hashlib.md5(f"{seed}|{'null' if doc_id is None else doc_id}".encode()).hexdigest()[:12], 16) + 0.5) / (1 << 48)
    total, k = 0.0, 0
    while True:
        total += math.exp(k * math.log(rate) - rate - math.lgamma(k + 1))
        if u < total:
            return k
        k += 1


def plain_rates(rows, weights):
    size = Counter()
    for _, text, source in rows:
        size[source] += len(text or "") + 1
    total, named = sum(size.values()), sum(w for s, w in weights.items() if s in size)
    rest = sum(n for s, n in size.items() if s not in weights)
    return {s: (weights[s] if s in weights else max(0.0, 1 - named) * n / rest) * total / n for s, n in size.items()}


def test_mixing_matches_brute_force(spark):
    rng = random.Random(5)
    texts = ["t" * rng.randrange(400) for _ in range(900)]
    docs = table(spark, texts)
    weights = {"src0": 0.6, "src1": 0.1, "not there": 0.2}
    rate = plain_rates([(i, t, f"src{i % 3}") for i, t in enumerate(texts)], weights)
    want = {i: plain_count(rate[f"src{i % 3}"], i) for i in range(900)}
    rows = mixing.mix(docs, weights).collect()
    assert Counter(r.doc_id for r in rows) == {i: n for i, n in want.items() if n}
    assert all(sorted(r.copy for r in rows if r.doc_id == i) == list(range(want[i])) for i in range(20))
    keys = [r.mix_key for r in rows]
    assert keys == sorted(keys) and abs(np.corrcoef(range(len(rows)), [r.doc_id for r in rows])[0, 1]) < 0.1
    share = Counter()
    for r in rows:
        share[r.source] += len(texts[r.doc_id]) + 1
    assert abs(share["src0"] / (sum(len(t) + 1 for t in texts) * 0.6) - 1) < 0.1
    assert mixing.mixture(docs, weights).count() == len(rows)


@pytest.mark.parametrize("few", [20_000, 0])
def test_mixing_edge_cases(spark, monkeypatch, few):
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", few)
    docs = awkward(spark)
    out = mixing.mixture(clashing(docs))
    assert out.columns == clashing(docs).columns
    per = Counter(r.doc_id for r in mixing.mixture(docs).collect())
    assert per[100] % 2 == 0  # repeated rows share one count
    assert mixing.mix(docs).columns[-2:] == ["copy", "mix_key"] and mixing.mix(clashing(docs)).columns[-2:] == ["copy_", "mix_key_"]
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.mix(docs, {"src0": 1.0}).select("source").distinct().collect() == [("src0",)]
    tiny = spark.createDataFrame([(i, "x" * 9999, "en", "big", 1) for i in range(50)] + [(99, "", "en", "tiny", 0)], SCHEMA)
    n = Counter(r.source for r in mixing.mix(tiny, {"big": 0.99, "tiny": 0.01}).collect())
    assert abs(n["tiny"] - 5000) < 300


@pytest.mark.parametrize("rate", [250.0, 320.0, 5000.0])
def test_high_rates(spark, monkeypatch, rate):
    """The quantile without a table of probabilities is within one copy of the exact one."""
    docs = spark.createDataFrame([(i, "x" * 9, "en", "hot", 9) for i in range(40)] + [(99, "y" * 1_000_000, "en", "bulk", 1)], SCHEMA)
    size = {"hot": 400, "bulk": 1_000_001}
    share = rate * size["hot"] / sum(size.values())
    got = {r.doc_id: r.copies for r in mixing.copies(docs, {"hot": share, "bulk": 1 - share}).where("source = 'hot'").collect()}
    assert all(abs(n - plain_count(rate, i)) <= (rate > mixing.EXACT_RATE) for i, n in got.items())
    assert sum(got.values()) == pytest.approx(40 * rate, rel=0.05)


def sized(spark, path, counts):
    """Documents of equal size, so many of each source, as a stored table."""
    rows = [(s, "x" * 99) for s, n in counts.items() for _ in range(n)]
    docs = spark.createDataFrame([(i, t, "en", s, 99) for i, (s, t) in enumerate(rows)], SCHEMA)
    docs.write.parquet(f"{path}/documents.parquet")
    return docs


@pytest.mark.parametrize("stranger", [None, "elsewhere"])
def test_production_targets_keep_unlisted_sources(spark, tmp_path, stranger):
    docs = sized(spark, tmp_path, {f"src{i}": 100 for i in range(20)} | {stranger: 1000})
    for out in (queries.op5_poisson_mixing(spark, str(tmp_path)), corpus_pipeline.mix(spark, docs, str(tmp_path))):
        n = Counter(r.source for r in out.select("source").collect())
        assert len(n) == 21 and abs(n[stranger] - 750) < 120 and abs(sum(n.values()) - 3000) < 250  # a third of 4 thirds


def test_production_targets_fill_up_for_missing_sources(spark, tmp_path):
    sized(spark, tmp_path, {f"src{i}": 400 for i in range(5)})
    n = Counter(r.source for r in queries.op5_poisson_mixing(spark, str(tmp_path)).select("source").collect())
    assert len(n) == 5 and all(abs(k - 400) < 100 for k in n.values())


def plain_padding(lengths, k):
    distinct = sorted(set(lengths))
    best = math.inf
    for cuts in combinations(distinct[:-1], min(k, len(distinct)) - 1):
        bounds = [*cuts, distinct[-1]]
        best = min(best, sum(next(b for b in bounds if b >= n) - n for n in lengths))
    return best


def test_boundaries_are_optimal():
    rng = random.Random(2)
    for _ in range(60):
        lengths = [rng.randrange(1, 40) ** 2 for _ in range(rng.randrange(1, 16))]
        n = Counter(lengths)
        keys = sorted(n)
        for k in (1, 2, 3, 5):
            bounds = packing.boundaries(np.array(keys), np.array([n[x] for x in keys]), np.array([x * n[x] for x in keys]), k)
            assert len(bounds) == min(k, len(keys)) and bounds[-1] == keys[-1]
            assert sum(next(b for b in bounds if b >= x) - x for x in lengths) == plain_padding(lengths, k)


def check_packed(rows, budget):
    batches = defaultdict(list)
    for r in rows:
        assert r.padding == r.bucket_len - r.n_tokens >= 0
        batches[r.bucket, r.batch].append(r)
    for group in batches.values():
        per = max(1, budget // group[0].bucket_len)
        if group[0].bucket_len > budget:  # only documents that are too long themselves, alone and unpadded
            assert len(group) == 1 and group[0].padding == 0
            continue
        assert len({r.bucket_len for r in group}) == 1 and len(group) * group[0].bucket_len <= budget
        assert sorted(r.place for r in group) == list(range(len(group))) and len(group) <= per
    for bucket in {b for b, _ in batches}:
        own = sorted(n for b, n in batches if b == bucket)
        assert own == list(range(len(own)))
        per = max(1, budget // min(r.bucket_len for n in own for r in batches[bucket, n]))
        assert all(len(batches[bucket, n]) == per for n in own[:-1])


def test_packing(spark):
    rng = random.Random(7)
    texts = [" ".join(["w"] * rng.choice([rng.randrange(30), rng.randrange(900)])) for _ in range(500)] + AWKWARD
    rows = packing.pack(table(spark, texts), 4, 2048).collect()
    assert len(rows) == len(texts)
    want = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) + 1 for i, t in enumerate(texts)}
    assert all(r.n_tokens == want[r.doc_id] for r in rows)
    check_packed(rows, 2048)
    n = Counter(x for x in want.values() if x <= 2048)
    keys = sorted(n)
    bounds = packing.boundaries(np.array(keys), np.array([n[x] for x in keys]), np.array([x * n[x] for x in keys]), 4)
    assert sorted({r.bucket_len for r in rows if r.bucket_len <= 2048}) == bounds


def test_documents_over_the_budget_are_batches_of_their_own(spark):
    lengths = [70_002, 71_000, 72_102, 30_001, 16_384, 16_385, 10_000, 3, 1]
    rows = packing.pack(table(spark, ["w " * (n - 1) for n in lengths])).collect()
    check_packed(rows, packing.BUDGET)
    assert {r.n_tokens for r in rows if r.bucket_len > packing.BUDGET} == {n for n in lengths if n > packing.BUDGET}
    assert sum(r.padding for r in rows) == 0


def test_copies_of_a_document_come_apart(spark):
    docs = table(spark, [f"{'w ' * (i % 9)}{i}" for i in range(300)])
    rows = packing.pack(docs.unionByName(docs).unionByName(docs).repartition(5), 4, 200).collect()
    check_packed(rows, 200)
    together = Counter((r.bucket, r.batch, r.doc_id) for r in rows)
    assert sum(n == 3 for n in together.values()) < 10 and len(together) > 700


def test_packing_edge_cases(spark):
    docs = awkward(spark)
    rows = packing.pack(clashing(docs), budget=64).collect()
    assert len(rows) == docs.count()
    check_packed(rows, 64)
    assert packing.pack(docs.limit(0)).count() == 0


def test_pipeline_matches_brute_force(spark, tmp_path):
    rng, rows = random.Random(11), []
    for i in range(90):
        lang = ("en", "de", "fr")[i % 3]
        rows.append((i, " ".join(rng.choices(WORDS[lang], k=rng.randrange(30, 90))), lang, f"src{i % 4}", 0))
    for i in range(90, 130):
        words = rows[rng.randrange(90)][1].split()
        if i % 2:
            words[-1] = "other"
        rows.append((i, "  ".join(words), "en", "src0", 0))
    rows += [(130, None, None, None, None), (131, "12 34 !!", "en", "src1", 8), (132, "漢字仮名交じり文 " * 9, None, "src9", 3)]
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.write.parquet(str(tmp_path / "documents.parquet"))

    model = langid.train(docs, ~langid.held_out())
    known = [r for r in rows if not model.predict(r[1])[2]]
    by = defaultdict(list)
    for r in known:
        by[re.sub(r"[\x20\x09-\x0D]", "", r[1])].append(r)
    exact = sorted((min(g, key=lambda r: (-len(r[1]), r[0])) for g in by.values()), key=lambda r: r[0])
    near = [r for i, r in enumerate(exact) if plain_classes([x[1] for x in exact])[i] == i]
    rate = plain_rates([(r[0], r[1], r[3]) for r in near], corpus_pipeline.TARGETS)
    want = Counter({r[0]: plain_count(rate[r[3]], r[0]) for r in near})

    at, frame = {}, spark.read.parquet(str(tmp_path / "documents.parquet"))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, frame, str(tmp_path)).write.parquet(str(tmp_path / f"stage{k}"))
        frame = spark.read.parquet(str(tmp_path / f"stage{k}"))
        at[k] = frame.collect()
        assert k == 4 or frame.columns == docs.columns, name
    assert sorted(r.doc_id for r in at[0]) == [r[0] for r in known]
    assert sorted(r.doc_id for r in at[1]) == [r[0] for r in exact]
    assert sorted(r.doc_id for r in at[2]) == [r[0] for r in near]
    assert Counter(r.doc_id for r in at[3]) == +want
    check_packed(at[4], packing.BUDGET)
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, whole)) == sorted(map(tuple, at[4]))
