"""Suffix arrays and repeated-byte removal against brute force."""

import hashlib
import random

import numpy as np
import pytest

from tessera.llm import substrings
from tessera.llm.suffix_array import grouped, grouped_many
from tests.llm.cases import AWKWARD, LINE, SCHEMA, awkward, clashing, table


def plain_order(t):
    return sorted(range(len(t)), key=lambda i: t[i:])


def texts(n=300, seed=1):
    rng = random.Random(seed)
    out = [[0], [1, 0], [1] * 30 + [0], [1, 2] * 20 + [0], [3, 2, 1, 0]]
    for _ in range(n):
        k = rng.choice([1, 2, 3, 30])
        out.append([rng.randrange(1, k + 1) for _ in range(rng.randrange(1, 70))] + [0])
    return out


def test_both_forms_give_the_suffix_array():
    every = texts()
    lengths = np.array([len(t) for t in every])
    padded = np.full((len(every), lengths.max()), -1, np.int32)
    for r, t in enumerate(every):
        padded[r, : len(t)] = t
    found = grouped_many(padded, lengths)
    for r, t in enumerate(every):
        assert grouped(t) == plain_order(t) == found[r, : len(t)].tolist()


def plain(rows):
    """rows: (key, text) in order; what dedup must return for each."""
    seen, out = set(), []
    for _, t in rows:
        raw = (t or "").encode()
        gone = [False] * len(raw)
        for p in range(len(raw) - 99):
            if raw[p : p + 100] in seen:
                gone[p : p + 100] = [True] * 100
            seen.add(raw[p : p + 100])
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((len(raw), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(raw, gone, strict=True) if not g)).hexdigest()))
    return out


def passages(seed=2):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgé") for _ in range(rng.randrange(1, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    common, out = [prose(40) for _ in range(4)], []
    for i in range(60):
        parts = [prose(rng.randrange(30)), rng.choice(common)[rng.randrange(60) :], prose(rng.randrange(20))]
        out.append(" ".join(parts) if i % 7 else out[-1] if out else "")
    return [*out, *AWKWARD, "ab" * 400, "x" * 99, "x" * 100, "y" * 99, "y" * 99, (LINE * 30)[:2100], "z" * 150 + LINE + "z" * 150]


@pytest.mark.parametrize("hot", ["none", "many"])
@pytest.mark.parametrize("lockstep", [1500, 100])
def test_removal_matches_brute_force(spark, monkeypatch, hot, lockstep):
    monkeypatch.setattr(substrings, "LOCKSTEP", lockstep)
    if hot == "many":
        monkeypatch.setattr(substrings, "HOT_SEEN", 3)
    every = passages()
    docs = table(spark, every, start=-20).repartition(7)
    rows = {r.doc_id: r for r in substrings.dedup(docs).collect()}
    for i, want in enumerate(plain(enumerate(every))):
        r = rows[i - 20]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want, i
        assert hashlib.sha256(r.kept).hexdigest() == r.kept_sha256


def test_long_texts_are_cut_without_loss(monkeypatch):
    monkeypatch.setattr(substrings, "_CHUNK", 300)
    rng = np.random.default_rng(0)
    data = rng.integers(97, 101, 2500).astype(np.uint8)
    anchor, start, count = substrings.runs(data)
    assert start[0] == 0 and (start[1:] == start[:-1] + count[:-1]).all() and start[-1] + count[-1] == len(data) - 99


def test_removal_edge_cases(spark):
    docs = awkward(spark)
    out = substrings.dedup(clashing(docs)).collect()
    assert len(out) == docs.count() and sum(r.doc_id is None for r in out) == 1
    twice = table(spark, [LINE * 2]).unionByName(table(spark, [LINE * 2]))
    assert sorted(r.n_removed for r in substrings.dedup(twice).collect())[1] == len(LINE) * 2
    assert substrings.dedup(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("bits", [12, 1])
def test_missing_repeated_and_extreme_ids(spark, monkeypatch, bits):
    """Null ids come first and stay null; the smallest long is an id like others; repeated ids are told apart by their texts."""
    monkeypatch.setattr(substrings, "PART_BITS", bits)
    text = LINE * 2
    rows = [(-(1 << 63), text), (None, text), (None, "short"), (7, text), (7, text + "tail"), (None, text), (-(1 << 63), "other " * 30)]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA).repartition(3)
    out = substrings.dedup(docs).collect()
    assert sorted(str(r.doc_id) for r in out) == sorted(str(i) for i, _ in rows)
    whole = [r for r in out if r.n_bytes == len(text) and r.n_removed == 0]
    assert [r.doc_id for r in whole] == [None]  # the first of five copies
    assert sorted(r.n_removed for r in out if r.n_bytes == len(text)) == [0] + [len(text)] * 3
    assert [r.n_removed for r in out if r.n_bytes == len(text) + 4] == [len(text)]
