"""Quality rules, virtual slots and exact deduplication against plain versions."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tessera.llm import exact_dedup, quality, sharding
from tests.llm.cases import AWKWARD, LINE, SCHEMA, WORD, awkward, clashing, table


def plain_base(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    spots = defaultdict(list)
    for i in range(len(words) - 7):
        spots[tuple(words[i : i + 8])].append(i)
    covered = {j for at in spots.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered),
        "base_failed": len(words) < 20 or 100 * len(covered) > 30 * len(words),
    }


def test_base_features_match_brute_force(spark):
    texts = [*AWKWARD, "a b c d e f g h " * 2, "a b c d e f g h i " * 2 + "tail", "z " * 9, (LINE * 2 + "\n") * 3 + "end " * 40]
    got = {r.doc_id: r.asDict() for r in quality.score(table(spark, texts)).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        assert {k: got[i][k] for k in plain_base(text)} == plain_base(text), i


def plain_em(counted, n_rules):
    good, bad, share = [quality.START_GOOD] * n_rules, [quality.START_BAD] * n_rules, quality.START_SHARE
    bound = lambda x, b: max(b[0], min(b[1], x))
    for _ in range(quality.ITERATIONS):
        q = {}
        for v in counted:
            odds = math.log(share / (1 - share))
            for x, g, b in zip(v, good, bad, strict=True):
                odds += math.log(g / (1 - b)) if x == 1 else math.log((1 - g) / b) if x == -1 else 0
            q[v] = 1 / (1 + math.exp(-odds))

        def ratio(j, start, sign, weight):
            hit, spoke = (sum(n * weight(v) for v, n in counted.items() if keep(v[j])) for keep in (lambda x: x == sign, lambda x: x != 0))
            return (start * quality.PRIOR + hit) / (quality.PRIOR + spoke)

        good = [bound(ratio(j, quality.START_GOOD, 1, lambda v: q[v]), quality.BOUNDS_GOOD) for j in range(n_rules)]
        bad = [bound(ratio(j, quality.START_BAD, -1, lambda v: 1 - q[v]), quality.BOUNDS_BAD) for j in range(n_rules)]
        share = bound((quality.START_SHARE * quality.PRIOR + sum(n * q[v] for v, n in counted.items())) / (quality.PRIOR + sum(counted.values())), quality.BOUNDS_SHARE)
    return good, bad, share


def test_estimation_matches_brute_force(spark):
    counted = {(1, 1, 1): 60, (1, 1, -1): 10, (-1, -1, -1): 12, (-1, 0, -1): 6, (0, 0, 0): 3, (1, -1, 0): 4}
    frame = spark.createDataFrame([(list(v), float(n)) for v, n in counted.items()], "votes array<int>, n double")
    row = quality.estimate(frame, 3).first()
    good, bad, share = plain_em(counted, 3)
    assert row.good == pytest.approx(good) and row.bad == pytest.approx(bad) and row.share == pytest.approx(share)


def test_posterior_replaces_all_must_pass(spark):
    good = ["Clean line of the usual words in this text and so on, number %d. " % i * 5 for i in range(40)]
    one_vote_down = LINE + "no end of the line\nso it goes on and on with all the words\nand then to the last of it"
    junk = [f"### $$$ %%% AB{i} &&& *** CD{i} " * 30 for i in range(6)]
    out = {r.doc_id: r for r in quality.score(table(spark, [*good, one_vote_down, *junk])).collect()}
    assert not any(out[i].kept for i in range(41, 47)) and out[40].kept
    spread = [f"The {i} of all things is to be here and to go on with it, as was said by them in the year {i * 7}." for i in range(40)]
    assert all(r.kept for r in quality.score(table(spark, spread)).collect())


def test_quality_edge_cases(spark):
    docs = awkward(spark)
    assert quality.score(clashing(docs)).count() == docs.count()
    assert quality.score(docs.limit(0)).count() == 0
    kept = quality.filter_quality(docs)
    assert kept.columns == docs.columns
    pair = quality.filter_quality(table(spark, [LINE + "So it is said of the end. " * 1, None]))
    assert [r.doc_id for r in pair.collect()] == [0]


def test_slots_match_brute_force_and_are_near_equal(spark):
    texts = [("é" if i % 5 else "long text ") * (i % 97 + 1) for i in range(3000)] + [None, "", "same"] + ["same"] * 1000
    docs = table(spark, texts)
    placed, path = sharding.shard(docs, 8, 512)
    rows = placed.collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(texts)))
    load, slots, virtual = Counter(), defaultdict(list), defaultdict(set)
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
        load[r.shard] += r.size
        slots[r.shard].append(r.slot)
        virtual[r.virtual_slot].add(r.shard)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and all(len(v) == 1 for v in virtual.values())
    assert max(load.values()) - min(load.values()) <= 0.01 * sum(load.values()) / 8
    sizes, want, out = Counter(), [0] * 8, {}
    for r in rows:
        sizes[r.virtual_slot] += r.size
    for size, v in sorted(((n, v) for v, n in sizes.items()), reverse=True):
        out[v] = want.index(min(want))
        want[out[v]] += size
    assert {v: next(iter(s)) for v, s in virtual.items()} == out
    sharding.add_shard(spark, path, 1, 9)
    old = {r.virtual_slot: r for r in sharding.read_map(spark, path, 1).collect()}
    new = {r.virtual_slot: r for r in sharding.read_map(spark, path, 2).collect()}
    assert old.keys() == new.keys() and all(new[v].shard in (8, old[v].shard) for v in old)
    grown = Counter()
    for r in new.values():
        grown[r.shard] += r.bytes
    assert max(grown.values()) - min(grown.values()) <= 0.1 * sum(grown.values()) / 9


def test_slots_edge_cases(spark):
    docs = awkward(spark)
    placed, _ = sharding.shard(clashing(docs), 3)
    assert placed.count() == docs.count()
    by = defaultdict(list)
    for r in placed.collect():
        by[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert sharding.shard(docs.limit(0), 8)[0].count() == 0


def plain_groups(rows):
    by = defaultdict(list)
    for i, t in rows:
        by[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i if i is not None else 0, i))
    return {norm: (min(v)[3], len(v)) for norm, v in by.items()}


@pytest.mark.parametrize("salt_rows", [2000, 3])
def test_exact_dedup_matches_brute_force(spark, monkeypatch, salt_rows):
    monkeypatch.setattr(exact_dedup, "SALT_ROWS", salt_rows)
    texts = [*AWKWARD, *["copy of the\ttext", "copy  of the text", " copyofthetext"] * 7, "one more"]
    docs = table(spark, texts)
    want = plain_groups(enumerate(texts))
    rows = exact_dedup.groups(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        norm = re.sub(r"[\x20\x09-\x0D]", "", texts[r.doc_id] or "")
        assert (r.keep_id, r.group_size) == want[norm] and r.kept == (r.doc_id == r.keep_id)
        assert r.text_sha256 == hashlib.sha256(norm.encode()).hexdigest()
    stay = exact_dedup.deduplicate(docs)
    assert stay.columns == docs.columns and sorted(r.doc_id for r in stay.collect()) == sorted(k for k, _ in want.values())


def test_full_bytes_are_checked_on_hits(spark):
    """A digest that takes many texts for equal must not join them."""
    texts = ["aa", "bb", "cc", "a a", "ddd", "dd d", "eee", None, ""]
    rows = exact_dedup.groups(table(spark, texts), digest=lambda norm: F.char_length(norm).cast("string")).collect()
    want = plain_groups(enumerate(texts))
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.keep_id, r.group_size) == want[(texts[r.doc_id] or "").replace(" ", "")], r


def test_state_goes_on_over_batches_and_restarts(spark, tmp_path):
    """Documents that come later meet the state of earlier ones, in micro-batches of single files."""
    texts = [*AWKWARD, *["copy of the\ttext", "copy  of the text"] * 5, "one more", None]
    home, want = str(tmp_path / "home"), plain_groups(enumerate(texts))
    for lo, hi in ((0, 9), (9, 9), (9, 20), (20, len(texts))):
        state = exact_dedup.absorb(table(spark, texts[lo:hi], lo).repartition(3), home, batch_bytes=1)
    got = {r.digest: (r.best.doc_id, r.arrived) for r in state.collect()}
    assert got == {hashlib.sha256(norm.encode()).hexdigest(): v for norm, v in want.items()}
    assert len([p for p in (tmp_path / "home" / "batches").iterdir() if p.name.isdigit()]) > 3


@pytest.mark.parametrize("salt_rows", [2000, 2])
def test_one_row_of_a_group_is_kept(spark, monkeypatch, salt_rows):
    """Rows repeated with one id and text, ids repeated with other texts, and null ids."""
    monkeypatch.setattr(exact_dedup, "SALT_ROWS", salt_rows)
    rows = [(5, "a b"), (5, "a b"), (5, "ab"), (6, "a  b"), (6, "a  b"), (None, "n n"), (None, "n n"), (7, "x"), (7, "y"), (7, "x"), (8, "y "), (None, "z"), (9, "z")]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA).repartition(4)
    out = exact_dedup.groups(docs).collect()
    assert len(out) == len(rows)
    by = defaultdict(list)
    for r in out:
        by[r.text_sha256].append(r)
    assert all(sum(r.kept for r in g) == 1 and {r.group_size for r in g} == {len(g)} for g in by.values())
    want = sorted([(6, "a  b"), (None, "n n"), (7, "x"), (8, "y "), (9, "z")], key=str)
    assert sorted(((r.doc_id, r.keep_id) for r in out if r.kept), key=str) == sorted(((i, i) for i, _ in want), key=str)
    assert sorted(((r.doc_id, r.text) for r in exact_dedup.deduplicate(docs).collect()), key=str) == want


def test_exact_dedup_edge_cases(spark):
    docs = awkward(spark)
    assert exact_dedup.groups(clashing(docs)).count() == docs.count()
    stay = exact_dedup.deduplicate(clashing(docs))
    assert stay.columns == clashing(docs).columns
    ids = Counter(r.doc_id for r in stay.collect())
    assert ids[100] == 1 and ids[101] == 0 and ids[None] == 1 and ids[3] + ids[0] + ids[1] + ids[2] == 1
    assert exact_dedup.groups(spark.createDataFrame([], SCHEMA)).count() == 0 and exact_dedup.deduplicate(spark.createDataFrame([], SCHEMA)).count() == 0
