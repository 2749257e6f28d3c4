"""Token files, language identification, toxicity and near-duplicate classes against plain versions."""

import math
import random
import re
import zlib
from collections import Counter
from itertools import accumulate

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import langid, minhash, tokens, toxicity
from tests.llm.cases import AWKWARD, SCHEMA, awkward, clashing, table

tokenizers_lib = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")


def path():
    return public.path("byte_bpe_50k.json")


TEXTS = [*AWKWARD, "a\x1cb \x1c\x1c c\x0b\x0c \x85\xa0 d", "I'll can't 12ab_c-d,,  e", "<|endoftext|> in the text <|endoftext|>", "it's   we'll  \n\n \t x", "  two  spaces  ", "12 3456 ½ ²", "​zero‍width", "a \n b  \n", "x \u200b y",
         *[f"a {c}'s 1{c}'s {c} {c}{c}" for c in "\u0558\u0c5c\u208f\ua7ce\U00011db0\U0001df64\u0300\u00b2\u180e\u2028\x1c\x85"], *[f"document {i} " * (i % 7) for i in range(200)]]


def test_token_files_match_the_library(spark):
    docs = table(spark, TEXTS).repartition(5)
    where = tokens.write_tokens(docs, path(), 2, block_bytes=2000)
    plain = tokenizers_lib.Tokenizer.from_file(path())
    want = [[*plain.encode(t or "", add_special_tokens=False).ids, 2] for t in TEXTS]
    rows = sorted(tokens.read_summary(spark, where).collect())
    starts = [0, *accumulate(map(len, want))]
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in rows] == [
        (i, starts[i], len(w), zlib.crc32(np.array(w, "<u4").tobytes())) for i, w in enumerate(want)
    ]
    some = {r.doc_id: r.ids for r in tokens.read_ids(spark, where, [3, 13, len(TEXTS) - 1, 10**6]).collect()}
    assert some == {i: want[i] for i in (3, 13, len(TEXTS) - 1)}
    assert {r.doc_id: r.ids for r in tokens.read_ids(spark, where).collect()} == dict(enumerate(want))
    head = spark.read.parquet(f"{where}/dictionary").first()
    assert head.width == 2 and {r[0] for r in spark.read.parquet(f"{where}/blocks").select("dict_hash").collect()} == {head.dict_hash}


def test_a_dictionary_helps_short_documents_and_is_checked(spark):
    import zstandard

    texts = [f"report {i} of the usual words in the usual order, as before, and so on to the end " * 2 for i in range(600)]
    where = tokens.write_tokens(table(spark, texts), path())
    head = spark.read.parquet(f"{where}/dictionary").first()
    assert len(head.dictionary) > 0
    own = sum(len(r.payload) for r in spark.read.parquet(f"{where}/blocks").select("payload").collect())
    encoder = tokens.Encoder.of(path(), 2)
    assert own < sum(len(zstandard.compress(encoder.serialised(t), tokens.LEVEL)) for t in texts)
    with pytest.raises(ValueError):
        list(tokens._frames([spark.read.parquet(f"{where}/blocks").limit(1).toArrow()], b"", "another"))


def test_chunks_are_encoded_as_the_library_does(monkeypatch):
    """Random texts of characters of all classes, the second time with a memory that overflows all the time."""
    plain, rng = tokenizers_lib.Tokenizer.from_file(path()), random.Random(7)
    for most in (tokens.MEMO, 3):
        monkeypatch.setattr(tokens, "MEMO", most)
        own = tokens.Encoder(path(), 2)
        for _ in range(1500):
            text = "".join(rng.choices("ab1 '  \n\t.é漢½\u00a0\u3000\u0558\u0c5c\U0001df64\u200b s!", k=rng.randrange(16)))
            assert np.frombuffer(own.serialised(text), own.dtype).tolist() == [*plain.encode(text, add_special_tokens=False).ids, 2], repr(text)


def test_new_chunks_go_to_the_library_together(monkeypatch):
    """Few calls for many new words; the same ids whatever texts and chunks share a call, or if all is forgotten again and again."""
    plain, rng = tokenizers_lib.Tokenizer.from_file(path()), random.Random(8)
    texts = [" ".join("".join(rng.choices("abcdefgé,.1'", k=9)) for _ in range(60)) for _ in range(40)]
    texts += ["".join(rng.choices("ab1 '  \n\t.é漢\u00a0\u180e\u200b s!", k=rng.randrange(16))) for _ in range(800)]
    want = [[*plain.encode(t, add_special_tokens=False).ids, 2] for t in texts]
    for most, group, joined in ((tokens.MEMO, tokens.GROUP, tokens.JOINED), (30, 7, 3)):
        for name, value in (("MEMO", most), ("GROUP", group), ("JOINED", joined)):
            monkeypatch.setattr(tokens, name, value)
        own = tokens.Encoder(path(), 2)
        assert [np.frombuffer(x, own.dtype).tolist() for x in own.each(texts)] == want
    monkeypatch.undo()

    class Counted:
        calls = 0

        def __getattr__(self, name):
            Counted.calls += 1
            return getattr(plain, name)

    own = tokens.Encoder(path(), 2)
    own.tokenizer = Counted()
    assert len(list(own.each(texts[:40]))) == 40 and Counted.calls < 60, Counted.calls


def test_bytes_without_a_token_do_not_shift_the_ids_of_others():
    own = tokens.Encoder(path(), 2)
    plain = tokenizers_lib.Tokenizer.from_file(path())
    own.bytes = own.bytes.copy()
    own.bytes[plain.encode(" b", add_special_tokens=False).ids[0]] = 0
    assert np.frombuffer(own.serialised("a b c"), own.dtype).tolist() == [*plain.encode("a b c", add_special_tokens=False).ids, 2]


def test_other_tokenizers_are_encoded_whole():
    other = tokens.Encoder(public.path("word_bpe_49k.json"), 2)
    plain = tokenizers_lib.Tokenizer.from_file(public.path("word_bpe_49k.json"))
    assert other.split is None
    for t in TEXTS[:20]:
        assert np.frombuffer(other.serialised(t), other.dtype).tolist() == [*plain.encode(t or "", add_special_tokens=False).ids, 2]


def test_token_edge_cases(spark):
    docs = awkward(spark)
    rows = tokens.read_summary(spark, tokens.write_tokens(clashing(docs), path())).collect()
    assert len(rows) == docs.count()
    rows.sort(key=lambda r: r.start)
    assert rows[0].doc_id is None and all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:], strict=False))
    assert tokens.read_summary(spark, tokens.write_tokens(spark.createDataFrame([], SCHEMA), path())).count() == 0


WORDS = {
    "en": "the of and with from this house water people little under which their would could".split(),
    "de": "der die und mit von dieses haus wasser leute kleine unter welche ihre würde könnte".split(),
    "fr": "le les et avec depuis cette maison eau gens petite sous laquelle leur serait pouvait".split(),
}


def languages(spark, n=240, seed=1):
    rng, rows = random.Random(seed), []
    for i in range(n):
        lang = ("en", "de", "fr")[i % 3]
        rows.append((i, " ".join(rng.choices(WORDS[lang], k=rng.randrange(8, 60))), lang, f"src{i % 4}", 0))
    return spark.createDataFrame(rows, SCHEMA)


def test_language_held_out_accuracy(spark):
    docs = languages(spark)
    model = langid.train(docs, ~langid.held_out())
    assert Counter(model.languages) == {"de": 4, "en": 4, "fr": 4}
    found = langid.predict(docs, model).join(docs.select("doc_id", "lang", langid.held_out().alias("out")), "doc_id").collect()
    out = [r for r in found if r.out]
    assert len(out) > 30 and all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in out)
    assert sum(r.lang == r.lang_pred for r in out) >= 0.98 * len(out) and not any(r.rejected for r in found)
    assert all(0 <= r.score <= 1 for r in found)
    far = table(spark, ["漢字仮名交じり文の例です" * 5, "12345 !!! ###", None, "the people under the water"])
    got = {r.doc_id: r for r in langid.predict(far, model).collect()}
    assert got[0].rejected and got[1].lang_pred == got[2].lang_pred == "und" and not got[3].rejected and got[3].lang_pred == "en"
    assert [r.doc_id for r in langid.keep_known(clashing(far), model).collect()] == [3]


def test_language_vectors_match_brute_force():
    def plain(text):
        text = " " + re.sub(r"\s+", " ", "".join(c if c.isalpha() else " " for c in text.lower())).strip() + " "
        return text

    a, b = "Größe, 12 und  mehr!", "größe und mehr"
    assert plain(a) == plain(b) and (langid.counts(a) == langid.counts(b)).all()
    assert langid.counts("abc").sum() == 5 + 4 + 3


def plain_grams(text):
    """n-grams of a text by hand: letters in lower case, one space for a run of others, and their places."""
    points = [ord(c) if c.isalpha() else 32 for c in text.lower()]
    joined = [32]
    for p in [*points, 32]:
        if p != 32 or joined[-1] != 32:
            joined.append(p)
    m, out = 1 << 32, Counter()
    for i, p in enumerate(joined):
        a = p * 2654435761 % m
        out[a >> 20] += 1
        if i + 1 < len(joined):
            b = a ^ (joined[i + 1] * 2246822519 + 374761393) % m
            out[(b * 3266489917 % m) >> 20] += 1
            if i + 2 < len(joined):
                c = (b * 3266489917 % m) ^ (joined[i + 2] * 668265263 % m)
                out[(c * 2654435761 % m) >> 20] += 1
    return out


def test_language_prediction_matches_brute_force(spark):
    docs = languages(spark)
    model = langid.train(docs, ~langid.held_out())
    texts = [r.text for r in docs.orderBy("doc_id").limit(25).collect()] + [t for t in AWKWARD if t and len(t) < 7000] + ["漢字仮名交じり文の例です" * 5, "Größe, 12 und mehr!"]
    got = {r.doc_id: r for r in langid.predict(table(spark, texts), model).collect()}
    for i, text in enumerate(texts):
        if not any(c.isalpha() for c in text):
            assert got[i].lang_pred == "und" and got[i].rejected and got[i].score == 0
            continue
        v = {k: (1 + math.log(n)) * float(model.idf[k]) for k, n in plain_grams(text).items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        near = [sum(x * float(c[k]) for k, x in v.items()) / norm for c in model.centroids]
        best = max(near)
        assert abs(got[i].score - min(1, max(0, best))) < 1e-4
        ties = [k for k, x in enumerate(near) if x > best - 1e-4]
        assert got[i].lang_pred in {model.languages[k] for k in ties}
        sized = [model.least[k][min(langid.SIZES - 1, int(math.log2(len(v))))] for k in ties]
        assert got[i].rejected in {best < x for x in sized} or min(abs(best - x) for x in sized) < 1e-4


def test_clusters_are_settled_and_the_sample_is_bounded(spark):
    docs = languages(spark)
    model = langid.train(docs, ~langid.held_out())
    again = langid.train(docs.unionByName(docs).unionByName(docs).repartition(7), ~langid.held_out())
    assert model.languages == again.languages and np.allclose(model.centroids, again.centroids, atol=1e-3)  # repeated rows count once
    x = langid._unit(np.random.default_rng(3).random((60, 8)).astype(np.float32))
    c = langid.cluster(x, 3)
    own = np.array([max(range(3), key=lambda j: float(v @ c[j])) for v in x])
    assert all(np.allclose(langid._unit(x[own == j].mean(axis=0)), c[j], atol=1e-2) for j in range(3))


def test_language_edge_cases(spark):
    docs, empty = awkward(spark), spark.createDataFrame([], SCHEMA)
    model = langid.train(docs, F.lit(True))
    assert langid.predict(clashing(docs), model).count() == docs.count()
    assert langid.predict(docs, langid.train(empty, F.lit(True))).select("lang_pred").distinct().collect()[0][0] == "und"
    kept = langid.keep_known(docs, model)
    assert kept.columns == docs.columns and langid.keep_known(empty, model).count() == 0 and langid.predict(empty, model).count() == 0


def toxic_table(spark, n=600, seed=3):
    rng, rows, labels = random.Random(seed), [], []
    for i in range(n):
        words = rng.choices([f"plain{j}" for j in range(300)], k=rng.randrange(5, 120))
        bad = i % 4 == 0
        for _ in range(rng.randrange(2, 9) if bad else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["idiot", "Moron!", "scum"]) if i % 8 else "vile" + rng.choice(["ra", "ta", "mo", "ne", "ku"]) + str(rng.randrange(9)))
        rows.append((i, " ".join(words), "en", "s", 0))
        labels.append((i, 1, int(bad)))
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_held_out(spark):
    docs, labels = toxic_table(spark)
    model = toxicity.train(docs, labels.where("doc_id < 400"))
    assert model.cuts[0] < model.cuts[1]
    rows = [r for r in toxicity.predict(docs, model).collect() if r.doc_id >= 400]
    assert sum(r.toxic == (r.doc_id % 4 == 0) for r in rows) >= 0.97 * len(rows)
    assert all(abs(r.severity - r.p_1 - r.p_2) < 1e-9 and r.p_1 >= r.p_2 for r in rows)


def test_ordinal_fit_maximises_the_likelihood():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 2, (400, 3)).astype(float)
    grade = np.clip((x @ np.array([2.0, 1.0, 0.0]) + rng.logistic(size=400) > np.array([[0.5], [2.5]])).sum(axis=0), 0, 2)

    def loss(w, cuts):
        above = 1 / (1 + np.exp(-((x @ w)[:, None] - cuts)))
        full = np.concatenate((np.ones((400, 1)), above, np.zeros((400, 1))), axis=1)
        at = np.arange(400)
        return -np.log(full[at, grade] - full[at, grade + 1]).mean() + toxicity.L2 / 2 * (w**2).sum()

    w, cuts = toxicity.fit_ordinal(x, grade)
    least = loss(w, cuts)
    for i in range(5):
        for step in (-0.1, 0.1):
            near = np.concatenate((w, cuts))
            near[i] += step
            assert loss(near[:3], near[3:]) > least


def test_toxicity_prediction_matches_brute_force(spark):
    docs, labels = toxic_table(spark)
    model = toxicity.train(docs, labels)
    weight = dict(zip(model.words.tolist(), model.weights.tolist(), strict=True))
    code = lambda w: int(minhash.word_hashes(np.frombuffer(w, np.uint8))[0] >> np.uint64(32))
    texts = [*(r.text for r in docs.orderBy("doc_id").limit(20).collect()), None, "", "IDIOT!! idiot-Idiot moron", "vilerat viletax " * 9]
    got = {r.doc_id: r for r in toxicity.predict(table(spark, texts), model).collect()}
    for i, text in enumerate(texts):
        words = re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").lower().encode())
        seen = Counter(code(w) for w in words)
        for n in toxicity.PREFIXES:  # beginnings of longer words have hashes of their own
            for w in words:
                if len(w) > n:
                    seen[int(minhash.word_hashes(np.frombuffer(w, np.uint8), toxicity.PREFIXES)[1 + [k for k in toxicity.PREFIXES if len(w) > k].index(n)] >> np.uint64(32))] += 1
        score = sum(weight[k] * (1 + math.log(n)) for k, n in seen.items() if k in weight)
        want = [1 / (1 + math.exp(-max(-40, min(40, score - c)))) for c in model.cuts]
        assert got[i].severity == pytest.approx(sum(want)) and got[i].toxic == (sum(want) >= 0.5)


def test_features_of_a_small_labelled_set():
    """The test adapts to the number of rows and features; noise is not selected."""
    rng = np.random.default_rng(5)
    noise1, noise0 = rng.binomial(40, 0.2, 3000), rng.binomial(60, 0.2, 3000)
    df1, df0 = np.concatenate((noise1, [20, 25])), np.concatenate((noise0, [0, 1]))
    gain = toxicity.surely_toxic(df1, df0, 40, 60)
    assert (gain[-2:] > 0).all() and (gain[:-2] > 0).sum() <= 1


def test_toxicity_edge_cases(spark):
    docs, labels = awkward(spark), spark.createDataFrame([(0, 1, None), (3, None, 1), (8, 0, 0), (8, 0, 1), (None, 1, 1), (777, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.train(clashing(docs), labels)
    assert toxicity.predict(clashing(docs), model).count() == docs.count()
    none = toxicity.train(docs, labels.limit(0))
    assert toxicity.predict(docs, none).agg(F.max("severity")).first()[0] == 0 and toxicity.predict(docs.limit(0), none).count() == 0


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_classes(texts):
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def copies(seed=4):
    rng, texts = random.Random(seed), []
    for _ in range(25):
        base = [rng.choice("abcdefghij") + str(rng.randrange(400)) for _ in range(rng.randrange(40, 260))]
        texts.append(" ".join(base))
        for _ in range(rng.randrange(6)):
            own = list(base)
            for _ in range(rng.randrange(9)):
                own[rng.randrange(len(own))] = "changed" + str(rng.randrange(999))
            texts.append("  ".join(own))
    return texts


def test_near_duplicates_match_brute_force(spark):
    texts = [*copies(), *AWKWARD]
    rows = {r.doc_id: r for r in minhash.classes(clashing(table(spark, texts))).collect()}
    want = plain_classes(texts)
    assert [rows[i].class_id for i in range(len(texts))] == want
    sizes = Counter(want)
    assert all(r.class_size == sizes[r.class_id] for r in rows.values())
    kept = minhash.keep_one(table(spark, texts))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want)) and kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_links_between_copies_of_a_weak_hub(spark):
    """A family whose members are like one original but not like each other, and a chain."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(60)]
    family = []
    for i in range(40):
        own = list(base)
        own[(i * 7) % 60] = f"x{i}"
        family.append(" ".join(own))
    family.insert(rng.randrange(40), " ".join(base))
    chain = [[f"c{i}" for i in range(100)]]
    for i in range(12):
        chain.append([*chain[-1][4:], *(f"d{i}{j}" for j in range(4))])
    texts = [*family, *(" ".join(c) for c in chain)]
    rows = {r.doc_id: r.class_id for r in minhash.classes(table(spark, texts)).collect()}
    assert [rows[i] for i in range(len(texts))] == plain_classes(texts)


@pytest.mark.parametrize("weights", [None, "random"])
def test_signature_agreement_is_the_weighted_jaccard_similarity(weights):
    rng = np.random.default_rng(1)
    agree, true = [], []
    for _ in range(60):
        pool = minhash.mix64(rng.integers(1, 1 << 60, 60).astype(np.uint64))
        x, y = (rng.random(60) * 3 * (rng.random(60) < 0.8) for _ in range(2))
        if weights is None:
            x, y = (x > 0).astype(float), (y > 0).astype(float)
        a, b = (minhash.darts(pool[v > 0], None if weights is None else v[v > 0]) for v in (x, y))
        agree.append((a == b).mean())
        true.append(np.minimum(x, y).sum() / np.maximum(x, y).sum())
    assert abs(np.mean(agree) - np.mean(true)) < 0.02 and np.corrcoef(agree, true)[0, 1] > 0.5


def test_count_weights(spark):
    texts = ["a b c d e f g h i j", "a b c d e f g h i j " * 6, "a b c d e f g h i j " * 6 + "k"]
    rows = {r.doc_id: r.class_id for r in minhash.classes(table(spark, texts), weighting="count").collect()}
    assert rows == {0: 0, 1: 1, 2: 1}


def test_near_duplicates_of_repeated_and_missing_ids(spark):
    """Of several texts under one id each is compared, whatever the order of the rows; rows without id are too."""
    base = {k: [f"{k}{i}" for i in range(80)] for k in "abc"}
    a, b, c = (" ".join(x) for x in base.values())
    a2, b2, c2 = (" ".join([*x[:-2], "other"]) for x in base.values())
    rows = [(5, a), (5, b), (6, a2), (7, b2), (None, c), (None, c2), (None, "alone " * 9), (None, " "), (8, ""), (8, "")]
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame([(i, t, None, None, None) for i, t in order], SCHEMA).coalesce(1)
        got = Counter((r.doc_id, r.class_id, r.class_size) for r in minhash.classes(docs).collect())
        assert got == Counter([(5, 5, 2), (5, 5, 2), (6, 5, 2), (7, 5, 2), (None, None, 2), (None, None, 2), (None, None, 1), (None, None, 1), (8, 8, 1), (8, 8, 1)])
        kept = Counter((r.doc_id, r.text) for r in minhash.keep_one(docs).collect())
        assert sum(kept.values()) == 7 and kept[5, a] == kept[5, b] == 1 and kept[8, ""] == 2 and kept[None, c] + kept[None, c2] == 1 and kept[None, "alone " * 9] == 1


def test_near_duplicate_edge_cases(spark):
    docs = awkward(spark)
    rows = minhash.classes(clashing(docs)).collect()
    assert len(rows) == docs.count() and [r.class_id for r in rows if r.doc_id is None] == [None]
    by = {r.doc_id: r.class_id for r in rows}
    assert by[8] == by[9] == 8 and by[0] == 0 and by[1] == 1 and by[100] == by[101] == 100
    assert sorted(r.doc_id for r in minhash.keep_one(clashing(docs)).collect() if r.doc_id is not None and r.doc_id >= 100) == [100]
    empty = spark.createDataFrame([], SCHEMA)
    assert minhash.classes(empty).count() == 0 and minhash.keep_one(empty).count() == 0
    assert minhash.keep_one(docs).where("doc_id is null").count() == 1
