import random
import zlib
from collections import Counter

import numpy as np
import pytest

from sitefold.llm import ann, langid, toxicity


def test_language_ids_of_held_out_documents(spark):
    d = "/root/testdata/sf0.01"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    got = langid.op7_language_id(spark, d).collect()
    assert len(got) == len(docs)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1
    held = [r for r in got if r.held_out]
    assert np.mean([r.lang_pred == docs[r.doc_id].lang for r in held]) > 0.97


def grams_by_hand(text):
    """Counts of n-grams, as tuples; None is the mark between words."""
    c, s = Counter(), [None]
    for x in text.lower():
        if x.isalpha():
            s.append(x)
        elif s[-1] is not None:
            s.append(None)
    if s[-1] is not None:
        s.append(None)
    for n in (1, 2, 3):
        for i in range(len(s) - n + 1):
            g = tuple(s[i : i + n])
            if set(g) != {None} and not (n == 3 and g[1] is None):
                c[g] += 1
    return c


def number(gram):
    return sum((0x110000 if x is None else ord(x)) << 21 * (len(gram) - 1 - i) for i, x in enumerate(gram))


def profile_by_hand(counts, top):
    return [number(g) for g, _ in sorted(counts.items(), key=lambda x: (-x[1], number(x[0])))[:top]]


LANGUAGE_TEXTS = ["the cat sat", "Ça va? Ça va!", "a", "漢字 😀 x", "aa aa aa", "", "123", "x1y", "Straße İstanbul ΣΑΣ", " a  b\na-b "]


@pytest.mark.parametrize("text", LANGUAGE_TEXTS)
@pytest.mark.parametrize("top", [5, 400])
def test_profiles_by_hand(text, top):
    assert langid.ranked(*langid.count_grams(text), top).tolist() == profile_by_hand(grams_by_hand(text), top)


def test_word_beginnings_differ_from_letters():
    k, n = langid.count_grams("ab cab")
    found = dict(zip(k.tolist(), n.tolist()))
    assert found[number((None, "a"))] == 1 and found[number(("a",))] == 2 and found[number((None, "a", "b"))] == 1 and found[number(("a", "b"))] == 2


def judge_by_hand(profiles, text, top):
    own = profile_by_hand(grams_by_hand(text or ""), top)
    if not own or not profiles:
        return "und", 0.0
    best = min((sum(abs(p.index(g) - i) if g in p else top for i, g in enumerate(own)), lang) for lang, p in profiles.items())
    return best[1], 1 - best[0] / (top * len(own))


@pytest.mark.parametrize("top", [7, 60])
def test_distance_is_out_of_place(top):
    rng = random.Random(top)
    say = lambda letters, k: " ".join("".join(rng.choices(letters, k=rng.randint(1, 6))) for _ in range(k))
    profiles = {lang: profile_by_hand(grams_by_hand(say(letters, 200)), top) for lang, letters in (("c", "abcdé"), ("a", "cdefg"), ("b", "aeiouy"))}
    judge = langid.Judge({k: np.array(v, np.int64) for k, v in profiles.items()}, top)
    for text in [say(rng.choice(["abcdé", "cdefg", "aeiouy", "abcdefgiouyé", "xyz"]), rng.randint(0, 30)) for _ in range(60)] + LANGUAGE_TEXTS + [None]:
        lang, score = judge(text)
        want = judge_by_hand(profiles, text, top)
        assert lang == want[0] and abs(score - want[1]) < 1e-12
    assert langid.Judge({})("words") == ("und", 0.0)


def test_language_query_by_hand(spark, docs_of, saved):
    """The query against profiles and distances by definition, with repeats, nulls and clashing columns."""
    rng = random.Random(3)
    say = lambda letters, k: " ".join("".join(rng.choices(letters, k=rng.randint(1, 6))) for _ in range(k))
    texts, langs = [], []
    for k in range(90):
        lang = rng.choice(["xx", "yy", None])
        texts.append(rng.choice([None, "", "12 3"]) if k % 11 == 0 else say({"xx": "abcdef", "yy": "efghij", None: "acegi"}[lang], rng.randint(1, 40)))
        langs.append(lang)
    ids = [*range(90)]
    ids[5], ids[7], ids[8] = 4, None, 4
    d = docs_of(texts, ids, lang=langs, _id=["i"] * 90, gram=["g"] * 90, score=["s"] * 90)
    rows = langid.op7_language_id(spark, saved(documents=d)).collect()
    held = lambda i: zlib.crc32(str(i if i is not None else "").encode()) % 3 == 1
    counts = {}
    for i, t, lang in zip(ids, texts, langs):
        if lang is not None and i is not None and not held(i):
            counts.setdefault(lang, Counter()).update(grams_by_hand(t or ""))
    profiles = {lang: profile_by_hand(c, langid.TOP) for lang, c in counts.items()}
    want = [(i, held(i), *judge_by_hand(profiles, t, langid.TOP)) for i, t in zip(ids, texts)]
    key = lambda r: (str(r[0]), r[2], round(r[3], 9))
    for got, by_hand in zip(sorted(map(tuple, rows), key=key), sorted(want, key=key), strict=True):
        assert got[:3] == by_hand[:3] and abs(got[3] - by_hand[3]) < 1e-12


def test_long_texts_are_counted_whole(monkeypatch):
    rng = random.Random(4)
    text = " ".join("".join(rng.choices("abcdeé", k=rng.randint(1, 9))) for _ in range(400)) + " " + "x" * 300
    whole = langid.count_grams(text)
    monkeypatch.setattr(langid, "PART", 50)
    parts = langid.count_grams(text)
    assert len(text) > 1000 and all((x == y).all() for x, y in zip(whole, parts))


def test_language_edge_rows(spark, docs_of):
    rng = random.Random(0)
    words = {"xx": ["bao", "bei", "boo"], "yy": ["zik", "zuk", "zak"]}
    texts, langs = [], []
    for i in range(60):
        lang = "xx" if i % 2 else "yy"
        texts.append(" ".join(rng.choices(words[lang], k=8)))
        langs.append(lang if i % 5 else None)
    texts += [None, "", "123", "bao " * 200_000]
    langs += ["xx"] * 4
    d = docs_of(texts, lang=langs)
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(d, langid.fit(d)).collect()}
    assert all(got[i][0] == ("xx" if i % 2 else "yy") for i in range(60))
    assert got[60] == got[61] == got[62] == ("und", 0.0) and got[63][0] == "xx"


def brute_segments(values):
    """Maximal segments by their definition (Ruzzo and Tompa): best segment, then left and right of it."""
    if not any(v > 0 for v in values):
        return []
    best = max((sum(values[i:j]), -(j - i), -i, i, j) for i in range(len(values)) for j in range(i + 1, len(values) + 1))
    i, j = best[3], best[4]
    return brute_segments(values[:i]) + [(i, j, best[0])] + [(a + j, b + j, s) for a, b, s in brute_segments(values[j:])]


@pytest.mark.parametrize("seed", range(60))
def test_segments_by_definition(seed):
    rng = random.Random(seed)
    gap = 0.5
    values = [rng.choice([-gap, -gap, -gap, 0.75, 1.25, 2.0]) for _ in range(rng.randint(0, 30))]
    got = toxicity.maximal_segments([(i, v) for i, v in enumerate(values) if v > 0], gap)
    want = brute_segments(values)
    assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want] and np.allclose([s for *_, s in got], [s for *_, s in want])


def planted(seed, n=1500):
    rng = random.Random(seed)
    vocab = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in "lmnrs"]
    bad = ["vilest", "cretin", "lout", "knave", "rotten"]
    texts, labels = [], []
    for _ in range(n):
        toxic = rng.random() < 0.15
        w = rng.choices(vocab, k=rng.randint(10, 200))
        if toxic:
            for _ in range(rng.randint(2, 6)):
                w[rng.randrange(len(w))] = rng.choice(bad)
        texts.append(" ".join(w).capitalize() + ".")
        labels.append(int(toxic))
    return texts, labels


def test_toxic_documents_are_found_and_clean_ones_left(spark, docs_of):
    texts, labels = planted(3)
    d = docs_of(texts)
    model = toxicity.fit(d, spark.createDataFrame([(i, x) for i, x in enumerate(labels)], "doc_id long, toxic int"))
    assert {"vilest", "cretin", "lout", "knave", "rotten"} <= set(model.weights)
    got = {r.doc_id: r.tox_score for r in toxicity.score_documents(d, model).collect()}
    held = [i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 5 == 0]
    right = [(got[i] >= 0.5) == bool(labels[i]) for i in held]
    assert np.mean(right) > 0.97
    seg, n = model.segments("Fine words only. You vilest cretin! " + "bal " * 300 + "rotten lout")
    assert len(seg) == 2 and n == 308


def test_toxicity_edges(spark, docs_of):
    texts, labels = planted(4, 300)
    texts += [None, "", "...", "vilest " * 100_000]
    d = docs_of(texts, toxic=[0] * len(texts))
    lab = spark.createDataFrame([(i, x) for i, x in enumerate(labels)] + [(0, None), (None, 1), (999, 1)], "doc_id long, toxic int")
    model = toxicity.fit(d.select("doc_id", "text"), lab)
    rows = toxicity.score_documents(d, model, passages=True).collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == len(texts) and all(0 <= r.tox_score <= 1 for r in rows) and "toxic" in rows[0].asDict()
    assert got[300].tox_score == got[301].tox_score == got[302].tox_score < 0.5 and got[300].passages == []
    for only in (0, 1):
        one = toxicity.fit(d.select("doc_id", "text"), spark.createDataFrame([(i, only) for i in range(50)], "doc_id long, toxic int"))
        assert (one.score(one.evidence([], 0)) > 0.5) == bool(only)


def vectors(seed=0, n=3000, d=16):
    rng = np.random.default_rng(seed)
    return rng.standard_normal((20, d))[rng.integers(0, 20, n)] + 0.6 * rng.standard_normal((n, d))


def nearest(x, ids, q, k=10):
    d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
    d[q] = np.inf
    o = np.lexsort((ids, d))[:k]
    return ids[o].tolist(), d[o]


def test_recall_and_scores(spark):
    x = vectors()
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in sorted(ann.search(df, 50).collect(), key=lambda r: r["rank"]):
        got.setdefault(r.query_id, []).append(r)
    assert set(got) == set(range(0, 3000, 50))
    hits = 0
    for q, rows in got.items():
        want, _ = nearest(x, np.arange(3000), q)
        assert [r["rank"] for r in rows] == list(range(1, 11))
        assert np.allclose([r.score for r in rows], [np.sqrt(((x[r.vec_id] - x[q]) ** 2).sum()) for r in rows], rtol=1e-14)
        hits += len(set(want) & {r.vec_id for r in rows})
    assert hits / (10 * len(got)) >= 0.9


def test_all_cells_give_exact_results_whatever_the_blocks(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_ROWS", 50)
    monkeypatch.setattr(ann, "BLOCK_QUERIES", 2)
    x = vectors(1, 400, 5)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    for r in ann.search(df, 40, probe=1.0).collect():
        assert nearest(x, np.arange(400), r.query_id)[0][r["rank"] - 1] == r.vec_id


def test_recall_on_the_tables(spark):
    d = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    got = {}
    for r in ann.op2_multi_index(spark, d).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    queries = [k for k, i in enumerate(ids.tolist()) if i % 100 == 0]
    assert sorted(got) == sorted(ids[queries].tolist())
    assert np.mean([len(got[ids[k]] & set(nearest(x, ids, k)[0])) / 10 for k in queries]) >= 0.9


def test_codebooks_grow():
    assert [ann.codebook_size(n) for n in (10, 10**5, 10**6, 10**9)] == [64, 79, 250, 512]


def test_lambda_k_and_logistic_by_definition():
    for p, up, down in ((0.02, 2.0, 0.05), (0.3, 1.0, 1.0), (0.001, 3.5, 0.05)):
        lam = toxicity._root(p, up, down)
        if lam > 1e-6:
            assert abs(p * np.exp(lam * up) + (1 - p) * np.exp(-lam * down) - 1) < 1e-6
    rng = np.random.default_rng(0)
    x = rng.normal(size=300)
    y = (rng.random(300) < 1 / (1 + np.exp(-(0.5 + 1.5 * x)))).astype(int)
    a, b = toxicity._logistic(x, y)
    loss = lambda a, b: -(y * (a + b * x) - np.log1p(np.exp(a + b * x))).sum() + 0.05 * b * b + 5e-7 * a * a
    assert all(loss(a, b) <= loss(a + da, b + db) + 1e-9 for da in (-1e-3, 0, 1e-3) for db in (-1e-3, 0, 1e-3))


def test_scored_columns_of_any_name(spark, docs_of):
    texts, labels = planted(5, 200)
    d = docs_of([*texts, None, ""], tox_score=["s"] * 202, _id=["i"] * 202, toxic=[7] * 202)
    model = toxicity.fit(d, spark.createDataFrame([(i, x) for i, x in enumerate(labels)], "doc_id long, toxic int"))
    kept = toxicity.clean_documents(d, model)
    assert kept.columns == d.columns and {200, 201} <= {r.doc_id for r in kept.collect()}
    with pytest.raises(ValueError, match="tox_score"):
        toxicity.score_documents(d, model)


def test_cells_come_in_order_of_distance():
    x = vectors(2, 500, 6)
    index = ann.MultiIndex(x, 9)
    q = x[3]
    d = [((q[:3] - index.books[0]) ** 2).sum(axis=1), ((q[3:] - index.books[1]) ** 2).sum(axis=1)]
    seen = list(index.walk(q))
    assert len(seen) == len(set(seen)) == 81
    sums = [d[0][i] + d[1][j] for i, j in seen]
    assert np.allclose(sums, sorted(sums))


def test_vectors_that_take_no_part_ties_and_repeats(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (9, [2.0, 0.0]), (9, [3.0, 0.0]), (100, [0.0, 5.0]), (200, [0.0, 0.0]), (10, [])]
    df = spark.createDataFrame([(*r, "s") for r in rows], "vec_id long, embedding array<double>, score string")
    got = sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 6)) for r in ann.search(df).collect())
    assert got == [(0, 1, 1, 0.0), (0, 2, 2, 0.0), (0, 3, 9, 1.0), (0, 4, 100, 5.09902), (100, 1, 0, 5.09902), (100, 2, 1, 5.09902), (100, 3, 2, 5.09902), (100, 4, 9, 5.385165)]
