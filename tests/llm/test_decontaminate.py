import hashlib
import random
import re

import pytest

from sitefold.llm import decontaminate as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall((t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


def brute(docs, items, n=10):
    out = []
    for doc_id, text in docs:
        w = words(text)
        hit, found = set(), set()
        for item, t in items:
            b = words(t)
            if not b:
                continue
            size = min(n, len(b))
            for i in range(len(b) - size + 1):
                for s in range(len(w) - size + 1):
                    if w[s : s + size] == b[i : i + size]:
                        hit.update(range(s, s + size))
                        found.add(str(item))
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def case(seed):
    rng = random.Random(seed)
    vocab = ["a", "bb", "ccc", "É", "x1", "the", "漢字"]
    text = lambda k: "".join(rng.choice(vocab).upper() + rng.choice([" ", "-", "\n", "'", "  "]) for _ in range(k))
    items = [(i, text(rng.choice([0, 1, 3, 9, 10, 11, 25]))) for i in range(8)] + [(8, None), (9, "  ")]
    items.append((10, items[5][1]))
    docs = [(i, text(rng.randint(0, 60)) + (rng.choice(items)[1] or "") + text(5)) for i in range(25)] + [(90, None), (91, ""), (92, "é"), (3, "twice"), (None, items[6][1])]
    return docs, items


@pytest.mark.parametrize("seed,bound", [(1, 1 << 20), (2, 1 << 20), (3, 0), (4, 0)])
def test_against_brute_force(spark, seed, bound):
    docs, items = case(seed)
    d = spark.createDataFrame([(*x, "s") for x in docs], "doc_id long, text string, start string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = dc.summarise(d, b, broadcast_bytes=bound)
    assert "start" in got.columns
    rows = [(r.doc_id, r.n_words, r.n_hit, r.n_items, hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), r.n_hit > 0) for r in got.collect()]
    assert sorted(rows, key=repr) == brute(docs, items)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("bound", [1 << 20, 0])
def test_clean_documents_stay_with_all_columns(spark, bound):
    docs, items = case(7)
    rows = [(i, t, k, "x", "y", "z", "w") for k, (i, t) in enumerate(docs)]
    d = spark.createDataFrame(rows, "doc_id long, text string, hit_id long, hit_h string, hit_g string, n_hit string, items string")
    kept = dc.clean_documents(d, spark.createDataFrame(items, "item_id long, text string"), broadcast_bytes=bound)
    assert kept.columns == d.columns
    want = [r for r in rows if not brute([r[:2]], items)[0][5]]
    assert sorted(map(tuple, kept.collect()), key=repr) == sorted(want, key=repr)


def test_clashing_columns(spark):
    docs, items = case(8)
    d = spark.createDataFrame([(*x, "s", 7, "h") for x in docs], "doc_id long, text string, hit_id string, hit_h int, h string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = dc.summarise(d, b)
    assert got.columns[:5] == d.columns
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items) for r in got.collect()), key=repr) == sorted((x[:4] for x in brute(docs, items)), key=repr)
    with pytest.raises(ValueError, match="n_hit"):
        dc.summarise(d.withColumnRenamed("hit_h", "N_Hit"), b)


def test_no_benchmark_and_no_documents(spark):
    d = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert [(r.n_words, r.n_hit) for r in dc.summarise(d, b.where("false")).collect()] == [(3, 0)]
    assert dc.clean_documents(d, b.where("false")).count() == 1 and dc.clean_documents(d.where("false"), b).count() == 0


def test_a_long_document(spark):
    item = " ".join(f"w{i}" for i in range(15))
    text = "the of and " * 30_000 + item + " the" * 1000
    d = spark.createDataFrame([(1, text)], "doc_id long, text string")
    r = dc.summarise(d, spark.createDataFrame([(5, item)], "item_id long, text string")).first()
    assert (r.n_words, r.n_hit, r.n_items) == (91_015, 15, 1)
