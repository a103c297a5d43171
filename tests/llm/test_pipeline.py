"""Every stage on odd rows: nulls, empty and long texts, ties, repeated rows, no rows, columns of any name."""

import random

import corpus_pipeline
import pytest

CLASH = ["_id", "_h", "_t", "tox_score", "passages", "was_empty", "tag", "near_id", "near_h", "hit_id", "n_hit", "items", "node", "doc", "part", "known", "h"]


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(11)
    say = lambda k: " ".join(rng.choices([f"w{i}" for i in range(2000)], k=k))
    item = say(12)
    long, other = say(30_000), say(120)
    rows = [
        (1, other),
        (2, other),  # a copy
        (2, other),  # and its row again
        (3, other.replace(other.split()[60], "changed")),  # a near copy
        (4, None),
        (5, None),
        (6, ""),
        (7, ""),
        (8, " \n"),
        (None, say(50)),
        (9, say(40) + " " + item + " " + say(40)),  # a benchmark item
        (10, long),
        (11, say(80)),
        (11, say(90)),  # another text under the same id
        (12, say(60) + " " + " ".join(long.split()[100:200])),  # shares a passage with 10
    ]
    docs = spark.createDataFrame([(i, t, len(t) if t is not None else None, *["x"] * len(CLASH)) for i, t in rows], "doc_id long, text string, n_chars int, " + ", ".join(f"{c} string" for c in CLASH))
    bench = spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string")
    labels = spark.createDataFrame([(1, 0), (11, 1), (None, 1), (12, None)], "doc_id long, toxic int")
    return docs, {"benchmark": bench, "labels": labels}, {i: t for i, t in rows}


def keys(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)


def test_each_stage(spark, odd, saved):
    docs, tables, text = odd
    d = saved(**tables)
    rows = keys(docs)
    stage = dict(corpus_pipeline.STAGES)
    for name, f in corpus_pipeline.STAGES[:-1]:
        got = f(spark, docs, d)
        assert got.dtypes == docs.dtypes, name
        assert {r["tag"] for r in got.collect()} <= {"x"}
    # the near copy and the copies go with all their rows; of empty texts the first stays
    kept = keys(stage["simhash"](spark, docs, d))
    assert [r for r in rows if r not in kept] == sorted([(2, text[1]), (2, text[1]), (3, text[3]), (5, None), (6, ""), (7, ""), (8, " \n")], key=repr)
    kept = dict((i, t) for i, t in keys(stage["repeats"](spark, docs, d)))
    assert kept[1] == text[1] and kept[4] is None and kept[6] == "" and kept[10] == text[10] and 2 not in kept and None in kept
    assert kept[12].strip() and len(kept[12]) < len(text[12]) - 300
    kept = keys(stage["decontamination"](spark, docs, d))
    assert [r for r in rows if r not in kept] == [(9, text[9])]
    out = stage["tokens"](spark, docs, d).collect()
    assert len(out) == len(rows) and {r.n_tokens for r in out if r.doc_id in (4, 5, 6, 7)} == {0}


def test_no_rows(spark, odd, saved):
    docs, tables, _ = odd
    d = saved(**{k: v.where("false") for k, v in tables.items()})
    for name, f in corpus_pipeline.STAGES:
        assert f(spark, docs.where("false"), d).collect() == [], name
    # nothing to learn or to compare with: all documents stay
    for name in ("toxicity", "decontamination"):
        assert keys(dict(corpus_pipeline.STAGES)[name](spark, docs, d)) == keys(docs), name


def test_the_whole_run(spark, odd, saved):
    docs, tables, text = odd
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, saved(documents=docs, **tables)).collect()}
    assert set(got) == {None, 1, 4, 10, 11, 12} and got[4].n_tokens == 0
