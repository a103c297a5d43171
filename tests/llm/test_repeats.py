import hashlib
import random
import sys

import numpy as np
import pyarrow as pa
import pytest

from sitefold.llm import repeats


def brute(docs, least=50):
    """Covered bytes by every string of that length."""
    first = {}
    for d, t in docs:
        if d is not None:
            for p in range(len(t) - least + 1):
                s = t[p : p + least]
                first[s] = min(d, first.get(s, d))
    out = []
    for d, t in docs:
        c = np.zeros(len(t), bool)
        if d is not None:
            for p in range(len(t) - least + 1):
                if first[t[p : p + least]] < d:
                    c[p : p + least] = True
        out.append(c)
    return out


@pytest.mark.parametrize("seed", range(150))
def test_maximal_repeats_cover_what_strings_cover(seed):
    rng = random.Random(seed)
    least = rng.choice([1, 2, 3, 5, 8, 9, 16, 20])
    letters = rng.choice([b"ab", b"a", b"abc\0", bytes(range(256))])
    docs = [(rng.randint(0, 6), bytes(rng.choices(letters, k=rng.randint(0, 60)))) for _ in range(rng.randint(1, 8))]
    if seed % 2:
        docs = [(d, t + docs[0][1][:30]) for d, t in docs]
    got = repeats.repeat_spans([t for _, t in docs], np.array([d for d, _ in docs]), least)
    for k, ((_, t), want) in enumerate(zip(docs, brute(docs, least))):
        c = np.zeros(len(t), bool)
        for o, a, b in zip(*got) if got is not None else ():
            if o == k:
                c[a:b] = True
        assert (c == want).all()


def test_maximal_repeats_list_all_occurrences():
    sa = repeats.SuffixArray([b"xabcabcy", b"zabcq"], 3)
    found = {sa.data[sa.pos[a] : sa.pos[a] + n]: sorted(sa.pos[a:b].tolist()) for n, a, b in sa.maximal_repeats()}
    assert found == {b"abc": [1, 4, 9]}
    sa = repeats.SuffixArray([b"mississippi"], 1)
    found = {sa.data[sa.pos[a] : sa.pos[a] + n]: b - a for n, a, b in sa.maximal_repeats()}
    assert found == {b"i": 4, b"p": 2, b"s": 4, b"issi": 2}


def test_equal_windows_have_equal_minimisers():
    rng = random.Random(1)
    passage = bytes(rng.choices(b"abcdefgh ", k=80))
    runs = []
    for _ in range(2):
        data = bytes(rng.choices(b"abcdefgh ", k=70)) + passage + bytes(rng.choices(b"xyz", k=60))
        m, start, size, _ = repeats.window_runs(data)
        assert size.sum() == len(data) - 49
        runs.append(np.repeat(m, size)[70 : 70 + 31])
    assert (runs[0] == runs[1]).all()
    m, start, size, _ = repeats.window_runs(b"a" * 500)
    assert size.sum() == 451 and size.max() <= repeats.RUN


def texts(seed):
    rng = random.Random(seed)
    say = lambda k: "".join(rng.choices(["the ", "and ", "of ", "re", "ti", "é", "ou ", "漢"], k=k))
    passages = [say(30) for _ in range(4)] + ["same words again " * 8, "z" * 200]
    out = []
    for _ in range(60):
        out.append(say(rng.randint(0, 60)) + rng.choice(passages) + say(rng.randint(0, 60)) + rng.choice(["", *passages]))
    phrase = "a phrase of forty-one bytes that many share"
    out += [say(10) + phrase + say(10) for _ in range(30)]
    return out + [out[0]] * 10 + [None, "", "short", "x" * 49, "x" * 50, "x" * 50]


def rows_of(df):
    return sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect() if r.doc_id is not None)


def expected(ids, ts):
    docs = [(i, (t or "").encode()) for i, t in zip(ids, ts)]
    out = []
    for (i, t), c in zip(docs, brute(docs)):
        kept = bytes(np.frombuffer(t, np.uint8)[~c]) if t else b""
        out.append((i, len(t), int(c.sum()), int((np.diff(np.concatenate(([0], c.astype(int)))) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(x for x in out if x[0] is not None)


SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


@pytest.mark.parametrize("seed,heavy,entries", [(1, 20_000, 1 << 17), (2, 2, 50), (3, 0, 50)])
def test_whole_operator(spark, docs_of, seed, heavy, entries):
    ts = texts(seed)
    ids = random.Random(seed).sample(range(1000), len(ts))
    d = docs_of(ts, ids, partitions=6, known=["k"] * len(ts))
    got = repeats.with_spans(d.select("doc_id", "text"), repeats._digest, SCHEMA, entries, heavy)
    assert rows_of(got) == expected(ids, ts)


def test_small_flushes_and_parts(spark, docs_of, monkeypatch):
    from pyspark import cloudpickle

    for name, value in (("FLUSH", 400), ("FLUSH_BYTES", 4000), ("PART", 150), ("RUN", 5), ("PART_BYTES", 2000)):
        monkeypatch.setattr(repeats, name, value)
    cloudpickle.register_pickle_by_value(repeats)  # or workers would import the module as it is in its file
    try:
        ts = texts(5)
        d = docs_of(ts, partitions=4)
        assert rows_of(repeats.with_spans(d, repeats._digest, SCHEMA, 100, 3)) == expected(range(len(ts)), ts)
    finally:
        cloudpickle.unregister_pickle_by_value(repeats)


def test_repeated_rows_null_ids_and_columns(spark, docs_of):
    t = "some text that is longer than fifty bytes, and é at the end: éé"
    d = docs_of([t, t, t, t + "x", None], [4, 4, None, 9, 5], known=list("abcde"), spans=["s"] * 5)
    got = repeats.drop_repeats(d)
    assert got.columns == d.columns
    assert sorted(((r.doc_id, r.text, r.known) for r in got.collect()), key=repr) == sorted([(4, t, "a"), (4, t, "b"), (None, t, "c"), (9, "x", "d"), (5, None, "e")], key=repr)


def test_rows_of_one_id_with_different_texts(spark, docs_of):
    """Each loses what it shares with a smaller id, at its own places."""
    rng = random.Random(7)
    p, q = ("".join(rng.choices("abcdefgh", k=90)) for _ in range(2))
    ids = [1, 2, 2, 2, 2, 3, 1]
    ts = ["zzz " + p, p + "xxxxx", "Y" * 200 + "own", "other " + p + " and " + p, p + "xxxxx", p + "xxxxx" + q, q]
    got = repeats.with_spans(docs_of(ts, ids, partitions=4), repeats._digest, SCHEMA)
    assert rows_of(got) == expected(ids, ts)
    # the space in front of the passage is shared as well
    kept = sorted((r.doc_id, r.text) for r in repeats.drop_repeats(docs_of(ts, ids, tag=list("abcdefg"))).collect())
    assert kept == sorted([(1, ts[0]), (1, q), (2, "xxxxx"), (2, "xxxxx"), (2, ts[2]), (2, "other and"), (3, "")])


def test_a_range_may_end_inside_a_character(spark, docs_of):
    a, b = "q" * 49 + "é", "q" * 49 + "è"  # both start with the same 50 bytes
    got = {r.doc_id: r.text for r in repeats.drop_repeats(docs_of([a + "end", b + "end"])).collect()}
    assert got == {0: a + "end", 1: "end"}


def test_the_stage_drops_only_texts_that_lost_all(spark, docs_of):
    import corpus_pipeline

    line = " ".join(f"w{i}" for i in range(100))
    docs = docs_of([line, line, "", None], [1, 2, 3, 4], source=list("abcd"))
    got = corpus_pipeline.drop_repeated_strings(spark, docs, "")
    assert got.columns == docs.columns and sorted((r.doc_id, r.text) for r in got.collect()) == [(1, line), (3, ""), (4, None)]


def test_no_step_of_python_for_each_document_of_a_bucket():
    """Shared minimisers are answered, and given back by document, as whole columns."""
    n = 3000
    ids, ms = np.arange(n, dtype=np.int64), np.repeat(np.arange(n // 2, dtype=np.uint64), 2)
    asked = pa.RecordBatch.from_pylist([{"bucket": 0, "known": 0, "docs": ids.tobytes(), "ms": repeats._pack40(ms), "counts": np.ones(n, "<u2").tobytes()}])
    calls = 0

    def count(frame, event, _):
        nonlocal calls
        calls += event == "call" and frame.f_code.co_filename == repeats.__file__

    answer = repeats._answers_packed(repeats.HEAVY, 2)
    sys.setprofile(count)
    try:
        packed = list(answer(iter([asked])))
    finally:
        sys.setprofile(None)
    assert calls < 200  # 3,000 and more before
    rows = pa.concat_tables([pa.ipc.open_stream(d.as_buffer()).read_all() for b in packed for d in b.column("data")])
    assert rows.num_rows == n and {k: v.tolist() for k, v in repeats._minimisers(rows).items()} == {k: [k // 2] for k in range(n)}


def test_suffixes_that_always_follow_the_same_byte_are_not_sorted():
    rng = random.Random(3)
    passage = bytes(rng.choices(b"abcdefgh", k=100))
    sa = repeats.SuffixArray([b"x" + passage + b"1", b"y" + passage + b"2"], 50)
    assert len(sa.pos) == 2  # 102 before: of the repeat's own suffixes only the longest can't be extended to the left
    assert [(n, sorted(sa.pos[a:b].tolist())) for n, a, b in sa.maximal_repeats()] == [(100, [1, 103])]
