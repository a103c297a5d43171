import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from sitefold.llm import bpe, lengths


@pytest.fixture(scope="module")
def own():
    return bpe.Codec(bpe.default_path())


@pytest.fixture(scope="module")
def theirs():
    with open(bpe.default_path(), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def same(own, theirs, texts):
    got = own.encode_batch(texts)
    for t, g in zip(texts, got):
        assert g == np.array(theirs.encode_ordinary(t), "<u4").tobytes(), repr(t[:60])
        assert own.decode(g) == own.decode(g, own.offsets(g)) == t.encode()
        assert (np.diff(own.offsets(g)) > 0).all() and own.offsets(g)[-1] == len(t.encode())


ALPHABET = list("'''  strevmldxS12!?.\n\t\r é漢") + ["\U0001f600", "\u0085", "\x1c", " ", "​", "́", "\x00", "²", "　"]


@pytest.mark.parametrize("seed", range(4))
def test_random_texts(own, theirs, seed):
    rng = random.Random(seed)
    same(own, theirs, ["".join(rng.choices(ALPHABET, k=rng.randint(0, 30))) for _ in range(5000)])


def test_every_codepoint_in_context(own, theirs):
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    same(own, theirs, ["".join(f"a{chr(c)}1{chr(c)} {chr(c)}" for c in points[k : k + 5000]) for k in range(0, len(points), 5000)])


@pytest.mark.parametrize("text", ["", "a" * 3000, "'" * 100, " " * 1000, "ab" * 400, "<|endoftext|>", "it's we'll they're I'd 'tis ''s 'S", "x\n\n\n y  \n"])
def test_edges(own, theirs, text):
    same(own, theirs, [text, text + "z", " " + text])


def test_texts_longer_than_a_chunk(own, theirs, monkeypatch):
    monkeypatch.setattr(bpe, "CHUNK", 50)
    rng = random.Random(9)
    texts = ["".join(rng.choices(ALPHABET, k=rng.randint(0, 400))) for _ in range(500)]
    same(own, theirs, texts)
    for t in texts:
        assert "".join(bpe.parts_of(t, 50)) == t


def test_a_full_cache_is_emptied(own, theirs, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 40)
    same(own, theirs, [" ".join(f"word{i}" for i in range(j, j + 30)) for j in range(0, 300, 30)])


def test_whole_words_and_heap_agree(own):
    rng = random.Random(1)
    words = list({bytes(rng.choices(b"abcdetn", k=rng.randint(2, 40))) for _ in range(400)})
    by = own.merge(words)
    assert all(own._merge_long(w) == by[w] for w in words if w not in own.ranks)


def test_scan_composes_functions():
    rng = np.random.default_rng(0)
    for n in (1, 63, 64, 65, 1000):
        cls = rng.integers(0, 11, n).astype(np.uint8)
        state, want = bpe.FRESH, []
        for c in cls:
            state = bpe.TABLE[c, state]
            want.append(state)
        assert bpe.scan(cls).tolist() == want


def test_rows(spark, docs_of, theirs):
    d = docs_of(["hello world", None, "", "hello world"], [1, 2, None, 1], n_tokens=["x"] * 4)
    got = sorted(bpe.encode(d).collect(), key=lambda r: (r.n_tokens, str(r.doc_id)))
    e = hashlib.sha256(b"").hexdigest()
    n = len(theirs.encode_ordinary("hello world"))
    assert [(r.doc_id, r.n_tokens) for r in got] == [(2, 0), (None, 0), (1, n), (1, n)]
    assert got[0].ids_sha256 == got[0].decoded_sha256 == e
    ids = np.array(theirs.encode_ordinary("hello world"), "<u4").tobytes()
    assert got[2].ids_sha256 == hashlib.sha256(ids).hexdigest() and got[2].decoded_sha256 == hashlib.sha256(b"hello world").hexdigest()


def test_offsets_and_ids(spark, docs_of, own):
    text = "héllo wörld " * 30
    r = bpe.encode(docs_of([text, None], [1, 2], offsets=["x", "y"]), ids=True, offsets=True).where("doc_id = 1").first()
    at = np.frombuffer(r.offsets, "<i8")
    assert len(at) == r.n_tokens + 1 and at[-1] == len(text.encode())
    tokens = [text.encode()[a:b] for a, b in zip(at[:-1], at[1:])]
    assert [own.vocabulary[k] for k in np.frombuffer(r.ids, "<u4")] == tokens


def test_another_pattern_is_refused(monkeypatch):
    monkeypatch.setattr(P, "PATTERN", r"\S+")
    with pytest.raises(ValueError, match="pattern"):
        bpe.default_path()


def test_classes_travel_as_data():
    assert (np.frombuffer(bpe.zlib.decompress(bpe.packed_classes()), np.uint8) == bpe.codepoint_classes()).all()


def test_histogram_of_null_long_and_clashing_rows(spark, docs_of, saved, theirs):
    texts = [None, "", "a b", "a b", "word " * 200_000]
    d = docs_of(texts, [1, None, 2, 2, 3], n_tokens=["x"] * 5, n_docs=["y"] * 5, limit=["z"] * 5)
    got = {r.limit: r.n_docs for r in lengths.op4_length_histogram(spark, saved(documents=d)).collect()}
    assert got == {0: 2, len(theirs.encode_ordinary("a b")): 2, len(theirs.encode_ordinary(texts[-1])): 1}


def test_limits_by_brute_force(spark):
    rng = random.Random(5)
    n = [rng.choice([0, 1, 2, 5, 700, 701, 5000]) for _ in range(300)]
    h = lengths.histogram(spark.createDataFrame([(x,) for x in n], "n_tokens long"))
    t = lengths.limits(h, block=3)
    rows = {r.limit: r for r in t.collect()}
    assert set(rows) == set(n)
    for k, r in rows.items():
        assert (r.n_docs, r.docs_over, r.docs_upto) == (n.count(k), sum(x > k for x in n), sum(x <= k for x in n))
        assert (r.tokens_upto, r.truncated_tokens, r.total_tokens) == (sum(x for x in n if x <= k), sum(min(x, k) for x in n), sum(n))
    for q in (0.01, 0.5, 0.9, 1.0):
        assert lengths.quantile(t, q) == sorted(n)[max(0, -(-int(q * 1000) * len(n) // 1000) - 1)]
    for k in (0, 1, 3, 600, 700, 9999):
        assert lengths.truncated_total(t, k) == sum(min(x, k) for x in n)
    long = lengths.limits(lengths.histogram(spark.createDataFrame([(7,), (9,), (9,)], "n_tokens long")))
    assert lengths.truncated_total(long, 4) == 12 and lengths.truncated_total(long.where("false"), 4) == 0


def test_histogram_query_counts_all_documents(spark, sf_dir, theirs):
    got = {r.limit: r.n_docs for r in lengths.op4_length_histogram(spark, sf_dir).collect()}
    want = {}
    for (t,) in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect():
        k = len(theirs.encode_ordinary(t or ""))
        want[k] = want.get(k, 0) + 1
    assert got == want
