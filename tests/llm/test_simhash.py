import random

import numpy as np
import pytest
import xxhash

from sitefold.llm import simhash


def brute_print(text, words=4):
    parts = [p for p in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\x0b", " ").replace("\x0c", " ").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if p]
    if not parts:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(parts[i : i + words]).encode(), 42) for i in range(max(1, len(parts) - words + 1))]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_classes(prints, radius=4):
    """Smallest id reachable, by flooding."""
    ids = [i for i, _ in prints]
    out, left = {}, set(range(len(prints)))
    while left:
        todo, group = [left.pop()], []
        while todo:
            k = todo.pop()
            group.append(k)
            near = {j for j in left if (prints[k][1] ^ prints[j][1]).bit_count() <= radius}
            left -= near
            todo += near
        known = [ids[k] for k in group if ids[k] is not None]
        out.update({k: min(known) if known else None for k in group})
    return [out[k] for k in range(len(prints))]


@pytest.mark.parametrize("text", [None, "", " \n\t", "One", "a b c", "a b c d", "A a A a a a a a a", "É é x y z w", "w " * 500, "  a b c d e"])
def test_fingerprints(text):
    assert simhash.fingerprint(text) == brute_print(text)


def test_a_long_text_in_pieces():
    text = " ".join(random.Random(0).choices(["a", "b", "cc", "dd"], k=70_000))
    assert simhash.fingerprint(text) == brute_print(text)


@pytest.mark.parametrize("last", range(32_766, 32_770))
def test_no_shingle_is_lost_between_pieces(last):
    """65,537 shingles, so that one of them decides bits."""
    text = " ".join(["a"] * (65_537 - last) + ["b"] * (last + 3))
    assert len(text.split()) == 65_540 and simhash.fingerprint(text) == brute_print(text)


def test_native_hash_is_the_same(spark):
    from pyspark.sql import functions as F

    got = spark.sql("SELECT 'one two thrée four' AS x").select(F.xxhash64("x")).first()[0]
    assert got % 2**64 == xxhash.xxh64_intdigest("one two thrée four".encode(), 42)


@pytest.mark.parametrize("radius", [0, 1, 4, 9])
def test_tiles_find_every_pair(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    x = np.concatenate([base, base ^ (np.uint64(1) << rng.integers(0, 64, 60, dtype=np.uint64)), base[:20] ^ rng.integers(0, 64, 20, dtype=np.uint64), [np.uint64(0), np.uint64(2**64 - 1)]])
    x = np.unique(x)
    a, b = simhash.compare(x[:70], x[50:], radius)
    got = set(zip(a.tolist(), b.tolist()))
    want = {(int(p), int(q)) for p in x[:70] for q in x[50:] if int(p ^ q).bit_count() <= radius}
    assert got == want


def test_forest_keeps_classes():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 50, 40), rng.integers(0, 50, 40)
    u, v = simhash.forest(a, b)
    links = lambda x, y: brute_classes_of(50, zip(x.tolist(), y.tolist()))
    assert links(a, b) == links(u, v) and len(set(u.tolist())) == len(u)


def brute_classes_of(n, links):
    low = list(range(n))
    links = list(links)
    for _ in range(n):
        for x, y in links:
            low[x] = low[y] = min(low[x], low[y])
    return low


@pytest.mark.parametrize("tile", [3, 8192])
def test_classes_by_brute_force(spark, docs_of, tile):
    rng = random.Random(tile)
    base = [" ".join(rng.choices([f"w{i}" for i in range(300)], k=rng.randint(0, 40))) for _ in range(25)]
    texts = base + [base[0]] * 12 + [None, "", "", "x"]
    texts += [t + " extra" for t in base[:5]] + [" ".join(rng.choices([f"v{i}" for i in range(99)], k=400))] * 2
    long = texts[-1].split()
    texts += [" ".join(long[:k] + ["changed"] + long[k + 1 :]) for k in range(0, 400, 40)]  # near copies
    ids = [*range(100, 100 + len(texts))]
    ids[3], ids[4], ids[-1] = ids[2], None, 1
    got = simhash.near_duplicates(docs_of(texts, ids, component_id=["c"] * len(texts)), tile=tile).collect()
    prints = [(i, brute_print(t)) for i, t in zip(ids, texts)]
    want = brute_classes(prints)
    assert sorted(((r.doc_id, r.fp % 2**64, r.component_id) for r in got), key=repr) == sorted(((i, f, c) for (i, f), c in zip(prints, want)), key=repr)


@pytest.mark.parametrize("at_once", [0, simhash.AT_ONCE])
def test_classes_of_links(spark, at_once):
    rng = random.Random(6)
    links = [(rng.randrange(40), rng.randrange(40)) for _ in range(25)] + [(50, k) for k in range(51, 70)]
    got = {r.node: r.root for r in simhash.classes(spark.createDataFrame(links, "u long, v long"), at_once=at_once).collect()}
    low = brute_classes_of(70, links)
    assert got == {k: low[k] for k in range(70) if low[k] != k}


def test_a_chain_is_one_class(spark):
    fps = [(i, (1 << (4 * i)) - 1 if i < 16 else -1) for i in range(17)]  # each four bits from the next
    df = spark.createDataFrame([(i, f if f < 2**63 else f - 2**64) for i, f in fps], "doc_id long, fp long")
    assert {r.component_id for r in simhash.components(df).collect()} == {0}


def test_unfinished_classes_are_an_error(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(64)], "u long, v long")
    with pytest.raises(RuntimeError, match="rounds"):
        simhash.classes(links, rounds=1, at_once=0)


def test_near_copies_go_and_others_stay(spark, docs_of):
    rng = random.Random(2)
    text = lambda k: " ".join(rng.choices([f"w{i}" for i in range(500)], k=k))
    a, b = text(300), text(300)
    w = a.split()
    w[150] = "changed"
    d = docs_of([a, b, a, " ".join(w), "", "", None, "short one", "short one"], [5, 6, 7, 8, 9, 10, 11, 12, 12], source=list("abcdefghi"))
    kept = simhash.drop_near_duplicates(d)
    assert kept.columns == d.columns and sorted(r.doc_id for r in kept.collect()) == [5, 6, 9, 12, 12]


@pytest.mark.parametrize("seed", range(4))
def test_tiles_hold_every_alike_pair(seed):
    """Of small and large sets, within a tile and between two."""
    rng = np.random.default_rng(seed)
    sets = []
    for size in [1, 2, 3, 4, 5, 6, 8, 9, 12, 20, 40, 90, 200] * 6:
        base = rng.integers(0, 2**63, size, dtype=np.uint64)
        sets.append(np.unique(base))
        for _ in range(4):
            keep = base[rng.random(size) > rng.choice([0.03, 0.08, 0.12])]
            sets.append(np.unique(np.concatenate((keep, rng.integers(0, 2**63, int(rng.integers(0, size // 12 + 2)), dtype=np.uint64)))))
    sets = [s for s in sets if len(s)]
    rows = np.array([[*simhash.wide_print(s), k, len(s)] for k, s in enumerate(sets)], np.int64)
    alike = {(i, j) for j in range(len(sets)) for i in range(j) if len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j]))}
    assert len(alike) > 40
    rng.shuffle(rows)
    half, by = len(sets) // 2, simhash._by_size

    def pairs(x, y):
        x, y = by(x), None if y is None else by(y)
        return {tuple(sorted((int(x[p, 8]), int((x if y is None else y)[q, 8])))) for i, j, _ in simhash.near_pairs(x, y, 0.8) for p, q in zip(i, j)}

    whole = pairs(rows, None)
    parts = pairs(rows[:half], None) | pairs(rows[half:], None) | pairs(rows[:half], rows[half:])
    assert whole == parts and len(alike - whole) <= 0.003 * len(alike)
    # of candidates the alike ones are linked, and no others
    of = lambda x: [sets[k] for k in x[:, 8]]
    for x, y in ((rows, None), (rows[:half], rows[half:])):
        links = list(simhash.verified_links(x, of(x), y, None if y is None else of(y), 0.8))
        want = {p for p in alike & (whole if y is None else pairs(x, y))}
        assert {tuple(sorted(p)) for p in links} <= want
        assert brute_classes_of(len(sets), links) == brute_classes_of(len(sets), want) and len(links) < len(sets)


def test_shingle_hashes_stand_for_shingles():
    memo = simhash._Hashes()
    text = "A b c d e f g a b c d e f g A B C D E"
    w = text.lower().split()
    assert len(simhash.shingle_hashes(text, 5, memo)) == len({tuple(w[i : i + 5]) for i in range(len(w) - 4)})
    assert len(simhash.shingle_hashes("a b", 5, memo)) == 1 and not len(simhash.shingle_hashes(" \t", 5, memo)) and not len(simhash.shingle_hashes(None, 5, memo))
    assert simhash.shingle_hashes("a b", 5, memo) != simhash.shingle_hashes("b a", 5, memo)


def test_long_texts_in_pieces(monkeypatch):
    text = " ".join(random.Random(3).choices(["one", "two", "thrée", "four\x0bfive", "  six"], k=3000))
    memo = simhash._Hashes()
    whole, s = simhash.fingerprint(text), simhash.shingle_hashes(text, 5, memo)
    monkeypatch.setattr(simhash, "PIECE", 100)
    assert simhash.fingerprint(text) == whole == brute_print(text) and (simhash.shingle_hashes(text, 5, memo) == s).all()


def test_near_copies_up_to_the_similarity_go(spark, docs_of):
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(3000)]
    texts, near = [], {}
    for g in range(40):
        base = rng.choices(vocab, k=250)
        texts.append(base)
        for changes in (1, 2, 3, 12):
            w = list(base)
            for k in rng.sample(range(len(w)), changes):
                w[k] = "changed"
            near[len(texts)] = g * 5
            texts.append(w)
    sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    jaccard = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    kept = {r.doc_id for r in simhash.drop_near_duplicates(docs_of([" ".join(t) for t in texts])).collect()}
    assert all(g * 5 in kept for g in range(40))
    alike = [k for k, g in near.items() if jaccard(k, g) >= 0.9]
    assert np.mean([k not in kept for k in alike]) > 0.9
    apart = [k for k, g in near.items() if max(jaccard(k, o) for o in range(g, g + 5) if o != k) < 0.8]
    assert apart and all(k in kept for k in apart)


def test_texts_of_one_fingerprint_that_are_not_like_the_first(spark, docs_of):
    line = "one two three four five"
    own = lambda k: " ".join(f"{k}{i}" for i in range(100))
    a, b = (" ".join([line] * 1000) + " " + own(k) for k in "ab")
    near = b.replace("b50 ", "changed ")
    assert simhash.fingerprint(a, 5) == simhash.fingerprint(b, 5) == simhash.fingerprint(near, 5)
    kept = simhash.drop_near_duplicates(docs_of([a, b, b, near, a], [1, 2, 3, 4, 5]))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2]


def jaccard_rest(texts, words=5, similarity=0.8):
    """What stays, by comparing every pair."""
    sets = [{tuple(t.split()[i : i + words]) for i in range(len(t.split()) - words + 1)} for t in texts]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i)]
    links = [(i, j) for i, j in pairs if len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j])]
    return {min(c) for c in brute_groups(len(texts), links)}, pairs, links


def brute_groups(n, links):
    group = {i: {i} for i in range(n)}
    for i, j in links:
        if group[i] is not group[j]:
            group[i] |= group[j]
            for k in group[j]:
                group[k] = group[i]
    return list({id(g): g for g in group.values()}.values())


@pytest.mark.parametrize("tile,block", [(simhash.TILE, simhash.BLOCK), (20, 3000)])
def test_every_candidate_is_verified_whatever_others_fail(spark, docs_of, tile, block):
    """Many texts share most shingles, so candidates that fail connect all of them; also where tiles and blocks are small."""
    rng = random.Random(14)
    vocab = [f"w{i}" for i in range(3000)]
    lists = [rng.choices(vocab, k=240)]
    for _ in range(120):
        w = list(rng.choice(lists))
        for k in rng.sample(range(240), rng.choice([4, 5, 7, 8, 9])):
            w[k] = rng.choice(vocab)
        lists.append(w)
    texts = [" ".join(w) for w in lists]
    want, pairs, links = jaccard_rest(texts)
    assert 0 < len(links) < len(pairs) / 3 and len(want) > 5
    kept = {r.doc_id for r in simhash.drop_near_duplicates(docs_of(texts), tile=tile, block=block).collect()}
    assert kept == want


def test_rows_that_repeat_an_id_and_clashing_columns(spark, docs_of):
    rng = random.Random(5)
    text = lambda k: " ".join(rng.choices([f"w{i}" for i in range(900)], k=k))
    a, b, c = text(200), text(200), text(200)
    near = a.replace(a.split()[100], "changed")
    d = docs_of([a, b, near, near, near, c, c, None, ""], [1, 2, 2, 2, 3, None, 4, 7, 8], near_id=list("abcdefghi"), near_h=["x"] * 9, node=["n"] * 9, h=["h"] * 9)
    kept = simhash.drop_near_duplicates(d)
    assert kept.columns == d.columns
    # of the rows of 2 only the one with a text of its own stays
    assert sorted(((r.doc_id, r.near_id) for r in kept.collect()), key=repr) == sorted([(1, "a"), (2, "b"), (None, "f"), (4, "g"), (7, "h")], key=repr)


def test_no_documents(spark, docs_of):
    d = docs_of(["x"], [1]).where("false")
    assert simhash.drop_near_duplicates(d).collect() == [] and simhash.near_duplicates(d).collect() == []
