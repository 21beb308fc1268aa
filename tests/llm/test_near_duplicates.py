import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkqueue.llm import near_duplicates as nd
from sparkqueue.llm.components import connected_components, least_reachable


def shingle_set(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1)) or frozenset([tuple(words)])


def brute_force(rows, size, percent=80):
    """rows: (doc_id, text) with distinct doc_ids."""
    sets = {i: shingle_set(t, size) for i, t in rows}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    index = {}
    for i in ids:
        for s in sets[i]:
            index.setdefault(s, []).append(i)
    for i in ids:
        for j in {j for s in sets[i] for j in index[s] if j > i}:
            a, b = sets[i], sets[j]
            both = len(a & b)
            if 100 * both >= percent * (len(a) + len(b) - both):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    return sorted((i, len(sets[i]), root(i), root(i) == i) for i in ids)


@pytest.mark.parametrize("size", [4, 5])
def test_sample_against_brute_force(sample, size):
    rows = [(r.doc_id, r.text) for r in sample.collect()]
    assert sorted(map(tuple, nd.near_duplicates(sample, size).collect())) == brute_force(rows, size)


def edited(r, words, times):
    out = list(words)
    for _ in range(times):
        k = r.randrange(len(out))
        if r.random() < 0.5:
            out[k] = f"x{r.randrange(10**6)}"
        else:
            del out[k]
    return out


def test_large_groups_against_brute_force(spark):
    """Copies at all distances, chains of cut copies, and unlike texts under one common passage."""
    r = random.Random(5)
    word = lambda: f"w{r.randrange(4000)}"
    rows = []
    for length, copies, most in ((150, 130, 9), (60, 80, 4), (300, 50, 30)):
        base = [word() for _ in range(length)]
        rows += [edited(r, base, r.randrange(most)) for _ in range(copies)]
    chain = [word() for _ in range(400)]
    rows += [chain[: 400 - 5 * i] for i in range(60)]
    common = [word() for _ in range(12)]
    rows += [common + [word() for _ in range(r.choice((2, 6, 60)))] for _ in range(90)]
    rows += [[word() for _ in range(r.randrange(1, 8))] for _ in range(60)] + rows[:20]
    r.shuffle(rows)
    rows = [(i * 7 % 1009, " ".join(w)) for i, w in enumerate(rows)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted(map(tuple, nd.near_duplicates(docs, 4).collect())) == brute_force(rows, 4)


def test_words_that_collide_under_polynomials_stay_apart(spark):
    """Thue-Morse words: a polynomial modulo 2**64 gives both the same hash, whatever its odd multiplier."""
    a = "a"
    while len(a) < 4096:
        a += a.translate(str.maketrans("ab", "ba"))
    rows = []
    for k, n in enumerate((64, 1024, 2048, 4096)):
        rows += [(2 * k, f"x{k} {a[:n]}"), (2 * k + 1, f"x{k} {a[:n].translate(str.maketrans('ab', 'ba'))}")]
    got = nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(i, i) for i in range(8)]


def kinds_under_a_passage(r, kinds, copies, passage, own):
    """Kinds of texts, each of near copies, that all hold one passage."""
    word = lambda: f"w{r.randrange(10**6)}"
    shared = [word() for _ in range(passage)]
    rows = []
    for _ in range(kinds):
        base = shared + [word() for _ in range(own)]
        rows += [" ".join(edited(r, base, r.randrange(0, 4))) for _ in range(copies)]
    r.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("passage, own", [(60, 40), (85, 15), (95, 5)])
def test_many_kinds_under_one_passage(spark, passage, own):
    rows = kinds_under_a_passage(random.Random(passage), 12, 50, passage, own)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(map(tuple, nd.near_duplicates(docs, 4).collect())) == brute_force(rows, 4)


def test_texts_of_common_passages_alone(spark, monkeypatch):
    """Every shingle is common: the last resort, blocks, has to find what lists and pivots don't."""
    r = random.Random(11)
    passages = [[f"p{i}w{j}" for j in range(12)] for i in range(14)]
    rows = []
    for _ in range(150):
        picked = r.sample(range(14), 9)
        rows.append([w for i in sorted(picked) for w in passages[i]])
        rows.append([*rows[-1][:-4], "x"])
    rows = list(enumerate(" ".join(w) for w in rows))
    monkeypatch.setattr(nd, "SHORT", 4)
    monkeypatch.setattr(nd, "PIVOTS", 1)
    monkeypatch.setattr(nd, "BLOCK_SHINGLES", 3000)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, nd.near_duplicates(docs, 4).collect())) == brute_force(rows, 4)


def test_prefixes_meet_what_is_similar():
    """Any two sets of the similarity share a prefix shingle, in any order, and the bound on places lets them pass."""
    r = np.random.default_rng(4)
    for _ in range(300):
        a = np.unique(r.integers(0, 200, r.integers(1, 80))).astype(np.uint64)
        b = np.unique(np.concatenate((r.permutation(a)[: r.integers(1, len(a) + 1)], r.integers(0, 200, r.integers(0, 6)).astype(np.uint64))))
        if len(a) > len(b):
            a, b = b, a
        if 100 * len(np.intersect1d(a, b)) < 80 * len(np.union1d(a, b)):
            continue
        known = np.unique(r.integers(0, 200, 40)).astype(np.uint64)
        times = r.integers(33, 99, len(known))
        x, y = (nd.rarest_first(s, known, times) for s in (a, b))
        few, many = len(x) + 1 + (-160 * len(x) // 180), len(y) + 1 + (-80 * len(y) // 100)
        met = [(i, j) for i in range(few) for j in range(many) if x[i] == y[j]]
        assert any(180 * min(len(x) - i, len(y) - j) >= 80 * (len(x) + len(y)) for i, j in met)


def test_clashing_names(spark):
    rows = [(1, "one two three four five six", 9), (2, "one two three four five six", 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, text_tie long").selectExpr("*", "text_tie as _text", "text_tie as kept_id", "text_tie as times", "text_tie as digest")
    got = nd.without_near_duplicates(docs)
    assert got.columns == docs.columns and [tuple(r) for r in got.collect()] == [(1, "one two three four five six", 9, 9, 9, 9, 9)]


def test_edge_cases(awkward, no_rows):
    got = nd.near_duplicates(awkward, 4).collect()
    assert len(got) == awkward.count()
    of = {}
    for r in got:
        of.setdefault(r.doc_id, []).append((r.n_shingles, r.component_id, r.kept))
    assert of[7] == [(0, 7, True)] and of[3] == [(0, 3, True)] and of[1] == [(1, 1, True)]
    assert of[4] == [(5, 4, True)] and of[5] == [(5, 4, False)] * 2
    assert of[6] == [(2, 6, True)] and of[None] == [(9, None, True)]
    assert nd.near_duplicates(no_rows).count() == 0


def test_blocks_find_what_pairs_find():
    r = np.random.default_rng(2)
    base = r.integers(0, 1 << 60, 100).astype("<u8")
    sets = [np.unique(np.concatenate((r.choice(base, 95, replace=False), r.integers(0, 1 << 60, r.integers(1, 20)).astype("<u8")))) for _ in range(40)]
    cls, side = np.arange(40), np.array([0] * 15 + [1] * 25)
    found = nd.links_in_block(cls, cls, side, [s.tobytes() for s in sets], 80)
    j = lambda a, b: len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert sorted(found) == [(i, k) for i in range(15) for k in range(15, 40) if j(sets[i], sets[k]) >= 0.8]


def test_estimate_of_whole_sketches_is_exact():
    a, b = np.arange(10, dtype="<u8"), np.arange(2, 11, dtype="<u8")
    assert nd.shared_of_union(a, b, True) == (8, 11)
    a, b = np.arange(0, 200, dtype="<u8")[: nd.KEPT], np.arange(10, 200, dtype="<u8")[: nd.KEPT]
    assert nd.shared_of_union(a, b, False) == (nd.KEPT - 10, nd.KEPT)


def test_least_reachable():
    r = np.random.default_rng(7)
    chain = r.permutation(500)
    vertex, root = least_reachable(chain[:-1], chain[1:])
    assert vertex.tolist() == list(range(500)) and set(root) == {0}
    u, v = r.integers(0, 300, 150), r.integers(0, 300, 150)
    up = {int(x): int(x) for x in [*u, *v]}
    for _ in range(300):
        for a, b in zip(u.tolist(), v.tolist(), strict=True):
            up[a] = up[b] = min(up[a], up[b])
    assert dict(zip(*(x.tolist() for x in least_reachable(u, v)), strict=True)) == up


def test_components(spark):
    r = random.Random(3)
    pairs = [(i, i + 1) for i in range(0, 90)] + [(1000, 1000 + i) for i in range(1, 50)] + [(r.randrange(2000, 2060), r.randrange(2000, 2060)) for _ in range(40)]
    r.shuffle(pairs)
    up = {v: v for p in pairs for v in p}

    def root(v):
        while up[v] != v:
            v = up[v]
        return v

    for a, b in pairs:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    expected = {v: root(v) for p in pairs for v in p if p[0] != p[1]}
    for links_a_task in (1_000_000, 60):
        found = connected_components(spark.createDataFrame(pairs, "a long, b long"), links_a_task=links_a_task).collect()
        assert len(found) == len(expected) and {x.vertex: x.component for x in found} == expected
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
