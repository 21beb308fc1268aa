import random
import re

import numpy as np
import pyarrow as pa
import pytest

from sparkqueue.llm import decontamination as dc

WORD = re.compile(r"[0-9a-z\x80-\U0010ffff]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def least(item, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item):
        now = [i + 1]
        for j, b in enumerate(text):
            now.append(min(row[j] + (a != b), row[j + 1] + 1, now[j] + 1))
        row = now
    return min(row)


def brute_force(docs, items):
    out = {}
    for d, text in docs:
        for i, item in items:
            w = words(item)
            if w and (n := least(w, words(text))) <= len(w) * 20 // 100:
                out[d, i] = n
    return out


def planted(seed, edits):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    items = [(k, " ".join(r.choice(vocabulary) for _ in range(n))) for k, n in enumerate([1, 2, 5, 9, 14, 14, 20, 26, 33, 40, 48, 60])]
    docs = []
    for d in range(80):
        w = [r.choice(vocabulary) for _ in range(r.randrange(0, 90))]
        if d % 2:
            own = items[r.randrange(3, len(items))][1].split()
            for _ in range(int(len(own) * edits)):
                at, kind = r.randrange(len(own)), r.randrange(3)
                own[at : at + 1] = [[r.choice(vocabulary)], [own[at], r.choice(vocabulary)], []][kind] or []
            at = r.randrange(len(w) + 1)
            w[at:at] = own
        docs.append((d, ", ".join(w).title() + "."))
    return docs, items


@pytest.mark.parametrize("edits", [0.0, 0.08, 0.16])
def test_against_brute_force(edits):
    docs, items = planted(int(edits * 100), edits)
    index = dc.ItemIndex([i for i, _ in items], [t for _, t in items])
    found = {(docs[row][0], items[i][0]): d for row, i, d in index.search(*dc.words_of(pa.array([t for _, t in docs])))}
    expected = brute_force(docs, items)
    assert all(expected[k] <= d <= len(words(items[k[1]][1])) * 20 // 100 for k, d in found.items())
    long = {k for k in expected if k[1] >= 3}
    assert len(long) >= 20 and len(long & found.keys()) >= 0.95 * len(long)
    if not edits:
        assert {k for k, d in expected.items() if d == 0} <= found.keys()


def test_a_walk_depends_on_words_alone_and_resumes_after_an_edit():
    r = np.random.default_rng(0)
    w = r.integers(1, 1 << 62, 60).astype(np.uint64)
    padded = lambda x: np.concatenate((x, np.zeros(100, np.uint64)))
    at, steps = np.zeros(1, np.int64), np.arange(80)
    assert dc.walk(padded(w), at, steps, 3)[0] == dc.walk(padded(w.copy()), at, steps, 3)[0]
    edited = w.copy()
    edited[5] = 1
    same = np.mean([dc.walk(padded(w), at, np.array([70]), s)[0] == dc.walk(padded(edited), at, np.array([70]), s)[0] for s in range(1, 200)])
    assert same > 0.5


def test_least_distance():
    r = random.Random(1)
    for _ in range(50):
        item, text = [r.randrange(1, 4) for _ in range(r.randrange(1, 8))], [r.randrange(1, 4) for _ in range(9)]
        assert dc.least_distance(np.array(item, np.uint64), np.array([text], np.uint64))[0] == least(item, text)


def test_sample_holds_what_exact_search_finds(spark, sample):
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    got = {(r.doc_id, r.item_id) for r in dc.contaminated(sample, items).collect()}
    texts = {r.doc_id: f" {' '.join(words(r.text))} " for r in sample.collect()}
    exact = {(d, r.item_id) for r in items.collect() for d, t in texts.items() if f" {' '.join(words(r.text))} " in t}
    assert exact and exact <= got
    left = {r.doc_id for r in dc.without_contaminated(sample, items).collect()}
    assert left == texts.keys() - {d for d, _ in got}
    sliced = {(r.doc_id, r.item_id) for r in dc.contaminated(sample, items, slice_items=15).collect()}
    assert sliced == got
    assert dc.without_contaminated(sample, items, slice_items=15).count() == len(left)


def test_edge_cases(spark, awkward, no_rows):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "?!"), (None, "same text TWICE of more"), (4, "long words long words long words"), (4, "long words long words long words")], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id or 0, r.distance) for r in dc.contaminated(awkward, items).collect())
    assert got == [(4, 0, 0), (5, 0, 0), (5, 0, 0), (6, 4, 0), (6, 4, 0)]
    clean = dc.without_contaminated(awkward, items)
    assert clean.columns == awkward.columns
    assert sorted((r.doc_id or 0) for r in clean.collect()) == [-8, 0, 1, 2, 3, 7, 9]
    assert dc.contaminated(no_rows, items).count() == 0
    assert dc.contaminated(awkward, items.limit(0)).count() == 0
    assert dc.without_contaminated(awkward, items.limit(0)).count() == awkward.count()


def edited(item, edits, r):
    """The item with so many random edits, spread over it."""
    out = list(item)
    for at in sorted(r.sample(range(len(item)), edits), reverse=True):
        out[at : at + 1] = [["new"], ["new", out[at]], []][r.randrange(3)]
    return out


@pytest.mark.parametrize("size", [400, 800])
def test_long_items_at_the_allowed_edits(size):
    r = random.Random(size)
    items = [[f"v{r.randrange(3000)}" for _ in range(size)] for _ in range(4)]
    index = dc.ItemIndex(list(range(4)), [" ".join(w) for w in items])
    docs = [edited(items[k % 4], size // 5, r) for k in range(24)]
    docs = [["other"] * (k % 3) + w + ["words"] * (k % 5) for k, w in enumerate(docs)]
    found = index.search(*dc.words_of(pa.array([" ".join(w) for w in docs] + ["a text that holds none"])))
    assert {(row, i) for row, i, _ in found} == {(k, k % 4) for k in range(24)}
    assert all(d <= size // 5 for *_, d in found)


@pytest.mark.parametrize("edits", [0.0, 0.08, 0.16])
def test_pieces_against_brute_force(edits):
    docs, items = planted(int(edits * 100) + 1, edits)
    index = dc.ItemIndex([i for i, _ in items], [t for _, t in items], most_walks=0)
    assert not index.classes
    found = {(docs[row][0], items[i][0]): d for row, i, d in index.search(*dc.words_of(pa.array([t for _, t in docs])))}
    assert found == brute_force(docs, items)


@pytest.mark.parametrize("size", [1, 2, 3, 4, 12])
def test_every_item_is_found_verbatim(size):
    items = [" ".join(f"u{k}x{j}" for j in range(size)) for k in range(2000)]
    index = dc.ItemIndex(list(range(2000)), items)
    found = index.search(*dc.words_of(pa.array([f"before {t} after" for t in items])))
    assert {(row, i) for row, i, d in found if d == 0} >= {(k, k) for k in range(2000)}


def test_scripts_without_spaces_and_their_punctuation():
    items = ["机器学习模型需要大量的训练数据才能取得好的结果", "これは評価のための文章です", "ประเทศไทยมีประชากรมาก", "Élan Überall Señor ÇA ÉTÉ", "«un texte» écrit…"]
    index = dc.ItemIndex(list(range(5)), items)
    docs = ["前文" + items[0] + "。后文没有空格。", "「" + items[1] + "」と書く。", "ก่อน" + items[2] + "หลัง", "x élan überall señor ça été", "un—texte écrit", "别的文字，没有题目。", None]
    found = index.search(*dc.words_of(pa.array(docs)))
    assert sorted(found) == [(k, k, 0) for k in range(5)]
    swapped = items[0].replace("训练", "练习")
    assert index.search(*dc.words_of(pa.array([f"前{swapped}后"])))[0][:2] == (0, 0)


def test_typos_in_many_words():
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randrange(6, 11)))
    items = [[word() for _ in range(n)] for n in (8, 20, 40, 90)]
    index = dc.ItemIndex(list(range(4)), [" ".join(w) for w in items])
    docs, far = [], 0
    for k, w in enumerate(items * 3):
        spoiled = list(w)
        for at in r.sample(range(len(w)), max(2, len(w) * 3 // 8)):
            spoiled[at] = spoiled[at][:2] + "0" + spoiled[at][3:]
        far += least(w, spoiled) > len(w) // 5
        docs.append(" ".join([word() for _ in range(k)] + spoiled + [word()]))
    assert far == 12
    found = index.search_texts([pa.array(docs[:5]), pa.array([None, *docs[5:], "no item at all in here"])])
    assert {(row, i) for row, i, _ in found} == {(k + (k >= 5), k % 4) for k in range(12)}


@pytest.mark.parametrize("size", [5, 12, 23, 24, 50, 100, 200, 500, 1000, 2000])
def test_recall_at_the_allowed_edits_and_cost_of_long_items(size):
    import time

    r = random.Random(size)
    items = [[f"v{r.randrange(5000)}" for _ in range(size)] for _ in range(6)]
    index = dc.ItemIndex(list(range(6)), [" ".join(w) for w in items])
    assert index.classes and not index.pieces
    many = 200 if size <= 100 else 40
    docs = [["other"] * (k % 3) + edited(items[k % 6], size // 5, r) + ["words"] * (k % 5) for k in range(many)]
    texts = pa.array([" ".join(w) for w in docs])
    began = time.perf_counter()
    found = {(row, i) for row, i, _ in index.search(*dc.words_of(texts))}
    assert time.perf_counter() - began < 0.1 * many + 0.5
    assert len(found & {(k, k % 6) for k in range(many)}) >= 0.95 * many


@pytest.mark.parametrize("size", [30, 120, 600])
def test_edited_items_in_scripts_without_spaces(size):
    r = random.Random(size)
    letter = lambda: chr(r.randrange(0x4E00, 0x9FA5))
    items = ["".join(letter() for _ in range(size)) for _ in range(5)]
    index = dc.ItemIndex(list(range(5)), items)
    docs = []
    for k in range(60):
        own = list(items[k % 5])
        for at in sorted(r.sample(range(size), size // 6), reverse=True):
            own[at : at + 1] = [[letter()], [letter(), own[at]], []][r.randrange(3)]
        docs.append("".join(letter() for _ in range(r.randrange(40))) + "".join(own) + "，" + letter() * 9)
    found = {(row, i) for row, i, _ in index.search(*dc.words_of(pa.array(docs)))}
    assert found <= {(k, k % 5) for k in range(60)} and len(found) >= 57


def test_long_texts_are_searched_in_stretches(monkeypatch):
    docs, items = planted(3, 0.08)
    long = [" ".join(t for _, t in docs), "é" * 3000 + " " + items[6][1] + " " + "z" * 3000, "漢" * 2000 + items[4][1] + "字" * 2000]
    index = dc.ItemIndex([i for i, _ in items], [t for _, t in items])
    plain = index.search_texts([pa.array([t]) for t in long])
    assert len(plain) > 10
    for size in (100, 1500):
        monkeypatch.setattr(dc, "BYTES_AT_ONCE", size)
        assert sorted(index.search_texts([pa.array([long[0], "short", None]), pa.array(long[1:])])) == sorted((row + 2 * (row > 0), i, d) for row, i, d in plain)
        for row, t in enumerate(long):
            assert sorted(index.search_texts([pa.array([t])])) == sorted((0, i, d) for k, i, d in plain if k == row)


def test_stretches_cut_no_word():
    texts = ["one two three four " * 9, "漢字かな" * 20, "ab\u200dcd " * 20, "x" * 500, ""]
    for t in texts:
        data = np.frombuffer(t.encode(), np.uint8)
        whole = dc.words_of(pa.array([t]))[0]
        got = [dc._words(v, k, np.array([0, len(v)]))[0] for v, k in dc.stretches(data, 37)]
        assert np.array_equal(np.concatenate([np.zeros(0, np.uint64), *got]), whole)
