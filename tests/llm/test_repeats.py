import hashlib
import random

import numpy as np
import pytest

from sparkqueue.llm import repeats
from sparkqueue.llm.repeats import without_repeats


def brute_force(rows):
    least = {}
    texts = [(i, (t or "").encode()) for i, t in rows]
    for i, t in texts:
        for p in range(len(t) - 49):
            s = t[p : p + 50]
            if i is not None and i < least.get(s, float("inf")):
                least[s] = i
    out = []
    for i, t in texts:
        goes = np.zeros(len(t) + 1, bool)
        for p in range(len(t) - 49):
            if least.get(t[p : p + 50], float("inf")) < (float("inf") if i is None else i):
                goes[p : p + 50] = True
        kept = bytes(b for b, g in zip(t, goes, strict=False) if not g)
        spans = sum(goes[p] and (p == 0 or not goes[p - 1]) for p in range(len(t)))
        out.append((i, len(t), int(goes[: len(t)].sum()), int(spans), hashlib.sha256(kept).hexdigest()))
    return out


def key(r):
    return (r[0] is None, r[0] or 0, r[1:])


def same(docs, rows, **more):
    got = sorted((tuple(r) for r in without_repeats(docs, **more).collect()), key=key)
    assert got == sorted(brute_force(rows), key=key)
    return got


def test_planted_passages(spark):
    r = random.Random(4)
    text = lambda n: "".join(r.choice("abcdefgh éß") for _ in range(n))
    passages = [text(n) for n in (49, 50, 51, 60, 81, 120, 400)]
    rows = []
    for i in range(150):
        parts = [text(r.randrange(0, 90)) for _ in range(r.randrange(1, 4))]
        for _ in range(r.randrange(0, 4)):
            p = r.choice(passages)
            cut = r.randrange(len(p))
            parts.insert(r.randrange(len(parts) + 1), p if r.random() < 0.5 else p[cut:])
        rows.append((i * 37 % 151, "".join(parts)))
    rows += [(500 + k, t) for k, (_, t) in enumerate(rows[:10])]
    rows += [(600, "ab" * 100), (601, "ab" * 60 + "x"), (602, "a" * 300), (603, "a" * 70), (-5, "a" * 55), (604, passages[-1] * 2)]
    base = text(900)
    for k in range(30):  # near copies, edited every few bytes
        edited = list(base)
        for _ in range(r.randrange(1, 25)):
            edited[r.randrange(len(edited))] = r.choice("xyz")
        rows.append((700 + k, "".join(edited)))
    r.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = same(docs, rows, block_rows=23)
    same(docs, rows, block_rows=60, strings_at_once=50)
    assert sum(x[2] > 0 for x in got) > 60


def test_long_documents_are_cut_in_stretches(spark, monkeypatch):
    r = random.Random(9)
    text = lambda n: "".join(r.choice("abcdefgh") for _ in range(n))
    shared = [text(n) for n in (60, 300, 3000)]
    rows = [(i, "".join(r.choice([text(200), r.choice(shared), r.choice(shared)[20:]]) for _ in range(12))) for i in range(12)]
    data = [np.frombuffer(t.encode(), np.uint8) for _, t in rows]
    monkeypatch.setattr(repeats, "STRETCH", 700)
    for d in data:
        block = repeats.Block.__new__(repeats.Block)
        block.data, block.starts = d, np.array([0, len(d)])
        found = [a + f for a, b, s in block.pieces() for f, n in zip(*repeats.runs(d[a:b], s)[:2], strict=True) for f in range(f, f + n)]
        assert found == list(range(len(d) - 49))
    monkeypatch.undo()
    same(spark.createDataFrame(rows, "doc_id long, text string"), rows)


@pytest.mark.parametrize("which", ["awkward", "no_rows"])
def test_edge_cases(request, which):
    docs = request.getfixturevalue(which)
    same(docs, [(r.doc_id, r.text) for r in docs.collect()])


def test_sample(sample):
    same(sample, [(r.doc_id, r.text) for r in sample.collect()], block_rows=40)


def test_blocks_are_bounded_in_bytes_and_keep_their_runs(spark, tmp_path):
    r = random.Random(2)
    rows = [(i, "".join(r.choice("abcdefgh ") for _ in range(r.choice((10, 3000, 60_000))))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    listed = repeats.write_blocks(docs, f"file://{tmp_path}/blocks", most_bytes=100_000, most_rows=20).collect()
    assert len({x.block for x in listed}) == len(listed) > 5
    ids = []
    for x in listed:
        block = repeats.Block(x.path, 3)
        assert (len(block.data) <= 100_000 or len(block.ids) == 1) and len(block.ids) <= 20
        again = repeats.Block(x.path, 3)
        assert np.array_equal(block.first, again.first) and np.array_equal(block.offset, again.offset) and block.kept("runs") is not None
        ids += block.ids.to_pylist()
    assert sorted(ids) == list(range(60))


def test_ranks_lie_evenly_in_the_ranges(spark, tmp_path):
    r = random.Random(8)
    docs = spark.createDataFrame([(i, "".join(r.choice("abcdefgh ") for _ in range(20_000))) for i in range(20)], "doc_id long, text string").coalesce(1)
    block = repeats.Block(repeats.write_blocks(docs, f"file://{tmp_path}/even").first().path, 16)
    sizes = [len(ranks) for _, _, ranks, _ in block.anchors()]
    assert len(sizes) == 16 and max(sizes) < 1.2 * min(sizes)
