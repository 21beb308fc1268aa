import hashlib
import heapq
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkqueue.llm import fingerprints as fp
from sparkqueue.llm.sharding import longest_first, shard_documents


def key(r):
    return (r.doc_id is None, -(r.doc_id or 0))


@pytest.mark.parametrize("which", ["awkward", "sample"])
def test_fingerprints_against_brute_force(request, which):
    docs = request.getfixturevalue(which)
    rows = sorted(docs.collect(), key=lambda r: (*key(r), r.text or ""))
    expected = []
    for i, r in enumerate(rows):
        now, then = r.text or "", rows[(i + 1) % len(rows)].text or ""
        m = len(now) // 3
        edited = now[: len(now) - m] + then[:m]
        a, b, c = (fp.fingerprint(t.encode()) for t in (now, edited, then))
        expected.append((r.doc_id, len(now), hashlib.sha256(edited.encode()).hexdigest(), fp.as_text(a), fp.as_text(b), fp.containment(a, b), fp.containment(a, c)))
    order = lambda x: (x[0] is None, x[0] or 0, x[1:])
    assert sorted(map(tuple, fp.document_fingerprints(docs).collect()), key=order) == sorted(expected, key=order)


def test_fingerprints_of_few_rows(spark, no_rows):
    assert fp.document_fingerprints(no_rows).count() == 0
    one = spark.createDataFrame([(1, "only one")], "doc_id long, text string")
    got = fp.document_fingerprints(one).collect()
    assert len(got) == 1 and got[0].near_next == 1.0
    assert got[0].edited_sha256 == hashlib.sha256(b"only oon").hexdigest()


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=1500))
def test_chunks_cover_the_text(text):
    ends = fp.cuts(np.frombuffer(text, np.uint8))
    sizes = np.diff([0, *ends])
    assert sum(sizes) == len(text)
    assert all(fp.LEAST <= n <= fp.MOST for n in sizes[:-1]) and all(0 < n <= fp.MOST for n in sizes[-1:])


def test_gear_hash_is_that_of_the_last_bytes():
    data = np.random.default_rng(0).integers(0, 256, 200).astype(np.uint8)
    h = fp.gear_hashes(data)
    for i in range(fp.WINDOW, 200):
        assert int(h[i]) == sum(int(fp.GEAR[data[i - j]]) << j for j in range(fp.WINDOW)) % 65536


def test_an_insertion_moves_few_chunks():
    text = np.random.default_rng(1).integers(97, 123, 20_000).astype(np.uint8).tobytes()
    a, b = fp.fingerprint(text), fp.fingerprint(text[:9000] + b"inserted" + text[9000:])
    assert fp.containment(a, b) > 0.98


def plain(items, shards):
    heap, out = [(0, s) for s in range(shards)], {}
    for size, name in sorted(items, key=lambda x: (-x[0], x[1])):
        load, s = heapq.heappop(heap)
        out[name] = s
        heapq.heappush(heap, (load + size, s))
    return out


def test_longest_first():
    items = [(7, "a"), (7, "b"), (6, "c"), (5, "d"), (4, "e"), (4, "f")]
    found = longest_first(items, 3)
    loads = defaultdict(int)
    for size, name in items:
        loads[found[name]] += size
    assert sorted(loads.values()) == [11, 11, 11] and found == plain(items, 3)


@pytest.mark.parametrize("which, shards", [("awkward", 3), ("sample", 24), ("sample", 1)])
def test_sharding(request, which, shards):
    docs = request.getfixturevalue(which)
    got = shard_documents(docs, shards, chunk_rows=10).collect()
    rows = docs.collect()
    expected = sorted((r.doc_id is not None, r.doc_id or 0, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in rows)
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.size, r.text_crc32) for r in got) == expected
    slots, shard_of = defaultdict(list), defaultdict(set)
    for r in got:
        assert r.law == "bytes" and 0 <= r.shard < shards and r.grown_shard is None
        slots[r.shard].append(r.slot)
        if r.size > 8:
            shard_of[r.text_crc32].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in shard_of.values())


def test_shard_sizes_are_near_equal(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    loads = [r.n for r in shard_documents(docs, 24).groupBy("shard").agg(F.sum("size").alias("n")).collect()]
    assert len(loads) == 24 and max(loads) / min(loads) < 1.03


def test_sharding_of_no_rows(no_rows):
    assert shard_documents(no_rows).count() == 0


def test_many_rows_without_an_id_are_cut_by_hash(spark):
    rows = [(None, f"text number {i} of those without an id") for i in range(900)] + [(5, f"the same id {i}") for i in range(300)] + [(i, f"own id {i}") for i in range(100, 400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 12)
    try:
        sizes = [n for n in fp.in_next_order(docs).rdd.mapPartitions(lambda x: [sum(1 for _ in x)]).collect()]
        got = sorted(fp.document_fingerprints(docs).collect(), key=str)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(got) == 1500 and max(sizes) < 400 and sum(sizes) <= 1500 + 13
    plain = sorted(fp.document_fingerprints(docs.coalesce(1)).collect(), key=str)
    assert got == plain


def test_places_and_bounds():
    r = np.random.default_rng(0)
    sample = np.concatenate((np.full(500, 7), r.integers(-(1 << 62), 1 << 62, 500)))
    bounds = fp.bounds_of(sample, 10)
    assert len(bounds[0]) == len(bounds[1]) == 9 and sorted(zip(*(b.tolist() for b in bounds), strict=True)) == list(zip(*(b.tolist() for b in bounds), strict=True))
    place, within = np.concatenate((np.full(2000, 7), sample)), r.integers(-(1 << 63), 1 << 63, 3000)
    pairs = list(zip(*(b.tolist() for b in bounds), strict=True))
    assert fp.part_of(bounds, place, within).tolist() == [sum(b <= x for b in pairs) for x in zip(place.tolist(), within.tolist(), strict=True)]
    assert fp.part_of(fp.bounds_of(sample[:0], 5), place, within).max() == 0
