import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkqueue.llm.language_id import LanguageFilters, commonest_grams, fit_language_filters, grams, held_out, identify_languages
from sparkqueue.llm.quality import STRIDE, SYMBOLS, WIDTH, ByteNet, Constant, chunks, fit_quality, score_quality, symbols

BASE = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{BASE}/documents.parquet"), spark.read.parquet(f"{BASE}/labels.parquet")


def test_chunks_cover_every_byte_and_never_cross_rows():
    rows = [b"", b"a", b"x" * 40, bytes(range(100)), b"ab" * 30]
    data = np.frombuffer(b"".join(rows), np.uint8)
    starts = np.concatenate(([0], np.cumsum([len(r) for r in rows])))
    marks, first = chunks(data, starts)
    for i, row in enumerate(rows):
        own = marks[first[i] : first[i + 1]]
        rebuilt = {}
        for c, chunk in enumerate(own):
            rebuilt.update({c * STRIDE + j: m % 256 for j, m in enumerate(chunk) if m != SYMBOLS})
        assert bytes(rebuilt[k] for k in range(len(row))) == row and len(rebuilt) == len(row)
        alone = chunks(np.frombuffer(row, np.uint8), np.array([0, len(row)]))[0]
        assert np.array_equal(alone, own)
    assert WIDTH > STRIDE


def test_repetition_marks_against_brute_force():
    row = b"one two one two three threex three aaaaaaaa"
    found = symbols(np.frombuffer(row, np.uint8), np.array([0, len(row)]))
    for i in range(len(row)):
        again = i + 4 <= len(row) and any(i >= lag and row[i : i + 4] == row[i - lag : i - lag + 4] for lag in range(2, 33))
        assert found[i] == row[i] + 256 * again


def test_gradient_against_differences():
    net = ByteNet(filters=3, size=2, hidden=2)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    marks, first = chunks(np.frombuffer(b"some words and some more of them!!" * 2, np.uint8), np.array([0, 30, 68]))
    labels = np.array([1.0, 0.0], np.float32)

    def loss():
        p = net.head(net.pooled(net.tables(), marks, first))[2]
        return -np.mean(labels * np.log(p) + (1 - labels) * np.log(1 - p))

    g = net._gradient(marks, first, labels)
    r = np.random.default_rng(0)
    for k, v in net.p.items():
        for _ in range(6):
            at = tuple(r.integers(0, n) for n in v.shape)
            old, e = v[at], 1e-6
            v[at] = old + e
            up = loss()
            v[at] = old - e
            down = loss()
            v[at] = old
            assert abs((up - down) / (2 * e) - g[k][at]) < 1e-4


def naive_score(net, text):
    """The network, chunk by chunk and filter by filter."""
    p = {k: v.astype(np.float64) for k, v in net.p.items()}
    marks = [b + 256 * (i + 4 <= len(text) and any(i >= lag and text[i : i + 4] == text[i - lag : i - lag + 4] for lag in range(2, 33))) for i, b in enumerate(text)]
    best = [-np.inf] * len(p["bias"])
    at = 0
    while True:
        chunk = (marks[at : at + WIDTH] + [SYMBOLS] * WIDTH)[:WIDTH]
        for f in range(len(best)):
            best[f] = max(best[f], sum(float(p["embed"][m] @ p["conv"][j, :, f]) for j, m in enumerate(chunk)))
        if at + WIDTH >= len(text):
            break
        at += STRIDE
    pool = [np.tanh(x + b) for x, b in zip(best, p["bias"], strict=True)]
    hidden = [np.tanh(sum(x * w for x, w in zip(pool, p["dense"][:, h], strict=True)) + p["dense_bias"][h]) for h in range(len(p["out"]))]
    return 1 / (1 + np.exp(-(sum(x * w for x, w in zip(hidden, p["out"], strict=True)) + p["out_bias"][0])))


TEXTS = [b"", b"a", b"short", b"x" * 16, b"x" * 17, b"one two one two and one two three, " * 9, "Ünïcödé 漢字 ".encode() * 12]


@pytest.mark.parametrize("fitted", [False, True])
def test_scores_against_the_plain_network(fitted, monkeypatch):
    from sparkqueue.llm import quality

    net = ByteNet(filters=5, size=3, hidden=4)
    if fitted:
        net.fit(TEXTS, np.array([0, 1, 0, 1, 0, 1, 1], np.float32), epochs=3, batch=3)
    data = np.frombuffer(b"".join(TEXTS), np.uint8)
    starts = np.concatenate(([0], np.cumsum([len(t) for t in TEXTS])))
    want = [naive_score(net, t) for t in TEXTS]
    assert np.allclose(net.score(net.tables(), data, starts), want, atol=1e-4)
    for size in (8, 64, 200):
        monkeypatch.setattr(quality, "STRETCH", size)
        assert np.allclose(net.score(net.tables(), data, starts), want, atol=1e-4)


def test_counts_against_sets_of_grams(monkeypatch):
    from sparkqueue.llm import language_id

    def plain(text):
        row = b"    " + text.lower().encode() + b"    " + b"    "
        return [row[i : i + 4] for i in range(len(row) - 4)]

    learned = {"a": "the quick brown fox jumps", "b": "der schnelle braune fuchs", "c": "el zorro marron salta"}
    sets = {k: set(plain(v)) for k, v in learned.items()}
    filters = LanguageFilters(list(learned), [np.unique(grams([t])[0]) for t in learned.values()], bits=20)
    texts = ["the braune zorro", "Quick SCHNELLE", "x", "der fuchs jumps over el zorro " * 30, "漢字 the fox"]
    for size in (1 << 20, 50):
        monkeypatch.setattr(language_id, "STRETCH", size)
        for t in texts:
            own = plain(t)
            got, n = filters.counts([t])
            assert n.tolist() == [len(own)]
            want = np.array([sum(g in sets[k] for g in own) for k in learned])
            want = np.maximum(0, (want - len(own) * filters.chance) / (1 - filters.chance))
            assert np.allclose(got[0], want, atol=0.02 * len(own) + 1e-9)
            top = max(range(3), key=lambda k: (got[0][k], -k))
            assert filters.predict([t])[0] == [list(learned)[top]]
    together, n = filters.counts(texts)
    for i, t in enumerate(texts):
        assert np.array_equal(together[i], filters.counts([t])[0][0])


def test_quality_on_held_out_rows(spark, tables):
    docs, labels = tables
    net = fit_quality(docs, labels, ~held_out(5, 0))
    got = score_quality(docs, net).join(labels, "doc_id").where(held_out(5, 0)).toPandas()
    assert len(got) > 50
    assert ((got.score >= 0.3) == (got.quality == 1)).mean() > 0.9


def test_quality_reads_only_training_labels(spark, tables):
    docs, labels = tables
    spoiled = labels.withColumn("quality", F.when(held_out(5, 0), 1 - F.col("quality")).otherwise(F.col("quality")))
    small = docs.where(F.octet_length("text") < 500)
    a, b = (fit_quality(small, x, ~held_out(5, 0), sample=40) for x in (labels, spoiled))
    assert all(np.array_equal(a.p[k], b.p[k]) for k in a.p)


def test_quality_edge_cases(spark, awkward, no_rows, tables):
    labels = tables[1]
    net = ByteNet()
    got = score_quality(awkward, net).toPandas()
    assert len(got) == awkward.count() and got.score.between(0, 1).all()
    assert got[got.doc_id.isin([3, 7])].score.nunique() == 1
    assert got[got.doc_id.isin([4, 5])].score.nunique() == 1
    assert score_quality(no_rows, net).count() == 0
    empty = fit_quality(no_rows, labels, ~held_out(5, 0))
    assert isinstance(empty, Constant) and empty.value == 0.5
    assert set(score_quality(awkward, empty).toPandas().score) == {0.5}
    nulls = spark.createDataFrame([(1, None), (None, 1), (2, 1), (2, 1)], "doc_id long, quality int")
    assert fit_quality(awkward, nulls, F.lit(True)).value == 1.0


def test_quality_learns_from_texts_of_bounded_size(spark, monkeypatch):
    read = []
    monkeypatch.setattr(ByteNet, "fit", lambda net, texts, labels: read.extend(texts))
    docs = spark.range(50).select(F.col("id").alias("doc_id"), F.repeat(F.lit("abcdé "), 10).alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    for most, rows in ((70 * 20, 20), (70 * 21 - 1, 20), (10_000, 50)):
        read.clear()
        fit_quality(docs, labels, F.lit(True), most_bytes=most)
        assert len(read) == rows


def test_held_out_fold_is_that_of_crc32(spark):
    got = spark.range(-3, 50).select(F.col("id").alias("doc_id")).withColumn("h", held_out(4, 2)).collect()
    assert spark.sql("select cast(null as long) as doc_id").select(held_out(4, 2)).first()[0] is True
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)


def test_filters_return_all_languages_that_contain_a_gram():
    texts = {"a": "the quick brown fox", "b": "der schnelle braune fuchs the", "c": "el zorro marron"}
    sets = [np.unique(grams([t])[0]) for t in texts.values()]
    filters = LanguageFilters(list(texts), sets, bits=16)
    every = np.unique(np.concatenate(sets))
    slots = filters._slots(every)
    mask = filters.slots[0][slots[0]] & filters.slots[0][slots[1]] & filters.slots[0][slots[2]]
    for bit, own in enumerate(sets):
        assert np.all(mask[np.isin(every, own)] >> bit & 1)
        assert np.mean(mask[~np.isin(every, own)] >> bit & 1) < 0.1
    names, score = filters.predict(["quick brown", None, "", "123 !?", "zorro", "schnelle"])
    assert names == ["a", "und", "und", "und", "c", "b"]
    assert (score[1:4] == 0).all() and (score >= 0).all() and (score <= 1).all()


def test_more_languages_than_bits():
    names = [f"l{i:03d}" for i in range(130)]
    words = [f"word{i:03d}end" for i in range(130)]
    filters = LanguageFilters(names, [np.unique(grams([w])[0]) for w in words], bits=18)
    assert filters.predict(words)[0] == names


def test_language_on_held_out_rows(tables):
    docs = tables[0]
    filters = fit_language_filters(docs.where(~held_out(4, 2)))
    got = identify_languages(docs, filters).join(docs.select("doc_id", "lang"), "doc_id").where(held_out(4, 2)).toPandas()
    assert len(got) > 100
    assert (got.lang == got.lang_pred).mean() > 0.97


def test_languages_full_of_copies_are_learned_from_all_their_texts(spark, monkeypatch):
    learned = {}
    monkeypatch.setattr("sparkqueue.llm.language_id.LanguageFilters", lambda names, sets: learned.update(zip(names, sets, strict=True)))
    copies = spark.range(20000).select(F.lit("xx").alias("lang"), F.lit("all of these are copies").alias("text"))
    others = spark.range(30).select(F.lit("xx").alias("lang"), F.format_string("words of text number %d", "id").alias("text"))
    many = spark.range(300).select(F.lit("yy").alias("lang"), F.format_string("other %d text", "id").alias("text"))
    fit_language_filters(copies.union(others).union(many), per_language=40)
    assert set(learned) == {"xx", "yy"}
    assert np.isin(grams(["words of text number"])[0][4:16], learned["xx"]).all()


def test_languages_learn_from_as_many_texts_as_asked_for(spark, monkeypatch):
    from sparkqueue.llm import language_id

    read = []
    monkeypatch.setattr(language_id, "grams", lambda texts: read.extend(texts) or grams(texts))
    docs = spark.range(6000).select(F.lit("xx").alias("lang"), F.format_string("text %d", F.greatest(F.col("id") - 5000, F.lit(0))).alias("text"))
    fit_language_filters(docs, per_language=100)
    assert len(read) == len(set(read)) == 100


@pytest.mark.parametrize("held", [1, 40, 1 << 22])
def test_commonest_grams_against_counters(held, monkeypatch):
    monkeypatch.setattr("sparkqueue.llm.language_id.HELD", held)
    for texts in ([], [""], ["one two one two"], [f"text {i % 3} of {'many ' * i}" for i in range(9)]):
        seen, of = Counter(), Counter()
        for t in texts:
            seen.update(grams([t])[0].tolist())
            of.update(set(grams([t])[0].tolist()))
        want = sorted((g for g in of if of[g] >= (2 if len(texts) >= 8 else 1)), key=lambda g: (-seen[g], g))
        for most in (5, 1000):
            assert commonest_grams(iter(texts), most).tolist() == want[:most]


def test_labels_that_name_too_many_languages_are_refused(spark):
    docs = spark.range(40).select(F.lit("some text").alias("text"), (F.col("id") % 20).cast("string").alias("lang"))
    assert fit_language_filters(docs, most_languages=20).names == sorted(str(i) for i in range(20))
    with pytest.raises(ValueError, match="more than 19 languages"):
        fit_language_filters(docs, most_languages=19)


def test_language_edge_cases(awkward, no_rows):
    filters = fit_language_filters(awkward)
    got = identify_languages(awkward, filters).toPandas()
    text = {r.doc_id: r.text for r in awkward.collect()}
    assert len(got) == awkward.count()
    for doc, pred in zip(got.doc_id, got.lang_pred, strict=True):
        t = text[None if pd.isna(doc) else int(doc)]
        assert (pred == "und") == (not t or not re.search(r"[^\W\d_]", t))
    nothing = fit_language_filters(no_rows)
    assert set(identify_languages(awkward, nothing).toPandas().lang_pred) == {"und"}
    assert identify_languages(no_rows, filters).count() == 0
