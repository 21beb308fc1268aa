import os

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkqueue.llm import common


def test_written_tables_live_in_the_shared_folder(spark):
    df = spark.range(5).withColumnRenamed("id", "x")
    out = common.written(df, "t")
    folder = out._written_to
    assert folder.startswith(common.shared_folder(spark)) and out.count() == 5 and out.dtypes == df.dtypes
    common.drop_written(df)  # not written: nothing happens
    assert out.count() == 5
    common.drop_written(out)
    assert not os.path.exists(folder.removeprefix("file://"))


TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet=st.sampled_from(list("aAbZé \t\n\x0b\x1c.漢")), max_size=25)), max_size=8)


@settings(max_examples=200, deadline=None)
@given(TEXTS, st.integers(1, 5))
def test_word_and_shingle_hashes(texts, size):
    import re

    data, starts = common.text_bytes(pa.array(texts, pa.string()))
    hashes, first, end, at = common.word_hashes(common.LOWER[data], starts)
    raw = data.tobytes()
    words = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for t in texts]
    assert [raw[a:b] for a, b in zip(first, end, strict=True)] == [w for row in words for w in row]
    low = [re.sub(rb"[A-Z]", lambda m: m[0].lower(), w) for row in words for w in row]
    assert len(set(low)) == len(set(hashes.tolist())) == len(set(zip(low, hashes.tolist(), strict=True)))
    shingles, where = common.shingle_hashes(hashes, at, size)
    own, k = [], 0
    for row in words:
        w = low[k : k + len(row)]
        k += len(row)
        own.append([tuple(w[i : i + size]) for i in range(len(w) - size + 1)] or ([tuple(w)] if w else []))
    assert np.diff(where).tolist() == [len(x) for x in own]
    flat = [x for row in own for x in row]
    assert len(set(flat)) == len(set(shingles.tolist())) == len(set(zip(flat, shingles.tolist(), strict=True)))


@pytest.mark.parametrize("most", [1, 10, 1000])
def test_text_batches_keep_all_rows(most):
    texts = ["a" * n for n in (0, 3, 30, 2, 0, 9)] + [None]
    batch = pa.RecordBatch.from_pydict({"text": pa.array(texts)})
    parts = list(common.text_batches(batch, most))
    assert [t for p in parts for t in p.column("text").to_pylist()] == texts
    assert all(p.num_rows == 1 or sum(len(t or "") for t in p.column("text").to_pylist()) <= most for p in parts)
    assert list(common.text_batches(batch.slice(0, 0))) == []


def test_sliced_columns():
    column = pa.array(["ab", None, "cd", "é"])
    data, starts = common.text_bytes(column.slice(1, 3))
    assert data.tobytes() == "cdé".encode() and starts.tolist() == [0, 0, 2, 4]
