import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sparkqueue.llm.token_counts import UnitLengths, table_of, token_counts
from sparkqueue.llm.token_files import UnitIds, token_files

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = st.text(alphabet=st.sampled_from(list("ab Z.,'s\n\t\r\x0b\x1c\x1d\x85\xa0 　é漢😀1²-<|>▁\x00")), max_size=40)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BYTES)


@pytest.fixture(scope="module")
def units():
    return UnitIds(BYTES, "<u2")


@pytest.fixture(scope="module")
def pieces():
    return UnitLengths(PIECES)


@settings(max_examples=400, deadline=None)
@given(st.one_of(ODD, st.text(max_size=40)))
def test_unit_ids_equal_the_library(library, units, text):
    assert units.splits
    expected = [library.encode(t, add_special_tokens=False).ids for t in (text, "", "a b.", text * 2)]
    ids, many = units.encode(pa.array([text, None, "a b.", text * 2]))
    assert ids.tolist() == [i for x in expected for i in x] and many.tolist() == [len(x) for x in expected]
    ids, many = units.encode(pa.array([text, None, "a b.", text * 2]), 2)
    assert ids.tolist() == [i for x in expected for i in [*x, 2]] and many.tolist() == [len(x) + 1 for x in expected]


@settings(max_examples=400, deadline=None)
@given(st.one_of(ODD, st.text(max_size=40)))
def test_unit_lengths_equal_the_library(pieces, text):
    assert pieces.splits
    table = table_of([" a", "b", "\n", " ab"], pieces)
    for known in (None, table):
        assert pieces.counts(pa.array([text, "", None, text + " ab\n a"]), known).tolist() == [len(pieces.model.encode(t)) for t in (text, "", "", text + " ab\n a")]


def test_a_full_cache_and_small_groups(monkeypatch, library):
    from sparkqueue.llm import units as module

    monkeypatch.setattr(module, "AT_ONCE", 3)
    own, lengths = UnitIds(BYTES, "<u2", most=5), UnitLengths(PIECES, most=5)
    texts = ["one two three, four five. six", "", "six  seven\n\n eight nine ten one two", "ünïcödé 漢字 x"]
    for _ in range(2):
        assert own.encode(pa.array(texts))[0].tolist() == [i for t in texts for i in library.encode(t, add_special_tokens=False).ids]
        assert lengths.counts(pa.array(texts)).tolist() == [len(lengths.model.encode(t)) for t in texts]
    assert len(own.known.hashes) <= 5 and len(lengths.cache.hashes) <= 5


@pytest.mark.parametrize("which", ["awkward", "sample", "no_rows"])
def test_token_files(request, library, which):
    docs = request.getfixturevalue(which)
    got = token_files(docs, BYTES, end_id=2).collect()
    rows = sorted(((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in docs.collect()))
    ids = [library.encode(t, add_special_tokens=False).ids + [2] for *_, t in rows]
    starts = np.cumsum([0, *map(len, ids)])[:-1].tolist()
    expected = [(i if there else None, s, len(x), zlib.crc32(np.asarray(x, "<u4").tobytes())) for (there, i, _), x, s in zip(rows, ids, starts, strict=True)]
    key = lambda r: (r[1], r[2])
    assert sorted(map(tuple, got), key=key) == sorted(expected, key=key)


@pytest.mark.parametrize("which", ["awkward", "sample", "no_rows"])
def test_token_counts(request, which):
    docs = request.getfixturevalue(which)
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    key = lambda r: (r[0] is not None, r[0] or 0, r[2])
    n = lambda t: len(model.encode(t or ""))
    expected = [(r.doc_id, len((r.text or "").encode()), n(r.text), n(r.text) > 4096) for r in docs.collect()]
    for size in (1 << 16, 8):
        assert sorted(map(tuple, token_counts(docs, PIECES, table_size=size).collect()), key=key) == sorted(expected, key=key)
