"""Directly addressable codes: round trips, random access, and the library's ids."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tabweave.llm import token_store
from tabweave.llm.token_store import TokenFile, read_tokens, to_levels, write_tokens
from tabweave.sources.scratch import fresh_path

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1), st.just(255), st.just(256)),
                max_size=1500), st.data())
def test_codes(ids, data):
    ids = np.array(ids, np.uint32)
    cut = data.draw(st.integers(0, len(ids)))
    stored = TokenFile(np.array([7, 9]), np.array([0, cut, len(ids)]), to_levels(ids))
    found = TokenFile.from_bytes(stored.to_bytes())
    assert found.document(0).tolist() == ids[:cut].tolist()
    assert found.document(1).tolist() == ids[cut:].tolist()
    places = np.random.default_rng(1).permutation(len(ids))
    assert found.tokens(places).tolist() == ids[places].tolist()


def test_long_codes_and_wrong_files():
    ids = np.random.default_rng(2).integers(0, 70_000, 200_000).astype(np.uint32)
    found = TokenFile.from_bytes(
        TokenFile(np.array([1]), np.array([0, len(ids)]), to_levels(ids)).to_bytes())
    assert (found.document(0) == ids).all() and len(found.levels) == 3
    assert found.tokens(np.array([199_999, 0, 512, 511])).tolist() == ids[[199_999, 0, 512, 511]].tolist()
    with pytest.raises(ValueError):
        TokenFile.from_bytes(b"something else")


TEXT = st.lists(st.sampled_from(
    ["Hello", "'s", "it's", " ", "\n", "\xa0", " ", "\x1c", "é", "É", "123", "日本", "🙂!", "<|endoftext|>",
     "<|startoftext|>", "<|", "İ", "Σ", "\x00", "ß", "ﬁ"]), max_size=30).map("".join)


@settings(max_examples=250, deadline=None)
@given(texts=st.lists(st.one_of(TEXT, st.text(max_size=40)), min_size=1, max_size=4))
def test_library(library, texts):
    coder = token_store.tokenizer(PATH)
    ids, sizes = coder.encode([t.encode() for t in texts])
    parts = np.split(ids, np.cumsum(sizes)[:-1])
    assert [p.tolist() for p in parts] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_files(spark, library, monkeypatch):
    rows = [(i * 3 % 50, f"Some words {i} <|endoftext|>\nand it's {'x' * i}", "a") for i in range(50)]
    rows += [(None, "nobody's", "b"), (200, None, "c"), (201, "", "d"), (7, "again", "e"), (300, "long " * 100_000, "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string").repartition(5)
    folder = fresh_path(spark, "tokens")
    files = write_tokens(docs, folder, PATH, 1)
    found = read_tokens(spark, folder, files, with_ids=True).collect()
    expected = sorted(((-2**63 if i is None else i), tuple(library.encode(t or "", add_special_tokens=False).ids + [1]))
                      for i, t, _ in rows)
    assert sorted(((-2**63 if r.doc_id is None else r.doc_id), tuple(r.ids)) for r in found) == expected
    at = 0
    for r in sorted(found, key=lambda r: r.start):
        assert r.start == at and r.n_tokens == len(r.ids)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        at += r.n_tokens
    in_order = [r.doc_id for r in sorted(found, key=lambda r: r.start)]
    assert in_order[0] is None and in_order[1:] == sorted(in_order[1:])
    empty = fresh_path(spark, "tokens")
    assert read_tokens(spark, empty, write_tokens(docs.limit(0), empty, PATH, 1)).count() == 0
