"""Merge rounds against the library, texts of all kinds."""

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tabweave.llm import piece_merge

PATH = public_tokenizers.path("piece_bpe_32k.model")
PARTS = [" ", "  ", "▁", "a", "aa", "the", "\n", "é", "日本", "🙂", "\x00", "ing", "\t", "0", "00",
         "---", "====", "ab", "́", "<s>", "<0x0A>", "&nbsp;", "ization", "!!!!", "\xa0"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def check(library, texts):
    coder = piece_merge.encoder(PATH)
    ids, sizes = coder.encode(texts)
    for part, text in zip(np.split(ids, np.cumsum(sizes)[:-1]), texts):
        expected = library.encode(text)
        assert part.tolist() == expected
        assert coder.decode(part).decode() == library.decode(expected)


@settings(max_examples=300, deadline=None)
@given(texts=st.lists(st.lists(st.sampled_from(PARTS), max_size=50).map("".join), min_size=1, max_size=4))
def test_parts(library, texts):
    check(library, texts)


@settings(max_examples=200, deadline=None)
@given(texts=st.lists(st.text(max_size=80), min_size=1, max_size=4))
def test_any_text(library, texts):
    check(library, texts)


def test_long_words_and_runs(library):
    check(library, ["a" * 50_000, " " * 3000, "日本語" * 700, "=" * 1000, "-" * 299, "aaaa" * 70,
                    "word " * 200_000])


def test_rounds_equal_one_by_one():
    pieces = piece_merge.Pieces(PATH)
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("aeinrst-=0▁ "), rng.integers(1, 40))) for _ in range(3000)]
    flat, counts = pieces.merge_all(words)
    for word, part in zip(words, np.split(flat, np.cumsum(counts)[:-1])):
        assert part.tolist() == pieces.merge_one(pieces.symbol_of[list(map(ord, word))].tolist())


def test_memory_of_words_is_bounded(library, monkeypatch):
    monkeypatch.setattr(piece_merge, "MAX_WORDS", 50)
    coder = piece_merge.Encoder(PATH)
    for n in range(20):
        texts = [f"word{n}x{i} and more" for i in range(40)]
        ids, _ = coder.encode(texts)
        assert ids.tolist() == [i for t in texts for i in library.encode(t)]
    assert len(coder.memory.known) < 200


def test_table_and_odd_rows(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(None, "x y"), (-1, None), (-2, ""), (-2, "")], docs.schema)
    rows = docs.unionAll(odd).select("doc_id", "text", piece_merge.encode(F.col("text"), PATH).alias("ids"))
    rows = rows.withColumn("out", piece_merge.decode(F.col("ids"), PATH)).collect()
    assert len(rows) == docs.count() + 4
    for r in rows:
        assert r.ids == library.encode(r.text or "") and r.out == library.decode(r.ids)
    nothing = docs.limit(0).select(piece_merge.encode(F.col("text"), PATH).alias("ids"))
    assert nothing.count() == 0
