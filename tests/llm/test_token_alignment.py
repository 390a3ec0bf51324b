"""Cross-tokenizer alignment against the libraries and a token-by-token brute force."""

import hashlib
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tabweave.llm import token_alignment as alignment
from tabweave.llm.queries import QUERIES

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, pairs string, row int"
ODD = [None, "", " ", "\n", "a", "<|endoftext|> and <s> </s> <unk>", "under\u2581score", "caf\u00e9 \U0001f600 \u65e5\u672c\u8a9e",
       "  two  spaces \t tab\r\n\r\nline ", "don't WE'LL 1234567 ?!...", "\x00\x01 \x85 \u00a0 \u3000 x", "\ufb01 \u212b \u0041\u030a",
       "word " * 300, " " * 1500 + "end", "x" * 700, "\ufffd", "\u2581"]


def brute(rows):
    """Rows as the contract words them, from the libraries' own ids."""
    a_of, b_of = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a_of.encode_special_tokens = True
    letters = alignment.byte_letters()
    spelled, counts, out = [], Counter(), []
    for _, text in rows:
        a = a_of.encode(" " + (text or ""), add_special_tokens=False).ids
        b = b_of.encode(text or "")
        one = [bytes(letters[c] for c in a_of.id_to_token(i)) for i in a]
        two = [bytes([int(b_of.id_to_piece(i)[3:5], 16)]) if b_of.is_byte(i)
               else b_of.id_to_piece(i).replace("\u2581", " ").encode() for i in b]
        whole = (" " + (text or "")).encode()
        if not text or b"".join(one) != whole or b"".join(two) != whole:
            a = b = one = two = []
        ends = [[sum(map(len, x[:n + 1])) for n in range(len(x))] for x in (one, two)]
        groups, links, p, q = [], [], 0, 0
        for n, end in enumerate(ends[0]):
            if end in ends[1]:
                m = ends[1].index(end)
                groups.append(",".join(map(str, a[p:n + 1])) + "|" + ",".join(map(str, b[q:m + 1])))
                links.append((a[n], b[m]))
                p, q = n + 1, m + 1
        spelled.append((len(a), len(b), groups, links))
        counts.update(links)
    most = Counter()
    for (_, b), c in counts.items():
        most[b] = max(most[b], c)
    for (i, _), (n_a, n_b, groups, links) in zip(rows, spelled):
        out.append((i, n_a, n_b, len(groups), len(links), sum(counts[x] == most[x[1]] for x in links),
                    sum(counts[x] for x in links), hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "",
                    ";".join(groups)))
    return sorted(out, key=repr)


def run(spark, rows, **options):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA).repartition(3)
    found = alignment.align_documents(docs, A, B, groups=True, **options)
    return sorted(map(tuple, found.collect()), key=repr)


@pytest.mark.parametrize("local", [alignment.LOCAL_PAIRS, 30, 0])
def test_brute_force(spark, local):
    prose = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) < 1500")
    rows = [(r.doc_id, r.text) for r in prose.limit(60).collect()]
    rows += [(1000 + i, t) for i, t in enumerate(ODD)] + [(1005, ODD[5]), (None, "no id"), (1005, ODD[5])]
    assert run(spark, rows, local_pairs=local) == brute(rows)


def test_windows_are_remembered_and_forgotten(monkeypatch):
    texts = [t.encode() for t in ODD if t] + [f"word{i} and more {i}".encode() for i in range(200)]
    one = alignment.Aligner(A, B)
    first = one.rows(texts)
    held = len(one.windows)
    assert held > 200 and one.rows(texts)["groups"] == first["groups"] and len(one.windows) == held
    assert len(one.counts) == len(one.texts) == held and one.counts.sum() == len(one.flat)
    monkeypatch.setattr(alignment, "MAX_WINDOWS", 10)
    assert one.rows(texts[:40])["groups"] == first["groups"][:40] and len(one.windows) < held
    assert one.rows([])["groups"] == [] and one.rows([b""])["n_groups"].tolist() == [0]


def test_ids_equal_the_library():
    side, library = alignment.ByteTokens(A), Tokenizer.from_file(A)
    library.encode_special_tokens = True
    assert side.fast is not None
    texts = [t for t in ODD if t] + ["\n " * 3000, "a" * 5000, "1" * 3000, "!?" * 2000]
    assert side.encode(texts) == [library.encode(" " + t, add_special_tokens=False).ids for t in texts]


def test_odd_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert alignment.align_documents(empty, A, B).count() == 0
    nulls = spark.createDataFrame([(None, None, None, None)] * 2, SCHEMA)
    assert [tuple(r) for r in alignment.align_documents(nulls, A, B).collect()] == [(None, 0, 0, 0, 0, 0, 0, "")] * 2
    long = [(1, "some words of a long text. " * 60_000), (2, "some words of a long text. " * 60_000)]
    found = run(spark, long)
    assert found[0][1:] == found[1][1:] and found[0][3] > 300_000


def test_query_over_whole_table(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("length(text) < 4000")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    whole = {r.doc_id: r for r in QUERIES["op12_tokenizer_alignment"](spark, folder).collect()}
    assert len(whole) == spark.read.parquet(f"{folder}/documents.parquet").count()
    for expected in brute(rows):  # groups need one text alone; corpus counts are held above
        r = whole[expected[0]]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.groups_sha256) == (*expected[1:5], expected[7])
