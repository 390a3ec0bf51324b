"""The pipeline against brute force, stage by stage, and the queries against their SQL."""

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from compare import differences, sql_engine
from tabweave.llm import queries, toxicity
from test_contamination import brute as contaminated
from test_lines import brute as deduped
from test_simhash import brute_components, brute_print

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, name):
    frame = queries.QUERIES[name](spark, "/root/testdata/sf0.01").toPandas()
    assert len(frame) > 0
    assert differences(frame, sql_engine("/root/testdata/sf0.01").sql(queries.SQL[name]).df()) is None


CONTRACT = {
    "op1": "doc_id n_lines n_dropped kept_sha256", "op2": "doc_id fingerprint component_id",
    "op3": "doc_id held_out n_tokens n_known train_tokens base_score score",
    "op4": "doc_id n_assign n_access n_hex base_sha256 spans", "op5": "vec_id n_links component_id kept",
    "op6": "doc_id held_out lang_pred score", "op7": "doc_id start n_tokens ids_crc32",
    "op8": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op9": "doc_id n_words n_hit n_items items_sha256 contaminated", "op10": "doc_id held_out score predicted",
    "op11": "doc_id keep_id group_size kept text_sha256",
    "op12": "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256",
    "op13": "vec_id cluster distance cluster_inertia inertia centroid_sha256",
}


@pytest.mark.parametrize("op", sorted(CONTRACT))
def test_contract_columns_and_rows(spark, op):
    name = next(n for n in entry.queries() if n.split("_")[0] == op)
    frame = entry.queries()[name](spark, FOLDER)
    table = "embeddings" if op in ("op5", "op13") else "documents"
    assert set(CONTRACT[op].split()) <= set(frame.columns)
    assert frame.count() == spark.read.parquet(f"{FOLDER}/{table}.parquet").count()


def test_every_stage(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "line dedup", "SimHash near-dedup", "benchmark decontamination",
                            "SentencePiece encoding and decoding"]

    def rows(df):
        return {r.doc_id: r for r in df.collect()}

    first = stages["toxicity"](spark, docs, FOLDER)
    scores = rows(docs.select("doc_id", toxicity.score(F.col("text"), toxicity.learn(docs, labels), docs).score.alias("s")))
    assert rows(first) == {i: r for i, r in rows(docs).items() if scores[i].s < 0.3}
    assert first.columns == docs.columns

    # The later stages are held against brute force on all documents, their own input.
    lines = rows(stages["line dedup"](spark, docs, FOLDER))
    expected = deduped([(i, r.text) for i, r in rows(docs).items()], 40, 5)
    assert [(i, r.text, r.n_chars) for i, r in sorted(lines.items())] == [
        (i, text, len(text)) for i, _, _, text in expected]

    prints = [(i, brute_print(r.text)) for i, r in rows(docs).items()]
    kept = {i for (i, _), c in zip(prints, brute_components(prints)) if i == c}
    assert set(rows(stages["SimHash near-dedup"](spark, docs, FOLDER))) == kept

    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    clean = {i for i, r in rows(docs).items() if not contaminated(r.text, items, 10)[1]}
    assert set(rows(stages["benchmark decontamination"](spark, docs, FOLDER))) == clean

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    last = rows(stages["SentencePiece encoding and decoding"](spark, docs, FOLDER))
    for i, r in rows(docs).items():
        assert last[i].ids == library.encode(r.text) and last[i].text == library.decode(last[i].ids)


def test_run_is_the_stages_in_turn(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, FOLDER)
    whole = corpus_pipeline.run(spark, FOLDER)
    assert whole.columns == docs.columns
    assert sorted(map(str, whole.collect())) == sorted(map(str, docs.collect()))


def test_odd_documents_pass_all_stages(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (None, "a b", "en", "s", 3),
            (4, "word " * 30_000, "de", None, 150_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[1:]:
        docs = stage(spark, docs, FOLDER)
    found = {(r.doc_id, r.n_tokens > 0) for r in docs.collect()}
    assert found == {(1, False), (None, True), (4, True)}
    for _, stage in corpus_pipeline.STAGES[1:]:
        empty = stage(spark, spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long"), FOLDER)
        assert empty.count() == 0
