"""The registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabweave.llm import cell_clusters, contamination, digest_index, hidden_markov, language, lines, piece_merge, secret_scan, simhash, token_alignment, token_store, toxicity, vector_graph
from tabweave.llm.common import drop_at_exit, table
from tabweave.sources.scratch import fresh_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(function: Callable[[SparkSession, str], DataFrame]):
    QUERIES[function.__name__] = function
    return function


def narrow(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    return table(spark, folder, name).select(*columns)


@query
def op1_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = lines.dedup_lines(narrow(spark, folder, "documents", "doc_id", "text"))
    digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    return docs.select("doc_id", "n_lines", "n_dropped", digest.alias("kept_sha256"))


SQL["op1_line_dedup"] = r"""
WITH exploded AS (
  SELECT doc_id, pos, line,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
        FROM documents)),
shared AS (
  SELECT key, max(doc_id) AS last FROM exploded WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT e.*, s.key IS NOT NULL AND e.doc_id <> s.last AS gone
  FROM exploded e LEFT JOIN shared s ON e.key = s.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


@query
def op2_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_copies(narrow(spark, folder, "documents", "doc_id", "text"))
    return found.select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op3_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    return hidden_markov.score_documents(narrow(spark, folder, "documents", "doc_id", "text"))


@query
def op4_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = secret_scan.find_secrets(narrow(spark, folder, "documents", "doc_id", "text"))

    def count(kind: int):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    base = F.filter("spans", lambda s: s["kind"] < 3)
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(secret_scan.spans_text(base).cast("binary"), 256).alias("base_sha256"),
        secret_scan.spans_text(F.col("spans")).alias("spans"))


@query
def op5_embedding_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return vector_graph.near_duplicates(narrow(spark, folder, "embeddings", "vec_id", "embedding"))


@query
def op6_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return language.identify(narrow(spark, folder, "documents", "doc_id", "text", "lang"))


@query
def op7_token_store(spark: SparkSession, folder: str) -> DataFrame:
    store = fresh_path(spark, "tokens")
    files = token_store.write_tokens(
        narrow(spark, folder, "documents", "doc_id", "text"), store,
        public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    drop_at_exit(spark, store)
    return token_store.read_tokens(spark, store, files)


@query
def op8_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    ids = narrow(spark, folder, "documents", "doc_id", "text").select(
        "doc_id", piece_merge.encode(F.col("text"), model).alias("ids"))
    return ids.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(piece_merge.decode(F.col("ids"), model).cast("binary"), 256).alias("decoded_sha256"))


@query
def op9_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = contamination.scan_documents(
        narrow(spark, folder, "documents", "doc_id", "text"),
        narrow(spark, folder, "benchmark", "item_id", "text"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"))


SQL["op9_benchmark_decontamination"] = r"""
WITH folded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item_words AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n,
         array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i
        FROM item_words WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM windows),
places AS (
  SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, greatest(len(w) - n + 1, 0) + 1)) AS i
        FROM folded, lengths)),
found AS (SELECT p.doc_id, p.n, p.i, x.item_id FROM places p JOIN windows x USING (n, win)),
hit AS (SELECT doc_id, count(DISTINCT place) AS n_hit
        FROM (SELECT doc_id, unnest(range(i, i + n)) AS place FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS joined
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id)
SELECT f.doc_id, len(f.w) AS n_words, coalesce(h.n_hit, 0) AS n_hit,
       coalesce(i.n_items, 0) AS n_items, sha256(coalesce(i.joined, '')) AS items_sha256,
       coalesce(h.n_hit, 0) > 0 AS contaminated
FROM folded f LEFT JOIN hit h USING (doc_id) LEFT JOIN items i USING (doc_id)
"""


@query
def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.rate(
        narrow(spark, folder, "documents", "doc_id", "text"),
        narrow(spark, folder, "labels", "doc_id", "toxic"), windows=False,
    ).select("doc_id", "held_out", "score", "predicted")


@query
def op11_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = narrow(spark, folder, "documents", "doc_id", "text")
    path = fresh_path(spark, "digest-index")
    index = digest_index.open_index(spark, path, docs.count())
    drop_at_exit(spark, path)
    found = index.add(docs, "documents")
    index.close()
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


SQL["op11_exact_dedup"] = r"""
WITH hashed AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                  'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256 FROM hashed
"""


@query
def op12_tokenizer_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return token_alignment.align_documents(
        narrow(spark, folder, "documents", "doc_id", "text"),
        public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op13_centroid_clustering(spark: SparkSession, folder: str) -> DataFrame:
    return cell_clusters.cluster(narrow(spark, folder, "embeddings", "vec_id", "embedding"))


def _clustering_sql(rounds: int) -> str:
    """Assignments and centroids of all rounds, one after the other, over (r, i, x) components."""
    steps = """
WITH numbered AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, embedding FROM embeddings),
long AS MATERIALIZED (
  SELECT r, unnest(range(64)) AS i, CAST(unnest(embedding) AS DOUBLE) AS x
  FROM numbered WHERE len(embedding) = 64),
v AS MATERIALIZED (
  SELECT r, i, CAST(floor(1024 * x) AS BIGINT) AS x FROM long WHERE r IN (
    SELECT r FROM long GROUP BY r HAVING count(*) FILTER (WHERE isfinite(x)) = 64)),
firsts AS (
  SELECT r, row_number() OVER (ORDER BY sha256('3:' || CAST(vec_id AS VARCHAR)), r) - 1 AS k
  FROM numbered WHERE r IN (SELECT r FROM v) ORDER BY k LIMIT 8),
c0 AS MATERIALIZED (SELECT k, i, x AS c FROM firsts JOIN v USING (r))"""
    assign = """,
a{n} AS MATERIALIZED (
  SELECT r, CAST(min(d * 8 + k) % 8 AS BIGINT) AS k, CAST(min(d * 8 + k) // 8 AS BIGINT) AS d FROM (
    SELECT r, k, sum((x - c) * (x - c)) AS d FROM v JOIN c{n} USING (i) GROUP BY r, k) GROUP BY r)"""
    move = """,
c{m} AS MATERIALIZED (
  SELECT k, i, coalesce(m, c) AS c FROM c{n} LEFT JOIN (
    SELECT k, i, CAST((sum(x) - (sum(x) % count(*) + count(*)) % count(*)) // count(*) AS BIGINT) AS m
    FROM v JOIN a{n} USING (r) GROUP BY k, i) USING (k, i))"""
    for n in range(rounds):
        steps += (assign + move).format(n=n, m=n + 1)
    return steps + assign.format(n=rounds) + """
SELECT vec_id, CAST(k AS INTEGER) AS cluster, d AS distance,
       CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia, h AS centroid_sha256
FROM a{n} JOIN numbered USING (r) JOIN (
  SELECT k, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY i)) AS h FROM c{n} GROUP BY k) USING (k)
""".format(n=rounds)


SQL["op13_centroid_clustering"] = _clustering_sql(10)
