"""Exact dedup: against brute force, over several batches, and on odd rows."""

import hashlib

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tabweave.llm.digest_index import DigestIndex, drop_copies, open_index
from tabweave.sources.scratch import fresh_path

SCHEMA = "doc_id long, text string, digest string, n int, batch int"
FOLD = {c: c + 32 for c in range(65, 91)}


def table(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], SCHEMA)


def brute(rows, seen):
    """Rows of a batch, and the texts that the index has afterwards."""
    last, n = {}, {}
    for i, t in rows:
        t = (t or "").translate(FOLD)
        last[t] = max(last.get(t, -(2**64)), -(2**63) - 1 if i is None else i)
        n[t] = n.get(t, 0) + 1
    new = {t: (None if i < -(2**63) else i) for t, i in last.items() if t not in seen}
    out = []
    for i, t in rows:
        t = (t or "").translate(FOLD)
        keep = new[t] if t in new else seen[t]
        out.append((i, keep, n[t], t in new and i == keep, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=repr), seen | new


def run(found):
    return sorted([(r.doc_id, r.keep_id, r.group_size, r.kept, bytes(r.digest).hex())
                   for r in found.collect()], key=repr)


texts = st.sampled_from([None, "", "a", "A", "\u00c4", "\u00e4", "a ", "aB\x00", "Ab\x00", "long \u0130 text"])
batches = st.lists(st.tuples(st.none() | st.integers(-2, 5), texts), max_size=9)


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(batches, min_size=1, max_size=3))
def test_batches_against_brute_force(spark, parts):
    index, seen = DigestIndex.open(spark, fresh_path(spark, "index"), 4), {}
    for k, rows in enumerate(parts):
        expected, seen = brute(rows, seen)
        assert run(index.add(table(spark, rows), f"part {k}")) == expected
    held = {bytes(r.digest).hex(): r.doc_id for r in index.rows().collect()}
    assert held == {hashlib.sha256(t.encode()).hexdigest(): i for t, i in seen.items()}
    assert index.rows().count() == len(seen)
    index.close()


def test_index_outlives_the_session_table(spark):
    path = fresh_path(spark, "index")
    index = DigestIndex.open(spark, path, 4)
    first = run(index.add(table(spark, [(1, "x"), (2, "X"), (3, "y")]), "one"))
    index.close()
    index = DigestIndex.open(spark, path, 4)
    assert run(index.add(table(spark, [(1, "x"), (2, "X"), (3, "y")]), "one")) == first  # run again
    assert [r[:4] for r in run(index.add(table(spark, [(9, "x"), (8, "z")]), "two"))] == [
        (8, 8, 1, True), (9, 2, 1, False)]
    small = index.compact(fresh_path(spark, "compact"))
    assert sorted(map(str, small.rows().collect())) == sorted(map(str, index.rows().collect()))
    left = drop_copies(table(spark, [(5, "Y"), (6, "w"), (7, "W"), (7, "W")]), small, "three")
    assert left.columns == ["doc_id", "text", "digest", "n", "batch"]
    assert [(r.doc_id, r.text, r.digest) for r in left.collect()] == [(7, "W", "x")] * 2


def test_index_is_joined_without_a_shuffle_of_it(spark):
    index = open_index(spark, fresh_path(spark, "index"), 100)
    index.add(table(spark, [(i, str(i)) for i in range(100)]), "one")
    new = spark.range(50).select(F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("digest"))
    joined = index.unseen(new)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("Exchange") == 1 and "Bucketed: true" in plan
    assert joined.count() == 0


def test_odd_rows(spark):
    index = open_index(spark, fresh_path(spark, "index"), 10)
    assert index.add(table(spark, []), "none").count() == 0
    long = "Line of a very long text\n" * 200_000
    rows = [(1, None), (2, ""), (None, ""), (3, long), (4, long.lower()), (4, long.lower()), (4, "other")]
    rows += [(100 + i, "Hot") for i in range(3000)]
    expected, _ = brute(rows, {})
    assert run(index.add(table(spark, rows), "all")) == expected
    nulls = spark.createDataFrame([(None, None)] * 2, "doc_id long, text string")
    index = open_index(spark, fresh_path(spark, "index"), 10)
    assert [tuple(r)[:4] for r in index.add(nulls, "nulls").collect()] == [(None, None, 2, True)] * 2
