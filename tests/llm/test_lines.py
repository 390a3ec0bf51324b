"""Line dedup against brute force, and odd inputs."""

import hashlib
from collections import defaultdict

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tabweave.llm.lines import dedup_lines

SCHEMA = "doc_id long, text string, n_lines string"
WHITE = " \t\n\x0b\x0c\r"


def key(line):
    return line.strip(WHITE).translate({c: c + 32 for c in range(65, 91)})


def brute(rows, min_chars, min_docs):
    holders = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            holders[key(line)].add(i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (
            len(key(x)) >= min_chars and len(holders[key(x)]) >= min_docs
            and i != max(holders[key(x)]))]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


def run(spark, rows, **options):
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], SCHEMA).drop("n_lines")
    return sorted((r.doc_id, r.n_lines, r.n_dropped, r.text or "")
                  for r in dedup_lines(docs, **options).collect())


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 6), st.lists(
    st.sampled_from(["", " ", "abc", "ABC ", "\tÄbc\r", "äbc", "abcd\x85", "long ß line", "İx y"]),
    max_size=6).map("\n".join)), max_size=8))
def test_brute_force(spark, rows):
    assert run(spark, rows, min_chars=3, min_docs=2) == brute(rows, 3, 2)


def test_odd_rows(spark):
    line = "The same boiler plate line that everybody has."
    rows = [(i, f"{line}\nown {i}") for i in range(6)] + [(3, f"{line}\nown 3"), (9, None), (10, "")]
    got = run(spark, rows)
    assert got == brute(rows, 40, 5)
    assert [r for r in got if r[0] == 5] == [(5, 2, 0, f"{line}\nown 5")]
    assert (9, 1, 0, "") in got and len([r for r in got if r[0] == 3]) == 2


def test_null_ids_are_one_document_and_extra_columns_stay(spark):
    line = "x" * 40
    docs = spark.createDataFrame(
        [(None, line, "a"), (None, line, "b"), (1, line, "c"), (2, line, "d")],
        "doc_id long, text string, gone string")
    out = dedup_lines(docs, min_docs=3).orderBy("gone").collect()
    assert [(r.gone, r.n_dropped) for r in out] == [("a", 1), ("b", 1), ("c", 1), ("d", 0)]
    assert dedup_lines(docs.limit(0)).count() == 0
    assert dedup_lines(docs.withColumn("text", F.lit(None).cast("string"))).count() == 4


def test_very_long_text(spark):
    text = "\n".join(f"{'line ' * 10}{i % 7000}" for i in range(30_000))
    rows = [(i, text) for i in range(5)]
    got = run(spark, rows)
    assert [r[2] for r in got] == [30_000] * 4 + [0]
    assert hashlib.sha256(got[4][3].encode()).digest() == hashlib.sha256(text.encode()).digest()
