"""Mixing against a plain statement of the contract, and against its SQL."""

import hashlib
import math
import os

import duckdb
import pytest

from sheetmill.llm import mixing as M
from sheetmill.llm import queries as Q

DIR = "/root/testdata/sf0.001"


def brute(rows, weights=(1, 2, 3), cap=3):
    size = [len((t or "").encode().split()) for _, t, _ in rows]
    sources = sorted({s for _, _, s in rows}, key=lambda s: (s is None, s or ""))
    total = {s: sum(n for n, r in zip(size, rows) if r[2] == s) for s in sources}
    weight = {s: weights[k % len(weights)] for k, s in enumerate(sources)}
    target, free, left = {}, set(sources), sum(size)
    while True:
        share = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        over = [s for s in free if share[s] > cap * total[s]]
        if not over:
            break
        for s in over:
            target[s] = float(cap * total[s])
            left -= cap * total[s]
            free.discard(s)
    target |= share
    taken = {}
    key = lambda r: hashlib.md5(f"{r[0]}:{hashlib.md5((r[1] or '').encode()).hexdigest()}".encode()).hexdigest()
    for s in sources:
        budget = math.floor(target[s] + 1e-9)
        epochs = budget // total[s] if total[s] else 0
        rest = budget - epochs * total[s]
        for n, r in sorted(((n, r) for n, r in zip(size, rows) if r[2] == s), key=lambda x: (key(x[1]), x[1][0])):
            cut = max(0, min(n, rest))
            taken[r[0]] = (n, total[s], target[s], epochs * n + cut)
            rest -= n
    return taken


@pytest.mark.parametrize("digits", [1, 3])
def test_against_brute_force(spark, monkeypatch, digits):
    monkeypatch.setattr(M, "BUCKET_DIGITS", digits)
    rows = [(i, "w " * (i * 37 % 91), ["big", "mid", "tiny", None][min(3, i % 11 % 5)]) for i in range(300)]
    rows += [(300, None, "big"), (301, "", "empty"), (302, "\x0b\t a\x1cb é c", "mid"), (303, "long " * 200_000, "mid")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, source string, size int, bucket string").repartition(7)
    got = {r.doc_id: (r.size, r.source_size, r.target, r.taken) for r in M.mix_sources(df).collect()}
    want = brute(rows)
    assert {i: (a, b, d) for i, (a, b, _, d) in got.items()} == {i: (a, b, d) for i, (a, b, _, d) in want.items()}
    assert all(abs(got[i][2] - want[i][2]) <= 1e-6 * max(1, want[i][2]) for i in want)
    assert all(t <= 3 * n for n, _, _, t in got.values())


def test_capped_sources_share_their_excess(spark):
    rows = [(1, "a " * 1000, "a"), (2, "b " * 10, "b"), (3, "c " * 20, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.source: (r.target, r.taken) for r in M.mix_sources(df).collect()}
    assert got == {"a": (940.0, 940), "b": (30.0, 30), "c": (60.0, 60)}
    mixed = M.mixed_documents(df).collect()
    assert sorted((r.doc_id, len(r.text.split())) for r in mixed) == [(1, 940), (2, 10), (2, 10), (2, 10), (3, 20), (3, 20), (3, 20)]


def test_empty_repeated_and_wordless(spark):
    schema = "doc_id long, text string, source string"
    assert M.mix_sources(spark.createDataFrame([], schema)).collect() == []
    assert [r.taken for r in M.mix_sources(spark.createDataFrame([(1, " ", "a"), (2, None, None)], schema)).collect()] == [0, 0]
    twice = M.mix_sources(spark.createDataFrame([(1, "a b c", "a")] * 2, schema)).collect()
    assert sum(r.taken for r in twice) == 6


def test_rows_without_an_id_spread_over_the_buckets(spark):
    rows = [(None, f"w{i} " * (i % 5 + 1), "a") for i in range(400)] + [(7, "x " * i, "b") for i in range(1, 200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = M.mix_sources(df)
    assert sum(r.taken for r in found.collect()) == sum(len(t.split()) for _, t, _ in rows)
    # The window inside a bucket sees few rows of one id.
    import hashlib
    from collections import Counter

    buckets = Counter(hashlib.md5(f":{hashlib.md5(t.encode()).hexdigest()}".encode()).hexdigest()[: M.BUCKET_DIGITS] for i, t, _ in rows if i is None)
    assert max(buckets.values()) < 9


def test_no_python_on_the_main_path(spark):
    plan = M.mix_sources(spark.createDataFrame([(1, "a", "b")], "doc_id long, text string, source string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
def test_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{DIR}/documents.parquet')")
    want = con.execute(Q.oracle_sql()["op9_mixing"]).fetchall()
    got = [tuple(r) for r in Q.queries()["op9_mixing"](spark, DIR).collect()]
    assert sorted(got) == sorted(want)
