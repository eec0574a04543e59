"""Line deduplication against brute force."""

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from sheetmill.llm import line_dedup as D


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute(docs, min_chars):
    seen, out = [], {}
    order = sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0))
    for doc_id, text in order:
        if text is None:
            out[doc_id] = (None, 0, 0)
            continue
        lines, stay = text.split("\n"), []
        for line in lines:
            x = line.strip()
            if not x:
                stay.append(line)
                continue
            if not any(x == y or (len(x) >= min_chars and len(y) >= min_chars and abs(len(x) - len(y)) <= 1 and distance(x, y) <= 1) for y in seen):
                stay.append(line)
            seen.append(x)
        out[doc_id] = ("\n".join(stay), len(lines), len(lines) - len(stay))
    return out


@pytest.mark.parametrize("broadcast", [1 << 20, -1])
def test_against_brute_force(spark, monkeypatch, broadcast):
    monkeypatch.setattr(D, "BROADCAST_LINES", broadcast)
    rng = np.random.default_rng(4)
    alphabet = np.array(list("abcdé ö"))
    base = ["".join(rng.choice(alphabet, rng.integers(9, 30))) for _ in range(40)]

    def near(line):
        k = int(rng.integers(0, len(line)))
        return rng.choice([line, line[:k] + "x" + line[k:], line[:k] + line[k + 1 :], line[:k] + "y" + line[k + 1 :], line[::-1], line[:k] + "zz" + line[k:]])

    docs = [(i, "\n".join(near(base[k]) for k in rng.integers(0, 40, 4))) for i in range(30)]
    docs += [(100, None), (101, ""), (102, "\n\n a \n"), (103, "a\nb\na"), (None, base[0]), (104, "w" * 200_000 + "\n" + "w" * 199_999)]
    df = spark.createDataFrame([(i, t, "k") for i, t in docs], "doc_id long, text string, line string").repartition(5)
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in D.dedup_lines(df, min_chars=11).collect()}
    want = brute([d for d in docs if d[0] != 104], 11)
    want[104] = ("w" * 200_000, 2, 1)
    assert got == want
    exact = {r.doc_id: r.n_removed for r in D.dedup_lines(df, max_edits=0).collect()}
    assert exact[103] == 2 and exact[104] == 0


def test_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, "one line of text"), (1, "one line of text"), (2, "one line of tex")], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in D.dedup_lines(df).collect()) == [(1, "one line of text"), (1, "one line of text"), (2, "")]
    assert D.dedup_lines(df.limit(0)).collect() == []


def test_rows_that_share_an_id(spark):
    rows = [(1, "first shared line of text"), (2, "unique line of another text"), (2, "first shared line of text"), (None, "nobody's own line"), (None, "nobody's own line, and more\nnobody's own line")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = D.dedup_lines(df).collect()
    assert sorted((r.doc_id, r.text, r.n_removed) for r in got if r.doc_id) == [(1, "first shared line of text", 0), (2, "", 1), (2, "unique line of another text", 0)]
    assert sum(r.n_removed for r in got if r.doc_id is None) == 1


@given(st.text("abc", max_size=7), st.text("abc", max_size=7))
def test_edit_check(a, b):
    assert D.within_one_edit(a, b) == (distance(a, b) <= 1)
