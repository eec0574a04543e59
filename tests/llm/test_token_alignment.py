"""Token alignment against whole texts, encoded by the libraries, and plain loops."""

import hashlib
import os
import random
from collections import Counter

import pytest

from sheetmill.llm import token_alignment as T


def brute(texts):
    a, b, a_bytes, b_bytes = T._tokenizers()
    groups, held = [], []
    for text in texts:
        groups.append(None)
        if not text:
            continue
        x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        if b"".join(a_bytes[i] for i in x) != (" " + text).encode() or b"".join(b_bytes[i] for i in y) != (" " + text).encode():
            continue
        ends, at = {}, 0
        for k, i in enumerate(y):
            at += len(b_bytes[i])
            ends[at] = k
        groups[-1], at, i0, j0 = [], 0, 0, 0
        for k, i in enumerate(x):
            at += len(a_bytes[i])
            if at in ends:
                groups[-1].append((x[i0 : k + 1], y[j0 : ends[at] + 1]))
                i0, j0 = k + 1, ends[at] + 1
    count = Counter()
    for g in groups:
        held.append(Counter((p, q) for x, y in g or [] for p in x for q in y))
        count.update(held[-1].keys())
    most = Counter()
    for (p, _), n in count.items():
        most[p] = max(most[p], n)
    out = []
    for g, h in zip(groups, held, strict=True):
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g or [])
        out.append((
            sum(len(x) for x, _ in g or []), sum(len(y) for _, y in g or []), len(g or []), sum(h.values()),
            sum(n for p, n in h.items() if count[p] == most[p[0]]), sum(n * count[p] for p, n in h.items()),
            hashlib.sha256(text.encode()).hexdigest() if g is not None else "",
        ))
    return out


def got(spark, texts, parts=3):
    df = spark.createDataFrame([(i, t, "w", "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, word string, block string, n_a long").repartition(parts)
    rows = {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in T.align_tokens(df).collect()}
    return [rows[i] for i in range(len(texts))]


ODD = [
    "", None, " ", "   ", "a", "  two  spaces ", "line\nend \n next", "tab\t x y", "<|endoftext|> <s> </s> <unk> <0x41>", "it's we'll 'S 2024 3,5", "▁ mark", "a▁b",
    "café été café 中文字 рус", "\U0001f600\U0001f468‍\U0001f469 ok", "nul\x00 x", "\r\n  \r\n", "x" * 3000, "word " * 2000, "　wide   sep", "\x1c a \x85 b", "á b ​ c", "﻿bom",
]


def test_odd_texts_and_repeats(spark):
    texts = ODD + ["the cat sat", "the cat sat", "The cat"]
    assert got(spark, texts) == brute(texts)


def test_random_texts_in_small_blocks(spark, monkeypatch):
    rng = random.Random(8)
    pool = ["the", "of", "é", "\n", "\t", "  ", " ", "'s", "1", "ing", "中", "-", "́", "Zq", " "]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randrange(40))) for _ in range(300)]
    monkeypatch.setattr(T, "BLOCK", 200)
    assert got(spark, texts) == brute(texts)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert T.align_tokens(df).collect() == []
    assert got(spark, [None, ""]) == [(0, 0, 0, 0, 0, 0, "")] * 2


def test_ids_of_any_kind(spark):
    df = spark.createDataFrame([(None, "a b"), ("x", "a b"), ("x", None)], "doc_id string, text string")
    rows = sorted(T.align_tokens(df).collect(), key=lambda r: (r.doc_id or "", r.n_a))
    assert [(r.doc_id, r.n_a, r.count_sum) for r in rows] == [(None, 2, 4), ("x", 0, 0), ("x", 2, 4)]


def test_the_test_tables(spark):
    folder = "/root/testdata/sf0.001"
    if not os.path.exists(f"{folder}/documents.parquet"):
        pytest.skip("no test tables")
    texts = [r.text for r in spark.read.parquet(f"{folder}/documents.parquet").select("text").collect()]
    assert got(spark, texts) == brute(texts)
