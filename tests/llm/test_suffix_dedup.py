"""Suffix-array deduplication against brute force."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sheetmill.llm import suffix_dedup as S


@settings(deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60))
def test_suffix_array(symbols):
    text = np.array(symbols, np.uint8)
    raw = text.tobytes()
    assert S.suffix_array(text, 1000).tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])


@settings(deadline=None)
@given(st.lists(st.integers(0, 1), min_size=1, max_size=90), st.integers(1, 30))
def test_common_prefixes(symbols, most):
    text = np.array(symbols, np.uint8)
    raw = text.tobytes()
    order = np.array([i for i in S.suffix_array(text, 1000) if i + most <= len(raw)], np.int64)

    def shared(a, b):
        return next((k for k in range(most) if raw[a + k] != raw[b + k]), most)

    assert S.common_prefixes(text, order, most).tolist() == [shared(a, b) for a, b in zip(order, order[1:])]


@settings(deadline=None)
@given(st.lists(st.integers(0, 9), min_size=8, max_size=80), st.integers(1, 7))
def test_sliding_least(values, w):
    x = np.array(values, np.uint64)
    want = [max(range(i, i + w), key=lambda j: (-values[j], j)) for i in range(len(values) - w + 1)]
    assert S._sliding_least(x, w).tolist() == want


def brute(texts, length):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        covered = np.zeros(len(r), bool)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                covered[i : i + length] = True
        kept = bytes(np.frombuffer(r, np.uint8)[~covered])
        out.append((len(r), int(covered.sum()), int((np.diff(np.concatenate(([0], covered.astype(np.int8)))) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [2000, 1])
def test_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(S, "HOT", hot)
    monkeypatch.setattr(S, "PART", 5)
    monkeypatch.setattr(S, "ARRAY_BYTES", 3000)
    monkeypatch.setattr(S, "RUN", 70)
    rng = np.random.default_rng(3)
    letters = np.array(list("abcdé "))
    passage = ["".join(rng.choice(letters, n)) for n in (30, 55, 90, 41)]

    def text():
        out = ""
        for _ in range(rng.integers(0, 5)):
            out += "".join(rng.choice(letters, rng.integers(0, 50))) + (passage[rng.integers(0, 4)] if rng.random() < 0.5 else "")
        return out

    texts = [text() for _ in range(60)]
    texts += [None, "", "a" * 300, "ab" * 200, texts[3], texts[3], "short", "x" * 39, "x" * 40, "x" * 41]
    docs = [(i, t) for i, t in enumerate(texts)] + [(7, texts[7]), (None, texts[5])]
    df = spark.createDataFrame([(i, t, b"") for i, t in docs], "doc_id long, text string, row binary").repartition(3)
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S.remove_repeats(df, length=40, gram=8).collect()), key=str)
    want = sorted(((d[0], *w) for d, w in zip(docs, brute([t for _, t in docs], 40))), key=str)
    assert got == want
    assert sum(w[2] for w in want) > 3000 and any(w[3] > 1 for w in want)


def test_a_shared_passage_is_split_over_keys(spark, monkeypatch):
    """Many documents share less than ``length`` bytes, with different text around: no key may gather them."""
    most, real = 20, S._compare

    def bounded(length):
        inner = real(length)

        def run(batches):
            def seen():
                count = Counter()
                for batch in batches:
                    count.update(batch.column("key").to_pylist())
                    if max(count.values()) > most:
                        raise ValueError("a key gathers too many parts")
                    yield batch

            yield from inner(seen())

        return run

    monkeypatch.setattr(S, "HOT", most)
    monkeypatch.setattr(S, "_compare", bounded)
    rng = np.random.default_rng(5)
    letters = np.array(list("abcdefgh "))
    word = lambda n: "".join(rng.choice(letters, n))
    texts = []
    for size, docs in ((260, 120), (345, 120), (398, 120)):
        passage, around = word(size), [word(n) for n in (90, 90)]
        texts += [word(250) + passage + word(250) for _ in range(docs)]
        texts += [word(150) + around[0] + passage + around[1] + word(150) for _ in range(3)]
        texts += [word(250) + passage + around[1][:k] + word(200) for k in (2, 3, 60, 60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S.remove_repeats(df).collect())
    want = [(i, *w) for i, w in enumerate(brute(texts, 400))]
    assert got == want and sum(w[2] > 0 for w in want) > 9


def test_copies_pass_through_suffix_arrays(spark, monkeypatch):
    """Equal digests alone mark nothing: with arrays that find no repeat, nothing goes."""
    text = " ".join(f"w{i}" for i in range(300))
    df = spark.createDataFrame([(1, text), (2, text), (3, "b " + text[:900])], "doc_id long, text string")
    assert {r.n_removed for r in S.remove_repeats(df).collect()} == {len(text), 900}
    monkeypatch.setattr(S, "_compare", lambda length: lambda batches: iter(()))
    assert {r.n_removed for r in S.remove_repeats(df).collect()} == {0}


def test_the_query_returns_what_is_left(spark, tmp_path):
    from sheetmill.llm.queries import op2_suffix_dedup

    text = "é" * 7 + " ".join(f"wörd{i}" for i in range(100))
    spark.createDataFrame([(1, "clean start " + text), (2, text + " clean end"), (3, "only"), (4, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in op2_suffix_dedup(spark, f"file://{tmp_path}").collect()}
    assert [rows[i].text for i in (1, 2, 3, 4)] == ["clean start ", " clean end", "only", ""]
    assert all(hashlib.sha256(r.text.encode()).hexdigest() == r.kept_sha256 for r in rows.values())


def test_empty_table(spark):
    assert S.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []
