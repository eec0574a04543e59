"""Packing: windows against brute force, and every token in exactly one piece."""

import zlib
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import public_tokenizers
from sheetmill.llm import packing as P
from sheetmill.llm.tokens import byte_encoder, word_encoder

ODD = ["", " ", "  a", "a  b\n\n c", "don't I'LL", "naïve café ÉÈ", "é x", "İstanbul ΑΣ ΟΔΟΣ", "<|endoftext|> x", "日本語 text", "١٢٣ 12 3a", "𝔘nicode 😀😀!", "\x00\x01 \x1c\x1d \x85", "a\r\n\tb ", "ﬁ ǅ ß ẞ", "word, word. word.. (word)", "A.B,c;d"]


SPECIAL = ["a <|endoftext|> b", "<|endoftext|>", "<|startoftext|>x<|endoftext|>", "x <|startoftext|>  y", "<|endoftext|><|endoftext|> z", "<|ENDOFTEXT|> <|end", "a<|endoftext|>\nb \u00c9<|startoftext|>", "<| endoftext|>"]


def library(file):
    """The library's own tokenizer, with nothing set."""
    return Tokenizer.from_file(public_tokenizers.path(file))


def test_ids_are_those_of_the_library():
    texts = ODD + ["one two\nThree four.\nFive, six\n\nseven.\n eight \nnine\n", "\nA\nb", "a\nb c.\nd, e\nf!", "x\u00a0\ny"] + [a + "\n" + b for a in ODD for b in ODD] + [a + " " + b for a in ODD for b in ODD] + [a + " \n" for a in ODD]
    texts += SPECIAL + [a + b for a in ODD for b in SPECIAL] + [b + a for a in ODD for b in SPECIAL]
    for encoder, file in ((byte_encoder(), "byte_bpe_50k.json"), (word_encoder(), "word_bpe_49k.json")):
        want = [e.ids for e in library(file).encode_batch(texts, add_special_tokens=False)]
        assert [x.tolist() for x in encoder.encode(texts)] == want


@settings(deadline=None)
@given(st.lists(st.tuples(st.integers(1, 6), st.integers(0, 9)), min_size=1, max_size=9))
def test_windows_cost_least(steps):
    cuts = np.cumsum([a for a, _ in steps])
    penalty = np.array([b for _, b in steps])
    size = 9

    def cost(ends):
        starts = [0, *ends[:-1]]
        return sum(size - (b - a) for a, b in zip(starts, ends)) + sum(int(penalty[np.searchsorted(cuts, b)]) for b in ends)

    best = min(
        cost(ends)
        for m in range(1 << (len(cuts) - 1))
        for ends in [[int(c) for k, c in enumerate(cuts[:-1]) if m >> k & 1] + [int(cuts[-1])]]
        if all(b - a <= size for a, b in zip([0, *ends[:-1]], ends))
    )
    found = P.best_windows(cuts, penalty, size)
    assert cost(found) == best and all(b - a <= size for a, b in zip([0, *found[:-1]], found))


def check_pieces(rows, docs, size=P.SIZE):
    encoder = library("word_bpe_49k.json")
    want = defaultdict(list)
    for doc_id, text in docs:
        want[doc_id].append([*encoder.encode(text or "", add_special_tokens=False).ids, 1])
    by_sequence, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append((r.offset, r.length))
        by_doc[r.doc_id].append(r)
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= size
    assert set(by_doc) == set(want)
    for doc_id, texts in want.items():
        if len(texts) > 1:
            continue
        (ids,), at = texts, 0
        for r in sorted(by_doc[doc_id], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    lengths = [sum(n for _, n in p) for p in by_sequence.values()]
    return sum(0 if n & (n - 1) == 0 else size - n for n in lengths) / sum(lengths)


def test_pieces(spark, monkeypatch):
    monkeypatch.setattr(P, "BLOCK", 5000)
    rng = np.random.default_rng(6)
    docs = [(i, " ".join("w%d%s" % (k, "." if k % 11 == 0 else "") for k in rng.integers(0, 500, rng.integers(0, 900)))) for i in range(80)]
    docs += [(200, None), (201, ""), (None, "no id."), (202, "x" * 50_000), (203, "one two " * 20_000), (204, "twice"), (204, "twice"), (205, "one <|endoftext|> two<|startoftext|>")]
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, start int").repartition(3)
    assert check_pieces(P.pack_documents(df).collect(), docs) < 0.02
    ids = P.pack_documents(df, with_ids=True).where("doc_id = 204").collect()
    # Both rows are there whole, wherever windows cut them.
    assert sorted(t for r in ids for t in r.ids) == sorted(2 * [*word_encoder().encode(["twice"])[0].tolist(), 1])
    assert all(len(r.ids) == r.length for r in ids)
    assert P.pack_documents(df.limit(0)).collect() == []
