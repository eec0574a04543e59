"""Token files: exact round trips, and random access against the whole."""

import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sheetmill.llm import token_files as T


def reader(raw):
    file = T.TokenFile(lambda at, n: raw[at : at + n])
    assert file.size == len(raw)
    return file


@settings(deadline=None)
@given(st.lists(st.lists(st.sampled_from([0, 1, 255, 256, 257, 50256, 65535, 65536, 1 << 24, (1 << 32) - 1]), max_size=40), max_size=40))
def test_round_trip(docs):
    ids = np.array([i for d in docs for i in d], np.uint32)
    raw = T.write_file(ids, np.array([len(d) for d in docs], np.int64), np.arange(len(docs)), np.zeros(len(docs), bool))
    file = reader(raw)
    assert [file.document(k).tolist() for k in range(len(docs))] == docs
    assert file.span(0, len(ids)).tolist() == ids.tolist()


def test_random_access():
    rng = np.random.default_rng(8)
    ids = rng.integers(0, 50257, 20_000).astype(np.uint32)
    ids[rng.random(len(ids)) < 0.6] %= 256
    file = reader(T.write_file(ids, np.array([5000, 0, 15_000]), np.array([3, 4, 9]), np.array([False, False, True])))
    at = rng.integers(0, len(ids), 300)
    assert [file.token(int(i)) for i in at] == ids[at].tolist()
    assert [len(file.document(k)) for k in range(3)] == [5000, 0, 15_000]
    assert file.doc_ids()[1].tolist() == [False, False, True]


def test_files_hold_the_documents_in_order(spark, tmp_path):
    rng = np.random.default_rng(2)
    docs = [(int(i), " ".join("w%d" % k for k in rng.integers(0, 90, 40))) for i in rng.permutation(200)]
    docs += [(300, None), (301, ""), (302, "é" * 70_000), (304, "a <|endoftext|> b<|endoftext|>"), (303, "same"), (303, "same"), (None, "no id")]
    df = spark.createDataFrame([(i, t, "u") for i, t in docs], "doc_id long, text string, uri string").repartition(4)
    files = T.write_tokens(df, f"file://{tmp_path}/tokens", file_tokens=700)
    got = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in T.read_tokens(files).collect()]
    library, at, want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0, []
    for i, text in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0)):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(got, key=lambda r: r[1]) == want
    assert T.read_tokens(T.write_tokens(df.limit(0), f"file://{tmp_path}/none")).collect() == []
