"""Fingerprints: recovered digests against set differences, and the query against brute force."""

import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from sheetmill.llm import fingerprints as P


@settings(deadline=None)
@given(st.lists(st.tuples(st.sets(st.integers(0, 400)), st.sets(st.integers(0, 400))), min_size=1, max_size=6))
def test_peeling_recovers_the_difference(pairs):
    def flat(k):
        values = [P._mix(np.array([x], np.uint64), 5)[0] for p in pairs for x in sorted(p[k])]
        return np.array(values, np.uint64), np.repeat(np.arange(len(pairs)), [len(p[k]) for p in pairs])

    key, pair, side = P.differences(*flat(0), *flat(1), len(pairs))
    got = sorted(zip(pair.tolist(), key.tolist(), side.tolist()))
    hashed = lambda x: int(P._mix(np.array([x], np.uint64), 5)[0])
    want = sorted([(i, hashed(x), 1) for i, (a, b) in enumerate(pairs) for x in a - b] + [(i, hashed(x), -1) for i, (a, b) in enumerate(pairs) for x in b - a])
    assert got == want


def test_pieces_are_local():
    rng = np.random.default_rng(1)
    words = [b"w%d" % k for k in rng.integers(0, 1000, 2000)]
    a = b" ".join(words)
    b = b" ".join(words[:700] + [b"inserted"] + words[700:])
    digest, edges = P.piece_digests([a, b, a, b"", b"\n\n"])
    assert P.likeness(digest, edges, np.array([0, 0, 3, 3]), np.array([1, 2, 3, 0])).tolist()[1:] == [1.0, 1.0, 0.0]
    assert P.likeness(digest, edges, np.array([0]), np.array([1]))[0] > 0.98


def test_equal_texts_are_cut_alike_behind_any_text():
    for text in (b"It is so", b"A b c and more", b" x", b"abcd e"):
        alone = P.piece_digests([text])[0].tolist()
        texts = [text]
        for k in range(256):
            texts += [b"before" + bytes([k]), text]
        digest, edges = P.piece_digests(texts)
        assert all(digest[edges[i] : edges[i + 1]].tolist() == alone for i in range(0, len(texts), 2))


def test_stored_fingerprints_are_peeled():
    lines = [b"line %d\n" % k for k in range(300)]
    for changed, small in ((2, True), (120, False)):
        digest, edges = P.piece_digests([b"".join(lines), b"".join(lines[changed:]) + b"new\n"])
        a, b = (set(digest[edges[k] : edges[k + 1]].tolist()) for k in (0, 1))
        cells = P.CELLS
        while (got := P.stored_differences(*P.fingerprint_strings(digest, edges, cells))) is None:
            cells *= P.LARGER
        assert got == (sorted(a - b), sorted(b - a)) and len(a - b) == changed and (cells == P.CELLS) == small


def test_query_against_brute_force(spark):
    rng = np.random.default_rng(7)
    docs = [(int(i) * 3, "\n".join(" ".join("wört%d" % k for k in rng.integers(0, 50, 12)) for _ in range(rng.integers(0, 9)))) for i in rng.permutation(150)]
    docs += [(1000, None), (1001, ""), (1002, "é" * 100_001), (1003, docs[5][1]), (1004, docs[5][1]), (1005, "abc"), (None, "no id at all")]
    df = spark.createDataFrame([(i, t, 5) for i, t in docs], "doc_id long, text string, part int").repartition(6)
    got = {r.doc_id: r for r in P.compare_versions(df).collect()}
    ordered = sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0))
    assert len(got) == len(docs)
    sets = lambda t: set(P.piece_digests([t.encode()])[0].tolist())
    for (i, text), (_, following) in zip(ordered, ordered[1:] + ordered[:1]):
        text, following = text or "", following or ""
        changed = P.edited(text, following)
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(changed.encode()).hexdigest())
        for near, other in ((r.near_edited, changed), (r.near_next, following)):
            a, b = sets(text), sets(other)
            assert near == (len(a & b) / len(a | b) if a | b else 1.0)
    assert got[1003].fingerprint == got[1004].fingerprint != got[1005].fingerprint
    assert got[1003].near_next == 1.0


def test_one_row_and_none(spark):
    one = spark.createDataFrame([(4, "abcdefgh")], "doc_id long, text string")
    (r,) = P.compare_versions(one).collect()
    assert r.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest() and r.near_next == 1.0
    assert P.compare_versions(one.limit(0)).collect() == []
