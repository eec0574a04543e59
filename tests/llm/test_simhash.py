"""SimHash against brute force."""

import numpy as np
import xxhash

from sheetmill.llm import simhash


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, fps, radius=2):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(ids)):
        groups.setdefault(find(i), []).append(ids[i])
    return {i: min(g) for g in groups.values() for i in g}


def test_whole_query_against_brute_force(spark):
    rng = np.random.default_rng(3)
    words = ["w%d" % i for i in range(300)]
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "One"), (4, "one"), (5, "a b"), (6, "A  B"), (7, "É é x"), (8, "x y z q")]
    for i in range(12):
        base = [words[k] for k in rng.integers(0, 300, 400)]
        for j in range(6):
            copy = list(base)
            for k in rng.integers(0, 400, j):
                copy[k] = "changed"
            rows.append((len(rows), " ".join(copy)))
    rows.append((len(rows), "long " * 300_000))
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, fp string")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(df).collect()}
    fps = [brute_fingerprint(t) for _, t in rows]
    comp = brute_components([i for i, _ in rows], fps)
    assert got == {i: (f"{f:016x}", comp[i]) for (i, _), f in zip(rows, fps)}


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(df).collect() == []


def test_cells_against_popcount():
    rng = np.random.default_rng(1)
    centre = rng.integers(0, 2**63, 5).astype(np.uint64)
    fps = np.unique(np.concatenate([c ^ (np.uint64(1) << rng.integers(0, 64, 60).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 60).astype(np.uint64)) for c in centre]))
    for radius in (0, 1, 2, 3, 5):
        comp = brute_components(list(range(len(fps))), [int(x) for x in fps], radius)
        want = [comp[i] for i in range(len(fps))]
        assert simhash.cell_roots(fps, radius, block=7).tolist() == want
        assert simhash.small_roots(fps, np.zeros(len(fps), np.int64), radius).tolist() == want


def test_blocks_are_abandoned(monkeypatch):
    """Blocks far from all that asks are left before their last plane, others are read to the end."""
    rng = np.random.default_rng(4)
    read = []
    real = simhash.far_lanes

    def counting(over, planes, differs, radius):
        seen = np.zeros(len(over), int)
        blank = (over == ~np.uint64(0)).all(axis=1)

        def counted(plane, blocks):
            seen[blocks] += 1
            return differs(plane, blocks)

        real(over, planes, counted, radius)
        done = (over == ~np.uint64(0)).all(axis=1)
        assert (seen[blank] == 0).all() and (seen[~done] == planes).all()
        read.append((seen[~blank].sum(), planes * (~blank).sum()))
        return over

    monkeypatch.setattr(simhash, "far_lanes", counting)
    fps = np.unique(rng.integers(0, 2**63, 900).astype(np.uint64) * np.uint64(2) + rng.integers(0, 2, 900).astype(np.uint64))
    assert simhash.cell_roots(fps, 2).tolist() == list(range(len(fps)))
    done, most = (sum(x) for x in zip(*read))
    assert done < 0.55 * most
    read.clear()
    cells = np.repeat(np.arange(len(fps) // 9 + 1), 9)[: len(fps)]
    assert simhash.small_roots(fps, cells, 2).tolist() == list(range(len(fps)))
    done, most = (sum(x) for x in zip(*read))
    assert done < 0.55 * most


def test_chunked_cells_join_the_same(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CELL", 16)
    rng = np.random.default_rng(2)
    fps = sorted({int(x) for x in (np.uint64(12345) ^ (np.uint64(1) << rng.integers(0, 63, 150).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 63, 150).astype(np.uint64)))})
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    from sheetmill.llm.components import components

    got = {r.node: r.root for r in components(simhash.fingerprint_links(df)).collect()}
    want = brute_components(fps, fps)
    assert {x: got.get(x, x) for x in fps} == want
