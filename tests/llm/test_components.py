"""Components against union by hand; slices and buffers of texts."""

import numpy as np
import pyarrow as pa

from sheetmill.llm import common
from sheetmill.llm.components import components, local_roots


def brute(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(k, k + 1) for k in range(500, 560)] + [(1000, k) for k in range(1001, 1100)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = brute([e for e in edges if e[0] != e[1]])
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_local_roots():
    left, right = np.array([3, 5, 1]), np.array([1, 3, 0])
    assert local_roots(7, left, right).tolist() == [0, 0, 2, 0, 4, 0, 6]


def test_text_buffers():
    texts = ["é", None, "", "abc", "x" * 50]
    for kind in (pa.string(), pa.large_string()):
        batch = pa.RecordBatch.from_pydict({"text": pa.array(["skip", *texts], kind)}).slice(1)
        data, edges = common.utf8_buffer(batch.column("text"))
        assert [bytes(data[a:b]).decode() for a, b in zip(edges, edges[1:])] == [t or "" for t in texts]
        parts = list(common.slices([batch], "text", 4))
        assert [t for p in parts for t in p.column("text").to_pylist()] == texts and len(parts) > 2
    assert list(common.slices([batch.slice(0, 0)], "text")) == []
