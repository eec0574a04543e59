"""The pipeline's stages, each against a plain statement of what it does."""

from collections import Counter

import corpus_pipeline as C
import numpy as np
from test_line_dedup import brute
from test_packing import check_pieces
from test_simhash import brute_components, brute_fingerprint

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, score string"


def documents(spark):
    rng = np.random.default_rng(9)
    words = {"en": ["the", "of", "tion", "and"], "de": ["sch", "ung", "der", "ein"]}
    rows = []
    for i in range(60):
        lang = "en" if i % 3 else "de"
        lines = [" ".join("".join(rng.choice(words[lang], 3)) for _ in range(12)) for _ in range(4)]
        if i % 10 == 9:
            lines = rows[-1][1].split("\n")[:3] + lines[:1]
        rows.append((i, "\n".join(lines), lang, f"s{i % 4}" if i % 7 else None, None, "k"))
    rows += [(60, None, "en", "s1", 0, "k"), (61, "12 34", "en", "s1", 5, "k"), (62, rows[0][1], "de", "s2", 3, "k")]
    rows = [(*r[:4], len(r[1] or ""), r[5]) for r in rows]
    return spark.createDataFrame(rows, COLUMNS), rows


def test_stages(spark):
    docs, rows = documents(spark)
    one = C.identify_language(spark, docs, "").cache()
    assert one.columns == docs.columns and {r.doc_id for r in one.collect()} == {r[0] for r in rows} - {60, 61}
    two = C.drop_repeated_lines(spark, one, "").cache()
    want = brute([(r.doc_id, r.text) for r in one.collect()], 12)
    assert two.columns == docs.columns
    assert {r.doc_id: (r.text, r.n_chars) for r in two.collect()} == {i: (t, len(t)) for i, (t, _, _) in want.items()}
    three = C.drop_near_duplicates(spark, two, "").cache()
    before = [(r.doc_id, r.text) for r in two.collect()]
    comp = brute_components([i for i, _ in before], [brute_fingerprint(t) for _, t in before])
    assert sorted(r.doc_id for r in three.collect()) == sorted({i for i in comp.values()})
    four = C.mix_to_weights(spark, three, "").cache()
    taken = {r.doc_id: r.taken for r in C.mixing.mix_sources(three).collect()}
    counted = Counter()
    texts = {r.doc_id: r.text for r in three.collect()}
    for r in four.collect():
        counted[r.doc_id] += len(r.text.split())
        assert texts[r.doc_id].startswith(r.text) and r.n_chars == len(r.text)
    assert four.columns == docs.columns and counted == {i: n for i, n in taken.items() if n}
    five = C.pack_sequences(spark, four, "").collect()
    check_pieces(five, [(r.doc_id, r.text) for r in four.collect()])
    assert all(len(r.ids) == r.length for r in five)


def test_near_duplicate_stage_keeps_one_of_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "a b c d e"), (1, "a b c d e"), (2, "a b c d e"), (3, "x y z w v u t")], "doc_id long, text string")
    assert sorted(r.doc_id for r in C.drop_near_duplicates(spark, docs, "").collect()) == [1, 3]


def test_empty_table(spark):
    docs, _ = documents(spark)
    out = docs.limit(0)
    for _, stage in C.STAGES:
        out = stage(spark, out, "")
    assert out.collect() == []
