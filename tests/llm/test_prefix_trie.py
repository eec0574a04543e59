"""The prefix trie against a plain dictionary of prefixes."""

import hashlib
import random
import zlib

import pytest

from sheetmill.llm import prefix_trie as T

SCHEMA = "conv_id long, turn long, role string, text string, c string, name string"


def remainder(c):
    return abs(c) % 5 * (1 if c >= 0 else -1)


def brute(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    for c, turns in own.items():
        turns.sort(key=lambda t: (*t[:3], hashlib.sha256(f"{len(t[2])}:{t[2]}{t[3]}".encode()).digest()))
        own[c] = [t[2:] for t in turns]
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        whole[c] = own.get(c - remainder(c), [])[:h] + turns[h:]
    members = {}
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = {}
    for path, found in members.items():
        below = [p for p in members if p[: len(path)] == path]
        children = {p for p in below if len(p) == len(path) + 1}
        ends = sorted(c for c in found if len(whole[c]) == len(path))
        out[min(found), len(path)] = (
            min(members[path[:-1]]) if path else None,
            len(found),
            len(children),
            sum(not any(q[:-1] == p for q in below if q) for p in below),
            sum((len(members[p]) - 1) * len(p[-1][1].encode()) for p in below if p),
            hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        )
    return out


def got(spark, rows):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(3)
    found = T.prefix_trie(df).collect()
    out = {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in found}
    assert len(out) == len(found)
    return out


def test_against_a_dictionary(spark):
    rng = random.Random(4)
    rows = [(c, t, rng.choice(["user", "bot", None]), rng.choice(["a", "bb", "é", None])) for c in rng.sample(range(-20, 60), 60) for t in range(rng.randint(1, 9))]
    rows += [(200 + k, t, "user", "same") for k in range(25) for t in range(5)]  # copies
    rows += [(3, None, "user", "null turn"), (3, None, None, None), (3, 1, "user", "tie"), (3, 1, "user", "tie"), (None, 0, "user", "no id"), (None, None, None, None)]
    assert got(spark, rows) == brute(rows)


def test_long_conversations_and_stretches(spark, monkeypatch):
    monkeypatch.setattr(T, "STRETCH", 4)
    monkeypatch.setattr(T, "ENDS", 2)
    long = [(c, t, "user", f"turn {t % 7}") for c in (0, 1, 2, 5) for t in range(37 + c)]
    rows = [*long, (10, 0, "user", "z" * 300_000), (11, 0, "user", "")]
    assert got(spark, rows) == brute(rows)


def test_empty(spark):
    assert got(spark, []) == {} and got(spark, [(None, 1, "user", "x")]) == {}
    # Turnless once rebuilt: every turn is within the first h, and there is no base.
    c = next(c for c in range(1, 99) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 1)
    assert got(spark, [(c, 0, "user", "x")]) == brute([(c, 0, "user", "x")])
    assert len(got(spark, [(c, 0, "user", "x")])) == 1


@pytest.mark.parametrize("text", ["|", ":"])
def test_role_and_text_do_not_run_together(spark, text):
    rows = [(5, 0, f"a{text}", "b"), (10, 0, "a", f"{text}b")]
    assert got(spark, rows) == brute(rows)


def test_a_round_is_a_few_jobs(spark):
    rows = [(c, t, "user", f"turn {t % 7}", "x", "y") for c in (0, 1, 2, 5) for t in range(37 + c)]
    df = spark.createDataFrame(rows, SCHEMA)
    spark.sparkContext.setJobGroup("trie", "trie")
    assert T.prefix_trie(df).count() > 37
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("trie")) < 80
