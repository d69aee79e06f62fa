import hashlib
import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from presswork.llm import suffixes
from tests.llm.helpers import ODD, prose


def model(rows, length):
    data = [(t or "").encode() for _, t in rows]
    count = Counter(b[k : k + length] for b in data for k in range(len(b) - length + 1))
    out = []
    for (i, _), b in zip(rows, data, strict=True):
        gone = [False] * len(b)
        for k in range(len(b) - length + 1):
            if count[b[k : k + length]] > 1:
                gone[k : k + length] = [True] * length
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


def check(spark, rows, length):
    df = spark.createDataFrame([(*r, "z", 1) for r in rows], "doc_id bigint, text string, n_bytes string, mark int")
    got = suffixes.without_repeats(df, length).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=str) == model(rows, length)


def corpus(rng, length):
    parts = [prose(rng, 30) for _ in range(6)] + ["é" * length, "ab" * length]
    rows = [(k, "".join(rng.choice([prose(rng, rng.randrange(1, 40)), rng.choice(parts), rng.choice(parts)[rng.randrange(60) :]]) for _ in range(rng.randrange(1, 6)))) for k in range(70)]
    return rows + [(200 + k, t) for k, t in enumerate(ODD)] + [(None, parts[0]), (None, prose(rng, 90)), rows[3], (5, "other text under a known id " + parts[1])]


def test_against_brute_force(spark):
    check(spark, corpus(random.Random(1), 80), 80)
    check(spark, corpus(random.Random(2), 33), 33)


def test_pieces_and_flushes(spark, monkeypatch):
    """Long texts in pieces, runs written early, several buckets."""
    rng = random.Random(3)
    block = prose(rng, 500)
    rows = [(1, prose(rng, 800) + block + prose(rng, 20)), (2, block[7:] + prose(rng, 900) + block[:1500]), (3, "q" * 2000)]
    for name, value in (("PIECE", 1000), ("HELD", 5000), ("BUCKET_ENTRIES", 3)):
        monkeypatch.setattr(suffixes, name, value)
    check(spark, rows, 100)


@pytest.mark.parametrize("held", [3000, 1 << 20])
def test_hot_groups(spark, monkeypatch, held):
    """Passages in many surroundings and copies beyond the bound of a group, in one flush and in many."""
    rng = random.Random(4)
    passage, copy = prose(rng, 60), prose(rng, 50)
    rows = [(k, prose(rng, rng.randrange(0, 30)) + passage[rng.choice([0, 0, 3, 90]) :] + prose(rng, rng.randrange(0, 30))) for k in range(40)] + [(100 + k, copy) for k in range(12)]
    rows += [(k, None) for k in (200, 201)] + [(300, copy[1:])]
    for name, value in (("HELD", held), ("HOT_ENTRIES", 4), ("BUCKET_ENTRIES", 3)):
        monkeypatch.setattr(suffixes, name, value)
    check(spark, rows, 80)
    check(spark, rows, 81)


def test_text_and_empty(spark):
    rows = [(1, "start " + "long repeated passage " * 5 + "end"), (2, "long repeated passage " * 5)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = {r["doc_id"]: r["text"] for r in suffixes.deduplicated(df, 60).collect()}
    assert out == {1: "startend", 2: ""}
    assert suffixes.without_repeats(df.limit(0)).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.binary(max_size=6).map(lambda b: bytes(x % 3 for x in b)), max_size=12), max_size=6))
def test_merge(runs):
    """Loser tree over front-coded runs gives sorted order and true common prefixes."""
    runs = [sorted(r) for r in runs]
    coded = [suffixes.front_coded([(s, b"", 0, 0, k, False) for k, s in enumerate(r)]) for r in runs]
    got = [(s, h) for s, h, _ in suffixes.merged([suffixes.read_run(c) for c in coded])]
    want = sorted(s for r in runs for s in r)
    assert [s for s, _ in got] == want
    for k in range(1, len(want)):
        a, b = want[k - 1], want[k]
        assert got[k][1] == next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
