import hashlib
import math
import random

import pytest

from presswork.llm import mixing
from tests.llm.helpers import ODD, prose, words


def targets(sizes, top=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        open_ = [s for s in names if s not in capped]
        if not open_:
            return {s: top * sizes[s] for s in names}
        level = (total - sum(top * sizes[s] for s in capped)) / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > top * sizes[s]}
        if not over:
            return {s: float(top * sizes[s]) if s in capped else level * weight[s] for s in names}
        capped |= over


def key(doc_id, size):
    h = hashlib.md5(("mix" + ("null" if doc_id is None else str(doc_id))).encode()).hexdigest()[:13]
    return -math.log((int(h, 16) + 0.5) / 16**13) / min(1.0, (size + 1) / 200)


def taken(rows):
    sizes = {}
    for _, s, t in rows:
        sizes[s] = sizes.get(s, 0) + len(words(t))
    goal, out = targets(sizes), []
    for s in sizes:
        own = sorted(((key(i, len(words(t))), i is not None, i or 0, len(words(t))) for i, x, t in rows if x == s))
        epochs = int(goal[s] // sizes[s]) if sizes[s] else 0
        rest, run = goal[s] - epochs * sizes[s], 0
        for _, has, i, n in own:
            out.append((i if has else None, n, sizes[s], (epochs + (run + n / 2 <= rest)) * n if n else 0))
            run += n
    return sorted(out, key=str), goal, sizes


def corpus():
    rng = random.Random(5)
    rows = [(k, rng.choice(["big"] * 5 + ["a", "b", "é", "z", None]), prose(rng, rng.randrange(0, 300))) for k in range(300)]
    return rows + [(900 + k, "odd", t) for k, t in enumerate(ODD)] + [(None, "a", "no id"), rows[0], (950, "empty", "")]


def test_mix(spark):
    rows = corpus()
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id bigint, source string, text string, taken string")
    got = mixing.mixed(df, keep_text=False).collect()
    want, goal, sizes = taken(rows)
    assert sorted(((r["doc_id"], r["size"], r["source_size"], r["taken"]) for r in got), key=str) == want
    for s, n in sizes.items():
        own = [r for r in got if r["source"] == s]
        assert own[0]["target"] == pytest.approx(goal[s], rel=1e-12)
        assert abs(sum(r["taken"] for r in own) - goal[s]) <= max(r["size"] for r in own)
        assert all(r["taken"] <= 3 * r["size"] for r in own)
    assert sum(goal.values()) == pytest.approx(sum(sizes.values()))
    mixed = mixing.mix(df).groupBy("doc_id", "text").count().collect()
    copies = {}
    for r in got:
        if r["copies"]:
            copies[r["doc_id"]] = copies.get(r["doc_id"], 0) + r["copies"]
    assert {r["doc_id"]: r["count"] for r in mixed} == copies


def test_empty(spark):
    assert mixing.mixed(spark.createDataFrame([], "doc_id bigint, source string, text string")).collect() == []


def test_heavier_documents_come_more_often(spark):
    df = spark.range(4000).selectExpr("id as doc_id", "'s' || id % 2 as source", "repeat('w ', 10) as text", "case when id % 4 < 2 then 4.0D else 1.0D end as q")
    got = mixing.mixed(df, weight=df["q"], weights=(0.5, 1.5)).where("source = 's0'").groupBy("q").agg({"taken": "sum"}).collect()
    by = {r["q"]: r["sum(taken)"] for r in got}
    assert by[4.0] > 1.8 * by[1.0]
