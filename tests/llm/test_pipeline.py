"""Stages on a small corpus, each held against the model of its operator."""

import random

import corpus_pipeline
from presswork.llm.queries import QUERIES, SQL
from tests.llm.helpers import prose, words
from tests.llm.test_mixing import taken
from tests.llm.test_neardup import classes
from tests.llm.test_suffixes import model as repeats


def test_names():
    assert {f"op{n}" for n in range(1, 11)} == {q.split("_")[0] for q in QUERIES} and set(SQL) <= set(QUERIES)
    assert [s[0] for s in corpus_pipeline.STAGES] == ["quality_rules", "minhash_dedup", "suffix_dedup", "mix_sources", "sentencepiece"]


def test_stages(spark, tmp_path):
    rng = random.Random(12)
    passage = prose(rng, 120)
    texts = [". ".join(prose(rng, 14) for _ in range(8)) + "." for _ in range(40)]
    texts += [texts[0], texts[1].replace("a", "a", 1), texts[2] + " tail.", texts[3] + " " + passage + ".", texts[4][::-1] + " " + passage + "."]
    texts += ["*** " * 80 + prose(rng, 60), "too short", None, ""]
    rows = [(k, t, "en", f"s{k % 3}", len(t or "")) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        out[name] = docs.collect()
        if name != "sentencepiece":
            assert docs.columns == list(corpus_pipeline.COLUMNS)
    first = [(r["doc_id"], r["text"]) for r in out["quality_rules"]]
    assert {r[0] for r in first} == set(range(45))
    group = classes(first)
    second = sorted((r["doc_id"], r["text"]) for r in out["minhash_dedup"])
    assert second == sorted(r for r in first if group[r[0]] == r[0])
    lengths = {r[0]: r[1] - r[2] for r in repeats(second, 400)}
    third = [(r["doc_id"], r["source"], r["text"]) for r in out["suffix_dedup"]]
    assert {r[0]: len(r[2].encode()) for r in third} == lengths and sum(lengths.values()) < sum(len(t.encode()) for _, t in second)
    want, _, _ = taken(third)
    words_out = {}
    for r in out["mix_sources"]:
        words_out[r["doc_id"]] = words_out.get(r["doc_id"], 0) + len(words(r["text"]))
    assert words_out == {i: n for i, _, _, n in want if n}
    assert len(out["sentencepiece"]) == len(out["mix_sources"]) and all(r["round_trip"] for r in out["sentencepiece"])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(out["sentencepiece"])


def test_odd_rows(spark, tmp_path):
    """Repeated rows, several texts under one id, null ids and extra columns, by row counts."""
    rng = random.Random(18)
    a, b, c = (". ".join(prose(rng, 14) for _ in range(9)) + "." for _ in range(3))
    rows = [(1, a), (1, a), (5, a + " Tail."), (5, b), (None, c), (None, None), (7, None), (8, "")]
    docs = spark.createDataFrame([(i, t, None, None, 1, 0.5, "x") for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, p_quality double, size string")
    counts = []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, "").write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        counts.append(sorted((r["doc_id"] or 0) for r in docs.collect()))
    assert counts[0] == [0, 1, 1, 5, 5] and counts[1] == counts[2] == [0, 1, 5]
    assert set(counts[4]) <= {0, 1, 5} and all(r["round_trip"] for r in docs.collect())


def test_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, "").write.parquet(str(tmp_path / name))
        docs = spark.read.schema(stage(spark, docs, "").schema).parquet(str(tmp_path / name))
        assert docs.collect() == []
