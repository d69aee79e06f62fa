import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from presswork.core.numbering import numbered
from presswork.core.storage import shared_dir
from presswork.functions import content, planning
from presswork.functions.sql import register_sql
from presswork.functions.text import tokenize
from presswork.operators import fingerprints, places, series, summaries, terms
from presswork.operators.graph import components
from presswork.streaming import scored_counts, windowed_counts


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


def test_terms(spark):
    d = docs(spark, "hello hello world world world", "b a b a", "", None)
    assert [tuple(r) for r in terms.top_words(d, 2, min_length=1).orderBy("doc_id", "rank").collect()] == [(0, 1, "world", 3), (0, 2, "hello", 2), (1, 1, "b", 2), (1, 2, "a", 2)]
    assert {(r["word"], r["count"]) for r in terms.word_frequency(d, min_length=1).where("doc_id = 1").collect()} == {("a", 2), ("b", 2)}
    tf = {r["term"]: r["tf"] for r in terms.term_frequency(terms.occurrences(docs(spark, "apple banana apple"), tokenize(F.col("text")))).collect()}
    assert tf == {"apple": 1.0, "banana": 0.75}
    df = spark.createDataFrame([("cat", 10), ("sat", 20), ("mat", 50), ("happi", 5)], "term string, df bigint")
    got = terms.keywords(docs(spark, "The cat sat on the mat. The cat is happy."), df, 100).orderBy("rank").collect()
    assert [r["word"] for r in got][:2] == ["cat", "happi"]
    v = terms.vocabulary(docs(spark, "bb aa", "cc aa dd"), tokenize(F.col("text"))).orderBy("index").collect()
    assert [(r["term"], r["index"]) for r in v] == [("bb", 0), ("aa", 1), ("cc", 2), ("dd", 3)]
    assert {r["term"]: r["df"] for r in terms.document_frequency(docs(spark, "cats cat", "cat dog")).collect()} == {"cat": 2, "dog": 1}
    s = terms.similar_documents(docs(spark, "red fox", "red fox", "blue whale fox"), docs(spark, "x"), 5).collect()
    assert [(r["query_id"], r["rank"], r["doc_id"]) for r in s] == [(0, 1, 1), (0, 2, 2)]


def simhash_model(text: str) -> str:
    import re

    votes = [0] * 64
    for t in re.sub(r"[^\w\s]", " ", (text or "").lower(), flags=re.A).split():
        if len(t) >= 2:
            h = 14695981039346656037
            for c in t:
                h = (h ^ ord(c)) * 1099511628211 % (1 << 64)
            for b in range(64):
                votes[b] += 1 if h >> b & 1 else -1
    return f"{sum(1 << b for b in range(64) if votes[b] > 0):016x}"


def test_simhash(spark):
    texts = ["The quick brown fox jumps over the lazy dog", "A.", "", None, "Breaking news: Major earthquake hits city", "Breaking news: Major earthquake hits town", "aa bb"]
    got = {r["doc_id"]: r["simhash"] for r in fingerprints.simhash(docs(spark, *texts)).collect()}
    assert got == {k: simhash_model(t) for k, t in enumerate(texts)}
    assert got[1] == "0" * 16


def greedy_model(rows, t):
    rows = sorted(rows, key=lambda r: (-r[2].timestamp(), r[3]))
    groups, taken = [], set()
    for r in rows:
        if r[0] in taken:
            continue
        members = [x for x in rows if x[0] not in taken and (x is r or bin(int(x[1], 16) ^ int(r[1], 16)).count("1") <= t)]
        taken |= {x[0] for x in members}
        apart = [bin(int(x[1], 16) ^ int(r[1], 16)).count("1") for x in members[1:]]
        groups.append((f"cluster-{len(groups) + 1}", r[0], [x[0] for x in members], sum(apart) / len(apart) if apart else 0.0))
    return groups


@pytest.mark.parametrize(("t", "settled"), [(0, 500_000), (3, 500_000), (3, 0)])
def test_group_articles(spark, monkeypatch, t, settled):
    """Components in the kernel, and all of them in rounds."""
    monkeypatch.setattr(fingerprints, "SETTLED", settled)
    rng = random.Random(t)
    rows = [(f"a{k}", f"{rng.choice([0, 0xFF]) ^ sum(1 << rng.randrange(12) for _ in range(3)):016x}", dt.datetime(2024, 1, 1 + rng.randrange(4)), k) for k in range(60)]
    df = spark.createDataFrame(rows, "id string, simHash string, publishedAt timestamp, ordinal bigint")
    got = [tuple(r) for r in fingerprints.group_articles(df, t).collect()]
    assert sorted(got) == sorted(greedy_model(rows, t))
    pairs = {(r["id_a"], r["id_b"]) for r in fingerprints.near_duplicates(df.select(F.col("ordinal").alias("doc_id"), F.col("simHash").alias("simhash")), t).collect()}
    assert pairs == {(a[3], b[3]) for a in rows for b in rows if a[3] < b[3] and bin(int(a[1], 16) ^ int(b[1], 16)).count("1") <= t}
    assert fingerprints.group_articles(df.limit(0), t).collect() == []


def test_trends(spark):
    long = [(t, t.upper(), f"2024-01-{10 - k:02d}", c) for t, cs in {"topic1": [100, 10, 11, 10, 10, 11], "topic2": [10, 10, 11, 10, 10, 11], "short": [5, 1, 1], "flat": [4, 3, 3, 3]}.items() for k, c in enumerate(cs)]
    df = spark.createDataFrame(long, "topicId string, topicName string, date string, count bigint")
    got = {r["topicId"]: r for r in series.detect_trends(df).collect()}
    assert set(got) == {"topic1", "topic2", "flat"}
    assert got["topic1"]["isTrending"] and not got["topic2"]["isTrending"]
    assert (got["flat"]["zScore"], got["flat"]["percentChange"], got["flat"]["baselineStdDev"]) == (10.0, 33, 0.0)
    assert {r["topicId"] for r in series.filter_trending(series.detect_trends(df)).collect()} == {"topic1", "flat"}
    one = spark.range(1).select(series.trend_score(F.lit(20.0), F.lit(10.0), F.lit(2.0)).alias("t")).first()["t"]
    assert (one["zScore"], one["percentChange"], one["isTrending"]) == (5.0, 100, True)


def test_baselines(spark):
    """Large counts keep their variance; the sliding baseline sees earlier dates only."""
    big = 10**9
    rows = [("t", "T", f"2024-01-{10 + k}", big + x) for k, x in enumerate((3, 1, 2, 4, 9))]
    df = spark.createDataFrame(rows, "topicId string, topicName string, date string, count bigint")
    got = series.detect_trends(df).first()
    assert (got["baselineMean"], got["baselineStdDev"]) == (big + 2.5, 1.12)
    b = df.where("count < 1000000009").agg(series.baseline(F.col("count")).alias("b")).first()["b"]
    assert (b["mean"], b["stddev"]) == (big + 2.5, 1.12)
    small = spark.createDataFrame([("t", f"d{k}", x) for k, x in enumerate((3, 1, 2, 4))], "topicId string, date string, count bigint")
    got = [(r["baselineMean"], r["baselineStdDev"]) for r in series.sliding_baseline(small, 2).orderBy("date").collect()]
    assert got == [(0.0, 0.0), (3.0, 0.0), (2.0, 1.0), (1.5, 0.5)]
    order = [("a", "A", f"d{k}", x) for k, x in enumerate((1, 2, 3, 1))] + [("b", "B", f"d{k}", x) for k, x in enumerate((1, 2, 3, 9))]
    assert [r["topicId"] for r in series.detect_trends(spark.createDataFrame(order, df.schema)).collect()] == ["b", "a"]


def test_null_series(spark):
    df = spark.createDataFrame([(None, "d1", 1.0), (None, "d2", 3.0)], "series string, date string, value double")
    assert series.detect_anomalies(df).count() == 2 and series.anomaly_report(df).first()["mean"] == 2.0


def test_components_and_numbers(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(140)] + [(300 + k, 301 + k) for k in range(40)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        p, q = find(a), find(b)
        root[max(p, q)] = min(p, q)
    want = {x: find(x) for e in edges if e[0] != e[1] for x in e}
    assert {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()} == want
    assert components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []
    df = spark.range(500).select(((F.col("id") * 7919) % 1009).alias("x"))
    got = numbered(df, "x", "k").collect()
    assert [r["x"] for r in sorted(got, key=lambda r: r["k"])] == sorted(r["x"] for r in got) and {r["k"] for r in got} == set(range(500))


def test_ranked_urls_and_low_confidence(spark):
    rows = [("u1", None, None, 0.1, 1, False), ("u2", None, None, 1.0, 1, True), ("u0", None, None, 0.1, 1, False)]
    df = spark.createDataFrame(rows, "url string, lastVisited timestamp, lastChanged timestamp, topicRelevance double, hubDepth int, isHub boolean")
    got = planning.rank_urls(df).collect()
    assert [r["url"] for r in got] == ["u2", "u0", "u1"] and "Is a hub page" in got[0]["reasons"]
    scored = spark.createDataFrame([("a", 0.39), ("b", 0.4), ("c", 0.1)], "id string, score double")
    assert [r["id"] for r in content.filter_low_confidence(scored).collect()] == ["c", "a"]


def test_sql_functions(spark):
    assert register_sql(spark) == ["simhash_of", "textrank_scores"]
    r = spark.sql("select simhash_of(split('aa bb cc', ' ')) as h, simhash_of(cast(null as array<string>)) as z, textrank_scores(array(array('x'))) as t").first()
    assert (r["h"], r["z"], r["t"]) == (simhash_model("aa bb cc"), "0" * 16, [1.0])


def test_shared_folder_on_clusters(tmp_path):
    """Without a shared folder a cluster is an error, not a folder of one machine."""

    class Conf:
        def get(self, *_):
            return None

        def set(self, *_):
            pass

    class Session:
        conf = Conf()

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(RuntimeError):
        shared_dir(Session())
    Session.sparkContext.master = "local[4]"
    assert shared_dir(Session()).startswith("file://")


def test_anomalies(spark):
    rows = [("s", f"2024-01-0{k}", 10.0) for k in range(1, 7)] + [("s", "2024-01-07", 100.0), ("one", "2024-01-01", 5.0)]
    df = spark.createDataFrame(rows, "series string, date string, value double")
    odd = series.detect_anomalies(df).where("isAnomaly").collect()
    assert [(r["value"], r["direction"]) for r in odd] == [(100.0, "above")]
    report = {r["series"]: r for r in series.anomaly_report(df).collect()}
    assert report["one"]["anomalies"] == [] and report["one"]["mean"] == 0 and len(report["s"]["anomalies"]) == 7
    history = spark.createDataFrame([("s", float(v)) for v in (10, 12, 11, 10, 11)] + [("flat", 3.0), ("flat", 3.0)], "series string, value double")
    values = spark.createDataFrame([("s", 11.0), ("s", 100.0), ("new", 1.0), ("flat", 4.0)], "series string, value double")
    got = {(r["series"], r["value"]): r["isAnomalous"] for r in series.value_anomalous(values, history).collect()}
    assert got == {("s", 11.0): False, ("s", 100.0): True, ("new", 1.0): False, ("flat", 4.0): True}


def test_textrank(spark):
    said = "The quick brown fox jumps over the lazy dog. The fox is quick and brown. Dogs are lazy animals. The sun is bright today. The brown dog and the quick fox are friends."
    got = summaries.textrank(docs(spark, said, "One sentence here.", "", "Same. Same. Same.")).collect()
    mine = [r for r in got if r["doc_id"] == 0]
    assert len(mine) == 5 and mine[0]["score"] > mine[-1]["score"] and "fox" in mine[0]["sentence"]
    assert [r["score"] for r in got if r["doc_id"] == 1] == [1.0]
    assert [r["index"] for r in got if r["doc_id"] == 3] == [0, 1, 2]
    assert {r["doc_id"] for r in summaries.summarize(docs(spark, said), 2).collect()} == {0}


def test_textrank_model():
    rng = random.Random(5)
    tokens = [[rng.choice("abcdefg") * 2 for _ in range(rng.randrange(1, 7))] for _ in range(12)]
    import math

    def weight(a, b):
        shared = sum(t in b for t in a)
        norm = math.log(len(a)) + math.log(len(b))
        return shared / norm if shared and norm else 0.0

    n = len(tokens)
    w = [[x if i != j and (x := weight(tokens[i], tokens[j])) >= 0.1 else 0.0 for j in range(n)] for i in range(n)]
    out, s = [sum(r) for r in w], [1.0] * n
    for _ in range(100):
        new = [0.15 + 0.85 * sum(w[j][i] / out[j] * s[j] for j in range(n) if w[j][i] > 0) for i in range(n)]
        moved = max(abs(a - b) for a, b in zip(new, s, strict=True))
        s = new
        if moved <= 1e-4:
            break
    assert summaries.rank(tokens, summaries.TextRankOptions()) == pytest.approx(s)


def test_gaps(spark):
    every = spark.createDataFrame([("France",), ("Spain",), ("Italy",), ("france",)], "name string")
    g = places.analyze_gaps(spark.createDataFrame([("FRANCE",)], "name string"), every)
    assert places.coverage(g).first().asDict() == {"covered": 2, "missing": 2, "coveragePercent": 50}
    assert places.coverage(g.limit(0)).first()["coveragePercent"] == 0


def test_streaming(spark, tmp_path):
    rows = [(f"t{k % 2}", dt.datetime(2024, 1, 1 + k // 10, k % 10)) for k in range(40)]
    spark.createDataFrame(rows, "topicId string, ts timestamp").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("topicId string, ts timestamp").parquet(str(tmp_path / "in"))
    base = spark.createDataFrame([("t0", 2.0, 1.0), ("t1", 5.0, 1.0)], "topicId string, mean double, stdDev double")
    scored = scored_counts(windowed_counts(stream), base)
    q = scored.writeStream.format("memory").queryName("scored").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(120)
    got = spark.table("scored").collect()
    assert got and all(r["count"] == 5 for r in got)
    assert {r["topicId"]: r["zScore"] for r in got} == {"t0": 3.0, "t1": 0.0}



def test_terms_shuffle_texts_once_and_not_their_tokens(spark):
    d = spark.createDataFrame([(1, "aa bb aa"), (2, "cc"), (1, "bb dd bb")], "doc_id long, text string")
    for df in (terms.term_frequency(terms.stem_occurrences(d)), terms.top_words(d, 2), terms.word_frequency(d)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange ") == 1
        assert plan.index("Exchange ") > plan.index("Generate ")  # the shuffle is below the explode
    assert sorted(map(tuple, terms.word_frequency(d).collect())) == [(1, "aa", 2), (1, "bb", 3), (1, "dd", 1), (2, "cc", 1)]


def test_bag_of_words_makes_tokens_once_per_row(spark):
    from presswork.functions import vectors

    d = spark.createDataFrame([(1, "aa bb aa")], "doc_id long, text string")
    v = d.select(vectors.bag_of_words(tokenize(F.col("text")), F.array(F.lit("aa"), F.lit("bb"), F.lit("zz"))).alias("v"))
    plan = v._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp" in plan and "regexp" not in plan[plan.index("lambdafunction(") :]
    assert v.collect()[0]["v"] == [2, 1, 0]


def test_jaccard_shuffles_distinct_tokens(spark, tmp_path):
    from presswork.plans import QUERIES

    spark.createDataFrame([(1, "aa bb aa"), (2, "bb cc bb"), (3, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    j = QUERIES["jaccard"](spark, str(tmp_path))
    assert "array_distinct" in j._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, j.collect())) == [(1, 1 / 3), (2, 0.0)]


def test_textrank_sends_text_and_not_lists_of_tokens(spark):
    d = spark.createDataFrame([(1, "The cat sat. A catK ran! Dogs ran? . é it's the CAT"), (2, "..."), (3, "one"), (4, None)], "doc_id long, text string")
    r = summaries.textrank(d)
    assert "array<array" not in r._jdf.queryExecution().analyzed().treeString() and "lambdafunction(filter" not in r._jdf.queryExecution().optimizedPlan().toString()
    rows = r.orderBy("doc_id", "index").collect()
    assert [(x["doc_id"], x["sentence"]) for x in rows] == [(1, "The cat sat"), (1, "A catK ran"), (1, "Dogs ran"), (1, "é it's the CAT"), (3, "one")]
    want = summaries.rank([["cat", "sat"], ["catk", "ran"], ["dogs", "ran"], ["it's", "cat"]], summaries.TextRankOptions())
    assert [x["score"] for x in rows[:4]] == want


def test_similar_documents_never_joins_terms(spark, monkeypatch):
    words = "ka lo mi nu pe ra se tu".split()
    rng = random.Random(5)
    texts = [" ".join(rng.choices(words, weights=range(1, 9), k=rng.randrange(0, 12))) for _ in range(90)]
    d = docs(spark, *texts)
    counts = [{w: t.split().count(w) for w in set(t.split())} for t in texts]
    want = []
    for q in range(0, 90, 10):
        norm = [math.sqrt(sum(n * n for n in c.values())) for c in counts]
        dot = {i: sum(n * c.get(w, 0) for w, n in counts[q].items()) for i, c in enumerate(counts) if i != q}
        near = sorted((-(v / (norm[q] * norm[i])), i) for i, v in dot.items() if v)[:4]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(near)]
    for sizes in ((4096, 1024), (7, 3)):
        monkeypatch.setattr(terms, "DOCUMENTS", sizes[0])
        monkeypatch.setattr(terms, "QUERIES", sizes[1])
        r = terms.similar_documents(d, d.where("doc_id % 10 = 0"), 4)
        plan = r._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "HashJoin" not in plan and "HashAggregate" not in plan
        assert sorted(map(tuple, r.collect())) == want
