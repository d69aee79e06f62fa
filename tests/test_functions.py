import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from presswork.core.contracts import CONTRACTS, validate
from presswork.functions import classify, content, geo, hashing, planning, sentiment, vectors

C = F.col


def test_hashes(one):
    assert one(lambda _: hashing.fnv1a64(C("t")), "t string", "hello") == 11831194018420276491 - (1 << 64)
    assert one(lambda _: hashing.fnv1a64(C("t")), "t string", "") == hashing.OFFSET
    h = 14695981039346656037
    for unit in (0xE9, 0xD83D, 0xDE00):
        h = (h ^ unit) * 1099511628211 % (1 << 64)
    assert one(lambda _: hashing.fnv1a64(C("t")) , "t string", "é😀") % (1 << 64) == h
    pair = lambda f, a, b: one(lambda _: f(C("a"), C("b")), "a string, b string", a, b)
    for f in (hashing.hamming, hashing.hamming16):
        assert pair(f, "f" * 16, "f" * 16) == 0
        assert pair(f, "f" * 16, "e" + "f" * 15) == 1
        assert pair(f, "f" + "0" * 15, "0" * 16) == 4
    assert pair(hashing.near_duplicate, "f" * 16, "0" * 16) is False
    assert pair(hashing.hamming16, "12zz" + "0" * 12, "0" * 16) == bin(0x12).count("1")
    with pytest.raises(Exception, match="16 characters"):
        pair(hashing.hamming16, "ff", "0" * 16)
    assert pair(lambda a, b: hashing.hamming16(a, b, strict=False), "ff", "0" * 16) is None
    kinds = [one(lambda _: hashing.match_type(C("d")), "d int", d) for d in (0, 3, 8, 20)]
    assert kinds == ["exact", "near", "similar", "different"]
    assert one(lambda _: hashing.similarity(C("d")), "d int", 16) == 0.75


def test_sentiment(one):
    a = lambda t, lexicon=None: one(lambda _: sentiment.analyze(C("t"), lexicon), "t string", t)
    good = a("This is a great and wonderful day")
    assert (good["label"], good["score"], good["normalizedScore"], good["confidence"]) == ("positive", 8.0, 1.0, 0.57)
    assert a("This is terrible and awful")["label"] == "negative"
    assert a("This is not good")["normalizedScore"] == -1.0
    assert a("not the good")["normalizedScore"] == 1.0
    assert a("very really good")["score"] == 3.9
    assert a("not not good")["score"] == -3.0
    assert a("The meeting is scheduled for tomorrow")["label"] == "neutral"
    assert a(None) == {"score": 0.0, "normalizedScore": 0.0, "confidence": 0.0, "label": "neutral", "wordCount": 0, "sentimentWords": 0}
    assert a("constructor __proto__ good")["score"] == 3.0
    assert a("odd", {"odd": -0.2})["normalizedScore"] == -0.07
    c = one(lambda _: sentiment.compare(sentiment.analyze(C("a")), sentiment.analyze(C("b"))), "a string, b string", "Great success!", "Terrible failure")
    assert c["agreementLabel"] == "disagree" and c["difference"] == 2.0
    assert len(sentiment.default_lexicon()) == 43


def test_tree(spark):
    tree = {"id": "r", "condition": {"type": "url_matches", "pattern": "/article/"}, "yes": {"id": "y", "result": True, "confidence": 0.9}, "no": {"id": "n", "result": False}}
    df = spark.createDataFrame([("https://news.com/ARTICLE/1", 5, "7", None), ("https://news.com/about/", None, "x", {"f": True}), (None, 50, None, {"f": None})], "url string, wordCount bigint, s string, flags map<string,boolean>")
    got = df.select(classify.evaluate_tree(df, tree).alias("r")).collect()
    assert [(r["r"]["match"], r["r"]["confidence"], r["r"]["reason"]) for r in got] == [(True, 0.9, "r:yes"), (False, 0.2, "r:no"), (False, 0.2, "r:no")]
    assert got[0]["r"]["path"][0].asDict() == {"nodeId": "r", "condition": 'URL matches "/article/"', "result": True, "branch": "yes"}

    def met(**c):
        return [r["m"] for r in df.select(classify.evaluate_tree(df, {"id": "a", "condition": c})["match"].alias("m")).collect()]

    assert met(type="compare", field="wordCount", operator=">", value=5) == [False, False, True]
    assert met(type="compare", field="wordCount", operator="!=", value=5) == [False, True, True]
    assert met(type="compare", field="wordCount", operator="==", value="5") == [True, False, False]
    assert met(type="compare", field="s", operator=">=", value=7) == [True, False, False]
    assert met(type="compare", field="s", operator="<", value="y") == [True, True, False]
    assert met(type="compare", field="nothing", operator="!=", value=1) == [True] * 3
    assert met(type="compare", field="nothing", operator="<", value=1) == [False] * 3
    assert met(type="flag", field="f") == [False, True, False]
    assert met(type="and", conditions=[]) == [True] * 3
    assert met(type="or", conditions=[]) == [False] * 3
    assert met(type="url_matches", pattern="(news") == [False] * 3
    leaf = df.select(classify.evaluate_tree(df, {"id": "x"}).alias("r")).first()["r"]
    assert (leaf["match"], leaf["confidence"], leaf["reason"], leaf["path"]) == (False, 0.0, "empty-tree", [])
    assert [len(r["m"]) for r in df.select(classify.matches(df, {"a": tree, "b": {"id": "t", "result": True}}).alias("m")).collect()] == [2, 1, 1]
    with pytest.raises(ValueError, match="bad operator"):
        classify.validate({"id": "x", "condition": {"type": "compare", "field": "a", "operator": "~"}})


def test_categories(one):
    u = lambda url: [c["category"] for c in one(lambda _: content.url_categories(C("u")), "u string", url)]
    assert u("/in-depth/climate-report") == ["inDepth"]
    assert u("/opinion/analysis") == ["opinion"]
    assert u("/videos/breaking") == ["multimedia"]
    assert u("/article/random") == []
    assert sum(len(p) for p in content.CATEGORY_PATTERNS.values()) == 41
    page = lambda url, words, video=None, gallery=None: one(
        lambda _: content.page_categories(C("u"), C("w"), C("v"), C("g")), "u string, w bigint, v boolean, g boolean", url, words, video, gallery
    )
    both = page("/in-depth/report", 2500)
    assert both[0]["category"] == "inDepth" and both[0]["confidence"] == pytest.approx(0.8 + 0.75 * 0.5, abs=0) or both[0]["confidence"] == 1.0
    assert [(c["category"], c["confidence"]) for c in page("/x", None, True, True)] == [("multimedia", 1.0)]
    assert one(lambda _: content.primary_category(content.page_categories(C("u"))), "u string", "/random") is None
    assert one(lambda _: content.is_category(C("u"), "live"), "u string", "/LIVE/x") is True


def test_confidence(one):
    t = lambda x: one(lambda _: content.title_quality(C("t")), "t string", x)
    assert [t(x) for x in (None, "  ", "Error 404", "Error 404 page", "1234567890", "x" * 201, "a good title of a page", "x" * 160, "😀" * 5)] == [0, 0, 0.3, 0.1, 0.2, 0.5, 1.0, 0.8, 0.8]
    length = lambda n: one(lambda _: content.length_quality(C("n")), "n bigint", n)
    assert [length(n) for n in (0, 49, 80, 300, 500, 10_001)] == [0, 0.2, 0.5, 0.75, 1.0, 0.6]
    row = ("title string, content string, author string, published string, section string, n bigint", "A perfectly fine title", "Lorem ipsum " * 100, "a", " ", None, None)
    c = one(lambda _: content.confidence(C("title"), C("content"), C("author"), C("published"), C("section"), C("n")), *row)
    assert (c["score"], c["level"], c["factors"]["length"]) == (round(0.3 + 0.5 * 0.625 + 0.2 / 3, 2), "good", 0.625)
    assert c["recommendation"] == "Consider: missing metadata"
    empty = one(lambda _: content.confidence(C("t"), C("t"), C("t"), C("t"), C("t")), "t string", None)
    assert (empty["score"], empty["level"]) == (0.0, "low")


def test_vectors(one):
    v = lambda f, a, b: one(lambda _: f(C("a"), C("b")), "a array<double>, b array<double>", a, b)
    assert v(vectors.cosine, [1.0, 0.0], [1.0, 1.0]) == pytest.approx(math.sqrt(0.5))
    assert v(vectors.cosine, [0.0, 0.0], [1.0, 1.0]) == 0
    assert v(vectors.euclidean, [0.0, 0.0], [3.0, 4.0]) == 5
    assert v(vectors.dot, [1.0, 2.0], [3.0, 4.0]) == 11
    with pytest.raises(Exception, match="same length"):
        v(vectors.dot, [1.0], [1.0, 2.0])
    assert v(lambda a, b: vectors.dot(a, b, strict=False), [1.0], [1.0, 2.0]) is None
    assert v(vectors.jaccard, [1.0, 2.0, 3.0], [2.0, 3.0, 4.0]) == 0.5
    assert v(vectors.jaccard, [], []) == 1
    assert one(lambda _: vectors.bag_of_words(C("t"), C("v")), "t array<string>, v array<string>", ["a", "c", "a", "z"], ["a", "b", "c"]) == [2, 0, 1]


def test_places(one):
    s = lambda n: one(lambda _: geo.to_slug(C("n")), "n string", n)
    assert [s(n) for n in ("United States", "São Paulo", "México", " Paris ", "a_b", "Straße", "Côte d’Ivoire", "x - y")] == ["united-states", "sao-paulo", "mexico", "-paris-", "ab", "strae", "cote-divoire", "x-y"]
    names = one(lambda _: geo.name_variants(C("n"), C("c"), C("s"), C("v")), "n string, c string, s string, v array<string>", "United Kingdom", "GB", "uk", ["Britain", "United Kingdom", ""])
    assert names == ["united-kingdom", "gb", "uk", "britain"]
    urls = one(lambda _: geo.hub_urls(F.lit("apnews.com"), F.array(C("s")), (("/a/{slug}", 0.5), ("/b/{slug}/{slug}", 2.0), ("/a/{slug}", 1.0))), "s string", "france")
    assert [(u["url"], u["weight"]) for u in urls] == [("https://apnews.com/b/france/{slug}", 2.0), ("https://apnews.com/a/france", 1.0)]
    slug = lambda u: one(lambda _: geo.slug_from_url(C("u")), "u string", u)
    assert [slug(u) for u in ("https://a.b/world/france", "https://a.b/world/france/", "nonsense", "https://a.b/x\n", None)] == ["france", None, None, "x", None]


def test_priority(one):
    now = dt.datetime(2024, 1, 10)
    schema = "v timestamp, c timestamp, r double, d int, h boolean"

    def p(hours, changed=None, r=0.5, d=1, h=False):
        row = (now - dt.timedelta(hours=hours), None if changed is None else now - dt.timedelta(hours=changed), r, d, h)
        return one(lambda _: planning.url_priority(C("v"), C("c"), C("r"), C("d"), C("h"), F.lit(now)), schema, *row)

    assert p(48)["score"] == 58
    assert [p(x)["score"] for x in (24, 168, 168.001, 23.999, 0.5, -5)] == [58, 58, 73, 48, 28, 28]
    assert p(48, 12)["score"] == 78
    full = p(200, 1, 0.9, 4, True)
    assert full == {"score": 100, "reasons": ["Not visited in 7+ days", "Changed in last 24h", "High topic relevance", "Is a hub page", "Deep URL"]}


def test_contracts(spark):
    for ddl in CONTRACTS.values():
        spark.createDataFrame([], ddl)
    df = spark.createDataFrame([("https://a.b/", 1, dt.datetime(2024, 1, 1), None), ("nope", -1, None, 2.0)], "url string, visits bigint, lastVisited timestamp, topicRelevance double")
    good, bad = validate(df, "UrlSignals")
    assert [(r["topicRelevance"], r["hubDepth"], r["isHub"]) for r in good.collect()] == [(0.5, 0, False)]
    assert [r["reason"] for r in bad.collect()] == ["url,visits,lastVisited,topicRelevance"]
