"""Page categories and extraction confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presswork.core.jscompat import JS_SPACE, let, round2, trim

#: The patterns of each category in order, as they are reported.
CATEGORY_PATTERNS: dict[str, tuple[str, ...]] = {
    "inDepth": (r"\/in-depth\/", r"\/longform\/", r"\/special-reports?\/", r"\/investigations?\/", r"\/features?\/", r"\/magazine\/", r"\/deep-dive\/"),
    "opinion": (r"\/opinion\/", r"\/editorial[s]?\/", r"\/commentary\/", r"\/columns?\/", r"\/perspectives?\/", r"\/viewpoint\/", r"\/letters\/"),
    "live": (r"\/live\/", r"\/live-updates?\/", r"\/breaking\/", r"\/developing\/", r"\/as-it-happens?\/"),
    "explainer": (r"\/explainer[s]?\/", r"\/explained\/", r"\/guide[s]?\/", r"\/what-is-", r"\/how-to-", r"\/faq\/", r"\/101\/"),
    "multimedia": (r"\/video[s]?\/", r"\/audio\/", r"\/podcast[s]?\/", r"\/interactive\/", r"\/gallery", r"\/photo[s]?\/", r"\/graphics?\/"),
    "hub": (r"\/world\/", r"\/politics\/", r"\/business\/", r"\/technology\/", r"\/science\/", r"\/sports?\/", r"\/entertainment\/", r"\/health\/"),
}
LENGTHS = {"min": 100, "ideal": 500, "max": 10_000}


def first_pattern(url: Column, patterns: tuple[str, ...]) -> Column:
    """The first pattern that is found in ``url``, or null."""
    return F.coalesce(*(F.when(url.rlike(f"(?i){p}"), F.lit(p)) for p in patterns))


def _result(category: str, confidence: Column, pattern: Column | None = None) -> Column:
    p = F.lit(None).cast("string") if pattern is None else pattern
    return F.struct(F.lit(category).alias("category"), confidence.cast("double").alias("confidence"), p.alias("matchedPattern"))


def _present(items: list[Column]) -> Column:
    return F.filter(F.array(*items), lambda x: x.isNotNull())


def url_categories(url: Column) -> Column:
    """0.8 for every category with a pattern in the url, in declaration order."""
    return _present([F.when(first_pattern(url, p).isNotNull(), _result(c, F.lit(0.8), first_pattern(url, p))) for c, p in CATEGORY_PATTERNS.items()])


def content_categories(word_count: Column, has_video: Column, has_gallery: Column, link_density: Column) -> Column:
    """Categories that content signals suggest; a gallery is a second multimedia entry."""
    long = F.coalesce(word_count > 2000, F.lit(False))
    return _present([
        F.when(long, _result("inDepth", F.least(F.lit(0.9), F.lit(0.5) + word_count / 10_000))),
        F.when(F.coalesce(has_video, F.lit(False)), _result("multimedia", F.lit(0.7))),
        F.when(F.coalesce(has_gallery, F.lit(False)), _result("multimedia", F.lit(0.6))),
        F.when(F.coalesce(link_density > 0.5, F.lit(False)), _result("hub", F.lit(0.6))),
    ])


def page_categories(url: Column, word_count: Column | None = None, has_video: Column | None = None, has_gallery: Column | None = None, link_density: Column | None = None) -> Column:
    """Both kinds merged: a repeat adds half its confidence, at most 1; most confident first.

    Ties keep the order in which a category was first seen: the url's in declaration
    order, then those of the content.
    """
    no = F.lit(False)
    long = no if word_count is None else F.coalesce(word_count > 2000, no)
    video = no if has_video is None else F.coalesce(has_video, no)
    gallery = no if has_gallery is None else F.coalesce(has_gallery, no)
    dense = no if link_density is None else F.coalesce(link_density > 0.5, no)
    depth = F.lit(0.0) if word_count is None else F.least(F.lit(0.9), F.lit(0.5) + word_count / 10_000)
    extra = {"inDepth": [(long, depth)], "multimedia": [(video, F.lit(0.7)), (gallery, F.lit(0.6))], "hub": [(dense, F.lit(0.6))]}
    late = {"inDepth": 6, "multimedia": 7, "hub": 8}
    items = []
    for k, (c, patterns) in enumerate(CATEGORY_PATTERNS.items()):
        found = first_pattern(url, patterns)
        score = F.when(found.isNotNull(), F.lit(0.8))
        for on, sure in extra.get(c, ()):
            score = F.when(on, F.when(score.isNull(), sure).otherwise(F.least(F.lit(1.0), score + sure * 0.5))).otherwise(score)
        place = F.when(found.isNotNull(), F.lit(k)).otherwise(F.lit(late.get(c, k)))
        items.append(F.when(score.isNotNull(), F.struct((-score).alias("order"), place.alias("place"), _result(c, score, found).alias("r"))))
    return F.transform(F.array_sort(_present(items)), lambda x: x["r"])


def primary_category(categories: Column) -> Column:
    return F.get(categories, 0)


def is_category(url: Column, category: str, least: float = 0.5) -> Column:
    return F.exists(page_categories(url), lambda x: (x["category"] == category) & (x["confidence"] >= least))


def whitespace_words(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), f"{JS_SPACE}+"), lambda w: F.length(w) > 0)).cast("bigint")


def title_quality(title: Column) -> Column:
    """Length in UTF-16 units of the trimmed title decides first, then its wording."""

    def of(t: Column) -> Column:
        n = F.octet_length(F.encode(t, "UTF-16BE")) / 2
        return (
            F.when(n == 0, 0.0).when(n < 10, 0.3).when(n > 200, 0.5).when(t.rlike("(?i)^(error|404|not found|loading)"), 0.1).when(t.rlike(r"^[0-9]+\z"), 0.2)
            .when((n >= 20) & (n <= 150), 1.0).otherwise(0.8)
        )

    return let(trim(F.coalesce(title, F.lit(""))), of)


def length_quality(words: Column, config: dict[str, int] | None = None) -> Column:
    c = LENGTHS | (config or {})
    w = words.cast("double")
    line = F.lit(0.5) + (w - c["min"]) / float(c["ideal"] - c["min"]) * 0.5
    return F.when(w == 0, 0.0).when(w < c["min"] * 0.5, 0.2).when(w < c["min"], 0.5).when(w > c["max"], 0.6).when(w >= c["ideal"], 1.0).otherwise(line)


def metadata_completeness(*fields: Column) -> Column:
    filled = [F.when(F.length(trim(F.coalesce(f, F.lit("")))) > 0, 1).otherwise(0) for f in fields]
    return sum(filled, F.lit(0)) / float(len(fields))


def level(score: Column) -> Column:
    return F.when(score >= 0.8, "high").when(score >= 0.6, "good").when(score >= 0.3, "medium").otherwise("low")


def recommendation(score: Column, title: Column, length: Column, metadata: Column) -> Column:
    issues = F.concat_ws(", ", F.when(title < 0.5, "verify title"), F.when(length < 0.5, "check content length"), F.when(metadata < 0.5, "missing metadata"))
    return F.when(score >= 0.8, "Content extraction looks reliable").when(issues == "", "Minor quality concerns").otherwise(F.concat(F.lit("Consider: "), issues))


def confidence(title: Column, content: Column, author: Column, publish_date: Column, section: Column, word_count: Column | None = None) -> Column:
    """Struct score, level, factors, recommendation; level and advice from the unrounded score."""
    words = whitespace_words(content) if word_count is None else F.coalesce(word_count, whitespace_words(content))
    factors = F.struct(title_quality(title).alias("title"), length_quality(words).alias("length"), metadata_completeness(author, publish_date, section).alias("metadata"))

    def of(f: Column) -> Column:
        s = f["title"] * 0.3 + f["length"] * 0.5 + f["metadata"] * 0.2
        return F.struct(round2(s).alias("score"), level(s).alias("level"), f.alias("factors"), recommendation(s, f["title"], f["length"], f["metadata"]).alias("recommendation"))

    return let(factors, of)


def filter_low_confidence(scored: DataFrame, threshold: float = 0.4, score: str = "score") -> DataFrame:
    """Rows of ``scored`` whose score lies below the threshold, lowest first."""
    return scored.where(F.col(score) < threshold).orderBy(score)
