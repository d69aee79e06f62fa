"""Slugs, name variants and hub urls of places."""

from __future__ import annotations

import re
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from presswork.core.jscompat import JS_SPACE

#: Url patterns and their weights.
COUNTRY_PATTERNS = (
    ("/location/{slug}", 1.2), ("/world/{slug}", 1.1), ("/news/{slug}", 1.0), ("/{slug}", 0.9), ("/topics/{slug}", 0.8), ("/tag/{slug}", 0.7), ("/region/{slug}", 0.8), ("/international/{slug}", 0.6),
)
CITY_PATTERNS = (("/local/{slug}", 1.2), ("/city/{slug}", 1.1), ("/news/{slug}", 1.0), ("/{slug}", 0.9), ("/metro/{slug}", 0.8))


@cache
def _letters() -> tuple[str, str]:
    """Lower-case characters that decompose to one ASCII letter or digit, and what to."""
    pairs = []
    for k in range(0x80, 0x110000):
        c = chr(k)
        if c.lower() == c:
            base = [x for x in unicodedata.normalize("NFD", c) if x.isascii() and (x.islower() or x.isdigit())]
            if len(base) == 1:
                pairs.append((c, base[0]))
    return "".join(p[0] for p in pairs), "".join(p[1] for p in pairs)


def to_slug(name: Column) -> Column:
    source, target = _letters()
    s = F.translate(F.lower(F.coalesce(name, F.lit(""))), source, target)
    s = F.regexp_replace(s, rf"[^a-z0-9\-{JS_SPACE[1:]}", "")
    return F.regexp_replace(F.regexp_replace(s, f"{JS_SPACE}+", "-"), "-+", "-")


def name_variants(name: Column, code: Column, slug: Column, variants: Column) -> Column:
    """Distinct, in order: slug of the name, code, given slug, slugs of the other names."""
    more = F.coalesce(F.transform(variants, to_slug), F.array().cast("array<string>"))
    every = F.concat(F.array(to_slug(name), F.lower(code), F.lower(slug)), more)
    return F.array_distinct(F.filter(every, lambda v: F.coalesce(F.length(v) > 0, F.lit(False))))


def hub_urls(domain: Column, variants: Column, patterns: tuple[tuple[str, float], ...] = COUNTRY_PATTERNS) -> Column:
    """Array of (url, weight): heaviest first, a url once with its largest weight.

    Patterns are sorted by weight up front, so the first occurrence of a url is the one
    to keep; a pattern's first ``{slug}`` is replaced.
    """
    base = F.when(domain.startswith("http"), domain).otherwise(F.concat(F.lit("https://"), domain))

    def filled(pattern: str, weight: float) -> Column:
        head, slot, tail = pattern.partition("{slug}")
        end = F.lit(tail)

        def url(v: Column) -> Column:
            return F.concat(base, F.lit(head), v, end) if slot else F.concat(base, F.lit(head))

        return F.transform(variants, lambda v: F.struct(url(v).alias("url"), F.lit(float(weight)).alias("weight")))

    lists = [filled(p, w) for p, w in sorted(patterns, key=lambda p: -p[1])]
    every = F.flatten(F.array(*lists))
    return F.filter(every, lambda x, i: F.array_position(F.transform(every, lambda y: y["url"]), x["url"]) == i + 1)


def slug_from_url(url: Column, patterns: tuple[tuple[str, float], ...] = COUNTRY_PATTERNS) -> Column:
    """The slug of the first pattern that the whole path matches, or null."""
    safe = F.regexp_replace(F.regexp_replace(url, r"^\s+|\s+\z", ""), " ", "%20")
    path = F.when(F.expr("true"), F.try_parse_url(safe, F.lit("PATH")))
    path = F.when(F.length(path) == 0, F.lit("/")).otherwise(path)
    found = []
    for pattern, _ in patterns:
        body = re.sub(r"\{slug\}", "([^/]+)", pattern)
        found.append(F.when(path.rlike(rf"^{body}\z"), F.regexp_extract(path, rf"^{body}\z", 1)))
    return F.coalesce(*found)
