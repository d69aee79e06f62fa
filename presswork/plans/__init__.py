"""Registered queries of the reference's operators over the test tables, and their SQL.

Inputs that the tables lack (publish times, page signals, places) are derived from keys
by the same arithmetic in both languages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presswork import streaming
from presswork.core import contracts
from presswork.functions import classify, content, geo, hashing, planning, sentiment, text, vectors
from presswork.functions.sql import register_sql
from presswork.operators import fingerprints, places, series, summaries, terms
from presswork.sources import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def of(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return of


# --- SQL fragments -----------------------------------------------------------------

WS = r"[\s\x0B\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
STOP = "[" + ", ".join(f"'{w}'" for w in text.STOPWORDS) + "]"


def tokens_sql(c: str, least: int = 2, stop: bool = False, odd: str = r"[^A-Za-z0-9_\s\x0B''-]") -> str:
    drop = f" and not list_contains({STOP}, w)" if stop else ""
    return rf"list_filter(regexp_split_to_array(regexp_replace(lower(coalesce({c}, '')), '{odd}', ' ', 'g'), '[\s\x0B]+'), lambda w: len(w) >= {least}{drop})"


def hash_tokens_sql(c: str) -> str:
    return tokens_sql(c, 2, odd=r"[^A-Za-z0-9_\s\x0B]")


def trim_sql(c: str) -> str:
    return f"regexp_replace(regexp_replace({c}, '^{WS}+', ''), '{WS}+$', '')"


def round2_sql(c: str) -> str:
    return f"(floor(({c})::double * 100 + 0.5::double) / 100::double)"


SENTENCES = rf"list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '[.!?]+'), lambda s: {trim_sql('s')}), lambda s: len(s) > 0)"
STEM1 = "case when w like '%sses' or w like '%ies' then left(w, -2) when w like '%ss' then w when w like '%s' then left(w, -1) else w end"
STEM2 = (
    "case when w like '%eed' then case when len(w) > 4 then left(w, -1) else w end when w like '%ed' then case when w like '%at%' or len(w) > 4 then left(w, -2) else w end "
    "when w like '%ing' then case when len(w) > 5 then left(w, -3) else w end else w end"
)
STEM3 = "case when regexp_matches(w, '[^aeiou]y$') then left(w, -1) || 'i' else w end"
STEMS = (
    f"list_transform({tokens_sql('text', 3, True)}, lambda x: case when len(x) < 3 then x else "
    f"list_transform(list_transform(list_transform([x], lambda w: {STEM1}), lambda w: {STEM2}), lambda w: {STEM3})[1] end)"
)
FNV = "list_reduce(list_transform(string_split(term, ''), lambda c: unicode(c)::uhugeint), lambda h, c: (xor(h, c) * 1099511628211::uhugeint) % 18446744073709551616::uhugeint, 14695981039346656037::uhugeint)"
SIMHASH = f"""
occ as (select doc_id, unnest({hash_tokens_sql('text')}) as term from documents),
cnt as (select doc_id, term, count(*)::hugeint as n from occ group by all),
hsh as (select term, {FNV} as h from (select distinct term from occ)),
vote as (select doc_id, b, sum(case when (h >> b::uhugeint) & 1 = 1 then n else -n end) as v from cnt join hsh using (term), (select unnest(range(64)) as b) group by all),
fp as (select doc_id, bit_or(case when v > 0 then 1::uhugeint << b::uhugeint else 0::uhugeint end) as f from vote group by 1),
sim as (select d.doc_id, coalesce(f, 0::uhugeint)::ubigint as f, lower(lpad(to_hex(coalesce(f, 0::uhugeint)::ubigint), 16, '0')) as simhash from documents d left join fp using (doc_id))"""


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


# --- text ---------------------------------------------------------------------------


@query(f"select doc_id, len(t)::bigint as n_tokens, array_to_string(t, ' ') as tokens from (select doc_id, {tokens_sql('text')} as t from documents)")
def tokenize(spark, sf_dir):
    t = documents(spark, sf_dir).select("doc_id", text.tokenize(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("bigint").alias("n_tokens"), F.array_join("t", " ").alias("tokens"))


@query(f"select doc_id, len({tokens_sql('text', 1)})::bigint as words from documents")
def word_count(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", text.word_count(F.col("text")).alias("words"))


@query(f"select doc_id, len(s)::bigint as n_sentences, array_to_string(s, '|') as sentences from (select doc_id, {SENTENCES} as s from documents)")
def sentences(spark, sf_dir):
    s = documents(spark, sf_dir).select("doc_id", text.sentences(F.col("text")).alias("s"))
    return s.select("doc_id", F.size("s").cast("bigint").alias("n_sentences"), F.array_join("s", "|").alias("sentences"))


@query(
    f"select doc_id, greatest(len(t) - 2, 0)::bigint as n, array_to_string(list_transform(range(1, greatest(len(t) - 1, 1)), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2]), '|') as trigrams "
    f"from (select doc_id, {tokens_sql('text')} as t from documents)"
)
def ngrams(spark, sf_dir):
    g = documents(spark, sf_dir).select("doc_id", text.ngrams(text.tokenize(F.col("text")), 3).alias("g"))
    return g.select("doc_id", F.size("g").cast("bigint").alias("n"), F.array_join("g", "|").alias("trigrams"))


@query(f"select doc_id, word, count(*) as count from (select doc_id, unnest({tokens_sql('text')}) as word from documents) group by all")
def word_frequency(spark, sf_dir):
    return terms.word_frequency(documents(spark, sf_dir))


@query(f"""
with e as (select doc_id, unnest(t) as word, unnest(range(len(t))) as pos from (select doc_id, {tokens_sql('text')} as t from documents)),
c as (select doc_id, word, count(*) as count, min(pos) as first from e group by all),
r as (select *, (row_number() over (partition by doc_id order by count desc, first))::int as rank from c)
select doc_id, rank, word, count from r where rank <= 10""")
def top_words(spark, sf_dir):
    return terms.top_words(documents(spark, sf_dir), 10)


@query(f"select doc_id, case when len(t) < 5 then true else len(list_filter(t, lambda w: list_contains({STOP}, w)))::double / len(t) > 0.1::double end as english from (select doc_id, {tokens_sql('text')} as t from documents)")
def likely_english(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", text.is_likely_english(F.col("text")).alias("english"))


@query(f"select distinct unnest({STEMS}) as stem from documents")
def stem(spark, sf_dir):
    return documents(spark, sf_dir).select(F.explode(terms.stems(F.col("text"))).alias("stem")).distinct()


# --- fingerprints and clusters -------------------------------------------------------


@query(f"select term, lower(lpad(to_hex(({FNV})::ubigint), 16, '0')) as hash from (select distinct unnest({hash_tokens_sql('text')}) as term from documents)")
def fnv1a64(spark, sf_dir):
    t = documents(spark, sf_dir).select(F.explode(text.hash_tokens(F.col("text"))).alias("term")).distinct()
    return t.select("term", hashing.hex16(hashing.fnv1a64(F.col("term"))).alias("hash"))


@query(f"with {SIMHASH} select doc_id, simhash from sim")
def simhash(spark, sf_dir):
    return fingerprints.simhash(documents(spark, sf_dir))


@query(f"""with {SIMHASH} select a.doc_id as id_a, b.doc_id as id_b, bit_count(xor(a.f, b.f))::int as distance,
case when bit_count(xor(a.f, b.f)) = 0 then 'exact' else 'near' end as match_type, 1 - bit_count(xor(a.f, b.f)) / 64::double as similarity
from sim a join sim b on a.doc_id < b.doc_id and bit_count(xor(a.f, b.f)) <= 3""")
def near_duplicates(spark, sf_dir):
    pairs = fingerprints.near_duplicates(fingerprints.simhash(documents(spark, sf_dir)), 3)
    return pairs.withColumns({"match_type": hashing.match_type(F.col("distance")), "similarity": hashing.similarity(F.col("distance"))})


@query(f"""with {SIMHASH} select a.doc_id, bit_count(xor(a.f, b.f))::int as distance, bit_count(xor(a.f, b.f))::int as distance16,
case when bit_count(xor(a.f, b.f)) = 0 then 'exact' when bit_count(xor(a.f, b.f)) <= 3 then 'near' when bit_count(xor(a.f, b.f)) <= 10 then 'similar' else 'different' end as match_type
from sim a join sim b on b.doc_id = a.doc_id + 1""")
def hamming(spark, sf_dir):
    h = fingerprints.simhash(documents(spark, sf_dir))
    b = h.select((F.col("doc_id") - 1).alias("doc_id"), F.col("simhash").alias("other"))
    d = h.join(b, "doc_id").select("doc_id", hashing.hamming(F.col("simhash"), F.col("other")).alias("distance"), hashing.hamming16(F.col("simhash"), F.col("other")).alias("distance16"))
    return d.withColumn("match_type", hashing.match_type(F.col("distance")))


@query(f"""with recursive {SIMHASH},
nodes as (select doc_id, f, row_number() over (order by doc_id % 50 desc, doc_id) as rank from sim),
walk(k, centres) as (
  select 0::bigint, []::struct(rank bigint, f ubigint)[]
  union all
  select n.rank, case when len(list_filter(w.centres, lambda c: bit_count(xor(c.f, n.f)) <= 3)) = 0 then list_append(w.centres, {{'rank': n.rank, 'f': n.f}}) else w.centres end
  from walk w join nodes n on n.rank = w.k + 1),
done as (select unnest(centres) as c from walk where k = (select max(rank) from nodes)),
own as (select n.doc_id, n.rank, n.f, min(c.rank) as centre from nodes n join done on bit_count(xor(n.f, c.f)) <= 3 group by all),
g as (select o.centre, array_to_string(list(o.doc_id::varchar order by o.rank), ',') as member_ids, count(*) as n, sum(bit_count(xor(o.f, c.f))) as total
  from own o join nodes c on c.rank = o.centre group by 1)
select 'cluster-' || row_number() over (order by centre) as id, c.doc_id::varchar as center_id, member_ids, case when n > 1 then total / (n - 1)::double else 0::double end as average_distance
from g join nodes c on c.rank = g.centre""")
def article_groups(spark, sf_dir):
    h = fingerprints.simhash(documents(spark, sf_dir))
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("doc_id") % 50 * 3600)
    articles = h.select(F.col("doc_id").cast("string").alias("id"), F.col("simhash").alias("simHash"), at.alias("publishedAt"), F.col("doc_id").alias("ordinal"))
    g = fingerprints.group_articles(articles, 3)
    return g.select("id", F.col("centerArticleId").alias("center_id"), F.array_join("memberIds", ",").alias("member_ids"), F.col("averageDistance").alias("average_distance"))


# --- sentiment -----------------------------------------------------------------------

#: Words that do occur in the tables, so that scores, negation and amplification are exercised.
OWN_LEXICON = {"the": 2, "of": -1, "and": 3, "in": -2.5, "que": 2, "de": -3, "und": 1.5, "der": -2}


def _case(values: dict, c: str) -> str:
    return f"case {c} " + " ".join(f"when '{k}' then {float(v)}::double" for k, v in values.items()) + " end"


def sentiment_sql(source: str, lexicon: dict, key: str = "doc_id", c: str = "text") -> str:
    neg = ", ".join(f"'{w}'" for w in sentiment.NEGATORS if "'" not in w)
    start = "{'w': '', 'total': 0::double, 'hits': 0::bigint, 'neg': false, 'amp': 1::double, 'score': null::double, 'loud': null::double, 'negates': false}"
    item = f"{{'w': w, 'total': 0::double, 'hits': 0::bigint, 'neg': false, 'amp': 1::double, 'score': ({_case(lexicon, 'w')})::double, 'loud': ({_case(sentiment.AMPLIFIERS, 'w')})::double, 'negates': w in ({neg})}}"
    plain = "(not x.negates and x.loud is null)"
    hit = f"({plain} and x.score is not null)"
    step = (
        f"{{'w': x.w, 'total': case when {hit} then a.total + case when a.neg then -(x.score * a.amp) else x.score * a.amp end else a.total end, 'hits': case when {hit} then a.hits + 1 else a.hits end, "
        f"'neg': case when x.negates then true when {plain} then false else a.neg end, 'amp': case when {plain} then 1::double when not x.negates then x.loud else a.amp end, "
        "'score': null::double, 'loud': null::double, 'negates': false}"
    )
    return f"""
select {key}, {round2_sql('s.total')} as score, {round2_sql('normal')} as normalized_score, {round2_sql('sure')} as confidence,
  case when normal > 0.1::double then 'positive' when normal < -0.1::double then 'negative' else 'neutral' end as label, n as word_count, s.hits as sentiment_words
from (select *, case when s.hits > 0 then greatest(-1::double, least(1::double, s.total / (s.hits * 3))) else 0::double end as normal,
        case when n > 0 then least(1::double, s.hits / n::double * 2) else 0::double end as sure
  from (select {key}, len(t)::bigint as n, list_reduce(list_transform(t, lambda w: {item}), lambda a, x: {step}, {start}) as s
    from (select {key}, {tokens_sql(c, 1)} as t from {source})))"""


def _sentiment(df: DataFrame, lexicon, key: str) -> DataFrame:
    s = df.select(key, sentiment.analyze(F.col("text"), lexicon).alias("s"))
    return s.select(
        key, "s.score", F.col("s.normalizedScore").alias("normalized_score"), "s.confidence", "s.label", F.col("s.wordCount").alias("word_count"), F.col("s.sentimentWords").alias("sentiment_words")
    )


@query(sentiment_sql("documents", sentiment.LEXICON))
def sentiment_default(spark, sf_dir):
    return _sentiment(documents(spark, sf_dir), None, "doc_id")


@query(sentiment_sql("documents", OWN_LEXICON))
def sentiment_custom(spark, sf_dir):
    return _sentiment(documents(spark, sf_dir), OWN_LEXICON, "doc_id")


@query(f"""with s as ({sentiment_sql("(select conv_id * 1000 + turn as id, text from conversations)", sentiment.LEXICON, "id")})
select a.id, a.normalized_score as a_score, b.normalized_score as b_score, abs(a.normalized_score - b.normalized_score) as difference,
  case when a.label = b.label or a.label = 'neutral' or b.label = 'neutral' then 'agree' else 'disagree' end as agreement
from s a join s b on b.id = a.id + 1""")
def compare_sentiment(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), sentiment.analyze(F.col("text")).alias("s"))
    both = c.join(c.select((F.col("id") - 1).alias("id"), F.col("s").alias("o")), "id").select("id", sentiment.compare(F.col("s"), F.col("o")).alias("c"))
    return both.select("id", F.col("c.aScore").alias("a_score"), F.col("c.bScore").alias("b_score"), "c.difference", F.col("c.agreementLabel").alias("agreement"))


# --- classification --------------------------------------------------------------------

TREE = {
    "id": "root", "condition": {"type": "url_matches", "pattern": "/en/[0-9]+"},
    "yes": {"id": "query", "condition": {"type": "or", "conditions": [{"type": "url_matches", "pattern": "page="}, {"type": "text_contains", "pattern": "THAT"}]},
            "yes": {"id": "hit", "result": True, "confidence": 0.9},
            "no": {"id": "size", "condition": {"type": "and", "conditions": [{"type": "compare", "field": "wordCount", "operator": ">=", "value": 30}, {"type": "compare", "field": "missing", "operator": "!=", "value": 3}]}}},
    "no": {"id": "flag", "condition": {"type": "flag", "field": "even"}, "yes": {"id": "even", "result": True}, "no": {"id": "odd", "result": False}},
}
SECOND = {"id": "broken", "condition": {"type": "url_matches", "pattern": "(example"}, "yes": {"id": "y", "result": True}}
PAGES = r"(select page_id, url, regexp_extract(html, '<title>([^<]*)', 1) as title, octet_length(encode(html))::bigint // 100 as words from pages)"


def _pages(spark, sf_dir) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    return p.select(
        "page_id", "url", F.regexp_extract("html", "<title>([^<]*)", 1).alias("title"), F.expr("octet_length(html) div 100").cast("bigint").alias("wordCount"),
        F.create_map(F.lit("even"), F.col("page_id") % 2 == 0).alias("flags"),
    )


_ROOT, _QUERY, _SIZE = "regexp_matches(coalesce(url, ''), '(?i)/en/[0-9]+')", "(regexp_matches(url, '(?i)page=') or contains(lower(title || ' '), 'that'))", "words >= 30"
TREE_SQL = f"""
select page_id, case when {_ROOT} then case when {_QUERY} then true else {_SIZE} end else page_id % 2 = 0 end as match,
  case when {_ROOT} then case when {_QUERY} then 0.9::double else 0.5::double end else case when page_id % 2 = 0 then 0.8::double else 0.2::double end end as confidence,
  case when {_ROOT} then case when {_QUERY} then 'root:yes,query:yes' when {_SIZE} then 'root:yes,query:no,size:yes' else 'root:yes,query:no,size:no' end
    when page_id % 2 = 0 then 'root:no,flag:yes' else 'root:no,flag:no' end as reason,
  case when {_ROOT} then 'URL matches "/en/[0-9]+"|Any of: URL matches "page=", Text contains "THAT"' || case when {_QUERY} then '' else '|All of: wordCount >= 30, missing != 3' end
    else 'URL matches "/en/[0-9]+"|Flag "even" is set' end as conditions
from {PAGES}"""


@query(TREE_SQL)
def decision_tree(spark, sf_dir):
    p = _pages(spark, sf_dir)
    r = p.select("page_id", classify.evaluate_tree(p, TREE).alias("r"))
    return r.select("page_id", "r.match", "r.confidence", "r.reason", F.array_join(F.transform("r.path", lambda s: s["condition"]), "|").alias("conditions"))


@query(f"""
select page_id, 'first' as category, confidence from ({TREE_SQL}) where match
union all select page_id, 'second', 0.8::double from pages where contains(url, '(example')""")
def tree_matches(spark, sf_dir):
    p = _pages(spark, sf_dir)
    m = p.select("page_id", F.explode(classify.matches(p, {"first": TREE, "second": SECOND})).alias("m"))
    return m.select("page_id", "m.category", "m.result.confidence")


# --- content -----------------------------------------------------------------------------

SEGMENTS = ("in-depth", "opinion", "LIVE", "guides", "video", "world", "news", "what-is-this", "features/live", "sports/gallery")
_SEG_SQL = "[" + ", ".join(f"'{s}'" for s in SEGMENTS) + "]"
URLS = f"(select doc_id, 'https://n.example/' || {_SEG_SQL}[doc_id % {len(SEGMENTS)} + 1] || '/' || doc_id as url, n_chars // 2 as words, doc_id % 3 = 0 as video, doc_id % 5 = 0 as gallery, (doc_id % 10) / 10::double as density from documents)"


def _urls(spark, sf_dir) -> DataFrame:
    d, k = table(spark, sf_dir, "documents"), F.col("doc_id")
    segment = F.get(F.array(*map(F.lit, SEGMENTS)), (k % len(SEGMENTS)).cast("int"))
    return d.select(
        k, F.concat(F.lit("https://n.example/"), segment, F.lit("/"), k.cast("string")).alias("url"), F.expr("n_chars div 2").alias("words"),
        (k % 3 == 0).alias("video"), (k % 5 == 0).alias("gallery"), ((k % 10) / 10).alias("density"),
    )


def _first_sql(patterns) -> str:
    return "case " + " ".join(f"when regexp_matches(url, '(?i){p}') then '{p}'" for p in patterns) + " end"


URL_CATEGORIES = " union all ".join(
    f"select doc_id, {k} as place, '{c}' as category, 0.8::double as confidence, {_first_sql(p)} as pattern from {URLS}" for k, (c, p) in enumerate(content.CATEGORY_PATTERNS.items())
)
CONTENT_CATEGORIES = f"""
select doc_id, 6 as place, 'inDepth' as category, least(0.9::double, 0.5::double + words / 10000::double) as confidence from {URLS} where words > 2000
union all select doc_id, 7, 'multimedia', 0.7::double from {URLS} where video
union all select doc_id, 8, 'multimedia', 0.6::double from {URLS} where gallery
union all select doc_id, 9, 'hub', 0.6::double from {URLS} where density > 0.5::double"""
PAGE_CATEGORIES = f"""
with u as (select * from ({URL_CATEGORIES}) where pattern is not null),
c as ({CONTENT_CATEGORIES}),
e as (select doc_id, place, category, confidence, pattern from u union all select doc_id, place, category, confidence, null from c),
g as (select doc_id, category, min(place) as place, max(pattern) as pattern, list(confidence order by place) as cs from e group by all),
m as (select doc_id, category, place, pattern, list_reduce(cs, lambda a, x: least(1::double, a + x * 0.5::double)) as confidence from g)"""


@query(f"select doc_id, category, confidence, pattern from ({URL_CATEGORIES}) where pattern is not null")
def url_categories(spark, sf_dir):
    c = _urls(spark, sf_dir).select("doc_id", F.explode(content.url_categories(F.col("url"))).alias("c"))
    return c.select("doc_id", "c.category", "c.confidence", F.col("c.matchedPattern").alias("pattern"))


@query(f"select doc_id, category, confidence from ({CONTENT_CATEGORIES})")
def content_categories(spark, sf_dir):
    c = _urls(spark, sf_dir).select("doc_id", F.explode(content.content_categories(F.col("words"), F.col("video"), F.col("gallery"), F.col("density"))).alias("c"))
    return c.select("doc_id", "c.category", "c.confidence")


def _page_categories(spark, sf_dir) -> DataFrame:
    u = _urls(spark, sf_dir)
    return u.select("doc_id", content.page_categories(F.col("url"), F.col("words"), F.col("video"), F.col("gallery"), F.col("density")).alias("c"))


@query(PAGE_CATEGORIES + " select doc_id, (row_number() over (partition by doc_id order by confidence desc, place))::int as rank, category, confidence, pattern from m")
def page_categories(spark, sf_dir):
    c = _page_categories(spark, sf_dir).select("doc_id", F.posexplode("c").alias("rank", "c"))
    return c.select("doc_id", (F.col("rank") + 1).alias("rank"), "c.category", "c.confidence", F.col("c.matchedPattern").alias("pattern"))


@query(PAGE_CATEGORIES + " select d.doc_id, arg_min(category, struct_pack(a := -confidence, b := place)) as category from documents d left join m using (doc_id) group by 1")
def primary_category(spark, sf_dir):
    return _page_categories(spark, sf_dir).select("doc_id", content.primary_category(F.col("c"))["category"].alias("category"))


@query(f"select doc_id, regexp_matches(url, '(?i)/live/|/live-updates?/|/breaking/|/developing/|/as-it-happens?/') as live from {URLS}")
def is_category(spark, sf_dir):
    return _urls(spark, sf_dir).select("doc_id", content.is_category(F.col("url"), "live").alias("live"))


EXTRACTIONS = f"""(select page_id, {trim_sql('title')} as t, title,
  case when page_id % 4 = 0 then null when page_id % 4 = 1 then ' ' else 'x' end as author, case when page_id % 3 = 0 then '2024' end as published, case when page_id % 2 = 0 then 'news' end as section,
  case when page_id % 5 = 0 then page_id * 7 % 12000 else words_in end as words
from (select page_id, case when page_id % 7 = 0 then 'Error 404 on this page' when page_id % 11 = 0 then '12345678901' when page_id % 13 = 0 then null else regexp_extract(html, '<title>([^<]*)', 1) end as title,
  len(list_filter(regexp_split_to_array(html, '{WS}+'), lambda w: len(w) > 0))::bigint as words_in from pages))"""
CONFIDENCE = f"""
with f as (select *, case when t is null or len(t) = 0 then 0 when len(t) < 10 then 0.3 when len(t) > 200 then 0.5 when regexp_matches(t, '(?i)^(error|404|not found|loading)') then 0.1 when regexp_matches(t, '^[0-9]+$') then 0.2
    when len(t) between 20 and 150 then 1 else 0.8 end::double as ft,
  case when words = 0 then 0::double when words < 50 then 0.2::double when words < 100 then 0.5::double when words > 10000 then 0.6::double when words >= 500 then 1::double
    else 0.5::double + (words - 100) / 400::double * 0.5::double end as fl,
  ((case when author = 'x' then 1 else 0 end) + (case when published is not null then 1 else 0 end) + (case when section is not null then 1 else 0 end)) / 3::double as fm from {EXTRACTIONS}),
s as (select *, ft * 0.3::double + fl * 0.5::double + fm * 0.2::double as s from f)
select page_id, {round2_sql('s')} as score, case when s >= 0.8::double then 'high' when s >= 0.6::double then 'good' when s >= 0.3::double then 'medium' else 'low' end as level, ft as title, fl as length, fm as metadata,
  case when s >= 0.8::double then 'Content extraction looks reliable' when ft >= 0.5 and fl >= 0.5 and fm >= 0.5 then 'Minor quality concerns'
    else 'Consider: ' || concat_ws(', ', case when ft < 0.5 then 'verify title' end, case when fl < 0.5 then 'check content length' end, case when fm < 0.5 then 'missing metadata' end) end as recommendation
from s"""


@query(CONFIDENCE)
def confidence(spark, sf_dir):
    k = F.col("page_id")
    title = F.when(k % 7 == 0, "Error 404 on this page").when(k % 11 == 0, "12345678901").when(k % 13 == 0, F.lit(None)).otherwise(F.regexp_extract("html", "<title>([^<]*)", 1))
    author = F.when(k % 4 == 0, F.lit(None)).when(k % 4 == 1, " ").otherwise("x")
    c = content.confidence(title, F.col("html"), author, F.when(k % 3 == 0, "2024"), F.when(k % 2 == 0, "news"), F.when(k % 5 == 0, k * 7 % 12000))
    p = table(spark, sf_dir, "pages").select(k, c.alias("c"))
    return p.select("page_id", "c.score", "c.level", "c.factors.title", "c.factors.length", "c.factors.metadata", "c.recommendation")


@query(f"select page_id, score from ({CONFIDENCE}) where score < 0.7::double")
def low_confidence(spark, sf_dir):
    return content.filter_low_confidence(confidence(spark, sf_dir), 0.7).select("page_id", "score")


# --- trends and anomalies ------------------------------------------------------------------


def _daily(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.col("event_type").alias("topicId"), F.to_date("ts").cast("string").alias("date")).agg(F.count("*").alias("count")).withColumn("topicName", F.upper("topicId"))


TRENDS = f"""
with daily as (select event_type as topic, ts::date as d, count(*) as n from events group by all),
r as (select *, row_number() over (partition by topic order by d desc) as k from daily),
b as (select topic, max(n) filter (k = 1) as cur, count(*) filter (k > 1) as m, avg(n::double) filter (k > 1) as mean, stddev_pop(n::double) filter (k > 1) as sd from r group by 1),
c as (select topic, cur, {round2_sql('mean')} as mean, case when m < 2 then 0::double else {round2_sql('sd')} end as sd from b where m >= 3),
z as (select *, case when sd > 0 then (cur - mean) / sd when cur > mean then 10::double else 0::double end as z, case when mean > 0 then (cur - mean) / mean * 100 when cur > 0 then 100::double else 0::double end as pct from c)
select topic as topicId, upper(topic) as topicName, cur as currentCount, mean as baselineMean, sd as baselineStdDev, {round2_sql('z')} as zScore, floor(pct + 0.5::double)::bigint as percentChange, z >= 1::double as isTrending from z"""


@query(TRENDS)
def trends(spark, sf_dir):
    return series.detect_trends(_daily(spark, sf_dir), sigma=1.0)


@query(f"select topicId, zScore from ({TRENDS.replace('z >= 1::double', 'z >= 0::double')}) where isTrending")
def trending(spark, sf_dir):
    return series.filter_trending(series.detect_trends(_daily(spark, sf_dir), sigma=0.0)).select("topicId", "zScore")


@query(f"""
with daily as (select event_type as topic, ts::date as d, count(*)::double as n from events group by all)
select topic as "topicId", count(*) as n, {round2_sql('avg(n)')} as mean, {round2_sql('stddev_pop(n)')} as stddev from daily group by 1""")
def baselines(spark, sf_dir):
    b = _daily(spark, sf_dir).groupBy("topicId").agg(F.count("*").alias("n"), series.baseline(F.col("count")).alias("b"))
    return b.select("topicId", "n", "b.mean", "b.stddev")


@query(f"""
with daily as (select event_type as topic, ts::date as d, count(*) as n from events group by all)
select topic as "topicId", d::varchar as date, n as count, {round2_sql('coalesce(avg(n::double) over w, 0)')} as "baselineMean", {round2_sql('case when count(*) over w < 2 then 0::double else stddev_pop(n::double) over w end')} as "baselineStdDev"
from daily window w as (partition by topic order by d rows between 7 preceding and 1 preceding)""")
def sliding_baselines(spark, sf_dir):
    return series.sliding_baseline(_daily(spark, sf_dir).drop("topicName"), 7)


@query("select event_type as topicId, ts::date::timestamp as date, count(*) as count from events group by all")
def streamed_counts(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_type", "ts").schema
    # The last letter as a pattern, so that one file and a folder of files are both found.
    return streaming.counted_so_far(spark, f"{sf_dir}/events.parque[t]", events, "event_type")


POINTS = "(select event_type as series, ts::date as d, count(*)::double as value from events group by all)"


def _points(spark, sf_dir) -> DataFrame:
    return _daily(spark, sf_dir).select(F.col("topicId").alias("series"), "date", F.col("count").cast("double").alias("value"))


@query(f"""
with p as {POINTS}, s as (select series, count(*) as n, avg(value) as m, stddev_pop(value) as sd from p group by 1),
z as (select p.*, m, sd, case when sd > 0 then (value - m) / sd else 0::double end as z from p join s using (series) where n >= 2)
select series, d::varchar as date, value, {round2_sql('z')} as zScore, abs(z) > 1.5::double as isAnomaly, case when abs(z) <= 1.5::double then 'normal' when z > 0 then 'above' else 'below' end as direction,
  {round2_sql('m')} as mean, {round2_sql('sd')} as "stdDev" from z""")
def anomalies(spark, sf_dir):
    return series.detect_anomalies(_points(spark, sf_dir), sigma=1.5)


@query(f"""
with p as {POINTS}, last as (select series, max(d) as d from p group by 1),
h as (select p.series, count(*) as n, avg(value) as m, stddev_pop(value) as sd from p join last l on p.series = l.series and p.d < l.d group by 1)
select p.series, p.value, case when coalesce(n, 0) < 2 then false when sd = 0 then p.value <> m else abs((p.value - m) / sd) > 1::double end as "isAnomalous"
from p join last l on p.series = l.series and p.d = l.d left join h on h.series = p.series""")
def value_anomalous(spark, sf_dir):
    p = _points(spark, sf_dir)
    last = p.groupBy("series").agg(F.max("date").alias("last"))
    p = p.join(last, "series")
    return series.value_anomalous(p.where("date = last").select("series", "value"), p.where("date < last").select("series", "value"), sigma=1.0)


@query(f"""
with p as {POINTS}, s as (select series, avg(value) as m, stddev_pop(value) as sd from p group by 1)
select series, count(*) filter (abs(value - m) / sd > 1.5::double) as n_anomalies, {round2_sql('any_value(m)')} as mean, {round2_sql('any_value(sd)')} as "stdDev", 1.5::double as threshold from p join s using (series) group by 1""")
def anomaly_report(spark, sf_dir):
    r = series.anomaly_report(_points(spark, sf_dir), sigma=1.5)
    return r.select("series", F.size(F.filter("anomalies", lambda a: a["isAnomaly"])).cast("bigint").alias("n_anomalies"), "mean", "stdDev", "threshold")


# --- TF-IDF and vectors ----------------------------------------------------------------------

OCC = f"occ as (select doc_id, unnest(t) as term, unnest(range(len(t))) as pos from (select doc_id, {STEMS} as t from documents)), c as (select doc_id, term, count(*) as n, min(pos) as first from occ group by all)"


@query(f"with {OCC} select doc_id, term, {round2_sql('0.5::double + 0.5::double * n / max(n) over (partition by doc_id)')} as tf from c")
def term_frequency(spark, sf_dir):
    tf = terms.term_frequency(terms.stem_occurrences(documents(spark, sf_dir)))
    return tf.select("doc_id", "term", (F.floor(F.col("tf") * 100 + F.lit(0.5)) / F.lit(100.0)).alias("tf"))


@query(f"with {OCC}, n as (select count(*) as n from documents) select term, count(*) as df, {round2_sql('ln(((select n from n)::double + 1) / (count(*)::double + 1)) + 1')} as idf from c group by 1")
def document_frequency(spark, sf_dir):
    d = documents(spark, sf_dir)
    df, total = terms.document_frequency(d), d.count()
    return df.withColumn("idf", F.floor(terms.idf(F.lit(total), F.col("df")) * 100 + F.lit(0.5)) / F.lit(100.0))


@query(f"""with {OCC}, df as (select term, count(*) as df from c group by 1), n as (select count(*) as n from documents),
s as (select doc_id, term, first, (0.5::double + 0.5::double * n / max(n) over (partition by doc_id)) * (ln(((select n from n)::double + 1) / (df::double + 1)) + 1) as score from c join df using (term)),
r as (select *, (row_number() over (partition by doc_id order by score desc, first))::int as rank from s)
select doc_id, rank, term as word, {round2_sql('score')} as score from r where rank <= 10""")
def keywords(spark, sf_dir):
    d = documents(spark, sf_dir)
    k = terms.keywords(d, n=10)
    return k.withColumn("score", F.floor(F.col("score") * 100 + F.lit(0.5)) / F.lit(100.0))


@query(f"""with occ as (select doc_id, unnest(t) as term, unnest(range(len(t))) as pos from (select doc_id, {tokens_sql('text')} as t from documents)),
f as (select term, min(struct_pack(d := doc_id, p := pos)) as place from occ group by 1) select term, (row_number() over (order by place) - 1)::bigint as "index" from f""")
def vocabulary(spark, sf_dir):
    return terms.vocabulary(documents(spark, sf_dir), text.tokenize(F.col("text")))


@query(f"""with occ as (select doc_id, unnest({tokens_sql('text', 2, True)}) as term from documents), c as (select doc_id, term, count(*) as n from occ group by all),
nm as (select doc_id, sqrt(sum(n * n)::double) as norm from c group by 1),
dots as (select q.doc_id as query_id, c.doc_id, sum(q.n * c.n)::bigint as dot from c q join c using (term) where q.doc_id % 100 = 0 and q.doc_id <> c.doc_id group by all),
s as (select query_id, d.doc_id, dot / (a.norm * b.norm) as score from dots d join nm a on a.doc_id = query_id join nm b on b.doc_id = d.doc_id),
r as (select *, (row_number() over (partition by query_id order by score desc, doc_id))::int as rank from s)
select query_id, rank, doc_id, {round2_sql('score')} as score from r where rank <= 5""")
def similar_documents(spark, sf_dir):
    d = documents(spark, sf_dir)
    s = terms.similar_documents(d, d.where("doc_id % 100 = 0"), 5)
    return s.withColumn("score", F.floor(F.col("score") * 100 + F.lit(0.5)) / F.lit(100.0))


@query("""with e as (select vec_id, list_transform(embedding, lambda x: x::double) as v from embeddings), p as (select a.vec_id, a.v as a, b.v as b from e a join e b on b.vec_id = a.vec_id + 1)
select vec_id, floor(list_inner_product(a, b) * 1000 + 0.5::double)::bigint as dot, floor(list_cosine_similarity(a, b) * 1000 + 0.5::double)::bigint as cosine, floor(list_distance(a, b) * 1000 + 0.5::double)::bigint as euclidean from p""")
def vector_metrics(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("a"))
    p = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b")), "vec_id")
    milli = lambda c: F.floor(c * 1000 + F.lit(0.5)).cast("bigint")
    a, b = F.col("a"), F.col("b")
    return p.select("vec_id", milli(vectors.dot(a, b)).alias("dot"), milli(vectors.cosine(a, b)).alias("cosine"), milli(vectors.euclidean(a, b)).alias("euclidean"))


@query(f"""with t as (select doc_id, list_distinct({tokens_sql('text')}) as t from documents)
select a.doc_id, case when len(a.t) + len(b.t) = 0 then 1::double else len(list_intersect(a.t, b.t)) / (len(a.t) + len(b.t) - len(list_intersect(a.t, b.t)))::double end as jaccard from t a join t b on b.doc_id = a.doc_id + 1""")
def jaccard(spark, sf_dir):
    t = documents(spark, sf_dir).select("doc_id", F.array_distinct(text.tokenize(F.col("text"))).alias("a"))
    p = t.join(t.select((F.col("doc_id") - 1).alias("doc_id"), F.col("a").alias("b")), "doc_id")
    return p.select("doc_id", vectors.jaccard(F.col("a"), F.col("b")).alias("jaccard"))


BAG = ("the", "of", "and", "que", "der", "absent")


@query("select doc_id, " + ", ".join(f"len(list_filter(t, lambda w: w = '{w}'))::bigint as n_{w}" for w in BAG) + f" from (select doc_id, {tokens_sql('text')} as t from documents)")
def bag_of_words(spark, sf_dir):
    v = documents(spark, sf_dir).select("doc_id", vectors.bag_of_words(text.tokenize(F.col("text")), F.array(*map(F.lit, BAG))).alias("v"))
    return v.select("doc_id", *(F.get("v", k).alias(f"n_{w}") for k, w in enumerate(BAG)))


# --- places and planning --------------------------------------------------------------------------

NAMES = ("São Tomé", "México  City", "Côte d’Ivoire", "New\tZealand", "Åland - Islands", "Straße")
_NAME_SQL = "[" + ", ".join(f"'{n}'" for n in NAMES) + "]"
PLACES = f"(select n_nationkey, {_NAME_SQL}[n_nationkey % {len(NAMES)} + 1] || ' ' || n_name as name, case when n_nationkey % 2 = 0 then 'C' || n_nationkey end as code, case when n_nationkey % 3 = 0 then 'Slug-' || n_nationkey end as slug, n_name as other from nation)"


def slug_sql(c: str) -> str:
    return f"regexp_replace(regexp_replace(regexp_replace(strip_accents(lower({c})), '[^a-z0-9\\-{WS[1:]}', '', 'g'), '{WS}+', '-', 'g'), '-+', '-', 'g')"


VARIANTS = f"list_filter([{slug_sql('name')}, lower(code), lower(slug), {slug_sql('other')}], lambda v: v is not null and len(v) > 0)"


def _places(spark, sf_dir) -> DataFrame:
    k = F.col("n_nationkey")
    name = F.concat(F.get(F.array(*map(F.lit, NAMES)), (k % len(NAMES)).cast("int")), F.lit(" "), F.col("n_name"))
    return table(spark, sf_dir, "nation").select(
        k, name.alias("name"), F.when(k % 2 == 0, F.concat(F.lit("C"), k.cast("string"))).alias("code"), F.when(k % 3 == 0, F.concat(F.lit("Slug-"), k.cast("string"))).alias("slug"), F.array("n_name").alias("nameVariants")
    )


@query(f"select n_nationkey, {slug_sql('name')} as slug from {PLACES}")
def slug(spark, sf_dir):
    return _places(spark, sf_dir).select("n_nationkey", geo.to_slug(F.col("name")).alias("slug"))


@query(f"select n_nationkey, array_to_string(v, '|') as variants from (select n_nationkey, {VARIANTS} as v from {PLACES})")
def name_variants(spark, sf_dir):
    v = geo.name_variants(F.col("name"), F.col("code"), F.col("slug"), F.col("nameVariants"))
    return _places(spark, sf_dir).select("n_nationkey", F.array_join(v, "|").alias("variants"))


def _hub_sql(patterns) -> str:
    rows = ", ".join(f"({k}, '{p}', {w}::double)" for k, (p, w) in enumerate(patterns))
    return f"""
with v as (select n_nationkey, unnest(v) as v, unnest(range(len(v))) as j from (select n_nationkey, {VARIANTS} as v from {PLACES})),
u as (select n_nationkey, 'https://news.example' || replace(p.pattern, '{{slug}}', v) as url, p.weight, p.k, j from v, (values {rows}) as p(k, pattern, weight)),
d as (select *, row_number() over (partition by n_nationkey, url order by weight desc, k, j) as n from u)
select n_nationkey, (row_number() over (partition by n_nationkey order by weight desc, k, j))::int as rank, url, weight from d where n = 1"""


@query(_hub_sql(geo.COUNTRY_PATTERNS))
def hub_urls(spark, sf_dir):
    return places.predict_hub_urls(_places(spark, sf_dir), F.lit("news.example")).select("n_nationkey", "rank", "url", "weight")


@query(_hub_sql(geo.CITY_PATTERNS))
def city_hub_urls(spark, sf_dir):
    return places.predict_hub_urls(_places(spark, sf_dir), F.lit("https://news.example"), geo.CITY_PATTERNS).select("n_nationkey", "rank", "url", "weight")


_HEADS = ("/world/", "/tag/", "/news/", "/", "/x/", "/world/x/", "/topics/", "/country/", "")
_TAILS = ("", "/", "?x=1", "#c", "/more", "/?y#z")
_SLUG_URLS = f"""(select p_partkey, case when p_partkey % 17 = 0 then 'not a url' else 'https://a.example' || [{', '.join(f"'{h}'" for h in _HEADS)}][p_partkey % {len(_HEADS)} + 1] || 'Place-' || p_partkey
  || [{', '.join(f"'{t}'" for t in _TAILS)}][p_partkey // 10 % {len(_TAILS)} + 1] end as url from part)"""
_SLUG_CASES = " ".join(
    f"when regexp_full_match(path, '{p.replace('{slug}', '([^/]+)')}') then regexp_extract(path, '^{p.replace('{slug}', '([^/]+)')}$', 1)" for p, _ in geo.COUNTRY_PATTERNS if "{slug}" in p
)


@query(f"""
with u as (select p_partkey, case when regexp_matches(url, '^https://[^/?#]+') then regexp_extract(url, '^https://[^/?#]+([^?#]*)', 1) end as path from {_SLUG_URLS})
select p_partkey, case {_SLUG_CASES} end as slug from (select p_partkey, case when path = '' then '/' else path end as path from u)""")
def slug_from_url(spark, sf_dir):
    k = F.col("p_partkey")
    head, tail = (F.get(F.array(*map(F.lit, x)), i.cast("int")) for x, i in ((_HEADS, k % len(_HEADS)), (_TAILS, F.expr("p_partkey div 10") % len(_TAILS))))
    url = F.when(k % 17 == 0, "not a url").otherwise(F.concat(F.lit("https://a.example"), head, F.lit("Place-"), k.cast("string"), tail))
    return table(spark, sf_dir, "part").select(k, geo.slug_from_url(url).alias("slug"))


@query(f"select n_nationkey, n_nationkey % 4 = 0 as covered from {PLACES}")
def gaps(spark, sf_dir):
    p = _places(spark, sf_dir)
    return places.analyze_gaps(p.where("n_nationkey % 4 = 0").select(F.upper("name").alias("name")), p).select("n_nationkey", "covered")


@query("select count(*) filter (n_nationkey % 4 = 0) as covered, count(*) filter (n_nationkey % 4 <> 0) as missing, floor(count(*) filter (n_nationkey % 4 = 0) / count(*)::double * 100 + 0.5::double)::bigint as \"coveragePercent\" from nation")
def coverage(spark, sf_dir):
    p = _places(spark, sf_dir)
    return places.coverage(places.analyze_gaps(p.where("n_nationkey % 4 = 0").select("name"), p)).select("covered", "missing", "coveragePercent")


PRIORITY = """
with s as (select page_id, url, page_id * 37 % 400 - 2 as seen, case when page_id % 3 = 0 then page_id % 60 end as changed, (page_id % 11) / 10::double as rel, page_id % 7 as depth, page_id % 4 = 0 as hub from pages)
select page_id, url, greatest(0, least(100, 50 + case when seen < 1 then -30 when seen < 24 then -10 when seen > 168 then 15 else 0 end + case when changed < 24 then 20 else 0 end + floor(rel * 15 + 0.5::double)::bigint
    + case when hub then 10 else 0 end + case when depth > 3 then -5 else 0 end))::bigint as score,
  concat_ws('|', case when seen < 1 then 'Recently visited (<1h)' when seen < 24 then 'Visited today' when seen > 168 then 'Not visited in 7+ days' end, case when changed < 24 then 'Changed in last 24h' end,
    case when rel > 0.8::double then 'High topic relevance' end, case when hub then 'Is a hub page' end, case when depth > 3 then 'Deep URL' end) as reasons from s"""


def _url_signals(spark, sf_dir) -> DataFrame:
    k, now = F.col("page_id"), 1_700_000_000
    return table(spark, sf_dir, "pages").select(
        k, "url", F.timestamp_seconds(now - (k * 37 % 400 - 2) * 3600).alias("lastVisited"), F.when(k % 3 == 0, F.timestamp_seconds(now - k % 60 * 3600)).alias("lastChanged"),
        ((k % 11) / 10).alias("topicRelevance"), (k % 7).alias("hubDepth"), (k % 4 == 0).alias("isHub"),
    )


@query(PRIORITY)
def url_priority(spark, sf_dir):
    c = F.col
    p = planning.url_priority(c("lastVisited"), c("lastChanged"), c("topicRelevance"), c("hubDepth"), c("isHub"), F.timestamp_seconds(F.lit(1_700_000_000)))
    r = _url_signals(spark, sf_dir).select("page_id", "url", p.alias("p"))
    return r.select("page_id", "url", "p.score", F.array_join("p.reasons", "|").alias("reasons"))


@query(f"select page_id, url, score, reasons from ({PRIORITY})")
def crawl_rank(spark, sf_dir):
    ranked = planning.rank_urls(_url_signals(spark, sf_dir), F.timestamp_seconds(F.lit(1_700_000_000)))
    return ranked.select("page_id", "url", "score", F.array_join("reasons", "|").alias("reasons"))


TEXTRANK = f"""
with recursive s as (select doc_id, unnest(ss) as sentence, unnest(range(len(ss)))::int as i from (select doc_id, {SENTENCES} as ss from documents)),
t as (select doc_id, i, unnest({tokens_sql('sentence', 2, True)}) as w from s),
c as (select doc_id, i, w, count(*) as n from t group by all),
z as (select doc_id, i, ln(sum(n)::double) as z from c group by all),
h as (select a.doc_id, a.i, b.i as j, sum(a.n)::double as shared from c a join c b on a.doc_id = b.doc_id and a.w = b.w and a.i <> b.i group by all),
e as (select h.doc_id, h.i, h.j, shared / (x.z + y.z) as w from h join z x on x.doc_id = h.doc_id and x.i = h.i join z y on y.doc_id = h.doc_id and y.i = h.j where x.z + y.z <> 0),
p as materialized (select doc_id, i, j, w / sum(w) over (partition by doc_id, i) as p from e where w >= 0.1::double),
walk(doc_id, i, it, score, done) as (
  select doc_id, i, 0, 1::double, count(*) over (partition by doc_id) = 1 from s
  union all
  select doc_id, i, it + 1, new, max(abs(new - score)) over (partition by doc_id) <= 1e-4::double or it + 1 >= 100
  from (
    select a.doc_id, a.i, a.it, a.score, 0.15::double + 0.85::double * coalesce(g.got, 0) as new
    from (select * from walk where not done) a
    left join (select b.doc_id, p.j, sum(p.p * b.score) as got from walk b join p on p.doc_id = b.doc_id and p.i = b.i where not b.done group by all) g on g.doc_id = a.doc_id and g.j = a.i)),
last as (select doc_id, i, arg_max(score, it) as score from walk group by all)
select doc_id, (row_number() over (partition by doc_id order by round(score, 9) desc, i))::int as rank, i as index, sentence, floor(score * 10000 + 0.5::double) / 10000::double as score
from last join s using (doc_id, i)"""


@query(TEXTRANK)
def textrank(spark, sf_dir):
    r = summaries.textrank(documents(spark, sf_dir))
    return r.withColumn("score", F.floor(F.col("score") * 10_000 + F.lit(0.5)) / F.lit(10_000.0))


@query(f"select doc_id, index, sentence from ({TEXTRANK}) where rank <= 3")
def summary(spark, sf_dir):
    return summaries.summarize(documents(spark, sf_dir), 3)


@query(f"with {SIMHASH} select doc_id, simhash from sim")
def simhash_in_sql(spark, sf_dir):
    register_sql(spark)
    documents(spark, sf_dir).select("doc_id", text.hash_tokens(F.col("text")).alias("tokens")).createOrReplaceTempView("presswork_tokens")
    return spark.sql("select doc_id, simhash_of(tokens) as simhash from presswork_tokens")


@query("""
with s as (select page_id, case when page_id % 5 = 0 then 'no url' else url end as url, page_id % 9 - 1 as visits, (page_id % 13) / 10::double as rel, page_id % 4 - 1 as depth, page_id % 11 = 0 as unseen from pages),
f as (select page_id, concat_ws(',', case when not coalesce(regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*:.+'), false) then 'url' end, case when visits < 0 then 'visits' end, case when unseen then 'lastVisited' end,
  case when rel > 1 then 'topicRelevance' end, case when depth < 0 then 'hubDepth' end) as reason from s)
select page_id, reason from f where reason <> ''""")
def contract_violations(spark, sf_dir):
    k = F.col("page_id")
    urls = table(spark, sf_dir, "pages").select(
        k, F.when(k % 5 == 0, "no url").otherwise(F.col("url")).alias("url"), (k % 9 - 1).alias("visits"), F.when(k % 11 != 0, F.timestamp_seconds(F.lit(1_700_000_000))).alias("lastVisited"),
        ((k % 13) / 10).alias("topicRelevance"), (k % 4 - 1).alias("hubDepth"),
    )
    return contracts.validate(urls, "UrlSignals")[1].select("page_id", "reason")
