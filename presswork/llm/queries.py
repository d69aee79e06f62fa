"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presswork.llm import chat, html, langid, mixing, neardup, pieces, quality, suffixes, topk, warc
from presswork.llm.common import new_path, read

#: The conversation that every formatting run must survive (a fixed value).
TRICKY = r"\### Assistant: </turn> ok"


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"), threshold=0.8)


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = spark.createDataFrame([(-7, 0, "user", TRICKY), (-7, 1, "assistant", TRICKY)], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.chat_windows(turns.unionByName(tricky)))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffixes.without_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"), length=400)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op4_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.top_k(vectors, F.col("vec_id") % 20 == 0, k=20, scale=64.0)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.quality_rules(docs, keep_text=False).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_texts(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mixed(docs, keep_text=False).select("doc_id", "size", "source_size", "target", "taken")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    warc.write_archive(read(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    records = warc.read_archive(spark, path, payload=False).where("gap is null")
    return records.select("page_id", "payload_bytes", "payload_digest", F.col("warc_type").alias("record_type"), "refers_to")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    trees = langid.train(docs.select("doc_id", "lang", "text"))
    out = langid.predict_language(docs.select("doc_id", "text"), trees)
    return out.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(read(spark, sf_dir, "pages").select("page_id", "url", "html"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op10_language_id": op10_language_id,
    "op1_minhash_dedup": op1_minhash_dedup,
    "op2_chat_formatting": op2_chat_formatting,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_topk_search": op4_topk_search,
    "op5_quality_rules": op5_quality_rules,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_mixing": op7_mixing,
    "op8_warc": op8_warc,
    "op9_html_extraction": op9_html_extraction,
}

def _quality_sql() -> str:
    """Measures, votes and a hundred rounds of estimation over the table of vote patterns."""
    names = list(quality.RULES)
    good, bad = (
        "case x when 1 then {} when 0 then {} else {} end".format(*(f"{quality.EXPECTED[kind][x]}::double" for x in (1, 0, -1))) for kind in ("good", "bad")
    )
    votes = ", ".join(f"case when {b} then -1 when {g} then 1 else 0 end" for g, b in quality.RULES.values())
    return rf"""
with recursive t as (select doc_id, coalesce(text, '') as text from documents),
w as (
  select doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as w,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l from t),
g as (select doc_id, unnest(range(1, greatest(len(w) - 1, 1))) as i, w from w),
g3 as (select doc_id, i, count(*) over (partition by doc_id, w[i], w[i + 1], w[i + 2]) as c from g),
r as (select doc_id, count(distinct p) as n from (select doc_id, unnest([i, i + 1, i + 2]) as p from g3 where c > 1) group by 1),
m as (
  select w.doc_id, len(w)::bigint as n_words, len(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::bigint as word_chars, (len(text) - len(translate(text, '#*$%&|<>', '')))::bigint as n_symbols,
    (len(l) - len(list_distinct(l)))::bigint as n_dup_lines, coalesce(r.n, 0)::bigint as n_repeat_words, len(l)::bigint as n_lines, (len(text) - len(translate(text, '.!?', '')))::bigint as n_stops,
    len(regexp_extract_all(text, '\p{{Lu}}'))::bigint as n_upper, (len(text) - len(translate(text, '|' || chr(9), '')))::bigint as n_bars
  from w left join r using (doc_id)),
v as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed, [{votes}] as v from m),
pat as (select v, count(*)::double as n from v where not base_failed group by 1),
em(it, v, n, post) as (
  select 0, v, n, case len(list_filter(v, lambda x: x < 0)) when 0 then 0.95::double when 1 then 0.2::double else 0.05::double end from pat
  union all
  select any_value(e.it) + 1, e.v, any_value(e.n), 1 / (1 + exp(-greatest(-500, least(500, any_value(ln(q.pi / (1 - q.pi))) + sum(ln(q.g / q.b))))))
  from (select it, v, n, unnest(v) as x, unnest(range(len(v))) as j from em where it < 100) e
  join (
    select j, x, any_value((mass + 0.9 * pull) / (total + pull)) as pi, any_value((pull * ({good}) + gx) / (pull + mass)) as g, any_value((pull * ({bad}) + bx) / (pull + total - mass)) as b
    from (
      select j, x, sum(n * post) as gx, sum(n * (1 - post)) as bx, any_value(mass) as mass, any_value(total) as total, any_value(total) * {quality.EXPECTED_WEIGHT}::double as pull
      from (select n, post, mass, total, unnest(v) as x, unnest(range(len(v))) as j from (select *, sum(n * post) over () as mass, sum(n) over () as total from em)) group by all)
    group by all) q on e.j = q.j and e.x = q.x
  group by e.v),
p as (select v, post from em where it = 100)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and coalesce(post, 0) >= 0.5 as kept from v left join p using (v)
"""


SQL: dict[str, str] = {
    "op5_quality_rules": _quality_sql(),
    "op1_minhash_dedup": r"""
with recursive w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
s as (
  select distinct doc_id, unnest(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s from w),
n as (select doc_id, count(*) as n from s group by 1),
met as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.s = b.s and a.doc_id <> b.doc_id group by all),
links as (select a, b from met join n x on x.doc_id = a join n y on y.doc_id = b where c / (x.n + y.n - c)::double >= 0.8::double),
reach(doc_id, other) as (select doc_id, doc_id from documents union select r.doc_id, l.b from reach r join links l on l.a = r.other)
select doc_id, min(other) as class_id from reach group by 1
""",
    "op2_chat_formatting": r"""
with recursive t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
o as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as k from t),
f as (
  select *, k = 1 and role = 'system' as sys,
    '### ' || replace(regexp_replace(role, '(\\|###|</turn>)', '\\\1', 'g'), ':', '\:') || ': ' || regexp_replace(text, '(\\|###|</turn>)', '\\\1', 'g') || ' </turn>' || chr(10) as shown from o),
c as (
  select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by k)) as turns_sha256,
    coalesce(string_agg(text, '' order by k) filter (role = 'assistant'), '') as loss,
    coalesce(max((octet_length(encode(shown)) + 3) // 4) filter (sys), 0)::bigint as fixed, coalesce(max(len(shown)) filter (sys), 0)::bigint as sys_chars,
    coalesce(list(((octet_length(encode(shown)) + 3) // 4)::bigint order by k) filter (not sys), []) as ts, coalesce(list(len(shown)::bigint order by k) filter (not sys), []) as cs
  from f group by 1),
s as (
  select *, len(ts)::bigint as n, list_transform(range(0, len(ts) + 1), lambda x: coalesce(list_sum(ts[1:x]), 0)::bigint) as p,
    list_transform(range(0, len(ts) + 1), lambda x: coalesce(list_sum(cs[1:x]), 0)::bigint) as q from c),
walk(conv_id, i, chars, windows) as (
  select conv_id, 0::bigint, 0::bigint, 0::bigint from s
  union all
  select conv_id, e, chars + sys_chars + q[e + 1] - q[coalesce(list_min(list_filter(range(b, i + 1), lambda x: fixed + p[e + 1] - p[x + 1] <= 2048)), i) + 1], windows + 1
  from (select *, greatest(least(i + 1, n), coalesce(list_max(list_filter(range(i + 1, n + 1), lambda x: fixed + p[x + 1] - p[b + 1] <= 2048)), 0))::bigint as e
    from (select w.*, s.n, s.p, s.q, s.fixed, s.sys_chars, list_min(list_filter(range(0, w.i + 1), lambda x: s.p[w.i + 1] - s.p[x + 1] <= 512)) as b
      from walk w join s using (conv_id) where w.i < s.n or w.windows = 0)))
select s.conv_id, n_turns, turns_sha256, len(loss)::bigint as loss_chars, sha256(loss) as loss_sha256, max(chars) as formatted_chars, max(windows) as n_windows
from s join walk using (conv_id) group by all
""",
    "op4_topk_search": r"""
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) as q from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select a.vec_id as query_id, b.vec_id, list_inner_product(a.q, b.q)::bigint as score
  from v a join v b on a.vec_id % 20 = 0 and a.vec_id <> b.vec_id),
r as (select *, (row_number() over (partition by query_id order by score desc, vec_id))::int as rank from s)
select query_id, rank, vec_id, score from r where rank <= 20
""",
    "op7_mixing": r"""
with sized as (
  select doc_id, source, size, -ln((('0x' || substr(md5('mix' || coalesce(cast(doc_id as varchar), 'null')), 1, 13))::bigint::double + 0.5) / 4503599627370496.0::double)
    / least(1.0::double, (size::double + 1::double) / 200::double) as key
  from (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size from documents)),
sources as (
  select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) as n from sized group by source),
w as (select *, ((n - 1) % 3 + 1)::double as w, (3 * source_size)::double as cap from sources),
levels as (
  select *, ((sum(source_size) over ())::double - coalesce(sum(cap) over (order by cap / w, n rows between unbounded preceding and 1 preceding), 0))
    / sum(w) over (order by cap / w, n rows between current row and unbounded following) as level from w),
target as (
  select source, source_size, least(cap, coalesce((select level from levels where cap >= level * w order by cap / w, n limit 1), 0) * w) as target from levels),
plan as (
  select *, case when source_size > 0 then floor(target / source_size)::bigint else 0 end as epochs from target),
run as (
  select d.doc_id, d.size, p.source_size, p.target, p.epochs, p.target - (p.epochs * p.source_size)::double as rest,
    coalesce(sum(d.size) over (partition by d.source order by d.key, d.doc_id nulls first, d.size rows between unbounded preceding and 1 preceding), 0) as before
  from sized d join plan p on d.source is not distinct from p.source)
select doc_id, size, source_size, target, (case when size > 0 then size * (epochs + case when before + size / 2.0::double <= rest then 1 else 0 end) else 0 end)::bigint as taken
from run
""",
    "op8_warc": r"""
with p as (select page_id, coalesce(html, '') as html from pages),
d as (select page_id, octet_length(encode(html))::bigint as n, sha1(html) as h from p),
b as (select page_id, n, h, list_transform(range(20), lambda i: ('0x' || substr(h, (2 * i + 1)::int, 2))::int) || [0] as bytes, max(page_id) over (partition by h) as top from d)
select page_id, n as payload_bytes,
  array_to_string(list_transform(range(32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (((bytes[(5 * j) // 8 + 1] * 256 + bytes[(5 * j) // 8 + 2]) >> (11 - (5 * j) % 8)::int) & 31)::int + 1, 1)), '') as payload_digest,
  case when top is null or page_id = top then 'response' else 'revisit' end as record_type,
  case when page_id <> top then top end as refers_to
from b
""",
    "op9_html_extraction": r"""
with a as (
  select page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article[^>]*>(.*?)(</article>|$)', 1) as h from pages),
b as (
  select page_id, url, list_filter(list_transform(regexp_split_to_array(h, '</?(p|h1|br)[^>]*>'),
    lambda x: trim(regexp_replace(regexp_replace(replace(regexp_replace(x, '<[^>]*(>|$)', '', 'g'), '&quot;', '"'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))), lambda x: x <> '') as t from a)
select page_id, url, array_to_string(t, ' ') as text, len(array_to_string(t, ' '))::bigint as n_chars from b
""",
    "op3_suffix_dedup": r"""
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
w as (select doc_id, i, md5(substr(h, (2 * i + 1)::bigint, 800)) as m from (select doc_id, h, unnest(range(0, greatest(len(h) // 2 - 399, 0))) as i from d)),
u as (select m from w group by m having count(*) > 1),
r as (select doc_id, i, i > coalesce(lag(i) over (partition by doc_id order by i), -1000) + 400 as fresh from w semi join u using (m)),
g as (select doc_id, i, sum(fresh::int) over (partition by doc_id order by i) as k from r),
s as (select doc_id, k, min(i) as a, max(i) + 400 as b from g group by all),
p as (select doc_id, a, b, coalesce(lag(b) over (partition by doc_id order by a), 0) as was from s),
kept as (select doc_id, string_agg(substr(h, (2 * was + 1)::bigint, (2 * (a - was))::bigint), '' order by a) || substr(any_value(h), (2 * max(b) + 1)::bigint) as rest, sum(b - a) as gone, count(*) as n from d join p using (doc_id) group by doc_id)
select d.doc_id, (len(d.h) // 2)::bigint as n_bytes, coalesce(gone, 0)::bigint as n_removed, coalesce(n, 0)::bigint as n_spans, sha256(unhex(coalesce(rest, d.h))) as kept_sha256
from d left join kept using (doc_id)
""",
}
