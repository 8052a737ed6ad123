"""The queries of this subpackage: each applies one operator, with production parameters, to a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch, ship

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(f):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return f(ship(spark), lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

    QUERIES[f.__name__] = run
    return f


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_html_text(spark, table) -> DataFrame:
    from .html_text import main_text

    return main_text(table("pages"))


@query
def op2_decontaminate(spark, table) -> DataFrame:
    from .decontaminate import contaminated

    return contaminated(table("documents"), table("benchmark"))


@query
def op3_line_dedup(spark, table) -> DataFrame:
    from .line_dedup import dedup_lines

    return dedup_lines(table("documents").select("doc_id", "text"), min_words=50)


ORACLE["op3_line_dedup"] = r"""
with raw as (select doc_id, text, string_split(text, chr(10)) as raw from documents),
b as (select *, list_transform(raw, lambda x: trim(x, chr(32) || chr(9) || chr(11) || chr(12) || chr(13))) as bare from raw),
d as (select doc_id, text, raw, list_filter(bare, lambda x: x <> '') as ls, list_filter(range(len(raw)), lambda i: bare[i + 1] <> '') as place from b),
l as (select doc_id, unnest(range(len(ls))) as i, unnest(list_transform(ls, lambda x: len(string_split_regex(x, '[ \t\r\v\f]+')))) as w from d),
c as (select doc_id, i, w, cast(sum(w) over (partition by doc_id order by i) as bigint) as upto from l),
s as (select a.doc_id, a.i as s, min(b.i) - a.i + 1 as m from c a join c b on a.doc_id = b.doc_id and b.i >= a.i and b.i < a.i + 50 and b.upto - a.upto + a.w >= 50 group by a.doc_id, a.i
  union
  select a.doc_id, max(b.i) as s, a.i - max(b.i) + 1 as m from c a join c b on a.doc_id = b.doc_id and b.i <= a.i and b.i > a.i - 50 and a.upto - b.upto + b.w >= 50 group by a.doc_id, a.i),
k as (select s.doc_id, s, m, list_slice(ls, s + 1, s + m) as run from s join d using (doc_id)),
f as (select run, min(struct_pack(d := doc_id, s := s)) as head from k group by run having count(*) > 1),
g as (select distinct k.doc_id, unnest(range(case when head.d = k.doc_id then greatest(k.s, head.s + m) else k.s end, k.s + m)) as i
  from k join f on k.run = f.run where k.doc_id > head.d or k.doc_id = head.d and k.s > head.s),
gone as (select doc_id, list(i) as gone from g group by doc_id),
lost as (select doc_id, flatten(list_transform(gone, lambda i: range(place[i + 1], coalesce(place[i + 2], len(raw))))) as lost from gone join d using (doc_id))
select d.doc_id, case when gone is null then text else array_to_string(list_transform(list_filter(range(len(raw)), lambda i: not list_contains(lost, i)), lambda i: raw[i + 1]), chr(10)) end as text,
  cast(len(ls) as int) as n_lines, cast(coalesce(len(gone), 0) as int) as n_deleted
from d left join gone using (doc_id) left join lost using (doc_id)
"""


@query
def op4_katz(spark, table) -> DataFrame:
    from .katz import score

    return score(table("documents"))


@query
def op5_token_store(spark, table) -> DataFrame:
    from . import token_store as ts

    store = ts.write(table("documents"), scratch(spark, "store"), vocabulary("word_bpe_49k.json"), end_id=1)
    return ts.read(store.placed, store).select("doc_id", "start", "n_tokens", "ids_crc32")


@query
def op7_byte_bpe(spark, table) -> DataFrame:
    import public_tokenizers

    from .byte_bpe import encode

    return encode(table("documents"), vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False)


#: host, path and verdict of the rules to judge by
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


@query
def op8_url_filter(spark, table) -> DataFrame:
    """The listed URLs are those that a page was met under with a tracking parameter: their page is blocked under any address."""
    from .url_filter import url_filter

    pages = table("pages")
    return url_filter(pages, spark.createDataFrame(RULES, "host string, path string, verdict string"), pages.where(F.col("url").contains("utm_source=")).select("url"))


ORACLE["op8_url_filter"] = r"""
with u as (
  select page_id, url,
    case when url like '%://%' then translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') else '' end as host,
    case when url like '%://%' then regexp_extract(url, '://[^/?#]*([^?#]*)', 1) else '' end as path
  from pages),
c as (select page_id, regexp_replace(host, '^www\.', '') || regexp_replace(regexp_replace(path, '/index\.html?$', '/'), '/+$', '') as canonical, url like '%utm_source=%' as listed from u),
hit as (select distinct c.page_id from c join (select distinct canonical from c where listed) l using (canonical) join u using (page_id) where u.host <> ''),
rules(rhost, rpath, rverdict) as (values ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
fits as (
  select distinct url, rhost || rpath as rule, rverdict from (select distinct url, host, path from u) x join rules
  on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath)),
best as (select url, arg_max(rule, length(rule)) as rule, arg_max(rverdict, length(rule)) as verdict from fits group by url)
select u.page_id, u.url, u.host, u.path, best.rule, coalesce(best.verdict, case when hit.page_id is not null then 'block' else 'allow' end) as verdict
from u left join best on u.url = best.url left join hit on u.page_id = hit.page_id
"""


@query
def op6_crf_quality(spark, table) -> DataFrame:
    from .crf_quality import held_out, score, train

    docs = table("documents").select("doc_id", "text")
    scored = score(docs, train(docs, table("labels")))
    return scored.select("doc_id", held_out(F.col("doc_id"), 4).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query
def op9_top_k(spark, table) -> DataFrame:
    from .topk import integers, top_k, usable

    vectors = table("embeddings").where(usable(F.col("embedding"))).select("vec_id", integers(F.col("embedding")).alias("v"))
    return top_k(vectors, vectors.where("vec_id % 100 = 0"), 10)


ORACLE["op9_top_k"] = """
with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as v from embeddings
  where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id as vec_id, cast(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) as bigint) as score
  from v q join v c on q.vec_id <> c.vec_id and q.vec_id % 100 = 0),
r as (select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank, vec_id, score from s)
select query_id, rank, vec_id, score from r where rank <= 10
"""


@query
def op10_simhash(spark, table) -> DataFrame:
    from ..session import keep
    from .simhash import as_hex, fingerprints, near_duplicates

    prints = keep(fingerprints(table("documents"), size=3, seed=42), "prints")
    return near_duplicates(prints, max_bits=2).select("doc_id", as_hex(F.col("fp")).alias("fingerprint"), "component_id")


@query
def op11_filter_audit(spark, table) -> DataFrame:
    from .filter_audit import audit

    return audit(table("documents"), table("labels"))


ORACLE["op11_filter_audit"] = r"""
with t as (select doc_id, coalesce(text, '') as text, coalesce(lang, '') as part from documents),
w as (select *, list_filter(string_split_regex(text, '[ \t\n\v\f\r]+'), lambda x: x <> '') as ws, min(doc_id) over (partition by text) as least from t),
l as (select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic from labels group by doc_id),
f as (select part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic, [len(ws) < 200, 100 * len(list_distinct(ws)) < 50 * len(ws),
    100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text), regexp_matches(text, '[#$%&*|]'), coalesce(doc_id > least, false)] as fails
  from w left join l using (doc_id)),
letters(x, k) as (values ('A', 1), ('B', 2), ('C', 3), ('D', 4), ('E', 5)),
orders as (select a.x || b.x || c.x || d.x || e.x as filter_order, [a.k, b.k, c.k, d.k, e.k] as ks from letters a, letters b, letters c, letters d, letters e
  where b.k <> a.k and c.k not in (a.k, b.k) and d.k not in (a.k, b.k, c.k) and e.k not in (a.k, b.k, c.k, d.k)),
steps as (select filter_order, cast(s as int) as step, ks[s] as k, ks[1:s - 1] as before from orders, range(1, 6) r(s)),
g as (select part, fails, count(*) as n, sum(good) as good, sum(toxic) as toxic from f group by part, fails),
j as (select g.*, filter_order, step, k, fails[k] as own, len(list_filter(before, lambda b: fails[b])) > 0 as earlier,
    len(list_filter(fails, lambda b: b)) as many from g, steps),
r as (select part, filter_order, step, k, sum(case when not own and not earlier then n else 0 end) as kept, sum(case when own and not earlier then n else 0 end) as removed,
    sum(case when own and earlier then n else 0 end) as redundant, sum(case when own and many = 1 then n else 0 end) as unique_fails,
    sum(case when own and not earlier then good else 0 end) as good_lost, sum(case when own and not earlier then toxic else 0 end) as toxic_lost
  from j group by part, filter_order, step, k)
select part, filter_order, step, cast(kept as bigint) as kept, cast(removed as bigint) as removed, cast(redundant as bigint) as redundant, cast(unique_fails as bigint) as unique_fails,
  cast(good_lost as bigint) as good_lost, cast(toxic_lost as bigint) as toxic_lost, cast(sum(removed) over (partition by part, k) as bigint) as shapley from r
"""


@query
def op13_prefix_trie(spark, table) -> DataFrame:
    from .prefix_trie import trie

    return trie(table("conversations")).drop("path")


#: DuckDB has no crc32: bits are shifted through the polynomial, eight for each byte of the id's digits.
ORACLE["op13_prefix_trie"] = r"""
with recursive own as (
  select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
    row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as place
  from conversations where conv_id is not null),
sizes as (select conv_id, count(*) as n from own group by conv_id),
crc(conv_id, i, v) as (
  select conv_id, 0, cast(4294967295 as bigint) from sizes
  union all
  select conv_id, i + 1, list_reduce(list_prepend(xor(v, ascii(substr(cast(conv_id as varchar), i + 1, 1))), range(8)),
      lambda a, k: case when a % 2 = 1 then xor(a // 2, 3988292384) else a // 2 end)
  from crc where i < length(cast(conv_id as varchar))),
convs as (
  select s.conv_id, s.conv_id - s.conv_id % 100 as base, xor(v, 4294967295) % 6 as h, s.n, least(xor(v, 4294967295) % 6, coalesce(b.n, 0)) as head
  from sizes s join crc c on c.conv_id = s.conv_id and c.i = length(cast(s.conv_id as varchar)) left join sizes b on b.conv_id = s.conv_id - s.conv_id % 100),
turns as (
  select c.conv_id, o.place as depth, o.role, o.text from convs c join own o on o.conv_id = c.base and o.place <= c.head
  union all
  select c.conv_id, o.place - c.h + c.head, o.role, o.text from convs c join own o on o.conv_id = c.conv_id and o.place > c.h),
pre as (
  select conv_id, depth, list(struct_pack(r := role, t := text)) over (partition by conv_id order by depth) as key, length(text) as chars from turns
  union all
  select conv_id, 0, [], 0 from convs),
lens as (select conv_id, head + greatest(n - h, 0) as n_turns from convs),
node as (
  select key, p.depth, min(p.conv_id) as conv_id, count(*) as n_convs, max(chars) as chars,
    sha256(coalesce(string_agg(case when n_turns = p.depth then cast(p.conv_id as varchar) end, ',' order by p.conv_id), '')) as ends_sha256
  from pre p join lens using (conv_id) group by key, p.depth),
up as (select p.conv_id, p.depth, n.conv_id as node from pre p join node n on p.key = n.key and p.depth = n.depth),
kid as (select n.conv_id, n.depth, u.node as parent from node n join up u on u.conv_id = n.conv_id and u.depth = n.depth - 1),
fan as (select parent as conv_id, depth - 1 as depth, count(*) as n_children from kid group by 1, 2),
own_sums as (select n.conv_id, n.depth, (n.n_convs - 1) * chars as saved, case when n_children is null then 1 else 0 end as leaf from node n left join fan using (conv_id, depth)),
sums as (select u.node as conv_id, u.depth, sum(leaf) as n_leaves, sum(saved) as saved_tokens from own_sums o join up u on u.conv_id = o.conv_id and u.depth <= o.depth group by 1, 2)
select n.conv_id, n.depth, parent as parent_conv_id, n_convs, coalesce(n_children, 0) as n_children, cast(n_leaves as bigint) as n_leaves, cast(saved_tokens as bigint) as saved_tokens, ends_sha256
from node n left join kid using (conv_id, depth) left join fan using (conv_id, depth) join sums using (conv_id, depth)
"""


@query
def op12_packing(spark, table) -> DataFrame:
    from .packing import packed

    return packed(table("documents"), vocabulary("word_bpe_49k.json"), end_id=1)
