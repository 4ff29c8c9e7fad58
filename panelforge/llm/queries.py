"""The queries opN_<name> and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm.decontam import benchmark_leaks
from panelforge.llm.fuzzyhash import fingerprints
from panelforge.llm.licenses import license_findings
from panelforge.llm.linededup import apply_bitmaps, line_bitmaps
from panelforge.llm.lm_score import cross_entropy_difference
from panelforge.llm.neardup import near_duplicates
from panelforge.llm.packing import pack, token_pieces
from panelforge.llm.quality import fit_quality, held_out, quality_score
from panelforge.llm.search import ranked
from panelforge.llm.secrets import secret_spans, span_list
from panelforge.llm.shared import materialize
from panelforge.llm.sharding import measured, shards
from panelforge.llm.trie import prefix_trie
from panelforge.llm.urlfilter import url_verdicts


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target language: the turns of `conversations`; background: all of `documents`."""
    return cross_entropy_difference(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "conversations"))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), words=3, percent=85)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_quality(docs, _table(spark, sf_dir, "labels"))
    out = docs.select("doc_id", held_out().alias("held_out"), quality_score(model, F.col("text")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(_table(spark, sf_dir, "documents"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    text = F.coalesce("text", F.lit(""))
    lines = (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long")
    kept = apply_bitmaps(docs.withColumn("n_lines", lines), materialize(line_bitmaps(docs), "ld-bitmaps"), dropped_col="n_dropped")
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(text, 256).alias("kept_sha256"))


def word_bpe_path() -> str:
    """The public vocabulary that the packing query uses."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = token_pieces(_table(spark, sf_dir, "documents"), word_bpe_path(), size=2048, end_id=0, ranked=True)
    return pack(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "__part", "__at"), size=2048)


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_spans(_table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] != "entropy")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(span_list(base), 256).alias("base_sha256"), span_list(F.col("spans")).alias("spans"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shards(measured(_table(spark, sf_dir, "documents")), n_shards=24)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(_table(spark, sf_dir, "pages"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(_table(spark, sf_dir, "conversations"))


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """score: the least free grade of all findings, 0 without any."""
    base = F.filter("findings", lambda f: f["kind"] == "base")
    labels = lambda found: F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda f: f["label"]))), ",")
    starts = F.transform(base, lambda f: f["start"])
    return license_findings(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), labels(base).alias("base_labels"),
        labels(F.col("findings")).alias("labels"), F.coalesce(F.array_min(F.transform("findings", lambda f: f["grade"])), F.lit(0.0)).alias("score"),
    )


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), k=50)


LINE_DEDUP_SQL = """
with d as (select doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents),
l as (select doc_id, unnest(ls) as line, unnest(range(len(ls))) as pos from d),
k as (select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
g as (select key, max(doc_id) as top from k where length(key) >= 20 group by key having count(distinct doc_id) >= 3),
m as (select k.*, coalesce(k.doc_id <> g.top, false) as gone from k left join g on k.key = g.key)
select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from m group by doc_id
"""

URL_FILTER_SQL = """
with u as (select page_id, case when contains(url, '://') then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
h as (select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from u),
r as (select * from (values ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')) as v(rhost, rpath, rverdict)),
f as (select h.page_id, max_by(rhost || rpath, length(rhost || rpath)) as rule, max_by(rverdict, length(rhost || rpath)) as rverdict
  from h join r on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath) group by h.page_id)
select h.page_id, host, path, rule, coalesce(rverdict, case when regexp_matches(host || path,
  '(^|[^A-Za-z0-9])(spam[^A-Za-z0-9]farm|cheap[^A-Za-z0-9]pills|casino|free[^A-Za-z0-9]money|free[^A-Za-z0-9]bets|adult|payday[^A-Za-z0-9]loans|keygen|ads[^A-Za-z0-9]track)($|[^A-Za-z0-9])')
  then 'block' else 'allow' end) as verdict
from h left join f using (page_id)
"""


PREFIX_TRIE_SQL = """
with t as (select conv_id, row_number() over (partition by conv_id order by turn nulls first) - 1 as pos, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
s as (select conv_id, count(*) as n from t group by conv_id),
h as (select conv_id, n, conv_id - conv_id % 5 as base, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(conv_id::varchar, ''), lambda c: ord(c)::bigint)),
  lambda acc, b: list_reduce([xor(acc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 9 as h from s),
c as (select h.*, least(h, coalesce(s.n, 0)) as lent from h left join s on h.base = s.conv_id),
r as (select c.conv_id, pos, role, text from c join t on t.conv_id = base and pos < lent union all select c.conv_id, pos - h + lent, role, text from c join t on t.conv_id = c.conv_id and pos >= h),
m as (select conv_id, pos + 1 as depth, text, sha256(string_agg(length(role) || ':' || length(text) || ':' || role || text, '|') over (partition by conv_id order by pos)) as key from r
  union all select conv_id, 0, '', 'root' from c),
mm as (select *, lag(key) over (partition by conv_id order by depth) as parent, lead(key) over (partition by conv_id order by depth) is null as ends from m),
nodes as (select key, depth, any_value(parent) as parent, min(conv_id) as conv_id, count(*) as n_convs, (count(*) - 1) * max(strlen(text)) as own,
  sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where ends), '')) as ends_sha256 from mm group by key, depth),
kids as (select parent as key, count(*) as n_children from nodes where parent is not null group by parent),
n as (select nodes.*, coalesce(n_children, 0) as n_children from nodes left join kids using (key)),
up as (select mm.key, sum(n.own) as saved_tokens, count(*) filter (where n.n_children = 0) as n_leaves from n join mm on mm.conv_id = n.conv_id and mm.depth <= n.depth group by mm.key)
select n.conv_id, n.depth, p.conv_id as parent_conv_id, n.n_convs, n.n_children, n_leaves, cast(saved_tokens as bigint) as saved_tokens, n.ends_sha256
from n join up using (key) left join nodes p on n.parent = p.key
"""

RANKED_SEARCH_SQL = r"""
with w as (select doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as word from documents),
t as (select doc_id, translate(word, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as term from w),
c as (select doc_id, term, count(*) as tf from t group by all),
l as (select doc_id, sum(tf)::bigint as n from c group by all),
total as (select count(*) as nn, sum(n)::bigint as ll from l),
q as (select distinct item_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as term from benchmark),
d as (select term, floor(1000 * ln((2 * nn + 2)::double / (2 * count(*) + 1)))::bigint as w from c, total group by term, nn),
s as (select item_id, c.doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nn) // ll))))::bigint as score
  from q join d using (term) join c using (term) join l using (doc_id), total group by all having score > 0)
select item_id, rank, doc_id, score from (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from s) where rank <= 50
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_lm_score, op2_near_duplicates, op3_quality, op4_fingerprints, op5_decontaminate, op6_line_dedup, op7_best_fit_packing, op8_secret_scan, op9_sharding, op10_url_filter, op11_prefix_trie, op12_license_scan, op13_ranked_search)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op6_line_dedup": LINE_DEDUP_SQL, "op10_url_filter": URL_FILTER_SQL, "op11_prefix_trie": PREFIX_TRIE_SQL, "op13_ranked_search": RANKED_SEARCH_SQL}
