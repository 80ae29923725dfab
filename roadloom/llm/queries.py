"""The queries of the training-data operators over the given tables, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadloom.llm.audit import filter_audit
from roadloom.llm.html import extract_text
from roadloom.llm.jaccard import near_groups
from roadloom.llm.language import predict, train
from roadloom.llm.lines import dedup_lines
from roadloom.llm.manifest import manifest
from roadloom.llm.mixing import mix_sources
from roadloom.llm.packing import pack
from roadloom.llm.repeats import remove_repeats
from roadloom.llm.secrets import KINDS, find_secrets
from roadloom.llm.shards import shard
from roadloom.llm.spotsigs import edited_likeness
from roadloom.llm.vectors import near_vectors

#: The folder of the public vocabularies; None: where their package lies on each machine.
TOKENIZERS = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"), k=3, least=(90, 100))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"), weights=(3, 1, 2), share=1.5, cap=2.0).select("doc_id", "size", "source_size", "target", "taken", "source")


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    show = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of = lambda *kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    return found.select(
        "doc_id", *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(show(of(*KINDS[:3])).cast("binary"), 256).alias("base_sha256"), show(F.col("spans")).alias("spans"),
    )


def op4_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_likeness(table(spark, sf_dir, "documents"))


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), length=400).drop("spans")


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = train(docs.where(~held_out))
    return predict(docs, model).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), TOKENIZERS, capacity=1024, end_id=2)


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = extract_text(table(spark, sf_dir, "pages"))
    return pages.select("page_id", "text", F.length("text").cast("long").alias("n_chars"))


def op9_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op10_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"), least=0.95)


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"), 16, "bytes", columns=["doc_id"])


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents"), tampered=F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_ngram_jaccard, op2_mixing, op3_secrets, op4_spotsigs, op5_repeats, op6_language, op7_packing, op8_html, op9_lines, op10_vectors, op11_sharding, op12_manifest, op13_filter_audit, pipeline)
}

#: A line's words are runs of other bytes than space and \t..\r; lines without words are no part of a run.
_OP9 = r"""
with l as (
  select doc_id, i - 1 as line, lines[i] as s, len(regexp_extract_all(lines[i], '[^\x20\x09-\x0D]+')) as w
  from (select doc_id, lines, unnest(range(1, len(lines) + 1)) as i from (select doc_id, string_split(text, chr(10)) as lines from documents where text <> '') a) b
), p as (
  select *, row_number() over (partition by doc_id order by line) as pos from l where w > 0
), x as (
  select *, lead(s) over d as s2, lead(w) over d as w2, lead(line) over d as l2, lead(s, 2) over d as s3, lead(line, 2) over d as l3
  from p window d as (partition by doc_id order by pos)
), b as (
  select doc_id, pos, line, l2, l3, w, w + w2 as ww, s2 is not null as two, s3 is not null as three,
    row_number() over (partition by s order by doc_id, pos) > 1 as r1,
    row_number() over (partition by s, s2 order by doc_id, pos) > 1 as r2,
    row_number() over (partition by s, s2, s3 order by doc_id, pos) > 1 as r3
  from x
), g as (
  select doc_id, line from b where w >= 50 and r1
  union select doc_id, unnest([line, l2]) from b where two and ww >= 50 and r2
  union select doc_id, unnest([line, l2, l3]) from b where three and r3
), n as (
  select doc_id, list(line) as gone from g group by doc_id
), k as (
  select d.doc_id, coalesce(d.text, '') as text, n.gone, string_split(d.text, chr(10)) as lines from documents d left join n using (doc_id)
)
select doc_id, case when text = '' then 0 else len(lines) end as n_lines, coalesce(len(gone), 0) as n_removed,
  sha256(case when gone is null then text else array_to_string([lines[i] for i in range(1, len(lines) + 1) if not list_contains(gone, i - 1)], chr(10)) end) as kept_sha256
from k
"""



def _climb(name: str, by: str, levels: int) -> str:
    """CTEs <name>1, <name>2, ..: a level each of the trees over <name>0 (by, pos, node, n). Ended trees go on as they are."""
    out = []
    for k in range(levels):
        out.append(f"""{name}{k + 1} as (
  select {by}, case when n > 1 then pos // 16 else pos end as pos, case when n > 1 then sha256(string_agg(node, '' order by pos)) else min(node) end as node, case when n > 1 then (n + 15) // 16 else n end as n
  from {name}{k} group by {by}, n, case when n > 1 then pos // 16 else pos end)""")
    return ",\n".join(out)


def _way(rows: str, name: str, by: str, levels: int, start: str) -> str:
    """CTEs <rows>1, ..: each row's proof and folded node carried up the levels of <name>; q: its place, m: its tree's nodes."""
    out = []
    for k in range(levels):
        last = start if not k else f"{rows}{k}"
        out.append(f"""{rows}{k + 1} as (
  select r.* exclude (q, m, proof, fold), case when r.m > 1 then r.q // 16 else r.q end as q, case when r.m > 1 then (r.m + 15) // 16 else r.m end as m,
    case when r.m > 1 then r.proof || array_to_string(list_concat(g.nodes[:(r.q % 16)], g.nodes[(r.q % 16) + 2:]), '') else r.proof end as proof,
    case when r.m > 1 then sha256(array_to_string(list_concat(list_append(g.nodes[:(r.q % 16)], r.fold), g.nodes[(r.q % 16) + 2:]), '')) else r.fold end as fold
  from {last} r left join (select {by}, pos // 16 as run, list(node order by pos) as nodes from {name}{k} group by all) g on r.{by} = g.{by} and r.q // 16 = g.run)""")
    return ",\n".join(out)


def _op12(levels: int = 5, upper: int = 3) -> str:
    """Trees of up to 16**levels leaves a source, 16**upper sources."""
    field = lambda c: f"coalesce(strlen(cast({c} as varchar)) || ':' || cast({c} as varchar), '-')"
    leaf = lambda text: "sha256(" + " || ".join(map(field, ("doc_id", "source", "lang", "n_chars", text))) + ")"
    small = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
with d as (
  select coalesce(':' || source, '-') as s, doc_id, {leaf("text")} as leaf, {leaf(small)} as low, {_CRC32} % 5 = 0 as bad from documents
), a0 as (
  select s, row_number() over (partition by s order by doc_id nulls first, leaf) - 1 as pos, leaf as node, count(*) over (partition by s) as n, doc_id, low, bad from d
), {_climb("a", "s", levels)}, b0 as (
  select 0 as g, s, row_number() over (order by encode(s)) - 1 as pos, node, count(*) over () as n from a{levels}
), {_climb("b", "g", upper)}, w0 as (
  select s, doc_id, node as leaf, pos as q, n as m, '' as proof, case when bad then low else node end as fold from a0
), {_way("w", "a", "s", levels, "w0")}, x0 as (
  select w.* exclude (q, m), b.pos as q, b.n as m, b.node as subroot, 0 as g from w{levels} w join b0 b using (s)
), {_way("x", "b", "g", upper, "x0")}
select x.doc_id, x.leaf, x.subroot, r.node as root, sha256(x.proof) as proof_sha256, x.fold as folded_root, x.fold = r.node as verified
from x{upper} x cross join b{upper} r
"""


#: CRC-32 of the decimal doc_id: bit by bit over its at most 20 digits (DuckDB has no such function).
_CRC32 = "xor(list_reduce(list_prepend(4294967295::bigint, [ascii(x)::bigint for x in string_split(cast(doc_id as varchar), '')]), lambda c, x: list_reduce(list_prepend(xor(c, x), [0::bigint, 0, 0, 0, 0, 0, 0, 0]), lambda v, i: xor(v >> 1, (v & 1) * 3988292384))), 4294967295::bigint)"

_OP13 = r"""
with t as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as s from documents),
w as (select *, regexp_extract_all(s, '[^\x20\x09-\x0D]+') as words, min(doc_id) over (partition by s) as first from t),
f as (
  select doc_id, part, (len(words) < 200)::int + 2 * (100 * len(list_distinct(words)) < 50 * len(words))::int
    + 4 * (100 * len(regexp_extract_all(s, '[A-Z]')) > 3 * length(s))::int + 8 * (len(regexp_extract(s, '[#$%&*|]')) > 0)::int
    + 16 * coalesce(doc_id > first, false)::int as mask
  from w
), l as (select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels group by doc_id),
c as (select part, mask, count(*) as docs, coalesce(sum(good), 0) as good, coalesce(sum(toxic), 0) as toxic from f left join l using (doc_id) group by all),
p as (select distinct part from c),
st as (select p.part, s.s, coalesce(sum(docs), 0) as docs, coalesce(sum(good), 0) as good, coalesce(sum(toxic), 0) as toxic
  from p cross join range(32) s(s) left join c on c.part = p.part and c.mask & s.s = 0 group by all),
i as (select unnest(range(5)) as i),
o as (select [a.i, b.i, c.i, d.i, e.i] as o from i a, i b, i c, i d, i e where len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
k as (select array_to_string([substr('ABCDE', x + 1, 1) for x in o], '') as filter_order, step, o[step] as f, list_sum(list_concat([0], [1 << x for x in o[:step - 1]])) as was from o cross join range(1, 6) r(step)),
j as (
  select a.part, k.filter_order, k.step, k.f, b.docs as kept, a.docs - b.docs as removed, n.docs - m.docs as fails, u.docs - v.docs as unique_fails, a.good - b.good as good_lost, a.toxic - b.toxic as toxic_lost
  from k join st a on a.s = k.was join st b on b.part = a.part and b.s = k.was + (1 << k.f) join st n on n.part = a.part and n.s = 0
  join st m on m.part = a.part and m.s = 1 << k.f join st u on u.part = a.part and u.s = 31 - (1 << k.f) join st v on v.part = a.part and v.s = 31
)
select part, filter_order, step::int as step, kept::bigint as kept, removed::bigint as removed, (fails - removed)::bigint as redundant, unique_fails::bigint as unique_fails,
  good_lost::bigint as good_lost, toxic_lost::bigint as toxic_lost, (sum(removed) over (partition by part, f))::bigint as shapley
from j
"""

ORACLE: dict[str, str] = {"op9_lines": _OP9, "op12_manifest": _op12(), "op13_filter_audit": _OP13}
