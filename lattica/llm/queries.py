"""One query for each operator, over its whole table, and its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.bpe import bpe_round_trip
from lattica.llm.chat import MAX_CHARS, rotate_perspectives, whole_dialogues
from lattica.llm.common import read
from lattica.llm.decontaminate import find_overlaps
from lattica.llm.html_extract import extract_main_text
from lattica.llm.line_dedup import line_dedup
from lattica.llm.near_dedup import near_duplicates
from lattica.llm.quality import line_first_quality
from lattica.llm.sale_assembly import assemble_sales
from lattica.llm.simhash import simhash_components
from lattica.llm.token_alignment import align_tokenizers
from lattica.llm import lm_score, pii, toxicity


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup(docs).select("doc_id", "n_lines", "n_lines_removed", F.col("runs").cast("string").alias("runs"), "text")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_first_quality(read(spark, sf_dir, "documents"), keep=["doc_id"])


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(read(spark, sf_dir, "pages"), keep=["page_id", "url"])


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = whole_dialogues(rotate_perspectives(read(spark, sf_dir, "conversations")))
    spans = F.array_join(F.transform("mask", lambda m: F.concat_ws(":", m["start"].cast("string"), m["end"].cast("string"))), ",")
    return made.select("conv_id", "part", "piece", "perspective", "n_turns", "text", spans.alias("mask"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_shingles")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = toxicity.train(docs, read(spark, sf_dir, "labels"))
    held_out = F.coalesce(toxicity.fold(F.col("doc_id")) == toxicity.HELD_OUT, F.lit(True))
    return toxicity.score_toxicity(docs, model, keep=["doc_id"]).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_round_trip(read(spark, sf_dir, "documents"), tokenizer_path(), keep=["doc_id"])


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_overlaps(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return lm_score.score_texts(docs, lm_score.train(docs), keep=["doc_id"])


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = pii.find_personal_data(docs, pii.learn_potentials(docs), keep=["doc_id"])
    return found.select("doc_id", *[f"n_{k}" for k in pii.KINDS], F.sha2("base", 256).alias("base_sha256"), "spans", "n_spans")


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(read(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op12_sale_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assemble_sales(read(spark, sf_dir, "sale_lines"), read(spark, sf_dir, "sales"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokenizers(read(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"), keep=["doc_id"])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_quality_rules": op2_quality_rules,
    "op3_html_extraction": op3_html_extraction,
    "op4_chat_formatting": op4_chat_formatting,
    "op5_near_dedup": op5_near_dedup,
    "op6_toxicity": op6_toxicity,
    "op7_bpe": op7_bpe,
    "op8_decontamination": op8_decontamination,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_pii": op10_pii,
    "op11_simhash": op11_simhash,
    "op12_sale_assembly": op12_sale_assembly,
    "op13_token_alignment": op13_token_alignment,
}

_CHAT_SQL = f"""with c as (select distinct conv_id, turn, coalesce(role, 'unknown') as role, coalesce(text, '') as text from conversations),
p as (select distinct conv_id, role as perspective from c where role <> 'system'),
r as (select c.*, coalesce(turn // 256, -1) as part, perspective,
  case when role = 'system' then '<|system|>' when role = perspective then '<|assistant|>' else '<|user name=' || role || '|>' end || chr(10) as head
  from c join p on c.conv_id is not distinct from p.conv_id),
z as (select conv_id, max(n) <= {MAX_CHARS} as short from (select conv_id, perspective, sum(length(head || text) + 8) as n from r group by conv_id, perspective) group by conv_id),
k as (select r.*, case when short then null else part end as own from r join z on r.conv_id is not distinct from z.conv_id),
o as (select *, head || text || '<|end|>' || chr(10) as whole,
  sum(length(head || text) + 8) over (partition by conv_id, perspective, own order by part, turn, role, text) - length(text) - 8 as begin_ from k)
select conv_id, own as part, case when own is not null then cast(0 as bigint) end as piece, perspective, count(*) as n_turns, string_agg(whole, '' order by part, turn, role, text) as text,
  coalesce(string_agg(case when role = perspective then begin_ || ':' || (begin_ + length(text) + 7) end, ',' order by part, turn, role, text), '') as mask
from o group by conv_id, own, perspective"""

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_OVERLAP_SQL = f"""with i as (select item_id, {_WORDS} as w from benchmark), d as (select doc_id, {_WORDS} as w from documents),
k as (select distinct item_id, n, array_to_string(w[p:p + n - 1], ' ') as key from (select *, least(10, len(w)) as n, unnest(range(1, len(w) - least(10, len(w)) + 2)) as p from i where len(w) > 0)),
e as (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as p from d),
f as (select doc_id, p, list(word) over (partition by doc_id order by p rows between current row and 9 following) as v from e),
h as (select f.doc_id, f.p, k.n, k.item_id from (select f.*, s.n from f cross join (select distinct n from k) s where len(v) >= s.n) f join k on k.n = f.n and k.key = array_to_string(f.v[1:f.n], ' ')),
c as (select doc_id, count(distinct q) as n_hit from (select doc_id, unnest(range(p, p + n)) as q from h) group by doc_id),
t as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, cast(item_id as varchar) as item from h) group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join c using (doc_id) left join t using (doc_id)"""

#: CRC-32 of `code` (ASCII), by the table `v` of its 256 steps.
_CRC = "xor(list_reduce([ascii(substr(code, i, 1)) for i in range(1, len(code) + 1)], lambda c, b: xor(c >> 8, v[1 + (xor(c, b) & 255)]), 4294967295), 4294967295)"
#: Rows of a sale one after the other; an open assembly is over at its first tick past its patience, or at the last one.
_ASSEMBLY_SQL = f"""with recursive tbl as (select list(list_reduce(range(8), lambda c, i: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, n) order by n) as v from (select unnest(range(256)) as n)),
l0 as (select distinct * from sale_lines where sale_id is not null),
l1 as (select l0.*, sale_id || ':' || coalesce(cast(line_no as varchar), '') as code from l0),
l2 as (select l1.*, {_CRC} as h from l1, tbl),
li as (select sale_id, coalesce(cast(floor(epoch(shipped_at) / 86400) as bigint) + h % 15, 19723 + h % 152) as day, case when isfinite(amount) then cast(floor(100 * amount + 0.5) as bigint) else 0 end as cents from l2),
ld as (select sale_id, day, count(*) as n, sum(cents) as cents from li group by all),
ls as (select sale_id, sum(cents) as total, arg_max(cents, day) as last from ld group by all),
s0 as (select distinct sale_id, coalesce(cast(floor(epoch(arrived_at) / 86400) as bigint), 19723) as day, max(case when isfinite(total) then cast(floor(100 * total + 0.5) as bigint) else 0 end) over (partition by sale_id) as total, cast(sale_id as varchar) as code from sales where sale_id is not null),
s1 as (select s0.*, {_CRC} % 5 as kind from s0, tbl),
sd as (select s1.sale_id, s1.day, case kind when 0 then s1.total when 1 then coalesce(ls.total - ls.last, 0) else coalesce(ls.total, 0) end as due from s1 left join ls on s1.sale_id = ls.sale_id),
ev as (select coalesce(ld.sale_id, sd.sale_id) as sale_id, coalesce(ld.day, sd.day) as day, coalesce(n, 0) as n, coalesce(cents, 0) as cents, due from ld full join sd on ld.sale_id = sd.sale_id and ld.day = sd.day),
e as (select *, greatest(0, least(9, cast(floor((day - 19723) * 10 / 160.0) as bigint))) as b, row_number() over (partition by sale_id order by day) as i from ev),
m as (select k as b, (select max(day) from e where e.b < k) as w from (select unnest(range(10)) as k)),
x as (select *, coalesce((select min(m.b) from m where m.w >= e.day + 10), 9) as over_ from e),
r as (
  select sale_id, i, b, day as first_day, day as last_day, n, cents, due, over_, n > 0 and due is not null and cents = due as done,
    null::bigint as f0, null::bigint as l0, null::hugeint as n0, null::hugeint as c0, null::hugeint as d0, null::bigint as b0 from x where i = 1
  union all
  select q.sale_id, q.i, q.b, case when q.fresh then q.day else q.first_day end, q.day, q.n2, q.c2, q.d2, case when q.fresh then q.over_x else q.over_ end, q.n2 > 0 and q.d2 is not null and q.c2 = q.d2,
    case when q.gone then q.first_day end, case when q.gone then q.last_day end, case when q.gone then q.n end, case when q.gone then q.cents end, case when q.gone then q.due end, case when q.gone then greatest(q.over_, q.rb) end
  from (select x.sale_id, x.i, x.b, x.day, r.b as rb, r.first_day, r.last_day, r.n, r.cents, r.due, r.over_, x.over_ as over_x,
      not r.done and r.b < x.b and r.over_ < x.b as gone, r.done or (r.b < x.b and r.over_ < x.b) as fresh,
      case when r.done or (r.b < x.b and r.over_ < x.b) then 0 else r.n end + x.n as n2, case when r.done or (r.b < x.b and r.over_ < x.b) then 0 else r.cents end + x.cents as c2,
      coalesce(x.due, case when r.done or (r.b < x.b and r.over_ < x.b) then null else r.due end) as d2
    from r join x on x.sale_id = r.sale_id and x.i = r.i + 1) q),
c as (
  select sale_id, first_day, last_day, n, cents, due, 'complete' as status, b from r where done
  union all select sale_id, f0, l0, n0, c0, d0, null, b0 from r where f0 is not null
  union all select sale_id, first_day, last_day, n, cents, due, null, greatest(over_, b) from (select *, i = max(i) over (partition by sale_id) as final from r) where final and not done)
select sale_id, cast(first_day as integer) as first_day, cast(last_day as integer) as last_day, cast(n as bigint) as n_lines, cast(cents as bigint) as cents, cast(due as bigint) as due,
  coalesce(status, case when due is null then 'headless' when n = 0 then 'orphan' when cents < due then 'short' else 'over' end) as status, cast(b as integer) as closing_batch from c"""

#: The other operators learn, sketch, encode or join to a fixed point; tests hold them against brute force.
ORACLE: dict[str, str] = {"op4_chat_formatting": _CHAT_SQL, "op8_decontamination": _OVERLAP_SQL, "op12_sale_assembly": _ASSEMBLY_SQL}
