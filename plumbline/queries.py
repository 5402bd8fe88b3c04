"""Registered queries of the evidence operators and the DuckDB SQL that each must agree with."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from plumbline import fixtures as fx
from plumbline.functions import scalars as sc
from plumbline.functions import scorers
from plumbline.functions.tables import scratch_path, written
from plumbline.operators import calibrate, fingerprint, fusion, grids, jobs, metrics, provenance, rollup, sampling
from plumbline.params import FORBIDDEN_PHRASES, FORBIDDEN_WORDS, GENERATORS, NEXT_STEPS, STANDARD_QUANT, TEMPERATURES, TEXTS
from plumbline.plans import protocol, retention, scoring
from plumbline.sources import commits, reports, scores
from plumbline.sources import jobs as job_source
from plumbline.sources.commits import Batches
from plumbline.streaming import jobs as streams
from plumbline.streaming.jobs import final_status

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
TIE = ("line", "part", "supp")
WEIGHTS = {"spatial": 0.7, "frequency": 0.3}
NOW = "timestamp '1998-06-01'"


def sql_list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def query(sql: str | None = None):
    """Registers a query and the SQL that it must agree with."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


SIGNALS = """signals as (
  select d.doc_id as key, case when d.lang = 'en' then 'calib' else 'report' end as dataset, l.quality as label,
    case when d.n_chars < 60 then null else round(length(regexp_replace(d.text, '[^A-Za-z]', '', 'g')) / cast(length(d.text) as double), 4) end as spatial,
    round(len(list_distinct(string_split(lower(d.text), ' '))) / cast(len(string_split(lower(d.text), ' ')) as double), 4) as frequency
  from documents d join labels l on d.doc_id = l.doc_id)"""
LONG = f"""{SIGNALS}, allrows as (
  select key, dataset, label, 'spatial' as detector, spatial as score from signals where spatial is not null
  union all select key, dataset, label, 'frequency', frequency from signals where frequency is not null),
long as (select * from allrows where (dataset, detector) in
  (select (dataset, detector) from allrows group by dataset, detector having count(*) >= 20 and min(label) < max(label)))"""
PARTS = """raw as (
  select l_orderkey as item_id, l_linenumber as line, l_partkey as part, l_suppkey as supp, cast(l_quantity as int) as w, cast(1 + l_partkey % 160 as int) as h,
    round(l_discount * 10, 4) as raw_score, round(l_tax / 10, 4) as spread, cast(l_suppkey * 37 % 500 as double) as blur, cast(l_partkey * 7 % 256 as double) as luma,
    cast(40 + l_linenumber * 8 as int) as jpeg_q from lineitem),
numbered as (select *, row_number() over (partition by item_id order by cast(w as bigint) * h desc, line, part, supp) as part_index from raw),
held as (select *, (case when h < 64 then round(greatest(0.35, h / 64.0::double), 3) else 1 end) as f1, (case when blur < 60 then 0.7::double else 1 end) as f2,
    (case when luma < 40 or luma > 215 then 0.8::double else 1 end) as f3, (case when jpeg_q < 70 then 0.6::double else 1 end) as f4 from numbered),
scored as (select *, ((f1 * f2) * f3) * f4 as confidence, round((0.5::double + (raw_score - 0.5::double) * (((f1 * f2) * f3) * f4))::decimal(28, 10), 4)::double as score from held)"""
ROLLED = f"""{PARTS}, rolled as (
  select *, case when n_parts = 1 then 'single_part' when n_elevated = 0 then 'none_elevated' when n_elevated = n_parts and n_parts >= 3 then 'all_elevated'
      when n_elevated = 1 then 'single_outlier' else 'several_elevated' end as pattern
  from (select item_id, max(score) as score, arg_max(spread, (score, -part_index)) as spread, count(*) as n_parts, count(*) filter (score >= 0.45) as n_elevated,
      arg_min(h, part_index) as top_h from scored where part_index <= 10 group by item_id))"""


def long_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.measurable(metrics.drop_unscored(fx.signals(spark, sf_dir), ["spatial", "frequency"], ["key", "dataset", "label"]))


def scored_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.score_parts(rollup.top_parts(rollup.number_parts(fx.parts(spark, sf_dir), *TIE)))


# ---- parts and items


@query(f"with {PARTS} select item_id, part_index, w, h, raw_score, cast(row_number() over (partition by item_id order by score desc, part_index) as int) as display_rank from scored")
def number_and_rank_parts(spark, sf_dir):
    parts = rollup.rank_by_score(rollup.score_parts(rollup.number_parts(fx.parts(spark, sf_dir), *TIE)))
    return parts.select("item_id", "part_index", "w", "h", "raw_score", "display_rank")


@query(f"""with {PARTS} select item_id, part_index, (f1 < 1)::int + (f2 < 1)::int + (f3 < 1)::int + (f4 < 1)::int as n_penalties, round(confidence, 9) as confidence, score,
  round((greatest(0, least(1, score - (2 * spread + 0.5 * (1 - confidence)))))::decimal(28, 10), 4)::double as lo, round((greatest(0, least(1, score + (2 * spread + 0.5 * (1 - confidence)))))::decimal(28, 10), 4)::double as hi
  from scored where part_index <= 10""")
def part_scores(spark, sf_dir):
    return scored_parts(spark, sf_dir).select("item_id", "part_index", F.size("penalties").alias("n_penalties"), F.round("confidence", 9).alias("confidence"), "score", F.col("uncertainty.lo").alias("lo"), F.col("uncertainty.hi").alias("hi"))


@query(f"""with {PARTS}, rows as (
  select item_id, part_index, f1 as factor from scored where part_index <= 10 and h < 64 union all select item_id, part_index, f2 from scored where part_index <= 10 and f2 < 1
  union all select item_id, part_index, f3 from scored where part_index <= 10 and f3 < 1 union all select item_id, part_index, f4 from scored where part_index <= 10 and f4 < 1)
  select item_id, part_index, count(*) as n, round(product(factor), 9) as confidence from rows group by 1, 2""")
def penalty_rows(spark, sf_dir):
    rows = rollup.penalty_rows(scored_parts(spark, sf_dir), "item_id", "part_index")
    counts = rows.groupBy("item_id", "part_index").agg(F.count("*").alias("n"))
    return counts.join(rollup.confidence_of_rows(rows, "item_id", "part_index").hint("merge"), ["item_id", "part_index"]).withColumn("confidence", F.round("confidence", 9))


@query(f"""with {ROLLED} select item_id, score, spread, n_parts, n_elevated, pattern, case when pattern = 'all_elevated' then 0.85
  when pattern = 'single_outlier' then round(greatest(0.55, 1 / (1 + 0.09 * (n_parts - 1))::double), 3) end as factor from rolled""")
def rollup_items(spark, sf_dir):
    rolled = rollup.rollup_parts(scored_parts(spark, sf_dir))
    return rolled.select("item_id", "score", "spread", "n_parts", "n_elevated", "pattern", F.get("rollup_penalties", F.lit(0))["factor"].alias("factor"))


@query(f"with {PARTS} select item_id, max(score) as score, arg_max(spread, (score, -part_index)) as spread from scored group by 1")
def naive_max(spark, sf_dir):
    return rollup.naive_max(rollup.score_parts(rollup.number_parts(fx.parts(spark, sf_dir), *TIE)))


@query(f"with {PARTS}, best as (select item_id, max(raw_score) as score from numbered where part_index <= 3 group by 1) select o_orderkey as item_id, score from orders left join best on o_orderkey = item_id")
def eval_top3(spark, sf_dir):
    return rollup.top3_max(fx.items(spark, sf_dir), rollup.number_parts(fx.parts(spark, sf_dir), *TIE))


@query("""with boxes as (select l_orderkey as id, l_linenumber as line, l_partkey as part, l_suppkey as supp, l_extendedprice % 400 - 50 as x, l_tax * 3000 - 20 as y, l_quantity * 3 as w, l_discount * 900 as h from lineitem),
 r as (select id, line, part, supp, greatest(0, round_even(x, 0)::int) as x, greatest(0, round_even(y, 0)::int) as y, round_even(w, 0)::int as w, round_even(h, 0)::int as h from boxes),
 c as (select id, line, part, supp, x, y, least(w, 320 - x) as w, least(h, 240 - y) as h from r)
 select id, line, part, supp, x, y, w, h, greatest(0, x - trunc(w * 0.25)::int) as x0, greatest(0, y - trunc(h * 0.25)::int) as y0, least(320, x + w + trunc(w * 0.25)::int) as x1, least(240, y + h + trunc(h * 0.25)::int) as y1
 from c where w > 0 and h > 0""")
def clamp_and_margin_boxes(spark, sf_dir):
    c = F.col
    lines = fx.table(spark, sf_dir, "lineitem")
    boxes = lines.select(c("l_orderkey").alias("id"), c("l_linenumber").alias("line"), c("l_partkey").alias("part"), c("l_suppkey").alias("supp"), (c("l_extendedprice") % 400 - 50).alias("x"), (c("l_tax") * 3000 - 20).alias("y"), (c("l_quantity") * 3).alias("w"), (c("l_discount") * 900).alias("h"), F.lit(320).alias("width"), F.lit(240).alias("height"))
    return rollup.margin_boxes(rollup.clamp_boxes(boxes)).drop("width", "height")


@query(f"""with {PARTS}, faces as (select item_id, part_index, w, h from scored), s as (select item_id, part_index, score from scored)
  select item_id, part_index, w, h, score from faces join s using (item_id, part_index)""")
def align_parts(spark, sf_dir):
    parts = rollup.score_parts(rollup.number_parts(fx.parts(spark, sf_dir), *TIE))
    return rollup.align_parts(parts.select("item_id", "part_index", "w", "h"), parts.select("item_id", "part_index", "score"))


@query("""with z as (select vec_id as item_id, v as variant, embedding[2 * v + 1]::double * 5 as a, embedding[2 * v + 2]::double * 5 as b from embeddings, range(4) t(v)),
  m as (select item_id, avg(a) as a, avg(b) as b, stddev_pop(1 / (1 + exp(a - b))) as spread, count(*) as n_variants from z group by 1)
  select item_id, round(1 / (1 + exp(a - b)), 9) as score, round(spread, 9) as spread, n_variants from m""")
def pool_variants(spark, sf_dir):
    e = fx.table(spark, sf_dir, "embeddings").withColumn("variant", F.explode(F.sequence(F.lit(0), F.lit(3))))
    at = lambda k: F.get("embedding", F.col("variant") * 2 + k).cast("double") * 5
    pooled = rollup.pool_variants(e.select(F.col("vec_id").alias("item_id"), "variant", F.array(at(0), at(1)).alias("logits")))
    return pooled.select("item_id", F.round("score", 9).alias("score"), F.round("spread", 9).alias("spread"), "n_variants")


ITEMS = """items as (select o_orderkey as item_id, cast(o_custkey * 13 % 400 as double) as blur, cast(o_orderkey * 11 % 256 as double) as luma,
    case when o_orderkey % 5 <> 0 then cast(40 + o_custkey % 60 as int) end as jpeg_q, floor(o_totalprice)::bigint % 1000 / 1000.0::double as frequency,
    case when o_orderkey % 11 = 0 then 'FLUX' end as marker, case when o_orderkey % 3 <> 0 then o_orderkey % 4 = 0 end as manifest_valid from orders)"""
#: Text of reports in SQL: the templates by kind, filled in.
FILLED = lambda t: "replace(replace(replace('" + t.replace("'", "''") + "', '{n}', n_parts::varchar), '{k}', n_elevated::varchar), '{label}', label)"
KIND = lambda i: "case case when n_parts = 0 then 'no_part' else pattern end " + " ".join(f"when '{k}' then {FILLED(t[i])}" for k, t in TEXTS.items()) + " end"
SCORE_TEXT = f"""array_to_string(list_filter([case when n_parts = 0 then 'no detector gave a score' else 'weighted by validation AUC; the detectors lie ' || round(disagreement::decimal(28, 10), 3)::varchar || ' apart' end,
    case override when 'generator_metadata' then 'metadata names ' || marker || ': raised to 0.88; markers can be removed, so none proves nothing'
      when 'c2pa_valid' then 'valid credentials of an unnamed signer: lowered to 0.35; they attest the signing, not what came before' end], lambda x: x is not null), '; ') as notes,
  {KIND(0)} as headline, {KIND(1)} as detail,
  case when n_parts = 0 then {FILLED(NEXT_STEPS["no_part"])} when n_elevated = 0 then {FILLED(NEXT_STEPS["quiet"])} when n_elevated = 1 then {FILLED(NEXT_STEPS["raised_one"])} else {FILLED(NEXT_STEPS["raised"])} end as next_steps"""
SCORE_ITEMS = f"""with {ROLLED}, {ITEMS}, j as (
  select i.*, r.score as s, r.spread as sp, coalesce(r.n_parts, 0) as n_parts, coalesce(r.n_elevated, 0) as n_elevated, coalesce(r.pattern, 'none_elevated') as pattern, r.top_h,
    (case when r.top_h < 64 then 0.6::double else 1 end) as g1, (case when i.blur < 60 then 0.7::double else 1 end) as g2, (case when i.luma < 40 or i.luma > 215 then 0.8::double else 1 end) as g3,
    (case when i.jpeg_q < 70 then 0.6::double else 1 end) as g4, (case when r.item_id is null then 0.5::double else 1 end) as g5,
    (case when pattern = 'all_elevated' then 0.85::double when pattern = 'single_outlier' then round(greatest(0.55, 1 / (1 + 0.09 * (n_parts - 1))::double), 3) else 1 end) as g6
  from items i left join rolled r using (item_id)),
k as (select *, g1 * g2 * g3 * g4 * 0.85::double * g5 * g6 as confidence, case when n_parts > 0 then (s * 0.7::double + frequency * 0.3::double) / 1.0::double else 0.5::double end as fused,
    case when n_parts > 0 then abs(s - frequency) / 2 else 0 end as disagreement,
    (g1 < 1)::int + (g2 < 1)::int + (g3 < 1)::int + (g4 < 1)::int + 1 + (g5 < 1)::int as n_item, (g6 < 1)::int as n_roll from j),
o as (select *, case when marker is not null and fused < 0.88 then 'generator_metadata' when marker is null and coalesce(manifest_valid, false) and fused > 0.35 then 'c2pa_valid' end as override from k),
p as (select *, case override when 'generator_metadata' then 0.88::double when 'c2pa_valid' then 0.35::double else fused end as clamped, case when n_parts > 0 then greatest(disagreement, sp) else 0 end as spread from o),
q as (select *, round((case when n_parts > 0 then 0.5::double + (clamped - 0.5::double) * confidence else clamped end)::decimal(28, 10), 4)::double as score from p),
b as (select *, case when score >= 0.88 then 'very_strong' when score >= 0.7 then 'strong' when score >= 0.45 then 'mixed' when score >= 0.2 then 'weak' else 'low' end as band,
   case when score >= 0.88 then 'Very strong indication' when score >= 0.7 then 'Strong indication' when score >= 0.45 then 'Mixed signals' when score >= 0.2 then 'Weak indication' else 'Low indication' end as label from q)
select item_id, score, round((greatest(0, least(1, score - (2 * spread + 0.5 * (1 - confidence)))))::decimal(28, 10), 4)::double as lo, round((greatest(0, least(1, score + (2 * spread + 0.5 * (1 - confidence)))))::decimal(28, 10), 4)::double as hi, band,
  round(confidence, 6) as confidence, override, n_parts, n_elevated, pattern, n_item + n_roll as n_penalties, n_item <= 1 and n_roll = 0 and n_parts > 0 as in_distribution,
  {SCORE_TEXT}
from b"""


@query(SCORE_ITEMS)
def score_items(spark, sf_dir):
    """The flagship: measured parts to item reports."""
    reports_ = scoring.score_items(fx.items(spark, sf_dir), fx.parts(spark, sf_dir), WEIGHTS, TIE)
    return reports_.withColumn("notes", F.array_join("notes", "; "))


@query(f"select item_id, frequency as score, case when frequency >= 0.88 then 'very_strong' when frequency >= 0.7 then 'strong' when frequency >= 0.45 then 'mixed' when frequency >= 0.2 then 'weak' else 'low' end as band from (with {ITEMS} select * from items)")
def band_join(spark, sf_dir):
    rows = fx.items(spark, sf_dir).select("item_id", F.col("frequency").alias("score"))
    return sc.band_join(rows, sc.band_table(spark)).select("item_id", "score", "band")


# ---- fusion


def three_detectors(spark, sf_dir):
    s = fx.signals(spark, sf_dir)
    flip = F.when(F.col("key") % 4 != 0, F.round(1 - F.col("frequency"), 4))
    return s.select(F.col("key").alias("item_id"), "spatial", "frequency", flip.alias("other")).unpivot(["item_id"], ["spatial", "frequency", "other"], "detector", "score")


THREE = f"""{SIGNALS}, three as (select key as item_id, 'spatial' as detector, spatial as score from signals union all select key, 'frequency', frequency from signals
  union all select key, 'other', case when key % 4 <> 0 then round(1 - frequency, 4) end from signals)"""


@query(f"""with {THREE}, w as (select *, case detector when 'spatial' then 0.5 when 'other' then 0.25 else 0 end::double as weight from three where score is not null),
  a as (select item_id, sum(score * weight) as ws, sum(weight) as tw, count(*) filter (weight > 0) as n, stddev_pop(score) filter (weight > 0) as d, max(score) as hi from w group by 1)
  select item_id, round(case when n_all = 0 then 0.5 when tw > 0 then ws / tw else hi end, 9) as score, round(case when n > 1 then d else 0 end, 9) as disagreement
  from (select t.item_id, count(score) as n_all from three t group by 1) left join a using (item_id)""")
def fuse_weighted(spark, sf_dir):
    weights = spark.createDataFrame([("spatial", 0.5), ("other", 0.25)], "detector string, weight double")
    fused = fusion.fuse(fusion.weight_join(three_detectors(spark, sf_dir), weights))
    return fused.select("item_id", F.round("score", 9).alias("score"), F.round("disagreement", 9).alias("disagreement"))


@query(f"""with {THREE}, b as (select item_id, max(score) as score, arg_min(detector, (-score, detector)) as chosen from three where score is not null group by 1)
  select item_id, coalesce(score, 0.5) as score, chosen from (select distinct item_id from three) left join b using (item_id)""")
def fuse_fallback(spark, sf_dir):
    none = spark.createDataFrame([], "detector string, weight double")
    fused = fusion.fuse(fusion.weight_join(three_detectors(spark, sf_dir), none))
    return fused.select("item_id", "score", F.get(F.map_keys("weights_used"), F.lit(0)).alias("chosen"))


FUSED = f"""{THREE}, w as (select *, case detector when 'spatial' then 0.5 when 'other' then 0.25 else 0 end::double as weight from three),
  f as (select item_id, count(score) as n, count(score) filter (weight > 0) as k, sum(weight) filter (score is not null) as total, sum(score * weight) as ws, stddev_pop(score) filter (weight > 0) as d, max(score) as hi,
    arg_min(detector, (-score, detector)) filter (score is not null) as chosen from w group by 1)"""


@query(f"""with {FUSED} select w.item_id, w.detector, round(w.weight / f.total, 9) as weight from w join f using (item_id) where w.score is not null and w.weight > 0
  union all select item_id, chosen, 1.0 from f where n > 0 and k = 0""")
def fuse_weights_used(spark, sf_dir):
    weights = spark.createDataFrame([("spatial", 0.5), ("other", 0.25)], "detector string, weight double")
    fused = fusion.fuse(fusion.weight_join(three_detectors(spark, sf_dir), weights))
    return fused.select("item_id", F.explode("weights_used").alias("detector", "weight")).withColumn("weight", F.round("weight", 9))


@query(f"""with {FUSED}, i as (select item_id, case when n = 0 then 0.5 when k = 0 then hi else ws / total end as s, case when n = 0 then 'no detector gave a score'
    when k = 0 then 'no weights are known for these detectors: the score is that of ' || chosen when k > 1 then 'weighted by validation AUC; the detectors lie ' || round(d::decimal(28, 10), 3)::varchar || ' apart' end as note,
    item_id % 11 = 0 as marked, item_id % 4 = 0 as valid from f),
  o as (select *, case when marked and s < 0.88 then 'generator_metadata' when not marked and valid and s > 0.35 then 'c2pa_valid' end as override from i)
  select item_id, round(case override when 'generator_metadata' then 0.88::double when 'c2pa_valid' then 0.35::double else s end, 9) as score, override,
    array_to_string(list_filter([note, case override when 'generator_metadata' then 'metadata names FLUX: raised to 0.88; markers can be removed, so none proves nothing'
      when 'c2pa_valid' then 'valid credentials of signer ' || (item_id % 3) || ': lowered to 0.35; they attest the signing, not what came before' end], lambda x: x is not null), '; ') as notes from o""")
def score_items_long(spark, sf_dir):
    key = F.col("key")
    items = fx.signals(spark, sf_dir).select(key.alias("item_id"), F.when(key % 11 == 0, "FLUX").alias("marker"), (key % 4 == 0).alias("manifest_valid"), F.concat(F.lit("signer "), (key % 3).cast("string")).alias("signer"))
    weights = spark.createDataFrame([("spatial", 0.5), ("other", 0.25)], "detector string, weight double")
    scored = scoring.score_items_long(items, three_detectors(spark, sf_dir), weights)
    return scored.select("item_id", F.round("score", 9).alias("score"), "override", F.array_join("notes", "; ").alias("notes"))


OVERRIDE_SQL = f"""with {ITEMS} select item_id, case when marker is not null and frequency < 0.88 then 'generator_metadata' when marker is null and manifest_valid and frequency > 0.35 then 'c2pa_valid' end as override,
  case when marker is not null and frequency < 0.88 then 0.88::double when marker is null and manifest_valid and frequency > 0.35 then 0.35::double else frequency end as score from items"""


@query(OVERRIDE_SQL)
def override_rules(spark, sf_dir):
    return fusion.override(fx.items(spark, sf_dir).withColumn("score", F.col("frequency"))).select("item_id", "override", "score")


@query(f"""with {ITEMS}, n as (select item_id, list_filter([case when frequency * 2 > 1.2 then 'irregular spectrum tail (' || printf('%.2f', frequency * 2) || ')' end,
   case when blur / 250 > 0.9 then 'uneven noise (' || printf('%.2f', blur / 250) || ')' end, case when luma / 500 > 0.35 then 'pronounced block grid (' || printf('%.2f', luma / 500) || ')' end], lambda x: x is not null) as notes,
   (least(1, frequency * 2 / 1.2::double) + least(1, blur / 250 / 0.9::double) + least(1, luma / 500 / 0.35::double)) / 3 as score from items)
  select item_id, round(score, 9) as score, case when len(notes) = 0 then 'nothing unusual measured' else array_to_string(notes, '; ') end as notes from n""")
def component_scores(spark, sf_dir):
    stats = (F.col("frequency") * 2, F.col("blur") / 250, F.col("luma") / 500)
    rows = fx.items(spark, sf_dir)
    return rows.select("item_id", F.round(fusion.component_score(*stats), 9).alias("score"), F.array_join(fusion.signal_notes(*stats), "; ").alias("notes"))


# ---- metrics

AUC_SQL = """, ranked as (select dataset, detector, label, avg(rn) over (partition by dataset, detector, score) as mid from (select *, row_number() over (partition by dataset, detector order by score) as rn from long)),
aucs as (select dataset, detector, (sum(mid) filter (label = 1) - count(*) filter (label = 1) * (count(*) filter (label = 1) + 1) / 2.0) / (count(*) filter (label = 1) * count(*) filter (label = 0)) as auc from ranked group by 1, 2)"""
ROC_SQL = """, cells as (select dataset, detector, score, sum(label)::double as tp, sum(1 - label)::double as fp from long group by 1, 2, 3),
cum as (select *, sum(tp) over w as tps, sum(fp) over w as fps, sum(tp) over g as p, sum(fp) over g as n, count(*) over g as rws from cells
  window w as (partition by dataset, detector order by score desc rows unbounded preceding), g as (partition by dataset, detector)),
bent as (select *, lead(tps) over o - 2 * tps + lag(tps) over o <> 0 or lead(fps) over o - 2 * fps + lag(fps) over o <> 0 as bent, lag(score) over o is null or lead(score) over o is null as ends from cum
  window o as (partition by dataset, detector order by score desc)),
kept as (select dataset, detector, row_number() over (partition by dataset, detector order by score desc) as idx, fps / n as fpr, tps / p as tpr, score as threshold from bent where rws <= 2 or ends or bent),
roc as (select * from kept union all select distinct dataset, detector, 0, 0.0, 0.0, null from kept)"""


@query(f"with {LONG}{AUC_SQL} select dataset, detector, round(auc, 9) as auc from aucs")
def auc(spark, sf_dir):
    return metrics.auc(long_signals(spark, sf_dir)).withColumn("auc", F.round("auc", 9))


@query(f"with {LONG}{ROC_SQL} select dataset, detector, cast(idx as int) as idx, round(fpr, 9) as fpr, round(tpr, 9) as tpr, threshold from roc")
def roc_curve(spark, sf_dir):
    return metrics.roc_curve(long_signals(spark, sf_dir)).withColumns({c: F.round(c, 9) for c in ("fpr", "tpr")})


@query(f"with {LONG}{ROC_SQL.replace('where rws <= 2 or ends or bent', '')} select dataset, detector, cast(idx as int) as idx, round(fpr, 9) as fpr, round(tpr, 9) as tpr, threshold from roc")
def roc_curve_full(spark, sf_dir):
    return metrics.roc_curve(long_signals(spark, sf_dir), drop_intermediate=False).withColumns({c: F.round(c, 9) for c in ("fpr", "tpr")})


@query(f"""with {LONG}{ROC_SQL} select dataset, detector, round(arg_min((fpr + 1 - tpr) / 2, (round(abs(1 - tpr - fpr), 12), idx)), 9) as eer, arg_min_null(threshold, (round(abs(1 - tpr - fpr), 12), idx)) as eer_threshold from roc group by 1, 2""")
def equal_error_rate(spark, sf_dir):
    eer = metrics.equal_error_rate(metrics.roc_curve(long_signals(spark, sf_dir)))
    return eer.withColumn("eer", F.round("eer", 9))


@query(f"""with {LONG}{ROC_SQL}, sizes as (select dataset, detector, count(*) filter (label = 0) as nn from long group by 1, 2),
 asked as (select *, case when nn = 0 then 'no negatives' when t < 1 / greatest(nn, 1)::double then 'not measurable: ' || nn || ' negatives' end as reason from sizes, (values (0.01::double), (0.1::double), (0.001::double)) v(t)),
 best as (select dataset, detector, t, arg_max(tpr, idx) as tpr, arg_max_null(threshold, idx) as threshold from asked join roc using (dataset, detector) where reason is null and fpr <= t group by 1, 2, 3)
 select dataset, detector, t as target_fpr, round(tpr, 9) as tpr, threshold, reason is null as measurable, reason is null and t * nn < 10 as unstable, reason from asked left join best using (dataset, detector, t)""")
def tpr_at_fpr(spark, sf_dir):
    rows = long_signals(spark, sf_dir)
    found = metrics.tpr_at_fpr(rows, metrics.roc_curve(rows), targets=(0.01, 0.1, 0.001))
    return found.withColumn("tpr", F.round("tpr", 9))


BINS_SQL = """, binned as (select dataset, detector, least(floor(score * 10), 9)::int as bin, count(*) as n, avg(score) as m, avg(label) as f from long group by 1, 2, 3),
frame as (select distinct dataset, detector, b::int as bin from long, range(10) t(b)),
bins as (select dataset, detector, bin, coalesce(n, 0) as n, coalesce(m, 0) as mean_score, coalesce(f, 0) as positive_share from frame left join binned using (dataset, detector, bin))"""


@query(f"with {LONG}{BINS_SQL} select dataset, detector, bin, n, round(mean_score, 9) as mean_score, round(positive_share, 9) as positive_share from bins")
def calibration_bins(spark, sf_dir):
    return metrics.calibration_bins(long_signals(spark, sf_dir)).withColumns({c: F.round(c, 9) for c in ("mean_score", "positive_share")})


EVALUATE = f"""with {LONG}{AUC_SQL}{ROC_SQL}{BINS_SQL},
 eers as (select dataset, detector, arg_min((fpr + 1 - tpr) / 2, (round(abs(1 - tpr - fpr), 12), idx)) as eer, arg_min_null(threshold, (round(abs(1 - tpr - fpr), 12), idx)) as eer_threshold from roc group by 1, 2),
 eces as (select dataset, detector, sum(n * abs(mean_score - positive_share)) / sum(n) as ece from bins group by 1, 2),
 sums as (select dataset, detector, count(*) as n, count(*) filter (label = 1) as n_positive, count(*) filter (label = 0) as n_negative, avg(score) filter (label = 1) as mean_positive, avg(score) filter (label = 0) as mean_negative from long group by 1, 2)
 select dataset, detector, n, n_positive, n_negative, round(mean_positive, 9) as mean_positive, round(mean_negative, 9) as mean_negative, round(auc, 9) as auc, round(eer, 9) as eer, eer_threshold, round(ece, 9) as ece
 from sums join aucs using (dataset, detector) join eers using (dataset, detector) join eces using (dataset, detector)"""


@query(EVALUATE)
def evaluate(spark, sf_dir):
    found = metrics.evaluate(long_signals(spark, sf_dir))
    return found.withColumns({c: F.round(c, 9) for c in ("mean_positive", "mean_negative", "auc", "eer", "ece")})


#: Poisson draws of cells: cumulative probabilities of each count that occurs, and of them those that a draw has passed.
BOOT_SQL = """, bcells as (select dataset, detector, score, label, count(*) as bk from long group by 1, 2, 3, 4),
 bcounts as (select distinct bk from bcells),
 bpmf as (select bk, bn, exp(bn * ln(bk) - bk - lgamma(bn + 1)) as bp from (select bk, unnest(range(greatest(0, floor(bk - (12 * sqrt(bk) + 20)))::bigint, ceil(bk + 12 * sqrt(bk) + 20)::bigint + 1)) as bn from bcounts)),
 bcdf as (select bk, min(bn) as blow, list(bc order by bn) as bcum from (select *, sum(bp) over (partition by bk order by bn) / sum(bp) over (partition by bk) as bc from bpmf) group by 1),
 bdraw as (select *, b * 4 + i + 1 as r, ('0x' || substr(md5(floor(score * 4503599627370496.0::double)::bigint || '|' || label || '|' || b), 8 * i::int + 1, 8))::bigint / 4294967296.0::double as u from bcells, range(125) t(b), range(4) j(i)),
 bw as (select dataset, detector, r, score, label, blow + len(list_filter(bcum, lambda x: x <= u)) as bweight from bdraw join bcdf using (bk)),
 bsum as (select dataset, detector, r, score, coalesce(sum(bweight) filter (label = 1), 0)::double as btp, coalesce(sum(bweight) filter (label = 0), 0)::double as bfp from bw group by 1, 2, 3, 4),
 bbelow as (select *, coalesce(sum(bfp) over (partition by dataset, detector, r order by score rows between unbounded preceding and 1 preceding), 0) as below from bsum),
 bauc as (select dataset, detector, r, case when sum(btp) * sum(bfp) > 0 then sum(btp * (below + bfp / 2)) / (sum(btp) * sum(bfp)) end as auc from bbelow group by 1, 2, 3),
 boot as (select dataset, detector, quantile_cont(auc, 0.025) as low, quantile_cont(auc, 0.975) as high, count(*) as replicates from bauc where auc is not null group by 1, 2)"""


@query(f"with {LONG}{BOOT_SQL} select dataset, detector, round(low, 9) as low, round(high, 9) as high, replicates from boot")
def bootstrap_auc(spark, sf_dir):
    found = metrics.bootstrap_auc(long_signals(spark, sf_dir))
    return found.withColumns({c: F.round(c, 9) for c in ("low", "high")})


@query(f"""with {LONG} select dataset, detector, count(*) as n, count(*) filter (label = 1) as n_positive from long group by 1, 2""")
def measurable_groups(spark, sf_dir):
    return metrics.class_summary(long_signals(spark, sf_dir)).select("dataset", "detector", "n", "n_positive")


# ---- calibration

GRID = "(values " + ", ".join(f"({t}::double)" for t in TEMPERATURES) + ")"
LOSS = f""", cells as (select dataset, detector, score, sum(label)::double as tp, sum(1 - label)::double as fp from long group by 1, 2, 3),
 z as (select *, 1 / (1 + exp(-(ln(greatest(0.000001, least(0.999999, score)) / (1 - greatest(0.000001, least(0.999999, score)))) / t))) as q0 from cells, {GRID} g(t)),
 losses as (select dataset, detector, t, sum(-(tp * ln(greatest(1e-7, least(1 - 1e-7, q0))) + fp * ln(1 - greatest(1e-7, least(1 - 1e-7, q0))))) / sum(tp + fp) as nll from z group by 1, 2, 3),
 fitted as (select dataset, detector, arg_min(t, (round(nll, 10), t)) as temperature, min(nll) as nll from losses group by 1, 2)"""


@query(f"with {LONG}{LOSS} select dataset, detector, temperature, round(nll, 8) as nll from fitted")
def fit_temperature(spark, sf_dir):
    return calibrate.fit_temperature(long_signals(spark, sf_dir)).withColumn("nll", F.round("nll", 8))


LIFT_SQL = """, l as (select dataset, detector, auc, greatest(0, auc - 0.5) as lift, sum(greatest(0, auc - 0.5)) over (partition by dataset) as total from aucs),
 weights as (select dataset, detector, round(auc, 4) as auc, round(case when total > 0 then lift / total else 0 end, 4) as weight, case when total <= 0 then 'weights need a detector above chance, and there is none'
   when lift = 0 then 'left out: measured AUC ' || round(auc::decimal(28, 10), 3)::varchar || ', chance is 0.5' else 'its share of all lift over chance; measured AUC ' || round(auc::decimal(28, 10), 3)::varchar end as rationale from l)"""


@query(f"with {LONG}{AUC_SQL}{LIFT_SQL} select dataset, detector, auc, weight, rationale, cast(row_number() over (partition by dataset order by auc desc, detector) as int) as rank from weights")
def derive_weights(spark, sf_dir):
    return calibrate.ordered_weights(calibrate.derive_weights(metrics.auc(long_signals(spark, sf_dir)), ["dataset"]), ["dataset"])


@query(f"""with {LONG}{LOSS}, moved as (select l.key, l.dataset, l.detector, l.label, 1 / (1 + exp(-(ln(greatest(0.000001, least(0.999999, l.score)) / (1 - greatest(0.000001, least(0.999999, l.score)))) / f.temperature))) as score
   from long l join fitted f on l.detector = f.detector and f.dataset = 'calib' where l.dataset = 'report')
 select detector, count(*) as n, round(avg(score), 8) as mean_score from moved group by 1""")
def apply_cross_dataset(spark, sf_dir):
    rows = long_signals(spark, sf_dir)
    temperatures = written(calibrate.fit_temperature(rows.where("dataset = 'calib'")), "temperatures")
    moved = calibrate.calibrated(rows.where("dataset = 'report'"), temperatures)
    return moved.groupBy("detector").agg(F.count("*").alias("n"), F.round(F.avg("score"), 8).alias("mean_score"))


EVAL_SQL = f"""{AUC_SQL}{ROC_SQL}{BINS_SQL},
 eers as (select dataset, detector, arg_min((fpr + 1 - tpr) / 2, (round(abs(1 - tpr - fpr), 12), idx)) as eer, arg_min_null(threshold, (round(abs(1 - tpr - fpr), 12), idx)) as eer_threshold from roc group by 1, 2),
 eces as (select dataset, detector, sum(n * abs(mean_score - positive_share)) / sum(n) as ece from bins group by 1, 2),
 sums as (select dataset, detector, count(*) as n, count(*) filter (label = 1) as n_positive, count(*) filter (label = 0) as n_negative, avg(score) filter (label = 1) as mean_positive, avg(score) filter (label = 0) as mean_negative from long group by 1, 2),
 evaluated as (select * from sums join aucs using (dataset, detector) join eers using (dataset, detector) join eces using (dataset, detector))"""


def over(sql: str, rows: str, tag: str) -> str:
    """Metric SQL over other rows than ``long``: its tables get names of their own."""
    names = re.findall(r"(?:, |,\n *)(\w+) as \(select", sql)
    sql = re.sub(rf"\b({'|'.join(names)})\b(?!\()", rf"\1_{tag}", sql)
    return re.sub(r"\blong\b", rows, sql)


VARIANTS = (("90", "0"), ("60", "4"), ("30", "a"))
KEPT_WORDS = lambda least: f"list_filter(string_split(lower(d.text), ' '), lambda x: md5(x) >= '{least}')"
SWEEP_SQL = "sweep as (" + " union all ".join(f"""select '{v}' as variant, d.doc_id as key, case when d.lang = 'en' then 'calib' else 'report' end as dataset, l.quality as label,
  case when d.n_chars < 60 then null else round(length(regexp_replace(d.text, '[^A-Za-z]', '', 'g')) / cast(length(d.text) as double), 4) end as spatial,
  round(len(list_distinct({KEPT_WORDS(least)})) / cast(nullif(len({KEPT_WORDS(least)}), 0) as double), 4) as frequency from documents d join labels l on d.doc_id = l.doc_id""" for v, least in VARIANTS) + ")"  # fmt: skip


def sweep_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.union_sources(*[fx.signals(spark, sf_dir, least).withColumn("variant", F.lit(v)) for v, least in VARIANTS])


@query(f"""with {SWEEP_SQL}, ranked as (select variant, label, avg(rn) over (partition by variant, frequency) as mid from (select *, row_number() over (partition by variant order by frequency) as rn from sweep where frequency is not null))
 select variant, round((sum(mid) filter (label = 1) - count(*) filter (label = 1) * (count(*) filter (label = 1) + 1) / 2.0) / (count(*) filter (label = 1) * count(*) filter (label = 0)), 4) as frequency from ranked group by 1""")
def robustness_sweep(spark, sf_dir):
    """Variants without some words: hashed ones, over whole texts."""
    rows = sweep_signals(spark, sf_dir).select("key", "label", "variant", F.lit("frequency").alias("detector"), F.col("frequency").alias("score"))
    return reports.robustness(metrics.auc(rows, ["variant", "detector"]), ["frequency"])


MEASURED = ["n", "n_positive", "n_negative", "mean_positive", "mean_negative", "auc", "eer", "eer_threshold", "ece"]
WIDE = lambda rows, names, section, dataset="dataset", detector="detector", note="null::varchar": (
    f"select '{section}' as section, dataset, detector, metric, value, note from (select {dataset} as dataset, {detector} as detector, {note} as note, {', '.join(f'{n}::double as {n}' for n in names)} from {rows}) unpivot include nulls (value for metric in ({', '.join(names)}))"
)
PROTOCOL_SQL = f"""with {LONG}{LOSS}, fit as (select * from long where dataset = 'calib'), raw as (select * from long where dataset = 'report'),
 moved as (select l.key, l.dataset, l.detector, l.label, 1 / (1 + exp(-(ln(greatest(0.000001, least(0.999999, l.score)) / (1 - greatest(0.000001, least(0.999999, l.score)))) / f.temperature))) as score
   from raw l join fitted f on l.detector = f.detector and f.dataset = 'calib'){over(EVAL_SQL, "fit", "f")}{over(EVAL_SQL, "raw", "r")}{over(EVAL_SQL, "moved", "c")}{over(BOOT_SQL, "raw", "r")}{over(LIFT_SQL.replace("aucs", "aucs_f"), "fit", "f")},
 both_ as (select r.dataset, r.detector, {', '.join(f'r.{m} as {m}_raw, c.{m} as {m}_calibrated' for m in MEASURED)} from evaluated_r r join evaluated_c c using (dataset, detector)),
 asked as (select dataset, detector, n_negative as nn, t, case when n_negative = 0 then 'no negatives' when t < 1 / greatest(n_negative, 1)::double then 'not measurable: ' || n_negative || ' negatives' end as reason from sums_r, (values (0.01::double), (0.001::double)) v(t)),
 best as (select dataset, detector, t, arg_max(tpr, idx) as tpr from asked join roc_r using (dataset, detector) where reason is null and fpr <= t group by 1, 2, 3),
 gaps as (select f.detector, f.auc - r.auc as auc_gap, f.eer - r.eer as eer_gap from evaluated_f f join evaluated_r r using (detector)),
 {SWEEP_SQL}, swept as (select variant as dataset, 'spatial' as detector, label, spatial as score from sweep where spatial is not null union all select variant, 'frequency', label, frequency from sweep where frequency is not null){over(AUC_SQL, "swept", "s")},
 covered as (select r.dataset, r.licence, count(s.key) as n_scored, count(s.key) filter (s.spatial is null) as n_without_part from (values ('calib', 'open'), ('report', 'closed')) r(dataset, licence) left join signals s on r.dataset = s.dataset group by 1, 2),
 rows_ as ({WIDE("evaluated_f", MEASURED, "in_dataset")} union all {WIDE("both_", [f"{m}_{t}" for m in MEASURED for t in ("raw", "calibrated")], "cross_dataset")}
  union all select 'thresholds', dataset, detector, 'tpr at ' || t::varchar, tpr, coalesce(reason, case when t * nn < 10 then 'unstable' end) from asked left join best using (dataset, detector, t)
  union all {WIDE("boot_r", ["low", "high", "replicates"], "intervals")} union all {WIDE("fitted where dataset = 'calib'", ["temperature", "nll"], "temperature", "null::varchar")}
  union all {WIDE("weights_f", ["auc", "weight"], "weights", "null::varchar", note="rationale")} union all {WIDE("gaps", ["auc_gap", "eer_gap"], "gap", "null::varchar")}
  union all {WIDE("aucs_s", ["auc"], "robustness")} union all {WIDE("covered", ["n_scored", "n_without_part"], "coverage", detector="null::varchar", note="licence")})"""


def protocol_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    registry = spark.createDataFrame([("calib", "open"), ("report", "closed"), ("unused", "open")], "dataset string, licence string")
    frames = protocol.cross_dataset(fx.signals(spark, sf_dir), ["spatial", "frequency"], "calib", "report", sweep=sweep_signals(spark, sf_dir), registry=registry)
    return protocol.report_rows(frames)


@query(f"{PROTOCOL_SQL} select section, dataset, detector, metric, round(value, 7) as value, note from rows_")
def cross_dataset_protocol(spark, sf_dir):
    """The whole protocol, through its nested report and back."""
    return reports.read_nested(reports.nested(protocol_report(spark, sf_dir))).withColumn("value", F.round("value", 7))


@query(f"{PROTOCOL_SQL} select case when dataset is null then section else section || ' ' || dataset end as section, coalesce(detector, '') as detector, metric, coalesce(printf('%.4f', value), '\u2014') as value, coalesce(note, '') as note from rows_")
def report_table(spark, sf_dir):
    return reports.report_table(protocol_report(spark, sf_dir))


@query(f"""with {LONG}{EVAL_SQL} select i.detector, round(i.auc, 9) as auc_in, round(c.auc, 9) as auc_cross, round(i.auc - c.auc, 9) as auc_gap, round(i.eer, 9) as eer_in, round(c.eer, 9) as eer_cross, round(i.eer - c.eer, 9) as eer_gap
  from evaluated i join evaluated c on i.detector = c.detector and i.dataset = 'calib' and c.dataset = 'report'""")
def generalisation_gap(spark, sf_dir):
    found = written(metrics.evaluate(long_signals(spark, sf_dir)), "evaluated")
    gap = reports.generalisation_gap(found.where("dataset = 'calib'"), found.where("dataset = 'report'"))
    return gap.select("detector", *[F.round(c, 9).alias(c) for c in gap.columns if c != "detector"])


@query(f"""with {SIGNALS} select r.dataset, r.licence, count(s.key) as n_scored, count(s.key) filter (s.spatial is null) as n_without_part, coalesce(round(sum(s.frequency), 1), 0) as seconds
 from (values ('calib', 'open'), ('report', 'open'), ('unused', 'closed')) r(dataset, licence) left join signals s on r.dataset = s.dataset group by 1, 2""")
def coverage(spark, sf_dir):
    registry = spark.createDataFrame([("calib", "open"), ("report", "open"), ("unused", "closed")], "dataset string, licence string")
    return reports.coverage(fx.signals(spark, sf_dir), registry, "frequency")  # any number may stand for the seconds that a sample took


@query("select case when o_orderpriority like '1%' then 'first' else 'rest' end as dataset, count(*) filter (o_orderkey % 11 = 0 or coalesce(o_orderkey % 3 <> 0 and o_orderkey % 4 = 0, false)) as n_fired, count(*) as n from orders group by 1")
def fired_counts(spark, sf_dir):
    o = fx.items(spark, sf_dir).join(fx.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item_id"), "o_orderpriority"), "item_id")
    fired = fusion.provenance_fired(F.col("manifest_valid"), F.col("marker"), F.lit(None).cast("boolean"))
    return reports.fired_counts(o.select(F.when(F.col("o_orderpriority").startswith("1"), "first").otherwise("rest").alias("dataset"), fired.alias("fired")))


# ---- sampling and sources


@query(f"""with {SIGNALS}, r as (select *, row_number() over (partition by dataset, label order by md5('7|' || key), key) as n from signals) select key, dataset, label from r where n <= 20""")
def balanced_sample(spark, sf_dir):
    return sampling.balanced_sample(fx.signals(spark, sf_dir), 40, 7, group=("dataset",)).select("key", "dataset", "label")


@query("""select url as path, case split_part(lower(url), '/', 4) when 'en' then 1 when 'de' then 0 end as label from (select distinct split_part(url, '?', 1) || '.jpg' as url from pages where page_id % 3 <> 0)
 where split_part(lower(url), '/', 4) in ('en', 'de')""")
def labelled_members(spark, sf_dir):
    # all pages are members, a third of them no media: the operator's suffix rule leaves these out
    suffix = F.when(F.col("page_id") % 3 != 0, ".jpg").otherwise(".html")
    pages = fx.table(spark, sf_dir, "pages").select(F.concat(F.substring_index("url", "?", 1), suffix).alias("path")).distinct()
    return sampling.labelled_members(pages.withColumn("archive", F.lit("a")), 3, {"en": 1, "de": 0}).select("path", "label")


@query("""with r as (select user_id as key, event_type, value, row_number() over (partition by user_id order by event_id desc) as n from events) select key, event_type, value from r where n = 1""")
def latest_by_key(spark, sf_dir):
    e = fx.table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), "event_type", "value", "event_id")
    return sampling.latest_by_key(e, "key", "event_id").select("key", "event_type", "value")


@query("select doc_id as key, 'todo' as state from documents where doc_id not in (select doc_id from labels) union all select doc_id, 'reused' from labels where doc_id in (select doc_id from documents)")
def resume_join(spark, sf_dir):
    d, lab = fx.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key")), fx.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("key"))
    todo, reused = sampling.resume(d, lab)
    return todo.select("key", F.lit("todo").alias("state")).unionByName(reused.select("key", F.lit("reused").alias("state")))


@query("""select cast(doc_id as varchar) as key, quality as label, case when doc_id % 3 = 0 then null else doc_id % 10 / 10.0::double end as spatial, 0.5::double as frequency, doc_id % 2 = 0 as fired from labels where doc_id % 5 <> 0""")
def read_score_lines(spark, sf_dir):
    lab = fx.table(spark, sf_dir, "labels")
    full = F.struct(F.col("doc_id").cast("string").alias("key"), F.col("quality").alias("label"), F.when(F.col("doc_id") % 3 != 0, F.col("doc_id") % 10 / 10.0).alias("spatial"), F.lit(0.5).alias("frequency"), (F.col("doc_id") % 2 == 0).alias("provenance_fired"), F.lit(1).alias("faces_found"), F.lit("d").alias("dataset"))
    json = F.to_json(full, {"ignoreNullFields": "false"})
    # each fifth line is cut off, or lacks a key
    line = F.when(F.col("doc_id") % 10 == 0, F.substring(json, 1, 40)).when(F.col("doc_id") % 5 == 0, F.regexp_replace(json, '"frequency":[^,]*,', "")).otherwise(json)
    return scores.parse_scores(lab.select(line.alias("value"), F.col("doc_id").alias("seq")), "seq").select("key", "label", "spatial", "frequency", F.col("provenance_fired").alias("fired"))


@query(f"with {LONG}{AUC_SQL}{LIFT_SQL}{LOSS} select detector, temperature, auc, weight, rationale from weights join fitted using (dataset, detector) where dataset = 'calib'")
def calibration_round_trip(spark, sf_dir):
    fit = long_signals(spark, sf_dir).where("dataset = 'calib'")
    fitted = calibrate.fit_temperature(fit).select("detector", "temperature").join(calibrate.derive_weights(metrics.auc(fit)).hint("merge"), "detector")
    path = scratch_path(spark, "calibration")
    scores.write_calibration(fitted, path, {"calibration_dataset": "calib"})
    return scores.read_calibration(spark, path).select("detector", "temperature", "auc", "weight", "rationale")


@query("""select doc_id as key, doc_id in (select doc_id from labels) as reused from documents""")
def resume_append(spark, sf_dir):
    planned, cached = fx.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key")), fx.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("key"), F.lit(True).alias("reused"))
    path = scratch_path(spark, "cache")
    cached.write.parquet(path)
    scores.resume_append(planned, cached, lambda rows: rows.withColumn("reused", F.lit(False)), path)
    return spark.read.parquet(path)


@query(f"with {SWEEP_SQL} select key, frequency from sweep where dataset = 'report' and variant = '60'")
def score_partition(spark, sf_dir):
    rows = sweep_signals(spark, sf_dir).withColumns({"n": F.lit(400), "seed": F.lit(7)})
    path = scratch_path(spark, "by-configuration")
    scores.write_partitioned(rows, path)
    return spark.read.parquet(path).where("dataset = 'report' and variant = '60'").select("key", "frequency")


@query("select event_type as dataset, count(*)::double as value from events where extract(day from ts) % 3 = 2 group by 1")
def latest_report(spark, sf_dir):
    """Each third of the days has a report; the one that is last by name is read."""
    days = fx.table(spark, sf_dir, "events").withColumn("third", F.dayofmonth("ts") % 3)
    path = scratch_path(spark, "reports")
    for k in range(3):
        counts = days.where(F.col("third") == k).groupBy("event_type").count()
        rows = counts.select(F.lit("events").alias("section"), F.col("event_type").alias("dataset"), F.lit(None).cast("string").alias("detector"), F.lit("n").alias("metric"), F.col("count").cast("double").alias("value"), F.lit(None).cast("string").alias("note"))
        reports.write_report(rows, path, f"2024-01-0{k + 1}")
    return reports.read_nested(reports.latest_report(spark, path)).select("dataset", "value")


@query("select o_orderkey as item_id, case when o_orderkey % 11 = 0 then 1 else 0 end as n_notes from orders")
def tolerant_reports(spark, sf_dir):
    rows = fx.items(spark, sf_dir).select("item_id", F.when(F.col("marker").isNotNull(), F.array("marker")).alias("notes"))
    read = reports.read_report_column(reports.report_column(rows, ["item_id"]), "notes array<string>").select("item_id", "report.notes")
    return jobs.tolerant(read, "notes", "array<string>").select("item_id", F.size("notes").alias("n_notes"))


@query(f"with {SIGNALS} select key from signals where dataset = 'calib'")
def overlap_guard(spark, sf_dir):
    s = fx.signals(spark, sf_dir)
    return calibrate.overlap_guard(s.where("dataset = 'calib'"), s.where("dataset = 'report'")).select("key")


@query("select l_orderkey as item_id, array_to_string(list(l_returnflag || l_linestatus order by l_partkey, l_returnflag || l_linestatus), '; ') as notes from lineitem group by 1")
def fold_notes(spark, sf_dir):
    lines = fx.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("item_id"), F.col("l_partkey").alias("pos"), F.concat("l_returnflag", "l_linestatus").alias("note"))
    return fusion.fold_notes(lines, "item_id").withColumn("notes", F.array_join("notes", "; "))


@query("select distinct name from (select 'spatial' as name union all select 'frequency' union all select 'other')")
def distinct_detectors(spark, sf_dir):
    return reports.distinct_detectors(three_detectors(spark, sf_dir)).withColumnRenamed("detector", "name")


@query("select r_name as dataset, 'hub/' || r_name as hub_id, case when r_regionkey % 2 = 0 then 'open' else 'closed' end as licence, r_regionkey % 2 = 0 as commercial, n_name as path, n_nationkey % 2 as label from region join nation on n_regionkey = r_regionkey")
def dataset_registry(spark, sf_dir):
    sources = fx.table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.collect_list(F.struct(F.col("n_name").alias("path"), (F.col("n_nationkey") % 2).alias("label"))).alias("sources"))
    open_ = F.col("r_regionkey") % 2 == 0
    specs = fx.table(spark, sf_dir, "region").join(sources.hint("merge"), "r_regionkey").select(F.col("r_name").alias("dataset"), F.concat(F.lit("hub/"), "r_name").alias("hub_id"), F.when(open_, "open").otherwise("closed").alias("licence"), open_.alias("commercial"), "sources")
    return sampling.dataset_registry(specs)


@query("""select event_id, user_id from (select *, row_number() over (partition by user_id order by event_id) - 1 as n, greatest(1, count(*) over (partition by user_id) // 16) as step from events) where n % step = 0 and n // step < 16""")
def systematic_cap(spark, sf_dir):
    return sampling.systematic_cap(fx.table(spark, sf_dir, "events").select("event_id", "user_id"), "user_id", "event_id", 16)


@query(f"with {ITEMS} select item_id, printf('%.4f', o_totalprice) as price, printf('%.1f%%', frequency * 100) as share, coalesce(jpeg_q::varchar || '.00', '-') as quality from items join orders on o_orderkey = item_id")
def number_formats(spark, sf_dir):
    o = fx.items(spark, sf_dir).join(fx.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item_id"), "o_totalprice"), "item_id")
    return o.select("item_id", sc.fixed(F.col("o_totalprice")).alias("price"), sc.percent(F.col("frequency")).alias("share"), sc.fixed(F.col("jpeg_q").cast("double"), 2, "-").alias("quality"))


@query(f"with {ITEMS} select item_id, blur, marker from items")
def report_json_round_trip(spark, sf_dir):
    rows = fx.items(spark, sf_dir).select("item_id", "blur", "marker")
    back = reports.read_report_column(reports.report_column(rows, ["item_id"]), "blur double, marker string")
    return back.select("item_id", "report.blur", "report.marker")


# ---- fingerprints, markers, manifests

HASHES = """own as (select vec_id as id, array_to_string(list_transform(embedding, lambda v: case when v::double > list_sort(list_transform(embedding[2:], lambda x: x::double))[32] then '1' else '0' end), '')::bit::bigint as h from embeddings),
 hashes as (select * from own union all select id + 1000000, xor(xor(h, ('0' || repeat('0', 62 - (id % 64)::int) || '1' || repeat('0', (id % 64)::int))[-64:]::bit::bigint), (repeat('0', 63 - (id * 7 % 64)::int) || '1' || repeat('0', (id * 7 % 64)::int))::bit::bigint) from own where id % 5 = 0)"""
HASHES = HASHES.replace("('0' || repeat('0', 62 - (id % 64)::int) || '1' || repeat('0', (id % 64)::int))[-64:]", "(repeat('0', 63 - (id % 64)::int) || '1' || repeat('0', (id % 64)::int))")


@query(f"with {HASHES} select id, lower(lpad(printf('%x', h), 16, '0')) as hex from hashes")
def fingerprint_hex(spark, sf_dir):
    return fx.hashes(spark, sf_dir).select("id", sc.hex64(F.col("h")).alias("hex"))


CLASSES_SQL = f"{HASHES}, classes as (select h, min(id) as rep from hashes group by h)"


@query(f"with {CLASSES_SQL} select a.rep as a, b.rep as b, bit_count(xor(a.h, b.h))::int as distance from classes a join classes b on a.rep < b.rep and bit_count(xor(a.h, b.h)) <= 3")
def near_duplicates(spark, sf_dir):
    return fingerprint.near_duplicates(fx.hashes(spark, sf_dir), 3)


@query(f"with {CLASSES_SQL} select id, rep from hashes join classes using (h)")
def fingerprint_members(spark, sf_dir):
    return fingerprint.members(fx.hashes(spark, sf_dir))


@query(f"with {HASHES}, known as (select h, min(id) as rep from hashes where id < 1000000 group by h) select a.id as a, b.rep as b, bit_count(xor(a.h, b.h))::int as distance from hashes a join known b on a.id >= 1000000 and bit_count(xor(a.h, b.h)) <= 2")
def hash_lookup(spark, sf_dir):
    h = fx.hashes(spark, sf_dir)
    return fingerprint.prior_reports(h.where("id >= 1000000"), h.where("id < 1000000"), 2)


@query(f"with {HASHES}, known as (select h, min(id) as rep from hashes where id < 1000000 group by h) select a.id as a, b.rep as b from hashes a join known b on a.h = b.h")
def equal_lookup(spark, sf_dir):
    h = fx.hashes(spark, sf_dir)
    return fingerprint.prior_reports(h, h.where("id < 1000000")).select("a", "b")


MARKERS = [(0, "tion", "first"), (1, "worthless", "second"), (2, "password", "third"), (3, "licen", "fourth")]


@query("""select doc_id as id, case when contains(lower(text), 'tion') then 'first' when contains(lower(text), 'worthless') then 'second' when contains(lower(text), 'password') then 'third' when contains(lower(text), 'licen') then 'fourth' end as label from documents""")
def marker_join(spark, sf_dir):
    markers = spark.createDataFrame(MARKERS, "pos int, marker string, label string")
    return provenance.marker_join(fx.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), markers).select("id", "label")


OWN_WORDS = "select doc_id as pos, lower(substr(text, 20, 8)) as marker, 'doc ' || doc_id as label from documents where doc_id % 7 = 0"


@query(f"with m as ({OWN_WORDS}) select d.doc_id as id, arg_min(m.label, (m.pos, m.marker)) as label from documents d left join m on contains(lower(d.text), m.marker) group by 1")
def marker_scan(spark, sf_dir):
    """Eight letters of each seventh document are a marker: by the automaton."""
    docs = fx.table(spark, sf_dir, "documents")
    markers = docs.where("doc_id % 7 = 0").select(F.col("doc_id").alias("pos"), F.lower(F.substring("text", 20, 8)).alias("marker"), F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("label"))
    return provenance.marker_join(docs.select(F.col("doc_id").alias("id"), "text"), markers).select("id", "label")


#: Pages name each marker in turn, some none: (page_id % (markers + 1)) tells which.
SOFTWARE = f"coalesce(' made with ' || upper({sql_list([m for m, _ in GENERATORS])}[(page_id % {len(GENERATORS) + 1} + 1)::int]), '')"


@query("select page_id as id, coalesce(" + ", ".join(f"case when contains(lower(url || html || {SOFTWARE}), '{m}') then '{lab}' end" for m, lab in GENERATORS) + ") as marker from pages")
def generator_markers(spark, sf_dir):
    named = F.get(F.array(*[F.lit(m.upper()) for m, _ in GENERATORS]), (F.col("page_id") % (len(GENERATORS) + 1)).cast("int"))
    text = F.concat("url", "html", F.coalesce(F.concat(F.lit(" made with "), named), F.lit("")))
    return fx.table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), provenance.first_marker(text, GENERATORS).alias("marker"))


@query("""select event_id as id, event_id % 4 <> 0 as present, case event_id % 4 when 0 then null when 1 then false when 2 then true else false end as valid, case when event_id % 4 >= 2 then event_type end as signer from events""")
def manifests(spark, sf_dir):
    e = fx.table(spark, sf_dir, "events")
    entry = lambda status: F.concat(F.lit('{"active_manifest":"m","manifests":{"m":{"signature_info":{"issuer":"","common_name":"'), "event_type", F.lit('"}}}' + status + "}"))
    json = F.when(F.col("event_id") % 4 == 1, "{broken").when(F.col("event_id") % 4 == 2, entry(',"validation_status":[]')).when(F.col("event_id") % 4 == 3, entry(',"validation_status":[{"code":"x"}]'))
    return e.select(F.col("event_id").alias("id"), provenance.manifest(json).alias("m")).select("id", "m.present", "m.valid", "m.signer")


#: Documents end with each banned word or phrase in turn, some with none.
BANNED = FORBIDDEN_WORDS + FORBIDDEN_PHRASES
ENDED = f"(lower(text) || ' ' || coalesce({sql_list(BANNED)}[(doc_id % {len(BANNED) + 1} + 1)::int], ''))"


@query(f"""select doc_id as id, array_to_string(list_concat(list_filter({sql_list(FORBIDDEN_WORDS)}, lambda w: list_contains(regexp_split_to_array(replace({ENDED}, '-', ' '), ' +'), w)),
  list_filter({sql_list(FORBIDDEN_PHRASES)}, lambda p: contains({ENDED}, p))), ',') as terms from documents where text is not null""")
def forbidden_terms(spark, sf_dir):
    ended = F.get(F.array(*[F.lit(t) for t in BANNED]), (F.col("doc_id") % (len(BANNED) + 1)).cast("int"))
    text = F.concat("text", F.lit(" "), F.coalesce(ended, F.lit("")))
    listed = F.array_intersect(F.array(*[F.lit(t) for t in BANNED]), provenance.forbidden_terms(text))  # in the order of the lists
    return fx.table(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").alias("id"), F.array_join(listed, ",").alias("terms"))


@query("""select field, side from ((select distinct p_brand || p_type as field, 'left' as side from part where p_size < 25 and p_brand || p_type not in (select p_brand || p_type from part where p_size >= 25))
  union all (select distinct p_brand || p_type, 'right' from part where p_size >= 25 and p_brand || p_type not in (select p_brand || p_type from part where p_size < 25)))""")
def schema_diff(spark, sf_dir):
    p = fx.table(spark, sf_dir, "part").select(F.concat("p_brand", "p_type").alias("field"), "p_size")
    return provenance.schema_diff(p.where("p_size < 25").select("field").distinct(), p.where("p_size >= 25").select("field").distinct())


@query("""with l as (select c_custkey // 2 as model, c_custkey % 2 as index, contains(lower(c_mktsegment), 'build') or contains(lower(c_mktsegment), 'auto') as pos, contains(lower(c_mktsegment), 'machin') or contains(lower(c_mktsegment), 'house') as neg from customer),
  m as (select model, count(*) as n, count_if(pos) as np, count_if(neg) as nn, max(index) filter (pos) as pi, max(index) filter (not neg) as rest from l group by 1)
  select model, case when np = 1 then pi when n = 2 and nn = 1 and np = 0 then rest end as index, case when np <> 1 and not (n = 2 and nn = 1 and np = 0) then 'ambiguous labels' end as problem from m""")
def label_hints(spark, sf_dir):
    c = fx.table(spark, sf_dir, "customer").select(F.floor(F.col("c_custkey") / 2).alias("model"), (F.col("c_custkey") % 2).alias("index"), F.col("c_mktsegment").alias("label"))
    return provenance.positive_index(c, ["build", "auto"], ["machin", "house"])


# ---- jobs

UPLOADS = """uploads as (select doc_id as id, case when doc_id % 13 <> 0 then ['image/jpeg', 'image/png', 'image/webp', 'text/plain', 'image/bmp'][(doc_id % 5 + 1)::int] end as mime,
  case when doc_id % 23 = 0 then 0 else n_chars end as size, doc_id % 9 <> 0 as consent from documents)"""
TYPES = "('image/jpeg', 'image/png', 'image/webp', 'image/bmp')"


ADMIT_SQL = f"""with {UPLOADS} select id, case when not consent then 400 when coalesce(mime, '') not in {TYPES} then 415 when size = 0 then 400 when size > 4000 then 413 else 202 end as status,
  case when not consent then 'no consent' when coalesce(mime, '') not in {TYPES} then 'unsupported type' when size = 0 then 'empty file' when size > 4000 then 'too large' end as reason from uploads"""


@query(ADMIT_SQL)
def admit(spark, sf_dir):
    return jobs.admit(fx.uploads(spark, sf_dir), 4000).select("id", "status", "reason")


@query(f"with {UPLOADS} select id, case when coalesce(mime, '') not in {TYPES} then 415 when size > 4000 then 413 when size = 0 then 400 else 202 end as status from uploads")
def admit_service(spark, sf_dir):
    return jobs.admit(fx.uploads(spark, sf_dir), 4000, jobs.SERVICE).select("id", "status")


JOBS = """jobs as (select o_orderkey as id, o_custkey as user_id, case when o_orderkey % 17 = 0 then 'failed' else case o_orderstatus when 'F' then 'complete' when 'O' then 'queued' else 'processing' end end as status,
  o_orderdate as created_at, o_orderdate + interval 24 hour as ttl, case when o_orderkey % 7 <> 0 then 'media/' || o_orderkey end as storage_key, case when o_orderkey % 10 = 0 then o_orderdate end as media_deleted_at from orders)"""


def stamped(spark, sf_dir):
    return jobs.ttl_stamp(fx.jobs(spark, sf_dir))


@query(f"with {JOBS} select id, user_id, storage_key from jobs where ttl <= {NOW} and storage_key is not null and media_deleted_at is null order by ttl, id limit 500")
def select_expired(spark, sf_dir):
    return jobs.select_expired(stamped(spark, sf_dir), F.expr(NOW)).select("id", "user_id", "storage_key")


@query(f"with {JOBS} select id, ttl <= {NOW} as expired, case when ttl <= {NOW} and storage_key is not null and media_deleted_at is null and not storage_key like '%3' then null else storage_key end as storage_key from jobs")
def retention_sweep(spark, sf_dir):
    rows, now = stamped(spark, sf_dir), F.expr(NOW)
    marked = retention.sweep(rows, now, lambda key: not key.endswith("3"), None)  # deletions that fail leave the job as it is
    return marked.select("id", (F.col("ttl") <= now).alias("expired"), "storage_key")


@query(f"""with {JOBS}, r as (select id as request_id, id, user_id + (case when id % 4 = 0 then 1 else 0 end) as user_id from jobs) select r.request_id, case when j.id is null then 404 else 200 end as code, j.status from r left join jobs j on r.id = j.id and r.user_id = j.user_id""")
def owned_rows(spark, sf_dir):
    rows = fx.jobs(spark, sf_dir)
    asked = rows.select(F.col("id").alias("request_id"), "id", (F.col("user_id") + F.when(F.col("id") % 4 == 0, 1).otherwise(0)).alias("user_id"))
    return jobs.owned_rows(asked, rows.select("id", "user_id", "status")).select("request_id", "code", "status")


@query(f"""with {JOBS} select id, status, case when status = 'complete' then 'r' || id end as report, case when status = 'failed' then 'analysis failed' end as error from jobs""")
def job_state_view(spark, sf_dir):
    rows = fx.jobs(spark, sf_dir).withColumns({"report": F.concat(F.lit("r"), F.col("id").cast("string")), "error": F.lit(None).cast("string")})
    return jobs.job_state_view(rows).drop("media_deleted_at")


@query(f"""with {JOBS}, r as (select id * 2 as id from jobs) select r.id, case when j.id is null then 404 when j.ttl <= {NOW} then 410 else 200 end as code from r left join jobs j on r.id = j.id""")
def access_state(spark, sf_dir):
    rows = stamped(spark, sf_dir)
    return jobs.access_state(rows.select((F.col("id") * 2).alias("id")), rows, F.expr(NOW))


@query(f"with {JOBS} select id, user_id from jobs where not (id % 3 = 0 and id % 2 = 0)")
def erase(spark, sf_dir):
    rows = fx.jobs(spark, sf_dir)
    asked = rows.where("id % 3 = 0").select("id", (F.col("user_id") + F.when(F.col("id") % 2 == 0, 0).otherwise(1)).alias("user_id"))
    return jobs.erase(rows, asked).select("id", "user_id")


@query(f"""with {PARTS} select item_id, part_index, rule from (select item_id, part_index, unnest(list_filter([case when not (raw_score <= 0.9) then 'score' end, case when not (w > 2) then 'width' end, case when not (h > 3) then 'height' end], lambda x: x is not null)) as rule from numbered)""")
def validate_rows(spark, sf_dir):
    rows = rollup.number_parts(fx.parts(spark, sf_dir), *TIE).withColumn("id", F.struct("item_id", "part_index"))
    found = jobs.violations(rows, {"score": F.col("raw_score") <= 0.9, "width": F.col("w") > 2, "height": F.col("h") > 3})
    return found.select("id.item_id", "id.part_index", "rule")


@query("""with e as (select user_id as id, ts, event_id, case event_type when 'view' then 'processing' when 'purchase' then 'complete' when 'error' then 'error' else 'other' end as kind from events),
 x as (select *, count(*) filter (kind = 'error') over w as tried, count(*) filter (kind = 'complete') over w as done from e window w as (partition by id order by ts, event_id rows unbounded preceding)),
 o as (select *, row_number() over (partition by id order by ts, event_id) as n, (done >= 1 or tried >= 2) as over_ from x),
 cut as (select id, coalesce(min(n) filter (over_), max(n)) as stop from o group by 1),
 l as (select o.* from o join cut using (id) where n <= stop),
 k as (select id, arg_max(kind, n) filter (kind <> 'other') as last_kind, count(*) filter (kind = 'error') as attempts from l group by 1)
 select id, case when last_kind = 'processing' then 'processing' when last_kind = 'complete' then 'complete' when last_kind = 'error' and attempts >= 2 then 'failed' else 'queued' end as status, attempts::int as attempts from k""")
def job_status(spark, sf_dir):
    kind = F.when(F.col("event_type") == "view", "processing").when(F.col("event_type") == "purchase", "complete").when(F.col("event_type") == "error", "error").otherwise("other")
    return final_status(fx.table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), "ts", "event_id", kind.alias("kind")))


@query("select event_type as dataset, time_bucket(interval 1 day, ts) as start, count(*) as n, count(*) filter (value < 10) as n_without_part from events group by 1, 2")
def progress_counts(spark, sf_dir):
    from plumbline.streaming.jobs import progress_counts as counts

    e = fx.table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("dataset"), F.when(F.col("value") >= 10, F.col("value")).alias("score"))
    return counts(e, "1 day", "1 hour").select("dataset", F.col("window.start").alias("start"), "n", "n_without_part")


@query("select user_id as item_id, time_bucket(interval 6 hour, ts) as start, round(avg(value), 6) as score, count(*) as n from events group by 1, 2")
def timeline_windows(spark, sf_dir):
    from plumbline.streaming.jobs import timeline_windows as windows

    e = fx.table(spark, sf_dir, "events").select(F.col("user_id").alias("item_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("score"))
    return windows(e, "6 hours").select("item_id", F.col("w.start").alias("start"), F.round("score", 6).alias("score"), "n")


@query("""with g as (select *, case when ts - lag(ts) over (partition by user_id order by ts) < interval 5 hour then 0 else 1 end as new from events), s as (select *, sum(new) over (partition by user_id order by ts rows unbounded preceding) as b from g)
 select user_id as item_id, min(ts) as start, max(value) as score, count(*) as n from s group by user_id, b""")
def bursts(spark, sf_dir):
    from plumbline.streaming.jobs import bursts as sessions

    e = fx.table(spark, sf_dir, "events").select(F.col("user_id").alias("item_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("score"))
    return sessions(e, "5 hours").select("item_id", F.col("w.start").alias("start"), "score", "n")


# ---- streams and the job source


def arriving(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream of its files: of the one file, or of all in its folder. As a pattern, the path may name either; columns that folders in it name are found from ``basePath``."""
    return spark.readStream.schema(fx.table(spark, sf_dir, name).schema).option("basePath", sf_dir).parquet(f"{sf_dir}/{name}.parque[t]")


def finished(query: StreamingQuery) -> None:
    query.awaitTermination()


@query(ADMIT_SQL)
def stream_admit(spark, sf_dir):
    at = {k: scratch_path(spark, f"stream-{k}") for k in ("admitted", "rejected", "checkpoint")}
    finished(streams.stream_admit(fx.uploads_of(arriving(spark, sf_dir, "documents")), 4000, at["admitted"], at["rejected"], at["checkpoint"]))
    return spark.read.parquet(at["admitted"]).unionByName(spark.read.parquet(at["rejected"])).select("id", "status", "reason")


@query(OVERRIDE_SQL)
def stream_score(spark, sf_dir):
    """Items that arrive are scored and committed; readers follow the manifests."""
    batches = Batches(spark, scratch_path(spark, "stream-scored"))
    score = lambda items: fusion.override(items.withColumn("score", F.col("frequency"))).select("item_id", "override", "score")
    finished(streams.stream_commit(fx.items_of(arriving(spark, sf_dir, "orders")), score, batches, scratch_path(spark, "stream-checkpoint")))
    return batches.read("item_id long, override string, score double")


@query(f"with {HASHES} select distinct h from own")
def repeat_uploads(spark, sf_dir):
    """The fingerprints of uploads, of which repeats are dropped: each is told once."""
    own = fx.fingerprints_of(arriving(spark, sf_dir, "embeddings")).select(F.col("h").alias("phash"), F.lit("2024-01-01 00:00:00").cast("timestamp").alias("ts"))
    out = scratch_path(spark, "stream-first")
    finished(streams.repeat_uploads(own, "1 hour").writeStream.format("parquet").option("checkpointLocation", scratch_path(spark, "stream-checkpoint")).trigger(availableNow=True).start(out))
    return spark.read.schema("phash long, ts timestamp").parquet(out).select(F.col("phash").alias("h"))


@query(f"with {JOBS}, l as (select user_id as id, max(ttl) as ttl from jobs group by 1) select id, 'live' as state, ttl from l union all select id, 'expired', ttl from l where ttl <= (select max(created_at) from jobs)")
def expiry_window(spark, sf_dir):
    return streams.expiry_states(stamped(spark, sf_dir).select(F.col("user_id").alias("id"), "created_at", "ttl"))


@query("select doc_id as key, length(text) as size from documents")
def resume_batches(spark, sf_dir):
    """Two runs over overlapping thirds and the rest: each key is committed once."""
    docs = fx.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), "text")
    batches = Batches(spark, scratch_path(spark, "resumed"))
    for part in (docs.where("key % 3 < 2"), docs.where("key % 3 > 0"), docs):
        commits.resume_batches(batches, part, lambda rows: rows.select("key", F.length("text").cast("long").alias("size")), "key long, size long")
    return batches.read("key long, size long")


def laid_jobs(spark, sf_dir):
    path = scratch_path(spark, "jobs")
    job_source.write_jobs(stamped(spark, sf_dir), path, "quarter", 4)
    return job_source.read_jobs(spark, path)


@query(f"with {JOBS} select id, user_id, storage_key from jobs where ttl <= {NOW} and storage_key is not null and media_deleted_at is null")
def jobs_table_due(spark, sf_dir):
    return job_source.due_jobs(laid_jobs(spark, sf_dir), F.expr(NOW), None, "quarter").select("id", "user_id", "storage_key")


@query(f"with {JOBS}, r as (select id as request_id, id, user_id + (case when id % 4 = 0 then 1 else 0 end) as user_id from jobs where user_id % 50 = 1) select r.request_id, case when j.id is null then 404 else 200 end as code, j.status from r left join jobs j on r.id = j.id and r.user_id = j.user_id")
def jobs_table_owned(spark, sf_dir):
    asked = fx.jobs(spark, sf_dir).where("user_id % 50 = 1").select(F.col("id").alias("request_id"), "id", (F.col("user_id") + F.when(F.col("id") % 4 == 0, 1).otherwise(0)).alias("user_id"))
    return job_source.owned_jobs(laid_jobs(spark, sf_dir), asked, 4).select("request_id", "code", "status")


#: A fixed linear model: two weights for each place of an embedding.
LINEAR = ((7, 3), (5, 2))


@query("select vec_id, " + ", ".join(f"round(list_sum(list_transform(embedding, lambda x, i: x::double * (((i - 1) % {m} - {c}) / 10.0::double))), 6) as logit_{k}" for k, (m, c) in enumerate(LINEAR)) + " from embeddings")
def batch_scorer(spark, sf_dir):
    def load():
        return lambda m: m.astype(float) @ np.array([[(i % n - c) / 10 for n, c in LINEAR] for i in range(m.shape[1])])

    scored = scorers.batch_scorer(fx.table(spark, sf_dir, "embeddings"), load, "embedding", ["vec_id"])
    return scored.select("vec_id", *[F.round(F.get("logits", F.lit(k)), 6).alias(f"logit_{k}") for k in range(len(LINEAR))])


@query("select o_orderkey as id, v as variant, round(o_totalprice * (case v when 'q90' then 0.9 when 'q60' then 0.6 else 0.3 end)::double, 4) as x from orders, (values ('q90'), ('q60'), ('q30')) t(v)")
def variant_generator(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").cast("double").alias("x"))
    made = scorers.variants(rows, lambda batch, name: batch.assign(x=batch["x"] * (int(name[1:]) / 100)), ["q90", "q60", "q30"])
    return made.withColumn("x", F.round("x", 4))


# ---- grids

CELLS = """sums as (select user_id as grid_id, extract(day from ts)::int - 1 as y, extract(hour from ts)::int as x, round(sum(value), 2) as v from events group by 1, 2, 3),
 cells as (select g.grid_id, yy::int as y, xx::int as x, coalesce(v, 0) as v from (select distinct grid_id from sums) g cross join range(31) a(yy) cross join range(24) b(xx) left join sums s on s.grid_id = g.grid_id and s.y = yy and s.x = xx)"""


def grid_cells(spark, sf_dir):
    return written(fx.cells(spark, sf_dir), "cells")


@query(f"""with {CELLS}, l as (select grid_id, coalesce(lag(v) over h, lead(v) over h) + coalesce(lead(v) over h, lag(v) over h) + coalesce(lag(v) over k, lead(v) over k) + coalesce(lead(v) over k, lag(v) over k) - 4 * v as d from cells
  window h as (partition by grid_id, y order by x), k as (partition by grid_id, x order by y)) select grid_id, round(var_pop(d), 3) as blur from l group by 1""")
def laplacian_variance(spark, sf_dir):
    return grids.laplacian_variance(grid_cells(spark, sf_dir)).withColumn("blur", F.round("blur", 3))


@query(f"with {CELLS} select grid_id, round(avg(v), 6) as mean_level from cells group by 1")
def mean_level(spark, sf_dir):
    return grids.mean_level(grid_cells(spark, sf_dir)).withColumn("mean_level", F.round("mean_level", 6))


@query(f"""with {CELLS}, n as (select c.grid_id, c.y, c.x, c.v, median(d.v) as m from cells c cross join range(-1, 2) a(dy) cross join range(-1, 2) b(dx)
   join cells d on d.grid_id = c.grid_id and d.y = least(greatest(c.y + dy, 0), 30) and d.x = least(greatest(c.x + dx, 0), 23) group by 1, 2, 3, 4),
  e as (select grid_id, y // 10 as ty, x // 8 as tx, var_pop(v - m) as e from n where y // 10 < 3 and x // 8 < 3 group by 1, 2, 3)
 select grid_id, round(case when avg(e) > 1e-6 then stddev_pop(e) / avg(e) else 0 end, 6) as noise_cv from e group by 1""")
def tile_noise_cv(spark, sf_dir):
    return grids.tile_noise_cv(grid_cells(spark, sf_dir), tiles=3).withColumn("noise_cv", F.round("noise_cv", 6))


@query(f"""with {CELLS}, r as (select grid_id, y - 1 as i, avg(d) as d from (select *, abs(v - lag(v) over (partition by grid_id, x order by y)) as d from cells) where d is not null group by 1, 2),
  c as (select grid_id, x - 1 as i, avg(d) as d from (select *, abs(v - lag(v) over (partition by grid_id, y order by x)) as d from cells) where d is not null group by 1, 2),
  s as (select grid_id, avg(d) filter (i % 8 = 7) / avg(d) filter (i % 8 <> 7) - 1 as k from r group by 1 having avg(d) filter (i % 8 <> 7) > 1e-6 union all select grid_id, avg(d) filter (i % 8 = 7) / avg(d) filter (i % 8 <> 7) - 1 from c group by 1 having avg(d) filter (i % 8 <> 7) > 1e-6)
 select grid_id, round(max(k), 6) as grid_strength from s group by 1""")
def grid_step_contrast(spark, sf_dir):
    return grids.grid_step_contrast(grid_cells(spark, sf_dir)).withColumn("grid_strength", F.round("grid_strength", 6))


@query(f"""with {CELLS}, basis as (select u, w, by_, bx, (case when u = 0 then sqrt(0.125) else 0.5 end) * (case when w = 0 then sqrt(0.125) else 0.5 end) * cos((2 * by_ + 1) * u * pi() / 16) * cos((2 * bx + 1) * w * pi() / 16) as c
   from range(8) a(u) cross join range(8) b(w) cross join range(8) d(by_) cross join range(8) e(bx)),
  k as (select grid_id, y // 8 * 3 + x // 8 as block, u, w, sum((v - 128) * c) as k from cells join basis on by_ = y % 8 and bx = x % 8 where y < 24 group by 1, 2, 3, 4)
 select grid_id, round(kurtosis_pop(k) filter (u > 0 and w > 0) + 3, 5) as kurtosis, round(sum(abs(k)) filter (u >= 4 and w >= 4) / sum(abs(k)), 6) as high_share from k group by 1""")
def block_dct_stats(spark, sf_dir):
    return grids.block_dct_stats(grid_cells(spark, sf_dir)).select("grid_id", F.round("kurtosis", 5).alias("kurtosis"), F.round("high_share", 6).alias("high_share"))


PROFILE = f"""{CELLS}, at_ as (select grid_id, floor(sqrt((y - 15) ** 2 + (x - 12) ** 2) * 16 / 12)::int as bin, v from cells), m as (select grid_id, bin, avg(v) as m from at_ where bin < 16 group by 1, 2),
  f as (select g.grid_id, b::int as bin, coalesce(m, 0) as m from (select distinct grid_id from cells) g cross join range(16) t(b) left join m on m.grid_id = g.grid_id and m.bin = b),
  profile as (select grid_id, bin, case when max(m) over (partition by grid_id) > 0 then m / max(m) over (partition by grid_id) else m end as v from f)"""


@query(f"with {PROFILE} select grid_id, bin, round(v, 9) as v from profile")
def radial_profile(spark, sf_dir):
    return grids.radial_profile(grid_cells(spark, sf_dir), 16).withColumn("v", F.round("v", 9))


@query(f"""with {PROFILE}, d as (select grid_id, v - lag(v) over (partition by grid_id order by bin) as d from profile where bin >= 8) select grid_id, round(coalesce(avg(d) filter (d > 0) * 100, 0), 6) as irregularity from d group by 1""")
def tail_irregularity(spark, sf_dir):
    return grids.tail_irregularity(grids.radial_profile(grid_cells(spark, sf_dir), 16)).withColumn("irregularity", F.round("irregularity", 6))


@query(f"""with s as (select vec_id as id, unnest(embedding) as e, unnest({STANDARD_QUANT}) as t from embeddings), z as (select id, (100 * cast(1 + floor(abs(e::double) * 100) as double) - 50) / t as s from s), m as (select id, median(s) as s from z where s > 0 group by 1)
 select id, round(greatest(1, least(100, case when s > 100 then 5000 / s else (200 - s) / 2 end)))::int as quality from m""")
def quant_quality(spark, sf_dir):
    q = F.transform("embedding", lambda x: 1 + F.floor(F.abs(x.cast("double")) * 100).cast("double"))
    return grids.quant_quality(fx.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), q.alias("q")))


@query(f"with {LONG} select key, detector, round(1 / (1 + exp(-(ln(greatest(0.000001, least(0.999999, score)) / (1 - greatest(0.000001, least(0.999999, score)))) / 2.5::double))), 9) as scaled from long")
def temperature_scaled(spark, sf_dir):
    return long_signals(spark, sf_dir).select("key", "detector", F.round(sc.apply_temperature(F.col("score"), F.lit(2.5)), 9).alias("scaled"))


@query("select label, string_agg(label || '', '') is null as never_null, count(*) as n from (select case when frequency >= 0.88 then 'Very strong indication' when frequency >= 0.7 then 'Strong indication' when frequency >= 0.45 then 'Mixed signals' when frequency >= 0.2 then 'Weak indication' else 'Low indication' end as label from (with " + ITEMS + " select * from items)) group by 1")
def band_labels(spark, sf_dir):
    rows = sc.band_join(fx.items(spark, sf_dir).select("item_id", F.col("frequency").alias("score")), sc.band_table(spark))
    return rows.groupBy("label").agg((F.count("label") == 0).alias("never_null"), F.count("*").alias("n"))

