"""Joins, windows, folds, trees and reports bound to the supplied tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lamina.functions import geometry
from lamina.operators import fonts, intervals, ordered, report, tree
from lamina.session import table as T


def font_analysis(spark, d):
    """The installed fonts are those of a property, the size."""
    part = T(spark, d, "part")
    texts = part.select(F.col("p_partkey").alias("ord"), F.concat(F.element_at(F.split("p_name", " "), 1), F.lit(" "), F.col("p_brand")).alias("family"), F.col("p_type").alias("style"), F.lit(None).cast("string").alias("base_family"), F.lit(None).cast("string").alias("base_style"))
    s = part.filter("p_size <= 20")
    same = s.select(F.col("p_partkey").alias("ord"), F.concat(F.element_at(F.split("p_name", " "), 1), F.when(F.col("p_size") % 2 == 0, " ").otherwise("_"), F.col("p_brand")).alias("family"), F.when(F.col("p_size") % 5 == 0, "Regular").otherwise(F.col("p_type")).alias("style"))
    base = spark.createDataFrame([(-2, "Inter", "Regular"), (-1, "Arial", "Regular")], "ord long, family string, style string")
    return fonts.analyze(fonts.requested(texts), base.unionByName(same)).select("key", "decision", F.lower("chosen_family").alias("chosen_family"), F.lower("chosen_style").alias("chosen_style"))


FONT_ANALYSIS = r"""
with req as (select distinct lower(string_split(p_name, ' ')[1] || ' ' || p_brand || '::' || p_type) as key, lower(string_split(p_name, ' ')[1] || ' ' || p_brand) as family from part),
inst0 as (select p_partkey as ord, string_split(p_name, ' ')[1] || case when p_size % 2 = 0 then ' ' else '_' end || p_brand as family, case when p_size % 5 = 0 then 'Regular' else p_type end as style from part where p_size <= 20
 union all select -2, 'Inter', 'Regular' union all select -1, 'Arial', 'Regular'),
inst as (select lower(family || '::' || style) as key, lower(any_value(family)) as family, lower(any_value(style)) as style, min(ord) as ord from inst0 group by 1),
fam as (select regexp_replace(family, '[\s._-]+', '', 'g') as fk, family, style, row_number() over (partition by regexp_replace(family, '[\s._-]+', '', 'g') order by case when style = 'regular' then 0 else 1 end, ord) as r from inst)
select req.key, case when i.key is not null then 'exact' when f.fk is not null then 'equivalent' else 'fallback' end as decision,
case when i.key is not null then req.family when f.fk is not null then f.family else 'inter' end as chosen_family,
case when i.key is not null then i.style when f.fk is not null then f.style else 'regular' end as chosen_style
from req left join inst i on req.key = i.key left join fam f on f.r = 1 and f.fk = regexp_replace(req.family, '[\s._-]+', '', 'g')"""


def font_choice(spark, d):
    part = T(spark, d, "part")
    key = F.lower(F.concat(F.col("p_brand"), F.lit("::"), F.col("p_type")))
    wanted = part.select(key.alias("key"), F.col("p_brand").alias("family"), F.col("p_type").alias("style")).distinct()
    installed = part.filter(F.col("p_size") > 40).select(F.col("p_brand").alias("family"), F.col("p_type").alias("style")).distinct()
    repl = wanted.filter(F.col("style") == "PROMO").select("key", F.col("family").alias("to_family"), F.lit("SMALL").alias("to_style"))
    return fonts.choose(wanted, installed, repl, ("Inter", "Regular")).select("key", "chosen_family", "chosen_style", "missing", "label")


FONT_CHOICE = """
with w as (select distinct lower(p_brand || '::' || p_type) as key, p_brand as family, p_type as style from part), i as (select distinct p_brand as family, p_type as style from part where p_size > 40)
select w.key, coalesce(a.family, b.family, 'Inter') as chosen_family, coalesce(a.style, b.style, 'Regular') as chosen_style, a.family is null as missing, case when a.family is null then w.family || ' ' || w.style end as label
from w left join i a on a.family = w.family and a.style = w.style left join i b on w.style = 'PROMO' and b.family = w.family and b.style = 'SMALL'"""

_EV = ["user_id"]


def _brackets(spark, d):
    e = T(spark, d, "events")
    return intervals.match_brackets(e.select("user_id", "event_id", "event_type", "value"), _EV, "event_id", F.col("event_type") == "signup", F.col("event_type") == "purchase", ["event_id", "value"])


def bracket_match(spark, d):
    return _brackets(spark, d).select("user_id", F.col("event_id").alias("open_id"), F.col("end").alias("close_id"), F.col("level").cast("int").alias("level"), F.col("value").alias("open_value"))


_BR = """
s as (select user_id, event_id, event_type, value, case event_type when 'signup' then 1 when 'purchase' then -1 else 0 end as st from events),
c as (select *, sum(st) over (partition by user_id order by event_id) as sm from s),
l as (select *, cast(sm - least(0, min(sm) over (partition by user_id order by event_id)) as integer) as la from c),
b as (select *, coalesce(lag(la) over (partition by user_id order by event_id), 0) as lb from l),
o as (select *, case when st = 1 then la else lb end as lv from b where st = 1 or (st = -1 and lb > 0)),
p as (select *, lag(event_id) over (partition by user_id, lv order by event_id) as open_id, lag(value) over (partition by user_id, lv order by event_id) as open_value from o),
br as (select user_id, open_id, event_id as close_id, lv as level, open_value from p where st = -1)"""
BRACKET_MATCH = f"with {_BR} select user_id, open_id, close_id, level, open_value from br"


def placeholder_drop(spark, d):
    rows = _brackets(spark, d).select("user_id", (F.col("start") % 10).alias("start"), (F.col("end") % 10).alias("end"), F.col("event_id").alias("id"), F.concat(F.lit(" Layer "), (F.col("event_id") % 7).cast("string")).alias("name"), (F.col("event_id") % 3 != 0).alias("visible"))
    return intervals.drop_placeholders(rows, _EV).select("user_id", "id", "name", "visible")


PLACEHOLDER_DROP = f"""
with {_BR}, r as (select user_id, open_id as id, ' Layer ' || (open_id % 7) as name, open_id % 3 <> 0 as visible, (open_id + 1) % 10 = close_id % 10 as empty from br)
select user_id, id, name, visible from r where not (visible and empty and exists (select 1 from r h where h.user_id = r.user_id and h.name = r.name and not h.visible))"""


def innermost_range(spark, d):
    points = T(spark, d, "events").filter("event_type = 'view'").select("user_id", F.col("event_id").alias("at"))
    ranges = _brackets(spark, d).select("user_id", "start", "end")
    return intervals.innermost(points, ranges, _EV, "at").select("user_id", "at", "start", "end")


INNERMOST_RANGE = f"""
with {_BR}, v as (select user_id, event_id as pos from events where event_type = 'view'),
j as (select v.user_id, v.pos, open_id + 1 as start, close_id as "end", row_number() over (partition by v.user_id, v.pos order by open_id desc nulls last, close_id) as r from v left join br on br.user_id = v.user_id and open_id + 1 <= pos and close_id >= pos)
select user_id, pos as "at", start, "end" from j where r = 1"""


def range_overlap(spark, d):
    r = _brackets(spark, d).select("user_id", "start", "end", "level")
    return intervals.overlapping(r.filter("level > 1"), r.filter("level = 1 and start % 2 = 0"), _EV, "left_anti").select("user_id", "start", "end", F.col("level").cast("int").alias("level"))


RANGE_OVERLAP = f"""
with {_BR}, r as (select user_id, open_id + 1 as start, close_id as "end", level from br)
select a.user_id, a.start, a."end", a.level from r a where a.level > 1 and not exists (select 1 from r b where b.level = 1 and b.start % 2 = 0 and b.user_id = a.user_id and a.start <= b."end" and a."end" >= b.start)"""


def state_carry(spark, d):
    e = T(spark, d, "events").select("user_id", "event_id", F.when(F.col("event_type") == "view", F.col("value")).alias("v"))
    out = ordered.carry(e, _EV, ["event_id"], F.col("v"), "state")
    return ordered.carry(out, _EV, ["event_id"], F.col("v"), "before", inclusive=False).select("user_id", "event_id", "state", "before")


STATE_CARRY = """
select user_id, event_id, last_value(v ignore nulls) over (partition by user_id order by event_id rows between unbounded preceding and current row) as state,
last_value(v ignore nulls) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding) as before
from (select user_id, event_id, case when event_type = 'view' then value end as v from events)"""


def islands(spark, d):
    e = T(spark, d, "events").select("user_id", "event_id", "value")
    near = F.abs(F.col("value") - ordered.previous("value", _EV, ["event_id"])) <= 50
    rows = ordered.islands(e, _EV, ["event_id"], near)
    return rows.groupBy("user_id", "island").agg(F.min("event_id").alias("first_event"), F.count("*").alias("events"), F.min("value").alias("low"), F.max("value").alias("high"))


ISLANDS = """
with l as (select user_id, event_id, value, case when abs(value - lag(value) over (partition by user_id order by event_id)) <= 50 then 0 else 1 end as f from events),
i as (select *, sum(f) over (partition by user_id order by event_id) as island from l)
select user_id, cast(island as bigint) as island, min(event_id) as first_event, count(*) as events, min(value) as low, max(value) as high from i group by user_id, island"""


def baseline_bins(spark, d):
    e = T(spark, d, "events").select("user_id", "event_id", "value")
    rows = e.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "value"))).alias("items"))
    rows = rows.withColumn("bins", ordered.greedy_bins(F.transform("items", lambda i: i["value"])))
    return rows.select("user_id", F.explode(F.arrays_zip("items", "bins")).alias("z")).select("user_id", F.col("z.items.event_id").alias("event_id"), F.col("z.bins").alias("bin"))


BASELINE_BINS = """
with g as (select user_id, list(value order by event_id) as v, list(event_id order by event_id) as ids from events group by user_id),
f as (select user_id, ids, list_reduce(list_transform(v, lambda x: {'f': [x], 'b': [0]}), lambda acc, y: {
 'f': case when len(list_filter(acc.f, lambda z: abs(z - y.f[1]) <= 2)) > 0 then acc.f else list_append(acc.f, y.f[1]) end,
 'b': list_append(acc.b, case when len(list_filter(acc.f, lambda z: abs(z - y.f[1]) <= 2)) > 0 then cast(list_position(list_transform(acc.f, lambda z: abs(z - y.f[1]) <= 2), true) - 1 as integer) else cast(len(acc.f) as integer) end)}) as r from g)
select user_id, unnest(ids) as event_id, unnest(r.b) as bin from f"""


def layout_cursor(spark, d):
    o = T(spark, d, "orders").select("o_custkey", "o_orderkey", F.floor(F.col("o_totalprice") / 100).cast("double").alias("w"))
    return ordered.layout_cursor(o, ["o_custkey"], ["o_orderkey"], F.col("w")).select("o_custkey", "o_orderkey", "x")


LAYOUT_CURSOR = """
select o_custkey, o_orderkey, coalesce(sum(floor(o_totalprice / 100) + 120) over (partition by o_custkey order by o_orderkey rows between unbounded preceding and 1 preceding), 0.0)::double as x from orders"""


def alignment(spark, d):
    e = T(spark, d, "events").select(F.col("user_id"), F.floor("value").cast("double").alias("left"), F.floor(F.col("value") + F.col("event_id") % 11).cast("double").alias("right"), F.lit(40.0).alias("height"))
    return ordered.alignment(e, _EV)


ALIGNMENT = """
with l as (select user_id, floor(value) as l, floor(value + event_id % 11) as r from events),
g as (select user_id, count(*) as lines, max(l) - min(l) as sl, max((l + r) / 2) - min((l + r) / 2) as sc, max(r) - min(r) as sr from l group by user_id)
select user_id, lines, case when lines < 2 or least(sl, sc, sr) > greatest(6.0, 40 * 0.35) then 'left' when sl <= sc and sl <= sr then 'left' when sc <= sr then 'center' else 'right' end as alignment from g"""


def clamped_fold(spark, d):
    e = T(spark, d, "events").select("user_id", "event_id", (F.col("value") / 100 - 0.4).alias("v"))
    return ordered.clamped_fold(e, _EV, "event_id", F.col("v")).select("user_id", F.round("total", 9).alias("total"))


CLAMPED_FOLD = """
select user_id, round(list_reduce(list_prepend(0.0::double, list(value / 100 - 0.4::double order by event_id)), lambda a, v: greatest(-1.0::double, least(1.0::double, a + v))), 9) as total from events group by user_id"""


def flowing_filters(spark, d):
    kind = F.when(F.col("event_type") == "signup", "persistent").when(F.col("event_type") == "error", "clipped").otherwise("layer")
    e = T(spark, d, "events").select("user_id", "event_id", kind.alias("kind"), F.floor(F.col("value") % 3 - 1).cast("double").alias("value"))
    return ordered.flowing_filters(e.withColumn("value", F.col("value") / 4), _EV, "event_id").select("user_id", "event_id", "filter")


FLOWING_FILTERS = """
with e as (select user_id, event_id, case event_type when 'signup' then 'p' when 'error' then 'c' else 'l' end as k, floor(value % 3 - 1) / 4 as v from events),
b as (select *, coalesce(sum(case when k = 'l' then 1 else 0 end) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding), 0) as blk from e),
w as (select *, coalesce(list({'e': event_id, 'v': v}) filter (where k = 'p') over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding), []) as ps,
 coalesce(list({'e': event_id, 'v': v}) filter (where k = 'c') over (partition by user_id, blk order by event_id rows between unbounded preceding and 1 preceding), []) as cs from b),
f as (select *, list_reduce(list_prepend(0.0::double, list_transform(list_sort(ps), lambda x: x.v)), lambda a, v: greatest(-1.0::double, least(1.0::double, a + v))) as fp,
 list_reduce(list_prepend(0.0::double, list_transform(list_sort(cs), lambda x: x.v)), lambda a, v: greatest(-1.0::double, least(1.0::double, a + v))) as fc from w where k = 'l')
select user_id, event_id, greatest(-1.0::double, least(1.0::double, fp + fc)) as filter from f"""


def tree_rollup(spark, d):
    cat = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    node = lambda df, id_, parent: df.select(F.lit("tree").alias("doc_id"), id_.alias("node_id"), parent.alias("parent_id"))
    r = node(T(spark, d, "region"), cat("r", F.col("r_regionkey")), F.lit(None).cast("string"))
    n = node(T(spark, d, "nation"), cat("n", F.col("n_nationkey")), cat("r", F.col("n_regionkey")))
    c = node(T(spark, d, "customer"), cat("c", F.col("c_custkey")), cat("n", F.col("c_nationkey")))
    o = node(T(spark, d, "orders"), cat("o", F.col("o_orderkey")), cat("c", F.col("o_custkey")))
    return tree.subtree_sizes(r.unionByName(n).unionByName(c).unionByName(o)).select("node_id", "nodes")


TREE_ROLLUP = """
with oc as (select o_custkey as c, count(*) as n from orders group by 1), cu as (select c_custkey, c_nationkey, 1 + coalesce(n, 0) as n from customer left join oc on c = c_custkey),
na as (select n_nationkey, n_regionkey, 1 + coalesce(sum(n), 0) as n from nation left join cu on c_nationkey = n_nationkey group by 1, 2),
re as (select r_regionkey, 1 + coalesce(sum(n), 0) as n from region left join na on n_regionkey = r_regionkey group by 1)
select 'o' || o_orderkey as node_id, cast(1 as bigint) as nodes from orders union all select 'c' || c_custkey, cast(n as bigint) from cu union all select 'n' || n_nationkey, cast(n as bigint) from na union all select 'r' || r_regionkey, cast(n as bigint) from re"""


def inherited_value(spark, d):
    """J18: the nearest of region, nation and customer that sets a value."""
    cat = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    node = lambda df, id_, parent: df.select(F.lit("tree").alias("doc_id"), id_.alias("node_id"), parent.alias("parent_id"))
    val = lambda df, id_, v, rank, when: df.filter(when).select(F.lit("tree").alias("doc_id"), id_.alias("node_id"), F.lit("fill").alias("name"), v.alias("value"), F.lit(rank).alias("rank"), F.lit(0).alias("class_pos"))
    r, n, c = T(spark, d, "region"), T(spark, d, "nation"), T(spark, d, "customer")
    nodes = node(r, cat("r", F.col("r_regionkey")), F.lit(None).cast("string")).unionByName(node(n, cat("n", F.col("n_nationkey")), cat("r", F.col("n_regionkey")))).unionByName(node(c, cat("c", F.col("c_custkey")), cat("n", F.col("c_nationkey"))))
    values = val(r, cat("r", F.col("r_regionkey")), F.col("r_name"), 2, F.lit(True)).unionByName(val(n, cat("n", F.col("n_nationkey")), F.col("n_name"), 0, F.col("n_nationkey") % 2 == 0)).unionByName(val(n, cat("n", F.col("n_nationkey")), F.lit("attribute"), 2, F.lit(True).eqNullSafe(F.col("n_nationkey") % 3 == 0))).unionByName(val(c, cat("c", F.col("c_custkey")), F.col("c_mktsegment"), 1, F.col("c_custkey") % 4 == 0))
    return tree.inherited(nodes, values).select("node_id", "value")


INHERITED_VALUE = """
with nv as (select n_nationkey, n_regionkey, case when n_nationkey % 2 = 0 then n_name when n_nationkey % 3 = 0 then 'attribute' end as v from nation)
select 'r' || r_regionkey as node_id, r_name as value from region union all select 'n' || n_nationkey, coalesce(v, r_name) from nv join region on r_regionkey = n_regionkey
union all select 'c' || c_custkey, coalesce(case when c_custkey % 4 = 0 then c_mktsegment end, v, r_name) from customer join nv on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey"""


def group_bounds(spark, d):
    k = T(spark, d, "lineitem").select("l_orderkey", F.col("l_quantity").alias("left"), F.col("l_partkey").cast("double").alias("top"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_quantity") + 10).alias("right"), (F.col("l_partkey") + F.col("l_suppkey")).cast("double").alias("bottom"), (F.col("l_returnflag") == "R").alias("hidden"))
    return tree.group_bounds(k, ["l_orderkey"])


GROUP_BOUNDS = """
with k as (select l_orderkey, l_quantity as l, l_partkey::double as t, l_quantity + greatest(1.0::double, coalesce(case when l_linenumber % 2 = 0 then l_quantity + 10 end, l_quantity + 1) - l_quantity) as r,
 l_partkey + greatest(1.0::double, (l_partkey + l_suppkey)::double - l_partkey) as b, l_returnflag <> 'R' as s from lineitem),
g as (select l_orderkey, min(l) filter (where s) as l, min(t) filter (where s) as t, max(r) filter (where s) as r, max(b) filter (where s) as b from k group by 1)
select l_orderkey, coalesce(l, 0.0::double) as left, coalesce(t, 0.0::double) as top, case when l is null then 1.0::double else greatest(1.0::double, r - l) end as width, case when l is null then 1.0::double else greatest(1.0::double, b - t) end as height from g"""


def doc_merge(spark, d):
    doc = T(spark, d, "documents").select("source", "doc_id", F.col("lang").alias("format"), F.concat(F.lit("0."), (F.col("doc_id") % 3).cast("string")).alias("version"), F.octet_length("text").cast("long").alias("byte_size"), F.col("n_chars").alias("parsed"), (F.col("doc_id") % 5).alias("editable"), (F.col("doc_id") % 7).alias("rasterized"), F.lit(1).cast("long").alias("skipped"), F.array(F.concat(F.lit("Font "), F.col("lang"))).alias("missing_fonts"))
    out = report.merge_documents(doc, ["source"], "doc_id")
    return out.withColumn("missing_fonts", F.array_join("missing_fonts", ","))


DOC_MERGE = """
select source, arg_min(lang, doc_id) as format, '0.' || (min(doc_id) % 3) as version, count(*) as documents, cast(sum(strlen(text)) as bigint) as byte_size, cast(sum(n_chars) as bigint) as parsed, cast(sum(doc_id % 5) as bigint) as editable,
cast(sum(doc_id % 7) as bigint) as rasterized, count(*) as skipped, array_to_string(list_sort(list_distinct(list('Font ' || lang))), ',') as missing_fonts from documents group by source"""


def report_rollup(spark, d):
    level = F.when(F.col("event_type") == "error", "warning").when(F.col("event_type") == "purchase", "fallback").otherwise("info")
    return report.rollup(T(spark, d, "events").withColumn("level", level), _EV)


REPORT_ROLLUP = """
select user_id, count(*) as items, count(*) filter (where event_type in ('signup','view','click')) as infos, count(*) filter (where event_type = 'error') as warnings,
count(*) filter (where event_type = 'purchase') as fallbacks, count(*) filter (where event_type in ('error','purchase')) as attention from events group by user_id"""


def table_grid(spark, d):
    """P29, G11: turns and their words laid on an equal grid."""
    c = T(spark, d, "conversations").select("conv_id", (F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1).alias("row"), F.split("text", " ").alias("cells"))
    shape = c.groupBy("conv_id").agg(F.count("*").alias("rows"), F.max(F.size("cells")).alias("cols"))
    x = c.select("conv_id", "row", F.posexplode("cells").alias("col", "word")).join(shape, "conv_id")
    x = x.withColumn("at", geometry.grid_cell(F.col("row"), F.col("col"), F.col("rows"), F.col("cols"), F.lit(960.0), F.lit(540.0)))
    return x.select("conv_id", "row", "col", "at.x", "at.y", (F.trim("word") != "").alias("has_text"))


TABLE_GRID = """
with c as (select conv_id, turn, string_split(text, ' ') as cells, row_number() over (partition by conv_id order by turn) - 1 as row from conversations),
s as (select conv_id, count(*) as rows, greatest(1, max(len(cells))) as cols from c group by 1),
k as (select conv_id, row, unnest(cells) as word, unnest(range(0, len(cells))) as col from c)
select k.conv_id, cast(row as integer) as row, cast(col as integer) as col, col * (960.0::double / cols) as x, row * (540.0::double / rows) as y, trim(word) <> '' as has_text from k join s using (conv_id)"""


def zorder_recover(spark, d):
    tag = F.when(F.col("role") == "user", "sp").when(F.col("role") == "system", "pic").otherwise("grpSp")
    n = T(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.when(F.col("conv_id") % 2 == 0, F.col("conv_id").cast("string")).alias("parent_id"), F.col("turn").alias("ord"), tag.alias("tag"))
    return tree.in_z_order(n).select(F.col("doc_id").alias("conv_id"), F.col("ord").alias("turn"), "z")


ZORDER_RECOVER = """
select conv_id, turn, cast(row_number() over (partition by conv_id order by case when conv_id % 2 = 0 then case role when 'user' then 1 when 'system' then 2 else 4 end else 0 end, turn) - 1 as integer) as z from conversations"""


def text_runs(spark, d):
    c = T(spark, d, "conversations").select("conv_id", "turn", F.col("text").alias("t"))
    new = F.col("turn") % 2 == 0
    first = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) == 1
    c = c.withColumn("nl", new & ~first)
    runs = ordered.text_runs(c, ["conv_id"], ["turn"], "t", F.col("nl"))
    return runs.select("conv_id", "turn", "run_start", "run_end")


#: UTF-16 units: a character beyond the first plane has two.
TEXT_RUNS = r"""
with c as (select conv_id, turn, length(text) + len(regexp_extract_all(text, '[\x{10000}-\x{10FFFF}]')) as n, case when turn % 2 = 0 and row_number() over (partition by conv_id order by turn) > 1 then 1 else 0 end as nl from conversations)
select conv_id, turn, cast(sum(n + nl) over (partition by conv_id order by turn) - n as bigint) as run_start, cast(sum(n + nl) over (partition by conv_id order by turn) + coalesce(lead(nl) over (partition by conv_id order by turn), 0) as bigint) as run_end from c"""


def joined_text(spark, d):
    c = T(spark, d, "conversations").select("conv_id", "turn", "role")
    return ordered.joined_text(c, ["conv_id"], "turn", "role", F.col("turn") > 0)


JOINED_TEXT = "select conv_id, string_agg(case when turn > 0 then chr(10) else '' end || role, '' order by turn) as characters from conversations group by conv_id"


def line_heights(spark, d):
    e = T(spark, d, "events").select("user_id", "event_id", "value")
    return ordered.neighbour_distance(e, _EV, ["event_id"], "value").select("user_id", "event_id", F.round("line_height", 6).alias("line_height"))


LINE_HEIGHTS = "select user_id, event_id, round(abs(value - coalesce(lead(value) over w, lag(value) over w)), 6) as line_height from events window w as (partition by user_id order by event_id)"


def positional_zip(spark, d):
    styles = T(spark, d, "benchmark").select((F.col("item_id") % 3).alias("conv_key"), (F.col("item_id") / 3).cast("long").alias("k"), "item_id")
    items = T(spark, d, "conversations").select("conv_id", (F.col("conv_id") % 3).alias("conv_key"), (F.col("conv_id") * 1000 + F.col("turn")).alias("o"), "turn")
    return intervals.positional(items, styles, ["conv_key"], "o").select("conv_id", "turn", "item_id")


POSITIONAL_ZIP = """
with s as (select item_id % 3 as ck, item_id // 3 as k, item_id from benchmark), n as (select ck, max(k) + 1 as n from s group by 1),
i as (select conv_id, turn, conv_id % 3 as ck, row_number() over (partition by conv_id % 3 order by conv_id * 1000 + turn) - 1 as r from conversations)
select conv_id, turn, item_id from i left join n using (ck) left join s on s.ck = i.ck and s.k = least(r, n - 1)"""


def replacement_merge(spark, d):
    o = T(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderpriority", F.col("o_orderdate"))
    return ordered.merge_later_wins(o, ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey", "o_orderpriority")


REPLACEMENT_MERGE = "select o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) as o_orderkey, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) as o_orderpriority from orders group by o_custkey"


def rollback_diff(spark, d):
    return report.added(T(spark, d, "documents").select("doc_id", "source"), T(spark, d, "labels"), "doc_id")


ROLLBACK_DIFF = "select doc_id, source from documents where doc_id not in (select doc_id from labels)"


def stale_filter(spark, d):
    return ordered.latest(T(spark, d, "events").select("user_id", "event_id", "event_type"), _EV, "event_id")


STALE_FILTER = "select user_id, event_id, event_type from events e where event_id = (select max(event_id) from events x where x.user_id = e.user_id)"


def page_placement(spark, d):
    from lamina.sources.sink import placed_pages

    p = T(spark, d, "part").select(F.col("p_brand").alias("doc_id"), F.col("p_partkey").alias("ord"), (F.col("p_size") * 10.0).alias("width"))
    return placed_pages(p).select("doc_id", "ord", "x", "page_no")


PAGE_PLACEMENT = """
select p_brand as doc_id, p_partkey as ord, coalesce(sum(p_size * 10.0 + 120) over (partition by p_brand order by p_partkey rows between unbounded preceding and 1 preceding), 0)::double as x, cast(row_number() over (partition by p_brand order by p_partkey) as integer) as page_no from part"""

QUERIES = {
    k: (globals()[k], globals()[k.upper()])
    for k in (
        "font_analysis", "font_choice", "bracket_match", "placeholder_drop", "innermost_range", "range_overlap", "state_carry", "islands", "baseline_bins", "layout_cursor", "alignment", "clamped_fold", "flowing_filters", "tree_rollup",
        "inherited_value", "group_bounds", "doc_merge", "report_rollup", "table_grid", "zorder_recover", "text_runs", "joined_text", "line_heights", "positional_zip", "replacement_merge", "rollback_diff", "stale_filter", "page_placement",
    )
}
