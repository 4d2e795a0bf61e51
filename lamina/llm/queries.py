"""The registered queries of this package and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm import ball_tree, byte_bpe, crf_quality, graph_ann, minhash_dedup, mixing, sharding, suffix_dedup, token_blocks, warc
from lamina.session import table


def op1_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_blocks.read_token_files(spark, token_blocks.write_token_files(table(spark, sf_dir, "documents")))


def op2_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crf_quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_pruned_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def op4_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), 16)


def op5_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.mix(table(spark, sf_dir, "documents"))
    first = F.get("positions", F.lit(0))
    return rows.orderBy(first.asc_nulls_last(), "doc_id").select("doc_id", "size", "source_size", "target", "taken", "source", "copies", first.alias("first_position"), F.get("positions", F.lit(1)).alias("second_position"))


def op6_ball_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_tree.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup_digests(table(spark, sf_dir, "documents"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip_digests(table(spark, sf_dir, "documents"))


def op9_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), words=2)


def op10_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    records, _ = warc.round_trip(table(spark, sf_dir, "pages"))  # the gap log is beside the records
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def queries() -> dict:
    return {f.__name__: f for f in (op1_token_blocks, op2_crf_quality, op3_pruned_graph, op4_jump_sharding, op5_curriculum_mix, op6_ball_tree, op7_suffix_dedup, op8_byte_bpe, op9_circulant_minhash, op10_warc_salvage)}


_NIBBLES = [0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948, 3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108]


def _hash(salt: str, *keys: str) -> str:
    return f"('0x' || substr(md5('{salt}'" + "".join(f" || '/' || coalesce(cast({k} as varchar), 'null')" for k in keys) + "), 1, 15))::bigint"


#: The crc32 goes through the hexadecimal digits of a text, low ones first.
OP4 = f"""
with recursive h as (select doc_id, octet_length(encode(coalesce(text, ''))) + 1 as size, string_split(hex(encode(coalesce(text, ''))), '') as x from documents),
d as (select doc_id, size, list_prepend(4294967295::bigint, list_transform(x, lambda c, i: (strpos('0123456789ABCDEF', x[i + 2 * (i % 2) - 1]) - 1)::bigint)) as v from h),
r as (select doc_id, size, xor(list_reduce(v, lambda a, n: xor(a >> 4, list_extract({_NIBBLES}::bigint[], (xor(a, n) & 15) + 1))), 4294967295::bigint) as text_crc32 from d),
j(doc_id, n, key, pos) as (select distinct doc_id, n, {_hash("jump", "doc_id")}::hugeint, 0::bigint from documents, (values (16), (17)) as t(n)
 union all select doc_id, n, key, pos from (select doc_id, n, k as key, floor((pos + 1) * (2147483648::double / ((k // 8589934592) + 1)::double))::bigint as pos from (select doc_id, n, pos, (key * 2862933555777941757 + 1) % 18446744073709551616 as k from j)) where pos < n),
s as (select doc_id, cast(max(pos) filter (where n = 16) as integer) as shard, cast(max(pos) filter (where n = 17) as integer) as grown_shard from j group by doc_id),
b as (select greatest(8, ceil(count(*) / 400000))::bigint as blocks from (select distinct doc_id, size, text_crc32 from r)),
o as (select r.*, shard, grown_shard, {_hash("slot", "r.doc_id", "size", "text_crc32")} % blocks as block from r join s on r.doc_id is not distinct from s.doc_id, b)
select doc_id, size, text_crc32, 'key' as law, shard, cast(row_number() over (partition by shard order by block, doc_id nulls first, size, text_crc32) - 1 as bigint) as slot, grown_shard from o"""


def _segments_sql(knots) -> str:
    pieces = [(t0, t1 - t0, w0, w1, (t1 - t0) * (w0 + w1) / 2) for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False)]
    total, done, out = sum(p[4] for p in pieces), 0.0, []
    for t0, h, w0, w1, area in pieces:
        out.append("{" + ", ".join(f"'{k}': {v!r}::double" for k, v in (("t0", t0), ("h", h), ("w0", w0 / total), ("w1", w1 / total), ("c0", done / total))) + "}")
        done += area
    return f"[{', '.join(out)}]"


def _position(k: int) -> str:
    """When copy k stands in training: the integral of the weight, inverted."""
    share = f"least(1.0::double, (mid + {k} * source_size) / target)"
    seg = f"list_filter(seg, lambda s: s.c0 <= {share} or s.c0 <= 0)[-1]"
    d = f"greatest({share} - g.c0, 0.0::double)"
    return f"case when copies > {k} then (select g.t0 + case when {d} = 0 then 0.0::double else 2.0::double * {d} / (g.w0 + sqrt(greatest(g.w0 * g.w0 + 2.0::double * (g.w1 - g.w0) / g.h * {d}, 0.0::double))) end from (select {seg} as g)) end"


OP5 = rf"""
with n as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size from documents),
u as (select greatest(32, ceil(count(*) / 20000))::bigint as blocks from (select distinct doc_id, source, size from n)),
h as (select n.*, {_hash("mix", "doc_id", "size")} as h, blocks from n, u),
o as (select *, sum(size) over (partition by source order by h % blocks, h, doc_id nulls first, size rows between unbounded preceding and current row) - size as start from h),
s0 as (select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) - 1 as idx from n group by source),
s1 as (select *, [5.0::double, 2.0::double, 1.0::double][idx % 3 + 1] as w, 2.0::double * source_size as cap from s0),
s2 as (select *, cap / w as ratio, 1.5::double * sum(source_size) over () as budget, sum(w) over () as all_w from s1),
s3 as (select *, (budget - coalesce(sum(cap) over f, 0.0::double)) / (all_w - coalesce(sum(w) over f, 0.0::double)) as level from s2 window f as (order by ratio, idx rows between unbounded preceding and 1 preceding)),
s4 as (select *, max(case when level <= ratio then level end) over () as reached from s3),
g as (select source, source_size, idx, least(cap, coalesce(reached * w, cap)) as target from s4),
m as (select doc_id, o.source, size, source_size, target, start + size / 2 as mid, [{', '.join(_segments_sql(k) for k in mixing.SCHEDULES)}][idx % {len(mixing.SCHEDULES)} + 1] as seg from o join g on o.source is not distinct from g.source),
c as (select *, case when size > 0 and source_size > 0 then cast(greatest(0, ceil((target - mid) / source_size)) as integer) else 0 end as copies from m)
select doc_id, size, source_size, target, copies * size as taken, source, copies, {_position(0)} as first_position, {_position(1)} as second_position from c"""

#: A vector takes part if it has components, all of them finite.
FINITE = "vec_id is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0"

OP6 = f"""
with e as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings where {FINITE}),
q as (select vec_id, min(v) as v from e where vec_id % 50 = 0 group by vec_id),
s as (select q.vec_id as query_id, e.vec_id, cast(list_inner_product(q.v, e.v) as bigint) as score from q join e on e.vec_id <> q.vec_id and len(e.v) = len(q.v)),
r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from s)
select query_id, rank, vec_id, score from r where rank <= 5"""

#: Windows and kept bytes as hexadecimal digits.
OP7 = """
with h as (select doc_id, hex(encode(coalesce(text, ''))) as x from documents),
w as (select doc_id, p, substr(x, 2 * p + 1, 200) as s from (select doc_id, x, unnest(range(0, greatest(0, len(x) // 2 - 99))) as p from h)),
f as (select s, min({'d': doc_id, 'p': p}) as first from w group by s having count(*) > 1),
e as (select doc_id, p from w join f using (s) where doc_id > first.d or (doc_id = first.d and p > first.p)),
i as (select doc_id, p, sum(new) over (partition by doc_id order by p) as run from (select doc_id, p, case when p - lag(p) over (partition by doc_id order by p) <= 100 then 0 else 1 end as new from e)),
r as (select doc_id, min(p) as a, max(p) + 100 as b from i group by doc_id, run),
k as (select h.doc_id, r.a, substr(x, 2 * coalesce(lag(b) over (partition by h.doc_id order by r.a), 0) + 1, 2 * (r.a - coalesce(lag(b) over (partition by h.doc_id order by r.a), 0))) as piece from h join r on h.doc_id = r.doc_id),
t as (select doc_id, sum(b - a) as n_removed, count(*) as n_spans, max(b) as last from r group by doc_id),
j as (select doc_id, string_agg(piece, '' order by a) as head from k group by doc_id)
select h.doc_id, (len(x) // 2)::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans, sha256(unhex(coalesce(head, '') || substr(x, 2 * coalesce(last, 0) + 1))) as kept_sha256
from h left join t on h.doc_id = t.doc_id left join j on h.doc_id = j.doc_id"""

OP9 = r"""
with recursive t as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
g as (select doc_id, case when len(w) >= 2 then list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) else w end as s from t),
x as (select doc_id, unnest(s) as k from g),
p as (select a.doc_id as a, b.doc_id as b, count(*) as n from x a join x b on a.k = b.k and a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from p join g i on i.doc_id = a join g j on j.doc_id = b where 100 * n >= 80 * (len(i.s) + len(j.s) - n)),
both_ways as (select a, b from l union all select b, a from l),
c(doc_id, other) as (select doc_id, doc_id from documents union select c.doc_id, b from c join both_ways on other = a),
m as (select doc_id, min(other) as component_id from c group by doc_id)
select g.doc_id, len(s)::bigint as n_shingles, component_id, g.doc_id = component_id as kept from g join m on g.doc_id = m.doc_id"""

OP10 = """
with p as (select page_id, octet_length(encode(coalesce(html, ''))) as n, sha256(coalesce(html, '')) as digest from pages),
f as (select digest, min(page_id) as first from p where n >= 100 group by digest)
select page_id, n as payload_bytes, p.digest as payload_digest, case when n >= 100 and page_id > first then 'revisit' else 'response' end as record_type, case when n >= 100 and page_id > first then first end as refers_to
from p left join f on p.digest = f.digest"""


def oracle_sql() -> dict[str, str]:
    """For the queries that SQL can express; tests/llm compares the others with brute force."""
    return {"op4_jump_sharding": OP4, "op5_curriculum_mix": OP5, "op6_ball_tree": OP6, "op7_suffix_dedup": OP7, "op9_circulant_minhash": OP9, "op10_warc_salvage": OP10}
