"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.llm._spark import delete, shared_folder, table
from terrane.llm.compression_bands import compression_bands
from terrane.llm.hadamard_clusters import centroid_clusters
from terrane.llm.language_model import score_texts
from terrane.llm.longest_match import token_counts
from terrane.llm.main_text import main_text
from terrane.llm.merkle_manifest import manifest, tampered_text
from terrane.llm.piece_matching import round_trip
from terrane.llm.pruned_graph import nearest
from terrane.llm.recompression import repeated_words
from terrane.llm.simhash_pivots import simhash_components
from terrane.llm.suffix_dedup import repeated_bytes
from terrane.llm.warc import digest_of_archives, read_warc, write_warc
from terrane.llm.winnowing import contamination


def op1_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression_bands(table(spark, sf_dir, "documents"))


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_bytes(table(spark, sf_dir, "documents"))


def op4_elias_fano(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))


def op5_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))


def op6_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items")


def op7_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_words(table(spark, sf_dir, "documents")).drop("kept_text")


def op8_longest_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


def op9_piece_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write_warc(table(spark, sf_dir, "pages"), path)
    records = read_warc(spark, path, payload=False)
    delete(spark, path)  # what it read is kept
    return digest_of_archives(records)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = manifest(table(spark, sf_dir, "documents"), now=tampered_text(F.col("doc_id"), F.col("text")))
    return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op12_pruned_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op13_hadamard_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clusters(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_compression_bands, op2_main_text, op3_suffix_dedup, op4_elias_fano, op5_simhash_pivots, op6_winnowing, op7_recompression, op8_longest_match, op9_piece_matching, op10_warc, op11_merkle_manifest, op12_pruned_graph, op13_hadamard_clusters)
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_LETTERS = f"list_filter(regexp_split_to_array(regexp_replace({_LOWER}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', 'g'), ' '), lambda x: x <> '')"

_WINDOWS = f"""
with d as (select row_number() over () as k, doc_id, {_LETTERS} as w from documents),
b as (select distinct cast(item_id as varchar) as item, {_LETTERS} as w from benchmark where text is not null and item_id is not null),
dl as (select k, i, list(x) over (partition by k order by i rows between current row and 9 following) as l from (select k, unnest(w) as x, unnest(range(1, len(w) + 1)) as i from d)),
bl as (select item, n, list(x) over (partition by item, w order by i rows between current row and 9 following) as l from (select item, w, least(len(w), 10) as n, unnest(w) as x, unnest(range(1, len(w) + 1)) as i from b)),
bw as (select distinct item, n, array_to_string(l, ' ') as win from bl where len(l) = n),
hit as (select k, i, bw.n, item from dl join (select distinct n as m from bw) s on len(l) >= m join bw on n = m and array_to_string(l[1:m], ' ') = win),
word as (select k, count(distinct j) as n_hit from (select k, unnest(range(i, i + n)) as j from hit) group by k),
item as (select k, count(distinct item) as n_items, string_agg(distinct item, ',' order by item) as items from hit group by k)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join word using (k) left join item using (k)
"""

_WARC = """
with p as (select page_id, coalesce(html, '') as h from pages),
q as (select page_id, cast(octet_length(encode(h)) as bigint) as payload_bytes, sha256(h) as payload_digest, min(page_id) over (partition by h) as f from p)
select page_id, payload_bytes, payload_digest, case when payload_bytes >= 100 and page_id <> f then 'revisit' else 'response' end as record_type, case when payload_bytes >= 100 and page_id <> f then f end as refers_to from q
"""

_REPEATED_WORDS = """
with d as (select row_number() over () as k, doc_id, list_filter(regexp_split_to_array(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g'), ' '), lambda x: x <> '') as w from documents),
x as (select k, doc_id, unnest(w) as x, unnest(range(1, len(w) + 1)) as i from d),
win as (select k, doc_id, i, sha256(string_agg(x, ' ') over v) as h, count(*) over v as n from x window v as (partition by k order by i rows between current row and 49 following)),
firsts as (select h, min(doc_id) as least from win where n = 50 group by h),
hit as (select distinct k, unnest(range(i, i + 50)) as i from win join firsts using (h) where n = 50 and doc_id > least),
kept as (select x.k, count(hit.i) as n_removed, string_agg(x.x, ' ' order by x.i) filter (hit.i is null) as t from x left join hit on x.k = hit.k and x.i = hit.i group by x.k)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(t, '')) as kept_sha256 from d left join kept using (k)
"""

_REPEATED_BYTES = """
with d as (select row_number() over () as k, doc_id, hex(encode(coalesce(text, ''))) as t, cast(octet_length(encode(coalesce(text, ''))) as bigint) as n from documents),
x as (select k, t, n, unnest(range(1, n - 398)) as i from d where n >= 400),
win as (select k, i, md5_number(substr(t, 2 * i - 1, 800)) as h from x),
often as (select h from win group by h having count(*) > 1),
edge as (select k, i, 1 as e from win semi join often using (h) union all select k, i + 400, -1 from win semi join often using (h)),
level as (select k, i, sum(e) as e from edge group by k, i),
run as (select k, i, sum(e) over (partition by k order by i) as s, lag(i) over (partition by k order by i) as p from level),
depth as (select k, i, s, coalesce(lag(s) over (partition by k order by i), 0) as b from run),
opens as (select k, i as a, row_number() over (partition by k order by i) as r from depth where b = 0 and s > 0),
closes as (select k, i as z, row_number() over (partition by k order by i) as r from depth where b > 0 and s = 0),
span as (select k, r, a, z from opens join closes using (k, r)),
gap as (select k, r, coalesce(lag(z) over (partition by k order by r), 1) as f, a as u from span union all select k, max(r) + 1, max(z), 9223372036854775807 from span group by k),
kept as (select k, string_agg(substr(t, 2 * f - 1, 2 * (least(u, n + 1) - f)), '' order by r) as t from gap join d using (k) group by k),
total as (select k, sum(z - a) as n_removed, count(*) as n_spans from span group by k),
y as (select k, w, t, unnest(range(1, n - 248)) as i from (select k, t, n, dense_rank() over (order by doc_id, t) as w from d) where n >= 250),
passage as (select k, w, i, md5_number(substr(t, 2 * i - 1, 500)) as h from y),
shared as (select h from passage group by h having min(w) <> max(w)),
held as (select k, i, lead(i) over (partition by k order by i) as j from passage semi join shared using (h)),
spread as (select k, sum(least(250, coalesce(j - i, 250))) as n_passage_bytes from held group by k)
select doc_id, n as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed, coalesce(n_spans, 0) as n_spans, sha256(unhex(coalesce(kept.t, d.t))) as kept_sha256, cast(coalesce(n_passage_bytes, 0) as bigint) as n_passage_bytes from d left join total using (k) left join kept using (k) left join spread using (k)
"""



def _merkle(arity: int = 3) -> str:
    """The trees level by level, siblings by level, and the fold of a leaf as a recursion over its levels."""
    fields = lambda text: " || ".join(f"case when {x} is null then '-' else cast(octet_length(encode(cast({x} as varchar))) as varchar) || ':' || cast({x} as varchar) end" for x in ("doc_id", "source", "lang", "n_chars", text))
    # CRC-32 is not a function of DuckDB: its remainder by 2 comes from a bitwise recursion over the digits
    crc = "list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, length(x) + 1), lambda i: ord(substr(x, i::int, 1))::bigint)), lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)::bigint[]), lambda v, w: case when v % 2 = 1 then xor(v // 2, 3988292384) else v // 2 end))"
    return f"""
with recursive d as materialized (select row_number() over () as k, doc_id, source, lang, n_chars, text, cast(doc_id as varchar) as x from documents),
t as materialized (select k, doc_id, source, sha256({fields('text')}) as leaf, case when doc_id is not null and xor({crc}, 4294967295) % 2 = 0 then replace(text, chr(10), '') else text end as now, lang, n_chars from d),
l as materialized (select k, doc_id, source, leaf, sha256({fields('now')}) as later, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as idx, count(*) over (partition by source) as n from t),
up as (
    select 0 as lev, source, idx, n, leaf as h from l
    union all
    select lev + 1, source, idx // {arity}, (n + {arity - 1}) // {arity}, sha256(string_agg(h, '' order by idx)) from up where n > 1 group by lev, source, idx // {arity}, n
),
sub as materialized (select source, lev as height, h as subroot, row_number() over (order by encode(source) nulls first) - 1 as idx, count(*) over () as n from up where n = 1),
top as (
    select 0 as lev, idx, n, subroot as h from sub
    union all
    select lev + 1, idx // {arity}, (n + {arity - 1}) // {arity}, sha256(string_agg(h, '' order by idx)) from top where n > 1 group by lev, idx // {arity}, n
),
root as materialized (select h as root, lev as height from top where n = 1),
near as materialized (
    select u.lev, u.source, u.idx, coalesce(string_agg(v.h, '' order by v.idx) filter (where v.idx < u.idx), '') as b, coalesce(string_agg(v.h, '' order by v.idx) filter (where v.idx > u.idx), '') as a
    from up u join up v on u.lev = v.lev and u.source is not distinct from v.source and u.idx // {arity} = v.idx // {arity} where u.n > 1 group by u.lev, u.source, u.idx
),
near_top as materialized (
    select u.lev, u.idx, coalesce(string_agg(v.h, '' order by v.idx) filter (where v.idx < u.idx), '') as b, coalesce(string_agg(v.h, '' order by v.idx) filter (where v.idx > u.idx), '') as a
    from top u join top v on u.lev = v.lev and u.idx // {arity} = v.idx // {arity} where u.n > 1 group by u.lev, u.idx
),
step as materialized (
    select l.k, near.lev, b, a from l join near on near.source is not distinct from l.source and near.idx = l.idx // cast(pow({arity}, near.lev) as bigint)
    union all
    select l.k, sub.height + near_top.lev, b, a from l join sub on l.source is not distinct from sub.source join near_top on near_top.idx = sub.idx // cast(pow({arity}, near_top.lev) as bigint)
),
fold as (
    select k, 0 as lev, later as h from l
    union all
    select f.k, f.lev + 1, sha256(s.b || f.h || s.a) from fold f join step s on s.k = f.k and s.lev = f.lev
),
proof as (select k, string_agg(b || a, '' order by lev) as p from step group by k)
select l.doc_id, leaf, subroot, root, sha256(coalesce(p, '')) as proof_sha256, h as folded_root, h = root as verified
from l join sub on l.source is not distinct from sub.source cross join root join (select k, arg_max(h, lev) as h from fold group by k) f on f.k = l.k left join proof on proof.k = l.k
"""


def _clusters(k: int = 40, rounds: int = 5) -> str:
    """The clustering with every distance computed, one block of common tables for each round."""
    near = "arg_min(c, {{'d': d, 'c': c}}) as c, min(d) as d from (select k, c, cast(list_sum(list_transform(list_zip(v, w), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) as bigint) as d from v, c{0}) group by k"
    parts = [
        "v as materialized (select row_number() over () as k, vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v from embeddings where len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 64 and len(embedding) = 64)",
        f"c0 as materialized (select cast(row_number() over (order by h) - 1 as int) as c, v as w from (select sha256('2:' || vec_id) as h, v from v order by h limit {k}))",
    ]
    for i in range(rounds):
        parts += [
            f"a{i} as materialized (select k, {near.format(i)})",
            f"m{i} as materialized (select c, list((s - ((s % n) + n) % n) // n order by j) as w from (select c, j, sum(x) as s, count(*) as n from (select c, unnest(v) as x, unnest(range(1, 65)) as j from a{i} join v using (k)) group by c, j) group by c)",
            f"c{i + 1} as materialized (select c, coalesce(m{i}.w, c{i}.w) as w from c{i} left join m{i} using (c))",
        ]
    last = f"a as materialized (select k, {near.format(rounds)})"
    return f"""
with {", ".join([*parts, last])}
select vec_id, c as cluster, d as distance, cast(sum(d) over (partition by c) as bigint) as cluster_inertia, cast(sum(d) over () as bigint) as inertia, sha256(array_to_string(w, ',')) as centroid_sha256
from a join v using (k) join c{rounds} using (c)
"""


ORACLE: dict[str, str] = {"op3_suffix_dedup": _REPEATED_BYTES, "op7_recompression": _REPEATED_WORDS, "op6_winnowing": _WINDOWS, "op10_warc": _WARC, "op11_merkle_manifest": _merkle(), "op13_hadamard_clusters": _clusters()}
