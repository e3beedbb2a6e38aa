"""Point, pose, submap and feature tables read out of the given tables, as Spark and DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "points_v": (
        "lineitem",
        """
select l_suppkey as scan_id,
       cast(row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey, l_quantity,
            l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) as bigint) as point_id,
       l_quantity - 25.0 as x, l_extendedprice / 2000.0 - 25.0 as y, (l_discount - l_tax) * 100.0 as z,
       l_discount * 10.0 as r, l_tax * 10.0 as g, l_quantity / 50.0 as b
from lineitem""",
    ),
    "scan_poses_v": (
        "supplier",
        """
select s_suppkey as scan_id, cast(s_suppkey as double) * 0.5 as tx, cast(s_suppkey % 7 as double) - 3.0 as ty,
       cast(0 as double) as tz, cast(s_suppkey % 16 as double) * 0.1 as yaw
from supplier""",
    ),
    "poses_v": (
        "events",
        """
select user_id as session_id, event_id,
       MICROS(ts) * 10 + 621355968000000000 as t_ticks,
       event_id + case when event_id % 11 = 0 then 400 else 0 end as arrival_seq,
       value / 10.0 as tx, cast(event_id % 97 as double) / 10.0 as ty, cast(0 as double) as tz,
       cast(event_id % 63 as double) * 0.1 - 3.1 as yaw,
       cast(event_id % 5 as double) * 0.25 as dx, cast(event_id % 3 as double) * 0.125 - 0.125 as dy,
       cast(event_id % 9 as double) * 0.05 - 0.2 as dyaw
from events""",
    ),
    "vec_points_v": (
        "embeddings",
        """
select vec_id as point_id, label as cloud_id, cast(AT(embedding, 1) as double) as x,
       cast(AT(embedding, 2) as double) as y, cast(AT(embedding, 3) as double) as z from embeddings""",
    ),
    "features_v": ("embeddings", "select vec_id, label, SLICE33(embedding) as f from embeddings"),
    "submaps_v": (
        "supplier",
        """
select s_suppkey as submap_id, cast(floor(s_suppkey / 2) as bigint) as parent_id, s_acctbal / 100.0 as cx,
       cast(s_nationkey as double) * 4.0 as cy, cast(0 as double) as cz
from supplier""",
    ),
}

_SPARK = (("MICROS(ts)", "unix_micros(cast(ts as timestamp))"), ("AT(", "element_at("), ("SLICE33(embedding)", "cast(slice(embedding, 1, 33) as array<double>)"))
_DUCK = (("MICROS(ts)", "epoch_us(ts)"), ("AT(", "array_extract("), ("SLICE33(embedding)", "cast(embedding[1:33] as double[])"))


def _spell(sql: str, words: tuple) -> str:
    for a, b in words:
        sql = sql.replace(a, b)
    return sql


#: Rows of a table that one task sorts for a view with windows, and the key of these.
_ROWS, _WINDOWS = 250_000, {"points_v": "l_suppkey"}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view; the more rows its table has, the more tasks its windows get, so that none holds more."""
    source, sql = VIEWS[name]
    t = spark.read.parquet(f"{sf_dir}/{source}.parquet")
    if name in _WINDOWS:
        parts = -(-t.count() // _ROWS)
        if parts > int(spark.conf.get("spark.sql.shuffle.partitions")):
            t = t.repartition(parts, _WINDOWS[name])
    return spark.sql(_spell(sql, _SPARK).replace(f"from {source}", "from {t}"), t=t)


def duck(*names: str) -> str:
    """The views as the head of a DuckDB query: ``with a as (...), b as (...)``."""
    return "with " + ", ".join(f"{n} as ({_spell(VIEWS[n][1], _DUCK)})" for n in names)
