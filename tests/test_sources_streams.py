import numpy as np
import pytest
from pyspark.sql import functions as F

from terrane.config import PRESETS
from terrane.operators import crop, trajectory
from terrane.sources import clouds
from terrane.streaming import streams


def packed(spark, colored):
    points = spark.createDataFrame([("/lidar", 7, i, 0.5 * i, float(i * i), 10.5 * i, 2 * i / 255, 5 * i / 255, 10 * i / 255) for i in range(5)], "topic string, stamp_ticks long, point_id long, x double, y double, z double, r double, g double, b double")
    return points, clouds.messages_of_points(points, "map", colors=colored)


@pytest.mark.parametrize("colored", [True, False])
def test_messages_round_trip(spark, colored):
    points, messages = packed(spark, colored)
    m = messages.first()
    assert (m.width, m.height, m.point_step, len(m.data)) == (5, 1, 16 if colored else 12, 5 * m.point_step)
    back = clouds.points_of_messages(clouds.messages_of_topic(messages, "lidar")).orderBy("point_id").collect()
    assert [(r.x, r.y, r.z) for r in back] == [(0.5 * i, i * i, 10.5 * i) for i in range(5)]
    assert [r.r for r in back] == ([2 * i / 255 for i in range(5)] if colored else [None] * 5)
    assert [r.b for r in clouds.points_of_messages(messages, skip_colors=True).collect()] == [None] * 5


def test_padded_big_endian_and_odd_fields(spark):
    fields = [{"name": n, "offset": o, "datatype": t, "count": 1} for n, o, t in (("x", 0, 7), ("y", 4, 7), ("z", 8, 7), ("ring", 12, 4), ("intensity", 14, 2))]
    raw = b"".join(np.array([i, 2 * i, 3 * i], ">f4").tobytes() + np.array([i + 1], ">u2").tobytes() + bytes([200]) + bytes(5) for i in range(3))
    df = spark.createDataFrame([("t", 1, "f", 1, 3, 20, True, True, fields, bytearray(raw)), ("t", 2, "f", 1, 0, 20, False, True, fields, bytearray())], clouds.MESSAGES)
    got = clouds.points_of_messages(df, attributes=["ring", "missing"]).orderBy("point_id").collect()
    assert [(r.x, r.z, r.ring, r.intensity, r.missing) for r in got] == [(i, 3 * i, i + 1, 200, None) for i in range(3)]
    with pytest.raises(ValueError):
        clouds.messages_of_points(clouds.points_of_messages(df), "map", [("ring", "text")])


def test_pcd_files(spark, tmp_path):
    rows = spark.createDataFrame([(k, i, i * 0.1, float("nan") if i == 3 else i * 0.2, -i * 1.0) for k in (1, 2) for i in range(4)], "submap_id long, point_id long, x double, y double, z double")
    for f in clouds.pcd_files(rows, "submap_id").collect():
        (tmp_path / f.name).write_bytes(f.content)
    (tmp_path / "3.pcd").write_text("VERSION .7\nFIELDS x y z\nSIZE 4 4 4\nTYPE F F F\nCOUNT 1 1 1\nWIDTH 2\nHEIGHT 1\nPOINTS 2\nDATA ascii\n1 2 3\n4 5 6\n")
    got = clouds.read_pcd(spark, str(tmp_path), ("x", "y", "z", "intensity"))
    assert got.count() == 10 and got.filter(crop.is_finite()).count() == 8 and got.where("intensity is not null").count() == 0
    spark.dataSource.register(clouds.PcdDataSource)
    assert sorted(r[2:] for r in spark.read.format("pcd").load(str(tmp_path)).where("file like '%3.pcd'").collect()) == [(1, 2, 3), (4, 5, 6)]
    with pytest.raises(ValueError):
        clouds.decode_pcd(b"nothing")


def test_meshes(spark):
    v = spark.createDataFrame([(1, i, float(i), 0.0, 1.0) for i in range(3)], "mesh_id long, vertex_id int, x double, y double, z double")
    t = spark.createDataFrame([(1, 0, 0, 1, 2)], "mesh_id long, triangle_id int, i0 int, i1 int, i2 int")
    v2, t2 = clouds.mesh_tables(clouds.meshes_of_tables(v, t))
    assert sorted(v2.collect()) == sorted(v.collect()) and t2.collect() == t.collect()
    bad = spark.createDataFrame([(1, [], [[0, 1, 2, 3]])], "mesh_id long, vertices array<struct<x:double,y:double,z:double>>, polygons array<array<int>>")
    with pytest.raises(Exception, match="triangles"):
        clouds.mesh_tables(bad)[1].collect()


def arrivals(spark):
    base = 638396640000000000
    rows = [(s, i, base + 1000 * (i if i % 5 else i - 3), i) for s in (1, 2, 3) for i in range(40)]
    return spark.createDataFrame(rows, "session_id long, event_id long, t_ticks long, arrival_seq long")


def stream_of(spark, df, path, files):
    for k in range(files):
        part = df.where((F.col("arrival_seq") >= k * 40 / files) & (F.col("arrival_seq") < (k + 1) * 40 / files))
        part.coalesce(1).write.mode("append").parquet(f"{path}/in")
    return streams.read_stream(spark, f"{path}/in", "session_id long, event_id long, t_ticks long, arrival_seq long")


@pytest.mark.parametrize("files", [1, 5])
def test_streams_equal_batches(spark, tmp_path, files):
    df = arrivals(spark).cache()
    s = stream_of(spark, df, tmp_path, files)
    streams.replay(streams.drop_late(s), f"{tmp_path}/late", f"{tmp_path}/c1")
    want = {(r.session_id, r.event_id) for r in trajectory.drop_late(df).collect()}
    assert {(r.session_id, r.event_id) for r in spark.read.parquet(f"{tmp_path}/late").collect()} == want and want
    ordered = df.withColumn("t_ticks", F.col("arrival_seq"))
    s = stream_of(spark, ordered, f"{tmp_path}/b", files)
    streams.replay(streams.count_batches(s, 4, skip=5), f"{tmp_path}/batches", f"{tmp_path}/c2")
    got = {(r.session_id, r.batch): r["items"][-1] for r in spark.read.parquet(f"{tmp_path}/batches").collect()}
    assert got == {(r.session_id, r.batch): r.last_item for r in trajectory.count_batches(ordered, 4, skip=5, item="event_id").collect()}


def test_dense_map_grows_batch_by_batch(spark, tmp_path):
    p = spark.createDataFrame([(1, i, i * 0.1, 0.0, 0.0, 0.1, 0.2, 0.3) for i in range(30)], "submap_id long, point_id long, x double, y double, z double, r double, g double, b double")
    sink = streams.dense_map_sink(spark, f"{tmp_path}/dense", 1.0)
    for k in range(3):
        sink(p.where(F.col("point_id") % 3 == k), k)
    sink(p.where("point_id % 3 = 2"), 2)  # the same batch again
    from terrane.operators.voxel import dense_state

    want = dense_state(p, 1.0, by=("submap_id",), extra=("r", "g", "b"))
    got = streams.read_dense_map(spark, f"{tmp_path}/dense").select(want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_presets():
    for p in PRESETS.values():
        assert p.search_radius > 0 and p.odometry.cropping.arguments() is not None


def test_pcd_sink_commits_whole_jobs_only(spark, tmp_path):
    from terrane.sources import pcd

    points = spark.createDataFrame([(s, i, i * 0.5, -1.0 * s, 2.0) for s in (1, 2, 3) for i in range(20)], "submap_id long, point_id long, x double, y double, z double")
    out = tmp_path / "out"
    pcd.save_submaps(points, str(out), "submap")
    assert sorted(p.name for p in out.iterdir()) == ["submap_1.pcd", "submap_2.pcd", "submap_3.pcd"]
    back = clouds.read_pcd(spark, f"file://{out}/*.pcd")
    got = sorted((r.path.rsplit("_", 1)[1], r.point_id, r.x, r.y, r.z) for r in back.collect())
    assert got == sorted((f"{r.submap_id}.pcd", r.point_id, r.x, r.y, r.z) for r in points.collect())
    pcd.save_submaps(points.where("submap_id = 2"), str(out), "submap")  # written anew: others go
    assert [p.name for p in out.iterdir()] == ["submap_2.pcd"]
    pcd.save_pcd(points.where("submap_id = 3").withColumn("file", F.lit("more.pcd")), str(out), "file")
    assert sorted(p.name for p in out.iterdir()) == ["more.pcd", "submap_2.pcd"]

    fails = F.when(F.col("submap_id") == 3, F.raise_error(F.lit("lost"))).otherwise(F.col("x"))
    with pytest.raises(Exception, match="lost"):
        pcd.save_submaps(points.withColumn("x", fails).repartition(3, "submap_id"), str(out), "submap")
    assert sorted(p.name for p in out.iterdir()) == ["more.pcd", "submap_2.pcd"]

    pcd.save_at_end(pcd.AtEnd(map=False, submaps=True), str(tmp_path / "end"), points, points, points)
    assert sorted(str(p.relative_to(tmp_path)) for p in (tmp_path / "end").rglob("*.pcd")) == [f"end/submaps/submap_{k}.pcd" for k in (1, 2, 3)]


def test_live_scans_come_once_in_bounded_batches_across_restarts(spark, tmp_path):
    from terrane.sources import pcd

    pcd.register_formats(spark)
    scans, sizes = tmp_path / "scans", []
    scans.mkdir()

    def arrive(ticks):
        for t in ticks:
            (scans / f"7_{t:04d}.pcd").write_bytes(clouds.encode_pcd({c: np.arange(3.0) + t for c in "xyz"}))

    def run():
        live = spark.readStream.format("pcd_scans").option("path", str(scans)).option("position", str(tmp_path / "position")).option("filesPerBatch", 2).load()
        def take(batch, number):
            batch = batch.persist()
            sizes.append(batch.select("t_ticks").distinct().count())
            batch.write.mode("overwrite").parquet(f"{tmp_path}/taken/batch={number}")

        q = live.writeStream.foreachBatch(take).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(processingTime="0 seconds").start()
        return q

    def wait(q, n):
        for _ in range(200):
            if sum(sizes) >= n:
                break
            q.awaitTermination(0.2)
        q.stop()

    arrive(range(1, 6))
    wait(run(), 5)
    arrive(range(6, 10))
    wait(run(), 9)
    rows = [(r.session_id, r.t_ticks, r.point_id, r.x) for r in spark.read.parquet(f"{tmp_path}/taken").collect()]
    assert sorted(rows) == [(7, t, k, float(t + k)) for t in range(1, 10) for k in range(3)]
    assert max(sizes) <= 4 and sizes[0] <= 2


def test_poses_once_and_resets_and_segments_as_in_batch(spark, tmp_path):
    rows = [(s, 100 * k + s, float((k * (3 + s)) % 17)) for s in (1, 2) for k in range(30) for _ in range(1 + k % 2)]
    df = spark.createDataFrame(rows, "session_id long, t_ticks long, x double")
    resets = spark.createDataFrame([(1, 700), (1, 701), (2, 1500)], "session_id long, t_ticks long")
    for k in range(3):
        here = (F.col("t_ticks") >= k * 1000) & (F.col("t_ticks") < (k + 1) * 1000)
        df.where(here).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        resets.where(here).coalesce(1).write.mode("append").parquet(f"{tmp_path}/resets")
    live = lambda n, schema: streams.read_stream(spark, f"{tmp_path}/{n}", schema)
    streams.replay(streams.emit_once(live("in", "session_id long, t_ticks long, x double")), f"{tmp_path}/once", f"{tmp_path}/c1")
    once = sorted((r.session_id, r.t_ticks) for r in spark.read.parquet(f"{tmp_path}/once").collect())
    assert once == sorted({(s, t) for s, t, _ in rows})
    split = streams.split_at_resets_live(live("in", "session_id long, t_ticks long, x double"), live("resets", "session_id long, t_ticks long"))
    streams.replay(split, f"{tmp_path}/split", f"{tmp_path}/c2")
    want = streams.split_at_resets(df, resets).select("session_id", "t_ticks", "x", "segment")
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/split").collect())) == sorted(map(tuple, want.collect()))
    assert {r.segment for r in want.collect()} == {0, 1, 2}


def walk(spark):
    """There and back along a line, with the cells that each scan lies in."""
    x = [0, 1, 2, 4, 5, 6, 8, 9, 6, 4, 2, 1, 0, 0, 0]
    rows = [(s, 100 * k, k, float(v * s), 0.0, 0.0, float(v * s), 0.0, 0.0, 10, [v], [10]) for s in (1, 2) for k, v in enumerate(x)]
    return spark.createDataFrame(rows, "session_id long, t_ticks long, event_id long, tx double, ty double, tz double, cx double, cy double, cz double, n int, cells array<long>, counts array<long>")


def test_segments_and_the_chain_of_events(spark, tmp_path):
    """Segments as in batch; events taken once though stages run again; the end of a session forces its last submap."""
    from terrane.operators import mapping

    df = walk(spark)
    for k in range(3):
        df.where((F.col("t_ticks") >= k * 500) & (F.col("t_ticks") < (k + 1) * 500)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    settings = {"radius": 3.0, "least_scans": 2, "replay": 2}
    live = streams.segment_submaps(streams.read_stream(spark, f"{tmp_path}/in", ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)), **settings)
    streams.replay(live, f"{tmp_path}/segments", f"{tmp_path}/c")
    segments = spark.read.parquet(f"{tmp_path}/segments").cache()
    key = lambda r: (r.session_id, r.t_ticks, r.event_id, r.submap_id, r.active_after, r.parent_id, tuple(r.replayed))
    assert sorted(map(key, segments.collect())) == sorted(map(key, mapping.segment_submaps(df, **settings).collect()))

    work, seen = streams.WorkTable(spark, f"file://{tmp_path}/work", streams.FINISHED), {}
    stage = streams.chain(work, "closures", lambda events, number: seen.setdefault(number, []).append(sorted(map(tuple, events.collect()))))
    events = streams.finished_submaps(segments)
    work.put(events.where("t_ticks < 700"), 0)
    stage(None, 0)
    work.put(events.where("t_ticks >= 700"), 1)
    stage(None, 0)  # killed and run again: the same events, not the new ones
    work.put(streams.flushed_submaps(segments, spark.createDataFrame([(1,)], "session_id long")), 2)
    stage(None, 1)
    stage(None, 1)
    stage(None, 2)
    assert seen[0][0] == seen[0][1] and seen[1][0] == seen[1][1] and 2 not in seen
    taken = seen[0][0] + seen[1][0]
    last = max((r for r in segments.collect() if r.session_id == 1), key=lambda r: r.t_ticks)
    assert sorted(taken) == sorted([*map(tuple, events.collect()), (1, last.active_after, last.t_ticks, True)])
