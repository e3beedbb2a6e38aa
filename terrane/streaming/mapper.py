"""Odometry and mapping of many sessions, batch by batch, with all state in versioned tables.

A batch of scans reads what the batch before it left: the last scan, the last accepted poses
and the tiled map of each session.  What it leaves itself stands under its own number, so a
batch that runs again replaces itself and changes nothing else.  Scans of one session are
taken one after the other, those of all sessions together; any split of the input therefore
gives the same poses and the same map.  A session of few points takes its scans in one task
(``following``); larger ones take them in Spark jobs, one scan of each at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrane.functions.geometry import POSE, pose
from terrane.operators.blocks import has_place
from terrane.operators.fits import whole_groups
from terrane.operators.neighbours import normals
from terrane.operators.registration import by_place, moved, register, steps_of
from terrane.operators.tiles import in_tiles, patches, tiled
from terrane.operators.trajectory import inverses, multiply, pose_product
from terrane.operators.voxel import VOXEL, merge_states
from terrane.plans.lineage import cut, forget
from terrane.streaming.following import CELL, FOLLOWED, HEAD, HEADED, LAST, NEW, NUMBERED, VOXELS, follow

_POSE = "struct<tx:double,ty:double,tz:double,qx:double,qy:double,qz:double,qw:double>"
HEADS = f"session_id long, seen_ticks long, t_ticks long, odometry_now {_POSE}, odometry {_POSE}, pose {_POSE}, inserted {_POSE}"
POSES = f"session_id long, t_ticks long, odometry {_POSE}, moved boolean, pose {_POSE}, fitness double, status string"
#: Rows of a session (scans of the batch, last scan, map) that follow each other in one task, and rows of such a task and of the arrays that it holds.
_SESSION, _TASK, _HELD = 50_000, 200_000, 65_536
MAP = "session_id long, vx int, vy int, vz int, n long, sx long, sy long, sz long, tx int, ty int, tz int"


@dataclass(frozen=True)
class Mapping:
    """How scans are registered and when they enter the map.

    ``radius`` bounds correspondences, ``reach`` is what a scan sees of the map, ``voxel`` and
    ``tile`` are the map's; a scan whose odometry fits worse than ``odometry_fitness`` counts as
    no motion, one that fits the map worse than ``refinement_fitness`` leaves no pose in the
    map, and one that moved less than ``least_move`` since the last insertion adds nothing.
    ``normals`` (radius, neighbours) are estimated where the kind needs them.  Every
    ``compact`` batches the map is written whole again.
    """

    kind: str = "PointToPoint"
    radius: float = 0.3
    reach: float = 30.0
    voxel: float = 0.1
    tile: float = 10.0
    odometry_fitness: float = 0.1
    refinement_fitness: float = 0.7
    least_move: float = 0.0
    rounds: int = 30
    normals: tuple[float, int] = (0.5, 10)
    compact: int = 16


def _array(poses: pd.Series) -> np.ndarray:
    return np.array([[p[n] for n in POSE] for p in poses]).reshape(-1, 7)


def _structs(poses: np.ndarray) -> list[dict[str, float]]:
    return [dict(zip(POSE, map(float, p), strict=True)) for p in poses]


def _predicted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Guesses moved on by the odometry since the last accepted scan, where there is any."""
    for t in batches:
        guess = _array(t["guess"])
        follows = t["follows"].to_numpy(bool)
        guess[follows] = multiply(guess[follows], multiply(inverses(_array(t["o"])), _array(t["odometry"]))[follows])
        yield t.assign(guess=_structs(guess))


def _continued(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Odometry of a batch, continued from what came before it."""
    for t in batches:
        yield t.assign(odometry=_structs(multiply(_array(t["from"]), _array(t["odometry"]))))


class SessionMapper:
    """A ``foreachBatch`` function over scans (session_id, t_ticks, point_id, x, y, z).

    A scan comes whole in one batch.  Scans at or before the last one seen of their session are
    late and dropped.  The first scan of a session is put at its pose in ``start``
    (session_id, pose), or at rest, and opens the map.
    """

    def __init__(self, spark: SparkSession, root: str, settings: Mapping = Mapping(), start: DataFrame | None = None) -> None:
        self.spark, self.root, self.s, self.start = spark, root.rstrip("/"), settings, start

    def poses(self) -> DataFrame:
        return self.spark.read.schema(f"{POSES}, batch long").parquet(f"{self.root}/poses").drop("batch")

    def map(self) -> DataFrame:
        """Voxel sums of each session."""
        return merge_states(self._map_before(None).drop("tx", "ty", "tz"), by=("session_id",))

    def __call__(self, batch: DataFrame, number: int) -> None:
        s = self.s
        heads, last = self._left_before(number)
        points = batch.select("session_id", "t_ticks", "point_id", "x", "y", "z").join(heads.select("session_id", "seen_ticks"), "session_id", "left")
        points = cut(points.where(F.col("seen_ticks").isNull() | (F.col("t_ticks") > F.col("seen_ticks"))).drop("seen_ticks"))
        base, fresh, done = self._map_before(number), None, None
        sizes = cut(self._sizes(points, last, base))
        total = sizes.agg(F.sum("n").alias("n"), F.count_if("fits").alias("small"), F.count_if(~F.col("fits")).alias("large")).first()
        if total["large"]:
            others = points.join(sizes.where("fits"), "session_id", "left_anti") if total["small"] else points
            heads, done, fresh = self._in_turn(others, heads, last, base)
        if total["small"]:
            small = sizes.where("fits").select("session_id") if total["large"] or number > 0 else None
            followed = cut(self._follow(points, self._left_before(number)[0], last, base, small, total["n"]))
            scans, voxels = followed.where("n is null"), followed.where("n is not null")
            at = {c: pose(*(F.col("numbers")[7 * k + i] for i in range(7))) for k, c in enumerate(NUMBERED)}
            poses = scans.select("session_id", "t_ticks", at["odometry"].alias("odometry"), "moved", at["pose"].alias("pose"), "fitness", "status")
            new = scans.where("last_ticks is not null").select("session_id", F.col("t_ticks").alias("seen_ticks"), F.col("last_ticks").alias("t_ticks"), at["odometry"].alias("odometry_now"), *(F.when(~F.isnan(at[c]["tx"]), at[c]).alias(n) for c, n in (("last_odometry", "odometry"), ("last_pose", "pose"), ("inserted", "inserted"))))
            added = in_tiles(voxels.select("session_id", *(F.col(c).cast("int").alias(c) for c in VOXEL), "n", "sx", "sy", "sz"), s.voxel, s.tile)
            done = poses if done is None else done.drop("enters").unionByName(poses)
            fresh = added if fresh is None else fresh.unionByName(added)
            heads = cut(heads.join(new, "session_id", "left_anti").unionByName(new))
        self._leave(number, points, heads, last, done, fresh)
        forget(sizes)

    def _sizes(self, points: DataFrame, last: DataFrame, base: DataFrame) -> DataFrame:
        """Sessions of the batch, with the rows that a task of the session would hold and whether it takes them."""
        known = F.col("session_id").isNotNull() & F.col("t_ticks").isNotNull() & has_place()
        for c in "xyz":
            known &= F.abs(c) < self.s.voxel * 2**30
        rows = [p.select("session_id", known.alias("known"), F.lit(new).alias("new")) for p, new in ((points, True), (last, False))]
        rows.append(base.select("session_id", (F.col("vx").isNotNull() & F.col("sx").isNotNull()).alias("known"), F.lit(False)))
        each = rows[0].union(rows[1]).union(rows[2]).groupBy("session_id").agg(F.count("*").alias("n"), F.bool_and(F.coalesce("known", F.lit(False))).alias("known"), F.bool_or("new").alias("new"))
        fits = F.lit(by_place(self.s.kind)) & F.col("known") & (F.col("n") <= _SESSION)
        return each.where("new").select("session_id", "n", fits.alias("fits"))

    def _follow(self, points: DataFrame, heads: DataFrame, last: DataFrame, base: DataFrame, small: DataFrame | None, rows: int) -> DataFrame:
        """Sessions that fit a task each, all their scans there; ``small`` names them if not all do."""
        s = self.s
        cloud = ["session_id", "t_ticks", "point_id", "x", "y", "z"]
        start = self.start.select("session_id", F.col("pose").alias("begin")) if self.start is not None else self.spark.createDataFrame([], f"session_id long, begin {_POSE}")
        left = heads.join(start, "session_id", "full")
        numbers = F.array(*(F.coalesce(F.col(c)[n], F.lit(float("nan"))) for c in HEADED for n in POSE))
        every = points.select(*cloud, F.lit(NEW).alias("kind")).unionByName(last.select(*cloud, F.lit(LAST).alias("kind")))
        every = every.unionByName(base.select("session_id", F.lit(VOXELS).alias("kind"), F.array(*(F.col(c).cast("long") for c in CELL)).alias("cell")), allowMissingColumns=True)
        every = every.unionByName(left.select("session_id", F.lit(HEAD).alias("kind"), numbers.alias("head")), allowMissingColumns=True)
        # empty lists instead of null ones: Spark's writer of Arrow batches goes back to the last list that isn't null for each row
        every = every.withColumns({"cell": F.coalesce("cell", F.array().cast("array<long>")), "head": F.coalesce("head", F.array().cast("array<double>"))})
        every = every if small is None else every.join(small, "session_id", "left_semi")
        parts = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // _TASK))
        dealt = every.repartition(parts, "session_id").sortWithinPartitions("session_id", "kind", "t_ticks", "point_id")
        solve, terms = steps_of(s.kind)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t in whole_groups(batches, _HELD):
                yield from follow(t, s, solve, terms)

        return dealt.mapInArrow(run, FOLLOWED)

    def _in_turn(self, points: DataFrame, heads: DataFrame, last: DataFrame, base: DataFrame) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
        """Sessions of any size, a scan of each at a time: their heads, poses and what they add to the map."""
        s, fresh, done = self.s, None, None
        in_time = Window.partitionBy("session_id").orderBy("t_ticks")  # a row for each scan of the batch
        stamps = points.select("session_id", "t_ticks").distinct().withColumns({"step": F.row_number().over(in_time) - 1, "before": F.lag("t_ticks").over(in_time)})
        stamps = cut(self._odometry(cut(stamps), points, heads, last))
        for step in range((stamps.agg(F.max("step")).first()[0] or 0) + 1 if not stamps.isEmpty() else 0):
            now = stamps.where(F.col("step") == step)
            found = cut(self._refine(now, points, heads, base if fresh is None else base.unionByName(fresh)))
            done = found if done is None else cut(done.unionByName(found), done)
            good = found.where("status <> 'rejected'")
            enters = good.where("enters").select(F.concat_ws("/", "session_id", "t_ticks").alias("pair_id"), "pose")
            scan = points.join(now.select("session_id", "t_ticks"), ["session_id", "t_ticks"], "left_semi").withColumn("pair_id", F.concat_ws("/", "session_id", "t_ticks"))
            added = tiled(moved(scan, enters), s.voxel, s.tile)
            fresh = cut(added) if fresh is None else cut(fresh.unionByName(added.select(fresh.columns)), fresh)
            heads = cut(self._heads_after(heads, found))
        return heads, done, fresh

    def _left_before(self, number: int) -> tuple[DataFrame, DataFrame]:
        """Heads and last scans of the batch before this one; none before the first."""
        tables = []
        for name, schema in (("heads", HEADS), ("last", "session_id long, t_ticks long, point_id long, x double, y double, z double")):
            if number > 0:
                tables.append(self.spark.read.schema(schema).parquet(f"{self.root}/{name}/batch={number - 1}"))
            else:
                tables.append(self.spark.createDataFrame([], schema))
        return tables[0], tables[1]

    def _map_before(self, number: int | None) -> DataFrame:
        """What batches before ``number`` added since the map was last written whole."""
        folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/map")
        files = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        there = sorted(int(x.getPath().getName().split("=")[1]) for x in files.listStatus(folder)) if files.exists(folder) else []
        there = [n for n in there if number is None or n < number]
        whole = max((n for n in there if n % self.s.compact == self.s.compact - 1), default=-1)
        paths = [f"{self.root}/map/batch={n}" for n in there if n >= whole]
        return self.spark.read.schema(MAP).parquet(*paths) if paths else self.spark.createDataFrame([], MAP)

    def _odometry(self, stamps: DataFrame, points: DataFrame, heads: DataFrame, last: DataFrame) -> DataFrame:
        """The stamps with the odometry pose of each scan and whether it moved with certainty: all pairs at once."""
        s = self.s
        pair = F.concat_ws("/", "session_id", "t_ticks").alias("pair_id")
        keyed = stamps.select("session_id", "t_ticks", "before", pair)
        cloud = ["point_id", "x", "y", "z"]
        source = keyed.join(points, ["session_id", "t_ticks"]).select("pair_id", *cloud)
        inside = keyed.where("before is not null").join(points.withColumnRenamed("t_ticks", "before"), ["session_id", "before"]).select("pair_id", *cloud)
        across = keyed.where("before is null").join(last.drop("t_ticks"), "session_id").select("pair_id", *cloud)
        target = cut(self._with_normals(inside.unionByName(across)))
        fit = register(source.join(target.select("pair_id").distinct(), "pair_id", "left_semi"), target, s.kind, s.radius, rounds=s.rounds)
        rest = pose(0.0, 0.0, 0.0)
        got = keyed.join(fit.select("pair_id", F.col("pose").alias("motion"), "fitness"), "pair_id", "left").withColumn("moved", F.coalesce(F.col("fitness") > s.odometry_fitness, F.lit(False)))
        steps = cut(got.select("session_id", "t_ticks", "moved", F.when(F.col("moved"), F.col("motion")).otherwise(rest).alias("pose")))
        product = pose_product(steps.select("session_id", "t_ticks", "pose"))
        from_ = heads.select("session_id", "odometry_now")
        whole = stamps.join(product, ["session_id", "t_ticks"]).join(steps.drop("pose"), ["session_id", "t_ticks"]).join(from_, "session_id", "left")
        whole = whole.select("session_id", "t_ticks", "step", "moved", F.coalesce("odometry_now", rest).alias("from"), F.col("product").alias("odometry"))
        return whole.mapInPandas(_continued, whole.schema).drop("from")

    def _with_normals(self, cloud: DataFrame) -> DataFrame:
        if self.s.kind == "PointToPoint":
            return cloud
        n = normals(cloud.withColumnRenamed("pair_id", "cloud_id"), *self.s.normals).where("not isnan(nx)")
        return cloud.join(n.select(F.col("cloud_id").alias("pair_id"), "point_id", "nx", "ny", "nz"), ["pair_id", "point_id"])

    def _refine(self, now: DataFrame, points: DataFrame, heads: DataFrame, state: DataFrame) -> DataFrame:
        """Poses in the map of one scan of each session, and whether the scan enters the map."""
        s = self.s
        rest = pose(0.0, 0.0, 0.0)
        before = heads.select("session_id", F.col("odometry").alias("o"), F.col("pose").alias("p"), F.col("inserted").alias("i"))
        start = self.start.select("session_id", F.col("pose").alias("begin")) if self.start is not None else self.spark.createDataFrame([], f"session_id long, begin {_POSE}")
        known = now.join(before, "session_id", "left").join(start, "session_id", "left").withColumn("pair_id", F.concat_ws("/", "session_id", "t_ticks"))
        known = known.select("session_id", "pair_id", "t_ticks", "odometry", "moved", F.coalesce("o", "odometry").alias("o"), "p", "i", F.coalesce("p", "begin", rest).alias("guess"), (F.col("p").isNotNull() & F.col("moved")).alias("follows"))
        known = cut(known.mapInPandas(_predicted, known.schema))
        follow = known.where("p is not null").select("session_id", "pair_id", F.col("guess").alias("pose"))
        if follow.isEmpty():  # first scans have no map to be registered in
            fit = self.spark.createDataFrame([], f"pair_id string, refined {_POSE}, fitness double")
            return self._judged(known, fit)
        target = self._with_normals(patches(state, follow, s.reach, s.voxel, s.tile))
        source = points.join(now.select("session_id", "t_ticks"), ["session_id", "t_ticks"], "left_semi").select(F.concat_ws("/", "session_id", "t_ticks").alias("pair_id"), "point_id", "x", "y", "z")
        source = source.where(F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z")) <= s.reach).join(follow.select("pair_id"), "pair_id", "left_semi")
        fit = register(source, cut(target), s.kind, s.radius, follow.select("pair_id", "pose"), rounds=s.rounds).select("pair_id", F.col("pose").alias("refined"), "fitness")
        return self._judged(known, fit)

    def _judged(self, known: DataFrame, fit: DataFrame) -> DataFrame:
        """Status and pose of each scan by its fit, if it has one, and whether it enters the map."""
        s = self.s
        done = known.join(fit, "pair_id", "left")
        status = F.when(F.col("p").isNull(), "first").when(F.coalesce(F.col("fitness") >= s.refinement_fitness, F.lit(False)), "accepted").otherwise("rejected")
        done = done.withColumn("status", status).withColumn("pose", F.when(F.col("status") == "accepted", F.col("refined")).otherwise(F.col("guess")))
        away = [F.col(f"pose.t{c}") - F.col(f"i.t{c}") for c in "xyz"]
        far = F.sqrt(away[0] * away[0] + away[1] * away[1] + away[2] * away[2]) >= s.least_move
        return done.select("session_id", "t_ticks", "odometry", "moved", "pose", F.coalesce("fitness", F.when(F.col("status") == "first", 1.0)).alias("fitness"), "status", F.coalesce(far, F.lit(True)).alias("enters"))

    def _heads_after(self, heads: DataFrame, found: DataFrame) -> DataFrame:
        """What later scans build on: the newest scan's odometry, and the poses of the last one accepted and inserted."""
        new = found.select("session_id", F.col("t_ticks").alias("t"), F.col("odometry").alias("o"), F.col("pose").alias("p"), (F.col("status") != "rejected").alias("ok"), "enters")
        both = heads.join(new, "session_id", "full")
        return both.select(
            "session_id",
            F.coalesce("t", "seen_ticks").alias("seen_ticks"),
            F.when(F.col("ok"), F.col("t")).otherwise(F.col("t_ticks")).alias("t_ticks"),
            F.coalesce("o", "odometry_now").alias("odometry_now"),
            F.when(F.col("ok"), F.col("o")).otherwise(F.col("odometry")).alias("odometry"),
            F.when(F.col("ok"), F.col("p")).otherwise(F.col("pose")).alias("pose"),
            F.when(F.col("ok") & F.col("enters"), F.col("p")).otherwise(F.col("inserted")).alias("inserted"),
        )

    def _leave(self, number: int, points: DataFrame, heads: DataFrame, last: DataFrame, done: DataFrame | None, fresh: DataFrame | None) -> None:
        write = lambda df, name: df.write.mode("overwrite").parquet(f"{self.root}/{name}/batch={number}")
        newest = heads.select("session_id", F.col("seen_ticks").alias("t_ticks"))
        write(points.unionByName(last).join(newest, ["session_id", "t_ticks"], "left_semi"), "last")
        write(done.select(*(c for c in done.columns if c != "enters")) if done is not None else self.spark.createDataFrame([], POSES), "poses")
        added = fresh if fresh is not None else self.spark.createDataFrame([], MAP)
        if number % self.s.compact == self.s.compact - 1:
            added = merge_states(self._map_before(number).unionByName(added), by=("session_id", "tx", "ty", "tz")).sortWithinPartitions("session_id", "tx", "ty", "tz")
        write(added.select("session_id", "vx", "vy", "vz", "n", "sx", "sy", "sz", "tx", "ty", "tz"), "map")
        write(heads, "heads")
        for spent in (points, heads, done, fresh):
            if spent is not None:
                forget(spent)
