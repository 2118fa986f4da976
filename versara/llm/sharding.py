"""Size-tiered compaction of small immutable shards under a versioned manifest. DataFrame operations only."""

from __future__ import annotations

import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import FREE_SHUFFLES, count_rows, drop_cuts, drop_path, setting, table, table_path, write_cut

#: Arrivals fall into lanes of this many; a lane's shards are planned together, so planning runs in parallel.
LANE = 65_536


def text_bytes(text: str = "text") -> Column:
    return F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long")


def tiers(base: int, target: int, fan_in: int) -> list[tuple[int, int]]:
    """[low, high) of the tiers: up to base times fan_in, then by that factor up to target / fan_in, and the
    last one from there to the target."""
    edges = [0]
    while (nxt := max(edges[-1], base) * fan_in) < target // fan_in:
        edges.append(nxt)
    return [*zip(edges, [*edges[1:], target // fan_in]), (target // fan_in, target)]


def compact_plan(shards: DataFrame, *, base: int, target: int, fan_in: int = 4) -> DataFrame:
    """From ``shards(first, last, bytes, docs, members)`` those after compaction, with ``merges`` (how many
    tiers they have climbed).

    Tier by tier from the smallest, a tier's shards stand in order of arrival. Below the last tier, every
    ``fan_in`` of them become one shard, which lies in a higher tier (if they had the base size); the
    remainder waits for arrivals. In
    the last tier, runs are cut where their running size passes a multiple of the target, and all but the
    last run become one shard each, of about the target size. Shards of that size or more stay as they are.
    So at most fan_in - 1 shards of a lower tier, and one run of the last, remain small.
    """
    names = ["first", "last", "bytes", "docs", "members", "merges"]
    shards = shards.withColumn("merges", F.lit(0))
    for low, high in tiers(base, target, fan_in):
        here = (F.col("bytes") >= low) & (F.col("bytes") < high)
        lane = Window.partitionBy("lane")
        line = lane.orderBy("first")
        rows = shards.where(here).withColumn("lane", F.expr(f"first div {LANE}"))
        if high < target:
            rows = rows.withColumn("n", F.row_number().over(line) - 1).withColumn("run", F.expr(f"n div {fan_in}"))
            waits = F.col("run") >= F.expr(f"count(1) over (partition by lane) div {fan_in}")
        else:
            before = F.coalesce(F.sum("bytes").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
            rows = rows.withColumn("n", before).withColumn("run", F.expr(f"n div {high}"))
            waits = F.col("run") == F.max("run").over(lane)
        rows = rows.withColumn("key", F.when(waits, F.col("first")).otherwise(-2 - F.col("run")))
        merged = rows.groupBy("lane", "key").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("bytes").alias("bytes"), F.sum("docs").alias("docs"), F.flatten(F.collect_list("members")).alias("members"), (F.max("merges") + (F.count(F.lit(1)) > 1).cast("int")).alias("merges"))
        shards = shards.where(~here).select(names).unionByName(merged.select(names))
    return shards


class Store:
    """Shards under ``root``: ``data/version=V/shard=F`` holds the rows (as ``row``, with their ``arrival``) of the
    shard that version V wrote and whose first arrival is F; ``manifest/rows-*`` has one JSON row per live shard,
    and the small file ``manifest/vV`` names the rows of version V. Files never change. What is live is what the
    newest version names. A version appears whole, when its file takes its name: that rename refuses a name that
    is taken (``FileContext.rename`` without overwriting), so of two writers one fails. A writer that dies before
    that leaves the old version in force. (On a store without such a rename, put a conditional write here.)

    Neither rows nor paths of shards come to the driver: what is live is found by a join on the partition columns.
    Old versions stay readable until ``vacuum``.
    """

    SCHEMA = "first long, last long, bytes long, docs long, version int"

    def __init__(self, spark: SparkSession, root: str, task_bytes: int = 1 << 25) -> None:
        """``task_bytes``: bytes of rows that one task of an append is to write."""
        self.spark, self.root, self.task_bytes = spark, root.rstrip("/"), task_bytes

    def _path(self, path: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self):
        return self._path(self.root).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """All versions that can be read, ascending."""
        folder = self._path(f"{self.root}/manifest")
        if not self._fs().exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs().listStatus(folder)]
        return sorted(int(x[1:]) for x in names if x.startswith("v"))

    def version(self) -> int:
        """The newest version; 0 before the first commit."""
        return max(self.versions(), default=0)

    def _rows_of(self, version: int) -> str:
        (row,) = self.spark.read.text(f"{self.root}/manifest/v{version:08d}", wholetext=True).collect()
        return f"{self.root}/manifest/{row.value}"

    def manifest(self, version: int | None = None) -> DataFrame:
        version = self.version() if version is None else version
        if not version:
            return self.spark.createDataFrame([], self.SCHEMA)
        return self.spark.read.schema(self.SCHEMA).json(self._rows_of(version))

    def commit(self, shards: DataFrame, version: int) -> None:
        """Makes ``shards`` the live ones of ``version``, or raises if another writer has."""
        mark = uuid.uuid4().hex
        with setting(self.spark, FREE_SHUFFLES, "true"):
            shards.select("first", "last", "bytes", "docs", "version").write.json(f"{self.root}/manifest/rows-{mark}")
        staged, fs = self._path(f"{self.root}/manifest/_staged-{mark}"), self._fs()
        out = fs.create(staged, False)
        out.write(f"rows-{mark}".encode())
        out.close()
        jvm = self.spark.sparkContext._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        kinds = jvm.java.lang.reflect.Array.newInstance(jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 1)
        kinds[0] = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").NONE
        try:
            context.rename(fs.makeQualified(staged), fs.makeQualified(self._path(f"{self.root}/manifest/v{version:08d}")), kinds)
        except Py4JJavaError as e:
            fs.delete(staged, False)
            if "FileAlreadyExists" not in e.java_exception.getClass().getName():
                raise
            raise RuntimeError(f"another writer committed version {version} of the manifest") from None

    def _write(self, rows: DataFrame, version: int) -> None:
        with setting(self.spark, FREE_SHUFFLES, "true"):
            rows.write.partitionBy("shard").option("compression", "zstd").parquet(f"{self.root}/data/version={version}")

    def append(self, rows: DataFrame, arrival: Column, size: Column) -> None:
        """Writes the rows of each arrival number (null: -1) as a small shard; then commits. ``size``: bytes of a
        row. Arrival numbers are new ones.

        Rows go to tasks of about ``task_bytes`` by the hash of their arrival, so each arrival is one file; an
        arrival of more bytes than that (there are at most total / task_bytes of them, which bounds what is
        broadcast) is spread over as many tasks as it needs, by where its rows came from."""
        version = self.version()
        number = F.coalesce(arrival.cast("long"), F.lit(-1))
        held = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), number.alias("arrival"), size.cast("long").alias("bytes"), number.alias("shard"))
        sizes = write_cut(held.groupBy("shard").agg(F.sum("bytes").alias("total")), "arrivals")
        tasks = max(1, -(-(sizes.agg(F.sum("total")).first()[0] or 0) // self.task_bytes))
        large = sizes.where(F.col("total") > self.task_bytes).select("shard", F.expr(f"total div {self.task_bytes} + 1").alias("parts"))
        dealt = held.join(F.broadcast(large), "shard", "left")
        part = F.pmod(F.spark_partition_id(), F.coalesce("parts", F.lit(1)))
        dealt = dealt.withColumn("task", F.pmod(F.xxhash64("shard") + part, F.lit(tasks)).cast("int"))
        self._write(dealt.repartitionById(tasks, "task").select("row", "arrival", "bytes", "shard"), version + 1)
        new = self._written(version + 1).groupBy(F.col("shard").alias("first")).agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("docs"))
        self.commit(self.manifest(version).unionByName(new.select("first", F.col("first").alias("last"), "bytes", "docs", F.lit(version + 1).alias("version"))), version + 1)
        drop_cuts(sizes)

    def _written(self, version: int) -> DataFrame:
        """``(bytes, shard)`` of every row that a version wrote; a version without rows has none."""
        path = f"{self.root}/data/version={version}"
        return self.spark.read.schema("bytes long, shard long").parquet(path)

    def _open(self, live: DataFrame, broadcast_rows: int) -> DataFrame | None:
        """The rows of the shards ``live(version, shard, ...)`` with its columns; None if there are none."""
        versions = sorted(r.version for r in live.select("version").distinct().collect())  # as many as commits
        if not versions:
            return None
        paths = [f"{self.root}/data/version={v}" for v in versions]
        held = self.spark.read.option("basePath", f"{self.root}/data").parquet(*paths)
        held = held.select("row", "arrival", "bytes", F.col("version").cast("int").alias("version"), F.col("shard").cast("long").alias("shard"))
        return held.join(F.broadcast(live) if count_rows(live) <= broadcast_rows else live, ["version", "shard"])

    def compact(self, *, base: int, target: int, fan_in: int = 4, broadcast_rows: int = 100_000) -> None:
        """Plans on the manifest, rewrites each run's rows into one shard, and commits. Data move once, however
        many tiers a run climbs, and a run, which is of about the target size, is one task's work and one file.
        The list of shards is broadcast up to ``broadcast_rows`` rows and joined by a shuffle beyond."""
        version = self.version()
        old = self.manifest(version)
        plan = write_cut(compact_plan(old.select("first", "last", "bytes", "docs", F.array("first").alias("members")), base=base, target=target, fan_in=fan_in), "compaction")
        # one row per run of the target size: a window over them is small
        runs = write_cut(plan.where("merges > 0").withColumn("task", (F.row_number().over(Window.orderBy("first")) - 1).cast("int")), "compaction-runs")
        if n := count_rows(runs):
            parts = runs.select("task", F.col("first").alias("into"), F.explode("members").alias("first"))
            parts = write_cut(parts.join(old.select("first", "version"), "first").select("version", F.col("first").alias("shard"), "into", "task"), "compaction-parts")
            moved = self._open(parts, broadcast_rows)
            self._write(moved.repartitionById(n, "task").select("row", "arrival", "bytes", F.col("into").alias("shard")), version + 1)
            fresh = runs.select("first", "last", "bytes", "docs", F.lit(version + 1).alias("version"))
            stay = old.join(parts.select(F.col("shard").alias("first")), "first", "left_anti").select(fresh.columns)
            self.commit(fresh.unionByName(stay), version + 1)
            drop_cuts(parts)
        drop_cuts(plan, runs)

    def vacuum(self, *, keep_versions: int = 2, older_than: float = 86_400.0) -> list[int]:
        """Deletes what only versions before the last ``keep_versions`` name, if these are ``older_than`` seconds
        old: their manifests, and the data folders of versions of which no kept manifest names a shard, each by
        one call. Readers of kept versions are never hurt. Returns the versions whose data went."""
        fs, now, known = self._fs(), time.time() * 1000, self.versions()
        at = {v: self._path(f"{self.root}/manifest/v{v:08d}") for v in known}
        old = [v for v in known[: max(0, len(known) - max(1, keep_versions))] if fs.getFileStatus(at[v]).getModificationTime() <= now - older_than * 1000]
        used = {r.version for v in known if v not in old for r in self.manifest(v).select("version").distinct().collect()}
        gone = []
        for v in old:
            rows = self._rows_of(v)
            fs.delete(at[v], False)
            drop_path(self.spark, rows)
        for v in range(1, max(old, default=0) + 1):
            if v not in used and fs.exists(self._path(f"{self.root}/data/version={v}")):
                drop_path(self.spark, f"{self.root}/data/version={v}")
                gone.append(v)
        return gone

    def read(self, version: int | None = None, broadcast_rows: int = 100_000) -> DataFrame | None:
        """The live rows of a version: ``row`` (as appended), ``arrival``, ``bytes``, and ``shard``, the first
        arrival of their shard; None if nothing is live."""
        held = self._open(self.manifest(version).select("version", F.col("first").alias("shard")), broadcast_rows)
        return None if held is None else held.drop("version")


ARRIVAL_DOCS, BASE, TARGET, FAN_IN = 256, 1 << 18, 1 << 25, 4


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents arrive 256 ids at a time; after compaction, where each one lies."""
    return compacted(table(spark, sf_dir, "documents"))


def compacted(docs: DataFrame) -> DataFrame:
    """Where each document lies after one append and one compaction. Null texts have no bytes; documents with a
    null id arrive as number -1, ids below 0 by their own numbers; rows that repeat come back as often; a very
    long text makes its shard large, and a shard of the target size or more stays as it is; shards of one size
    stand in order of arrival; an empty table gives no rows; clashing column names are kept apart inside ``row``."""
    spark = docs.sparkSession
    store = Store(spark, table_path(spark, "shards"))
    store.append(docs, F.floor(F.col("doc_id") / ARRIVAL_DOCS), text_bytes())
    store.compact(base=BASE, target=TARGET, fan_in=FAN_IN)
    live = store.manifest().select(F.col("first").alias("shard"), F.col("last").alias("shard_last"), F.col("docs").alias("shard_docs"), F.col("bytes").alias("shard_bytes"))
    rows = store.read()
    if rows is None:
        return spark.createDataFrame([], "doc_id long, arrival long, shard_first long, shard_last long, shard_docs long, shard_bytes long")
    return rows.select(F.col("row.doc_id").alias("doc_id"), "arrival", "shard").join(live, "shard").select("doc_id", "arrival", F.col("shard").alias("shard_first"), "shard_last", "shard_docs", "shard_bytes")


def _oracle() -> str:
    steps = []
    for i, (low, high) in enumerate(tiers(BASE, TARGET, FAN_IN)):
        if high < TARGET:
            run, waits = f"(row_number() over (partition by first // {LANE} order by first) - 1) // {FAN_IN}", f"run >= count(*) over (partition by lane) // {FAN_IN}"
        else:
            run, waits = f"coalesce(sum(bytes) over (partition by first // {LANE} order by first rows between unbounded preceding and 1 preceding), 0)::bigint // {high}", "run = max(run) over (partition by lane)"
        steps.append(f"""
r{i} as (select *, first // {LANE} as lane, {run} as run from s{i} where bytes >= {low} and bytes < {high}),
k{i} as (select *, case when {waits} then first else -2 - run end as key from r{i}),
s{i + 1} as (select first, last, bytes, docs, members from s{i} where not (bytes >= {low} and bytes < {high}) union all
  select min(first), max(last), sum(bytes)::bigint, sum(docs)::bigint, flatten(list(members)) from k{i} group by lane, key),""")
    return f"""
with d as (select doc_id, coalesce(floor(doc_id / {ARRIVAL_DOCS})::bigint, -1) as arrival, coalesce(strlen(text), 0)::bigint as bytes from documents),
s0 as (select arrival as first, arrival as last, sum(bytes)::bigint as bytes, count(*) as docs, [arrival] as members from d group by arrival),
{''.join(steps)}
m as (select unnest(members) as arrival, first as shard_first, last as shard_last, docs as shard_docs, bytes as shard_bytes from s{len(steps)})
select doc_id, arrival, shard_first, shard_last, shard_docs, shard_bytes from d join m using (arrival)"""


OP7_SQL = _oracle()
