"""Sharding by size-tiered compaction: small immutable shards, merged into target-sized files, under a manifest.

A store is a folder. `append` writes one arrival of documents as small immutable shard files, as its tasks hold them
and without a shuffle, and each batch of the arrival becomes a run. `compact` groups the live runs of all arrivals by
size tier (powers of `fanout`); a tier with at least `least_runs` runs is merged, in order, into shards of up to about
`target_bytes` and `most_rows`. A merged shard is a run again and enters the next tier, so compaction repeats. Runs of an
arrival that are not merged get a shard of their own; compacted runs that are not merged, or have reached `target_bytes`,
stay where they are and are not rewritten. What would make a shard of more than twice the target (one batch that holds a
third of all rows, say) is dealt over several, by the place of each row in its immutable file.

Every change is committed as one new manifest version: a manifest table, and then one small file that names it, created
only if that version has none. A version exists as a whole or not at all, and of two writers one fails, wherever the
file system creates a file exclusively (HDFS does; on a store that does not, let one writer commit). A version begun by a
writer that died before it closed the file is refused with an error that names the file. Readers of an older version keep
their files until `vacuum`, which is for times when no writer is at work.

The manifest has a row for each live run (key, arrival, run, tier, merged, n_rows, bytes, commit, home, homes) whatever
made the version, and carries the documents' schema. Files lie in data/commit=C/home=H, and a run is found under its
commit and home. Merging is planned over runs, of which there is one for `batch_rows` documents: running sums go range
by range, so no task holds all runs of a tier. Each merged shard is built by one task, and what a compaction has written
is counted again before it is committed. The driver gets numbers of versions and commits, never lists of runs or shards.

Edge cases. Null texts have 0 bytes; null ids form a batch of their own. Repeated rows and tied ids stay what they are:
every row lands in exactly one shard. Arrivals may number their batches alike: a run is known by its arrival as well. An
arrival with other columns than the store's is refused. A document larger than the target gets a shard that is larger
than the target. An empty table commits a version without shards. All columns are kept; the store's own columns are
nested apart, so columns of any name may come. `assignments` takes ids that cast to long.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpusgraph.llm.common import cut, hinted, shared_path


@dataclass(frozen=True)
class ShardParams:
    target_bytes: int = 8 << 20
    most_rows: int = 1_000_000
    batch_rows: int = 512
    fanout: int = 4
    least_runs: int = 4
    broadcast_rows: int = 100_000
    codec: str = "zstd"


def text_bytes(text: Column) -> Column:
    return F.octet_length(F.coalesce(text, F.lit(""))).cast("long")


def tier_of(size: Column, fanout: int) -> Column:
    """How often the size divides by fanout: 0 below fanout bytes. Integer steps, no logarithm, so it is exact."""
    tier = F.lit(0)
    for k in range(1, 32):
        if fanout**k >= 1 << 62:
            break
        tier = tier + (size >= F.lit(fanout**k).cast("long")).cast("int")
    return tier


def with_places(runs: DataFrame, p: ShardParams) -> DataFrame:
    """Runs with in_tier (runs of their tier), and bytes_before and rows_before: sums over the tier's runs before each.

    The runs are range-partitioned; sums inside a range are added to those of the ranges before it."""
    by_range = cut(runs.repartitionByRange("tier", "arrival", "run", "key").withColumn("slice", F.spark_partition_id()))
    heads = by_range.groupBy("tier", "slice").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("b"), F.sum("n_rows").alias("r"))
    earlier = Window.partitionBy("tier").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    upto = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    heads = heads.select("tier", "slice", F.sum("n").over(Window.partitionBy("tier")).alias("in_tier"), upto("b", earlier).alias("b0"), upto("r", earlier).alias("r0"))
    inside = Window.partitionBy("tier", "slice").orderBy("arrival", "run", "key").rowsBetween(Window.unboundedPreceding, -1)
    out = by_range.join(hinted(heads, p.broadcast_rows), ["tier", "slice"])
    return out.withColumn("bytes_before", F.col("b0") + upto("bytes", inside)).withColumn("rows_before", F.col("r0") + upto("n_rows", inside)).drop("slice", "b0", "r0")


def merge_plan(runs: DataFrame, p: ShardParams) -> DataFrame:
    """Live runs -> those that move: key, commit, home, n_rows, bytes, tier, and of the shard they move to: into (the key of
    its first run), shard (that run's number), merged, its arrival and run, pieces, and place, the task that builds it."""
    open_ = runs.where(~(F.col("compacted") & (F.col("bytes") >= p.target_bytes))).withColumn("tier", tier_of(F.col("bytes"), p.fanout))
    open_ = with_places(open_, p).withColumn("merged", F.col("in_tier") >= p.least_runs)
    at = [F.floor(F.col("bytes_before") / F.lit(p.target_bytes)), F.floor(F.col("rows_before") / F.lit(p.most_rows))]
    open_ = open_.withColumn("part", F.when(F.col("merged"), F.concat_ws("_", *[x.cast("string") for x in at])).otherwise(F.col("key"))).withColumn("nth", at[0] + at[1])
    group = Window.partitionBy("tier", "merged", "part")  # bounded: what fits in a shard, and one run more
    first = lambda c: F.first(c).over(group.orderBy("arrival", "run", "key"))
    size = lambda c: F.sum(c).over(group)
    moves = ~F.col("compacted") | (F.count(F.lit(1)).over(group) > 1)
    fill = F.greatest(size("bytes") / F.lit(p.target_bytes), size("n_rows") / F.lit(p.most_rows))
    pieces = F.when(fill > 2, F.ceil(fill)).otherwise(F.lit(1)).cast("int")
    shard = F.coalesce(first("run"), F.lit(-1)).alias("shard")
    planned = open_.select("key", "commit", "home", "n_rows", "bytes", "tier", "merged", "nth", "in_tier", first("key").alias("into"), first("arrival").alias("arrival"), first("run").alias("run"), shard, pieces.alias("pieces"), moves.alias("moves"))
    planned = cut(planned.where("moves").drop("moves"))
    # Tiers one after the other, a place for each shard's worth of bytes.
    spans = planned.groupBy("tier").agg(F.max(F.col("nth") + F.col("pieces")).alias("span"))
    base = F.coalesce(F.sum("span").over(Window.orderBy("tier").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # at most 32 tiers
    return planned.join(F.broadcast(spans.select(F.col("tier").alias("t"), base.alias("base"))), F.col("tier") == F.col("t")).withColumn("place", F.col("base") + F.col("nth")).drop("t", "base", "nth", "in_tier")


#: A live run in a manifest: key is unique among the live runs, arrival and run are those of its first batch; homes is
#: how many homes its commit has written.
RUN = {"key": "string", "arrival": "int", "run": "long", "n_rows": "long", "bytes": "long", "tier": "int", "merged": "boolean", "compacted": "boolean", "commit": "int", "home": "string", "homes": "long"}


def with_schema(manifest: DataFrame, doc: StructType) -> DataFrame:
    return manifest.withColumn("home", F.col("home").alias("home", metadata={"doc": doc.json()}))


class ShardStore:
    """A folder of immutable shards under versioned manifests, on any file system that Hadoop reaches."""

    def __init__(self, spark: SparkSession, path: str, p: ShardParams | None = None):
        self.spark, self.path, self.p = spark, path.rstrip("/"), p or ShardParams()

    def _fs(self):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def _listed(self, folder: str, prefix: str) -> list[int]:
        fs, path = self._fs()
        at = path(f"{self.path}/{folder}")
        names = [x.getPath().getName() for x in fs.listStatus(at)] if fs.exists(at) else []
        return sorted(int(x.removeprefix(prefix)) for x in names if x.startswith(prefix))

    def version(self) -> int:
        return max(self._listed("versions", "v"), default=0)

    def _named(self, version: int) -> str:
        """The manifest table of a version."""
        fs, path = self._fs()
        at = f"{self.path}/versions/v{version:08d}"
        stream = fs.open(path(at))
        name = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        if not name.endswith("\n"):
            raise RuntimeError(f"{at} is not finished; if its writer is gone, delete it")
        return f"{self.path}/{name.strip()}"

    def commit(self, manifest: DataFrame, version: int) -> None:
        """All of the manifest or nothing becomes this version; fails if the version exists."""
        fs, path = self._fs()
        name = f"manifests/{uuid.uuid4().hex}"
        manifest.withColumn("version", F.lit(version)).write.parquet(f"{self.path}/{name}")
        try:
            stream = fs.create(path(f"{self.path}/versions/v{version:08d}"), False)
        except Py4JJavaError as e:
            fs.delete(path(f"{self.path}/{name}"), True)
            if "FileAlreadyExists" not in str(e):
                raise
            raise RuntimeError(f"version {version} was committed by another writer") from None
        stream.writeBytes(f"{name}\n")
        stream.close()

    def manifest(self, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(self._named(version or self.version()))

    def live(self, version: int) -> DataFrame:
        """The runs of a version, without its number; those of version 0 are none."""
        if version:
            return self.manifest(version).select(*RUN)
        return self.spark.createDataFrame([], ", ".join(f"{k} {v}" for k, v in RUN.items()))

    def doc_schema(self, version: int | None = None) -> StructType:
        """The documents' schema, which every manifest carries."""
        return StructType.fromJson(json.loads(self.manifest(version).schema["home"].metadata["doc"]))

    def _rows(self, commits: list[int], doc: StructType) -> DataFrame:
        schema = StructType().add("key", "string").add("run", "long").add("bytes", "long").add("doc", doc).add("tier", "integer").add("merged", "boolean").add("shard", "long").add("commit", "integer").add("home", "string")
        if not commits:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/data").parquet(*[f"{self.path}/data/commit={c:08d}" for c in commits])

    def append(self, docs: DataFrame, batch: Column, text: str = "text") -> int:
        """Write an arrival as small shards; `batch` numbers the runs of this arrival (long)."""
        was = self.version()
        version = was + 1
        if was and self.doc_schema(was).simpleString() != docs.schema.simpleString():
            raise ValueError(f"the store has documents of other columns: {self.doc_schema(was).simpleString()}")
        run = batch.cast("long")
        key = F.concat(F.lit(f"{version}_"), F.coalesce(run.cast("string"), F.lit("null")))
        rows = docs.select(key.alias("key"), run.alias("run"), text_bytes(F.col(text)).alias("bytes"), F.struct("*").alias("doc"))
        rows.write.option("compression", self.p.codec).parquet(f"{self.path}/data/commit={version:08d}/home=all")
        written = self._rows([version], docs.schema).groupBy("key", "run").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("bytes").alias("bytes"))
        new = written.withColumns({"arrival": F.lit(version), "tier": tier_of(F.col("bytes"), self.p.fanout), "merged": F.lit(False), "compacted": F.lit(False), "commit": F.lit(version), "home": F.lit("all"), "homes": F.lit(1).cast("long")})
        self.commit(with_schema(self.live(was).unionByName(new.select(*RUN)), docs.schema), version)
        return version

    def compact(self) -> int:
        """Merge the live runs of the newest version by tier and commit the outcome; without runs to move the version
        stays. Repeat it to fill the next tiers."""
        was = self.version()
        version = was + 1
        runs, doc = self.live(was), self.doc_schema(was)
        planned = cut(merge_plan(runs, self.p))
        total = planned.agg(F.sum("n_rows").alias("rows"), F.max(F.col("place") + F.col("pieces")).alias("places")).first()
        if not total["rows"]:
            return was
        commits = sorted(x[0] for x in planned.select("commit").distinct().collect())
        rows = self._rows(commits, doc).select("commit", "home", "key", "run", "bytes", "doc", F.xxhash64("_metadata.file_path", "_metadata.row_index").alias("dealt"))
        side = hinted(planned.select("commit", "home", "key", "into", "shard", "tier", "merged", "pieces", "place"), self.p.broadcast_rows)
        moved = rows.join(side, ["commit", "home", "key"]).withColumn("piece", F.pmod("dealt", F.col("pieces").cast("long")))
        home = F.when(F.col("pieces") > 1, F.concat_ws(".", "into", F.col("piece").cast("string"))).otherwise(F.col("into"))
        info = planned.groupBy("into", "arrival", "run", "tier", "merged").agg(F.max("pieces").alias("pieces"))
        info = info.withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).withColumn("home", home)
        moved = moved.select(home.alias("key"), "run", "bytes", "doc", "tier", "merged", "shard", home.alias("home"), (F.col("place") + F.col("piece")).cast("int").alias("place"))
        moved = moved.repartitionById(int(total["places"]), F.col("place")).drop("place")
        moved.write.partitionBy("home").option("compression", self.p.codec).parquet(f"{self.path}/data/commit={version:08d}")
        written = cut(self._rows([version], doc).groupBy("home").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("bytes").alias("bytes")))
        found = written.agg(F.sum("n_rows").alias("rows"), F.count(F.lit(1)).alias("homes")).first()
        if found["rows"] != total["rows"]:
            raise RuntimeError(f"compaction read {total['rows']} rows and wrote {found['rows']}; nothing is committed")
        new = written.join(info.select("home", "arrival", "run", "tier", "merged"), "home")
        new = new.withColumns({"key": F.col("home"), "compacted": F.lit(True), "commit": F.lit(version), "homes": F.lit(found["homes"]).cast("long")})
        stay = runs.join(hinted(planned.select("key"), self.p.broadcast_rows), "key", "left_anti")
        self.commit(with_schema(stay.select(*RUN).unionByName(new.select(*RUN)), doc), version)
        return version

    def vacuum(self) -> None:
        """Delete the manifests and files of all versions but the newest, and what no version has."""
        fs, path = self._fs()
        newest, older = self.version(), self._listed("versions", "v")[:-1]
        homes = self.manifest(newest).select("commit", "home").distinct()
        used = {x[0] for x in homes.select("commit").distinct().collect()}
        for c in self._listed("data", "commit="):
            if c not in used:
                fs.delete(path(f"{self.path}/data/commit={c:08d}"), True)
        for v in older:
            gone = self.manifest(v).where(F.col("commit").isin(*used)).select("commit", "home").distinct().join(homes, ["commit", "home"], "left_anti")
            for x in gone.toLocalIterator():
                fs.delete(path(f"{self.path}/data/commit={x['commit']:08d}/home={x['home']}"), True)
        for v in older:
            fs.delete(path(self._named(v)), True)
            fs.delete(path(f"{self.path}/versions/v{v:08d}"), False)

    def read(self) -> DataFrame:
        """Rows of the newest version: key (that of the row's run in the manifest), run, bytes, the document as struct
        `doc`, and tier, merged, shard, which are null until the row is compacted; and its commit and home."""
        newest = self.version()
        runs = self.manifest(newest)
        commits = runs.groupBy("commit").agg(F.countDistinct("home").alias("n"), F.max("homes").alias("of")).collect()
        rows = self._rows(sorted(x["commit"] for x in commits), self.doc_schema(newest))
        if all(x["n"] == x["of"] for x in commits):
            return rows
        return rows.join(hinted(runs.select("commit", "home").distinct(), self.p.broadcast_rows), ["commit", "home"], "left_semi").select(rows.columns)


def stored(docs: DataFrame, id_col: str = "doc_id", text: str = "text", p: ShardParams | None = None) -> ShardStore:
    """A new store with all documents, as arrivals of `batch_rows` ids each, compacted once."""
    p = p or ShardParams()
    store = ShardStore(docs.sparkSession, shared_path(docs.sparkSession, "shards"), p)
    store.append(docs, F.floor(F.col(id_col) / F.lit(p.batch_rows)), text)
    store.compact()
    store.vacuum()
    return store


def shard(docs: DataFrame, id_col: str = "doc_id", text: str = "text", p: ShardParams | None = None) -> DataFrame:
    """The rows of a new store with all documents: their columns in the struct `doc`, with run, shard, tier, merged, bytes."""
    return stored(docs, id_col, text, p).read()


def assignments(docs: DataFrame, id_col: str = "doc_id", text: str = "text", p: ShardParams | None = None) -> DataFrame:
    """One row for each document: id, bytes, run, shard, tier, merged, and its shard's shard_rows and shard_bytes. The
    shards hold all columns of the documents."""
    store = stored(docs, id_col, text, p)
    rows = store.read().select(F.col("doc").getField(id_col).alias(id_col), "bytes", "run", "shard", "tier", "merged", "key")
    sizes = store.manifest().select("key", F.col("n_rows").alias("shard_rows"), F.col("bytes").alias("shard_bytes"))
    return rows.join(hinted(sizes, store.p.broadcast_rows), "key").drop("key")


def oracle_sql(p: ShardParams | None = None) -> str:
    """SQL of `assignments`, for tables of which no shard comes to more than twice the target."""
    p = p or ShardParams()
    steps = " + ".join(f"(bytes >= {p.fanout**k})::INT" for k in range(1, 32) if p.fanout**k < 1 << 62)
    return f"""
WITH d AS (SELECT doc_id, floor(doc_id / {p.batch_rows})::BIGINT AS run, octet_length(encode(coalesce(text, '')))::BIGINT AS bytes FROM documents),
r AS (SELECT run, sum(bytes)::BIGINT AS bytes, count(*) AS n_rows FROM d GROUP BY run),
t AS (SELECT *, {steps} AS tier FROM r),
m AS (SELECT *, count(*) OVER (PARTITION BY tier) >= {p.least_runs} AS merged,
  [floor(coalesce(sum(bytes) OVER before, 0) / {p.target_bytes}), floor(coalesce(sum(n_rows) OVER before, 0) / {p.most_rows})] AS part
  FROM t WINDOW before AS (PARTITION BY tier ORDER BY run ASC NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s AS (SELECT *, min(coalesce(run, -1)) OVER (PARTITION BY tier, merged, CASE WHEN merged THEN part ELSE [coalesce(run, -1)] END) AS shard FROM m)
SELECT d.doc_id, d.bytes, d.run, s.shard, s.tier::INTEGER AS tier, s.merged, count(*) OVER (PARTITION BY s.shard) AS shard_rows,
  (sum(d.bytes) OVER (PARTITION BY s.shard))::BIGINT AS shard_bytes FROM d JOIN s ON d.run IS NOT DISTINCT FROM s.run"""
