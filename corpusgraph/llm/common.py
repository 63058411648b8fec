"""Helpers shared by the training-data operators: word splitting, the shared folder, components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgraph.operators.state import delete, shared_dir, shared_path

SPACE_WORD_BREAK = r"[\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and go on from there: lineage ends, and a lost executor loses nothing.

    Results are lazy, so nobody can say when a table behind one may go; a checkpoint's files go with the last use of it,
    where the session sets spark.cleaner.referenceTracking.cleanCheckpoints."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def space_words(text: Column) -> Column:
    """The words `[^\\x20\\x09-\\x0D]+` of a text, in order; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_WORD_BREAK), lambda w: w != "")


def portions(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in consecutive slices of about that many bytes of text, so a worker's lists of words stay small."""
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            done = int(ends[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + most_bytes, side="right")))
            yield batch.slice(at, to - at)
            at = to


def within(df: DataFrame, most: int) -> bool:
    """Whether df has at most that many rows; reads no more than needed to tell."""
    return df.limit(most + 1).count() <= most


def hinted(df: DataFrame, most: int) -> DataFrame:
    """df, to be broadcast if it has at most that many rows, and left to a shuffle join otherwise."""
    return F.broadcast(df) if within(df, most) else df


def sieve(ids: DataFrame, most_bits: int = 1 << 29) -> Callable[[Column], Column]:
    """A test of long values that is false only for values that are certainly none of ids (one long column): a Bloom filter
    whose bits for a value lie in one word, 16 to 32 bits an id. Beyond most_bits it lets more pass, and never fewer."""
    spark, key = ids.sparkSession, ids.columns[0]
    n_words = 1 << (min(max(16 * ids.count(), 4096), most_bits // 2).bit_length() - 6)
    bits = F.expr(" | ".join(f"shiftleft(1L, cast(shiftrightunsigned(h, {40 + 6 * j}) & 63 as int))" for j in range(4)))
    set_ = ids.select(F.xxhash64(key).alias("h")).select(F.col("h").bitwiseAND(n_words - 1).alias("at"), bits.alias("bits"))
    set_ = set_.groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros(n_words, np.uint64)
    words[set_["at"].to_numpy()] = set_["bits"].to_numpy().view(np.uint64)
    shared = spark.sparkContext.broadcast(words)

    @F.pandas_udf("boolean")
    def may(hashes: pd.Series) -> pd.Series:
        h = hashes.to_numpy(np.int64).view(np.uint64)
        word, found = shared.value[(h & np.uint64(n_words - 1)).astype(np.int64)], np.ones(len(h), bool)
        for j in range(4):
            found &= (word >> (h >> np.uint64(40 + 6 * j) & np.uint64(63)) & np.uint64(1)).astype(bool)
        return pd.Series(found)

    return lambda c: may(F.xxhash64(c))


def joined_few(rows: DataFrame, key: Column, few: DataFrame, at: str, most: int) -> DataFrame:
    """rows, which are wide, with those of few that have their key (long). Where few is too many to be broadcast, only rows that
    can match are shuffled."""
    if within(few, most):
        return rows.join(F.broadcast(few), key == few[at])
    return rows.where(sieve(few.select(at))(key)).join(few, key == few[at])


def without(rows: DataFrame, key: Column, few: DataFrame, at: str, most: int) -> DataFrame:
    """rows, which are wide, whose key (long) is none of few's. Where few is too many to be broadcast, keys that could be few's
    are compared with it alone, and rows stay where they are but for those of more than `most` keys that only seemed to be."""
    if within(few, most):
        return rows.join(F.broadcast(few), key == few[at], "left_anti")
    may = sieve(few.select(at))(key)
    seemed = rows.select(key.alias("__key")).where("__key is not null").where(may).distinct()
    seemed = cut(seemed.join(few, F.col("__key") == few[at], "left_anti"))
    staying = joined_few(rows.where(key.isNotNull() & may), key, seemed, "__key", most).select(rows.columns)
    return rows.where(key.isNull() | ~may).unionAll(staying)


def components(edges: DataFrame, max_rounds: int = 60, broadcast_rows: int = 200_000) -> DataFrame:
    """Connected components of the edges (a long, b long) as rows (node, root): root is the smallest node reachable.

    Every round hooks each node to its smallest neighbour, follows the hooks once more, and contracts the graph;
    so a round at least halves the nodes that still have edges, and a star of any size takes one round. Minima are
    pre-aggregated before the shuffle, so a node with many neighbours is no hot spot; what many nodes hook to is looked up
    among those that are hooked to, which are broadcast if they are few. Nodes without edges are not returned, self-loops
    are ignored, and no edges give no rows.
    """
    spark = edges.sparkSession
    folder = shared_path(spark, "components")

    def kept(df: DataFrame, name: str) -> DataFrame:
        # A table and not checkpoint(), which keeps the size estimate of its plan: over rounds of joins that number's
        # digits would double each time.
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    edges = kept(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    maps = []
    while not edges.isEmpty():
        if len(maps) >= max_rounds:
            raise RuntimeError(f"components: no end after {max_rounds} rounds")
        both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).toDF("node", "other")
        hook = both.groupBy("node").agg(F.min("other").alias("up")).select("node", F.least("node", "up").alias("up"))
        hook = kept(hook, f"first{len(maps)}")
        ups = hook.select("up").distinct()
        far = hook.select(F.col("node").alias("up"), F.col("up").alias("up2")).join(ups, "up", "left_semi")
        hook = kept(hook.join(hinted(far, broadcast_rows), "up", "left").select("node", F.coalesce("up2", "up").alias("root")), f"hooks{len(maps)}")
        maps.append(hook)
        left = hook.toDF("a", "ra").join(edges.select("a").distinct(), "a", "left_semi")
        edges = edges.join(hinted(left, broadcast_rows), "a").join(hook.toDF("b", "rb"), "b").where("ra <> rb")
        edges = kept(edges.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), f"edges{len(maps)}")
    out = maps[0] if maps else edges.toDF("node", "root")
    for later in maps[1:]:
        out = out.join(hinted(later.toDF("root", "next"), broadcast_rows), "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    out = cut(out)
    delete(spark, folder)
    return out
