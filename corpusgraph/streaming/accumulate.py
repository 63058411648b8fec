"""The accumulated graph: mentions and relations arrive in batches, nodes and edges grow, and the result equals a rebuild.

State is two append-only tables, node observations and edge observations, each already reduced by batch to a row for each key
and document; reading them merges the reductions. Relations are resolved to nodes when they are read, as a node may be seen
first in a batch to come. A batch is written under its own number, so a batch that is replayed replaces itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgraph.operators.merge import Graph, edge_observations, edges_of, node_observations, nodes_of, resolve
from corpusgraph.operators.state import cut


class AccumulatedGraph:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def add(self, mentions: DataFrame, batch: int, relations: DataFrame | None = None) -> None:
        """Fold entity mentions and relation mentions of a batch in."""
        node_observations(mentions).write.mode("overwrite").parquet(f"{self.path}/nodes/batch={batch}")
        if relations is not None:
            edge_observations(relations).write.mode("overwrite").parquet(f"{self.path}/edges/batch={batch}")

    def stream(self, mentions: DataFrame, checkpoint: str, relate: Callable[[DataFrame], DataFrame] | None = None):
        """Fold a streaming DataFrame of mentions in, batch by batch; returns the query writer, ready to start. relate
        makes a batch's relations of its mentions, so a segment has to arrive in one batch."""
        return mentions.writeStream.foreachBatch(lambda df, n: self.add(df, n, relate(df) if relate else None)).option("checkpointLocation", checkpoint)

    def _merged(self, name: str, by: list[str], *counts: str) -> DataFrame:
        """Observations with those of one key and document, from several batches, made one."""
        every = self.spark.read.parquet(f"{self.path}/{name}")
        least = [F.min("first").alias("first"), F.max("best").alias("best")] if name == "nodes" else [F.min("at").alias("at")]
        return every.groupBy(*by).agg(*least, F.max("score").alias("score"), *[F.sum(c).alias(c) for c in counts])

    def node_observations(self) -> DataFrame:
        return self._merged("nodes", ["canonical", "doc_id"], "n_mentions")

    def nodes(self, type_policy: str = "first") -> DataFrame:
        return nodes_of(self.node_observations(), type_policy)

    def edges(self) -> DataFrame:
        """Edges as a rebuild has them; there must have been a batch with relations."""
        return self.graph().edges

    def graph(self, type_policy: str = "first") -> Graph:
        seen = cut(self.node_observations())
        nodes = cut(nodes_of(seen, type_policy))
        found = cut(resolve(self._merged("edges", ["head_key", "tail_key", "relation_type", "doc_id", "doc_ord"], "n_seen"), nodes))
        node_docs = seen.select("canonical", "doc_id").join(nodes.select("canonical", "node_id"), "canonical").select("node_id", "canonical", "doc_id")
        return Graph(nodes, edges_of(found), node_docs, found.select("source", "target", "relation_type", "doc_id"))
