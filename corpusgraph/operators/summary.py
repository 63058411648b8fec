"""Views over the corpus graph: totals, novelty, filters and classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusgraph.functions import text as fn
from corpusgraph.operators.merge import Graph
from corpusgraph.operators.state import hinted


def corpus_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of totals; common means two documents or more."""
    part = lambda df, what: df.agg(F.count(F.lit(1)).alias(f"total_{what}"), F.count_if(F.col("n_docs") > 1).alias(f"common_{what}"), F.count_if(F.col("n_docs") < 2).alias(f"unique_{what}"))
    return part(nodes, "nodes").crossJoin(part(edges, "edges"))  # one row each


def doc_novelty(documents: DataFrame, graph: Graph) -> DataFrame:
    """For every document asked for: nodes_in_doc, unique_nodes, unique_edges, novelty (0 without nodes). What is unique
    counts for the document where it was first seen, as it is the only one."""
    n = graph.node_docs.groupBy(F.col("doc_id").alias("d")).agg(F.count(F.lit(1)).alias("nodes_in_doc"))
    own = lambda df, name: df.where("n_docs = 1").groupBy(F.col("first_doc").alias(f"d_{name}")).agg(F.count(F.lit(1)).alias(name))
    n = n.join(own(graph.nodes, "unique_nodes"), F.col("d") == F.col("d_unique_nodes"), "left")
    e = own(graph.edges, "unique_edges").withColumnRenamed("d_unique_edges", "e")
    out = documents.select("doc_id").join(n, F.col("doc_id") == F.col("d"), "left").join(e, F.col("doc_id") == F.col("e"), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    ratio = F.when(zero("nodes_in_doc") > 0, F.round(zero("unique_nodes") / zero("nodes_in_doc"), 3)).otherwise(F.lit(0.0))
    return out.select("doc_id", *[zero(c).alias(c) for c in ("nodes_in_doc", "unique_nodes", "unique_edges")], ratio.alias("novelty"))


def degrees(edges: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Relations of each node, or of those of ids (node_id) only."""
    ends = edges.select(F.col("source").alias("node_id")).union(edges.select("target"))
    if ids is not None:
        ends = ends.join(hinted(ids.select("node_id").distinct()), "node_id", "left_semi")
    return ends.groupBy("node_id").agg(F.count(F.lit(1)).alias("degree"))


def without_orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("source").alias("node_id")).union(edges.select("target"))
    return nodes.join(ends, "node_id", "left_semi")


def with_source_class(df: DataFrame, main: Column) -> DataFrame:
    return df.withColumn("source_class", fn.source_class(F.col("n_docs"), F.col("first_doc"), main))


def keep_nodes(nodes: DataFrame, edges: DataFrame, kept: Column) -> tuple[DataFrame, DataFrame]:
    """The nodes for which kept holds, and the edges with both ends among them."""
    n = nodes.where(kept)
    ids = n.select("node_id")
    e = edges.join(ids.withColumnRenamed("node_id", "source"), "source", "left_semi").join(ids.withColumnRenamed("node_id", "target"), "target", "left_semi")
    return n, e.select(edges.columns)


def first_documents(documents: DataFrame, n: int) -> DataFrame:
    """The first n documents in their order (ord counts from 0)."""
    return documents.where(F.col("ord") < n)


def name_search(nodes: DataFrame, part: str) -> DataFrame:
    """Nodes whose text contains that part, whatever its case."""
    return nodes.where(F.contains(F.lower("text"), F.lit(part.lower())))


def important_edges(edges: DataFrame, scores: DataFrame, top: int = 10) -> DataFrame:
    """Edges between the `top` nodes of the highest score; scores: (node_id, score). Ties by id."""
    best = scores.orderBy(F.desc("score"), "node_id").limit(top).select("node_id")
    e = edges.join(best.withColumnRenamed("node_id", "source"), "source", "left_semi").join(best.withColumnRenamed("node_id", "target"), "target", "left_semi")
    return e.select(edges.columns)


def relation_type_counts(edges: DataFrame, top: int = 15) -> DataFrame:
    """How often relation types occur, the `top` most frequent ones."""
    return edges.groupBy("relation_type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "relation_type").limit(top)


def sub_graph(nodes: DataFrame, edges: DataFrame, topic: str = "", source: str = "") -> tuple[DataFrame, DataFrame]:
    """The subgraph of nodes whose text contains the topic and whose source class is the source; an empty one allows all.
    nodes have a source_class."""
    kept = F.lit(True)
    if topic:
        kept = kept & F.contains(F.lower("text"), F.lit(topic.lower()))
    if source:
        kept = kept & (F.col("source_class") == source)
    return keep_nodes(nodes, edges, kept)


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    e = edges.agg(F.count(F.lit(1)).alias("relations"))
    n = nodes.agg(F.count(F.lit(1)).alias("entities"))
    return n.crossJoin(e).withColumn("avg_degree", F.round(2 * F.col("relations") / F.greatest("entities", F.lit(1)), 6))


def type_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy(F.coalesce("entity_type", F.lit("unknown")).alias("entity_type")).agg(F.count(F.lit(1)).alias("n_nodes"))


def edge_weights(edges: DataFrame) -> DataFrame:
    """Drawing width and opacity, relative to the strongest edge of the graph (one number, joined to all)."""
    top = edges.agg(F.greatest(F.coalesce(F.max("score"), F.lit(0.0)), F.lit(0.01)).alias("top"))
    ratio = F.col("score") / F.col("top")
    return edges.crossJoin(F.broadcast(top)).select("source", "target", "relation_type", F.round(1 + 3 * ratio, 6).alias("width"), F.round(F.lit(0.35) + F.lit(0.65) * ratio, 6).alias("opacity"))
