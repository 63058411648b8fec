"""Provenance merge: mentions of many documents to one graph whose nodes and edges know their documents.

Mentions carry their order (doc_ord, segment_ix, pos); "first" always means first in it, never in order of arrival.
Tables: entity mentions (doc_id, doc_ord, segment_ix, pos, text, label, score) and relation mentions (doc_id, doc_ord,
segment_ix, pos, head_text, relation_type, tail_text, score); a doc_ord is one document's. They are reduced at once to one row for each key and
document, the observations, which tasks combine before the shuffle; all that follows comes from those. A graph has nodes
(node_id, canonical, text, entity_type, score, n_mentions, n_docs, first_doc, first_ord), edges (source, target,
relation_type, score, n_seen, n_docs, first_doc, first_ord, first_at), and for the documents of each the tables node_docs (node_id, canonical,
doc_id) and edge_docs (source, target, relation_type, doc_id). A concept of all documents has as many rows there, spread by
document; no value and no task holds them together.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgraph.functions import text as fn
from corpusgraph.operators.state import cut


class Graph:
    """The four tables. Edges and their documents may be given as functions, and are then made when they are first asked for."""

    def __init__(self, nodes: DataFrame, edges: DataFrame | Callable[[], DataFrame], node_docs: DataFrame, edge_docs: DataFrame | Callable[[], DataFrame]):
        self.nodes, self._edges, self.node_docs, self._edge_docs = nodes, edges, node_docs, edge_docs

    @property
    def edges(self) -> DataFrame:
        if not isinstance(self._edges, DataFrame):
            self._edges = self._edges()
        return self._edges

    @edges.setter
    def edges(self, edges: DataFrame) -> None:
        self._edges = edges

    @property
    def edge_docs(self) -> DataFrame:
        if not isinstance(self._edge_docs, DataFrame):
            self._edge_docs = self._edge_docs()
        return self._edge_docs


def order() -> Column:
    return F.struct("doc_ord", "segment_ix", "pos")


def keyed(mentions: DataFrame) -> DataFrame:
    """Entity mentions with their key; empty keys are dropped, as they would be part of everything."""
    return mentions.withColumn("canonical", fn.canonical(F.col("text"))).where("canonical <> ''")


def node_observations(mentions: DataFrame, key: str = "canonical", best: bool = True) -> DataFrame:
    """(canonical, doc_id, first, best, score, n_mentions): one row for each key of a document. `first` has the order, text and
    label of the first mention, `best` those of the one with the highest score, where that is wanted."""
    m = mentions if key in mentions.columns else keyed(mentions)
    top = F.max(F.struct("score", (-F.col("doc_ord")).alias("o"), (-F.col("segment_ix")).alias("s"), (-F.col("pos")).alias("p"), "label"))
    first = F.min(F.struct("doc_ord", "segment_ix", "pos", "text", "label"))
    return m.groupBy(F.col(key).alias("canonical"), "doc_id").agg(first.alias("first"), *([top.alias("best")] if best else []), F.max("score").alias("score"), F.count(F.lit(1)).alias("n_mentions"))


def nodes_of(observations: DataFrame, type_policy: str = "first") -> DataFrame:
    """One node for each key. The first mention gives text and id; type_policy `first` or `best` (highest score) the type."""
    agg = observations.groupBy("canonical").agg(
        F.min(F.struct("first.*", "doc_id")).alias("first"), *([F.max("best").alias("best")] if type_policy == "best" else []),
        F.max("score").alias("score"), F.sum("n_mentions").alias("n_mentions"), F.count(F.lit(1)).alias("n_docs"),
    )
    kind = F.col("first.label") if type_policy == "first" else F.col("best.label")
    return agg.select(fn.entity_id(F.col("first.text"), F.col("first.label")).alias("node_id"), "canonical", F.col("first.text").alias("text"), kind.alias("entity_type"), "score", "n_mentions", "n_docs", F.col("first.doc_id").alias("first_doc"), F.col("first.doc_ord").alias("first_ord"))


def edge_observations(relations: DataFrame) -> DataFrame:
    """(head_key, tail_key, relation_type, doc_id, doc_ord, at, score, n_seen): one row for each relation of a document. `at` is
    its first place in the document as one number, so that the aggregate's values are all of fixed length and hashed."""
    place = F.shiftleft(F.col("segment_ix").cast("long"), 32).bitwiseOR(F.col("pos").cast("long"))
    r = relations.withColumns({"head_key": fn.canonical(F.col("head_text")), "tail_key": fn.canonical(F.col("tail_text"))})
    return r.groupBy("head_key", "tail_key", "relation_type", "doc_id", "doc_ord").agg(F.min(place).alias("at"), F.max("score").alias("score"), F.count(F.lit(1)).alias("n_seen"))


def resolve(observations: DataFrame, nodes: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Edge observations with both ends resolved to nodes first seen in their own or an earlier document; others are dropped.
    Ends that are aliases may make several rows of one edge and document, which become one."""
    r = observations
    if aliases is not None:
        for end in ("head", "tail"):
            a = aliases.select(F.col("canonical").alias("__k"), F.col("leader").alias("__l"))
            r = r.join(a, F.col(f"{end}_key") == F.col("__k"), "left").withColumn(f"{end}_key", F.coalesce("__l", f"{end}_key")).drop("__k", "__l")
    for end, name in (("head", "source"), ("tail", "target")):
        n = nodes.select(F.col("canonical").alias("__k"), F.col("node_id").alias(name), F.col("first_ord").alias("__o"))
        r = r.join(n, (F.col(f"{end}_key") == F.col("__k")) & (F.col("__o") <= F.col("doc_ord"))).drop("__k", "__o")
    r = r.select("source", "target", "relation_type", "doc_id", "doc_ord", "at", "score", "n_seen")
    if aliases is not None:
        r = r.groupBy("source", "target", "relation_type", "doc_id", "doc_ord").agg(F.min("at").alias("at"), F.max("score").alias("score"), F.sum("n_seen").alias("n_seen"))
    return r


def edges_of(resolved: DataFrame) -> DataFrame:
    return resolved.groupBy("source", "target", "relation_type").agg(F.max("score").alias("score"), F.sum("n_seen").alias("n_seen"), F.count(F.lit(1)).alias("n_docs"), F.min_by("doc_id", "doc_ord").alias("first_doc"), F.min("doc_ord").alias("first_ord"), F.min_by("at", "doc_ord").alias("first_at"))


def with_docs(rows: DataFrame, docs: DataFrame, by: list[str]) -> DataFrame:
    """Nodes or edges with `docs`, all their documents in one sorted value, as exports have them."""
    lists = docs.groupBy(*by).agg(F.sort_array(F.collect_list("doc_id")).alias("docs"))
    return rows.join(lists, by)


def merge_graph(entities: DataFrame, relations: DataFrame, merge: str = "canonical", type_policy: str = "first") -> Graph:
    """The graph of mentions; merge `containment` first joins keys that contain one another. Observations and nodes are
    tables in the shared folder, as all parts of the graph come from them; those of edges are made when edges are used."""
    m = keyed(entities)
    aliases, key = None, "canonical"
    if merge == "containment":
        aliases = cut(alias_leaders(m))
        m, key = m.join(aliases.select(F.col("canonical").alias("__k"), "leader"), F.col("canonical") == F.col("__k")).drop("__k"), "leader"
    seen = cut(node_observations(m, key, type_policy == "best"))
    nodes = cut(nodes_of(seen, type_policy))
    found = cache(lambda: cut(resolve(edge_observations(relations), nodes, aliases)))
    node_docs = seen.select("canonical", "doc_id").join(nodes.select("canonical", "node_id"), "canonical").select("node_id", "canonical", "doc_id")
    return Graph(nodes, lambda: edges_of(found()), node_docs, lambda: found().select("source", "target", "relation_type", "doc_id"))


def contained_pairs(keys: DataFrame) -> DataFrame:
    """(short, long) for keys of which every token of the one is in the other. keys: (canonical).

    A contained key is looked up under its rarest token only: all its tokens must be in the other, so one is enough,
    and the rarest meets the fewest.
    """
    t = keys.select("canonical", F.explode(F.array_distinct(fn.words(F.col("canonical")))).alias("token"))
    freq = t.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    rare = t.join(freq, "token").groupBy("canonical").agg(F.min(F.struct("n", "token"))["token"].alias("token"))
    long = t.select("token", F.col("canonical").alias("long"))
    pairs = rare.select("token", F.col("canonical").alias("short")).join(long, "token").where("short <> long")
    return pairs.where(fn.token_subset(F.col("short"), F.col("long"))).select("short", "long")


def alias_leaders(mentions: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(canonical, leader): keys in order of first occurrence join the first leader that contains them or is contained
    in them, and lead otherwise. This is the first maximal independent set in that order, found in parallel rounds."""
    keys = cut(mentions.groupBy("canonical").agg(F.min(order()).alias("ord")))
    p = contained_pairs(keys.select("canonical"))
    near = p.union(p.select(F.col("long"), F.col("short"))).toDF("a", "b").distinct()
    a, b = keys.toDF("a", "a_ord"), keys.toDF("b", "b_ord")
    earlier = cut(near.join(a, "a").join(b, "b").where(F.struct("b_ord", "b") < F.struct("a_ord", "a")).select("a", "b", "b_ord"))
    state = cut(keys.join(earlier.select(F.col("a").alias("canonical")).distinct(), "canonical", "left_anti").select("canonical", F.lit(True).alias("leads")))
    for _ in range(max_rounds):
        open_ = keys.select("canonical").join(state, "canonical", "left_anti")
        if open_.isEmpty():
            break
        s = state.select(F.col("canonical").alias("b"), "leads")
        seen = earlier.join(open_.withColumnRenamed("canonical", "a"), "a").join(s, "b", "left")
        seen = seen.groupBy("a").agg(F.max(F.coalesce("leads", F.lit(False))).alias("near_leader"), F.max(F.col("leads").isNull()).alias("waits"))
        new = seen.where("near_leader or not waits").select(F.col("a").alias("canonical"), (~F.col("near_leader")).alias("leads"))
        state = cut(state.union(new))
    else:
        raise RuntimeError(f"alias_leaders: not done after {max_rounds} rounds")
    lead = state.where("leads").select(F.col("canonical").alias("b"))
    joined = earlier.join(lead, "b").groupBy("a").agg(F.min(F.struct("b_ord", "b"))["b"].alias("leader"))
    return state.join(joined, F.col("canonical") == F.col("a"), "left").select("canonical", F.when(F.col("leads"), F.col("canonical")).otherwise(F.col("leader")).alias("leader"))


def entity_index(mentions: DataFrame) -> DataFrame:
    """Entities by id: the first mention's text, type and score, and how many mentions and documents there are."""
    m = mentions.withColumn("entity_id", fn.entity_id(F.col("text"), F.col("label")))
    first = F.min_by(F.struct("text", "label", "score"), order())
    return m.groupBy("entity_id").agg(first.alias("f"), F.count(F.lit(1)).alias("n_mentions"), F.countDistinct("doc_id").alias("n_docs")).select("entity_id", F.col("f.text").alias("text"), F.col("f.label").alias("entity_type"), F.col("f.score").alias("score"), "n_mentions", "n_docs")
