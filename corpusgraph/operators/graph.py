"""Traversal, ranking and comparison of graphs. Nodes (node_id, ...), edges (source, target, relation_type, ...)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusgraph.operators.order import running
from corpusgraph.operators.state import cut, hinted


def both_ways(edges: DataFrame) -> DataFrame:
    """(a, b) for every edge and its reverse, once each."""
    return edges.select(F.col("source").alias("a"), F.col("target").alias("b")).union(edges.select("target", "source")).where("a <> b").distinct()


def neighbours(edges: DataFrame, starts: DataFrame, depth: int = 1, relation_types: list[str] | None = None) -> DataFrame:
    """(start, node_id, hops): nodes within `depth` undirected hops of each start, the start itself left out.

    starts: (start). What was reached is looked for in the edges where they lie, broadcast while it is small, and taken out of
    what the next hop finds."""
    e = edges if relation_types is None else edges.where(F.col("relation_type").isin(relation_types))
    e = e.select("source", "target") if depth == 1 else cut(e.select("source", "target"))
    seen = cut(starts.select("start", F.col("start").alias("node_id"), F.lit(0).alias("hops")))
    front = seen
    for hop in range(1, depth + 1):
        near = hinted(front.select("start", F.col("node_id").alias("__at")))
        new = e.join(near, F.col("source") == F.col("__at")).select("start", F.col("target").alias("node_id"))
        new = new.union(e.join(near, F.col("target") == F.col("__at")).select("start", F.col("source").alias("node_id"))).distinct()
        front = new.join(seen.select("start", "node_id"), ["start", "node_id"], "left_anti").withColumn("hops", F.lit(hop))
        front = cut(front) if hop < depth else front
        seen = seen.union(front)
    return seen.where("hops > 0")


def subgraph(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The induced subgraph of ids (node_id)."""
    e = edges.join(ids.select(F.col("node_id").alias("source")), "source", "left_semi").join(ids.select(F.col("node_id").alias("target")), "target", "left_semi")
    return nodes.join(ids.select("node_id"), "node_id", "left_semi"), e.select(edges.columns)


def paths(edges: DataFrame, starts: DataFrame, ends: DataFrame, max_length: int = 3) -> DataFrame:
    """(path, length): directed simple paths from a start (node_id) to an end; parallel edges repeat a path.

    The last edge is one into an end and the last but one leads to an end or to the source of such an edge, so paths that
    cannot end in time are not made."""
    e = edges.select("source", "target").where("source <> target")
    goal = hinted(ends.select(F.col("node_id").alias("goal")))
    last = cut(e.join(goal, F.col("target") == F.col("goal"), "left_semi"))
    near = hinted(cut(last.select(F.col("source").alias("near")).union(goal).distinct()))
    front = starts.select(F.array("node_id").alias("path"))
    found = None
    for length in range(1, max_length + 1):
        left = max_length - length
        step = last if left == 0 else e.join(near, F.col("target") == F.col("near"), "left_semi") if left == 1 else e
        one, other = (front, hinted(step)) if left == 0 else (hinted(front), step)
        front = one.join(other, F.element_at("path", -1) == F.col("source")).where(~F.array_contains("path", F.col("target"))).select(F.concat("path", F.array("target")).alias("path"))
        front = cut(front) if left else front
        hit = front.join(goal, F.element_at("path", -1) == F.col("goal")).select("path", F.lit(length).alias("length"))
        found = hit if found is None else found.union(hit)
    return found


def with_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with text and type of both ends."""
    n = lambda k: nodes.select(F.col("node_id").alias(k), F.col("text").alias(f"{k}_text"), F.col("entity_type").alias(f"{k}_type"))
    return edges.join(n("source"), "source").join(n("target"), "target")


def entity_context(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> DataFrame:
    """(node_id, direction, relation_type, other_text, other_type, score) of each of the ids."""
    e = with_ends(edges, nodes)
    out = e.join(ids.select(F.col("node_id").alias("source")), "source", "left_semi").select(F.col("source").alias("node_id"), F.lit("out").alias("direction"), "relation_type", F.col("target_text").alias("other_text"), F.col("target_type").alias("other_type"), "score")
    into = e.join(ids.select(F.col("node_id").alias("target")), "target", "left_semi").select(F.col("target").alias("node_id"), F.lit("in").alias("direction"), "relation_type", F.col("source_text").alias("other_text"), F.col("source_type").alias("other_type"), "score")
    return out.union(into)


def pagerank(edges: DataFrame, iterations: int = 5, damping: float = 0.85) -> DataFrame:
    """(node_id, rank) after a fixed number of iterations over directed links; edges (source, target). The mass of nodes
    without out-links is spread over all: it is what a round does not pass on."""
    links = edges.select("source", "target").distinct()
    # Kept by source from here on, so no round shuffles the links again; from the edges if an executor is lost.
    links = links.withColumn("n_out", F.count(F.lit(1)).over(Window.partitionBy("source"))).persist()
    ids = cut(links.select(F.col("source").alias("node_id")).union(links.select("target")).distinct())
    n = ids.count()
    if not n:
        return ids.withColumn("rank", F.lit(0.0))
    ranks = ids.withColumn("rank", F.lit(1.0 / n))
    for _ in range(iterations):
        given = cut(links.join(ranks, F.col("source") == F.col("node_id")).groupBy("target").agg(F.sum(F.col("rank") / F.col("n_out")).alias("got")))
        loose = 1.0 - (given.agg(F.sum("got")).first()[0] or 0.0)
        got = damping * (F.coalesce("got", F.lit(0.0)) + F.lit(loose / n))
        ranks = ids.join(given, F.col("node_id") == F.col("target"), "left").select("node_id", (F.lit((1 - damping) / n) + got).alias("rank"))
    links.unpersist()
    return ranks


def eigenvector(edges: DataFrame, iterations: int = 20) -> DataFrame:
    """(node_id, value): power iteration on the undirected graph (shifted by one, so it also settles on bipartite ones)."""
    pairs = both_ways(edges).repartition("b").persist()
    value = pairs.select(F.col("a").alias("node_id")).distinct().withColumn("value", F.lit(1.0))
    for _ in range(iterations):
        got = pairs.join(value, F.col("b") == F.col("node_id")).groupBy("a").agg(F.sum("value").alias("got"))
        value = cut(value.join(got, F.col("node_id") == F.col("a")).select("node_id", (F.col("value") + F.col("got")).alias("value")))
        size = value.agg(F.sqrt(F.sum(F.col("value") * F.col("value")))).first()[0] or 1.0
        value = value.withColumn("value", F.col("value") / F.lit(size))
    pairs.unpersist()
    return value


def min_max(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns scaled to 0..1 by their range; a column without range becomes 0. The ranges are one row."""
    ranges = df.agg(*[f(c).alias(f"__{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))])
    out = df.crossJoin(F.broadcast(ranges))
    scale = lambda c: (F.col(c) - F.col(f"__lo_{c}")) / F.when(F.col(f"__hi_{c}") == F.col(f"__lo_{c}"), F.lit(1.0)).otherwise(F.col(f"__hi_{c}") - F.col(f"__lo_{c}"))
    return out.withColumns({c: scale(c) for c in columns}).select(df.columns)


def rank_sum(df: DataFrame, columns: list[str]) -> DataFrame:
    """Sum over the columns of the descending average rank. A column's ranks come from running counts of its values."""
    out = df.withColumn("rank_sum", F.lit(0.0))
    for c in columns:
        n = df.groupBy(F.col(c).alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
        n = running(n, [F.desc("__v")], {"__above": F.col("__n")})
        ranks = n.select("__v", (F.col("__above") + (F.col("__n") + 1) / 2).alias("__r"))
        out = out.join(ranks, F.col(c) == F.col("__v")).withColumn("rank_sum", F.col("rank_sum") + F.col("__r")).drop("__v", "__r")
    return out


def wl_histogram(node_labels: DataFrame, adjacency: DataFrame, rounds: int = 2) -> DataFrame:
    """(doc_id, label, n) over all rounds of Weisfeiler-Lehman relabelling. node_labels: (doc_id, node, label); adjacency:
    (doc_id, a, b), both directions."""
    now, every = node_labels, node_labels.select("doc_id", "label")
    for _ in range(rounds):
        side = now.select("doc_id", F.col("node").alias("b"), F.col("label").alias("other"))
        near = adjacency.join(side, ["doc_id", "b"]).groupBy("doc_id", F.col("a").alias("node")).agg(F.array_join(F.sort_array(F.collect_list("other")), ",").alias("others"))
        now = now.join(near, ["doc_id", "node"], "left").select("doc_id", "node", F.md5(F.concat("label", F.lit("|"), F.coalesce("others", F.lit("")))).alias("label"))
        every = every.union(now.select("doc_id", "label"))
    return every.groupBy("doc_id", "label").agg(F.count(F.lit(1)).alias("n"))


def wl_similarity(histogram: DataFrame, pairs: DataFrame) -> DataFrame:
    """(left_doc, right_doc, similarity): cosine of the label counts of the given pairs."""
    size = histogram.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("n") * F.col("n")).cast("double")).alias("size"))
    l, r = histogram.toDF("left_doc", "label", "nl"), histogram.toDF("right_doc", "label", "nr")
    dots = pairs.join(l, "left_doc").join(r, ["right_doc", "label"]).groupBy("left_doc", "right_doc").agg(F.sum(F.col("nl") * F.col("nr")).alias("dot"))
    out = pairs.join(dots, ["left_doc", "right_doc"], "left").join(size.toDF("left_doc", "sl"), "left_doc", "left").join(size.toDF("right_doc", "sr"), "right_doc", "left")
    return out.select("left_doc", "right_doc", F.round(F.coalesce(F.col("dot") / (F.col("sl") * F.col("sr")), F.lit(0.0)), 6).alias("similarity"))


def per_graph(edges: DataFrame, measure: str) -> DataFrame:
    """Measures of single graphs (doc_id, source, target), undirected, one graph in a task's memory at a time, as shortest paths
    and communities need the whole of it: `betweenness` (by chains, else Brandes) or `communities` (Louvain). For graphs of
    documents, not of corpora."""
    value = shortest if measure == "betweenness" else moved
    return of_documents(edges, lambda graphs: [value(g) for g in graphs])


def brandes(adj: dict) -> dict:
    score = dict.fromkeys(adj, 0.0)
    for s in adj:
        order, preds, sigma, dist, queue = [], {v: [] for v in adj}, dict.fromkeys(adj, 0), {s: 0}, [s]
        sigma[s] = 1
        for v in queue:
            order.append(v)
            for w in adj[v]:
                if w not in dist:
                    dist[w] = dist[v] + 1
                    queue.append(w)
                if dist[w] == dist[v] + 1:
                    sigma[w] += sigma[v]
                    preds[w].append(v)
        delta = dict.fromkeys(adj, 0.0)
        for w in reversed(order):
            for v in preds[w]:
                delta[v] += sigma[v] / sigma[w] * (1 + delta[w])
            if w != s:
                score[w] += delta[w]
    n = len(adj)
    return {v: x / ((n - 1) * (n - 2)) if n > 2 else 0.0 for v, x in score.items()}


@dataclass
class DocumentGraph:
    """names of the nodes; one, to: the different edges between different nodes, as places in names."""

    names: pa.Array
    one: np.ndarray
    to: np.ndarray


def neighbours_of(g: DocumentGraph) -> dict:
    names = g.names.to_pylist()
    adj: dict = {v: set() for v in sorted(names)}
    for a, b in zip(g.one.tolist(), g.to.tolist(), strict=True):
        adj[names[a]].add(names[b])
        adj[names[b]].add(names[a])
    return {v: sorted(x) for v, x in adj.items()}


def shortest(g: DocumentGraph) -> np.ndarray:
    """Betweenness of the names."""
    n = len(g.names)
    if n < 3:
        return np.zeros(n)
    x, y = both_sides(g)
    got = chained(n, x[x < y], y[x < y])
    if got is None:
        by_name = betweenness(neighbours_of(g), brandes)
        got = np.array([by_name[v] for v in g.names.to_pylist()])
    return got


def moved(g: DocumentGraph) -> np.ndarray:
    """Communities of the names."""
    by_name = louvain(neighbours_of(g))
    return np.array([by_name[v] for v in g.names.to_pylist()])


def document_graph(source: pa.Array, target: pa.Array) -> DocumentGraph:
    coded = pa.concat_arrays([source, target]).dictionary_encode()
    code, n = coded.indices.to_numpy(), len(coded.dictionary)
    a, b = code[: len(source)].astype(np.int64), code[len(source) :].astype(np.int64)
    one, to = np.divmod(np.unique((a * n + b)[a != b]), max(n, 1))
    used = np.zeros(n, bool)
    used[one], used[to] = True, True
    place = np.cumsum(used) - 1
    return DocumentGraph(coded.dictionary.filter(pa.array(used)), place[one], place[to])


def both_sides(g: DocumentGraph) -> tuple[np.ndarray, np.ndarray]:
    """The edges and their reverses, once each, in order."""
    n = max(len(g.names), 1)
    return np.divmod(np.unique(np.concatenate([g.one * n + g.to, g.to * n + g.one])), n)


def of_documents(edges: DataFrame, values: Callable[[list[DocumentGraph]], list[np.ndarray]], most_edges: int = 1 << 14) -> DataFrame:
    """(doc_id, node_id, value): `values` of the graphs, which it gets in lots of about that many edges. edges (doc_id, source,
    target) have one edge in a row, or the edges of a row as two arrays; a document's are brought together in one row."""
    kinds = dict(edges.dtypes)
    e = edges.select("doc_id", "source", "target")
    ends = [F.flatten(F.collect_list(c)).alias(c) for c in ("source", "target")]
    if not kinds["source"].startswith("array"):
        e, ends = e.where("source <> target"), [F.collect_list(c).alias(c) for c in ("source", "target")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            edges_upto = np.concatenate([[0], np.cumsum(pc.list_value_length(batch.column("source")).to_numpy())])
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(edges_upto, edges_upto[at] + most_edges, side="right")) - 1)
                graphs = [document_graph(*(batch.column(c)[i].values for c in ("source", "target"))) for i in range(at, to)]
                got = values(graphs)
                rows = np.repeat(np.arange(at, to), [len(g.names) for g in graphs])
                names = pa.concat_arrays([g.names for g in graphs])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(rows)), names, pa.array(np.concatenate(got), pa.float64())], ["doc_id", "node_id", "value"])
                at = to

    return e.groupBy("doc_id").agg(*ends).mapInArrow(run, f"doc_id {kinds['doc_id']}, node_id string, value double")


def chained(n: int, one: np.ndarray, two: np.ndarray, most: int = 1 << 17, rounds: int = 64) -> np.ndarray | None:
    """Betweenness of the nodes 0..n-1 of a connected graph of different edges (one, two), or None where it is not connected or
    its paths have too many branchings or are too many for a double.

    Graphs of texts are long chains of nodes with two neighbours between a few branching nodes. Distances and numbers of
    shortest paths are found between branching nodes only; from them follow, for each start and chain, how many of its
    nodes are reached by which end. What starts and ends in chains is thus a flow between pairs of branching nodes, which is
    passed back along their shortest paths. Pairs inside one chain go along it or around it by their gap alone. At
    most about `most` values are held in a step, beside matrices of all pairs of branching nodes."""
    m = len(one)
    src, dst = np.concatenate([one, two]), np.concatenate([two, one])
    order = np.argsort(src * n + dst)
    rank = np.empty(2 * m, np.int64)
    rank[order] = np.arange(2 * m)
    back = rank[np.concatenate([np.arange(m, 2 * m), np.arange(m)])][order]
    src, dst = src[order], dst[order]
    degree = np.bincount(src, minlength=n)
    first = np.cumsum(degree) - degree
    hub = degree != 2
    if not hub.any():
        hub[0] = True
    # The last step of the chain that each step is on, and how many come before it, by doubling.
    steps = np.arange(2 * m)
    last = np.where(hub[dst], steps, 2 * first[dst] + 1 - back)
    ahead = (last != steps).astype(np.int64)
    for _ in range(int(2 * m).bit_length() + 1):
        further = last[last]
        if (further == last).all():
            break
        ahead, last = ahead + ahead[last], further
    if not hub[dst[last]].all():
        return None  # a ring apart from the rest
    hubs = np.flatnonzero(hub)
    r = len(hubs)
    number = np.zeros(n, np.int64)
    number[hubs] = np.arange(r)
    out = np.flatnonzero(hub[src])
    at = np.zeros(2 * m, np.int64)
    at[out] = np.arange(len(out))
    x, y, length, mate = number[src[out]], number[dst[last[out]]], ahead[out] + 1, at[back[last[out]]]
    starts = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))

    whole, none = (np.int16, 1 << 14) if n < 1 << 13 else (np.int32, 1 << 29)
    long = length.astype(whole)[:, None]
    dist, ways = np.empty((r, r), whole), np.empty((r, r))
    width = max(1, most // len(x))
    for a in range(0, r, width):
        cols = np.arange(a, min(a + width, r))
        d = np.full((r, len(cols)), none, whole)
        d[cols, cols - a] = 0
        for _ in range(rounds):
            new = np.minimum(np.minimum.reduceat(d[y] + long, starts, axis=0), d)
            if (new == d).all():
                break
            d = new
        else:
            return None
        if (d == none).any():
            return None
        on = d[y] + long == d[x]
        now = np.zeros((r, len(cols)))
        now[cols, cols - a] = 1.0
        w = now
        while now.any():
            now = np.add.reduceat(now[y] * on, starts, axis=0)
            w = w + now
        dist[:, cols], ways[:, cols] = d, w
    if not np.isfinite(ways).all() or ways.max() > 1e150:
        return None

    # Nodes inside chains, by chain: number of the chain (the smaller of its two directions), ends and distances to them.
    inner = np.flatnonzero(~hub)
    k1, k2 = first[inner], first[inner] + 1
    c1, c2 = at[back[last[k2]]], at[back[last[k1]]]  # outward from the end behind
    chain, swap = np.minimum(c1, c2), c1 > c2
    du, dv = np.where(swap, ahead[k1], ahead[k2]) + 1, np.where(swap, ahead[k2], ahead[k1]) + 1
    by = np.lexsort((du, chain))
    inner, chain, du, dv = inner[by], chain[by], du[by], dv[by]
    u, v, size = x[chain], y[chain], du + dv
    wide = np.flatnonzero((length > 1) & (np.arange(len(x)) < mate))  # chains with nodes inside
    place = np.zeros(len(x), np.int64)
    place[wide] = np.arange(len(wide))
    cx, cy, span = x[wide], y[wide], length[wide].astype(whole)[:, None]
    ends = np.concatenate([cx, cy])
    by_end = np.argsort(ends, kind="stable")
    held = ends[by_end]
    runs = np.flatnonzero(np.concatenate([[True], held[1:] != held[:-1]])) if len(held) else held

    def reached(d: np.ndarray, w: np.ndarray, own: np.ndarray | None) -> np.ndarray:
        """For starts (columns) the flow for each path that ends at, or leaves by, a branching node (rows)."""
        count, shared = np.ones(d.shape), np.zeros(d.shape)
        if len(wide):
            q = d[cy]
            q -= d[cx]
            q += span
            tie = (q & 1) == 0
            tie &= q > 0
            tie &= q < 2 * span
            q -= 1
            q >>= 1
            near = np.maximum(q, 0, out=q)
            far = span - 1 - near
            far -= tie
            if own is not None:
                cols = np.arange(d.shape[1])
                near[own, cols], far[own, cols], tie[own, cols] = 0, 0, False
            count[held[runs]] += np.add.reduceat(np.concatenate([near, far])[by_end], runs, axis=0, dtype=whole)
            i, j = np.nonzero(tie)
            if len(i):
                p, o = cx[i] * d.shape[1] + j, cy[i] * d.shape[1] + j
                flow = 1 / (w.ravel()[p] + w.ravel()[o])
                shared = np.bincount(np.concatenate([p, o]), np.concatenate([flow, flow]), d.size).reshape(d.shape)
        return count / w + shared

    flow = np.zeros((r, r))  # for each path from a branching node (column) to another (row)
    width = max(1, most // (len(wide) + r))
    for a in range(0, r, width):
        cols = np.arange(a, min(a + width, r))
        got = reached(dist[:, cols], ways[:, cols], None)
        got[cols, cols - a] -= 1  # a start is no end of its own
        flow[:, cols] += got
    by_u, by_v = np.empty(len(inner)), np.empty(len(inner))
    for a in range(0, len(inner), width):
        z = slice(a, a + width)
        one_way, other = dist[:, u[z]] + du[z].astype(whole), dist[:, v[z]] + dv[z].astype(whole)
        e1, e2 = one_way <= other, other <= one_way
        w1, w2 = ways[:, u[z]] * e1, ways[:, v[z]] * e2
        got = reached(np.minimum(one_way, other), w1 + w2, place[chain[z]])
        by_u[z], by_v[z] = np.einsum("ij,ij->j", got, w1), np.einsum("ij,ij->j", got, w2)
        cut_at = np.flatnonzero(np.concatenate([[True], chain[z][1:] != chain[z][:-1]]))
        for e, end in ((e1, u[z][cut_at]), (e2, v[z][cut_at])):
            np.add.at(flow.T, end, np.add.reduceat(got * e, cut_at, axis=1).T)

    # Pairs inside a chain: those nearer than half the ring go along it, others around, equal ones both ways. along: sums over
    # k <= g of the share that goes along the chain of gaps up to k.
    gaps = np.concatenate([length[wide] - 2, size - 2, size - 1 - du, du - 1, size - 2 - du, du - 2]).clip(0)
    of = np.concatenate([wide, chain, chain, chain, chain, chain])
    lap = length[of] + dist[x[of], y[of]]
    full = (lap - 1) // 2
    low = np.minimum(gaps, full)
    along = low * (low + 1) / 2 + (gaps - low) * full + np.where(lap % 2 == 0, np.maximum(gaps - lap // 2 + 1, 0) / (1 + ways[x[of], y[of]]), 0.0)
    pairs = gaps * (gaps + 1) / 2  # of gaps + 1 nodes in a row
    all_of, after_it, before_it = along[len(wide) :].reshape(5, -1)[:3]
    around = pairs - along
    inside = all_of - after_it - before_it + around[len(wide) :].reshape(5, -1)[3:].sum(axis=0)
    ring = around[: len(wide)] / ways[cx, cy]
    np.add.at(flow, (cx, cy), ring)
    np.add.at(flow, (cy, cx), ring)

    through, passed = np.zeros(r), np.zeros(len(x))
    width = max(1, most // len(x))
    for a in range(0, r, width):
        cols = slice(a, a + width)
        d, w = dist[:, cols], ways[:, cols]
        on = d[x] + long == d[y]
        now = total = flow[:, cols]
        while True:
            now = np.add.reduceat(now[y] * on, starts, axis=0)
            if not now.any():
                break
            total = total + now
        through += np.einsum("ij,ij->i", w, total)
        passed += np.einsum("ij,ij,ij->i", w[x], on, total[y])
    score = np.zeros(n)
    score[hubs] = through - 2 * (n - 1)
    if len(inner):
        left, right = np.cumsum(by_v) - by_v, np.cumsum(by_u)
        head = np.flatnonzero(np.concatenate([[True], chain[1:] != chain[:-1]]))
        tail = np.append(head[1:], len(chain)) - 1
        many = tail - head + 1
        before, after = left - np.repeat(left[head], many), np.repeat(right[tail], many) - right
        score[inner] = passed[chain] + passed[mate[chain]] + 2 * (before + after + inside)
    return np.maximum(score, 0.0) / ((n - 1) * (n - 2))


def betweenness(adj: dict, plain: Callable[[dict], dict], most: int = 1 << 20) -> dict:
    """Node -> share of the shortest paths between others that pass it, after Brandes, from many nodes at once: level by level
    over pairs (start, node), of which `most` are held. `plain` does a graph whose numbers of paths are beyond a double."""
    names, n = list(adj), len(adj)
    if n < 3:
        return dict.fromkeys(names, 0.0)
    at = {v: i for i, v in enumerate(names)}
    degree = np.fromiter(map(len, adj.values()), np.int64, n)
    near = np.fromiter((at[w] for x in adj.values() for w in x), np.int64, int(degree.sum()))
    first, score, held = np.cumsum(degree) - degree, np.zeros(n), max(1, most // n)
    for a in range(0, n, held):
        rows = min(held, n - a)
        own = np.arange(rows) * n + np.arange(a, a + rows)
        seen, paths, owner = np.zeros(rows * n, bool), np.zeros(rows * n), np.zeros(rows * n, np.int64)
        seen[own], paths[own] = True, 1.0
        front, levels = own, []
        while len(front):
            v = front % n
            many = degree[v]
            k = np.arange(many.sum()) + np.repeat(first[v] - (np.cumsum(many) - many), many)
            to = np.repeat(front - v, many) + near[k]
            new = ~seen[to]
            one, to = np.repeat(front, many)[new], to[new]
            np.add.at(paths, to, paths[one])
            seen[to] = True
            order = np.arange(len(to))
            owner[to] = order
            front = to[owner[to] == order]
            levels.append((one, to))
        if not np.isfinite(paths).all():
            return plain(adj)
        passed = np.zeros(rows * n)
        for one, to in reversed(levels):
            np.add.at(passed, one, paths[one] / paths[to] * (1 + passed[to]))
        passed[own] = 0.0
        score += passed.reshape(rows, n).sum(axis=0)
    return dict(zip(names, (score / ((n - 1) * (n - 2))).tolist(), strict=True))


def louvain(adj: dict) -> dict:
    """Node -> community: moves to the neighbouring community that gains most modularity, nodes in order, until none gains;
    then each community becomes a node, and again, until nothing moves. Communities are numbered by their first node."""
    weights = {v: dict.fromkeys(near, 1) for v, near in adj.items()}
    home = {v: v for v in adj}
    twice = sum(map(len, adj.values())) or 1
    while True:
        at = {v: i for i, v in enumerate(weights)}
        degree = {v: sum(w.values()) for v, w in weights.items()}
        total = {at[v]: d for v, d in degree.items()}
        moved = moving = True
        rounds = 0
        while moving:
            moving = False
            for v, near in weights.items():
                links: dict = {}
                for w, n in near.items():
                    if w != v:
                        links[at[w]] = links.get(at[w], 0) + n
                total[at[v]] -= degree[v]
                links.setdefault(at[v], 0)
                share = degree[v]
                gain = {c: n - total[c] * share / twice for c, n in links.items()}
                most = max(gain.values())
                top = round(most, 9)  # gains of the same nine digits are equal; of equal ones the own, else the first
                best = at[v] if round(gain[at[v]], 9) == top else min(c for c, g in gain.items() if g > most - 2e-9 and round(g, 9) == top)
                total[best] += degree[v]
                moving |= best != at[v]
                at[v] = best
            rounds += 1
        moved = rounds > 1
        home = {v: at[h] for v, h in home.items()}
        if not moved:
            break
        joined: dict = {}
        for v, near in weights.items():
            row = joined.setdefault(at[v], {})
            for w, n in near.items():
                row[at[w]] = row.get(at[w], 0) + n
        weights = joined
    number: dict = {}
    return {v: float(number.setdefault(h, len(number))) for v, h in home.items()}


#: Weights of the measures in the combined index.
CENTRALITY = {"degree": 0.2, "betweenness": 0.3, "eigenvector": 0.2, "pagerank": 0.3}


def multi_centrality(edges: DataFrame, iterations: int = 100) -> DataFrame:
    """(doc_id, node_id, value): for each graph (doc_id, source, target) the four measures of its nodes, each scaled to 0..1 by
    its range in the graph, in one weighted sum. The rounds go over many graphs at once, as one without edges between them."""

    def run(graphs: list[DocumentGraph]) -> list[np.ndarray]:
        filled = [g for g in graphs if len(g.names)]
        if not filled:
            return [np.zeros(0) for _ in graphs]
        sizes = np.array([len(g.names) for g in filled])
        upto = np.cumsum(sizes)
        starts, own, n = upto - sizes, np.repeat(np.arange(len(sizes)), sizes), int(upto[-1])
        one, to = (np.concatenate([c + s for c, s in zip(x, starts, strict=True)]) for x in ([g.one for g in filled], [g.to for g in filled]))
        x, y = (np.concatenate([c + s for c, s in zip(z, starts, strict=True)]) for z in zip(*map(both_sides, filled), strict=True))
        n_out, each = np.bincount(one, minlength=n), sizes[own]
        share, loose = 1 / n_out[one], n_out == 0
        rank, value = 1 / each, np.ones(n)
        for _ in range(iterations):
            spread = np.add.reduceat(rank * loose, starts) / sizes
            rank = 0.15 / each + 0.85 * (np.bincount(to, rank[one] * share, n) + spread[own])
            value = value + np.bincount(x, value[y], n)
            value = value / np.sqrt(np.add.reduceat(value * value, starts))[own]
        measures = {"degree": np.bincount(x, minlength=n).astype(float), "betweenness": np.concatenate([shortest(g) for g in filled]), "eigenvector": value, "pagerank": rank}
        total = np.zeros(n)
        for c, weight in CENTRALITY.items():
            least = np.minimum.reduceat(measures[c], starts)
            span = np.maximum.reduceat(measures[c], starts) - least
            total = total + weight * ((measures[c] - least[own]) / np.where(span == 0, 1.0, span)[own])
        parts = iter(np.split(total, upto[:-1]))
        return [next(parts) if len(g.names) else np.zeros(0) for g in graphs]

    return of_documents(edges, run)
