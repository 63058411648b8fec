"""Engine operators against hand-written cases and sequential re-tellings."""

import json
import random
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusgraph.functions import text as fn
from corpusgraph.operators import discovery, extract, graph, merge, originality, retrieve, segment, structure, summary
from corpusgraph.operators.order import running
from corpusgraph.plans import config, jobs
from corpusgraph.plans.pipeline import build_corpus_graph
from corpusgraph.sources import readers, sinks
from corpusgraph.streaming.accumulate import AccumulatedGraph


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


@pytest.mark.parametrize("text, key", [("Chain-of-Thought Hub", "chain of thought hub"), ("  The_Big-Cat ", "big cat"), ("-foo", "foo"), ("the a model", "a model"), ("", "")])
def test_canonical(spark, text, key):
    assert one(spark, fn.canonical(F.lit(text))) == key


def test_scalar_functions(spark):
    assert one(spark, fn.token_subset(F.lit("model"), F.lit("reasoning model")))
    assert not one(spark, fn.token_subset(F.lit("reasoning"), F.lit("model")))
    assert one(spark, fn.entity_id(F.lit("ibm"), F.lit("org"))) == "cf054271d1e6"
    assert one(spark, fn.sentences(F.lit("A b. C d! E"))) == ["A b.", "C d!", "E"]
    assert one(spark, fn.arxiv_ids(F.lit("see 2401.12345v2 and arxiv.org/abs/2301.00001"))) == ["2301.00001", "2401.12345v2"]
    assert [one(spark, fn.is_reference_heading(F.lit(h))) for h in ("References", "7. References")] == [True, False]
    assert one(spark, fn.keyword_bounds(F.lit(100)))["hi"] == 2
    assert one(spark, fn.hard_chunks(F.lit("a b c d e"), 2)) == ["a b", "c d", "e"] and one(spark, fn.hard_chunks(F.lit(" "), 2)) == []
    assert one(spark, fn.tail_tokens(F.lit("a b c"), F.lit(2))) == "b c" and one(spark, fn.tail_tokens(F.lit("a b"), F.lit(0))) == ""
    assert one(spark, fn.analysis_id(F.lit("A b/C:d"))) == "analysis_a_b_c_d"
    assert fn.token_budget(1024) == 1016 and fn.token_budget(1) == 1
    assert one(spark, fn.arxiv_id_of(F.lit("https://arxiv.org/pdf/2401.00001v3.pdf"))) == "2401.00001v3"


def test_structure(spark):
    text = "intro\n\n# A\n## B\none\ntwo\n\nthree\n## C\nfour\n# References\n[1] X y\nmore\n[2]. Z 2401.00001\n1. W\n- [12] V\n2) U\n1234. T\n# Appendix\nlast"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, content string")
    blocks = structure.markdown_blocks(docs)
    got = [(r["text"], r["headings"]) for r in blocks.orderBy("block_ix").collect()]
    assert got[:4] == [("intro", []), ("one\ntwo", ["A", "B"]), ("three", ["A", "B"]), ("four", ["A", "C"])] and got[-1] == ("last", ["Appendix"])
    cumulative = structure.markdown_blocks(docs, "cumulative").orderBy("block_ix").collect()
    assert cumulative[-1]["headings"] == ["A", "B", "C", "References", "Appendix"]
    rng = random.Random(6)
    for _ in range(5):  # paths by level against a stack
        heads, path, want = [(rng.randrange(1, 7), f"h{i}") for i in range(12)], [], []
        for level, h in heads:
            path = [x for x in path if x[0] < level] + [(level, h)]
            want.append([x[1] for x in path])
        made = spark.createDataFrame([(1, "\n".join("#" * v + f" {h}\ntext" for v, h in heads))], "doc_id long, content string")
        assert [r["headings"] for r in structure.markdown_blocks(made).orderBy("block_ix").collect()] == want
    s = structure.sections(blocks).orderBy("section_ix").collect()
    assert s[1]["text"] == "one\ntwo\n\nthree"
    assert [r["raw_text"] for r in structure.reference_entries(docs).orderBy("ref_ix").collect()] == ["X y more [2]. Z 2401.00001", "W", "V", "U 1234. T"]
    assert [r["source_id"] for r in structure.cited_ids(structure.reference_entries(docs)).collect()] == ["2401.00001"]
    only = spark.createDataFrame([(9, 0, "x", ["References"])], "doc_id long, section_ix int, text string, headings array<string>")
    assert structure.without_boilerplate(only, ["references"]).count() == 1


def test_segments_lose_nothing():
    rng = random.Random(4)
    for _ in range(100):
        blocks = [(" ".join(f"w{rng.randrange(99)}" + rng.choice(["", ".", ""]) for _ in range(rng.randrange(0, 60))), ["h"] * rng.randrange(2)) for _ in range(rng.randrange(6))]
        out = list(segment.segments_of(blocks, 20, 0))
        body = [w for t, h, _ in out for w in t.split("\n\n", 1 if h else 0)[-1].split()] if all(not h for _, h, _ in out) else None
        if body is not None:
            assert body == [w for t, _ in blocks for w in t.split()]
        assert all(n <= 21 for _, _, n in out)


def mention_rows(rng, n_docs=6, n=25):
    names = ["model", "reasoning model", "data model", "the model", "big data", "data", "graph", "graph data model"]
    return [(d, d, 0, i, rng.choice(names), rng.choice("xy"), rng.randrange(10) / 10) for d in range(n_docs) for i in range(rng.randrange(n))]


MENTION = "doc_id long, doc_ord long, segment_ix int, pos int, text string, label string, score double"


def sequential_merge(rows):
    nodes, edges = {}, {}
    canon = lambda t: t.removeprefix("the ")
    for d in sorted({r[0] for r in rows}):
        own = sorted(r for r in rows if r[0] == d)
        for _, _, _, _, t, label, s in own:
            n = nodes.setdefault(canon(t), [t, label, s, set()])
            n[2] = max(n[2], s)
            n[3].add(d)
        for a, b in zip(own, own[1:]):
            e = edges.setdefault((canon(a[4]), canon(b[4])), [0, set()])
            e[0] += 1
            e[1].add(d)
    return nodes, edges


def test_merge_equals_sequential(spark):
    rng = random.Random(1)
    for _ in range(3):
        rows = mention_rows(rng)
        m = spark.createDataFrame(rows, MENTION).repartition(5)
        g = merge.merge_graph(m, extract.adjacent_relations(m, F.lit("r"), F.lit(0.5)))
        n, e = merge.with_docs(g.nodes, g.node_docs, ["node_id"]), merge.with_docs(g.edges, g.edge_docs, ["source", "target", "relation_type"])
        nodes, edges = sequential_merge(rows)
        assert {r["canonical"]: (r["text"], r["entity_type"], r["score"], set(r["docs"])) for r in n.collect()} == {k: (v[0], v[1], v[2], v[3]) for k, v in nodes.items()}
        key = {r["node_id"]: r["canonical"] for r in n.collect()}
        assert {(key[r["source"]], key[r["target"]]): (r["n_seen"], set(r["docs"])) for r in e.collect()} == {k: tuple(v) for k, v in edges.items()}


def test_relation_needs_known_ends(spark):
    m = spark.createDataFrame([(1, 1, 0, 0, "a b", "x", 0.5), (2, 2, 0, 0, "c d", "x", 0.5)], MENTION)
    r = spark.createDataFrame([(1, 1, 0, 0, "a b", "r", "c d", 0.9), (2, 2, 0, 0, "a b", "r", "c d", 0.8)], "doc_id long, doc_ord long, segment_ix int, pos int, head_text string, relation_type string, tail_text string, score double")
    g = merge.merge_graph(m, r)
    assert [(x["n_seen"], x["n_docs"], x["first_doc"]) for x in g.edges.collect()] == [(1, 1, 2)] and [x["doc_id"] for x in g.edge_docs.collect()] == [2]


def test_alias_leaders_equal_greedy(spark):
    rng = random.Random(2)
    for _ in range(4):
        keys = list({" ".join(rng.sample(["a", "b", "c", "d", "e"], rng.randrange(1, 4))) for _ in range(25)})
        rng.shuffle(keys)
        leaders, want = [], {}
        for k in keys:
            got = next((x for x in leaders if set(k.split()) <= set(x.split()) or set(x.split()) <= set(k.split())), None)
            want[k] = got or k
            if not got:
                leaders.append(k)
        df = spark.createDataFrame([(k, i, 0, 0) for i, k in enumerate(keys)], "canonical string, doc_ord long, segment_ix int, pos int").repartition(3)
        assert {r["canonical"]: r["leader"] for r in merge.alias_leaders(df).collect()} == want


def test_expansion_equals_queue(spark):
    rng = random.Random(3)
    words = "a b c d e f g h".split()
    for cap in (2, 5, 100):
        triples = list({(" ".join(rng.sample(words, 2)), " ".join(rng.sample(words, 2))) for _ in range(20)})
        triples = [t for t in triples if t[0] != t[1]]
        seeds = ["a", "c d"]
        depth, queue, used, edges = {s: 0 for s in seeds}, list(seeds), set(), []
        for t in queue:
            if len(edges) >= cap:
                break
            if depth[t] >= 2:
                continue
            for i, (s, d) in enumerate(triples):
                if i not in used and set(t.split()) & (set(s.split()) | set(d.split())):
                    used.add(i)
                    edges.append(i)
                    for x in (s, d):
                        if x not in depth:
                            depth[x] = depth[t] + 1
                            queue.append(x)
        s = spark.createDataFrame([(1, k, i) for i, k in enumerate(seeds)], "doc_id long, key string, pos int")
        t = spark.createDataFrame([(1, i, a, b, "r") for i, (a, b) in enumerate(triples)], "doc_id long, ord int, src string, dst string, relation string")
        n, e = discovery.expand_topics(s, t, 2, cap)
        assert {r["key"]: r["depth"] for r in n.collect()} == depth
        assert {r["ord"] for r in e.collect()} == set(edges)


def test_topic_queries_use_configured_limits(spark, tmp_path):
    """25 seeds and 100 relations a document: a long document against a queue with these limits."""
    from corpusgraph.plans import queries

    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda i: "keyword" + letters[i // 26] + letters[i % 26]
    filler = lambda i: "minor" + letters[i // 26] + letters[i % 26]  # noqa: E731  (too rare for a seed)
    words = [w for i in range(40) for k in range(4) for w in (word(i), filler(4 * i + k))]
    rows = [(1, " ".join(words), "en"), (2, "keyword keyword minor", "en")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    triples = {}
    for i, (a, b) in enumerate(zip(words, words[1:])):
        triples.setdefault((a, len(a) >= len(b), b), i)
    depth, used, queue = {word(i): 0 for i in range(25)}, set(), [word(i) for i in range(25)]
    for w in queue:
        if depth[w] >= 2 or len(used) >= 100:
            continue
        for (a, _, b), i in triples.items():
            if i not in used and w in (a, b):
                used.add(i)
                for x in (a, b):
                    if x not in depth:
                        depth[x] = depth[w] + 1
                        queue.append(x)
    got = queries.topic_bfs(spark, str(tmp_path)).where("doc_id = 1").collect()
    assert {r["key"]: r["depth"] for r in got} == depth and len(used) >= 100
    assert {r["ord"] for r in queries.topics(spark, str(tmp_path))[1].where("doc_id = 1").collect()} == used
    n = {r["depth"]: r["n_topics"] for r in queries.depth_histogram(spark, str(tmp_path)).where("doc_id = 1").collect()}
    assert n == {d: list(depth.values()).count(d) for d in set(depth.values())} and n[0] == 25


def test_label_top_k(spark):
    rows = [(1, f"l{i:02}", 0.1) for i in range(15)] + [(2, f"l{i:02}", 0.9) for i in range(12)]
    got = discovery.label_top_k(spark.createDataFrame(rows, "g long, label string, score double"), ["g"]).groupBy("g").count().collect()
    assert {r["g"]: r["count"] for r in got} == {1: 5, 2: 10}


def test_graph(spark):
    e = spark.createDataFrame([("a", "b", "r"), ("b", "c", "r"), ("c", "d", "s"), ("a", "b", "s")], "source string, target string, relation_type string")
    s = spark.createDataFrame([("a",)], "start string")
    assert {r["node_id"] for r in graph.neighbours(e, s, 2).collect()} == {"b", "c"}
    assert {r["node_id"] for r in graph.neighbours(e, s, 3, ["r"]).collect()} == {"b", "c"}
    ids = spark.createDataFrame([("a",)], "node_id string")
    goal = spark.createDataFrame([("d",)], "node_id string")
    assert [r["path"] for r in graph.paths(e, ids, goal, 3).collect()] == [["a", "b", "c", "d"]] * 2
    assert abs(sum(r["rank"] for r in graph.pagerank(e, 7).collect()) - 1) < 1e-9
    path = e.withColumn("doc_id", F.lit(1))
    assert {r["node_id"]: round(r["value"], 6) for r in graph.per_graph(path, "betweenness").collect()} == {"a": 0, "b": 0.666667, "c": 0.666667, "d": 0}
    assert graph.per_graph(path, "communities").count() == 4
    assert abs(sum(r["value"] ** 2 for r in graph.eigenvector(e, 5).collect()) - 1) < 1e-9


def test_betweenness_of_documents(spark, tmp_path):
    """The query's graphs are those of whole documents: every pair's shortest paths, counted by brute force."""
    from itertools import combinations

    from corpusgraph.plans import queries

    names = ["alpha", "bravo", "delta", "gamma", "omega", "sigma", "theta"]
    rng = random.Random(4)
    rows = [(d, " ".join(rng.choice(names) for _ in range(n)), "en") for d, n in ((1, 9), (2, 14), (3, 1))]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {}
    for d, text, _ in rows:
        w = text.split()
        near = {x: {y for p in zip(w, w[1:]) if x in p for y in p if y != x} for x in w if len(w) > 1}
        for x in near:
            want[d, x] = 0.0
        for a, b in combinations(near, 2):
            paths = [[a]]
            while not any(p[-1] == b for p in paths):
                paths = [[*p, y] for p in paths for y in near[p[-1]] if y not in p]
            paths = [p for p in paths if p[-1] == b]
            for x in {y for p in paths for y in p[1:-1]}:
                want[d, x] += sum(x in p[1:-1] for p in paths) / len(paths) * 2 / ((len(near) - 1) * (len(near) - 2))
    got = {(r["doc_id"], r["node_id"]): r["value"] for r in queries.betweenness(spark, str(tmp_path)).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-5 for k in want) and max(want.values()) > 0


def some_graph(rng, n, m):
    return {(a, b) for a, b in ((f"n{rng.randrange(n)}", f"n{rng.randrange(n)}") for _ in range(m)) if a != b}


def test_betweenness_at_once():
    """All starts at once, and a few at a time, against the paths of every pair."""
    rng = random.Random(11)
    for n, m in ((3, 2), (12, 16), (30, 45), (40, 300)):
        adj = {}
        for a, b in some_graph(rng, n, m):
            adj.setdefault(a, set()).add(b)
            adj.setdefault(b, set()).add(a)
        dist, ways = {}, {}
        for s in adj:
            dist[s, s], ways[s, s], queue = 0, 1, [s]
            for v in queue:
                for w in adj[v]:
                    if (s, w) not in dist:
                        dist[s, w], ways[s, w] = dist[s, v] + 1, 0
                        queue.append(w)
                    if dist[s, w] == dist[s, v] + 1:
                        ways[s, w] += ways[s, v]
        size = len(adj)
        want = {v: sum(ways[s, v] * ways[v, t] / ways[s, t] for s, t in dist if v not in (s, t) and s != t and (s, v) in dist and (v, t) in dist and dist[s, v] + dist[v, t] == dist[s, t]) / max(1, (size - 1) * (size - 2)) for v in adj}
        for most in (1 << 20, 7, 3 * size):
            got = graph.betweenness(adj, None, most)
            assert got.keys() == want.keys() and all(abs(got[v] - want[v]) < 1e-9 for v in want)
    rungs = {}
    for i in range(1100):  # 2 ** 1100 shortest paths
        for x in (f"u{i}", f"d{i}"):
            for a, b in ((f"k{i}", x), (x, f"k{i + 1}")):
                rungs.setdefault(a, []).append(b)
                rungs.setdefault(b, []).append(a)
    assert graph.betweenness(rungs, lambda adj: "plain", 1 << 14) == "plain"


def sparse_graphs(rng, many):
    """Walks over words, rings, trees, and few nodes joined by long chains, some of them side by side or back to their start."""
    for t in range(many):
        if t % 4 == 0:
            k = rng.randrange(3, 60)
            w = [rng.randrange(k) for _ in range(rng.randrange(4, 120))]
            yield list(zip(w, w[1:]))
        elif t % 4 == 1:
            n = rng.randrange(3, 30)
            yield [(i, (i + 1) % n) for i in range(n)]
        elif t % 4 == 2:
            yield [(i, rng.randrange(i)) for i in range(1, rng.randrange(3, 20))]
        else:
            e, free = [], 6
            for _ in range(rng.randrange(1, 12)):
                at, end = rng.randrange(6), rng.randrange(6)
                for free in range(free, free + rng.randrange(2, 6)):
                    e.append((at, free))
                    at = free
                e.append((at, end))
                free += 1
            yield e


def test_betweenness_by_chains():
    """What is found between branching nodes and spread over the chains equals one search from each node, at a fraction of its time."""
    rng, found = random.Random(17), 0
    for e in sparse_graphs(rng, 200):
        g = graph.document_graph(pa.array([str(a) for a, _ in e]), pa.array([str(b) for _, b in e]))
        want = graph.brandes(graph.neighbours_of(g))
        assert dict(zip(g.names.to_pylist(), graph.shortest(g))).keys() == want.keys()
        x, y = graph.both_sides(g)
        for most in (1 << 17, 40):
            got = graph.chained(len(want), x[x < y], y[x < y], most) if len(want) > 2 else None
            found += got is not None
            for values in (graph.shortest(g), got if got is not None else graph.shortest(g)):
                assert all(abs(want[v] - b) < 1e-9 for v, b in zip(g.names.to_pylist(), values, strict=True))
    assert found > 200
    w = [rng.randrange(700) if rng.random() < 0.3 else 1000 + i for i in range(1500)]
    g = graph.document_graph(pa.array([str(a) for a in w[:-1]]), pa.array([str(b) for b in w[1:]]))
    began = time.process_time()
    values = graph.shortest(g)
    once = time.process_time()
    want = graph.betweenness(graph.neighbours_of(g), graph.brandes)
    assert all(abs(want[v] - b) < 1e-9 for v, b in zip(g.names.to_pylist(), values, strict=True)) and 2 * (once - began) < time.process_time() - once


def test_graphs_of_documents_in_one_row(spark):
    """Edges row by row, as arrays, and as several rows of arrays of a document are the same graph; null documents are one, and a
    document without edges between different nodes has no rows."""
    e = spark.createDataFrame([(1, "a", "b"), (1, "b", "c"), (1, "b", "b"), (1, "c", "d"), (None, "x", "y"), (None, "y", "z"), (2, "s", "s"), (3, None, "q")], "doc_id int, source string, target string")
    packed = spark.createDataFrame([(1, ["a", "b"], ["b", "c"]), (1, ["b", "c"], ["b", "d"]), (None, ["x"], ["y"]), (None, ["y"], ["z"]), (2, ["s"], ["s"]), (3, [], [])], "doc_id int, source array<string>, target array<string>")
    for run in (lambda x: graph.per_graph(x, "betweenness"), lambda x: graph.per_graph(x, "communities"), graph.multi_centrality):
        one, two = ({(r["doc_id"], r["node_id"]): round(r["value"], 9) for r in run(x).collect()} for x in (e, packed))
        assert one == two and one.keys() == {*((1, v) for v in "abcd"), *((None, v) for v in "xyz")}


def test_multi_centrality_equals_loops(spark):
    edges = sorted(some_graph(random.Random(5), 14, 30))
    names = sorted({v for e in edges for v in e})
    near = {v: {b for a, b in edges if a == v} | {a for a, b in edges if b == v} for v in names}
    out = {v: {b for a, b in edges if a == v} for v in names}
    rank, value = dict.fromkeys(names, 1 / len(names)), dict.fromkeys(names, 1.0)
    for _ in range(100):
        loose = sum(rank[v] for v in names if not out[v])
        rank = {v: 0.15 / len(names) + 0.85 * (sum(rank[a] / len(out[a]) for a in names if v in out[a]) + loose / len(names)) for v in names}
        value = {v: value[v] + sum(value[w] for w in near[v]) for v in names}
        size = sum(x * x for x in value.values()) ** 0.5
        value = {v: x / size for v, x in value.items()}
    measures = {"degree": {v: len(near[v]) for v in names}, "betweenness": graph.betweenness(near, None), "eigenvector": value, "pagerank": rank}
    scaled = lambda m, v: (m[v] - min(m.values())) / (max(m.values()) - min(m.values()))
    got = graph.multi_centrality(spark.createDataFrame([(1, *e) for e in edges] + [(1, *edges[0])], "doc_id int, source string, target string")).collect()
    assert {r["node_id"]: round(r["value"], 9) for r in got} == {v: round(sum(w * scaled(measures[k], v) for k, w in graph.CENTRALITY.items()), 9) for v in names}


def test_paths_make_no_dead_ends(spark, monkeypatch):
    """A hub with many ways on: only those that can end in time are kept, and every path of a brute-force search is there."""
    edges = [("s", "hub"), ("s", "hub"), *[("hub", f"x{i}") for i in range(300)], ("x7", "t"), ("x8", "s"), ("x8", "t"), ("hub", "t"), ("t", "s"), *[(f"x{i}", f"y{i}") for i in range(300)]]
    e = spark.createDataFrame([(a, b) for a, b in edges], "source string, target string")
    ids = spark.createDataFrame([("s",), ("t",)], "node_id string")
    kept, cut = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: (kept.append(df.columns), kept.append(cut(df).count()), cut(df))[2])
    want, front = [], [["s"], ["t"]]
    for _ in range(3):
        front = [[*p, b] for p in front for a, b in edges if a == p[-1] and b not in p]
        want += [p for p in front if p[-1] in "st"]
    assert sorted(r["path"] for r in graph.paths(e, ids, ids, 3).collect()) == sorted(want)
    fronts = [n for c, n in zip(kept[::2], kept[1::2]) if c == ["path"]]
    assert len(fronts) == 2 and max(fronts) < 20


def test_context_pieces(spark):
    """Lines joined piece by piece are those of one sort, whatever the batches."""
    rng = random.Random(2)
    rows = [(q, f"s{rng.randrange(40)}", "r", f"t{rng.randrange(40)}") for q in ("a", "b") for _ in range(400)]
    lines = spark.createDataFrame(rows, "q string, s string, r string, t string").withColumn("line", F.concat_ws(" ", "s", "r", "t"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "70")
    pieces = retrieve.joined_pieces(lines.repartition(5), "q", ["s", "r", "t"]).collect()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(pieces) > 10
    for q in ("a", "b"):
        assert "\n".join(p["piece"] for p in sorted(pieces, key=lambda p: (p["part"], p["ix"])) if p["q"] == q) == "\n".join(" ".join(r[1:]) for r in sorted(r for r in rows if r[0] == q))


def test_parsed_triples(spark):
    rows = [  # "IBM acquired Red Hat in 2019 ." / "It presents BLIP on COCO ."
        (1, 0, 0, "IBM", "IBM", "PROPN", "nsubj", 1, "ORG", "IBM"), (1, 0, 1, "acquired", "acquire", "VERB", "ROOT", 1, "", None), (1, 0, 2, "Hat", "Hat", "PROPN", "dobj", 1, "ORG", "Red Hat"), (1, 0, 3, "in", "in", "ADP", "prep", 1, "", None), (1, 0, 4, "2019", "2019", "NUM", "pobj", 3, "DATE", "2019"),
        (1, 1, 0, "It", "it", "PRON", "nsubj", 1, "", "It"), (1, 1, 1, "presents", "present", "VERB", "ROOT", 1, "", None), (1, 1, 2, "BLIP", "BLIP", "PROPN", "dobj", 1, "", "the BLIP"), (1, 1, 3, "on", "on", "ADP", "prep", 1, "", None), (1, 1, 4, "COCO", "COCO", "PROPN", "pobj", 3, "", "COCO"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, sent_ix int, i int, text string, lemma string, pos string, dep string, head int, ent_type string, chunk string")
    got = {(r["source"], r["relation"], r["target"]) for r in extract.triples_from_parses(df).collect()}
    assert got == {("IBM", "acquire", "Red Hat"), ("IBM", "acquire in", "2019"), ("BLIP", "present on", "COCO")}


def test_pipeline_and_views(spark, tmp_path):
    text = "# Intro\nGraph models learn graph models from data. Data feeds graph models.\n# References\n[1] A 2401.00001\n"
    docs = spark.createDataFrame([("a", 0, text), ("b", 1, text.replace("data", "light")), ("c", 2, "")], "doc_id string, ord int, content string")
    g = build_corpus_graph(docs, config.load({"adaptive": {"score_floor": 0.05}}))
    s = {r["doc_id"]: r for r in g.doc_summary.collect()}
    assert s["c"]["novelty"] == 0.0 and s["c"]["nodes_in_doc"] == 0
    total = g.corpus_summary.first()
    assert total["total_nodes"] == total["common_nodes"] + total["unique_nodes"] and sum(r["unique_nodes"] for r in s.values()) == total["unique_nodes"]
    sinks.write_graph_json(docs, g.graph, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json/nodes")).count() == total["total_nodes"]
    whole = json.loads(spark.read.text(str(tmp_path / "json/graph")).first()["value"])
    assert len(whole["nodes"]) == total["total_nodes"] and len(whole["edges"]) == total["total_edges"] and whole["summary"]["documents"] == ["a", "b", "c"]
    assert whole["summary"]["per_document"]["c"]["novelty"] == 0.0 and all(n["unique"] == (len(n["docs"]) < 2) for n in whole["nodes"])
    page = sinks.graph_html(g.graph, "a")
    assert "Corpus graph" in page and "<option>b</option>" in page
    r = retrieve.retrieve(g.graph, spark.createDataFrame([("graph models",), ("nothing",)], "query string"), match_on="text")
    context = retrieve.format_context(r, g.graph.nodes).collect()
    assert len(context) == r.matched.select("query").distinct().count() and all(c["context"].startswith("## Relevant Entities\n\n-> **") for c in context)
    ideas = spark.createDataFrame([("zebra",), ("graph models deep",)], "idea string")
    assert {x["idea"]: x["status"] for x in originality.idea_status(ideas, g.graph.nodes).collect()} == {"zebra": "not_found", "graph models deep": "partial"}
    fewer = build_corpus_graph(docs, config.load({"adaptive": {"score_floor": 0.05}, "filter_labels": True}))
    assert 0 < fewer.entities.count() <= g.entities.count()
    with pytest.raises(ValueError):
        build_corpus_graph(docs.limit(0))
    with pytest.raises(ValueError):
        config.load({"discovery": {"pronouns": []}})


def test_context_is_made_once(spark):
    """The whole text is put together where it is returned: no join and no shuffle has it as a column."""
    nodes = spark.createDataFrame([("a", "Alpha", "t"), ("b", "Beta", None), ("c", "Gamma", "t")], "node_id string, text string, entity_type string")
    top = spark.createDataFrame([("q", 1, True, "Alpha", "t"), ("q", 2, False, "Beta", None), ("z", 1, True, "Gamma", "t")], "query string, rank int, is_match boolean, text string, entity_type string")
    rel = spark.createDataFrame([("q", "a", "b", "r"), ("q", "b", "a", "r"), ("q", "a", "b", "n"), ("none", "a", "b", "r")], "query string, source string, target string, relation_type string")
    out = retrieve.format_context(retrieve.Retrieval(None, top, rel, None), nodes)
    assert {r["query"]: r["context"] for r in out.collect()} == {
        "q": "## Relevant Entities\n\n-> **Alpha** (t)\n   **Beta** (unknown)\n\n## Known Relationships\n\n- Alpha --[n]--> Beta\n- Alpha --[r]--> Beta\n- Beta --[r]--> Alpha",
        "z": "## Relevant Entities\n\n-> **Gamma** (t)",
    }
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan[: plan.index("MapInPandas")]


def test_jobs(spark):
    a, steps = jobs.start(spark, topic="Graph nets", mode="deep")
    assert a.first()["id"] == "analysis_graph_nets"
    now = {r["key"]: r["status"] for r in jobs.advance(steps, "segment").collect()}
    assert now == {"parse": "done", "taxonomy": "done", "segment": "running", "extract": "pending", "merge": "pending", "done": "pending"}
    assert {r["status"] for r in jobs.advance(steps, "unknown").collect()} == {"pending"} and {r["status"] for r in jobs.advance(steps, "done").collect()} == {"done"}
    assert [r["key"] for r in jobs.start(spark, seed_url="x")[1].orderBy("ord").collect()] == ["fetch_seed", "references", "fetch_refs", "taxonomy", "extract", "merge", "done"]
    with pytest.raises(ValueError):
        jobs.start(spark)


def paper_table(spark):
    text = "# Intro\nGraph models learn graph models from data. Data feeds graph models.\n# References\n[1] 2401.00002\n[2] 2401.09999\n"
    rows = [("2401.00001", "Graph", "about graph models and graph models", text, "2024", "2024", "http://x/1"), ("2401.00002", "Other", "cited graph models", "cited text of graph models", "2023", "2025", "http://x/2"), ("2401.00003", "Third", "no topic", None, "2022", "2022", None)]
    return spark.createDataFrame(rows, "arxiv_id string, title string, summary string, fulltext string, published string, updated string, pdf_url string")


def test_analyses(spark):
    """Topic and seed runs, quick and deep, to their results; unknown, failed and unfinished ones are errors."""
    runs = jobs.Analyses(spark, paper_table(spark), config.load({"adaptive": {"score_floor": 0.05}}))
    deep = runs.start(seed_url="https://arxiv.org/abs/2401.00001", mode="deep")
    assert deep.status == "completed" and deep.error is None and {s["status"] for s in deep.steps} == {"done"} and deep.progress == 1.0
    result = runs.result(deep.id)
    assert [p["id"] for p in result["papers"]] == ["arxiv:2401.00001", "arxiv:2401.00002"] and result["papers"][0]["title"] == "Graph"
    topics, links = result["topics"].collect(), result["relationships"].collect()
    assert topics and {t["id"] for t in topics} == {x for r in links for x in (r["source"], r["target"])} and {t["source"] for t in topics} <= {"main", "shared", "reference"}
    assert len({r["id"] for r in links}) == len(links) and result["stats"]["total_edges"] == len(links)
    assert runs.subgraph(deep.id, "graph")[0].count() >= 1 and runs.subgraph(deep.id, source="nowhere")[0].count() == 0
    quick = runs.start(topic="graph models")
    assert quick.status == "completed" and len(quick.papers) == 2 and runs.status(quick.id) is quick and [s["key"] for s in quick.steps] == ["taxonomy", "extract", "merge", "done"]
    failed = runs.start(topic="zebra")
    assert failed.status == "error" and "No papers found" in failed.error
    with pytest.raises(ValueError):
        runs.result(failed.id)
    with pytest.raises(LookupError):
        runs.status("analysis_none")


def test_fulltext(spark, tmp_path):
    papers = paper_table(spark)
    source = readers.StoredPapers(papers, "graph no", 10)
    assert [r["doc_id"] for r in source.fetch_fulltext().orderBy("ord").collect()] == ["arxiv:2401.00001", "arxiv:2401.00002"]
    parsed = []

    def parse(d):
        parsed.append(d.count())
        return d.select("doc_id", F.upper("content").alias("content"))

    for _ in range(2):  # the second time all texts are there but the one that can't be parsed
        got = source.fetch_fulltext(str(tmp_path / "cache"), parse).orderBy("doc_id").collect()
        assert len(got) == 2 and got[1]["content"] == "CITED TEXT OF GRAPH MODELS"
    assert parsed == [3, 1]
    have = spark.createDataFrame([("pdfs/2401.00001.pdf",)], "path string")
    assert [r["path"] for r in readers.to_download(papers, "pdfs/", have).collect()] == ["pdfs/2401.00002.pdf"]
    quick = readers.SeedPaper(papers, "https://arxiv.org/abs/2401.00001").fetch_abstracts(spark).orderBy("ord").collect()
    assert quick[0]["content"].startswith("# Intro") and quick[1]["content"] == "cited graph models"


def make_reader():
    made.append(1)
    return lambda body: (body.decode(), body.count(b"page"))


made: list = []


def test_converters(spark, tmp_path):
    """A converter is built once, files beyond the page limit and broken ones are left out."""
    for name, body in (("a", b"page one page two"), ("b", b"page " * 9), ("c", b"\xff\xfe")):
        (tmp_path / f"{name}.pdf").write_bytes(body)
    source = readers.LocalFiles(str(tmp_path), "pdf", 5, readers.convert_with(make_reader))
    assert [(r["doc_id"], r["content"]) for r in source.fetch(spark).collect()] == [("a", "page one page two")]
    assert readers.once(make_reader) is readers.once(make_reader) and made == [1]
    with pytest.raises(ValueError):
        readers.LocalFiles(str(tmp_path), "pdf")


def test_reports(spark):
    phases = spark.createDataFrame([("parse", 1.0), ("merge", 3.0)], "phase string, seconds double")
    report = json.loads(sinks.timing_report(phases, {"cpus": 8}, spark.range(1).withColumn("total_nodes", F.lit(5))).first()["value"])
    assert report["phases"][0] == {"phase": "merge", "seconds": 3.0, "share": 75.0} and report["environment"] == {"cpus": "8"} and report["summary"]["total_nodes"] == 5
    answers = spark.createDataFrame([(1, '{"name": "x"}'), (2, "no json")], "id int, response string")
    assert [r["parsed"] and r["parsed"]["name"] for r in extract.parse_structured(answers, "name string").orderBy("id").collect()] == ["x", None]


def test_topics_from_parses(spark):
    """A parser's triples grow topics from the seeds, and what they reach becomes labels."""
    docs = spark.createDataFrame([("a", 0, "Payments to banks. Payments to banks matter.")], "doc_id string, ord int, content string")

    def parser(sections):
        rows = [("a", 0, 0, "Payments", "payment", "NOUN", "nsubj", 1, "", "Payments"), ("a", 0, 1, "reached", "reach", "VERB", "ROOT", 1, "", None), ("a", 0, 2, "Equifax", "Equifax", "PROPN", "dobj", 1, "ORG", "Equifax")]
        return spark.createDataFrame(rows, "doc_id string, sent_ix int, i int, text string, lemma string, pos string, dep string, head int, ent_type string, chunk string")

    g = build_corpus_graph(docs, config.load({"adaptive": {"score_floor": 0.05}}), parser=parser)
    assert {(r["src"], r["relation"], r["dst"]) for r in g.topics[1].collect()} == {("payments", "reach", "equifax")}
    labels = {(r["kind"], r["label"]) for r in g.labels.collect()}
    assert ("entity", "equifax") in labels and ("relation", "reach") in labels
    start = g.topics[0].where("depth = 0").select("doc_id", "key", "pos")
    topic = json.loads(sinks.topic_json(g.topics[0], g.topics[1], start).first()["value"])
    assert "payments" in topic["seeds"] and topic["edges"][0]["target"] == "equifax"


def test_louvain():
    clique = lambda names: {a: [b for b in names if b != a] for a in names}
    adj = clique("abcd") | clique("efgh") | clique("ijkl")
    for x, y in (("d", "e"), ("h", "i")):
        adj[x].append(y)
        adj[y].append(x)
    got = graph.louvain(adj)
    assert got == {v: float(i) for i, group in enumerate(("abcd", "efgh", "ijkl")) for v in group}
    ring = {i: [(i - 1) % 30, (i + 1) % 30] for i in range(30)}  # single moves make pairs, whole communities join further
    assert len(set(graph.louvain(ring).values())) < 10 and graph.louvain({}) == {}


def test_multi_centrality(spark):
    e = spark.createDataFrame([(1, "a", "b"), (1, "b", "c"), (1, "c", "d"), (2, "x", "y")], "doc_id int, source string, target string")
    got = {(r["doc_id"], r["node_id"]): r["value"] for r in graph.multi_centrality(e).collect()}
    assert got[1, "a"] < got[1, "b"] and got[1, "a"] < got[1, "c"] and 0 <= min(got.values()) and max(got.values()) <= 1 + 1e-9
    assert abs(got[2, "x"]) < 1e-9 and abs(got[2, "y"] - 0.3) < 1e-6  # only the ranks of two differ


def test_sources(spark, tmp_path):
    (tmp_path / "b.txt").write_text("bee")
    (tmp_path / "a.txt").write_text("ay\nay")
    (tmp_path / "x.json").write_text(json.dumps({"text": "hello", "year": 3}))
    (tmp_path / "y.csv").write_text("text,year\nhi,4\n")
    got = readers.build_source({"type": "local_files", "folder": str(tmp_path)}).fetch(spark).orderBy("ord").collect()
    assert [(r["doc_id"], r["content"]) for r in got] == [("a", "ay\nay"), ("b", "bee")]
    x = readers.LocalFiles(str(tmp_path), "json").fetch(spark).first()
    assert x["content"] == "hello" and json.loads(x["metadata"]) == {"year": "3"}
    assert readers.LocalFiles(str(tmp_path), "csv").fetch(spark).first()["content"] == "hi"
    papers = spark.createDataFrame([("2401.00001", "Graph", "about graphs", "x\n# References\n[1] 2401.00002\n[2] 2401.09999", "2024"), ("2401.00002", "Other", "cited", "y", "2023")], "arxiv_id string, title string, summary string, fulltext string, published string")
    seed = readers.build_source({"type": "seed_paper", "seed_url": "https://arxiv.org/abs/2401.00001"}, papers).fetch(spark).orderBy("ord").collect()
    assert [r["doc_id"] for r in seed] == ["arxiv:2401.00001", "arxiv:2401.00002"]
    assert readers.StoredPapers(papers, "graph").fetch().count() == 1
    for bad in ({"type": "nope"}, {"type": "arxiv"}, {"type": "seed_paper"}):
        with pytest.raises(ValueError):
            readers.build_source(bad, papers)


def test_accumulated_equals_rebuild(spark, tmp_path):
    rows = mention_rows(random.Random(5))
    m = spark.createDataFrame(rows, MENTION)
    acc = AccumulatedGraph(spark, str(tmp_path / "acc"))
    for b in range(3):
        acc.add(m.where(F.col("doc_id") % 3 == b), b)
    acc.add(m.where(F.col("doc_id") % 3 == 1), 1)  # a replayed batch
    key = lambda df: {(r["node_id"], r["canonical"], r["score"], r["n_mentions"], r["n_docs"], r["first_doc"]) for r in df.collect()}
    assert key(acc.nodes()) == key(merge.nodes_of(merge.node_observations(m)))
    src = str(tmp_path / "in")
    m.write.parquet(src)
    live = AccumulatedGraph(spark, str(tmp_path / "live"))
    live.stream(spark.readStream.schema(m.schema).parquet(src), str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    assert key(live.nodes()) == key(acc.nodes())


def test_accumulated_edges_equal_rebuild(spark, tmp_path):
    m = spark.createDataFrame(mention_rows(random.Random(5)), MENTION)
    relate = lambda df: extract.adjacent_relations(df, F.when(F.col("score") > 0.5, "r").otherwise("s"), F.col("score"))
    whole = merge.merge_graph(m, relate(m))
    nodes, edges = whole.nodes, whole.edges
    key = lambda df: {(r["source"], r["target"], r["relation_type"], r["score"], r["n_seen"], r["n_docs"], r["first_doc"]) for r in df.collect()}
    acc = AccumulatedGraph(spark, str(tmp_path / "acc"))
    for b in (2, 0, 1, 0):  # later documents first, and a replayed batch
        part = m.where(F.col("doc_id") % 3 == b)
        acc.add(part, b, relate(part))
    assert key(acc.edges()) == key(edges) and len(key(edges)) > 5
    assert {r["node_id"] for r in acc.nodes().collect()} == {r["node_id"] for r in nodes.collect()}
    for a, b in ((acc.graph().node_docs, whole.node_docs), (acc.graph().edge_docs, whole.edge_docs)):
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    src = str(tmp_path / "in")
    m.coalesce(1).write.parquet(src)
    live = AccumulatedGraph(spark, str(tmp_path / "live"))
    live.stream(spark.readStream.schema(m.schema).parquet(src), str(tmp_path / "ck"), relate).trigger(availableNow=True).start().awaitTermination()
    assert key(live.edges()) == key(edges)


def test_running_sums(spark):
    rng = random.Random(8)
    values = rng.sample(range(1000), 200)
    df = spark.createDataFrame([(v, rng.randrange(9)) for v in values], "v int, n int").repartition(7)
    want, total = {}, 0
    for r in sorted(df.collect()):
        want[r["v"]], total = total, total + r["n"]
    assert {r["v"]: r["before"] for r in running(df, [F.col("v")], {"before": F.col("n")}).collect()} == want
    assert {r["v"]: r["at"] for r in running(df, [F.desc("v")], {"at": F.lit(1)}).collect()} == {v: i for i, v in enumerate(sorted(values, reverse=True))}
    assert running(df.limit(0), [F.col("v")], {"at": F.lit(1)}).count() == 0


def test_summary_rounding(spark):
    rows = [(str(i), 1 if i == 0 else 2, 1) for i in range(16)]
    nodes = spark.createDataFrame(rows, "node_id string, n_docs long, first_doc long")
    edges = spark.createDataFrame([], "source string, target string, n_docs long, first_doc long")
    node_docs = spark.createDataFrame([(i, d) for i, n, _ in rows for d in range(1, n + 1)], "node_id string, doc_id long")
    docs = spark.createDataFrame([(1,), (3,)], "doc_id long")
    assert {r["doc_id"]: r["novelty"] for r in summary.doc_novelty(docs, merge.Graph(nodes, edges, node_docs, edges)).collect()} == {1: 0.063, 3: 0.0}


def test_adjacent_in_row_equals_mentions(spark):
    """Neighbours made inside a row are those that a window over the mentions finds."""
    rows = spark.createDataFrame([(1, 1, 0, ["a", "bb", "c"]), (2, 2, 0, ["x"]), (3, 3, 0, [])], "doc_id long, doc_ord long, segment_ix int, w array<string>")
    m = rows.select("doc_id", "doc_ord", "segment_ix", F.posexplode("w").alias("pos", "text")).withColumn("label", F.lit("l"))
    kind, score = F.length("text").cast("string"), F.length("next_text").cast("double")
    one, two = (sorted(map(tuple, x.collect())) for x in (extract.adjacent_in_row(rows, "w", kind, score), extract.adjacent_relations(m, kind, score)))
    assert one == two and len(one) == 2
