"""Queries over the test tables for the engine's operators, each with the SQL that gives the same rows.

The graph queries build a graph from `documents`: words of five letters or more are entity mentions (type: the
document's language), neighbouring ones are relations, and a document's id is its place in the order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgraph.functions import text as fn
from corpusgraph.operators import discovery, extract, graph, merge, originality, retrieve, segment, structure, summary
from corpusgraph.operators.order import running
from corpusgraph.operators.state import cut
from corpusgraph.plans.config import Discovery
from corpusgraph.plans import jobs
from corpusgraph.sources import readers, sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pair(g: merge.Graph) -> tuple[DataFrame, DataFrame]:
    return g.nodes, g.edges


def joined(c: str = "docs"):
    return F.array_join(F.transform(F.col(c), lambda x: x.cast("string")), "|")


# --- the graph of documents ----------------------------------------------------------------------------------------


def word_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, doc_ord, segment_ix, lang, w): each document's words of five letters or more, in order."""
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"(\p{L}{5,})"), 1)
    return table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").alias("doc_ord"), F.lit(0).alias("segment_ix"), "lang", words.alias("w"))


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = word_rows(spark, sf_dir).select("doc_id", "doc_ord", "segment_ix", F.col("lang").alias("label"), F.posexplode("w").alias("pos", "text"))
    return docs.select("doc_id", "doc_ord", "segment_ix", "pos", "text", "label", (F.length("text") % 10 / 10).alias("score"))


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.length("text") >= F.length("next_text"), "broader").otherwise("narrower")
    return extract.adjacent_in_row(word_rows(spark, sf_dir), "w", kind, (F.length("text") + F.length("next_text")) % 10 / 10)


def corpus(spark: SparkSession, sf_dir: str, keep: bool = False) -> merge.Graph:
    g = merge.merge_graph(mentions(spark, sf_dir), relations(spark, sf_dir))
    if keep:
        g.edges = cut(g.edges)
    return g


GRAPH = r"""
m AS MATERIALIZED (SELECT doc_id, pos, text, label, (length(text) % 10) / 10.0 AS score, lower(text) AS canonical FROM (
  SELECT doc_id, lang AS label, unnest(w) AS text, unnest(range(len(w))) AS pos FROM (SELECT doc_id, lang, regexp_extract_all(coalesce(text, ''), '\p{L}{5,}') AS w FROM documents))),
nodes AS MATERIALIZED (SELECT substr(md5(label || ':' || lower(text)), 1, 12) AS node_id, canonical, text, label AS entity_type, score, n_mentions, docs, first_ord FROM (
  SELECT canonical, arg_min(text, (doc_id, pos)) AS text, arg_min(label, (doc_id, pos)) AS label, max(score) AS score, count(*) AS n_mentions, list_sort(list(DISTINCT doc_id)) AS docs, min(doc_id) AS first_ord FROM m GROUP BY canonical)),
rel AS MATERIALIZED (SELECT doc_id, pos, canonical AS head, lead(canonical) OVER w AS tail, CASE WHEN length(text) >= length(lead(text) OVER w) THEN 'broader' ELSE 'narrower' END AS relation_type,
  ((length(text) + length(lead(text) OVER w)) % 10) / 10.0 AS score FROM m WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
edges AS MATERIALIZED (SELECT h.node_id AS source, t.node_id AS target, relation_type, max(r.score) AS score, count(*) AS n_seen, list_sort(list(DISTINCT doc_id)) AS docs
  FROM rel r JOIN nodes h ON r.head = h.canonical JOIN nodes t ON r.tail = t.canonical WHERE r.tail IS NOT NULL GROUP BY ALL),
ends AS (SELECT source AS node_id FROM edges UNION ALL SELECT target FROM edges),
both_ways AS MATERIALIZED (SELECT DISTINCT a, b FROM (SELECT source AS a, target AS b FROM edges UNION ALL SELECT target, source FROM edges) WHERE a <> b),
starts AS MATERIALIZED (SELECT node_id FROM nodes WHERE canonical IN ('thing', 'thble', 'thtion', 'nicht', 'ering'))"""


def with_graph(sql: str) -> str:
    return f"WITH {GRAPH}\n{sql}"


def starts(nodes: DataFrame) -> DataFrame:
    return nodes.where(F.col("canonical").isin("thing", "thble", "thtion", "nicht", "ering")).select("node_id")


@query(with_graph("SELECT node_id, canonical, text, entity_type, score::DOUBLE AS score, n_mentions, array_to_string(docs, '|') AS docs, first_ord FROM nodes"))
def corpus_nodes(spark, sf_dir):
    g = corpus(spark, sf_dir)
    return merge.with_docs(g.nodes, g.node_docs, ["node_id"]).select("node_id", "canonical", "text", "entity_type", "score", "n_mentions", joined().alias("docs"), "first_ord")


@query(with_graph("SELECT source, target, relation_type, score::DOUBLE AS score, n_seen, array_to_string(docs, '|') AS docs, docs[1] AS first_doc FROM edges"))
def corpus_edges(spark, sf_dir):
    g = corpus(spark, sf_dir)
    return merge.with_docs(g.edges, g.edge_docs, sinks.EDGE).select(*sinks.EDGE, "score", "n_seen", joined().alias("docs"), "first_doc")


@query(with_graph("SELECT (SELECT count(*) FROM nodes) AS total_nodes, (SELECT count(*) FROM nodes WHERE len(docs) > 1) AS common_nodes, (SELECT count(*) FROM nodes WHERE len(docs) < 2) AS unique_nodes, (SELECT count(*) FROM edges) AS total_edges, (SELECT count(*) FROM edges WHERE len(docs) > 1) AS common_edges, (SELECT count(*) FROM edges WHERE len(docs) < 2) AS unique_edges"))
def corpus_summary(spark, sf_dir):
    return summary.corpus_summary(*pair(corpus(spark, sf_dir)))


NOVELTY = """, n AS (SELECT d, count(*) AS nodes_in_doc, count(*) FILTER (u) AS unique_nodes FROM (SELECT unnest(docs) AS d, len(docs) = 1 AS u FROM nodes) GROUP BY d),
e AS (SELECT docs[1] AS d, count(*) AS unique_edges FROM edges WHERE len(docs) = 1 GROUP BY 1)"""


@query(f"WITH {GRAPH}{NOVELTY} SELECT doc_id, coalesce(nodes_in_doc, 0) AS nodes_in_doc, coalesce(unique_nodes, 0) AS unique_nodes, coalesce(unique_edges, 0) AS unique_edges, coalesce(round(unique_nodes / nodes_in_doc, 3), 0)::DOUBLE AS novelty FROM documents LEFT JOIN n ON doc_id = n.d LEFT JOIN e ON doc_id = e.d")
def doc_novelty(spark, sf_dir):
    return summary.doc_novelty(table(spark, sf_dir, "documents"), corpus(spark, sf_dir))


@query(f"WITH {GRAPH}{NOVELTY} SELECT doc_id, n_chars, (len(string_split(text, chr(10))))::BIGINT AS n_lines, (SELECT count(*) FROM m WHERE m.doc_id = documents.doc_id) AS n_mentions, coalesce(round(unique_nodes / nodes_in_doc, 3), 0)::DOUBLE AS novelty FROM documents LEFT JOIN n ON doc_id = n.d")
def doc_breakdown(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    nov = doc_novelty(spark, sf_dir).select(F.col("doc_id").alias("d"), "novelty")
    n = mentions(spark, sf_dir).groupBy(F.col("doc_id").alias("d2")).agg(F.count(F.lit(1)).alias("n_mentions"))
    out = d.join(nov, F.col("doc_id") == F.col("d")).join(n, F.col("doc_id") == F.col("d2"), "left")
    return out.select("doc_id", "n_chars", F.size(F.split("text", "\n")).cast("long").alias("n_lines"), F.coalesce("n_mentions", F.lit(0)).cast("long").alias("n_mentions"), "novelty")


@query(with_graph("SELECT e AS entities, r AS relations, round(2 * r / greatest(e, 1), 6)::DOUBLE AS avg_degree FROM (SELECT count(*) AS e FROM nodes), (SELECT count(*) AS r FROM edges)"))
def graph_stats(spark, sf_dir):
    return summary.graph_stats(*pair(corpus(spark, sf_dir)))


@query(with_graph("SELECT coalesce(entity_type, 'unknown') AS entity_type, count(*) AS n_nodes FROM nodes GROUP BY 1"))
def type_counts(spark, sf_dir):
    return summary.type_counts(corpus(spark, sf_dir).nodes)


@query(with_graph("SELECT source, target, relation_type, round(1 + 3 * score::DOUBLE / top, 6) AS width, round(0.35 + 0.65 * (score::DOUBLE / top), 6) AS opacity FROM edges, (SELECT greatest(coalesce(max(score), 0), 0.01)::DOUBLE AS top FROM edges)"))
def edge_weights(spark, sf_dir):
    return summary.edge_weights(corpus(spark, sf_dir).edges)


@query(with_graph("SELECT node_id, canonical FROM nodes WHERE node_id IN (SELECT node_id FROM ends)"))
def orphan_filter(spark, sf_dir):
    n, e = pair(corpus(spark, sf_dir))
    return summary.without_orphans(n, e).select("node_id", "canonical")


CLASS = "CASE WHEN len(docs) > 1 THEN 'shared' WHEN list_contains(docs, 0) THEN 'main' ELSE 'reference' END"


@query(with_graph(f"SELECT node_id, {CLASS} AS source_class, round(score::DOUBLE * 10, 1) AS importance FROM nodes"))
def source_class(spark, sf_dir):
    n = summary.with_source_class(corpus(spark, sf_dir).nodes, F.lit(0).cast("long"))
    return n.select("node_id", "source_class", F.round(F.col("score") * 10, 1).alias("importance"))


@query(with_graph(f"SELECT source, target, relation_type FROM edges WHERE source IN (SELECT node_id FROM nodes WHERE {CLASS} = 'shared') AND target IN (SELECT node_id FROM nodes WHERE {CLASS} = 'shared')"))
def source_filter(spark, sf_dir):
    n, e = pair(corpus(spark, sf_dir))
    n = summary.with_source_class(n, F.lit(0).cast("long"))
    return summary.keep_nodes(n, e, F.col("source_class") == "shared")[1].select("source", "target", "relation_type")


@query(with_graph("SELECT node_id, text FROM nodes WHERE len(docs) > 1 OR list_contains(docs, 7)"))
def doc_filter(spark, sf_dir):
    g = corpus(spark, sf_dir)
    return g.nodes.where("n_docs > 1").union(g.nodes.where("n_docs = 1").join(originality.nodes_in(g, F.lit(7)), "node_id", "left_semi").select(g.nodes.columns)).select("node_id", "text")


@query(with_graph("SELECT node_id, degree FROM (SELECT node_id, count(*) AS degree FROM ends GROUP BY 1)"))
def degree_centrality(spark, sf_dir):
    return summary.degrees(corpus(spark, sf_dir).edges)


@query(with_graph("SELECT item_id, node_id FROM (SELECT item_id, unnest(list_distinct(regexp_extract_all(lower(text), '\\p{L}{5,}'))) AS k FROM benchmark) JOIN nodes ON k = canonical"))
def find_by_text(spark, sf_dir):
    q = table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}{5,})"), 1))).alias("query"))
    hit = retrieve.match(corpus(spark, sf_dir).nodes, q.select("query"), "text")
    return q.join(hit, "query").select("item_id", "node_id")


@query(with_graph("SELECT 'FR' AS query, node_id FROM nodes WHERE entity_type = 'fr'"))
def find_by_type(spark, sf_dir):
    return retrieve.match(corpus(spark, sf_dir).nodes, spark.range(1).select(F.lit("FR").alias("query")), "type")


@query(with_graph("SELECT a AS start, b AS node_id, 1 AS hops FROM both_ways WHERE a IN (SELECT node_id FROM starts)"))
def neighbors_1(spark, sf_dir):
    n, e = pair(corpus(spark, sf_dir, True))
    return graph.neighbours(e, starts(n).withColumnRenamed("node_id", "start"), 1)


K_HOP = """, h1 AS (SELECT a AS start, b AS node_id FROM both_ways WHERE a IN (SELECT node_id FROM starts)),
h2 AS (SELECT DISTINCT start, b AS node_id FROM h1 JOIN both_ways ON node_id = a WHERE b <> start),
near AS (SELECT start, node_id, min(hops) AS hops FROM (SELECT *, 1 AS hops FROM h1 UNION ALL SELECT *, 2 FROM h2) GROUP BY 1, 2)"""


@query(f"WITH {GRAPH}{K_HOP} SELECT start, node_id, hops FROM near")
def neighbors_k(spark, sf_dir):
    n, e = pair(corpus(spark, sf_dir, True))
    return graph.neighbours(e, starts(n).withColumnRenamed("node_id", "start"), 2)


@query(f"WITH {GRAPH}{K_HOP}, ids AS (SELECT node_id FROM near WHERE hops = 1 UNION SELECT node_id FROM starts) SELECT source, target, relation_type, n_seen FROM edges WHERE source IN (SELECT node_id FROM ids) AND target IN (SELECT node_id FROM ids)")
def subgraph(spark, sf_dir):
    n, e = pair(corpus(spark, sf_dir, True))
    s = starts(n)
    ids = graph.neighbours(e, s.withColumnRenamed("node_id", "start"), 1).select("node_id").union(s).distinct()
    return graph.subgraph(n, e, ids)[1].select("source", "target", "relation_type", "n_seen")


PATHS = """, x AS MATERIALIZED (SELECT source AS s, target AS t FROM edges WHERE source <> target),
p1 AS MATERIALIZED (SELECT [s, t] AS p FROM x WHERE s IN (SELECT node_id FROM starts)),
p2 AS MATERIALIZED (SELECT list_append(p, t) AS p FROM p1 JOIN x ON p[2] = s WHERE NOT list_contains(p, t)),
p3 AS MATERIALIZED (SELECT list_append(p, t) AS p FROM p2 JOIN (SELECT x.* FROM x JOIN starts ON t = node_id) y ON p[3] = y.s WHERE NOT list_contains(p, y.t))"""


@query(f"WITH {GRAPH}{PATHS} SELECT array_to_string(p, '>') AS path, (len(p) - 1)::INTEGER AS length FROM (SELECT p FROM p1 UNION ALL SELECT p FROM p2 UNION ALL SELECT p FROM p3) WHERE p[-1] IN (SELECT node_id FROM starts)")
def find_paths(spark, sf_dir):
    n, e = pair(corpus(spark, sf_dir, True))
    return graph.paths(e, starts(n), starts(n)).select(F.array_join("path", ">").alias("path"), "length")


@query(with_graph("SELECT s.node_id, 'out' AS direction, relation_type, n.text AS other_text, n.entity_type AS other_type, e.score::DOUBLE AS score FROM starts s JOIN edges e ON e.source = s.node_id JOIN nodes n ON n.node_id = e.target UNION ALL SELECT s.node_id, 'in', relation_type, n.text, n.entity_type, e.score::DOUBLE FROM starts s JOIN edges e ON e.target = s.node_id JOIN nodes n ON n.node_id = e.source"))
def entity_context(spark, sf_dir):
    n, e = pair(corpus(spark, sf_dir, True))
    return graph.entity_context(n, e, starts(n))


WANTED = ["thing", "thble", "thtion", "nicht", "ering"]
FOUND = f"""{K_HOP}, f AS (SELECT canonical AS query, node_id, true AS is_match FROM nodes WHERE node_id IN (SELECT node_id FROM starts)
  UNION ALL SELECT n.canonical, near.node_id, false FROM near JOIN nodes n ON n.node_id = start),
g AS (SELECT query, node_id, bool_or(is_match) AS is_match FROM f GROUP BY 1, 2), dg AS (SELECT node_id, count(*) AS degree FROM ends GROUP BY 1),
r AS (SELECT g.*, coalesce(degree, 0) AS degree, row_number() OVER (PARTITION BY query ORDER BY is_match DESC, coalesce(degree, 0) DESC, node_id) AS rank FROM g LEFT JOIN dg USING (node_id))"""


def retrieval(spark, sf_dir, depth=2):
    g = corpus(spark, sf_dir, True)
    return g, retrieve.retrieve(g, spark.createDataFrame([(w,) for w in WANTED], "query string"), 5, depth, "text")


@query(f"WITH {GRAPH}{FOUND} SELECT query, node_id, is_match, degree, rank::INTEGER AS rank FROM r WHERE rank <= 5")
def retrieve_ranked(spark, sf_dir):
    return retrieval(spark, sf_dir)[1].expanded.select("query", "node_id", "is_match", "degree", "rank")


@query(f"WITH {GRAPH}{FOUND} SELECT DISTINCT query, unnest(docs) AS doc_id FROM g JOIN nodes USING (node_id)")
def context_docs(spark, sf_dir):
    return retrieval(spark, sf_dir)[1].documents


@query(f"""WITH {GRAPH}{FOUND.replace('near.node_id, false FROM near JOIN', 'near.node_id, false FROM (SELECT * FROM near WHERE hops = 1) near JOIN')},
ent AS (SELECT query, string_agg(CASE WHEN is_match THEN '-> ' ELSE '   ' END || '**' || text || '** (' || coalesce(entity_type, 'unknown') || ')', chr(10) ORDER BY rank) AS t FROM r JOIN nodes USING (node_id) WHERE rank <= 5 GROUP BY query),
rl AS (SELECT a.query, string_agg('- ' || x.text || ' --[' || relation_type || ']--> ' || y.text, chr(10) ORDER BY x.text, relation_type, y.text) AS t
  FROM edges JOIN g a ON a.node_id = source JOIN g b ON b.node_id = target AND b.query = a.query JOIN nodes x ON x.node_id = source JOIN nodes y ON y.node_id = target GROUP BY a.query)
SELECT ent.query, '## Relevant Entities' || chr(10) || chr(10) || ent.t || coalesce(chr(10) || chr(10) || '## Known Relationships' || chr(10) || chr(10) || rl.t, '') AS context FROM ent LEFT JOIN rl ON rl.query = ent.query""")
def format_context(spark, sf_dir):
    g, found = retrieval(spark, sf_dir, 1)
    return retrieve.format_context(found, g.nodes)


def _pagerank_sql(links: str, rounds: int) -> str:
    ctes = [f"l AS ({links})", "ids AS (SELECT s AS id FROM l UNION SELECT t FROM l)", "o AS (SELECT s, count(*) AS n FROM l GROUP BY s)", "c AS (SELECT count(*)::DOUBLE AS n FROM ids)", "p0 AS (SELECT id, 1 / c.n AS r FROM ids, c)"]
    for i in range(rounds):
        ctes.append(f"p{i + 1} AS (SELECT ids.id, 0.15 / c.n + 0.85 * (coalesce(g.got, 0) + z.loose / c.n) AS r FROM ids CROSS JOIN c CROSS JOIN (SELECT coalesce(sum(r), 0) AS loose FROM p{i} WHERE id NOT IN (SELECT s FROM o)) z LEFT JOIN (SELECT l.t, sum(p.r / o.n) AS got FROM l JOIN p{i} p ON p.id = l.s JOIN o ON o.s = l.s GROUP BY l.t) g ON g.t = ids.id)")
    return f"WITH {GRAPH}, " + ", ".join(ctes) + f" SELECT id AS node_id, round(r * 1e4, 6) AS rank FROM p{rounds}"


@query(_pagerank_sql("SELECT DISTINCT source AS s, target AS t FROM edges", 5))
def pagerank_5(spark, sf_dir):
    return graph.pagerank(corpus(spark, sf_dir, True).edges, 5).withColumn("rank", F.round(F.col("rank") * 1e4, 6))


@query(_pagerank_sql("SELECT a AS s, b AS t FROM both_ways", 3))
def textrank_words(spark, sf_dir):
    pairs = graph.both_ways(corpus(spark, sf_dir, True).edges).toDF("source", "target")
    return graph.pagerank(pairs, 3).withColumn("rank", F.round(F.col("rank") * 1e4, 6))


def measures(spark, sf_dir):
    n, e = pair(corpus(spark, sf_dir, True))
    d = summary.degrees(e)
    return cut(n.join(d, "node_id").select("node_id", F.col("degree").cast("double").alias("degree"), F.col("n_mentions").cast("double").alias("n_mentions"), F.col("n_docs").cast("double").alias("n_docs")))


MEASURES = "x AS (SELECT node_id, degree::DOUBLE AS degree, n_mentions::DOUBLE AS n_mentions, len(docs)::DOUBLE AS n_docs FROM nodes JOIN (SELECT node_id, count(*) AS degree FROM ends GROUP BY 1) USING (node_id))"
SCALED = lambda c: f"(({c} - min({c}) OVER ()) / CASE WHEN max({c}) OVER () = min({c}) OVER () THEN 1 ELSE max({c}) OVER () - min({c}) OVER () END)"


@query(f"WITH {GRAPH}, {MEASURES} SELECT node_id, round(0.3 * {SCALED('degree')} + 0.5 * {SCALED('n_mentions')} + 0.2 * {SCALED('n_docs')}, 6) AS centrality FROM x")
def centrality_index(spark, sf_dir):
    m = graph.min_max(measures(spark, sf_dir), ["degree", "n_mentions", "n_docs"])
    return m.select("node_id", F.round(F.lit(0.3) * F.col("degree") + F.lit(0.5) * F.col("n_mentions") + F.lit(0.2) * F.col("n_docs"), 6).alias("centrality"))


AVERAGE_RANK = lambda c: f"(rank() OVER (ORDER BY {c} DESC) + (count(*) OVER (PARTITION BY {c}) - 1) / 2)"


@query(f"WITH {GRAPH}, {MEASURES} SELECT node_id, ({AVERAGE_RANK('degree')} + {AVERAGE_RANK('n_docs')})::DOUBLE AS rank_sum FROM x")
def rank_sum(spark, sf_dir):
    return graph.rank_sum(measures(spark, sf_dir), ["degree", "n_docs"]).select("node_id", "rank_sum")


@query(f"WITH {GRAPH}, {MEASURES}, a AS (SELECT node_id FROM x ORDER BY degree DESC, node_id LIMIT 20), b AS (SELECT node_id FROM x ORDER BY n_docs DESC, node_id LIMIT 20) SELECT coalesce(a.node_id, b.node_id) AS node_id, CASE WHEN b.node_id IS NULL THEN 'degree' WHEN a.node_id IS NULL THEN 'docs' ELSE 'both' END AS side FROM a FULL JOIN b ON a.node_id = b.node_id")
def set_overlap(spark, sf_dir):
    m = measures(spark, sf_dir)
    top = lambda c, n: m.orderBy(F.desc(c), "node_id").limit(20).select(F.col("node_id").alias(n))
    side = F.when(F.col("b").isNull(), "degree").when(F.col("a").isNull(), "docs").otherwise("both")
    return top("degree", "a").join(top("n_docs", "b"), F.col("a") == F.col("b"), "full").select(F.coalesce("a", "b").alias("node_id"), side.alias("side"))


@query(with_graph("SELECT node_id, text, len(docs)::BIGINT AS n_docs FROM nodes WHERE len(docs) > 1"))
def shared_topics(spark, sf_dir):
    return originality.shared(corpus(spark, sf_dir).nodes).select("node_id", "text", "n_docs")


@query(with_graph("SELECT source, target, relation_type, len(docs)::BIGINT AS n_docs FROM edges WHERE len(docs) > 1"))
def shared_relations(spark, sf_dir):
    return originality.shared(corpus(spark, sf_dir).edges).select("source", "target", "relation_type", "n_docs")


FIRST_OWN = "(SELECT min(docs[1]) FROM nodes WHERE len(docs) = 1)"


@query(with_graph(f"SELECT node_id, text, CASE WHEN score >= 0.8 THEN 'high' WHEN score >= 0.6 THEN 'medium' ELSE 'low' END AS band FROM nodes WHERE len(docs) = 1 AND docs[1] = {FIRST_OWN}"))
def unique_topics(spark, sf_dir):
    """For the first document that has any."""
    n = corpus(spark, sf_dir).nodes
    first = n.where("n_docs = 1").agg(F.min("first_doc")).first()[0]
    return originality.unique_to(n, F.lit(first)).select("node_id", "text", originality.band(F.col("score")).alias("band"))


MAIN = ", inside AS MATERIALIZED (SELECT node_id FROM nodes WHERE list_contains(docs, 1))"


@query(f"WITH {GRAPH}{MAIN}, near AS (SELECT target AS node_id FROM edges JOIN inside ON source = node_id UNION SELECT source FROM edges JOIN inside ON target = node_id) SELECT n.node_id, text FROM nodes n ANTI JOIN near USING (node_id) WHERE NOT list_contains(docs, 1)")
def missing_topics(spark, sf_dir):
    return originality.missing_topics(corpus(spark, sf_dir, True), F.lit(1)).select("node_id", "text")


@query(f"WITH {GRAPH}{MAIN} SELECT source, target, relation_type FROM edges SEMI JOIN inside a ON source = a.node_id SEMI JOIN inside b ON target = b.node_id WHERE NOT list_contains(docs, 1)")
def missing_relations(spark, sf_dir):
    return originality.missing_relations(corpus(spark, sf_dir, True), F.lit(1)).select("source", "target", "relation_type")


@query(f"WITH {GRAPH}{MAIN}, near AS (SELECT id, sum(n) AS n FROM (SELECT target AS id, len(docs) AS n FROM edges JOIN inside ON source = node_id UNION ALL SELECT source, len(docs) FROM edges JOIN inside ON target = node_id) GROUP BY id) SELECT node_id, text, CASE WHEN coalesce(n, 0) > 0 THEN 'weak' ELSE 'none' END AS evidence FROM nodes LEFT JOIN near ON node_id = id WHERE len(docs) > 1 AND NOT list_contains(docs, 1)")
def topic_gaps(spark, sf_dir):
    return originality.topic_gaps(corpus(spark, sf_dir, True), F.lit(1))


@query(with_graph("SELECT least(source, target) AS a, greatest(source, target) AS b, sum(n_seen)::BIGINT AS n_seen FROM edges WHERE source <> target AND source IN (SELECT node_id FROM nodes WHERE len(docs) > 1) AND target IN (SELECT node_id FROM nodes WHERE len(docs) > 1) GROUP BY 1, 2 HAVING sum(n_seen) <= 1"))
def underexplored(spark, sf_dir):
    return originality.underexplored(corpus(spark, sf_dir, True))


@query(with_graph("SELECT i.w AS idea, i.w AS canonical, CASE WHEN n.canonical IS NULL THEN 'not_found' ELSE 'found' END AS status FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '\\p{L}{5,}')) AS w FROM benchmark) i LEFT JOIN nodes n ON n.canonical = i.w"))
def idea_check(spark, sf_dir):
    ideas = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}{5,})"), 1)).alias("idea")).distinct()
    return originality.idea_status(ideas, corpus(spark, sf_dir).nodes.select("canonical"))


HALF = "(SELECT max(doc_id) / 2 FROM documents)"


@query(f"WITH {GRAPH}, old AS (SELECT DISTINCT head, tail, relation_type FROM rel WHERE tail IS NOT NULL AND doc_id < {HALF}), known AS (SELECT DISTINCT canonical FROM m WHERE doc_id < {HALF}), new AS (SELECT DISTINCT doc_id, head, tail, relation_type FROM rel WHERE tail IS NOT NULL AND doc_id >= {HALF}) SELECT new.*, CASE WHEN old.head IS NOT NULL THEN 'repetition' WHEN h.canonical IS NOT NULL AND t.canonical IS NOT NULL THEN 'novel_combination' ELSE 'new_concept' END AS class FROM new LEFT JOIN old ON new.head = old.head AND new.tail = old.tail AND new.relation_type = old.relation_type LEFT JOIN known h ON h.canonical = new.head LEFT JOIN known t ON t.canonical = new.tail")
def originality_class(spark, sf_dir):
    half = table(spark, sf_dir, "documents").agg(F.max("doc_id") / 2).first()[0]
    m = merge.keyed(mentions(spark, sf_dir))
    r = relations(spark, sf_dir).select("doc_id", fn.canonical(F.col("head_text")).alias("head"), fn.canonical(F.col("tail_text")).alias("tail"), "relation_type").distinct()
    return originality.classify(r.where(F.col("doc_id") >= half), m.where(F.col("doc_id") < half).select("canonical").distinct(), r.where(F.col("doc_id") < half))


@query(f"WITH {GRAPH}, x AS (SELECT DISTINCT source AS author, canonical FROM m JOIN documents USING (doc_id)), c AS (SELECT canonical, count(*) AS n FROM x GROUP BY 1) SELECT author, count(*) AS n_nodes, count(*) FILTER (n = 1) AS own_nodes, round(count(*) FILTER (n = 1) / count(*), 3)::DOUBLE AS originality FROM x JOIN c USING (canonical) GROUP BY author")
def author_originality(spark, sf_dir):
    a = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("author"))
    x = merge.keyed(mentions(spark, sf_dir)).join(a, "doc_id").select("author", "canonical").distinct()
    c = x.groupBy("canonical").agg(F.count(F.lit(1)).alias("n"))
    out = x.join(c, "canonical").groupBy("author").agg(F.count(F.lit(1)).alias("n_nodes"), F.count_if(F.col("n") == 1).alias("own_nodes"))
    return out.withColumn("originality", F.round(F.col("own_nodes") / F.col("n_nodes"), 3))


@query(r"""WITH t AS (SELECT conv_id, turn, lower(text) AS w FROM conversations), l AS (SELECT DISTINCT conv_id, turn, role FROM conversations),
a AS (SELECT x.conv_id, x.turn AS a, y.turn AS b FROM l x JOIN l y ON x.conv_id = y.conv_id AND abs(x.turn - y.turn) = 1),
r1 AS MATERIALIZED (SELECT l.conv_id, l.turn, md5(l.role || '|' || coalesce((SELECT string_agg(o.role, ',' ORDER BY o.role) FROM a JOIN l o ON o.conv_id = a.conv_id AND o.turn = a.b WHERE a.conv_id = l.conv_id AND a.a = l.turn), '')) AS lab FROM l),
r2 AS (SELECT r1.conv_id, r1.turn, md5(r1.lab || '|' || coalesce((SELECT string_agg(o.lab, ',' ORDER BY o.lab) FROM a JOIN r1 o ON o.conv_id = a.conv_id AND o.turn = a.b WHERE a.conv_id = r1.conv_id AND a.a = r1.turn), '')) AS lab FROM r1),
h AS (SELECT conv_id, lab, count(*) AS n FROM (SELECT conv_id, role AS lab FROM l UNION ALL SELECT conv_id, lab FROM r1 UNION ALL SELECT conv_id, lab FROM r2) GROUP BY 1, 2),
s AS (SELECT conv_id, sqrt(sum(n * n)::DOUBLE) AS z FROM h GROUP BY 1),
p AS (SELECT conv_id AS left_doc, lead(conv_id) OVER (ORDER BY conv_id) AS right_doc FROM (SELECT DISTINCT conv_id FROM l)),
d AS (SELECT left_doc, right_doc, sum(x.n * y.n) AS dot FROM p JOIN h x ON x.conv_id = left_doc JOIN h y ON y.conv_id = right_doc AND y.lab = x.lab GROUP BY 1, 2)
SELECT p.left_doc, p.right_doc, round(coalesce(d.dot / (x.z * y.z), 0), 6)::DOUBLE AS similarity FROM p LEFT JOIN d ON d.left_doc = p.left_doc AND d.right_doc = p.right_doc JOIN s x ON x.conv_id = p.left_doc JOIN s y ON y.conv_id = p.right_doc WHERE p.right_doc IS NOT NULL""")
def wl_similarity(spark, sf_dir):
    l = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("node"), F.col("role").alias("label")).distinct()
    near = l.select("doc_id", F.col("node").alias("a"), F.explode(F.array(F.col("node") - 1, F.col("node") + 1)).alias("b"))
    near = near.join(l.select("doc_id", F.col("node").alias("b")), ["doc_id", "b"], "left_semi")
    ids = l.select("doc_id").distinct()
    at = running(ids, [F.col("doc_id")], {"at": F.lit(1)})
    nxt = at.toDF("left_doc", "at").join(at.select(F.col("doc_id").alias("right_doc"), (F.col("at") - 1).alias("at")), "at").drop("at")
    return graph.wl_similarity(graph.wl_histogram(l, near), nxt)


@query(f"WITH {GRAPH}, w AS (SELECT doc_id, canonical FROM m WHERE pos = 0) SELECT h.node_id AS source, t.node_id AS target, count(*) AS n_seen, min(a.doc_id) AS first_doc FROM w a JOIN w b ON b.doc_id = a.doc_id + 1 JOIN nodes h ON h.canonical = a.canonical AND h.first_ord <= a.doc_id JOIN nodes t ON t.canonical = b.canonical AND t.first_ord <= a.doc_id GROUP BY 1, 2")
def asof_edges(spark, sf_dir):
    """Each document names the first word of the next one: only words that some document had by then resolve."""
    w = word_rows(spark, sf_dir).where(F.size("w") > 0).select("doc_id", F.col("w")[0].alias("text"))
    r = w.join(w.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("tail_text")), "doc_id")
    r = r.select("doc_id", F.col("doc_id").alias("doc_ord"), F.lit(0).alias("segment_ix"), F.lit(0).alias("pos"), F.col("text").alias("head_text"), F.lit("next").alias("relation_type"), "tail_text", F.lit(1.0).alias("score"))
    nodes = merge.nodes_of(merge.node_observations(mentions(spark, sf_dir)))
    return merge.edges_of(merge.resolve(merge.edge_observations(r), cut(nodes))).select("source", "target", "n_seen", "first_doc")


@query(with_graph("SELECT a AS start, b AS node_id, 1 AS hops FROM (SELECT source AS a, target AS b FROM edges WHERE relation_type = 'broader' UNION SELECT target, source FROM edges WHERE relation_type = 'broader') JOIN starts ON a = node_id WHERE a <> b"))
def neighbors_typed(spark, sf_dir):
    n, e = pair(corpus(spark, sf_dir))
    return graph.neighbours(e, starts(n).withColumnRenamed("node_id", "start"), 1, ["broader"])


@query(with_graph("SELECT node_id, text FROM nodes WHERE contains(lower(text), 'tion')"))
def name_search(spark, sf_dir):
    return summary.name_search(corpus(spark, sf_dir).nodes, "TION").select("node_id", "text")


@query(f"WITH {GRAPH}, b AS MATERIALIZED (SELECT node_id FROM (SELECT node_id, count(*) AS n FROM ends GROUP BY 1) ORDER BY n DESC, node_id LIMIT 10) SELECT source, target, relation_type FROM edges SEMI JOIN b x ON source = x.node_id SEMI JOIN b y ON target = y.node_id")
def important_edges(spark, sf_dir):
    e = corpus(spark, sf_dir, True).edges
    return summary.important_edges(e, summary.degrees(e).withColumnRenamed("degree", "score")).select("source", "target", "relation_type")


@query(with_graph("SELECT relation_type, count(*) AS n FROM edges GROUP BY 1"))
def relation_type_counts(spark, sf_dir):
    return summary.relation_type_counts(corpus(spark, sf_dir).edges)


@query(with_graph(f"SELECT source, target, relation_type FROM edges SEMI JOIN (SELECT node_id FROM nodes WHERE {CLASS} = 'shared' AND contains(lower(text), 'ing')) x ON source = x.node_id SEMI JOIN (SELECT node_id FROM nodes WHERE {CLASS} = 'shared' AND contains(lower(text), 'ing')) y ON target = y.node_id"))
def subgraph_by_topic(spark, sf_dir):
    n, e = pair(corpus(spark, sf_dir, True))
    return summary.sub_graph(summary.with_source_class(n, F.lit(0)), e, "ing", "shared")[1].select("source", "target", "relation_type")


@query(with_graph("SELECT node_id AS id, text, coalesce(entity_type, 'unknown') AS entity_type, score::DOUBLE AS score, array_to_string(docs, '|') AS docs, len(docs) < 2 AS unique FROM nodes"))
def export_nodes(spark, sf_dir):
    return sinks.node_rows(corpus(spark, sf_dir)).withColumn("docs", joined())


@query(with_graph("SELECT source, target, relation_type, score::DOUBLE AS score, n_seen AS count, array_to_string(docs, '|') AS docs, len(docs) < 2 AS unique FROM edges"))
def export_edges(spark, sf_dir):
    return sinks.edge_rows(corpus(spark, sf_dir)).withColumn("docs", joined())


@query(with_graph(f"SELECT node_id AS id, text AS name, coalesce(entity_type, 'concept') AS type, round(score::DOUBLE * 10, 1) AS importance, {CLASS} AS source, array_to_string(docs, '|') AS documents FROM nodes SEMI JOIN ends USING (node_id)"))
def result_topics(spark, sf_dir):
    return sinks.result_topics(corpus(spark, sf_dir, True), F.lit(0)).withColumn("documents", joined("documents"))


@query(f"WITH {GRAPH}, o AS (SELECT h.node_id AS source, t.node_id AS target, relation_type, min((doc_id, pos)) AS first_at FROM rel JOIN nodes h ON head = h.canonical JOIN nodes t ON tail = t.canonical GROUP BY ALL) SELECT source || '_' || target || '_' || (row_number() OVER (PARTITION BY source, target ORDER BY first_at, relation_type) - 1) AS id, source, target, relation_type AS relation, round(score::DOUBLE, 2) AS confidence, array_to_string(docs, '|') AS documents FROM edges JOIN o USING (source, target, relation_type)")
def result_relationships(spark, sf_dir):
    return sinks.result_relationships(corpus(spark, sf_dir)).withColumn("documents", joined("documents"))


@query(f"WITH {GRAPH}, x AS (SELECT 'analysis_' || (d % 7) AS analysis_id, d, node_id, len(docs) AS n FROM (SELECT node_id, docs, unnest(docs) AS d FROM nodes)) SELECT analysis_id, count(DISTINCT node_id) AS topics, count(DISTINCT d) AS \"references\", count(DISTINCT node_id) FILTER (n = 1) AS unique_topics FROM x GROUP BY 1")
def saved_analyses(spark, sf_dir):
    g = corpus(spark, sf_dir)
    rows = g.node_docs.join(g.nodes.select("node_id", "n_docs"), "node_id")
    return jobs.saved_analyses(rows.select(fn.analysis_id((F.col("doc_id") % 7).cast("string")).alias("analysis_id"), "doc_id", "node_id", "n_docs"))


def _eigenvector_sql(rounds: int) -> str:
    ctes = ["v0 AS (SELECT DISTINCT a AS id, 1.0::DOUBLE AS v FROM both_ways)"]
    for i in range(rounds):
        ctes.append(f"u{i} AS (SELECT p.id, p.v + g.got AS v FROM v{i} p JOIN (SELECT a, sum(v) AS got FROM both_ways JOIN v{i} ON b = id GROUP BY a) g ON g.a = p.id)")
        ctes.append(f"v{i + 1} AS (SELECT id, v / z AS v FROM u{i}, (SELECT sqrt(sum(v * v)) AS z FROM u{i}))")
    return f"WITH {GRAPH}, " + ", ".join(ctes) + f" SELECT id AS node_id, round(v, 6) AS value FROM v{rounds}"


@query(_eigenvector_sql(3))
def eigenvector_3(spark, sf_dir):
    return graph.eigenvector(corpus(spark, sf_dir, True).edges, 3).withColumn("value", F.round("value", 6))


def document_edges(spark, sf_dir):
    """(doc_id, source, target): the relations inside each document, as two arrays."""
    w = word_rows(spark, sf_dir).select("doc_id", F.transform("w", fn.topic_key).alias("w")).where(F.size("w") > 1)
    return w.select("doc_id", F.slice("w", 1, F.size("w") - 1).alias("source"), F.slice("w", 2, F.size("w") - 1).alias("target"))


@query()
def communities(spark, sf_dir):
    return graph.per_graph(document_edges(spark, sf_dir), "communities").withColumn("value", F.col("value").cast("long"))


@query()
def multi_centrality(spark, sf_dir):
    return graph.multi_centrality(document_edges(spark, sf_dir)).withColumn("value", F.round("value", 6))


# --- functions, structure and topics -------------------------------------------------------------------------------

CANON = r"trim(regexp_replace(regexp_replace(lower(regexp_replace(T, '^\s+|\s+$', '', 'g')), '[\s\-_]+', ' ', 'g'), '^(the|a|an) ', ''))"
WORDS = r"list_filter(regexp_split_to_array(coalesce(T, ''), '\s+'), lambda w: w <> '')"


@query(rf"SELECT text, {CANON.replace('T', 'text')} AS canonical, substr(md5(lang || ':' || lower(text)), 1, 12) AS entity_id, replace(text, ' ', '_') AS label FROM (SELECT DISTINCT lang, unnest({WORDS.replace('T', 'text')}) AS text FROM documents)")
def canonical_keys(spark, sf_dir):
    w = table(spark, sf_dir, "documents").select("lang", F.explode(fn.words(F.col("text"))).alias("text")).distinct()
    return w.select("text", fn.canonical(F.col("text")).alias("canonical"), fn.entity_id(F.col("text"), F.col("lang")).alias("entity_id"), fn.label(F.col("text")).alias("label"))


KEYS = "k AS (SELECT DISTINCT lower(p_name) AS c FROM part UNION SELECT DISTINCT unnest(string_split(lower(p_name), ' ')) FROM part)"


def part_keys(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select(fn.canonical(F.col("p_name")).alias("canonical")).union(p.select(F.explode(fn.words(F.lower("p_name"))))).distinct()


@query(f"WITH {KEYS} SELECT a.c AS short, b.c AS long FROM k a, k b WHERE a.c <> b.c AND list_has_all(string_split(b.c, ' '), string_split(a.c, ' '))")
def token_subset_pairs(spark, sf_dir):
    return merge.contained_pairs(part_keys(spark, sf_dir))


@query(f"""WITH RECURSIVE {KEYS}, o AS MATERIALIZED (SELECT c, string_split(c, ' ') AS t, row_number() OVER (ORDER BY substr(md5(c), 1, 12), c) AS i FROM k),
r AS (SELECT 0::BIGINT AS i, '' AS c, '' AS leader, []::VARCHAR[] AS leaders UNION ALL
  SELECT i, c, coalesce(f, c), CASE WHEN f IS NULL THEN list_append(leaders, c) ELSE leaders END FROM (
    SELECT o.i, o.c, r.leaders, list_filter(r.leaders, lambda x: list_has_all(string_split(x, ' '), o.t) OR list_has_all(o.t, string_split(x, ' ')))[1] AS f FROM r JOIN o ON o.i = r.i + 1))
SELECT c AS canonical, leader FROM r WHERE i > 0""")
def alias_leaders(spark, sf_dir):
    """In the order of the keys' digests, as the table has none."""
    at = F.conv(F.substring(F.md5("canonical"), 1, 12), 16, 10).cast("long")
    k = part_keys(spark, sf_dir).select("canonical", at.alias("doc_ord"), F.lit(0).alias("segment_ix"), F.lit(0).alias("pos"))
    return merge.alias_leaders(k)


QUICK = """pm AS MATERIALIZED (SELECT p_partkey % 50 AS doc_id, p_partkey AS pos, CASE WHEN p_partkey % 3 = 0 THEN string_split(p_name, ' ')[1] ELSE p_name END AS text, p_brand AS label, lower(CASE WHEN p_partkey % 3 = 0 THEN string_split(p_name, ' ')[1] ELSE p_name END) AS c FROM part),
o AS MATERIALIZED (SELECT c, string_split(c, ' ') AS t, row_number() OVER (ORDER BY min((doc_id, pos)), c) AS i FROM pm GROUP BY c),
r AS (SELECT 0::BIGINT AS i, '' AS c, '' AS leader, []::VARCHAR[] AS leaders UNION ALL
  SELECT i, c, coalesce(f, c), CASE WHEN f IS NULL THEN list_append(leaders, c) ELSE leaders END FROM (
    SELECT o.i, o.c, r.leaders, list_filter(r.leaders, lambda x: list_has_all(string_split(x, ' '), o.t) OR list_has_all(o.t, string_split(x, ' ')))[1] AS f FROM r JOIN o ON o.i = r.i + 1)),
qn AS MATERIALIZED (SELECT leader, arg_min(text, (doc_id, pos)) AS text, arg_min(label, (doc_id, pos)) AS label, count(*) AS n_mentions, count(DISTINCT doc_id) AS n_docs, min(doc_id) AS first_ord FROM pm JOIN r USING (c) GROUP BY leader),
qi AS MATERIALIZED (SELECT *, substr(md5(label || ':' || lower(text)), 1, 12) AS node_id FROM qn)"""


def quick_graph(spark, sf_dir):
    """Parts as mentions, every third by the first word of its name only; each is related to the next of its document."""
    p = table(spark, sf_dir, "part")
    text = F.when(F.col("p_partkey") % 3 == 0, F.split("p_name", " ")[0]).otherwise(F.col("p_name"))
    d = (F.col("p_partkey") % 50).alias("doc_id")
    m = p.select(d, d.alias("doc_ord"), F.lit(0).alias("segment_ix"), F.col("p_partkey").alias("pos"), text.alias("text"), F.col("p_brand").alias("label"), F.lit(0.5).alias("score"))
    return merge.merge_graph(m, extract.adjacent_relations(m, F.lit("next"), F.lit(0.5)), "containment")


@query(f"WITH RECURSIVE {QUICK} SELECT node_id, leader AS canonical, text, n_mentions, n_docs FROM qi")
def quick_nodes(spark, sf_dir):
    return quick_graph(spark, sf_dir).nodes.select("node_id", "canonical", "text", "n_mentions", "n_docs")


@query(f"""WITH RECURSIVE {QUICK}, x AS (SELECT doc_id, c, lead(c) OVER (PARTITION BY doc_id ORDER BY pos) AS c2 FROM pm)
SELECT h.node_id AS source, t.node_id AS target, count(*) AS n_seen, count(DISTINCT doc_id) AS n_docs FROM x JOIN r a ON a.c = x.c JOIN r b ON b.c = x.c2 JOIN qi h ON h.leader = a.leader AND h.first_ord <= doc_id JOIN qi t ON t.leader = b.leader AND t.first_ord <= doc_id GROUP BY 1, 2""")
def quick_edges(spark, sf_dir):
    return quick_graph(spark, sf_dir).edges.select("source", "target", "n_seen", "n_docs")


@query("WITH k AS (SELECT DISTINCT lower(p_name) AS c FROM part) SELECT a.c AS a, b.c AS b FROM k a, k b WHERE a.c < b.c AND list_has_any(string_split(a.c, ' '), string_split(b.c, ' '))")
def touches_pairs(spark, sf_dir):
    k = table(spark, sf_dir, "part").select(F.lower("p_name").alias("c")).distinct().select("c", F.explode(fn.words(F.col("c"))).alias("token")).distinct()
    pairs = k.toDF("a", "token").join(k.toDF("b", "token"), "token").where("a < b").select("a", "b").distinct()
    return pairs.where(fn.touches(F.col("a"), F.col("b")))


@query(r"SELECT doc_id, len(s)::INTEGER AS n_sentences, md5(array_to_string(s, '|')) AS digest FROM (SELECT doc_id, list_filter(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: length(trim(x)) > 0) AS s FROM documents)")
def sentences(spark, sf_dir):
    s = table(spark, sf_dir, "documents").select("doc_id", fn.sentences(F.col("text")).alias("s"))
    return s.select("doc_id", F.size("s").alias("n_sentences"), F.md5(F.array_join("s", "|")).alias("digest"))


@query(rf"SELECT doc_id, n::INTEGER AS n_words, md5(array_to_string(w[1:250], ' ')) AS digest, greatest(2, least(20, est))::INTEGER AS hi, greatest(greatest(2, least(20, est)), least(25, est))::INTEGER AS pool FROM (SELECT doc_id, w, len(w) AS n, round_even(least(len(w), 250) / 40, 0)::INTEGER AS est FROM (SELECT doc_id, {WORDS.replace('T', 'text')} AS w FROM documents))")
def word_truncate(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text", fn.token_count(F.col("text")).alias("n_words"))
    b = fn.keyword_bounds(F.least("n_words", F.lit(250)))
    return d.select("doc_id", "n_words", F.md5(fn.first_words(F.col("text"))).alias("digest"), b["hi"].alias("hi"), b["pool"].alias("pool"))


@query(rf"SELECT doc_id, i::INTEGER AS chunk_ix, array_to_string(w[i * 100 + 1:i * 100 + 100], ' ') AS chunk FROM (SELECT doc_id, w, unnest(range((len(w) + 99) // 100)) AS i FROM (SELECT doc_id, {WORDS.replace('T', 'text')} AS w FROM documents))")
def hard_chunks(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(fn.hard_chunks(F.col("text"), 100)).alias("chunk_ix", "chunk"))


@query(rf"SELECT doc_id, array_to_string(w[greatest(len(w) - 63, 1):], ' ') AS tail, substr(regexp_replace(text, '\s+', ' ', 'g'), 1, 200) AS preview FROM (SELECT doc_id, text, {WORDS.replace('T', 'text')} AS w FROM documents)")
def tails_and_previews(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", fn.tail_tokens(F.col("text"), F.lit(64)).alias("tail"), fn.preview(F.col("text")).alias("preview"))


@query("SELECT event_id, 'analysis_' || lower(translate(event_type || '/' || user_id, '/: ', '___')) AS analysis_id, replace(event_type || '/' || user_id, '/', '_') AS file_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS at, floor(100.0 * (user_id % 7) / 7 + 0.5)::BIGINT AS share FROM events")
def names_and_times(spark, sf_dir):
    name = F.concat("event_type", F.lit("/"), F.col("user_id").cast("string"))
    return table(spark, sf_dir, "events").select("event_id", fn.analysis_id(name).alias("analysis_id"), fn.file_id(name).alias("file_id"), fn.iso_time(F.col("ts")).alias("at"), fn.percent(F.col("user_id") % 7, F.lit(7)).alias("share"))


@query("SELECT event_id, coalesce(json_extract_string(props, '$.text'), '') AS content, len(list_filter(json_keys(props), lambda k: k <> 'text'))::INTEGER AS n_metadata FROM events")
def json_docs(spark, sf_dir):
    raw = table(spark, sf_dir, "events").select(F.col("event_id").alias("path"), F.col("props").alias("value"))
    return readers.parse_whole(raw, "json").select(F.col("path").alias("event_id"), "content", F.size(F.json_object_keys("metadata")).alias("n_metadata"))


@query("SELECT event_id, json_type(props) = 'OBJECT' AS parsed, json_extract_string(props, '$.k') AS k FROM events")
def structured_answers(spark, sf_dir):
    """The events' JSON as answers of a schema."""
    out = extract.parse_structured(table(spark, sf_dir, "events").select("event_id", F.col("props").alias("response")), "k string")
    return out.select("event_id", F.col("parsed").isNotNull().alias("parsed"), F.col("parsed.k").alias("k"))


BUILT_SQL = """built AS (SELECT doc_id, 'Preface' || chr(10) || chr(10) || '# Part one' || chr(10) || '## Introduction' || chr(10) || text || chr(10) || chr(10) || '## Results' || chr(10) || 'See 10.1234/abc.' || doc_id || ' and more' || chr(10) || '# References' || chr(10)
  || '[1] One arXiv:24' || lpad((doc_id % 12 + 1)::VARCHAR, 2, '0') || '.' || lpad((doc_id % 50)::VARCHAR, 5, '0') || 'v2' || chr(10) || 'continued doi 10.5555/x' || (doc_id % 30) || chr(10) || '2. Two 2301.00001, 2301.00001 and 10.5555/y' || chr(10) || chr(10) || '- [3] Three http://arxiv.org/abs/2402.0000' || (doc_id % 10) || chr(10) || '# Appendix' || chr(10) || 'Last words' AS content FROM documents)"""


def built(spark, sf_dir):
    """Markdown made of the documents' columns: the tables hold none."""
    d = lambda m: (F.col("doc_id") % m)
    parts = [
        F.lit("Preface\n\n# Part one\n## Introduction\n"), F.col("text"), F.lit("\n\n## Results\nSee 10.1234/abc."), F.col("doc_id"), F.lit(" and more\n# References\n[1] One arXiv:24"),
        F.lpad((d(12) + 1).cast("string"), 2, "0"), F.lit("."), F.lpad(d(50).cast("string"), 5, "0"), F.lit("v2\ncontinued doi 10.5555/x"), d(30), F.lit("\n2. Two 2301.00001, 2301.00001 and 10.5555/y\n\n- [3] Three http://arxiv.org/abs/2402.0000"),
        d(10), F.lit("\n# Appendix\nLast words"),
    ]
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(*[p.cast("string") for p in parts]).alias("content"))


@query(f"WITH {BUILT_SQL} SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(content, '\\b(\\d{{4}}\\.\\d{{4,5}}(?:v\\d+)?)\\b', 1))), ' ') AS ids FROM built")
def arxiv_ids(spark, sf_dir):
    return built(spark, sf_dir).select("doc_id", F.array_join(fn.arxiv_ids(F.col("content")), " ").alias("ids"))


@query(f"WITH {BUILT_SQL} SELECT doc_id, array_to_string(regexp_extract_all(content, '(10\\.\\d{{4,9}}/[^\\s,;]+)', 1), ' ') AS ids FROM built")
def dois(spark, sf_dir):
    return built(spark, sf_dir).select("doc_id", F.array_join(fn.dois(F.col("content")), " ").alias("ids"))


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '2401.' || lpad((doc_id % 99999)::VARCHAR, 5, '0') || 'v1' WHEN 1 THEN '2301.' || lpad((doc_id % 9999)::VARCHAR, 4, '0') END AS id FROM documents")
def arxiv_id_parse(spark, sf_dir):
    i = F.col("doc_id")
    a = F.concat(F.lit("https://arxiv.org/pdf/2401."), F.lpad((i % 99999).cast("string"), 5, "0"), F.lit("v1.pdf"))
    b = F.concat(F.lit("paper 2301."), F.lpad((i % 9999).cast("string"), 4, "0"), F.lit(" text"))
    return table(spark, sf_dir, "documents").select("doc_id", fn.arxiv_id_of(F.when(i % 3 == 0, a).when(i % 3 == 1, b).otherwise(F.lit("none"))).alias("id"))


SECTIONS_SQL = f"""WITH {BUILT_SQL}, s AS (
SELECT doc_id, 0 AS ix, 'Preface' AS text, '' AS path FROM built UNION ALL
SELECT doc_id, 1, trim(text, chr(10) || chr(13) || chr(9) || ' '), 'Part one>Introduction' FROM documents UNION ALL
SELECT doc_id, 2, 'See 10.1234/abc.' || doc_id || ' and more', 'Part one>Results' FROM built UNION ALL
SELECT doc_id, 3, '[1] One arXiv:24' || lpad((doc_id % 12 + 1)::VARCHAR, 2, '0') || '.' || lpad((doc_id % 50)::VARCHAR, 5, '0') || 'v2' || chr(10) || 'continued doi 10.5555/x' || (doc_id % 30) || chr(10) || '2. Two 2301.00001, 2301.00001 and 10.5555/y' || chr(10) || chr(10) || '- [3] Three http://arxiv.org/abs/2402.0000' || (doc_id % 10), 'References' FROM built UNION ALL
SELECT doc_id, 4, 'Last words', 'Appendix' FROM built)"""


@query(f"{SECTIONS_SQL} SELECT doc_id, ix::BIGINT AS section_ix, md5(text) AS digest, path FROM s")
def sections(spark, sf_dir):
    s = structure.sections(structure.markdown_blocks(built(spark, sf_dir)))
    return s.select("doc_id", F.col("section_ix").cast("long").alias("section_ix"), F.md5("text").alias("digest"), F.array_join("headings", ">").alias("path"))


@query(f"{SECTIONS_SQL} SELECT doc_id, ix::BIGINT AS section_ix, path FROM s WHERE path NOT IN ('References', 'Appendix')")
def kept_sections(spark, sf_dir):
    s = structure.without_boilerplate(structure.sections(structure.markdown_blocks(built(spark, sf_dir))), ["references", "appendix"])
    return s.select("doc_id", F.col("section_ix").cast("long").alias("section_ix"), F.array_join("headings", ">").alias("path"))


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 1 ELSE 0 END::BIGINT AS section_ix, CASE doc_id % 3 WHEN 0 THEN 'A ' || doc_id WHEN 1 THEN 'In this paper we ' || doc_id ELSE 'plain ' || doc_id || chr(10) || chr(10) || 'more' END AS text FROM documents")
def abstract_sections(spark, sf_dir):
    kinds = [F.concat(F.lit(a), F.col("doc_id").cast("string"), F.lit(b)) for a, b in (("Intro words\n\n# 1 Abstract\nA ", "\n# Body\nText"), ("# One\nIn this paper we ", "\n# Two\nmore"), ("# One\nplain ", "\n# Two\nmore"))]
    d = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, kinds[0]).when(F.col("doc_id") % 3 == 1, kinds[1]).otherwise(kinds[2]).alias("content"))
    return structure.abstracts(structure.sections(structure.markdown_blocks(d))).withColumn("section_ix", F.col("section_ix").cast("long"))


@query("SELECT doc_id, 0::BIGINT AS section_ix, 'References' AS path, md5(text) AS digest FROM (SELECT doc_id, 'only ' || doc_id AS text FROM documents)")
def skip_fallback(spark, sf_dir):
    """Documents of which the skip list would leave nothing keep all they have."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("# References\nonly "), F.col("doc_id").cast("string")).alias("content"))
    s = structure.without_boilerplate(structure.sections(structure.markdown_blocks(d)), Discovery().skip_headings)
    return s.select("doc_id", F.col("section_ix").cast("long").alias("section_ix"), F.array_join("headings", ">").alias("path"), F.md5("text").alias("digest"))


@query("SELECT doc_id, i::INTEGER AS ref_ix, '2401.' || lpad(((doc_id + i) % 100000)::VARCHAR, 5, '0') AS source_id FROM documents, range(15) t(i)")
def cited_limit(spark, sf_dir):
    """Forty references each, of which the configured number count."""
    refs = F.transform(F.sequence(F.lit(0), F.lit(39)), lambda i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] arXiv:2401."), F.lpad(((F.col("doc_id") + i) % 100000).cast("string"), 5, "0")))
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("# Works Cited\n"), F.array_join(refs, "\n")).alias("content"))
    return structure.cited_ids(structure.reference_entries(d), "arxiv")


@query(f"{SECTIONS_SQL} SELECT doc_id, ix::BIGINT AS section_ix, len(list_filter(regexp_split_to_array(replace(path, '>', chr(10)), '\\s+'), lambda w: w <> ''))::INTEGER AS prefix_tokens FROM s")
def heading_tokens(spark, sf_dir):
    s = structure.sections(structure.markdown_blocks(built(spark, sf_dir)))
    return s.select("doc_id", F.col("section_ix").cast("long").alias("section_ix"), fn.heading_prefix_tokens(F.col("headings")).alias("prefix_tokens"))


REFS = f"""WITH {BUILT_SQL}, e AS (
SELECT doc_id, 0 AS ref_ix, 'One arXiv:24' || lpad((doc_id % 12 + 1)::VARCHAR, 2, '0') || '.' || lpad((doc_id % 50)::VARCHAR, 5, '0') || 'v2 continued doi 10.5555/x' || (doc_id % 30) AS raw_text FROM documents UNION ALL
SELECT doc_id, 1, 'Two 2301.00001, 2301.00001 and 10.5555/y' FROM documents UNION ALL SELECT doc_id, 2, 'Three http://arxiv.org/abs/2402.0000' || (doc_id % 10) FROM documents)"""


@query(f"{REFS} SELECT doc_id, ref_ix, raw_text FROM e")
def reference_entries(spark, sf_dir):
    return structure.reference_entries(built(spark, sf_dir))


def _cited(pattern: str) -> str:
    return f"{REFS}, i AS (SELECT doc_id, ref_ix, unnest(regexp_extract_all(raw_text, '{pattern}', 1)) AS source_id FROM e) SELECT doc_id, min(ref_ix) AS ref_ix, source_id FROM i GROUP BY doc_id, source_id"


@query(_cited(r"\b(\d{4}\.\d{4,5}(?:v\d+)?)\b"))
def cited_arxiv(spark, sf_dir):
    return structure.cited_ids(structure.reference_entries(built(spark, sf_dir)), "arxiv")


@query(_cited(r"(10\.\d{4,9}/[^\s,;]+)"))
def cited_dois(spark, sf_dir):
    return structure.cited_ids(structure.reference_entries(built(spark, sf_dir)), "doi")


SEEDS = r"""s AS (SELECT doc_id, word AS keyword, n / 10.0 AS score, ord, lower(word) AS key FROM (SELECT doc_id, word, count(*) AS n, min(i) AS ord FROM (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM (SELECT doc_id, regexp_extract_all(text, '\p{L}{7,}') AS w FROM documents)) GROUP BY 1, 2)),
u AS (SELECT doc_id, key, arg_min(keyword, ord) AS keyword, max(score)::DOUBLE AS score, min(ord) AS ord FROM s WHERE score >= 0.2 GROUP BY 1, 2)"""


def seeds(spark, sf_dir):
    w = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(r"(\p{L}{7,})"), 1)).alias("i", "keyword"))
    return w.groupBy("doc_id", "keyword").agg((F.count(F.lit(1)) / 10).alias("score"), F.min("i").cast("long").alias("ord"))


@query(f"WITH {SEEDS} SELECT * FROM u")
def seed_union(spark, sf_dir):
    return discovery.seed_union(seeds(spark, sf_dir), 0.2)


@query(f"WITH {SEEDS} SELECT doc_id, key, score, r::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, ord, key) AS r FROM u) WHERE r <= 25")
def top_seeds(spark, sf_dir):
    return discovery.top_seeds(discovery.seed_union(seeds(spark, sf_dir), 0.2)).select("doc_id", "key", "score", "rank")


def triples(spark, sf_dir):
    r = relations(spark, sf_dir)
    return r.select("doc_id", F.col("pos").alias("ord"), F.col("head_text").alias("source"), F.col("relation_type").alias("relation"), F.col("tail_text").alias("target"), F.lit("").alias("evidence"))


@query(with_graph("SELECT doc_id, head AS src, tail AS dst, relation_type AS rel, min(pos)::INTEGER AS ord FROM rel WHERE tail IS NOT NULL AND head <> tail GROUP BY 1, 2, 3, 4"))
def triple_dedup(spark, sf_dir):
    return discovery.dedup_triples(triples(spark, sf_dir)).select("doc_id", "src", "dst", F.lower("relation").alias("rel"), "ord")


@query(with_graph("SELECT doc_id, 'entity' AS kind, arg_min(text, pos) AS label, (row_number() OVER (PARTITION BY doc_id ORDER BY min(pos)) - 1)::INTEGER AS label_ord FROM m GROUP BY doc_id, canonical"))
def taxonomy_labels(spark, sf_dir):
    p = mentions(spark, sf_dir).select("doc_id", F.lit("entity").alias("kind"), F.col("text").alias("phrase"), F.col("pos").alias("ord"))
    return discovery.taxonomy_labels(p)


def topics(spark, sf_dir):
    t = discovery.dedup_triples(triples(spark, sf_dir)).select("doc_id", "ord", "src", "dst", F.col("relation").alias("relation"))
    c = Discovery()
    s = discovery.top_seeds(discovery.seed_union(seeds(spark, sf_dir), 0.2), c.max_seeds).select("doc_id", "key", F.col("rank").alias("pos"))
    return discovery.expand_topics(cut(s), cut(t), c.max_depth, c.max_relations)


def _topics_sql() -> str:
    """Two levels of expansion, written out; keys are single words, so touching is being equal."""
    c = Discovery()
    seeds = f"seed AS MATERIALIZED (SELECT doc_id, key, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, ord, key) AS pos FROM u QUALIFY pos <= {c.max_seeds})"
    triples = "t AS MATERIALIZED (SELECT doc_id, head AS src, tail AS dst, relation_type AS relation, min(pos) AS ord FROM rel WHERE tail IS NOT NULL AND head <> tail GROUP BY doc_id, head, tail, relation_type)"
    ctes, had, known = [seeds, triples, "front0 AS (SELECT doc_id, key, pos FROM seed)"], "SELECT doc_id, ord FROM t WHERE false", "SELECT doc_id, key FROM seed"
    for d in range(c.max_depth):
        ctes += [
            f"had{d} AS MATERIALIZED ({had})",
            f"cand{d} AS (SELECT t.doc_id, t.ord, min(f.pos) AS p FROM t JOIN front{d} f ON f.doc_id = t.doc_id AND f.key IN (t.src, t.dst) ANTI JOIN had{d} h ON h.doc_id = t.doc_id AND h.ord = t.ord GROUP BY ALL)",
            f"n{d} AS (SELECT doc_id, count(*) AS n FROM had{d} GROUP BY 1)",
            f"lev{d} AS MATERIALIZED (SELECT * FROM (SELECT x.*, coalesce(count(*) OVER (PARTITION BY x.doc_id ORDER BY p RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + coalesce(n, 0) AS before FROM cand{d} x LEFT JOIN n{d} ON n{d}.doc_id = x.doc_id) WHERE before < {c.max_relations})",
            f"end{d} AS (SELECT doc_id, key, min((p, ord, side)) AS place FROM (SELECT l.doc_id, l.p, l.ord, unnest([src, dst]) AS key, unnest([0, 1]) AS side FROM lev{d} l JOIN t ON t.doc_id = l.doc_id AND t.ord = l.ord) GROUP BY ALL)",
            f"known{d} AS MATERIALIZED ({known})",
            f"front{d + 1} AS MATERIALIZED (SELECT e.doc_id, e.key, row_number() OVER (PARTITION BY e.doc_id ORDER BY place, e.key) AS pos FROM end{d} e ANTI JOIN known{d} k ON k.doc_id = e.doc_id AND k.key = e.key)",
        ]
        had, known = f"SELECT doc_id, ord FROM had{d} UNION ALL SELECT doc_id, ord FROM lev{d}", f"SELECT * FROM known{d} UNION ALL SELECT doc_id, key FROM front{d + 1}"
    every = " UNION ALL ".join(f"SELECT doc_id, key, {d} AS depth, pos::INTEGER AS pos FROM front{d}" for d in range(c.max_depth + 1))
    return f"WITH {GRAPH}, {SEEDS}, {', '.join(ctes)}, topic AS ({every})"


_LEVELS = " UNION ALL ".join(f"SELECT t.doc_id, src, dst, relation, t.ord, {d} AS depth FROM lev{d} l JOIN t ON t.doc_id = l.doc_id AND t.ord = l.ord" for d in range(Discovery().max_depth))


@query(f"{_topics_sql()} {_LEVELS}")
def topic_edges(spark, sf_dir):
    return topics(spark, sf_dir)[1]


@query(_topics_sql() + " SELECT * FROM topic")
def topic_bfs(spark, sf_dir):
    return topics(spark, sf_dir)[0]


@query(_topics_sql() + " SELECT doc_id, depth, count(*) AS n_topics FROM topic GROUP BY 1, 2")
def depth_histogram(spark, sf_dir):
    return topics(spark, sf_dir)[0].groupBy("doc_id", "depth").agg(F.count(F.lit(1)).alias("n_topics"))


COS = "list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (greatest(sqrt(list_inner_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])), 1e-10) * greatest(sqrt(list_inner_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])), 1e-10))"


@query(f"WITH l AS (SELECT label, arg_min(embedding, vec_id) AS embedding FROM embeddings GROUP BY label), s AS (SELECT a.vec_id, b.label, {COS} AS score FROM embeddings a, l b), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, label) AS rank FROM s) SELECT vec_id, label, round(score, 6) AS score, rank::INTEGER AS rank FROM r WHERE rank <= 10 AND (score >= 0.3 OR rank <= 5)")
def label_topk(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    labels = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("vector"))
    s = discovery.score_labels(e.select("vec_id", F.col("embedding").alias("vector")), labels, ["vec_id"])
    return discovery.label_top_k(s, ["vec_id"]).withColumn("score", F.round("score", 6))


@query(rf"""WITH {SEEDS}, l AS (SELECT doc_id, keyword AS label, key FROM u QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY ord) <= 12),
t AS (SELECT doc_id, ('0x' || substr(md5(tok), 1, 7))::BIGINT % 64 AS slot, count(*) AS n FROM (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')) AS tok FROM documents) GROUP BY 1, 2),
z AS (SELECT doc_id, sqrt(sum(n * n)) AS z FROM t GROUP BY 1),
sc AS (SELECT l.doc_id, label, coalesce(n, 0) / z AS score FROM l JOIN z USING (doc_id) LEFT JOIN t ON t.doc_id = l.doc_id AND t.slot = ('0x' || substr(md5(l.key), 1, 7))::BIGINT % 64),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, label) AS rank FROM sc)
SELECT doc_id, 0 AS segment_ix, label, round(score, 6) AS score, rank::INTEGER AS rank FROM r WHERE rank <= 10 AND (score >= 0.3 OR rank <= 5)""")
def segment_labels(spark, sf_dir):
    """Of each document's first twelve long words the nearest to its text."""
    u = discovery.seed_union(seeds(spark, sf_dir), 0.2)
    first = F.transform(F.slice(F.sort_array(F.collect_list(F.struct("ord", "keyword"))), 1, 12), lambda x: x["keyword"])
    labels = u.groupBy("doc_id").agg(first.alias("l")).select("doc_id", F.explode("l").alias("label"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.lit(0).alias("segment_ix"), "text")
    return discovery.filter_labels(docs, labels).withColumn("score", F.round("score", 6))


@query(with_graph("SELECT substr(md5(label || ':' || lower(text)), 1, 12) AS entity_id, arg_min(text, (doc_id, pos)) AS text, arg_min(label, (doc_id, pos)) AS entity_type, arg_min(score, (doc_id, pos))::DOUBLE AS score, count(*) AS n_mentions, count(DISTINCT doc_id) AS n_docs FROM m GROUP BY 1"))
def entity_index(spark, sf_dir):
    return merge.entity_index(mentions(spark, sf_dir))


@query()
def segments(spark, sf_dir):
    b = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("block_ix"), "text", F.array("role").alias("headings"))
    return segment.segments(b, 128, 16).withColumn("headings", F.array_join("headings", ">"))


_STOPS = ", ".join(f"'{w}'" for w in extract.STOP_WORDS)


@query(rf"""WITH d AS (SELECT doc_id, {WORDS.replace('T', 'text')} AS w FROM documents),
t AS (SELECT doc_id, pos, tok, lead(tok) OVER (PARTITION BY doc_id ORDER BY pos) AS nxt FROM (SELECT doc_id, unnest(a) AS tok, unnest(range(len(a))) AS pos FROM (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(array_to_string(w[1:250], ' ')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS a FROM d))),
g AS (SELECT *, tok NOT IN ({_STOPS}) AND length(tok) > 2 AS ok, nxt IS NOT NULL AND nxt NOT IN ({_STOPS}) AND length(nxt) > 2 AS ok2 FROM t),
f AS (SELECT doc_id, keyword, count(*) AS n, min(pos) AS first_pos FROM (SELECT doc_id, tok AS keyword, pos FROM g WHERE ok UNION ALL SELECT doc_id, tok || ' ' || nxt, pos FROM g WHERE ok AND ok2) GROUP BY 1, 2),
s AS (SELECT *, n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)) AS score FROM f),
b AS (SELECT doc_id, greatest(2, least(20, est)) AS hi, greatest(greatest(2, least(20, est)), least(25, est)) AS pool FROM (SELECT doc_id, round_even(least(len(w), 250) / 40, 0)::INTEGER AS est FROM d)),
c AS (SELECT s.*, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, first_pos, keyword) AS rank FROM s WHERE score >= 0.05),
p AS MATERIALIZED (SELECT c.*, hi, count(*) OVER (PARTITION BY c.doc_id) AS n_all FROM c JOIN b USING (doc_id) WHERE rank <= pool),
w AS (SELECT doc_id, rank, score, min(rank) OVER x AS r0, count(*) OVER x AS m, first_value(score) OVER (PARTITION BY doc_id ORDER BY rank) AS top, last_value(score) OVER (PARTITION BY doc_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS low FROM p WHERE rank BETWEEN 2 AND hi WINDOW x AS (PARTITION BY doc_id)),
q AS (SELECT doc_id, m, row_number() OVER (PARTITION BY doc_id ORDER BY (top - (top - low) * (rank - r0) / greatest(m - 1, 1)) - score DESC, rank) AS nth, rank - r0 + 1 AS knee FROM w),
k AS (SELECT DISTINCT p.doc_id, CASE WHEN n_all <= 2 THEN n_all WHEN coalesce(m, 0) < 2 THEN 2 ELSE least(greatest(2 + knee - 1, 2), hi) END AS k FROM p LEFT JOIN (SELECT * FROM q WHERE nth = 1) q USING (doc_id))
SELECT doc_id, keyword, round(score, 6) AS score, rank::INTEGER AS rank FROM p JOIN k USING (doc_id) WHERE rank <= k""")
def keywords(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    n = d.select("doc_id", F.least(fn.token_count(F.col("text")), F.lit(250)).alias("n_words"))
    k = extract.adaptive_keywords(extract.keyword_candidates(d, ["doc_id"]), n, ["doc_id"], floor=0.05)
    return k.withColumn("score", F.round("score", 6))


@query()
def betweenness(spark, sf_dir):
    return graph.per_graph(document_edges(spark, sf_dir), "betweenness").withColumn("value", F.round("value", 6))


@query("SELECT doc_id, lang FROM documents WHERE doc_id < 100")
def first_documents(spark, sf_dir):
    return summary.first_documents(table(spark, sf_dir, "documents").withColumn("ord", F.col("doc_id")), 100).select("doc_id", "lang")


@query("SELECT phase, seconds, round(CASE WHEN total > 0 THEN 100 * seconds / total ELSE 0 END, 1) AS share FROM (SELECT *, sum(seconds) OVER () AS total FROM (SELECT event_type AS phase, round(sum(value), 3) AS seconds FROM events GROUP BY 1))")
def phase_shares(spark, sf_dir):
    return sinks.phase_shares(table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("phase")).agg(F.round(F.sum("value"), 3).alias("seconds")))


STEP_SQL = ", ".join(f"({i}, '{k}', '{a}', '{b}', {s}, {d})" for i, (k, a, b, s, d) in enumerate(jobs.STEPS))


@query(f"""WITH r AS (SELECT DISTINCT event_type AS topic, NULL AS seed_url, 'quick' AS mode FROM events UNION ALL SELECT DISTINCT NULL, 'https://arxiv.org/abs/' || event_type, 'deep' FROM events),
s(i, key, quick, deep, of_seed, of_deep) AS (VALUES {STEP_SQL}),
x AS (SELECT 'analysis_' || lower(translate(coalesce(seed_url, topic), '/: ', '___')) AS id, (row_number() OVER (PARTITION BY coalesce(seed_url, topic) ORDER BY i) - 1)::INTEGER AS ord, key, CASE WHEN mode = 'deep' THEN deep ELSE quick END AS label FROM r, s WHERE (NOT of_seed OR seed_url IS NOT NULL) AND (NOT of_deep OR mode = 'deep'))
SELECT x.id, x.ord, x.key, label, CASE WHEN x.ord < c.ord THEN 'done' WHEN x.ord = c.ord THEN 'running' ELSE 'pending' END AS status FROM x JOIN (SELECT id, ord FROM x WHERE key = 'extract') c ON c.id = x.id""")
def analysis_steps(spark, sf_dir):
    """The steps of an analysis for each type of events, as a topic and as a seed, at its extraction."""
    kinds = table(spark, sf_dir, "events").select(F.col("event_type").alias("t")).distinct()
    none = F.lit(None).cast("string")
    requests = kinds.select(F.col("t").alias("topic"), none.alias("seed_url"), F.lit("quick").alias("mode")).union(kinds.select(none, F.concat(F.lit("https://arxiv.org/abs/"), "t"), F.lit("deep")))
    return jobs.advance(jobs.step_rows(jobs.analysis_rows(requests)), "extract")


def parses(spark, sf_dir):
    """A parsed sentence for each customer: `N reported the missed payments to L`, `I obtained a loan from L`, or `N began
    charging me a late fee`."""
    who, where, d = F.col("c_name"), F.col("n_name"), F.col("doc_id")
    tok = lambda i, text, lemma, pos, dep, head, ent="", chunk=None: F.struct(F.lit(i).alias("i"), text.alias("text"), F.lit(lemma).alias("lemma"), F.lit(pos).alias("pos"), F.lit(dep).alias("dep"), F.lit(head).alias("head"), F.lit(ent).alias("ent_type"), (F.lit(chunk) if chunk is None or isinstance(chunk, str) else chunk).cast("string").alias("chunk"))
    lit = F.lit
    one = F.array(tok(0, who, "n", "PROPN", "nsubj", 1, "ORG", who), tok(1, lit("reported"), "report", "VERB", "ROOT", 1), tok(2, lit("payments"), "payment", "NOUN", "dobj", 1, "", "the missed payments"), tok(3, lit("to"), "to", "ADP", "prep", 2), tok(4, where, "l", "PROPN", "pobj", 3, "GPE", where))
    two = F.array(tok(0, lit("I"), "I", "PRON", "nsubj", 1), tok(1, lit("obtained"), "obtain", "VERB", "ROOT", 1), tok(2, lit("loan"), "loan", "NOUN", "dobj", 1, "", "a loan"), tok(3, lit("from"), "from", "ADP", "prep", 1), tok(4, where, "l", "PROPN", "pobj", 3, "GPE", where))
    three = F.array(tok(0, who, "n", "PROPN", "nsubj", 1, "ORG", who), tok(1, lit("began"), "begin", "VERB", "ROOT", 1), tok(2, lit("charging"), "charge", "VERB", "xcomp", 1), tok(3, lit("me"), "I", "PRON", "dative", 2), tok(4, lit("fee"), "fee", "NOUN", "dobj", 2, "", "a late fee"))
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).withColumn("doc_id", F.col("c_custkey"))
    return c.select("doc_id", F.lit(0).alias("sent_ix"), F.explode(F.when(d % 3 == 0, one).when(d % 3 == 1, two).otherwise(three)).alias("t")).select("doc_id", "sent_ix", "t.*")


@query("""WITH c AS (SELECT c_custkey AS doc_id, c_name AS name, n_name AS nation FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT doc_id, 0 AS triple_ix, name AS source, 'report' AS relation, 'missed payments' AS target FROM c WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, 1, name, 'report to', nation FROM c WHERE doc_id % 3 = 0
UNION ALL SELECT doc_id, 0, 'loan', 'obtain from', nation FROM c WHERE doc_id % 3 = 1
UNION ALL SELECT doc_id, 0, name, 'charge', 'late fee' FROM c WHERE doc_id % 3 = 2""")
def parsed_triples(spark, sf_dir):
    return extract.triples_from_parses(parses(spark, sf_dir)).select("doc_id", "triple_ix", "source", "relation", "target")


@query("SELECT dep, sum(n)::BIGINT AS n FROM (SELECT unnest(CASE c_custkey % 3 WHEN 0 THEN ['nsubj', 'dobj', 'prep', 'pobj'] WHEN 1 THEN ['nsubj', 'dobj', 'prep', 'pobj'] ELSE ['nsubj', 'xcomp', 'dative', 'dobj'] END) AS dep, 1 AS n FROM customer) GROUP BY 1")
def dependency_counts(spark, sf_dir):
    """How often each dependency stands in the dependency graphs of the parsed sentences."""
    return summary.relation_type_counts(extract.dependency_edges(parses(spark, sf_dir)).withColumnRenamed("dep", "relation_type")).withColumnRenamed("relation_type", "dep")
