"""The corpus graph pipeline: documents to sections, topics, segments, mentions, graph and summary."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgraph.functions import text as fn
from corpusgraph.operators import discovery, extract, merge, segment, structure, summary
from corpusgraph.operators.merge import Graph
from corpusgraph.operators.state import cut
from corpusgraph.plans.config import PipelineConfig


@dataclass
class GraphTables:
    sections: DataFrame
    labels: DataFrame
    segments: DataFrame
    entities: DataFrame
    relations: DataFrame
    graph: Graph
    topics: tuple[DataFrame, DataFrame] | None
    doc_summary: DataFrame
    corpus_summary: DataFrame


def build_corpus_graph(documents: DataFrame, config: PipelineConfig | None = None, extractor=extract.lexicon_mentions, parser=None) -> GraphTables:
    """documents (doc_id, ord, content) to all tables. Lineage is cut after the opaque stages only.

    parser makes parsed tokens (doc_id, sent_ix, ...) of sections; with one, triples come from the parses, topics grow along
    them, and what they reach and how they relate it are labels beside the seeds."""
    c = config or PipelineConfig()
    if documents.isEmpty():
        raise ValueError("no documents")
    blocks = structure.markdown_blocks(documents, c.heading_mode)
    sections = structure.without_boilerplate(structure.sections(blocks), c.discovery.skip_headings)
    by = ["doc_id", "section_ix"]
    cands = extract.keyword_candidates(sections, by)
    a = c.adaptive
    n = sections.select(*by, F.least(fn.token_count(F.col("text")), F.lit(250)).alias("n_words"))
    keywords = extract.adaptive_keywords(cands, n, by, a.score_floor, a.min_k, a.max_k, a.words_per_kw, a.max_candidates)
    union = discovery.seed_union(keywords.withColumn("ord", F.struct("section_ix", "rank")))
    seeds = cut(discovery.top_seeds(union, c.discovery.max_seeds).select("doc_id", F.col("keyword").alias("phrase"), F.col("rank").alias("ord")))
    phrases, topics = seeds.withColumn("kind", F.lit("entity")), None
    if parser is not None:
        found = extract.triples_from_parses(parser(sections)).withColumns({"ord": F.col("sent_ix") * 10_000 + F.col("triple_ix"), "evidence": F.lit("")})
        triples = cut(discovery.dedup_triples(found))
        start = seeds.select("doc_id", fn.topic_key(F.col("phrase")).alias("key"), F.col("ord").alias("pos"))
        nodes, used = discovery.expand_topics(start, triples.select("doc_id", "ord", "src", "dst", "relation"), c.discovery.max_depth, c.discovery.max_relations)
        topics = (cut(nodes), cut(used))
        more = topics[0].where("depth > 0").select("doc_id", F.col("key").alias("phrase"), (F.col("depth") * 1_000_000 + F.col("pos")).alias("ord"), F.lit("entity").alias("kind"))
        kinds = topics[1].select("doc_id", F.col("relation").alias("phrase"), "ord", F.lit("relation").alias("kind"))
        phrases = phrases.unionByName(more).unionByName(kinds)
    labels = discovery.taxonomy_labels(phrases)
    if c.segmentation.enabled:
        segments = segment.segments(blocks, c.segmentation.max_tokens, c.segmentation.overlap_tokens)
    else:
        segments = documents.select("doc_id", F.lit(0).alias("segment_ix"), F.col("content").alias("text"), F.array().cast("array<string>").alias("headings"), fn.token_count(F.col("content")).alias("n_tokens"))
    segments = cut(segments)
    wanted = labels.where("kind = 'entity'").select("doc_id", "label")
    mentions = extractor(segments, discovery.filter_labels(segments, wanted) if c.filter_labels else wanted, c.thresholds.entity)
    mentions = cut(mentions.join(documents.select("doc_id", F.col("ord").alias("doc_ord")), "doc_id"))
    relations = extract.adjacent_relations(mentions, F.lit("related_to"), F.lit(0.5)).where(F.col("score") >= c.thresholds.relation)
    g = merge.merge_graph(mentions, relations, c.merge, c.type_policy)
    g.edges = cut(g.edges)
    return GraphTables(sections, labels, segments, mentions, relations, g, topics, summary.doc_novelty(documents, g), summary.corpus_summary(g.nodes, g.edges))
