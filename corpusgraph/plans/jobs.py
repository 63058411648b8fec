"""Analyses: requests, steps, status and results. A request's steps are rows; a run goes through them and keeps, beside its
status, the graph's tables. What the driver holds of an analysis is its status and a list of a few steps and papers."""

from __future__ import annotations

import traceback
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgraph.functions import text as fn
from corpusgraph.operators import summary
from corpusgraph.plans.config import PipelineConfig
from corpusgraph.plans.pipeline import GraphTables, build_corpus_graph
from corpusgraph.sources import readers, sinks

# The steps of an analysis: key, label, label in deep mode, whether it is of seed runs only, of deep mode only.
STEPS = (
    ("fetch_seed", "Fetching seed abstract", "Downloading seed paper", True, False),
    ("references", "Extracting references", "Extracting references", True, False),
    ("fetch_refs", "Fetching referenced abstracts", "Downloading referenced papers", True, False),
    ("parse", "Parsing documents", "Parsing documents", False, True),
    ("taxonomy", "Building topic taxonomy", "Building topic taxonomy", False, False),
    ("segment", "Segmenting documents", "Segmenting documents", False, True),
    ("extract", "Extracting entities and relationships", "Extracting entities and relationships", False, False),
    ("merge", "Merging cross-document graph", "Merging cross-document graph", False, False),
    ("done", "Analysis complete", "Analysis complete", False, False),
)


def analysis_rows(requests: DataFrame) -> DataFrame:
    """(topic, seed_url, mode) -> with id and status; requests with neither topic nor seed are left out. A repeated request
    has the same id."""
    name = F.coalesce("seed_url", "topic")
    return requests.where(F.coalesce(F.col("seed_url"), F.col("topic"), F.lit("")) != "").select(fn.analysis_id(name).alias("id"), F.lit("pending").alias("status"), "topic", "seed_url", "mode", F.lit(0.0).alias("progress"))


def step_rows(analyses: DataFrame) -> DataFrame:
    """(id, ord, key, label, status): the steps of analyses (id, seed_url, mode), in order."""
    seed, deep = F.col("seed_url").isNotNull(), F.col("mode") == "deep"
    steps = [F.when((~F.lit(s) | seed) & (~F.lit(d) | deep), F.struct(F.lit(k).alias("key"), F.when(deep, F.lit(in_deep)).otherwise(F.lit(label)).alias("label"))) for k, label, in_deep, s, d in STEPS]
    return analyses.select("id", F.posexplode(F.filter(F.array(*steps), lambda x: x.isNotNull())).alias("ord", "s")).select("id", "ord", "s.key", "s.label", F.lit("pending").alias("status"))


def start(spark: SparkSession, topic: str | None = None, seed_url: str | None = None, mode: str = "quick") -> tuple[DataFrame, DataFrame]:
    """(analysis row, its steps); one of topic and seed_url is needed."""
    if not (topic or seed_url):
        raise ValueError("Either 'topic' or 'seed_url' must be provided")
    a = analysis_rows(spark.range(1).select(F.lit(topic).cast("string").alias("topic"), F.lit(seed_url).cast("string").alias("seed_url"), F.lit(mode).alias("mode")))
    return a, step_rows(a)


def advance(steps: DataFrame, key: str) -> DataFrame:
    """Steps before key are done, key runs; `done` completes all; an unknown key changes nothing."""
    if key == "done":
        return steps.withColumn("status", F.lit("done"))
    cur = steps.where(F.col("key") == key).groupBy(F.col("id").alias("__id")).agg(F.min("ord").alias("cur"))
    out = steps.join(cur, F.col("id") == F.col("__id"), "left")
    status = F.when(F.col("cur").isNull(), F.col("status")).when(F.col("ord") < F.col("cur"), "done").when(F.col("ord") == F.col("cur"), "running").otherwise(F.col("status"))
    return out.withColumn("status", status).drop("__id", "cur")


def progress_percent(progress: Column) -> Column:
    return F.floor(progress * 100 + 0.5).cast("int")


def saved_analyses(results: DataFrame) -> DataFrame:
    """(analysis_id, doc_id, node_id, n_docs): what analyses found -> for each its topics, references and unique topics."""
    return results.groupBy("analysis_id").agg(F.countDistinct("node_id").alias("topics"), F.countDistinct("doc_id").alias("references"), F.countDistinct(F.when(F.col("n_docs") == 1, F.col("node_id"))).alias("unique_topics"))


@dataclass
class Analysis:
    id: str
    topic: str | None
    seed_url: str | None
    mode: str
    steps: list[dict]
    status: str = "pending"
    progress: float = 0.0
    current_step: str = ""
    detail: str = ""
    error: str | None = None
    papers: list[dict] = field(default_factory=list)
    tables: GraphTables | None = None
    result: dict | None = None

    def update(self, key: str, progress: float, detail: str = "") -> None:
        self.current_step, self.progress, self.detail = key, progress, detail
        at = next((i for i, s in enumerate(self.steps) if s["key"] == key), -1)
        self.status = "completed" if key == "done" else "running"
        for i, s in enumerate(self.steps):
            s["status"] = "done" if key == "done" or i < at else "running" if i == at else s["status"]


class Analyses:
    """Analyses over a table of papers (arxiv_id, title, summary, fulltext, published, updated)."""

    def __init__(self, spark: SparkSession, papers: DataFrame, config: PipelineConfig | None = None):
        self.spark, self.papers, self.config, self.known = spark, papers, config or PipelineConfig(), {}

    def start(self, topic: str | None = None, seed_url: str | None = None, mode: str = "quick", max_papers: int = 2, max_references: int = 15) -> Analysis:
        """Run an analysis to its end; what fails is in its status. Repeating a request replaces it."""
        row, steps = start(self.spark, topic, seed_url, mode)
        a = Analysis(row.first()["id"], topic, seed_url, mode, [r.asDict() for r in steps.orderBy("ord").select("key", "label", "status").collect()])
        self.known[a.id] = a
        try:
            self._run(a, max_papers, max_references)
        except Exception as e:  # noqa: BLE001 - an analysis that fails says so in its status
            a.status, a.error, a.detail = "error", str(e), traceback.format_exc()
        return a

    def status(self, analysis_id: str) -> Analysis:
        if analysis_id not in self.known:
            raise LookupError("Analysis not found")
        return self.known[analysis_id]

    def result(self, analysis_id: str) -> dict:
        a = self.status(analysis_id)
        if a.status != "completed":
            raise ValueError("Analysis not completed yet")
        return a.result

    def subgraph(self, analysis_id: str, topic: str = "", source: str = "") -> tuple[DataFrame, DataFrame]:
        self.result(analysis_id)
        g = self.known[analysis_id].tables.graph
        return summary.sub_graph(summary.with_source_class(g.nodes, F.lit(self.known[analysis_id].papers[0]["id"])), g.edges, topic, source)

    def _run(self, a: Analysis, max_papers: int, max_references: int) -> None:
        if a.seed_url:
            a.update("fetch_seed", 0.05, f"Fetching seed paper: {a.seed_url}")
            source = readers.SeedPaper(self.papers, a.seed_url, max_references)
            a.update("references", 0.10, "Extracting references...")
            docs = source.fetch(self.spark) if a.mode == "deep" else source.fetch_abstracts(self.spark)
            a.update("fetch_refs", 0.30)
        else:
            docs = readers.StoredPapers(self.papers, a.topic, max_papers).fetch()
        docs = docs.orderBy("ord").collect()  # at most a seed and its max_references, or max_papers
        if not docs:
            raise ValueError(f"Could not fetch seed paper: {a.seed_url}" if a.seed_url else f"No papers found for topic: {a.topic}")
        a.papers = [{"id": r["doc_id"], "title": self._title(r["doc_id"])} for r in docs]
        table = self.spark.createDataFrame([tuple(r) for r in docs], "doc_id string, ord int, content string, source string, metadata string")
        quick = a.mode == "quick"
        a.update("taxonomy", 0.40)
        config = replace(self.config, merge="containment" if quick else self.config.merge, segmentation=replace(self.config.segmentation, enabled=self.config.segmentation.enabled and not quick))
        a.update("extract", 0.50)
        a.tables = build_corpus_graph(table, config)
        a.update("merge", 0.90)
        g = a.tables.graph
        a.result = {
            "id": a.id, "topic": a.topic or a.seed_url or "", "papers": a.papers, "topics": sinks.result_topics(g, F.lit(a.papers[0]["id"])),
            "relationships": sinks.result_relationships(g), "stats": a.tables.corpus_summary.first().asDict(),
        }
        a.update("done", 1.0, "Analysis complete")

    def _title(self, doc_id: str) -> str:
        row = self.papers.where(F.concat(F.lit("arxiv:"), "arxiv_id") == doc_id).select("title").first()
        return row["title"] if row and row["title"] else doc_id
