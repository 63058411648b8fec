"""Sources: files of a folder, stored papers, and a seed paper with what it cites. Every source gives
documents(doc_id, ord, content, source, metadata) where metadata is JSON text."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusgraph.functions import text as fn
from corpusgraph.operators import structure
from corpusgraph.operators.order import running


log = logging.getLogger(__name__)


@dataclass(frozen=True)
class SourceCapabilities:
    can_search: bool = False
    can_fetch_fulltext: bool = False
    can_download_pdf: bool = False
    has_references: bool = False
    reference_format: str | None = None


class DataSource(Protocol):
    """What every source is: it says what it can do, and gives documents."""

    capabilities: SourceCapabilities

    def fetch(self, spark: SparkSession) -> DataFrame: ...


DOCUMENT = ["doc_id", "ord", "content", "source", "metadata"]


def parse_whole(raw: DataFrame, kind: str) -> DataFrame:
    """(path, value) of whole files of a kind -> content and metadata."""
    if kind == "json":
        return raw.select("path", F.coalesce(F.get_json_object("value", "$.text"), F.lit("")).alias("content"), without_text("value").alias("metadata"))
    return raw.select("path", F.col("value").alias("content"), F.lit("{}").alias("metadata"))


def without_text(column: str):
    """The JSON object without its key `text`, values as they are."""
    pairs = F.map_filter(F.from_json(column, "map<string,string>"), lambda k, v: k != "text")
    return F.coalesce(F.to_json(pairs), F.lit("{}"))


#: kind -> whether files are read whole as text; csv has a row for each document, pdf needs a plug-in converter.
PARSERS = {"txt": True, "md": True, "json": True, "csv": False, "pdf": False}


_built: dict = {}


def once(make: Callable):
    """What make builds, built once in a worker process and then reused."""
    key = f"{make.__module__}.{make.__qualname__}"
    if key not in _built:
        _built[key] = make()
    return _built[key]


def convert_with(make: Callable) -> Callable[[DataFrame], DataFrame]:
    """A converter for LocalFiles of (path, body): make builds, once in a worker, a function from bytes to (text, pages). A file
    that it can't convert is left out."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        convert = once(make)
        for pdf in frames:
            rows = []
            for path, body in zip(pdf["path"], pdf["body"], strict=True):
                try:
                    rows.append((path, *convert(bytes(body))))
                except Exception as e:  # noqa: BLE001 - one broken file does not stop the others
                    log.warning("not converted: %s: %s", path, e)
            yield pd.DataFrame(rows, columns=["path", "content", "n_pages"])

    return lambda raw: raw.mapInPandas(run, "path string, content string, n_pages int")


class LocalFiles:
    """Files `*.kind` of a folder, not below it, in order of path; the id is the file's stem."""

    capabilities = SourceCapabilities(can_fetch_fulltext=True)

    def __init__(self, folder: str, kind: str = "txt", max_pages: int | None = None, convert=None):
        if kind not in PARSERS:
            raise ValueError(f"unknown file type {kind!r}")
        if kind == "pdf" and convert is None:
            raise ValueError("pdf needs a converter: a function from (path, bytes) DataFrames to (path, content, n_pages)")
        self.folder, self.kind, self.max_pages, self.convert = folder.rstrip("/"), kind, max_pages, convert

    def fetch(self, spark: SparkSession) -> DataFrame:
        pattern = f"{self.folder}/*.{self.kind}"
        if self.kind == "csv":
            place = F.struct("_metadata.file_block_start", F.monotonically_increasing_id().alias("row"))
            parsed = spark.read.option("header", True).csv(pattern).withColumns({"path": F.col("_metadata.file_path"), "__at": place})
            if "text" not in parsed.columns:
                raise ValueError("a csv source needs a column `text`")
            rest = [c for c in parsed.columns if c not in ("text", "path", "__at")]
            within_file = F.row_number().over(Window.partitionBy("path").orderBy("__at")) - 1
            parsed = parsed.select("path", within_file.alias("row"), F.coalesce("text", F.lit("")).alias("content"), (F.to_json(F.struct(*rest)) if rest else F.lit("{}")).alias("metadata"))
        elif self.kind == "pdf":
            raw = spark.read.format("binaryFile").load(pattern).select("path", F.col("content").alias("body"))
            parsed = self.convert(raw)
            if self.max_pages:
                parsed = parsed.where(F.col("n_pages") <= self.max_pages)
            parsed = parsed.select("path", "content", F.lit("{}").alias("metadata"))
        else:
            raw = spark.read.text(pattern, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
            parsed = parse_whole(raw, self.kind)
        stem = F.regexp_extract("path", r"([^/]*)\.[^./]*$", 1)
        if self.kind != "csv":
            parsed = parsed.withColumn("row", F.lit(0))
        # Files are put in order over their paths and numbers of rows alone, not over their contents.
        files = parsed.groupBy("path").agg(F.count(F.lit(1)).alias("rows"))
        parsed = parsed.join(running(files, [F.col("path")], {"before": F.col("rows")}).drop("rows"), "path")
        return parsed.select(stem.alias("doc_id"), (F.col("before") + F.col("row")).cast("int").alias("ord"), "content", F.lit(f"local_{self.kind}").alias("source"), "metadata")

    fetch_fulltext = fetch


class StoredPapers:
    """A table of papers (arxiv_id, title, summary, published, ...) in place of a remote index, searched and sorted by
    the same three keys."""

    capabilities = SourceCapabilities(True, True, False, True, "arxiv")
    SORT = {"relevance": "hits", "submitted": "published", "updated": "updated"}

    def __init__(self, papers: DataFrame, query: str, max_results: int = 100, sort_by: str = "relevance"):
        if sort_by not in self.SORT:
            raise ValueError(f"unknown sort key {sort_by!r}")
        self.papers, self.query, self.max_results, self.sort_by = papers, query, max_results, sort_by

    def search(self) -> DataFrame:
        terms = F.array(*[F.lit(t.lower()) for t in self.query.split()])
        text = F.lower(F.concat_ws(" ", "title", "summary"))
        found = self.papers.withColumn("hits", F.size(F.filter(terms, lambda t: F.contains(text, t)))).where("hits > 0")
        return found.orderBy(F.desc(self.SORT[self.sort_by]), "arxiv_id").limit(self.max_results)

    def fetch(self, spark: SparkSession | None = None) -> DataFrame:
        """One document of its summary for each paper found."""
        return as_documents(self.search())

    def fetch_fulltext(self, cache_path: str | None = None, parse=None) -> DataFrame:
        """One document of its full text for each paper found; papers without one are left out. Texts come from the column
        fulltext or, with a cache and a parser (a function from papers to (doc_id, content)), from what is parsed and
        kept there: a text is parsed once."""
        found = self.search()
        docs = as_documents(found, "fulltext", "arxiv_fulltext")
        if cache_path:
            docs = parse_missing(docs, cache_path, parse or (lambda d: d))
        return docs.where("content is not null").select(DOCUMENT)


def pdf_path(arxiv_id: Column, folder: str) -> Column:
    """Where a paper's PDF is kept."""
    return F.concat(F.lit(f"{folder.rstrip('/')}/"), fn.file_id(arxiv_id), F.lit(".pdf"))


def to_download(papers: DataFrame, folder: str, have: DataFrame) -> DataFrame:
    """(arxiv_id, pdf_url, path) of the papers with an address whose file is not among those there are; have: (path).
    Fetching them is for whatever has a network: the engine has none."""
    wanted = papers.where("pdf_url is not null and pdf_url <> ''").select("arxiv_id", "pdf_url", pdf_path(F.col("arxiv_id"), folder).alias("path"))
    return wanted.join(have.select("path"), "path", "left_anti").select("arxiv_id", "pdf_url", "path")


def as_documents(papers: DataFrame, content: str = "summary", source: str = "arxiv") -> DataFrame:
    """Papers as documents: one column is the content, all but the texts the metadata. (A search's papers are few, so their
    order is numbered in one task, over ids alone.)"""
    order = papers.select("arxiv_id").withColumn("ord", F.row_number().over(Window.orderBy("arxiv_id")) - 1)
    rest = [c for c in papers.columns if c not in ("hits", "fulltext")]
    return papers.join(F.broadcast(order), "arxiv_id").select(F.concat(F.lit("arxiv:"), "arxiv_id").alias("doc_id"), "ord", F.col(content).alias("content"), F.lit(source).alias("source"), F.to_json(F.struct(*rest)).alias("metadata"))


class SeedPaper:
    """A paper and the papers it cites (one hop), in order of reference; ids that the table lacks are skipped."""

    capabilities = SourceCapabilities(False, True, True, True, "arxiv")

    def __init__(self, papers: DataFrame, seed_url: str, max_references: int = 15):
        self.papers, self.seed_url, self.max_references = papers, seed_url, max_references

    def fetch(self, spark: SparkSession) -> DataFrame:
        """The seed and what it cites, all in full text; a paper without one is left out."""
        return self._documents(spark, F.col("fulltext")).where("content is not null")

    def fetch_abstracts(self, spark: SparkSession) -> DataFrame:
        """The seed in full text, or its summary where it has none, and the summaries of what it cites."""
        return self._documents(spark, F.col("summary"))

    def _documents(self, spark: SparkSession, cited_content: Column) -> DataFrame:
        seed_id = spark.range(1).select(fn.arxiv_id_of(F.lit(self.seed_url)).alias("id")).first()["id"]
        if not seed_id:
            raise ValueError(f"no arXiv id in {self.seed_url!r}")
        seed = self.papers.where(F.col("arxiv_id") == seed_id)
        text = F.coalesce("fulltext", "summary")
        entries = structure.reference_entries(seed.select(F.col("arxiv_id").alias("doc_id"), text.alias("content")))
        cited = structure.cited_ids(entries, "arxiv", self.max_references)
        refs = cited.join(self.papers, cited["source_id"] == self.papers["arxiv_id"]).where(F.col("arxiv_id") != seed_id)
        first = seed.select("arxiv_id", text.alias("content"), F.lit(-1).alias("ref_ix"), F.lit("arxiv_seed").alias("source"))
        every = first.unionByName(refs.select("arxiv_id", cited_content.alias("content"), "ref_ix", F.lit("arxiv").alias("source")))
        order = F.row_number().over(Window.orderBy("ref_ix", "arxiv_id")) - 1  # a seed and at most max_references
        return every.select(F.concat(F.lit("arxiv:"), "arxiv_id").alias("doc_id"), order.alias("ord"), "content", "source", F.lit("{}").alias("metadata"))


def build_source(config: dict, papers: DataFrame | None = None):
    """A source from a configuration block: type local_files, arxiv or seed_paper."""
    kind = config.get("type")
    if kind == "local_files":
        return LocalFiles(config["folder"], config.get("file_type", "txt"), config.get("max_pages"), config.get("convert"))
    if kind == "arxiv":
        if not config.get("query"):
            raise ValueError("an arxiv source needs a query")
        return StoredPapers(papers, config["query"], config.get("max_results", 100), config.get("sort_by", "relevance"))
    if kind == "seed_paper":
        if not config.get("seed_url"):
            raise ValueError("a seed_paper source needs seed_url")
        return SeedPaper(papers, config["seed_url"], config.get("max_references", 15))
    raise ValueError(f"unknown source type {kind!r}")


def parse_missing(documents: DataFrame, cache_path: str, parse) -> DataFrame:
    """A write-once cache of parsed texts (doc_id, content): only documents that it lacks are parsed and appended."""
    spark = documents.sparkSession
    try:
        have = spark.read.parquet(cache_path)
        new = documents.join(have.select("doc_id"), "doc_id", "left_anti")
    except Exception as e:  # noqa: BLE001 - an absent cache is an empty one, anything else is an error
        if "PATH_NOT_FOUND" not in str(e):
            raise
        new = documents
    parse(new).select("doc_id", "content").where("content is not null").write.mode("append").parquet(cache_path)
    return documents.drop("content").join(spark.read.parquet(cache_path), "doc_id")
