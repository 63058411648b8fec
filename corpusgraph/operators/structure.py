"""Document structure: blocks, sections, reference lists. Input documents (doc_id, content)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusgraph.functions import text as fn

# Fixed value: how an entry of a reference list begins.
ENTRY = r"^(?:-\s*)?\[(\d{1,3})\]\s+|^\d{1,3}[\.\)]\s+"


def lines(documents: DataFrame) -> DataFrame:
    """(doc_id, line_ix, line): one row for each line."""
    return documents.select("doc_id", F.posexplode(F.split(F.coalesce("content", F.lit("")), r"\r?\n")).alias("line_ix", "line"))


def _path(mode: str, w: Window) -> Column:
    """The headings above a line, by a window over the document's heading lines: all so far (cumulative; such a path is as long
    as the list of headings before it), or those of the levels that still hold: of each level the last heading, unless one
    of a higher level came after it."""
    if mode == "cumulative":
        return F.collect_list("h").over(w)
    last = [F.last(F.when(F.col("level") == v, F.struct("line_ix", "h")), ignorenulls=True).over(w) for v in range(1, 7)]
    held = [last[0]] + [F.when(F.coalesce(F.greatest(*[x["line_ix"] for x in last[:v]], F.lit(-1)), F.lit(-1)) < last[v]["line_ix"], last[v]) for v in range(1, 6)]
    return F.transform(F.filter(F.array(*held), lambda x: x.isNotNull()), lambda x: x["h"])


def markdown_blocks(documents: DataFrame, heading_mode: str = "levels") -> DataFrame:
    """(doc_id, block_ix, text, headings): runs of lines between headings and blank lines. A heading may be long-lived,
    so its path is made for heading lines only, not for all lines."""
    w = Window.partitionBy("doc_id").orderBy("line_ix")
    df = lines(documents).withColumn("h", fn.heading_text(F.col("line"))).withColumn("blank", fn.strip(F.col("line")) == "")
    df = df.withColumn("part", F.sum((F.col("h").isNotNull() | F.col("blank")).cast("int")).over(w)).withColumn("h_ix", F.sum(F.col("h").isNotNull().cast("int")).over(w))
    heads = df.where("h is not null").withColumn("level", fn.heading_level(F.col("line"))).select(F.col("doc_id").alias("d"), F.col("h_ix").alias("hx"), _path(heading_mode, w).alias("headings"))
    body = df.where("h is null and not blank").groupBy("doc_id", "part", "h_ix").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_ix", "line"))), lambda x: x["line"]), "\n").alias("text"))
    body = body.join(heads, (F.col("doc_id") == F.col("d")) & (F.col("h_ix") == F.col("hx")), "left")
    ix = F.row_number().over(Window.partitionBy("doc_id").orderBy("part")) - 1
    return body.select("doc_id", ix.alias("block_ix"), fn.strip(F.col("text")).alias("text"), F.coalesce("headings", F.array().cast("array<string>")).alias("headings"))


def sections(blocks: DataFrame) -> DataFrame:
    """(doc_id, section_ix, text, headings): consecutive blocks with equal paths, joined by a blank line."""
    w = Window.partitionBy("doc_id").orderBy("block_ix")
    new = F.coalesce(F.lag("headings").over(w) != F.col("headings"), F.lit(True))
    df = blocks.withColumn("new", new.cast("int")).withColumn("section_ix", F.sum("new").over(w) - 1)
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block_ix", "text"))), lambda x: x["text"]), "\n\n")
    return df.groupBy("doc_id", "section_ix").agg(text.alias("text"), F.first("headings").alias("headings"))


def inherit_headings(blocks: DataFrame) -> DataFrame:
    """Blocks of a layout parser: one without headings has those of the block before."""
    w = Window.partitionBy("doc_id").orderBy("block_ix")
    own = F.when(F.size("headings") > 0, F.col("headings"))
    return blocks.withColumn("headings", F.coalesce(F.last(own, ignorenulls=True).over(w), F.array().cast("array<string>")))


def document_sections(documents: DataFrame, parsed_blocks: DataFrame | None = None, heading_mode: str = "levels") -> DataFrame:
    """Sections of parsed blocks where a document has some, else of its markdown."""
    if parsed_blocks is None:
        return sections(markdown_blocks(documents, heading_mode))
    rest = documents.join(parsed_blocks.select("doc_id").distinct(), "doc_id", "left_anti")
    return sections(inherit_headings(parsed_blocks)).unionByName(sections(markdown_blocks(rest, heading_mode)))


def without_boilerplate(sections_: DataFrame, skip: list[str]) -> DataFrame:
    """Sections that are not blank nor under a skip heading; all of a document's if that leaves none."""
    df = sections_.where(fn.token_count(F.col("text")) > 0).withColumn("kept", ~fn.is_skipped(F.col("headings"), skip))
    any_kept = F.max("kept").over(Window.partitionBy("doc_id"))
    return df.withColumn("any_kept", any_kept).where("kept or not any_kept").drop("kept", "any_kept")


def abstracts(sections_: DataFrame, first: int = 5) -> DataFrame:
    """(doc_id, section_ix, text): of each document the first section under a heading with `abstract` in it; else, of its first
    sections, the first that begins with `abstract` or says `this paper` in its first 200 characters; else all its text."""
    low = F.lower("text")
    named = F.exists("headings", lambda h: F.contains(F.lower(h), F.lit("abstract")))
    told = (F.col("section_ix") < first) & (F.startswith(low, F.lit("abstract")) | F.contains(F.substring(low, 1, 200), F.lit("this paper")))
    rank = F.when(named, 0).when(told, 1)
    best = sections_.where(rank.isNotNull()).groupBy("doc_id").agg(F.min_by(F.struct("section_ix", "text"), F.struct(rank, "section_ix")).alias("x")).select("doc_id", "x.*")
    rest = sections_.join(best.select("doc_id"), "doc_id", "left_anti")
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("section_ix", "text"))), lambda x: x["text"]), "\n\n")
    return best.unionByName(rest.groupBy("doc_id").agg(F.min("section_ix").alias("section_ix"), whole.alias("text")))


def reference_lines(documents: DataFrame) -> DataFrame:
    """Lines under the first reference heading up to the next heading that is none."""
    w = Window.partitionBy("doc_id").orderBy("line_ix")
    df = lines(documents).withColumn("h", fn.heading_text(F.col("line"))).withColumn("ref", fn.is_reference_heading(F.col("h")))
    df = df.withColumn("started", F.max(F.coalesce("ref", F.lit(False))).over(w))
    df = df.withColumn("stopped", F.max(F.col("started") & F.col("h").isNotNull() & ~F.coalesce("ref", F.lit(False))).over(w))
    return df.where("started and not stopped and h is null").select("doc_id", "line_ix", fn.strip(F.col("line")).alias("line")).where("line <> ''")


def reference_entries(documents: DataFrame) -> DataFrame:
    """(doc_id, ref_ix, raw_text): a numbered line starts an entry, other lines continue it."""
    w = Window.partitionBy("doc_id").orderBy("line_ix")
    df = reference_lines(documents).withColumn("starts", F.col("line").rlike(ENTRY)).withColumn("entry", F.sum(F.col("starts").cast("int")).over(w))
    df = df.withColumn("piece", F.when(F.col("starts"), F.regexp_replace("line", ENTRY, "")).otherwise(F.col("line")))
    joined = F.array_join(F.filter(F.transform(F.sort_array(F.collect_list(F.struct("line_ix", "piece"))), lambda x: x["piece"]), lambda x: x != ""), " ")
    entries = df.groupBy("doc_id", "entry").agg(joined.alias("raw_text")).where("raw_text <> ''")
    return entries.select("doc_id", (F.row_number().over(Window.partitionBy("doc_id").orderBy("entry")) - 1).alias("ref_ix"), "raw_text")


def cited_ids(entries: DataFrame, scheme: str = "arxiv", max_refs: int = 15) -> DataFrame:
    """(doc_id, ref_ix, source_id): ids in order of reference, each once, the first max_refs of a document."""
    ids = fn.arxiv_ids(F.col("raw_text")) if scheme == "arxiv" else fn.dois(F.col("raw_text"))
    df = entries.select("doc_id", "ref_ix", F.posexplode(ids).alias("pos", "source_id"))
    df = df.groupBy("doc_id", "source_id").agg(F.min(F.struct("ref_ix", "pos")).alias("at"))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("at", "source_id"))
    return df.withColumn("rank", rank).where(F.col("rank") <= max_refs).select("doc_id", F.col("at.ref_ix").alias("ref_ix"), "source_id")
