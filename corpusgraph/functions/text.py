"""Scalar functions of the engine, each a Column from Columns. All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Headings of a bibliography, and articles that a key drops.
REFERENCE_HEADINGS = ("references", "bibliography", "literature cited", "works cited", "cited works")
ARTICLES = "the|a|an"
ARXIV_ID = r"\b(\d{4}\.\d{4,5}(?:v\d+)?)\b"
SENTENCE_END = r"(?<=[.!?])\s+"
DOI = r"(10\.\d{4,9}/[^\s,;]+)"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def canonical(text: Column) -> Column:
    """Key of an entity text: lower case, runs of white space, hyphens and underscores one space, one leading article off."""
    spaced = F.regexp_replace(F.lower(strip(text)), r"[\s\-_]+", " ")
    whole = strip(F.regexp_replace(spaced, rf"^({ARTICLES}) ", ""))
    return F.when(text.rlike(r"[\s\-_]"), whole).otherwise(F.lower(text))  # most are one word


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"\s+"), "")


def token_subset(short: Column, long: Column) -> Column:
    """Whether every token of `short` is in `long`; true for an empty `short`."""
    return F.size(F.array_except(words(short), words(long))) == 0


def touches(a: Column, b: Column) -> Column:
    """Whether two texts share a token."""
    return F.arrays_overlap(words(a), words(b))


def entity_id(text: Column, kind: Column) -> Column:
    return F.substring(F.md5(F.concat(kind, F.lit(":"), F.lower(strip(text)))), 1, 12)


def label(text: Column) -> Column:
    return F.replace(text, F.lit(" "), F.lit("_"))


def topic_key(text: Column) -> Column:
    return F.lower(strip(text))


def is_skipped(headings: Column, skip: list[str]) -> Column:
    """Whether a skip word is part of any heading of the path, whatever its case."""
    return F.exists(headings, lambda h: F.exists(F.array(*[F.lit(s.lower()) for s in skip]), lambda s: F.contains(F.lower(h), s)))


def heading_text(line: Column) -> Column:
    """The heading of a markdown heading line, or null."""
    return F.when(line.rlike(r"^#{1,6}\s+"), strip(F.regexp_extract(line, r"^#{1,6}\s+(.*)$", 1)))


def heading_level(line: Column) -> Column:
    return F.length(F.regexp_extract(line, r"^(#{1,6})\s", 1))


def sentences(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SENTENCE_END), lambda s: F.length(strip(s)) > 0)


def token_count(text: Column) -> Column:
    return F.size(words(text))


def tail_tokens(text: Column, n: Column) -> Column:
    """The last n tokens; nothing for n below one."""
    w = words(text)
    return F.when(n <= 0, F.lit("")).otherwise(F.array_join(F.slice(w, F.greatest(F.size(w) - n + 1, F.lit(1)), F.greatest(n, F.lit(0))), " "))


def hard_chunks(text: Column, size: int) -> Column:
    """Consecutive pieces of at most `size` tokens."""
    w = words(text)
    starts = F.when(F.size(w) > 0, F.sequence(F.lit(0), F.size(w) - 1, F.lit(size))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(w, i + 1, F.lit(size)), " "))


def token_budget(max_tokens: int, model_max: int = 1024, reserve: int = 8) -> int:
    return max(1, min(max_tokens, model_max) - reserve)


def heading_prefix_tokens(headings: Column) -> Column:
    """Tokens that a heading path takes at the head of a segment."""
    return F.when(F.size(headings) > 0, token_count(F.array_join(headings, "\n"))).otherwise(F.lit(0))


def is_reference_heading(heading: Column) -> Column:
    return F.lower(strip(heading)).isin(*REFERENCE_HEADINGS)


def arxiv_ids(text: Column) -> Column:
    """Distinct ids with their version, in lexicographic order."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(ARXIV_ID), 1)))


def dois(text: Column) -> Column:
    """All DOIs in text order."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(DOI), 1)


def arxiv_id_of(address: Column) -> Column:
    """The id in an arXiv address, else the first bare id anywhere, else null."""
    got = lambda pattern: F.nullif(F.regexp_extract(address, pattern, 1), F.lit(""))
    return F.coalesce(got(r"arxiv\.org/(?:abs|pdf|html)/(\d{4}\.\d{4,5}(?:v\d+)?)"), got(r"(\d{4}\.\d{4,5}(?:v\d+)?)"))


def without_determiner(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?i)^({ARTICLES})\s+", "")


def first_words(text: Column, n: int = 250) -> Column:
    return F.array_join(F.slice(words(text), 1, n), " ")


def keyword_bounds(n_words: Column, min_k: int = 2, max_k: int = 20, per_keyword: int = 40, max_candidates: int = 25) -> Column:
    """(lo, hi, pool) of the adaptive keyword count; the estimate rounds half to even."""
    est = F.bround(n_words / F.lit(per_keyword)).cast("int")
    hi = F.greatest(F.lit(min_k), F.least(F.lit(max_k), est))
    return F.struct(F.lit(min_k).alias("lo"), hi.alias("hi"), F.greatest(hi, F.least(F.lit(max_candidates), est)).alias("pool"))


def norm(v: Column) -> Column:
    return F.greatest(F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))), F.lit(1e-10))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def analysis_id(name: Column) -> Column:
    return F.concat(F.lit("analysis_"), F.lower(F.translate(name, "/: ", "___")))


def file_id(name: Column) -> Column:
    return F.replace(name, F.lit("/"), F.lit("_"))


def preview(text: Column, n: int = 200) -> Column:
    return F.substring(F.regexp_replace(text, r"\s+", " "), 1, n)


def percent(part: Column, whole: Column) -> Column:
    return F.floor(F.lit(100.0) * part / F.greatest(whole, F.lit(1)) + 0.5).cast("long")


def source_class(n_docs: Column, first_doc: Column, main: Column) -> Column:
    """shared, main or reference, from the documents that hold a node or an edge."""
    return F.when(n_docs > 1, "shared").when(first_doc == main, "main").otherwise("reference")


def iso_time(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
