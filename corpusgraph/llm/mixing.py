"""Mixing sources to target weights by Pareto order sampling.

A source's target (in words) over its size is the number of copies each of its documents should get. The whole part
is given to every document for certain; the rest is sampled. Each document draws a random number U fixed by its id, and
gets the rank value Q = odds(U) / odds(inclusion probability): the documents with the smallest Q of a source form the
sample, which is of fixed size (in words, to within half a document) instead of the random size of independent draws.
Inclusion probabilities are unequal: proportional to a document's weight (its size in words, unless another is given),
and such that the source's expected words are its rest. Where that would exceed 1 the document is taken for certain (Q is
0) and the others' probabilities are scaled to what is then left, again until none exceeds 1.

A source may hold most of the corpus, so no window or sort runs over a source: word sums by (source, slice of Q)
are pre-aggregated, a running sum over the slices finds the one slice in which the sample ends, and only that slice,
1/slices of a source, is ordered document by document. The slices grow in number with the corpus. Nor does one task hold
all sources: they are numbered range by range, and both kinds of scaling (targets under their caps, probabilities under
1) are repeated aggregations until nothing is newly capped, which ends because what is capped stays so.

Edge cases. Null texts have size 0. Sources are ordered by code point, a null source last as a source of its own;
a source of size 0 has target 0. A null id draws as the empty string does. Rows with the same source and id draw the
same number; of equal weight, they are taken or left together. Weights that are null or negative count as 0: such a row
is taken only if all others are. An empty table gives an empty result. Other columns are never read; the mix returns
them untouched, whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusgraph.llm.common import SPACE_WORD_BREAK, cut, hinted
from corpusgraph.operators.order import running


@dataclass(frozen=True)
class MixParams:
    weights: tuple = (5, 2, 1)
    budget: float = 1.5
    most_copies: int = 2
    seed: str = "mix-1"
    rows_per_slice: int = 100_000
    least_slices: int = 256
    broadcast_rows: int = 10_000


def word_count(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_WORD_BREAK), "")).cast("long")


def draw(id_col: Column, seed: str) -> Column:
    """U in (0, 1), the same in every run: the first 48 bits of an md5."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("")))
    return (F.conv(F.substring(F.md5(key), 1, 12), 16, 10).cast("double") + F.lit(0.5)) / F.lit(281474976710656.0)


def targets(sizes: DataFrame, p: MixParams) -> DataFrame:
    """(source, size) once for each source -> source, source_size, target.

    Water filling: all share what is left by weight; those whose cap is not above their share get the cap, and the others
    share the rest anew."""
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in p.weights]), (F.col("at") % len(p.weights) + 1).cast("int"))
    by_code_point = [F.col("source").isNull(), F.col("source").asc_nulls_last()]
    df = cut(running(sizes, by_code_point, {"at": F.lit(1)}).withColumn("weight", weight).withColumn("cap", p.most_copies * F.col("size")))
    total = df.agg(F.sum("size").alias("size"), F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("n")).first()
    level, capped = (p.budget * total["size"] / total["weight"] if total["n"] else 0.0), 0
    while True:
        full = F.col("cap") <= F.lit(level) * F.col("weight")
        got = df.where(full).agg(F.coalesce(F.sum("cap"), F.lit(0)).alias("cap"), F.coalesce(F.sum("weight"), F.lit(0)).alias("weight"), F.count(F.lit(1)).alias("n")).first()
        if got["n"] in (capped, total["n"]):
            break
        level, capped = (p.budget * total["size"] - got["cap"]) / (total["weight"] - got["weight"]), got["n"]
    return df.select("source", F.col("size").alias("source_size"), F.least(F.col("cap").cast("double"), F.lit(level) * F.col("weight")).alias("target"))


def with_scale(per_source: DataFrame, sized: DataFrame, p: MixParams) -> DataFrame:
    """per_source (source, rest, ...) with scale: a document's inclusion probability is scale times its weight, and it is
    taken for certain where that is 1 or more."""
    by_weight = cut(sized.groupBy("source", "weight").agg(F.sum("size").alias("words")))
    now, certain = per_source.select("source", "rest", F.lit(0.0).alias("scale")), None
    while True:
        side = hinted(now.withColumnRenamed("source", "__s"), p.broadcast_rows)
        taken = F.col("scale") * F.col("weight") >= 1
        parts = by_weight.join(side, F.col("source").eqNullSafe(F.col("__s"))).groupBy("source", "rest").agg(
            F.coalesce(F.sum(F.when(taken, F.col("words"))), F.lit(0)).alias("fixed"),
            F.coalesce(F.sum(F.when(~taken, F.col("words") * F.col("weight"))), F.lit(0.0)).alias("open"),
            F.count_if(taken).alias("n"),
        )
        now = cut(parts.select("source", "rest", F.coalesce(F.try_divide(F.col("rest") - F.col("fixed"), F.col("open")), F.lit(0.0)).alias("scale"), "n"))
        n = now.agg(F.sum("n")).first()[0]
        if n == certain or not n and certain is not None:
            break
        certain = n
    out = per_source.join(now.select(F.col("source").alias("__s"), "scale"), F.col("source").eqNullSafe(F.col("__s")), "left").drop("__s")
    return cut(out.withColumn("scale", F.coalesce("scale", F.lit(0.0))))


def plan(sized: DataFrame, p: MixParams) -> DataFrame:
    """(id, source, size, weight) for each document -> for each source: source_size, target, whole copies, scale, and the
    rank value up to which documents get one copy more (rank_to, id_to)."""
    rows = sized.count()
    slices = max(p.least_slices, math.ceil(rows / p.rows_per_slice))
    per_source = targets(sized.groupBy("source").agg(F.sum("size").alias("size")), p)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    per_source = per_source.withColumn("whole", F.floor(ratio).cast("long"))
    per_source = per_source.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")).withColumn("inclusion", ratio - F.col("whole"))
    per_source = with_scale(cut(per_source), sized, p)
    slice_ = F.when(F.col("q") == 0, F.lit(-1)).otherwise(F.floor(F.col("q") / (1 + F.col("q")) * slices)).cast("int")  # what is certain fits
    drawn = with_rank(sized, per_source.where("inclusion > 0"), p).withColumn("slice", slice_)
    by_slice = drawn.groupBy("source", "slice", "rest").agg(F.sum("size").alias("words"))
    run = F.sum("words").over(Window.partitionBy("source").orderBy("slice"))
    last = by_slice.withColumn("upto", run).where("upto > rest").groupBy("source").agg(F.min(F.struct("slice", (F.col("upto") - F.col("words")).alias("before"))).alias("x"))
    last = cut(last.select("source", F.col("x.slice").alias("slice"), F.col("x.before").alias("before")))
    edge = drawn.join(hinted(last.withColumnRenamed("source", "s"), p.broadcast_rows), F.col("source").eqNullSafe(F.col("s")) & (drawn["slice"] == last["slice"]))
    edge = edge.withColumn("id", F.coalesce(F.col("id").cast("string"), F.lit(""))).groupBy("source", "q", "id", "before", "rest").agg(F.sum("size").alias("size"))
    run = F.sum("size").over(Window.partitionBy("source").orderBy("q", "id"))
    edge = edge.withColumn("mid", F.col("before") + run - F.col("size") / 2).where("mid <= rest").groupBy("source").agg(F.max(F.struct("q", "id")).alias("to"))
    end = last.select(F.col("source").alias("s1"), (F.greatest("slice", F.lit(0)) / F.lit(slices)).alias("from_u")).join(edge.withColumnRenamed("source", "s2"), F.col("s1").eqNullSafe(F.col("s2")), "left")
    # Without a row in the last slice the sample ends where that slice begins.
    end = end.select("s1", F.coalesce(F.col("to.q"), F.try_divide(F.col("from_u"), 1 - F.col("from_u"))).alias("rank_to"), F.col("to.id").alias("id_to"))
    out = per_source.join(end, F.col("source").eqNullSafe(F.col("s1")), "left").drop("s1")
    return cut(out)


def with_rank(df: DataFrame, per_source: DataFrame, p: MixParams) -> DataFrame:
    """df (id, source, weight, ...) with its source's columns and the rank value q (null where nothing is sampled)."""
    side = hinted(per_source.withColumnRenamed("source", "__s"), p.broadcast_rows)
    out = df.join(side, F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    u = draw(F.col("id"), p.seed)
    p_in = F.greatest(F.col("scale") * F.col("weight"), F.lit(1e-12))
    q = F.when(p_in >= 1, F.lit(0.0)).otherwise(u / (1 - u) / (p_in / (1 - p_in)))
    return out.withColumn("q", F.when(F.col("inclusion") > 0, q))


def copies(id_col: str = "id") -> Column:
    """Copies of a row that has its source's plan and its rank value."""
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    more = (F.col("inclusion") > 0) & (F.col("rank_to").isNull() | (F.col("q") == 0) | (F.col("q") < F.col("rank_to")) | ((F.col("q") == F.col("rank_to")) & (key <= F.coalesce(F.col("id_to"), F.lit("")))))
    return F.col("whole") + F.when(F.coalesce(more, F.lit(False)), F.lit(1)).otherwise(F.lit(0))


def _weight(size: Column, weight: str | Column | None) -> Column:
    given = size if weight is None else F.col(weight) if isinstance(weight, str) else weight
    return F.greatest(F.coalesce(given.cast("double"), F.lit(0.0)), F.lit(0.0))


def _sized(docs: DataFrame, id_col: str, source: str, text: str, weight: str | Column | None) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), *([] if weight is None else [_weight(F.lit(0), weight).alias("weight")]))
    return cut(rows if weight is not None else rows.withColumn("weight", _weight(F.col("size"), None)))


def allocate(docs: DataFrame, id_col: str = "doc_id", source: str = "source", text: str = "text", weight: str | Column | None = None, p: MixParams | None = None) -> DataFrame:
    """One row for each document: id, source, size, source_size, target (words of its source) and taken (words)."""
    p = p or MixParams()
    sized = _sized(docs, id_col, source, text, weight)
    out = with_rank(sized, plan(sized, p), p).withColumn("copies", copies())
    return out.select(F.col("id").alias(id_col), F.col("source").alias(source), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame, id_col: str = "doc_id", source: str = "source", text: str = "text", weight: str | Column | None = None, p: MixParams | None = None) -> DataFrame:
    """The documents as often as the mix takes them, with all their columns."""
    p = p or MixParams()
    per_source = plan(_sized(docs, id_col, source, text, weight), p)
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.col(source).alias("source"), _weight(word_count(F.col(text)), weight).alias("weight"))
    out = with_rank(rows, per_source, p).withColumn("copies", copies())
    return out.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("__n")).select("row.*")


def oracle_sql(p: MixParams | None = None) -> str:
    p = p or MixParams()
    weights = "[" + ", ".join(map(str, p.weights)) + "]"
    return rf"""
WITH d AS (
  SELECT doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> ''))::BIGINT AS size,
    (('0x' || substr(md5('{p.seed}:' || coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0 AS u FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, {p.most_copies} * source_size AS cap, list_extract({weights}, (mod(pos, {len(p.weights)}) + 1)::BIGINT) AS weight
  FROM (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS pos FROM s)),
o AS (SELECT *, ({p.budget}::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap / weight, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS share FROM w),
l AS (SELECT arg_min(share, (cap / weight, pos)) FILTER (cap > share * weight) AS level FROM o),
t AS (SELECT source, source_size, CASE WHEN level IS NULL THEN cap::DOUBLE ELSE least(cap::DOUBLE, level * weight) END AS target FROM o, l),
r AS (SELECT d.*, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole,
  CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS ratio FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
-- Heaviest first: a weight is certain while, of what the heavier leave, its share is one or more.
x AS (SELECT source, size AS weight, sum(size) AS words, any_value(target - whole * source_size) AS rest FROM r GROUP BY source, size),
y AS (SELECT *, weight > 0 AND weight * (rest - coalesce(sum(words) OVER (PARTITION BY source ORDER BY weight DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  >= sum(weight * words) OVER (PARTITION BY source ORDER BY weight ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS certain FROM x),
z AS (SELECT source, coalesce((any_value(rest) - coalesce(sum(words) FILTER (certain), 0)) / nullif(sum(weight * words) FILTER (NOT certain), 0)::DOUBLE, 0) AS scale,
  coalesce(min(weight) FILTER (certain), 9e18) AS certain_from FROM y GROUP BY source),
p AS (SELECT r.*, CASE WHEN size >= certain_from THEN 1 ELSE greatest(scale * size::DOUBLE, 1e-12) END AS p_in FROM r JOIN z ON r.source IS NOT DISTINCT FROM z.source),
o2 AS (SELECT *, CASE WHEN p_in >= 1 THEN 0 ELSE u / (1 - u) / (p_in / (1 - p_in)) END AS odds FROM p),
q AS (SELECT *, target - whole * source_size AS rest,
  sum(size) OVER (PARTITION BY source ORDER BY odds, doc_id) AS upto,
  sum(size) OVER (PARTITION BY source, odds, doc_id) AS peers FROM o2)
SELECT doc_id, size, source_size, target,
  (size * (whole + CASE WHEN ratio > whole AND (odds = 0 OR upto - peers / 2 <= rest) THEN 1 ELSE 0 END))::BIGINT AS taken FROM q"""
