"""URL filters: a temporal join of captures with dated lists.

A list is a table of dated entries (entry_id, kind, pattern, verdict, dated, removed): an addition, or a removal, of
a pattern on a day. For each pattern the entries become validity intervals [dated, next entry of that pattern), and a
removal only ends the one before. An as-of join then gives every capture the entries in force when it was fetched.

kind is `domain` (the host or a parent domain of it), `host` (that host only), `prefix` (host and whole path segments)
or `token` (a run of letters and digits in the URL). A capture is blocked if its most specific entry in force says
`block`; from the least specific: token, domain, host, prefix; longer patterns go before shorter ones, `allow` before
`block`, then the smaller entry_id.

Captures are first reduced to distinct (url, fetched) pairs, so thousands of captures of one URL cost one. A URL's
keys are its domains, tokens and prefixes (only depths that the list has), and the join is on keys. The list is
broadcast if it has at most `broadcast_rows` intervals. Of a longer one only the part is broadcast whose keys are hot,
each in more than one of `hot_share` of all keys of the captures (so there are fewer than that many); the other keys are
joined by shuffle, to which `https` and `www` no longer come.

Edge cases. A null URL, an empty one, or one without `//host` has no host; tokens still count, and without a match it
is not blocked. A null time matches no entry. Letters A-Z are lower-cased; user, port and fragment are left out of the
host and of prefixes. Entries of one pattern on one day: the largest entry_id rules. Repeated captures each keep
their row. An empty list blocks nothing, an empty table gives an empty result. Other columns are never read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusgraph.llm.common import cut, hinted, within

KINDS = ("token", "domain", "host", "prefix")
LIST_SCHEMA = "entry_id long, kind string, pattern string, verdict string, dated date, removed boolean"

# The list that the query applies: a parameter of the query, not of the operator.
SAMPLE_LIST = (
    (1, "token", "casino", "block", "2024-01-01", False),
    (2, "domain", "example.org", "block", "2024-02-01", False),
    (3, "domain", "example.org", "block", "2024-06-01", True),
    (4, "domain", "example.org", "block", "2024-10-01", False),
    (5, "host", "blog.ththth.example.org", "allow", "2024-03-15", False),
    (6, "domain", "tionsh.example.net", "block", "2024-05-01", False),
    (7, "prefix", "tionsh.example.net/fr", "allow", "2024-07-01", False),
    (8, "prefix", "tionsh.example.net/fr", "block", "2024-11-01", False),
    (9, "token", "ref", "block", "2024-09-01", False),
    (10, "host", "ththon.example.com", "block", "2024-04-01", False),
    (11, "host", "ththon.example.com", "block", "2024-08-01", True),
    (12, "domain", "tionble.example.com", "block", "2024-01-01", False),
    (13, "host", "blog.tionble.example.com", "allow", "2024-12-01", False),
)


@dataclass(frozen=True)
class UrlParams:
    broadcast_rows: int = 200_000
    hot_share: int = 20_000


def sample_list(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([list(x) for x in SAMPLE_LIST], LIST_SCHEMA.replace("dated date", "dated string")).withColumn("dated", F.to_date("dated"))


def _lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """The host in lower case without user, port and final dots; empty if there is none."""
    return F.regexp_extract(_lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*[^/?#:@.])", 1)


def intervals(entries: DataFrame) -> DataFrame:
    """Dated entries as (key, entry_id, rank, allow, starts, ends), additions only; ends is null while in force."""
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    known = entries.where(rank > 0).where("pattern is not null and dated is not null")
    known = known.withColumn("key", F.concat_ws(":", "kind", _lower(F.col("pattern"))))
    day = known.groupBy("key", "dated").agg(F.max_by(F.struct("entry_id", "kind", "pattern", "verdict", "removed"), "entry_id").alias("e")).select("key", "dated", "e.*")
    ends = F.lead("dated").over(Window.partitionBy("key").orderBy("dated"))
    spans = day.withColumn("ends", ends).where("not coalesce(removed, false)")
    return spans.select("key", "entry_id", rank.alias("rank"), F.length("pattern").alias("len"), (F.col("verdict") == "allow").alias("allow"), F.col("dated").alias("starts"), "ends")


def keys_of(url: Column, depth: int) -> Column:
    """All keys under which an entry could match this URL."""
    low, host = _lower(F.coalesce(url, F.lit(""))), host_of(url)
    labels = F.split(host, r"\.")
    n = F.size(labels)
    domains = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit("domain:"), F.array_join(F.slice(labels, i, n), ".")))
    path = F.regexp_extract(low, r"^[^:]*://[^/?#]*([^?#]*)", 1)
    parts = F.array_remove(F.split(path, "/"), "")
    prefixes = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.size(parts), F.lit(depth)))), lambda i: F.concat(F.lit("prefix:"), host, F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/")))
    tokens = F.transform(F.array_remove(F.split(low, "[^a-z0-9]+"), ""), lambda t: F.concat(F.lit("token:"), t))
    of_host = F.when(host != "", F.concat(F.array(F.concat(F.lit("host:"), host)), domains, prefixes)).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(of_host, tokens))


def _matches(keyed: DataFrame, spans: DataFrame, p: UrlParams) -> DataFrame:
    """The rows of keyed (key, ...) with each interval of their key."""
    if within(spans, p.broadcast_rows):
        return keyed.join(F.broadcast(spans), "key")
    least = keyed.count() // p.hot_share
    hot = cut(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > least).select("key"))
    hot_spans = cut(spans.join(F.broadcast(hot), "key", "left_semi"))
    rest = keyed.join(F.broadcast(hot), "key", "left_anti").join(spans, "key")
    return rest.unionByName(keyed.join(hinted(hot_spans, p.broadcast_rows), "key"))


def judge(captures: DataFrame, entries: DataFrame, url: str = "url", fetched: str = "fetched", p: UrlParams | None = None) -> DataFrame:
    """The captures with host, n_active (entries in force that match), decided_by (entry_id or null) and blocked.

    Columns of those names in the captures are replaced."""
    p = p or UrlParams()
    spans = cut(intervals(entries))
    depth = spans.where("rank = 4").agg(F.max(F.size(F.split("key", "/")) - 1)).first()[0] or 1
    pairs = captures.select(F.col(url).alias("u"), F.col(fetched).cast("timestamp").alias("at")).where("u is not null and at is not null").distinct()
    found = _matches(pairs.withColumn("key", F.explode(keys_of(F.col("u"), depth))), spans, p)
    found = found.where("starts <= at and (ends is null or at < ends)")
    best = F.max(F.struct("rank", "len", "allow", (-F.col("entry_id")).alias("minus_id")))
    verdict = found.groupBy("u", "at").agg(F.count("*").alias("n"), best.alias("best"))
    verdict = verdict.select("u", "at", "n", (-F.col("best.minus_id")).alias("id"), (~F.col("best.allow")).alias("no"))
    names = [F.col(f"`{c}`") for c in captures.columns if c not in ("host", "n_active", "decided_by", "blocked")]
    rows = captures.select(F.struct(*names).alias("row"), F.col(url).alias("cu"), F.col(fetched).cast("timestamp").alias("cat"))
    out = rows.join(verdict, (F.col("cu") == F.col("u")) & (F.col("cat") == F.col("at")), "left")
    return out.select("row.*", host_of(F.col("cu")).alias("host"), F.coalesce("n", F.lit(0)).cast("long").alias("n_active"), F.col("id").alias("decided_by"), F.coalesce("no", F.lit(False)).alias("blocked"))


def page_list(pages: DataFrame) -> DataFrame:
    """The sample list and entries for the hosts of the pages themselves, so that the list grows with the table: from the
    digest of a host it follows whether and when it is blocked, whether that ends, and whether it is allowed again."""
    hosts = pages.select(host_of(F.col("url")).alias("pattern")).where("pattern <> ''").distinct()
    h = hosts.withColumn("h", F.conv(F.substring(F.md5("pattern"), 1, 7), 16, 10).cast("long"))
    start = F.date_add(F.to_date(F.lit("2024-01-01")), F.pmod(F.shiftright("h", 8), F.lit(200)).cast("int"))
    entry = lambda i, kind, verdict, days, removed: F.struct((F.col("h") + 1000 + i).alias("entry_id"), F.lit(kind).alias("kind"), F.col("pattern"), F.lit(verdict).alias("verdict"), F.date_add(start, days).alias("dated"), F.lit(removed).alias("removed"))
    steps = F.array(F.when(F.col("h") % 2 == 0, entry(0, "host", "block", 0, False)), F.when(F.col("h") % 4 == 0, entry(1, "host", "block", 60, True)), F.when(F.col("h") % 3 == 0, entry(2, "domain", "allow", 90, False)))
    made = h.select(F.explode(F.filter(steps, lambda x: x.isNotNull())).alias("e")).select("e.*")
    return sample_list(pages.sparkSession).unionByName(made)


def page_captures(pages: DataFrame) -> DataFrame:
    """`pages` has no fetch time: each page counts as fetched on a day of 2024 that follows from its id."""
    day = F.pmod(F.coalesce(F.col("page_id"), F.lit(0)) * 7, F.lit(366)).cast("int")
    return pages.select("page_id", "url", F.date_add(F.to_date(F.lit("2024-01-01")), day).cast("timestamp").alias("fetched"))


def oracle_sql() -> str:
    rows = ", ".join(f"({i}, '{k}', '{x}', '{v}', DATE '{d}', {str(r).lower()})" for i, k, x, v, d, r in SAMPLE_LIST)
    return rf"""
WITH given(entry_id, kind, pattern, verdict, dated, removed) AS (VALUES {rows}),
ph AS (SELECT pattern, ('0x' || substr(md5(pattern), 1, 7))::BIGINT AS h FROM (
  SELECT DISTINCT regexp_extract(lower(coalesce(url, '')), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*[^/?#:@.])', 1) AS pattern FROM pages) WHERE pattern <> ''),
pd AS (SELECT *, DATE '2024-01-01' + ((h >> 8) % 200)::INTEGER AS starts FROM ph),
e AS (SELECT * FROM given
  UNION ALL SELECT h + 1000, 'host', pattern, 'block', starts, false FROM pd WHERE h % 2 = 0
  UNION ALL SELECT h + 1001, 'host', pattern, 'block', starts + 60, true FROM pd WHERE h % 4 = 0
  UNION ALL SELECT h + 1002, 'domain', pattern, 'allow', starts + 90, false FROM pd WHERE h % 3 = 0),
s AS (SELECT *, CASE kind WHEN 'token' THEN 1 WHEN 'domain' THEN 2 WHEN 'host' THEN 3 ELSE 4 END AS rank,
  lead(dated) OVER (PARTITION BY kind, pattern ORDER BY dated) AS ends FROM e),
c AS (SELECT row_number() OVER () AS r, page_id, url, DATE '2024-01-01' + ((coalesce(page_id, 0) * 7) % 366)::INTEGER AS fetched, lower(coalesce(url, '')) AS low FROM pages),
h AS (SELECT *, regexp_extract(low, '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*[^/?#:@.])', 1) AS host,
  regexp_extract(low, '^[^:]*://[^/?#]*([^?#]*)', 1) AS path FROM c),
m AS (SELECT h.r, s.* FROM h JOIN s ON s.dated <= h.fetched AND (s.ends IS NULL OR h.fetched < s.ends) AND NOT s.removed AND (
  (kind = 'token' AND list_contains(regexp_split_to_array(low, '[^a-z0-9]+'), pattern)) OR
  (kind = 'host' AND host = pattern) OR (kind = 'domain' AND (host = pattern OR ends_with(host, '.' || pattern))) OR
  (kind = 'prefix' AND host <> '' AND starts_with(host || regexp_replace(path, '/+$', '') || '/', pattern || '/')))),
b AS (SELECT r, count(*) AS n, arg_max(entry_id, (rank, length(pattern), verdict = 'allow', -entry_id)) AS decided_by,
  arg_max(verdict, (rank, length(pattern), verdict = 'allow', -entry_id)) AS verdict FROM m GROUP BY r)
SELECT page_id, url, fetched::TIMESTAMP AS fetched, host, coalesce(n, 0)::BIGINT AS n_active, decided_by::BIGINT AS decided_by, coalesce(verdict = 'block', false) AS blocked
FROM h LEFT JOIN b USING (r)"""
