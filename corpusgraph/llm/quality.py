"""Quality rules as weak supervision: rules vote or abstain, EM finds how far to trust each, a posterior decides.

Every rule looks at one document and votes good (+1), bad (-1) or abstains (0). The votes of a corpus are reduced
to counts of vote patterns, at most 3^rules rows whatever the corpus. Expectation-maximisation over these counts
estimates the share of good documents and, for each rule, how often it votes "bad" on good and on bad documents
(its two error rates). The posterior probability that a document is good follows from its own votes.

Edge cases. Null and empty texts have zero in every count, fail the base (fewer than `min_words` words) and are
rejected. Rows are judged one by one: repeated rows and tied ids each get their row. An empty table gives an empty
result, and the model keeps its starting values. Columns other than id and text are never read, and the filter
returns them untouched whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgraph.llm.common import SPACE_WORD_BREAK, cut, hinted

# Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to in that is for it with was as be on by at from this are an "
    "de la le les et des en un une du est que qui dans par pour sur pas au "
    "der die und das von zu mit den ist im auf ein eine nicht des dem "
    "el los las del por con se su al lo para no una"
).split()
RULES = ("symbols", "shouting", "repetition", "lines", "sentences", "lengths", "function_words")


@dataclass(frozen=True)
class QualityParams:
    min_words: int = 50
    max_repeat_percent: int = 50
    keep_from: float = 0.5
    rounds: int = 15
    broadcast_rows: int = 200_000
    stop_words: tuple = field(default_factory=lambda: tuple(sorted(set(STOP_WORDS))))


def features(docs: DataFrame, keep: list[Column], text: str = "text", hash_bits: int = 40) -> DataFrame:
    """The kept columns and a struct of counts, in built-in functions only; no text leaves its row.

    Repeated three-word windows: each window becomes a long, `hash_bits` of its hash above its place (fewer where a text
    has more words than the rest can number), so one sort of longs brings equal windows together. Neighbours with equal
    hashes are compared word by word. Where two of them differ, all windows of that hash are sorted by their words, so
    windows that share a hash hide no repeat.
    """
    names = [f"__k{i}" for i in range(len(keep))]
    col = lambda: [F.col(n) for n in names]
    body = F.coalesce(F.col(text), F.lit(""))
    df = docs.select(*[k.alias(n) for k, n in zip(keep, names, strict=True)], body.alias("t"), F.array_remove(F.split(body, SPACE_WORD_BREAK), "").alias("w"))
    df = df.withColumn("b", F.greatest(F.lit(64 - hash_bits), F.length(F.bin(F.size("w").cast("long")))))
    packed = "sort_array(transform(slice(w, 1, greatest(size(w) - 2, 0)), (x, i) -> shiftleft(xxhash64(x, get(w, i + 1), get(w, i + 2)), b) | i))"
    df = df.select(*col(), "t", "w", "b", F.expr(packed).alias("p"), F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("l"))
    place = lambda v: f"cast({v} & (shiftleft(1L, b) - 1) as int)"
    twins = "filter(sequence(0, greatest(size(p) - 2, 0)), i -> shiftright(get(p, i), b) = shiftright(get(p, i + 1), b))"
    pairs = f"transform({twins}, i -> struct({place('get(p, i)')} as a, {place('get(p, i + 1)')} as b, shiftright(get(p, i), b) as h))"
    df = df.select(*col(), "t", "w", "l", "b", "p", F.expr(pairs).alias("c"))
    same = "get(w, x.a) = get(w, x.b) and get(w, x.a + 1) = get(w, x.b + 1) and get(w, x.a + 2) = get(w, x.b + 2)"
    shared = f"array_distinct(transform(filter(c, x -> not ({same})), x -> x.h))"
    df = df.select(*col(), "t", "w", "l", "b", "p", F.expr(f"transform(filter(c, x -> {same}), x -> struct(x.a as a, x.b as b))").alias("c"), F.expr(shared).alias("h"))
    spelled = f"transform(filter(p, v -> array_contains(h, shiftright(v, b))), v -> struct(array_join(slice(w, {place('v')} + 1, 3), ' ') as s, {place('v')} as a))"
    df = df.select(*col(), "t", "w", "l", "c", F.expr(f"case when size(h) > 0 then sort_array({spelled}) end").alias("k"))
    more = "transform(filter(sequence(0, greatest(size(k) - 2, 0)), i -> get(k, i).s = get(k, i + 1).s), i -> struct(get(k, i).a as a, get(k, i + 1).a as b))"
    df = df.select(*col(), "t", "w", "l", F.expr(f"case when k is null then c else concat(c, {more}) end").alias("c"))
    covered = F.expr("size(array_distinct(flatten(transform(c, x -> array(x.a, x.a + 1, x.a + 2, x.b, x.b + 1, x.b + 2)))))")

    def count(chars: str) -> Column:
        rest = F.col("t")
        for c in chars:
            rest = F.replace(rest, F.lit(c), F.lit(""))
        return F.length("t") - F.length(rest)

    counts = {
        "n_words": F.size("w"), "word_chars": F.length(F.array_join("w", "")), "n_symbols": count("#*$%&|<>"),
        "n_dup_lines": F.size("l") - F.size(F.array_distinct("l")), "n_repeat_words": covered, "n_lines": F.size("l"),
        "n_stops": count(".!?"), "n_shouts": count("!"),
        "n_function": F.size(F.array_intersect(F.array(*map(F.lit, QualityParams().stop_words)), F.col("w"))),
    }
    return df.select(*col(), F.struct(*[c.cast("long").alias(n) for n, c in counts.items()]).alias("__f"))


#: For each rule: when it votes bad, when good; else it abstains. Integer arithmetic, valid in Spark SQL and DuckDB.
VOTES = {
    "symbols": ("10 * n_symbols > n_words", "50 * n_symbols <= n_words"),
    "shouting": ("5 * n_shouts > n_words", "50 * n_shouts <= n_words"),
    "repetition": ("10 * n_repeat_words > 4 * n_words", "20 * n_repeat_words <= n_words"),
    "lines": ("n_dup_lines > 1 AND 10 * n_dup_lines > 3 * n_lines", "n_lines > 1 AND n_dup_lines = 0"),
    "sentences": ("n_words >= 50 AND (100 * n_stops < n_words OR 2 * n_stops > n_words)", "50 * n_stops >= n_words AND 3 * n_stops <= n_words"),
    "lengths": ("word_chars > 14 * n_words OR word_chars < 2 * n_words", "word_chars <= 10 * n_words AND word_chars >= 3 * n_words"),
    "function_words": ("n_words >= 50 AND n_function < 3", "n_function >= 6"),
}


def votes(counts: str = "__f") -> dict[str, Column]:
    """-1, 0 or 1 for each rule; texts without words get abstentions only."""
    put = lambda rule: F.expr(f"(CASE WHEN n_words = 0 THEN 0 WHEN {rule[0]} THEN -1 WHEN {rule[1]} THEN 1 ELSE 0 END)".replace("n_", f"{counts}.n_").replace("word_chars", f"{counts}.word_chars"))
    return {r: put(VOTES[r]) for r in RULES}


@dataclass
class VoteModel:
    prior: float
    bad_if_good: list[float]
    bad_if_bad: list[float]

    def log_odds(self, vote: list) -> float:
        s = math.log(self.prior / (1 - self.prior))
        for v, g, b in zip(vote, self.bad_if_good, self.bad_if_bad, strict=True):
            s += math.log(g / b) if v < 0 else math.log((1 - g) / (1 - b)) if v > 0 else 0.0
        return s

    def posterior(self, marks: list[Column]) -> Column:
        s = F.lit(math.log(self.prior / (1 - self.prior)))
        for v, g, b in zip(marks, self.bad_if_good, self.bad_if_bad, strict=True):
            s = s + F.when(v < 0, F.lit(math.log(g / b))).when(v > 0, F.lit(math.log((1 - g) / (1 - b)))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-s))


#: Starting values and smoothing of the model: prior, P(bad vote | good), P(bad vote | bad), pseudo-votes.
START = (0.8, 0.05, 0.4, 2.0)


def fit(patterns: list[tuple[tuple, int]], rounds: int) -> VoteModel:
    """EM over (votes, documents) counts; the list is at most 3^rules long."""
    k = len(RULES)
    m = VoteModel(START[0], [START[1]] * k, [START[2]] * k)
    total = sum(n for _, n in patterns)
    for _ in range(rounds if total else 0):
        good = [n / (1 + math.exp(-m.log_odds(v))) for v, n in patterns]
        share = lambda j, w, start: (sum(x for (v, _), x in zip(patterns, w, strict=True) if v[j] < 0) + START[3] * start) / (sum(x for (v, _), x in zip(patterns, w, strict=True) if v[j]) + START[3])
        bad = [n - g for (_, n), g in zip(patterns, good, strict=True)]
        m = VoteModel((sum(good) + START[3] * START[0]) / (total + START[3]), [share(j, good, START[1]) for j in range(k)], [share(j, bad, START[2]) for j in range(k)])
    return m


def vote_patterns(marked: DataFrame) -> list[tuple[tuple, int]]:
    rows = marked.groupBy(*[f"__v.{r}" for r in RULES]).count().collect()
    return sorted((tuple(x[r] for r in RULES), x["count"]) for x in rows)


def base_failed(p: QualityParams, counts: str = "__f") -> Column:
    f = lambda c: F.col(f"{counts}.{c}")
    return (f("n_words") < p.min_words) | (100 * f("n_repeat_words") > p.max_repeat_percent * f("n_words"))


def _marked(docs: DataFrame, keep: list[Column], text: str) -> DataFrame:
    return features(docs, keep, text).withColumn("__v", F.struct(*[v.alias(r) for r, v in votes().items()]))


def score(docs: DataFrame, id_col: str = "doc_id", text: str = "text", p: QualityParams | None = None) -> DataFrame:
    """One row for each document: id, counts, votes, base_failed, posterior `quality` and `kept`.

    The texts are read once: counts and votes (a few numbers a document) go to the shared folder, and the model and
    the result come from there.
    """
    p = p or QualityParams()
    marked = cut(_marked(docs.select(F.col(id_col).alias("__id"), F.col(text).alias("text")), [F.col("__id")], "text")).withColumnRenamed("__k0", "id")
    model = fit(vote_patterns(marked), p.rounds)
    posterior = model.posterior([F.col(f"__v.{r}") for r in RULES])
    failed = base_failed(p)
    return marked.select(
        F.col("id").alias(id_col), "__f.*", *[F.col(f"__v.{r}").alias(f"vote_{r}") for r in RULES],
        failed.alias("base_failed"), posterior.alias("quality"), (~failed & (posterior >= p.keep_from)).alias("kept"),
    )


def keep_good(docs: DataFrame, text: str = "text", p: QualityParams | None = None) -> DataFrame:
    """The documents that `score` keeps, with all their columns. Counts and votes are made once, and go to the shared folder
    under the digest of the text, of which they are a function; then rejected digests are joined out."""
    p = p or QualityParams()
    digest = F.md5(F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary"))
    marked = cut(_marked(docs.select(digest.alias("__d"), F.col(f"`{text}`").alias("text")), [F.col("__d")], "text"))
    posterior = fit(vote_patterns(marked), p.rounds).posterior([F.col(f"__v.{r}") for r in RULES])
    rejected = cut(marked.where(base_failed(p) | (posterior < p.keep_from)).select(F.col("__k0").alias("__rejected")).distinct())
    return docs.join(hinted(rejected, p.broadcast_rows), digest == F.col("__rejected"), "left_anti")


def oracle_sql(p: QualityParams | None = None) -> str:
    """The contract's columns in DuckDB SQL, the EM rounds written out one by one."""
    p = p or QualityParams()
    quoted = ", ".join(f"'{w}'" for w in p.stop_words)
    case = ", ".join(f"CASE WHEN n_words = 0 THEN 0 WHEN {VOTES[r][0]} THEN -1 WHEN {VOTES[r][1]} THEN 1 ELSE 0 END AS v{j}" for j, r in enumerate(RULES))
    ks = range(len(RULES))
    vs = ", ".join(f"v{j}" for j in ks)
    odds = "ln(m.prior / (1 - m.prior)) + " + " + ".join(f"CASE WHEN v{j} < 0 THEN ln(m.g{j} / m.b{j}) WHEN v{j} > 0 THEN ln((1 - m.g{j}) / (1 - m.b{j})) ELSE 0 END" for j in ks)
    prior, g0, b0, pseudo = START
    ctes = [
        "d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents)",
        r"w AS (SELECT r, doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d)",
        "g AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w))",
        "rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS c FROM g) WHERE c > 1) GROUP BY r)",
        f"f AS (SELECT w.r, doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, len(l) AS n_lines, length(t) - length(regexp_replace(t, '[.!?]', '', 'g')) AS n_stops, length(t) - length(replace(t, '!', '')) AS n_shouts, len(list_distinct(list_filter(w, lambda x: x IN ({quoted})))) AS n_function FROM w LEFT JOIN rep ON rep.r = w.r)",
        f"v AS (SELECT *, {case} FROM f)",
        f"pat AS (SELECT {vs}, count(*) AS n FROM v GROUP BY ALL)",
        "m0 AS (SELECT " + f"{prior}::DOUBLE AS prior, " + ", ".join(f"{g0}::DOUBLE AS g{j}, {b0}::DOUBLE AS b{j}" for j in ks) + ")",
    ]
    for i in range(p.rounds):
        ctes.append(f"e{i} AS (SELECT pat.*, n / (1 + exp(-({odds}))) AS y FROM pat, m{i} AS m)")
        part = ", ".join(
            f"(coalesce(sum(y) FILTER (v{j} < 0), 0) + {pseudo * g0}) / (coalesce(sum(y) FILTER (v{j} <> 0), 0) + {pseudo}) AS g{j}, "
            f"(coalesce(sum(n - y) FILTER (v{j} < 0), 0) + {pseudo * b0}) / (coalesce(sum(n - y) FILTER (v{j} <> 0), 0) + {pseudo}) AS b{j}"
            for j in ks
        )
        ctes.append(f"m{i + 1} AS (SELECT (coalesce(sum(y), 0) + {pseudo * prior}) / (coalesce(sum(n), 0) + {pseudo}) AS prior, {part} FROM e{i})")
    failed = f"(n_words < {p.min_words} OR 100 * n_repeat_words > {p.max_repeat_percent} * n_words)"
    return (
        "WITH " + ",\n".join(ctes) + f"\nSELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {failed} AS base_failed, "
        f"(NOT {failed} AND 1 / (1 + exp(-({odds}))) >= {p.keep_from}) AS kept FROM v, m{p.rounds} AS m"
    )
