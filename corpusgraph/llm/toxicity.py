"""Toxicity by a weighted lexicon: Aho-Corasick over folded words, exception phrases, normalised by length.

Folding lower-cases, maps letters of other scripts that look like ASCII letters, and reads digits and signs inside
words as the letters they stand for. The lexicon holds words and beginnings of words, each with a weight: the log of
how much more often it occurs in documents labelled toxic than in others, kept where that is no accident (likelihood
ratio). Some words are in it from the start, with a weight that labels raise or lower as if `prior_rows` toxic documents
had been seen before. A word counts with its longest entry. Exception phrases are neighbouring words of which one is in
the lexicon, that clean documents use and toxic ones hardly do, besides a few given ones; inside them nothing counts. The
sum of weights over the length of the text goes through a logistic curve fitted to the same labels.

Only rows whose crc32(doc_id as text) mod 3 is not 1 are learned from, and about `train_rows` of them at most (those with
the smallest hashes; a documented bound, which also bounds the words that the driver sees). Labels, lang, source and doc_id
are no inputs of a score. Scoring reads every text where it lies, without a shuffle.

Edge cases. A null or empty text has no words and scores as a text without hits. A null id is not held out and never
learned from. Without labels of both kinds the lexicon is the given words and the curve keeps its starting values, by
which a text without hits is clean. Rows with equal ids each get their row; ids labelled more than once count toxic if
any label says so. An empty table gives an empty result. Other columns are never read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgraph.llm.common import cut, hinted, portions
from corpusgraph.llm.pii import LOOKALIKES


@dataclass(frozen=True)
class ToxicParams:
    train_rows: int = 100_000
    prefixes: tuple = (4, 5, 6)
    sureness: float = -5.0
    least_weight: float = 1.5
    prior_rows: float = 3.0
    prior_weight: float = 5.0
    pad_words: int = 20
    limit: float = 0.7
    broadcast_rows: int = 200_000


# Digits and signs and the letters they replace inside words.
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
# Phrases in which a word is harmless.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "class clown", "pathetic fallacy", "scum line")
# Words that are in the lexicon before any label is seen.
GIVEN = (
    "idiot idiots idiotic moron morons moronic imbecile cretin scum scumbag loser losers stupid dumb dumbass trash garbage worthless pathetic disgusting clown retard retarded bastard bitch asshole "
    "fool fools vermin filth filthy degenerate subhuman braindead jackass dipshit shithead fuck fucking fucker shit bullshit "
    "idiota imbécil estúpido estúpida basura escoria crétin débile ordure connard connasse salope dummkopf vollidiot trottel abschaum arschloch"
).split()
_GLYPHS = {ord(a): b.lower() for a, b in zip(LOOKALIKES[::2], LOOKALIKES[1::2], strict=True) if b.isalpha()}
_ODD = re.compile("[" + "".join(re.escape(chr(c)) for c in _GLYPHS) + "]")
_MIXED = re.compile(r"[^\W\d_]*[0-9@$!][^\W_@$!]*(?:[@$!]?[^\W_]+)*")
_WORD = re.compile(r"[^\W_]+")


def _unleet(m: re.Match) -> str:
    word = m[0]
    letters = sum(c.isalpha() for c in word)
    if letters < 2:
        return word
    end = len(word.rstrip("!"))  # a mark at the end is punctuation
    return "".join(LEET.get(c, c) for c in word[:end]) + word[end:]


def folded(text: str | None) -> list[str]:
    """The words of a text after folding."""
    low = (text or "").lower()
    if not low.isascii() and _ODD.search(low):
        low = low.translate(_GLYPHS)
    if any(c in low for c in LEET):
        low = _MIXED.sub(_unleet, low)
    return _WORD.findall(low)


def entries_of(word: str, prefixes: tuple) -> list[str]:
    """The lexicon entries under which a word could stand: itself (closed by a space) and its beginnings."""
    return [f" {word} ", *(f" {word[:n]}" for n in prefixes if len(word) >= n)]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, p: ToxicParams) -> DataFrame:
    """(text, toxic) of the labelled rows that may be learned from."""
    known = labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").alias("labelled")).agg(F.max("toxic").alias("toxic"))
    known = cut(known)
    n = known.count()
    if n > p.train_rows:  # about so many: a share of the hashes, not a sort of all rows
        known = known.where(F.pmod(F.xxhash64("labelled"), F.lit(1 << 32)) < F.lit((p.train_rows << 32) // n))
    return docs.join(hinted(known, p.broadcast_rows), docs["id"] == known["labelled"]).select("text", "toxic")


def _count_entries(prefixes: tuple):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, "text"):
            found: dict[bool, Counter] = {False: Counter(), True: Counter()}
            rows = Counter()
            for text, toxic in zip(batch.column("text"), batch.column("toxic").to_pylist(), strict=True):
                words = set(folded(text.as_py()))
                rows[bool(toxic)] += 1
                found[bool(toxic)].update({e for w in words for e in entries_of(w, prefixes)})
            for toxic, n in rows.items():
                found[toxic][""] = n
            keys = sorted(found[False].keys() | found[True].keys())
            yield pa.RecordBatch.from_arrays([pa.array(keys), *[pa.array([found[y][k] for k in keys], pa.int64()) for y in (True, False)]], ["entry", "bad", "good"])

    return count


def _pairs(entries: frozenset, prefixes: tuple):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, "text"):
            found: dict[bool, Counter] = {False: Counter(), True: Counter()}
            for text, toxic in zip(batch.column("text"), batch.column("toxic").to_pylist(), strict=True):
                words = folded(text.as_py())
                marked = [not entries.isdisjoint(entries_of(w, prefixes)) for w in words]
                found[bool(toxic)].update({f"{words[i]} {words[i + 1]}" for i in range(len(words) - 1) if marked[i] or marked[i + 1]})
            keys = sorted(found[False].keys() | found[True].keys())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *[pa.array([found[y][k] for k in keys], pa.int64()) for y in (True, False)]], ["entry", "bad", "good"])

    return count


@dataclass
class Lexicon:
    weights: dict[str, float]
    exceptions: list[str]
    slope: float = 1.0
    offset: float = -3.0
    pad: int = 20

    def automaton(self) -> ahocorasick.Automaton | None:
        out = ahocorasick.Automaton()
        for e, w in self.weights.items():
            out.add_word(e, (len(e), w))
        for e in self.exceptions:
            out.add_word(f" {e} ", (len(e) + 2, None))
        if len(out) == 0:
            return None
        out.make_automaton()
        return out

    def density(self, text: str | None, found: ahocorasick.Automaton | None) -> float:
        """Weight per hundred words, over a text padded by some words."""
        words = folded(text)
        if found is None or not words:
            return 0.0
        line = f" {' '.join(words)} "
        best: dict[int, tuple[int, float]] = {}
        harmless: list[tuple[int, int]] = []
        for end, (size, weight) in found.iter(line):
            start = end + 1 - size
            if weight is None:
                harmless.append((start, end))
            elif size > best.get(start, (0, 0.0))[0]:
                best[start] = (size, weight)
        total = sum(w for s, (_, w) in best.items() if not any(a <= s < b for a, b in harmless))
        return 100 * total / (len(words) + self.pad)

    def score(self, density: float) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.offset + self.slope * density))))


def likelihood_ratio(bad: int, good: int, n_bad: int, n_good: int) -> float:
    """G statistic of an entry's counts against equal rates."""
    share = (bad + good) / (n_bad + n_good)
    part = lambda k, n: 2 * sum(x * math.log(x / e) for x, e in ((k, n * share), (n - k, n * (1 - share))) if x > 0 and e > 0)
    return part(bad, n_bad) + part(good, n_good)


def learn(docs: DataFrame, labels: DataFrame, p: ToxicParams) -> Lexicon:
    """A lexicon from (id, text) and (doc_id, toxic)."""
    rows = cut(training_rows(docs, labels, p))
    counted = rows.mapInArrow(_count_entries(p.prefixes), "entry string, bad long, good long").groupBy("entry").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    given = {e: p.prior_weight for w in GIVEN for e in entries_of(" ".join(folded(w)), ())}
    counted = cut(counted.where((F.col("entry") == "") | (F.col("bad") >= 3) | F.col("entry").isin(*given)))
    total = counted.where("entry = ''").first()
    n_bad, n_good = (total["bad"], total["good"]) if total else (0, 0)
    out = Lexicon(dict(given), list(EXCEPTIONS), pad=p.pad_words)
    if not n_bad or not n_good:
        return out
    rate = lambda k, n: (k + 0.5) / (n + 1)
    likely = counted.where("entry <> '' and bad >= 3").where((F.col("bad") + 0.5) / (n_bad + 1) > math.exp(p.least_weight) * (F.col("good") + 0.5) / (n_good + 1)).collect()
    # Chance alone gives one of m entries a ratio of about 2 ln m; a little less is asked for, as the curve weighs as well.
    least = 2 * math.log(max(2, counted.count())) + p.sureness
    out.weights |= {x["entry"]: math.log(rate(x["bad"], n_bad) / rate(x["good"], n_good)) for x in likely if likelihood_ratio(x["bad"], x["good"], n_bad, n_good) >= least}
    # A given word: the prior's documents are added to those seen, so its weight is the prior's where there are none.
    clean = p.prior_rows * (n_good + 1) / (n_bad + 1) * math.exp(-p.prior_weight)
    seen = {x["entry"]: (x["bad"], x["good"]) for x in counted.where(F.col("entry").isin(*given)).collect()}
    for e in given:
        bad, good = seen.get(e, (0, 0))
        out.weights[e] = math.log((bad + p.prior_rows) / (n_bad + 1) / ((good + clean) / (n_good + 1)))
    out.weights = {e: w for e, w in out.weights.items() if w > 0}
    pairs = rows.mapInArrow(_pairs(frozenset(out.weights), p.prefixes), "entry string, bad long, good long").groupBy("entry").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    harmless = pairs.where("good >= 3").where((F.col("good") + 0.5) / (n_good + 1) > 3 * (F.col("bad") + 0.5) / (n_bad + 1))
    out.exceptions += sorted(x["entry"] for x in harmless.collect())
    _calibrate(out, rows)
    return out


def _calibrate(lexicon: Lexicon, rows: DataFrame) -> None:
    """Logistic regression on the density, over counts of (density to a hundredth, toxic)."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = lexicon.automaton()
        for batch in portions(batches, "text"):
            x = [round(100 * lexicon.density(t.as_py(), found)) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), batch.column("toxic").cast(pa.int64())], ["x", "y"])

    counts = [(r["x"] / 100, min(1, r["y"]), r["n"]) for r in rows.mapInArrow(measure, "x long, y long").groupBy("x", "y").agg(F.count(F.lit(1)).alias("n")).orderBy("x", "y").collect()]
    a, b, ridge = -3.0, 1.0, 0.01
    for _ in range(50):
        g0 = g1 = 0.0
        h00 = h11 = ridge
        h01 = 0.0
        g0, g1 = -ridge * a, -ridge * b
        for x, y, n in counts:
            q = 1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * x))))
            g0 += n * (y - q)
            g1 += n * (y - q) * x
            v = n * q * (1 - q)
            h00, h01, h11 = h00 + v, h01 + v * x, h11 + v * x * x
        det = h00 * h11 - h01 * h01
        if det <= 1e-12:
            break
        da, db = (h11 * g0 - h01 * g1) / det, (h00 * g1 - h01 * g0) / det
        step = min(1.0, 5 / max(abs(da), abs(db), 1e-9))
        a, b = a + step * da, b + step * db
        if max(abs(da), abs(db)) < 1e-8:
            break
    lexicon.slope, lexicon.offset = max(b, 0.0), a


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", p: ToxicParams | None = None) -> DataFrame:
    """One row for each document: id, held_out, score, predicted."""
    p = p or ToxicParams()
    own = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    lexicon = learn(own, labels, p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = lexicon.automaton()
        for batch in portions(batches, "text"):
            scores = [lexicon.score(lexicon.density(t.as_py(), found)) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(scores, pa.float64())], ["id", "score"])

    kind = dict(docs.dtypes)[id_col]
    out = own.mapInArrow(run, f"id {kind}, score double")
    return out.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= p.limit).cast("int").alias("predicted"))
