"""Benchmark decontamination: a broadcast hash set of the benchmark's word windows, a scan of every document's windows,
verification of each hash hit word by word, and removal of documents or of the hit passages.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z, found on UTF-8 bytes. A window is `window`
consecutive words of an item; a shorter item is one window as a whole. Documents are scanned where they lie: no text
is shuffled, and a document costs the same whoever else holds the passage.

The hash set is broadcast only in blocks of about `block_words` benchmark words, some 40 bytes a word in a worker; items
are cut into pieces, which overlap by a window less one word, so no item is larger than a block. A benchmark of one block
takes one pass over the documents. A larger one takes one pass with a bit table of all windows (at most `filter_bits` bits,
whatever the benchmark), and then one pass for each block, in turn, over the texts that the table does not rule out; each
block's broadcast is given up before the next is made, and hits are joined to the documents by the text's digest.

Edge cases. Null and empty texts have no words and no hits; the digest of no items is that of the empty string.
Items without words or with a null id match nothing. Repeated items and rows each count as they stand, ids once. An
empty benchmark or table gives no hits or rows. Very long texts are scanned whole. Other columns are never read, and
`clean` returns them untouched, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgraph.llm.common import cut, portions

WORD_TABLE = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
MEMO_MOST = 200_000


@dataclass(frozen=True)
class DecontaminateParams:
    window: int = 10
    block_words: int = 2_000_000
    piece_words: int = 20_000
    filter_bits: int = 1 << 29
    action: str = "drop"


class WordHashes(dict):
    """64-bit hashes of words, remembered; forgotten when there are too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > MEMO_MOST:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def word_list(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(WORD_TABLE).split()


def window_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit hash of every `length` consecutive word hashes."""
    n = max(0, len(words) - length + 1)
    h = np.zeros(n, np.uint64)
    for j in range(length):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        h += words[j : j + n]
    return h


def hashes_of(words: list[bytes], memo: WordHashes) -> np.ndarray:
    return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))


class WindowSet:
    """The windows of some pieces of items (item, words joined by spaces, window length): for each length the sorted hashes
    with a bit table before them, and for each hash its piece and first word, to compare with the words themselves."""

    def __init__(self, pieces: list[tuple[str, bytes, int]]):
        memo = WordHashes()
        self.items = [p[0] for p in pieces]
        self.text = b" ".join([p[1] for p in pieces] + [b""])
        found: dict[int, list] = {}
        at = 0
        for i, (_, body, size) in enumerate(pieces):
            words = body.split(b" ")
            starts = at + np.concatenate([[0], np.cumsum([len(w) + 1 for w in words])])
            h = window_hashes(hashes_of(words, memo), size)
            n = len(h)
            found.setdefault(size, []).append((h, np.full(n, i, np.int32), starts[:n].astype(np.int64), (starts[size : size + n] - 1).astype(np.int64)))
            at = int(starts[-1])
        self.by_length = {}
        for size, parts in found.items():
            h, piece, first, after = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(h, kind="stable")
            bits = np.zeros(1 << 20, np.bool_)
            bits[h >> np.uint64(44)] = True
            self.by_length[size] = (h[order], piece[order], first[order], after[order], bits)

    def hits(self, words: list[bytes], hashes: np.ndarray) -> Iterator[tuple[int, int, set]]:
        """(first word, word after the last, items) of every window that occurs in the words."""
        for size, (known, piece, first, after, bits) in self.by_length.items():
            h = window_hashes(hashes, size)
            maybe = np.flatnonzero(bits[h >> np.uint64(44)])
            low, high = np.searchsorted(known, h[maybe]), np.searchsorted(known, h[maybe], side="right")
            for at, a, b in zip(maybe[high > low].tolist(), low[high > low].tolist(), high[high > low].tolist(), strict=True):
                here = b" ".join(words[at : at + size])
                items = {self.items[piece[k]] for k in range(a, b) if self.text[first[k] : after[k]] == here}
                if items:
                    yield at, at + size, items


class WindowFilter:
    """A bit table of window hashes: says no only of what is in none of the added sets."""

    def __init__(self, windows: int, most_bits: int):
        self.power = max(10, min(most_bits.bit_length() - 1, (16 * max(1, windows)).bit_length()))
        self.table = np.zeros(1 << (self.power - 3), np.uint8)
        self.lengths: set[int] = set()

    def _places(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - self.power)).astype(np.int64)

    def add(self, windows: WindowSet) -> None:
        for size, (known, *_) in windows.by_length.items():
            self.lengths.add(size)
            at = self._places(known)
            np.bitwise_or.at(self.table, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))

    def may_hit(self, hashes: np.ndarray) -> bool:
        for size in self.lengths:
            at = self._places(window_hashes(hashes, size))
            if len(at) and bool(((self.table[at >> 3] >> (at & 7).astype(np.uint8)) & 1).any()):
                return True
        return False


def _union(spans: list) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


SPANS, ITEMS = "array<struct<first:long,after:long>>", "array<string>"
SPAN_TYPE = pa.list_(pa.struct([("first", pa.int64()), ("after", pa.int64())]))


def _scanner(windows, carried: list[str]):
    """Adds n_words, spans and items to batches with `text`."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, memo = windows.value, WordHashes()
        for batch in portions(batches, "text"):
            n_words, spans, items = [], [], []
            for text in batch.column("text").cast(pa.binary()):
                words = word_list(text.as_py())
                found = list(sets.hits(words, hashes_of(words, memo))) if words else []
                n_words.append(len(words))
                spans.append([{"first": a, "after": b} for a, b in _union([x[:2] for x in found])])
                items.append(sorted(set().union(*[x[2] for x in found])))
            more = [pa.array(n_words, pa.int64()), pa.array(spans, SPAN_TYPE), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in carried] + more, [*carried, "n_words", "spans", "items"])

    return scan


def _counter(known, carried: list[str]):
    """Adds n_words and may_hit to batches with `text`."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, memo = known.value, WordHashes()
        for batch in portions(batches, "text"):
            lists = [word_list(t.as_py()) for t in batch.column("text").cast(pa.binary())]
            more = [pa.array(map(len, lists), pa.int64()), pa.array([table.may_hit(hashes_of(w, memo)) for w in lists], pa.bool_())]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in carried] + more, [*carried, "n_words", "may_hit"])

    return count


def _cutter(p: DecontaminateParams):
    """Items to pieces: words joined by spaces, and the length of the windows in them."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, "text"):
            rows = []
            for item, text in zip(batch.column("id").to_pylist(), batch.column("text").cast(pa.binary()), strict=True):
                words = word_list(text.as_py())
                size = min(p.window, len(words))
                for at in range(0, len(words) - size + 1, p.piece_words) if words else ():
                    part = words[at : at + p.piece_words + size - 1]
                    rows.append((item, b" ".join(part), size, len(part)))
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.binary(), pa.int32(), pa.int64()), strict=True)], ["id", "body", "size", "n"])

    return pieces


def scan(docs: DataFrame, benchmark: DataFrame, carried: list[str], p: DecontaminateParams) -> DataFrame:
    """docs (the carried columns, `text` among them) with n_words, spans of hit words, and item ids as strings."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("id"), "text").where("id is not null and text is not null")
    pieces = cut(items.mapInArrow(_cutter(p), "id string, body binary, size int, n long").distinct())
    total, windows = pieces.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.col("n") - F.col("size") + 1), F.lit(0))).first()
    blocks = -(-total // p.block_words) or 1
    schema = ", ".join(f"`{c}` {t}" for c, t in docs.select(*carried).dtypes)

    def block(k: int) -> WindowSet:
        part = pieces.where(F.pmod(F.xxhash64("id", "body"), F.lit(blocks)) == k).select("id", "body", "size")
        return WindowSet(sorted((x["id"], bytes(x["body"]), x["size"]) for x in part.collect()))

    if blocks == 1:
        one = spark.sparkContext.broadcast(block(0))
        return docs.mapInArrow(_scanner(one, carried), f"{schema}, n_words long, spans {SPANS}, items {ITEMS}")
    table = WindowFilter(windows, p.filter_bits)
    for k in range(blocks):
        table.add(block(k))
    known = spark.sparkContext.broadcast(table)
    counted = docs.mapInArrow(_counter(known, carried), f"{schema}, n_words long, may_hit boolean").withColumn("digest", F.md5(F.col("text").cast("binary")))
    texts = cut(counted.where("may_hit").groupBy("digest").agg(F.first("text").alias("text")))
    hits = None
    for k in range(blocks):
        now = spark.sparkContext.broadcast(block(k))
        found = texts.mapInArrow(_scanner(now, ["digest", "text"]), f"digest string, text string, n_words long, spans {SPANS}, items {ITEMS}")
        found = cut(found.where(F.size("spans") > 0).select("digest", "spans", "items"))
        now.destroy()
        hits = found if hits is None else hits.union(found)
    union = F.udf(lambda s: [{"first": a, "after": b} for a, b in _union([(x["first"], x["after"]) for x in s])], SPANS)
    hits = hits.groupBy("digest").agg(F.flatten(F.collect_list("spans")).alias("s"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    hits = cut(hits.select(F.col("digest").alias("__d"), union("s").alias("spans"), "items"))
    joined = counted.join(hits, F.col("digest") == F.col("__d"), "left")
    none = lambda c, t: F.coalesce(F.col(c), F.array().cast(t)).alias(c)
    return joined.select(*carried, "n_words", none("spans", SPANS), none("items", ITEMS))


def inspect(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", p: DecontaminateParams | None = None) -> DataFrame:
    """One row for each document: id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = scan(docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")), benchmark, ["id", "text"], p or DecontaminateParams())
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["after"] - x["first"])
    out = found.select(F.col("id").alias(id_col), "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.sort_array("items"), ","), 256).alias("items_sha256"))
    return out.withColumn("contaminated", F.col("n_hit") > 0)


def _without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans and what separates them."""
    body = text.encode()
    flat = body.translate(WORD_TABLE)
    starts, ends, at = [], [], 0
    for w in flat.split():
        at = flat.index(w, at)
        starts.append(at)
        at += len(w)
        ends.append(at)
    out, done = [], 0
    for a, b in spans:
        out.append(body[done : starts[a]])
        done = ends[b - 1]
    return b"".join([*out, body[done:]]).decode()


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", p: DecontaminateParams | None = None) -> DataFrame:
    """The documents without contaminated ones (`drop`), or with the hit passages cut out of their text (`cut`)."""
    p = p or DecontaminateParams()
    rows = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)], F.col(text).alias("text"))
    names = [f"c{i}" for i in range(len(docs.columns))]
    found = scan(rows, benchmark, [*names, "text"], p)
    body = docs.columns.index(text)
    if p.action == "drop":
        found = found.where(F.size("spans") == 0)
    else:
        cut = F.pandas_udf(lambda t, s: t.combine(s, lambda a, b: _without(a, [(x["first"], x["after"]) for x in b]) if len(b) else a), "string")
        found = found.withColumn(f"c{body}", F.when(F.size("spans") > 0, cut("text", "spans")).otherwise(F.col("text")))
    return found.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)])


def oracle_sql(p: DecontaminateParams | None = None) -> str:
    p = p or DecontaminateParams()
    words = lambda t: f"list_filter(regexp_split_to_array(translate(coalesce({t}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {words('text')} AS w FROM documents),
b AS (SELECT item_id, {words('text')} AS w FROM benchmark),
g AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM (
  SELECT item_id, w, least({p.window}, len(w)) AS n, unnest(range(1, len(w) - least({p.window}, len(w)) + 2)) AS i FROM b WHERE len(w) > 0 AND item_id IS NOT NULL)),
n AS (SELECT DISTINCT n FROM g),
x AS (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, n WHERE len(w) >= n)),
h AS (SELECT x.r, x.n, x.i, g.item_id FROM x JOIN g ON x.n = g.n AND x.s = g.s),
c AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM h) GROUP BY r),
k AS (SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT r, item_id::VARCHAR AS id FROM h) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN c USING (r) LEFT JOIN k USING (r)"""
