"""Segments: blocks packed to a token budget, one pass over each document with carried state.

The packing depends on what was put out before (heading prefix, overlap tail), so it is a fold over a document's blocks
in one group; a document is bounded, the corpus is not. Nothing is ever dropped: the budget of a unit leaves room for
the heading path, and a unit over the budget is cut into pieces of it.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from corpusgraph.functions.text import SENTENCE_END, token_budget

SCHEMA = "doc_id {id}, segment_ix int, text string, headings array<string>, n_tokens int"
_SENTENCE = re.compile(SENTENCE_END)


def count_words(text: str) -> int:
    return len(text.split())


def hard(text: str, budget: int) -> Iterator[str]:
    w = text.split()
    for i in range(0, len(w), budget):
        yield " ".join(w[i : i + budget])


def pack(pieces: Iterator[str], joint: str, budget: int, count: Callable[[str], int], smaller: Callable[[str], Iterator[str]]) -> Iterator[str]:
    """Greedy packing; a piece over the budget is first cut by `smaller`."""
    held: list[str] = []
    size = 0
    for piece in pieces:
        for p in [piece] if count(piece) <= budget else smaller(piece):
            n = count(p)
            if held and size + n > budget:
                yield joint.join(held)
                held, size = [], 0
            held.append(p)
            size += n
    if held:
        yield joint.join(held)


def split_to_budget(text: str, budget: int, count: Callable[[str], int] = count_words) -> list[str]:
    """Paragraphs packed to the budget, over-long ones by sentences, over-long sentences by tokens."""
    sentences = lambda p: pack((s for s in _SENTENCE.split(p) if s.strip()), " ", budget, count, lambda s: hard(s, budget))
    return list(pack((p for p in re.split(r"\n\s*\n", text) if p.strip()), "\n\n", budget, count, sentences))


def segments_of(blocks: list[tuple[str, list[str]]], budget: int, overlap: int, count: Callable[[str], int] = count_words) -> Iterator[tuple[str, list[str], int]]:
    """(text, headings, tokens) of each segment: new headings open a segment; a full one passes on its tail."""
    held: list[str] = []
    size = 0
    path: list[str] = []
    fresh = False

    def out() -> tuple[str, list[str], int]:
        body = "\n\n".join(held)
        text = "\n".join(path) + "\n\n" + body if path else body
        return text, path, count(text)

    for text, headings in blocks:
        room = max(1, budget - sum(map(count, headings)))
        if headings != path:
            if fresh:
                yield out()
            held, size, path, fresh = [], 0, list(headings), False
        for unit in split_to_budget(text, room, count):
            n = count(unit)
            if fresh and size + n > room:
                yield out()
                tail = " ".join(" ".join(held).split()[-overlap:]) if overlap > 0 else ""
                held, size = ([tail], count(tail)) if tail and count(tail) + n <= room else ([], 0)
            held.append(unit)
            size += n
            fresh = True
    if fresh:
        yield out()


def segments(blocks: DataFrame, max_tokens: int = 1024, overlap: int = 64, model_max: int = 1024, reserve: int = 8) -> DataFrame:
    """(doc_id, block_ix, text, headings) -> (doc_id, segment_ix, text, headings, n_tokens)."""
    budget = token_budget(max_tokens, model_max, reserve)

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block_ix", kind="stable")
        units = [(t or "", list(h) if h is not None else []) for t, h in zip(pdf["text"], pdf["headings"], strict=True)]
        rows = [(pdf["doc_id"].iloc[0], i, t, h, n) for i, (t, h, n) in enumerate(segments_of(units, budget, overlap))]
        return pd.DataFrame(rows, columns=["doc_id", "segment_ix", "text", "headings", "n_tokens"])

    return blocks.select("doc_id", "block_ix", "text", "headings").groupBy("doc_id").applyInPandas(fold, SCHEMA.format(id=dict(blocks.dtypes)["doc_id"]))
