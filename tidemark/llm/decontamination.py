"""Benchmark decontamination: n-gram seeds join passages to test items, Smith-Waterman alignment scores them.

No seed is dropped for being common: where an item's other words are edited, a common seed may be all that a document
shares with it. What a common seed hits in vain is ruled out by a bound on the alignment's score, which loses nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, settled, table, text_of
from .words import BASE, Words, words_of

#: Words of a seed, words that an item needs, and the share of an item's words from which an alignment counts.
SEED, LEAST_WORDS, LEAST_SCORE = 4, 8, 0.4
#: Scores of an equal word, another word, and a word that only one side has.
MATCH, OTHER, GAP = 1.0, -0.5, 0.5
#: Places of items that hits are spread to at once, about (whole texts).
MOST_PLACES = 1 << 20
#: Bytes of test items that are held at once; more items take more passes.
BLOCK_BYTES = 16 << 20


@dataclass
class Items:
    """Test items of a block: their words, and their seeds by hash."""

    ids: list
    words: list[np.ndarray]
    keys: np.ndarray  # sorted hashes, each once
    first: np.ndarray  # where each hash's places begin, one entry more
    item: np.ndarray  # of each place: item number and word number
    at: np.ndarray
    maybe: np.ndarray

    @staticmethod
    def of(ids: list, words: list[np.ndarray], seeds: tuple[np.ndarray, np.ndarray, np.ndarray]) -> Items:
        hashes, item, at = seeds
        order = np.lexsort((at, item, hashes))
        hashes, item, at = hashes[order], item[order], at[order]
        keys, first = np.unique(hashes, return_index=True)
        maybe = np.zeros(1 << 20, bool)
        maybe[(keys & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        return Items(ids, words, keys, np.append(first, len(hashes)), item, at, maybe)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions among ``hashes`` that are seeds, and which."""
        at = np.flatnonzero(self.maybe[(hashes & np.uint64((1 << 20) - 1)).astype(np.int64)])
        if not len(at) or not len(self.keys):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        key = np.minimum(np.searchsorted(self.keys, hashes[at]), len(self.keys) - 1)
        hit = self.keys[key] == hashes[at]
        return at[hit], key[hit]


def items_of(rows: list[tuple[int, str]]) -> Items:
    w = words_of([t for _, t in rows])
    cuts, (hashes, first) = w.cuts(), w.grams(SEED)
    own = w.owner[first]
    sizes = np.diff(cuts)
    fine = sizes[own] >= LEAST_WORDS
    words = [w.hashes[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
    return Items.of([i for i, _ in rows], words, (hashes[fine], own[fine], first[fine] - cuts[own[fine]]))


def smith_waterman(item: np.ndarray, passage: np.ndarray) -> tuple[float, int, int]:
    """The best local alignment's score, and its first and last+1 word in the passage."""
    n, m = len(item), len(passage)
    slope = GAP * np.arange(m + 1)
    held = np.zeros((n + 1, m + 1))
    for i in range(n):
        fresh = np.zeros(m + 1)
        fresh[1:] = np.maximum(held[i, :-1] + np.where(passage == item[i], MATCH, OTHER), held[i, 1:] - GAP)
        held[i + 1] = np.maximum(np.maximum.accumulate(fresh + slope) - slope, 0.0)
    i, j = np.unravel_index(int(held.argmax()), held.shape)
    score, end = float(held[i, j]), int(j)
    start = end
    while i > 0 and j > 0 and held[i, j] > 0:
        if math.isclose(held[i, j], held[i - 1, j - 1] + (MATCH if passage[j - 1] == item[i - 1] else OTHER), abs_tol=1e-9):
            i, j = i - 1, j - 1
            start = int(j)
        elif math.isclose(held[i, j], held[i - 1, j] - GAP, abs_tol=1e-9):
            i -= 1
        else:
            j -= 1
    return score, start, end


def most(item: np.ndarray, passage: np.ndarray) -> float:
    """No alignment scores more. With m words matched, b of them right behind another on both sides, there are m - b
    runs with something that costs 0.5 at least between any two: m - (m - b - 1) / 2."""

    def shared(own: np.ndarray, other: np.ndarray) -> int:
        if not len(own) or not len(other):
            return 0
        other = np.sort(other)
        return int((other[np.minimum(np.searchsorted(other, own), len(other) - 1)] == own).sum())

    pairs = [x[:-1] * np.uint64(BASE) + x[1:] for x in (item, passage)]
    return MATCH * shared(item, passage) - min(GAP, -OTHER) * max(0, shared(item, passage) - shared(*pairs) - 1)


def _windows(at: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Stretches of words that hold all positions of hits, with an item's length around them; long ones in overlapping pieces."""
    first = last = int(at[0])
    for x in at[1:].tolist():
        if x - last > 2 * size or x - first > 4 * size:
            yield first - size, last + size + SEED
            first = x
        last = x
    yield first - size, last + size + SEED


def scan(w: Words, items: Items, least: float = LEAST_SCORE) -> Iterator[tuple[int, int, float, int, int]]:
    """(text, item, score, first and last+1 word): the best alignment of each text and item that share a seed, of
    ``least`` or more. A score is the alignment's, by the item's words: 1 for a whole copy."""
    hashes, first = w.grams(SEED)
    at, key = items.find(hashes)
    if not len(at):
        return
    counts = items.first[key + 1] - items.first[key]
    spread, owner, cuts = np.cumsum(counts), w.owner[first[at]], w.cuts()
    a = 0
    while a < len(at):
        b = int(np.searchsorted(spread, spread[a] + MOST_PLACES, side="right"))
        b = int(np.searchsorted(owner, owner[b - 1], side="right"))
        yield from _scan(w, cuts, items, first[at[a:b]], key[a:b], counts[a:b], least)
        a = b


def _scan(w: Words, cuts: np.ndarray, items: Items, first: np.ndarray, key: np.ndarray, counts: np.ndarray, least: float) -> Iterator[tuple[int, int, float, int, int]]:
    place = np.repeat(items.first[key], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    spot, item = np.repeat(first, counts), items.item[place]
    text = w.owner[spot]
    order = np.lexsort((spot, item, text))
    spot, item, text = spot[order], item[order], text[order]
    groups = np.flatnonzero(np.append(True, (item[1:] != item[:-1]) | (text[1:] != text[:-1])))
    for a, b in zip(groups.tolist(), np.append(groups[1:], len(spot)).tolist(), strict=True):
        own, best = items.words[item[a]], (0.0, 0, 0)
        for low, high in _windows(np.unique(spot[a:b]), len(own)):
            low, high = max(low, int(cuts[text[a]])), min(high, int(cuts[text[a] + 1]))
            if most(own, w.hashes[low:high]) < max(least * len(own), best[0]):
                continue
            score, start, end = smith_waterman(own, w.hashes[low:high])
            if score > best[0]:
                best = score, low + start, low + end
                if score >= len(own) * MATCH:
                    break
        if best[0] >= least * len(own):
            yield int(text[a]), int(item[a]), best[0] / len(own), best[1], best[2]


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items, so many at a time that they fit the bound."""
    items = benchmark.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), text_of().alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // BLOCK_BYTES)
    for i in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == i)
        yield [(r.item_id, r.text) for r in part.orderBy("item_id", "text").collect()]


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, score, start_char, end_char: each row of ``docs`` and item whose alignment scores ``LEAST_SCORE``.

    Words are compared in lower case without punctuation. Items of fewer than ``LEAST_WORDS`` words and rows with a null
    item_id take no part; null texts are empty and match nothing. Repeated rows and equal items give rows each. Characters
    count from 0 within the text. Other columns play no part; an empty table on either side gives no rows.
    """
    schema = "doc_id long, item_id long, score double, start_char long, end_char long"
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    out = None
    for block in _blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(items_of(block))  # BLOCK_BYTES of texts

        @settled
        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = shared.value
            for batch, own in chunks(batches, "text"):
                w, ids = words_of(own), batch.column(0).to_pylist()
                rows = [(ids[t], items.ids[i], s, int(w.starts[a] - w.offsets[t]), int(w.ends[b - 1] - w.offsets[t])) for t, i, s, a, b in scan(w, items)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "item_id", "score", "start_char", "end_char"])

        found = texts.mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` without a match, all their columns; nothing is shuffled."""
    for block in _blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(items_of(block))  # BLOCK_BYTES of texts

        @settled
        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch, own in chunks(batches, "text"):
                hit = {t for t, *_ in scan(words_of(own), shared.value)}
                yield batch.take(pa.array([i for i in range(len(own)) if i not in hit], pa.int64())) if hit else batch

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and test item of which it holds a copy, edited or not."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return matches(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))
