"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

Words are runs of ASCII letters, digits and other characters, lower-cased; so punctuation, capitals and
markup between words do not matter. All n-grams of the items are seeds, however common they are, so what is
found in a document does not depend on the other documents. One pass finds the seeds
in each document and aligns the item with the passage around them: +1 for an equal word, -1/2 for another or a
missing one. The best score, as a share of the item's words, is reported from ``least`` on. A passage is
aligned only where its words that the item has, less half of the others, could come to that score. Seeds belong
to one passage while the gaps that ``least`` allows could lie between them, 2 * (1 - least) * its words.

The items are sent to the tasks in slices of at most about MAX_ITEMS and MAX_BYTES. There is one pass over the
documents, whatever the number of slices: a task hashes the words of a batch once and holds one slice after the
other against it, so its memory is bounded. Texts are never shuffled.

A null text counts as empty; an item without words matches nothing; one with fewer words than an n-gram is
found where all of them stand in a row. Items with equal texts each match. Rows with equal ids are reported each. Without documents or items
the result is empty. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import filled, save, short_batches

N = 3
MAX_ITEMS, MAX_BYTES = 20_000, 16 << 20
LEAST = 0.5


def grams_of(words: np.ndarray, at: np.ndarray, size: int = N) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``size`` words that begin at each word, and whether they lie within one row."""
    n = len(words)
    if n < size:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    total = np.full(n - size + 1, size, np.uint64)
    for i in range(size):
        total += words[i : n - size + 1 + i] * np.uint64(pow(0xD6E8FEB86659FD93, i + 1, 1 << 64))
    whole = np.ones(n - size + 1, bool)
    for i in range(1, size):
        cut = at[1:-1] - i
        whole[cut[(cut >= 0) & (cut < len(whole))]] = False
    return W.mix(total), whole


class Items:
    """A slice of the test items: their words, and where each n-gram occurs in them."""

    def __init__(self, ids: list[int], texts: list[str]):
        data, ends = W.texts(pa.array(texts, pa.string()))
        h, _, _, at = W.word_hashes(data, ends, lower=True, inner=True)
        words = [h[at[k] : at[k + 1]] for k in range(len(ids))]
        kept = [k for k, w in enumerate(words) if len(w)]
        self.ids, self.words = [ids[k] for k in kept], [words[k] for k in kept]
        self.size = np.array([len(w) for w in self.words], np.int64)
        self.short = {}
        gram, item, place = [], [], []
        for k, w in enumerate(self.words):
            g = W.shingles(w, N)
            if len(w) < N:
                self.short.setdefault(len(w), {}).setdefault(int(g[0]), []).append(k)
                continue
            gram.append(g)
            item.append(np.full(len(g), k))
            place.append(np.arange(len(g)))
        self.gram, self.item, self.place = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (gram, item, place))
        order = np.argsort(self.gram.astype(np.uint64), kind="stable")
        self.gram, self.item, self.place = self.gram.astype(np.uint64)[order], self.item[order], self.place[order]
        self.all, self.start = np.unique(self.gram, return_index=True)
        self.start = np.append(self.start, len(self.gram))


def align(item: np.ndarray, passage: np.ndarray) -> tuple[float, int, int]:
    """Smith-Waterman: the best score, and the first word and end of that passage."""
    n = len(passage)
    half = 0.5 * np.arange(n + 1)
    row, frm = np.zeros(n + 1), np.arange(n + 1)
    best, lo, hi = 0.0, 0, 0
    for w in item:
        score = np.where(passage == w, 1.0, -0.5)
        slant, up = row[:-1] + score, row[1:] - 0.5
        new, start = np.zeros(n + 1), np.arange(n + 1)
        new[1:] = np.maximum(0, np.maximum(slant, up))
        start[1:] = np.where(new[1:] <= 0, start[1:], np.where(slant >= up, frm[:-1], frm[1:]))
        lifted = new + half
        peak = np.maximum.accumulate(lifted)
        at = np.maximum.accumulate(np.where(lifted == peak, np.arange(n + 1), 0))
        gap = peak - half
        start = np.where(gap > new, start[at], start)
        row, frm = np.maximum(new, gap), start
        k = int(np.argmax(row))
        if row[k] > best:
            best, lo, hi = float(row[k]), int(frm[k]), k
    return best, lo, hi


def most_score(item: np.ndarray, passage: np.ndarray) -> float:
    """No alignment scores more: the best stretch of the passage, +1 for a word of the item, -1/2 for another."""
    total = np.cumsum(np.where(np.isin(passage, item), 1.0, -0.5))
    return float(np.max(total - np.minimum(0, np.minimum.accumulate(total)), initial=0))


def _match(items: Items, words: np.ndarray, hit: np.ndarray, place: np.ndarray, least: float) -> Iterator[tuple[int, float, int, int, int]]:
    """One row's matches: item, score, first word, end, seeds. hit: indexes into items.all; place: their words."""
    reps = items.start[hit + 1] - items.start[hit]
    entry = np.repeat(items.start[hit], reps) + np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
    item, slant = items.item[entry], np.repeat(place, reps) - items.place[entry]
    order = np.lexsort((slant, item))
    item, slant = item[order], slant[order]
    # an alignment that reaches `least` holds at most so many words that the item lacks
    room = np.floor(2 * (1 - least) * items.size[item] + 1e-9).astype(np.int64)
    cuts = np.flatnonzero(np.append(True, (item[1:] != item[:-1]) | (slant[1:] - slant[:-1] > room[1:])))
    best: dict[int, tuple[float, int, int, int]] = {}
    for i, j in zip(cuts, np.append(cuts[1:], len(item)), strict=True):
        k = int(item[i])
        own = items.words[k]
        lo, hi = max(0, int(slant[i] - room[i])), min(len(words), int(slant[j - 1] + room[i]) + len(own))
        passage = words[lo:hi]
        if most_score(own, passage) < least * len(own):
            continue
        score, a, b = align(own, passage)
        if score >= least * len(own) and (k not in best or score > best[k][0]):
            best[k] = score, lo + a, lo + b, j - i
    for k, (score, a, b, seeds) in sorted(best.items()):
        yield k, score / len(items.words[k]), a, b, seeds


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", least: float = LEAST) -> DataFrame:
    """doc_id, item_id, score (0 to 1), first_word, end_word, seeds: one row for each document and item that match."""
    with short_batches(docs.sparkSession):
        return _contaminated(docs, benchmark, id_col, text_col, item_col, item_text, least)


def _contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text: str, least: float) -> DataFrame:
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.lower(filled(F.col(text_col).cast("string"))).alias("text"))
    tests = benchmark.select(F.col(item_col).cast("long").alias("item"), F.lower(filled(F.col(item_text).cast("string"))).alias("text"))
    count, size = tests.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    slices = max(1, -(-count // MAX_ITEMS), -(-size // MAX_BYTES))
    sent = []
    for s in range(slices):
        part = tests.where(F.pmod(F.xxhash64("text", "item"), F.lit(slices)) == s) if slices > 1 else tests
        part = part.orderBy("item", "text").collect()
        sent.append(spark.sparkContext.broadcast(Items([r.item for r in part], [r.text for r in part])))
    out = save(_search(rows, sent, least), "decontamination")
    for b in sent:
        b.destroy()
    return out.select(F.col("doc").alias(id_col), F.col("item").alias(item_col), "score", "first_word", "end_word", "seeds")


def _found(items: Items, h: np.ndarray, at: np.ndarray, least: float) -> Iterator[tuple[int, int, float, int, int, int]]:
    """Row, item, score, first word, end and seeds of each match in a block of rows (of which these are the words'
    hashes, and each row's first word)."""
    g, whole = grams_of(h, at)
    k, is_in = W.find(items.all, g)
    place = np.flatnonzero(is_in & whole)
    doc = np.searchsorted(at, place, "right") - 1
    for d in np.unique(doc):
        lo, hi = np.searchsorted(doc, [d, d + 1])
        p = place[lo:hi]
        for m in _match(items, h[at[d] : at[d + 1]], k[p], p - at[d], least):
            yield int(d), items.ids[m[0]], *m[1:]
    for n, wanted in items.short.items():
        g, whole = grams_of(h, at, n)
        place = np.flatnonzero(W.find(np.array(sorted(wanted), np.uint64), g)[1] & whole)
        found: dict[tuple[int, int], list[int]] = {}
        for p, d in zip(place, np.searchsorted(at, place, "right") - 1, strict=True):
            found.setdefault((int(d), int(g[p])), []).append(int(p - at[d]))
        for (d, x), p in found.items():
            for m in wanted[x]:
                yield d, items.ids[m], 1.0, p[0], p[0] + n, len(p)


def _search(rows: DataFrame, sent: list, least: float) -> DataFrame:
    names = ["doc", "item", "score", "first_word", "end_word", "seeds"]
    types = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64())

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            data, ends = W.texts(batch.column(1))
            # words are hashed once, whatever the slices; of the slices a task holds one
            hashed = [(i, *W.word_hashes(data, ends[i : j + 1], lower=True, inner=True)[::3]) for i, j in W.blocks(ends)]
            out = []
            for part in sent:
                items = part.value
                for i, h, at in hashed:
                    out += [(ids[i + d].as_py(), *m) for d, *m in _found(items, h, at, least)]
                if len(sent) > 1:
                    items = None
                    part.__dict__.pop("_value", None)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names)

    return rows.mapInArrow(search, "doc long, item long, score double, first_word long, end_word long, seeds long")
