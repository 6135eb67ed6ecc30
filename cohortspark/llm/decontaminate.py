"""Benchmark decontamination by the CGK random walk and bit-sampling LSH.

The CGK walk embeds edit distance into Hamming distance: at step j it emits the word it
stands on and moves on if the bit that the step's random function assigns to that word is 1.
Two texts that differ by few edits fall back into step after each edit, so they agree in most
steps. A hash samples the words emitted at a few steps; windows of equal samples whose
Hamming distance over further sampled steps is small make a candidate, and walks and samples
repeat independently. Windows are sized by the items: a class of items of
n words takes windows of up to three quarters of n words, at a stride of a quarter of the
window in documents and at every word in items, so that each copy of an item meets one of
its windows in every repetition. Every candidate is then decided by the exact word edit
distance between the item and the best matching stretch of the document.

The random function of step j depends on j modulo 8 and moves every word at least once in
eight steps, so that no walk gets stuck; a walk is a composition of blocks of
eight steps that are computed once per word and shared by all windows and sizes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.llm.textops import U64, Words, arrow_limits, blocks, column_bytes, mix

REPEATS = 6
SAMPLES = 4  # words in a hash
WITNESSES, AGREE = 12, 7  # further steps of the walk, and how many of them must agree
RATIO = 0.2  # edits allowed per word of the item
MIN_WORDS = 5  # shorter items prove nothing and are left out
BLOCK_WORDS = 400_000  # words of items searched at a time
_STEPS = 8
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] |= 32
_FOLD[[b for b in range(128) if not chr(b).isalnum()]] = 0x20


def window_of(n: int) -> int:
    """The window for items of n words: the largest of 3, 4, 6, 8, 12, 16, 24, ... up to 3n/4."""
    best = 3
    size = 1
    while size <= n:
        for s in (size, size * 3 // 2):
            if 3 <= s and 4 * s <= 3 * n:
                best = max(best, s)
        size *= 2
    return best


def folded_words(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Words of letters and digits in lower case; other ASCII characters separate."""
    data = _FOLD[data]
    if len(data) > 1:
        capital = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
        data[1:][capital] |= 0x20
    return Words(data, offsets)


class Walks:
    """One repetition's walks over a sequence of words."""

    def __init__(self, words: np.ndarray, repeat: int, reach: int):
        n = len(words)
        self.words = np.concatenate([words, np.zeros(reach + _STEPS, U64)])  # walks may leave the text
        random = mix(self.words, 100 + repeat)
        bits = (random >> U64(56)).astype(np.uint8) | np.left_shift(np.uint8(1), ((random >> U64(40)) & U64(7)).astype(np.uint8))
        at = np.arange(n + reach, dtype=np.int32)
        self.after = [np.zeros(n + reach, np.uint8)]  # displacement after k steps of a block
        for k in range(_STEPS):
            move = (bits[at] >> np.uint8(k)) & np.uint8(1)
            at += move
            self.after.append(self.after[-1] + move)

    def emitted(self, starts: np.ndarray, steps: list[int]) -> list[np.ndarray]:
        """The words emitted at each of the (ascending) steps, for each window start."""
        at, block, out = starts.astype(np.int32), 0, []
        for step in steps:
            while block < step // _STEPS:
                at = at + self.after[_STEPS][at]
                block += 1
            out.append(self.words[at + self.after[step % _STEPS][at] if step % _STEPS else at])
        return out

    def hashes(self, starts: np.ndarray, steps: list[int]) -> np.ndarray:
        """A hash of the words emitted at the steps, for each window start."""
        out = np.full(len(starts), U64(len(steps)))
        for words in self.emitted(starts, steps):
            out = out * U64(0x2545F4914F6CDD1D) + words
        return mix(out, 7)


def _steps(window: int, repeat: int) -> list[int]:
    """The sampled steps of a repetition: one in each part of the walk over about 3/4 of the window."""
    rng = np.random.default_rng([window, repeat])
    edges = np.linspace(0, 1.5 * window, SAMPLES + 1)
    return [int(rng.integers(int(a), max(int(a) + 1, int(b)))) for a, b in zip(edges[:-1], edges[1:])]


def _witnesses(window: int) -> list[int]:
    """Steps spread over the same part of the walk, to compare in Hamming distance."""
    return np.linspace(0, 1.5 * window - 1, WITNESSES).astype(int).tolist()


@dataclass
class Index:
    """The item windows of one block of items."""

    ids: list
    words: list[np.ndarray] = field(default_factory=list)
    tables: dict[tuple[int, int], tuple] = field(default_factory=dict)  # (window, repeat): bitmap, keys, item, offset, witnesses
    reach: int = 0

    def build(self, repeats: int) -> Index:
        groups: dict[int, list[int]] = {}
        for i, w in enumerate(self.words):
            groups.setdefault(window_of(len(w)), []).append(i)
        self.reach = 2 * max(groups, default=0) + _STEPS
        for r in range(repeats):
            for window, members in groups.items():
                parts = []
                for i in members:
                    starts = np.arange(len(self.words[i]) - window + 1)
                    walks = Walks(self.words[i], r, self.reach)
                    parts.append((walks.hashes(starts, _steps(window, r)), np.full(len(starts), i), starts, np.stack(walks.emitted(starts, _witnesses(window)), axis=1)))
                keys, item, offset, seen = (np.concatenate(x) for x in zip(*parts))
                order = np.argsort(keys, kind="stable")
                size = 1 << max(16, (64 * len(keys)).bit_length())
                bitmap = np.zeros(size, bool)
                bitmap[(keys & U64(size - 1)).astype(np.int64)] = True
                self.tables[window, r] = bitmap, keys[order], item[order], offset[order], seen[order]
        return self

    def candidates(self, words: np.ndarray, repeats: int) -> tuple[np.ndarray, np.ndarray]:
        """(item, position where it would begin) of windows whose hashes agree."""
        found = []
        for r in range(repeats):
            walks = Walks(words, r, self.reach)
            for (window, at), (bitmap, keys, item, offset, seen) in self.tables.items():
                if at != r:
                    continue
                starts = np.arange(0, len(words), max(1, window // 4), dtype=np.int32)
                h = walks.hashes(starts, _steps(window, r))
                maybe = np.flatnonzero(bitmap[(h & U64(len(bitmap) - 1)).astype(np.int64)])
                lo, hi = np.searchsorted(keys, h[maybe], "left"), np.searchsorted(keys, h[maybe], "right")
                hit = np.flatnonzero(hi > lo)
                maybe, lo, size = maybe[hit], lo[hit], (hi - lo)[hit]
                if not len(hit):
                    continue
                near = np.stack(walks.emitted(starts[maybe], _witnesses(window)), axis=1)
                for a in range(0, len(hit), 4096):  # bounded memory, however many item windows share a hash
                    n = size[a : a + 4096]
                    which = np.repeat(lo[a : a + 4096] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                    doc = np.repeat(np.arange(a, a + len(n)), n)
                    good = (near[doc] == seen[which]).sum(axis=1) >= AGREE
                    found.append(np.stack([item[which[good]], starts[maybe[doc[good]]].astype(np.int64) - offset[which[good]]]))
        item, begin = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
        return item, begin


def edit_distance(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """Smallest word edit distance between ``item`` and any stretch of ``text``; its end."""
    steps = np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, np.int64)
    for word in item:
        new = row + 1
        new[1:] = np.minimum(new[1:], row[:-1] + (text != word))
        row = np.minimum.accumulate(new - steps) + steps
    end = int(row.argmin())
    return int(row[end]), end


def _matches(texts: pa.Array, index: Index, repeats: int, ratio: float) -> Iterator[tuple[int, int, int, int]]:
    """(row, item, distance, word where the match ends), the best of each row and item."""
    data, offsets = column_bytes(texts)
    for lo, hi in blocks(offsets):
        at = offsets[lo : hi + 1]
        words = folded_words(data[at[0] : at[-1]], at - at[0])
        h = words.hashes()
        item, begin = index.candidates(h, repeats)
        if not len(item):
            continue
        size = np.array([len(w) for w in index.words])
        middle = np.clip(begin + size[item] // 2, 0, max(len(h) - 1, 0))
        row = np.searchsorted(words.first, middle, "right") - 1
        near = np.maximum(1, (ratio * size).astype(np.int64))
        keys = np.unique(np.stack([row, item, begin // near[item]]), axis=1)
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for r, i, bucket in keys.T.tolist():
            limit = int(ratio * size[i])
            if best.get((r, i), (1,))[0] == 0:
                continue
            first, last = int(words.first[r]), int(words.first[r + 1])
            a = max(first, bucket * int(near[i]) - limit)
            b = min(last, (bucket + 1) * int(near[i]) + int(size[i]) + limit)
            if b - a < size[i] - limit or np.isin(h[a:b], index.words[i]).sum() < size[i] - limit:
                continue  # too few words of the item for so few edits
            distance, end = edit_distance(index.words[i], h[a:b])
            if distance <= limit and (distance, a + end - first) < best.get((r, i), (limit + 1, 0)):
                best[r, i] = distance, a + end - first
        for (r, i), (distance, end) in best.items():
            yield lo + r, i, distance, end


def _item_blocks(items: DataFrame, id_col: str, text_col: str, block_words: int) -> Iterator[Index]:
    """The items in blocks of bounded size; only one is held at a time."""
    index, size = Index([]), 0
    rows = items.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).filter(F.col(id_col).isNotNull()).distinct()
    for name, text in rows.toLocalIterator():
        data = np.frombuffer((text or "").encode(), np.uint8)
        words = folded_words(data, np.array([0, len(data)])).hashes()
        if len(words) < MIN_WORDS:
            continue
        index.ids.append(name)
        index.words.append(words)
        size += len(words)
        if size >= block_words:
            yield index
            index, size = Index([]), 0
    if index.ids:
        yield index


def contaminated(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
    ratio: float = RATIO, repeats: int = REPEATS, block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """``(id_col, item_id, item_words, distance, end_word)``: the items a document holds.

    Words are runs of letters and digits, lower-cased. An item of n words is held when some
    stretch of the document is within ``ratio * n`` word edits of it; the smallest distance
    and where that stretch ends are given. Items of fewer than 5 words, null texts and null
    item ids match nothing; items of one id are alternatives. Items are searched in blocks,
    each a bounded broadcast and one scan of ``docs``.
    """
    spark = docs.sparkSession
    arrow_limits(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = "id long, item long, item_words int, distance int, end_word int"
    out = spark.createDataFrame([], schema)
    for index in _item_blocks(items, item_id, item_text, block_words):
        shared = spark.sparkContext.broadcast(index.build(repeats))

        def run(batches, shared=shared):
            for batch in batches:
                index = shared.value
                found = [(r, index.ids[i], len(index.words[i]), d, e) for r, i, d, e in _matches(batch.column(1), index, repeats, ratio)]
                if found:
                    r, *rest = zip(*found)
                    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32()]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(r)), *[pa.array(x, k) for x, k in zip(rest, kinds)]],
                                                     ["id", "item", "item_words", "distance", "end_word"])

        out = out.union(rows.mapInArrow(run, schema))
    best = out.groupBy("id", "item").agg(F.min(F.struct("distance", "end_word", "item_words")).alias("b"))
    return best.select(F.col("id").alias(id_col), F.col("item").alias(item_id), "b.item_words", "b.distance", "b.end_word")
