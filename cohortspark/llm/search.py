"""Ranked lexical search over bags restricted to the vocabulary of the queries.

Documents are read once for each block of items and keep only the counts of terms that some
item asks for. Two documents with the same counts and the same length measure get the same
score for every item, so documents are grouped by a hash of both and verified on the values
themselves; a class is scored once. A class answers with its members in ascending order of
id: as all of them score alike, no item ever needs more than the first ``k``, and for each
item no task needs to report more than its ``k`` best classes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.llm.textops import arrow_limits, blocks, column_bytes, range_hash
from cohortspark.sources.stored import settle

#: fixed value: what a term is, in the documents and in the items
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
ITEM_BYTES = 16 << 20  # items searched together: their vocabulary is sent to every task
ITEM_ROWS = 50_000
SCORES = 1 << 20  # cells of the class x item matrix that is held at once
EXACT = 1 << 53  # sums of whole numbers below this are exact in doubles

_BREAK = np.ones(256, bool)
_BREAK[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 32
_CODE = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9FB21C651E98DF25)) ^ np.uint64(0x2545F4914F6CDD1D)
_PAIR = np.dtype([("term", "<i4"), ("tf", "<i4")])


def _spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte ranges of the terms of some texts, and each text's first term."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~_BREAK[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def _ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """``start, start + 1, ..`` of each range, one after another."""
    shift = np.cumsum(lengths) - lengths
    return np.arange(int(lengths.sum())) + np.repeat(starts - shift, lengths)


class Vocabulary:
    """Terms numbered in byte order, found by hash and compared byte by byte."""

    def __init__(self, terms: list[str]):
        coded = sorted(t.encode() for t in terms)
        self.lengths = np.array([len(t) for t in coded], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.data = np.frombuffer(b"".join(coded), np.uint8)
        hashes = range_hash(_CODE[self.data], self.starts, self.starts + self.lengths)
        self.order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[self.order]

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of each term of ``data`` (already folded), -1 for others."""
        out = np.full(len(starts), -1, np.int64)
        if not len(self.hashes) or not len(starts):
            return out
        hashes = range_hash(_CODE[data], starts, ends)
        at = np.searchsorted(self.hashes, hashes)
        todo = np.flatnonzero((at < len(self.hashes)) & (self.hashes[np.minimum(at, len(self.hashes) - 1)] == hashes))
        while len(todo):  # once, unless two terms of the vocabulary share a hash
            term, n = self.order[at[todo]], (ends - starts)[todo]
            fits = self.lengths[term] == n
            rows, term_fit, n_fit = np.flatnonzero(fits), term[fits], n[fits]
            if len(rows):
                equal = data[_ragged(starts[todo][rows], n_fit)] == self.data[_ragged(self.starts[term_fit], n_fit)]
                same = np.logical_and.reduceat(equal, np.cumsum(n_fit) - n_fit)
                out[todo[rows[same]]] = term_fit[same]
            todo = todo[out[todo] < 0]
            at[todo] += 1
            more = at[todo] < len(self.hashes)
            todo = todo[more]
            todo = todo[self.hashes[at[todo]] == hashes[todo]]
        return out


def _bags(docs: DataFrame, id_col: str, text_col: str, vocabulary) -> DataFrame:
    """(id, n, bag): all terms of a text counted, those of the vocabulary with their counts."""

    def run(batches: Iterator[pa.RecordBatch]):
        words: Vocabulary = vocabulary.value
        for batch in batches:
            data, offsets = column_bytes(batch.column(1))
            for lo, hi in blocks(offsets):
                part, at = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                starts, ends, first = _spans(part, at)
                found = words.find(_FOLD[part], starts, ends)
                doc = np.repeat(np.arange(hi - lo), np.diff(first))[found >= 0]
                cells, counts = np.unique(doc * len(words.lengths) + found[found >= 0], return_counts=True)
                pairs = np.empty(len(cells), _PAIR)
                width = max(len(words.lengths), 1)
                pairs["term"], pairs["tf"] = cells % width, counts
                cut = np.searchsorted(cells // width, np.arange(hi - lo + 1))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(np.diff(first).astype(np.int64)),
                     pa.array([pairs[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])], pa.binary())], ["id", "n", "bag"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, n long, bag binary")


def _document_counts(bags: DataFrame, width: int) -> DataFrame:
    """(term, df): one partial count a task and term."""

    def run(batches: Iterator[pa.RecordBatch]):
        total = np.zeros(width, np.int64)
        for batch in batches:
            data, _ = column_bytes(batch.column(0).cast(pa.large_binary()))
            total += np.bincount(np.frombuffer(data.tobytes(), _PAIR)["term"], minlength=width)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["term", "df"])

    return bags.select("bag").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))


def _best_classes(classes: DataFrame, asked, k: int) -> DataFrame:
    """(item, score, low, bag, m): every task's ``k`` best classes of each item."""
    kind = classes.schema["low"].dataType

    def run(batches: Iterator[pa.RecordBatch]):
        begin, items, weights, n_items, exact = asked.value
        best: list[list[tuple]] = [[] for _ in range(n_items)]
        for batch in batches:
            raw = [np.frombuffer(b, _PAIR) for b in batch.column("bag").to_pylist()]
            m = batch.column("m").to_numpy()
            low = batch.column("low").to_pylist()
            step = max(1, SCORES // max(n_items, 1))
            for lo in range(0, len(raw), step):
                part = raw[lo : lo + step]
                pairs, row = np.concatenate(part), np.repeat(np.arange(len(part)), [len(p) for p in part])
                term, tf = pairs["term"].astype(np.int64), pairs["tf"].astype(np.int64)
                gain = (1_000_000_000 * tf) // (1000 * tf + 8 * m[lo : lo + step][row])
                fan = begin[term + 1] - begin[term]
                at = _ragged(begin[term], fan)
                cell, add = np.repeat(row, fan) * n_items + items[at], np.repeat(gain, fan) * weights[at]
                if exact:
                    score = np.bincount(cell, add, len(part) * n_items).astype(np.int64)
                else:
                    score = np.zeros(len(part) * n_items, np.int64)
                    np.add.at(score, cell, add)
                score = score.reshape(len(part), n_items)
                # only what can still enter an item's list: at least its k-th score so far
                floor = np.array([b[-1][0] if len(b) == k else 1 for b in best])
                high = score
                if len(part) > k:
                    floor = np.maximum(floor, -np.partition(-high, k - 1, axis=0)[k - 1])
                for r, i in zip(*np.nonzero((score >= floor) & (score > 0))):
                    best[i].append((int(score[r, i]), low[lo + r], raw[lo + r].tobytes(), int(m[lo + r])))
                for i, held in enumerate(best):
                    if len(held) > 1:
                        held.sort(key=lambda x: (-x[0], x[1] is None, x[1]))
                        del held[k:]
        out = [(i, *x) for i, held in enumerate(best) for x in held]
        yield pa.RecordBatch.from_arrays(
            [pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], low_kind),
             pa.array([x[3] for x in out], pa.binary()), pa.array([x[4] for x in out], pa.int64())], ["item", "score", "low", "bag", "m"])

    low_kind = pa.int64() if kind.simpleString() == "bigint" else pa.int32() if kind.simpleString() == "int" else pa.string()
    return classes.select("bag", "m", "low").mapInArrow(run, f"item long, score long, low {kind.simpleString()}, bag binary, m long")


def _item_blocks(items: DataFrame) -> tuple[DataFrame, int]:
    """Distinct (item, term) with a block number; a block's texts have at most ITEM_BYTES."""
    text = F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = F.struct(F.col("item").isNull(), "item")
    total = items.agg(F.sum(F.octet_length("text")).alias("b"), F.count("*").alias("n")).first()
    n = max(1, math.ceil((total["b"] or 0) / ITEM_BYTES), math.ceil(total["n"] / ITEM_ROWS))
    while True:
        block = F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
        sizes = items.groupBy(block.alias("block")).agg(F.sum(F.octet_length("text")).alias("b"), F.count("*").alias("n"), F.count_distinct(key).alias("d"))
        if sizes.filter(((F.col("b") > ITEM_BYTES) | (F.col("n") > ITEM_ROWS)) & (F.col("d") > 1)).isEmpty():
            break
        n *= 2  # a single item stands alone, however long
    terms = items.select(block.alias("block"), "item", F.explode(F.regexp_extract_all(text, F.lit(TERM), F.lit(0))).alias("term"))
    return terms.distinct(), n


def ranked(
    docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """``(item_col, rank, id_col, score)``: each item's ``k`` documents of highest score above 0.

    A term is a run of letters, digits and characters beyond ASCII, with A-Z in lower case. A
    document's score sums, over the item's distinct terms, the term's weight
    ``floor(1000 ln((2N + 2) / (2df + 1)))`` times ``10^9 tf div (1000 tf + 8m)``, where
    ``m = 10 + 90 n N div L``. Equal scores go by ascending id, documents without an id last.
    Every row is a document of its own, repeated ids included. Rows of one item id (or of
    none) are one item. Null and empty texts have no terms. Other columns are ignored. Items
    are taken in blocks of bounded text size, and the documents are read once for each.
    """
    spark = docs.sparkSession
    arrow_limits(spark)
    queries = items.select(F.col(item_col).alias("item"), F.col(item_text_col).cast("string").alias("text"))
    terms, n_blocks = _item_blocks(queries)
    terms = settle(terms, "terms")
    out = None
    for block in range(n_blocks):
        part = _ranked_block(docs, terms.filter(F.col("block") == block), k, id_col, text_col)
        out = part if out is None else out.unionByName(part)
    return out.select(F.col("item").alias(item_col), "rank", F.col("id").alias(id_col), "score")


def _ranked_block(docs: DataFrame, terms: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    spark = docs.sparkSession
    pairs = [(r["item"], r["term"]) for r in terms.select("item", "term").collect()]  # of at most ITEM_BYTES of text
    words = sorted({t for _, t in pairs}, key=str.encode)
    number = {t: i for i, t in enumerate(words)}
    names = list(dict.fromkeys(x for x, _ in pairs))
    place = {name: i for i, name in enumerate(names)}
    vocabulary = spark.sparkContext.broadcast(Vocabulary(words))
    bags = settle(_bags(docs, id_col, text_col, vocabulary), "bags")
    stats = bags.agg(F.count_if(F.col("n") > 0).alias("n"), F.sum("n").alias("l")).first()
    n_docs, n_terms = stats["n"], stats["l"] or 0
    held = bags.filter(F.length("bag") > 0)
    weight = F.floor(1000 * F.log((2.0 * F.lit(n_docs) + 2) / (2.0 * F.col("df") + 1))).cast("long")
    df = _document_counts(held, len(words)).select("term", weight.alias("w")).collect()  # one row a term of the block
    w = np.zeros(len(words) + 1, np.int64)
    for r in df:
        w[r["term"]] = r["w"]
    term, item = (np.array(x, np.int64) for x in ([number[t] for _, t in pairs], [place[x] for x, _ in pairs]))
    order = np.lexsort((item, term))
    begin = np.searchsorted(term[order], np.arange(len(words) + 1))
    largest = int(np.bincount(item, minlength=1).max()) if len(item) else 0
    exact = largest * int(w.max(initial=0)) * 1_000_000 < EXACT
    asked = spark.sparkContext.broadcast((begin, item[order], w[term[order]], len(names), exact))

    m = (F.lit(10) + F.expr(f"(90L * n * {n_docs}L) div {max(n_terms, 1)}L")).cast("long")
    rows = held.select("id", "bag", m.alias("m")).withColumn("hash", F.xxhash64("bag", "m"))
    smallest = F.min("id").alias("low")
    classes = rows.groupBy("hash", "bag", "m").agg(smallest)
    found = _best_classes(classes, asked, k)
    best = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("low").asc_nulls_last(), "bag", "m")
    chosen = found.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k).drop("r", "low")
    chosen = settle(chosen.withColumn("hash", F.xxhash64("bag", "m")), "chosen")
    wanted = chosen.select("hash").distinct()  # at most k a item of the block: 8 bytes each
    order_in = Window.partitionBy("hash", "bag", "m").orderBy(F.col("id").asc_nulls_last())
    members = (rows.join(F.broadcast(wanted), "hash", "left_semi")
               .withColumn("r", F.row_number().over(order_in)).filter(F.col("r") <= k).drop("r"))
    answers = chosen.join(members, ["hash", "bag", "m"])
    last = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    top = answers.withColumn("rank", F.row_number().over(last)).filter(F.col("rank") <= k)
    labels = spark.createDataFrame([(i, x) for i, x in enumerate(names)], f"item long, name {terms.schema['item'].dataType.simpleString()}")
    return top.join(labels, "item").select(F.col("name").alias("item"), "rank", "id", "score")
