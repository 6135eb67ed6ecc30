"""Packing by lexical retrieval: related documents share a training sequence.

Documents are tokenized once; the same pass counts in how many documents each token
occurs (the vocabulary bounds that table). Documents are laid out in the order of their most
telling token, cut into shards of bounded size, and each shard builds a BM25 inverted index
over its documents with the statistics of the whole corpus. A sequence starts with a seed
document; the index returns the seed's unused neighbours, best first and as many as it takes to
fill the window greedily. A seed asks its own shard only. The last one is cut where the window ends and its rest seeds the next window, so
only the last sequence of a partition is not full.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.llm.textops import arrow_limits
from cohortspark.llm.tokens import encoded
from cohortspark.sources.stored import settle

WINDOW = 4096
SHARD_TOKENS = 1 << 20  # tokens indexed at a time
PARTITION_TOKENS = 1 << 22  # tokens of a task, about
QUERY_TERMS = 24  # the seed's tokens of highest BM25 weight ask the index
NEIGHBOURS = 24  # answers ranked at first; the others follow if they do not fill the window
K1, B = 1.2, 0.75
_VOCABULARY = 1 << 16
_RANKS = np.log1p(np.arange(_VOCABULARY, dtype=np.float32))


def distinct(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ids and how often each occurs."""
    ids = np.sort(ids, kind="stable")  # by radix
    at = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
    return ids[at], np.diff(np.append(at, len(ids)))


def telling(terms: np.ndarray, tf: np.ndarray) -> int:
    """The id that tells most about a document: often in it, and rare by its rank.

    Merges are numbered from the most frequent on, so the number itself ranks rarity.
    """
    return int(terms[np.argmax(_RANKS[terms] * tf / (tf + np.float32(K1)))])


def tokenized(docs: DataFrame, id_col: str, text_col: str, tokenizer: str, end_id: int) -> DataFrame:
    """(id, n, lead, ids, seen): the document's ids and then ``end_id``, 16 bits each, their number and most telling one.

    The last row of a task is no document: ``seen`` counts the task's documents that hold each token.
    """
    tail = np.array([end_id], "<u2").tobytes()

    def run(batches):
        seen = np.zeros(_VOCABULARY, "<i8")
        for batch in batches:
            ids, lead = [x + tail for x in encoded(batch.column(1), tokenizer)], []
            for x in ids:
                terms, tf = distinct(np.frombuffer(x, "<u2"))
                lead.append(telling(terms, tf))
                seen[terms] += 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(x) // 2 for x in ids], pa.int64()), pa.array(lead, pa.int64()), pa.array(ids, pa.binary()), pa.nulls(len(ids), pa.binary())], names)
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((None, 0, None, None, seen.tobytes()), types)], names)

    names, types = ["id", "n", "lead", "ids", "seen"], [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, n long, lead long, ids binary, seen binary")


def document_frequencies(seen: DataFrame) -> np.ndarray:
    """Documents that hold each token, from the counts of all tasks: one number per token of the vocabulary."""

    def run(batches):
        total = np.zeros(_VOCABULARY, np.int64)
        for batch in batches:
            for x in batch.column(0):
                total += np.frombuffer(x.as_buffer(), "<i8")
        terms = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(terms), pa.array(total[terms])], ["term", "df"])

    found = seen.mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    df = np.zeros(_VOCABULARY, np.int64)
    df[found["term"].to_numpy()] = found["df"].to_numpy()
    return df


@dataclass
class Statistics:
    """Of the whole corpus: documents, mean length, and each token's idf."""

    documents: int
    mean: float
    idf: np.ndarray


class Shard:
    """A BM25 inverted index of some documents."""

    def __init__(self, docs: list[np.ndarray], stats: Statistics):
        terms, tf = zip(*[distinct(d) for d in docs])
        size = np.array([len(d) for d in docs])
        owner = np.repeat(np.arange(len(docs), dtype=np.int32), [len(t) for t in terms])
        term, tf = np.concatenate(terms), np.concatenate(tf)
        weight = (stats.idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[owner] / stats.mean))).astype(np.float32)
        self.ends = np.cumsum([len(t) for t in terms])
        self.terms, self.weights = term, weight
        order = np.argsort(term, kind="stable")
        self.owner, self.posted = owner[order], weight[order]
        self.at = np.searchsorted(term[order], np.arange(_VOCABULARY + 1))
        self.n = len(docs)

    def neighbours(self, seed: int, unused: np.ndarray) -> Iterator[int]:
        """All unused documents that share a query token with the seed, best first; ties by position."""
        lo, hi = (self.ends[seed - 1] if seed else 0), self.ends[seed]
        terms, weights = self.terms[lo:hi], self.weights[lo:hi]
        if len(terms) > QUERY_TERMS:
            terms = terms[np.argsort(-weights, kind="stable")[:QUERY_TERMS]]
        spans = [slice(self.at[t], self.at[t + 1]) for t in terms.tolist()]
        score = np.bincount(np.concatenate([self.owner[s] for s in spans]), np.concatenate([self.posted[s] for s in spans]), self.n)
        score[~unused] = 0
        found = np.flatnonzero(score > 0)
        if len(found) > NEIGHBOURS:
            least = np.partition(score[found], len(found) - NEIGHBOURS)[len(found) - NEIGHBOURS]
            best = found[score[found] >= least]  # with all ties of the last one
            yield from best[np.argsort(-score[best], kind="stable")].tolist()
            found = found[score[found] < least]
        yield from found[np.argsort(-score[found], kind="stable")].tolist()


class _Packer:
    """Fills one window after the other; an open window passes from shard to shard."""

    def __init__(self, partition: int, window: int):
        self.window, self.sequence, self.offset = window, partition << 40, 0
        self.rows: list[tuple] = []

    def put(self, doc: int, ids: np.ndarray, start: int) -> int:
        """Place what fits of ``ids[start:]``; returns where it was cut."""
        take = min(self.window - self.offset, len(ids) - start)
        piece = ids[start : start + take]
        self.rows.append((doc, start, take, zlib.crc32(piece.astype("<u4").tobytes()), len(ids), self.sequence, self.offset))
        self.offset += take
        if self.offset == self.window:
            self.sequence, self.offset = self.sequence + 1, 0
        return start + take

    def shard(self, names: list[int], docs: list[np.ndarray], stats: Statistics) -> None:
        index = Shard(docs, stats)
        unused = np.ones(len(docs), bool)
        next_, ranked = 0, iter(())
        while True:
            # the seed's neighbours fill its window; then a new seed, in shard order
            doc = next((d for d in ranked if unused[d]), None) if self.offset else None
            seed = doc is None
            if seed:
                while next_ < len(docs) and not unused[next_]:
                    next_ += 1
                if next_ == len(docs):
                    return
                doc = next_
            unused[doc] = False
            at, sequence = 0, self.sequence
            while at < len(docs[doc]):
                at = self.put(names[doc], docs[doc], at)
            if seed or self.sequence != sequence:  # it opened the window, or its rest did
                ranked = index.neighbours(doc, unused) if self.offset else iter(())


def packed(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, window: int = WINDOW,
) -> DataFrame:
    """Pieces ``(id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset)``.

    ``tokenizer`` is a tokenizers file whose pre-tokenizer drops white space and whose ids fit
    16 bits. A document is its ids and then ``end_id``; a null text has only that. Each id lies
    in exactly one piece, ``start`` counts the ids before it, ``offset`` is gapless in a
    sequence. Documents with equal ids are packed like different ones; ids of documents are
    not null. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    arrow_limits(spark)
    written = settle(tokenized(docs, id_col, text_col, tokenizer, end_id), "tokens")
    tokens = written.filter("seen is null")
    n, total = tokens.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = document_frequencies(written.filter("seen is not null").select("seen"))
    stats = Statistics(n, total / max(n, 1), np.log1p((n - df + 0.5) / (df + 0.5)))
    def pack(batches):
        packer, names, held, size = _Packer(TaskContext.get().partitionId(), window), [], [], 0

        def flush():
            out, packer.rows = packer.rows, []
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else [[]] * 7)],
                                              ["id", "start", "length", "crc", "total", "sequence", "offset"])

        for batch in batches:
            for name, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                names.append(name)
                held.append(np.frombuffer(x.as_py(), "<u2"))
                size += len(held[-1])
                if size >= SHARD_TOKENS:
                    packer.shard(names, held, stats)
                    names, held, size = [], [], 0
                    yield flush()
        if held:
            packer.shard(names, held, stats)
            yield flush()

    parts = max(1, math.ceil(total / PARTITION_TOKENS))
    laid = tokens.repartitionByRange(parts, "lead", "id").sortWithinPartitions("lead", "id")
    rows = laid.select("id", "ids").mapInArrow(pack, "id long, start long, length long, crc long, total long, sequence long, offset long")
    return rows.toDF(id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
