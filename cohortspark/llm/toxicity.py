"""Toxicity by class-conditional Kneser-Ney models of word spelling.

Two interpolated Kneser-Ney models, toxic and ordinary, spell words byte by byte in 6-grams.
Only the highest order is counted per class; the lower orders are continuation counts shared
by both, so a rare expression is judged by the spelling it shares with known ones and not by
its rarity. A text is compared word by word: ``log(1 - e + e * toxic / ordinary)`` is the
likelihood ratio of a text in which a small part ``e`` of the words is toxic. Its
length-normalised sums go through a logistic calibration.

Where a class has not seen a 6-gram, its probability is the shared one times the weight of
the context, and the shared one cancels in the ratio. So the model is two tables: a log
ratio per seen 6-gram and one per context. Both are hash tables of fixed size, in which the
weightier entry of a slot wins.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.llm.textops import U64, Words, arrow_limits, blocks, column_bytes, mix
from cohortspark.sources.stored import lifetime, settle

FOLDS, HELD_OUT, CALIBRATION = 5, 0, 1
ORDER = 6
SLOT_BITS = 21  # slots of each table
DISCOUNT = 0.75
SHARE = 0.02  # expected part of toxic words in a toxic text
TRAIN_ROWS = 200_000  # labelled rows at most (a hash sample beyond): the bound of the broadcast


def fold(doc_id: str | Column) -> Column:
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(FOLDS)).cast("int")


def _lower(data: np.ndarray) -> np.ndarray:
    """A-Z and the two-byte Latin capitals in lower case."""
    out = np.where((data >= 65) & (data <= 90), data | 32, data)
    if len(data) > 1:
        accented = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
        out[1:][accented] |= 0x20
    return out


def _types(texts: pa.Array):
    """Per block: (first row, rows, words, index of the spelling of each word, grams, bounds).

    ``grams`` are the 6-grams of each distinct spelling, ``bounds`` where each begins.
    """
    data, offsets = column_bytes(texts)
    for lo, hi in blocks(offsets):
        at = offsets[lo : hi + 1]
        words = Words(_lower(data[at[0] : at[-1]]), at - at[0])
        _, sample, which = np.unique(words.hashes(), return_index=True, return_inverse=True)
        starts, size = words.starts[sample], words.ends[sample] - words.starts[sample]
        # each spelling: five begin marks, its bytes, an end mark
        bounds = np.concatenate([[0], np.cumsum(size + ORDER)])
        flat = np.full(bounds[-1], 2, U64)
        inner = np.repeat(bounds[:-1] + ORDER - 1 - np.concatenate([[0], np.cumsum(size)[:-1]]) if len(size) else size, size) + np.arange(size.sum())
        flat[inner] = words.data[np.repeat(starts - np.concatenate([[0], np.cumsum(size)[:-1]]) if len(size) else size, size) + np.arange(size.sum())]
        flat[bounds[1:] - 1] = 3
        gram = flat.copy()
        for j in range(1, ORDER):
            gram[j:] |= flat[:-j] << U64(8 * j)
        real = np.ones(len(flat), bool)
        real[(bounds[:-1][:, None] + np.arange(ORDER - 1)).reshape(-1)] = False
        steps = np.concatenate([[0], np.cumsum(size + 1)])
        yield lo, hi, words, which, gram[real], steps


def _counts(labelled: DataFrame) -> DataFrame:
    """(text, toxic) to (g, t, o): 6-grams with their counts in toxic and ordinary texts."""

    def run(batches):
        for batch in batches:
            toxic = batch.column(1).to_numpy(zero_copy_only=False)
            for lo, _, words, which, gram, steps in _types(batch.column(0)):
                label = np.repeat(toxic[lo : lo + len(words.first) - 1], np.diff(words.first))
                n = len(steps) - 1
                each = [np.bincount(which[label == c], minlength=n) for c in (1, 0)]
                grams, at = np.unique(gram, return_inverse=True)
                size = np.diff(steps)
                t, o = (np.bincount(at, np.repeat(e, size), minlength=len(grams)).astype(np.int64) for e in each)
                yield pa.RecordBatch.from_arrays([pa.array(grams.astype(np.int64)), pa.array(t), pa.array(o)], ["g", "t", "o"])

    rows = labelled.select("text", "toxic").mapInArrow(run, "g long, t long, o long")
    return rows.groupBy("g").agg(F.sum("t").alias("t"), F.sum("o").alias("o"))


def _suffix(n: int) -> Column:
    return F.col("g").bitwiseAND(F.lit((1 << (8 * n)) - 1))


def _ratios(grams: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Log ratios (key, value, weight) of seen 6-grams and of contexts.

    Every order is written before the next one reads it: one plan over all orders would hold
    dozens of shuffles at once on the driver.
    """
    below = {ORDER: grams.select("g")}
    for n in range(ORDER - 1, 0, -1):  # continuations: distinct left extensions
        below[n] = settle(below[n + 1].groupBy(_suffix(n).alias("g")).agg(F.count("*").alias("k")), "continuations")
    total = below[1].agg(F.sum("k").alias("all"))
    p = below[1].join(F.broadcast(total)).select("g", (F.col("k") / F.col("all")).alias("p"))  # 256 rows at most
    for n in range(2, ORDER):
        rows = below[n].withColumn("h", F.shiftright("g", 8)).withColumn("s", _suffix(n - 1))
        context = rows.groupBy("h").agg(F.sum("k").alias("all"), F.count("*").alias("kinds"))
        p = settle(rows.join(context, "h").join(p.withColumnRenamed("g", "s"), "s")
                   .select("g", ((F.greatest(F.col("k") - DISCOUNT, F.lit(0.0)) + DISCOUNT * F.col("kinds") * F.col("p")) / F.col("all")).alias("p")), "backoff")
    rows = grams.withColumn("h", F.shiftright("g", 8)).withColumn("s", _suffix(ORDER - 1))
    context = rows.groupBy("h").agg(*[x for c in "to" for x in (F.sum(c).alias(f"all_{c}"), F.sum((F.col(c) > 0).cast("long")).alias(f"kinds_{c}"))])

    def seen(c: str) -> Column:
        raised = (F.greatest(F.col(c) - DISCOUNT, F.lit(0.0)) + DISCOUNT * F.col(f"kinds_{c}") * F.col("p")) / F.col(f"all_{c}")
        return F.when(F.col(f"all_{c}") > 0, raised).otherwise(F.col("p"))

    def left(c: str) -> Column:
        return F.when(F.col(f"all_{c}") > 0, DISCOUNT * F.col(f"kinds_{c}") / F.col(f"all_{c}")).otherwise(1.0)

    known = (rows.join(context, "h").join(p.withColumnRenamed("g", "s"), "s")
             .select(F.col("g").alias("key"), F.log(seen("t") / seen("o")).alias("value"), (F.col("t") + F.col("o")).alias("weight")))
    backed = context.select(F.col("h").alias("key"), F.log(left("t") / left("o")).alias("value"), (F.col("all_t") + F.col("all_o")).alias("weight"))
    return known, backed


def _slot(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slot and check value (never 0) of each key."""
    h = mix(keys.astype(U64), 9)
    return (h & U64((1 << SLOT_BITS) - 1)).astype(np.int64), ((h >> U64(48)) | U64(1)).astype(np.uint16)


def _table(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Rows (key, value, weight) as arrays of check values and log ratios, one per slot."""

    def run(batches):
        for batch in batches:
            slot, check = _slot(batch.column(0).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(check.astype(np.int32)), *batch.columns], ["slot", "check", "key", "value", "weight"])

    filed = rows.mapInArrow(run, "slot long, check int, key long, value double, weight long")
    best = filed.groupBy("slot").agg(F.max(F.struct(F.abs(F.col("value")) * F.col("weight"), "key", "check", "value")).alias("b"))
    found = best.select("slot", "b.check", F.col("b.value").cast("float").alias("value")).toArrow()
    check, value = np.zeros(1 << SLOT_BITS, np.uint16), np.zeros(1 << SLOT_BITS, np.float32)
    at = found["slot"].to_numpy()
    check[at], value[at] = found["check"].to_numpy().astype(np.uint16), found["value"].to_numpy()
    return check, value


def _evidence(texts: pa.Array, model) -> tuple[np.ndarray, np.ndarray]:
    """Per text: the summed word evidence and the number of words."""
    (gram_check, gram_value), (context_check, context_value) = model
    total, size = [], []
    for _, _, words, which, gram, steps in _types(texts):
        slot, check = _slot(gram)
        known = gram_check[slot] == check
        ratio = np.where(known, gram_value[slot], np.float32(0)).astype(np.float64)
        rest = np.flatnonzero(~known)
        slot, check = _slot(gram[rest] >> U64(8))
        ratio[rest] = np.where(context_check[slot] == check, context_value[slot], np.float32(0))
        word = np.add.reduceat(ratio, steps[:-1]) if len(steps) > 1 else np.zeros(0)
        each = np.log1p(SHARE * np.expm1(np.clip(word, -40, 40)))[which]
        sums = np.concatenate([[0.0], np.cumsum(each)])
        total.append(sums[words.first[1:]] - sums[words.first[:-1]])
        size.append(np.diff(words.first))
    return (np.concatenate(total), np.concatenate(size)) if total else (np.zeros(0), np.zeros(0, np.int64))


def _features(total: np.ndarray, size: np.ndarray) -> np.ndarray:
    n = np.maximum(size, 1)
    return np.stack([np.ones(len(n)), total / np.sqrt(n), 20 * total / n], axis=1)


def _fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic weights with a light ridge, by Newton steps until they settle.

    Both classes weigh the same, so that 0.5 is the balanced cut however rare toxic texts are.
    """
    w = np.zeros(x.shape[1])
    share = np.where(y > 0, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    ridge = np.diag([1e-3, 1e-2, 1e-2])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        step = np.linalg.solve((x.T * (share * p * (1 - p))) @ x + ridge, x.T @ (share * (y - p)) - ridge @ w)
        w += step * min(1.0, 4 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-9:
            return w
    raise RuntimeError("calibration did not converge")


def scored(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    train_rows: int = TRAIN_ROWS, score_col: str = "score",
) -> DataFrame:
    """``docs`` with a toxicity between 0 and 1; all its rows and columns stay.

    Labels count outside the held-out fold (crc32 of the id as text, modulo 5); null labels
    are left out, contradicting ones take the higher. At most ``train_rows`` labelled rows
    are used, the first by hash. A null text scores as an empty one. Without labels of both
    classes every text gets the smoothed share of toxic labels. ``score_col`` must not be a
    column of ``docs``. A row without an id is scored like any other.
    """
    if score_col in docs.columns:
        raise ValueError(f"rename column {score_col}")
    spark = docs.sparkSession
    arrow_limits(spark)
    marks = (labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id"))
             .agg((F.max(label_col) > 0).cast("int").alias("toxic")).withColumn("fold", fold("id")).filter(F.col("fold") != HELD_OUT)
             .orderBy(F.xxhash64("id"), "id").limit(train_rows))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    with lifetime(spark):  # the model is broadcast: its tables go
        labelled = texts.join(F.broadcast(settle(marks, "marks")), "id").select("text", "toxic", "fold")
        grams = settle(_counts(labelled.filter(F.col("fold") != CALIBRATION)), "grams")
        known, backed = _ratios(grams)
        model = spark.sparkContext.broadcast((_table(known), _table(backed)))

        def measure(batches):
            for batch in batches:
                total, size = _evidence(batch.column(0), model.value)
                yield pa.RecordBatch.from_arrays([pa.array(total), pa.array(size.astype(np.int64)), batch.column(1)], ["total", "size", "toxic"])

        seen = labelled.filter(F.col("fold") == CALIBRATION).select("text", "toxic").mapInArrow(measure, "total double, size long, toxic int").toArrow()
        y = seen["toxic"].to_numpy().astype(float)
        sums = grams.agg(F.sum("t"), F.sum("o")).first()
        if 0 < y.sum() < len(y) and sums[0] and sums[1]:
            weights = _fit(_features(seen["total"].to_numpy(), seen["size"].to_numpy()), y)
        else:
            weights = np.array([np.log((y.sum() + 1) / (len(y) - y.sum() + 1)), 0.0, 0.0])
    at = docs.columns.index(text_col)

    def score(batches):
        for batch in batches:
            text = batch.column(at)
            total, size = _evidence(text if pa.types.is_string(text.type) else text.cast(pa.string()), model.value)
            p = 1 / (1 + np.exp(-np.clip(_features(total, size) @ weights, -35, 35)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p)], [*batch.schema.names, score_col])

    fields = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(score, f"{fields}, `{score_col}` double")


def rated(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, held_out, score, predicted)``, one row per document."""
    rows = scored(docs.select(F.col(id_col), F.col(text_col)), labels, id_col, text_col, score_col="score")
    return rows.select(id_col, F.coalesce(fold(id_col) == HELD_OUT, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
