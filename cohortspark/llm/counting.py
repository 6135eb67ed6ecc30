"""Edit-aware token counts.

A tokenizer first cuts a text into pre-tokens and encodes each on its own. A document's
pre-tokens are grouped into leaves of a segment tree that holds characters and tokens of every
subtree. An edit finds its leaf by descending on characters; encoding restarts at that leaf's
boundary (that of the second character before the edit, since a run of white space looks that
far ahead), and ends at the first old leaf boundary behind the edit at which the new pre-tokens are cut as
well, since from there on both texts are cut alike. Only those leaves are encoded again, and
only their ancestors' sums change.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.llm.textops import arrow_limits

LEAF = 32  # pre-tokens
REMEMBERED = 300_000


class Counter:
    """Tokens of a pre-token, with a bounded memory."""

    def __init__(self, ranks: str, pattern: str):
        import regex
        import tiktoken

        with open(ranks, "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encode = tiktoken.Encoding("counts", pat_str=pattern, mergeable_ranks=table, special_tokens={}).encode_ordinary
        self.cut = regex.compile(pattern)
        self.known: dict[str, int] = {}

    def counts(self, pieces: list[str]) -> list[int]:
        known, out = self.known, []
        if len(known) > REMEMBERED:
            known.clear()
        for p in pieces:
            n = known.get(p)
            if n is None:
                n = known[p] = len(self.encode(p))
            out.append(n)
        return out


@lru_cache(maxsize=2)
def counter(ranks: str, pattern: str) -> Counter:
    return Counter(ranks, pattern)


class Tree:
    """Segment tree of (characters, tokens) over the leaves of one text."""

    def __init__(self, chars: list[int], tokens: list[int]):
        self.leaves = max(1, len(chars))
        self.width = 1 << (self.leaves - 1).bit_length()
        pad = [0] * (self.width - len(chars))
        self.chars, self.tokens = [0] * self.width + chars + pad, [0] * self.width + tokens + pad
        for i in range(self.width - 1, 0, -1):
            self._sum(i)

    def _sum(self, i: int) -> None:
        self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
        self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    @classmethod
    def of(cls, text: str, c: Counter, leaf: int = LEAF) -> Tree:
        pieces = c.cut.findall(text)
        counts = c.counts(pieces)
        starts = range(0, len(pieces), leaf)
        return cls([sum(map(len, pieces[i : i + leaf])) for i in starts], [sum(counts[i : i + leaf]) for i in starts])

    @property
    def total(self) -> int:
        return self.tokens[1]

    def stored(self) -> tuple[list[int], list[int]]:
        """The leaves that hold text; :class:`Tree` builds the same sums from them."""
        kept = [i for i in range(self.width, 2 * self.width) if self.chars[i]]
        return [self.chars[i] for i in kept], [self.tokens[i] for i in kept]

    def find(self, at: int) -> tuple[int, int]:
        """The leaf that holds character ``at`` (the last one that holds text, at the end) and where it begins."""
        i, start = 1, 0
        while i < self.width:
            i *= 2
            if at >= start + self.chars[i] and self.chars[i + 1]:
                start += self.chars[i]
                i += 1
        return i, start

    def put(self, leaf: int, chars: int, tokens: int) -> None:
        self.chars[leaf], self.tokens[leaf] = chars, tokens
        while leaf > 1:
            leaf //= 2
            self._sum(leaf)

    def edit(self, text: str, at: int, cut: int, insert: str, c: Counter) -> tuple[str, int]:
        """Replace ``cut`` characters at ``at``; returns the new text and the characters encoded again.

        Positions outside the text are clamped.
        """
        at = min(max(at, 0), len(text))
        cut = min(max(cut, 0), len(text) - at)
        new = text[:at] + insert + text[at + cut :]
        first, begin = self.find(max(at - 2, 0))
        moved = len(insert) - cut
        last, end = first, begin + self.chars[first]  # old boundary behind the edit
        while end < at + cut and last + 1 < 2 * self.width:
            last += 1
            end += self.chars[last]
        pieces: list[str] = []
        place = begin
        for m in c.cut.finditer(new, begin):
            while end + moved < m.start() and last + 1 < 2 * self.width:
                last += 1
                end += self.chars[last]
            if m.start() == end + moved and m.start() >= at + len(insert) and m.start() > begin:
                break
            pieces.append(m.group())
            place = m.end()
        else:
            last = 2 * self.width - 1
        self.put(first, place - begin, sum(c.counts(pieces)))
        for leaf in range(first + 1, last + 1):
            if self.chars[leaf]:
                self.put(leaf, 0, 0)
        return new, place - begin


def edited_counts(
    docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", edits_col: str = "edits",
) -> DataFrame:
    """``(id_col, n_tokens, edited_tokens, n_edits, encoded_chars, edited_text, leaf_chars, leaf_tokens)``.

    ``edits_col`` is an array of ``(at, cut, put)``: at character ``at`` of the text so far,
    ``cut`` characters go and ``put`` comes; a null array, and nulls inside, mean no edit, 0
    and the empty string. ``ranks`` is a tiktoken file, ``pattern`` its pre-token pattern.
    The leaves are the edited document's tree, as :class:`Tree` takes them. A null text is
    empty. Other columns are ignored, repeated rows are counted alike.
    """
    arrow_limits(docs.sparkSession)

    def run(batches):
        c = counter(ranks, pattern)
        for batch in batches:
            out = []
            for text, edits in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                text = text or ""
                tree = Tree.of(text, c)
                before, encoded = tree.total, 0
                for e in edits or ():
                    if e is not None:
                        text, n = tree.edit(text, e["at"] or 0, e["cut"] or 0, e["put"] or "", c)
                        encoded += n
                out.append((before, tree.total, len(edits or ()), encoded, text, *tree.stored()))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()))
            columns = zip(*out) if out else [[]] * 7
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x, k) for x, k in zip(columns, kinds)]],
                                             ["id", "n_tokens", "edited_tokens", "n_edits", "encoded_chars", "edited_text", "leaf_chars", "leaf_tokens"])

    edits = F.transform(edits_col, lambda e: F.struct(e["at"].cast("long").alias("at"), e["cut"].cast("long").alias("cut"), e["put"].cast("string").alias("put")))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), edits.alias("edits"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n_tokens long, edited_tokens long, n_edits long, encoded_chars long, edited_text string, "
                                "leaf_chars array<int>, leaf_tokens array<int>").withColumnRenamed("id", id_col)


def with_edits(docs: DataFrame, edits: DataFrame, id_col: str = "doc_id", order_col: str = "seq") -> DataFrame:
    """``docs`` with the rows ``(id_col, order_col, at, cut, put)`` of an edit log as an array, in order."""
    per = edits.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct(order_col, "at", "cut", "put"))).alias("edits"))
    return docs.join(per, id_col, "left")


def sample_edits(id_col: str = "doc_id", text_col: str = "text", n: int = 3) -> Iterable:
    """A column of edits derived from the document: words of its own moved to places chosen by hash."""
    size = F.length(F.coalesce(F.col(text_col), F.lit("")))
    place = lambda k, of: F.pmod(F.xxhash64(F.col(id_col), F.lit(k)), of)
    return F.array(*[
        F.struct(place(3 * k, size + 1).alias("at"), place(3 * k + 1, F.lit(24)).alias("cut"),
                 F.substring(F.col(text_col), (place(3 * k + 2, size + 1) + 1).cast("int"), F.lit(5 + 9 * k)).alias("put"))
        for k in range(n)])


def whole_count(text: str, ranks: str, pattern: str) -> int:
    """Tokens of a text encoded as a whole."""
    return len(counter(ranks, pattern).encode(text))


def encoded_pieces(pieces: Iterable[str], ranks: str, pattern: str) -> list[int]:
    return counter(ranks, pattern).counts(list(pieces))
