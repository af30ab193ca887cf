"""Evaluation passages inside a training corpus.

Method: pigeonhole edit matching. A passage is any ``run`` letters in a row of an item (all of it, if it is shorter). Items
are split into pieces so short that a passage holds one more of them than the error budget: an occurrence within the
budget leaves at least one piece unchanged. Pieces are found by one automaton for all items, and around each hit the
passage is placed and verified with Myers' bit-parallel edit distance, which must not exceed the budget.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Items are searched for in blocks of at most this many characters (each block in one pass over the documents), so that
#: the broadcast pieces and the automaton have a bound.
BLOCK_CHARS = 20_000_000

#: Items of fewer letters are too short to be recognised and aren't searched for; ``searched`` in the report says so.
LEAST_LETTERS = 30

_REST = re.compile(r"[\W_]+")
_ASCII_REST = bytes(c for c in range(128) if not chr(c).isalnum())


def letters(text: str) -> str:
    """The letters and digits of ``text`` after NFKD and lower-casing."""
    if text.isascii():
        return text.lower().encode().translate(None, _ASCII_REST).decode()
    return _REST.sub("", unicodedata.normalize("NFKD", text).lower())


def myers(pattern: str, text: str) -> int:
    """Least edit distance between ``pattern`` and any substring of ``text`` (Myers 1999, one bit per pattern letter)."""
    m = len(pattern)
    if not m:
        return 0
    peq: dict[str, int] = {}
    for i, ch in enumerate(pattern):
        peq[ch] = peq.get(ch, 0) | 1 << i
    mask, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = mask, 0, m, m
    for ch in text:
        eq = peq.get(ch, 0)
        xh = (((eq & pv) + pv) ^ pv) | eq | mv
        ph = mv | ~(xh | pv) & mask
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = ph << 1 & mask, mh << 1 & mask
        # the text may be entered at any place, so no error comes in from the left
        xv = eq | mv
        pv, mv = mh | ~(xv | ph) & mask, ph & xv
        best = min(best, score)
    return best


def piece_size(length: int, run: int, budget: int) -> int:
    """Letters of a piece: any passage of an item of ``length`` letters holds budget + 1 whole pieces."""
    return (min(run, length) + 1) // (budget + 2)


def pieces_of(text: str, size: int) -> list[tuple[int, str]]:
    """The consecutive pieces of ``size`` letters with their places; a shorter rest belongs to no piece."""
    return [(o, text[o : o + size]) for o in range(0, len(text) - size + 1, size)]


def reach(item: str, doc: str, i: int, d: int, step: int, edits: int) -> int:
    """Letters of ``item`` from ``i`` on (backwards if ``step`` is -1) that agree with ``doc`` from ``d`` on within ``edits``."""
    n = 0
    while 0 <= i + n * step < len(item) and 0 <= d + n * step < len(doc) and item[i + n * step] == doc[d + n * step]:
        n += 1
    if not edits or not 0 <= i + n * step < len(item):
        return n
    i, d = i + n * step, d + n * step
    other = reach(item, doc, i + step, d + step, step, edits - 1) + 1  # another letter
    more = reach(item, doc, i, d + step, step, edits - 1)  # a letter too many
    less = reach(item, doc, i + step, d, step, edits - 1) + 1  # a letter missing
    return n + max(other, more, less)


def exact_run(doc: str, item: str, at: int, o: int) -> int:
    """Letters in which both agree around ``doc[at] == item[o]``, without a gap."""
    a = b = 0
    while at - a > 0 and o - a > 0 and doc[at - a - 1] == item[o - a - 1]:
        a += 1
    while at + b < len(doc) and o + b < len(item) and doc[at + b] == item[o + b]:
        b += 1
    return a + b


class Finder:
    """Searches documents for a block of items; built once in each Python worker."""

    def __init__(self, items: list[tuple[int, str]], run: int, budget: int) -> None:
        import ahocorasick

        self.run, self.budget = run, budget
        self.items = dict(items)
        self.where: dict[str, list[tuple[int, int]]] = {}
        for i, text in self.items.items():
            if len(text) >= LEAST_LETTERS:
                for o, piece in pieces_of(text, piece_size(len(text), run, budget)):
                    self.where.setdefault(piece, []).append((i, o))
        self.automaton = ahocorasick.Automaton()
        for piece in self.where:
            self.automaton.add_word(piece, piece)
        if self.where:
            self.automaton.make_automaton()

    def passage(self, item: str, doc: str, o: int, at: int, size: int) -> tuple[int, int, int]:
        """(start, letters, distance) of the longest passage of ``item`` around a piece at ``o`` that stands around
        ``doc[at]`` within the budget; the distance is Myers' and exceeds the budget if there is no such passage."""
        best = (0, 0, self.budget + 1)
        for left in range(self.budget + 1):
            a = reach(item, doc, o - 1, at - 1, -1, left)
            b = reach(item, doc, o + size, at + size, 1, self.budget - left)
            if a + size + b > best[1]:
                window, spare = item[o - a : o + size + b], self.budget
                distance = myers(window, doc[max(0, at - a - spare) : at + size + b + spare])
                if distance <= self.budget:
                    best = (o - a, a + size + b, distance)
        return best

    def __call__(self, doc: str) -> list[tuple[int, int, int, int]]:
        """(item, longest exact run, letters of the longest passage within the budget, its distance) of each item of which
        ``doc`` holds a passage."""
        if not self.where:
            return []
        seen: dict[tuple[int, int], int] = {}
        best: dict[int, tuple[int, int, int]] = {}
        for end, piece in self.automaton.iter(doc):
            size = len(piece)
            at = end - size + 1
            for i, o in self.where[piece]:
                if seen.get((i, at - o), -1) >= at:  # inside a run that has been followed already
                    continue
                item = self.items[i]
                n = exact_run(doc, item, at, o)
                seen[i, at - o] = at + reach(item, doc, o, at, 1, 0) - 1
                _, letters_, distance = self.passage(item, doc, o, at, size)
                if distance > self.budget or letters_ < min(self.run, len(item)):
                    continue
                old = best.get(i, (0, 0, 0))
                best[i] = (max(old[0], n), *max((old[1], old[2]), (letters_, distance), key=lambda x: (x[0], -x[1])))
        return [(i, *found) for i, found in best.items()]


_finders: dict[str, Finder] = {}


def leaks(docs: DataFrame, items: DataFrame, doc_id: str, doc_text: str, item_id: str, item_text: str, run: int = 70, budget: int = 1) -> DataFrame:
    """Documents that hold a passage of an item within the error budget: ``item_id, doc_id, run, passage, distance``.

    ``passage`` is the number of letters of the longest such passage, ``distance`` its edit distance (0 to ``budget``),
    ``run`` the longest stretch around a shared piece in which document and item agree exactly. Every pair that shares
    ``run`` letters in a row is in the result, with a ``run`` of so many at least; so is every pair in which a passage of so
    many letters differs by up to ``budget`` letters changed, missing or too many.

    Texts count whole. Items of fewer than ``run`` letters are searched for as a whole, those under LEAST_LETTERS not at
    all. Null and empty texts give no rows. Repeated rows give one row per pair of ids; the ids may be of any integer type.
    Other columns don't matter. Empty tables give no rows.
    """
    if budget < 0 or piece_size(min(run, LEAST_LETTERS), run, budget) < 4:
        raise ValueError("the pieces of a budget this large are too short to be searched for")
    spark = docs.sparkSession
    wanted = items.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).alias("t")).where(F.length("t") > 0)
    chars = wanted.agg(F.sum(F.length("t"))).first()[0] or 0
    blocks = max(1, -(-chars // BLOCK_CHARS))
    src = docs.select(F.col(doc_id).cast("long").alias("d"), F.col(doc_text).alias("x")).where(F.length("x") > 0)
    out = None
    for b in range(blocks):
        block = wanted.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == b)
        shipped = spark.sparkContext.broadcast([(r.i, letters(r.t)) for r in block.distinct().toLocalIterator()])
        key = uuid.uuid4().hex

        def search(batches: Iterator[pd.DataFrame], shipped=shipped, key=key) -> Iterator[pd.DataFrame]:
            if key not in _finders:
                _finders.clear()
                _finders[key] = Finder(shipped.value, run, budget)
            find = _finders[key]
            for batch in batches:
                rows = [(i, d, *found) for d, x in zip(batch["d"], batch["x"]) for i, *found in find(letters(x))]
                yield pd.DataFrame(rows, columns=["item_id", "doc_id", "run", "passage", "distance"])

        part = src.mapInPandas(search, "item_id long, doc_id long, run long, passage long, distance long")
        out = part if out is None else out.unionByName(part)
    return out.groupBy("item_id", "doc_id").agg(F.max("run").alias("run"), F.max("passage").alias("passage"), F.min_by("distance", F.struct(-F.col("passage"), "distance")).alias("distance"))


@F.pandas_udf(T.LongType())
def _letters_of(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: len(letters(t or ""))).astype("int64")


def report(found: DataFrame, items: DataFrame, item_id: str, item_text: str, run: int = 70) -> DataFrame:
    """Per item: ``item_id, letters, searched, documents, near_documents, longest_run, longest_passage``: in how many
    documents it leaked with ``run`` letters in a row, in how many more within the budget only, and how much of it at most.
    Items without a leak count 0; ``searched`` is false for those too short to be searched for."""
    n = found.groupBy("item_id").agg(F.count_if(F.col("run") >= run).alias("documents"), F.count_if(F.col("run") < run).alias("near_documents"), F.max("run").alias("longest_run"), F.max("passage").alias("longest_passage"))
    own = items.groupBy(F.col(item_id).cast("long").alias("item_id")).agg(F.max(_letters_of(F.col(item_text))).alias("letters"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return own.join(n, "item_id", "left").select("item_id", "letters", (F.col("letters") >= LEAST_LETTERS).alias("searched"), *[zero(c) for c in ("documents", "near_documents", "longest_run", "longest_passage")])
