"""Joins beyond equality: precedence, fallback keys, intervals, as-of, fuzzy best match, suffixes."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

from quillspark.functions.urls import host, suffixes
from quillspark.session import broadcast_if_small, cut, ship


def merge_by_precedence(frames: Sequence[tuple[str, DataFrame]], key: str, columns: Sequence[str]) -> DataFrame:
    """Full outer merge: the first source with a non-null value wins, and ``<column>_from`` names it (D01, D17). Each
    frame has one row per key; missing columns count as null."""
    out = None
    for name, df in frames:
        part = df.select(F.col(key), *[(F.col(c) if c in df.columns else F.lit(None).cast("string")).alias(f"{c}__{name}") for c in columns])
        out = part if out is None else out.join(part, key, "full_outer")
    picks = [x for c in columns for x in (F.coalesce(*[F.col(f"{c}__{n}") for n, _ in frames]).alias(c), F.coalesce(*[F.when(F.col(f"{c}__{n}").isNotNull(), F.lit(n)) for n, _ in frames]).alias(f"{c}_from"))]
    return out.select(key, *picks)


def join_with_fallback(left: DataFrame, right: DataFrame, keys: Sequence[Sequence[str]], values: Sequence[str]) -> DataFrame:
    """Left join on the first key set that finds anything (D02, D03): adds ``values``, ``matched_on`` (0 for the first key
    set; null without match) and ``ambiguous`` (several rows matched; the least row is taken)."""
    out = left
    for i, on in enumerate(keys):
        side = right.groupBy(*on).agg(F.min(F.struct(*values)).alias(f"v{i}"), F.count(F.lit(1)).alias(f"n{i}")).where(reduce(lambda a, c: a & F.col(c).isNotNull(), on, F.lit(True)))
        out = out.join(side, list(on), "left")
    chosen = F.coalesce(*[F.when(F.col(f"n{i}").isNotNull(), F.struct(F.lit(i).alias("matched_on"), (F.col(f"n{i}") > 1).alias("ambiguous"), F.col(f"v{i}").alias("v"))) for i in range(len(keys))])
    return out.withColumn("m_", chosen).select(*left.columns, *[F.col(f"m_.v.{v}").alias(v) for v in values], "m_.matched_on", "m_.ambiguous")


def as_of(left: DataFrame, right: DataFrame, by: Sequence[str], left_at: str, right_at: str, values: Sequence[str]) -> DataFrame:
    """For each left row the values of the last right row at or before it (D14, D15). One sort of the union by key and
    time instead of a range join; of right rows at one time the greatest wins."""
    l = left.select(*by, F.col(left_at).alias("at_"), F.lit(1).alias("side_"), F.struct(*left.columns).alias("l_"), F.lit(None).cast(_struct(right, values)).alias("r_"))  # noqa: E741
    r = right.select(*by, F.col(right_at).alias("at_"), F.lit(0).alias("side_"), F.lit(None).cast(_struct(left, left.columns)).alias("l_"), F.struct(*values).alias("r_"))
    w = Window.partitionBy(*by).orderBy("at_", "side_", "r_").rowsBetween(Window.unboundedPreceding, 0)
    both = l.unionByName(r).withColumn("r_", F.last("r_", ignorenulls=True).over(w)).where("side_ = 1")
    return both.select("l_.*", *[F.col(f"r_.{v}").alias(v) for v in values])


def _struct(df: DataFrame, columns: Sequence[str]) -> str:
    return "struct<" + ",".join(f"`{c}`:{df.schema[c].dataType.simpleString()}" for c in columns) + ">"


def within(points: DataFrame, spans: DataFrame, by: Sequence[str], at: str, start: str, end: str, cell: int, slack: int = 0) -> DataFrame:
    """Pairs of a point and a span [start - slack, end + slack) that holds it (D10, D13). Spans are cut into cells of
    ``cell`` units, so the join is one of equality; null places match nothing."""
    p = points.where(F.col(at).isNotNull()).withColumn("cell_", F.floor(F.col(at) / cell))
    lo, hi = F.col(start) - slack, F.col(end) + slack
    s = spans.where(hi > lo).withColumn("cell_", F.explode(F.sequence(F.floor(lo / cell), F.floor((hi - 1) / cell))))
    return p.join(s, [*by, "cell_"]).where((F.col(at) >= lo) & (F.col(at) < hi)).drop("cell_")


def best_match(left: DataFrame, right: DataFrame, by: Sequence[str], score: Column, least: float, left_id: str, right_id: str) -> DataFrame:
    """The best right row of each left row within a cell, if its score is high enough (D06, D11, D21): ``left_id,
    right_id, score``. Cells are small by their nature (a group's names); ties go to the lower right_id."""
    pairs = left.join(right, list(by)).select(left_id, right_id, score.alias("score")).where(F.col("score") >= least)
    return pairs.groupBy(left_id).agg(F.max_by(F.struct(right_id, "score"), F.struct("score", -F.col(right_id))).alias("m")).select(left_id, "m.*")


def longest_suffix(df: DataFrame, url: str, rules: DataFrame, suffix: str, value: str, default: str) -> DataFrame:
    """The value of the longest listed host suffix (A16, C20, D25). ``df`` needs no id: the host is looked up, not the row."""
    hosts = df.select(host(F.col(url)).alias("h_")).distinct()
    found = hosts.select("h_", F.explode(suffixes(F.col("h_"))).alias(suffix)).join(rules, suffix)
    best = found.groupBy("h_").agg(F.max_by(value, F.length(suffix)).alias("v_"))
    return df.withColumn("h_", host(F.col(url))).join(best, "h_", "left").withColumn(value, F.coalesce("v_", F.lit(default))).drop("h_", "v_")


def unique_match(left: DataFrame, right: DataFrame, on: Sequence[str], left_id: str, right_id: str) -> DataFrame:
    """Pairs whose left row meets exactly one right row."""
    one = right.groupBy(*on).agg(F.min(right_id).alias(right_id), F.count(F.lit(1)).alias("n_")).where("n_ = 1")
    return left.join(one, list(on)).select(left_id, right_id)


def prefix_pairs(a: DataFrame, b: DataFrame, by: str, left: str, right: str) -> DataFrame:
    """Pairs of rows with the same ``by`` (null is a value) where ``left`` and ``right`` are prefixes of each other, either way
    (O07). Every prefix of one side is looked up in the other, so both directions are joins of equality, for words of any
    length and scripts without blanks. But for ``by`` the sides share no column; empty strings match nothing."""
    a, b = a.where(F.length(left) > 0), b.where(F.length(right) > 0).withColumnRenamed(by, "by_")
    prefixes = lambda df, c: df.withColumn("p_", F.explode(F.transform(F.sequence(F.lit(1), F.length(c)), lambda n: F.col(c).substr(F.lit(1), n))))
    same = F.col(by).eqNullSafe(F.col("by_"))
    longer = prefixes(b, right).join(broadcast_if_small(a), same & (F.col("p_") == F.col(left)))
    shorter = prefixes(a, left).join(broadcast_if_small(b), same & (F.col("p_") == F.col(right))).where(F.col(left) != F.col(right))
    return longer.unionByName(shorter).drop("by_", "p_")


#: How many left rows and how many tokens of right sets one task compares at a time; a cell with more is dealt over several.
PART, BLOCK = 8192, 1 << 16
#: A token that more than one in so many sets of a block hold is counted by a product of matrices, a rarer one by its places.
_RARE = 64
#: Numbers in one matrix.
_MOST = 1 << 22


def best_overlap(left: DataFrame, right: DataFrame, on: Sequence[str], tokens: str, left_id: str, right_id: str, least: float) -> DataFrame:
    """For each ``left_id`` the ``right_id`` whose token set has most in common with its own, in share of the smaller set, at
    least ``least`` (D06, D21): ``left_id, right_id, score``; of equals the lower id. Both sides have ``on`` (compared null-safe
    as text), ``tokens`` (distinct) and an id (on the right a number or text); null and empty sets match nothing.

    Exact, and no row per pair or per token leaves a task: equal sets on the right count once, a cell's left rows are dealt
    over parts and its right sets over blocks, and each part meets each block in a task that counts shared tokens. Each left
    row travels once per block, so once where a cell's right sets have at most ``BLOCK`` tokens. Only a row per cell is broadcast."""
    ship(left.sparkSession)
    side = lambda df, i: df.select(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in on]).alias("cell_"), F.col(i).alias("id_"), F.col(tokens).alias("set_"))
    a, b = side(left, left_id), side(right, right_id).where(F.size("set_") > 0)
    b = cut(b.groupBy("cell_", F.array_sort("set_").alias("set_")).agg(F.min("id_").alias("id_")), "right")
    parts = a.groupBy("cell_").agg(F.ceil(F.count(F.lit(1)) / PART).alias("parts_"))
    blocks = b.groupBy("cell_").agg(F.ceil(F.sum(F.size("set_")) / BLOCK).alias("blocks_"))
    cells = broadcast_if_small(cut(parts.join(blocks, "cell_"), "cells"))

    key = ["cell_", "part_", "block_"]
    deal = lambda df, own, n, other, m: df.join(cells, "cell_").withColumn(own, F.pmod(F.xxhash64("id_"), F.col(n))).withColumn(other, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(m) - 1))).select(*key, "id_", "set_").groupBy(*key)
    schema = StructType([StructField("l", a.schema["id_"].dataType), StructField("r", b.schema["id_"].dataType), StructField("score", DoubleType())])
    found = deal(a, "part_", "parts_", "block_", "blocks_").cogroup(deal(b, "block_", "blocks_", "part_", "parts_")).applyInArrow(_best_of_block(least, to_arrow_schema(schema)), schema)
    return found.groupBy("l").agg(F.max("score").alias("score"), F.min_by("r", F.struct((-F.col("score")).alias("s"), F.col("r").alias("i"))).alias("r")).select(F.col("l").alias(left_id), F.col("r").alias(right_id), "score")


def _best_of_block(least: float, schema: pa.Schema) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The best right row of each left row, for a part and a block with ``id_`` and ``set_``."""

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        right = right.take(pc.sort_indices(right["id_"]))  # so of equals the first is the lower id
        a, b = left["set_"].combine_chunks(), right["set_"].combine_chunks()
        size_a, size_b = (pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False).astype(np.int64) for x in (a, b))
        row_a, row_b = np.repeat(np.arange(len(a)), size_a), np.repeat(np.arange(len(b)), size_b)
        coded = b.flatten().dictionary_encode(null_encoding="encode")
        token_b = coded.indices.to_numpy(zero_copy_only=False)
        token_a = pc.fill_null(pc.index_in(a.flatten(), value_set=coded.dictionary), -1).to_numpy(zero_copy_only=False)
        row_a, token_a = row_a[token_a >= 0], token_a[token_a >= 0]
        held = np.bincount(token_b, minlength=len(coded.dictionary))
        common = held * _RARE > len(b)
        column = np.cumsum(common) - 1
        holders, first = row_b[np.argsort(token_b, kind="stable")], np.cumsum(held) - held

        def matrix(rows, tokens, n):
            m = np.zeros((n, int(common.sum())), np.float32)
            m[rows, column[tokens]] = 1
            return m

        dense_b = matrix(row_b[common[token_b]], token_b[common[token_b]], len(b)).T
        out = []
        step = max(1, _MOST // (len(b) + len(dense_b)))
        for at in range(0, len(a), step):
            n_a = size_a[at : at + step]
            lo, hi = np.searchsorted(row_a, (at, at + step))
            rows, tokens = row_a[lo:hi] - at, token_a[lo:hi]
            dense = common[tokens]
            shared = matrix(rows[dense], tokens[dense], len(n_a)) @ dense_b
            rows, tokens = rows[~dense], tokens[~dense]
            n = held[tokens]
            places = np.repeat(first[tokens] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            np.add.at(shared, (np.repeat(rows, n), holders[places]), 1)
            # near enough in single precision, then exactly, rounded half up as SQL does
            smaller = np.minimum(n_a[:, None], size_b[None, :]).astype(np.float32)
            i, j = np.nonzero(shared >= np.maximum(np.float32(least - 1e-5) * smaller - np.float32(1e-3), np.float32(0.5)))
            p, q = shared[i, j].astype(np.int64), np.minimum(n_a[i], size_b[j])
            score = (2_000_000 * p + q) // (2 * q) / 1e6
            i, j, score = i[score >= least], j[score >= least], score[score >= least]
            order = np.lexsort((j, -score, i))
            i, j, score = i[order], j[order], score[order]
            top = np.flatnonzero(np.diff(i, prepend=-1))
            out.append((i[top] + at, j[top], score[top]))
        i, j, score = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.Table.from_arrays([left["id_"].take(pa.array(i)), right["id_"].take(pa.array(j)), pa.array(score)], names=schema.names)

    return best
