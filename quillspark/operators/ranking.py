"""Ranking, selection and ordered state: windows over cells, runs and logs."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.session import broadcast_if_small, cut


#: Rows of a group that a task looks at together where a window slides over it.
STRETCH = 100_000


def ranked(df: DataFrame, by: Sequence[str], order: Sequence[Column], into: str = "rank") -> DataFrame:
    """Rank from 1 within ``by``; ``order`` must end in a unique column."""
    return df.withColumn(into, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def beside(df: DataFrame, stats: DataFrame, by: Sequence[str]) -> DataFrame:
    """``df`` with the other columns of ``stats``, which has one row per ``by``; null keys meet each other."""
    renamed = stats.select(*[F.col(c).alias(f"{c}__") for c in by], *[c for c in stats.columns if c not in by])
    on = reduce(and_, [F.col(c).eqNullSafe(F.col(f"{c}__")) for c in by])
    return df.join(broadcast_if_small(renamed), on, "left").drop(*[f"{c}__" for c in by])


def running(df: DataFrame, by: Sequence[str], order: Sequence[Column], value: Column, into: str) -> DataFrame:
    """The sum of ``value`` from the first row of ``by`` to each row, in ``order``, for groups of any size: rows are split into
    ranges of ``by`` and ``order``, each range is summed by itself, and what the ranges before it hold of the group is added.
    No task has more than a range, however large a group is. Rows alike in ``order`` are in one range."""
    ranges = cut(df.withColumn("value_", value).repartitionByRange(*[F.col(c) for c in by], *order).withColumn("range_", F.spark_partition_id()), "ranges")
    sums = ranges.groupBy(*by, "range_").agg(F.sum("value_").alias("n_"))
    before = Window.partitionBy(*by).orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*by, "range_", F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("start_"))
    upto = Window.partitionBy(*by, "range_").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    own = ranges.withColumn("own_", F.sum("value_").over(upto))
    return beside(own, starts, [*by, "range_"]).withColumn(into, F.col("start_") + F.col("own_")).drop("range_", "start_", "own_", "value_")


def numbered(df: DataFrame, by: Sequence[str], order: Sequence[Column], into: str = "rank") -> DataFrame:
    """``ranked`` for groups of any size, as a ``running`` count. Where only the first few of a group are wanted, ``ranked`` with
    a limit moves less."""
    return running(df, by, order, F.lit(1), into)


def select_cells(df: DataFrame, cell: Sequence[str], score: str, key: str, theta: Column, floor: Column, ceiling: Column, direct: float = 0.65, sparse: DataFrame | None = None, topup: Column | None = None) -> DataFrame:
    """Threshold selection with floor and ceiling per cell (F01): of R rows, T reach theta; the best
    N = least(ceiling, greatest(T, least(floor, R))) stay, with ``band`` direct or gray and ``bound``, what stopped it:
    max, min, exhausted or theta. Null scores rank last and never reach theta.

    ``sparse`` is the sparse leg, with ``cell``, ``key`` and ``rank`` from 1: of each cell its first ``topup`` rows (none by
    default) that aren't chosen yet come after the choice as gray, beyond the ceiling too, also in cells without other
    rows; their other columns are null. ``floor`` and ``topup`` are read from its rows as well."""
    sizes = df.groupBy(*cell).agg(F.count_if(F.col(score) >= theta).alias("t_"), F.count(F.lit(1)).alias("r_"))
    out = beside(numbered(df, cell, [F.desc_nulls_last(score), F.col(key)], "rank"), sizes, cell)
    t = F.col("t_")
    out = out.withColumn("n_", F.least(ceiling, F.greatest(t, F.least(floor, F.col("r_")))))
    bound = F.when((F.col("r_") > F.col("n_")) & (F.col("n_") == ceiling), "max").when(t < floor, F.when(F.col("r_") < floor, "exhausted").otherwise("min")).otherwise("theta")
    band = F.when((F.col(score) >= theta) & (F.col(score) >= direct), "direct").otherwise("gray")
    out = out.withColumn("band", band).withColumn("bound", bound).where("rank <= n_").drop("t_", "r_", "n_")
    if sparse is None or topup is None:
        return out
    empty = F.when(floor > 0, "exhausted").otherwise("theta")
    more = sparse.where(F.col("rank") <= topup).groupBy(*cell, key).agg(F.min("rank").alias("s_"), F.max(empty).alias("e_")).alias("s")
    same = reduce(and_, [F.col(f"s.{c}").eqNullSafe(F.col(f"o.{c}")) for c in cell])
    more = more.join(out.select(*cell, key).alias("o"), same & (F.col(f"s.{key}") == F.col(f"o.{key}")), "left_anti").alias("s")
    stop = out.groupBy(*cell).agg(F.max("rank").alias("n_"), F.max("bound").alias("b_")).alias("o")
    more = more.join(stop, same, "left").select("s.*", "n_", "b_")
    more = ranked(more, cell, [F.col("s_"), F.col(key)], "k_")
    more = more.select(*cell, key, (F.coalesce("n_", F.lit(0)) + F.col("k_")).alias("rank"), F.lit("gray").alias("band"), F.coalesce("b_", "e_").alias("bound"))
    return out.unionByName(more, allowMissingColumns=True)


def fuse(legs: Sequence[DataFrame], cell: Sequence[str], key: str, constant: int = 60) -> DataFrame:
    """Reciprocal rank fusion (F04): the sum of 1 / (constant + rank) over the legs, each with ``cell``, ``key``, ``rank``."""
    both = legs[0].select(*cell, key, "rank")
    for leg in legs[1:]:
        both = both.unionByName(leg.select(*cell, key, "rank"))
    return both.groupBy(*cell, key).agg(F.round(F.sum(1.0 / (constant + F.col("rank"))), 6).alias("score"), F.count(F.lit(1)).alias("legs"))


def fill_quota(df: DataFrame, cell: Sequence[str], best: Sequence[Column], slots: int) -> DataFrame:
    """Breadth-first fill (F08): one row of every cell, then second rows, until ``slots`` are full."""
    return ranked(df, cell, best, "round").where(F.col("round") <= slots).orderBy("round", *cell).limit(slots)  # a cell can fill no more


def ordinals(df: DataFrame, by: Sequence[str], order: Sequence[Column], citation: str, into: str) -> DataFrame:
    """The nth repeat of a citation gets ``~n``, the first none."""
    out = numbered(df, [*by, citation], order, "n_")
    return out.withColumn(into, F.when(F.col("n_") > 1, F.concat(F.col(citation), F.lit("~"), F.col("n_").cast("string"))).otherwise(F.col(citation))).drop("n_")


def latest(df: DataFrame, by: Sequence[str], order: Sequence[str], tombstone: Column | None = None) -> DataFrame:
    """The last row of each key, without those whose last row is a tombstone (F20, H06 reversed). A map-side maximum, so
    that a key with a third of all rows shrinks before the shuffle. Rows alike in ``order`` tie to the greatest row."""
    other = [c for c in df.columns if c not in by]
    out = df.groupBy(*by).agg(F.max_by(F.struct(*other), F.struct(*order, *[c for c in other if c not in order])).alias("row_"))
    out = out.select(*by, "row_.*").select(*df.columns)
    return out if tombstone is None else out.where(~F.coalesce(tombstone, F.lit(False)))


def first_wins(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key."""
    other = [c for c in df.columns if c not in by]
    out = df.groupBy(*by).agg(F.min_by(F.struct(*other), F.struct(*order, *[c for c in other if c not in order])).alias("row_"))
    return out.select(*by, "row_.*").select(*df.columns)


def widest_run(df: DataFrame, by: Sequence[str], order: str, number: str) -> DataFrame:
    """Runs of non-decreasing numbers; the one that spans most of ``order`` wins, the first of equals."""
    w = Window.partitionBy(*by).orderBy(order)
    runs = df.withColumn("new_", (F.col(number) < F.lag(number).over(w)).cast("int")).withColumn("run", F.sum(F.coalesce("new_", F.lit(0))).over(w))
    spans = runs.groupBy(*by, "run").agg(F.min(order).alias("start"), F.max(order).alias("end"), F.count(F.lit(1)).alias("rows"))
    return spans.groupBy(*by).agg(F.max_by(F.struct("run", "start", "end", "rows"), F.struct((F.col("end") - F.col("start")).alias("w"), -F.col("run"))).alias("s")).select(*by, "s.*")


def streaks(df: DataFrame, by: Sequence[str], order: Sequence[str], bad: Column, most: int) -> DataFrame:
    """Stretches of at least ``most`` bad outcomes in a row (F29): ``by``, ``streak``, ``from``, ``until``, ``length``."""
    marked = running(df.withColumn("bad_", F.coalesce(bad, F.lit(False))), by, [F.col(c) for c in order], (~F.col("bad_")).cast("int"), "streak").where("bad_")
    return marked.groupBy(*by, "streak").agg(F.min(order[0]).alias("from"), F.max(order[0]).alias("until"), F.count(F.lit(1)).alias("length")).where(F.col("length") >= most)


def sliding_mix(df: DataFrame, by: Sequence[str], order: Sequence[str], outcome: str, of: int = 40) -> DataFrame:
    """For every row the share of bad outcomes among the last ``of`` (F29, O31). A group is cut into stretches of ``STRETCH`` rows,
    each with the few rows before it, so no task has all rows of a group."""
    n = numbered(df, by, [F.col(c) for c in order], "n_").withColumn("at_", F.floor((F.col("n_") - 1) / STRETCH))
    # the last rows of a stretch are seen by the next one as well
    late = F.when((F.col("n_") - 1) % STRETCH >= STRETCH - (of - 1), F.array("at_", F.col("at_") + 1)).otherwise(F.array("at_"))
    n = n.withColumn("in_", F.explode(late))
    w = Window.partitionBy(*by, "in_").orderBy("n_").rowsBetween(1 - of, 0)
    out = n.withColumn("seen", F.count(F.lit(1)).over(w)).withColumn("share", F.round(F.avg(F.when(F.col(outcome) == "ok", 0.0).otherwise(1.0)).over(w), 6))
    return out.where("in_ = at_").drop("n_", "at_", "in_")


def forward_fill(df: DataFrame, by: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Null cells take the last value above them."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})


def chunks(df: DataFrame, text: str, size: int = 1200, step: int = 1050, least: int = 80) -> DataFrame:
    """Overlapping chunks of fixed size; short ones are dropped (G09). ``chunk`` counts from 0, ``start`` is its place."""
    n = F.length(text)
    starts = F.sequence(F.lit(0), F.greatest(n - (size - step), F.lit(1)) - 1, F.lit(step))
    out = df.where(n > 0).select("*", F.posexplode(starts).alias("chunk", "start"))
    return out.withColumn("body", F.substring(F.col(text), F.col("start") + 1, F.lit(size))).where(F.length("body") >= least)


def bin_pack(df: DataFrame, by: str, order: str, size: str, most_size: int, most_rows: int) -> DataFrame:
    """Batches within a group: a new one starts when size or rows would pass their limit (K10). Sequential per group, so
    groups must fit one task; a row above the limit is a batch of its own."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def pack(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(order, kind="stable")
        batch, total, rows, out = 0, 0, 0, []
        for s in g[size]:
            if rows and (total + s > most_size or rows >= most_rows):
                batch, total, rows = batch + 1, 0, 0
            total, rows = total + s, rows + 1
            out.append(batch)
        return g.assign(batch=out)

    return df.groupBy(by).applyInPandas(pack, f"{fields}, batch int")


def stratified(df: DataFrame, stratum: Column, shares: dict[str, float], n: int, key: str, seed: int, forced: Column | None = None) -> DataFrame:
    """A sample of ``n`` with stated shares per stratum, in a seeded order; forced rows come first (G08). The sample is
    the feature; it is taken per stratum by the lowest hashes. Where a stratum has too few rows, the others named in ``shares``
    fill its part, lowest hashes first."""
    quota = F.create_map(*[x for k, v in shares.items() for x in (F.lit(k), F.lit(round(n * v)))])
    order = [F.coalesce(forced, F.lit(False)).desc()] if forced is not None else []
    by_hash = [F.xxhash64(F.lit(seed), key), F.col(key)]
    out = df.withColumn("stratum", stratum).withColumn("rn_", F.row_number().over(Window.partitionBy("stratum").orderBy(*order, *by_hash)))
    out = out.where(F.col("rn_") <= n).withColumn("over_", F.col("rn_") > F.try_element_at(quota, F.col("stratum"))).where("over_ IS NOT NULL")
    return out.orderBy("over_", *order, *by_hash).limit(n).drop("rn_", "over_")


def spacing(df: DataFrame, by: Sequence[str], at: str, least_seconds: float) -> DataFrame:
    """Events that came sooner after the one before than allowed (F30): with ``gap`` in seconds."""
    w = Window.partitionBy(*by).orderBy(at)
    gap = (F.unix_micros(F.col(at).cast("timestamp")) - F.unix_micros(F.lag(at).over(w).cast("timestamp"))) / 1e6
    return df.withColumn("gap", F.round(gap, 6)).where(F.col("gap") < least_seconds)


