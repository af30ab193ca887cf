"""Upserts, listing differences, carried state and slowly changing rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.session import broadcast_if_small


def upsert(old: DataFrame, new: DataFrame, processed: DataFrame, key: str) -> DataFrame:
    """Rows of processed keys are replaced, also where nothing new came; all others survive."""
    return old.join(processed.select(key).distinct(), key, "left_anti").unionByName(new)


def listing_changes(old: DataFrame, new: DataFrame, key: str, compare: Mapping[str, Column]) -> DataFrame:
    """New, gone and changed rows of two listings with one row per key (L01 to L07): ``key, change, reasons``; unchanged rows are
    left out. ``compare`` gives the compared values by reason."""
    names = list(compare)
    side = lambda df, p: df.select(F.col(key), F.struct(*[compare[n].alias(n) for n in names]).alias(p))
    j = side(old, "o").join(side(new, "n"), key, "full_outer")
    reasons = F.filter(F.array(*[F.when(~F.col(f"o.{n}").eqNullSafe(F.col(f"n.{n}")), F.lit(n)) for n in names]), lambda x: x.isNotNull())
    change = F.when(F.col("o").isNull(), "new").when(F.col("n").isNull(), "gone").when(F.size(reasons) > 0, "changed")
    return j.select(key, change.alias("change"), F.when(change == "changed", reasons).otherwise(F.array().cast("array<string>")).alias("reasons")).where("change IS NOT NULL")


def carried_forward(old: DataFrame, fresh: DataFrame, key: str, read: Column, state: Sequence[str], note: str) -> DataFrame:
    """Fresh rows take the old state where it was not read again; vanished rows stay, with a note."""
    o = old.select(F.col(key), F.struct(*[c for c in old.columns if c != key]).alias("o"))
    f = fresh.withColumn("read_", F.coalesce(read, F.lit(False))).select(F.col(key), F.struct(*[c for c in fresh.columns if c != key], "read_").alias("f"))
    j = o.join(f, key, "full_outer")
    pick = lambda c: F.when(F.col("f").isNull(), F.col(f"o.{c}")).when(~F.col("f.read_") & F.col("o").isNotNull(), F.col(f"o.{c}")).otherwise(F.col(f"f.{c}")) if c in state else F.coalesce(F.col(f"f.{c}"), F.col(f"o.{c}"))
    return j.select(key, *[pick(c).alias(c) for c in old.columns if c != key], F.when(F.col("f").isNull(), F.lit(note)).alias("carried"))


def consecutive(rows: DataFrame, source: str, key: str, snapshot: str) -> tuple[DataFrame, DataFrame]:
    """The listings before and after each step between consecutive snapshots that a source delivered, for ``listing_changes``
    over all of them at once: ``k`` is the struct of source, key and later snapshot. ``rows`` has one row per source, key and
    snapshot; a source's first snapshot ends no step."""
    dates = rows.select(source, snapshot).distinct()
    by = Window.partitionBy(source).orderBy(snapshot)
    dates = dates.select(F.col(source).alias("s_"), F.col(snapshot).alias("d_"), F.lag(snapshot).over(by).alias("prev_"), F.lead(snapshot).over(by).alias("next_"))
    dated = rows.join(broadcast_if_small(dates), F.col(source).eqNullSafe(F.col("s_")) & (F.col(snapshot) == F.col("d_")))
    values = [c for c in rows.columns if c not in (source, key, snapshot)]
    at = lambda c: dated.where(f"{c} IS NOT NULL").select(F.struct(F.col(source), F.col(key), F.col("next_" if c == "next_" else snapshot).alias(snapshot)).alias("k"), *values)
    return at("next_"), at("prev_")


def carried_over(rows: DataFrame, source: str, key: str, snapshot: str, read: Column, state: Sequence[str], note: str) -> DataFrame:
    """``carried_forward`` from each delivered snapshot of a source to the next, the result of a step being the old side of the
    one after: a key holds its last read state (that of its first listing until then), other columns their last stated
    value, and it stays, with a note, in the snapshots that don't list it. ``rows`` has one row per source, key and
    snapshot; the result one per key and snapshot of its source from the second on."""
    dates = rows.select(F.col(source).alias("s_"), F.col(snapshot).alias("d_")).distinct()
    dates = dates.withColumn("step_", F.row_number().over(Window.partitionBy("s_").orderBy("d_")))
    keys = rows.groupBy(source, key).agg(F.min(snapshot).alias("since_"))
    grid = keys.join(broadcast_if_small(dates), F.col(source).eqNullSafe(F.col("s_")) & (F.col("d_") >= F.col("since_"))).select(F.col(source).alias("s_"), F.col(key).alias("k_"), "d_", "since_", "step_")
    listed = rows.withColumn("read_", F.coalesce(read, F.lit(False)))
    j = grid.join(listed, F.col("s_").eqNullSafe(F.col(source)) & (F.col("k_") == F.col(key)) & (F.col("d_") == F.col(snapshot)), "left")
    w = Window.partitionBy("s_", "k_").orderBy("d_")
    kept = F.last(F.when(F.col("read_") | (F.col("d_") == F.col("since_")), F.struct(*state)), True).over(w)
    values = [c for c in rows.columns if c not in (source, key, snapshot)]
    j = j.withColumn("kept_", kept).select(F.col("s_").alias(source), F.col("k_").alias(key), F.col("d_").alias(snapshot), "step_", *[(F.col(f"kept_.{c}") if c in state else F.last(c, True).over(w)).alias(c) for c in values], F.when(F.col(snapshot).isNull(), F.lit(note)).alias("carried"))
    return j.where("step_ > 1").drop("step_")


def corrected(rows: DataFrame, decisions: DataFrame, key: str, verdict: str, corrections: str, columns: Sequence[str]) -> DataFrame:
    """Rows without the rejected ones, corrections put in column by column (F21). ``decisions`` has one row per key, its
    corrections a map of column to value."""
    d = decisions.select(key, F.col(verdict).alias("v_"), F.col(corrections).alias("c_"))
    out = rows.join(d, key, "left").where(F.coalesce(F.col("v_") != "reject", F.lit(True)))
    return out.withColumns({c: F.coalesce(F.try_element_at("c_", F.lit(c)), F.col(c)) for c in columns}).drop("v_", "c_")


def history(df: DataFrame, key: Sequence[str], at: str, version: Column) -> DataFrame:
    """Versions of each key with the time they held: ``valid_from``, ``valid_to`` (null: current), ``seq`` from 1 (F18, SCD 2).
    Repeats of the version before are no version of their own."""
    w = Window.partitionBy(*key).orderBy(at)
    out = df.withColumn("version", version)
    out = _changes_only(out, w)
    return out.select(*key, "version", F.col(at).alias("valid_from"), F.lead(at).over(w).alias("valid_to"), F.row_number().over(w).alias("seq"))


def _changes_only(df: DataFrame, w) -> DataFrame:
    return df.withColumn("p_", F.lag(F.struct("version")).over(w)).where("p_ IS NULL OR NOT (p_.version <=> version)").drop("p_")
