"""Typed coercion and rules over rows: one pass, all messages."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def coerced(df: DataFrame, ints: Sequence[str] = (), bools: Sequence[str] = (), optional: Sequence[str] = (), strict_bools: bool = False) -> DataFrame:
    """Strings to types (A02): null for what is no number; true, 1, yes and false, 0, no; '' is null in optional columns.
    With ``strict_bools`` only 'true' is true and all else false (A03)."""
    low = lambda c: F.lower(F.trim(c))
    truth = (lambda c: low(c) == "true") if strict_bools else (lambda c: F.when(low(c).isin("true", "1", "yes"), True).when(low(c).isin("false", "0", "no"), False))
    return df.withColumns({**{c: F.nullif(F.col(c), F.lit("")) for c in optional}, **{c: F.expr(f"try_cast(trim(`{c}`) AS INT)") for c in ints}, **{c: truth(F.col(c)) for c in bools}})


def failures(df: DataFrame, key: str, rules: Mapping[str, Column]) -> DataFrame:
    """Rows that break a rule, with the names of the rules in order (A01, K05, K06, E17): ``key, broken``. A rule that is
    null for a row counts as broken."""
    broken = F.filter(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()]), lambda x: x.isNotNull())
    return df.select(key, broken.alias("broken")).where(F.size("broken") > 0)


def rule_counts(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """How many rows break each rule, in one aggregation: ``rule, broken``."""
    one = df.agg(*[F.count_if(~F.coalesce(c, F.lit(False))).alias(n) for n, c in rules.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("broken")) for n in rules])).alias("r")).select("r.*")


def duplicates(df: DataFrame, by: Sequence[str], key: str) -> DataFrame:
    """Values that several rows share (A04, H05): ``by``, ``rows``, ``first``."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.min(key).alias("first")).where("rows > 1")


def column_headed(df: DataFrame, heading: str, least: int = 0) -> str | None:
    """The first column from place ``least`` on whose name begins with ``heading``, letter case and blanks around it aside (F24);
    None if there is none. It reads the schema only."""
    return next((c for c in df.columns[least:] if c.strip().lower().startswith(heading.lower())), None)
