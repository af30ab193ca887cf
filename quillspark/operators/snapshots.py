"""Changes between consecutive full snapshots of a table."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.session import small

#: Calendars (pairs of source and date) up to this many rows are broadcast; longer ones are joined by shuffle.
CALENDAR_ROWS = 200_000


def loose_word(c: Column) -> Column:
    """Text whose letter case, surrounding blanks and joints between words (``_``, ``-``, blank) don't count; null for ''."""
    return F.nullif(F.regexp_replace(F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", "")), r"(?U)[_\-\s]+", " "), F.lit(""))


def loose_url(c: Column) -> Column:
    """An address whose scheme, case of the host, closing slash, query and fragment don't count; null for ''."""
    bare = F.regexp_replace(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""), r"(?s)[?#].*$", "")
    bare = F.regexp_replace(F.regexp_replace(bare, r"^[A-Za-z][A-Za-z0-9+.\-]*://", ""), r"/$", "")
    host = F.regexp_extract(bare, r"^[^/]*", 0)
    return F.nullif(F.concat(F.lower(host), F.regexp_replace(bare, r"^[^/]*", "")), F.lit(""))


def snapshot_changes(
    rows: DataFrame,
    key: Column,
    snapshot: Column,
    source: Column,
    delivered: Column,
    fields: Mapping[str, Column],
    tie: Column | None = None,
) -> DataFrame:
    """Which records were added, removed or changed between consecutive snapshots of each source.

    ``rows`` holds full snapshots, one row per record; ``fields`` are the compared values, already in comparable form.
    Result: ``source, key, snapshot, change_kind, changed_fields`` with one row per record and later snapshot.

    Every row becomes signed cells: a presence marker and one cell (field, value) for each field, +1 in the comparison
    that ends at its snapshot and -1 in the one that starts there. Sums other than 0 are the changes: a presence of +1
    is an addition, of -1 a removal, and a field whose cells don't cancel has changed.

    - A record delivered several times for a snapshot counts as the row with the latest ``delivered`` (null: earliest),
      then the greatest ``tie``; rows alike in both are one.
    - Null fields are a value like any other; going to or from null is a change.
    - Rows whose key or snapshot is null or empty belong to no record or snapshot and give nothing.
    - A null source is a source like any other. An empty table gives no rows; other columns don't matter.

    Plan: deliveries are reduced by a map-side aggregate (a record or source with a third of all rows shrinks before
    the shuffle), then rows move once to their record, and both sums run where they lie.
    """
    names = list(fields)
    base = rows.select(
        source.alias("source"),
        key.alias("key"),
        snapshot.alias("snapshot"),
        F.struct(delivered.alias("d"), (tie if tie is not None else F.lit(0)).alias("t")).alias("ord"),
        F.struct(*[fields[n].alias(f"f{i}") for i, n in enumerate(names)]).alias("val"),
    ).where((F.length("key") > 0) & F.col("snapshot").isNotNull() & (F.length(F.col("snapshot").cast("string")) > 0))
    order = F.struct(F.col("ord.d").isNotNull(), F.col("ord"), F.col("val"))
    last = base.groupBy("source", "key", "snapshot").agg(F.max_by("val", order).alias("val"))

    dates = base.select("source", "snapshot").distinct()
    by = Window.partitionBy("source").orderBy("snapshot")
    dates = dates.select("source", "snapshot", F.lag("snapshot").over(by).alias("prev"), F.lead("snapshot").over(by).alias("next"))
    dates = dates.select(F.col("source").alias("s_"), F.col("snapshot").alias("d_"), "prev", "next")
    if small(dates, CALENDAR_ROWS):
        dates = F.broadcast(dates)
    dated = last.join(dates, F.col("source").eqNullSafe(F.col("s_")) & (F.col("snapshot") == F.col("d_"))).select("source", "key", "snapshot", "val", "prev", "next")

    cell = lambda f, v: F.struct(F.lit(f).alias("field"), v.cast("string").alias("value"))
    cells = F.array(cell(-1, F.lit(None)), *[cell(i, F.col(f"val.f{i}")) for i in range(len(names))])
    ends = F.filter(
        F.array(
            F.struct(F.when(F.col("prev").isNotNull(), F.col("snapshot")).alias("at"), F.lit(1).alias("sign")),
            F.struct(F.col("next").alias("at"), F.lit(-1).alias("sign")),
        ),
        lambda e: e["at"].isNotNull(),
    )
    signed = (
        dated.repartition("source", "key")
        .select("source", "key", F.explode(ends).alias("e"), cells.alias("cells"))
        .select("source", "key", F.col("e.at").alias("snapshot"), F.col("e.sign").alias("sign"), F.explode("cells").alias("c"))
    )
    sums = signed.groupBy("source", "key", "snapshot", "c.field", "c.value").agg(F.sum("sign").alias("n")).where("n <> 0")
    named = F.array(*[F.lit(n) for n in names])
    presence = F.max(F.when(F.col("field") == -1, F.col("n")))
    return (
        sums.groupBy("source", "key", "snapshot")
        .agg(
            F.coalesce(presence, F.lit(0)).alias("p"),
            F.array_sort(F.collect_set(F.when(F.col("field") >= 0, F.element_at(named, F.col("field") + 1)))).alias("changed_fields"),
        )
        .select(
            "source",
            "key",
            "snapshot",
            F.when(F.col("p") > 0, "added").when(F.col("p") < 0, "removed").otherwise("changed").alias("change_kind"),
            F.when(F.col("p") == 0, F.col("changed_fields")).otherwise(F.array().cast("array<string>")).alias("changed_fields"),
        )
    )


def census_changes(census: DataFrame) -> DataFrame:
    """``snapshot_changes`` over portal snapshots of laws: key portal_id (upper case, no surrounding white space), source
    economy, fields legal_status and document_url in their loose forms."""
    return snapshot_changes(
        census,
        key=F.upper(F.regexp_replace("portal_id", r"(?U)^\s+|\s+$", "")),
        snapshot=F.col("snapshot_date"),
        source=F.col("economy"),
        delivered=F.col("delivered_at"),
        fields={"legal_status": loose_word(F.col("legal_status")), "document_url": loose_url(F.col("document_url"))},
        tie=F.col("row_id"),
    )
