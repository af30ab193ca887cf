"""Queries and SQL of the general data problems."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillspark.operators.snapshots import census_changes
from quillspark.session import table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Laws added to, removed from or changed between consecutive snapshots of each economy."""
    return census_changes(table(spark, sf_dir, "law_census")).selectExpr("key AS portal_id", "snapshot AS snapshot_date", "change_kind")


def p3_changed_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The changed fields of every law that changed, one row each."""
    return (
        census_changes(table(spark, sf_dir, "law_census"))
        .where("change_kind = 'changed'")
        .selectExpr("source AS economy", "key AS portal_id", "snapshot AS snapshot_date", "explode(changed_fields) AS field")
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p3_found": p3_found, "p3_changed_fields": p3_changed_fields}

_CENSUS = r"""
WITH base AS (
  SELECT economy, upper(regexp_replace(portal_id, '^\s+|\s+$', '', 'g')) AS portal_id, snapshot_date, delivered_at, row_id,
    nullif(regexp_replace(lower(regexp_replace(legal_status, '^\s+|\s+$', '', 'g')), '[_\-\s]+', ' ', 'g'), '') AS legal_status,
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(document_url, '^\s+|\s+$', '', 'g'), '[?#](.|\n)*$', ''), '^[A-Za-z][A-Za-z0-9+.\-]*://', ''), '/$', '') AS u
  FROM law_census),
latest AS (
  SELECT economy, portal_id, snapshot_date, legal_status,
    nullif(lower(regexp_extract(u, '^[^/]*')) || regexp_replace(u, '^[^/]*', ''), '') AS document_url
  FROM base WHERE length(portal_id) > 0 AND length(snapshot_date) > 0
  QUALIFY row_number() OVER (PARTITION BY economy, portal_id, snapshot_date ORDER BY delivered_at DESC NULLS LAST, row_id DESC) = 1),
dates AS (
  SELECT economy, snapshot_date, lag(snapshot_date) OVER (PARTITION BY economy ORDER BY snapshot_date) AS prev
  FROM (SELECT DISTINCT economy, snapshot_date FROM latest)),
new AS (SELECT l.*, d.prev FROM latest l JOIN dates d ON l.economy IS NOT DISTINCT FROM d.economy AND l.snapshot_date = d.snapshot_date WHERE d.prev IS NOT NULL),
old AS (SELECT l.*, d.snapshot_date AS next FROM latest l JOIN dates d ON l.economy IS NOT DISTINCT FROM d.economy AND l.snapshot_date = d.prev),
both_ AS (
  SELECT coalesce(n.economy, o.economy) AS economy, coalesce(n.portal_id, o.portal_id) AS portal_id, coalesce(n.snapshot_date, o.next) AS snapshot_date,
    n.portal_id IS NULL AS gone, o.portal_id IS NULL AS fresh,
    n.legal_status IS DISTINCT FROM o.legal_status AS s_changed, n.document_url IS DISTINCT FROM o.document_url AS u_changed
  FROM new n FULL JOIN old o ON n.economy IS NOT DISTINCT FROM o.economy AND n.portal_id = o.portal_id AND n.snapshot_date = o.next)
"""

SQL: dict[str, str] = {
    "p3_found": _CENSUS
    + """SELECT portal_id, snapshot_date, CASE WHEN fresh THEN 'added' WHEN gone THEN 'removed' ELSE 'changed' END AS change_kind
FROM both_ WHERE fresh OR gone OR s_changed OR u_changed""",
    "p3_changed_fields": _CENSUS
    + """SELECT economy, portal_id, snapshot_date, unnest(list_filter([CASE WHEN s_changed THEN 'legal_status' END, CASE WHEN u_changed THEN 'document_url' END], lambda x: x IS NOT NULL)) AS field
FROM both_ WHERE NOT fresh AND NOT gone AND (s_changed OR u_changed)""",
}
