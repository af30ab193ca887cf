from datetime import datetime

from pyspark.sql import functions as F

from quillspark.operators.snapshots import census_changes, loose_url, loose_word

SCHEMA = "row_id long, snapshot_date string, economy string, portal_id string, legal_status string, document_url string, delivered_at timestamp, key string, value string, snapshot string"


def at(day):
    return datetime(2026, 1, day)


def run(spark, rows):
    df = spark.createDataFrame([(i, *r, "k", "v", "s") for i, r in enumerate(rows)], SCHEMA)
    return sorted((r.source or "", r.key, r.snapshot, r.change_kind, tuple(r.changed_fields)) for r in census_changes(df).collect())


def test_added_removed_changed(spark):
    got = run(
        spark,
        [
            ("2026-01-01", "AU", "a", "in_force", "http://H.x/a", at(1)),
            ("2026-01-01", "AU", "b", "in_force", "http://h.x/b", at(1)),
            ("2026-01-01", "AU", "c", None, "u", at(1)),
            ("2026-02-01", "AU", " A\t", "In-Force ", "https://h.x/a/?q=1#f", at(2)),  # the same in other notation
            ("2026-02-01", "AU", "c", "", "v", at(2)),  # only the address changed
            ("2026-02-01", "AU", "d", "pending", None, at(2)),
        ],
    )
    assert got == [("AU", "B", "2026-02-01", "removed", ()), ("AU", "C", "2026-02-01", "changed", ("document_url",)), ("AU", "D", "2026-02-01", "added", ())]


def test_latest_delivery_and_late_rows(spark):
    got = run(
        spark,
        [
            ("2026-01-01", "AU", "a", "x", "u", at(1)),
            ("2026-02-01", "AU", "a", "y", "u", at(2)),  # put right below
            ("2026-02-01", "AU", "a", "x", "u", at(9)),
            ("2026-02-01", "AU", "a", "z", "u", None),  # no time: earliest
            ("2026-03-01", "AU", "a", "x", "u", at(3)),
            ("2026-03-01", "AU", "a", "x", "u", at(3)),
        ],
    )
    assert got == []


def test_snapshot_missing_for_one_source_and_null_source(spark):
    got = run(
        spark,
        [
            ("2026-01-01", None, "a", "x", "u", at(1)),
            ("2026-03-01", None, "a", "y", None, at(1)),
            ("2026-01-01", "MY", "a", "x", "u", at(1)),
            ("2026-02-01", "MY", "b", "x", "u", at(1)),
            ("2026-02-01", "MY", None, "x", "u", at(1)),
            ("2026-02-01", "MY", "  ", "x", "u", at(1)),
            (None, "MY", "q", "x", "u", at(1)),
        ],
    )
    assert got == [("", "A", "2026-03-01", "changed", ("document_url", "legal_status")), ("MY", "A", "2026-02-01", "removed", ()), ("MY", "B", "2026-02-01", "added", ())]


def test_empty_and_single_snapshot(spark):
    assert run(spark, []) == []
    assert run(spark, [("2026-01-01", "AU", "a", "x", "u", at(1))]) == []


def test_loose_forms(spark):
    df = spark.createDataFrame([("HTTPS://Ab.C/Path/?x#y", " In-_force\t"), ("", ""), (None, None), ("x" * 100000 + "/", "a b")], "u string, s string")
    got = df.select(loose_url(F.col("u")), loose_word(F.col("s"))).collect()
    assert [tuple(r) for r in got[:3]] == [("ab.c/Path", "in force"), (None, None), (None, None)]
    assert got[3][0] == "x" * 100000 and got[3][1] == "a b"
