"""Queries that take whole tables where the ones beside them take a part, over small tables made here."""

from collections import Counter

from quillspark.plans import catalog


def test_masked_lines_of_any_length(spark, tmp_path):
    long, short = "Printed under the authority of the Department on page 17 of 230", "Page 3"
    texts = [f"{long}\n  {short} \n\nonce", f"{long}\n{short}", f"{long.replace('17', '9')}\nPage 12\nonce"]
    spark.createDataFrame([(t,) for t in texts], "text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = Counter({r.line: r.n for r in catalog.QUERIES["i42_masked_lines"](spark, str(tmp_path)).collect()})
    assert got == {"Printed under the authority of the Department on page # of #": 3, "Page #": 3}
    assert max(map(len, got)) > 40


def test_prefix_amendments_of_every_economy(spark, tmp_path):
    names = {
        ("MY", "a", "Wine Act 1970"): "Wine Amendment Act 1999",  # short, and not AU
        ("MY", "b", "Wine Act 1990"): "Wine Amendment (Fees) Act 2005",  # the newest law before both; the later one holds
        ("MY", "c", "Wine Act 2010"): None,  # younger than both
        ("AU", "d", "Timber"): "Timber Parcel Export Amendment Act 1980",  # the law's title is the prefix
        ("AU", "e", "Wine Act 1960"): "Statute Tidying (Omnibus) Act 2025",
        ("AU", "f", "Timber Parcel Export Amendment Act 1980"): None,
    }
    data = [(i, "2026-03-01", *k, "5/1950" if k[1] == "d" else None, "principal_act", v) for i, (k, v) in enumerate(names.items())]
    df = spark.createDataFrame(data, "row_id long, snapshot_date string, economy string, portal_id string, title string, law_number string, document_kinds string, last_amending_instrument string")
    df.selectExpr("*", "timestamp '2026-03-01 00:00:00' AS delivered_at").write.parquet(f"{tmp_path}/law_census.parquet")
    got = sorted((r.economy, r.portal_id, r.dated, r.amending, r.amended) for r in catalog.QUERIES["o07_prefix_amendments"](spark, str(tmp_path)).collect())
    assert got == [("AU", "D", 1950, "Timber Parcel Export Amendment Act 1980", 1980), ("MY", "B", 1990, "Wine Amendment (Fees) Act 2005", 2005)]


def test_best_match_of_odd_names(spark, tmp_path):
    names = [(1, "6.1", "Decree on Fees"), (1, "6.1", "Decree on Banks"), (2, "6.1", "Decree on Fees"), (3, None, "Decree on Fees"), (4, "6.2", "Decree on Fees"), (5, "6.1", None), (6, "6.1", ""), (7, "6.1", "Decrees"), (8, "6.1", "ກົດໝາຍ"), (None, "6.1", "fee decree")]
    known = [(20, "6.1", "Decree on Fees of Banks"), (10, "6.1", "Fees of Banks (Decree)"), (30, None, "the decree on fees"), (40, "6.1", "Decree"), (50, "6.1", None), (60, "6.1", "ກົດໝາຍ 1")]
    spark.createDataFrame(names, "record_id long, indicator_id string, law_name string").write.parquet(f"{tmp_path}/records_la.parquet")
    spark.createDataFrame(known, "baseline_id long, indicator_id string, law_name string").write.parquet(f"{tmp_path}/baseline_la.parquet")
    got = Counter(tuple(r) for r in catalog.QUERIES["d06_best_match"](spark, str(tmp_path)).select("record_id", "baseline_id", "score").collect())
    assert got == Counter({(1, 10, 1.0): 2, (2, 10, 1.0): 1, (3, 30, 1.0): 1, (8, 60, 1.0): 1, (None, 10, 1.0): 1})
