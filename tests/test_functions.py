from pyspark.sql import functions as F

from quillspark.functions import dates, text, urls


def one(spark, column, *values):
    df = spark.createDataFrame([(v,) for v in values], "x string")
    return [r[0] for r in df.select(column(F.col("x")).alias("y")).collect()]


def test_names(spark):
    assert one(spark, text.collapse, " a　 b\n", "", None) == ["a b", "", None]
    assert one(spark, text.plain_name, "The  Data, Act (No. 2)", None) == ["the data act no 2", None]
    assert one(spark, text.tokens, "The Data Data Act 2020", "", None) == [["data"], [], None]
    assert one(spark, lambda c: text.tokens(c, "none"), "The Act 2020") == [["2020"]]
    assert one(spark, text.acronym, "Personal Data Protection Act 2012 (rev. 2020)", "") == ["pdpar2020", ""]
    assert one(spark, text.title_base, "Harbour Code (Amendment) Act 2002", "x") == ["HARBOUR CODE", "X"]
    assert one(spark, text.slug, "A b!", "ກົດ", "x" * 100)[0] == "a_b"
    assert one(spark, text.slug, "ກົດ")[0].startswith("x_") and len(one(spark, text.slug, "x" * 100)[0]) == 80


def test_overlaps(spark):
    df = spark.createDataFrame([(["a", "b"], ["b", "c", "d"]), ([], ["a"]), (["a"], ["a", "b"]), (["a"], ["a"])], "a array<string>, b array<string>")
    a, b = F.col("a"), F.col("b")
    got = df.select(text.coverage(a, b), text.covers(a, b), text.overlap(a, b), text.jaccard(a, b)).collect()
    assert [tuple(r) for r in got] == [(0.5, False, 0.5, 0.25), (0.0, False, 0.0, 0.0), (1.0, False, 1.0, 0.5), (1.0, True, 1.0, 1.0)]


def test_numbers(spark):
    assert one(spark, text.act_number, "Lei N.o 012 /2024", "n.º 7/1999", "x", None) == ["12/2024", "7/1999", None, None]
    assert one(spark, text.citation_root, "s.26(1)", "15a", "x", "") == ["26", "15A", None, None]
    assert one(spark, text.numeral, "二十三", "十", "一百零五", "三千二百", "两百", "x", "", None) == [23, 10, 105, 3200, 200, None, None, None]
    assert one(spark, lambda c: text.section_key(c)["number"], "15A", "x") == [15, -1]
    ids = ["6.10", "6.9", "12.1", "6.1"]
    df = spark.createDataFrame([(i,) for i in ids], "x string").orderBy(text.dotted_key(F.col("x")))
    assert [r.x for r in df.collect()] == ["6.1", "6.9", "6.10", "12.1"]


def test_texts(spark):
    assert one(spark, text.strip_tags, "<p>a &amp; <b>b</b></p><script>x</script>", None) == ["a & b", None]
    assert one(spark, text.references, "see Section 4 and section 4, Artigo 12", "") == [["4", "12"], []]
    assert one(spark, text.urls_in, "at https://a.b/c). and http://x.y, https://a.b/c") == [["https://a.b/c", "http://x.y"]]
    assert one(spark, text.script_runs, "a北b屿ກ") == ["北屿ກ"]
    assert one(spark, text.digit_mask, "p. 12 of 345") == ["p. # of #"]
    df = spark.createDataFrame([("0123456789", "345", 3), ("0123", "x", 1), (None, "x", 0)], "t string, s string, at int")
    got = df.select(text.grounded(F.col("t"), F.col("s"), F.col("at")), text.context(F.col("t"), F.col("at"), F.col("at") + 2, 2)).collect()
    assert [r[0] for r in got] == [True, False, False] and tuple(got[0][1]) == ("12", "34", "56")


def test_urls(spark):
    assert one(spark, urls.canonical_url, "HTTPS://A.b/C/?x=1&id=2&f=1#z", "a.b/c", None) == ["https://a.b/C?f=1&id=2", None, None]
    assert one(spark, urls.host, "http://u:p@A.b:80/x", "x") == ["a.b", None]
    assert one(spark, lambda c: urls.https(c, "h.x"), "/a", "http://b/c") == ["https://h.x/a", "https://b/c"]
    assert one(spark, lambda c: urls.with_parameter(c, "q", F.lit("a b")), "http://x#f", "http://x?a=1") == ["http://x?q=a+b#f", "http://x?a=1&q=a+b"]
    assert one(spark, lambda c: urls.suffixes(c), "a.b.c") == [["a.b.c", "b.c", "c"]]


def test_dates(spark):
    assert one(spark, dates.all_dates, "on 5/3/2026, 2025-01-02 and 7 Ogos 2020 or 40/1/2020", "", None) == [["2026-03-05", "2025-01-02", "2020-08-07"], [], None]
    assert one(spark, dates.first_date, "x 2025-01-02", "x") == ["2025-01-02", None]
    assert one(spark, dates.day_first, "31/02/2024", "1/13/2024", None) == ["2024-02-31", None, None]
    assert one(spark, dates.stamp, "20240199", "2024") == ["2024-01-99", None]
    assert one(spark, dates.language_code, "pt-TL", "xyz", "?", None) == ["por", "xyz", None, None]
    assert one(spark, dates.economy_code, " laos", "sg", "Mars", None) == ["LA", "SG", None, None]
