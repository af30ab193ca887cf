"""Queries of the pipeline's operators over the test tables, each with its SQL. Keys carry the survey's operator ids."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions import dates, text, urls
from quillspark.operators import aggregates, changes, checks, joins, ranking, retrieval, segments, snapshots
from quillspark.session import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _t(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda s, d: table(s, d, name)


documents, records, gloss, census, crawl = (_t(n) for n in ("documents", "records_la", "gloss_tl", "law_census", "crawl_log"))

# A: scans with gates


@query("a02_coerced", "SELECT row_id, try_cast(trim(compilation_number) AS INTEGER) AS compilation_number, CASE lower(trim(is_principal)) WHEN 'true' THEN true WHEN '1' THEN true WHEN 'yes' THEN true WHEN 'false' THEN false WHEN '0' THEN false WHEN 'no' THEN false END AS is_principal, nullif(law_number, '') AS law_number FROM law_census")
def a02(s, d):
    return checks.coerced(census(s, d), ints=["compilation_number"], bools=["is_principal"], optional=["law_number"]).select("row_id", "compilation_number", "is_principal", "law_number")


@query("a03_strict_coerced", "SELECT row_id, lower(trim(is_principal)) = 'true' AS is_principal, lower(trim(in_seed)) = 'true' AS in_seed FROM law_census")
def a03(s, d):
    return checks.coerced(census(s, d), bools=["is_principal", "in_seed"], strict_bools=True).select("row_id", "is_principal", "in_seed")


@query("a04_duplicate_texts", "SELECT sha256(text) AS content_sha256, count(*) AS rows, min(doc_id) AS first FROM documents GROUP BY 1 HAVING count(*) > 1")
def a04(s, d):
    return checks.duplicates(documents(s, d).withColumn("content_sha256", F.sha2("text", 256)), ["content_sha256"], "doc_id")


def _rules():
    return {"has_lang": F.col("lang").isNotNull() & (F.col("lang") != ""), "counted": F.col("n_chars") == F.length("text"), "has_source": F.col("source").isNotNull(), "id_form": F.col("instrument_id").rlike("^[a-z]{2}-[a-z0-9]+-[0-9]{3}$")}


@query("a05_rule_counts", """SELECT unnest(['has_lang', 'counted', 'has_source', 'id_form']) AS rule, unnest([count_if(NOT coalesce(lang <> '', false)), count_if(NOT coalesce(n_chars = length(text), false)), count_if(source IS NULL), count_if(NOT coalesce(regexp_matches(instrument_id, '^[a-z]{2}-[a-z0-9]+-[0-9]{3}$'), false))]) AS broken FROM documents""")
def a05(s, d):
    return checks.rule_counts(documents(s, d), _rules())


@query("k05_rule_failures", """SELECT doc_id, list_filter([CASE WHEN NOT coalesce(lang <> '', false) THEN 'has_lang' END, CASE WHEN NOT coalesce(n_chars = length(text), false) THEN 'counted' END, CASE WHEN source IS NULL THEN 'has_source' END, CASE WHEN NOT coalesce(regexp_matches(instrument_id, '^[a-z]{2}-[a-z0-9]+-[0-9]{3}$'), false) THEN 'id_form' END], lambda x: x IS NOT NULL) AS broken FROM documents
WHERE NOT (coalesce(lang <> '', false) AND coalesce(n_chars = length(text), false) AND source IS NOT NULL AND coalesce(regexp_matches(instrument_id, '^[a-z]{2}-[a-z0-9]+-[0-9]{3}$'), false))""")
def k05(s, d):
    return checks.failures(documents(s, d), "doc_id", _rules())


@query("a10_provisions_index", """WITH p AS (SELECT law_name, unnest(provisions) AS p FROM records_cn)
SELECT law_name, p.article_section AS article_section, p.indicator_id AS indicator_id, min(p.record_id) AS record_id, count(*) AS rows FROM p GROUP BY ALL""")
def a10(s, d):
    p = table(s, d, "records_cn").select("law_name", F.explode("provisions").alias("p")).select("law_name", "p.article_section", "p.indicator_id", "p.record_id")
    return p.groupBy("law_name", "article_section", "indicator_id").agg(F.min("record_id").alias("record_id"), F.count(F.lit(1)).alias("rows"))


@query("a13_forward_fill", "SELECT event_id, user_id, last_value(CASE WHEN event_type = 'click' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS last_click FROM events")
def a13(s, d):
    e = table(s, d, "events").withColumn("last_click", F.when(F.col("event_type") == "click", F.col("value")))
    return ranking.forward_fill(e, ["user_id"], ["ts", "event_id"], ["last_click"]).select("event_id", "user_id", "last_click")


@query("a16_longest_suffix", """WITH h AS (SELECT record_id, lower(regexp_extract(source_url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)) AS host FROM records_la)
SELECT record_id, CASE WHEN host = 'www.gazette.la.example' OR host LIKE '%.www.gazette.la.example' THEN 'mirror' WHEN host = 'gazette.la.example' OR host LIKE '%.gazette.la.example' THEN 'gazette' WHEN host = 'la.example' OR host LIKE '%.la.example' THEN 'lao' ELSE 'none' END AS parser FROM h""")
def a16(s, d):
    rules = s.createDataFrame([("la.example", "lao"), ("gazette.la.example", "gazette"), ("www.gazette.la.example", "mirror")], "suffix string, parser string")
    return joins.longest_suffix(records(s, d), "source_url", rules, "suffix", "parser", "none").select("record_id", "parser")


# B: sinks as queries of their result


@query("b02_upsert", "SELECT record_id, 'old' AS origin FROM records_la WHERE indicator_id IS NULL OR indicator_id NOT IN (SELECT indicator_id FROM gloss_items) UNION ALL SELECT record_id, 'new' FROM records_la WHERE confidence = '0.9' AND indicator_id IN (SELECT indicator_id FROM gloss_items)".replace("gloss_items", "(SELECT DISTINCT indicator AS indicator_id FROM gold_items WHERE economy = 'SG')"))
def b02(s, d):
    r = records(s, d).select("record_id", "indicator_id", "confidence")
    done = table(s, d, "gold_items").where("economy = 'SG'").select(F.col("indicator").alias("indicator_id")).distinct()
    new = r.where("confidence = '0.9'").join(done, "indicator_id", "left_semi").withColumn("origin", F.lit("new"))
    return changes.upsert(r.withColumn("origin", F.lit("old")), new, done, "indicator_id").select("record_id", "origin")


@query("b06_grouped_laws", "SELECT law_name, law_number_ref, source_url, count(*) AS provisions, string_agg(article_section, '|' ORDER BY record_id) AS articles FROM records_la GROUP BY ALL")
def b06(s, d):
    g = records(s, d).groupBy("law_name", "law_number_ref", "source_url")
    pairs = F.array_sort(F.collect_list(F.when(F.col("article_section").isNotNull(), F.struct("record_id", "article_section"))))
    return g.agg(F.count(F.lit(1)).alias("provisions"), F.array_join(F.transform(pairs, lambda p: p["article_section"]), "|").alias("a_")).select("law_name", "law_number_ref", "source_url", "provisions", F.when(F.col("a_") != "", F.col("a_")).alias("articles"))


# C: predicates and routing


@query("c01_superseded", "SELECT record_id, coalesce(contains(lower(notes), 'no law match'), false) AS hit FROM records_la")
def c01(s, d):
    return records(s, d).select("record_id", F.coalesce(F.lower("notes").contains("no law match"), F.lit(False)).alias("hit"))


@query("c05_lanes", "SELECT ts, url, host, CASE WHEN content_type LIKE 'text/html%' THEN 'A' WHEN content_type LIKE '%word%' THEN 'D' WHEN content_type = 'application/pdf' AND status = 200 THEN 'B' WHEN content_type = 'application/pdf' THEN 'C' ELSE 'none' END AS lane FROM crawl_log")
def c05(s, d):
    ct = F.col("content_type")
    lane = F.when(ct.like("text/html%"), "A").when(ct.like("%word%"), "D").when((ct == "application/pdf") & (F.col("status") == 200), "B").when(ct == "application/pdf", "C").otherwise("none")
    return crawl(s, d).select("ts", "url", "host", lane.alias("lane"))


@query("c09_interactive_filter", "SELECT record_id FROM records_la WHERE coalesce(discovery_tag, '') <> '' AND contains(lower(concat_ws(' ', law_name, article_section, verbatim_snippet, mapping_rationale, notes)), 'insurance')")
def c09(s, d):
    hay = F.lower(F.concat_ws(" ", "law_name", "article_section", "verbatim_snippet", "mapping_rationale", "notes"))
    return records(s, d).where((F.coalesce("discovery_tag", F.lit("")) != "") & hay.contains("insurance")).select("record_id")


@query("c17_rule_groups", """SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)repealed') THEN [] ELSE list_filter([CASE WHEN regexp_matches(text, '(?i)licen[cs]e') THEN 'licensing' END, CASE WHEN regexp_matches(text, '(?i)register') THEN 'registers' END], lambda x: x IS NOT NULL) END AS groups FROM documents""")
def c17(s, d):
    has = lambda p: F.col("text").rlike(f"(?i){p}")
    found = F.filter(F.array(F.when(has("licen[cs]e"), F.lit("licensing")), F.when(has("register"), F.lit("registers"))), lambda x: x.isNotNull())
    return documents(s, d).select("doc_id", F.when(has("repealed"), F.array().cast("array<string>")).otherwise(found).alias("groups"))


@query("c22_status_map", "SELECT row_id, CASE regexp_replace(lower(trim(legal_status)), '[_ -]+', '_', 'g') WHEN 'in_force' THEN 'live' WHEN 'pending' THEN 'future' WHEN 'repealed' THEN 'dead' WHEN 'ceased' THEN 'dead' WHEN 'superseded' THEN 'old' ELSE 'unknown' END AS state FROM law_census")
def c22(s, d):
    k = F.regexp_replace(F.lower(F.trim("legal_status")), "[_ -]+", "_")
    return census(s, d).select("row_id", F.when(k == "in_force", "live").when(k == "pending", "future").when(k.isin("repealed", "ceased"), "dead").when(k == "superseded", "old").otherwise("unknown").alias("state"))


# D: joins


@query("d01_precedence_merge", """WITH a AS (SELECT instrument_id, min(lang) AS lang, min(source) AS source FROM documents WHERE source = 'au_register' GROUP BY 1), b AS (SELECT instrument_id, max(lang) AS lang, max(source) AS source FROM documents GROUP BY 1)
SELECT instrument_id, coalesce(a.lang, b.lang) AS lang, CASE WHEN a.lang IS NOT NULL THEN 'register' WHEN b.lang IS NOT NULL THEN 'all' END AS lang_from, coalesce(a.source, b.source) AS source, CASE WHEN a.source IS NOT NULL THEN 'register' WHEN b.source IS NOT NULL THEN 'all' END AS source_from FROM a FULL JOIN b USING (instrument_id)""")
def d01(s, d):
    doc = documents(s, d).where("instrument_id IS NOT NULL")
    a = doc.where("source = 'au_register'").groupBy("instrument_id").agg(F.min("lang").alias("lang"), F.min("source").alias("source"))
    b = doc.groupBy("instrument_id").agg(F.max("lang").alias("lang"), F.max("source").alias("source"))
    return joins.merge_by_precedence([("register", a), ("all", b)], "instrument_id", ["lang", "source"])


@query("d03_fallback_join", """WITH k1 AS (SELECT law_name, law_number_ref, min(baseline_id) AS baseline_id, count(*) AS n FROM baseline_la WHERE law_name IS NOT NULL AND law_number_ref IS NOT NULL GROUP BY ALL), k2 AS (SELECT law_number_ref, min(baseline_id) AS baseline_id, count(*) AS n FROM baseline_la WHERE law_number_ref IS NOT NULL GROUP BY ALL)
SELECT record_id, CASE WHEN k1.n IS NOT NULL THEN k1.baseline_id ELSE k2.baseline_id END AS baseline_id, CASE WHEN k1.n IS NOT NULL THEN 0 WHEN k2.n IS NOT NULL THEN 1 END AS matched_on, CASE WHEN k1.n IS NOT NULL THEN k1.n > 1 WHEN k2.n IS NOT NULL THEN k2.n > 1 END AS ambiguous
FROM records_la r LEFT JOIN k1 USING (law_name, law_number_ref) LEFT JOIN k2 USING (law_number_ref)""")
def d03(s, d):
    r, b = records(s, d).select("record_id", "law_name", "law_number_ref"), table(s, d, "baseline_la").select("baseline_id", "law_name", "law_number_ref")
    return joins.join_with_fallback(r, b, [["law_name", "law_number_ref"], ["law_number_ref"]], ["baseline_id"]).select("record_id", "baseline_id", "matched_on", "ambiguous")


@query("d10_within", """SELECT g.event_id, o.o_orderkey FROM events g JOIN (SELECT o_orderkey, o_custkey, epoch(o_orderdate)::BIGINT AS a FROM orders) o ON g.user_id = o.o_custkey AND g.event_id * 1000 + 700000000 >= o.a - 1000000 AND g.event_id * 1000 + 700000000 < o.a + 9000000""")
def d10(s, d):
    e = table(s, d, "events").select("event_id", F.col("user_id").alias("k"), (F.col("event_id") * 1000 + 700_000_000).alias("at"))
    o = table(s, d, "orders").select("o_orderkey", F.col("o_custkey").alias("k"), F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("a")).withColumn("b", F.col("a") + 8_000_000)
    return joins.within(e, o, ["k"], "at", "a", "b", 10_000_000, slack=1_000_000).select("event_id", "o_orderkey")


@query("d14_as_of", """SELECT e.event_id, e.user_id, p.event_id AS signup_id FROM events e ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'signup' GROUP BY ALL) p ON e.user_id = p.user_id AND e.ts >= p.ts WHERE e.event_type = 'purchase'""")
def d14(s, d):
    e = table(s, d, "events")
    bought = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    signups = e.where("event_type = 'signup'").select("user_id", F.col("ts").alias("at"), F.col("event_id").alias("signup_id"))
    return joins.as_of(bought, signups, ["user_id"], "ts", "at", ["signup_id"]).select("event_id", "user_id", "signup_id")


@query("d18_unique_match", "WITH one AS (SELECT law_name, min(baseline_id) AS baseline_id FROM baseline_la GROUP BY law_name HAVING count(*) = 1) SELECT record_id, baseline_id FROM records_la JOIN one USING (law_name)")
def d18(s, d):
    return joins.unique_match(records(s, d).select("record_id", "law_name"), table(s, d, "baseline_la"), ["law_name"], "record_id", "baseline_id")


@query("d19_anti", "SELECT baseline_id FROM baseline_la WHERE law_name NOT IN (SELECT law_name FROM records_la WHERE law_name IS NOT NULL) OR law_name IS NULL")
def d19(s, d):
    return table(s, d, "baseline_la").join(records(s, d).select("law_name").distinct(), "law_name", "left_anti").select("baseline_id")


# E: aggregations


@query("e01_weighted_mode", """WITH s AS (SELECT source, lang, sum(CASE WHEN coalesce(n_chars, 0) = 0 THEN 1 ELSE n_chars END)::BIGINT AS weight FROM documents WHERE lang IS NOT NULL GROUP BY ALL)
SELECT source, lang, weight FROM s QUALIFY row_number() OVER (PARTITION BY source ORDER BY weight DESC, lang) = 1""")
def e01(s, d):
    return aggregates.weighted_mode(documents(s, d), ["source"], "lang", F.col("n_chars"))


@query("e08_reconcile", """WITH a AS (SELECT instrument_id, count(*) AS n FROM documents WHERE lang = 'en' AND instrument_id IS NOT NULL GROUP BY 1), b AS (SELECT instrument_id, count(*) AS n FROM documents WHERE economy IS NOT NULL AND instrument_id IS NOT NULL GROUP BY 1)
SELECT instrument_id, a.n AS "left", b.n AS "right", CASE WHEN a.n IS NULL THEN 'only right' WHEN b.n IS NULL THEN 'only left' ELSE 'counts differ' END AS problem FROM a FULL JOIN b USING (instrument_id) WHERE a.n IS DISTINCT FROM b.n""")
def e08(s, d):
    doc = documents(s, d).where("instrument_id IS NOT NULL")
    n = lambda df, c: df.groupBy("instrument_id").agg(F.count(F.lit(1)).alias(c))
    return aggregates.reconcile(n(doc.where("lang = 'en'"), "a"), n(doc.where("economy IS NOT NULL"), "b"), "instrument_id", "a", "b")


@query("e10_weighted_mean", "SELECT l_returnflag, round(sum(l_discount * l_quantity) / sum(l_quantity), 5) AS mean FROM lineitem GROUP BY 1")
def e10(s, d):
    return table(s, d, "lineitem").groupBy("l_returnflag").agg(F.round(F.sum(F.col("l_discount") * F.col("l_quantity")) / F.sum("l_quantity"), 5).alias("mean"))


@query("e14_counts_by_dimensions", "SELECT economy, discovery_tag, language_of_source, count(*) AS n, grouping(economy, discovery_tag, language_of_source)::BIGINT AS level FROM records_la GROUP BY GROUPING SETS ((economy), (discovery_tag), (language_of_source), ())")
def e14(s, d):
    r = records(s, d)
    return r.groupingSets([[F.col("economy")], [F.col("discovery_tag")], [F.col("language_of_source")], []], "economy", "discovery_tag", "language_of_source").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().cast("bigint").alias("level")).select("economy", "discovery_tag", "language_of_source", "n", "level")


@query("e18_dominant", """WITH c AS (SELECT source, lang, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY ALL), t AS (SELECT source, sum(n)::BIGINT AS total, max(n) AS n, arg_max(lang, (n, lang)) AS lang FROM c GROUP BY 1)
SELECT source, CASE WHEN n >= 0.8 * total THEN lang END AS lang, round(n / total, 6) AS share FROM t""")
def e18(s, d):
    return aggregates.dominant(documents(s, d), ["source"], "lang", 0.8)


@query("e21_confusion", "WITH x AS (SELECT (status = 200) AS t, (outcome = 'ok') AS p FROM crawl_log), y AS (SELECT count_if(coalesce(t, false) AND coalesce(p, false)) AS tp, count_if(NOT coalesce(t, false) AND coalesce(p, false)) AS fp, count_if(coalesce(t, false) AND NOT coalesce(p, false)) AS fn, count_if(NOT coalesce(t, false) AND NOT coalesce(p, false)) AS tn FROM x) SELECT *, round(CASE WHEN fn + tn > 0 THEN fn / (fn + tn) ELSE 0 END, 6) AS missed FROM y".replace("SELECT *,", "SELECT tp, fp, fn, tn,"))
def e21(s, d):
    return aggregates.confusion(crawl(s, d), F.col("status") == 200, F.col("outcome") == "ok")


@query("e23_funnel", "SELECT economy, count(*) AS listed, count_if(in_all = 'true') AS selected, count_if(in_all = 'true' AND in_relevant = 'true') AS relevant, count_if(in_all = 'true' AND in_relevant = 'true' AND coalesce(document_url, '') <> '') AS held FROM law_census GROUP BY 1")
def e23(s, d):
    stages = [("listed", F.lit(True)), ("selected", F.col("in_all") == "true"), ("relevant", F.col("in_relevant") == "true"), ("held", F.coalesce("document_url", F.lit("")) != "")]
    return aggregates.funnel(census(s, d), stages, ["economy"])


@query("e24_rank_of", "SELECT event_type, round(avg(CASE WHEN value < 20 THEN 1.0 WHEN value >= 20 THEN 0.0 END), 6) AS below, count(value) AS n FROM events GROUP BY 1")
def e24(s, d):
    return aggregates.rank_of(table(s, d, "events"), ["event_type"], "value", 20.0)


@query("e25_quantile_offsets", """WITH q AS (SELECT event_type, unnest([0.25, 0.5, 0.75]) AS p, unnest(quantile_cont(value, [0.25, 0.5, 0.75])) AS v FROM events GROUP BY 1), b AS (SELECT p, v FROM q WHERE event_type = 'view')
SELECT q.event_type, round(median(q.v - b.v), 6) AS shift FROM q JOIN b USING (p) GROUP BY 1""")
def e25(s, d):
    q = table(s, d, "events").groupBy("event_type").agg(F.percentile("value", [0.25, 0.5, 0.75]).alias("v")).select("event_type", F.posexplode("v").alias("p", "v"))
    b = q.where("event_type = 'view'").select("p", F.col("v").alias("b"))
    return q.join(b, "p").groupBy("event_type").agg(F.round(F.median(F.col("v") - F.col("b")), 6).alias("shift"))


@query("m05_vote", "WITH v AS (SELECT event_id, value > 10 AS a, value > 20 AS b, event_id % 3 = 0 AS c FROM events) SELECT event_id, CASE WHEN a IS NULL OR b IS NULL THEN 'error' WHEN a = b THEN 'agree' WHEN c IS NULL THEN 'error' WHEN c = a THEN 'tiebreak_upheld' ELSE 'tiebreak_overturned' END AS verdict FROM v")
def m05(s, d):
    return table(s, d, "events").select("event_id", aggregates.vote(F.col("value") > 10, F.col("value") > 20, F.col("event_id") % 3 == 0).alias("verdict"))


# F: windows and ordered state


@query("f01_select_cells", """WITH r AS (SELECT l_returnflag AS e, l_linestatus AS i, l_orderkey * 10 + l_linenumber AS pid, round(l_discount * 10, 6) AS score FROM lineitem), w AS (SELECT *, row_number() OVER (PARTITION BY e, i ORDER BY score DESC, pid) AS rank, sum(CASE WHEN score >= 0.95 THEN 1 ELSE 0 END) OVER (PARTITION BY e, i) AS t, count(*) OVER (PARTITION BY e, i) AS r FROM r)
SELECT e, i, pid, rank, CASE WHEN score >= 0.95 AND score >= 0.65 THEN 'direct' ELSE 'gray' END AS band, CASE WHEN r > least(3000, greatest(t, least(40, r))) AND least(3000, greatest(t, least(40, r))) = 3000 THEN 'max' WHEN t < 40 THEN CASE WHEN r < 40 THEN 'exhausted' ELSE 'min' END ELSE 'theta' END AS bound
FROM w WHERE rank <= least(3000, greatest(t, least(40, r)))""")
def f01(s, d):
    r = table(s, d, "lineitem").select(F.col("l_returnflag").alias("e"), F.col("l_linestatus").alias("i"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pid"), F.round(F.col("l_discount") * 10, 6).alias("score"))
    return ranking.select_cells(r, ["e", "i"], "score", "pid", F.lit(0.95), F.lit(40), F.lit(3000)).select("e", "i", "pid", "rank", "band", "bound")


@query("f04_fusion", """WITH a AS (SELECT o_orderpriority AS cell, o_custkey AS k, row_number() OVER (PARTITION BY o_orderpriority ORDER BY max(o_totalprice) DESC, o_custkey) AS rank FROM orders GROUP BY 1, 2), b AS (SELECT o_orderpriority AS cell, o_custkey AS k, row_number() OVER (PARTITION BY o_orderpriority ORDER BY count(*) DESC, o_custkey) AS rank FROM orders GROUP BY 1, 2)
SELECT cell, k, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score, count(*) AS legs FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY ALL""")
def f04(s, d):
    o = table(s, d, "orders").groupBy(F.col("o_orderpriority").alias("cell"), F.col("o_custkey").alias("k")).agg(F.max("o_totalprice").alias("m"), F.count(F.lit(1)).alias("n"))
    a, b = ranking.numbered(o, ["cell"], [F.desc("m"), F.col("k")]), ranking.numbered(o, ["cell"], [F.desc("n"), F.col("k")])
    return ranking.fuse([a, b], ["cell"], "k")


@query("f08_quota", "WITH r AS (SELECT economy, indicator_id, record_id, row_number() OVER (PARTITION BY economy, indicator_id ORDER BY filed_at, record_id) AS round FROM records_la WHERE economy IS NOT NULL AND indicator_id IS NOT NULL) SELECT economy, indicator_id, record_id, round FROM r ORDER BY round, economy, indicator_id LIMIT 100")
def f08(s, d):
    r = records(s, d).where("economy IS NOT NULL AND indicator_id IS NOT NULL").select("economy", "indicator_id", "record_id", "filed_at")
    return ranking.fill_quota(r, ["economy", "indicator_id"], [F.col("filed_at"), F.col("record_id")], 100).select("economy", "indicator_id", "record_id", "round")


@query("f09_widest_run", """WITH e AS (SELECT user_id, event_id, value, CASE WHEN value < lag(value) OVER (PARTITION BY user_id ORDER BY event_id) THEN 1 ELSE 0 END AS brk FROM events), r AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM e), s AS (SELECT user_id, run, min(event_id) AS "start", max(event_id) AS "end", count(*) AS rows FROM r GROUP BY ALL)
SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY "end" - "start" DESC, run) = 1""")
def f09(s, d):
    return ranking.widest_run(table(s, d, "events"), ["user_id"], "event_id", "value")


@query("f18_history", """WITH e AS (SELECT portal_id, economy, delivered_at, compilation_number AS version, row_id, row_number() OVER (PARTITION BY economy, portal_id ORDER BY delivered_at, row_id) AS n FROM law_census), o AS (SELECT economy, portal_id, n AS pos, version, lag(version) OVER (PARTITION BY economy, portal_id ORDER BY n) AS p FROM e), c AS (SELECT * FROM o WHERE pos = 1 OR p IS DISTINCT FROM version)
SELECT economy, portal_id, version, pos AS valid_from, lead(pos) OVER (PARTITION BY economy, portal_id ORDER BY pos) AS valid_to, row_number() OVER (PARTITION BY economy, portal_id ORDER BY pos) AS seq FROM c""")
def f18(s, d):
    e = ranking.ranked(census(s, d).select("economy", "portal_id", "delivered_at", "compilation_number", "row_id"), ["economy", "portal_id"], [F.col("delivered_at"), F.col("row_id")], "at")
    return changes.history(e.withColumn("at", F.col("at").cast("bigint")), ["economy", "portal_id"], "at", F.col("compilation_number"))


@query("f19_ordinals", "SELECT gloss_id, CASE WHEN n > 1 THEN article_section || '~' || n ELSE article_section END AS citation FROM (SELECT gloss_id, article_section, row_number() OVER (PARTITION BY law_name, article_section ORDER BY gloss_id) AS n FROM gloss_tl)")
def f19(s, d):
    return ranking.ordinals(gloss(s, d), ["law_name"], [F.col("gloss_id")], "article_section", "citation").select("gloss_id", "citation")


@query("f20_latest", "SELECT url, status, outcome FROM (SELECT url, status, outcome, ts FROM crawl_log) QUALIFY row_number() OVER (PARTITION BY url ORDER BY ts DESC NULLS LAST, status DESC NULLS LAST, outcome DESC NULLS LAST) = 1")
def f20(s, d):
    return ranking.latest(crawl(s, d).select("url", "ts", "status", "outcome"), ["url"], ["ts"]).select("url", "status", "outcome")


SQL["f20_latest"] = "SELECT url, status, outcome FROM (SELECT DISTINCT url, status, outcome, ts FROM crawl_log) QUALIFY row_number() OVER (PARTITION BY url ORDER BY ts DESC NULLS LAST, status DESC NULLS LAST, outcome DESC NULLS LAST) = 1"


@query("f20_tombstones", "WITH l AS (SELECT host, outcome FROM (SELECT DISTINCT host, ts, outcome, url FROM crawl_log) QUALIFY row_number() OVER (PARTITION BY host, url ORDER BY ts DESC NULLS LAST, outcome DESC NULLS LAST) = 1) SELECT host, count(*) AS live FROM l WHERE coalesce(outcome <> 'blocked', true) GROUP BY 1")
def f20t(s, d):
    return ranking.latest(crawl(s, d).select("host", "url", "ts", "outcome"), ["host", "url"], ["ts"], F.col("outcome") == "blocked").groupBy("host").agg(F.count(F.lit(1)).alias("live"))


_SEEN = "(SELECT DISTINCT host, ts, url, outcome FROM crawl_log)"


def _seen(s, d):
    return crawl(s, d).select("host", "ts", "url", "outcome").distinct()


@query("f29_streaks", f"""WITH m AS (SELECT host, ts, url, coalesce(outcome <> 'ok', false) AS bad, sum(CASE WHEN coalesce(outcome <> 'ok', false) THEN 0 ELSE 1 END) OVER (PARTITION BY host ORDER BY ts, url, outcome ROWS UNBOUNDED PRECEDING)::BIGINT AS streak FROM {_SEEN} WHERE host IS NOT NULL)
SELECT host, streak, min(ts) AS "from", max(ts) AS until, count(*) AS length FROM m WHERE bad GROUP BY ALL HAVING count(*) >= 3""")
def f29(s, d):
    return ranking.streaks(_seen(s, d).where("host IS NOT NULL"), ["host"], ["ts", "url", "outcome"], F.col("outcome") != "ok", 3)


SQL["f29_streaks"] = SQL["f29_streaks"].replace("ORDER BY ts, url, outcome", "ORDER BY ts NULLS FIRST, url NULLS FIRST, outcome NULLS FIRST")


@query("f29_sliding_mix", f"SELECT host, ts, url, outcome, count(*) OVER w AS seen, round(avg(CASE WHEN outcome = 'ok' THEN 0.0 ELSE 1.0 END) OVER w, 6) AS share FROM {_SEEN} WINDOW w AS (PARTITION BY host ORDER BY ts NULLS FIRST, url NULLS FIRST, outcome NULLS FIRST ROWS 39 PRECEDING)")
def f29m(s, d):
    return ranking.sliding_mix(_seen(s, d), ["host"], ["ts", "url", "outcome"], "outcome")


@query("f30_spacing", "WITH g AS (SELECT event_id, user_id, round((epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts))) / 1e6, 6) AS gap FROM events) SELECT event_id, user_id, gap FROM g WHERE gap < 600")
def f30(s, d):
    return ranking.spacing(table(s, d, "events"), ["user_id"], "ts", 600).select("event_id", "user_id", "gap")


# G: retrieval, order, chunks


def _terms_sql(c: str) -> str:
    stem = "x"
    for before, ending, stays in retrieval.ENDINGS:
        stem = f"regexp_replace({stem}, '([{before}]){ending}$', '\\1{stays}')"
    words = f"list_filter(list_transform(regexp_extract_all(lower({c}), '[{retrieval.WORD}]+|[一-鿿]'), lambda x: {stem}), lambda x: x NOT IN ({', '.join(repr(w) for w in retrieval.STOP)}))"
    pairs = f"flatten(list_transform(regexp_extract_all(lower({c}), '[{retrieval.UNSPACED}]+'), lambda r: list_transform(range(1, length(r)), lambda i: substr(r, i::INT, 2))))"
    return f"list_concat({words}, {pairs})"


@query("g01_bm25", f"""WITH b AS (SELECT doc_id, {_terms_sql('text')} AS t FROM documents), l AS (SELECT doc_id, t, len(t) AS len FROM b WHERE len(t) > 0), st AS (SELECT count(*) AS n, avg(len) AS avg FROM l), q AS (SELECT item_id AS query_id, unnest(list_distinct({_terms_sql('text')})) AS term FROM gold_items),
tf AS (SELECT doc_id, len, term, count(*) AS tf FROM (SELECT doc_id, len, unnest(t) AS term FROM l) WHERE term IN (SELECT term FROM q) GROUP BY ALL), i AS (SELECT term, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf, st GROUP BY term, n),
sc AS (SELECT query_id, doc_id, round(sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avg))), 6) AS score FROM tf JOIN i USING (term) JOIN q USING (term), st GROUP BY ALL)
SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sc QUALIFY rank <= 10""")
def g01(s, d):
    return retrieval.bm25(documents(s, d), "doc_id", "text", table(s, d, "gold_items"), "item_id", "text", 10)


@query("d06_best_match", f"""WITH r AS (SELECT DISTINCT indicator_id, law_name, list_distinct({_terms_sql('law_name')}) AS a FROM records_la WHERE law_name IS NOT NULL), b AS (SELECT baseline_id, indicator_id, list_distinct({_terms_sql('law_name')}) AS b FROM baseline_la WHERE law_name IS NOT NULL), p AS (SELECT r.indicator_id, r.law_name, baseline_id, round(len(list_intersect(a, b)) / least(len(a), len(b)), 6) AS score FROM r JOIN b ON r.indicator_id IS NOT DISTINCT FROM b.indicator_id WHERE len(a) > 1 AND len(b) > 1)
SELECT x.record_id, p.baseline_id, p.score FROM records_la x JOIN (SELECT * FROM p WHERE score >= 0.85 QUALIFY row_number() OVER (PARTITION BY indicator_id, law_name ORDER BY score DESC, baseline_id) = 1) p ON x.indicator_id IS NOT DISTINCT FROM p.indicator_id AND x.law_name = p.law_name""")
def d06(s, d):
    terms = F.array_distinct(retrieval.terms(F.col("law_name")))
    words = F.get(F.filter(F.array(terms), lambda t: F.size(t) > 1), 0).alias("t")  # null for one word or none, with the terms found once
    r = records(s, d).select(F.struct("record_id", F.monotonically_increasing_id().alias("row")).alias("of"), "indicator_id", words)
    b = table(s, d, "baseline_la").select("baseline_id", "indicator_id", words)
    return joins.best_overlap(r, b, ["indicator_id"], "t", "of", "baseline_id", 0.85).select("of.record_id", "baseline_id", "score")


@query("g02_nearest", """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), p AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_dot_product(q.e, v.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(v.e, v.e))), 6) AS score FROM v JOIN v q ON q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id)
SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p QUALIFY rank <= 10""")
def g02(s, d):
    v = table(s, d, "embeddings")
    asked = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return retrieval.nearest(v, "vec_id", "embedding", asked, 10)


@query("g04_dotted_order", "SELECT indicator_id, row_number() OVER (ORDER BY list_transform(string_split(indicator_id, '.'), lambda x: x::INTEGER)) AS place FROM (SELECT DISTINCT indicator_id FROM records_la WHERE regexp_matches(indicator_id, '^[0-9.]+$'))")
def g04(s, d):
    ids = records(s, d).where("indicator_id RLIKE '^[0-9.]+$'").select("indicator_id").distinct()
    return ids.select("indicator_id", F.row_number().over(Window.orderBy(text.dotted_key(F.col("indicator_id")))).alias("place"))


@query("g09_chunks", "WITH s AS (SELECT doc_id, text, unnest(generate_series(0, greatest(length(text) - 150, 1) - 1, 1050)) AS start FROM documents WHERE length(text) > 0) SELECT doc_id, start::INTEGER AS start, md5(substr(text, (start + 1)::BIGINT, 1200)) AS body_md5 FROM s WHERE length(substr(text, (start + 1)::BIGINT, 1200)) >= 80")
def g09(s, d):
    return ranking.chunks(documents(s, d).select("doc_id", "text"), "text").select("doc_id", "start", F.md5("body").alias("body_md5"))


@query("g08_stratified")
def g08(s, d):
    return ranking.stratified(records(s, d).select("record_id", "discovery_tag"), F.lower(F.coalesce("discovery_tag", F.lit("none"))), {"new": 0.5, "known": 0.35, "none": 0.15}, 200, "record_id", 7).select("record_id", "stratum")


# H: sets


@query("h01_union", "SELECT 'la' AS t, record_id AS id, indicator_id AS indicator FROM records_la UNION ALL SELECT 'tl', gloss_id, indicator FROM gloss_tl")
def h01(s, d):
    return records(s, d).selectExpr("'la' AS t", "record_id AS id", "indicator_id AS indicator").unionByName(gloss(s, d).selectExpr("'tl' AS t", "gloss_id AS id", "indicator"))


@query("h02_except", "SELECT DISTINCT indicator FROM gold_items EXCEPT SELECT DISTINCT indicator_id FROM baseline_la")
def h02(s, d):
    return table(s, d, "gold_items").select("indicator").subtract(table(s, d, "baseline_la").select(F.col("indicator_id").alias("indicator")))


@query("h04_distinct_content", "SELECT sha256(text) AS sha, min(doc_id) AS doc_id FROM documents GROUP BY 1")
def h04(s, d):
    return ranking.first_wins(documents(s, d).select(F.sha2("text", 256).alias("sha"), "doc_id"), ["sha"], ["doc_id"])


@query("h05_failed_not_stored", "SELECT url, max(ts) AS last_failure FROM crawl_log WHERE outcome = 'failed' AND url NOT IN (SELECT url FROM crawl_log WHERE outcome = 'ok' AND url IS NOT NULL) GROUP BY 1")
def h05(s, d):
    c = crawl(s, d)
    return c.where("outcome = 'failed' AND url IS NOT NULL").join(c.where("outcome = 'ok'").select("url").distinct(), "url", "left_anti").groupBy("url").agg(F.max("ts").alias("last_failure"))


# I and J: functions


@query("i01_canonical_urls", r"""WITH u AS (SELECT record_id, regexp_replace(trim(source_url), '#.*$', '') AS b FROM records_la), p AS (SELECT record_id, lower(regexp_extract(b, '^([A-Za-z][A-Za-z0-9+.\-]*://[^/?]*)', 1)) AS h, regexp_replace(regexp_extract(b, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?]*([^?]*)', 1), '/+$', '') AS path, list_sort(list_filter(string_split(regexp_extract(b, '\?(.*)$', 1), '&'), lambda x: string_split(x, '=')[1] IN ('id', 'f', 'doc'))) AS q FROM u)
SELECT record_id, CASE WHEN h <> '' THEN h || path || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END END AS url FROM p""")
def i01(s, d):
    return records(s, d).select("record_id", urls.canonical_url(F.col("source_url")).alias("url"))


@query("i07_hosts", r"SELECT nullif(lower(regexp_extract(source_url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '') AS host, count(*) AS n FROM records_la GROUP BY 1")
def i07(s, d):
    return records(s, d).groupBy(urls.host(F.col("source_url")).alias("host")).agg(F.count(F.lit(1)).alias("n"))


@query("i03_slugs", "WITH x AS (SELECT doc_id, title, regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS s FROM documents) SELECT doc_id, CASE WHEN length(s) = 0 THEN 'x_' || substr(sha256(title), 1, 8) WHEN length(s) > 80 THEN substr(s, 1, 71) || '_' || substr(sha256(title), 1, 8) ELSE s END AS slug FROM x")
def i03(s, d):
    return documents(s, d).select("doc_id", text.slug(F.col("title")).alias("slug"))


@query("i16_tokens", r"SELECT baseline_id, list_sort(list_distinct(list_filter(string_split(trim(regexp_replace(regexp_replace(lower(law_name), '[^a-z0-9\s]', '', 'g'), '\s+', ' ', 'g')), ' '), lambda w: w <> '' AND w NOT IN ('a','an','and','act','by','for','in','law','of','on','or','the','to','with') AND NOT regexp_matches(w, '[0-9]')))) AS words FROM baseline_la")
def i16(s, d):
    return table(s, d, "baseline_la").select("baseline_id", F.array_sort(text.tokens(F.col("law_name"))).alias("words"))


@query("i22_citation_roots", "SELECT record_id, nullif(upper(regexp_extract(article_section, '([0-9]+[A-Za-z]*)', 1)), '') AS root FROM records_la")
def i22(s, d):
    return records(s, d).select("record_id", text.citation_root(F.col("article_section")).alias("root"))


@query("i26_references", r"SELECT doc_id, list_sort(list_distinct(list_transform(regexp_extract_all(text, '(?i)\b(?:section|article|artigo|pasal|clause|regulation)\s+([0-9]+[A-Z]?)', 1), lambda x: upper(x)))) AS refs FROM documents")
def i26(s, d):
    return documents(s, d).select("doc_id", F.array_sort(text.references(F.col("text"))).alias("refs"))


@query("i32_act_numbers", r"SELECT row_id, CASE WHEN regexp_extract(title, '(?i)n\.?\s*[ºo°]?\.?\s*([0-9]+)\s*/\s*([0-9]{4})', 1) <> '' THEN regexp_extract(title, '(?i)n\.?\s*[ºo°]?\.?\s*([0-9]+)\s*/\s*([0-9]{4})', 1)::BIGINT || '/' || regexp_extract(title, '(?i)n\.?\s*[ºo°]?\.?\s*([0-9]+)\s*/\s*([0-9]{4})', 2) END AS number FROM law_census")
def i32(s, d):
    return census(s, d).select("row_id", text.act_number(F.col("title")).alias("number"))


@query("i36_context", "SELECT doc_id, substr(text, greatest(n_chars // 2 - 200, 0) + 1, n_chars // 2 - greatest(n_chars // 2 - 200, 0)) AS before, substr(text, n_chars // 2 + 1, 50) AS snippet FROM documents WHERE n_chars > 0")
def i36(s, d):
    at = F.floor(F.col("n_chars") / 2).cast("int")
    c = text.context(F.col("text"), at, at + 50)
    return documents(s, d).where("n_chars > 0").select("doc_id", c["before"].alias("before"), c["snippet"].alias("snippet"))


@query("i42_masked_lines", "SELECT regexp_replace(trim(line), '[0-9]+', '#', 'g') AS line, count(*) AS n FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) WHERE length(trim(line)) >= 1 GROUP BY 1 HAVING count(*) >= 3")
def i42_all(s, d):
    lines = documents(s, d).select(F.explode(F.split("text", "\n")).alias("l")).where(F.length(F.trim("l")) >= 1)
    return lines.groupBy(text.digit_mask(F.trim("l")).alias("line")).agg(F.count(F.lit(1)).alias("n")).where("n >= 3")


@query("i51_prefixed", "SELECT gloss_id, concat_ws(' ¦ ', law_name, article_section, economy) || ' :: ' || concat_ws(' ', indicator, original, english) AS body FROM gloss_tl")
def i51(s, d):
    return gloss(s, d).select("gloss_id", text.prefixed([F.col("law_name"), F.col("article_section"), F.col("economy")], F.col("indicator"), F.col("original"), F.col("english")).alias("body"))


@query("j01_dates")
def j01(s, d):
    return table(s, d, "baseline_la").select("baseline_id", dates.all_dates(F.concat_ws(" ", "law_number_ref", "law_date")).alias("dates"))


@query("j04_day_first", r"WITH x AS (SELECT baseline_id, regexp_extract(law_date, '^\s*([0-9]{1,2})[-/]([0-9]{1,2})[-/]([0-9]{4})\s*$', ['d', 'm', 'y']) AS r FROM baseline_la) SELECT baseline_id, CASE WHEN try_cast(r.m AS INTEGER) BETWEEN 1 AND 12 AND try_cast(r.d AS INTEGER) BETWEEN 1 AND 31 THEN format('{:04d}-{:02d}-{:02d}', try_cast(r.y AS INTEGER), try_cast(r.m AS INTEGER), try_cast(r.d AS INTEGER)) END AS iso FROM x")
def j04(s, d):
    return table(s, d, "baseline_la").select("baseline_id", dates.day_first(F.col("law_date")).alias("iso"))


@query("j14_economies", "SELECT record_id, CASE WHEN lower(trim(economy)) IN ('lao pdr', 'laos', 'la') THEN 'LA' WHEN upper(trim(economy)) IN ('AU', 'MY', 'SG', 'TL', 'CN') THEN upper(trim(economy)) END AS code FROM records_la")
def j14(s, d):
    return records(s, d).select("record_id", dates.economy_code(F.col("economy")).alias("code"))


# L and O: changes, census


def _listed(s, d, *cols):
    """One row per law and snapshot, by the rules of p3: the latest delivery holds; keys in upper case without white space around."""
    c = census(s, d).withColumn("portal_id", F.upper(F.regexp_replace("portal_id", r"(?U)^\s+|\s+$", ""))).where("length(portal_id) > 0 AND length(snapshot_date) > 0")
    return ranking.latest(c.select("economy", "portal_id", "snapshot_date", "delivered_at", "row_id", *cols), ["economy", "portal_id", "snapshot_date"], ["delivered_at", "row_id"]).drop("delivered_at", "row_id")


_LISTED = r"""WITH l AS (SELECT * FROM (SELECT * REPLACE (upper(regexp_replace(portal_id, '^\s+|\s+$', '', 'g')) AS portal_id) FROM law_census) WHERE length(portal_id) > 0 AND length(snapshot_date) > 0 QUALIFY row_number() OVER (PARTITION BY economy, portal_id, snapshot_date ORDER BY delivered_at DESC NULLS LAST, row_id DESC) = 1),
c AS (SELECT economy, snapshot_date, lag(snapshot_date) OVER (PARTITION BY economy ORDER BY snapshot_date) AS prev FROM (SELECT DISTINCT economy, snapshot_date FROM l)),
"""


@query("l06_listing_changes", _LISTED + r"""v AS (SELECT economy, portal_id, snapshot_date, title, nullif(regexp_replace(lower(regexp_replace(legal_status, '^\s+|\s+$', '', 'g')), '[_\-\s]+', ' ', 'g'), '') AS status FROM l),
n AS (SELECT v.* FROM v JOIN c ON v.economy IS NOT DISTINCT FROM c.economy AND v.snapshot_date = c.snapshot_date WHERE c.prev IS NOT NULL), o AS (SELECT v.* REPLACE (c.snapshot_date AS snapshot_date) FROM v JOIN c ON v.economy IS NOT DISTINCT FROM c.economy AND v.snapshot_date = c.prev)
SELECT coalesce(n.economy, o.economy) AS economy, coalesce(n.portal_id, o.portal_id) AS portal_id, coalesce(n.snapshot_date, o.snapshot_date) AS snapshot_date, CASE WHEN o.portal_id IS NULL THEN 'new' WHEN n.portal_id IS NULL THEN 'gone' ELSE 'changed' END AS change, CASE WHEN o.portal_id IS NULL OR n.portal_id IS NULL THEN [] ELSE list_filter([CASE WHEN o.title IS DISTINCT FROM n.title THEN 'title' END, CASE WHEN o.status IS DISTINCT FROM n.status THEN 'status' END], lambda x: x IS NOT NULL) END AS reasons
FROM o FULL JOIN n ON o.economy IS NOT DISTINCT FROM n.economy AND o.portal_id = n.portal_id AND o.snapshot_date = n.snapshot_date WHERE o.portal_id IS NULL OR n.portal_id IS NULL OR o.title IS DISTINCT FROM n.title OR o.status IS DISTINCT FROM n.status""")
def l06_all(s, d):
    old, new = changes.consecutive(_listed(s, d, "title", "legal_status"), "economy", "portal_id", "snapshot_date")
    return changes.listing_changes(old, new, "k", {"title": F.col("title"), "status": snapshots.loose_word(F.col("legal_status"))}).select("k.*", "change", "reasons")


@query("l05_moved", _LISTED + r"""u AS (SELECT economy, portal_id, snapshot_date, lower(regexp_replace(document_url, '[?#].*$', '')) AS u FROM l WHERE document_url <> ''),
m AS (SELECT economy, portal_id, snapshot_date, lag(u) OVER w AS was, u AS is_now FROM u WINDOW w AS (PARTITION BY economy, portal_id ORDER BY snapshot_date))
SELECT * FROM m WHERE was <> is_now""")
def l05_all(s, d):
    # an address is compared with the law's last stated one, so a snapshot without address or law hides no move
    u = _listed(s, d, "document_url").where("document_url <> ''").withColumn("is_now", F.lower(F.regexp_replace("document_url", "[?#].*$", "")))
    w = Window.partitionBy("economy", "portal_id").orderBy("snapshot_date")
    return u.select("economy", "portal_id", "snapshot_date", F.lag("is_now").over(w).alias("was"), "is_now").where("was <> is_now")


@query("l09_carried", _LISTED + """f AS (SELECT economy, portal_id, min(snapshot_date) AS since FROM l GROUP BY ALL), g AS (SELECT f.*, c.snapshot_date, c.prev FROM f JOIN c ON f.economy IS NOT DISTINCT FROM c.economy AND c.snapshot_date >= f.since),
j AS (SELECT g.*, l.portal_id IS NOT NULL AS listed, l.title, l.legal_status, coalesce(l.in_seed = 'true', false) OR g.snapshot_date = g.since AS holds FROM g LEFT JOIN l ON g.economy IS NOT DISTINCT FROM l.economy AND g.portal_id = l.portal_id AND g.snapshot_date = l.snapshot_date),
k AS (SELECT economy, portal_id, snapshot_date, prev, last_value(title IGNORE NULLS) OVER w AS title, last_value(CASE WHEN holds THEN {'s': legal_status} END IGNORE NULLS) OVER w AS state, CASE WHEN NOT listed THEN 'not listed' END AS carried FROM j WINDOW w AS (PARTITION BY economy, portal_id ORDER BY snapshot_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT economy, portal_id, snapshot_date, title, state.s AS legal_status, carried FROM k WHERE prev IS NOT NULL""")
def l09_all(s, d):
    rows = _listed(s, d, "title", "legal_status", "in_seed")
    return changes.carried_over(rows, "economy", "portal_id", "snapshot_date", F.col("in_seed") == "true", ["legal_status"], "not listed").drop("in_seed")


@query("o12_fingerprints", _LISTED + "k AS (SELECT DISTINCT economy, snapshot_date, portal_id FROM l) SELECT economy, snapshot_date, md5(string_agg(portal_id, '|' ORDER BY portal_id)) AS fingerprint FROM k GROUP BY ALL")
def o12_all(s, d):
    return _listed(s, d).groupBy("economy", "snapshot_date").agg(F.md5(F.array_join(F.array_sort(F.collect_list("portal_id")), "|")).alias("fingerprint"))


@query("o01_stale", """WITH a AS (SELECT last_amending_instrument AS amending, max(published_on) AS amended FROM law_census WHERE coalesce(last_amending_instrument, '') <> '' AND coalesce(published_on, '') <> '' GROUP BY 1)
SELECT DISTINCT portal_id FROM law_census l JOIN a ON l.last_amending_instrument = a.amending WHERE l.published_on <> '' AND l.published_on < a.amended""")
def o01(s, d):
    c = census(s, d).where("coalesce(last_amending_instrument, '') <> '' AND coalesce(published_on, '') <> ''")
    # one instrument amends about a tenth of the laws: its latest date is a map-side maximum, not a self-join of its rows
    amended = c.groupBy("last_amending_instrument").agg(F.max("published_on").alias("amended"))
    return c.join(amended, "last_amending_instrument").where("published_on < amended").select("portal_id").distinct()


_YEAR = r"(?s)^(?:.*[^0-9])?((?:1[89]|20)[0-9]{2})(?:[^0-9]|$)"
_NUMBER_YEAR = "[/,] *((?:1[89]|20)[0-9]{2})$"
_LINKAGE = "(^|;)(amending_act|repealing_act|commencement_instrument)(;|$)"


@query("o07_prefix_amendments", _LISTED + f"""x AS (SELECT economy, unnest([last_amending_instrument, title]) AS amending FROM l),
a AS (SELECT DISTINCT economy, amending, upper(trim(regexp_extract(amending, '^(.+?) Amendment ', 1))) AS stem, try_cast(nullif(regexp_extract(amending, '{_YEAR}', 1), '') AS INTEGER) AS amended FROM x),
t AS (SELECT DISTINCT economy, portal_id, upper(trim(title)) AS law, try_cast(coalesce(nullif(regexp_extract(title, '{_YEAR}', 1), ''), nullif(regexp_extract(law_number, '{_NUMBER_YEAR}', 1), '')) AS INTEGER) AS dated FROM l WHERE title NOT LIKE '%Amendment%' AND NOT regexp_matches(coalesce(document_kinds, ''), '{_LINKAGE}')),
n AS (SELECT a.economy, portal_id, law, dated, amending, amended FROM a JOIN t ON a.economy IS NOT DISTINCT FROM t.economy AND length(stem) > 0 AND length(law) > 0 AND (starts_with(law, stem) OR starts_with(stem, law)) AND dated < amended QUALIFY row_number() OVER (PARTITION BY a.economy, amending ORDER BY dated DESC, portal_id DESC, law DESC) = 1)
SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY economy, portal_id ORDER BY amended DESC, amending DESC) = 1""")
def o07_all(s, d):
    year = lambda c, r: F.nullif(F.regexp_extract(c, r, 1), F.lit(""))
    c = _listed(s, d, "title", "law_number", "document_kinds", "last_amending_instrument")
    a = c.select("economy", F.explode(F.array("last_amending_instrument", "title")).alias("amending")).distinct()
    a = a.select("economy", "amending", F.upper(F.trim(F.regexp_extract("amending", "^(.+?) Amendment ", 1))).alias("stem"), year("amending", _YEAR).cast("int").alias("amended")).where("stem <> '' AND amended IS NOT NULL")
    laws = c.where(~F.col("title").contains("Amendment") & ~F.coalesce("document_kinds", F.lit("")).rlike(_LINKAGE))
    laws = laws.select("economy", "portal_id", F.upper(F.trim("title")).alias("law"), F.coalesce(year("title", _YEAR), year("law_number", _NUMBER_YEAR)).cast("int").alias("dated")).where("dated IS NOT NULL").distinct()
    # years are what both names state; a law of the amendment's own year isn't known to be the older
    pairs = joins.prefix_pairs(a, laws, "economy", "stem", "law").where("dated < amended").select("economy", "portal_id", "law", "dated", "amending", "amended")
    newest = ranking.latest(pairs, ["economy", "amending"], ["dated", "portal_id", "law"])
    return ranking.latest(newest, ["economy", "portal_id"], ["amended", "amending"])


@query("o14_staleness", "SELECT host, date_diff('day', max(ts)::DATE, DATE '2026-12-31') AS days, count(*) AS checks FROM crawl_log GROUP BY 1")
def o14(s, d):
    return crawl(s, d).groupBy("host").agg(F.datediff(F.lit("2026-12-31").cast("date"), F.max("ts").cast("date")).cast("bigint").alias("days"), F.count(F.lit(1)).alias("checks"))


@query("o30_sections", "SELECT record_id, coalesce(try_cast(nullif(regexp_extract(article_section, '([0-9]+)', 1), '') AS INTEGER), -1) AS number, upper(regexp_extract(article_section, '[0-9]+([A-Za-z]*)', 1)) AS letters FROM records_la WHERE article_section IS NOT NULL")
def o30(s, d):
    k = text.section_key(F.col("article_section"))
    return records(s, d).where("article_section IS NOT NULL").select("record_id", k["number"].alias("number"), k["letters"].alias("letters"))


@query("k09_batches", "SELECT record_id, ((row_number() OVER (PARTITION BY source_url ORDER BY record_id) - 1) // 20)::BIGINT AS batch FROM records_la")
def k09(s, d):
    n = ranking.numbered(records(s, d).select("record_id", "source_url"), ["source_url"], [F.col("record_id")], "n")
    return n.select("record_id", F.floor((F.col("n") - 1) / 20).alias("batch"))


# more joins and nested data


@query("d04_guarded_donor", """WITH donors AS (SELECT original, min(english) AS english FROM gloss_tl WHERE english IS NOT NULL GROUP BY 1)
SELECT gloss_id, coalesce(g.english, d.english) AS english, g.english IS NULL AND d.english IS NOT NULL AS borrowed FROM gloss_tl g LEFT JOIN donors d ON g.original = d.original""")
def d04(s, d):
    g = gloss(s, d).select("gloss_id", "original", "english")
    donors = g.where("english IS NOT NULL").groupBy("original").agg(F.min("english").alias("donor"))
    return g.join(donors, "original", "left").select("gloss_id", F.coalesce("english", "donor").alias("english"), (F.col("english").isNull() & F.col("donor").isNotNull()).alias("borrowed"))


@query("d12_greedy_groups")
def d12(s, d):
    names = table(s, d, "baseline_la").select("baseline_id", "indicator_id", text.tokens(F.col("law_name"), "pure").alias("words")).where("indicator_id IS NOT NULL")
    return segments.greedy_groups(names, "indicator_id", "baseline_id", "words").select("baseline_id", "group_key")


@query("d17_priority_link", """WITH a AS (SELECT law_number_ref, min(baseline_id) AS b1 FROM baseline_la WHERE coalesce(law_number_ref, '') NOT IN ('', 'n/a') GROUP BY 1 HAVING count(*) = 1), t AS (SELECT lower(law_name) AS k, min(baseline_id) AS b2 FROM baseline_la WHERE law_name IS NOT NULL GROUP BY 1 HAVING count(*) = 1)
SELECT record_id, coalesce(b1, b2) AS baseline_id, CASE WHEN b1 IS NOT NULL THEN 'number' WHEN b2 IS NOT NULL THEN 'title' END AS link_source FROM records_la r LEFT JOIN a USING (law_number_ref) LEFT JOIN t ON lower(r.law_name) = t.k""")
def d17(s, d):
    b = table(s, d, "baseline_la")
    one = lambda df, k, v: df.groupBy(k).agg(F.min("baseline_id").alias(v), F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")
    numbers = one(b.where("coalesce(law_number_ref, '') NOT IN ('', 'n/a')"), "law_number_ref", "b1")
    titles = one(b.where("law_name IS NOT NULL").withColumn("k", F.lower("law_name")), "k", "b2")
    r = records(s, d).select("record_id", "law_number_ref", F.lower("law_name").alias("k")).join(numbers, "law_number_ref", "left").join(titles, "k", "left")
    return r.select("record_id", F.coalesce("b1", "b2").alias("baseline_id"), F.when(F.col("b1").isNotNull(), "number").when(F.col("b2").isNotNull(), "title").alias("link_source"))


@query("e09_furniture", """WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10) || chr(10))) AS body, generate_subscripts(string_split(text, chr(10) || chr(10)), 1) AS page FROM documents), n AS (SELECT doc_id, count(*) AS n FROM p GROUP BY 1), l AS (SELECT DISTINCT doc_id, page, regexp_replace(trim(line, ' '), '[0-9]+', '#', 'g') AS line FROM (SELECT doc_id, page, unnest(string_split(body, chr(10))) AS line FROM p)), c AS (SELECT doc_id, line, count(*) AS pages FROM l WHERE length(line) > 0 GROUP BY ALL)
SELECT doc_id, line, pages FROM c JOIN n USING (doc_id) WHERE pages >= greatest(3, floor(n * 0.3))""")
def e09(s, d):
    p = documents(s, d).select("doc_id", F.posexplode(F.split("text", "\n\n")).alias("page", "body"))
    return aggregates.furniture(p, "doc_id", "page", "body")


@query("f21_corrected", "SELECT record_id, law_name, CASE WHEN lower(trim(discovery_tag)) = 'known' THEN '0.0' ELSE indicator_id END AS indicator_id FROM records_la WHERE coalesce(confidence <> '0.6', true)")
def f21(s, d):
    # decisions as a reviewer might log them: doubtful rows rejected, known ones given another indicator
    r = records(s, d)
    reject, known = F.col("confidence") == "0.6", F.lower(F.trim("discovery_tag")) == "known"
    said = r.where(reject | known).select("record_id", F.when(reject, "reject").otherwise("correct").alias("verdict"), F.when(known, F.create_map(F.lit("indicator_id"), F.lit("0.0"))).alias("corrections"))
    return changes.corrected(r.select("record_id", "law_name", "indicator_id"), said, "record_id", "verdict", "corrections", ["law_name", "indicator_id"])


@query("g07_cap_and_rest", "SELECT row_id, row_number() OVER (PARTITION BY economy, snapshot_date ORDER BY coalesce(in_seed = 'true', false) DESC, coalesce(in_relevant = 'true', false) DESC, published_on DESC NULLS LAST, row_id) <= 50 AS taken FROM law_census")
def g07(s, d):
    yes = lambda c: F.coalesce(F.col(c) == "true", F.lit(False)).desc()
    r = ranking.ranked(census(s, d), ["economy", "snapshot_date"], [yes("in_seed"), yes("in_relevant"), F.desc_nulls_last("published_on"), F.col("row_id")], "n")
    return r.select("row_id", (F.col("n") <= 50).alias("taken"))


_SPACE = r"[\s\x0b\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


@query("i14_plain_text", rf"""WITH t AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '(?is)<script\b.*?</script\s*>', ' ', 'g'), '(?is)<style\b.*?</style\s*>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g') AS t FROM documents), e AS (SELECT doc_id, replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&') AS t FROM t)
SELECT doc_id, md5(regexp_replace(regexp_replace(t, '{_SPACE}+', ' ', 'g'), '^ | $', '', 'g')) AS body FROM e""")
def i14(s, d):
    return documents(s, d).select("doc_id", F.md5(text.strip_tags(F.col("text"))).alias("body"))


@query("i21_overlap", """WITH p AS (SELECT b.baseline_id, list_distinct(string_split(lower(b.law_name), ' ')) AS x, list_distinct(string_split(lower(r.law_name), ' ')) AS y, r.record_id FROM baseline_la b JOIN records_la r ON b.law_number_ref = r.law_number_ref WHERE coalesce(b.law_number_ref, '') NOT IN ('', 'n/a') AND b.law_name IS NOT NULL AND r.law_name IS NOT NULL)
SELECT baseline_id, record_id, round(len(list_intersect(x, y)) / least(len(x), len(y)), 6) AS score FROM p""")
def i21(s, d):
    words = lambda c: F.array_distinct(F.split(F.lower(c), " "))
    b = table(s, d, "baseline_la").where("coalesce(law_number_ref, '') NOT IN ('', 'n/a') AND law_name IS NOT NULL").select("baseline_id", "law_number_ref", words("law_name").alias("x"))
    r = records(s, d).where("law_name IS NOT NULL").select("record_id", "law_number_ref", words("law_name").alias("y"))
    return b.join(r, "law_number_ref").select("baseline_id", "record_id", F.round(text.overlap(F.col("x"), F.col("y")), 6).alias("score"))


@query("i39_anchored")
def i39(s, d):
    g = gloss(s, d).select("gloss_id", "original", F.upper(F.substring(F.regexp_replace("original", " ", "  "), 10, 60)).alias("quote"))
    return segments.anchored(g, "quote", "original").select("gloss_id", "grounded", "how", "start", "end")


@query("j12_language_codes", """SELECT doc_id, CASE lower(trim(lang)) WHEN 'en' THEN 'eng' WHEN 'pt' THEN 'por' WHEN 'zh' THEN 'zho' WHEN 'lo' THEN 'lao' WHEN 'id' THEN 'ind' END AS code FROM documents""")
def j12(s, d):
    return documents(s, d).select("doc_id", dates.language_code(F.col("lang")).alias("code"))


@query("j18_script_counts", "SELECT doc_id, len(regexp_extract_all(text, '[\\x{4e00}-\\x{9fff}]')) AS han, len(regexp_extract_all(text, '[\\x{0e80}-\\x{0eff}]')) AS lao, len(regexp_extract_all(text, '[A-Za-z]')) AS latin FROM documents")
def j18(s, d):
    n = lambda p: F.regexp_count("text", F.lit(p)).cast("bigint")
    return documents(s, d).select("doc_id", n("[\\u4e00-\\u9fff]").alias("han"), n("[\\u0e80-\\u0eff]").alias("lao"), n("[A-Za-z]").alias("latin"))


@query("k10_bin_pack")
def k10(s, d):
    rows = table(s, d, "records_cn").select("law_row_id", F.posexplode("provisions").alias("pos", "p")).select("law_row_id", "pos", "p.record_id", F.coalesce(F.length("p.verbatim_snippet"), F.lit(0)).alias("size"))
    return ranking.bin_pack(rows, "law_row_id", "pos", "size", 300, 5).select("record_id", "batch")


@query("o10_membership", "SELECT portal_id, bool_or(in_seed = 'true') AS in_seed, bool_or(in_relevant = 'true') AS in_relevant, coalesce(list_sort(list_distinct(flatten(list(string_split(document_kinds, ';')) FILTER (document_kinds IS NOT NULL)))), []) AS kinds FROM law_census GROUP BY 1")
def o10(s, d):
    kinds = F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.split("document_kinds", ";")))))
    return census(s, d).groupBy("portal_id").agg(F.bool_or(F.col("in_seed") == "true").alias("in_seed"), F.bool_or(F.col("in_relevant") == "true").alias("in_relevant"), kinds.alias("kinds"))


@query("o57_url_references", "SELECT source_url, count(*) AS refs, min(record_id) AS first, max(record_id) AS last, count(DISTINCT indicator_id) AS indicators FROM records_la WHERE source_url LIKE 'http%' GROUP BY 1")
def o57(s, d):
    # a count and the ends instead of the list of references: one address holds a tenth of the rows
    return records(s, d).where("source_url LIKE 'http%'").groupBy("source_url").agg(F.count(F.lit(1)).alias("refs"), F.min("record_id").alias("first"), F.max("record_id").alias("last"), F.countDistinct("indicator_id").alias("indicators"))


@query("e05_weighted_sum", "SELECT o_orderpriority, round(sum(l_extendedprice * (1 - l_discount)) / 1e6, 4) AS volume, count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def e05(s, d):
    o, li = table(s, d, "orders"), table(s, d, "lineitem")
    return o.join(li, o.o_orderkey == li.l_orderkey).groupBy("o_orderpriority").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))) / 1e6, 4).alias("volume"), F.count(F.lit(1)).alias("n"))


@query("e02_max_roll_up", "WITH per AS (SELECT n_name, c_custkey, max(o_totalprice) AS best FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL) SELECT n_name, max(best) AS best, count(*) AS groups, count_if(best > 300000) AS counted FROM per GROUP BY 1")
def e02(s, d):
    o, c, n = table(s, d, "orders"), table(s, d, "customer"), table(s, d, "nation")
    per = o.groupBy("o_custkey").agg(F.max("o_totalprice").alias("best")).join(c, F.col("o_custkey") == c.c_custkey).join(F.broadcast(n), c.c_nationkey == n.n_nationkey)
    return per.groupBy("n_name").agg(F.max("best").alias("best"), F.count(F.lit(1)).alias("groups"), F.count_if(F.col("best") > 300000).alias("counted"))


@query("d22_semi", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def d22(s, d):
    return table(s, d, "customer").join(table(s, d, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi").select("c_custkey")
