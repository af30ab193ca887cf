"""Queries of predicates, joins, aggregates, orders and differences over whole tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions import dates, text, urls
from quillspark.operators import aggregates, changes, joins, ranking, snapshots
from quillspark.session import broadcast_if_small, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
C = F.col


def query(name: str, sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name], SQL[name] = f, sql
        return f

    return add


def _t(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda s, d: table(s, d, name)


documents, records, gloss, census, crawl, baseline, gold = (_t(n) for n in ("documents", "records_la", "gloss_tl", "law_census", "crawl_log", "baseline_la", "gold_items"))
STATUS = "regexp_replace(lower(trim(legal_status)), '[_ -]+', '_', 'g')"


def _status():
    return F.regexp_replace(F.lower(F.trim("legal_status")), "[_ -]+", "_")


# C: predicates and decisions


@query("c02_scope_filter", "SELECT record_id FROM records_la WHERE indicator_id IN (SELECT indicator FROM gold_items WHERE economy = 'AU')")
def c02(s, d):
    return records(s, d).join(broadcast_if_small(gold(s, d).where("economy = 'AU'").select(C("indicator").alias("indicator_id")).distinct()), "indicator_id", "left_semi").select("record_id")


@query("c03_ordered_decision", f"SELECT row_id, CASE WHEN contains(title, 'Amendment') THEN 'exclude: amendment' WHEN NOT coalesce(contains(document_kinds, 'principal'), false) THEN 'wrong instrument' WHEN {STATUS} = 'repealed' THEN 'repealed' WHEN coalesce(document_url, '') = '' THEN 'skip: linkage' ELSE 'read' END AS decision FROM law_census")
def c03(s, d):
    decision = F.when(C("title").contains("Amendment"), "exclude: amendment").when(~F.coalesce(C("document_kinds").contains("principal"), F.lit(False)), "wrong instrument").when(_status() == "repealed", "repealed").when(F.coalesce("document_url", F.lit("")) == "", "skip: linkage").otherwise("read")
    return census(s, d).select("row_id", decision.alias("decision"))


@query("c04_only_repealed", f"SELECT economy, portal_id, coalesce(count({STATUS}) > 0 AND bool_and({STATUS} = 'repealed'), false) AS repealed FROM law_census GROUP BY ALL")
def c04(s, d):
    st = _status()
    return census(s, d).groupBy("economy", "portal_id").agg(F.coalesce((F.count(st) > 0) & F.bool_and(st == "repealed"), F.lit(False)).alias("repealed"))


_RULES = [("page", "text/html", "fits"), ("page", "application/pdf", "mislabelled"), ("file", "application/pdf", "fits"), ("file", "text/html", "error page")]


@query("c08_verdict_table", f"WITH k AS (SELECT url, ts, CASE WHEN retrieval_method = 'browser' THEN 'page' WHEN retrieval_method IS NOT NULL THEN 'file' END AS claimed, content_type FROM crawl_log), r AS (SELECT * FROM (VALUES {', '.join(map(str, _RULES))}) AS v(claimed, content_type, verdict)) SELECT url, ts, coalesce(verdict, 'unknown') AS verdict FROM k LEFT JOIN r USING (claimed, content_type)")
def c08(s, d):
    claimed = F.when(C("retrieval_method") == "browser", "page").when(C("retrieval_method").isNotNull(), "file")
    rules = F.broadcast(s.createDataFrame(_RULES, "claimed string, content_type string, verdict string"))
    return crawl(s, d).select("url", "ts", claimed.alias("claimed"), "content_type").join(rules, ["claimed", "content_type"], "left").select("url", "ts", F.coalesce("verdict", F.lit("unknown")).alias("verdict"))


@query("c11_reject_reasons", "SELECT CASE WHEN coalesce(verbatim_snippet, '') = '' THEN 'ungrounded' WHEN coalesce(contains(notes, 'repealed'), false) THEN 'not_in_force' WHEN indicator_id IN ('6.1', '7.1') AND discovery_tag = 'KNOWN' THEN 'known_only' END AS reason, count(*) AS n FROM records_la GROUP BY 1")
def c11(s, d):
    reason = F.when(F.coalesce("verbatim_snippet", F.lit("")) == "", "ungrounded").when(F.coalesce(C("notes").contains("repealed"), F.lit(False)), "not_in_force").when(C("indicator_id").isin("6.1", "7.1") & (C("discovery_tag") == "KNOWN"), "known_only")
    return records(s, d).groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("c12_note_buckets", r"WITH a AS (SELECT gloss_id, string_split(provision_id, '#')[1] AS doc, try_cast(nullif(regexp_extract(provision_id, '#a([0-9]+)#', 1), '') AS INT) AS act FROM gloss_tl), n AS (SELECT doc, max(act) AS acts FROM a GROUP BY 1) SELECT gloss_id, CASE WHEN coalesce(acts, 1) <= 1 THEN 'none' WHEN act IS NULL THEN 'act_unknown' WHEN act = 1 THEN 'first_act' ELSE 'later_act' END AS bucket FROM a LEFT JOIN n USING (doc)")
def c12(s, d):
    a = gloss(s, d).select("gloss_id", F.split("provision_id", "#")[0].alias("doc"), F.expr("try_cast(nullif(regexp_extract(provision_id, '#a([0-9]+)#', 1), '') AS int)").alias("act"))
    n = a.groupBy("doc").agg(F.max("act").alias("acts"))
    return a.join(n, "doc", "left").select("gloss_id", F.when(F.coalesce("acts", F.lit(1)) <= 1, "none").when(C("act").isNull(), "act_unknown").when(C("act") == 1, "first_act").otherwise("later_act").alias("bucket"))


@query("c14_absence_scores", "SELECT record_id, CASE WHEN confidence IS NULL THEN '0' WHEN trim(confidence) = '' THEN 'unscored' ELSE trim(confidence) END AS score FROM records_la")
def c14(s, d):
    return records(s, d).select("record_id", F.when(C("confidence").isNull(), "0").when(F.trim("confidence") == "", "unscored").otherwise(F.trim("confidence")).alias("score"))


@query("c15_coverage_classes", "WITH n AS (SELECT indicator_id, count(*) AS n FROM baseline_la GROUP BY 1) SELECT record_id, CASE WHEN indicator_id IS NULL THEN 'EXCLUDED' WHEN n.n >= 250 THEN 'AUTOMATED' WHEN n.n > 0 THEN 'AUTOMATED partial' ELSE 'MANUAL' END AS coverage FROM records_la LEFT JOIN n USING (indicator_id)")
def c15(s, d):
    n = baseline(s, d).groupBy("indicator_id").agg(F.count(F.lit(1)).alias("n"))
    return records(s, d).select("record_id", "indicator_id").join(broadcast_if_small(n), "indicator_id", "left").select("record_id", F.when(C("indicator_id").isNull(), "EXCLUDED").when(C("n") >= 250, "AUTOMATED").when(C("n") > 0, "AUTOMATED partial").otherwise("MANUAL").alias("coverage"))


@query("c16_label_filter", "SELECT gloss_id, CASE WHEN coalesce(language_of_source, 'und') = 'und' THEN 'suspect' WHEN model = 'gloss-small' THEN 'review' END AS flag FROM gloss_tl")
def c16(s, d):
    return gloss(s, d).select("gloss_id", F.when(F.coalesce("language_of_source", F.lit("und")) == "und", "suspect").when(C("model") == "gloss-small", "review").alias("flag"))


@query("c18_tiers", "SELECT economy, portal_id, CASE WHEN bool_or(in_seed = 'true') THEN 'core' WHEN bool_or(in_relevant = 'true') THEN 'sectoral' END AS tier FROM law_census GROUP BY ALL")
def c18(s, d):
    any_ = lambda c: F.bool_or(C(c) == "true")
    return census(s, d).groupBy("economy", "portal_id").agg(F.when(any_("in_seed"), "core").when(any_("in_relevant"), "sectoral").alias("tier"))


@query("c19_bigrams", "WITH w AS (SELECT row_id, list_filter(regexp_split_to_array(lower(title), '[^a-z]+'), lambda x: length(x) > 2 AND x NOT IN ('the', 'and', 'act', 'for')) AS w FROM law_census), b AS (SELECT unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS phrase FROM w) SELECT phrase, count(*) AS n FROM b GROUP BY 1")
def c19(s, d):
    w = census(s, d).select(F.filter(F.split(F.lower("title"), "[^a-z]+"), lambda x: (F.length(x) > 2) & ~x.isin("the", "and", "act", "for")).alias("w")).where(F.size("w") > 1)
    phrase = F.explode(F.zip_with(F.slice("w", F.lit(1), F.size("w") - 1), F.slice("w", F.lit(2), F.size("w") - 1), lambda a, b: F.concat_ws(" ", a, b)))
    return w.select(phrase.alias("phrase")).groupBy("phrase").agg(F.count(F.lit(1)).alias("n"))


_ROBOTS = [("/doc/", False), ("/doc/0/", True), ("/api/", False), ("/", True)]


@query("c20_longest_pattern", f"WITH p AS (SELECT DISTINCT url, regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)', 1) AS path FROM crawl_log), r AS (SELECT * FROM (VALUES {', '.join(map(str, _ROBOTS))}) AS v(pattern, allow)), m AS (SELECT url, arg_max(allow, length(pattern) * 2 + allow::INT) AS allow FROM p JOIN r ON starts_with(path, pattern) GROUP BY 1) SELECT p.url, coalesce(allow, true) AS allowed FROM p LEFT JOIN m ON p.url IS NOT DISTINCT FROM m.url")
def c20(s, d):
    # the rules are a fixed list, so the longest one that fits is an expression
    path = F.regexp_extract("url", "^[a-z]+://[^/]+(/[^?#]*)", 1)
    fits = [F.when(path.startswith(p), F.struct(F.lit(len(p)).alias("n"), F.lit(a).alias("allow"))) for p, a in _ROBOTS]
    return crawl(s, d).select("url").distinct().select("url", F.coalesce(F.greatest(*fits)["allow"], F.lit(True)).alias("allowed"))


@query("c21_in_scope", "WITH b AS (SELECT DISTINCT law_number FROM law_census WHERE in_seed = 'true' AND law_number <> '') SELECT row_id, CASE WHEN series = 'gazette' THEN false WHEN law_number IN (SELECT law_number FROM b) THEN true ELSE coalesce(series IN ('C', 'act'), false) END AS in_scope FROM law_census WHERE law_number IS NOT NULL OR series IS NULL OR series <> 'none'")
def c21(s, d):
    seeds = census(s, d).where("in_seed = 'true' AND law_number <> ''").select("law_number").distinct().withColumn("seeded", F.lit(True))
    c = census(s, d).where("law_number IS NOT NULL OR series IS NULL OR series <> 'none'").join(broadcast_if_small(seeds), "law_number", "left")
    return c.select("row_id", F.when(C("series") == "gazette", False).when(C("seeded"), True).otherwise(F.coalesce(C("series").isin("C", "act"), F.lit(False))).alias("in_scope"))


@query("c23_dated_status", f"SELECT row_id, CASE WHEN {STATUS} IN ('repealed', 'ceased') THEN 'dead' WHEN published_on > snapshot_date THEN 'future' WHEN {STATUS} = 'in_force' THEN 'live' ELSE 'unknown' END AS status FROM law_census")
def c23(s, d):
    return census(s, d).select("row_id", F.when(_status().isin("repealed", "ceased"), "dead").when(C("published_on") > C("snapshot_date"), "future").when(_status() == "in_force", "live").otherwise("unknown").alias("status"))


@query("c25_triage", f"WITH n AS (SELECT economy, title, max(snapshot_date) AS newest FROM law_census GROUP BY ALL) SELECT row_id, CASE WHEN {STATUS} = 'superseded' OR c.snapshot_date < newest THEN 'superseded' WHEN coalesce(document_url, '') <> '' THEN 'held' WHEN in_relevant = 'true' THEN 'relevant' WHEN in_all = 'true' THEN 'borderline' ELSE 'skip' END AS triage FROM law_census c JOIN n ON c.economy IS NOT DISTINCT FROM n.economy AND c.title IS NOT DISTINCT FROM n.title")
def c25(s, d):
    c = census(s, d)
    newest = c.groupBy(C("economy").alias("e_"), C("title").alias("t_")).agg(F.max("snapshot_date").alias("newest"))
    j = c.join(newest, C("economy").eqNullSafe(C("e_")) & C("title").eqNullSafe(C("t_")))
    triage = F.when((_status() == "superseded") | (C("snapshot_date") < C("newest")), "superseded").when(F.coalesce("document_url", F.lit("")) != "", "held").when(C("in_relevant") == "true", "relevant").when(C("in_all") == "true", "borderline").otherwise("skip")
    return j.select("row_id", triage.alias("triage"))


# D: joins


@query("d02_enriched", "WITH b1 AS (SELECT law_name, law_number_ref, min(baseline_id) AS a FROM baseline_la WHERE law_name IS NOT NULL AND law_number_ref IS NOT NULL GROUP BY ALL), b2 AS (SELECT law_name, min(baseline_id) AS b FROM baseline_la WHERE law_name IS NOT NULL GROUP BY 1), b3 AS (SELECT source_url, min(baseline_id) AS c FROM baseline_la WHERE source_url IS NOT NULL GROUP BY 1) SELECT record_id, coalesce(a, b, c) AS baseline_id, CASE WHEN a IS NOT NULL THEN 0 WHEN b IS NOT NULL THEN 1 WHEN c IS NOT NULL THEN 2 END AS matched_on FROM records_la LEFT JOIN b1 USING (law_name, law_number_ref) LEFT JOIN b2 USING (law_name) LEFT JOIN b3 USING (source_url)")
def d02(s, d):
    r, b = records(s, d).select("record_id", "law_name", "law_number_ref", "source_url"), baseline(s, d).select("baseline_id", "law_name", "law_number_ref", "source_url")
    return joins.join_with_fallback(r, b, [["law_name", "law_number_ref"], ["law_name"], ["source_url"]], ["baseline_id"]).select("record_id", "baseline_id", "matched_on")


@query("d05_split_by_outcome", "WITH v AS (SELECT url, bool_or(outcome = 'ok') AS upheld FROM crawl_log WHERE url IS NOT NULL GROUP BY 1) SELECT c.row_id, CASE WHEN v.url IS NULL THEN 'unverified' WHEN coalesce(v.upheld, false) THEN 'upheld' ELSE 'rejected' END AS outcome FROM law_census c LEFT JOIN v ON c.document_url = v.url")
def d05(s, d):
    v = crawl(s, d).where("url IS NOT NULL").groupBy(C("url").alias("document_url")).agg(F.bool_or(C("outcome") == "ok").alias("upheld"), F.lit(True).alias("seen"))
    return census(s, d).select("row_id", "document_url").join(v, "document_url", "left").select("row_id", F.when(C("seen").isNull(), "unverified").when(F.coalesce("upheld", F.lit(False)), "upheld").otherwise("rejected").alias("outcome"))


@query("d11_fallback_chain", "WITH f AS (SELECT indicator_id, arg_min(law_name, baseline_id) FILTER (law_name IS NOT NULL) AS law, arg_min(source_url, baseline_id) FILTER (source_url IS NOT NULL) AS url FROM baseline_la GROUP BY 1) SELECT record_id, coalesce(nullif(trim(r.law_name), ''), f.law, f.url, 'nothing identified') AS citation FROM records_la r LEFT JOIN f USING (indicator_id)")
def d11(s, d):
    first = lambda c: F.min_by(c, F.when(C(c).isNotNull(), C("baseline_id")))
    f = baseline(s, d).groupBy("indicator_id").agg(first("law_name").alias("law"), first("source_url").alias("url"))
    return records(s, d).select("record_id", "indicator_id", "law_name").join(broadcast_if_small(f), "indicator_id", "left").select("record_id", F.coalesce(F.nullif(F.trim("law_name"), F.lit("")), "law", "url", F.lit("nothing identified")).alias("citation"))


@query("d13_within_spans", "WITH o AS (SELECT o_custkey AS k, o_orderkey, epoch(o_orderdate)::BIGINT AS a FROM orders) SELECT e.event_id, max(o.o_orderkey) AS last_order FROM events e JOIN o ON e.user_id = o.k AND e.event_id * 1000 + 700000000 >= o.a AND e.event_id * 1000 + 700000000 < o.a + 5000000 GROUP BY 1")
def d13(s, d):
    e = table(s, d, "events").select("event_id", C("user_id").alias("k"), (C("event_id") * 1000 + 700_000_000).alias("at"))
    o = table(s, d, "orders").select("o_orderkey", C("o_custkey").alias("k"), F.unix_seconds(C("o_orderdate").cast("timestamp")).alias("a")).withColumn("b", C("a") + 5_000_000)
    return joins.within(e, o, ["k"], "at", "a", "b", 5_000_000).groupBy("event_id").agg(F.max("o_orderkey").alias("last_order"))


_LEVELS = """WITH e AS (SELECT user_id, event_id, CASE WHEN event_type = 'signup' THEN event_id END AS part, CASE WHEN event_type = 'purchase' THEN event_id END AS division FROM events), p AS (SELECT *, max(part) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS p FROM e)"""


@query("d15_as_of_with_reset", _LEVELS + " SELECT event_id, p AS part, max(division) OVER (PARTITION BY user_id, p ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS division FROM p")
def d15(s, d):
    e = table(s, d, "events")
    on = lambda kind: F.when(C("event_type") == kind, C("event_id"))
    upto = lambda *keys: Window.partitionBy(*keys).orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    p = e.withColumn("part", F.max(on("signup")).over(upto("user_id")))
    return p.select("event_id", "part", F.max(on("purchase")).over(upto("user_id", "part")).alias("division"))


@query("d16_levels_as_of", _LEVELS.split(", p AS")[0] + " SELECT event_id, last_value(part IGNORE NULLS) OVER w AS part, last_value(division IGNORE NULLS) OVER w AS division FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)")
def d16(s, d):
    on = lambda kind: F.when(C("event_type") == kind, C("event_id"))
    e = table(s, d, "events").withColumns({"part": on("signup"), "division": on("purchase")})
    return ranking.forward_fill(e, ["user_id"], ["event_id"], ["part", "division"]).select("event_id", "part", "division")


@query("d25_longest_suffixes", "WITH h AS (SELECT url, ts, host FROM crawl_log) SELECT url, ts, CASE WHEN host = 'register.au.example' OR host LIKE '%.register.au.example' THEN 'register' WHEN host = 'au.example' OR host LIKE '%.au.example' THEN 'au' WHEN host = 'example' OR host LIKE '%.example' THEN 'any' ELSE 'none' END AS matched FROM h")
def d25(s, d):
    rules = s.createDataFrame([("example", "any"), ("au.example", "au"), ("register.au.example", "register")], "suffix string, matched string")
    c = crawl(s, d).select("url", "ts", F.concat(F.lit("https://"), C("host")).alias("at"))
    return joins.longest_suffix(c, "at", rules, "suffix", "matched", "none").select("url", "ts", "matched")


@query("d26_normalised_keys", "WITH g AS (SELECT DISTINCT regexp_replace(trim(indicator), '^0+', '') AS k, indicator FROM gold_items) SELECT g.k AS indicator, count(r.record_id) AS records FROM g LEFT JOIN records_la r ON regexp_replace(trim(r.indicator_id), '^0+', '') = g.k GROUP BY 1")
def d26(s, d):
    key = lambda c: F.regexp_replace(F.trim(c), "^0+", "")
    n = records(s, d).groupBy(key("indicator_id").alias("indicator")).agg(F.count("record_id").alias("records"))
    return gold(s, d).select(key("indicator").alias("indicator")).distinct().join(n, "indicator", "left").select("indicator", F.coalesce("records", F.lit(0)).alias("records"))


# E: aggregates

_SCORE = "CASE WHEN trim(confidence) LIKE '%\\%' ESCAPE '\\' THEN try_cast(replace(trim(confidence), '%', '') AS DOUBLE) / 100 ELSE try_cast(trim(confidence) AS DOUBLE) END"


def _confidence():
    c = F.trim("confidence")
    return F.when(c.endswith("%"), F.replace(c, F.lit("%"), F.lit("")).try_cast("double") / 100).otherwise(c.try_cast("double"))


@query("e03_count_rule", f"WITH b AS (SELECT indicator_id, law_name, max({_SCORE}) AS best FROM records_la GROUP BY ALL), n AS (SELECT indicator_id, count_if(best >= 0.7) AS laws, max(best) AS top FROM b GROUP BY 1) SELECT indicator_id, laws, greatest(coalesce(top, 0), CASE WHEN laws >= 20 THEN 1.0 WHEN laws >= 5 THEN 0.5 ELSE 0.0 END) AS score FROM n")
def e03(s, d):
    best = records(s, d).groupBy("indicator_id", "law_name").agg(F.max(_confidence()).alias("best"))
    n = best.groupBy("indicator_id").agg(F.count_if(C("best") >= 0.7).alias("laws"), F.max("best").alias("top"))
    counted = F.when(C("laws") >= 20, 1.0).when(C("laws") >= 5, 0.5).otherwise(0.0)
    return n.select("indicator_id", "laws", F.greatest(F.coalesce("top", F.lit(0.0)), counted).alias("score"))


@query("e03_capped_sum", f"WITH b AS (SELECT indicator_id, law_name, max({_SCORE}) AS best FROM records_la GROUP BY ALL) SELECT indicator_id, least(10.0, round(sum(best), 6)) AS score FROM b GROUP BY 1")
def e03_sum(s, d):
    best = records(s, d).groupBy("indicator_id", "law_name").agg(F.max(_confidence()).alias("best"))
    return best.groupBy("indicator_id").agg(F.least(F.lit(10.0), F.round(F.sum("best"), 6)).alias("score"))


@query("e04_evidence", "WITH r AS (SELECT indicator_id, record_id, trim(regexp_replace(verbatim_snippet, '[ \\t\\r\\n]+', ' ', 'g')) AS quote, row_number() OVER (PARTITION BY indicator_id ORDER BY record_id) AS n FROM records_la WHERE verbatim_snippet <> '') SELECT indicator_id, list(quote ORDER BY record_id) AS quotes FROM r WHERE n <= 40 GROUP BY 1")
def e04(s, d):
    r = records(s, d).where("verbatim_snippet <> ''").select("indicator_id", "record_id", F.trim(F.regexp_replace("verbatim_snippet", "[ \\t\\r\\n]+", " ")).alias("quote"))
    first = ranking.ranked(r, ["indicator_id"], [C("record_id")]).where("rank <= 40")  # the rank limit is pushed below the shuffle
    return first.groupBy("indicator_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("record_id", "quote"))), lambda x: x["quote"]).alias("quotes"))


@query("e11_grouped_counts", "SELECT outcome, note, count(*) AS n, grouping(outcome, note)::BIGINT AS level FROM crawl_log GROUP BY GROUPING SETS ((outcome), (note))")
def e11(s, d):
    return crawl(s, d).groupingSets([[C("outcome")], [C("note")]], "outcome", "note").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().cast("bigint").alias("level")).select("outcome", "note", "n", "level")


@query("e12_totals_by_language", "SELECT lang, count(*) AS docs, sum(n_chars)::BIGINT AS chars, grouping(lang)::BIGINT AS total FROM documents GROUP BY ROLLUP (lang)")
def e12(s, d):
    return documents(s, d).rollup("lang").agg(F.count(F.lit(1)).alias("docs"), F.sum("n_chars").alias("chars"), F.grouping("lang").cast("bigint").alias("total"))


@query("e15_merged_provisions", "SELECT law_name, law_number, source_url, count(*) AS arms, sum(len(provisions))::BIGINT AS provisions FROM records_cn GROUP BY ALL")
def e15(s, d):
    return table(s, d, "records_cn").groupBy("law_name", "law_number", "source_url").agg(F.count(F.lit(1)).alias("arms"), F.sum(F.when(C("provisions").isNotNull(), F.size("provisions")).cast("bigint")).alias("provisions"))


@query("e19_first_file_wins", "SELECT law_number_ref, arg_min(law_name, (round_no, baseline_id)) AS law_name FROM baseline_la WHERE law_number_ref IS NOT NULL AND law_name IS NOT NULL AND round_no IS NOT NULL GROUP BY 1")
def e19(s, d):
    b = baseline(s, d).where("law_number_ref IS NOT NULL AND law_name IS NOT NULL AND round_no IS NOT NULL")
    return b.groupBy("law_number_ref").agg(F.min_by("law_name", F.struct("round_no", "baseline_id")).alias("law_name"))


@query("e22_agreement", "SELECT model, count(*) AS n, round(avg(CASE WHEN is_literal THEN 1.0 ELSE 0.0 END), 6) AS literal, round(avg(CASE WHEN is_literal = machine_translation THEN 1.0 WHEN machine_translation IS NOT NULL THEN 0.0 END), 6) AS agreement, count_if(english IS NULL) AS missing FROM gloss_tl GROUP BY 1")
def e22(s, d):
    agree = F.when(C("is_literal") == C("machine_translation"), 1.0).when(C("machine_translation").isNotNull(), 0.0)
    return gloss(s, d).groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.when(C("is_literal"), 1.0).otherwise(0.0)), 6).alias("literal"), F.round(F.avg(agree), 6).alias("agreement"), F.count_if(C("english").isNull()).alias("missing"))


# F, G, H: orders and choices


@query("f07_composite_order", f"SELECT record_id, rank FROM (SELECT record_id, row_number() OVER (ORDER BY CASE WHEN coalesce(article_section, '') = '' THEN 1 ELSE 0 END, CASE WHEN discovery_tag IS NULL THEN 1 ELSE 0 END, {_SCORE} DESC NULLS LAST, law_name NULLS LAST, record_id) AS rank FROM records_la) WHERE rank <= 500")
def f07(s, d):
    r = records(s, d).select("record_id", F.when(F.coalesce("article_section", F.lit("")) == "", 1).otherwise(0).alias("caveat"), C("discovery_tag").isNull().cast("int").alias("pending"), _confidence().alias("score"), "law_name")
    top = r.orderBy("caveat", "pending", F.desc_nulls_last("score"), F.asc_nulls_last("law_name"), "record_id").limit(500)  # a report of the first 500: merged from each task's own
    return top.select("record_id", F.row_number().over(Window.orderBy("caveat", "pending", F.desc_nulls_last("score"), F.asc_nulls_last("law_name"), "record_id")).cast("bigint").alias("rank"))


@query("f12_last_and_next", "WITH l AS (SELECT user_id, event_type, max(event_id) AS start FROM events GROUP BY ALL) SELECT user_id, event_type, start, coalesce(lead(start) OVER (PARTITION BY user_id ORDER BY start), 1000000000) AS until FROM l")
def f12(s, d):
    last = table(s, d, "events").groupBy("user_id", "event_type").agg(F.max("event_id").alias("start"))
    return last.withColumn("until", F.lead("start", 1, 1_000_000_000).over(Window.partitionBy("user_id").orderBy("start")))


@query("f16_complete_or_none", "WITH l AS (SELECT user_id, event_type, max(event_id) AS pos FROM events WHERE event_type IN ('signup', 'purchase', 'click') GROUP BY ALL), n AS (SELECT user_id FROM l GROUP BY 1 HAVING count(DISTINCT pos) = 3) SELECT user_id, event_type, pos FROM l WHERE user_id IN (SELECT user_id FROM n)")
def f16(s, d):
    last = table(s, d, "events").where("event_type IN ('signup', 'purchase', 'click')").groupBy("user_id", "event_type").agg(F.max("event_id").alias("pos"))
    whole = last.groupBy("user_id").agg(F.count_distinct("pos").alias("n")).where("n = 3")
    return last.join(whole.select("user_id"), "user_id", "left_semi").select("user_id", "event_type", "pos")


@query("f17_none_inside", "SELECT e.event_id FROM events e WHERE e.event_type = 'signup' AND NOT EXISTS (SELECT 1 FROM events x WHERE x.user_id = e.user_id AND x.event_type = 'error' AND x.event_id > e.event_id AND x.event_id <= e.event_id + 300)")
def f17(s, d):
    e = table(s, d, "events").where("event_type IN ('signup', 'error')")
    # the next error of the user, by one window instead of a join of ranges
    after = F.min(F.when(C("event_type") == "error", C("event_id"))).over(Window.partitionBy("user_id").orderBy("event_id").rangeBetween(1, 300))
    return e.withColumn("inside", after).where("event_type = 'signup' AND inside IS NULL").select("event_id")


@query("f23_run_order", "SELECT snapshot_date, economy, row_number() OVER (ORDER BY e, b, economy, snapshot_date) AS rank FROM (SELECT snapshot_date, economy, max(delivered_at) AS e, min(delivered_at) AS b FROM law_census GROUP BY snapshot_date, economy)")
def f23(s, d):
    runs = census(s, d).groupBy("snapshot_date", "economy").agg(F.max("delivered_at").alias("ended"), F.min("delivered_at").alias("began"))
    return runs.select("snapshot_date", "economy", F.row_number().over(Window.orderBy("ended", "began", "economy", "snapshot_date")).cast("bigint").alias("rank"))


@query("f25_preferred_document", "SELECT instrument_id, doc_id FROM (SELECT instrument_id, doc_id, row_number() OVER (PARTITION BY instrument_id ORDER BY CASE lang WHEN 'en' THEN 0 WHEN 'pt' THEN 1 ELSE 2 END, (access_date IS NOT NULL) DESC, access_date DESC NULLS LAST, doc_id) AS n FROM documents) WHERE n = 1")
def f25(s, d):
    order = F.struct(F.when(C("lang") == "en", 0).when(C("lang") == "pt", 1).otherwise(2).alias("a"), C("access_date").isNull().alias("b"), (-F.unix_micros(C("access_date").cast("timestamp"))).alias("c"), C("doc_id").alias("d"))
    return documents(s, d).groupBy("instrument_id").agg(F.min_by("doc_id", order).alias("doc_id"))


@query("g05_external_order", "WITH o AS (SELECT indicator, min(item_id) AS pos FROM gold_items GROUP BY 1) SELECT baseline_id, try_cast(string_split(indicator_id, '.')[1] AS INT) AS pillar, coalesce(pos, 1000000) AS pos FROM baseline_la b LEFT JOIN o ON b.indicator_id = o.indicator")
def g05(s, d):
    o = gold(s, d).groupBy(C("indicator").alias("indicator_id")).agg(F.min("item_id").alias("pos"))
    return baseline(s, d).join(broadcast_if_small(o), "indicator_id", "left").select("baseline_id", F.split("indicator_id", r"\.")[0].try_cast("int").alias("pillar"), F.coalesce("pos", F.lit(1_000_000)).alias("pos"))


@query("g06_priorities", "SELECT doc_id, CASE WHEN source = 'ocr_backfile' THEN 2 WHEN regexp_matches(lower(title), 'data|register|licen[cs]e') THEN 0 ELSE 1 END AS priority FROM documents")
def g06(s, d):
    return documents(s, d).select("doc_id", F.when(C("source") == "ocr_backfile", 2).when(F.lower("title").rlike("data|register|licen[cs]e"), 0).otherwise(1).alias("priority"))


@query("h03_first_per_url", "SELECT lower(regexp_replace(url, '[?#].*$', '')) AS key, min(ts) AS first_seen, count(*) AS times FROM crawl_log WHERE url IS NOT NULL GROUP BY 1")
def h03(s, d):
    return crawl(s, d).where("url IS NOT NULL").groupBy(F.lower(F.regexp_replace("url", "[?#].*$", "")).alias("key")).agg(F.min("ts").alias("first_seen"), F.count(F.lit(1)).alias("times"))


@query("h06_first_wins", "SELECT provision_id, min(gloss_id) AS gloss_id, arg_min(indicator, gloss_id) FILTER (indicator IS NOT NULL) AS indicator FROM gloss_tl GROUP BY 1")
def h06(s, d):
    return gloss(s, d).groupBy("provision_id").agg(F.min("gloss_id").alias("gloss_id"), F.min_by("indicator", F.when(C("indicator").isNotNull(), C("gloss_id"))).alias("indicator"))


# L: differences and state


def _listed(s, d, *values):
    """One row per economy, key and snapshot: the latest delivered."""
    c = census(s, d).withColumn("portal_id", F.upper(F.regexp_replace("portal_id", r"^\s+|\s+$", ""))).where("portal_id <> ''")
    best = F.max_by(F.struct(*values), F.struct("delivered_at", "row_id"))
    return c.groupBy("economy", "portal_id", "snapshot_date").agg(best.alias("v")).select("economy", "portal_id", "snapshot_date", "v.*")


_L = r"""WITH l AS (SELECT * REPLACE (upper(regexp_replace(portal_id, '^\s+|\s+$', '', 'g')) AS portal_id) FROM law_census WHERE regexp_replace(portal_id, '^\s+|\s+$', '', 'g') <> '' QUALIFY row_number() OVER (PARTITION BY economy, upper(regexp_replace(portal_id, '^\s+|\s+$', '', 'g')), snapshot_date ORDER BY delivered_at DESC, row_id DESC) = 1),
c AS (SELECT economy, snapshot_date, lag(snapshot_date) OVER (PARTITION BY economy ORDER BY snapshot_date) AS prev FROM (SELECT DISTINCT economy, snapshot_date FROM l)), n AS (SELECT l.* FROM l JOIN c ON l.economy IS NOT DISTINCT FROM c.economy AND l.snapshot_date = c.snapshot_date WHERE c.prev IS NOT NULL), o AS (SELECT l.* REPLACE (c.snapshot_date AS snapshot_date) FROM l JOIN c ON l.economy IS NOT DISTINCT FROM c.economy AND l.snapshot_date = c.prev),
j AS (SELECT coalesce(n.economy, o.economy) AS economy, coalesce(n.portal_id, o.portal_id) AS portal_id, coalesce(n.snapshot_date, o.snapshot_date) AS snapshot_date, o.portal_id IS NULL AS no_o, n.portal_id IS NULL AS no_n, o, n FROM o FULL JOIN n ON o.economy IS NOT DISTINCT FROM n.economy AND o.portal_id = n.portal_id AND o.snapshot_date = n.snapshot_date)
"""


def _differences(names: dict[str, str]) -> str:
    reasons = "list_filter([" + ", ".join(f"CASE WHEN o.{c} IS DISTINCT FROM n.{c} THEN '{r}' END" for r, c in names.items()) + "], lambda x: x IS NOT NULL)"
    return _L + f"SELECT economy, portal_id, snapshot_date, CASE WHEN no_o THEN 'new' WHEN no_n THEN 'gone' ELSE 'changed' END AS change, CASE WHEN no_o OR no_n THEN [] ELSE {reasons} END AS reasons FROM j WHERE no_o OR no_n OR len({reasons}) > 0"


def _steps(s, d, *values):
    return changes.consecutive(_listed(s, d, *values), "economy", "portal_id", "snapshot_date")


@query("l01_changes_with_reasons", _differences({"version": "version_id", "status": "legal_status", "listing": "title"}))
def l01(s, d):
    old, new = _steps(s, d, "version_id", "legal_status", "title")
    return changes.listing_changes(old, new, "k", {"version": C("version_id"), "status": C("legal_status"), "listing": C("title")}).select("k.*", "change", "reasons")


@query("l02_amended_or_repealed", _L + f"SELECT economy, portal_id, snapshot_date, CASE WHEN no_o THEN 'new' WHEN no_n THEN 'not_checked' WHEN n.legal_status ILIKE '%repealed%' AND o.legal_status NOT ILIKE '%repealed%' THEN 'repealed' WHEN n.amendments_listed > o.amendments_listed THEN 'amended' WHEN n.version_id IS DISTINCT FROM o.version_id THEN 'regenerated' WHEN coalesce(n.document_url, '') = '' THEN 'file pending' ELSE 'unchanged' END AS verdict FROM j")
def l02(s, d):
    values = ("legal_status", "amendments_listed", "version_id", "document_url")
    old, new = _steps(s, d, *values)
    j = old.select("k", F.struct(*values).alias("o")).join(new.select("k", F.struct(*values).alias("n")), "k", "full_outer")
    dead = lambda x: F.lower(f"{x}.legal_status").contains("repealed")
    verdict = (
        F.when(C("o").isNull(), "new").when(C("n").isNull(), "not_checked").when(dead("n") & ~dead("o"), "repealed").when(C("n.amendments_listed") > C("o.amendments_listed"), "amended")
        .when(~C("n.version_id").eqNullSafe(C("o.version_id")), "regenerated").when(F.coalesce("n.document_url", F.lit("")) == "", "file pending").otherwise("unchanged")
    )
    return j.select("k.*", verdict.alias("verdict"))


@query("l03_versions_by_series", _L + "SELECT coalesce(n.series, o.series) AS series, CASE WHEN no_o THEN 'new_title' WHEN no_n THEN 'dropped' WHEN n.version_id IS DISTINCT FROM o.version_id THEN 'new_version' ELSE 'unchanged' END AS verdict, count(*) AS n FROM j GROUP BY ALL")
def l03(s, d):
    old, new = _steps(s, d, "series", "version_id")
    j = old.select("k", F.struct("series", "version_id").alias("o")).join(new.select("k", F.struct("series", "version_id").alias("n")), "k", "full_outer")
    verdict = F.when(C("o").isNull(), "new_title").when(C("n").isNull(), "dropped").when(~C("n.version_id").eqNullSafe(C("o.version_id")), "new_version").otherwise("unchanged")
    return j.groupBy(F.coalesce("n.series", "o.series").alias("series"), verdict.alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


@query("l04_per_file_changes", _L + ", f AS (SELECT economy, portal_id, snapshot_date, unnest(string_split(coalesce(o.document_kinds, ''), ';')) AS kind, 1 AS a, 0 AS b FROM j UNION ALL SELECT economy, portal_id, snapshot_date, unnest(string_split(coalesce(n.document_kinds, ''), ';')), 0, 1 FROM j) SELECT economy, portal_id, snapshot_date, kind, CASE WHEN max(a) = 0 THEN 'new' ELSE 'delisted' END AS verdict FROM f WHERE kind <> '' GROUP BY ALL HAVING max(a) <> max(b)".replace("\n, f", ", f"))
def l04(s, d):
    old, new = _steps(s, d, "document_kinds")
    files = lambda df, a, b: df.select("k", F.explode(F.split(F.coalesce("document_kinds", F.lit("")), ";")).alias("kind"), F.lit(a).alias("a"), F.lit(b).alias("b")).where("kind <> ''")
    both = files(old, 1, 0).unionByName(files(new, 0, 1)).groupBy("k", "kind").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    return both.where("a <> b").select("k.*", "kind", F.when(C("a") == 0, "new").otherwise("delisted").alias("verdict"))


@query("l10_latest_state", "SELECT url, arg_max(outcome, (ts, status)) AS outcome, max(ts) AS at, bool_or(outcome = 'ok') AS stored FROM (SELECT * FROM (SELECT DISTINCT url, ts, status, outcome FROM crawl_log WHERE url IS NOT NULL AND outcome IS NOT NULL AND ts IS NOT NULL AND status IS NOT NULL) QUALIFY count(*) OVER (PARTITION BY url, ts, status) = 1) GROUP BY 1")
def l10(s, d):
    c = crawl(s, d).where("url IS NOT NULL AND outcome IS NOT NULL AND ts IS NOT NULL AND status IS NOT NULL").select("url", "ts", "status", "outcome").distinct()
    once = c.groupBy("url", "ts", "status").agg(F.count(F.lit(1)).alias("n"), F.min("outcome").alias("outcome")).where("n = 1")
    return once.groupBy("url").agg(F.max_by("outcome", F.struct("ts", "status")).alias("outcome"), F.max("ts").alias("at"), F.bool_or(C("outcome") == "ok").alias("stored"))


@query("l13_cache_keys", "SELECT doc_id, sha256(concat_ws('|', sha256(text), coalesce(lang, ''), coalesce(source, ''), '300', 'v1')) AS cache_key FROM documents")
def l13(s, d):
    blank = lambda c: F.coalesce(c, F.lit(""))
    return documents(s, d).select("doc_id", F.sha2(F.concat_ws("|", F.sha2("text", 256), blank("lang"), blank("source"), F.lit("300"), F.lit("v1")), 256).alias("cache_key"))
