"""More of the pipeline's operators as queries: routing, evaluation, nested values, config layers, work lists, catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import text, urls
from quillspark.operators import ranking
from quillspark.session import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _t(name: str):
    return lambda s, d: table(s, d, name)


documents, records, gloss, census, crawl, baseline = (_t(n) for n in ("documents", "records_la", "gloss_tl", "law_census", "crawl_log", "baseline_la"))


# C: routing and flags


@query("c10_scored_flag", "SELECT record_id, CASE WHEN coalesce(verbatim_snippet, '') = '' OR source_url LIKE 'n/a%' THEN 'no_provision' ELSE 'scored' END AS state FROM records_la")
def c10(s, d):
    return records(s, d).selectExpr("record_id", "CASE WHEN coalesce(verbatim_snippet, '') = '' OR source_url LIKE 'n/a%' THEN 'no_provision' ELSE 'scored' END AS state")


@query("c13_cell_state", """WITH b AS (SELECT indicator_id, count(*) AS n, bool_or(law_number_ref LIKE '%MOF%') AS mof FROM baseline_la GROUP BY 1)
SELECT record_id, CASE WHEN b.n IS NULL THEN 'absent' WHEN b.mof = coalesce(contains(law_number_ref, 'MOF'), false) THEN 'reproduces' ELSE 'contradicts' END AS state FROM records_la LEFT JOIN b USING (indicator_id)""")
def c13(s, d):
    b = baseline(s, d).groupBy("indicator_id").agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col("law_number_ref").like("%MOF%")).alias("mof"))
    own = F.coalesce(F.col("law_number_ref").contains("MOF"), F.lit(False))
    return records(s, d).join(b, "indicator_id", "left").select("record_id", F.when(F.col("n").isNull(), "absent").when(F.col("mof") == own, "reproduces").otherwise("contradicts").alias("state"))


@query("c24_kind", "SELECT row_id, CASE WHEN regexp_matches(title, '(?i)amend|alteração|修订') THEN 'amending_act' WHEN regexp_matches(title, '(?i)repeal|revoga') THEN 'repealing_act' WHEN is_principal = 'true' THEN 'principal_act' ELSE 'listed' END AS kind FROM law_census")
def c24(s, d):
    has = lambda p: F.col("title").rlike(p)
    return census(s, d).select("row_id", F.when(has("(?iu)amend|alteração|修订"), "amending_act").when(has("(?iu)repeal|revoga"), "repealing_act").when(F.col("is_principal") == "true", "principal_act").otherwise("listed").alias("kind"))


@query("c26_quality_flags", """SELECT doc_id, list_filter([CASE WHEN length(text) < 100 THEN 'short' END, CASE WHEN length(text) > 5000 THEN 'long' END, CASE WHEN lang IS NULL THEN 'no_language' END, CASE WHEN contains(text, '…') OR contains(text, '....') THEN 'dots' END], lambda x: x IS NOT NULL) AS flags FROM documents""")
def c26(s, d):
    n = F.length("text")
    f = [F.when(n < 100, F.lit("short")), F.when(n > 5000, F.lit("long")), F.when(F.col("lang").isNull(), F.lit("no_language")), F.when(F.col("text").contains("…") | F.col("text").contains("...."), F.lit("dots"))]
    return documents(s, d).select("doc_id", F.filter(F.array(*f), lambda x: x.isNotNull()).alias("flags"))


@query("c27_distinctive_words", r"""WITH w AS (SELECT doc_id, text, list_distinct(list_filter(string_split(trim(regexp_replace(regexp_replace(lower(title), '[^a-z0-9\s]', '', 'g'), '\s+', ' ', 'g')), ' '), lambda x: length(x) > 3)) AS words FROM documents WHERE title IS NOT NULL)
SELECT doc_id, len(list_filter(words, lambda x: contains(lower(text), x))) AS found, len(words) AS words FROM w""")
def c27(s, d):
    w = documents(s, d).where("title IS NOT NULL").select("doc_id", F.lower("text").alias("t"), F.array_distinct(F.filter(F.split(text.plain_name(F.col("title")), " "), lambda x: F.length(x) > 3)).alias("words"))
    return w.select("doc_id", F.size(F.filter("words", lambda x: F.col("t").contains(x))).cast("bigint").alias("found"), F.size("words").cast("bigint").alias("words"))


@query("c28_hint_numbers", "SELECT record_id, list_filter(list_transform(regexp_extract_all(indicator_id, '[0-9]+'), lambda x: x::INTEGER), lambda x: x BETWEEN 1 AND 12) AS pillars FROM records_la WHERE indicator_id IS NOT NULL")
def c28(s, d):
    n = F.transform(F.regexp_extract_all("indicator_id", F.lit("[0-9]+"), 0), lambda x: x.cast("int"))
    return records(s, d).where("indicator_id IS NOT NULL").select("record_id", F.filter(n, lambda x: x.between(1, 12)).alias("pillars"))


# D: evaluation and resume


@query("d08_resolvable", """WITH c AS (SELECT DISTINCT instrument_id FROM documents WHERE n_chars > 500)
SELECT economy, count(DISTINCT d.instrument_id) AS listed, count(DISTINCT c.instrument_id) AS resolvable FROM documents d LEFT JOIN c USING (instrument_id) GROUP BY 1""")
def d08(s, d):
    c = documents(s, d).where("n_chars > 500").select("instrument_id", F.col("instrument_id").alias("held")).distinct()
    return documents(s, d).select("economy", "instrument_id").join(c, "instrument_id", "left").groupBy("economy").agg(F.countDistinct("instrument_id").alias("listed"), F.countDistinct("held").alias("resolvable"))


@query("d09_evaluation", """WITH e AS (SELECT DISTINCT indicator_id, law_number_ref FROM records_la WHERE law_number_ref LIKE '%/%'), g AS (SELECT DISTINCT indicator_id, law_number_ref FROM baseline_la WHERE law_number_ref LIKE '%/%')
SELECT indicator_id, count(*) AS gold, count(e.law_number_ref) AS hits, round(count(e.law_number_ref) / count(*), 6) AS recall FROM g LEFT JOIN e USING (indicator_id, law_number_ref) GROUP BY 1""")
def d09(s, d):
    keys = lambda df: df.where("law_number_ref LIKE '%/%'").select("indicator_id", "law_number_ref").distinct()
    e = keys(records(s, d)).withColumn("hit", F.lit(1))
    j = keys(baseline(s, d)).join(e, ["indicator_id", "law_number_ref"], "left")  # rows without an indicator are a group too
    return j.groupBy("indicator_id").agg(F.count(F.lit(1)).alias("gold"), F.count("hit").alias("hits"), F.round(F.count("hit") / F.count(F.lit(1)), 6).alias("recall"))


@query("d23_resume", "SELECT DISTINCT url FROM crawl_log WHERE url IS NOT NULL AND url NOT IN (SELECT url FROM crawl_log WHERE outcome IN ('ok', 'duplicate') AND url IS NOT NULL)")
def d23(s, d):
    c = crawl(s, d)
    return c.select("url").where("url IS NOT NULL").distinct().join(c.where("outcome IN ('ok', 'duplicate')").select("url").distinct(), "url", "left_anti")


@query("d20_two_key_lookup", """WITH a AS (SELECT portal_id, min(title) AS t FROM law_census WHERE title IS NOT NULL GROUP BY 1), b AS (SELECT document_url, min(title) AS t FROM law_census WHERE title IS NOT NULL AND document_url <> '' GROUP BY 1)
SELECT row_id, coalesce(a.t, b.t) AS known_title FROM law_census c LEFT JOIN a ON upper(trim(c.portal_id)) = a.portal_id LEFT JOIN b USING (document_url)""")
def d20(s, d):
    c = census(s, d)
    a = c.where("title IS NOT NULL").groupBy(F.col("portal_id").alias("k")).agg(F.min("title").alias("a"))
    b = c.where("title IS NOT NULL AND document_url <> ''").groupBy("document_url").agg(F.min("title").alias("b"))
    j = c.select("row_id", F.upper(F.trim("portal_id")).alias("k"), "document_url").join(a, "k", "left").join(b, "document_url", "left")
    return j.select("row_id", F.coalesce("a", "b").alias("known_title"))


# E: counts


@query("e06_conditional_counts", """WITH p AS (SELECT unnest(provisions) AS p FROM records_cn)
SELECT count(DISTINCT p.record_id) AS provisions, count_if(p.verbatim_snippet <> '') AS with_text, count_if(coalesce(p.verbatim_snippet, '') = '') AS without_text, count(DISTINCT p.indicator_id) AS indicators FROM p""")
def e06(s, d):
    p = table(s, d, "records_cn").select(F.explode("provisions").alias("p")).select("p.*")
    return p.agg(F.countDistinct("record_id").alias("provisions"), F.count_if(F.col("verbatim_snippet") != "").alias("with_text"), F.count_if(F.coalesce("verbatim_snippet", F.lit("")) == "").alias("without_text"), F.countDistinct("indicator_id").alias("indicators"))


@query("e07_orphans", "SELECT coalesce(m.source, '(no target)') AS source, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents d LEFT JOIN mix_targets m ON d.source = m.source GROUP BY 1")
def e07(s, d):
    m = table(s, d, "mix_targets").select("source", F.col("source").alias("known")).distinct()
    return documents(s, d).join(m, "source", "left").groupBy(F.coalesce("known", F.lit("(no target)")).alias("source")).agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@query("e13_mode_of_host", r"""WITH h AS (SELECT indicator_id, lower(regexp_extract(source_url, '^https?://([^/?#:]+)', 1)) AS host, count(*) AS n FROM records_la GROUP BY ALL)
SELECT indicator_id, host, n FROM h WHERE host <> '' QUALIFY row_number() OVER (PARTITION BY indicator_id ORDER BY n DESC, host) = 1""")
def e13(s, d):
    h = records(s, d).groupBy("indicator_id", urls.host(F.col("source_url")).alias("host")).agg(F.count(F.lit(1)).alias("n")).where("host IS NOT NULL")
    return ranking.ranked(h, ["indicator_id"], [F.desc("n"), F.col("host")]).where("rank = 1").select("indicator_id", "host", "n")


@query("e16_two_level_counts", "SELECT economy, legal_status, count(*) AS n, count_if(in_seed = 'true') AS seeded, count_if(in_relevant = 'false') AS set_aside FROM law_census GROUP BY ALL")
def e16(s, d):
    return census(s, d).groupBy("economy", "legal_status").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("in_seed") == "true").alias("seeded"), F.count_if(F.col("in_relevant") == "false").alias("set_aside"))


@query("e17_checks_against_group", "SELECT row_id, amendments_listed - min(amendments_listed) OVER (PARTITION BY economy) AS above_least FROM law_census QUALIFY amendments_listed > min(amendments_listed) OVER (PARTITION BY economy)")
def e17(s, d):
    c = census(s, d)
    # the minimum as an aggregate and a join: a window would gather an economy in one task
    least = c.groupBy("economy").agg(F.min("amendments_listed").alias("least"))
    return c.join(least.withColumnRenamed("economy", "e_"), F.col("economy").eqNullSafe(F.col("e_"))).where("amendments_listed > least").select("row_id", (F.col("amendments_listed") - F.col("least")).alias("above_least"))


@query("e20_method_counters", "SELECT retrieval_method, count(*) AS requests, count_if(outcome = 'ok') AS ok, count(DISTINCT url) AS urls, round(count_if(outcome = 'ok') / count(*), 6) AS share FROM crawl_log GROUP BY 1")
def e20(s, d):
    ok = F.count_if(F.col("outcome") == "ok")
    return crawl(s, d).groupBy("retrieval_method").agg(F.count(F.lit(1)).alias("requests"), ok.alias("ok"), F.countDistinct("url").alias("urls"), F.round(ok / F.count(F.lit(1)), 6).alias("share"))


# F: config layers, choices by date


@query("f02_layered_config", """SELECT record_id, CASE WHEN indicator_id = '6.1' AND upper(economy) = 'LA' THEN 0.4 WHEN indicator_id = '6.1' THEN 0.5 WHEN indicator_id LIKE '7.%' THEN 0.55 ELSE 0.6 END AS theta FROM records_la""".replace("0.4 ", "0.4::DOUBLE ").replace("0.5 ", "0.5::DOUBLE ").replace("0.55 ", "0.55::DOUBLE ").replace("0.6 ", "0.6::DOUBLE "))
def f02(s, d):
    cfg = s.createDataFrame([("class", None, None, "*", 0.6), ("class", None, None, "7", 0.55), ("indicator", None, "6.1", None, 0.5), ("override", "LA", "6.1", None, 0.4)], "scope string, economy string, indicator string, class string, theta double")
    pick = lambda where: F.broadcast(cfg.where(where))
    r = records(s, d).select("record_id", F.upper("economy").alias("economy"), F.col("indicator_id").alias("indicator"), F.regexp_extract(F.coalesce("indicator_id", F.lit("")), "^([0-9]+)[.]", 1).alias("class"))
    default = cfg.where("class = '*'").select(F.col("theta").alias("t0"))
    layers = [pick("scope = 'class' AND class <> '*'").select("class", F.col("theta").alias("t1")), pick("scope = 'indicator'").select("indicator", F.col("theta").alias("t2")), pick("scope = 'override'").select("economy", "indicator", F.col("theta").alias("t3"))]
    out = r.crossJoin(F.broadcast(default)).join(layers[0], "class", "left").join(layers[1], "indicator", "left").join(layers[2], ["economy", "indicator"], "left")
    return out.select("record_id", F.coalesce("t3", "t2", "t1", "t0").alias("theta"))


@query("f05_overrides", r"""WITH p AS (SELECT record_id, unnest(regexp_split_to_array(regexp_extract(source_url, '\?([^#]*)', 1), '[?&]')) AS p FROM records_la)
SELECT record_id, string_split(p, '=')[1] AS name, string_split(p, '=')[2] AS value FROM p WHERE contains(p, '=')""")
def f05(s, d):
    pairs = F.explode(F.split(F.regexp_extract("source_url", r"\?([^#]*)", 1), "[?&]")).alias("p")
    return records(s, d).select("record_id", pairs).where(F.col("p").contains("=")).select("record_id", F.split("p", "=")[0].alias("name"), F.split("p", "=")[1].alias("value"))


@query("f27_latest_as_of", "SELECT portal_id, arg_max(version_id, (snapshot_date, row_id)) AS version_id, max(snapshot_date) AS snapshot_date FROM law_census WHERE snapshot_date <= '2026-06-15' GROUP BY 1")
def f27(s, d):
    c = census(s, d).where("snapshot_date <= '2026-06-15'")
    return c.groupBy("portal_id").agg(F.max_by("version_id", F.struct("snapshot_date", "row_id")).alias("version_id"), F.max("snapshot_date").alias("snapshot_date"))


SQL["f27_latest_as_of"] = "SELECT portal_id, version_id, snapshot_date FROM law_census WHERE snapshot_date <= '2026-06-15' QUALIFY row_number() OVER (PARTITION BY portal_id ORDER BY snapshot_date DESC, row_id DESC) = 1"


@query("f26_not_in_force", "SELECT row_id, coalesce(published_on > '2025-12-31', true) OR regexp_replace(lower(trim(legal_status)), '[_ -]+', '_', 'g') <> 'in_force' AS out_of_force FROM law_census WHERE legal_status IS NOT NULL")
def f26(s, d):
    state = F.regexp_replace(F.lower(F.trim("legal_status")), "[_ -]+", "_")
    return census(s, d).where("legal_status IS NOT NULL").select("row_id", (F.coalesce(F.col("published_on") > "2025-12-31", F.lit(True)) | (state != "in_force")).alias("out_of_force"))


@query("f28_urls_with_conflicts", "SELECT document_url, arg_min(portal_id, row_id) AS kept, count(DISTINCT portal_id) - 1 AS others FROM law_census WHERE document_url <> '' GROUP BY 1 HAVING count(DISTINCT portal_id) > 1")
def f28(s, d):
    g = census(s, d).where("document_url <> ''").groupBy("document_url").agg(F.min_by("portal_id", "row_id").alias("kept"), (F.countDistinct("portal_id") - 1).alias("others"))
    return g.where("others > 0")


@query("f06_best_row", "SELECT indicator_id, record_id FROM (SELECT indicator_id, record_id, try_cast(confidence AS DOUBLE) AS c FROM records_la WHERE indicator_id IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY indicator_id ORDER BY c DESC NULLS LAST, record_id) = 1")
def f06(s, d):
    r = records(s, d).where("indicator_id IS NOT NULL").selectExpr("indicator_id", "record_id", "try_cast(confidence AS DOUBLE) AS c")
    best = F.max_by("record_id", F.struct(F.coalesce("c", F.lit(-1e300)), -F.col("record_id")))
    return r.groupBy("indicator_id").agg(best.alias("record_id"))


# J and K: ids, scores, nested values


@query("j10_ids", "SELECT record_id, CASE WHEN regexp_matches(indicator_id, '^P[0-9]+-I[0-9]+$') THEN replace(substr(indicator_id, 2), '-I', '.') WHEN regexp_matches(indicator_id, '^[0-9]+[.][0-9]+$') THEN indicator_id END AS id FROM records_la")
def j10(s, d):
    i = F.col("indicator_id")
    return records(s, d).select("record_id", F.when(i.rlike("^P[0-9]+-I[0-9]+$"), F.regexp_replace(i, "^P([0-9]+)-I", "$1.")).when(i.rlike("^[0-9]+[.][0-9]+$"), i).alias("id"))


@query("j11_pillars", "SELECT indicator_id, try_cast(string_split(indicator_id, '.')[1] AS INTEGER) AS pillar, count(*) AS n FROM records_la GROUP BY ALL")
def j11(s, d):
    return records(s, d).groupBy("indicator_id").agg(F.count(F.lit(1)).alias("n")).selectExpr("indicator_id", "try_cast(split(indicator_id, '[.]')[0] AS INT) AS pillar", "n")


@query("j16_membership_eps", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE abs(l_discount - 0.05) < 1e-9 OR abs(l_discount - 0.07) < 1e-9")
def j16(s, d):
    near = lambda v: F.abs(F.col("l_discount") - v) < 1e-9
    return table(s, d, "lineitem").where(near(0.05) | near(0.07)).select("l_orderkey", "l_linenumber")


@query("j21_score_lists", "SELECT record_id, list_transform(regexp_extract_all(confidence, '[0-9]+(?:[.][0-9]+)?'), lambda x: x::DOUBLE) AS scores FROM records_la WHERE confidence IS NOT NULL")
def j21(s, d):
    return records(s, d).where("confidence IS NOT NULL").select("record_id", F.transform(F.regexp_extract_all("confidence", F.lit("[0-9]+(?:[.][0-9]+)?"), 0), lambda x: x.cast("double")).alias("scores"))


@query("k01_json_values", "SELECT event_id, try_cast(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def k01(s, d):
    return table(s, d, "events").selectExpr("event_id", "try_variant_get(try_parse_json(props), '$.k', 'int') AS k")


@query("k03_guarded", "SELECT record_id, CASE WHEN lower(trim(discovery_tag)) IN ('new', 'known') THEN lower(trim(discovery_tag)) ELSE 'other' END AS tag, round(least(CASE WHEN lower(trim(discovery_tag)) IN ('new', 'known') THEN 1.0 ELSE 0.3 END, greatest(0.0, coalesce(try_cast(confidence AS DOUBLE), 0.0))), 2) AS confidence FROM records_la")
def k03(s, d):
    return records(s, d).selectExpr("record_id", "CASE WHEN lower(trim(discovery_tag)) IN ('new', 'known') THEN lower(trim(discovery_tag)) ELSE 'other' END AS tag", "round(least(CASE WHEN lower(trim(discovery_tag)) IN ('new', 'known') THEN 1.0D ELSE 0.3D END, greatest(0.0D, coalesce(try_cast(confidence AS DOUBLE), 0.0D))), 2) AS confidence")


@query("k08_ordinals_in_array", """SELECT law_row_id, list_transform(provisions, lambda p, i: i || ':' || coalesce(p.indicator_id, '')) AS marks FROM records_cn""")
def k08(s, d):
    return table(s, d, "records_cn").select("law_row_id", F.transform("provisions", lambda p, i: F.concat((i + 1).cast("string"), F.lit(":"), F.coalesce(p["indicator_id"], F.lit("")))).alias("marks"))


# L and O: work lists and catalogue


@query("l08_work_list", """WITH stored AS (SELECT DISTINCT final_url FROM crawl_log WHERE outcome = 'ok' AND final_url IS NOT NULL)
SELECT DISTINCT url, host FROM crawl_log WHERE status = 200 AND url IS NOT NULL AND url NOT IN (SELECT final_url FROM stored)""")
def l08(s, d):
    c = crawl(s, d)
    stored = c.where("outcome = 'ok'").select(F.col("final_url").alias("url")).distinct()
    return c.where("status = 200 AND url IS NOT NULL").select("url", "host").distinct().join(stored, "url", "left_anti")


@query("o11_not_selected", "SELECT row_id, CASE WHEN in_all = 'true' AND in_relevant = 'true' THEN NULL WHEN coalesce(document_url, '') = '' THEN 'no address' WHEN in_all = 'false' THEN 'not listed' ELSE 'not relevant' END AS reason FROM law_census")
def o11(s, d):
    return census(s, d).selectExpr("row_id", "CASE WHEN in_all = 'true' AND in_relevant = 'true' THEN NULL WHEN coalesce(document_url, '') = '' THEN 'no address' WHEN in_all = 'false' THEN 'not listed' ELSE 'not relevant' END AS reason")


@query("o13_membership", "SELECT row_id, CASE WHEN list_contains(string_split(document_kinds, ';'), 'principal_act') THEN 'dedicated' WHEN len(list_filter(string_split(document_kinds, ';'), lambda x: starts_with(x, 'amend'))) > 0 THEN 'general' END AS membership FROM law_census")
def o13(s, d):
    kinds = F.split("document_kinds", ";")
    return census(s, d).select("row_id", F.when(F.array_contains(kinds, "principal_act"), "dedicated").when(F.exists(kinds, lambda x: x.startswith("amend")), "general").alias("membership"))


@query("o15_elsewhere", """WITH ok AS (SELECT DISTINCT url FROM crawl_log WHERE outcome = 'ok'), other AS (SELECT DISTINCT regexp_extract(url, '/([^/]+)$', 1) AS tail FROM crawl_log WHERE outcome = 'ok')
SELECT DISTINCT url, regexp_extract(url, '/([^/]+)$', 1) IN (SELECT tail FROM other) AS stored_elsewhere FROM crawl_log WHERE url IS NOT NULL AND url NOT IN (SELECT url FROM ok WHERE url IS NOT NULL)""")
def o15(s, d):
    c, tail = crawl(s, d), F.regexp_extract("url", "/([^/]+)$", 1)
    ok = c.where("outcome = 'ok' AND url IS NOT NULL").select("url", tail.alias("tail"))
    open_ = c.where("url IS NOT NULL").select("url").distinct().join(ok.select("url").distinct(), "url", "left_anti").withColumn("tail", tail)
    return open_.join(ok.select("tail", F.lit(True).alias("hit")).distinct(), "tail", "left").select("url", F.coalesce("hit", F.lit(False)).alias("stored_elsewhere"))


@query("o22_title_kinds", "SELECT row_id, CASE WHEN title LIKE '%办法%' THEN 'measures' WHEN title LIKE '%条例%' THEN 'regulations' WHEN title LIKE '%规定%' OR title LIKE '%规则%' OR title LIKE '%细则%' THEN 'rules' WHEN title LIKE '%法%' THEN 'law' ELSE 'other' END AS kind FROM law_census WHERE economy = 'CN'")
def o22(s, d):
    return census(s, d).where("economy = 'CN'").selectExpr("row_id", "CASE WHEN title LIKE '%办法%' THEN 'measures' WHEN title LIKE '%条例%' THEN 'regulations' WHEN title LIKE '%规定%' OR title LIKE '%规则%' OR title LIKE '%细则%' THEN 'rules' WHEN title LIKE '%法%' THEN 'law' ELSE 'other' END AS kind")


@query("o24_chinese_years", "SELECT row_id, try_cast(nullif(regexp_extract(title, '([0-9]{4})年', 1), '') AS INTEGER) AS year FROM law_census WHERE economy = 'CN'")
def o24(s, d):
    return census(s, d).where("economy = 'CN'").selectExpr("row_id", "try_cast(nullif(regexp_extract(title, '([0-9]{4})年', 1), '') AS INT) AS year")


@query("o29_completeness", """WITH p AS (SELECT portal_id, try_cast(compilation_number AS INTEGER) AS n FROM law_census), r AS (SELECT portal_id, min(n) AS lo, max(n) AS hi, count(DISTINCT n) AS have FROM p WHERE n IS NOT NULL GROUP BY 1)
SELECT portal_id, hi - lo + 1 - have AS missing FROM r WHERE hi - lo + 1 > have""")
def o29(s, d):
    p = census(s, d).selectExpr("portal_id", "try_cast(compilation_number AS INT) AS n").where("n IS NOT NULL")
    r = p.groupBy("portal_id").agg((F.max("n") - F.min("n") + 1 - F.countDistinct("n")).alias("missing"))
    return r.where("missing > 0")


@query("o36_reasons", """WITH last AS (SELECT url, outcome, note FROM (SELECT DISTINCT url, ts, outcome, note FROM crawl_log) QUALIFY row_number() OVER (PARTITION BY url ORDER BY ts DESC NULLS LAST, outcome DESC NULLS LAST, note DESC NULLS LAST) = 1)
SELECT url, coalesce(note, outcome) AS reason FROM last WHERE outcome <> 'ok'""")
def o36(s, d):
    last = ranking.latest(crawl(s, d).select("url", "ts", "outcome", "note"), ["url"], ["ts"])
    return last.where("outcome <> 'ok'").select("url", F.coalesce("note", "outcome").alias("reason"))


@query("o38_missing_reasons", "SELECT economy, coalesce(nullif(not_crawled_reason, ''), legal_status, '(none)') AS reason, count(*) AS n FROM law_census WHERE coalesce(document_url, '') = '' GROUP BY ALL")
def o38(s, d):
    c = census(s, d).where("coalesce(document_url, '') = ''")
    return c.groupBy("economy", F.coalesce(F.nullif("not_crawled_reason", F.lit("")), "legal_status", F.lit("(none)")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("o55_profile", "SELECT economy, series, count(*) AS rows, count(DISTINCT portal_id) AS laws, count(title) AS titled, min(snapshot_date) AS first, max(snapshot_date) AS last FROM law_census GROUP BY ALL")
def o55(s, d):
    return census(s, d).groupBy("economy", "series").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("portal_id").alias("laws"), F.count("title").alias("titled"), F.min("snapshot_date").alias("first"), F.max("snapshot_date").alias("last"))
