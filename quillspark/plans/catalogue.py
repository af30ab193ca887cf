"""Queries of the catalogue: how laws, links, files and runs hang together, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.plans.relations import _L, _listed
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
_ONE = _L.split("\nc AS")[0].rstrip(", \n")  # the listed rows alone


@query("o02_use_labels", "WITH k AS (SELECT DISTINCT url FROM crawl_log WHERE outcome = 'ok' AND url IS NOT NULL) SELECT row_id, CASE WHEN contains(title, 'Amendment') THEN CASE WHEN k.url IS NULL THEN 'linkage' ELSE 'linkage, text held' END WHEN k.url IS NOT NULL THEN 'evidence' ELSE 'evidence, text needed' END AS use FROM law_census c LEFT JOIN k ON c.document_url = k.url")
def o02(s, d):
    held = crawl(s, d).where("outcome = 'ok' AND url IS NOT NULL").select(C("url").alias("document_url")).distinct().withColumn("held", F.lit(True))
    use = F.when(C("title").contains("Amendment"), F.when(C("held").isNull(), "linkage").otherwise("linkage, text held")).when(C("held"), "evidence").otherwise("evidence, text needed")
    return census(s, d).join(held, "document_url", "left").select("row_id", use.alias("use"))


@query("o03_census_links_stored", _ONE + ", s AS (SELECT url, max(ts) AS stored FROM crawl_log WHERE outcome = 'ok' AND url IS NOT NULL GROUP BY 1) SELECT economy, portal_id, snapshot_date, document_url, s.stored, s.url IS NOT NULL AS held FROM l LEFT JOIN s ON l.document_url = s.url WHERE coalesce(document_url, '') <> ''")
def o03(s, d):
    stored = crawl(s, d).where("outcome = 'ok' AND url IS NOT NULL").groupBy(C("url").alias("document_url")).agg(F.max("ts").alias("stored"), F.lit(True).alias("held"))
    listed = _listed(s, d, "document_url").where("coalesce(document_url, '') <> ''")
    return listed.join(stored, "document_url", "left").select("economy", "portal_id", "snapshot_date", "document_url", "stored", F.coalesce("held", F.lit(False)).alias("held"))


@query("o04_census_table", _ONE + " SELECT economy, series, snapshot_date, count(*) AS laws, count_if(coalesce(document_url, '') <> '') AS with_address, count(DISTINCT version_id) AS versions FROM l GROUP BY ALL")
def o04(s, d):
    listed = _listed(s, d, "series", "document_url", "version_id")
    return listed.groupBy("economy", "series", "snapshot_date").agg(F.count(F.lit(1)).alias("laws"), F.count_if(F.coalesce("document_url", F.lit("")) != "").alias("with_address"), F.count_distinct("version_id").alias("versions"))


@query("o05_amended_since", _ONE + ", a AS (SELECT economy, title, max(published_on) AS amended_on FROM l WHERE title IS NOT NULL GROUP BY ALL) SELECT l.economy, l.portal_id, l.snapshot_date, a.amended_on FROM l JOIN a ON l.economy = a.economy AND l.last_amending_instrument = a.title WHERE a.amended_on > l.published_on")
def o05(s, d):
    listed = _listed(s, d, "title", "published_on", "last_amending_instrument")
    # one row per title before the join: a title that amends a tenth of the laws meets each of them once
    named = listed.where("title IS NOT NULL").groupBy("economy", C("title").alias("last_amending_instrument")).agg(F.max("published_on").alias("amended_on"))
    return listed.join(named, ["economy", "last_amending_instrument"]).where("amended_on > published_on").select("economy", "portal_id", "snapshot_date", "amended_on")


@query("o06_disputed_addresses", _ONE + ", u AS (SELECT document_url, count(DISTINCT portal_id) AS laws FROM l WHERE document_url <> '' GROUP BY 1) SELECT economy, l.portal_id, snapshot_date, laws > 1 AS disputed FROM l JOIN u USING (document_url)")
def o06(s, d):
    listed = _listed(s, d, "document_url").where("document_url <> ''")
    n = listed.groupBy("document_url").agg(F.count_distinct("portal_id").alias("laws"))
    return listed.join(n, "document_url").select("economy", "portal_id", "snapshot_date", (C("laws") > 1).alias("disputed"))


@query("o08_use_with_disputes", _ONE + ", u AS (SELECT document_url, count(DISTINCT portal_id) AS laws FROM l WHERE document_url <> '' GROUP BY 1), k AS (SELECT DISTINCT url FROM crawl_log WHERE outcome = 'ok' AND url IS NOT NULL) SELECT economy, portal_id, snapshot_date, CASE WHEN coalesce(l.document_url, '') = '' THEN 'not held' WHEN u.laws > 1 OR legal_status ILIKE '%repealed%' THEN 'linkage' WHEN k.url IS NULL THEN 'evidence, text stale' ELSE 'evidence' END AS use FROM l LEFT JOIN u USING (document_url) LEFT JOIN k ON l.document_url = k.url")
def o08(s, d):
    listed = _listed(s, d, "document_url", "legal_status")
    n = listed.where("document_url <> ''").groupBy("document_url").agg(F.count_distinct("portal_id").alias("laws"))
    held = crawl(s, d).where("outcome = 'ok' AND url IS NOT NULL").select(C("url").alias("document_url")).distinct().withColumn("held", F.lit(True))
    j = listed.join(n, "document_url", "left").join(held, "document_url", "left")
    use = F.when(F.coalesce("document_url", F.lit("")) == "", "not held").when((C("laws") > 1) | F.lower("legal_status").contains("repealed"), "linkage").when(C("held").isNull(), "evidence, text stale").otherwise("evidence")
    return j.select("economy", "portal_id", "snapshot_date", use.alias("use"))


@query("o09_scope_ranks", "SELECT document_url, min(CASE WHEN in_seed = 'true' THEN 0 WHEN in_relevant = 'true' THEN 1 WHEN in_all = 'true' THEN 2 ELSE 3 END) AS scope, min(row_id) AS first_seen, count(DISTINCT document_kinds) AS kinds FROM law_census WHERE document_url IS NOT NULL GROUP BY 1")
def o09(s, d):
    scope = F.when(C("in_seed") == "true", 0).when(C("in_relevant") == "true", 1).when(C("in_all") == "true", 2).otherwise(3)
    return census(s, d).where("document_url IS NOT NULL").groupBy("document_url").agg(F.min(scope).alias("scope"), F.min("row_id").alias("first_seen"), F.count_distinct("document_kinds").alias("kinds"))


@query("o16_validators", "SELECT url, ts, CASE WHEN status = 304 THEN 'unchanged' WHEN status = 200 AND (final_url IS NULL OR final_url = url) THEN 'same' WHEN status = 200 THEN 'changed' WHEN status BETWEEN 300 AND 399 OR len(redirect_chain) > 1 THEN 'redirect' WHEN status >= 400 THEN 'error' ELSE 'other' END AS verdict FROM crawl_log")
def o16(s, d):
    st = C("status")
    verdict = F.when(st == 304, "unchanged").when((st == 200) & (C("final_url").isNull() | (C("final_url") == C("url"))), "same").when(st == 200, "changed").when(st.between(300, 399) | (F.size("redirect_chain") > 1), "redirect").when(st >= 400, "error").otherwise("other")
    return crawl(s, d).select("url", "ts", verdict.alias("verdict"))


@query("o17_newest_to_floor", "SELECT law_number, max(published_on) AS published_on, arg_max(row_id, (published_on, row_id)) AS row_id FROM law_census WHERE published_on >= '2000-01-01' AND law_number <> '' GROUP BY 1")
def o17(s, d):
    c = census(s, d).where("published_on >= '2000-01-01' AND law_number <> ''")
    return c.groupBy("law_number").agg(F.max("published_on").alias("published_on"), F.max_by("row_id", F.struct("published_on", "row_id")).alias("row_id"))


@query("o18_pages", "SELECT host, ceil(count(*) / 25)::BIGINT AS pages FROM crawl_log GROUP BY 1")
def o18(s, d):
    return crawl(s, d).groupBy("host").agg(F.ceil(F.count(F.lit(1)) / 25).alias("pages"))


@query("o19_stored_first", "WITH k AS (SELECT DISTINCT url FROM crawl_log WHERE outcome = 'ok' AND url IS NOT NULL) SELECT upper(trim(portal_id)) AS portal_id, document_kinds, arg_min(document_url, (CASE WHEN k.url IS NULL THEN 1 ELSE 0 END, row_id)) AS document_url FROM law_census c LEFT JOIN k ON c.document_url = k.url WHERE document_url <> '' GROUP BY 1, 2")
def o19(s, d):
    held = crawl(s, d).where("outcome = 'ok' AND url IS NOT NULL").select(C("url").alias("document_url")).distinct().withColumn("held", F.lit(0))
    c = census(s, d).where("document_url <> ''").join(held, "document_url", "left")
    return c.groupBy(F.upper(F.trim("portal_id")).alias("portal_id"), "document_kinds").agg(F.min_by("document_url", F.struct(F.coalesce("held", F.lit(1)).alias("a"), C("row_id").alias("b"))).alias("document_url"))


@query("o20_batches", "SELECT user_id, event_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 7 AS batch FROM events")
def o20(s, d):
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    return table(s, d, "events").select("user_id", "event_id", F.floor(n / 7).alias("batch"))


@query("o21_partial_runs", "WITH r AS (SELECT economy, snapshot_date, count(*) AS n FROM law_census GROUP BY ALL), m AS (SELECT economy, max(n) AS most FROM r GROUP BY 1) SELECT economy, snapshot_date, n < 0.5 * most AS partial FROM r JOIN m USING (economy)")
def o21(s, d):
    r = census(s, d).groupBy("economy", "snapshot_date").agg(F.count(F.lit(1)).alias("n"))
    return r.join(r.groupBy("economy").agg(F.max("n").alias("most")), "economy").select("economy", "snapshot_date", (C("n") < 0.5 * C("most")).alias("partial"))


@query("o23_file_names", r"SELECT record_id, regexp_extract(source_url, '([^/=?#]+)\.([A-Za-z]+)(?:[?#]|$)', 1) AS name, lower(regexp_extract(source_url, '([^/=?#]+)\.([A-Za-z]+)(?:[?#]|$)', 2)) AS kind FROM records_la")
def o23(s, d):
    part = lambda k: F.regexp_extract("source_url", r"([^/=?#]+)\.([A-Za-z]+)(?:[?#]|$)", k)
    return records(s, d).select("record_id", part(1).alias("name"), F.lower(part(2)).alias("kind"))


@query("o25_expected_items", "WITH r AS (SELECT indicator_id, min(record_id) AS record_id FROM records_la GROUP BY 1) SELECT item_id, indicator, record_id FROM gold_items g LEFT JOIN r ON g.indicator = r.indicator_id")
def o25(s, d):
    first = records(s, d).groupBy(C("indicator_id").alias("indicator")).agg(F.min("record_id").alias("record_id"))
    return gold(s, d).join(first, "indicator", "left").select("item_id", "indicator", "record_id")


@query("o26_links_of_rows", r"""WITH m AS (SELECT record_id, '| [' || coalesce(article_section, '') || '](' || source_url || ') | [b](' || source_url || '#b) |' AS line FROM records_la), x AS (SELECT record_id, regexp_extract_all(line, '\]\(([^()\s]+)\)', 1) AS l FROM m), y AS (SELECT record_id, unnest(l) AS url, generate_subscripts(l, 1) - 1 AS pos FROM x) SELECT url, min(record_id) AS record_id, arg_min(pos, (record_id, pos))::BIGINT AS pos FROM y GROUP BY 1""")
def o26(s, d):
    line = F.concat(F.lit("| ["), F.coalesce("article_section", F.lit("")), F.lit("]("), C("source_url"), F.lit(") | [b]("), C("source_url"), F.lit("#b) |"))
    y = records(s, d).select("record_id", F.posexplode(F.regexp_extract_all(line, F.lit(r"\]\(([^()\s]+)\)"), 1)).alias("pos", "url"))
    return y.groupBy("url").agg(F.min("record_id").alias("record_id"), F.min_by("pos", F.struct("record_id", "pos")).cast("bigint").alias("pos"))


@query("o27_first_wins_union", "WITH u AS (SELECT source_url AS url, 0 AS list, record_id AS id FROM records_la UNION ALL SELECT source_url, 1, baseline_id FROM baseline_la UNION ALL SELECT url, 2, 0 FROM crawl_log) SELECT url, min(list) AS list, arg_min(id, (list, id)) AS id FROM u WHERE url IS NOT NULL GROUP BY 1")
def o27(s, d):
    lists = [records(s, d).select(C("source_url").alias("url"), F.lit(0).alias("list"), C("record_id").alias("id")), baseline(s, d).select(C("source_url").alias("url"), F.lit(1).alias("list"), C("baseline_id").alias("id")), crawl(s, d).select("url", F.lit(2).alias("list"), F.lit(0).cast("bigint").alias("id"))]
    u = lists[0].unionByName(lists[1]).unionByName(lists[2]).where("url IS NOT NULL")
    return u.groupBy("url").agg(F.min("list").alias("list"), F.min_by("id", F.struct("list", "id")).alias("id"))


@query("o28_still_missing", "SELECT row_id FROM law_census WHERE trim(coalesce(document_url, '')) = ''")
def o28(s, d):
    return census(s, d).where(F.trim(F.coalesce("document_url", F.lit(""))) == "").select("row_id")


@query("o31_last_outcomes", "WITH t AS (SELECT DISTINCT host, ts, url, outcome FROM crawl_log WHERE host IS NOT NULL AND ts IS NOT NULL), r AS (SELECT host, outcome, row_number() OVER (PARTITION BY host ORDER BY ts DESC, url DESC NULLS LAST, outcome DESC NULLS LAST) AS n FROM t) SELECT host, outcome, count(*) AS n FROM r WHERE n <= 50 GROUP BY ALL")
def o31(s, d):
    t = crawl(s, d).where("host IS NOT NULL AND ts IS NOT NULL").select("host", "ts", "url", "outcome").distinct()
    last = F.row_number().over(Window.partitionBy("host").orderBy(F.desc("ts"), F.desc_nulls_last("url"), F.desc_nulls_last("outcome")))
    return t.withColumn("n_", last).where("n_ <= 50").groupBy("host", "outcome").agg(F.count(F.lit(1)).alias("n"))


@query("o32_files_without_rows", "SELECT DISTINCT final_url AS url FROM crawl_log WHERE final_url IS NOT NULL AND final_url NOT IN (SELECT document_url FROM law_census WHERE document_url IS NOT NULL) AND final_url NOT IN (SELECT source_url FROM records_la WHERE source_url IS NOT NULL)")
def o32(s, d):
    named = census(s, d).select(C("document_url").alias("url")).unionByName(records(s, d).select(C("source_url").alias("url")))
    return crawl(s, d).where("final_url IS NOT NULL").select(C("final_url").alias("url")).distinct().join(named, "url", "left_anti")


@query("o33_declared_languages", "WITH a AS (SELECT instrument_id, min(lang) AS x FROM documents WHERE source = 'la_gazette' GROUP BY 1), b AS (SELECT instrument_id, min(lang) AS y, min(economy) AS z FROM documents GROUP BY 1) SELECT instrument_id, coalesce(x, y, z) AS language, CASE WHEN x IS NOT NULL THEN 'gazette' WHEN y IS NOT NULL THEN 'documents' WHEN z IS NOT NULL THEN 'economy' END AS declared_by FROM b LEFT JOIN a USING (instrument_id) WHERE instrument_id IS NOT NULL")
def o33(s, d):
    # one pass: the three sources are conditional aggregates
    x = F.min(F.when(C("source") == "la_gazette", C("lang")))
    g = documents(s, d).where("instrument_id IS NOT NULL").groupBy("instrument_id").agg(x.alias("x"), F.min("lang").alias("y"), F.min("economy").alias("z"))
    return g.select("instrument_id", F.coalesce("x", "y", "z").alias("language"), F.when(C("x").isNotNull(), "gazette").when(C("y").isNotNull(), "documents").when(C("z").isNotNull(), "economy").alias("declared_by"))


@query("o34_content_index", "SELECT sha256(text) AS digest, max(doc_id) AS doc_id, count(*) AS files FROM documents GROUP BY 1")
def o34(s, d):
    return documents(s, d).groupBy(F.sha2("text", 256).alias("digest")).agg(F.max("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("files"))


@query("o35_files_to_rows", r"SELECT doc_id, upper(string_split(instrument_id, '-')[1]) AS economy, string_split(instrument_id, '-')[2] AS law, try_cast(string_split(instrument_id, '-')[3] AS INT) AS part, lower(regexp_extract(source_url, '^https?://([^/:]+)', 1)) AS host FROM documents")
def o35(s, d):
    part = lambda k: F.try_element_at(F.split("instrument_id", "-"), F.lit(k))
    return documents(s, d).select("doc_id", F.upper(part(1)).alias("economy"), part(2).alias("law"), part(3).try_cast("int").alias("part"), F.lower(F.regexp_extract("source_url", "^https?://([^/:]+)", 1)).alias("host"))


@query("o37_held_per_economy", "SELECT economy, count(*) AS documents, count(DISTINCT instrument_id) AS instruments FROM documents GROUP BY 1")
def o37(s, d):
    return documents(s, d).groupBy("economy").agg(F.count(F.lit(1)).alias("documents"), F.count_distinct("instrument_id").alias("instruments"))


@query("o39_time_estimates", "SELECT host, round(count(*) * 1.5 + coalesce(sum(CASE WHEN status = 503 THEN 30 END), count(*) * 0.1), 6)::DOUBLE AS seconds FROM crawl_log GROUP BY 1")
def o39(s, d):
    n = F.count(F.lit(1))
    return crawl(s, d).groupBy("host").agg(F.round(n * 1.5 + F.coalesce(F.sum(F.when(C("status") == 503, 30)), n * 0.1), 6).alias("seconds"))


@query("o40_run_states", "SELECT host, CASE WHEN count_if(outcome IS NOT NULL) = 0 THEN '' WHEN count_if(outcome = 'ok') = count(*) THEN 'complete' WHEN count_if(outcome = 'blocked') > 0.2 * count(*) THEN 'stopped' WHEN count_if(outcome = 'ok') > 0 THEN 'running' ELSE 'not complete' END AS state FROM crawl_log GROUP BY 1")
def o40(s, d):
    n, of = F.count(F.lit(1)), (lambda x: F.count_if(C("outcome") == x))
    state = F.when(F.count("outcome") == 0, "").when(of("ok") == n, "complete").when(of("blocked") > 0.2 * n, "stopped").when(of("ok") > 0, "running").otherwise("not complete")
    return crawl(s, d).groupBy("host").agg(state.alias("state"))


@query("o41_stage_states", "SELECT snapshot_date, economy, CASE WHEN count_if(coalesce(document_url, '') <> '') = count(*) THEN 'complete' WHEN count_if(not_crawled_reason IS NOT NULL) > 0 THEN 'not complete' ELSE 'running' END AS state FROM law_census GROUP BY ALL")
def o41(s, d):
    whole = F.count_if(F.coalesce("document_url", F.lit("")) != "") == F.count(F.lit(1))
    return census(s, d).groupBy("snapshot_date", "economy").agg(F.when(whole, "complete").when(F.count("not_crawled_reason") > 0, "not complete").otherwise("running").alias("state"))


@query("o42_run_inventory", "SELECT snapshot_date, count(DISTINCT economy) AS economies, count(*) AS rows, max(delivered_at) AS ended FROM law_census GROUP BY 1")
def o42(s, d):
    return census(s, d).groupBy("snapshot_date").agg(F.count_distinct("economy").alias("economies"), F.count(F.lit(1)).alias("rows"), F.max("delivered_at").alias("ended"))


@query("o43_path_identities", "SELECT url, ts, string_split(url, '/')[3] AS site, string_split(url, '/')[5] AS batch, string_split(url, '/')[6] AS item FROM crawl_log")
def o43(s, d):
    part = lambda k: F.try_element_at(F.split("url", "/"), F.lit(k))
    return crawl(s, d).select("url", "ts", part(3).alias("site"), part(5).alias("batch"), part(6).alias("item"))


@query("o44_summed_costs", "SELECT law_row_id, coalesce(list_sum(list_transform(provisions, lambda p: coalesce(length(p.verbatim_snippet), 0)::DOUBLE)), 0.0) AS cost FROM records_cn")
def o44(s, d):
    cost = F.aggregate(F.coalesce("provisions", F.array()), F.lit(0.0), lambda a, p: a + F.coalesce(F.length(p["verbatim_snippet"]), F.lit(0)))
    return table(s, d, "records_cn").select("law_row_id", cost.alias("cost"))


@query("o45_fallback_set", "WITH i AS (SELECT DISTINCT indicator, bool_or(lang = 'zh') OVER (PARTITION BY indicator) AS marked FROM gold_items), n AS (SELECT count_if(marked) AS n FROM i) SELECT indicator FROM i, n WHERE CASE WHEN n > 0 THEN marked ELSE indicator LIKE '6.%' OR indicator LIKE '7.%' END")
def o45(s, d):
    i = gold(s, d).groupBy("indicator").agg(F.bool_or(C("lang") == "zh").alias("marked"))
    n = F.broadcast(i.agg(F.count_if("marked").alias("n")))  # one row
    return i.crossJoin(n).where(F.when(C("n") > 0, C("marked")).otherwise(C("indicator").like("6.%") | C("indicator").like("7.%"))).select("indicator")


@query("o46_with_block", "SELECT DISTINCT indicator_id FROM records_la WHERE indicator_id IN (SELECT indicator FROM gold_items)")
def o46(s, d):
    return records(s, d).select("indicator_id").distinct().join(broadcast_if_small(gold(s, d).select(C("indicator").alias("indicator_id")).distinct()), "indicator_id", "left_semi")


@query("o47_ids_in_prose", r"SELECT doc_id, list_sort(list_distinct(list_filter(regexp_extract_all(text, '(?:section|Section|clause) ([0-9]+)', 1), lambda x: length(x) <= 2))) AS ids FROM documents")
def o47(s, d):
    found = F.regexp_extract_all("text", F.lit(r"(?:section|Section|clause) ([0-9]+)"), 1)
    return documents(s, d).select("doc_id", F.array_sort(F.array_distinct(F.filter(found, lambda x: F.length(x) <= 2))).alias("ids"))


@query("o48_layered_flags", "WITH a AS (SELECT indicator, min(text) AS x FROM gold_items WHERE economy = 'AU' GROUP BY 1), b AS (SELECT indicator_id, min(law_name) AS y FROM baseline_la GROUP BY 1) SELECT record_id, CASE WHEN nullif(notes, '') IS NOT NULL THEN 'reviewed' WHEN x IS NOT NULL THEN 'gold' WHEN y IS NOT NULL THEN 'candidate' END AS layer FROM records_la r LEFT JOIN a ON r.indicator_id = a.indicator LEFT JOIN b USING (indicator_id)")
def o48(s, d):
    a = gold(s, d).where("economy = 'AU'").groupBy(C("indicator").alias("indicator_id")).agg(F.min("text").alias("x"))
    b = baseline(s, d).groupBy("indicator_id").agg(F.min("law_name").alias("y"))
    r = records(s, d).select("record_id", "indicator_id", "notes").join(broadcast_if_small(a), "indicator_id", "left").join(broadcast_if_small(b), "indicator_id", "left")
    return r.select("record_id", F.when(F.nullif("notes", F.lit("")).isNotNull(), "reviewed").when(C("x").isNotNull(), "gold").when(C("y").isNotNull(), "candidate").alias("layer"))


@query("o49_coverage_columns", "SELECT baseline_id, CASE WHEN indicator_id IS NULL THEN 'excluded' WHEN string_split(indicator_id, '.')[1] IN ('6', '7') THEN 'automated' ELSE 'manual' END AS coverage FROM baseline_la")
def o49(s, d):
    return baseline(s, d).select("baseline_id", F.when(C("indicator_id").isNull(), "excluded").when(F.split("indicator_id", r"\.")[0].isin("6", "7"), "automated").otherwise("manual").alias("coverage"))


@query("o50_numbered_lines", r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents), n AS (SELECT doc_id, pos, try_cast(regexp_extract(line, '^([0-9]+)\.$', 1) AS INT) AS n FROM l WHERE regexp_matches(line, '^[0-9]+\.$')), w AS (SELECT doc_id, n - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS off FROM n) SELECT doc_id, count(*) AS lines, min(off) = max(off) AS in_sequence FROM w GROUP BY 1""")
def o50(s, d):
    numbers = F.transform(F.filter(F.split("text", "\n"), lambda x: x.rlike(r"^[0-9]+\.$")), lambda x: F.regexp_extract(x, "^([0-9]+)", 1).try_cast("int"))
    off = F.transform("n", lambda x, i: x - i)  # within the array, so no window over lines
    n = documents(s, d).select("doc_id", numbers.alias("n")).where(F.size("n") > 0)
    return n.select("doc_id", F.size("n").cast("bigint").alias("lines"), (F.array_min(off) == F.array_max(off)).alias("in_sequence"))


@query("o51_rolled_up_fields", "WITH u AS (SELECT indicator_id, count(*) AS n FROM records_la WHERE confidence IS NULL GROUP BY 1), m AS (SELECT indicator_id, max(confidence) AS top FROM records_la GROUP BY 1) SELECT indicator_id, CASE WHEN u.n > 0 THEN 'unscored' ELSE coalesce(top, 'default') END AS field FROM m LEFT JOIN u USING (indicator_id) WHERE indicator_id IS NOT NULL")
def o51(s, d):
    g = records(s, d).where("indicator_id IS NOT NULL").groupBy("indicator_id").agg(F.count_if(C("confidence").isNull()).alias("n"), F.max("confidence").alias("top"))
    return g.select("indicator_id", F.when(C("n") > 0, "unscored").otherwise(F.coalesce("top", F.lit("default"))).alias("field"))


@query("o52_blocks", r"""WITH l AS (SELECT doc_id, string_split(text, chr(10) || chr(10)) AS b FROM documents) SELECT doc_id, len(b) AS blocks, len(list_filter(b, lambda x: regexp_matches(x, '^(PART|Division|Section|CAPÍTULO|Artigo)'))) AS with_marker FROM l""")
def o52(s, d):
    b = F.split("text", "\n\n")
    return documents(s, d).select("doc_id", F.size(b).cast("bigint").alias("blocks"), F.size(F.filter(b, lambda x: x.rlike("^(PART|Division|Section|CAPÍTULO|Artigo)"))).cast("bigint").alias("with_marker"))


@query("o53_directory_difference", "WITH a AS (SELECT instrument_id AS path, max(sha256(text)) AS h FROM documents WHERE lang = 'en' AND instrument_id IS NOT NULL GROUP BY 1), b AS (SELECT instrument_id AS path, max(sha256(text)) AS h FROM documents WHERE instrument_id IS NOT NULL GROUP BY 1) SELECT path, CASE WHEN a.h IS NULL THEN 'only right' WHEN b.h IS NULL THEN 'only left' ELSE 'differs' END AS difference FROM a FULL JOIN b USING (path) WHERE a.h IS DISTINCT FROM b.h")
def o53(s, d):
    doc = documents(s, d).where("instrument_id IS NOT NULL").select(C("instrument_id").alias("path"), F.sha2("text", 256).alias("h"), "lang")
    a, b = doc.where("lang = 'en'").groupBy("path").agg(F.max("h").alias("a")), doc.groupBy("path").agg(F.max("h").alias("b"))
    return a.join(b, "path", "full_outer").where("NOT (a <=> b)").select("path", F.when(C("a").isNull(), "only right").when(C("b").isNull(), "only left").otherwise("differs").alias("difference"))


@query("o54_paired_agreement", "WITH a AS (SELECT provision_id, indicator, bool_or(is_literal) AS x FROM gloss_tl WHERE model = 'gloss-base' GROUP BY ALL), b AS (SELECT provision_id, indicator, bool_or(is_literal) AS y FROM gloss_tl WHERE model = 'gloss-small' GROUP BY ALL) SELECT count(*) AS pairs, coalesce(count_if(x = y), 0)::BIGINT AS agree FROM a JOIN b ON a.provision_id = b.provision_id AND a.indicator IS NOT DISTINCT FROM b.indicator")
def o54(s, d):
    of = lambda m: F.bool_or(F.when(C("model") == m, C("is_literal")))
    there = lambda m: F.bool_or(C("model") == m)
    g = gloss(s, d).where("provision_id IS NOT NULL").groupBy("provision_id", "indicator").agg(of("gloss-base").alias("x"), of("gloss-small").alias("y"), there("gloss-base").alias("a"), there("gloss-small").alias("b"))
    return g.where("a AND b").agg(F.count(F.lit(1)).alias("pairs"), F.count_if(C("x") == C("y")).alias("agree"))


@query("o56_slices", "SELECT doc_id, upper(string_split(instrument_id, '-')[1]) AS prefix, coalesce(economy, upper(string_split(instrument_id, '-')[1])) AS economy FROM documents")
def o56(s, d):
    prefix = F.upper(F.split("instrument_id", "-")[0])
    return documents(s, d).select("doc_id", prefix.alias("prefix"), F.coalesce("economy", prefix).alias("economy"))
