"""Queries of segmentation, anchoring, merges, assembly and sinks over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.operators import ranking, segments
from quillspark.session import scratch, table
from quillspark.sources import files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
C = F.col


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _t(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda s, d: table(s, d, name)


documents, records, gloss, census, crawl, baseline, gold = (_t(n) for n in ("documents", "records_la", "gloss_tl", "law_census", "crawl_log", "baseline_la", "gold_items"))


# segmentation and anchors


@query("f10_bodies")
def f10(s, d):
    return segments.bodies(documents(s, d), "doc_id", "text")


@query("f11_sections", r"""WITH l AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents), p AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM l),
h AS (SELECT doc_id, length(text) AS n, start, regexp_extract(line, '^((?:PART|Division|CAPÍTULO|BAB|ໝວດທີ)|(?:Section|Artigo|Pasal|ມາດຕາ|Article)) ([0-9]+[A-Z]?)', ['unit', 'number']) AS x FROM p WHERE regexp_matches(line, '^(?:(?:PART|Division|CAPÍTULO|BAB|ໝວດທີ)|(?:Section|Artigo|Pasal|ມາດຕາ|Article)) [0-9]'))
SELECT doc_id, x.unit AS unit, x.number AS number, start, coalesce(lead(start) OVER (PARTITION BY doc_id ORDER BY start), n) AS "end" FROM h""")
def f11(s, d):
    lines = documents(s, d).select("doc_id", F.length("text").cast("bigint").alias("n"), F.split("text", "\n").alias("lines"))
    # where each line starts, by one fold over the lines
    step = lambda a, x: F.struct((a["at"] + F.length(x) + 1).alias("at"), F.when(x.rlike(_HEAD), F.array_append(a["found"], F.struct(a["at"].alias("start"), x.alias("line")))).otherwise(a["found"]).alias("found"))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<start:bigint,line:string>>").alias("found"))
    h = lines.select("doc_id", "n", F.explode(F.aggregate("lines", start, step, lambda a: a["found"])).alias("h"))
    part = lambda k: F.regexp_extract("h.line", _HEAD, k)
    return h.select("doc_id", part(1).alias("unit"), part(2).alias("number"), C("h.start").alias("start"), F.coalesce(F.lead("h.start").over(Window.partitionBy("doc_id").orderBy("h.start")), C("n")).alias("end"))


_HEAD = "^((?:PART|Division|CAPÍTULO|BAB|ໝວດທີ)|(?:Section|Artigo|Pasal|ມາດຕາ|Article)) ([0-9]+[A-Z]?)"


@query("i52_enclosing_sections", r"""WITH l AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents), p AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM l),
h AS (SELECT doc_id, length(text) AS n, start, regexp_extract(line, '^((?:PART|Division|CAPÍTULO|BAB|ໝວດທີ)|(?:Section|Artigo|Pasal|ມາດຕາ|Article)) ([0-9]+[A-Z]?)', ['unit', 'number']) AS x FROM p WHERE regexp_matches(line, '^(?:(?:PART|Division|CAPÍTULO|BAB|ໝວດທີ)|(?:Section|Artigo|Pasal|ມາດຕາ|Article)) [0-9]')), g AS (SELECT doc_id, list(start) AS l FROM h GROUP BY 1), t AS (SELECT doc_id, strpos(text, 'shall') - 1 AS a, strpos(text, 'shall') + 4 AS b FROM documents WHERE contains(text, 'shall'))
SELECT doc_id, coalesce(list_max(list_filter(l, lambda x: x <= a AND x >= a - 6000)), a)::BIGINT AS start, coalesce(list_min(list_filter(l, lambda x: x >= b AND x <= b + 8000)), b)::BIGINT AS "end" FROM t LEFT JOIN g USING (doc_id)""")
def i52(s, d):
    starts = f11(s, d).groupBy("doc_id").agg(F.collect_list("start").alias("l"))  # a text's headings: as many as the text has lines at most
    at = F.expr("instr(text, 'shall') - 1").cast("bigint")
    t = documents(s, d).where(C("text").contains("shall")).select("doc_id", at.alias("a")).join(starts, "doc_id", "left")
    return t.select("doc_id", segments.enclosing(C("l"), C("a"), C("a") + 5).alias("s")).select("doc_id", "s.start", "s.end")


_STYLES = (("decimal", r"^[0-9]+\.$"), ("plain", r"^(?:Section|Artigo|Pasal|ມາດຕາ) ?[0-9]+"), ("part", r"^(?:PART|Division|CAPÍTULO|BAB|ໝວດທີ) ?[0-9]+"))


@query("f13_styles", "WITH c AS (SELECT doc_id, " + ", ".join(f"len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{p}'))) AS {n}" for n, p in _STYLES) + " FROM documents) SELECT doc_id, " + ", ".join(n for n, _ in _STYLES) + ", CASE " + " ".join(f"WHEN {n} >= 3 THEN '{n}'" for n, _ in _STYLES) + " ELSE 'none' END AS style FROM c")
def f13(s, d):
    like = lambda p: lambda x: x.rlike(p)
    n = [F.size(F.filter(F.split("text", "\n"), like(p))).cast("bigint").alias(name) for name, p in _STYLES]
    style = F.when(C("decimal") >= 3, "decimal").when(C("plain") >= 3, "plain").when(C("part") >= 3, "part").otherwise("none")
    return documents(s, d).select("doc_id", *n).withColumn("style", style)


@query("i38_nearest_occurrences", "WITH p AS (SELECT doc_id, n_chars // 2 AS hint, unnest(string_split(text, 'shall')) AS part, generate_subscripts(string_split(text, 'shall'), 1) AS k, len(string_split(text, 'shall')) AS n FROM documents), a AS (SELECT doc_id, hint, sum(length(part)) OVER (PARTITION BY doc_id ORDER BY k) + 5 * (k - 1) AS pos, k, n FROM p) SELECT doc_id, arg_min(pos, (abs(pos - hint), pos))::BIGINT AS place FROM a WHERE k < n GROUP BY 1")
def i38(s, d):
    place = segments.nearest_occurrence(C("text"), "shall", F.floor(C("n_chars") / 2))
    return documents(s, d).select("doc_id", place.cast("bigint").alias("place")).where("place IS NOT NULL")


@query("i44_page_offsets", "WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10) || chr(10))) AS page, generate_subscripts(string_split(text, chr(10) || chr(10)), 1) AS k FROM documents) SELECT doc_id, (k - 1)::BIGINT AS page, (sum(length(page)) OVER (PARTITION BY doc_id ORDER BY k) - length(page) + 2 * (k - 1))::BIGINT AS start FROM p")
def i44(s, d):
    pages = documents(s, d).select("doc_id", F.posexplode(F.split("text", "\n\n")).alias("page", "body"))
    upto = Window.partitionBy("doc_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    return pages.select("doc_id", C("page").cast("bigint").alias("page"), (F.coalesce(F.sum(F.length("body")).over(upto), F.lit(0)) + 2 * C("page")).alias("start"))


@query("i48_grounded_numbers", r"WITH l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '(?:No\.|n\.º|Nomor) ?[0-9]+') AND NOT regexp_matches(lower(x), 'amend|repeal')) AS l FROM documents) SELECT doc_id, regexp_extract(l[1], '(?:No\.|n\.º|Nomor) ?([0-9]+)', 1) AS number FROM l WHERE len(l) > 0")
def i48(s, d):
    line = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"(?:No\.|n\.º|Nomor) ?[0-9]+") & ~F.lower(x).rlike("amend|repeal"))
    return documents(s, d).select("doc_id", line.alias("l")).where(F.size("l") > 0).select("doc_id", F.regexp_extract(C("l")[0], r"(?:No\.|n\.º|Nomor) ?([0-9]+)", 1).alias("number"))


@query("i49_grounded_dates", r"SELECT baseline_id, coalesce(nullif(regexp_extract(law_number_ref, 'dated ([0-9]{1,2} [A-Z][a-z]+ [0-9]{4})', 1), ''), nullif(regexp_extract(law_number_ref, '([0-9]{1,2}/[0-9]{1,2}/[0-9]{4})', 1), '')) AS value FROM baseline_la")
def i49(s, d):
    found = lambda p: F.nullif(F.regexp_extract("law_number_ref", p, 1), F.lit(""))
    return baseline(s, d).select("baseline_id", F.coalesce(found("dated ([0-9]{1,2} [A-Z][a-z]+ [0-9]{4})"), found("([0-9]{1,2}/[0-9]{1,2}/[0-9]{4})")).alias("value"))


# selection, merges, assembly


@query("f03_global_top", "WITH r AS (SELECT l_returnflag AS e, l_orderkey * 10 + l_linenumber AS pid, row_number() OVER (ORDER BY l_extendedprice DESC, l_orderkey * 10 + l_linenumber) AS rank FROM lineitem), t AS (SELECT * FROM r WHERE rank <= 1000) SELECT e, count(*) AS selected, min(rank) AS best, count(*) < 100 AS exhausted FROM t GROUP BY 1")
def f03(s, d):
    r = table(s, d, "lineitem").select(C("l_returnflag").alias("e"), (C("l_orderkey") * 10 + C("l_linenumber")).alias("pid"), "l_extendedprice")
    top = r.orderBy(F.desc("l_extendedprice"), "pid").limit(1000)  # each task keeps its own first thousand, so nothing is sorted whole
    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("l_extendedprice"), "pid")))
    return ranked.groupBy("e").agg(F.count(F.lit(1)).alias("selected"), F.min("rank").cast("bigint").alias("best"), (F.count(F.lit(1)) < 100).alias("exhausted"))


_ORDER = "snapshot_date DESC, delivered_at DESC, row_id DESC"


@query("f22_newest_run_wins", f"WITH a AS (SELECT * FROM law_census QUALIFY row_number() OVER (PARTITION BY economy, upper(trim(portal_id)) ORDER BY {_ORDER}) = 1), b AS (SELECT * FROM a QUALIFY document_url IS NULL OR row_number() OVER (PARTITION BY document_url ORDER BY {_ORDER}) = 1), o AS (SELECT economy, upper(trim(portal_id)) AS k, min(row_id) AS oldest FROM law_census GROUP BY ALL) SELECT b.row_id, o.oldest AS kept_id FROM b JOIN o ON b.economy IS NOT DISTINCT FROM o.economy AND upper(trim(b.portal_id)) IS NOT DISTINCT FROM o.k")
def f22(s, d):
    newest = lambda c: F.max_by(c, F.struct("snapshot_date", "delivered_at", "row_id"))
    # by identity, the oldest row's id kept; then by address; both as aggregates, so no task holds a law or an address
    a = census(s, d).groupBy("economy", F.upper(F.trim("portal_id")).alias("k")).agg(newest(F.struct("row_id", "document_url", "snapshot_date", "delivered_at")).alias("v"), F.min("row_id").alias("kept_id")).select("v.*", "kept_id")
    key = F.coalesce("document_url", F.concat(F.lit("\x00"), C("row_id").cast("string")))  # rows without an address stay apart
    return a.groupBy(key.alias("k")).agg(newest(F.struct("row_id", "kept_id")).alias("v")).select("v.*")


@query("g03_query_documents", "WITH r AS (SELECT indicator, text, row_number() OVER (PARTITION BY indicator ORDER BY item_id) AS n FROM gold_items) SELECT indicator, 'indicator ' || indicator || chr(10) || string_agg(left(text, 400), chr(10) ORDER BY n) AS query FROM r WHERE n <= 2 AND indicator IS NOT NULL GROUP BY 1")
def g03(s, d):
    first = ranking.ranked(gold(s, d).where("indicator IS NOT NULL").select("indicator", "item_id", "text"), ["indicator"], [C("item_id")]).where("rank <= 2")
    texts = F.transform(F.array_sort(F.collect_list(F.struct("item_id", "text"))), lambda x: F.substring(x["text"], 1, 400))
    return first.groupBy("indicator").agg(F.concat_ws("\n", F.concat(F.lit("indicator "), C("indicator")), F.array_join(texts, "\n")).alias("query"))


@query("k02_aligned_replies", "WITH r AS (SELECT law_row_id, list_transform(provisions, lambda p: p.record_id) AS asked, list_transform(list_filter(provisions, lambda p: coalesce(p.verbatim_snippet, '') <> ''), lambda p: p.record_id) AS answered FROM records_cn) SELECT law_row_id, CASE WHEN asked IS NULL THEN NULL WHEN list_sort(asked) = list_sort(answered) THEN 'by id' WHEN len(asked) = len(answered) THEN 'by position' END AS aligned FROM r")
def k02(s, d):
    ids = lambda a: F.transform(a, lambda p: p["record_id"])
    asked, answered = ids("provisions"), ids(F.filter("provisions", lambda p: F.coalesce(p["verbatim_snippet"], F.lit("")) != ""))
    return table(s, d, "records_cn").select("law_row_id", F.when(F.array_sort(asked) == F.array_sort(answered), "by id").when(F.size(asked) == F.size(answered), "by position").alias("aligned"))


@query("k04_assembled", "SELECT record_id, coalesce(nullif(economy, ''), 'LA') AS economy, trim(law_name) AS law_name, nullif(trim(law_number_ref), '') AS number, upper(trim(discovery_tag)) AS tag, coalesce(notes, '') AS notes, length(coalesce(verbatim_snippet, '')) AS letters, source_url IS NOT NULL AS has_source FROM records_la")
def k04(s, d):
    blank = lambda c: F.nullif(c, F.lit(""))
    return records(s, d).select("record_id", F.coalesce(blank(C("economy")), F.lit("LA")).alias("economy"), F.trim("law_name").alias("law_name"), blank(F.trim("law_number_ref")).alias("number"), F.upper(F.trim("discovery_tag")).alias("tag"), F.coalesce("notes", F.lit("")).alias("notes"), F.length(F.coalesce("verbatim_snippet", F.lit(""))).cast("bigint").alias("letters"), C("source_url").isNotNull().alias("has_source"))


@query("k06_cross_field_rules", "SELECT CASE WHEN verbatim_snippet <> '' AND coalesce(article_section, '') = '' THEN 'snippet without section' WHEN coalesce(verbatim_snippet, '') = '' AND article_section <> '' THEN 'section without snippet' ELSE 'kept' END AS rule, count(*) AS n FROM records_la GROUP BY 1")
def k06(s, d):
    empty = lambda c: F.coalesce(c, F.lit("")) == ""
    rule = F.when(~empty("verbatim_snippet") & empty("article_section"), "snippet without section").when(empty("verbatim_snippet") & ~empty("article_section"), "section without snippet").otherwise("kept")
    return records(s, d).groupBy(rule.alias("rule")).agg(F.count(F.lit(1)).alias("n"))


@query("k07_prompts", "SELECT gloss_id, left('law: ' || coalesce(law_name, '-') || chr(10) || 'section: ' || coalesce(article_section, '-') || chr(10) || original, 6000) AS prompt FROM gloss_tl")
def k07(s, d):
    named = lambda n, c: F.concat(F.lit(f"{n}: "), F.coalesce(c, F.lit("-")))
    return gloss(s, d).select("gloss_id", F.substring(F.concat_ws("\n", named("law", "law_name"), named("section", "article_section"), "original"), 1, 6000).alias("prompt"))


@query("l11_resume_state", "SELECT url, max(ts) AS last_seen, count_if(outcome IN ('ok', 'duplicate')) > 0 AS done FROM crawl_log WHERE url IS NOT NULL AND outcome IS NOT NULL GROUP BY 1")
def l11(s, d):
    return crawl(s, d).where("url IS NOT NULL AND outcome IS NOT NULL").groupBy("url").agg(F.max("ts").alias("last_seen"), F.bool_or(C("outcome").isin("ok", "duplicate")).alias("done"))


@query("a06_text_lookup", "SELECT doc_id, sha256(text) AS digest FROM documents WHERE source_url IN (SELECT document_url FROM law_census WHERE document_url IS NOT NULL) OR instrument_id IN (SELECT instrument_id FROM documents WHERE lang = 'lo')")
def a06(s, d):
    doc = documents(s, d)
    held = census(s, d).where("document_url IS NOT NULL").select(C("document_url").alias("source_url")).distinct().withColumn("a", F.lit(True))
    lao = doc.where("lang = 'lo' AND instrument_id IS NOT NULL").select("instrument_id").distinct().withColumn("b", F.lit(True))
    return doc.join(held, "source_url", "left").join(lao, "instrument_id", "left").where("a OR b").select("doc_id", F.sha2("text", 256).alias("digest"))


@query("a24_page_cache", "WITH h AS (SELECT doc_id, sha256(text) AS h, lang, source FROM documents), k AS (SELECT h, lang, min(doc_id) AS page FROM h WHERE lang IS NOT NULL GROUP BY ALL) SELECT doc_id, page, page IS NULL AS to_do FROM h LEFT JOIN k USING (h, lang)")
def a24(s, d):
    h = documents(s, d).select("doc_id", F.sha2("text", 256).alias("h"), "lang")
    cache = h.where("lang IS NOT NULL").groupBy("h", "lang").agg(F.min("doc_id").alias("page"))
    return h.join(cache, ["h", "lang"], "left").select("doc_id", "page", C("page").isNull().alias("to_do"))


# sinks: what is read again is what was written


_FIELDS = ["record_id", "indicator_id", "article_section", "confidence"]


@query("b01_twin_sinks", "SELECT record_id::VARCHAR AS record_id, nullif(indicator_id, '') AS indicator_id, nullif(article_section, '') AS article_section, nullif(confidence, '') AS confidence FROM records_la")
def b01(s, d):
    path = scratch(s, "sink")
    files.write_twins(records(s, d).select(*_FIELDS), path, _FIELDS)
    return files.read_strings(s, f"{path}/csv", _FIELDS)


@query("a08_json_lines", "SELECT record_id, indicator_id, article_section, confidence FROM records_la")
def a08(s, d):
    path = scratch(s, "sink")
    files.write_twins(records(s, d).select(*_FIELDS), path, _FIELDS)
    return files.read_lines(s, f"{path}/json", "record_id bigint, indicator_id string, article_section string, confidence string").where("_corrupt IS NULL").select(*_FIELDS)


@query("b03_one_folder_per_law", "SELECT economy, count(*) AS rows, min(doc_id) AS first FROM documents GROUP BY 1")
def b03(s, d):
    path = scratch(s, "sink")
    documents(s, d).select("doc_id", "economy", "title").repartition("economy").write.partitionBy("economy").json(path)
    back = s.read.schema("doc_id bigint, title string, economy string").json(path)
    return back.groupBy("economy").agg(F.count(F.lit(1)).alias("rows"), F.min("doc_id").alias("first"))


@query("b16_appended_runs", "SELECT stage, count(*) AS entries, sum(n)::BIGINT AS n FROM (SELECT 'listed' AS stage, count(*) AS n FROM law_census UNION ALL SELECT 'listed', count(*) FROM law_census UNION ALL SELECT 'filed', count(*) FROM records_la) GROUP BY 1")
def b16(s, d):
    path = scratch(s, "sink")
    for stage, df in (("listed", census(s, d)), ("listed", census(s, d)), ("filed", records(s, d))):
        files.append_events(df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(stage).alias("stage"), "n"), path)
    return files.read_lines(s, path, "stage string, n bigint").groupBy("stage").agg(F.count(F.lit(1)).alias("entries"), F.sum("n").alias("n"))


@query("b05_pair_rows", "SELECT record_id, round(try_cast(replace(trim(confidence), '%', '') AS DOUBLE) / 3, 6) AS score FROM records_la WHERE try_cast(replace(trim(confidence), '%', '') AS DOUBLE) IS NOT NULL")
def b05(s, d):
    path = scratch(s, "sink")
    score = F.round(F.replace(F.trim("confidence"), F.lit("%"), F.lit("")).try_cast("double") / 3, 6)
    records(s, d).select("record_id", score.alias("score")).where("score IS NOT NULL").write.json(path)
    return files.read_lines(s, path, "record_id bigint, score double").select("record_id", "score")


@query("b12_audit_trail", "SELECT gloss_id::VARCHAR AS line, CASE WHEN machine_translation THEN 'kept' ELSE 'removed' END AS decision, model AS model, note AS note FROM gloss_tl")
def b12(s, d):
    path = scratch(s, "sink")
    corrections = F.to_json(F.struct("model", "note"))
    lines = gloss(s, d).select(C("gloss_id").cast("string").alias("line"), F.when(C("machine_translation"), "kept").otherwise("removed").alias("decision"), corrections.alias("corrections"))
    files.write_twins(lines, path, ["line", "decision", "corrections"])
    back = files.read_strings(s, f"{path}/csv")
    return back.select("line", "decision", F.from_json("corrections", "model string, note string").alias("c")).select("line", "decision", "c.model", "c.note")
