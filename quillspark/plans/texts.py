"""Queries of the column functions over whole tables: addresses, names, numbers, titles, dates, codes."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions import dates, text, urls
from quillspark.session import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def column(name: str, of: str, key: str, out, sql: str) -> None:
    """A query of one computed column beside the key of a table."""
    QUERIES[name] = lambda s, d: table(s, d, of).select(key, out().alias("value"))
    SQL[name] = f"SELECT {key}, {sql} AS value FROM {of}"


C = F.col
WS = "[ \\t\\r\\n]+"

# addresses
column("i02_https_urls", "records_la", "record_id", lambda: urls.https(C("source_url"), "gazette.la.example"), "CASE WHEN starts_with(trim(source_url), '/') THEN 'https://gazette.la.example' || trim(source_url) ELSE regexp_replace(trim(source_url), '^(?i)http://', 'https://') END")
column("i08_versioned_urls", "law_census", "row_id", lambda: urls.with_parameter(C("document_url"), "v", C("version_id")), "regexp_extract(document_url, '^([^#]*)', 1) || CASE WHEN contains(regexp_extract(document_url, '^([^#]*)', 1), '?') THEN '&' ELSE '?' END || 'v=' || url_encode(version_id) || regexp_extract(document_url, '(#.*)$', 1)")
column("i09_deep_links", "law_census", "row_id", lambda: urls.deep_link(C("document_url"), C("compilation_number"), F.when(C("economy") == "AU", "fragment").when(C("economy") == "TL", "query").otherwise("none")), "CASE WHEN economy NOT IN ('AU', 'TL') OR coalesce(compilation_number, '') = '' THEN document_url WHEN economy = 'TL' THEN document_url || CASE WHEN contains(document_url, '?') THEN '&' ELSE '?' END || 'anchor=' || compilation_number ELSE document_url || '#' || compilation_number END")
column("i10_short_paths", "records_la", "record_id", lambda: text.short_path(C("source_url"), 20), "array_to_string(list_transform(string_split(source_url, '/'), lambda p: CASE WHEN length(p) > 20 THEN left(p, 11) || '-' || left(sha256(p), 8) ELSE p END), '/')")
column("d24_url_hosts", "crawl_log", "url", lambda: urls.host(C("final_url")), "nullif(lower(regexp_extract(final_url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '')")
column("i27_urls_in_texts", "records_la", "record_id", lambda: text.urls_in(F.concat_ws(" ", C("notes"), F.lit("see"), C("source_url"), F.lit("and"), C("source_url"))), "")
SQL["i27_urls_in_texts"] = r"""WITH f AS (SELECT record_id, list_transform(regexp_extract_all(concat_ws(' ', notes, 'see', source_url, 'and', source_url), 'https?://[^\s<>"'']+'), lambda x: regexp_replace(x, '[.,;:)\]]+$', '')) AS l FROM records_la)
SELECT record_id, list_filter(l, lambda x, i: list_position(l, x) = i) AS value FROM f"""

# names
PLAIN = "trim(regexp_replace(regexp_replace(lower({0}), '[^a-z0-9\\s]', '', 'g'), '\\s+', ' ', 'g'))"
STOPPED = "list_filter(string_split(" + PLAIN + ", ' '), lambda w: w <> '' AND w NOT IN (" + ", ".join(f"'{w}'" for w in text.STOP) + "))"
column("i15_plain_names", "baseline_la", "baseline_id", lambda: text.plain_name(C("law_name")), PLAIN.format("law_name"))
column("i19_names_without_notes", "baseline_la", "baseline_id", lambda: text.without_notes(C("law_name")), PLAIN.format("regexp_replace(law_name, '(?i)\\((?:revised|amendment|amended)[^)]*\\)', ' ', 'g')"))
column("i20_tokens_with_letters", "baseline_la", "baseline_id", lambda: F.array_sort(text.tokens(C("law_name"), "pure")), "list_sort(list_distinct(list_filter(" + STOPPED.format("law_name") + ", lambda w: NOT regexp_matches(w, '^[0-9]+$'))))")
column("i25_all_tokens", "gloss_tl", "gloss_id", lambda: F.array_sort(text.tokens(C("english"), "none")), "list_sort(list_distinct(" + STOPPED.format("english") + "))")
TOKENS = "list_distinct(list_filter(" + STOPPED + ", lambda w: NOT regexp_matches(w, '[0-9]')))"
column("i18_coverage", "gloss_tl", "gloss_id", lambda: F.round(text.coverage(text.tokens(C("original")), text.tokens(C("english"))), 6), "")
SQL["i18_coverage"] = f"WITH t AS (SELECT gloss_id, english IS NULL AS none, {TOKENS.format('original')} AS a, {TOKENS.format('english')} AS b FROM gloss_tl) SELECT gloss_id, CASE WHEN len(a) = 0 THEN 0 WHEN none THEN NULL ELSE round(len(list_filter(a, lambda x: list_contains(b, x))) / len(a), 6) END AS value FROM t"
column("d07_same_law", "gloss_tl", "gloss_id", lambda: F.coalesce(text.covers(text.tokens(C("original")), text.tokens(C("english"))), F.lit(False)), "")
SQL["d07_same_law"] = f"WITH t AS (SELECT gloss_id, {TOKENS.format('original')} AS a, {TOKENS.format('english')} AS b FROM gloss_tl) SELECT gloss_id, coalesce(CASE WHEN len(a) = 1 THEN list_sort(a) = list_sort(b) WHEN len(a) = 0 THEN false ELSE len(list_filter(a, lambda x: list_contains(b, x))) / len(a) >= 0.8 END, false) AS value FROM t"
column("i04_compact_slugs", "gloss_tl", "gloss_id", lambda: text.slug(C("law_name"), 24), "")
SQL["i04_compact_slugs"] = "WITH s AS (SELECT gloss_id, law_name, regexp_replace(regexp_replace(lower(law_name), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS s FROM gloss_tl) SELECT gloss_id, CASE WHEN length(s) = 0 THEN 'x_' || left(sha256(law_name), 8) WHEN length(s) > 24 THEN left(s, 15) || '_' || left(sha256(law_name), 8) ELSE s END AS value FROM s"
column("i05_acronyms", "law_census", "row_id", lambda: text.acronym(C("title")), "")
SQL["i05_acronyms"] = f"WITH w AS (SELECT row_id, list_filter(string_split({PLAIN.format('title')}, ' '), lambda w: w <> '' AND w NOT IN ('a', 'an', 'and', 'by', 'for', 'in', 'of', 'on', 'or', 'the', 'to', 'with') AND NOT regexp_matches(w, '^[0-9]')) AS w, regexp_extract_all(title, '(?:^|[^0-9])((?:19|20)[0-9]{{2}})(?:$|[^0-9])', 1) AS y FROM law_census) SELECT row_id, array_to_string(list_transform(w, lambda x: left(x, 1)), '') || CASE WHEN len(y) > 0 THEN y[len(y)] ELSE '' END AS value FROM w"
column("i06_digests", "documents", "doc_id", lambda: F.sha2(C("text"), 256), "sha256(text)")
column("i17_script_keys", "records_la", "record_id", lambda: text.script_runs(C("law_name")), "regexp_replace(law_name, '[^一-鿿຀-໿]', '', 'g')")
column("i23_cited_roots", "documents", "doc_id", lambda: text.cited_roots(C("text")), "")
SQL["i23_cited_roots"] = "WITH r AS (SELECT doc_id, list_transform(regexp_extract_all(text, '(?i)(?:section|article|art\\.|artigo|clause|pasal)\\s*([0-9]+[A-Z]*)', 1), lambda x: upper(x)) AS l FROM documents) SELECT doc_id, list_filter(l, lambda x, i: list_position(l, x) = i) AS value FROM r"
column("i24_single_blanks", "records_la", "record_id", lambda: F.trim(F.regexp_replace(C("mapping_rationale"), WS, " ")), f"trim(regexp_replace(mapping_rationale, '{WS}', ' ', 'g'))")
NORMAL = f"upper(trim(regexp_replace(translate(title, '‘’“”', '''''\"\"'), '{WS}', ' ', 'g')))"
column("i28_normal_titles", "law_census", "row_id", lambda: text.title_normal(C("title")), NORMAL)
column("i29_amended_titles", "law_census", "row_id", lambda: text.amending_base(C("title")), f"nullif(trim(regexp_extract({NORMAL}, '^(.*?)\\(?AMENDMENT\\)? ACT [0-9]{{4}}', 1)), '')")
column("i30_title_keys", "law_census", "row_id", lambda: text.title_key(C("title")), f"trim(regexp_replace({NORMAL}, ' *(?:ACT|RULES|ORDER|REGULATIONS)? *[0-9]{{4}}$', ''))")
column("i35_title_cores", "law_census", "row_id", lambda: text.title_core(C("title")), "trim(regexp_replace(regexp_replace(title, '[《》]|[(（][^()（）]*[)）]', '', 'g'), '^中华人民共和国', ''))")
column("i31_listed_numbers", "law_census", "row_id", lambda: F.transform(F.regexp_extract_all(C("law_number"), F.lit(r"No\. ([0-9]+, [0-9]{4})"), 1), lambda x: F.replace(x, F.lit(", "), F.lit("/"))), "list_transform(regexp_extract_all(law_number, 'No\\. ([0-9]+, [0-9]{4})', 1), lambda x: replace(x, ', ', '/'))")
column("i33_amended_numbers", "law_census", "row_id", lambda: text.amended_number(C("title")), "nullif(regexp_extract(title, '(?i)altera\\S* (?:à|ao|da|do) .*?n\\.?[ºo°]\\.? *([0-9]+/[0-9]{4})', 1), '')")
column("i34_numbers_read_twice", "law_census", "row_id", lambda: text.numbers_read_twice(C("title")), f"list_sort(list_distinct(list_concat(regexp_extract_all(title, '[0-9]+/[0-9]{{4}}'), regexp_extract_all(regexp_replace(title, '{WS}', '', 'g'), '[0-9]+/[0-9]{{4}}'))))")
column("i37_grounded", "gloss_tl", "gloss_id", lambda: text.grounded(C("original"), C("english"), F.lit(0)), "coalesce(left(original, length(english)) = english, false)")
column("i45_headings", "documents", "doc_id", lambda: F.size(F.filter(F.split("text", "\n"), text.heading)).cast("bigint"), "len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '^(?:(?:PART|Part|Division|Section|SECTION|CAPÍTULO|Artigo|Pasal|BAB) ?[0-9]+|(?:ມາດຕາ|ໝວດທີ) ?[0-9]+|第[0-9一二三四五六七八九十百]+[条章])')))")
column("i46_sentence_cuts", "documents", "doc_id", lambda: text.sentence_cut(C("text"), 500), "CASE WHEN length(text) <= 500 THEN text ELSE coalesce(nullif(regexp_extract(left(text, 500), '(?s)^(.*[.!?。])', 1), ''), left(text, 500)) END")
column("i47_grounded_titles", "documents", "doc_id", lambda: F.nullif(F.expr("instr(text, title)"), F.lit(0)).cast("bigint"), "nullif(strpos(text, title), 0)")
column("i50_composite_ids", "gloss_tl", "gloss_id", lambda: F.concat_ws("#", F.split("provision_id", "#")[0], F.nullif(F.concat(F.lit("a"), F.regexp_extract("provision_id", "#a([0-9]+)#", 1)), F.lit("a")), "article_section"), "concat_ws('#', string_split(provision_id, '#')[1], nullif('a' || regexp_extract(provision_id, '#a([0-9]+)#', 1), 'a'), article_section)")
column("i53_error_rates", "records_la", "record_id", lambda: F.round(text.error_rate(text.plain_name(C("law_name")), text.plain_name(C("notes"))), 6), "CASE WHEN length({0}) > 0 THEN round(levenshtein({0}, {1}) / length({0}), 6) END".format(PLAIN.format("law_name"), PLAIN.format("notes")))
column("i13_tags", "law_census", "row_id", lambda: text.strip_tags(F.concat(F.lit("<div class='x'><b>"), C("law_number"), F.lit("</b>&nbsp;&amp;<script>a<b</script> "), C("series"), F.lit("</div>"))), "trim(regexp_replace(law_number || ' & ' || series, '\\s+', ' ', 'g'))")


def per_text(f: Callable[[str], str]):
    """A function of one text as an Arrow-batched column function; null stays null."""

    @F.pandas_udf(T.StringType())
    def run(c: pd.Series) -> pd.Series:
        return c.map(f, na_action="ignore")

    return run


def _unaccented(t: str) -> str:
    import unicodedata

    return "".join(ch for ch in unicodedata.normalize("NFD", t) if unicodedata.category(ch) != "Mn").upper()


def _composed(t: str) -> str:
    import re
    import unicodedata

    t = unicodedata.normalize("NFC", t).replace("ຫນ", "ໜ").replace("ຫມ", "ໝ")
    return re.sub("[ \t\r\n\xa0]+", " ", t).strip(" ")


def _canonical(t: str) -> str:
    import re
    import unicodedata

    return re.sub("[\x00-\x08\x0b-\x1f\x7f]", "", unicodedata.normalize("NFC", t.replace("\r\n", "\n").replace("\r", "\n"))).replace("�", "")


column("i11_unaccented", "gloss_tl", "gloss_id", lambda: per_text(_unaccented)(C("law_name")), "upper(strip_accents(law_name))")
column("i12_composed", "records_la", "record_id", lambda: per_text(_composed)(C("law_name")), "trim(regexp_replace(replace(replace(nfc_normalize(law_name), 'ຫນ', 'ໜ'), 'ຫມ', 'ໝ'), '[ \\t\\r\\n\\x{00a0}]+', ' ', 'g'))")
column("i41_canonical_texts", "documents", "doc_id", lambda: per_text(_canonical)(C("title")), "replace(regexp_replace(nfc_normalize(replace(replace(title, chr(13) || chr(10), chr(10)), chr(13), chr(10))), '[\\x00-\\x08\\x0b-\\x1f\\x7f]', '', 'g'), '�', '')")

# dates
_MONTH = " ".join(f"WHEN '{m}' THEN {n}" for m, n in dates.MONTHS.items())
_PARTS = r"""CASE WHEN regexp_matches({x}, '^[0-9]{{4}}-') THEN [left({x}, 4), substr({x}, 6, 2), substr({x}, 9, 2)] WHEN contains({x}, ' ') THEN [right({x}, 4), CASE lower(regexp_extract({x}, '[A-Za-z]+')) MONTHS END::VARCHAR, regexp_extract({x}, '^[0-9]+')] ELSE [right({x}, 4), regexp_extract({x}, '^[0-9]+[-/]([0-9]+)', 1), regexp_extract({x}, '^[0-9]+')] END""".replace("MONTHS", _MONTH)
_ISO = "list_transform(list_filter(list_transform({l}, lambda x: list_transform({p}, lambda y: y::INTEGER)), lambda d: d[2] BETWEEN 1 AND 12 AND d[3] BETWEEN 1 AND 31), lambda d: printf('%04d-%02d-%02d', d[1], d[2], d[3]))"


def _dates(c: str) -> str:
    return _ISO.format(l=f"regexp_extract_all({c}, '{dates._ANY}', 1)", p=_PARTS.format(x="x"))


column("j01_dates", "documents", "doc_id", lambda: dates.all_dates(C("text")), _dates("text"))
column("j02_first_dates", "baseline_la", "baseline_id", lambda: dates.first_date(C("law_number_ref")), f"({_dates('law_number_ref')})[1]")
column("j03_effective_dates", "baseline_la", "baseline_id", lambda: dates.earliest_date(C("law_number_ref"), C("law_date")), f"coalesce(list_min({_dates('law_number_ref')}), law_date)")
column("j05_day_first_dates", "baseline_la", "baseline_id", lambda: dates.day_first(C("law_date")), "")
SQL["j05_day_first_dates"] = r"WITH p AS (SELECT baseline_id, regexp_extract(law_date, '^\s*([0-9]{1,2})[-/]([0-9]{1,2})[-/]([0-9]{4})\s*$', ['d', 'm', 'y']) AS p FROM baseline_la) SELECT baseline_id, CASE WHEN p.y <> '' AND try_cast(p.m AS INT) BETWEEN 1 AND 12 AND try_cast(p.d AS INT) BETWEEN 1 AND 31 THEN printf('%04d-%02d-%02d', try_cast(p.y AS INT), try_cast(p.m AS INT), try_cast(p.d AS INT)) END AS value FROM p"
column("j06_display_dates", "baseline_la", "baseline_id", lambda: dates.display_date(F.nullif(F.regexp_extract("law_number_ref", "([0-9]{1,2} [A-Z][a-z]+ [0-9]{4})", 1), F.lit(""))), "try_strptime(regexp_extract(law_number_ref, '([0-9]{1,2} [A-Z][a-z]+ [0-9]{4})', 1), '%d %B %Y')::DATE")
column("j07_stamps", "law_census", "row_id", lambda: dates.stamp(F.replace(C("published_on"), F.lit("-"), F.lit(""))), "CASE WHEN regexp_matches(replace(published_on, '-', ''), '^[0-9]{8}$') THEN left(replace(published_on, '-', ''), 4) || '-' || substr(replace(published_on, '-', ''), 5, 2) || '-' || right(replace(published_on, '-', ''), 2) END")
column("j08_floor_dates", "law_census", "row_id", lambda: F.date_sub(F.try_to_date("published_on", "yyyy-MM-dd"), 30), "(try_strptime(published_on, '%Y-%m-%d')::DATE - 30)::DATE")
column("j13_language_names", "gloss_tl", "gloss_id", lambda: dates.language_name(dates.language_code(C("language_of_source"))), "")
_CODE = "regexp_replace(lower(trim(language_of_source)), '[-_].*$', '')"
_CASES = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in dates.LANGUAGES.items())
SQL["j13_language_names"] = f"WITH c AS (SELECT gloss_id, coalesce(CASE {_CODE} {_CASES} END, {_CODE}) AS c FROM gloss_tl) SELECT gloss_id, coalesce(CASE c " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in dates.LANGUAGE_NAMES.items()) + " END, '') AS value FROM c"
column("j15_language_offsets", "documents", "doc_id", lambda: F.coalesce(F.try_element_at(F.create_map(F.lit("lo"), F.lit(0.12), F.lit("zh"), F.lit(0.08)), C("lang")), F.lit(0.05)), "coalesce(CASE lang WHEN 'lo' THEN 0.12 WHEN 'zh' THEN 0.08 END, 0.05)::DOUBLE")
column("j17_tri_states", "records_la", "record_id", lambda: F.when(C("confidence").isNull(), "undeclared").when(F.trim("confidence") == "", "null").when(F.trim("confidence").rlike("^[0-9.]+%?$"), "number").otherwise("text"), "CASE WHEN confidence IS NULL THEN 'undeclared' WHEN trim(confidence) = '' THEN 'null' WHEN regexp_matches(trim(confidence), '^[0-9.]+%?$') THEN 'number' ELSE 'text' END")
column("j20_language_packs", "documents", "doc_id", lambda: F.when(C("lang").isin("en", "pt", "id"), "latin").when(C("lang") == "lo", "lao").when(C("lang") == "zh", "han").otherwise("fallback"), "CASE WHEN lang IN ('en', 'pt', 'id') THEN 'latin' WHEN lang = 'lo' THEN 'lao' WHEN lang = 'zh' THEN 'han' ELSE 'fallback' END")


def query(name: str, sql: str):
    def add(f: Query) -> Query:
        QUERIES[name], SQL[name] = f, sql
        return f

    return add


#: Words that tell a language, strong and weak.
TELLING = {"en": (r"\b(?:shall|must)\b", r"\b(?:the|of)\b"), "pt": (r"\b(?:artigo|deve)\b", r"\b(?:que|para)\b"), "id": (r"\b(?:pasal|wajib)\b", r"\b(?:yang|dan)\b")}


def _score(lang: str, n) -> str:
    strong, weak = TELLING[lang]
    return f"3 * {n.format(strong)} + {n.format(weak)}"


@query("j19_telling_words", "WITH s AS (SELECT doc_id, " + ", ".join(_score(x, "len(regexp_extract_all(lower(text), '{0}'))") + f" AS {x}" for x in TELLING) + ") FROM documents), r AS (SELECT doc_id, unnest(['en', 'pt', 'id']) AS lang, unnest([en, pt, id]) AS n FROM s) SELECT doc_id, arg_max(lang, (n, lang)) FILTER (n >= 3) AS lang FROM r GROUP BY 1".replace(") FROM documents)", " FROM documents)"))
def j19(s, d):
    low = F.lower("text")
    count = lambda p: F.size(F.regexp_extract_all(low, F.lit(p), 0))
    scores = F.array(*[F.struct((3 * count(a) + count(b)).alias("n"), F.lit(x).alias("lang")) for x, (a, b) in TELLING.items()])
    best = F.array_max(F.filter(scores, lambda x: x["n"] >= 3))
    return table(s, d, "documents").select("doc_id", best["lang"].alias("lang"))


_DIGITS = "translate(n, '零〇一二两三四五六七八九', '001223456789')"


@query("j09_numerals", f"""WITH p AS (SELECT unnest(provisions) AS p FROM records_cn), a AS (SELECT p.record_id AS record_id, regexp_extract(p.article_section, '[零〇一二两三四五六七八九十百千]+') AS n FROM p), b AS (SELECT record_id, n, {_DIGITS} AS t FROM a)
SELECT record_id, CASE WHEN n <> '' THEN """ + " + ".join(f"CASE WHEN contains(t, '{u}') THEN coalesce(try_cast(nullif(regexp_extract(t, '([0-9]?){u}', 1), '') AS INT), 1) * {k} ELSE 0 END" for u, k in (("千", 1000), ("百", 100), ("十", 10))) + " + coalesce(try_cast(nullif(regexp_extract(t, '([0-9])$', 1), '') AS INT), 0) END AS value FROM b")
def j09(s, d):
    p = table(s, d, "records_cn").select(F.explode("provisions").alias("p")).select("p.record_id", F.regexp_extract("p.article_section", "[零〇一二两三四五六七八九十百千]+", 0).alias("n"))
    return p.select("record_id", text.numeral(C("n")).alias("value"))

