"""Column functions over text: normal forms, token sets, keys, names and numbers of laws. All run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that say nothing in names of laws.
STOP = ("a", "an", "and", "act", "by", "for", "in", "law", "of", "on", "or", "the", "to", "with")


def collapse(c: Column) -> Column:
    """White space of any kind to single blanks, none at the ends."""
    return F.regexp_replace(F.regexp_replace(c, r"(?U)\s+", " "), r"^ | $", "")


def plain_name(c: Column) -> Column:
    """Lower case, single blanks, only ``[a-z0-9 ]``."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9\s]", ""), r"\s+", " "))


def tokens(c: Column, drop_numbers: str = "any") -> Column:
    """Distinct words of a name without stop words: ``drop_numbers`` 'any' drops words with a digit (I16), 'pure' only
    numbers (I20), 'none' keeps all (I25)."""
    words = F.array_distinct(F.filter(F.split(plain_name(c), " "), lambda w: (w != "") & ~w.isin(*STOP)))
    if drop_numbers == "any":
        return F.filter(words, lambda w: ~w.rlike("[0-9]"))
    if drop_numbers == "pure":
        return F.filter(words, lambda w: ~w.rlike("^[0-9]+$"))
    return words


def coverage(a: Column, b: Column) -> Column:
    """Share of ``a``'s tokens that ``b`` has; 0 for an empty ``a``."""
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a)).otherwise(F.lit(0.0))


def covers(a: Column, b: Column, least: float = 0.8) -> Column:
    """True if ``b`` covers ``a``; a single token must be all there is."""
    return F.when(F.size(a) == 1, F.array_sort(a) == F.array_sort(b)).otherwise(coverage(a, b) >= least)


def overlap(a: Column, b: Column) -> Column:
    """Common tokens in share of the smaller set; 0 if either is empty."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    """Common tokens in share of all; 0 if both are empty."""
    n = F.size(F.array_union(a, b))
    return F.when(n > 0, F.size(F.array_intersect(a, b)) / n).otherwise(F.lit(0.0))


def slug(c: Column, most: int = 80) -> Column:
    """Lower case, runs of other than letters and digits as ``_``; long ones are cut and marked with 8 hex digits of their
    hash, names without Latin letters are the hash alone (I03, I04)."""
    s = F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")
    mark = F.substring(F.sha2(c, 256), 1, 8)
    return F.when(F.length(s) == 0, F.concat(F.lit("x_"), mark)).when(F.length(s) > most, F.concat(F.substring(s, 1, most - 9), F.lit("_"), mark)).otherwise(s)


def acronym(c: Column) -> Column:
    """Initials of the words that say something, and the last year named."""
    words = F.filter(F.split(plain_name(c), " "), lambda w: (w != "") & ~w.isin("a", "an", "and", "by", "for", "in", "of", "on", "or", "the", "to", "with") & ~w.rlike("^[0-9]"))
    years = F.regexp_extract_all(c, F.lit(r"(?:^|[^0-9])((?:19|20)[0-9]{2})(?:$|[^0-9])"), 1)
    return F.concat(F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), ""), F.when(F.size(years) > 0, F.element_at(years, -1)).otherwise(F.lit("")))


def title_base(c: Column) -> Column:
    """Title without amendment note, year and kind, in capitals."""
    t = F.upper(collapse(F.translate(c, "‘’“”", "''\"\"")))
    t = F.regexp_replace(t, r"\s*[\(（][^\)）]*(?:AMENDMENT|AMENDED|REVISED|修订|ALTERAÇÃO)[^\)）]*[\)）]", "")
    return F.trim(F.regexp_replace(t, r"\s*(?:ACT|CODE|RULES|ORDER)?\s*(?:19|20)[0-9]{2}$", ""))


def act_number(c: Column) -> Column:
    """``N.o 012 /2024`` to ``12/2024``; null without a number (I32)."""
    n = F.regexp_extract(c, r"(?i)n\.?\s*[ºo°]?\.?\s*([0-9]+)\s*/\s*([0-9]{4})", 1)
    y = F.regexp_extract(c, r"(?i)n\.?\s*[ºo°]?\.?\s*([0-9]+)\s*/\s*([0-9]{4})", 2)
    return F.when(n != "", F.concat_ws("/", n.cast("long").cast("string"), y))


def citation_root(c: Column) -> Column:
    """First number with its letters: ``s.26(1)`` to ``26``."""
    return F.nullif(F.upper(F.regexp_extract(c, r"([0-9]+[A-Za-z]*)", 1)), F.lit(""))


def section_key(c: Column) -> Column:
    """Sortable form of a section: ``15A`` to (15, 'A'); no number sorts first."""
    number = F.nullif(F.regexp_extract(c, r"([0-9]+)", 1), F.lit("")).cast("int")
    return F.struct(F.coalesce(number, F.lit(-1)).alias("number"), F.upper(F.regexp_extract(c, r"[0-9]+([A-Za-z]*)", 1)).alias("letters"))


def dotted_key(c: Column) -> Column:
    """Sortable form of a dotted id: ``6.10`` after ``6.9``, never a float."""
    return F.transform(F.split(c, r"\."), lambda x: x.cast("int"))


def digit_mask(c: Column) -> Column:
    """Runs of digits as ``#``."""
    return F.regexp_replace(c, "[0-9]+", "#")


def strip_tags(c: Column) -> Column:
    """HTML without scripts, styles and tags, common entities resolved, single blanks."""
    t = F.regexp_replace(c, r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    t = F.regexp_replace(t, r"(?s)<[^>]*>", " ")
    for entity, ch in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(ch))
    return collapse(t)


def script_runs(c: Column) -> Column:
    """The ideographs and Lao letters of a text in a row."""
    return F.regexp_replace(c, r"[^一-鿿຀-໿]", "")


def references(c: Column) -> Column:
    """Articles and sections that a text cites, distinct, in order."""
    return F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(r"(?i)\b(?:section|article|artigo|pasal|clause|regulation)\s+([0-9]+[A-Z]?)"), 1), F.upper))


def urls_in(c: Column) -> Column:
    """Addresses in a text without closing punctuation, distinct, in order."""
    return F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(r"https?://[^\s<>\"']+"), 0), lambda u: F.regexp_replace(u, r"[.,;:)\]]+$", "")))


def context(text: Column, start: Column, end: Column, reach: int = 200) -> Column:
    """The span [start, end) of a text and ``reach`` code points on either side."""
    cut = lambda a, b: F.substring(text, a + F.lit(1), F.greatest(b - a, F.lit(0)))
    before = F.greatest(start - reach, F.lit(0))
    return F.struct(cut(before, start).alias("before"), cut(start, end).alias("snippet"), cut(end, end + reach).alias("after"))


def grounded(text: Column, snippet: Column, start: Column) -> Column:
    """True if the snippet stands at its place, letter by letter."""
    return F.coalesce(F.substring(text, start + F.lit(1), F.length(snippet)) == snippet, F.lit(False))


def prefixed(parts: list[Column], before: Column, body: Column, after: Column) -> Column:
    """Metadata joined by a broken bar, then the text with its surroundings."""
    return F.concat(F.concat_ws(" ¦ ", *parts), F.lit(" :: "), F.concat_ws(" ", before, body, after))


def numeral(c: Column) -> Column:
    """Chinese numeral up to 9,999 as a number; null for anything else (J09). 二十三 is 23, 十 is 10, 一百零五 is 105."""
    digit = F.create_map(*[x for i, ch in enumerate("零一二三四五六七八九") for x in (F.lit(ch), F.lit(i))], F.lit("〇"), F.lit(0), F.lit("两"), F.lit(2))
    unit = F.create_map(F.lit("十"), F.lit(10), F.lit("百"), F.lit(100), F.lit("千"), F.lit(1000))
    start = F.struct(F.lit(0).alias("sum"), F.lit(-1).alias("last"))

    def step(acc: Column, ch: Column) -> Column:
        u, d = F.try_element_at(unit, ch), F.try_element_at(digit, ch)
        one = F.when(acc["last"] < 0, F.lit(1)).otherwise(acc["last"])
        return F.struct(F.when(u.isNotNull(), acc["sum"] + one * u).otherwise(acc["sum"]).alias("sum"), F.when(u.isNotNull(), F.lit(-1)).otherwise(d).alias("last"))

    value = F.aggregate(F.split(c, ""), start, step, lambda acc: acc["sum"] + F.greatest(acc["last"], F.lit(0)))
    return F.when(c.rlike("^[零〇一二两三四五六七八九十百千]+$"), value)


def without_notes(c: Column) -> Column:
    """Name without its notes of revision or amendment, in plain form."""
    return plain_name(F.regexp_replace(c, r"(?i)\((?:revised|amendment|amended)[^)]*\)", " "))


def cited_roots(c: Column) -> Column:
    """Numbers with letters that cue words announce, distinct, in order."""
    return F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(r"(?i)(?:section|article|art\.|artigo|clause|pasal)\s*([0-9]+[A-Z]*)"), 1), F.upper))


def title_normal(c: Column) -> Column:
    """Capitals, straight quotes, single blanks."""
    return F.upper(F.trim(F.regexp_replace(F.translate(c, "‘’“”", "''\"\""), r"[ \t\r\n]+", " ")))


def amending_base(c: Column) -> Column:
    """What an amending title amends: the title before 'AMENDMENT ACT' and the year; null for other titles."""
    return F.nullif(F.trim(F.regexp_extract(title_normal(c), r"^(.*?)\(?AMENDMENT\)? ACT [0-9]{4}", 1)), F.lit(""))


def title_key(c: Column) -> Column:
    """Title in normal form without kind and year at its end."""
    return F.trim(F.regexp_replace(title_normal(c), r" *(?:ACT|RULES|ORDER|REGULATIONS)? *[0-9]{4}$", ""))


def title_core(c: Column) -> Column:
    """Title without book marks, notes in brackets and the country's name."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"[《》]|[(（][^()（）]*[)）]", ""), r"^中华人民共和国", ""))


def numbers_read_twice(c: Column) -> Column:
    """Numbers of the form n/yyyy in a text as it is and with its blanks removed, distinct and sorted."""
    found = lambda x: F.regexp_extract_all(x, F.lit(r"[0-9]+/[0-9]{4}"), 0)
    return F.array_sort(F.array_union(found(c), found(F.regexp_replace(c, r"[ \t\r\n]+", ""))))


def amended_number(c: Column) -> Column:
    """Number of the instrument that an amending title names."""
    return F.nullif(F.regexp_extract(c, r"(?iu)altera\S* (?:à|ao|da|do) .*?n\.?[ºo°]\.? *([0-9]+/[0-9]{4})", 1), F.lit(""))


def short_path(c: Column, most: int = 80) -> Column:
    """Path whose folders longer than ``most`` are cut and marked with 8 hex digits of their hash."""
    return F.array_join(F.transform(F.split(c, "/"), lambda p: F.when(F.length(p) > most, F.concat(F.substring(p, 1, most - 9), F.lit("-"), F.substring(F.sha2(p, 256), 1, 8))).otherwise(p)), "/")


def sentence_cut(c: Column, most: int = 1500) -> Column:
    """Text of at most ``most`` letters, cut after its last sentence end if it is longer."""
    head = F.substring(c, 1, most)
    return F.when(F.length(c) <= most, c).otherwise(F.coalesce(F.nullif(F.regexp_extract(head, r"(?s)^(.*[.!?。])", 1), F.lit("")), head))


def heading(c: Column) -> Column:
    """True for a line that is a heading in one of the scripts."""
    return F.coalesce(c.rlike(r"^(?:(?:PART|Part|Division|Section|SECTION|CAPÍTULO|Artigo|Pasal|BAB) ?[0-9]+|(?:ມາດຕາ|ໝວດທີ) ?[0-9]+|第[0-9一二三四五六七八九十百]+[条章])"), F.lit(False))


def error_rate(reference: Column, hypothesis: Column) -> Column:
    """Edits per letter of the reference; null for an empty one."""
    return F.when(F.length(reference) > 0, F.levenshtein(reference, hypothesis) / F.length(reference))
