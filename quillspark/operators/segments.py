"""Sections of texts, anchored quotes, page joins: what places in a text mean."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Headings of provisions in the languages of the corpus, at the start of a line.
HEADING = r"(?dm)^(?:(PART|Division|CAPÍTULO|BAB|ໝວດທີ)|(Section|Artigo|Pasal|ມາດຕາ|Article)) ([0-9]+[A-Z]?)\.?[ºo]?"


def headings(df: DataFrame, key: str, text: str, pattern: str = HEADING) -> DataFrame:
    """``key, number, unit, start``: every heading with its place in code points (A30, F11, I45). Texts without one give none."""
    n = F.regexp_count(F.col(text), F.lit(pattern))
    parts = F.split(F.col(text), pattern)
    hits = F.regexp_extract_all(F.col(text), F.lit(pattern), 0)
    # the place of the k-th heading is what the texts before it and the headings before it add up to
    ends = F.transform(F.sequence(F.lit(1), F.size(hits)), lambda k: F.aggregate(F.slice(parts, 1, k), F.lit(0), lambda a, p: a + F.length(p)) + F.aggregate(F.slice(hits, 1, k - 1), F.lit(0), lambda a, h: a + F.length(h)))
    rows = df.where(n > 0).select(key, F.explode(F.arrays_zip(hits.alias("h"), ends.alias("s"))).alias("z"))
    return rows.select(key, F.col("z.h").alias("heading"), F.regexp_extract("z.h", "([0-9]+[A-Z]?)", 1).alias("number"), F.regexp_extract("z.h", r"^(\S+)", 1).alias("unit"), F.col("z.s").alias("start"))


def sections(df: DataFrame, key: str, text: str, pattern: str = HEADING) -> DataFrame:
    """Sections from heading to the next heading or the end (F11, F14): ``key, unit, number, start, end``."""
    sizes = df.select(key, F.length(text).alias("n_"))
    w = Window.partitionBy(key).orderBy("start")
    return headings(df, key, text, pattern).join(sizes, key).withColumn("end", F.coalesce(F.lead("start").over(w), F.col("n_"))).drop("n_")


def _plain(text: str) -> tuple[str, list[int]]:
    """NFKC, case and punctuation folded, without white space; and the place of every kept character, so that spans map back."""
    out, at = [], []
    for i, ch in enumerate(text):
        for c in unicodedata.normalize("NFKC", ch).casefold():
            if not c.isspace() and unicodedata.category(c)[0] not in "PC":
                out.append(c)
                at.append(i)
    return "".join(out), at


def _loose(text: str) -> tuple[str, list[int]]:
    out, at = [], []
    for i, ch in enumerate(text):
        if ch.isspace():
            if out and out[-1] != " ":
                out.append(" ")
                at.append(i)
        else:
            out.append(ch.lower() if len(ch.lower()) == 1 else ch)
            at.append(i)
    return "".join(out), at


def anchor(quote: str | None, text: str | None) -> tuple[bool, str, int | None, int | None]:
    """Where a quote stands (I37, I39): exactly, else but for white space and case, else but for widths and punctuation.
    Empty quotes stand nowhere. (grounded, how, start, end) with the span of the source."""
    if not quote or not text or not quote.strip():
        return False, "none", None, None
    i = text.find(quote)
    if i >= 0:
        return True, "exact", i, i + len(quote)
    for how, form in (("whitespace", _loose), ("normalised", _plain)):
        (q, _), (t, at) = form(quote.strip()), form(text)
        if q and (i := t.find(q)) >= 0:
            return True, how, at[i], at[i + len(q) - 1] + 1
    return False, "none", None, None


def anchored(df: DataFrame, quote: str, text: str) -> DataFrame:
    """Adds ``grounded, how, start, end``."""

    @F.pandas_udf("grounded boolean, how string, start int, end int")
    def find(q: pd.Series, t: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame([anchor(a, b) for a, b in zip(q, t)], columns=["grounded", "how", "start", "end"])
        return out.astype({"start": "Int32", "end": "Int32"})

    return df.withColumn("a_", find(F.col(quote), F.col(text))).select(*df.columns, "a_.*")


def joined_pages(pages: DataFrame, doc: str, page: str, text: str, joiner: str = "\n") -> DataFrame:
    """Texts of documents from their pages, with the place of each page (I44): ``doc, text, pages array<struct<page, start>>``. A
    document is gathered whole, as it must be."""
    rows = pages.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct(F.col(page).alias("page"), F.coalesce(F.col(text), F.lit("")).alias("t")))).alias("p"))
    starts = F.transform(F.sequence(F.lit(1), F.size("p")), lambda k: F.struct(F.element_at("p", k)["page"].alias("page"), F.aggregate(F.slice("p", 1, k - 1), F.lit(0), lambda a, x: a + F.length(x["t"]) + len(joiner)).alias("start")))
    return rows.select(doc, F.array_join(F.transform("p", lambda x: x["t"]), joiner).alias("text"), starts.alias("pages"))


def error_rate(reference: Column, hypothesis: Column) -> Column:
    """Edits in share of the reference's length, white space collapsed; null for an empty reference."""
    a, b = (F.trim(F.regexp_replace(x, r"(?U)\s+", " ")) for x in (reference, hypothesis))
    return F.when(F.length(a) > 0, F.levenshtein(a, b) / F.length(a))


def greedy_groups(df: DataFrame, by: str, key: str, tokens: str, least: float = 0.8) -> DataFrame:
    """Rows in order of ``key`` join the first group whose first member covers them or is covered (D12). Order-dependent by
    definition, so it runs per ``by`` in one task: adds ``group_key``, the key of the group's first member."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    kind = df.schema[key].dataType.simpleString()

    def group(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(key, kind="stable")
        heads: list[tuple[object, set]] = []
        out = []
        for k, words in zip(g[key], g[tokens]):
            own = set(words if words is not None else ())
            for head, other in heads:
                if own and other and len(own & other) >= least * min(len(own), len(other)):
                    out.append(head)
                    break
            else:
                heads.append((k, own))
                out.append(k)
        return g.assign(group_key=out)

    return df.groupBy(by).applyInPandas(group, f"{fields}, group_key {kind}")


def repair_sequence(numbers: list[int | None], drift: int = 3) -> tuple[list[int], int]:
    """Numbers of headings in order, with those repaired that reading got wrong, and how many were (F15): a number up to
    ``drift`` above the expected one is accepted; one whose successor follows it starts a new count; any other becomes the
    expected one. Unread numbers (None) are repaired."""
    out, repaired, expected = [], 0, None
    for k, n in enumerate(numbers):
        after = numbers[k + 1] if k + 1 < len(numbers) else None
        fits = n is not None and (expected is None or expected <= n <= expected + drift or after == n + 1)
        if not fits:
            n, repaired = expected if expected is not None else 1, repaired + 1
        out.append(n)
        expected = n + 1
    return out, repaired


def stitched_body(numbers: list[int], continues: int = 3) -> list[int]:
    """Places of the headings that form the body of a text (F10): of the runs of rising numbers the widest, with the runs
    before and after it that continue it (their numbers lie beyond its ends by at most ``continues``); of a number that comes
    again only the first place counts."""
    runs: list[list[int]] = []
    for k, n in enumerate(numbers):
        if runs and n >= numbers[runs[-1][-1]]:
            runs[-1].append(k)
        else:
            runs.append([k])
    if not runs:
        return []
    widest = max(range(len(runs)), key=lambda r: (numbers[runs[r][-1]] - numbers[runs[r][0]], len(runs[r]), -r))
    body = list(runs[widest])
    for r in range(widest + 1, len(runs)):
        if 0 < numbers[runs[r][0]] - numbers[body[-1]] <= continues:
            body += runs[r]
    for r in range(widest - 1, -1, -1):
        if 0 < numbers[body[0]] - numbers[runs[r][-1]] <= continues:
            body = runs[r] + body
    seen: set[int] = set()
    return [k for k in body if not (numbers[k] in seen or seen.add(numbers[k]))]


def bodies(df: DataFrame, key: str, text: str, pattern: str = HEADING) -> DataFrame:
    """Per text with headings (F10, F15): ``key``, ``numbers`` as read, ``repaired`` numbers, how many were repaired, and the
    ``body``: places in the list that belong to it. Each text is decided by itself, in Arrow batches; null texts give none."""
    found = F.transform(F.regexp_extract_all(F.col(text), F.lit(pattern), 3), lambda x: F.regexp_extract(x, "([0-9]+)", 1).try_cast("int"))
    src = df.select(key, found.alias("numbers")).where(F.size("numbers") > 0)

    def fold(batches):
        for b in batches:
            lists = [[None if pd.isna(n) else int(n) for n in x] for x in b["numbers"]]
            done = [repair_sequence(x) for x in lists]
            yield b.assign(numbers=pd.Series(lists, dtype=object, index=b.index), repaired=pd.Series([d[0] for d in done], dtype=object, index=b.index), repairs=[d[1] for d in done], body=pd.Series([stitched_body(d[0]) for d in done], dtype=object, index=b.index))

    kind = df.schema[key].dataType.simpleString()
    return src.mapInPandas(fold, f"`{key}` {kind}, numbers array<int>, repaired array<int>, repairs int, body array<int>")


def nearest_occurrence(text: Column, needle: str, hint: Column) -> Column:
    """Place (from 0) of the occurrence of ``needle`` nearest to ``hint``, the first of equals; null without one."""
    start = F.struct(F.lit(0).alias("at"), F.lit(None).cast("int").alias("best"))
    here = lambda a, p: a["at"] + F.length(p)
    nearer = lambda a, p: a["best"].isNull() | (F.abs(here(a, p) - hint) < F.abs(a["best"] - hint))
    step = lambda a, p: F.struct((here(a, p) + len(needle)).alias("at"), F.when(nearer(a, p), here(a, p)).otherwise(a["best"]).alias("best"))
    parts = F.split(text, rf"\Q{needle}\E")
    return F.aggregate(F.slice(parts, F.lit(1), F.size(parts) - 1), start, step, lambda a: a["best"])


def enclosing(starts: Column, start: Column, end: Column, back: int = 6000, ahead: int = 8000) -> Column:
    """The section around a span (I52): from the last of the headings' ``starts`` (an array) at or before ``start``, at most ``back``
    before it, to the next at or after ``end``, at most ``ahead`` after it; where there is none the span's own end stays."""
    before = F.array_max(F.filter(starts, lambda x: (x <= start) & (x >= start - back)))
    after = F.array_min(F.filter(starts, lambda x: (x >= end) & (x <= end + ahead)))
    return F.struct(F.coalesce(before, start).alias("start"), F.coalesce(after, end).alias("end"))
