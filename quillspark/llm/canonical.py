"""One consistent form for text that looks the same but differs in its characters.

Method: script-aware repair. Widths, ligatures, composed accents, invisible characters and blanks are folded character
by character. Letters that look like another script's are replaced only inside tokens that mix scripts, towards the
token's dominant script, and only if the result is a word of the corpus.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.session import broadcast_if_small, cut

#: Letters of Latin, Cyrillic and Greek that are drawn alike, one line for each shape ('-' where a script has none).
LOOK_ALIKES = """
A А Α
B В Β
C С -
E Е Ε
H Н Η
I І Ι
J Ј -
K К Κ
M М Μ
N - Ν
O О Ο
P Р Ρ
S Ѕ -
T Т Τ
X Х Χ
Y Ү Υ
Z - Ζ
a а -
c с -
d ԁ -
e е -
h һ -
i і -
j ј -
o о ο
p р -
q ԛ -
s ѕ -
v ѵ ν
w ԝ -
x х -
y у -
"""
SCRIPTS = ("LATIN", "CYRILLIC", "GREEK")
#: Compatibility characters (Unicode tag <compat>) drawn like their parts: ranges of code points.
ALIKE_COMPAT = ((0x00A0, 0x00A0), (0x0132, 0x0133), (0x01C4, 0x01CC), (0x01F1, 0x01F3), (0x0E33, 0x0E33), (0x0EB3, 0x0EB3), (0x0EDC, 0x0EDD), (0x2000, 0x200A), (0x2024, 0x2026), (0x202F, 0x202F), (0x205F, 0x205F), (0x2160, 0x217F), (0x2E9F, 0x2E9F), (0x2EF3, 0x2EF3), (0x2F00, 0x2FD5), (0x3000, 0x3000), (0xFB00, 0xFB06))
#: Single characters drawn like another one of the same script.
ALIKE_SINGLE = {"‐": "-", "‑": "-", "ʼ": "’", "Ð": "Đ", "Ɖ": "Đ"}
#: Characters that are not drawn at all, besides Unicode's category Cf.
INVISIBLE = ((0x034F, 0x034F), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xE0100, 0xE01EF))

#: Any letter whose row may hold a token of several scripts: Greek or Cyrillic.
_OTHER_SCRIPT = r"[Ͱ-ϿЀ-ԯ]"
#: Letters of the scripts of LOOK_ALIKES, of any width.
_ANY_SCRIPT = r"[A-Za-zÀ-ɏḀ-ỿͰ-ϿЀ-ԯＡ-ｚ]"
_TOKEN = re.compile(r"[^\W\d_]+(?:[̀-ͯ]+[^\W\d_]*)*")
_SYLLABLE = (
    # a tone mark typed before the vowel sign or ring it stands above; Lao, then Thai
    (re.compile("([່-໌]+)([ັິ-ູົຼໍ]+)"), r"\2\1"),
    (re.compile("([่-์]+)([ัิ-ฺ็ํ]+)"), r"\2\1"),
    # two signs E drawn side by side are the sign AE
    (re.compile("ເເ"), "ແ"),
    (re.compile("เเ"), "แ"),
)
_MARKS = re.compile("[ั-ํັ-ໍ]")
_BLANKS = re.compile(r"\s+")


@cache
def _fold_table() -> dict[int, str]:
    """Code point to what it is drawn like. Built from the Unicode database once per process."""
    within = lambda cp, ranges: any(a <= cp <= b for a, b in ranges)
    out: dict[int, str] = {ord(k): v for k, v in ALIKE_SINGLE.items()}
    for cp in (*range(0x80, 0x30000), *range(0xE0000, 0xE0200)):  # no other planes hold such characters
        ch = chr(cp)
        tag = unicodedata.decomposition(ch)
        if tag.startswith(("<wide>", "<narrow>", "<noBreak>")) or tag.startswith("<compat>") and within(cp, ALIKE_COMPAT):
            out.setdefault(cp, out.get(ord(k), k) if len(k := unicodedata.normalize("NFKC", ch)) == 1 else k)
        elif within(cp, INVISIBLE) or unicodedata.category(ch) == "Cf":
            out[cp] = ""
    for cp in range(0x20):
        if not chr(cp).isspace():
            out[cp] = ""
    return out


@cache
def _folded() -> re.Pattern:
    """Any character that folding may change, so that most texts skip the table."""
    cps = sorted(_fold_table())
    spans: list[list[int]] = []
    for cp in cps:
        if spans and cp == spans[-1][1] + 1:
            spans[-1][1] = cp
        else:
            spans.append([cp, cp])
    return re.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in spans) + "]")


def fold(text: str) -> str:
    """The character-wise part: widths, ligatures, accents, invisible characters, syllable order, blanks. Letter case,
    accents, digits raised or in circles, and every other visible difference stay."""
    if not text.isascii():
        if _folded().search(text):
            text = text.translate(_fold_table())
        text = unicodedata.normalize("NFC", text)
        if _MARKS.search(text):
            for pattern, to in _SYLLABLE:
                text = pattern.sub(to, text)
    elif not text.isprintable():
        text = text.translate(_fold_table())
    return _BLANKS.sub(" ", text).strip()


@cache
def _twins() -> dict[str, dict[str, str]]:
    """For each script: letter of another script to its own look-alike."""
    rows = [x.split() for x in LOOK_ALIKES.split("\n") if x]
    return {s: {r[j]: r[i] for r in rows if r[i] != "-" for j in range(len(SCRIPTS)) if j != i and r[j] != "-"} for i, s in enumerate(SCRIPTS)}


@cache
def _script(ch: str) -> str:
    return next((s for s in SCRIPTS if unicodedata.name(ch, "").startswith(s)), "")


def _most(counts: dict[str, int]) -> str:
    return max(counts, key=counts.get) if counts else ""


def repairs(text: str) -> list[tuple[str, str]]:
    """Tokens of a folded text that mix scripts, with the form in their dominant script (the text's, where two scripts have
    equally many letters). A word of one letter can't mix scripts, so it is brought into the text's. Only tokens that can
    be brought wholly into one script count."""
    tokens = set(_TOKEN.findall(text))
    per: dict[str, dict[str, int]] = {}
    whole: dict[str, int] = {}
    for t in tokens:
        c = per[t] = {}
        for ch in t:
            if s := _script(ch):
                c[s] = c.get(s, 0) + 1
                whole[s] = whole.get(s, 0) + 1
    main, out = _most(whole), []
    for t, c in per.items():
        if not c or len(c) == 1 and (sum(c.values()) > 1 or main in c):
            continue
        top = max(c.values())
        leading = [s for s, n in c.items() if n == top]
        to = leading[0] if len(leading) == 1 and len(c) > 1 else main
        if all(_script(ch) in ("", to) or ch in _twins()[to] for ch in t):
            out.append((t, "".join(_twins()[to].get(ch, ch) for ch in t)))
    return sorted(out)


def _candidates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = [(i, t, c, c.lower()) for i, text in zip(b["id_"], b["text_"]) for t, c in repairs(fold(text))]
        yield pd.DataFrame(rows, columns=["id_", "token", "becomes", "word"])


def _apply(text: str, fixes) -> str:
    text = fold(text)
    if fixes is not None and len(fixes):
        known = {f["token"]: f["becomes"] for f in fixes}
        text = _TOKEN.sub(lambda m: known.get(m[0], m[0]), text)
    return text


@F.pandas_udf(T.StringType())
def _fold_udf(texts: pd.Series) -> pd.Series:
    return texts.map(fold, na_action="ignore")


@F.pandas_udf(T.StringType())
def _fixed_udf(texts: pd.Series, fixes: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else _apply(t, f) for t, f in zip(texts, fixes)], index=texts.index, dtype=object)


def canonical(df: DataFrame, text: str, into: str = "canonical", row_id: Column | None = None) -> DataFrame:
    """``df`` with a column ``into``: ``text`` in its consistent form.

    ``row_id`` identifies rows that may need a repair (default: a hash of the text; equal texts get equal repairs, so it
    need not be unique). Null text stays null; empty text and text of nothing but blanks become ''. Rows, their order in
    ties, repeated rows and further columns stay as they are; a column named ``into`` is replaced.

    The vocabulary is every token of every row of ``df``; it is only ever joined with the candidates of repairs, which
    come from the rows with Greek or Cyrillic letters. Rows without such letters take no part in a join.
    """
    other = [c for c in df.columns if c != into]
    src = df.select(*[df[c] for c in other])
    rid = row_id if row_id is not None else F.xxhash64(F.col(text))
    mixed = F.coalesce(F.col(text).rlike(_OTHER_SCRIPT), F.lit(False))
    plain = src.where(~mixed).withColumn(into, _fold_udf(F.col(text)))
    suspects = src.where(mixed)
    wanted = (
        suspects.select(rid.cast("string").alias("id_"), F.col(text).alias("text_"))
        .mapInPandas(_candidates, "id_ string, token string, becomes string, word string")
        .distinct()
    )
    wanted = cut(wanted, "repairs")
    words = broadcast_if_small(wanted.select("word").distinct())
    tokens = src.where(F.col(text).rlike(_ANY_SCRIPT)).select(F.explode(F.array_distinct(F.split(F.lower(text), r"[^\p{L}\p{M}]+"))).alias("word"))
    known = tokens.join(words, "word", "left_semi").distinct()
    fixes = (
        wanted.join(broadcast_if_small(cut(known, "words")), "word", "left_semi")
        .groupBy("id_")
        .agg(F.collect_set(F.struct("token", "becomes")).alias("fixes_"))
    )
    fixed = (
        suspects.withColumn("id_", rid.cast("string"))
        .join(fixes, "id_", "left")
        .withColumn(into, _fixed_udf(F.col(text), F.col("fixes_")))
        .select(*other, into)
    )
    return plain.unionByName(fixed)


def look_alike_pairs(df: DataFrame, source: str, row_id: str, text: str, block: int = 2000) -> DataFrame:
    """Pairs of rows of one ``source`` whose texts look the same but are not the same string:
    ``source, id_a, id_b`` with id_a < id_b.

    Rows with null text, or text that shows nothing, are in no pair. Identical strings are not paired with each other.
    Groups are found by a hash of 128 bits of the consistent form; only groups with several strings go on. A large group
    is paired in blocks of about ``block`` rows against the whole group, so no task holds a group.
    """
    src = df.select(F.col(source).alias("source"), F.col(row_id).alias("rid"), F.col(text).alias("text")).where(F.length("text") > 0)
    keyed = canonical(src, "text", "canonical", F.concat_ws("|", F.col("source").cast("string"), F.col("rid").cast("string")))
    keyed = keyed.where(F.length("canonical") > 0).select("source", "rid", F.unhex(F.md5(F.col("canonical").cast("binary"))).alias("k"), F.unhex(F.md5(F.col("text").cast("binary"))).alias("raw"))
    keyed = cut(keyed, "forms")
    groups = (
        keyed.groupBy("source", "k")
        .agg(F.min("raw").alias("lo"), F.max("raw").alias("hi"), F.count(F.lit(1)).alias("n"))
        .where("lo <> hi")
        .select("source", "k", F.ceil(F.col("n") / block).cast("int").alias("parts"))
    )
    members = keyed.join(broadcast_if_small(cut(groups, "groups")), ["source", "k"])
    a = members.select("source", "k", F.col("rid").alias("id_a"), F.col("raw").alias("raw_a"), F.pmod(F.xxhash64("rid"), F.col("parts")).cast("int").alias("part"))
    b = members.select("source", "k", F.col("rid").alias("id_b"), F.col("raw").alias("raw_b"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    return a.join(b, ["source", "k", "part"]).where("id_a < id_b AND raw_a <> raw_b").select("source", "id_a", "id_b")


def look_alike_classes(df: DataFrame, source: str, row_id: str, text: str) -> DataFrame:
    """A row per text of ``df`` that is not null or empty and shows something: ``source, row_id, class_id, strings, rows``: the
    least row id of its class of texts that look the same, how many different strings the class has, and how many rows.
    Unlike the pairs this grows with the rows only, however large a class is."""
    src = df.select(F.col(source).alias("source"), F.col(row_id).alias("row_id"), F.col(text).alias("text")).where(F.length("text") > 0)
    keyed = canonical(src, "text", "canonical", F.concat_ws("|", F.col("source").cast("string"), F.col("row_id").cast("string")))
    digest = lambda c: F.unhex(F.md5(F.col(c).cast("binary")))
    keyed = cut(keyed.where(F.length("canonical") > 0).select("source", "row_id", digest("canonical").alias("k"), digest("text").alias("raw")), "forms")
    # equal strings are one row before classes are formed, so that no task holds a class
    strings = keyed.groupBy("source", "k", "raw").agg(F.min("row_id").alias("row_id"), F.count(F.lit(1)).alias("rows"))
    classes = strings.groupBy("source", "k").agg(F.min("row_id").alias("class_id"), F.count(F.lit(1)).alias("strings"), F.sum("rows").alias("rows"))
    return keyed.select("source", "row_id", "k").join(classes, ["source", "k"]).select("source", "row_id", "class_id", "strings", "rows")
