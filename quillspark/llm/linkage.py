"""Records and catalogue entries that mean the same instrument, without a common key.

Method: probabilistic record linkage. Several blocking passes propose pairs, each pair is compared field by field into
agreement levels, expectation-maximisation over the counts of level patterns learns how often matches and others show
each level, and the posterior of a pattern is the confidence of its pairs.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.session import broadcast_if_small, cut, small

#: Issuing bodies as written in Lao and in English.
BODIES = {"ສພຊ": "NA", "ລບ": "GOV", "ກຕສ": "MTC", "ທຫລ": "BOL", "ອຄ": "MOIC", "ກງ": "MOF"}
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
#: Letters that reading software takes for each other in Lao.
MISREAD = str.maketrans({"ຄ": "ດ"})
#: Kinds of instruments, English and Lao.
KINDS = (("law", "ກົດໝາຍ"), ("decree", "ດຳລັດ"), ("decision", "ຂໍ້ຕົກລົງ"), ("regulation", "ລະບຽບການ"), ("instruction", "ຄຳແນະນຳ"))
#: Pairs from this posterior on are matches.
ACCEPT = 0.75

_REF = re.compile(r"(\d{1,18})\s*/\s*([A-Z]{2,}|[ກ-ໟ]+)")
_YEAR = re.compile(r"(?<!\d)(?:19|20)\d\d(?!\d)")
_DMY = re.compile(r"(?<!\d)(\d{1,2})[/-](\d{1,2})[/-]((?:19|20)\d\d)(?!\d)")
_YMD = re.compile(r"(?<!\d)((?:19|20)\d\d)-(\d{1,2})-(\d{1,2})(?!\d)")
_WORDED = re.compile(r"(\d{1,2}) (" + "|".join(MONTHS) + r") ((?:19|20)\d\d)", re.I)
_FILE = re.compile(r"([^/=?#]+)\.(?:pdf|docx?|html?)(?=$|[?#&])", re.I)
_VIEW = re.compile(r"/view/(\d+)")
_FILE_DATED = re.compile(r"^(\d{1,18})-(\d{1,2})-(\d{1,2})-((?:19|20)\d\d)_")
_FILE_BODY = re.compile(r"^(\d{1,18})([ກ-ໟ]+|[A-Z]{2,})-((?:19|20)\d\d)-")
_FILE_YEAR = re.compile(r"^[a-z]+_((?:19|20)\d\d)_")
_ENGLISH = re.compile(r"[A-Za-z][A-Za-z ,.()'\-]*")
_LAO = re.compile(r"[ກ-ໟ][ກ-ໟ ()]*")
_NOTE_TITLE = re.compile(r"English title[^:;]*: *([^;]+)")
_NONE = re.compile(r"no instrument", re.I)
_LAO_MARKS = re.compile("[^ກ-ຮໜໝ]")

#: Blocking passes, as many as ``_keys`` has keys.
PASSES = 7
FEATURES = "id long, num long, body string, year int, day int, file string, fnum long, fbody string, fyear int, fday int, en string, lk string, flags int, kind int"


def _date(d, m, y) -> int | None:
    d, m, y = int(d), int(m), int(y)
    return y * 10000 + m * 100 + d if 1 <= m <= 12 and 1 <= d <= 31 else None


def _full_date(text: str) -> int | None:
    if m := _WORDED.search(text):
        return _date(m[1], MONTHS.index(m[2].lower()) + 1, m[3])
    if m := _YMD.search(text):
        return _date(m[3], m[2], m[1])
    if m := _DMY.search(text):
        return _date(m[1], m[2], m[3])
    return None


def _sorted(word: str) -> str:
    return "".join(sorted(word))


#: Words that clerks drop or exchange, and the form they are brought to.
SMALL_WORDS = {"the": "", "concerning": "on", "regarding": "on", "guideline": "instruction", "guidelines": "instruction", "of": "of", "on": "on", "for": "for", "in": "in", "at": "at"}
_SMALL = {_sorted(w): to for w, to in SMALL_WORDS.items()}
_LETTERS = re.compile(r"[a-z]+")


def english_form(text: str) -> str:
    """English title as small letters without blanks; small words, also with letters out of order, in one form."""
    return "".join(_SMALL.get(_sorted(w), w) for w in _LETTERS.findall(text.lower()))


def lao_form(text: str) -> str:
    """The consonants of a Lao title: reading errors mostly hit tone marks, vowel signs and blanks."""
    return _LAO_MARKS.sub("", unicodedata.normalize("NFC", text.replace("ຫນ", "ໜ").replace("ຫມ", "ໝ"))).translate(MISREAD)


@cache
def _kinds() -> tuple[tuple[str, str], ...]:
    return tuple((a, lao_form(b)) for a, b in KINDS)


def _stretches(pattern: re.Pattern, text: str, least: int) -> str:
    """All stretches of one script that are long enough to be part of a title; shorter ones are stray letters."""
    return " ".join(m for m in pattern.findall(text) if len(m) >= least)


def features(i, name, number, url, date, notes) -> tuple:
    """What a row tells about its instrument, in the order of FEATURES."""
    name, number, url, date, notes = (x if isinstance(x, str) else "" for x in (name, number, url, date, notes))
    num = body = year = day = None
    if m := _REF.search(number):
        num, body = int(m[1]), BODIES.get(m[2], m[2])
        rest = number[m.end() :]
        day = _full_date(rest)
        years = _YEAR.findall(rest)
        year = day // 10000 if day else int(years[-1]) if years else None
    if date and (day is None or year is None):
        day = day or _full_date(date)
        years = _YEAR.findall(date)
        year = year or (day // 10000 if day else int(years[0]) if years else None)
    file = fnum = fbody = fyear = fday = None
    if m := _FILE.search(url):
        file = m[1].lower()
        if m := _FILE_DATED.match(file):
            fnum, fday, fyear = int(m[1]), _date(m[2], m[3], m[4]), int(m[4])
        elif m := _FILE_BODY.match(file):
            fnum, fbody, fyear = int(m[1]), BODIES.get(m[2], m[2].upper()), int(m[3])
        elif m := _FILE_YEAR.match(file):
            fyear = int(m[1])
    elif m := _VIEW.search(url):
        file = "view" + m[1]
    lao = _stretches(_LAO, name, 6)
    english = _stretches(_ENGLISH, name, 9)
    if not english and (m := _NOTE_TITLE.search(notes)):
        english = m[1]
    if _NONE.search(name):
        lao = english = ""
    en, lk = english_form(english) or None, lao_form(lao) or None
    low = english.lower()
    amended = "amended" in low or "ສະບັບປັບປຸງ" in name or lk is not None and lao_form("ສະບັບປັບປຸງ") in lk
    implements = "implementation" in low or lk is not None and lao_form("ຈັດຕັ້ງປະຕິບັດ") in lk
    kind = next((k for k, (a, b) in enumerate(_kinds()) if en and en.startswith(a) or lk and lk.startswith(b)), None)
    return i, num, body, year, day, file, fnum, fbody, fyear, fday, en, lk, amended + 2 * implements, kind


def featured(df: DataFrame, row_id: str, name: str, number: str, url: str, date: str | None = None, notes: str | None = None) -> DataFrame:
    pick = lambda c: F.col(c) if c else F.lit(None).cast("string")
    src = df.select(F.col(row_id).cast("long").alias("id"), pick(name).alias("n"), pick(number).alias("r"), pick(url).alias("u"), pick(date).alias("d"), pick(notes).alias("t"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in FEATURES.split(", ")]
        for b in batches:
            rows = [features(*x) for x in zip(b["id"], b["n"], b["r"], b["u"], b["d"], b["t"])]
            out = pd.DataFrame(rows, columns=names, dtype=object)
            yield out

    return src.mapInPandas(read, FEATURES)


def _keys() -> Column:
    """The blocking keys of a row, one per pass; null where the row lacks what the pass needs."""
    # implementing texts begin alike, so their heads are longer
    implements = F.col("flags") >= 2
    head = lambda p, c, n, m: F.when(F.length(c) >= F.when(implements, m).otherwise(n), F.concat(F.lit(p), F.when(implements, F.substring(c, 1, m)).otherwise(F.substring(c, 1, n))))
    letters = lambda c: F.when(c.isNotNull(), F.concat_ws("", F.array_sort(F.split(c, ""))))
    return F.array(
        F.concat(F.lit("n"), F.col("num").cast("string"), F.lit("/"), F.col("body")),
        F.concat(F.lit("m"), F.coalesce("num", "fnum").cast("string"), F.lit("/"), F.coalesce("year", "fyear").cast("string")),
        F.concat(F.lit("f"), F.col("file")),
        F.concat(F.lit("t"), letters(F.col("en"))),
        F.concat(F.lit("l"), F.col("lk")),
        head("p", "lk", 20, 32),
        head("q", "en", 28, 46),
    )


def _edits(a: str, near: int) -> Column:
    """Edits between both titles of a pair where they can be close, else -1: lengths that differ by more, or edits beyond three
    tenths of the longer one, are not counted out. Null if a side has no title."""
    x, y = F.col(f"r.{a}"), F.col(f"b.{a}")
    most = F.greatest(F.floor(F.greatest(F.length(x), F.length(y)) * 0.3).cast("int"), F.lit(2 * near))
    apart = F.abs(F.length(x) - F.length(y)) > most
    return F.when(x.isNull() | y.isNull(), F.lit(None)).when(x == y, 0).when(apart, -1).otherwise(F.call_function("levenshtein", x, y, most))


def _title_level(a: str, near: int, least: int) -> Column:
    """1 alike but for slips, 2 close, 3 one is cut short, 4 much in common, 5 different, 0 not comparable; from the column
    ``edits_<a>``."""
    x, y, edits = F.col(f"r.{a}"), F.col(f"b.{a}"), F.col(f"edits_{a}")
    short, long_ = F.least(F.length(x), F.length(y)), F.greatest(F.length(x), F.length(y))
    head = F.levenshtein(x.substr(F.lit(1), short), y.substr(F.lit(1), short), near) >= 0
    return (
        F.when(edits.isNull(), 0)
        .when(edits.between(0, near), 1)
        .when(edits.between(0, 2 * near), 2)
        .when((short >= least) & (long_ - short > 2 * near) & head, 3)
        .when((edits >= 0) & (edits <= long_ * 0.3), 4)
        .otherwise(5)
    )


def _levels() -> dict[str, Column]:
    r, b = (lambda c: F.col(f"r.{c}")), (lambda c: F.col(f"b.{c}"))
    same = lambda x, y: (x == y)
    body_fits = lambda x, y: F.coalesce(x == y, F.lit(True))
    number = (
        F.when(r("num").isNotNull() & b("num").isNotNull(), F.when((r("num") == b("num")) & (r("body") == b("body")), F.when(r("year") == b("year"), 5).otherwise(1)).otherwise(2))
        .when(r("num").isNotNull() & b("fnum").isNotNull(), F.when((r("num") == b("fnum")) & body_fits(r("body"), b("fbody")), 3).otherwise(4))
        .when(r("fnum").isNotNull() & b("num").isNotNull(), F.when((r("fnum") == b("num")) & body_fits(r("fbody"), b("body")), 3).otherwise(4))
        .otherwise(0)
    )
    rday, bday = F.coalesce(r("day"), r("fday")), F.coalesce(b("day"), b("fday"))
    ryear, byear = F.coalesce(r("year"), r("fyear")), F.coalesce(b("year"), b("fyear"))
    time = (
        F.when(ryear.isNull() | byear.isNull(), 0)
        .when(same(rday, bday), 1)
        .when(same(ryear, byear), F.when(rday.isNotNull() & bday.isNotNull(), 3).otherwise(2))
        .when(r("year").isNotNull() & b("year").isNotNull(), 4)
        .otherwise(5)
    )
    en, lao = F.col("level_en"), F.col("level_lk")
    title = F.when((en == 0) | (lao > 0) & (lao < en), lao).otherwise(en)
    # a viewer's number and a file's name are different namings and can't contradict each other
    viewed = lambda x: x.rlike("^view[0-9]+$")
    file = F.when(r("file").isNull() | b("file").isNull() | (viewed(r("file")) != viewed(b("file"))), 0).when(r("file") == b("file"), 1).otherwise(2)
    flags = F.when((r("en").isNull() & r("lk").isNull()) | (b("en").isNull() & b("lk").isNull()), 0).when(r("flags") == b("flags"), 1).otherwise(2)
    kind = F.when(r("kind").isNull() | b("kind").isNull(), 0).when(r("kind") == b("kind"), 1).otherwise(2)
    return {"number": number, "time": time, "title": title, "file": file, "flags": flags, "kind": kind}


#: Levels of each field, 0 (not comparable) included. Numbers: 1 agree, 5 agree with their year, 2 differ; 3 and 4 the same
#: for a number against the one in the other's file name.
SIZES = {"number": 6, "time": 6, "title": 6, "file": 3, "flags": 3, "kind": 3}
#: Where the rounds start: how often matches, and other pairs that a pass proposes, show each level (from 1 on).
START = {"number": (0.3, 0.01, 0.15, 0.04, 0.5), "time": (0.4, 0.5, 0.02, 0.02, 0.06), "title": (0.8, 0.1, 0.05, 0.03, 0.02), "file": (0.7, 0.3), "flags": (0.95, 0.05), "kind": (0.98, 0.02)}
START_OTHER = {"number": (0.15, 0.6, 0.05, 0.19, 0.01), "time": (0.02, 0.08, 0.1, 0.5, 0.3), "title": (0.1, 0.1, 0.1, 0.3, 0.4), "file": (0.15, 0.85), "flags": (0.6, 0.4), "kind": (0.6, 0.4)}


def fit(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Posterior of each pattern and the log ratio of each level, by expectation-maximisation. Level 0 is no evidence."""
    fields = list(SIZES)
    m = {f: np.array([0, *START[f]], float) for f in fields}
    u = {f: np.array([0, *START_OTHER[f]], float) for f in fields}
    share, post = 0.3, np.zeros(len(counts))
    for _ in range(rounds):
        ratio = np.log(share / (1 - share)) + sum(np.where(patterns[:, k] > 0, np.log(np.maximum(m[f], 1e-9))[patterns[:, k]] - np.log(np.maximum(u[f], 1e-9))[patterns[:, k]], 0) for k, f in enumerate(fields))
        new = 1 / (1 + np.exp(-np.clip(ratio, -50, 50)))
        if np.abs(new - post).max(initial=0) < 1e-7:
            post = new
            break
        post = new
        for p, w in ((m, counts * post), (u, counts * (1 - post))):
            for k, f in enumerate(fields):
                seen = np.bincount(patterns[:, k], weights=w, minlength=SIZES[f])[1:]
                p[f][1:] = (seen + 0.5) / (seen.sum() + 0.5 * len(seen))
        share = min(max(float((counts * post).sum() / counts.sum()), 1e-6), 1 - 1e-6)
    return post, {f: np.log(np.maximum(m[f], 1e-9) / np.maximum(u[f], 1e-9)) for f in fields}


def _translated(rows: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Rows without an English title get the one that rows with the same Lao title mostly have."""
    known = lexicon.select(F.col("lk").alias("lk_"), "en_of")
    # rows without a Lao title must not meet in one task
    at = F.coalesce("lk", F.concat(F.lit("\x00"), F.col("id").cast("string"))) == F.col("lk_")
    return rows.join(known, at, "left").withColumn("en", F.coalesce("en", "en_of")).drop("en_of", "lk_")


def _met(many: DataFrame, one: DataFrame, most_rows: int = 200_000, hot: int = 100_000) -> DataFrame:
    """Rows of both sides with a key in common. ``one`` is broadcast if it is small; else both are shuffled, and a key with
    more than ``hot`` rows of ``many`` is split over so many tasks, each with the key's rows of ``one``."""
    if small(one, most_rows):
        return many.join(F.broadcast(one), ["pass", "key"])
    heavy = many.groupBy("pass", "key").agg(F.ceil(F.count(F.lit(1)) / hot).cast("int").alias("parts")).where("parts > 1")
    heavy = broadcast_if_small(cut(heavy, "hot"))
    parts = F.coalesce("parts", F.lit(1))
    left = many.join(heavy, ["pass", "key"], "left").withColumn("part", F.pmod(F.xxhash64("r.id"), parts).cast("int")).drop("parts")
    right = one.join(heavy, ["pass", "key"], "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    return left.join(right, ["pass", "key", "part"]).drop("part")


def link(records: DataFrame, entries: DataFrame) -> DataFrame:
    """Pairs of a record and an entry of the same instrument: ``entry_id, record_id, confidence``.

    Both sides are tables in the form of ``featured``. Rows without any title, number or file are in no pair. Rows that
    repeat under another id are linked like the first; an instrument that is listed twice gives two pairs.

    Passes: issuing body and number; number and year; file name; letters of the English title (given or known from rows
    with the same Lao title); consonants of the Lao title; the heads of both, for titles cut short. A pair is formed
    once, in the first pass that finds it, so pairs need no shuffle to become distinct. The entries are broadcast if few,
    else both sides are shuffled by key. Only counts of patterns (at most the product of SIZES) reach the driver.
    """
    spark = records.sparkSession
    records, entries = cut(records, "records"), cut(entries, "entries")
    pairs_of_titles = records.select("lk", "en").unionByName(entries.select("lk", "en")).where("lk IS NOT NULL AND en IS NOT NULL")
    lexicon = pairs_of_titles.groupBy("lk", "en").count().groupBy("lk").agg(F.max_by("en", F.struct("count", "en")).alias("en_of"))
    lexicon = broadcast_if_small(cut(lexicon, "titles"))
    # comparing titles costs much more than moving rows, and the rows of few files would be compared in few tasks
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    r = _translated(records, lexicon).repartition(tasks, "id").withColumn("keys", _keys())
    b = _translated(entries, lexicon).withColumn("keys", _keys())
    explode = lambda x, name: x.select(F.struct(*x.columns).alias(name), F.posexplode("keys").alias("pass", "key")).where("key IS NOT NULL")
    one, many = explode(b, "b"), explode(r, "r")
    met = _met(many, one)
    same = lambda k: F.coalesce(F.col("r.keys")[k] == F.col("b.keys")[k], F.lit(False))
    earlier = reduce(lambda acc, k: acc | (F.lit(k) < F.col("pass")) & same(k), range(PASSES), F.lit(False))
    levels = _levels()
    code = reduce(lambda acc, f: acc * SIZES[f] + levels[f], SIZES, F.lit(0))
    shown = lambda side: F.struct(F.col(f"{side}.num"), F.col(f"{side}.body"), F.col(f"{side}.year"), F.col(f"{side}.kind"))
    compared = met.where(~earlier).withColumns({"edits_en": _edits("en", 2), "edits_lk": _edits("lk", 1)})
    compared = compared.withColumns({"level_en": _title_level("en", 2, 18), "level_lk": _title_level("lk", 1, 10)})
    pairs = compared.select(F.col("b.id").alias("entry_id"), F.col("r.id").alias("record_id"), code.cast("int").alias("code"), shown("b").alias("said"), shown("r").alias("own"))
    pairs = cut(pairs, "pairs")
    found = pairs.groupBy("code").count().toPandas()
    schema = "code int, confidence double"
    if len(found):
        codes, patterns = found["code"].to_numpy(), np.zeros((len(found), len(SIZES)), int)
        rest = codes.copy()
        for k, f in reversed(list(enumerate(SIZES))):
            patterns[:, k], rest = rest % SIZES[f], rest // SIZES[f]
        post, _ = fit(patterns, found["count"].to_numpy(float))
        table = spark.createDataFrame([(int(c), float(p)) for c, p in zip(codes, post)], schema)
    else:
        table = spark.createDataFrame([], schema)
    scored = pairs.join(F.broadcast(table), "code").where(F.col("confidence") >= ACCEPT)
    # exact check: another kind, or another stated year of issue, is another instrument
    agree = lambda one, other, cs: reduce(lambda acc, c: acc & F.coalesce(F.col(f"{one}.{c}") == F.col(f"{other}.{c}"), F.lit(True)), cs, F.lit(True))
    scored = scored.where(agree("said", "own", ("kind", "year")))
    # one record is one instrument: what contradicts its best entry in number, body or year goes
    best = F.max_by("said", F.struct("confidence", F.col("said.num").isNotNull(), F.col("said.year").isNotNull(), -F.col("entry_id"))).over(Window.partitionBy("record_id"))
    return scored.withColumn("best", best).where(agree("said", "best", ("num", "body", "year"))).select("entry_id", "record_id", "confidence")
