"""Languages of texts, and of the parts of mixed texts, where labels are missing or wrong.

Method: hierarchical discrimination. A linear one-versus-rest stage predicts the language family of every sentence from
character n-grams; within a family, one-versus-one linear support vector machines separate its languages.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.canonical import LOOK_ALIKES
from quillspark.session import broadcast_if_small, cut

#: Families with their languages.
FAMILIES = {"Tai": ("lao", "tha"), "Romance": ("fra", "por"), "Austronesian": ("ind", "tet"), "Germanic": ("eng",), "Vietic": ("vie",)}
#: Names, own names and codes of languages.
NAMES = {
    "lao": "lao laotian lo ພາສາລາວ ລາວ",
    "eng": "english en eng",
    "tha": "thai th tha ภาษาไทย ไทย",
    "fra": "french fr fra fre français francais",
    "vie": "vietnamese vi vie tiếng_việt tieng_viet",
    "por": "portuguese pt por português portugues língua_portuguesa",
    "tet": "tetum tetun tet tetun_dili lia-tetun",
    "ind": "indonesian id ind bahasa_indonesia bahasa",
    "zho": "chinese zh zho chi 中文 汉语",
    "spa": "spanish es spa español",
    "deu": "german de deu ger deutsch",
    "msa": "malay ms msa may bahasa_melayu",
    "khm": "khmer km khm",
    "mya": "burmese my mya bur",
    "rus": "russian ru rus русский",
    "jpn": "japanese ja jpn 日本語",
    "kor": "korean ko kor 한국어",
}
#: Sentences of each language that the model is fitted on, at most (a bounded sample of labelled rows).
SAMPLE = 800
#: Step of the fit.
STEP = 0.05
#: Bins of the n-grams.
BINS = 1 << 15
#: Letters below which a sentence is no evidence, unless the text has no longer one.
SHORT = 15
#: Letters from which a run in another script, outside brackets, is a sentence of its own.
RUN = 25

LANGUAGES = tuple(x for f in FAMILIES.values() for x in f)
PAIRS = tuple(p for f in FAMILIES.values() for p in combinations(f, 2))

#: No language here is written in Greek or Cyrillic: their letters stand for the Latin ones they look like.
_LATIN_TWINS = {y.lower(): x.lower() for x, *ys in (r.split() for r in LOOK_ALIKES.split("\n") if r) for y in ys if y != "-"}
_JOINTS = re.compile(r"\s*(?:[;,/|&+]|\band\b|\be\b|\bdan\b)\s*")
_ROW, _CUT = "\x01", "\x02"
_ENDS = re.compile(r"(?<=[.!?。！？])[^\S\x01]+|[\n\r]+|\s[—–/|]\s")
_ASIDE = re.compile(r"\([^()\x01\x02]+\)")
_SCRIPT_RUN = {"lao": re.compile("[຀-໿][຀-໿\\s\\d.,]*"), "tha": re.compile("[฀-๿][฀-๿\\s\\d.,]*")}


@cache
def _names() -> dict[str, str]:
    return {n.replace("_", " "): code for code, names in NAMES.items() for n in names.split()}


@cache
def label_languages(label: str) -> frozenset[str]:
    """Codes that a label names; parts that name no language count as nothing."""
    text = unicodedata.normalize("NFC", label).strip().lower()
    whole = _names().get(text)
    found = {whole} if whole else {_names().get(p) or _names().get(re.split(r"[-_]", p)[0].strip()) for p in _JOINTS.split(text)}
    return frozenset(x for x in found if x)


@cache
def _classes() -> tuple[np.ndarray, np.ndarray]:
    """For each code point below 0x2000: 1 Lao, 2 Thai, 3 Latin, 4 other letter, 0 none; and the letter itself or a blank."""
    kind = np.zeros(0x2000, np.uint8)
    to = np.arange(0x2000)
    for cp in range(0x1FFF):
        ch = chr(cp)
        if 0xE80 <= cp <= 0xEFF:
            kind[cp] = 1
        elif 0xE00 <= cp <= 0xE7F and cp != 0xE3F:
            kind[cp] = 2
        elif ch in _LATIN_TWINS:
            kind[cp], to[cp] = 3, ord(_LATIN_TWINS[ch])
        elif unicodedata.category(ch)[0] == "L":
            kind[cp] = 3 if "LATIN" in unicodedata.name(ch, "") else 4
        elif unicodedata.category(ch) == "Mn":
            kind[cp] = 3
    keep = np.where((kind > 0) | (np.arange(0x2000) == 0x27), to, 32)
    return kind, keep.astype(np.int32)


class Sentences:
    """The sentences of a batch of texts as numbers."""

    def __init__(self, texts: list[str]) -> None:
        joined = _ROW.join(t.replace(_ROW, " ").replace(_CUT, " ") for t in texts)
        joined = _ENDS.sub(_CUT, joined)
        self.raw = [s for row in joined.split(_ROW) for s in row.split(_CUT)] if texts else []
        rows = np.array([row.count(_CUT) + 1 for row in joined.split(_ROW)]) if texts else np.zeros(0, int)
        self.row = np.repeat(np.arange(len(texts)), rows)
        if self.raw:
            self._split_scripts()
        plain = _CUT.join(self.raw)
        if _ASIDE.search(plain):
            plain = _ASIDE.sub(" ", plain)
        cps = np.frombuffer(unicodedata.normalize("NFKC", plain).lower().encode("utf-32-le"), np.uint32)
        kinds, keep = _classes()
        low = np.minimum(cps, 0x1FFF)
        self.n = len(self.raw)
        self.owner = np.cumsum(cps == ord(_CUT), dtype=np.int32)
        self.kind = kinds[low]
        solid = self.kind > 0
        self.letters = np.bincount(self.owner[solid], minlength=self.n)
        letters = keep[low]
        # letters one by one; and three characters in a row of one sentence, but not where the script says enough
        uni, self.uni_at = letters[solid] % BINS, self.owner[solid]
        tai = np.append((np.bincount(self.owner[(self.kind == 1) | (self.kind == 2)], minlength=self.n) > 0.9 * self.letters) & (self.letters > 0), False)
        tri, tri_at = np.zeros(0, np.int32), np.zeros(0, np.int32)
        if len(cps) > 2:
            inside = np.flatnonzero((self.owner[2:] == self.owner[:-2]) & (solid[:-2] | solid[1:-1] | solid[2:]) & ~tai[self.owner[2:]])
            tri = (letters[inside] * 31_337 + letters[inside + 1] * 1_009 + letters[inside + 2] * 17) % BINS
            tri_at = self.owner[inside]
        self.bins = np.concatenate([uni, tri])
        self.at = np.concatenate([self.uni_at, tri_at])

    def _split_scripts(self) -> None:
        """Sentences in which Lao and Thai, or one of them and Latin, stand side by side at length become several."""
        cps = np.frombuffer(_CUT.join(self.raw).encode("utf-32-le"), np.uint32)
        owner = np.cumsum(cps == ord(_CUT), dtype=np.int32)
        kind = np.where(cps < 0x2000, _classes()[0][np.minimum(cps, 0x1FFF)], 0)
        n = np.stack([np.bincount(owner[kind == k], minlength=len(self.raw)) >= RUN for k in (1, 2, 3)])
        both = np.flatnonzero(n.sum(axis=0) > 1)
        if not len(both):
            return
        raw, row, at = [], [], 0
        for i in both:
            bare = _ASIDE.sub(" ", self.raw[i])
            parts = [self.raw[i]]
            for pattern in _SCRIPT_RUN.values():
                own, rest = "".join(pattern.findall(bare)), pattern.sub(" ", bare)
                if min(sum(c.isalpha() for c in x) for x in (own, rest)) >= RUN:
                    parts = [own, rest]
                    break
            raw += self.raw[at:i] + parts
            row += [*self.row[at:i], *[self.row[i]] * len(parts)]
            at = i + 1
        self.raw, self.row = raw + self.raw[at:], np.array([*row, *self.row[at:]])

    def share(self, kind: int) -> np.ndarray:
        """Share of a kind of letters among the letters of each sentence."""
        return np.bincount(self.owner[self.kind == kind], minlength=self.n) / np.maximum(self.letters, 1)

    def mean(self, weights: np.ndarray) -> np.ndarray:
        """Mean weight of a sentence's n-grams, for each column of ``weights``."""
        size = np.maximum(np.bincount(self.at, minlength=self.n), 1)
        return np.stack([np.bincount(self.at, weights=weights[self.bins, k], minlength=self.n) / size for k in range(weights.shape[1])], axis=1) if self.n else np.zeros((0, weights.shape[1]))


def _svm(bins: np.ndarray, at: np.ndarray, n: int, sign: np.ndarray, rounds: int = 40, ridge: float = 1e-4) -> np.ndarray:
    """Linear support vector machine (squared hinge, both sides weighing alike) by gradient steps scaled per bin."""
    size = np.maximum(np.bincount(at, minlength=n), 1)
    value = (1 / np.sqrt(size))[at]
    side = np.where(sign > 0, 1 / max(1, (sign > 0).sum()), 1 / max(1, (sign < 0).sum()))
    w, scale = np.zeros(BINS), np.full(BINS, 1e-12)
    for _ in range(rounds):
        margin = sign * np.bincount(at, weights=w[bins] * value, minlength=n)
        slack = np.maximum(0, 1 - margin) * side * sign
        grad = ridge * w - np.bincount(bins, weights=slack[at] * value, minlength=BINS)
        scale += grad * grad
        w -= STEP * grad / np.sqrt(scale)
    return w


@dataclass
class Model:
    """Weights of the families and of the pairs within them, one column each."""

    weights: np.ndarray

    def predict(self, s: Sentences) -> tuple[np.ndarray, np.ndarray]:
        """Index into LANGUAGES and confidence of each sentence."""
        size = np.sqrt(np.maximum(np.bincount(s.at, minlength=s.n), 1))[:, None]
        score = s.mean(self.weights) * size
        family = score[:, : len(FAMILIES)]
        best = family.argmax(axis=1) if s.n else np.zeros(0, int)
        sure = np.exp(2 * (family - family.max(axis=1, keepdims=True))) if s.n else family
        conf = 1 / np.maximum(sure.sum(axis=1), 1)
        lang = np.zeros(s.n, int)
        for f, (members) in enumerate(FAMILIES.values()):
            here = best == f
            votes = np.zeros((s.n, len(members)))
            least = np.full((s.n, len(members)), np.inf)  # the closest of a language's comparisons
            for k, (a, b) in enumerate(PAIRS):
                if a in members:
                    x = score[:, len(FAMILIES) + k]
                    i, j = members.index(a), members.index(b)
                    votes[:, i] += x > 0
                    votes[:, j] += x <= 0
                    least[:, i], least[:, j] = np.minimum(least[:, i], np.abs(x)), np.minimum(least[:, j], np.abs(x))
            winner = votes.argmax(axis=1)
            margin = least[np.arange(s.n), winner]
            lang[here] = LANGUAGES.index(members[0]) + winner[here]
            if len(members) > 1:
                conf[here] *= (1 / (1 + np.exp(-3 * margin)))[here]
        return lang, conf


def fit(texts: list[str], labels: list[str], sample: int = SAMPLE, cleanings: int = 2) -> Model:
    """Fit on labelled texts, of which some labels may be wrong: after each round, sentences whose language the model
    sees otherwise are left out of the next one."""
    s = Sentences(texts)
    code = np.array([LANGUAGES.index(x) for x in labels], int)[s.row] if len(labels) else np.zeros(0, int)
    # a label that the script rules out is wrong
    lao, thai = s.share(1) > 0.5, s.share(2) > 0.5
    own = np.where(lao, LANGUAGES.index("lao"), np.where(thai, LANGUAGES.index("tha"), -1))
    use = (s.letters >= SHORT) & ((own == code) | (own < 0) & (code != LANGUAGES.index("lao")) & (code != LANGUAGES.index("tha")))
    order = np.random.default_rng(7).permutation(s.n)
    keep = np.zeros(s.n, bool)
    for x in range(len(LANGUAGES)):
        keep[[i for i in order if use[i] and code[i] == x][:sample]] = True
    family_of = np.array([f for f, members in enumerate(FAMILIES.values()) for _ in members])
    model = None
    for _ in range(cleanings + 1):
        if model is not None:
            keep &= model.predict(s)[0] == code
        pick = np.flatnonzero(keep)
        number = np.full(s.n, -1)
        number[pick] = np.arange(len(pick))
        inside = keep[s.at]
        bins, at, lang = s.bins[inside], number[s.at[inside]], code[pick]
        columns = [_svm(bins, at, len(pick), np.where(family_of[lang] == f, 1.0, -1.0)) for f in range(len(FAMILIES))]
        for a, b in PAIRS:
            two = np.isin(lang, (LANGUAGES.index(a), LANGUAGES.index(b)))
            columns.append(_svm(bins[two[at]], (np.cumsum(two) - 1)[at[two[at]]], int(two.sum()), np.where(lang[two] == LANGUAGES.index(a), 1.0, -1.0)))
        model = Model(np.stack(columns, axis=1).astype(np.float32))
    return model


def labelled_sample(df: DataFrame, text: str, label: str, per_label: int = 2 * SAMPLE) -> list[tuple[str, str]]:
    """(text, code) of about ``per_label`` texts of each language whose label names just that one: those with the lowest
    hashes, so that no task gathers a language. Labels are counted over all rows first. A text counts once however often it
    comes, and each language is bounded by itself, so that neither many copies nor a large language leave others without."""
    spark = df.sparkSession
    rows = df.select(F.col(text).alias("t"), F.col(label).alias("l")).where((F.length("t") > 0) & (F.length("l") > 0))
    labels = rows.groupBy("l").agg(F.approx_count_distinct(F.xxhash64("t")).alias("texts"))

    def coded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sets = [label_languages(x) for x in b["l"]]
            yield b.assign(code=pd.Series([next(iter(c)) if len(c) == 1 and c <= set(LANGUAGES) else None for c in sets], dtype=object, index=b.index))

    known = cut(labels.mapInPandas(coded, "l string, texts long, code string").where("code IS NOT NULL"), "labels")
    total = {r.code: r.n for r in known.groupBy("code").agg(F.sum("texts").alias("n")).collect()}
    if not total:
        return []
    at = F.create_map(*[x for c, n in total.items() for x in (F.lit(c), F.lit(min(1.0, per_label / max(n, 1))))])
    shares = broadcast_if_small(known.select("l", "code", at[F.col("code")].alias("share")))
    picked = rows.join(shares, "l").where(F.pmod(F.xxhash64("t"), F.lit(1_000_000)) < F.col("share") * 1_000_000).select("t", "code").distinct()
    rank = F.row_number().over(Window.partitionBy("code").orderBy(F.pmod(F.xxhash64("t"), F.lit(1_000_000)), "t"))
    return sorted((r.t, r.code) for r in picked.withColumn("n_", rank).where(F.col("n_") <= 3 * per_label).collect())


def _present(s: Sentences, lang: np.ndarray) -> np.ndarray:
    """Whether a sentence counts: it is long enough, or its text has none that is. Sentences mostly in a script that none of
    LANGUAGES is written in have none of them."""
    longest = np.zeros(s.row.max(initial=-1) + 1, np.int64)
    np.maximum.at(longest, s.row, s.letters)
    return ((s.letters >= SHORT) | (s.letters == longest[s.row]) & (longest[s.row] < SHORT) & (s.letters > 0)) & (s.share(4) <= 0.5)


def segments(df: DataFrame, keep: list[str], text: str, model: Model) -> DataFrame:
    """``keep``, ``segment`` (number within the text), ``lang_code``, ``confidence``, ``sentences``, ``segment_text``: the
    stretches of sentences in one language, in order. Sentences too short to tell join the stretch before them.

    Null and empty texts, and texts without letters, have no segments. Rows repeat as they are repeated; names in
    ``keep`` may not be those of the result. Each row is decided by itself; the model is broadcast, its size is fixed.
    """
    at = df.sparkSession.sparkContext.broadcast(model)
    src = df.select(*keep, F.col(text).alias("text_")).where(F.length("text_") > 0)

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            s = Sentences(b["text_"].tolist())
            lang, conf = at.value.predict(s)
            counts = _present(s, lang)
            out: list[list] = []
            for i in range(s.n):
                new = not out or out[-1][0] != s.row[i]
                if counts[i] and (new or out[-1][2] != lang[i]):
                    out.append([s.row[i], 0 if new else out[-1][1] + 1, lang[i], [conf[i]], [s.raw[i]]])
                elif not new:
                    out[-1][3] += [conf[i]] if counts[i] else []
                    out[-1][4].append(s.raw[i])
            own = b.iloc[[o[0] for o in out]][keep].reset_index(drop=True)
            own = own.astype({c: object for c in keep if own[c].dtype.kind not in "iufbM"})
            yield own.assign(segment=[o[1] for o in out], lang_code=pd.Series([LANGUAGES[o[2]] for o in out], dtype=object), confidence=[float(np.mean(o[3])) for o in out], sentences=[len(o[3]) for o in out], segment_text=pd.Series([" ".join(o[4]) for o in out], dtype=object))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields if f.name != "text_")
    return src.mapInPandas(find, f"{fields}, segment int, lang_code string, confidence double, sentences int, segment_text string")


def languages(df: DataFrame, keep: list[str], text: str, label: str, model: Model) -> DataFrame:
    """``keep``, ``label_codes``, ``text_codes`` (both sorted), ``main_code``, ``confidence``: languages of the label and of
    the text, a row per text that is not null or empty. Texts without letters have no languages.

    A language is present with a whole sentence; terms in brackets and words within a sentence don't count.
    """
    at = df.sparkSession.sparkContext.broadcast(model)
    src = df.select(*keep, F.col(text).alias("text_"), F.coalesce(F.col(label), F.lit("")).alias("label_")).where(F.length("text_") > 0)

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            s = Sentences(b["text_"].tolist())
            lang, conf = at.value.predict(s)
            counts = _present(s, lang)
            n, k = len(b), len(LANGUAGES)
            cell = (s.row * k + lang)[counts]
            have = np.bincount(cell, minlength=n * k).reshape(n, k)
            size = np.bincount(cell, weights=s.letters[counts], minlength=n * k).reshape(n, k)
            sure = np.bincount(cell, weights=conf[counts], minlength=n * k).reshape(n, k)
            main = size.argmax(axis=1)
            any_ = have.any(axis=1)
            of = [",".join(sorted(LANGUAGES[j] for j in np.flatnonzero(row))) for row in have]
            own = b[keep].astype({c: object for c in keep if b[c].dtype.kind not in "iufbM"})
            yield own.assign(
                label_codes=pd.Series([",".join(sorted(label_languages(x))) for x in b["label_"]], dtype=object, index=b.index),
                text_codes=pd.Series(of, dtype=object, index=b.index),
                main_code=pd.Series([LANGUAGES[m] if a else None for m, a in zip(main, any_)], dtype=object, index=b.index),
                confidence=np.where(any_, sure[np.arange(n), main] / np.maximum(have[np.arange(n), main], 1), 0.0),
            )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields if f.name not in ("text_", "label_"))
    return src.mapInPandas(find, f"{fields}, label_codes string, text_codes string, main_code string, confidence double")


def mislabelled(found: DataFrame, keep: list[str]) -> DataFrame:
    """Of ``languages``: a row per language of each text whose label is not exactly its set of languages."""
    codes: Column = F.split("text_codes", ",")
    return found.where("text_codes <> '' AND text_codes <> label_codes").select(*keep, F.explode(codes).alias("lang_code"))
