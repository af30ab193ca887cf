"""Template residue, filler, error pages and script notices in documents.

Method: positive-unlabelled naive Bayes, learnt by expectation-maximisation. Passages with a trusted sign of an error or
placeholder are the positives, passages of trusted kinds that are never residue the negatives, all others are unlabelled.
Rounds of soft labels and counts give the model: words and pairs of words of residue, of the unlabelled rest and of the
trusted negatives as a second component of the rest (Nigam et al. 2000), and how often a passage is residue by the length
of its record and by what stands beside it. The model scores every passage, and a document is decided by its passages.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.session import cut

#: Words are counted in the lower half of this many bins, pairs of words in the upper half, so that the model has a fixed size.
BINS = 1 << 17
HALF = BINS // 2
ROUNDS = 6
#: A passage from this probability on makes a document residue.
DECISION = 0.5
#: Soft labels below this count as nothing: summed up, those of a thousand headings would outweigh what is trusted.
LEAST = 0.05
#: A neighbour from this probability on counts as residue beside a passage.
BESIDE = 0.9
#: Share of the even distribution mixed into the words of residue, and of the rest.
EVEN, EVEN_REST = 0.4, 0.003
#: Of what is mixed into the pairs: share of the corpus' own distribution.
CORPUS_PAIRS = 0.9
#: The most that one word or pair tells, as log odds.
MOST = 6.0
#: A passage with more words and pairs than this has its evidence scaled down to so many: one telling word in a long sentence is
#: not what a message looks like.
LENGTH = 12
#: Passages that the first model gives less log odds than this, context aside, are legal text for good.
FLOOR = -12.0
#: Records by number of passages (1, 2, up to 5, more), for the share of residue in them.
SIZES = (2, 3, 6)

#: Trusted signs, as (what the text must hold in small letters, pattern in small letters).
#: Fields that were never filled in:
FIELDS = (
    ("{{", r"\{\{[^{}\n]+\}\}"),
    ("${", r"\$\{[^{}\n]+\}"),
    ("#{", r"#\{[^{}\n]+\}"),
    ("{%", r"\{%[^%\n]+%\}"),
    ("<%", r"<%=?[^%\n]+%>"),
    ("[[", r"\[\[[^\[\]\n]+\]\]"),
    ("<<", r"<<[^<>\n]+>>"),
    ("@@", r"@@\w+@@"),
    ("%%", r"%%\w+%%"),
    ("__", r"(?<!_)__[a-z](?:_?[a-z])*__(?!_)"),
    ("«", r"«[a-z]+(?:_[a-z]+)*»"),
    ("[insert ", r"\[insert [^\[\]\n]+\]"),
    ("<insert ", r"<insert [^<>\n]+>"),
    ("[enter ", r"\[enter [^\[\]\n]+\]"),
    (" to be confirmed]", r"\[[^\[\]\n]+ to be confirmed\]"),
)
#: Filler:
FILLER = (
    ("lorem", r"\blorem\b[^.]*\bipsum\b|\bipsum\b[^.]*\blorem\b"),
    ("placeholder", r"\bplaceholder (?:page|text)\b"),
    ("tbd", r"\btbd tbd\b"),
    ("texto de exemplo", r"texto de exemplo"),
    ("isi teks contoh", r"isi teks contoh"),
    ("此处填写", r"此处填写"),
    ("ຂໍ້ຄວາມຕົວຢ່າງ", r"ຂໍ້ຄວາມຕົວຢ່າງ"),
)
#: Messages of servers and programs:
ERRORS = (
    (" not found", r"^\W*(?:http )?(?:error )?[45]\d\d:? not found"),
    ("error ", r"^\W*(?:http )?error [45]\d\d\b"),
    ("erro ", r"^\W*(?:http )?erro [45]\d\d:"),
    ("错误代码", r"错误代码\s*[45]\d\d"),
    ("on this server", r"was not found on this server"),
    ("access denied", r"^\W*access denied\b"),
    ("exception", r"uncaught exception|exception at \w"),
    ("gateway timeout", r"^\W*gateway timeout\b"),
    ("temporar", r"temporar\w+ (?:unavailable|indispon\w+)\W*$"),
    ("tidak ditemukan", r"tidak ditemukan\W*$"),
    ("unexpected error", r"unexpected error (?:has )?occurred"),
    ("connection failed", r"\bconnection failed\b"),
    ("系统繁忙", r"系统繁忙"),
    ("ບໍ່ພົບໜ້າເວັບ", r"ບໍ່ພົບໜ້າເວັບ"),
)
#: Notices that scripts or a browser check are needed:
SCRIPTS = (
    ("javascript", r"\benable javascript\b"),
    ("javascript", r"\bjavascript is disabled\b"),
    ("javascript", r"\bative o javascript\b"),
    ("javascript", r"\baktifkan javascript\b"),
    ("javascript", r"请启用javascript"),
    ("javascript", r"ເປີດໃຊ້ javascript"),
)
Signs = tuple[tuple[str, str], ...]
TRUSTED: Signs = (*FIELDS, *FILLER, *ERRORS, *SCRIPTS)

#: Trusted negatives: blanks printed for the public to fill in; notes of editors in brackets; sentences that set a norm.
_PRINTED = re.compile(r"_{3,}|\.{4,}|…{2,}|\d__|__[年月日]")
_EDITED = re.compile(r"^\W*[\[(][^\[\]]*\b(?:repealed|revoked|amended|substituted|inserted|omitted|revogad\w+|dicabut)\b", re.I)
_NORMS = (" shall ", " must ", " may not ", " need not ", " deve ", " devem ", " deverá ", " não pode", " wajib ", " dilarang ", "应当", "不得", "ຕ້ອງ")
#: A norm is a sentence of so many letters, or ideographs, at least.
_NORM_LETTERS, _NORM_IDEOGRAPHS = 40, 15
_DIGITS = re.compile(r"\d+")
_ENCLOSED = re.compile(r"(?:[\[{<«@%#$]+|(?<!_)_{2,3}(?=[^\W\d_]))[^\[\]{}<>«»@%\n]+?(?:[\]}>»@%]+|(?<=[^\W\d_])_{2,3}(?!_))")
_OPENS = re.compile(r"[\[{<«@%#$]|__")
_NUMBER_NEXT = re.compile("\x1e(?=\\d)")
_WORD = re.compile(r"[^\W\d_⺀-鿿]+(?:_[^\W\d_⺀-鿿]+)*|[⺀-鿿]|\d+_*|_+|[^\w\s]+|[ກ-ໟ]{1,4}")


def passages(text: str) -> list[str]:
    """Lines split into sentences, and each span in brackets or doubled signs once more by itself. A full stop before a
    number ends no sentence ('No. 7')."""
    cut_up = text.replace("。", "。\n").replace(". ", ".\x1e").replace("! ", "!\n").replace("? ", "?\n")
    parts = [p for p in _NUMBER_NEXT.sub(" ", cut_up).replace("\x1e", "\n").split("\n") if p and not p.isspace()]
    if _OPENS.search(text):
        parts += [m[0] for m in _ENCLOSED.finditer(text)]
    return parts


def _bin(word: str) -> int:
    return zlib.crc32(b"0" if word[0].isdecimal() else word.encode())


class Bags:
    """Turns passages into bins. What a run of characters without blanks holds is worked out once and looked up from
    then on; the table starts anew when it has grown too long."""

    def __init__(self, most: int = 300_000) -> None:
        self.most = most
        self.ids: dict[str, int] = {}
        self.flat: list[int] = []
        self.starts: list[int] = []
        self.lens: list[int] = []

    def _id(self, chunk: str) -> int:
        found = [_bin(w) for w in _WORD.findall(chunk)]
        i = self.ids[chunk] = len(self.starts)
        self.starts.append(len(self.flat))
        self.lens.append(len(found))
        self.flat += found
        return i

    def __call__(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(bins of all passages one after the other, passage of each): the words, signs and ideographs, letter case
        aside and numbers alike, and the pairs of them in a row."""
        if len(self.ids) > self.most:
            self.__init__(self.most)
        ids: list[int] = []
        counts = np.empty(len(parts), np.int64)
        get = self.ids.get
        for k, p in enumerate(parts):
            chunks = p.lower().split()
            counts[k] = len(chunks)
            ids += [i if (i := get(c)) is not None else self._id(c) for c in chunks]
        at = np.array(ids, np.int64)
        lens = np.array(self.lens, np.int64)[at] if len(at) else np.zeros(0, np.int64)
        total = int(lens.sum())
        within = np.arange(total) - np.repeat(np.cumsum(lens) - lens, lens)
        words = np.array(self.flat, np.int64)[np.repeat(np.array(self.starts, np.int64)[at], lens) + within] if total else np.zeros(0, np.int64)
        owner = np.repeat(np.repeat(np.arange(len(parts)), counts), lens)
        same = owner[1:] == owner[:-1]
        pairs = HALF + ((words[:-1] * 40503 + words[1:] * 7 + 1) >> 3)[same] % HALF
        return np.concatenate([words % HALF, pairs]), np.concatenate([owner, owner[1:][same]])


def bins(passage: str) -> np.ndarray:
    return Bags()([passage])[0]


def evidence(odds: np.ndarray, found: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Log odds of each of ``n`` passages by their words and pairs."""
    size = np.bincount(owner, minlength=n)
    return np.bincount(owner, weights=odds[found], minlength=n) * np.minimum(1.0, LENGTH / np.maximum(1, size))


@cache
def _gate(signs: Signs):
    import ahocorasick

    patterns: dict[str, list[re.Pattern]] = {}
    for literal, pattern in signs:
        patterns.setdefault(literal, []).append(re.compile(pattern))
    a = ahocorasick.Automaton()
    for literal, found in patterns.items():
        a.add_word(literal, tuple(found))
    a.make_automaton()
    return a


def trusted(passage: str, signs: Signs = TRUSTED) -> bool:
    """True if the passage holds a trusted sign."""
    low = passage.lower()
    return any(p.search(low) for group in {ps for _, ps in _gate(signs).iter(low)} for p in group)


def _may_be_trusted(text: str, signs: Signs) -> bool:
    return next(_gate(signs).iter(text.lower()), None) is not None


def never_residue(parts: list[str]) -> list[bool]:
    """Whether each passage of a record is of a trusted negative kind: printed blanks, notes of editors, norms, and running
    heads: lines with a number that come again in the record, with another number or with text between."""
    out = [False] * len(parts)
    forms: dict[str, list[int]] = {}
    whole = "\n".join(parts)
    blanks = "__" in whole or "...." in whole or "……" in whole
    norms = [w for w in _NORMS if w in whole]
    for k, p in enumerate(parts):
        if norms and len(p) >= (_NORM_IDEOGRAPHS if p[-1] > "\u2e80" else _NORM_LETTERS):
            for w in norms:
                if w in p:
                    out[k] = True
                    break
        if not out[k]:
            out[k] = bool(blanks and _PRINTED.search(p) or p[0] in "[( " and _EDITED.search(p))
        if not out[k] and len(parts) > 1 and (form := _DIGITS.sub("0", p)) != p:
            forms.setdefault(form.strip(), []).append(k)
    for same in forms.values():
        if len(same) > 1 and (same[-1] - same[0] > 2 or len({parts[k].strip() for k in same}) > 1):
            for k in same:
                out[k] = True
    return out


def _cut_up(texts: pd.Series, signs: Signs) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """The passages of a batch, the row of each, its place in the row's list, and whether it is trusted."""
    parts: list[str] = []
    sizes: list[int] = []
    marks: list[bool] = []
    for text in texts:
        own = passages(text)
        parts += own
        sizes.append(len(own))
        marks += [trusted(p, signs) for p in own] if _may_be_trusted(text, signs) else [False] * len(own)
    n = np.array(sizes, np.int64)
    rows = np.repeat(np.arange(len(n)), n)
    return parts, rows, np.arange(len(parts)) - np.repeat(np.cumsum(n) - n, n), np.array(marks, bool)


def _count(batches: Iterator[pd.DataFrame], signs: Signs) -> Iterator[pd.DataFrame]:
    kinds = np.zeros((3, BINS), np.int64)
    totals = np.zeros((3, len(SIZES) + 1), np.int64)
    bags = Bags()
    for batch in batches:
        parts, rows, place, sure = _cut_up(batch["x"], signs)
        found, owner = bags(parts)
        starts = np.flatnonzero(place == 0)
        never = np.array([x for a, b in zip(starts, [*starts[1:], len(parts)]) for x in never_residue(parts[a:b])], bool) & ~sure
        size = np.digitize(np.bincount(rows, minlength=len(batch))[rows], SIZES)
        for k, mine in enumerate((np.ones(len(parts), bool), sure, never)):
            kinds[k] += np.bincount(found[mine[owner]] if k else found, minlength=BINS)
            totals[k] += np.bincount(size[mine], minlength=len(SIZES) + 1)
    at = np.flatnonzero(kinds[0])
    of = [*(-1 - np.arange(len(SIZES) + 1)), *at]
    yield pd.DataFrame({"bin": of, "n": [*totals[0], *kinds[0][at]], "sure": [*totals[1], *kinds[1][at]], "never": [*totals[2], *kinds[2][at]]})


@dataclass
class Model:
    """Log odds of bins against the rest and against the trusted negatives, and the prior log odds: by size of the
    record and by what stands beside (nothing, something doubtful, residue), and against the trusted negatives."""

    rest: np.ndarray
    never: np.ndarray
    prior: np.ndarray
    prior_never: float

    def passages(self, b: Kept) -> tuple[np.ndarray, np.ndarray]:
        """Probability of each passage, and the cells of ``prior`` of all places of the records."""
        n = len(b.marks)
        rest, never = evidence(self.rest, b.found, b.owner, n), evidence(self.never, b.found, b.owner, n) + self.prior_never
        p = (b.marks > 0).astype(float)
        for _ in range(2):  # first with trusted neighbours alone, then with those that are residue by their words
            dense = np.zeros(b.places + 2)
            dense[b.at + 1] = np.where(p >= BESIDE, p, 0)
            cell = b.sizes * 3 + np.digitize(np.maximum(dense[:-2], dense[2:]), [0.1, 0.5])
            z = -np.logaddexp(-(rest + self.prior[cell[b.at]]), -never)
            p = np.where(b.marks > 0, 1.0, np.where(b.marks < 0, 0.0, _posterior(z)))
        return p, cell


def _posterior(score: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(score, -50, 50)))


@dataclass
class Kept:
    """Kept passages of a batch of records: bins and the passage of each, marks, the place of each passage among the
    ``places`` of all records one after the other with one free place between them, and the size class of every place."""

    found: np.ndarray
    owner: np.ndarray
    marks: np.ndarray
    at: np.ndarray
    sizes: np.ndarray

    @property
    def places(self) -> int:
        return len(self.sizes)

    @staticmethod
    def of(batch: pd.DataFrame) -> Kept:
        size = batch["size"].to_numpy(np.int64)
        starts = np.cumsum(size + 1) - size - 1
        flat = lambda c, kind: np.concatenate([np.asarray(x, kind) for x in batch[c]]) if len(batch) else np.zeros(0, kind)
        many = np.array([len(x) for x in batch["place"]], np.int64)
        lens = flat("lens", np.int64)
        return Kept(flat("bins", np.int64), np.repeat(np.arange(len(lens)), lens), flat("marks", np.int64), flat("place", np.int64) + np.repeat(starts, many), np.repeat(np.digitize(size, SIZES), size + 1))


def _mixed(counts: np.ndarray, share: float, other: np.ndarray) -> np.ndarray:
    return (1 - share) * counts / max(counts.sum(), 1e-9) + share * other


def learnt(pos: np.ndarray, every: np.ndarray, never: np.ndarray, prior: np.ndarray, prior_never: float) -> Model:
    """The model of weighted counts of bins. Words unseen in residue are no evidence for it, however rare they are."""
    rest, odds, against = np.maximum(every - pos, 0), np.zeros(BINS), np.zeros(BINS)
    for half in (slice(0, HALF), slice(HALF, BINS)):
        even, corpus = np.full(HALF, 1 / HALF), every[half] / max(every[half].sum(), 1)
        other = even if half.start == 0 else CORPUS_PAIRS * corpus + (1 - CORPUS_PAIRS) * even
        odds[half] = np.log(_mixed(pos[half], EVEN, other)) - np.log(_mixed(rest[half], EVEN_REST, other))
        against[half] = np.log(_mixed(pos[half], 0.1, corpus) + 1e-9) - np.log(_mixed(never[half], 0.1, corpus) + 1e-9)
    odds = np.where(pos < 0.01, np.minimum(odds, 0), odds)
    return Model(np.clip(odds, -MOST, MOST).astype(np.float32), np.clip(against, -MOST, MOST).astype(np.float32), prior, prior_never)


def _priors(pos: np.ndarray, all_: np.ndarray, n_pos: float, n_never: float) -> tuple[np.ndarray, float]:
    """Log odds of residue per cell, drawn to the whole corpus' share where a cell is small; at most even."""
    base = n_pos / max(all_.sum(), 1)
    share = np.clip((pos + 20 * base) / (all_ + 20), 1e-4, 0.5)
    return np.log(share / (1 - share)), float(np.log(max(n_pos, 1) / max(n_never, 1)))


def residue_passages(docs: DataFrame, doc_id: str, text: str, signs: Signs = TRUSTED) -> DataFrame:
    """Scored passages of documents that may be residue: ``doc_id, passage, trusted, probability``.

    All passages of all documents are counted and scored. Left out of the result are those below FLOOR under the first
    model and those of trusted negative kinds (``never_residue``). Null and empty texts have no passages; repeated rows
    repeat their passages; other columns don't matter. ``signs`` are the trusted signs to start from. If nothing trusted exists in the corpus, there is nothing to learn
    from and the result is empty.

    The model is a few vectors of fixed size (BINS), which are all that ever reaches the driver. Two passes over the
    texts: counts, and scores under the first model; the rounds run over the passages that remain, a row per record.
    """
    spark = docs.sparkSession
    src = docs.select(F.col(doc_id).alias("d"), F.col(text).alias("x")).where(F.length("x") > 0)
    counts = src.select("x").mapInPandas(lambda batches: _count(batches, signs), "bin int, n long, sure long, never long").groupBy("bin").agg(*[F.sum(c).alias(c) for c in ("n", "sure", "never")]).toPandas()
    kind = src.schema["d"].dataType.simpleString()
    classes = len(SIZES) + 1
    every, sure, never = np.zeros(BINS), np.zeros(BINS), np.zeros(BINS)
    totals = np.zeros((3, classes))
    words, heads = counts[counts["bin"] >= 0], counts[counts["bin"] < 0]
    for k, (c, vector) in enumerate((("n", every), ("sure", sure), ("never", never))):
        vector[words["bin"]] = words[c]
        totals[k][-1 - heads["bin"]] = heads[c]
    if not totals[1].sum():
        return spark.createDataFrame([], f"doc_id {kind}, passage string, trusted boolean, probability double")
    n_never = totals[2].sum()
    # the first prior knows sizes only; a doubtful or trusted neighbour makes residue as likely as not
    prior, prior_never = _priors(np.stack([totals[1], totals[1] * 0, totals[1] * 0], axis=1).ravel(), np.stack([totals[0], totals[0] * 0, totals[0] * 0], axis=1).ravel(), totals[1].sum(), n_never)
    prior.reshape(-1, 3)[:, 1:] = 0.0
    model = learnt(sure, every, never, prior, prior_never)
    first = spark.sparkContext.broadcast(model.rest)

    def screen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bags = Bags()
        for batch in batches:
            parts, rows, place, sure = _cut_up(batch["x"], signs)
            found, owner = bags(parts)
            keep = sure | (evidence(first.value, found, owner, len(parts)) >= FLOOR)
            order = np.argsort(owner, kind="stable")
            found, size = found[order], np.bincount(owner, minlength=len(parts))
            ends = np.cumsum(size)
            out = []
            for row in np.unique(rows[keep]):
                lo, hi = np.searchsorted(rows, [row, row + 1])
                never = np.array(never_residue(parts[lo:hi]), bool) & ~sure[lo:hi]
                i = np.flatnonzero(keep[lo:hi] & ~never) + lo
                if len(i):
                    out.append((batch["d"].iloc[row], hi - lo, [parts[k] for k in i], place[i], sure[i].astype(np.int64), size[i], np.concatenate([found[ends[k] - size[k] : ends[k]] for k in i])))
            yield pd.DataFrame(out, columns=["doc_id", "size", "passages", "place", "marks", "lens", "bins"]).astype({"size": "int64"})

    left = cut(src.mapInPandas(screen, f"doc_id {kind}, size long, passages array<string>, place array<int>, marks array<int>, lens array<int>, bins array<int>"), "passages")

    for _ in range(ROUNDS):
        at = spark.sparkContext.broadcast(model)

        def expect(batches: Iterator[pd.DataFrame], at=at) -> Iterator[pd.DataFrame]:
            pos, cells, beside = np.zeros(BINS), np.zeros(3 * classes), np.zeros(3 * classes)
            for batch in batches:
                b = Kept.of(batch)
                p, cell = at.value.passages(b)
                w = np.where(p >= LEAST, p, 0.0)
                pos += np.bincount(b.found, weights=w[b.owner], minlength=BINS)
                cells += np.bincount(cell[b.at], weights=w, minlength=3 * classes)
                inside = np.ones(b.places, bool)
                inside[np.cumsum(batch["size"].to_numpy(np.int64) + 1) - 1] = False
                beside += np.bincount(cell[inside], minlength=3 * classes)
            k = np.flatnonzero(pos)
            yield pd.DataFrame({"bin": [*(-1 - np.arange(6 * classes)), *k], "w": [*cells, *beside, *pos[k]]})

        got = left.select("size", "place", "marks", "lens", "bins").mapInPandas(expect, "bin int, w double").groupBy("bin").agg(F.sum("w").alias("w")).toPandas()
        inner, outer = got[got["bin"] >= 0], got[got["bin"] < 0]
        pos, sums = np.zeros(BINS), np.zeros(6 * classes)
        pos[inner["bin"]] = inner["w"]
        sums[-1 - outer["bin"]] = outer["w"]
        cells, all_ = sums[: 3 * classes], sums[3 * classes :].reshape(-1, 3)
        all_[:, 0] = totals[0] - all_[:, 1:].sum(axis=1)  # records of which nothing is left have no neighbours either
        model = learnt(pos, every, never, *_priors(cells, all_.ravel(), cells.sum(), n_never))

    last = spark.sparkContext.broadcast(model)

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            b = Kept.of(batch)
            p, _ = last.value.passages(b)
            ids = batch["doc_id"].to_numpy()[np.repeat(np.arange(len(batch)), [len(x) for x in batch["place"]])]
            yield pd.DataFrame({"doc_id": ids, "passage": pd.Series([x for xs in batch["passages"] for x in xs], dtype=object), "trusted": b.marks > 0, "probability": p})

    return left.mapInPandas(decide, f"doc_id {kind}, passage string, trusted boolean, probability double")


def residue_documents(docs: DataFrame, doc_id: str, text: str, signs: Signs = TRUSTED) -> DataFrame:
    """Documents with residue anywhere in them: ``doc_id, probability, passages, trusted`` (the greatest probability of a
    passage, how many reach DECISION, and whether one of them holds a trusted sign; else the model alone found the
    document). One row per id; the rest of the corpus is what an anti join leaves."""
    scored = residue_passages(docs, doc_id, text, signs).where(F.col("probability") >= DECISION)
    return scored.groupBy("doc_id").agg(F.max("probability").alias("probability"), F.count(F.lit(1)).alias("passages"), F.bool_or("trusted").alias("trusted"))
