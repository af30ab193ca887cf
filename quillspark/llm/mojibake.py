"""Text read in the wrong character encoding: find it, and restore what can be restored.

Method: for every pair (right encoding, wrong encoding) the garbled form of every character is computed beforehand; one
automaton finds these sequences, and only matched spans are replaced, so correct text beside them stays as it is.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Single-byte encodings in which UTF-8 may have been read, with the one they are counted with.
WRONG = {"cp1252": "cp1252", "latin-1": "cp1252", "cp1250": "cp1250", "cp437": "cp437", "cp850": "cp850", "mac_roman": "mac_roman", "cp1251": "cp1251", "cp874": "cp874"}
#: Wrong encodings without letters of another alphabet, where double-byte text shows as heaps of accents and signs.
WRONG_LATIN = ("latin-1", "cp1252", "cp437", "cp850", "mac_roman")
#: The double-byte encoding, right or wrong.
DOUBLE = "gb18030"
#: Characters that titles may hold, as ranges: Latin with accents (and control characters, that a first
#: wrong reading left), punctuation, currency, Thai and Lao, Vietnamese, CJK punctuation, ideographs and full widths.
REPERTOIRE = ((0x80, 0x17F), (0x1A0, 0x1A1), (0x1AF, 0x1B0), (0xE01, 0xE3A), (0xE3F, 0xE5B), (0xE81, 0xEDF), (0x1EA0, 0x1EF9), (0x2010, 0x2026), (0x20AC, 0x20AC), (0x2122, 0x2122), (0x3000, 0x3011), (0x4E00, 0x9FA5), (0xFF01, 0xFF5E))
_CLOSING = set("”’»…–—™®º")
_LOST = "�"
#: A lead byte whose continuation was dropped as invisible: A with tilde before a small letter starts no word.
_CUT_SHORT = re.compile(r"Ã(?=[a-z])")
_ALONE = re.compile(r"(?<!\w)Ã (?= ?\w)")  # its continuation, a no-break space, became a plain one
_CONTINUATION = bytes(range(0x80, 0xC0))
_HIGH_RUN = re.compile(r"[^\x00-\x7f]+")


class Hit(NamedTuple):
    """A span of a text with what it stood for; ``to`` is None if that is lost."""

    start: int
    end: int
    to: str | None


def _byte_chars(enc: str) -> list[str]:
    """What each byte shows as; bytes that the encoding lacks show as the control character, or as lost where they
    can't be passed through."""
    out = []
    for b in range(256):
        try:
            out.append(bytes([b]).decode(enc))
        except UnicodeDecodeError:
            out.append(chr(b))
    return out


def repertoire() -> list[str]:
    """Characters that may have been garbled: those of REPERTOIRE, and what the wrong encodings show, for text that was
    read wrongly twice."""
    chars = dict.fromkeys(chr(c) for a, b in REPERTOIRE for c in range(a, b + 1) if unicodedata.category(chr(c)) != "Cn")
    return [*chars, *dict.fromkeys(ch for enc in WRONG for ch in _byte_chars(enc) if not ch.isascii() and ch not in chars)]


@cache
def _automaton():
    """Garbled sequence to [(wrong encoding, character)], for all pairs with UTF-8 as the right encoding. Built once in
    each Python worker."""
    import ahocorasick

    table: dict[str, dict[str, str]] = {}
    for enc, like in WRONG.items():
        show = _byte_chars(enc)
        for ch in repertoire():
            seq = "".join(show[b] for b in ch.encode())
            if not seq.isascii() and seq != ch:
                table.setdefault(seq, {}).setdefault(like, ch)
                if len(seq) > 2 and "\xa0" in seq[1:-1]:  # the blank in it may have become a plain one
                    table.setdefault(seq.replace("\xa0", " "), {}).setdefault(like, ch)
    a = ahocorasick.Automaton()
    for seq, means in table.items():
        a.add_word(seq, (len(seq), tuple(means.items())))
    a.make_automaton()
    return a


@cache
def _bytes_of(enc: str) -> dict[str, int]:
    return {ch: b for b, ch in enumerate(_byte_chars(enc))}


@cache
def _known() -> frozenset[str]:
    return frozenset(repertoire())


def _letter(ch: str) -> bool:
    return unicodedata.category(ch)[0] == "L" and ch not in "ªºµ" or unicodedata.category(ch)[0] == "M"


def _latin(ch: str) -> bool:
    return "LATIN" in unicodedata.name(ch, "")


def _strong(text: str, start: int, end: int) -> bool:
    """True if the sequence can't be correct text by itself."""
    seq = text[start:end]
    before, after = text[start - 1 : start], text[end : end + 1]
    if len(seq) == 2 and seq[1] in _CLOSING and seq[0].isupper():
        # a closing mark after a word in capitals may be correct
        return seq[0] in "ÂÃ" and (seq[1] == "º" or after.isalpha() or before == "")
    if any(not _letter(ch) for ch in seq):
        return True
    if all(_latin(ch) for ch in seq):
        return seq[0].isupper() or len(seq) > 2
    scripts = {unicodedata.name(ch, "?").split()[0] for ch in seq}
    # letters of one other alphabet: only where they stand inside a Latin word
    return len(scripts) > 1 or before.isascii() and before.isalpha() and before != "" or after.isascii() and after.isalpha() and after != ""


def _sequences(text: str) -> list[Hit]:
    """Garbled sequences of the one wrong encoding that explains most of ``text``, leftmost and longest first, without
    overlaps; none if they may all be correct text."""
    found: dict[str, dict[int, tuple[int, str]]] = {}
    for end, (n, means) in _automaton().iter(text):
        for enc, ch in means:
            at = found.setdefault(enc, {})
            if n > at.get(end - n + 1, (0,))[0]:
                at[end - n + 1] = n, ch
    best: list[Hit] = []
    for at in found.values():
        chosen, pos = [], 0
        for i in sorted(at):
            if i >= pos:
                chosen.append(Hit(i, i + at[i][0], at[i][1]))
                pos = i + at[i][0]
        touching = sum(x.end == y.start for x, y in zip(chosen, chosen[1:]))
        if (touching >= 2 or any(_strong(text, h.start, h.end) for h in chosen)) and sum(h.end - h.start for h in chosen) > sum(h.end - h.start for h in best):
            best = chosen
    return best


def _double_as_latin(text: str) -> list[Hit]:
    """Runs of accents and signs that are double-byte text read as a Latin encoding: at least two characters, all known."""
    out = []
    for m in _HIGH_RUN.finditer(text):
        if len(m[0]) < 4:
            continue
        for enc in WRONG_LATIN:
            table = _bytes_of(enc)
            if all(ch in table for ch in m[0]):
                raw = bytes(table[ch] for ch in m[0])
                try:
                    raw.decode("utf-8")
                    break
                except UnicodeError:
                    pass
                try:
                    to = raw.decode(DOUBLE)
                except UnicodeError:
                    continue
                if len(to) * 2 == len(m[0]) and all(ch in _known() and ord(ch) >= 0x2010 for ch in to):
                    out.append(Hit(m.start(), m.end(), to))
                    break
    return out


@cache
def _as_bytes(ch: str) -> bytes:
    try:
        raw = ch.encode("gbk")
    except UnicodeError:
        return b""
    return raw if len(raw) == 2 else b""


def _utf8_as_double(text: str) -> list[Hit]:
    """Runs of double-byte characters that are UTF-8 text: their bytes must be UTF-8 of known characters, but for what
    was lost at the ends of the run. A run of one or two characters counts only in text that is Latin otherwise."""
    runs, i = [], 0
    while i < len(text):
        if not _as_bytes(text[i]):
            i += 1
            continue
        j = i
        while j < len(text) and _as_bytes(text[j]):
            j += 1
        runs.append((i, j))
        i = j
    latin = sum(ch.isascii() and ch.isalpha() for ch in text)
    out = []
    for i, j in runs:
        raw = b"".join(_as_bytes(ch) for ch in text[i:j])
        body = raw.lstrip(_CONTINUATION) if text[i - 1 : i] == _LOST else raw
        try:
            to, tail = body.decode("utf-8"), 0
        except UnicodeDecodeError as e:
            tail = len(body) - e.start
            if tail > 2 or not 0xC2 <= body[e.start] <= 0xEF:
                continue
            to = body[: e.start].decode("utf-8")
        if not all(ch in _known() or ch.isascii() for ch in to) or not to and text[j : j + 1] != _LOST:
            continue
        if j - i > 2 and any(not ch.isascii() for ch in to) or j - i <= 2 and latin >= 3 and (to == "" or _letter(to[0]) or not to[0].isascii()):
            out.append(Hit(i, j, to if not tail and body == raw else None))
    if any(h.end - h.start <= 2 for h in out) and len(out) < sum(any("\u4e00" <= ch <= "\u9fff" for ch in text[i:j]) for i, j in runs):
        out = [h for h in out if h.end - h.start > 2]
    return out


def hits(text: str, repaired: bool = False) -> list[Hit]:
    """The damaged spans of ``text`` in order. Text that was ``repaired`` once is only looked at for UTF-8 garbled again."""
    if text.isascii():
        return []
    size = lambda hs: sum(h.end - h.start for h in hs)
    out = _sequences(text) if repaired else max(_double_as_latin(text), _sequences(text), key=size) or _utf8_as_double(text)
    covered = {i for h in out for i in range(h.start, h.end)}
    out += [Hit(m.start(), m.end(), "à" if text[m.end()] == " " else "à ") for m in _ALONE.finditer(text) if out and not covered & {m.start(), m.end() - 1}]
    out += [Hit(m.start(), m.end(), None) for m in _CUT_SHORT.finditer(text) if m.start() not in covered]
    out += [Hit(i, i + 1, None) for i, ch in enumerate(text) if ch == _LOST and i not in covered]
    return sorted(out)


def repair(text: str) -> tuple[bool, str, bool]:
    """(damaged, text with the spans restored that can be, whether all of it could be). Text may have been read wrongly any
    number of times; each round makes it shorter, so there is an end."""
    damaged, k, size = False, 0, len(text) + 1
    while len(text) < size:
        found, k, size = hits(text, k > 0), k + 1, len(text)
        damaged |= bool(found)
        if not any(h.to is not None for h in found):
            break
        parts, pos = [], 0
        for h in found:
            if h.to is not None and h.start >= pos:
                parts += [text[pos : h.start], h.to]
                pos = h.end
        text = "".join(parts) + text[pos:]
    return damaged, text, damaged and not hits(text, True)


def damaged_texts(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """The rows whose ``text`` shows wrong decoding: columns ``keep``, then ``damaged`` (the text), ``restored`` and
    ``complete`` (false if a part is lost).

    Null, empty and pure ASCII texts are never damaged. Repeated rows stay repeated. Further columns are not read; names
    in ``keep`` may not be ``damaged``, ``restored`` or ``complete``. No shuffle: each row is decided by itself.
    """
    src = df.select(*keep, F.col(text).alias("damaged")).where(F.col("damaged").rlike(r"[^\x00-\x7f]"))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            done = [repair(t) for t in b["damaged"]]
            b = b.astype({c: object for c in b.columns if b[c].dtype.kind not in "iufbM"})
            b = b.assign(restored=pd.Series([d[1] for d in done], dtype=object, index=b.index), complete=[d[2] for d in done])
            yield b[[d[0] for d in done]]

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields)
    return src.mapInPandas(search, f"{fields}, restored string, complete boolean")
