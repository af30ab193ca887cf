"""Column functions over dates in text, language and economy codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Months in English and Malay, by number.
MONTHS = {"january": 1, "february": 2, "march": 3, "april": 4, "may": 5, "june": 6, "july": 7, "august": 8, "september": 9, "october": 10, "november": 11, "december": 12, "januari": 1, "februari": 2, "mac": 3, "mei": 5, "jun": 6, "julai": 7, "ogos": 8, "oktober": 10, "disember": 12}
#: What economies are called.
ECONOMIES = {"australia": "AU", "malaysia": "MY", "singapore": "SG", "timor-leste": "TL", "timor leste": "TL", "lao pdr": "LA", "laos": "LA", "la": "LA", "china": "CN"}
#: Aliases of languages.
LANGUAGES = {"en": "eng", "english": "eng", "pt": "por", "portuguese": "por", "zh": "zho", "chinese": "zho", "lo": "lao", "lao": "lao", "id": "ind", "indonesian": "ind", "tetum": "tet", "fr": "fra"}

_ANY = r"(?i)([0-9]{1,2}[-/][0-9]{1,2}[-/][0-9]{4}|[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2} (?:" + "|".join(MONTHS) + ") [0-9]{4})"


def _lookup(table: dict[str, object]) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])


def _iso(y: Column, m: Column, d: Column) -> Column:
    """ISO text if month and day are in range, else null: the calendar is not asked."""
    y, m, d = (x.cast("int") for x in (y, m, d))
    return F.when(m.between(1, 12) & d.between(1, 31), F.format_string("%04d-%02d-%02d", y, m, d))


def day_first(c: Column) -> Column:
    """``25/3/2026`` and ``25-03-2026``."""
    part = lambda k: F.nullif(F.regexp_extract(c, r"^\s*([0-9]{1,2})[-/]([0-9]{1,2})[-/]([0-9]{4})\s*$", k), F.lit(""))
    return _iso(part(3), part(2), part(1))


def any_date(c: Column) -> Column:
    """ISO text of a date in one of the notations, else null."""
    part = lambda p, k: F.nullif(F.regexp_extract(c, p, k), F.lit(""))
    iso, named = r"^([0-9]{4})-([0-9]{2})-([0-9]{2})$", r"^([0-9]{1,2}) ([A-Za-z]+) ([0-9]{4})$"
    month = F.try_element_at(_lookup(MONTHS), F.lower(part(named, 2)))
    return F.coalesce(day_first(c), _iso(part(iso, 1), part(iso, 2), part(iso, 3)), _iso(part(named, 3), month, part(named, 1)))


def all_dates(c: Column) -> Column:
    """The dates of a text as ISO text, in order."""
    return F.filter(F.transform(F.regexp_extract_all(c, F.lit(_ANY), 1), any_date), lambda d: d.isNotNull())


def first_date(c: Column) -> Column:
    """The first date of a text, or null."""
    return F.try_element_at(all_dates(c), F.lit(1))


def stamp(c: Column) -> Column:
    """Exactly eight digits as ISO text, the range unchecked."""
    return F.when(c.rlike("^[0-9]{8}$"), F.concat_ws("-", F.substring(c, 1, 4), F.substring(c, 5, 2), F.substring(c, 7, 2)))


def language_code(c: Column) -> Column:
    """Three-letter code of a name or code, with or without region; unknown codes of three letters stay."""
    k = F.regexp_replace(F.lower(F.trim(c)), r"[-_].*$", "")
    return F.coalesce(F.try_element_at(_lookup(LANGUAGES), k), F.when(k.rlike("^[a-z]{3}$"), k))


def economy_code(c: Column) -> Column:
    """Two-letter code of an economy; null for the unknown, never a guess."""
    k = F.lower(F.trim(c))
    return F.coalesce(F.try_element_at(_lookup(ECONOMIES), k), F.when(F.upper(k).isin(*sorted(set(ECONOMIES.values()))), F.upper(k)))


def earliest_date(texts: Column, published: Column) -> Column:
    """The earliest date of a text, else the day of publication."""
    return F.coalesce(F.array_min(all_dates(texts)), published)


def display_date(c: Column, pattern: str = "d MMMM yyyy") -> Column:
    """A date as it is displayed, by the real calendar; null if there is no such day."""
    return F.try_to_date(c, pattern)


#: What languages are called.
LANGUAGE_NAMES = {"eng": "English", "por": "Portuguese", "zho": "Chinese", "lao": "Lao", "ind": "Indonesian", "tet": "Tetum", "fra": "French"}


def language_name(code: Column) -> Column:
    """Display name of a language code; blank for the unknown."""
    return F.coalesce(F.try_element_at(_lookup(LANGUAGE_NAMES), code), F.lit(""))
