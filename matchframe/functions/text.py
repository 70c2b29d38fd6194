"""Text keys for linking names across sources, and numbers written as text."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F


def _plain(char: str) -> str:
    """Compatibility decomposition of a character without its combining marks."""
    return "".join(c for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c))


@cache
def _fold_tables() -> tuple[str, str, str, str]:
    """Characters to replace one for one and their replacements; characters that become several letters and lie
    below U+2000, and "x:letters" pairs of all that do.

    Built from the Unicode database. Characters whose decomposition has no letter or digit are left out
    (they turn into a space later), marks are put last without a replacement (``translate`` drops those).
    """
    single: dict[str, str] = {}
    several: dict[str, str] = {}
    dropped: list[str] = []
    # Ideographs, Hangul and surrogates have neither letters nor marks to find.
    for code in [*range(0x80, 0x3400), *range(0xA000, 0xAC00), *range(0xF900, 0x1FC00)]:
        char = chr(code)
        plain = _plain(char)
        keeps = any(c.isascii() and c.isalnum() for c in plain)
        if not plain:
            dropped.append(char)
        elif keeps and len(plain) == 1:
            single[char] = plain
        elif keeps:
            several[char] = "".join(c if c.isascii() and c.isalnum() else " " for c in plain)
    low = "".join(c for c in several if c < "\u2000")
    pairs = ",".join(f"{c}:{s}" for c, s in several.items())
    return "".join(single) + "".join(dropped), "".join(single.values()), low, pairs


def strip_accents(text: Column) -> Column:
    """Letters without accents, ligatures and other compatibility forms spelled out."""
    matching, replacement, low, pairs = _fold_tables()
    spelled = F.str_to_map(F.lit(pairs), F.lit(","), F.lit(":"))

    def spell(c: Column) -> Column:
        plain = (c < "\u2000") & ~c.isin(*low)
        return F.when(plain, c).otherwise(F.coalesce(F.try_element_at(spelled, c), c))

    # Few texts have such a character, so only those are taken apart.
    expanded = F.array_join(F.transform(F.split(text, ""), spell), "")
    rare = text.rlike(f"[{low}\u2000-\U0010ffff]")
    return F.translate(F.when(rare, expanded).otherwise(text), matching, replacement)


def normalise_name(text: Column) -> Column:
    """Lower-case ASCII words separated by single spaces; null becomes an empty text."""
    words = F.regexp_replace(F.lower(strip_accents(text)), "[^a-z0-9]+", " ")
    return F.coalesce(F.trim(words), F.lit(""))


def strip_id_suffix(text: Column) -> Column:
    """Name without a trailing "(123)"."""
    return F.coalesce(F.regexp_replace(text, r"\s*\(\d+\)\s*$", ""), F.lit(""))


def cut_at_bracket(text: Column) -> Column:
    """Name up to its first bracket."""
    return F.substring_index(text, "(", 1)


def full_name(given: Column, family: Column) -> Column:
    return F.trim(F.concat_ws(" ", given, family))


def surname(name_norm: Column) -> Column:
    """Last word of a normalised name, null where it is empty."""
    return F.nullif(F.substring_index(name_norm, " ", -1), F.lit(""))


def initial(name_norm: Column) -> Column:
    """First letter of a normalised name, null where it is empty."""
    return F.nullif(F.substring(name_norm, 1, 1), F.lit(""))


def is_initial_form(name_norm: Column) -> Column:
    """True for names such as "e martinez": two words or more, the first a single letter."""
    return name_norm.rlike("^[a-z0-9] ")


def contains_or_false(text: Column, part: str) -> Column:
    return F.coalesce(text.contains(part), F.lit(False))


def coerce_stat(raw: Column) -> Column:
    """Number written as text: "54%" is 0.54, anything that is no number is null."""
    text = F.trim(raw)
    percent = F.regexp_replace(text, "%+$", "").try_cast("double") / 100
    return F.when(text.endswith("%"), percent).otherwise(text.try_cast("double"))
