"""Text, code and number harmonization."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from ribeira.functions.sql import evaluate, let, text

# White space as Python's str.strip() sees it; Java's \s stops at ASCII and leaves out \x1c-\x1f.
SPACE = r"\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# What is left of it once a text is plain ASCII.
ASCII_SPACES = r"[\s\x1c-\x1f]+"

# Texts that count as a number. Casts alone differ between engines ("5d", "1_000", "NaN").
NUMBER = r"(?i)^\s*[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf(inity)?)\s*$"

NOT_ASCII = r"[^\x00-\x7F]"


@lru_cache(maxsize=1)
def ascii_folds() -> tuple[str, str, str, list[str]]:
    """Compatibility decompositions reduced to ASCII, worked out from the Unicode database.

    Returns (characters, their one-letter forms, characters with longer forms, those forms).
    Characters of which nothing ASCII remains are in neither list. The rule is per character:
    normalization only reorders combining marks beyond that, and they are dropped anyway.
    """
    single, letter, several, forms = [], [], [], []
    # No character beyond the first three planes has a decomposition.
    for point in range(0x80, 0x30000):
        if 0xD800 <= point <= 0xDFFF:
            continue
        rest = unicodedata.normalize("NFKD", chr(point)).encode("ascii", "ignore").decode()
        if len(rest) == 1:
            single.append(chr(point))
            letter.append(rest)
        elif rest:
            several.append(chr(point))
            forms.append(rest)
    return "".join(single), "".join(letter), "".join(several), forms


def fold_to_ascii(c: Column) -> Column:
    """NFKD with everything outside ASCII dropped: ``São`` -> ``Sao``, ``ﬁ`` -> ``fi``.

    Plain ASCII rows skip all of it. One ``translate`` covers the characters with a one-letter
    form; only rows that still hold other characters are cut up to look for longer forms.
    """
    single, letter, several, forms = ascii_folds()
    # Cut before and after each remaining character, but never inside a surrogate pair.
    cut = text(rf"(?![\uDC00-\uDFFF])(?:(?<={NOT_ASCII})|(?={NOT_ASCII}))")
    place = f"if(length(piece) = 1, position(piece, {text(several)}), 0)"
    longer = f"split({text(chr(10).join(forms))}, '\\n')"
    pieces = f"transform(split(folded, {cut}), piece -> coalesce(get({longer}, {place} - 1), piece))"
    expanded = f"regexp_replace(array_join({pieces}, ''), {text(NOT_ASCII + '+')}, '')"
    finished = let(
        "folded",
        f"translate(arg.c, {text(single)}, {text(letter)})",
        f"if(rlike(folded, {text(NOT_ASCII)}), {expanded}, folded)",
    )
    return F.when(c.rlike(NOT_ASCII), evaluate(finished, c=c)).otherwise(c)


def normalize_text(c: Column) -> Column:
    """ASCII, trimmed, lower case, runs of white space as one blank; null becomes ''."""
    folded = fold_to_ascii(F.coalesce(c.cast("string"), F.lit("")))
    return F.lower(F.trim(F.regexp_replace(folded, ASCII_SPACES, " ")))


def slug(c: Column) -> Column:
    """A safe snake-case name: ``Unidade (Código)`` -> ``unidade_codigo``."""
    words = F.regexp_replace(F.lower(fold_to_ascii(F.coalesce(c.cast("string"), F.lit("")))), "[^a-z0-9]+", "_")
    return F.trim(words, F.lit("_"))


def clean_code(c: Column, width: int = 7) -> Column:
    """All-digit codes padded with zeros to ``width``, never cut; anything else is null."""
    whole = F.regexp_replace(c.cast("string"), r"\.0(?=\n?\z)", "")
    code = F.regexp_replace(whole, f"^[{SPACE}]+|[{SPACE}]+\\z", "")
    padded = F.when(F.length(code) >= width, code).otherwise(F.lpad(code, width, "0"))
    return F.when(code.rlike(r"^\p{Nd}+\z"), padded)


def coerce_numeric(c: Column) -> Column:
    """The number in a text as DOUBLE, or null where there is none or it is out of range."""
    written = c.cast("string")
    number = F.when(written.rlike(NUMBER), written.try_cast("double"))
    overflow = (F.abs(number) == float("inf")) & ~written.rlike("(?i)inf")
    return F.when(~overflow, number)


def localized_number(c: Column) -> Column:
    """Numbers written ``1.234,5``; blanks and dots are grouping, '-' and 'X' mean missing."""
    bare = F.replace(F.replace(c.cast("string"), F.lit(" "), F.lit("")), F.lit("."), F.lit(""))
    return coerce_numeric(F.replace(bare, F.lit(","), F.lit(".")))
