"""Text folding as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space and invisible characters for a character class: no-break, thin and zero-width spaces, byte order mark.
BLANKS = r"\s" + "".join(map(chr, (0xA0, *range(0x2000, 0x200C), 0x202F, 0x3000, 0xFEFF)))

# Letters with diacritics and the plain letters they fold to.
_MARKED = "ąćęłńóśźżáàâãäåăçčďđéèêëěíìîïĺľňñòôõöőøŕřšşťțúùûüůűýÿž"
_PLAIN = "acelnoszzaaaaaaaccddeeeeeiiiillnnoooooorrssttuuuuuuyyz"


def squeeze(c: Column) -> Column:
    """Blanks of all kinds as single spaces, none at the ends."""
    return F.trim(F.regexp_replace(c, f"[{BLANKS}]+", " "))


def strip(c: Column) -> Column:
    """Without blanks of any kind at the ends."""
    return F.regexp_replace(c, f"^[{BLANKS}]+|[{BLANKS}]+$", "")


def fold(c: Column) -> Column:
    """Lower case without diacritics; other characters stay."""
    return F.translate(F.lower(c), _MARKED, _PLAIN)


def fold_words(c: Column) -> Column:
    """Folded text with every run of other characters than a-z and 0-9 as one space."""
    return F.trim(F.regexp_replace(fold(c), "[^a-z0-9]+", " "))


def fold_py(text: str) -> str:
    """:func:`fold` for Python code."""
    return text.lower().translate(_TABLE)


_TABLE = str.maketrans(_MARKED, _PLAIN)
