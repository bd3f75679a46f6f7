"""String expressions shared by the operators; all run inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Whatever Unicode calls white space, and the zero-width marks that editors leave.
BLANK = r"[\s\v\x{85}\x{a0}\x{1680}\x{2000}-\x{200b}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"


def strip_blanks(c: Column | str) -> Column:
    """The text without white space of any kind at its ends; null stays null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(c, f"^{BLANK}+|{BLANK}+$", "")


def key_form(c: Column | str) -> Column:
    """A reference key as it is compared: stripped and in lower case."""
    return F.lower(strip_blanks(c))


def letters_digits(c: Column | str) -> Column:
    """Lower case without anything but letters and digits (Unicode L and N)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "")
