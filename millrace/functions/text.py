"""Text scoring with Python's notion of white space."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: The 29 code points that Python's str.isspace accepts.
_SPACES = "".join(map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
WS = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: A run of them that is not a single U+0020 already.
_RUN = rf"[\x09-\x0d\x1c-\x1f\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]{WS}*|\x20{WS}+"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(text: Column | str) -> Column:
    """Python's str.strip(): white space goes from both ends. Null stays null."""
    return F.btrim(_col(text), F.lit(_SPACES))


def exact_match(prediction: Column | str, answer: Column | str) -> Column:
    """Equal after stripping and lower-casing; white space inside counts. Null gives null."""
    return F.lower(py_strip(prediction)) == F.lower(py_strip(answer))


def normalize_answer(text: Column | str) -> Column:
    """Stripped, lower-cased, runs of white space made one space. Null stays null."""
    return F.regexp_replace(F.lower(py_strip(text)), _RUN, " ")
