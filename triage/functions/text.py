"""Column expressions over log text.

All helpers return ``Column`` built from Spark built-ins (JVM-side, inside
whole-stage codegen).  Regexes use Java syntax with ``(?U)`` so ``\\w``, ``\\s``,
``\\d`` and case folding are Unicode-aware like Python's ``re`` (SURVEY Q2).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config as C

# Characters at which Python's str.splitlines() breaks a line, after \r\n and \r
# have been normalised to \n.  Java regex char-class syntax.
LINE_BREAKS = r"\n\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"
# Python str.strip() whitespace = Java (?U)\s plus \x1c-\x1f.
_STRIP = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z"


#: Short alternatives that also occur inside other words.
SHORT_WORDS = ("OOM", "Auth", "403")


def ci(pattern: str, strict: bool = False) -> str:
    """Case-insensitive, Unicode-aware Java form of a Python ``re.I`` pattern.

    ``strict`` asks for whole words of the short alternatives only.
    """
    if strict:
        pattern = "|".join(rf"\b{p}\b" if p in SHORT_WORDS else p for p in pattern.split("|"))
    return "(?iU)" + pattern


def normalize_newlines(text: Column) -> Column:
    """Universal-newline translation: ``\\r\\n`` and ``\\r`` become ``\\n``."""
    return F.regexp_replace(text, r"\r\n?", "\n")


def decode_text(raw: Column) -> Column:
    """Replace invalid UTF-8 sequences, as a reader with ``errors='replace'`` does."""
    return F.make_valid_utf8(raw)


def tail_lines(text: Column, n: int = C.MAX_LINES) -> Column:
    """Last ``n`` lines of ``text`` (newlines kept), without splitting into an array.

    ``substring_index`` with a negative count scans back from the end, so the cost
    is proportional to the tail, not the whole text.  A text ending in ``\\n`` has
    one more separator than lines (SURVEY Q12).
    """
    if n <= 0:
        return F.lit("")
    return F.when(F.endswith(text, F.lit("\n")), F.substring_index(text, "\n", -(n + 1))).otherwise(
        F.substring_index(text, "\n", -n)
    )


def line_count(text: Column) -> Column:
    """Number of lines as ``readlines`` counts them (a final partial line counts)."""
    nl = F.length(text) - F.length(F.regexp_replace(text, "\n", ""))
    return F.when(F.length(text) == 0, F.lit(0)).otherwise(
        nl + F.when(F.endswith(text, F.lit("\n")), 0).otherwise(1)
    )


def py_strip(s: Column) -> Column:
    return F.regexp_replace(s, _STRIP, "")


def _line_anchor() -> str:
    return rf"(?:^|(?<=[{LINE_BREAKS}]))"


def first_line_matching(text: Column, pattern: str) -> Column:
    """First line (splitlines semantics) containing ``pattern``, stripped; NULL if none.

    One regex scan anchored at line starts; no line array is materialised.
    """
    lb = LINE_BREAKS
    rx = rf"(?iU){_line_anchor()}([^{lb}]*?(?:{pattern})[^{lb}]*)"
    hit = F.regexp_extract(text, rx, 1)
    return F.when(hit != "", py_strip(hit))


def first_line_context(text: Column, pattern: str, before: int = 2, after: int = 2) -> Column:
    """The first matching line with up to ``before``/``after`` neighbouring lines,
    joined by ``\\n``; NULL if no line matches.

    The lazy prefix makes the match start ``before`` lines above the *first*
    matching line; a trailing line break does not open a new line.
    """
    lb = LINE_BREAKS
    rx = (
        rf"(?iU){_line_anchor()}("
        rf"(?:[^{lb}]*[{lb}]){{0,{before}}}?"
        rf"[^{lb}]*?(?:{pattern})[^{lb}]*"
        rf"(?:[{lb}](?!\z)[^{lb}]*){{0,{after}}})"
    )
    hit = F.regexp_extract(text, rx, 1)
    return F.when(hit != "", F.regexp_replace(hit, rf"[{lb}]", "\n"))


def extract_group(text: Column, pattern: str, idx: int = 1) -> Column:
    """``re.search(pattern).group(idx)`` or NULL."""
    hit = F.regexp_extract(text, pattern, idx)
    return F.when(hit != "", hit)


def extract_bigint(text: Column, pattern: str, idx: int = 1) -> Column:
    """First match converted to BIGINT; NULL if absent or out of range."""
    return F.regexp_extract(text, pattern, idx).try_cast("bigint")


def py_list_repr(arr: Column) -> Column:
    """Python ``repr`` of a list of strings: ``['a', 'b']``.

    Backslash, quote and the common control characters are escaped the way
    Python does; a string holding ``'`` but no ``"`` is shown in double quotes.
    """

    def one(x: Column) -> Column:
        esc = F.regexp_replace(x, r"\\", r"\\\\")
        esc = F.regexp_replace(esc, "\n", r"\\n")
        esc = F.regexp_replace(esc, "\r", r"\\r")
        esc = F.regexp_replace(esc, "\t", r"\\t")
        dq = esc.contains("'") & ~esc.contains('"')
        return F.when(dq, F.concat(F.lit('"'), esc, F.lit('"'))).otherwise(
            F.concat(F.lit("'"), F.regexp_replace(esc, "'", r"\\'"), F.lit("'"))
        )

    return F.concat(F.lit("["), F.array_join(F.transform(arr, one), ", "), F.lit("]"))


def split_strip(s: Column, chars: str = C.COLUMN_STRIP_CHARS) -> Column:
    """``[c.strip(chars) for c in s.split(',')]``."""
    return F.transform(F.split(s, ",", -1), lambda c: F.trim(c, F.lit(chars)))


def compact_array(*items: Column) -> Column:
    """Array of the non-NULL items, in order (conditional evidence lists)."""
    return F.filter(F.array(*items), lambda x: x.isNotNull())
