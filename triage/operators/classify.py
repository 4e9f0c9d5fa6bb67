"""A3–A7 — signature matching, priority classification, confidence, excerpt.

Per log everything is one narrow projection: no shuffle, no Python.  One pass over a
text finds the places of all signatures (:func:`match_patterns`).  Regex flags
are computed in their own projection so Catalyst keeps each one evaluated once
(CollapseProject never duplicates a non-cheap expression).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..config import DEFAULT, TriageConfig
from ..functions.text import ci, first_line_matching, tail_lines

PLAIN = re.compile(r"[A-Za-z0-9][A-Za-z0-9 _.:\-]*")
CLASSIFICATION_FIELDS = ["error_type", "error_message", "matched_patterns", "confidence"]


def _flag(i: int) -> str:
    return f"_sig{i}"


def plain_alternatives(pattern: str) -> list[str] | None:
    """The alternatives of a signature made of letters, digits and a few signs alone; None for any other."""
    inner = pattern[1:-1] if pattern.startswith("(") and pattern.endswith(")") else pattern
    parts = inner.split("|")
    return parts if all(PLAIN.fullmatch(part) for part in parts) else None


def hits_pattern(alternatives: list[str]) -> str:
    """Zero-width at every place where an alternative begins, capturing as many characters as the longest has.

    The places are tested by their first character before anything else; an
    alternative that begins with another one needs no test of its own.
    """
    firsts = "".join(sorted({part[0].lower() for part in alternatives}))
    low = [part.lower() for part in alternatives]
    needed = [part for k, part in enumerate(alternatives) if not any(low[k].startswith(other) and (other != low[k] or j < k) for j, other in enumerate(low) if j != k)]
    longest = max(map(len, alternatives))
    return ci(f"(?=[{firsts}])(?={'|'.join(needed)})(?=([\\s\\S]{{0,{longest}}}))")


def match_patterns(df: DataFrame, text: str = "log_text", cfg: TriageConfig = DEFAULT) -> DataFrame:
    """A3: ``matched_patterns`` — names of the signatures found anywhere in the text,
    in configuration order.

    One pass finds the places where any alternative of any plain signature begins, and
    what stands there; which signatures they satisfy is told from these few
    characters, so overlaps count for each.  Other signatures, and all of them in
    ``strict`` mode, are searched one by one.
    """
    names = list(cfg.signatures)
    plain = {} if cfg.strict else {n: parts for n in names if (parts := plain_alternatives(cfg.signatures[n]))}
    found = df
    if len(plain) > 1:
        every = [part for parts in plain.values() for part in parts]
        found = df.withColumn("_hits", F.regexp_extract_all(F.col(text), F.lit(hits_pattern(every)), F.lit(1)))

    def flag(name: str) -> Column:
        pattern = ci(cfg.signatures[name], cfg.strict)
        if len(plain) > 1 and name in plain:
            return F.exists("_hits", lambda hit: hit.rlike(pattern))
        return F.col(text).rlike(pattern)

    flagged = found.select("*", *[flag(n).alias(_flag(i)) for i, n in enumerate(names)]).drop("_hits")
    return flagged.withColumn(
        "matched_patterns",
        F.filter(
            F.array(*[F.when(F.col(_flag(i)), F.lit(n)) for i, n in enumerate(names)]),
            lambda x: x.isNotNull(),
        ),
    )


def _error_type(cfg: TriageConfig) -> Column:
    names = list(cfg.signatures)
    by_priority = [
        F.when(F.col(_flag(names.index(p))), F.lit(p)) for p in cfg.priority if p in cfg.signatures
    ]
    return F.coalesce(*by_priority, F.get(F.col("matched_patterns"), 0), F.lit("Other"))


def classification_confidence(n_matches: Column) -> Column:
    """0.45 for no match, else min(0.9, 0.6 + 0.1·(k−1)) to 2 dp."""
    return F.when(n_matches == 0, F.lit(0.45)).otherwise(
        F.round(F.least(F.lit(0.9), F.lit(0.6) + F.lit(0.1) * (n_matches - 1)), 2)
    )


def classify(df: DataFrame, text: str = "log_text", cfg: TriageConfig = DEFAULT) -> DataFrame:
    """Adds ``error_type, error_message, matched_patterns, cls_confidence`` and
    the ``classification`` struct."""
    names = list(cfg.signatures)
    m = match_patterns(df, text, cfg).withColumn(
        "_exc", first_line_matching(F.col(text), C.EXCEPTION_LINE)
    )
    out = m.select(
        "*",
        _error_type(cfg).alias("error_type"),
        F.coalesce(F.col("_exc"), F.lit(C.NO_EXCEPTION_LINE)).alias("error_message"),
        classification_confidence(F.size("matched_patterns")).alias("cls_confidence"),
    ).drop("_exc", *[_flag(i) for i in range(len(names))])
    return out.withColumn(
        "classification",
        F.struct(
            "error_type",
            "error_message",
            "matched_patterns",
            F.col("cls_confidence").alias("confidence"),
        ),
    )


def with_tail(df: DataFrame, text: str = "log_text", n: int = C.MAX_LINES) -> DataFrame:
    """A2: keep the last ``n`` lines of ``text``."""
    return df.withColumn(text, tail_lines(F.col(text), n))


def with_excerpt(df: DataFrame, text: str = "log_text", chars: int = C.EXCERPT_CHARS) -> DataFrame:
    """``sample_excerpt`` — the first ``chars`` characters of the tail."""
    return df.withColumn("sample_excerpt", F.substring(F.col(text), 1, chars))


def parse_logs(df: DataFrame, text: str = "log_text", cfg: TriageConfig = DEFAULT) -> DataFrame:
    """Tail → classify → excerpt: ``log_path, summary, sample_excerpt`` (the parsed-log entity)."""
    c = with_excerpt(classify(with_tail(df, text, cfg.max_lines), text, cfg), text)
    return c.select("log_path", F.col("classification").alias("summary"), "sample_excerpt")
