"""Quality rules whose cutoffs are certified to reject few good documents.

Every whole text is measured with built-in functions.  A rule rejects a
document when a share (symbols, upper-case letters, repeated lines, repeated
three-word windows) is above a cutoff.  Cutoffs are chosen for each stratum
(band of text length) from labelled documents: for a cutoff, of n good documents k
are rejected, and the exact binomial p-value of "the true false-rejection rate
is at least alpha" is P(Bin(n, alpha) <= k).  Cutoffs of a rule are tested from
the most lenient on and testing stops at the first that is not significant
(fixed sequence); the level is divided by the number of rules and strata
(Bonferroni).  Each rule gets an equal part of alpha, so that with probability
1 - delta, in every stratum at once, all rules together reject at most alpha of
the good documents.  The bound needs independent draws, so labelled documents with
the same text count once.  Of the certified cutoffs the one that parts bad from good
best is taken; where none is certified or helps, the rule is not used.

Edge cases: a null or empty text has no words and fails the base; documents
without label are judged like others; a null ``quality`` is no label, and of
several labels of one document the lowest counts; an empty table gives no rows.
Other columns can have any name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import scratch

SPACE = "[\\x20\\x09-\\x0D]"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
RULES = ["symbol_share", "upper_share", "dup_line_share", "repeat_share"]
CUTOFFS = [0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.12, 0.1, 0.08, 0.06, 0.05, 0.04, 0.03, 0.02]
#: Strata: bands of the number of words, by their lower ends.
BANDS = [0, 120, 350, 1200]
PLACE_BITS = 24


def measure(docs: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``row`` (a struct of ``columns``) with the base counts and the rules' shares of every whole text.

    Repeated windows are found by sorting a text's window hashes with their
    places: one array of longs holds the upper 40 bits of each hash above the
    window's place, so equal windows become neighbours.  Where two different
    windows share those bits, or a text has over 2^24 words, whole hashes are
    sorted instead.
    """
    place, high = (1 << PLACE_BITS) - 1, ~((1 << PLACE_BITS) - 1)
    text = F.coalesce(F.col("__text"), F.lit(""))
    df = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.col("text").alias("__text"))
    df = df.select(
        "row",
        F.xxhash64(text).alias("text_key"),
        F.array_remove(F.split(text, SPACE + "+"), "").alias("words"),
        (F.length(text) - F.regexp_count(text, F.lit(SPACE))).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count(text, F.lit("\\p{Lu}")).cast("long").alias("n_upper"),
        F.filter(F.split(text, "\n"), lambda line: line.rlike("[^\\x20\\x09-\\x0D]")).alias("lines"),
    )
    n = F.size("words")
    df = df.select(
        "row", "text_key", "word_chars", "n_symbols", "n_upper", n.cast("long").alias("n_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform(F.slice("words", F.lit(1), F.greatest(n - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2))).alias("grams"),
    )
    base = ["row", "text_key", "word_chars", "n_symbols", "n_upper", "n_words", "n_lines", "n_dup_lines"]
    packed = F.transform("grams", lambda h, i: h.bitwiseAND(F.lit(high)).bitwiseOR(i.cast("long")))
    df = df.select(*base, "grams", F.sort_array(packed).alias("keys"))

    def paired(keys: str, same) -> Column:
        return F.filter(keys, lambda x, k: F.coalesce(same(x, F.get(keys, k - 1)), F.lit(False)) | F.coalesce(same(x, F.get(keys, k + 1)), F.lit(False)))

    def same_bits(x: Column, y: Column) -> Column:
        return F.shiftright(x, PLACE_BITS) == F.shiftright(y, PLACE_BITS)

    df = df.select(*base, "grams", paired("keys", same_bits).alias("twins"))

    def at(x: Column) -> Column:
        return x.bitwiseAND(F.lit(place)).cast("int")

    def other(x: Column, k: Column) -> Column:
        y = F.get("twins", k - 1)
        return F.coalesce((k > 0) & same_bits(x, y) & (F.get("grams", at(x)) != F.get("grams", at(y))), F.lit(False))

    clash = F.size(F.filter("twins", other)) > 0
    whole = F.when(clash | (F.size("grams") > place), F.array_sort(F.transform("grams", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    df = df.select(*base, "twins", whole.alias("whole"))
    starts = F.when(F.col("whole").isNull(), F.transform("twins", at)).otherwise(
        F.transform(paired("whole", lambda x, y: x["h"] == y["h"]), lambda x: x["i"]))
    df = df.select(*base, F.sort_array(starts).alias("starts"))
    m = F.size("starts")
    steps = F.transform(F.slice("starts", F.lit(1), F.greatest(m - 1, F.lit(0))), lambda a, k: F.least(F.get("starts", k + 1) - a, F.lit(3)))
    covered = F.aggregate(steps, F.lit(0).cast("long"), lambda s, x: s + x) + F.when(m > 0, 3).otherwise(0)
    df = df.select(*base, covered.cast("long").alias("n_repeat_words"))

    def share(part: str, of: str) -> Column:
        return F.coalesce(F.col(part) / F.nullif(F.col(of), F.lit(0)), F.lit(0.0))

    band = sum((F.when(F.col("n_words") >= b, 1).otherwise(0) for b in BANDS[1:]), F.lit(0))
    return df.select(
        "row", "text_key", *BASE, band.alias("band"),
        share("n_symbols", "word_chars").alias("symbol_share"), share("n_upper", "word_chars").alias("upper_share"),
        share("n_dup_lines", "n_lines").alias("dup_line_share"), share("n_repeat_words", "n_words").alias("repeat_share"),
        ((F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).alias("base_failed"),
    )


def binomial_tail(n: Column, k: Column, rate: float) -> Column:
    """P(Bin(n, rate) <= k), exactly: its k + 1 terms are summed by logarithms; 1 where k is above the mean."""
    odds = F.log(F.lit(rate / (1 - rate)))
    start = n * F.log1p(F.lit(-rate))

    def step(s: Column, i: Column) -> Column:
        term = s["term"] + F.log((n - i + 1) / i) + odds
        top = F.greatest(s["total"], term)
        return F.struct(term.alias("term"), (top + F.log1p(F.exp(F.least(s["total"], term) - top))).alias("total"))

    terms = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    total = F.aggregate(terms, F.struct(start.alias("term"), start.alias("total")), step, lambda s: s["total"])
    return F.when(k > n * rate, F.lit(1.0)).otherwise(F.exp(total))


def certified_cutoffs(measured: DataFrame, labels: DataFrame, alpha: float, delta: float, doc_id: str = "doc_id") -> DataFrame:
    """A row for each stratum: ``band`` and a cutoff for each rule (null: the rule is not used)."""
    quality = labels.where(F.col("quality").isNotNull()).groupBy(F.col("doc_id").alias("__id")).agg(F.min("quality").alias("quality"))
    levels = [
        F.struct(F.lit(r).alias("rule"), sum((F.when(F.col(name) <= c, 1).otherwise(0) for c in CUTOFFS), F.lit(0)).alias("level"))
        for r, name in enumerate(RULES)
    ]
    held = (
        measured.where(~F.col("base_failed")).select(F.col("row")[doc_id].alias("__doc"), "band", "text_key", F.array(*levels).alias("levels"))
        .join(quality, F.col("__doc") == F.col("__id")).groupBy("band", "text_key").agg(F.min("quality").alias("quality"), F.any_value("levels").alias("levels"))
        .select("band", (F.col("quality") == 1).alias("good"), F.explode("levels").alias("l"))
        .groupBy("band", "l.rule", "l.level").agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"))
    )
    spark = measured.sparkSession
    grid = spark.range(len(BANDS) * len(RULES) * (len(CUTOFFS) + 1)).select(
        (F.col("id") % len(BANDS)).cast("int").alias("band"),
        (F.floor(F.col("id") / len(BANDS)) % len(RULES)).cast("int").alias("rule"),
        F.floor(F.col("id") / (len(BANDS) * len(RULES))).cast("int").alias("level"),
    )
    counts = grid.join(held, ["band", "rule", "level"], "left").fillna(0, ["good", "bad"])
    whole = Window.partitionBy("band", "rule")
    upto = whole.orderBy("level").rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.select(
        "band", "rule", "level",
        F.sum("good").over(whole).alias("n"), F.sum("good").over(upto).alias("k"),
        F.sum("bad").over(whole).alias("n_bad"), F.sum("bad").over(upto).alias("k_bad"),
    ).where(F.col("level") < len(CUTOFFS))
    each = alpha / len(RULES)
    tested = counts.withColumn("p", binomial_tail(F.col("n"), F.col("k"), each)).withColumn("worst", F.max("p").over(upto))
    gain = F.coalesce(F.col("k_bad") / F.nullif(F.col("n_bad"), F.lit(0)), F.lit(0.0)) - F.coalesce(F.col("k") / F.nullif(F.col("n"), F.lit(0)), F.lit(0.0))
    cutoff = F.get(F.array(*[F.lit(c) for c in CUTOFFS]), F.col("level"))
    useful = (F.col("worst") <= delta / (len(RULES) * len(BANDS))) & (F.col("gain") > 0)
    chosen = tested.withColumn("gain", gain).where(useful).groupBy("band", "rule").agg(F.max_by(cutoff, F.struct("gain", -F.col("level"))).alias("cutoff"))
    return chosen.groupBy("band").pivot("rule", list(range(len(RULES)))).agg(F.first("cutoff")).select("band", *[F.col(str(r)).alias(f"max_{name}") for r, name in enumerate(RULES)])


def judge(docs: DataFrame, labels: DataFrame, columns: Sequence[str], alpha: float = 0.04, delta: float = 0.05) -> DataFrame:
    """``row`` (a struct of ``columns``, ``doc_id`` among them), the base counts, ``base_failed`` and ``kept``.

    The texts are read once; the measures are a table.  The cutoffs are a row
    for each of the fixed strata, which bounds their broadcast.
    """
    measured = scratch.saved(measure(docs, columns), "quality-measures")
    cutoffs = certified_cutoffs(measured, labels, alpha, delta)
    passes = ~F.col("base_failed")
    for name in RULES:
        passes = passes & F.coalesce(F.col(name) <= F.col(f"max_{name}"), F.lit(True))
    return measured.join(F.broadcast(cutoffs), "band", "left").select("row", *BASE, "base_failed", passes.alias("kept"))
