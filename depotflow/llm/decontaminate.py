"""Benchmark decontamination by template windows, with Spark expressions only.

Texts become words of a template: numbers, names (capitalised inside a sentence) and units (after a number) turn into one
typed placeholder each, other words into lower case; punctuation and white space don't count. Windows of five template words
are hashed and hash-joined with those of the benchmark. A document is a candidate for an item if it holds at least 0.8 of the
item's different windows. Then the slots are checked: along the best alignment, equal values of the item must
stand for equal values of the document and different ones for different ones, type by type, so a question with other
numbers and names is caught while a chance fit of placeholders is not.

Nulls: null and empty texts match nothing, null ids are not reported. Items of fewer than five words are one window of
all their words, so only a text of just these words matches. Repeated rows and ids count once. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from depotflow.llm.common import stage, text_key
from depotflow.operators.bitmaps import without

WORDS, COVERAGE = 5, 0.8
NAME, UNIT, NUMBER = "\u0001", "\u0002", "0"
UNITS = (
    "kg|g|mg|lb|lbs|oz|tons?|tonnes?|km|m|cm|mm|mi|miles?|ft|feet|foot|inch(?:es)?|yards?|meters?|metres?|liters?|litres?|ml|l|gallons?|"
    "s|sec|seconds?|min|minutes?|h|hours?|days?|weeks?|months?|years?|dollars?|euros?|pounds?|cents?|usd|eur|gbp|percent|degrees?|mph|kmh|"
    "hz|khz|mhz|ghz|kb|mb|gb|tb|w|kw|kwh|v|a"
)
PUNCTUATION = "\t\n\r\f\u000b!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~ ¡¿«»“”‘’–—…€£"
# Benchmark windows up to this count are sent to every executor, as (hash, item); more are joined by shuffle.
BROADCAST_WINDOWS = 1_000_000


def marked_words(text: Column) -> Column:
    """The words of a text; names begin with NAME, units with UNIT, numbers with a digit."""
    text = F.regexp_replace(F.coalesce(text, F.lit("")), f"[{NAME}{UNIT}]", " ")
    text = F.regexp_replace(text, r"([\p{Ll}\p{N},;] )(\p{Lu})", f"$1{NAME}$2")
    text = F.regexp_replace(text, r"([0-9]) ?%", f"$1 {UNIT}percent")
    text = F.regexp_replace(text, rf"(?i)([0-9])[ -]?({UNITS})(?![\p{{L}}\p{{N}}])", f"$1 {UNIT}$2")
    spaced = F.translate(text, PUNCTUATION, " " * len(PUNCTUATION))
    return F.filter(F.split(F.lower(spaced), " "), lambda w: w != "")


def word_kind(word: Column) -> Column:
    """NAME, UNIT or NUMBER for a slot, null for other words."""
    return (
        F.when(word < UNIT, F.lit(NAME)).when(word < "\u0003", F.lit(UNIT)).when((word >= "0") & (word < ":"), F.lit(NUMBER))
    )


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, wherever the optimizer moves the expression."""
    return F.get(F.transform(F.array(value), body), 0)


def template_windows(text: Column) -> Column:
    """Hashes of all runs of WORDS (five) template words; a text of fewer words has one, of all its words."""

    def wider(left: Column, right: Column, by: int) -> Column:
        """Hash of a run from the hash of its beginning and of the rest, which starts `by` words later."""
        rest = F.slice(right, F.lit(by + 1), F.greatest(F.size(right) - by, F.lit(0)))
        return F.zip_with(left, rest, lambda a, b: F.xxhash64(a, b))

    def runs(one: Column) -> Column:
        # past the end of the text a run is shorter than its place says; only a text that is short as a whole keeps one
        whole = F.greatest(F.size(one) - (WORDS - 1), F.least(F.size(one), F.lit(1)))
        five = _let(wider(one, one, 1), lambda two: _let(wider(two, two, 2), lambda four: wider(four, one, 4)))
        return F.slice(five, F.lit(1), whole)

    return _let(F.transform(marked_words(text), lambda w: F.xxhash64(F.coalesce(word_kind(w), w))), runs)


def _slots(table: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    words = table.select(*keys, F.posexplode(marked_words(F.col(text_col))).alias("pos", "word"))
    return words.withColumn("kind", word_kind(F.col("word"))).filter("kind is not null")


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, coverage, n_slots, n_changed) of every document that holds an item, as it is or with other values."""
    items = benchmark.filter("item_id is not null")
    known = stage(items.select("item_id", F.posexplode(template_windows(F.col("text"))).alias("at", "window")))
    totals = known.groupBy("item_id").agg(F.count_distinct("window").alias("n_windows"))
    small = known.count() <= BROADCAST_WINDOWS
    sought = F.broadcast(known) if small else known
    texts = docs.filter("doc_id is not null").select("doc_id", F.col("text").alias("_t"))
    windows = texts.select("doc_id", F.posexplode(template_windows(F.col("_t"))).alias("pos", "window"))
    hits = stage(windows.join(sought, "window").select("doc_id", "item_id", "pos", "at", "window"))
    covered = hits.groupBy("doc_id", "item_id").agg(F.count_distinct("window").alias("n_found")).join(totals, "item_id")
    candidates = stage(
        covered.withColumn("coverage", F.col("n_found") / F.col("n_windows"))
        .filter(F.col("coverage") >= COVERAGE)
        .select("doc_id", "item_id", "coverage")
    )
    # the alignment with most windows; the earliest of equals
    shift = (F.col("pos") - F.col("at")).alias("shift")
    aligned = hits.groupBy("doc_id", "item_id", shift).agg(F.count("*").alias("n"))
    best = F.max_by("shift", F.struct("n", -F.col("shift")))
    placed = aligned.join(candidates, ["doc_id", "item_id"]).groupBy("doc_id", "item_id", "coverage").agg(best.alias("shift"))
    item_slots = _slots(benchmark.select("item_id", F.col("text").alias("_t")), ["item_id"], "_t").select(
        "item_id", F.col("pos").alias("at"), "kind", F.col("word").alias("was")
    )
    flagged = texts.join(candidates.select("doc_id").distinct(), "doc_id", "left_semi")
    doc_slots = _slots(flagged.distinct(), ["doc_id"], "_t").select("doc_id", "pos", "kind", F.col("word").alias("now"))
    pairs = (
        placed.join(item_slots, "item_id")
        .withColumn("pos", F.col("at") + F.col("shift"))
        .join(doc_slots, ["doc_id", "pos", "kind"])
        .groupBy("doc_id", "item_id", "kind", "was", "now")
        .agg(F.count("*").alias("n"))
    )
    per_was, per_now = (Window.partitionBy("doc_id", "item_id", "kind", c) for c in ("was", "now"))
    checked = pairs.withColumn("clash", (F.count("*").over(per_was) > 1) | (F.count("*").over(per_now) > 1))
    verdicts = checked.groupBy("doc_id", "item_id").agg(
        F.sum("n").alias("n_slots"),
        F.sum(F.when(F.col("was") != F.col("now"), F.col("n")).otherwise(0)).alias("n_changed"),
        F.max(F.col("clash") & (F.col("was") != F.col("now"))).alias("clash"),
    )
    return (
        placed.join(verdicts, ["doc_id", "item_id"], "left")
        .filter(~F.coalesce("clash", F.lit(False)))
        .select(
            "doc_id", "item_id", "coverage",
            F.coalesce("n_slots", F.lit(0)).alias("n_slots"), F.coalesce("n_changed", F.lit(0)).alias("n_changed"),
        )
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """`docs` without the rows whose text holds an item of the benchmark; ids have no say, so rows that share one or have none
    are judged singly."""
    texts = docs.select(text_key(F.col("text")).alias("doc_id"), "text")
    found = stage(contaminated(texts, benchmark).select("doc_id").distinct())
    return without(docs, text_key(F.col("text")), found)
