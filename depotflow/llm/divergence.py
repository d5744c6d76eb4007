"""How far the sources of a language differ in their terms, from a frequent-pattern tree of term rows.

A term row is the list of (source, count) of all sources of a language that have the term, ordered by source. The tree of all rows has one
node for each prefix of a row and keeps how many rows run through it (its multiplicity). For sources g and h the divergence is the
sum of f(c_g, c_h) over all terms. Most counts are zero, so it starts from f(0, 0) for every term, and

    f(c_g, c_h) = f(0, 0) + [f(c_g, 0) - f(0, 0)] + [f(0, c_h) - f(0, 0)] + [f(c_g, c_h) - f(c_g, 0) - f(0, c_h) + f(0, 0)]

leaves one correction for each node and, for every two counts of a row, one for each node and ancestor. Rows that share a path share
nodes, and each such correction is computed once with its multiplicity. All arithmetic is on whole numbers.

Nulls: a null text, language or source is the empty string. Every (language, source) that occurs is a group, also without
terms; a language without kept terms has the value 0 for each pair. Equal values rank by item. Repeated rows count as
often as they occur. Other columns are not read. An empty table gives an empty result. A term row has at most one entry for each source
of its language; the result itself has a row for each pair of them.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from depotflow.llm.common import reach_package, stage, text_slices

LEAST_DOCS, TOP, SCALE, PRIOR = 10, 10, 1_000_000_000, 2
# Terms a task keeps before it hands its counts on.
HELD_TERMS = 200_000
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    """Runs of letters and characters beyond ASCII, A-Z as lower case; UTF-8 bytes beyond 127 belong to such characters only."""
    return text.translate(LETTERS).split()


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n: occurrences, docs: texts with the term) of (lang, source, text)."""
    reach_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def emit() -> Iterator[pa.RecordBatch]:
            for (lang, source), (often, held) in found.items():
                listed = list(often)
                names = [t.decode("utf-8", "replace") for t in listed]
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(x, pa.string()) for x in ([lang] * len(names), [source] * len(names), names)),
                     pa.array([often[t] for t in listed], pa.int64()), pa.array([held[t] for t in listed], pa.int64())],
                    ["lang", "source", "term", "n", "docs"],
                )
            found.clear()

        for groups, texts in text_slices(batches):
            for group, text in zip(groups.to_pylist(), texts):
                often, held = found.setdefault((group["lang"], group["source"]), (Counter(), Counter()))
                words = terms(text)
                often.update(words)
                held.update(set(words))
            if sum(len(often) for often, _ in found.values()) > HELD_TERMS:
                yield from emit()
        yield from emit()

    group = F.struct(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")]).alias("group")
    rows = docs.select(group, F.coalesce("text", F.lit("")).alias("text"))
    parts = rows.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def tree_nodes(rows: DataFrame) -> DataFrame:
    """(lang, path, m) of every node of the tree of (lang, path): how many rows have the path as their beginning."""
    paths = rows.groupBy("lang", "path").agg(F.count(F.lit(1)).alias("m"))
    prefixes = paths.select("lang", F.explode(F.transform(F.sequence(F.lit(1), F.size("path")), lambda k: F.slice("path", 1, k))).alias("path"), "m")
    return prefixes.groupBy("lang", "path").agg(F.sum("m").alias("m"))


def share(count: Column | str, total: Column | str, kept: Column | str) -> Column:
    """Smoothed share of a term in parts of SCALE, a whole number; decimals hold products that a long can't."""
    count, total, kept = (F.col(c) if isinstance(c, str) else c for c in (count, total, kept))
    over = (count.cast("decimal(19,0)") + PRIOR) * F.lit(SCALE).cast("decimal(10,0)")
    return 1 + F.call_function("div", over, F.greatest(total + PRIOR * kept, F.lit(1)).cast("decimal(19,0)"))


def gap(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)); shares never exceed SCALE + 1, so the square fits a long."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def divergences(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): for every group its distance to each other source of the language (part `pair`), and the
    terms it uses more than the language does, the `top` largest distances (part `term`)."""
    counts = stage(term_counts(docs))
    entry = F.struct("source", "n").alias("e")
    kept = stage(
        counts.select("lang", "term", "n", "docs", entry)
        .groupBy("lang", "term")
        .agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.sort_array(F.collect_list("e")).alias("path"))
        .filter(F.col("docs") >= least_docs)
        .select("lang", "term", "total", "path")
    )
    single = kept.select("lang", "term", "total", F.explode("path").alias("e")).select("lang", "term", "total", "e.*")
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("total").alias("lang_n"))
    held = single.groupBy("lang", "source").agg(F.sum("n").alias("own_n"))
    found = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    groups = stage(
        found.join(held, ["lang", "source"], "left").join(langs, "lang", "left")
        .select("lang", "source", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("own_n", "v", "lang_n")])
    )

    def side(name: str) -> DataFrame:
        return groups.select("lang", F.col("source").alias(name), F.col("own_n").alias(f"n_{name}"), "v" if name == "g" else F.lit(0).alias("_v"))

    def p(name: str, count: Column) -> Column:
        return share(count, f"n_{name}", "v")

    nodes = stage(tree_nodes(kept.select("lang", "path")))
    last = F.element_at("path", -1)
    both = side("g").join(side("h"), "lang").filter("g <> h")
    zero = F.lit(0).cast("long")
    neither = gap(p("g", zero), p("h", zero))
    base = both.filter("g < h").select("lang", "g", "h", (F.col("v") * neither).alias("value"))
    alone = nodes.groupBy("lang", last["source"].alias("g"), last["n"].alias("c_g")).agg(F.sum("m").alias("m"))
    alone = alone.join(both, ["lang", "g"]).select(
        "lang", F.least("g", "h").alias("g"), F.greatest("g", "h").alias("h"),
        (F.col("m") * (gap(p("g", F.col("c_g")), p("h", zero)) - neither)).alias("value"),
    )
    above = nodes.select("lang", last.alias("x"), F.explode(F.slice("path", 1, F.size("path") - 1)).alias("y"), "m")
    together = above.groupBy(
        "lang", F.col("y.source").alias("g"), F.col("y.n").alias("c_g"), F.col("x.source").alias("h"), F.col("x.n").alias("c_h")
    ).agg(F.sum("m").alias("m"))
    shared = gap(p("g", F.col("c_g")), p("h", F.col("c_h"))) - gap(p("g", F.col("c_g")), p("h", zero)) - gap(p("g", zero), p("h", F.col("c_h"))) + neither
    joined = together.join(both, ["lang", "g", "h"]).select("lang", "g", "h", (F.col("m") * shared).alias("value"))
    pairs = stage(base.unionAll(alone).unionAll(joined).groupBy("lang", "g", "h").agg(F.sum("value").alias("value")))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = F.row_number().over(order).alias("rank")
    forth = pairs.select("lang", F.col("g").alias("source"), F.col("h").alias("item"), "value")
    back = pairs.select("lang", F.col("h").alias("source"), F.col("g").alias("item"), "value")
    named = ["lang", "source", F.lit("pair").alias("part"), "item", "value", ranked]
    apart = forth.unionAll(back).select(*named)
    own = single.join(groups, ["lang", "source"]).withColumns({"p": share("n", "own_n", "v"), "q": share("total", "lang_n", "v")})
    own = own.filter("p > q").select("lang", "source", F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value"))
    strong = own.select("lang", "source", F.lit("term").alias("part"), "item", "value", ranked).filter(F.col("rank") <= top)
    return apart.unionAll(strong)
