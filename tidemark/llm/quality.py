"""Quality rules with thresholds that adapt to language and source (operator 5).

Each metric of a document falls into a bucket of a relative-error quantile sketch: bucket b
holds values from GAMMA^(b-1) to GAMMA^b, zero has its own.  A sketch is its buckets' counts,
so sketches merge by adding counts, in any order and with the same result; they are made by
one pre-aggregated groupBy per language and source, and merged to those of each language and of
everything.  From each come fences: as far from the outer deciles as FACTORS say, or as Tukey's
fences (quartiles and their distance), whichever is wider, and for shares no lower than a floor.
A group's fences are weighed with those of its language, and these with those of everything,
by their numbers of documents against PRIOR, so a group of any size has its own and none jumps.
A document is kept if no metric lies beyond the fences of its group.  Documents that fail the
base rules are left out of the sketches.

Rows: a null text has no words and fails the base rules; null language or source is a group
of its own; repeated rows each give a row and each count in the sketches; texts of any length
are read whole; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

MIN_WORDS = 50
#: Percent of words in repeated windows above which a document fails.
MAX_REPEAT = 50
SYMBOLS = "#*$%&|<>"
#: Relative error of a quantile: (GAMMA - 1) / (GAMMA + 1), about one percent.
GAMMA = 1.02
#: Bucket of zero, and of anything smaller than GAMMA ** (ZERO + 1).
ZERO = -1000
#: Documents that the coarser sketch counts as beside a group's own.
PRIOR = 50
#: Times the distance of the quartiles that a fence stands off.
FENCE = 3.0
#: metric: (times the upper decile, least upper fence, times the lower decile or None for no lower fence)
FACTORS = {"word_length": (1.3, 0.0, 0.72), "symbol_ratio": (1.5, 0.03, None), "dup_line_ratio": (1.5, 0.3, None), "repeat_ratio": (1.5, 0.15, None)}
COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"
#: Fixed value: what stands between words (space, tab, line feed, vertical tab, form feed, carriage return).
BLANKS = " \t\n\x0b\x0c\r"


def repeated_words(words: list) -> int:
    """Words that lie in a 3-word window found at least twice."""
    n = len(words)
    if n < 4:
        return 0
    code: dict = {}
    c = np.fromiter((code.setdefault(w, len(code)) for w in words), dtype=np.int64, count=n)
    pair = c[:-1] * len(code) + c[1:]
    _, pair = np.unique(pair, return_inverse=True)
    window = pair[:-1] * n + pair[1:]
    order = np.argsort(window, kind="stable")
    same = np.diff(window[order]) == 0
    if not same.any():
        return 0
    twice = np.zeros(n - 2, dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(n, dtype=bool)
    for k in range(3):
        cover[k : n - 2 + k] |= twice
    return int(cover.sum())


def counts(text: str | None) -> tuple[int, ...]:
    """The numbers of COUNTS for one text."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    return (
        len(words),
        len(text) - sum(map(text.count, BLANKS)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
    )


def measure(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    names = [c.split(" ")[0] for c in COUNTS.split(", ")]

    def fn(part: pa.RecordBatch) -> dict:
        rows = [counts(t) for t in part.column(1).to_pylist()]
        return {"doc_id": part.column(0), "lang": part.column(2), "source": part.column(3)} | dict(zip(names, zip(*rows, strict=True), strict=True))

    narrow = df.select(df[id_col].cast("long").alias("id"), df[text_col].cast("string").alias("text"), df[lang_col].cast("string").alias("lang"), df[source_col].cast("string").alias("source"))
    return common.map_slices(narrow, fn, f"doc_id long, lang string, source string, {COUNTS}")


def metrics() -> dict:
    ratio = lambda a, b: F.coalesce(F.col(a) / F.when(F.col(b) > 0, F.col(b)), F.lit(0.0))
    return {
        "word_length": ratio("word_chars", "n_words"),
        "symbol_ratio": ratio("n_symbols", "word_chars"),
        "dup_line_ratio": ratio("n_dup_lines", "n_lines"),
        "repeat_ratio": ratio("n_repeat_words", "n_words"),
    }


def sketches(stats: DataFrame) -> DataFrame:
    """Bucket counts by (lang, source, metric)."""
    bucket = lambda x: F.when(x > 0, F.greatest(F.lit(ZERO), F.ceil(F.log(x) / math.log(GAMMA)))).otherwise(ZERO)
    each = F.array(*[F.struct(F.lit(k).alias("metric"), bucket(x).cast("int").alias("bucket")) for k, x in metrics().items()])
    return stats.where("not base_failed").select("lang", "source", F.inline(each)).groupBy("lang", "source", "metric", "bucket").agg(F.count("*").alias("n"))


def merge(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches of coarser groups, by adding counts."""
    return sketch.groupBy(*keys, "metric", "bucket").agg(F.sum("n").alias("n"))


def quantiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """Size, outer deciles and quartiles of each sketch; a sketch has a bounded number of buckets."""
    w = Window.partitionBy(*keys, "metric")
    upto = F.sum("n").over(w.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    ranked = sketch.withColumn("upto", upto).withColumn("total", F.sum("n").over(w))
    value = F.when(F.col("bucket") > ZERO, F.pow(F.lit(GAMMA), F.col("bucket") - 0.5)).otherwise(0.0)
    at = lambda q: F.min(F.when(F.col("upto") * 100 >= q * F.col("total"), value)).alias(f"q{q}")
    return ranked.groupBy(*keys, "metric").agg(F.first("total").alias("total"), *map(at, (10, 25, 75, 90)))


def fences(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each group: its size and the fences of each metric."""
    q = quantiles(sketch, keys)
    wide = [F.max("total").alias("total")]
    for m, (up, floor, down) in FACTORS.items():
        of = lambda c, m=m: F.max(F.when(F.col("metric") == m, F.col(c)))
        spread = (of("q75") - of("q25")) * FENCE
        wide.append(F.greatest(of("q75") + spread, of("q90") * up, F.lit(floor)).alias(f"{m}_most"))
        if down is not None:
            wide.append(F.least(of("q25") - spread, of("q10") * down).alias(f"{m}_least"))
    return q.groupBy(*keys).agg(*wide) if keys else q.agg(*wide)


LIMITS = [f"{m}_{side}" for m, (_, _, down) in FACTORS.items() for side in ("most", "least") if side == "most" or down is not None]


def blended(sketch: DataFrame) -> DataFrame:
    """(g_lang, g_source, fence): the fences of each group, weighed with the coarser ones."""
    named = lambda d, tag: d.withColumnsRenamed({c: f"{tag}_{c}" for c in [*LIMITS, "total", "lang"] if c in d.columns})
    own = fences(sketch, ["lang", "source"])
    lang, everything = named(fences(merge(sketch, ["lang"]), ["lang"]), "lang"), named(fences(merge(sketch, []), []), "all")  # the latter is one row
    both = own.join(lang, own["lang"].eqNullSafe(lang["lang_lang"])).join(F.broadcast(everything), F.lit(True))
    weighed = lambda n, a, b: (F.col(n) * F.col(a) + PRIOR * b) / (F.col(n) + PRIOR)
    fence = [weighed("total", c, weighed("lang_total", f"lang_{c}", F.col(f"all_{c}"))).alias(c) for c in LIMITS]
    return both.select(F.col("lang").alias("g_lang"), F.col("source").alias("g_source"), F.struct(*fence).alias("fence"))


def judge(df: DataFrame, **names: str) -> DataFrame:
    """Counts of every document, whether the base rules fail, and whether it is kept."""
    stats, _ = common.narrow(
        measure(df, **names).withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words")))
    )
    sketch, _ = common.narrow(sketches(stats))  # a row for each group and bucket
    # as many rows as groups: broadcast only if few, else split by skew
    chosen, groups = common.narrow(blended(sketch))
    joined = common.picked(stats, chosen, groups, stats["lang"].eqNullSafe(chosen["g_lang"]) & stats["source"].eqNullSafe(chosen["g_source"]), "left")
    within = F.lit(True)
    for m, x in metrics().items():
        within = within & (x <= F.col(f"fence.{m}_most"))
        if f"{m}_least" in LIMITS:
            within = within & (x >= F.col(f"fence.{m}_least"))
    kept = ~F.col("base_failed") & F.coalesce(within, F.lit(True))
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"))


def op5_quality(spark, sf_dir: str) -> DataFrame:
    """Quality verdict on every document."""
    return judge(common.table(spark, sf_dir, "documents"))
