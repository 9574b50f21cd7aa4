"""Quality rules with thresholds that adapt to each language and source; DataFrame functions only.

A quantile sketch here is a histogram over logarithmic-linear buckets: whole
values below 64, then 32 buckets for each doubling, so a quantile is off by a
32nd at most. Its counts add up: sketches of parts, of sources and of
languages merge by summing, the sum is made before the shuffle, and the result
does not hang on how rows are dealt. Thresholds come from each group's sketch,
from its language's where the group is small, and from all documents' beyond.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadloom.llm.common import written

WHITE = r"[\x20\x09-\x0D]+"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

#: Metric: (whole-number value, side, least spread, number of spreads from the median that a document may lie away).
METRICS = {
    "symbol_share": ("10000 * n_symbols div word_chars", "upper", 60, 8),
    "long_words": ("100 * word_chars div n_words", "upper", 25, 8),
    "short_words": ("100 * word_chars div n_words", "lower", 25, 8),
    "repeat_share": ("1000 * n_repeat_words div n_words", "upper", 40, 8),
}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeated_words(words: Column) -> Column:
    """Number of words in 3-word windows that occur twice or more in the array, the first occurrences included.

    Texts whose windows' hashes all differ have none, which is told without
    building strings; the others compare the windows themselves, sorted.
    """
    last = F.size(words) - 3

    def exactly(_: Column) -> Column:
        keyed = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("k"), i.alias("i")))

        def twice(s: Column) -> Column:
            same = lambda x, j: F.coalesce(F.get(s, j).getField("k") == x.getField("k"), F.lit(False))
            hits = F.filter(s, lambda x, j: F.when(j > 0, same(x, F.greatest(j - 1, F.lit(0)))).otherwise(False) | same(x, j + 1))
            return F.sort_array(F.transform(hits, lambda x: x.getField("i")))

        def covered(starts: Column) -> Column:
            spans = F.transform(starts, lambda p, j: F.least(F.lit(3), F.coalesce(F.get(starts, j + 1) - p, F.lit(3))))
            return F.aggregate(spans, F.lit(0).cast("long"), lambda a, x: a + x)

        return let(let(F.sort_array(keyed), twice), covered)

    hashes = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    any_twice = let(hashes, lambda h: F.size(F.array_distinct(h)) < F.size(h))
    return F.when((last < 0) | ~any_twice, F.lit(0).cast("long")).otherwise(exactly(words))


def with_base_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and base_failed; null text is empty."""
    own = [f"`{c}`" for c in docs.columns if c not in (*BASE, "base_failed")]
    raw = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    cut = docs.select(
        *own,
        F.filter(F.split(raw, WHITE), lambda w: w != "").alias("_words"),
        F.filter(F.split(raw, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"),
        F.regexp_count(raw, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
    )
    counted = cut.select(
        *own,
        F.size("_words").cast("long").alias("n_words"),
        F.char_length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        "n_symbols",
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("_words")).alias("n_repeat_words"),
    )
    return counted.withColumn("base_failed", F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words"))


def bucket(value: Column) -> Column:
    """The least value of the bucket that a whole number of 0 or more falls in."""
    drop = F.greatest(F.length(F.bin(value)) - 6, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, drop), drop)


def sketches(counted: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """Counts by language, source, metric and bucket of all documents that have a word; null languages and sources count as empty."""
    values = F.array(*[F.struct(F.lit(k).alias("metric"), F.expr(v[0]).alias("value")) for k, v in METRICS.items()])
    of = counted.where("n_words > 0").select(F.coalesce(lang, F.lit("")).alias("_lang"), F.coalesce(source, F.lit("")).alias("_source"), F.explode(values).alias("m"))
    return of.groupBy("_lang", "_source", F.col("m.metric").alias("metric"), bucket(F.col("m.value")).alias("bucket")).agg(F.count("*").alias("n"))


def thresholds(sketch: DataFrame, min_rows: int = 200) -> DataFrame:
    """_lang, _source and a bound for each metric, from the merged sketch of the smallest group that has `min_rows` documents.

    The levels are the language and source, the language, and all. A bound is
    the median and so many spreads, a spread being the distance from the
    median to the quartile on the other side (which junk on this side cannot
    widen), or the metric's least spread if that is more.
    """
    levels = []
    for depth, keys in enumerate((["_lang", "_source"], ["_lang"], [])):
        merged = sketch.groupBy(*keys, "metric", "bucket").agg(F.sum("n").alias("n"))
        group = Window.partitionBy(*keys, "metric")
        up = group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        ranked = merged.select(*keys, "metric", "bucket", F.sum("n").over(up).alias("upto"), F.sum("n").over(group).alias("rows"))
        at = lambda k: F.min(F.when(F.col("upto") * 4 >= F.col("rows") * k, F.col("bucket")))
        levels.append(ranked.groupBy(*keys, "metric").agg(F.first("rows").alias(f"rows{depth}"), F.struct(at(1).alias("q1"), at(2).alias("q2"), at(3).alias("q3")).alias(f"q_{depth}")))
    groups = sketch.select("_lang", "_source", "metric").distinct()
    joined = groups.join(levels[0], ["_lang", "_source", "metric"]).join(levels[1], ["_lang", "metric"]).join(levels[2], ["metric"])
    q = F.when(F.col("rows0") >= min_rows, F.col("q_0")).when(F.col("rows1") >= min_rows, F.col("q_1")).otherwise(F.col("q_2"))
    bound = F.lit(None).cast("long")
    for name, (_, side, least, times) in METRICS.items():
        q1, q2, q3 = (q.getField(x) for x in ("q1", "q2", "q3"))
        one = q2 + times * F.greatest(q2 - q1, F.lit(least)) if side == "upper" else q2 - times * F.greatest(q3 - q2, F.lit(least))
        bound = F.when(F.col("metric") == name, one).otherwise(bound)
    return joined.select("_lang", "_source", "metric", bound.alias("bound")).groupBy("_lang", "_source").pivot("metric", list(METRICS)).agg(F.first("bound"))


def judge_quality(docs: DataFrame, carry: list[str], lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """The columns `carry` of every row of `docs`, its base counts, base_failed and kept.

    kept is false where base_failed, else whether all metrics are within the
    bounds of the row's language and source. Null text is empty, so it fails;
    repeated rows are each judged; an empty table stays empty.
    """
    cols = list(dict.fromkeys([*carry, lang, source]))
    counted = written(with_base_counts(docs.select(*dict.fromkeys([*cols, text])), text).select(*[f"`{c}`" for c in cols], *BASE, "base_failed"), "quality")
    bounds = written(thresholds(sketches(counted, lang, source)), "thresholds")
    joined = counted.withColumn("_lang", F.coalesce(lang, F.lit(""))).withColumn("_source", F.coalesce(source, F.lit(""))).join(bounds, ["_lang", "_source"], "left")
    good = F.expr("NOT base_failed")
    for name, (value, side, *_) in METRICS.items():
        inside = F.expr(f"CASE WHEN n_words > 0 THEN ({value}) {'<=' if side == 'upper' else '>='} {name} ELSE false END")
        good = good & F.coalesce(inside, F.lit(True))
    return joined.select(*[f"`{c}`" for c in carry], *BASE, "base_failed", good.alias("kept"))
