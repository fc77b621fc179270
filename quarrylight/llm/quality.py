"""Quality rules: base counts of every text, then robust multivariate outliers.

Native: only DataFrame functions.  The texts are read once; what follows works on a table of counts.
For each language and source a minimum-covariance-determinant estimate is fitted to the transformed
statistics of the documents that pass the base rules.  From three starts (medians with quartile ranges,
and the scatter of hyperbolic tangents and of spatial signs about them) concentration steps take the mean
and covariance of the ``SUPPORT`` share of documents nearest to the estimate before.  After two steps the
start with the least determinant is kept, and steps go on until no group's determinant falls any more, by
more than ``TOLERANCE``.  Groups under
``MIN_GROUP`` documents use the estimate of their language, those of small languages the one of all
documents, which are fitted only where such groups exist; where that is small too, the base rules alone
decide.  Documents whose robust squared distance exceeds ``CUTOFF`` are rejected.

The estimate is regularised: to the consistent covariance a variance is added on the diagonal, and it is
the determinant of the sum that falls with each step.  For a statistic that is the same in nearly all
documents of a group must not make slight deviations outliers.  It is the mean, over the group, of what
a single symbol, repeated line or repeated window (``resolution``) changes in the square of the
statistic, and of the squared standard error of the mean length of words; never more than ``FLOOR`` squared.

Defined results: a null text has no words and fails the base rules; null languages or sources form
groups of their own; repeated rows give repeated results; an empty table gives no rows; texts are read
whole; other columns of the input play no part.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.llm.common import SPACE, Scratch, read, text_or_empty

STATS = ("x0", "x1", "x2", "x3")
#: The most that is added to the standard deviation of each statistic, beside the consistent covariance.
FLOOR = (0.0975, 0.0975, 0.146, 0.146)
SUPPORT = 0.75
#: The covariance of the nearest 75 % of a normal sample of 4 dimensions, times this, is consistent.
CONSISTENCY = 1.486
#: The 0.99999 quantile of chi-squared with 4 degrees of freedom.
CUTOFF = 28.47
#: Steps end when no logarithm of a determinant falls below its least one so far by more than this; they do within some ten.
#: It is above what the steps of 1 / LEVELS in the order of distances may change; C_STEPS bounds the steps in any case.
TOLERANCE = 1e-3
C_STEPS = 60
#: A table of groups of at most so many rows goes to all tasks; a larger one is joined by a shuffle.
GROUPS = 10_000
#: Distances are ordered by their logarithm in steps of 1 / LEVELS, so that quantiles keep some thousand counts.
LEVELS = 4000
MIN_GROUP = 60
MIN_WORDS = 50


def base_counts(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text, lang, source)`` to counts of words, symbols, repeated lines and windows."""
    text = F.col("text")
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), text_or_empty(text).alias("text"))
    d = d.select(
        "doc_id", "lang", "source",
        F.array_remove(F.split(text, f"[{SPACE}]+"), "").alias("words"),
        F.length(F.regexp_replace(text, "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.filter(F.split(text, "\n"), lambda s: s.rlike(f"[^{SPACE}]")).alias("lines"),
    )
    n = F.size("words")
    d = d.select(
        "doc_id", "lang", "source", "n_symbols", n.cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2))))
        .otherwise(F.array().cast("array<bigint>")).alias("windows"),
    )
    # windows found twice: neighbours in the order of (hash, position); most texts have none to sort
    repeated = F.size(F.array_distinct("windows")) < F.size("windows")
    d = d.withColumn("sorted", F.when(repeated, F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))).drop("windows")
    twice = F.filter("sorted", lambda e, i: (e["h"] == F.get("sorted", i - 1)["h"]) | (e["h"] == F.get("sorted", i + 1)["h"]))
    d = d.withColumn("at", F.array_sort(F.transform(twice, lambda e: e["i"]))).drop("sorted")
    # a window covers three words; the next repeated window may begin within them
    covered = F.aggregate(
        F.transform("at", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("at", i + 1) - p, F.lit(3)))), F.lit(0).cast("bigint"), lambda a, x: a + x)
    d = d.withColumn("n_repeat_words", covered).drop("at")
    return d.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def transformed(counts: DataFrame) -> DataFrame:
    """The statistic vectors, scaled so that clean texts vary by about as much in each."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    return counts.select(
        "*",
        F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n).alias("x0"),
        F.sqrt(F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1))).alias("x1"),
        F.sqrt(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))).alias("x2"),
        F.sqrt(F.col("n_repeat_words") / n).alias("x3"),
    )


def resolution() -> list[Column]:
    """Squares of the least changes of the statistics of a row of counts; words vary by about half their mean length."""
    n, chars, lines = (F.greatest(F.col(c), F.lit(1)) for c in ("n_words", "word_chars", "n_lines"))
    return [0.25 / n, 1 / chars, 1 / lines, 6 / n]


def _grid(x: Column) -> Column:
    # exact quantiles keep a count for each distinct value: on this grid those are a few thousand
    return F.round(x * 1000) / 1000


def _distance(rows: DataFrame) -> Column:
    """Squared distance by the Cholesky factor columns l00..l33 and the centre columns m0..m3."""
    y: list[Column] = []
    for i, x in enumerate(STATS):
        rest = F.col(x) - F.col(f"m{i}")
        for j in range(i):
            rest = rest - F.col(f"l{i}{j}") * y[j]
        y.append(rest / F.col(f"l{i}{i}"))
    return sum((v * v for v in y[1:]), y[0] * y[0])


def _factor(fits: DataFrame) -> DataFrame:
    """Adds the Cholesky factor of the covariance columns c00..c33, with the variances f0..f3 on the diagonal, and its log_det."""
    p = len(STATS)
    for j in range(p):
        diag = F.col(f"c{j}{j}") + F.col(f"f{j}")
        for k in range(j):
            diag = diag - F.col(f"l{j}{k}") * F.col(f"l{j}{k}")
        fits = fits.withColumn(f"l{j}{j}", F.sqrt(F.greatest(diag, F.col(f"f{j}") / 100)))
        for i in range(j + 1, p):
            off = F.col(f"c{i}{j}")
            for k in range(j):
                off = off - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            fits = fits.withColumn(f"l{i}{j}", off / F.col(f"l{j}{j}"))
    return fits.withColumn("log_det", 2 * sum((F.log(F.col(f"l{i}{i}")) for i in range(1, p)), F.log("l00")))


def _levels() -> Column:
    """Group keys of a row: its language and source, its language, all."""
    lang, source = F.col("lang"), F.col("source")
    return F.array(F.to_json(F.struct(F.lit(1).alias("level"), lang, source)), F.to_json(F.struct(F.lit(2).alias("level"), lang)), F.to_json(F.struct(F.lit(3).alias("level"))))


def _needed(rows: DataFrame, min_group: int) -> DataFrame:
    """Keys of the groups that are large enough and that a document uses."""
    sizes = rows.groupBy("lang", "source").agg(F.count("*").alias("n"))
    keys = _levels()
    langs = sizes.groupBy("lang").agg(F.sum("n").alias("n"), F.min("n").alias("least")).where(F.col("least") < min_group)
    every = langs.agg(F.min("n").alias("least")).where(F.col("least") < min_group)
    own = sizes.where(F.col("n") >= min_group).select(keys[0].alias("key"))
    return own.union(langs.where(F.col("n") >= min_group).select(F.to_json(F.struct(F.lit(2).alias("level"), "lang")).alias("key"))).union(every.select(F.to_json(F.struct(F.lit(3).alias("level"))).alias("key")))


def _moments(columns: Sequence[Column]) -> list[Column]:
    return [F.covar_pop(columns[i], columns[j]).alias(f"c{i}{j}") for i in range(len(columns)) for j in range(i + 1)]


def sent(groups: DataFrame) -> DataFrame:
    """A table of a row for each group, to be sent to all tasks if it is small."""
    return F.broadcast(groups) if groups.limit(GROUPS + 1).count() <= GROUPS else groups


def fit_groups(rows: DataFrame, keep: Scratch, steps: int = C_STEPS, min_group: int = MIN_GROUP, least: Sequence[Column] | None = None) -> DataFrame:
    """Estimates of all groups of ``min_group`` rows or more that are needed: key, n, centre, Cholesky factor and log_det.

    ``least`` has the squared resolution of each statistic; without it, FLOOR squared is added throughout.
    A group may hold any share of the rows: all joins are with tables of a row for each group, written
    first, so that they are sent to all tasks if they are few and the rows of a key can be split if not.
    """
    p = range(len(STATS))
    floors, order = [f"f{i}" for i in p], [(i, j) for i in p for j in range(i + 1)]
    least = [F.lit(x**2) for x in FLOOR] if least is None else least
    points = rows.select(F.explode(_levels()).alias("key"), *STATS, *(r.alias(f) for r, f in zip(least, floors)))
    points = points.join(sent(keep.keep(_needed(rows, min_group), "keys")), "key")
    bounds = [F.least(F.avg(f), F.lit(x**2)).alias(f) for f, x in zip(floors, FLOOR)]
    middle = points.groupBy("key").agg(F.count("*").alias("n"), *bounds, *(F.percentile(_grid(F.col(x)), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f"q{i}") for i, x in enumerate(STATS)))
    middle = middle.where(F.col("n") >= min_group)
    spread = [F.greatest((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / 1.349, F.sqrt(f"f{i}")).alias(f"s{i}") for i in p]
    middle = keep.keep(middle.select("key", "n", *floors, *(F.col(f"q{i}")[1].alias(f"m{i}") for i in p), *spread), "middle")
    scaled = points.select("key", *STATS).join(sent(middle), "key").select("key", *((F.col(x) - F.col(f"m{i}")) / F.col(f"s{i}") for i, x in enumerate(STATS))).toDF("key", *STATS)
    length = F.greatest(F.sqrt(sum((F.col(x) * F.col(x) for x in STATS[1:]), F.col("x0") * F.col("x0"))), F.lit(1e-12))
    plain = middle.select("key", F.lit(0).alias("start"), *(F.lit(float(i == j)).alias(f"c{i}{j}") for i, j in order))
    tanh = scaled.groupBy("key").agg(*_moments([F.tanh(x) for x in STATS])).withColumn("start", F.lit(1))
    signs = scaled.groupBy("key").agg(*_moments([len(STATS) * F.col(x) / length for x in STATS])).withColumn("start", F.lit(2))
    starts = plain.unionByName(tanh).unionByName(signs).join(middle, "key")
    starts = starts.select("key", "start", "n", *floors, *(f"m{i}" for i in p), *((F.col(f"c{i}{j}") * F.col(f"s{i}") * F.col(f"s{j}")).alias(f"c{i}{j}") for i, j in order))
    fits = keep.keep(_factor(starts).withColumn("least", F.lit(float("inf"))), "fit0")
    names = [c for c in fits.columns if c != "key"]
    for step in range(1, steps + 1):
        rated = points.drop(*floors).join(sent(fits), "key").select("key", "start", *STATS, F.log1p(_distance(points)).alias("d"))
        limit = rated.groupBy("key", "start").agg(F.percentile(F.ceil(F.col("d") * LEVELS) / LEVELS, SUPPORT).alias("limit"))
        limited = keep.keep(fits.join(limit, ["key", "start"]), f"limit{step}")
        near = points.drop(*floors).join(sent(limited), "key").where(F.log1p(_distance(points)) <= F.col("limit"))
        means = near.groupBy("key", "start").agg(F.first("n").alias("n"), *(F.first(f).alias(f) for f in floors), *(F.avg(x).alias(f"m{i}") for i, x in enumerate(STATS)), *_moments([F.col(x) for x in STATS]), F.first("least").alias("least"))
        fits = _factor(means.withColumns({f"c{i}{j}": CONSISTENCY * F.col(f"c{i}{j}") for i, j in order}))
        fits = fits.withColumn("falls", F.col("least") - F.col("log_det") > TOLERANCE).withColumn("least", F.least("least", "log_det"))
        if step == 2:
            fits = fits.groupBy("key").agg(F.min_by(F.struct(*names, "falls"), F.struct("log_det", "start")).alias("best")).select("key", "best.*")
        fits = keep.keep(fits, f"fit{step}")
        keep.drop(f"limit{step}")
        if step > 1 and not fits.where("falls").limit(1).count():
            break
    return fits.drop("least", "falls")


def judged(counts: DataFrame, keep: Scratch, cutoff: float = CUTOFF, **fit: int) -> DataFrame:
    """Adds ``distance`` (null where no estimate holds) and ``kept`` to base counts."""
    rows = transformed(counts)
    fits = fit_groups(rows.where(~F.col("base_failed")), keep, least=resolution(), **fit)
    keys = _levels()
    names = [f"{a}{i}" for a in ("m",) for i in range(len(STATS))] + [f"l{i}{j}" for i in range(len(STATS)) for j in range(i + 1)]
    out = rows.withColumn("k1", keys[0]).withColumn("k2", keys[1]).withColumn("k3", keys[2])
    for level in (1, 2, 3):
        side = fits.select(F.col("key").alias(f"k{level}"), F.struct(*names).alias(f"f{level}"))
        out = out.join(sent(side), f"k{level}", "left")
    out = out.select(*rows.columns, F.coalesce("f1", "f2", "f3").alias("f")).select(*rows.columns, "f.*")
    out = out.withColumn("distance", F.when(~F.col("base_failed"), _distance(out)))
    return out.withColumn("kept", ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= cutoff)).drop(*names)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    keep = Scratch(spark, "quality")
    counts = keep.keep(base_counts(read(spark, sf_dir, "documents")), "counts")
    out = judged(counts, keep)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")
