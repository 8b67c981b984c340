"""Quality rules: fixed rules, then robust outliers by minimum-covariance-determinant estimates."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pixelseries.session import cut_lineage

from .common import let, spare, words

STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Smallest spread of each feature: differences below it are never called odd. With the last two, in a group
#: without any, a duplicate line per 20 words or a fifth of repeated words is odd on its own.
FLOORS = (0.5, 0.08, 0.08, 0.03, 0.06)
DIMENSIONS = len(FLOORS)
#: The share of a group's rows the estimate is made of, and its refinements.
CORE, STEPS = 0.75, 4
#: Groups with fewer rows are pooled: first by language, then all together.
LEAST_ROWS = 60
#: A large group's rows meet its estimate in this many parts, should the estimates be too many to be sent to every task.
SALTS = 16
#: A clean row is rejected with this chance if its features are normal.
TAIL = 1e-9


def chi_square(p: int, upper: float) -> float:
    """The value a chi-square variable of ``p`` degrees passes with chance ``upper`` (Wilson and Hilferty)."""
    return p * (1 - 2 / (9 * p) + NormalDist().inv_cdf(1 - upper) * (2 / (9 * p)) ** 0.5) ** 3


def _repeat_words(found: Column) -> Column:
    """Words in some three-word window that occurs twice or more.

    Sorted window hashes put equal ones side by side, so this takes n log n steps
    for n words; texts without a repeat stop after one set of hashes.
    """
    n = F.size(found)
    at = lambda w, i: F.get(w, i)
    windows = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(at(w, i), at(w, i + 1), at(w, i + 2)))

    def covered(starts: Column) -> Column:
        gap = lambda p, i: F.least(F.lit(3), F.coalesce(at(starts, i + 1), p + 3) - p)
        return F.aggregate(F.transform(starts, gap), F.lit(0), lambda total, x: total + x)

    def repeated(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        same = lambda s, x, i: x["h"].eqNullSafe(at(s, i - 1)["h"]) | x["h"].eqNullSafe(at(s, i + 1)["h"])
        starts = let(pairs, lambda s: F.transform(F.filter(s, lambda x, i: same(s, x, i)), lambda x: x["i"]))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(let(F.sort_array(starts), covered))

    return F.when(n < 3, 0).otherwise(let(windows(found), repeated))


def statistics(text: Column) -> Column:
    """The five statistics of a text as a struct of longs; all zero for a null text."""
    full = F.coalesce(text, F.lit(""))
    lines = let(F.filter(F.split(full, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")), lambda x: F.size(x) - F.size(F.array_distinct(x)))
    counts = let(words(text), lambda w: F.struct(F.size(w).alias("n"), F.length(F.array_join(w, "")).alias("c"), _repeat_words(w).alias("r")))
    values = let(counts, lambda c: F.struct(*(v.cast("long").alias(k) for k, v in zip(STATISTICS, (c["n"], c["c"], F.length(F.regexp_replace(full, r"[^#*$%&|<>]+", "")), lines, c["r"])))))
    return values


def base_failed(s: Column) -> Column:
    return (s["n_words"] < 50) | (100 * s["n_repeat_words"] > 50 * s["n_words"])


def features(s: Column) -> list[Column]:
    """The statistics on scales where most groups are near normal."""
    n = F.greatest(s["n_words"], F.lit(1)).cast("double")
    share = lambda c: F.sqrt(F.least(s[c] / n, F.lit(3.0)))
    return [F.log(n), F.log(F.greatest(s["word_chars"], F.lit(1)) / n), share("n_symbols"), share("n_dup_lines"), share("n_repeat_words")]


def _pair(i: int, j: int) -> str:
    return f"s{min(i, j)}{max(i, j)}"


PAIRS = [(i, j) for i in range(DIMENSIONS) for j in range(i, DIMENSIONS)]
MEANS = [f"m{i}" for i in range(DIMENSIONS)]
PRECISION = [f"p{i}{j}" for i, j in PAIRS]


def _inverted(groups: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, m*, p*, logdet`` from means ``m*`` and covariances ``s*``, with the floors added to the spread."""
    d, df = range(DIMENSIONS), groups
    df = df.withColumns({f"s{i}{i}": F.greatest(F.col(f"s{i}{i}"), F.lit(0.0)) + FLOORS[i] ** 2 for i in d})
    for j in d:  # a lower triangle whose product with its transpose is the covariance
        pivot = F.col(f"s{j}{j}") - sum((F.col(f"l{j}{k}") ** 2 for k in range(j)), F.lit(0.0))
        df = df.withColumn(f"l{j}{j}", F.sqrt(F.greatest(pivot, F.lit(FLOORS[j] ** 2 / 100))))
        df = df.withColumns({f"l{i}{j}": (F.col(_pair(i, j)) - sum((F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0))) / F.col(f"l{j}{j}") for i in d if i > j})
    for i in d:  # its inverse, row by row
        df = df.withColumns({f"v{i}{j}": (F.lit(1.0) if i == j else -sum((F.col(f"l{i}{k}") * F.col(f"v{k}{j}") for k in range(j, i)), F.lit(0.0))) / F.col(f"l{i}{i}") for j in range(i + 1)})
    precision = [sum((F.col(f"v{k}{i}") * F.col(f"v{k}{j}") for k in range(j, DIMENSIONS)), F.lit(0.0)).alias(f"p{i}{j}") for i, j in PAIRS]
    return df.select(*keys, *MEANS, *precision, sum((2 * F.log(F.col(f"l{i}{i}")) for i in d), F.lit(0.0)).alias("logdet"))


def _distance(x: list[Column], at=F.col) -> Column:
    """The squared Mahalanobis distance of features ``x`` by the columns of ``_inverted``."""
    off = [x[i] - at(f"m{i}") for i in range(DIMENSIONS)]
    return sum((at(f"p{i}{j}") * off[i] * off[j] * (1 if i == j else 2) for i, j in PAIRS), F.lit(0.0))


def _salted(estimates: DataFrame) -> DataFrame:
    """Estimates once per salt, as one small file: its size is what Spark decides by how to join it."""
    return cut_lineage(estimates.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).repartition(1))


def _moments(rows: DataFrame, keys: list[str]) -> DataFrame:
    x = [F.col(f"x{i}") for i in range(DIMENSIONS)]
    sums = [F.sum(v).alias(f"t{i}") for i, v in enumerate(x)] + [F.sum(x[i] * x[j]).alias(f"t{i}{j}") for i, j in PAIRS]
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *sums)


def _covariances(sums: DataFrame, keys: list[str]) -> DataFrame:
    mean = lambda i: F.col(f"t{i}") / F.col("n")
    return sums.select(*keys, *(mean(i).alias(f"m{i}") for i in range(DIMENSIONS)), *((F.col(f"t{i}{j}") / F.col("n") - mean(i) * mean(j)).alias(_pair(i, j)) for i, j in PAIRS))


def _starts(rows: DataFrame) -> DataFrame:
    """Two first estimates per group: median with median deviations, and the plain mean and covariance."""
    d = range(DIMENSIONS)
    medians = cut_lineage(rows.groupBy("fit").agg(*(F.percentile_approx(f"x{i}", 0.5, 1000).alias(f"m{i}") for i in d)))
    spreads = rows.join(_salted(medians), ["fit", "salt"]).groupBy("fit").agg(*(F.percentile_approx(F.abs(F.col(f"x{i}") - F.col(f"m{i}")), 0.5, 1000).alias(f"d{i}") for i in d))
    zero = [F.lit(0.0).alias(_pair(i, j)) for i, j in PAIRS if i < j]
    robust = medians.join(spreads, "fit").select("fit", F.lit(0).alias("start"), *MEANS, *((1.4826 * F.col(f"d{i}")).alias(f"r{i}") for i in d))
    robust = robust.select("fit", "start", *MEANS, *((F.col(f"r{i}") ** 2).alias(_pair(i, i)) for i in d), *zero)
    plain = _covariances(_moments(rows, ["fit"]), ["fit"]).withColumn("start", F.lit(1))
    return robust.unionByName(plain)


def _refined(rows: DataFrame, params: DataFrame) -> DataFrame:
    """The next estimates: moments of the nearest ``CORE`` of each group's rows.

    Rows are summed by group, start and a fine logarithmic bin of their distance;
    the nearest bins that hold the core are then added up. One pass, no sort, and
    a large group is spread over all tasks.
    """
    keys = ["fit", "start"]
    d2 = _distance([F.col(f"x{i}") for i in range(DIMENSIONS)])
    near = rows.join(_salted(params), ["fit", "salt"]).withColumn("bin", F.round(16 * F.log2(F.greatest(d2, F.lit(1e-6)))).cast("int"))
    bins = _moments(near, [*keys, "bin"])
    w = W.partitionBy(*keys)
    before = F.coalesce(F.sum("n").over(w.orderBy("bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    chosen = bins.withColumns({"before": before, "all": F.sum("n").over(w)}).filter(F.col("before") < CORE * F.col("all"))
    sums = chosen.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in ["n", *(f"t{i}" for i in range(DIMENSIONS)), *(f"t{i}{j}" for i, j in PAIRS)]))
    return _covariances(sums, keys)


def _fit_key(lang: Column, source: Column) -> Column:
    return F.to_json(F.struct(lang.alias("lang"), source.alias("source")), {"ignoreNullFields": "false"})


class Outliers:
    """Robust centre and spread per language and source; ``params`` has one row per pair."""

    def __init__(self, params: DataFrame):
        self.params = params

    def rejected(self, rows: DataFrame, lang: str, source: str, stats: str, out: str) -> DataFrame:
        """Add the column ``out``: whether the distance passes the limit."""
        named = self.params.select(*(F.col(c).alias(f"__quality_{c}") for c in self.params.columns))
        d2 = _distance(features(F.col(stats)), lambda c: F.col(f"__quality_{c}"))
        found = rows.join(named, F.col(lang).eqNullSafe(F.col("__quality_lang")) & F.col(source).eqNullSafe(F.col("__quality_source")), "left")
        return found.withColumn(out, F.coalesce(d2 > F.col("__quality_limit"), F.lit(False))).select(*rows.columns, out)


def fit_outliers(stats: DataFrame) -> Outliers:
    """Estimates from rows ``lang, source, stats`` that pass the fixed rules.

    Two starts per group are refined by concentration steps; the one with the
    smaller determinant stays. Its spread is scaled so that the median distance is
    that of normal features, but never below the estimate itself.
    """
    x = [v.alias(f"x{i}") for i, v in enumerate(features(F.col("stats")))]
    usable = stats.filter(~base_failed(F.col("stats"))).select("lang", "source", *x)
    counts = usable.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    lacking = F.col("n") < LEAST_ROWS
    rest = F.sum(F.when(lacking, F.col("n"))).over(W.partitionBy("lang"))
    fit = F.when(~lacking, _fit_key(F.col("lang"), F.col("source"))).when(rest >= LEAST_ROWS, F.concat(F.lit("rest "), F.to_json(F.struct("lang")))).otherwise("rest")
    pairs = cut_lineage(counts.withColumn("fit", fit).select("lang", "source", "fit").repartition(1))
    p = pairs.select(F.col("lang").alias("__lang"), F.col("source").alias("__source"), "fit")
    rows = usable.join(p, F.col("lang").eqNullSafe(F.col("__lang")) & F.col("source").eqNullSafe(F.col("__source"))).select("fit", F.pmod(F.xxhash64(*(f"x{i}" for i in range(DIMENSIONS))), F.lit(SALTS)).cast("int").alias("salt"), *(f"x{i}" for i in range(DIMENSIONS)))
    rows = cut_lineage(rows)

    keys = ["fit", "start"]
    params = cut_lineage(_inverted(_starts(rows), keys))
    for _ in range(STEPS):
        params = cut_lineage(_inverted(_refined(rows, params), keys))
    best = params.groupBy("fit").agg(F.min(F.struct("logdet", "start", *MEANS, *PRECISION)).alias("best")).select("fit", "best.*")
    best = cut_lineage(best.repartition(1))
    d2 = _distance([F.col(f"x{i}") for i in range(DIMENSIONS)])
    middle = rows.join(_salted(best), ["fit", "salt"]).groupBy("fit").agg(F.percentile_approx(d2, 0.5, 1000).alias("middle"))
    scale = F.greatest(F.col("middle") / chi_square(DIMENSIONS, 0.5), F.lit(1.0))
    limits = best.join(middle, "fit").withColumn("limit", scale * chi_square(DIMENSIONS, TAIL))
    return Outliers(cut_lineage(pairs.join(limits, "fit").select("lang", "source", *MEANS, *PRECISION, "limit").repartition(1)))


def assess(docs: DataFrame) -> DataFrame:
    """``doc_id``, the five statistics, ``base_failed`` and ``kept`` for every row.

    Null and blank texts have no words and fail the fixed rules. Null languages and
    sources are groups of their own. Groups without enough rows share an estimate.
    Repeated rows are judged one by one; other columns are ignored.
    """
    stats = cut_lineage(docs.select("doc_id", "lang", "source", statistics(F.col("text")).alias("stats")))
    judged = fit_outliers(stats).rejected(stats, "lang", "source", "stats", "odd")
    failed = base_failed(F.col("stats"))
    return judged.select("doc_id", "stats.*", failed.alias("base_failed"), (~failed & ~F.col("odd")).alias("kept"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns."""
    compact = cut_lineage(docs.select("lang", "source", statistics(F.col("text")).alias("stats")))
    stats, odd = spare(docs, "__quality_stats"), spare(docs, "__quality_odd")
    rows = docs.withColumn(stats, statistics(F.col("text")))
    judged = fit_outliers(compact).rejected(rows, "lang", "source", stats, odd)
    # One condition on both: on its own the first would work out the statistics once more.
    return judged.filter(F.when(base_failed(F.col(stats)), F.lit(False)).otherwise(~F.col(odd))).select(*docs.columns)
