"""Quality rules: fixed limits on each text, then robust multivariate outliers per language and source.

Every text gives a vector of transformed statistics. For each stratum (a language and source), and for all rows together,
the minimum-covariance-determinant estimate of centre and spread is sought from several deterministic starts by
concentration steps, each one aggregation over all rows. Of the starts the least determinant counts, and one step over the rows
within a chi-square limit reweights it. A stratum's estimate is drawn towards that of all rows as if PRIOR more rows had it,
so that small strata are judged too, and none changes its way of being judged at some size. A text whose squared
Mahalanobis distance is beyond a chi-square limit is rejected.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeloom.llm.common import batch_of, held

SPACES = " \t\n\r\x0b\x0c"
SYMBOLS = "#*$%&|<>"
UPPER = bytes(range(ord("A"), ord("Z") + 1))
COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_upper long, n_shouts long, n_stops long"

#: Transformed statistics: log word length, and roots of symbols, capitals, exclamation marks and stops against words or characters.
FEATURES = ("x_length", "x_symbols", "x_upper", "x_shouts", "x_stops")
#: Least spread of each, so that a statistic that is nearly constant in a stratum rejects no text for a trifle.
FLOORS = (0.05, 0.05, 0.02, 0.05, 0.05)


def chi_square_limit(tail: float) -> float:
    """The value that a chi-square variable of five degrees of freedom exceeds with probability tail."""
    above = lambda x: math.erfc(math.sqrt(x / 2)) + math.sqrt(2 * x / math.pi) * math.exp(-x / 2) * (1 + x / 3)
    low, high = 0.0, 1000.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if above(middle) > tail else (low, middle)
    return high


#: Share of a stratum that the estimate rests on, and what makes its covariance consistent for five normal variables.
KEPT_SHARE, CONSISTENCY = 0.75, 1.41
#: The same for the rows that the reweighted estimate rests on.
INNER_CONSISTENCY = 1.055
#: Concentration steps at most; a start ends sooner, when none of its strata's determinants falls by this share.
STEPS, STILL = 8, 0.01
STARTS = ("scales", "signs", "tanh")
#: Tail beyond which a row doesn't count for the reweighted estimate, and beyond which a text goes. The statistics have longer tails
#: than normal ones, so the second is far out.
INNER, OUTER = 0.025, 1.2e-11
REWEIGHT, CUTOFF = chi_square_limit(INNER), chi_square_limit(OUTER)
#: Rows by which a stratum's estimate is drawn towards that of all.
PRIOR = 50.0
#: Words by which the distance of a short text, whose shares are noisy, is shrunk.
SHORT = 40.0
#: The stratum of all rows.
ALL = "all"


def repeated_words(words: list[bytes], width: int = 5) -> int:
    """Words within windows of so many words that occur twice or more, first occurrences included."""
    n = len(words)
    if n <= width:
        return 0
    if n <= 50_000:
        grams: list = list(zip(*(words[i:] for i in range(width)), strict=False))
        if len(set(grams)) == len(grams):
            return 0
        seen: dict = {}
        for g in grams:
            seen[g] = seen.get(g, 0) + 1
        often = np.fromiter((seen[g] > 1 for g in grams), bool, len(grams))
    else:  # the same in bounded memory
        number: dict[bytes, int] = {}
        ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int32, n)
        windows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(ids, width)).view(f"V{4 * width}").ravel()
        _, which, times = np.unique(windows, return_inverse=True, return_counts=True)
        often = times[which] > 1
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, np.flatnonzero(often), 1)
    np.add.at(edges, np.flatnonzero(often) + width, -1)
    return int(np.count_nonzero(np.cumsum(edges[:-1])))


def counts_of(text: str) -> tuple[int, ...]:
    """The COUNTS of one text. Words are parted by ASCII white space only."""
    raw = text.encode()
    words, lines, dup = raw.split(), set(), 0
    for line in raw.split(b"\n"):
        if line in lines:
            dup += 1
        elif line.strip(b" \t\r\x0b\x0c"):
            lines.add(line)
    return (
        len(words),
        len(text) - sum(map(text.count, SPACES)),
        sum(map(text.count, SYMBOLS)),
        dup,
        repeated_words(words),
        len(raw) - len(raw.translate(None, UPPER)),
        raw.count(b"!"),
        raw.count(b".") + raw.count(b","),
    )


def with_features(rows: DataFrame) -> DataFrame:
    """Add base_failed and the FEATURES to rows that have the COUNTS."""
    words = F.col("n_words") + 1
    x = (
        F.log((F.col("word_chars") + 5) / words),
        F.sqrt(F.col("n_symbols") / words),
        F.sqrt(F.col("n_upper") / (F.col("word_chars") + 1)),
        F.sqrt(F.col("n_shouts") / words),
        F.sqrt(F.col("n_stops") / words),
    )
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return rows.withColumns({"base_failed": failed} | dict(zip(FEATURES, x, strict=True)))


def text_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, the COUNTS, base_failed and the FEATURES of every row of docs; null texts have no words."""
    schema = f"doc_id long, lang string, source string, {COUNTS}"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = (batch[c].to_pylist() for c in ("doc_id", "lang", "source", "text"))
            yield batch_of([(i, la, so, *counts_of(t or "")) for i, la, so, t in zip(*columns, strict=True)], schema)

    plain = docs.select(F.col("doc_id").cast("long"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")), F.col("text").cast("string"))
    return with_features(plain.mapInArrow(count, schema))


def distance() -> Column:
    """Squared Mahalanobis distance of the FEATURES under the columns mean and inverse."""
    p = len(FEATURES)
    off = [F.col(x) - F.col("mean")[i] for i, x in enumerate(FEATURES)]
    terms = [F.col("inverse")[i * p + j] * off[i] * off[j] * (1 if i == j else 2) for i in range(p) for j in range(i, p)]
    return sum(terms[1:], terms[0])


def stratum_of(lang: str = "lang", source: str = "source") -> Column:
    return F.concat_ws("\x1f", F.lit("pair"), lang, source)


def moments(rows: DataFrame, by: list[str]) -> DataFrame:
    """Number, sums and sums of products of the FEATURES by columns; partial sums are taken before the shuffle."""
    p = len(FEATURES)
    sums = [F.sum(x).alias(f"s{i}") for i, x in enumerate(FEATURES)]
    sums += [F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"s{i}_{j}") for i in range(p) for j in range(i, p)]
    return rows.groupBy(*by).agg(F.count("*").alias("n"), *sums)


def from_moments(near: pd.Series, factor: float) -> tuple[list[float], np.ndarray]:
    """Mean, and covariance times a factor and on the floors, of summed moments."""
    p, n = len(FEATURES), near["n"]
    mean = np.array([near[f"s{i}"] for i in range(p)]) / n
    spread = np.empty((p, p))
    for i in range(p):
        for j in range(i, p):
            spread[i, j] = spread[j, i] = near[f"s{i}_{j}"] / n - mean[i] * mean[j]
    return mean.tolist(), factor * spread + np.diag(np.square(FLOORS))


ESTIMATES = "stratum string, start string, n double, mean array<double>, spread array<double>, inverse array<double>, volume double"


def estimate(stratum: str, start: str, n: float, mean: list[float], spread: np.ndarray) -> pd.DataFrame:
    row = {"stratum": stratum, "start": start, "n": float(n), "mean": mean, "spread": spread.ravel().tolist(), "inverse": np.linalg.inv(spread).ravel().tolist(), "volume": np.linalg.slogdet(spread)[1]}
    return pd.DataFrame({k: [v] for k, v in row.items()})


def first_estimates(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """The starts of one stratum: median and scales; the same with the correlation of spatial signs; and with that of tanh of the standardised."""
    r, p, out = pdf.iloc[0], len(FEATURES), []
    scale = np.array(r["scale"])
    for start in STARTS:
        correlation = np.eye(p)
        if start != "scales":
            sums = np.array(r[start]).reshape(p, p)
            root = np.sqrt(np.maximum(np.diag(sums), 1e-12))
            correlation = 0.95 * sums / np.outer(root, root) + 0.05 * np.eye(p)
        out.append(estimate(key[0], start, r["n"], list(r["mean"]), correlation * np.outer(scale, scale)))
    return pd.concat(out)


def starts(rows: DataFrame) -> DataFrame:
    """ESTIMATES of every stratum and start."""
    p = len(FEATURES)
    quartiles = [F.percentile_approx(x, [0.25, 0.5, 0.75], 2000).alias(f"q{i}") for i, x in enumerate(FEATURES)]
    q = rows.groupBy("stratum").agg(*quartiles)
    scale = [F.sqrt(F.pow((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / 1.349, 2) + FLOORS[i] ** 2) for i in range(p)]
    middle = held(q.select("stratum", F.array(*(F.col(f"q{i}")[1] for i in range(p))).alias("mean"), F.array(*scale).alias("scale")), "mcd-middle")
    z = [(F.col(x) - F.col("mean")[i]) / F.col("scale")[i] for i, x in enumerate(FEATURES)]
    placed = rows.join(middle, "stratum").select("stratum", *(c.alias(f"z{i}") for i, c in enumerate(z)))
    norm = sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(1, p)), F.col("z0") * F.col("z0")) + 1e-9
    pairs = [(i, j) for i in range(p) for j in range(p)]
    sums = [F.sum(F.col(f"z{i}") * F.col(f"z{j}") / norm).alias(f"a{i}_{j}") for i, j in pairs if i <= j]
    sums += [F.sum(F.tanh(f"z{i}") * F.tanh(f"z{j}")).alias(f"b{i}_{j}") for i, j in pairs if i <= j]
    square = lambda name: F.array(*(F.col(f"{name}{min(i, j)}_{max(i, j)}") for i, j in pairs))
    summed = placed.groupBy("stratum").agg(F.count("*").cast("double").alias("n"), *sums).select("stratum", "n", square("a").alias("signs"), square("b").alias("tanh"))
    return summed.join(middle, "stratum").groupBy("stratum").applyInPandas(first_estimates, ESTIMATES)


def concentrate(key: tuple, bins: pd.DataFrame) -> pd.DataFrame:
    """From moments by distance bin, the estimate from the nearest KEPT_SHARE of one stratum's rows, those of the last bin all taken in."""
    bins = bins.sort_values("bin")
    need = np.searchsorted(np.cumsum(bins["n"].to_numpy()), KEPT_SHARE * bins["n"].sum()) + 1
    return estimate(*key, bins["n"].sum(), *from_moments(bins.iloc[:need].sum(numeric_only=True), CONSISTENCY))


def reweigh(key: tuple, sums: pd.DataFrame) -> pd.DataFrame:
    return estimate(*key, sums["rows"].iloc[0], *from_moments(sums.iloc[0], INNER_CONSISTENCY))


def fit(statistics: DataFrame, steps: int = STEPS) -> DataFrame:
    """ESTIMATES of each stratum, one row each, that of ALL among them, before they are drawn together; n is a stratum's rows.

    statistics must be cheap to reread. Rows are only ever aggregated, with partial sums before each shuffle, so a
    stratum that holds most rows costs no task more than another. Only whether any determinant fell reaches the driver.
    """
    rows = statistics.select(*FEATURES, F.explode(F.array(stratum_of(), F.lit(ALL))).alias("stratum"))
    now = held(starts(rows), "mcd-starts")
    best = now
    for step in range(steps):
        far = rows.join(now.select("stratum", "start", "mean", "inverse"), "stratum").withColumn("bin", F.floor(16 * F.log2(1 + distance())).cast("int"))
        now = held(moments(far, ["stratum", "start", "bin"]).groupBy("stratum", "start").applyInPandas(concentrate, ESTIMATES), f"mcd-{step}")
        if step:
            fell = now.join(best.select("stratum", "start", F.col("volume").alias("was")), ["stratum", "start"]).where(F.col("volume") < F.col("was") - STILL)
            if fell.isEmpty():
                break
        best = now
    least = best.groupBy("stratum").agg(F.min(F.struct("volume", "start", "mean", "inverse", "n")).alias("m")).select("stratum", "m.*")
    least = held(least, "mcd-least")
    inner = rows.join(least.select("stratum", "start", F.col("n").alias("rows"), "mean", "inverse"), "stratum").where(distance() <= F.lit(REWEIGHT))
    return held(moments(inner, ["stratum", "start", "rows"]).groupBy("stratum", "start").applyInPandas(reweigh, ESTIMATES), "mcd-reweighted")


def drawn_together(fitted: DataFrame) -> DataFrame:
    """stratum, mean, inverse: each stratum's estimate averaged with that of ALL, n rows' against PRIOR."""
    every = fitted.where(F.col("stratum") == ALL).first()  # one row of p * p numbers
    if every is None:
        return fitted.select("stratum", "mean", "inverse")
    mean, spread = np.array(every.mean), np.array(every.spread)

    def average(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = len(FEATURES)
        for pdf in batches:
            out = []
            for stratum, n, m, s in pdf.itertuples(index=False):
                own = n / (n + PRIOR)
                off = np.array(m) - mean
                both = own * np.array(s) + (1 - own) * (spread + own * np.outer(off, off).ravel())
                out.append((stratum, (mean + own * off).tolist(), np.linalg.inv(both.reshape(p, p)).ravel().tolist()))
            yield pd.DataFrame(out, columns=["stratum", "mean", "inverse"])

    return held(fitted.select("stratum", "n", "mean", "spread").mapInPandas(average, "stratum string, mean array<double>, inverse array<double>"), "mcd")


def verdict(distance_squared: Column) -> Column:
    """Kept, unless base_failed or the distance, shrunk for short texts, is beyond CUTOFF."""
    near = distance_squared * F.col("n_words") / (F.col("n_words") + SHORT) <= CUTOFF
    return ~F.col("base_failed") & F.coalesce(near, F.lit(True))


def judge(docs: DataFrame) -> DataFrame:
    """Counts and verdict of every row of docs: doc_id, n_words .. n_repeat_words, base_failed, kept, distance.

    A null text has no words and fails; a null lang or source counts as the empty one; repeated rows are judged each;
    doc_id is only carried. An empty table gives no rows.
    """
    statistics = held(text_statistics(docs), "text-statistics")
    judged = statistics.withColumn("stratum", stratum_of()).join(drawn_together(fit(statistics)), "stratum", "left").withColumn("distance", distance())
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", verdict(F.col("distance")).alias("kept"), "distance")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that the rules keep, with all their columns.

    The statistics are taken once for the estimates and again beside the texts, which so are never shuffled.
    """
    statistics = held(text_statistics(docs), "text-statistics")
    params = drawn_together(fit(statistics)).withColumnRenamed("stratum", "_stratum")
    names = [n.split()[0] for n in COUNTS.split(", ")]

    @F.pandas_udf(f"struct<{', '.join(n.replace(' ', ':') for n in COUNTS.split(', '))}>")
    def counts(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([counts_of(t or "") for t in texts], columns=names, dtype="int64")

    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")
    named = docs.select(whole, *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"_{c}") for c in ("lang", "source")), counts(F.col("text").cast("string")).alias("_c"))
    judged = named.select("_row", stratum_of("_lang", "_source").alias("_stratum"), "_c.*")
    good = with_features(judged).join(params, "_stratum", "left").where(verdict(distance()))
    return good.select("_row.*")
