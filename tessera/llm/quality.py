"""Quality classifier: a sparse ensemble of rules over text statistics.

Statistics are Spark columns over the whole text. On labelled rows, at most ``MOST_ROWS``
(those with the least id hashes; the bound is fixed), boosted trees of depth ``DEPTH`` are
grown; every path from a root to an inner or outer node is a rule, a conjunction of
comparisons. A logistic model with an L1 penalty (accelerated proximal gradient) weighs the
rules and drops most; those that are left are compiled back into one Spark column.

Defined cases: a null text counts as empty, and an empty one is scored like any other; of
repeated labels of one document the mean counts (1 from 0.5 on); null labels and null ids
teach nothing; without labels of both kinds all scores are the share of label 1 (0.5 with
no labels at all). Columns ``score`` and ``predicted`` of the input are replaced; no other name can clash.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_ROWS = 20_000
TREES, DEPTH, RATE, BINS, LEAST = 40, 3, 0.2, 32, 10
PENALTY, STEPS = 2e-3, 600
#: what is counted, by pattern
COUNTS = {
    "words": r"[^\x20\x09-\x0D]+",
    "upper": r"\p{Lu}",
    "digits": r"\p{N}",
    "symbols": r"[*%#$&@^~_=+<>\\]",
    "bars": r"[|]",
    "marks": r"[!?]",
    "stops": r"[.,;:]",
    "lines": r"\n",
    "stutter": r"(?<!\S)(\S++)(?= \1(?!\S))",
}
NAMES = ("log_chars", "log_words", "word_length", "upper", "digits", "symbols", "bars", "marks", "stops", "lines", "stutter")


def statistics(text: Column) -> Column:
    """A struct of the statistics ``NAMES`` of a text, all double and never null.

    What is counted is bound to a lambda's variable and used from there. As plain columns the
    counts would be put into every place that uses them, and matched again in each rule.
    """
    text = F.coalesce(text.cast("string"), F.lit(""))
    counted = F.struct(F.length(text).cast("double").alias("chars"), *(F.regexp_count(text, F.lit(p)).cast("double").alias(n) for n, p in COUNTS.items()))

    def made(r: Column) -> Column:
        chars, words = F.greatest(r["chars"], F.lit(1.0)), F.greatest(r["words"], F.lit(1.0))
        per_char, per_word = ("upper", "digits", "symbols", "bars", "marks", "stops"), ("lines", "stutter")
        shares = [(r[n] / chars).alias(n) for n in per_char] + [(r[n] / words).alias(n) for n in per_word]
        return F.struct(F.log1p(r["chars"]).alias("log_chars"), F.log1p(r["words"]).alias("log_words"), (r["chars"] / words).alias("word_length"), *shares)

    return F.element_at(F.transform(F.array(counted), made), 1)


Rule = tuple[tuple[int, bool, float], ...]  # (statistic, above, threshold), all of which hold


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, cuts: list[np.ndarray], rows: np.ndarray, path: Rule, depth: int, out: list, margins: np.ndarray) -> None:
    if path:
        out.append(path)
    best = (1e-6, None)
    if depth and len(rows) >= 2 * LEAST:
        total_g, total_h = g[rows].sum(), h[rows].sum()
        for f, c in enumerate(cuts):
            if not len(c):
                continue
            b = np.searchsorted(c, x[rows, f], "left")
            sg, sh, n = (np.bincount(b, w, len(c) + 1).cumsum()[:-1] for w in (g[rows], h[rows], None))
            gain = sg**2 / (sh + 1) + (total_g - sg) ** 2 / (total_h - sh + 1) - total_g**2 / (total_h + 1)
            gain[(n < LEAST) | (len(rows) - n < LEAST)] = -1
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], (f, float(c[k])))
    if best[1] is None:
        margins[rows] += RATE * -g[rows].sum() / (h[rows].sum() + 1)
        return
    f, t = best[1]
    above = x[rows, f] > t
    _grow(x, g, h, cuts, rows[~above], (*path, (f, False, t)), depth - 1, out, margins)
    _grow(x, g, h, cuts, rows[above], (*path, (f, True, t)), depth - 1, out, margins)


def _holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    return np.logical_and.reduce([(x[:, f] > t) == above for f, above, t in rule])


def _largest_eigenvalue(a: np.ndarray) -> float:
    """Of the Gram matrix of ``a`` and a column of ones, from above, by power steps: no second copy of ``a``."""
    v, top = np.ones(a.shape[1] + 1, dtype=np.float32), 1.0
    for _ in range(30):
        u = a @ v[1:] + v[0]
        v = np.concatenate([[u.sum()], u @ a]).astype(np.float32)
        top = float(np.linalg.norm(v))
        v /= np.float32(top)
    return 1.05 * top


@dataclass(frozen=True)
class RuleModel:
    bias: float
    rules: tuple[tuple[Rule, float], ...]

    def column(self, stat: Column) -> Column:
        """P(label 1) from a struct of the statistics."""

        def margin(s: Column) -> Column:
            total = F.lit(self.bias)
            for rule, weight in self.rules:
                tests = [(s[NAMES[f]] > t) if above else (s[NAMES[f]] <= t) for f, above, t in rule]
                total = total + F.when(reduce(Column.__and__, tests), F.lit(weight)).otherwise(F.lit(0.0))
            return total

        return F.lit(1.0) / (F.lit(1.0) + F.exp(-F.element_at(F.transform(F.array(stat), margin), 1)))


def fit_rules(x: np.ndarray, y: np.ndarray) -> RuleModel:
    if not len(y) or y.min() == y.max():
        p = float(np.clip(y.mean() if len(y) else 0.5, 1e-6, 1 - 1e-6))
        return RuleModel(float(np.log(p / (1 - p))), ())
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for c in x.T]
    margins, found = np.full(len(y), np.log(y.mean() / (1 - y.mean()))), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margins))
        _grow(x, p - y, p * (1 - p), cuts, np.arange(len(y)), (), DEPTH, found, margins)
    rules, seen = [], set()
    for rule in dict.fromkeys(found):
        held = _holds(rule, x)
        if 0 < held.sum() < len(y) and (key := held.tobytes()) not in seen:
            seen.add(key)
            rules.append((rule, held))
    if not rules:
        p = y.mean()
        return RuleModel(float(np.log(p / (1 - p))), ())
    a = np.empty((len(y), len(rules)), dtype=np.float32)
    for k, (_, held) in enumerate(rules):
        a[:, k] = held
    step = 4 * len(y) / _largest_eigenvalue(a)
    w, b = np.zeros(a.shape[1], dtype=np.float32), float(np.log(y.mean() / (1 - y.mean())))
    zw, zb, t = w.copy(), b, 1.0
    for _ in range(STEPS):
        r = 1 / (1 + np.exp(-((a @ zw).astype(np.float64) + zb))) - y
        nw = zw - step * (r.astype(np.float32) @ a) / len(y)
        nw = (np.sign(nw) * np.maximum(np.abs(nw) - step * PENALTY, 0)).astype(np.float32)
        nb = zb - step * r.mean()
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        zw, zb = (nw + (t - 1) / nt * (nw - w)).astype(np.float32), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    return RuleModel(float(b), tuple((rule, float(v)) for (rule, _), v in zip(rules, w, strict=True) if v))


def fit_quality(spark: SparkSession, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", *, learn: Column | None = None, most_rows: int = MOST_ROWS) -> RuleModel:
    """Fits on the labelled rows of ``docs`` for which ``learn`` (over ``id_col``) holds."""
    marks = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    marks = marks.where(learn) if learn is not None else marks
    marks = marks.groupBy(F.col(id_col).alias("id_")).agg((F.avg(label_col) >= 0.5).cast("double").alias("y_"))
    marks = marks.orderBy(F.xxhash64("id_"), "id_").limit(most_rows)
    texts = docs.select(F.col(id_col).alias("id_"), F.col(text_col).alias("text_")).join(F.broadcast(marks), "id_")  # at most most_rows pairs of numbers
    rows = texts.select("id_", "y_", statistics(F.col("text_")).alias("stat_")).collect()
    rows = sorted((r.id_, r.y_, tuple(r.stat_)) for r in rows)[:most_rows]  # rows of one id may repeat
    x = np.array([r[2] for r in rows], dtype=np.float64).reshape(len(rows), len(NAMES))
    return fit_rules(x, np.array([r[1] for r in rows], dtype=np.float64))


def scored(docs: DataFrame, model: RuleModel, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score`` and ``predicted``; columns of these names are replaced."""
    out = docs.withColumn("score", model.column(statistics(F.col(text_col))))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def fold(id_col: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(3))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of each document, from labels outside the held-out fold."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit_quality(spark, docs, labels, learn=fold() != 1)
    return scored(docs.select("doc_id", "text"), model).select("doc_id", F.coalesce(fold() == 1, F.lit(False)).alias("held_out"), "score", "predicted")
