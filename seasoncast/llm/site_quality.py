"""Document quality by hierarchical empirical Bayes: what the text says and where it comes from.

A logistic model gives each document evidence for or against good quality. Its probabilities are
summed by path and by host. A host's rate is shrunk toward the rate of all documents, a path's
toward its host's, each by as many pseudo-documents as the spread between sites calls for, so a
sparse site keeps near its parent. The posterior adds a document's evidence to the log odds of its
path, from which the document itself is left out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seasoncast.llm.common import hash_sample
from seasoncast.sources.shared import cut_lineage

#: Labelled rows, about, that the logistic model is fitted on at most; chosen by a hash of doc_id.
LABELLED_ROWS = 20_000
#: Copies of the site table over which the documents of a hot site are spread.
SALTS = 16
_SYMBOLS = "!#$%&*+/<=>@\\^_`|~{}[]"
#: Bounds of the pseudo-documents, and of a rate before its log odds are taken.
_STRENGTH, _RATE = (1.0, 1e6), 1e-6
_OWN = ("evidence", "host_rate", "path_rate", "quality", "kept")


def features(text: Column) -> Column:
    """Shares that need no vocabulary, ``array<double>``; null counts as empty."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    chars = F.greatest(F.length(text), F.lit(1))
    words = F.filter(F.split(text, r"[ \t\n\r]+"), lambda w: w != "")
    lines = F.split(text, "\n")
    n_words = F.greatest(F.size(words), F.lit(1))
    plain = F.translate(text, _SYMBOLS, "")
    small = F.regexp_replace(text, r"\p{Lu}+", "")
    values = [
        F.log1p(F.size(words).cast("double")),
        (F.length(text) - F.length(plain)) / chars,
        (F.length(text) - F.length(small)) / chars,
        F.size(F.array_distinct(words)) / n_words,
        F.size(F.array_distinct(lines)) / F.size(lines),
        chars / n_words / 10,
        (F.length(text) - F.length(F.replace(text, F.lit("."), F.lit("")))) / n_words,
    ]
    return F.array(*[v.cast("double") for v in values])


@dataclass(frozen=True)
class Logistic:
    """Weights for standardised features and their squares; ``prior`` is the fitted rows' log odds."""

    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]
    bias: float
    prior: float

    @staticmethod
    def _expand(x: np.ndarray) -> np.ndarray:
        x = np.clip(x, -8, 8)
        return np.hstack([x, x * x])

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 50) -> Logistic:
        """Newton steps on the penalised likelihood."""
        mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
        design = np.hstack([cls._expand((x - mean) / scale), np.ones((len(x), 1))])
        penalty = np.full(design.shape[1], ridge)
        penalty[-1] = 1e-6
        w = np.zeros(design.shape[1])
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
            slope = design.T @ (y - p) - penalty * w
            curve = (design * (p * (1 - p))[:, None]).T @ design + np.diag(penalty)
            step = np.linalg.solve(curve, slope)
            w += step
            if np.abs(step).max() < 1e-9:
                break
        rate = np.clip(y.mean(), _RATE, 1 - _RATE)
        return cls(tuple(mean), tuple(scale), tuple(w[:-1]), float(w[-1]), float(np.log(rate / (1 - rate))))

    def evidence(self, x: Column) -> Column:
        """Log likelihood ratio of good against bad."""
        total, n = F.lit(self.bias - self.prior), len(self.mean)
        for i in range(n):
            z = F.greatest(F.least((x[i] - self.mean[i]) / self.scale[i], F.lit(8.0)), F.lit(-8.0))
            total = total + z * self.weights[i] + z * z * self.weights[n + i]
        return total


def fit_classifier(measured: DataFrame, labels: DataFrame, target: str = "quality") -> Logistic | None:
    """From ``doc_id, x`` and ``doc_id, target`` (0 or 1); None if one class is missing."""
    labelled = cut_lineage(
        labels.filter(F.col(target).isin(0, 1))
        .select("doc_id", F.col(target).cast("double").alias("_y"))
        .join(measured.select("doc_id", "x"), "doc_id")
    )
    rows = sorted(hash_sample(labelled, ["doc_id"], LABELLED_ROWS).collect())
    y = np.array([r["_y"] for r in rows])
    if len(set(y)) < 2:
        return None
    return Logistic.fit(np.array([r["x"] for r in rows]), y)


def _strength(parts: DataFrame, rate: Column, size: Column) -> float:
    """Pseudo-documents of a Beta prior from the spread of the rates of ``parts`` around ``rate``,
    less what sampling alone would give."""
    noise = rate * (1 - rate)
    row = parts.agg(
        F.sum(size * (F.col("good") / size - rate) ** 2 - noise).alias("excess"),
        F.sum(size - 1).alias("weight"),
        F.sum(noise).alias("noise"),
        F.count("*").alias("many"),
    ).first()
    if not row["many"] or not row["weight"] or row["excess"] is None or row["excess"] <= 0:
        return _STRENGTH[1]
    between = row["excess"] / row["weight"]
    within = row["noise"] / row["many"]
    return float(np.clip(within / between - 1, *_STRENGTH))


def _log_odds(rate: Column) -> Column:
    held = F.greatest(F.least(rate, F.lit(1 - _RATE)), F.lit(_RATE))
    return F.log(held / (1 - held))


def site_posteriors(
    scored: DataFrame,
) -> tuple[DataFrame, float, float, float]:
    """Sums by path with those of the host, the rate of all documents, and the two strengths.

    ``scored`` has ``host, path, p``; columns of the result: ``host, path, n, good, host_n, host_good``.
    """
    paths = cut_lineage(
        scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("good"))
    )
    hosts = cut_lineage(
        paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("good").alias("host_good"))
    )
    total = hosts.agg(F.sum("host_n").alias("n"), F.sum("host_good").alias("good")).first()
    rate = total["good"] / total["n"] if total["n"] else 0.5
    among_hosts = _strength(
        hosts.select(F.col("host_n").alias("n"), F.col("host_good").alias("good")),
        F.lit(rate),
        F.col("n"),
    )
    both = cut_lineage(paths.join(hosts, "host"))
    host_rate = (F.col("host_good") + among_hosts * rate) / (F.col("host_n") + among_hosts)
    among_paths = _strength(both, host_rate, F.col("n"))
    return both, rate, among_hosts, among_paths


def score_quality(
    docs: DataFrame,
    labels: DataFrame,
    host: Column | None = None,
    path: Column | None = None,
    least: float = 0.5,
) -> DataFrame:
    """``docs`` with ``evidence, host_rate, path_rate, quality, kept``.

    The host is ``source``, the path is ``source`` and ``lang``, unless given. ``kept`` says that
    the posterior ``quality`` reaches ``least``. Labels are ``doc_id, quality`` (0 or 1); other
    values and nulls are ignored. If a class has no labelled document, nothing is known of any
    text: evidence and quality are null and every document is kept. A null host or path is a site
    of its own; null and empty texts are judged as texts of no words; repeated rows are judged
    alike. Columns of ``docs`` with the names of the new ones are replaced.
    """
    host = F.col("source") if host is None else host
    path = F.col("lang") if path is None else path
    own = [c for c in docs.columns if c not in _OWN]
    # A mark tells a null from the text that stands for it.
    site = lambda c: F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit(""))
    placed = docs.select(*own, site(host).alias("_host"), site(path).alias("_path"))
    measured = cut_lineage(
        placed.select("doc_id", "_host", "_path", features(F.col("text")).alias("x"))
    )
    model = fit_classifier(measured, labels)
    if model is None:
        nothing = F.lit(None).cast("double")
        return placed.select(*own, *[nothing.alias(c) for c in _OWN[:-1]], F.lit(True).alias("kept"))
    chance = lambda e: 1 / (1 + F.exp(-(e + model.prior)))
    scored = measured.select(
        F.col("_host").alias("host"),
        F.col("_path").alias("path"),
        chance(model.evidence(F.col("x"))).alias("p"),
    )
    sites, rate, among_hosts, among_paths = site_posteriors(scored)
    salted = sites.select(
        F.col("host").alias("_host"),
        F.col("path").alias("_path"),
        *[F.col(c).alias(f"_{c}") for c in ("n", "good", "host_n", "host_good")],
        F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<long>")).alias("_salt"),
    )
    judged = (
        placed.withColumn("_x", features(F.col("text")))
        .withColumn("evidence", model.evidence(F.col("_x")))
        .withColumn("_p", chance(F.col("evidence")))
        .withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
        .join(salted, ["_host", "_path", "_salt"], "left")
    )
    n, good = F.col("_host_n") - 1, F.col("_host_good") - F.col("_p")
    host_rate = (good + among_hosts * rate) / (n + among_hosts)
    path_rate = (F.col("_good") - F.col("_p") + among_paths * F.col("host_rate")) / (
        F.col("_n") - 1 + among_paths
    )
    posterior = 1 / (1 + F.exp(-(F.col("evidence") + _log_odds(F.col("path_rate")))))
    return (
        judged.withColumn("host_rate", host_rate)
        .withColumn("path_rate", path_rate)
        .withColumn("quality", posterior)
        .select(*own, *_OWN[:-1], (F.col("quality") >= least).alias("kept"))
    )
