"""Quality classifier with hierarchical empirical Bayes over sites.

A logistic model on the shape of a text and a learned word list gives each document's evidence.
Evidence is summed per host and per path of a host; a host's rate is shrunk toward the global rate
and a path's toward its host's, the more so the fewer documents it has. The site's rate is the
prior odds, the document's evidence the likelihood ratio, and their product decides.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluiceway.llm.common import fresh, give_back, stored

SAMPLE_ROWS = 20_000  # labelled rows that the model is fitted on, at most
LEXICON_WORDS = 200
BEGINNINGS = (5, 7)
SHAPES = 10
CACHED = 100_000
WORD = re.compile(r"[^\W\d_]+")
LETTER, UPPER, DIGIT, SPACE, OTHER = range(5)
KINDS = np.full(129, OTHER, np.uint8)
for _c in range(128):
    _s = chr(_c)
    KINDS[_c] = UPPER if _s.isupper() else LETTER if _s.isalpha() else DIGIT if _s.isdigit() else SPACE if _s.isspace() else OTHER
KINDS[128] = LETTER  # letters beyond ASCII, whose case is not told apart


def entries(word: str) -> list[str]:
    """What a word can be known by: itself and its beginnings."""
    return [word, *(f"{word[:k]}~" for k in BEGINNINGS if len(word) > k)]


def shape(text: str) -> list[float]:
    """Shares and ratios that tell prose from lists, shouting, repeats and marked-up words."""
    words = text.split()
    n = max(1, len(words))
    counts = Counter(words)
    kinds = KINDS[np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), 128)]
    by_kind = np.bincount(kinds, minlength=5)
    other = kinds == OTHER
    doubled = int(np.count_nonzero(other[1:] & other[:-1]))
    letters = max(1, by_kind[LETTER] + by_kind[UPPER])
    bare = sum(counts[w] for w in counts if not any(c.isalnum() for c in w)) if other.any() else 0
    top = max(counts.values(), default=0)
    return [
        np.log1p(len(words)),
        by_kind[UPPER] / letters,
        by_kind[OTHER] / max(1, len(kinds)),
        min(5.0, doubled / n),
        bare / n,
        len(counts) / n,
        top / n if len(words) > 20 else 0.0,
        np.log1p(len(counts)) - np.log1p(len(words)),
        min(3.0, sum(map(len, words)) / n / 10),
        by_kind[DIGIT] / max(1, len(kinds)),
    ]


class Lexicon:
    """Counts of learned words and word beginnings in a text."""

    def __init__(self, known: list[str]) -> None:
        self.at = {e: k for k, e in enumerate(known)}
        self.seen: dict[str, list[int]] = {}

    def __call__(self, text: str) -> np.ndarray:
        found = np.zeros(len(self.at))
        if self.at:
            for word in WORD.findall(text.lower()):
                hits = self.seen.get(word)
                if hits is None:
                    if len(self.seen) >= CACHED:
                        self.seen.clear()
                    hits = self.seen[word] = [self.at[e] for e in entries(word) if e in self.at]
                for k in hits:
                    found[k] += 1
        return np.log1p(np.minimum(found, 10))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.3, rounds: int = 40) -> np.ndarray:
    """Weights of a ridge logistic regression, the last one the intercept."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(h, x.T @ (y - p) - penalty * w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w


@dataclass
class QualityModel:
    """Two heads: low quality, on the shape of a text, and toxic, on learned words and its length."""

    known: list[str] = field(default_factory=list)
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    low: np.ndarray | None = None
    toxic: np.ndarray | None = None

    def lexicon(self) -> Lexicon:
        return Lexicon(self.known)

    def inputs(self, text: str, lexicon: Lexicon) -> np.ndarray:
        return np.concatenate([shape(text), lexicon(text)])

    def probability(self, x: np.ndarray) -> np.ndarray:
        """Probability that a text should go; 0.01 for all if no label was there to learn from."""
        if self.mean is None or not len(x):
            return np.full(len(x), 0.01)
        x = np.column_stack([(x - self.mean) / self.scale, np.ones(len(x))])
        stay = np.ones(len(x))
        for w, columns in ((self.low, self.low_columns()), (self.toxic, self.toxic_columns())):
            if w is not None:
                stay *= 1 - 1 / (1 + np.exp(-np.clip(x[:, columns] @ w, -30, 30)))
        return np.clip(1 - stay, 1e-6, 1 - 1e-6)

    def low_columns(self) -> list[int]:
        return [*range(SHAPES), SHAPES + len(self.known)]

    def toxic_columns(self) -> list[int]:
        return [0, *range(SHAPES, SHAPES + len(self.known) + 1)]


def fit(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    sample_rows: int = SAMPLE_ROWS,
) -> QualityModel:
    """Fit on at most ``sample_rows`` labelled documents, picked by a hash of their id.

    ``labels`` has the id, ``quality`` (1 good) and ``toxic`` (1 toxic); a null label counts as
    good or not toxic, and the worst of repeated labels counts. Equal texts count once, so that a
    group of copies does not outvote the rest.
    """
    picked = (
        labels.where(F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("l_id"))
        .agg((F.coalesce(F.min("quality"), F.lit(1)) == 0).alias("low"), (F.coalesce(F.max("toxic"), F.lit(0)) == 1).alias("toxic"))
        .orderBy(F.xxhash64(F.lit("labelled"), "l_id"))
        .limit(sample_rows)
    )
    texts = docs.select(F.col(id_col).alias("d_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # The picked labels have a bounded number of small rows.
    sample = texts.join(F.broadcast(picked), F.col("d_id") == F.col("l_id")).groupBy(F.xxhash64("text").alias("h")).agg(
        F.first("text").alias("text"), F.max("low").alias("low"), F.max("toxic").alias("toxic")
    )
    sample = stored(sample.select("text", "low", "toxic"), "labelled")
    model = QualityModel(learn_words(sample))
    data = np.array([(*r.x, r.low, r.toxic) for r in inputs(sample, model).toPandas().itertuples(index=False)], np.float64)
    if not len(data):
        return model
    data = data[np.lexsort(data.T)]  # the same order, and so the same sums, on every run
    x, low, toxic = data[:, :-2], data[:, -2], data[:, -1]
    model.mean, model.scale = x.mean(0), np.maximum(x.std(0), 1e-3)
    x = (x - model.mean) / model.scale
    if 0 < low.sum() < len(low):
        model.low = logistic(x[:, model.low_columns()[:-1]], low)
    if 0 < toxic.sum() < len(toxic):
        model.toxic = logistic(x[:, model.toxic_columns()[:-1]], toxic)
    return model


def learn_words(sample: DataFrame, least: int = 3, odds: float = 8.0, evidence: float = 20.0) -> list[str]:
    """At most ``LEXICON_WORDS`` words and beginnings that toxic texts have and others hardly.

    ``odds`` is the least ratio of the two shares, ``evidence`` the least likelihood ratio
    statistic of the difference.
    """

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            a, k = Counter(), Counter()
            for text, toxic in zip(frame["text"], frame["toxic"]):
                found = {e for w in set(WORD.findall(text.lower())) for e in entries(w)}
                k.update(found)
                if toxic:
                    a.update(found)
            yield pd.DataFrame({"entry": list(k), "a": [a[e] for e in k], "k": list(k.values())})

    totals = sample.agg(F.sum(F.col("toxic").cast("int")).alias("t"), F.count("*").alias("n")).first()
    toxic, n = totals.t or 0, totals.n
    if not toxic or toxic == n:
        return []
    counts = sample.select("text", "toxic").mapInPandas(count, "entry string, a long, k long").groupBy("entry").agg(
        F.sum("a").alias("a"), F.sum("k").alias("k")
    )
    counts = counts.where(F.col("a") >= least).withColumn("b", F.col("k") - F.col("a"))

    def fit_of(hits: Column, total: int, share: Column) -> Column:
        miss = total - hits
        return F.when(hits > 0, hits * F.log(share)).otherwise(0) + F.when(miss > 0, miss * F.log(1 - share)).otherwise(0)

    a, b = F.col("a"), F.col("b")
    both, in_a, in_b = (a + b) / n, a / toxic, b / (n - toxic)
    gain = 2 * (fit_of(a, toxic, in_a) + fit_of(b, n - toxic, in_b) - fit_of(a, toxic, both) - fit_of(b, n - toxic, both))
    good = counts.where(in_a >= odds * (b + 0.5) / (n - toxic)).withColumn("gain", gain).where(F.col("gain") >= evidence)
    return [r.entry for r in good.orderBy(F.round("gain", 6).desc(), "entry").limit(LEXICON_WORDS).collect()]


def inputs(sample: DataFrame, model: QualityModel) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon = model.lexicon()
        for frame in frames:
            x = [model.inputs(t, lexicon) for t in frame["text"]]
            yield pd.DataFrame({"x": x, "low": frame["low"], "toxic": frame["toxic"]})

    return sample.mapInPandas(run, "x array<double>, low boolean, toxic boolean")


def with_evidence(docs: DataFrame, model: QualityModel, text_col: str, name: str) -> DataFrame:
    """All columns of ``docs`` and the model's probability that the text should go."""
    at = docs.columns.index(text_col)
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = model.lexicon()
        for batch in batches:
            x = np.array([model.inputs(t or "", lexicon) for t in batch.column(at).to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(model.probability(x))], names=[*batch.schema.names, name]
            )
        give_back()

    return docs.mapInArrow(run, schema)


def odds(p: Column) -> Column:
    return p / (1 - p)


def site_rates(scored: DataFrame, evidence: str, host: str, path: str) -> DataFrame:
    """``host, path, host_rate, path_rate, global_rate`` by grouped sums, shrunk level by level.

    A level's prior counts for as many documents as the spread of the rates at that level tells
    (method of moments, between 2 and 1,000). Null hosts and paths are sites of their own.
    """
    paths = stored(
        scored.groupBy(F.col(host).alias("host"), F.col(path).alias("path"))
        .agg(F.count("*").alias("n"), F.sum(evidence).alias("s")),
        "site-sums",
    )
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("s").alias("host_s"))

    def strength(df: DataFrame, n: str, s: str) -> Column:
        """Documents that the prior counts for."""
        rate = F.col(s) / F.col(n)
        m = F.sum(s) / F.sum(n)
        between = F.sum(F.col(n) * rate * rate) / F.sum(n) - m * m
        within = m * (1 - m) * F.count("*") / F.sum(n)  # chance alone
        size = m * (1 - m) / F.greatest(between - within, F.lit(1e-6))
        return df.agg(F.greatest(F.lit(2.0), F.least(F.lit(1000.0), F.coalesce(size, F.lit(1000.0)))).alias("k")).scalar()

    overall = paths.agg((F.sum("s") / F.sum("n")).alias("rate")).scalar()
    hosts = hosts.withColumn("global_rate", overall).withColumn("k", strength(hosts, "host_n", "host_s")).withColumn(
        "host_rate", (F.col("host_s") + F.col("k") * F.col("global_rate")) / (F.col("host_n") + F.col("k"))
    )
    hosts = hosts.select(F.col("host").alias("h"), "host_rate", "global_rate")
    both = paths.join(hosts, F.col("host").eqNullSafe(F.col("h"))).withColumn("k", strength(paths, "n", "s"))
    rate = (F.col("s") + F.col("k") * F.col("host_rate")) / (F.col("n") + F.col("k"))
    return both.select("host", "path", "host_rate", rate.alias("path_rate"), "global_rate")


def judge(
    docs: DataFrame,
    model: QualityModel,
    *,
    text_col: str = "text",
    host_col: str = "source",
    path_col: str = "lang",
    threshold: float = 0.5,
    prefix: str = "_",
) -> DataFrame:
    """All columns of ``docs`` and ``_evidence, _host_rate, _path_rate, _posterior, _rejected``.

    Null counts as the empty text. A null host or path is a site like any other. Every row gets a
    judgement of its own, repeated rows equal ones. An empty table gives an empty result, and
    without labels nothing is rejected. ``prefix`` begins the names of the new columns; columns of
    ``docs`` with one of these names are replaced, all others stay.
    """
    names = [f"{prefix}{n}" for n in ("evidence", "host_rate", "path_rate", "posterior", "rejected")]
    evidence, site = fresh("evidence"), fresh("site")
    scored = stored(with_evidence(docs.drop(*names), model, text_col, evidence), "evidence")
    rates = stored(site_rates(scored, evidence, host_col, path_col), "site-rates")
    sites = rates.withColumnsRenamed({c: f"{site}_{c}" for c in rates.columns})
    same = scored[host_col].eqNullSafe(F.col(f"{site}_host")) & scored[path_col].eqNullSafe(F.col(f"{site}_path"))
    joined = scored.join(sites, same, "left")
    e = odds(F.col(evidence)) / odds(F.col(f"{site}_global_rate")) * odds(F.col(f"{site}_path_rate"))
    posterior = e / (1 + e)
    kept = [F.col(c) for c in scored.columns if c != evidence]
    judged = [F.col(evidence), F.col(f"{site}_host_rate"), F.col(f"{site}_path_rate"), posterior, posterior >= threshold]
    return joined.select(*kept, *[value.alias(name) for value, name in zip(judged, names)])
