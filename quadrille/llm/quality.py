"""Quality classifier: document evidence combined with hierarchical empirical Bayes over sites and paths.

Evidence. A logistic regression over how often each byte stands in a text, and a few measures of its words,
fitted on at most `fit_rows` labelled documents chosen by hash (quality 1 or 0).

Sites. All labelled documents are counted by site and by path within the site (here: source, and language
within the source). The rate of good documents of a site is shrunk toward the rate of all, and a path's
toward its site's, by beta priors whose strengths come from the over-dispersion of all units (method of
moments). The odds of a document are its classifier's odds times the ratio of its path's posterior odds
to the odds of all; it is kept if the probability reaches `limit`.

Null text counts as empty. A null site or path is a unit like any other; units without labelled documents have
their parent's rate. Labels of which one quality is 0 count as 0; null labels don't count. Without any
label all documents are kept with probability null. Rows are judged one by one; repeated rows alike. Sites
are counted with pre-aggregation and joined as Spark chooses; the texts are never shuffled by the operator's
fit. Further columns are kept; those named evidence, site_rate, probability and kept are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Own, map_batches, materialize, number, small, table, texts

FIT_ROWS = 20_000
N_FEATURES = 256 + 6


def features(text: bytes) -> np.ndarray:
    """Square roots of byte shares, and measures of words."""
    out = np.zeros(N_FEATURES)
    words = text.split()
    if not words:
        out[-1] = 1.0
        return out
    n = len(text)
    out[:256] = np.sqrt(np.bincount(np.frombuffer(text, np.uint8), minlength=256) / n)
    kinds = len(set(words))
    lines = text.count(b"\n") + 1
    out[256:] = [n / len(words) / 10, kinds / len(words), np.log(len(words)) / 10, np.log(lines) / 10, len(words) / lines / 100, 0.0]
    return out


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ridge logistic regression by Newton's steps: centre, scale, weights (the last is the intercept)."""
    # Some rows at a time, so that the driver holds no copies of all features.
    parts = [slice(k, k + 2000) for k in range(0, len(x), 2000)]
    wide = lambda p: x[p].astype(np.float64)
    centre = sum(wide(p).sum(0) for p in parts) / len(x)
    scale = np.sqrt(sum(((wide(p) - centre) ** 2).sum(0) for p in parts) / len(x)) + 1e-3
    w = np.zeros(x.shape[1] + 1)
    for _ in range(rounds):
        gradient, curve = ridge * np.r_[w[:-1], 0], ridge * np.eye(len(w))
        for part in parts:
            z = np.c_[(wide(part) - centre) / scale, np.ones(len(y[part]))]
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            gradient += z.T @ (p - y[part]) / len(y)
            curve += (z * (p * (1 - p) + 1e-6)[:, None]).T @ z / len(y)
        step = np.linalg.solve(curve, gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return centre, scale, w


def labelled(labels: DataFrame) -> DataFrame:
    return labels.filter("doc_id is not null and quality is not null").groupBy(F.col("doc_id").alias("_id")).agg(F.min(F.when(F.col("quality") == 0, 0).otherwise(1)).alias("_good"))


def train(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", fit_rows: int = FIT_ROWS):
    """The fitted classifier, or None without labelled documents of both kinds. Only features reach the driver."""
    chosen = labelled(labels).orderBy(F.xxhash64("_id"), "_id").limit(fit_rows)
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    found = own.join(F.broadcast(chosen), own.doc_id == chosen._id).select("_id", "_good", "text")

    def run(batch: pa.RecordBatch) -> dict:
        return {"x": [features(t).astype(np.float32).tobytes() for t in texts(batch)]}

    # Of rows that repeat an id one counts, so that no more rows than labels come to the driver.
    rows = map_batches(found, run, "x binary", ("text",)).groupBy("_id").agg(F.max("_good").alias("_good"), F.min("x").alias("x")).collect()
    rows.sort(key=lambda r: r["_id"])
    y = np.array([r["_good"] for r in rows], np.float64)
    if len(set(y.tolist())) < 2:
        return None
    x = np.empty((len(rows), N_FEATURES), np.float32)
    for k in range(len(rows)):
        x[k], rows[k] = np.frombuffer(bytes(rows[k]["x"]), np.float32), None
    del rows
    return fit(x, y)


def _strength(units: DataFrame, prior: str) -> DataFrame:
    p, n, good = F.col(prior), F.col("n"), F.col("good")
    excess, spread = F.sum(F.pow(good - n * p, 2) / (p * (1 - p)) - n), F.sum(n * (n - 1)).cast("double")
    rho = F.greatest(F.lit(0.001), F.least(F.lit(0.5), F.coalesce(F.try_divide(excess, spread), F.lit(0.001))))
    return number(units.agg((1 / rho - 1).alias("m")))


def rates(docs: DataFrame, labels: DataFrame, site: str, path: str, doc_id: str = "doc_id") -> DataFrame:
    """_site, _path, site_rate (posterior rate of good documents), base_rate, for units with labels."""
    marks = labelled(labels)
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(site).alias("_site"), F.col(path).alias("_path"))
    counted = own.join(marks, own.doc_id == marks._id).groupBy("_site", "_path").agg(F.count("*").alias("n"), F.sum("_good").alias("good"))
    # One row per path: counted once, and all levels are found from what was counted.
    counted = materialize(counted, "paths")
    base = number(counted.agg(((F.sum("good") + 0.5) / (F.sum("n") + 1.0)).alias("p")))
    sites = counted.groupBy(F.col("_site").alias("_s")).agg(F.sum("n").alias("n"), F.sum("good").alias("good")).withColumn("base_rate", base)
    m = _strength(sites, "base_rate")
    sites = sites.select("_s", "base_rate", ((F.col("good") + m * F.col("base_rate")) / (F.col("n") + m)).alias("of_site"))
    paths = counted.join(sites, F.col("_site").eqNullSafe(F.col("_s"))).drop("_s")
    m = _strength(paths, "of_site")
    return paths.select("_site", "_path", "base_rate", "of_site", ((F.col("good") + m * F.col("of_site")) / (F.col("n") + m)).alias("site_rate"))


def _judged(own: Own, labels: DataFrame, text: str, site: str, path: str, doc_id: str, limit: float, fit_rows: int) -> DataFrame:
    """The table's own columns that are kept, evidence, site_rate, probability, kept."""
    columns = [f"c{i}" for i in own.kept]
    text, site, path, doc_id = (own.name(c) for c in (text, site, path, doc_id))
    model = train(own.df, labels, text, doc_id, fit_rows)
    if model is None:
        none = F.lit(None).cast("double")
        return own.df.select(*columns, *[none.alias(c) for c in ("evidence", "site_rate", "probability")], F.lit(True).alias("kept"))
    centre, scale, w = model
    slope = w[:-1] / scale
    shift = float(w[-1] - centre @ slope)

    def run(batch: pa.RecordBatch) -> dict:
        return {"evidence": np.array([features(t).astype(np.float32) @ slope + shift for t in texts(batch, text)])}

    needed = dict.fromkeys([*columns, text, site, path])
    scored = map_batches(own.df.select(*needed), run, "evidence double", () if text in columns else (text,))
    known = materialize(rates(own.df, labels, site, path, doc_id), "rates")
    # Units are far fewer than documents, and where they are few indeed the documents stay where they are.
    of_path = small(known.select("_site", "_path", "site_rate"))
    of_site = small(known.select(F.col("_site").alias("_s"), "of_site", "base_rate").distinct())
    joined = scored.join(of_site, scored[site].eqNullSafe(F.col("_s")), "left").join(
        of_path, scored[site].eqNullSafe(F.col("_site")) & scored[path].eqNullSafe(F.col("_path")), "left"
    )
    rate = F.coalesce("site_rate", "of_site")
    odds = F.coalesce(F.log(rate / (1 - rate)) - F.log(F.col("base_rate") / (1 - F.col("base_rate"))), F.lit(0.0))
    p = 1 / (1 + F.exp(-(F.col("evidence") + odds)))
    return joined.select(*columns, "evidence", rate.alias("site_rate"), p.alias("probability"), (p >= limit).alias("kept"))


def classify(
    docs: DataFrame, labels: DataFrame, text: str = "text", site: str = "source", path: str = "lang", doc_id: str = "doc_id",
    limit: float = 0.5, fit_rows: int = FIT_ROWS, drop: tuple[str, ...] = (),
) -> DataFrame:
    """docs with evidence (log odds by the text), site_rate, probability, kept."""
    own = Own(docs, ("evidence", "site_rate", "probability", "kept", *drop))
    return _judged(own, labels, text, site, path, doc_id, limit, fit_rows).select(*own.back(), "evidence", "site_rate", "probability", "kept")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return classify(docs, table(spark, sf_dir, "labels"), drop=("text",)).select("doc_id", "probability", "site_rate", "kept")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    own = Own(docs)
    return _judged(own, table(spark, sf_dir, "labels"), "text", "source", "lang", "doc_id", 0.5, FIT_ROWS).filter("kept").select(*own.back())
