"""Quality classifier with hierarchical empirical Bayes over hosts and paths.

A logistic regression on the form of the text (lengths, repeats, and hashed pairs of neighbouring character classes) gives each
document a probability of being good. Hosts and paths (a path lies in a host) have posteriors of their own: grouped sums of what is
known of their documents (the label where there is one, else the classifier's probability) are shrunk toward the level above, a
path toward its host and a host toward the whole, with a strength found by moments from the spread between groups. Sparse sites so
stay near the global prior. A document's score joins its own log-odds with those of its path without the document itself, relative
to the global prior: what is known of a document counts once, and its label doesn't enter its own score.

The regression is fitted on at most ``FIT_DOCS`` labelled documents, by a hash of the id; sums run over all documents, with partial
aggregation before any shuffle. Sites are joined back by broadcast up to a counted bound, by a shuffle beyond it.

Null texts count as empty and null hosts or paths as one unnamed site. An id that is labelled repeatedly counts with its mean label.
Without labels every document's own probability is the prior 0.5, and all stay. Repeated rows stay rows. An empty table gives an
empty table. Other columns pass through :func:`accepted` untouched.
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

FIT_DOCS, THRESHOLD, RIDGE = 20_000, 0.5, 1.0
_UPPER, _DIGITS = bytes(range(65, 91)), bytes(range(48, 58))
NAMES = ("length", "upper", "digits", "lines", "distinct", "repeats", "word_length", "one_symbol_words", "same_lines")
#: Buckets of the hashed pairs. Classes: lower and upper letters, digits, white space, line ends, control, beyond ASCII, and each
#: other ASCII character alone.
PAIRS, _KINDS = 128, 40
_CLASS = np.full(256, 6, np.int64)
_CLASS[:128] = [5 if c < 32 or c == 127 else 0 if 97 <= c < 123 else 1 if 65 <= c < 91 else 2 if 48 <= c < 58 else 7 for c in range(128)]
_CLASS[[32, 9]], _CLASS[[10, 13]] = 3, 4
_CLASS[np.flatnonzero(_CLASS == 7)] = np.arange(7, 7 + int((_CLASS == 7).sum()))
_BUCKET = (np.arange(_KINDS * _KINDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(57)).astype(np.int64)


def features(text: str | None) -> np.ndarray:
    """Numbers on the form of one whole text, each within bounds."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    n, k = max(1, len(data)), max(1, len(words))
    lines = [x for x in data.split(b"\n") if x]
    share = lambda chars: (len(data) - len(data.translate(None, chars))) / n
    kinds = _CLASS[np.frombuffer(data, np.uint8)]
    pairs = np.bincount(_BUCKET[kinds[:-1] * _KINDS + kinds[1:]], minlength=PAIRS)
    own = [
        np.log1p(len(words)) / 10,
        share(_UPPER),
        share(_DIGITS),
        min(1.0, len(lines) / k),
        len(set(words)) / k,
        sum(map(eq, words, words[1:])) / k,
        min(1.0, len(data) / k / 20),
        sum(map((1).__eq__, map(len, words))) / k,
        1 - len(set(lines)) / max(1, len(lines)),
    ]
    return np.concatenate([own, np.sqrt(pairs / n)])


def table(texts: list[str | None]) -> np.ndarray:
    return np.array([features(t) for t in texts], float).reshape(len(texts), len(NAMES) + PAIRS)


def regression(x: np.ndarray, y: np.ndarray) -> dict:
    """Ridge logistic regression by Newton's method on standardized features."""
    if not len(y) or y.min() == y.max():
        rate = float((y.sum() + 1) / (len(y) + 2)) if len(y) else 0.5
        return {"mean": np.zeros(x.shape[1]), "scale": np.ones(x.shape[1]), "w": np.append(np.zeros(x.shape[1]), np.log(rate / (1 - rate)))}
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
    z = np.column_stack([np.clip((x - mean) / scale, -8, 8), np.ones(len(y))])
    ridge = np.diag([RIDGE] * x.shape[1] + [1e-6])
    w = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge, z.T @ (y - p) - ridge @ w)
        w += step
        if abs(step).max() < 1e-8:
            break
    return {"mean": mean, "scale": scale, "w": w}


def probability(model: dict, x: np.ndarray) -> np.ndarray:
    z = np.clip((x - model["mean"]) / model["scale"], -8, 8) @ model["w"][:-1] + model["w"][-1]
    return 1 / (1 + np.exp(-np.clip(z, -12, 12)))


def labelled(labels: DataFrame) -> DataFrame:
    """(doc_id, y): the mean label of each labelled id."""
    return labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg("quality").alias("y"))


def fit(docs: DataFrame, known: DataFrame, fit_docs: int = FIT_DOCS, id_col: str = "doc_id", text_col: str = "text") -> dict:
    """Fit on labelled documents (known: doc_id, y, written). Of rows with one id the one with the least features counts."""
    n = known.count()
    if n > fit_docs:
        known = known.where(F.pmod(F.xxhash64(F.lit("fit"), "doc_id"), F.lit(1_000_003)) < int(1_000_003 * fit_docs / n))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(known), "doc_id")  # at most about fit_docs rows

    def compute(texts: list[str | None]) -> list[pa.Array]:
        return [pa.array([x.astype("<f4").tobytes() for x in table(texts)], pa.binary())]

    # a row for each id, so about fit_docs rows of half a kilobyte reach the driver
    got = sorted(map(tuple, shared.append(rows, "text", [("x", "binary")], compute).groupBy("doc_id", "y").agg(F.min("x").alias("x")).collect()))
    return regression(np.array([np.frombuffer(x, "<f4") for _, _, x in got], float).reshape(len(got), len(NAMES) + PAIRS), np.array([y >= 0.5 for _, y, _ in got], float))


def strength(prior: float, spread: float) -> float:
    """How many documents the level above counts for: of a beta distribution with this mean and variance."""
    prior = min(max(prior, 1e-6), 1 - 1e-6)
    return float(min(max(prior * (1 - prior) / max(spread, 1e-9) - 1, 1.0), 1e6))


def _spread(groups: DataFrame, mean: Column) -> float:
    """Variance between groups beyond what their sizes explain, weighted by documents."""
    within = mean * (1 - mean) / F.col("n")
    row = groups.where("n > 0").agg(F.sum(F.col("n") * (F.pow(F.col("e") / F.col("n") - mean, 2) - within)), F.sum("n")).first()
    return (row[0] or 0.0) / (row[1] or 1)


def sites(scored: DataFrame) -> tuple[DataFrame, float, float, float]:
    """Posteriors from (host, path, e): (host, path, n, e, host_n, host_e, host_posterior, path_posterior), the global prior, and
    how many documents the prior counts for in a host and a host's posterior in a path."""
    paths = shared.materialize(scored.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("e").alias("e")), "paths")
    hosts = shared.materialize(paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("e").alias("e")), "hosts")
    n, e = hosts.agg(F.sum("n"), F.sum("e")).first()
    prior = ((e or 0.0) + 1) / ((n or 0) + 2)
    k_host = strength(prior, _spread(hosts, F.lit(prior)))
    hosts = hosts.select("host", F.col("n").alias("host_n"), F.col("e").alias("host_e"), ((F.col("e") + k_host * prior) / (F.col("n") + k_host)).alias("host_posterior"))
    both = shared.materialize(paths.join(hosts, "host"), "sites")
    k_path = strength(prior, _spread(both, F.col("host_posterior")))
    path = (F.col("e") + k_path * F.col("host_posterior")) / (F.col("n") + k_path)
    found = shared.materialize(both.select("host", "path", "n", "e", "host_n", "host_e", "host_posterior", path.alias("path_posterior")), "posteriors")
    return found, prior, k_host, k_path


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _classified(docs: DataFrame, model: dict, name: str, text_col: str) -> DataFrame:
    def compute(texts: list[str | None]) -> list[pa.Array]:
        return [pa.array(probability(model, table(texts)))]

    return shared.append(docs, text_col, [(name, "double")], compute)


@dataclass
class Judge:
    """What was learned: the regression, the sites with their sums, the prior and its strengths, the labels."""

    model: dict
    posteriors: DataFrame
    prior: float
    k_host: float
    k_path: float
    known: DataFrame

    def without(self, own: Column, n: Column, e: Column, host_n: Column, host_e: Column) -> Column:
        """The posterior of a document's path from all other documents, ``own`` being what is known of it."""
        host = (host_e - own + self.k_host * self.prior) / (host_n - 1 + self.k_host)
        path = (e - own + self.k_path * host) / (n - 1 + self.k_path)
        return F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), path))

    def score(self, doc_score: Column, site: Column) -> Column:
        return 1 / (1 + F.exp(-(_logit(doc_score) + _logit(site) - float(np.log(self.prior / (1 - self.prior))))))


def _learned(docs: DataFrame, labels: DataFrame, host: Column, path: Column, id_col: str, text_col: str) -> tuple[Judge, DataFrame]:
    """The judge, and (doc_id, host, path, doc_score, own) of every row."""
    known = shared.materialize(labelled(labels), "labels")
    model = fit(docs, known, id_col=id_col, text_col=text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"), F.col(text_col).cast("string").alias("text"))
    scored = _classified(rows, model, "doc_score", "text").drop("text")
    scored = shared.materialize(shared.lookup_join(scored, known, ["doc_id"]).select("doc_id", "host", "path", "doc_score", F.coalesce("y", "doc_score").alias("own")), "doc-scores")
    return Judge(model, *sites(scored.withColumnRenamed("own", "e")), known), scored


def judged(docs: DataFrame, labels: DataFrame, host: Column, path: Column, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, Judge]:
    """(doc_id, host, path, doc_score, host_posterior, path_posterior, others_posterior, score, keep) per row, and the judge;
    others_posterior is the path's without the document."""
    judge, scored = _learned(docs, labels, host, path, id_col, text_col)
    out = shared.lookup_join(scored, judge.posteriors, ["host", "path"])
    out = out.withColumn("others_posterior", judge.without(*map(F.col, ("own", "n", "e", "host_n", "host_e")))).withColumn("score", judge.score(F.col("doc_score"), F.col("others_posterior")))
    return out.select("doc_id", "host", "path", "doc_score", "host_posterior", "path_posterior", "others_posterior", "score", (F.col("score") >= threshold).alias("keep")), judge


def accepted(docs: DataFrame, labels: DataFrame, host: Column, path: Column, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept, all columns kept. Texts meet their site's sums and their label by lookups."""
    judge, _ = _learned(docs, labels, host, path, id_col, text_col)
    sums = ("n", "e", "host_n", "host_e")
    h, p, own, label, key, *site = (shared.fresh(docs, x) for x in ("site_host", "site_path", "own_score", "own_label", "own_id", *(f"site_{x}" for x in sums)))
    marked = docs.withColumn(h, F.coalesce(host, F.lit(""))).withColumn(p, F.coalesce(path, F.lit(""))).withColumn(key, F.col(f"`{id_col}`").cast("long"))
    rows = _classified(marked, judge.model, own, text_col)
    rows = shared.lookup_join(rows, judge.posteriors.select(F.col("host").alias(h), F.col("path").alias(p), *(F.col(x).alias(y) for x, y in zip(sums, site))), [h, p])
    rows = shared.lookup_join(rows, judge.known.select(F.col("doc_id").alias(key), F.col("y").alias(label)), [key])
    others = judge.without(F.coalesce(label, own), *map(F.col, site))
    return rows.where(judge.score(F.col(own), others) >= threshold).select(*[F.col(f"`{c}`") for c in docs.columns])
