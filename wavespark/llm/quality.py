"""Quality classifier: document evidence and site posteriors under hierarchical empirical Bayes.

1. A logistic regression over measures of the text, trained on labelled documents, gives each document's evidence.
2. Grouped sums give every host and every path below it a posterior: labelled documents count with their label, others
   with their evidence at a small weight. A path shrinks toward its host and a host toward the global rate, by prior
   strengths that the spread between sites implies (method of moments), so a sparse site says little.
3. The document's log odds move by what its site's posterior, of which the document itself is left out, differs from
   the global rate.

The only bounded sample is the classifier's: at most ``most_labelled`` labelled rows, in the order of a hash of their
id. All else counts all documents.

Defined cases: a null text is empty; a document without words has evidence of its own (``no words`` is a measure); null
hosts and paths are a site of their own; several labels of one id count as their mean; repeated rows are scored each;
without labels of both kinds evidence is 0.5 and every document is kept; an empty table gives an empty table. Other
columns pass through; ``evidence``, ``site``, ``quality_score`` and ``kept`` replace columns of their name.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, hash_bound

SYMBOLS = "|!%*#$&{}<>=~^_@\\"
MEASURES = 13


def measures(text: str | None) -> list[float]:
    """Numbers that describe a text, each of the order of 1 and none growing with its length but by its logarithm."""
    words = (text or "").split()
    n = len(words)
    if not n:
        return [0.0] * (MEASURES - 1) + [1.0]
    chars = len(text)
    distinct = len(set(words))
    return [
        np.log1p(n) / 8,
        distinct / n,
        distinct / n * np.log1p(n) / 8,
        sum(map(str.isupper, words)) / n,
        sum(map(str.istitle, words)) / n,
        sum(map(str.isalpha, words)) / n,
        sum(map(operator.eq, words, words[1:])) / n,
        min(3.0, sum(map(text.count, SYMBOLS)) / n),
        min(2.0, text.count("|") / n),
        min(2.0, text.count("!") / n),
        min(3.0, (chars - n) / n / 8),
        min(2.0, (text.count(".") + text.count(",")) / n),
        0.0,
    ]


def _measured(rows: DataFrame) -> DataFrame:
    """rows: ``id``, ``host``, ``path``, ``mark``, ``text``. The measures stand for the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([measures(t) for t in batch.column(4).to_pylist()], np.float32).reshape(-1)
            ends = np.arange(0, len(x) + 1, MEASURES, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.ListArray.from_arrays(pa.array(ends), pa.array(x))], names=["id", "host", "path", "mark", "measures"])

    kept = rows.select("id", "host", "path", "mark").schema.fields
    return rows.select("id", "host", "path", "mark", "text").mapInArrow(run, T.StructType([*kept, T.StructField("measures", T.ArrayType(T.FloatType()))]))


def _evidence(weights: list[float]) -> Column:
    """The trained probability, of the column ``measures``."""
    odds = F.lit(weights[-1])
    for i, w in enumerate(weights[:-1]):
        odds = odds + F.lit(w) * F.col("measures")[i].cast("double")
    return 1 / (1 + F.exp(-odds))


def fit(x: np.ndarray, y: np.ndarray, w: np.ndarray | None = None, ridge: float = 1e-2, steps: int = 50) -> list[float]:
    """Logistic regression by Newton's method; the last weight is the constant."""
    a = np.hstack([x, np.ones((len(x), 1))])
    beta = np.zeros(a.shape[1])
    penalty = np.full(a.shape[1], ridge)
    penalty[-1] = 0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        v = np.maximum(p * (1 - p), 1e-6)
        step = np.linalg.solve((a * v[:, None]).T @ a + np.diag(penalty + 1e-9), a.T @ (y - p) - penalty * beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta.tolist()


def train(base: DataFrame, most_labelled: int = 20_000) -> list[float] | None:
    """base: ``id``, ``measures``, ``label``. Weights from at most ``most_labelled`` labelled rows, those of the least
    hashes of their ids; None unless both kinds are there."""
    known = base.where("label IS NOT NULL").select("id", "measures", "label", F.xxhash64("id").alias("h"))
    count = known.count()
    if count > most_labelled:
        # Hashes are even, so this share of them is a little more than is wanted: no task sorts more than that.
        share = (most_labelled + 6 * most_labelled**0.5) / count
        known = known.where(F.col("h") < F.lit(hash_bound(share)))
    got = known.orderBy("h", "measures").limit(most_labelled).collect()
    y = np.array([r.label for r in got], dtype=float)
    if not len(y) or y.min() >= 0.5 or y.max() < 0.5:
        return None
    return fit(np.array([r.measures for r in got], dtype=float), y)


def _labels(labels: DataFrame, id_: str, label: str) -> DataFrame:
    return labels.select(F.col(f"`{id_}`").alias("id"), F.col(f"`{label}`").cast("double").alias("v")).where("id IS NOT NULL AND v IS NOT NULL").groupBy("id").agg(F.avg("v").alias("label"))


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def _strength(rows: DataFrame, mean: Column, n: str = "n", k: str = "k") -> float:
    """How many documents a prior is worth: from the spread of the groups' rates beyond what chance gives."""
    r = rows.where(F.col(n) > 0).select(F.col(n).alias("n"), (F.col(k) / F.col(n)).alias("rate"), mean.alias("m"))
    got = r.agg(F.count("*"), F.sum(F.col("n") * F.pow(F.col("rate") - F.col("m"), 2)), F.sum(F.col("m") * (1 - F.col("m"))), F.sum("n")).first()
    groups, spread, chance, total = got
    if not groups or groups < 2 or not total:
        return 1e3
    # E[sum n (rate - m)^2] = sum m(1-m) (1 + (n-1)/(s+1)); solved for s.
    extra = (spread - chance) / max(1e-9, chance / groups * (total - groups))
    return float(min(1e4, max(1.0, 1 / extra - 1 if extra > 0 else 1e4)))


def posteriors(scratch: Scratch, scored: DataFrame) -> tuple[DataFrame, float, float, float]:
    """scored: ``host``, ``path``, ``weight``, ``value``. One row per path with the sums of its documents and of its
    host's (``n``, ``k``, ``host_n``, ``host_k``), the global rate, and the prior strengths of hosts and of paths.
    Sums are grouped by path and then by host, so that a host of any size is one partial sum per task."""
    paths = scratch.write(scored.groupBy("host", "path").agg(F.sum("weight").alias("n"), F.sum(F.col("weight") * F.col("value")).alias("k")))
    n, k = paths.agg(F.sum("n"), F.sum("k")).first()
    rate = k / n if n else 0.5
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("k").alias("host_k"))
    s0 = _strength(hosts, F.lit(rate), "host_n", "host_k")
    own, theirs = paths.alias("p"), hosts.select(F.col("host").alias("of"), "host_n", "host_k")
    sites = own.join(theirs, F.col("p.host").eqNullSafe(F.col("of"))).drop("of")
    s1 = _strength(sites.withColumn("host_rate", _shrunk("host_n", "host_k", s0, F.lit(rate))), F.col("host_rate"))
    return scratch.write(sites), rate, s0, s1


def _shrunk(n: str | Column, k: str | Column, strength: float, prior: Column) -> Column:
    """The posterior rate of sums under a prior that is worth ``strength`` documents."""
    n, k = (F.col(x) if isinstance(x, str) else x for x in (n, k))
    return (F.greatest(k, F.lit(0.0)) + prior * F.lit(strength)) / (F.greatest(n, F.lit(0.0)) + F.lit(strength))


def classify(
    spark: SparkSession, docs: DataFrame, labels: DataFrame, text: str = "text", id_: str = "doc_id", host: Column | None = None, path: Column | None = None, label: str = "quality", threshold: float = 0.5, soft: float = 0.05, most_labelled: int = 20_000, keep_text: bool = True
) -> DataFrame:
    """Adds ``evidence``, ``site``, ``quality_score`` and ``kept`` to every document; without ``keep_text`` the result is
    one row per document with its id and these alone.

    host and path: columns of docs; by default its source, and the language below it. soft: what a document without a
    label weighs in its site, against one with a label.
    """
    scratch = Scratch(spark, "quality")
    host = F.col("source") if host is None else host
    path = F.col("lang") if path is None else path
    docs = docs.drop("evidence", "site", "quality_score", "kept")
    id_column, body = F.col(f"`{id_}`"), F.col(f"`{text}`")
    # What a decision depends on, in one number: rows that share an id may differ in the rest.
    mark = F.xxhash64(*[x for c in (id_column, host, path, body) for x in (c, c.isNull())])
    # Texts are read once, where they lie; from here on measures stand for them.
    small = _measured(docs.select(id_column.alias("id"), host.alias("host"), path.alias("path"), mark.alias("mark"), body.alias("text")))
    base = scratch.write(small.join(_labels(labels, id_, label).hint("merge"), "id", "left"))
    weights = train(base, most_labelled)
    if weights is None:
        half = {c: F.lit(0.5) for c in ("evidence", "site", "quality_score")} | {"kept": F.lit(True)}
        return docs.withColumns(half) if keep_text else docs.select(id_column).withColumns(half)
    scored = base.withColumn("evidence", _evidence(weights)).drop("measures")
    weight = F.when(F.col("label").isNotNull(), F.lit(1.0)).otherwise(F.lit(soft))
    scored = scored.withColumns({"weight": weight, "value": F.coalesce("label", "evidence")})
    sites, rate, s0, s1 = posteriors(scratch, scored)
    sites = sites.withColumnsRenamed({"host": "of_host", "path": "of_path"})
    near = scored.join(sites, F.col("host").eqNullSafe(F.col("of_host")) & F.col("path").eqNullSafe(F.col("of_path")), "left")
    # The document itself is left out of its site: its evidence counts once.
    own = F.col("weight") * F.col("value")
    host_rate = _shrunk(F.col("host_n") - F.col("weight"), F.col("host_k") - own, s0, F.lit(rate))
    site = _shrunk(F.col("n") - F.col("weight"), F.col("k") - own, s1, host_rate)
    odds = _logit(F.col("evidence")) + _logit(F.col("site")) - _logit(F.lit(rate))
    judged = near.withColumn("site", site).withColumn("quality_score", 1 / (1 + F.exp(-odds))).withColumn("kept", F.col("quality_score") >= threshold)
    out = ["evidence", "site", "quality_score", "kept"]
    if not keep_text:
        return judged.select(F.col("id").alias(id_), *out)
    decisions = judged.select(F.col("mark").alias("of_mark"), *out).dropDuplicates(["of_mark"])
    whole = docs.select(F.struct("*").alias("doc"), mark.alias("mark"))
    return whole.join(decisions.hint("merge"), F.col("mark") == F.col("of_mark")).select("doc.*", *out)
