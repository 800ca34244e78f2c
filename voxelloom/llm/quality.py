"""Quality classifier with hierarchical empirical Bayes.

A logistic classifier over form features gives each document its own evidence.  Known labels and, where
there is none, the classifier's probability are summed by path and by host; each level is
shrunk towards the one above by a strength fitted to the spread between its groups, so a
sparse path leans on its host and a sparse host on the global share.  A document's posterior
odds are its own odds times what its path says beyond the global share.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from voxelloom.llm.common import Work

#: At most so many labelled rows fit the classifier, those with the smallest hash of the id.
SAMPLE_ROWS = 20_000
THRESHOLD = 0.5
#: How much a path may move a document: the weight of its log odds.
SITE_WEIGHT = 0.5
FEATURES = ("distinct", "repeated", "upper", "symbols", "bars", "short", "length", "digits", "stops", "marks")
_MARK = re.compile(r"[^\w\s.,;:'\"()?\-]")
_SCHEMA = "doc_id bigint, " + ", ".join(f"{f} double" for f in FEATURES)


def form(text: str) -> list[float]:
    """Form features of a whole text; all 0 for an empty one."""
    found = text.split()
    if not found:
        return [0.0] * len(FEATURES)
    n, size = len(found), len(text)
    letters = sum(map(text.count, "aeiouAEIOU")) + 1
    upper = sum(map(text.count, "AEIOU"))
    marks = sum(len(m) for m in _MARK.findall(text))
    return [math.log(len(set(found)) / n), sum(a == b for a, b in zip(found, found[1:])) / n,
            upper / letters, marks / n, sum(w == "|" for w in found) / n, sum(len(w) < 4 for w in found) / n,
            math.log(n), sum(map(text.count, "0123456789")) / size, (text.count(".") + text.count(",")) / n,
            text.count("!") / n]


def features(docs: DataFrame) -> DataFrame:
    """Form features of ``(doc_id, text)``; a null text counts as empty."""
    def run(batches):
        for batch in batches:
            rows = np.array([form(x or "") for x in batch.column(1).to_pylist()], dtype=float).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in rows.T.copy())],
                                             ["doc_id", *FEATURES])

    return docs.select("doc_id", "text").mapInArrow(run, _SCHEMA)


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means, scales and weights (the last is the intercept) of a ridge logistic regression, by Newton steps."""
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale == 0] = 1.0
    z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    w[-1] = math.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    pull = np.full(len(w), ridge)
    pull[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(pull), z.T @ (y - p) - pull * w)
        w = w + step * min(1.0, 2.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, w


def evidence(rows: DataFrame, model) -> Column:
    """The classifier's probability as an expression over the features."""
    mean, scale, w = model
    s = F.lit(float(w[-1]))
    for name, m, sd, weight in zip(FEATURES, mean, scale, w[:-1]):
        s = s + (F.col(name) - float(m)) * float(weight / sd)
    return 1 / (1 + F.exp(-F.least(F.greatest(s, F.lit(-30.0)), F.lit(30.0))))


def strength(groups: DataFrame, above: str) -> float:
    """Pseudo-count of the prior of one level, by moments.

    *groups* has ``n`` and ``good`` and the column *above* with the mean of the level above.  Spread between groups
    beyond the binomial one means a weak prior.  One aggregate over the groups, one row back.
    """
    d = F.col("good") / F.col("n") - F.col(above)
    v = F.col(above) * (1 - F.col(above))
    row = groups.where("n > 0").agg(F.sum(F.col("n") * d * d).alias("ss"), F.sum(v).alias("noise"),
                                    F.sum(F.col("n") * v).alias("nv")).first()
    if not row["nv"]:
        return 1.0
    spread = max((row["ss"] - row["noise"]) / row["nv"], 1e-6)  # the intra-group correlation
    return min(1 / spread - 1, 1e6) if spread < 1 else 1e-3


def classify(docs: DataFrame, labels: DataFrame, host: Column | None = None, path: Column | None = None,
             id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
             sample_rows: int = SAMPLE_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, host, path, evidence, host_rate, path_rate, score, keep`` for every document with an id.

    *host* and *path* are expressions over the documents (source, and source with language, by default);
    null counts as an own empty value.  Of several labels of a document the largest counts.  Without
    any label nothing is known and everything is kept with score 0.5.  A null or empty text has all
    features 0.  Repeated rows stay repeated; other columns are not read.
    """
    spark = docs.sparkSession
    work = Work(spark, "quality")
    host = F.col("source") if host is None else host
    path = F.concat_ws("/", F.coalesce(host, F.lit("")), F.col("lang")) if path is None else path
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                       F.coalesce(host.cast("string"), F.lit("")).alias("host"),
                       F.coalesce(path.cast("string"), F.lit("")).alias("path")).where("doc_id IS NOT NULL")
    marks = (labels.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
             .where("doc_id IS NOT NULL AND label IS NOT NULL").groupBy("doc_id").agg(F.max("label").alias("label")))
    # one pass over the texts: features of all documents go into a stage table with host and path
    def run(batches):
        for batch in batches:
            got = np.array([form(x or "") for x in batch.column(1).to_pylist()], dtype=float).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3),
                                              *(pa.array(c) for c in got.T.copy())], ["doc_id", "host", "path", *FEATURES])

    seen = work.put(rows.mapInArrow(run, _SCHEMA.replace("doc_id bigint,", "doc_id bigint, host string, path string,")), "form")
    sample = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    got = seen.dropDuplicates(["doc_id"]).join(F.broadcast(sample), "doc_id").select(*FEATURES, "label").toPandas()
    base = seen.select("doc_id", "host", "path")
    if got.empty:
        return base.select("*", *[F.lit(0.5).alias(c) for c in ("evidence", "host_rate", "path_rate", "score")],
                           F.lit(True).alias("keep"))
    got = got.sort_values(list(got.columns))
    model = fit(got[list(FEATURES)].to_numpy(), got["label"].to_numpy(dtype=float))
    scored = seen.select("doc_id", "host", "path", evidence(seen, model).alias("evidence"))
    known = scored.join(marks, "doc_id", "left").withColumn("y", F.coalesce(F.col("label").cast("double"), "evidence"))
    paths = work.put(known.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("y").alias("good")), "paths")
    overall = paths.agg(F.sum("good") / F.sum("n")).first()[0]
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good")).withColumn("above", F.lit(overall))
    k = strength(hosts, "above")
    hosts = hosts.select("host", ((F.col("good") + k * F.col("above")) / (F.col("n") + k)).alias("host_rate"))
    paths = paths.join(hosts, "host")
    k = strength(paths, "host_rate")
    paths = paths.select("host", "path", "host_rate",
                         ((F.col("good") + k * F.col("host_rate")) / (F.col("n") + k)).alias("path_rate"))
    odds = lambda p: F.log(F.greatest(p, F.lit(1e-9)) / F.greatest(1 - p, F.lit(1e-9)))
    salts = 16  # a host with a third of the documents is dealt by a part of the id as well
    dealt = paths.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    joined = (scored.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int"))
              .join(dealt, ["host", "path", "salt"]))
    s = odds(F.col("evidence")) + SITE_WEIGHT * (odds(F.col("path_rate")) - odds(F.lit(float(overall))))
    return (joined.withColumn("score", 1 / (1 + F.exp(-s)))
            .select("doc_id", "host", "path", "evidence", "host_rate", "path_rate", "score",
                    (F.col("score") >= threshold).alias("keep")))
