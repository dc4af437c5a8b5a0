"""Intermediate tables, sampling, model fits on bounded samples, joins with hot keys."""

from __future__ import annotations

import gc
import pickle
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import stored as _stored


def stored(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back: lineage ends there.

    Shuffle files of jobs before it go first: what they made is stored.
    """
    release_shuffles(df.sparkSession)
    return _stored(df, what)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a stored table that no later plan reads; what was made of it must be stored by then."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def release_shuffles(spark: SparkSession) -> None:
    """Ask both collectors to run, so that Spark's cleaner removes shuffle files of finished jobs."""
    gc.collect()
    spark._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(column: str = "text"):
    """A text column as UTF-8 bytes, null as empty: Python workers then need no decoding."""
    return F.coalesce(F.col(column).cast("binary"), F.lit(b"").cast("binary"))


def hash_sample(df: DataFrame, key: str | list[str], wanted: int, total: int) -> DataFrame:
    """About ``wanted`` rows of ``total``, chosen by a hash of ``key``: the same on every run, rows with an equal key once."""
    key = [key] if isinstance(key, str) else key
    if total > wanted:
        share = int(2**32 * wanted / total)
        df = df.filter((F.xxhash64(*[F.col(f"`{k}`") for k in key], F.lit("sample")).bitwiseAND(F.lit(4294967295))) < share)
    return df.dropDuplicates(key)


def free_name(df: DataFrame, name: str) -> str:
    """A name for a helper column that ``df`` doesn't have, in any spelling."""
    taken = {c.lower() for c in df.columns}
    name = f"_{name}"
    while name in taken:
        name = f"_{name}"
    return name


def fit_in_task(sample: DataFrame, fit: Callable[[list[dict]], object]) -> object:
    """``fit(rows)`` of a bounded sample, computed by one task so that the driver holds its result only."""

    def run(batches):
        rows = [row for batch in batches for row in batch.to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(rows))], pa.binary())], names=["model"])

    got = sample.repartition(1).mapInArrow(run, "model binary").first()
    return pickle.loads(got["model"]) if got is not None else fit([])


def fit_logistic(x_rows: list[tuple[np.ndarray, np.ndarray]], dense: np.ndarray, y: np.ndarray, weight: np.ndarray,
                 dim: int, steps: int = 120, rate: float = 0.1, l2: float = 1e-4):
    """Full-batch Adam on the logistic loss over sparse hashed features and dense ones.

    ``x_rows`` holds (indices, values) per row, ``y`` labels in [0, 1] (soft
    labels allowed).  Returns the sparse weights, dense weights and the bias.
    The rows are a bounded sample.
    """
    n = len(y)
    size = np.fromiter((len(i) for i, _ in x_rows), np.int64, n)
    row = np.repeat(np.arange(n), size)
    idx = np.concatenate([i for i, _ in x_rows]).astype(np.int64) if n else np.zeros(0, np.int64)
    val = np.concatenate([v for _, v in x_rows]).astype(np.float32) if n else np.zeros(0, np.float32)
    used, idx = np.unique(idx, return_inverse=True)
    w, b = np.zeros(len(used)), 0.0
    d = np.zeros(dense.shape[1])
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(d), np.zeros_like(d), 0.0, 0.0]
    total = max(weight.sum(), 1e-9)
    for t in range(1, steps + 1):
        z = np.bincount(row, val * w[idx], n) + dense @ d + b
        g = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / total
        grads = (np.bincount(idx, val * g[row], len(w)) + l2 * w, dense.T @ g + l2 * d, g.sum())
        for k, grad in enumerate(grads):
            state[2 * k] = 0.9 * state[2 * k] + 0.1 * grad
            state[2 * k + 1] = 0.99 * state[2 * k + 1] + 0.01 * grad * grad
            move = rate * (state[2 * k] / (1 - 0.9**t)) / (np.sqrt(state[2 * k + 1] / (1 - 0.99**t)) + 1e-8)
            if k == 0:
                w = w - move
            elif k == 1:
                d = d - move
            else:
                b = b - float(move)
    weights = np.zeros(dim, np.float32)
    weights[used] = w
    return weights, d, b


def fit_platt(z: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, steps: int = 200) -> tuple[float, float]:
    """Platt's calibration: (a, b) so that sigmoid(a * z + b) is a probability.  Without both classes: (1, 0)."""
    if len(z) == 0 or y.min() == y.max():
        return 1.0, 0.0
    weight = np.ones(len(z)) if weight is None else weight
    spread = max(float(z.std()), 1e-6)
    x = np.stack([z / spread, np.ones(len(z))], 1)
    t = np.array([1.0, 0.0])
    smooth = np.where(y > 0.5, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    for _ in range(steps):  # Newton with a small ridge
        p = 1 / (1 + np.exp(-np.clip(x @ t, -30, 30)))
        g = x.T @ (weight * (p - smooth)) + 1e-3 * t
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, g)
        t -= step
        if np.abs(step).max() < 1e-8:
            break
    return float(t[0] / spread), float(t[1])


#: A key with more than this share of the rows is hot; so there are at most ``1 / HOT_SHARE`` hot keys.
HOT_SHARE = 1 / 400
SALTS = 64


def join_by_key(rows: DataFrame, per_key: DataFrame, key: str | list[str], count: str, how: str = "inner", total: int | None = None) -> DataFrame:
    """Join ``rows`` with ``per_key``, which has one row per key and the number of ``rows`` of that key.

    ``total``, where it is known, is the number of ``rows`` or a little more; else they are counted.

    Hot keys are spread over ``SALTS`` sub-keys: their rows get a random-looking
    salt and their one row on the other side is repeated.  The list of hot keys
    is bounded by ``1 / HOT_SHARE``, so it may be broadcast.
    """
    key = [key] if isinstance(key, str) else key
    if total is None:
        total = per_key.agg(F.sum(count)).first()[0] or 0
    if total == 0:
        return rows.join(per_key.drop(count), key, how)
    least = max(int(total * HOT_SHARE), 64)
    hot = per_key.filter(F.col(count) > least).select(*key, F.lit(True).alias("_hot"))
    spread = F.when(F.col("_hot"), F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]), F.lit(SALTS))).otherwise(F.lit(0)).cast("int")
    left = rows.join(F.broadcast(hot), key, "left").withColumn("_salt", spread).drop("_hot")
    last = F.when(F.col(count) > least, F.lit(SALTS - 1)).otherwise(F.lit(0))
    right = per_key.withColumn("_salt", F.explode(F.sequence(F.lit(0), last))).drop(count)
    return left.join(right, [*key, "_salt"], how).drop("_salt")
