"""Quality scores from random Fourier features of document statistics.

Every whole text becomes a short vector of statistics.  Random cosine features
approximate a Gaussian kernel over them; each partition of the labelled sample
sums its share of the normal equations, their total is solved for ridge weights,
and isotonic regression on labelled rows that the fit has not seen turns raw
scores into probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ledgerline.llm.texts import small_batches, string_bytes, word_hashes, word_spans
from ledgerline.session import cut

#: Labelled rows that the fit takes at most, by a hash of their key.
SAMPLE_ROWS = 200_000
FEATURES, RIDGE, BANDWIDTH = 256, 1e-3, 3.0
ACCEPT = 0.7
BATCH_ROWS = 500

# Kinds of bytes whose share of a text's printable bytes is a statistic.  White
# space is none: copies that differ in it alone have equal statistics.
_KINDS = (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b"!", b"|", b".,", b";:'\"?()-")
_SPACES = list(b" \t\n\r\x0b\x0c")
_KIND = np.full(256, len(_KINDS) + 1, np.uint8)
for _number, _members in enumerate(_KINDS):
    _KIND[list(_members)] = _number
_KIND[128:] = len(_KINDS)  # bytes of other than ASCII characters; the rest are symbols
_IS_SPACE = np.isin(np.arange(256), _SPACES)
STATISTICS = len(_KINDS) + 2 + 6


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(documents, STATISTICS): shares are square roots, so that small ones show."""
    n = len(offsets) - 1
    kinds = len(_KINDS) + 2
    size = np.diff(offsets)
    owner = np.repeat(np.arange(n) * kinds, size)
    shares = np.bincount(owner + _KIND[data], minlength=n * kinds).reshape(n, kinds)
    spaces = np.bincount(np.repeat(np.arange(n), size), _IS_SPACE[data], n).astype(np.int64)
    shares[:, -1] -= spaces  # they count as symbols in the table
    shares = shares / np.maximum(size - spaces, 1)[:, None]
    hashes, at = word_hashes(data, offsets)
    starts, ends, _ = word_spans(data, offsets)
    words = np.diff(at)
    some = np.maximum(words, 1)
    doc = np.repeat(np.arange(n), words)
    length = np.bincount(doc, ends - starts, n) / some
    again = np.zeros(len(hashes))
    again[1:] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
    order = np.lexsort((hashes, doc))
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = (hashes[order][1:] != hashes[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    distinct = np.bincount(doc[order], fresh, n)
    # Words that end in something other than a letter or a plain stop.
    tail = _KIND[data[ends - 1]] if len(ends) else np.zeros(0, np.uint8)
    odd = np.bincount(doc, (tail == 3) | (tail == 4) | (tail == kinds - 1), n) / some
    caps = np.bincount(doc, (_KIND[data[starts]] == 0) if len(starts) else None, n) / some if len(starts) else np.zeros(n)
    extra = np.stack(
        [np.log1p(words) / 5, np.minimum(length, 30) / 10, np.sqrt(np.bincount(doc, again, n) / some), np.sqrt(odd), np.sqrt(caps),
         np.where(words > 0, np.log1p(distinct) / np.log1p(some), 1.0)], 1
    )
    return np.concatenate([np.sqrt(shares), extra], 1).astype(np.float32)


def _projection(width: int, features: int, bandwidth: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.normal(size=(width, features)) / bandwidth, rng.uniform(0, 2 * np.pi, features)


def fourier(x: np.ndarray, mean: np.ndarray, scale: np.ndarray, projection: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    w, b = projection
    z = np.cos(((x - mean) / scale) @ w + b) * np.sqrt(2 / w.shape[1])
    return np.concatenate([z, np.ones((len(x), 1))], 1)


def isotonic(at: np.ndarray, count: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points (raw score, value) of the best non-decreasing fit to binned labels.

    Pooled adjacent violators; a pool's place is the mean of its rows' scores.
    """
    order = np.argsort(at)
    pools: list[list[float]] = []  # sum of scores, ones, rows
    for a, n, k in zip(at[order], count[order].astype(float), ones[order].astype(float), strict=True):
        pools.append([a * n, k, n])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [x + y for x, y in zip(pools[-1], last, strict=True)]
    return np.array([p[0] / p[2] for p in pools]), np.array([p[1] / p[2] for p in pools])


def fold_of(key: Column) -> Column:
    """crc32(key as text) mod 4; a null key counts as an empty string."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(4)).cast("int")


def _stats_table(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(_key, x): the statistics of every text."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    picked = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    schema = picked.drop("_text").schema.add("x", T.ArrayType(T.FloatType()))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "_text"):
            x = statistics(*string_bytes(batch.column(1)))
            rows = pa.ListArray.from_arrays(np.arange(0, x.size + 1, STATISTICS, dtype=np.int32), pa.array(x.ravel()))
            yield pa.record_batch([batch.column(0), rows], names=["_key", "x"])

    return picked.mapInArrow(scan, schema)


def _sums(rows: DataFrame, one) -> list[np.ndarray]:
    """Sums over partitions of ``one(x, y)``, a flat array; at most 16 of them."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                x = batch.column(0).flatten().to_numpy().reshape(-1, STATISTICS).astype(np.float64)
                part = one(x, batch.column(1).to_numpy().astype(np.float64))
                total = part if total is None else total + part
        if total is not None:
            yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], names=["s"])

    parts = rows.select("x", "y").repartition(16).mapInArrow(scan, "s binary").collect()
    return [np.frombuffer(p["s"], np.float64) for p in parts]


class QualityModel:
    """Standardisation, features, ridge weights and calibration steps."""

    def __init__(self, mean, scale, projection, weights, steps):
        self.mean, self.scale, self.projection, self.weights, self.steps = mean, scale, projection, weights, steps

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.ones(len(x))
        raw = fourier(x, self.mean, self.scale, self.projection) @ self.weights
        at, value = self.steps
        return np.clip(np.interp(raw, at, value), 0, 1)


def fit_quality(labelled: DataFrame, seed: int = 7, features: int = FEATURES) -> QualityModel:
    """The model of ``(x, y, fold)`` rows: fold 3 calibrates, others fit.

    Without rows to fit, every score is 1: there is nothing to reject.
    """
    fit = labelled.filter("fold <> 3")
    moments = _sums(fit, lambda x, y: np.concatenate([[len(x)], x.sum(0), (x * x).sum(0)]))
    if not moments:
        return QualityModel(None, None, None, None, None)
    total = sum(moments)
    n = total[0]
    mean = total[1 : 1 + STATISTICS] / n
    scale = np.sqrt(np.maximum(total[1 + STATISTICS :] / n - mean**2, 0)) + 1e-3
    projection = _projection(STATISTICS, features, BANDWIDTH, seed)

    def normal(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        z = fourier(x, mean, scale, projection)
        return np.concatenate([(z.T @ z).ravel(), z.T @ y])

    total = sum(_sums(fit, normal))
    side = features + 1
    gram, right = total[: side * side].reshape(side, side), total[side * side :]
    ridge = RIDGE * n * np.eye(side) / side
    ridge[-1, -1] = 0  # texts unlike all others get the mean label
    weights = np.linalg.solve(gram + ridge, right)

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(0).flatten().to_numpy().reshape(-1, STATISTICS)
            # Scores on a grid of 1/1000: a bounded table, whatever the rows.
            bins = np.clip(np.round(fourier(x, mean, scale, projection) @ weights * 1000), -2000, 3000).astype(np.int64)
            yield pa.record_batch([pa.array(bins), batch.column(1)], names=["bin", "y"])

    held = labelled.filter("fold = 3").select("x", "y").mapInArrow(raw, "bin long, y double")
    rows = held.groupBy("bin").agg(F.count("*").alias("n"), F.sum("y").alias("ones")).toArrow()
    if not rows.num_rows:
        steps = np.array([0.0, 1.0]), np.array([0.0, 1.0])
    else:
        bins, count, ones = (rows.column(c).to_numpy() for c in ("bin", "n", "ones"))
        steps = isotonic(bins / 1000, count, ones)
    return QualityModel(mean, scale, projection, weights, steps)


def _fit(table: DataFrame, labels: DataFrame, key: str, label: str, sample_rows: int) -> QualityModel:
    named = labels.select(F.col(key).alias("_lk"), F.col(label).cast("double").alias("y"))
    named = named.filter(F.col("y").isNotNull() & F.col("_lk").isNotNull()).withColumn("fold", fold_of(F.col("_lk"))).filter("fold <> 2")
    part = min(1.0, sample_rows / max(1, named.count()))
    named = named.filter(F.pmod(F.xxhash64("_lk"), F.lit(1_000_000)) < int(part * 1_000_000))
    return fit_quality(cut(table.join(named, F.col("_key") == F.col("_lk")).select("x", "y", "fold"), "labelled"))


def score_quality(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """key, held_out, score and predicted of every whole text.

    Learnt from rows of ``labels`` whose key is in ``docs`` and whose fold is not
    2, at most ``sample_rows`` of them; null labels teach nothing and a key that
    is labelled or occurs more than once teaches each time.  Null texts are
    empty, and score as empty texts do.  Null keys are not held out and have no
    label.  Other columns are ignored.  An empty table gives an empty result;
    without labels every score is 1.  ``predicted`` is 1 where the score is
    ``ACCEPT`` or more.
    """
    table = cut(_stats_table(docs, key, text), "statistics")
    model = docs.sparkSession.sparkContext.broadcast(_fit(table, labels, key, label, sample_rows))
    schema = table.drop("x").schema.add("score", "double")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(-1, STATISTICS)
            yield pa.record_batch([batch.column(0), pa.array(model.value.score(x))], names=["_key", "score"])

    return table.mapInArrow(score, schema).select(
        F.col("_key").alias(key),
        (fold_of(F.col("_key")) == 2).alias("held_out"),
        "score",
        (F.col("score") >= ACCEPT).cast("int").alias("predicted"),
    )


def accepted(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample_rows: int = SAMPLE_ROWS
) -> DataFrame:
    """The rows of ``docs`` whose text scores ``ACCEPT`` or more, as they are.

    The same model and the same cases as in ``score_quality``; rows are judged
    one by one in a scan, so null and repeated keys need no join.
    """
    table = _stats_table(docs, key, text)
    model = docs.sparkSession.sparkContext.broadcast(_fit(table, labels, key, label, sample_rows))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, text):
            score = model.value.score(statistics(*string_bytes(batch.column(text))))
            yield batch.filter(pa.array(score >= ACCEPT))

    return docs.mapInArrow(scan, docs.schema)
