"""Language identification by a bidirectional gated recurrent network over bytes.

The network is trained here in numpy by backpropagation through time.  It reads
every byte of every text, in windows that bound memory on very long texts,
labels each position from both directions' states, and pools a document's
probabilities as the mean over its positions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ledgerline.llm.texts import small_batches, string_bytes
from ledgerline.session import cut

HIDDEN, WINDOW = 8, 128
#: Texts of a language that the network learns from at most (by a hash of their
#: key), and windows of each.
SAMPLE_TEXTS, WINDOWS_A_TEXT = 1500, 4
TRAIN_WINDOW, BATCH, STEPS = 64, 160, 220
BATCH_ROWS = 500
_PAD = 256


class Network:
    """Byte tables and recurrent weights of two directions, and the label layer.

    Gates use ``sigmoid(x) = (1 + tanh(x / 2)) / 2``.
    """

    def __init__(self, labels: int, seed: int, hidden: int = HIDDEN):
        rng = np.random.default_rng(seed)

        def draw(*shape: int, scale: float) -> np.ndarray:
            return (rng.normal(size=shape) * scale).astype(np.float32)

        self.hidden = hidden
        self.p: dict[str, np.ndarray] = {"b": np.zeros(labels, np.float32)}
        for d in "fb":
            self.p |= {
                f"{d}g": draw(257, 2 * hidden, scale=0.3), f"{d}n": draw(257, hidden, scale=0.5),
                f"{d}ug": draw(hidden, 2 * hidden, scale=0.4), f"{d}un": draw(hidden, hidden, scale=0.4),
                f"{d}w": draw(hidden, labels, scale=0.3),
            }

    def states(self, x: np.ndarray, real: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """(time, rows, hidden) states over ``x`` (time, rows); padding holds 0."""
        time, rows = x.shape
        n_ = self.hidden
        table_g, table_n = self.p[f"{d}g"], self.p[f"{d}n"]
        u = np.concatenate([self.p[f"{d}ug"], self.p[f"{d}un"]], 1)
        h = np.zeros((rows, n_), np.float32)
        out = np.empty((time, rows, n_), np.float32)
        full = real.all(1)
        for t in range(time) if d == "f" else range(time - 1, -1, -1):
            a = h @ u
            g = table_g[x[t]]
            g += a[:, : 2 * n_]
            g *= np.float32(0.5)
            np.tanh(g, out=g)
            g += np.float32(1)
            g *= np.float32(0.5)
            z, r = g[:, :n_], g[:, n_:]
            inner = a[:, 2 * n_ :]
            n = r * inner
            n += table_n[x[t]]
            np.tanh(n, out=n)
            new = h - n
            new *= z
            new += n
            if not full[t]:
                new *= real[t][:, None]
            if keep is not None:
                keep.append((t, h, z, r, n, inner))
            out[t] = new
            h = out[t]
        return out

    def label(self, x: np.ndarray, real: np.ndarray) -> np.ndarray:
        """(time, rows, labels) probabilities of every position."""
        time, rows = x.shape
        out = self.states(x, real, "f").reshape(-1, self.hidden) @ self.p["fw"]
        out += self.states(x, real, "b").reshape(-1, self.hidden) @ self.p["bw"]
        out += self.p["b"]
        out -= out.max(1, keepdims=True)
        np.exp(out, out=out)
        out /= out.sum(1, keepdims=True)
        return out.reshape(time, rows, -1)

    def step(self, x: np.ndarray, real: np.ndarray, goal: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Weighted loss over real positions, and its gradients through time."""
        time, rows = x.shape
        n_ = self.hidden
        kept: dict[str, list] = {"f": [], "b": []}
        s = {d: self.states(x, real, d, kept[d]) for d in "fb"}
        logits = s["f"] @ self.p["fw"] + s["b"] @ self.p["bw"] + self.p["b"]
        logits -= logits.max(2, keepdims=True)
        e = np.exp(logits)
        e /= e.sum(2, keepdims=True)
        w = real * weight[None, :]
        w /= max(1e-9, float(w.sum()))
        loss = float(-(np.log(e[:, np.arange(rows), goal] + 1e-9) * w).sum())
        e[:, np.arange(rows), goal] -= 1
        e *= w[:, :, None]
        grads = {"b": e.sum((0, 1))}
        for d in "fb":
            grads[f"{d}w"] = s[d].reshape(time * rows, n_).T @ e.reshape(time * rows, -1)
            dout = e @ self.p[f"{d}w"].T
            ug, un = self.p[f"{d}ug"], self.p[f"{d}un"]
            gg, gn = np.zeros((257, 2 * n_), np.float32), np.zeros((257, n_), np.float32)
            gug, gun = np.zeros_like(ug), np.zeros_like(un)
            dh = np.zeros((rows, n_), np.float32)
            for t, h, z, r, n, inner in reversed(kept[d]):
                dnew = (dh + dout[t]) * real[t][:, None]
                dz = dnew * (h - n) * z * (1 - z)
                dn = dnew * (1 - z) * (1 - n * n)
                dr = dn * inner * r * (1 - r)
                dg = np.concatenate([dz, dr], 1)
                dinner = dn * r
                gug += h.T @ dg
                gun += h.T @ dinner
                for j in range(2 * n_):
                    gg[:, j] += np.bincount(x[t], dg[:, j], 257)
                for j in range(n_):
                    gn[:, j] += np.bincount(x[t], dn[:, j], 257)
                dh = dnew * z + dg @ ug.T + dinner @ un.T
            grads |= {f"{d}g": gg, f"{d}n": gn, f"{d}ug": gug, f"{d}un": gun}
        return loss, grads

    def fit(self, windows: np.ndarray, sizes: np.ndarray, goal: np.ndarray, steps: int, seed: int) -> list[float]:
        """Adam over seeded batches; every language weighs the same."""
        rng = np.random.default_rng(seed)
        weight = (1 / np.maximum(np.bincount(goal), 1))[goal].astype(np.float32)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        losses = []
        for t in range(1, steps + 1):
            rows = rng.integers(0, len(windows), BATCH)
            real = (np.arange(windows.shape[1])[:, None] < sizes[rows]).astype(np.float32)
            loss, grads = self.step(windows[rows].T.astype(np.int64), real, goal[rows], weight[rows])
            losses.append(loss)
            rate = 0.03 * min(1, t / 15) * (0.05 ** (t / steps))
            for k, g in grads.items():
                m[k] += 0.1 * (g - m[k])
                s[k] += 0.01 * (g * g - s[k])
                self.p[k] -= np.float32(rate) * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.99**t)) + 1e-8)
        return losses


def cut_windows(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every text's bytes in windows (time, n) padded with 256; sizes; owners."""
    lengths = np.diff(offsets)
    count = -(-lengths // size)
    owner = np.repeat(np.arange(len(lengths)), count)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    start = offsets[owner] + number * size
    sizes = np.minimum(size, offsets[owner + 1] - start)
    at = start[None, :] + np.arange(size)[:, None]
    real = np.arange(size)[:, None] < sizes[None, :]
    x = np.full(at.shape, _PAD, np.int32)
    x[real] = data[at[real]]
    return x, sizes, owner


def pooled(net: Network, data: np.ndarray, offsets: np.ndarray, labels: int, at_once: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """Mean probabilities of each text and the share of positions a label won."""
    n = len(offsets) - 1
    total, votes = np.zeros((n, labels)), np.zeros((n, labels))
    x, sizes, owner = cut_windows(data, offsets, WINDOW)
    # Windows of like size together: few steps are padding.
    order = np.argsort(-sizes, kind="stable")
    for low in range(0, len(order), at_once):
        part = order[low : low + at_once]
        long = int(sizes[part].max())
        real = np.arange(long)[:, None] < sizes[part]
        prob = net.label(x[:long, part], real.astype(np.float32))
        prob *= real[:, :, None]
        won = np.zeros((len(part), labels))
        best = prob.argmax(2)
        for j in range(labels):
            won[:, j] = ((best == j) & real).sum(0)
        for j, column in enumerate(prob.sum(0, dtype=np.float64).T):
            total[:, j] += np.bincount(owner[part], column, n)
            votes[:, j] += np.bincount(owner[part], won[:, j], n)
    size = np.maximum(np.diff(offsets), 1)[:, None]
    return total / size, votes / size


def fold_of(key: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(4)).cast("int")


def _sample(docs: DataFrame, seed: int, texts: int) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Languages, and windows of a bounded sample of each one's training texts."""
    training = docs.filter(F.col("lang").isNotNull() & F.col("t").isNotNull() & (fold_of(F.col("k")) != 2))
    counts = training.groupBy("lang").agg(F.count("*").alias("n"))
    counts = counts.withColumn("part", F.least(F.lit(1.0), F.lit(float(texts)) / F.col("n")))
    counts = cut(counts.select(F.col("lang").alias("_lang"), "part"), "languages")
    chosen = training.join(counts, F.col("lang") == F.col("_lang")).filter(
        F.pmod(F.xxhash64("k", F.lit(seed)), F.lit(1_000_000)) < F.col("part") * 1_000_000
    )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "t"):
            data, offsets = string_bytes(batch.column(2))
            rows, names = [], []
            for key, lang, a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                if b > a:
                    rng = np.random.default_rng([seed, abs(key or 0)])
                    for start in rng.integers(0, max(1, b - a - TRAIN_WINDOW // 2), WINDOWS_A_TEXT).tolist():
                        rows.append(data[a + start : min(b, a + start + TRAIN_WINDOW)].tobytes())
                        names.append(lang)
            yield pa.record_batch([pa.array(names, pa.string()), pa.array(rows, pa.binary())], names=["lang", "w"])

    got = chosen.select("k", "lang", "t").mapInArrow(scan, "lang string, w binary").toArrow().to_pylist()
    got.sort(key=lambda r: (r["lang"], r["w"]))
    languages = sorted({r["lang"] for r in got})
    number = {name: i for i, name in enumerate(languages)}
    x = np.full((len(got), TRAIN_WINDOW), _PAD, np.int32)
    for i, r in enumerate(got):
        x[i, : len(r["w"])] = np.frombuffer(r["w"], np.uint8)
    return languages, x, np.array([len(r["w"]) for r in got]), np.array([number[r["lang"]] for r in got])


def detect_languages(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    sample_texts: int = SAMPLE_TEXTS,
    steps: int = STEPS,
    seed: int = 5,
) -> DataFrame:
    """key, held_out, lang_pred, score and share of every whole text.

    Learnt from text and non-null ``lang`` of rows whose crc32(key as text) mod
    4 is not 2 (a null key counts as an empty string), ``sample_texts`` texts a
    language at most.  ``score`` is the pooled probability of ``lang_pred``,
    ``share`` the part of positions with that label.  Texts that are null or
    have no letter are ``und`` with score 1 and share 0, as are all texts if
    there is nothing to learn from (score 0 then).  Repeated rows get equal
    results; other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    picked = docs.select(F.col(key).cast("long").alias("k"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("t"))
    languages, windows, sizes, goal = _sample(picked, seed, sample_texts)
    net = Network(max(1, len(languages)), seed)
    if len(languages) > 1:
        net.fit(windows, sizes, goal, steps, seed)
    shared = spark.sparkContext.broadcast((net, languages))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, languages = shared.value
        for batch in small_batches(batches, "t", 2 << 20):
            texts = batch.column(1).to_pylist()
            letters = np.array([t is not None and any(map(str.isalpha, t)) for t in texts])
            if languages:
                prob, votes = pooled(net, *string_bytes(batch.column(1)), len(languages))
                best = prob.argmax(1)
                rows = np.arange(len(best))
                score = np.where(letters, prob[rows, best], 1.0)
                share = np.where(letters, votes[rows, best], 0.0)
                names = [languages[b] if ok else "und" for b, ok in zip(best, letters, strict=True)]
            else:
                score, share, names = np.where(letters, 0.0, 1.0), np.zeros(len(texts)), ["und"] * len(texts)
            columns = [batch.column(0), pa.array(names), pa.array(np.clip(score, 0, 1)), pa.array(share)]
            yield pa.record_batch(columns, names=["k", "lang_pred", "score", "share"])

    out = picked.select("k", "t").mapInArrow(scan, "k long, lang_pred string, score double, share double")
    return out.select(F.col("k").alias(key), (fold_of(F.col("k")) == 2).alias("held_out"), "lang_pred", "score", "share")
