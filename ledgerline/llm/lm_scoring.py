"""Language-model scores of whole texts by causal self-attention.

A text is its words, lower-cased in A-Z, each encoded with a space in front as
subword ids of a public vocabulary, then one end id.  A small attention model,
trained here in numpy, reads the last ``WINDOW`` ids and predicts the class of
the next; the probability of an id is that of its class times its share of the
class after the id before (backing off to the class before, then to all).

All training texts count: ids, their neighbours (which make the classes), words
and pairs of ids are summed over them, and the network is trained on every
window of all of them by rounds of local steps.  In a round every scan task
starts from the same parameters, makes Adam steps on its windows, and the tasks'
parameters are averaged, weighted by windows.  A seeded hash deals all blocks of
all texts to the rounds; a small corpus uses them several times.  A bounded
sample of texts chooses only where the rounds start from and which words are
summed in scan tasks, which no count depends on.

Every text is read and encoded once: its ids and the numbers of its words are
written, and counting, training and scoring read those.  Scores and gradients of
windows come from onnxruntime where it is installed (``attention_graph``), else
from numpy by the same formulas.

Texts are scored in windows that overlap by ``WINDOW - STRIDE`` ids: each id is
scored once, with at least that much context, by masked attention over many
windows at a time.

Beside it stands a unigram base over words, whose counts cover every training
text.  The counts of a bounded set of frequent words are summed in the scan tasks
and sent to all; any other word of a text is dealt once by its 64-bit hash, so
that its count and all texts that hold it meet, and once by text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from ledgerline.llm import attention_graph
from ledgerline.llm.texts import mix64, rank_encoder, small_batches, string_bytes, word_hashes, word_spans
from ledgerline.session import cut

WINDOW, STRIDE = 48, 32
WIDTH, HIDDEN, CLASSES = 16, 32, 128
#: Ids with an input vector and a column of their own.
OWN_IDS = 2000
#: Texts that choose frequent words and where training starts from; words whose
#: counts are summed in scan tasks, and the longest of them in bytes.
SAMPLE_TEXTS, FREQUENT, LONGEST = 4000, 200_000, 64
WINDOWS_A_TEXT, FIRST_STEPS, BATCH = 40, 1000, 96
#: Training: bytes of a block, the windows that a small corpus repeats itself to, the
#: most repeats, and the rounds.
BLOCK, LEAST_WINDOWS, MOST_REPEATS, ROUNDS = 2048, 400_000, 16, 4
#: Ids that are clustered at most, those whose neighbourhood counts, and the fewest occurrences.
CLUSTERED, NEIGHBOURS, LEAST_COUNT = 6000, 400, 5
#: Strength of the priors of an id's share: of the class before, and of all.
BACK_OFF, BACK_OFF_CLASS = 4.0, 40.0
BATCH_ROWS = 500

_ODD = re.compile(r"[^\S \n]")  # white space that may join a line feed's piece

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


@dataclass
class Vocabulary:
    """A public rank file: its place, its splitting pattern and its size."""

    path: str
    pattern: str
    size: int = 50_257  # with one free id, the last, that ends a text

    @property
    def end(self) -> int:
        return self.size - 1

    def model(self):
        return rank_encoder(self.path, self.pattern).model


def lowered(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = string_bytes(column)
    return _LOWER[data], offsets


class Lookup:
    """Row numbers of 64-bit keys: open addressing, probed a whole array at once."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(2 * max(1, len(keys))).bit_length())
        self.slots = np.full((1 << self.bits) + 64, -1, np.int64)
        self.keys = keys
        home = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        for i, at in enumerate(home.tolist()):
            while self.slots[at] >= 0:
                at += 1
            self.slots[at] = i

    def __call__(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), -1, np.int64)
        if not len(self.keys):
            return out
        at = (x >> np.uint64(64 - self.bits)).astype(np.int64)
        rows = np.arange(len(x))
        while len(rows):
            got = self.slots[at]
            hit = (got >= 0) & (self.keys[got] == x[rows])
            out[rows[hit]] = got[hit]
            go = (got >= 0) & ~hit
            rows, at = rows[go], at[go] + 1
        return out


def encode_words(model, strings: list[str], at_once: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all words in a row, ids of each); a word has a space in front.

    Words are encoded as the lines of one text, since pieces end at a line feed;
    a word with white space of its own (beyond ASCII) goes to the library alone.
    """
    (feed,) = model.encode_ordinary("\n")
    flat, sizes = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    for low in range(0, len(strings), at_once):
        part = strings[low : low + at_once]
        text = " " + "\n ".join(part)
        if _ODD.search(text):
            for word in part:
                ids = np.array(model.encode_ordinary(" " + word), np.int32)
                flat.append(ids)
                sizes.append(np.array([len(ids)]))
            continue
        ids = model.encode_to_numpy(text, disallowed_special=()).astype(np.int32)
        feeds = ids == feed
        ends = np.append(np.flatnonzero(feeds), len(ids))
        if len(ends) != len(part):
            raise AssertionError("the vocabulary merges over line feeds")
        flat.append(ids[~feeds])
        sizes.append(np.diff(ends, prepend=-1) - 1)
    return np.concatenate(flat), np.concatenate(sizes)


class FrequentWords:
    """Numbers of frequent words by hash, and their ids, so that only others are encoded."""

    def __init__(self, strings: list[str], model):
        self.strings = strings
        data, offsets = lowered(pa.array(strings, pa.string()))
        hashes, _ = word_hashes(data, offsets)
        self.find = Lookup(hashes)
        self.flat, self.sizes = encode_words(model, strings)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def __len__(self) -> int:
        return len(self.sizes)

    def ids(self, model, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in a row, ids of each) of words given by place and number (-1: not frequent)."""
        known = number >= 0
        sizes, first = np.zeros(len(number), np.int64), np.zeros(len(number), np.int64)
        sizes[known], first[known] = self.sizes[number[known]], self.starts[number[known]]
        flat, rare = self.flat, np.flatnonzero(~known)
        if len(rare):
            raw = data.tobytes()
            spans = zip(starts[rare].tolist(), ends[rare].tolist(), strict=True)
            more, n = encode_words(model, [raw[a:b].decode("utf-8", "replace") for a, b in spans])
            sizes[rare], first[rare] = n, len(flat) + np.cumsum(n) - n
            flat = np.concatenate([flat, more])
        total = np.cumsum(sizes)
        where = np.repeat(first - (total - sizes), sizes) + np.arange(total[-1] if len(total) else 0)
        return flat[where], sizes


def text_ids(words: FrequentWords, model, end: int, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple]:
    """(ids of all texts in a row, each with ``end``; ids of each; its words' hashes, offsets and numbers)."""
    starts, ends, _ = word_spans(data, offsets)
    hashes, at = word_hashes(data, offsets)
    number = words.find(hashes)
    flat, sizes = words.ids(model, data, starts, ends, number)
    before = np.concatenate([[0], np.cumsum(sizes)])[at]
    n = np.diff(before) + 1
    out = np.full(len(flat) + len(n), end, np.int32)
    inside = np.ones(len(out), bool)
    inside[np.cumsum(n) - 1] = False
    out[inside] = flat
    return out, n, (hashes, at, number)


# ---------------------------------------------------------------- the model


@dataclass
class AttentionModel:
    """One causal attention layer over ids, a hidden layer, and classes."""

    slot: np.ndarray  # input row of every id; also its column below
    group: np.ndarray  # class of every id
    share: np.ndarray  # log share of a slot within its class, by the slot of the id before
    within: np.ndarray  # log share of every id within its slot
    p: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def fresh(cls, slot: np.ndarray, group: np.ndarray, share: np.ndarray, within: np.ndarray, seed: int) -> AttentionModel:
        rng = np.random.default_rng(seed)
        rows, classes = int(slot.max()) + 1, int(group.max()) + 1

        def draw(*shape: int) -> np.ndarray:
            return (rng.normal(size=shape) / np.sqrt(shape[0] if len(shape) > 1 and shape[0] < 1000 else 4)).astype(np.float32)

        p = {
            "x": draw(rows, WIDTH), "q": draw(WIDTH, WIDTH), "k": draw(WIDTH, WIDTH), "v": draw(WIDTH, WIDTH),
            "near": np.zeros(WINDOW, np.float32), "xh": draw(rows, HIDDEN), "oh": draw(WIDTH, HIDDEN),
            "hc": draw(HIDDEN, classes) * np.float32(0.1), "c": np.zeros(classes, np.float32),
        }
        return cls(slot, group, share, within, p)

    #: Distance from query to key, for the last STRIDE of WINDOW positions.
    far = (np.arange(WINDOW - STRIDE, WINDOW)[:, None] - np.arange(WINDOW)[None, :]).astype(np.int64)

    def _bias(self) -> np.ndarray:
        return np.where(self.far >= 0, self.p["near"][np.maximum(self.far, 0)], np.float32(-1e9))

    def _forward(self, rows: np.ndarray, tables: tuple) -> tuple:
        q, k, v = tables[0][rows[:, WINDOW - STRIDE :]], tables[1][rows], tables[2][rows]
        a = np.matmul(q, k.transpose(0, 2, 1))
        a += tables[3]
        if not tables[4]:
            a -= a.max(2, keepdims=True)
        np.exp(a, out=a)
        total = a.sum(2, keepdims=True)
        o = np.matmul(a, v)
        o /= total
        h = o.reshape(-1, WIDTH) @ self.p["oh"]
        h += self.p["xh"][rows[:, WINDOW - STRIDE :].ravel()]
        np.tanh(h, out=h)
        logits = h @ self.p["hc"]
        logits += self.p["c"]
        return q, k, v, a, total, o, h, logits

    def tables(self) -> tuple:
        p = self.p
        q, k, bias = (p["x"] @ p["q"]) / np.float32(np.sqrt(WIDTH)), p["x"] @ p["k"], self._bias()
        # Scores and logits so small that no exponential can overflow are not shifted.
        most = float(np.linalg.norm(q, axis=1).max() * np.linalg.norm(k, axis=1).max() + np.abs(p["near"]).max())
        logit = float(np.abs(p["hc"]).sum(0).max() + np.abs(p["c"]).max())
        return q, k, p["x"] @ p["v"], bias, most < 60, logit < 60

    def log_probability(self, ids: np.ndarray, targets: np.ndarray, tables: tuple) -> np.ndarray:
        """Natural log of each target's probability; windows in, (n, STRIDE) out."""
        rows = self.slot[ids]
        logits = self._forward(rows, tables)[-1]
        if not tables[5]:
            logits -= logits.max(1, keepdims=True)
        flat = targets.ravel()
        own = logits[np.arange(len(flat)), self.group[flat]]
        np.exp(logits, out=logits)
        out = own - np.log(logits.sum(1))
        out += self.share[rows[:, WINDOW - STRIDE :].ravel(), self.slot[flat]]
        out += self.within[flat]
        return out.reshape(targets.shape)

    def step(self, windows: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean class loss of windows of WINDOW + 1 ids and its gradients; -1 is no id and no target."""
        p = self.p
        targets = windows[:, WINDOW - STRIDE + 1 :].ravel()
        rows = self.slot[np.where(windows[:, :WINDOW] < 0, len(self.slot) - 1, windows[:, :WINDOW])]
        tables = self.tables()
        q, k, v, a, total, o, h, logits = self._forward(rows, tables)
        a /= total
        real = targets >= 0
        goal = self.group[np.maximum(targets, 0)]
        if not tables[5]:
            logits -= logits.max(1, keepdims=True)
        n = np.arange(len(goal))
        own = logits[n, goal]
        d = np.exp(logits, out=logits)
        total = d.sum(1)
        many = max(1, int(real.sum()))
        loss = float(np.sum((np.log(total) - own) * real) / many)
        weight = (real / many).astype(np.float32)
        d *= (weight / total)[:, None]
        d[n, goal] -= weight
        g = {"hc": h.T @ d, "c": d.sum(0)}
        d = (d @ p["hc"].T) * (1 - h * h)
        last = rows[:, WINDOW - STRIDE :]
        count = len(p["x"])

        def scatter(where: np.ndarray, values: np.ndarray) -> np.ndarray:
            where = where.ravel()
            flat = values.reshape(len(where), -1)
            return np.stack([np.bincount(where, flat[:, j], count) for j in range(flat.shape[1])], 1).astype(np.float32)

        g["xh"] = scatter(last, d)
        g["oh"] = o.reshape(-1, WIDTH).T @ d
        do = (d @ p["oh"].T).reshape(o.shape)
        dv = np.matmul(a.transpose(0, 2, 1), do)
        da = np.matmul(do, v.transpose(0, 2, 1))
        da -= np.einsum("nij,nij->ni", da, a)[:, :, None]
        ds = np.multiply(da, a, out=da)
        seen = self.far >= 0
        g["near"] = np.bincount(self.far[seen], ds.sum(0)[seen], WINDOW).astype(np.float32)
        dq = np.matmul(ds, k) / np.float32(np.sqrt(WIDTH))
        dk = np.matmul(ds.transpose(0, 2, 1), q)
        x, xl = p["x"][rows].reshape(-1, WIDTH), p["x"][last].reshape(-1, WIDTH)
        dq, dk, dv = (z.reshape(-1, WIDTH) for z in (dq, dk, dv))
        g["q"], g["k"], g["v"] = xl.T @ dq, x.T @ dk, x.T @ dv
        g["x"] = scatter(rows, dk @ p["k"].T + dv @ p["v"].T) + scatter(last, dq @ p["q"].T)
        return loss, g


class Adam:
    """Moments of a model's parameters, and its steps."""

    def __init__(self, model: AttentionModel):
        self.t = 0
        self.flat, shapes = _flatten(model.p), model.p
        model.p = _unflatten(self.flat, shapes)  # views, which follow every step
        self.m, self.s, self.room = (np.zeros_like(self.flat) for _ in range(3))
        self.gradients = attention_graph.Gradients(model) if attention_graph.onnxruntime else lambda windows: model.step(windows)[1]

    def __call__(self, windows: np.ndarray, rate: float) -> None:
        g = _flatten(self.gradients(windows))
        self.t += 1
        rate *= min(1.0, self.t / 30)
        m, s, room = self.m, self.s, self.room
        m += np.multiply(np.subtract(g, m, out=room), np.float32(0.1), out=room)
        s += np.multiply(np.subtract(np.multiply(g, g, out=room), s, out=room), np.float32(0.01), out=room)
        np.sqrt(np.multiply(s, np.float32(1 / (1 - 0.99**self.t)), out=room), out=room)
        room += np.float32(1e-8)
        np.divide(m, room, out=room)
        room *= np.float32(rate / (1 - 0.9**self.t))
        self.flat -= room


def first_fit(model: AttentionModel, windows: np.ndarray, steps: int, seed: int, batch: int = BATCH) -> None:
    """Steps on seeded batches of a sample's windows, at a falling rate."""
    rng, adam = np.random.default_rng(seed), Adam(model)
    for t in range(steps):
        adam(windows[rng.integers(0, len(windows), batch)], 0.02 * 0.2 ** (t / steps))


def often_ids(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids that are clustered, ids that make their neighbourhoods), most frequent first."""
    order = np.argsort(-counts, kind="stable")
    return order[: min(CLUSTERED, int((counts >= LEAST_COUNT).sum()))], order[:NEIGHBOURS]


def group_ids(counts: np.ndarray, often: np.ndarray, features: np.ndarray, spaced: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(class, input row) of every id, from counts of ids and of neighbours.

    ``often`` ids are clustered by their neighbours on both sides, a row of
    ``features`` each; the others fall in eight classes by whether they start a
    word and by number.
    """
    size = len(counts)
    group = np.where(spaced, 0, 4) + np.arange(size) % 4
    if len(often) > CLASSES:
        features = np.sqrt(features.astype(np.float32))
        features /= np.linalg.norm(features, axis=1, keepdims=True) + 1e-6
        k = CLASSES - 8
        rng = np.random.default_rng(seed)
        centres = features[rng.choice(min(len(often), 1500), k, replace=False)]
        for _ in range(12):
            label = (features @ centres.T).argmax(1)
            for j in range(k):
                if (mine := label == j).any():
                    centre = features[mine].sum(0)
                    centres[j] = centre / (np.linalg.norm(centre) + 1e-6)
        group[often] = 8 + label
    group = np.unique(group, return_inverse=True)[1]  # no class is empty
    slot = OWN_IDS + group
    own = np.argsort(-counts, kind="stable")[:OWN_IDS]
    slot[own] = np.arange(len(own))
    return group.astype(np.int64), slot.astype(np.int64)


def shares(slot: np.ndarray, group: np.ndarray, counts: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log share of a slot in its class after a slot, log share of an id in its slot).

    ``pairs`` counts (slot before, slot); every id has half a count more.
    """
    soft = counts + 0.5
    rows, classes = len(pairs), int(group.max()) + 1
    of = np.zeros(rows, np.int64)
    of[slot] = group
    mass = np.bincount(slot, soft, rows)
    within = np.log(soft / mass[slot]).astype(np.float32)
    mass = np.maximum(mass, 1e-9)  # rows that no id has
    overall = mass / np.bincount(of, mass, classes)[of]

    def by_class(table: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(of, row, classes) for row in table])

    above = np.zeros((classes, rows))
    np.add.at(above, of, pairs)
    above = (above + BACK_OFF_CLASS * overall) / (by_class(above) + BACK_OFF_CLASS)[:, of]
    out = np.empty((rows, rows), np.float32)
    for low in range(0, rows, 256):
        part = pairs[low : low + 256]
        prior = above[of[low : low + 256]]
        out[low : low + 256] = np.log((part + BACK_OFF * prior) / (by_class(part) + BACK_OFF)[:, of])
    return out, within


def score_ids(model: AttentionModel, flat: np.ndarray, sizes: np.ndarray, end: int, at_once: int = 96, scorer: attention_graph.Scorer | None = None) -> np.ndarray:
    """log10 probability of every id; texts follow each other, ``sizes`` ids each; a ``scorer`` is the model's."""
    tables = None if scorer else model.tables()
    windows = -(-sizes // STRIDE)
    # Every text as WINDOW starts, its ids, and filling up to whole strides.
    room = WINDOW + windows * STRIDE
    first = np.cumsum(room) - room
    line = np.full(int(room.sum()) + WINDOW, end, np.int32)
    before = np.cumsum(sizes) - sizes
    line[np.repeat(first + WINDOW - before, sizes) + np.arange(len(flat))] = flat
    owner = np.repeat(np.arange(len(sizes)), windows)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    begin = first[owner] + number * STRIDE + STRIDE - 1
    out = np.empty(len(flat), np.float32)
    done = 0
    span, ahead = np.arange(WINDOW), np.arange(WINDOW - STRIDE + 1, WINDOW + 1)
    rows, goals = (model.slot[line], model.group[line]) if scorer else (line, line)
    for low in range(0, len(owner), at_once):
        part = slice(low, low + at_once)
        at = begin[part, None]
        got = scorer(rows[at + span], goals[at + ahead]) if scorer else model.log_probability(line[at + span], line[at + ahead], tables)
        real = got[number[part, None] * STRIDE + np.arange(STRIDE) < sizes[owner[part], None]]
        out[done : done + len(real)] = real
        done += len(real)
    if scorer:
        last = np.full(len(flat), end)
        last[1:] = flat[:-1]
        last[before[sizes > 0]] = end
        out += model.share[model.slot[last], model.slot[flat]] + model.within[flat]
    return out.astype(np.float64) / np.log(10)


def windows_of(ids: np.ndarray, begins: bool, ends: bool, end: int) -> np.ndarray:
    """(n, WINDOW + 1) ids that have every id of a run as a target once.

    A run that begins its text has WINDOW ends before it; one that doesn't uses
    its first ids as context only.  What lies beyond the run is -1.
    """
    line = np.concatenate([np.full(WINDOW * begins, end), ids, np.full(int(ends), end)])
    at = np.arange((STRIDE - 1) * begins, len(line) - (WINDOW - STRIDE + 1), STRIDE)
    line = np.append(line, np.full(STRIDE, -1))
    return line[at[:, None] + np.arange(WINDOW + 1)].astype(np.int32)


# ------------------------------------------------------------ over the corpus


def _is_training(key):
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(5)) != 1


def _windows(sample: DataFrame, vocabulary: Vocabulary, seed: int) -> np.ndarray:
    """Up to WINDOWS_A_TEXT windows of ids from seeded places of each text."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, none = vocabulary.model(), FrequentWords([], vocabulary.model())
        for batch in small_batches(batches, "t"):
            flat, sizes, _ = text_ids(none, model, vocabulary.end, *lowered(batch.column(1)))
            rows = []
            for key, ids in zip(batch.column(0).to_pylist(), np.split(flat, np.cumsum(sizes)[:-1]), strict=True):
                all_ = windows_of(ids, True, False, vocabulary.end)
                if len(all_) > WINDOWS_A_TEXT:
                    rng = np.random.default_rng([seed, abs(key or 0)])
                    all_ = all_[np.sort(rng.choice(len(all_), WINDOWS_A_TEXT, replace=False))]
                rows += all_.tolist()
            yield pa.record_batch([pa.array(rows, pa.list_(pa.int32()))], names=["w"])

    rows = sample.mapInArrow(scan, "w array<int>").toArrow().column(0).combine_chunks()
    flat = rows.flatten().to_numpy().reshape(len(rows), WINDOW + 1)
    return flat[np.lexsort(flat.T[::-1])]  # whatever order tasks ended in


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches, "t"):
        data, offsets = lowered(batch.column(1))
        starts, ends, _ = word_spans(data, offsets)
        hashes, _ = word_hashes(data, offsets)
        _, first, n = np.unique(hashes, return_index=True, return_counts=True)
        short = ends[first] - starts[first] <= LONGEST
        first, n = first[short], n[short]
        raw = data.tobytes()
        spans = zip(starts[first].tolist(), ends[first].tolist(), strict=True)
        yield pa.record_batch([pa.array([raw[a:b].decode() for a, b in spans], pa.string()), pa.array(n)], names=["word", "n"])


def _id_type(vocabulary: Vocabulary) -> type:
    return np.uint16 if vocabulary.size <= 1 << 16 else np.uint32


def _blobs(flat: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Bytes of the numbers of each text."""
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32) * np.int32(flat.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(flat))])


def _numbers(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of all texts in a row, n + 1 offsets) of what ``_blobs`` made."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]].view(kind), (at - at[0]) // np.dtype(kind).itemsize


def _encoded(docs: DataFrame, vocabulary: Vocabulary, words) -> DataFrame:
    """Texts with their ids and words, and the tasks' counts over training texts, in one table written once.

    A text (kind -1) has its key and n, the words and one end; ``ids`` of the
    vocabulary with an end; ``numbers`` of its frequent words; its other words
    by hash, with times.  A count n of kind 0 is of an id, of kind 1 of a
    frequent word, of kind 2 of words (key 0) and texts (key 1).
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, model = words.value, vocabulary.model()
        ids, frequent, totals = np.zeros(vocabulary.size, np.int64), np.zeros(len(known), np.int64), np.zeros(2, np.int64)
        row = TaskContext.get().partitionId() << 34
        for batch in small_batches(batches, "t"):
            many = batch.num_rows
            learnt = batch.column(2).to_numpy(zero_copy_only=False)
            flat, sizes, (hashes, at, number) = text_ids(known, model, vocabulary.end, *lowered(batch.column(1)))
            n_words = np.diff(at)
            owner = np.repeat(np.arange(many), n_words)
            easy = number >= 0
            ids += np.bincount(flat[np.repeat(learnt, sizes)], minlength=vocabulary.size)
            frequent += np.bincount(number[easy & learnt[owner]], minlength=len(known))
            totals += [n_words[learnt].sum(), learnt.sum()]
            rare, of = hashes[~easy], owner[~easy]
            order = np.lexsort((rare, of))
            rare, of = rare[order], of[order]
            new = np.ones(len(rare), bool)
            new[1:] = (rare[1:] != rare[:-1]) | (of[1:] != of[:-1])
            first = np.flatnonzero(new)
            times = np.diff(np.append(first, len(rare))).astype(np.int32)
            ends = np.concatenate([[0], np.cumsum(np.bincount(of[first], minlength=many))]).astype(np.int32)
            columns = [
                pa.array(np.full(many, -1, np.int32)), batch.column(0), pa.array(n_words + 1), pa.array(row + np.arange(many)), batch.column(2),
                _blobs(flat.astype(_id_type(vocabulary)), sizes), _blobs(number[easy].astype(np.uint32), np.bincount(owner[easy], minlength=many)),
                pa.ListArray.from_arrays(ends, pa.array(rare[first].view(np.int64))), pa.ListArray.from_arrays(ends, pa.array(times)),
            ]
            row += many
            yield pa.record_batch(columns, names=names)
        for kind, n in enumerate((ids, frequent, totals)):
            some = np.flatnonzero(n)
            columns = [pa.array(np.full(len(some), kind, np.int32)), pa.array(some), pa.array(n[some])]
            yield pa.record_batch([*columns, *(pa.nulls(len(some), t) for t in types)], names=names)

    names = ["kind", "key", "n", "row", "train", "ids", "numbers", "words", "times"]
    types = [pa.int64(), pa.bool_(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32())]
    schema = "kind int, key long, n long, row long, train boolean, ids binary, numbers binary, words array<long>, times array<int>"
    return cut(docs.select("k", "t", "train").mapInArrow(scan, schema), "encoded", "zstd")


def _totals(encoded: DataFrame, sizes: tuple[int, ...]) -> list[np.ndarray]:
    """Counts over all training texts: of ids, of frequent words, (words, texts)."""
    counted = encoded.filter("kind >= 0").groupBy("kind", "key").agg(F.sum("n").alias("n")).toArrow()
    kind, index, n = (counted.column(c).to_numpy() for c in ("kind", "key", "n"))
    out = [np.zeros(size, np.int64) for size in sizes]
    for k, into in enumerate(out):
        into[index[kind == k]] = n[kind == k]
    return out


def _id_blocks(batches: Iterator[pa.RecordBatch], kind: type, most: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(texts, their ids in a row, n + 1 offsets), ``most`` ids or one text at most; ids are the last column."""
    for batch in batches:
        flat, at = _numbers(batch.column(batch.num_columns - 1), kind)
        low = 0
        while low < batch.num_rows:
            high = max(low + 1, int(np.searchsorted(at, at[low] + most, "right")) - 1)
            yield batch.slice(low, high - low), flat[at[low] : at[high]], at[low : high + 1] - at[low]
            low = high


def _pair_counts(texts: DataFrame, vocabulary: Vocabulary, tables: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """Counts of pairs of an id and the one after it over all ``texts``' ids; a text begins after an end.

    A table maps the two ids to a row and a column.
    """
    shapes = [(int(a.max()) + 1, int(b.max()) + 1) for a, b in tables]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = [np.zeros(x * y, np.int64) for x, y in shapes]
        held, size = [np.array([vocabulary.end])], 0  # every text ends with the id that the next one begins after

        def count() -> None:
            flat = np.concatenate(held)
            for (row, column), counts in zip(tables, pairs, strict=True):
                y = int(column.max()) + 1
                counts += np.bincount(row[flat[:-1]] * y + column[flat[1:]], minlength=len(counts))
            held[:] = [flat[-1:]]

        for _, flat, _ in _id_blocks(batches, _id_type(vocabulary), 1 << 20):
            held.append(flat)
            size += len(flat)
            if size >= 1 << 21:
                count()
                size = 0
        count()
        for kind, n in enumerate(pairs):
            some = np.flatnonzero(n)
            yield pa.record_batch([pa.array(np.full(len(some), kind, np.int32)), pa.array(some), pa.array(n[some])], names=["kind", "key", "n"])

    counted = texts.select("ids").mapInArrow(scan, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")).toArrow()
    kind, index, n = (counted.column(c).to_numpy() for c in ("kind", "key", "n"))
    out = [np.zeros(x * y) for x, y in shapes]
    for k, into in enumerate(out):
        into[index[kind == k]] = n[kind == k]
    return [into.reshape(shape) for into, shape in zip(out, shapes, strict=True)]


def _neighbours(texts: DataFrame, vocabulary: Vocabulary, often: np.ndarray, top: np.ndarray) -> np.ndarray:
    """How often each of ``often`` follows and precedes each of ``top``, over all ``texts``."""
    row, column = np.full(vocabulary.size, len(often)), np.full(vocabulary.size, len(top))
    row[often], column[top] = np.arange(len(often)), np.arange(len(top))
    before, after = _pair_counts(texts, vocabulary, [(column, row), (row, column)])
    return np.concatenate([before[: len(top), : len(often)].T, after[: len(often), : len(top)]], 1)


def _flatten(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in sorted(p)])


def _unflatten(flat: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape).astype(np.float32, copy=False)
        at += like[k].size
    return out


def _picked_runs(keys: np.ndarray, data: np.ndarray, offsets: np.ndarray, part: tuple[int, int], of: int, seed: int, context: int = 0) -> tuple:
    """Blocks of BLOCK bytes whose hash modulo ``of`` is in ``part``: (data, offsets, begins, ends).

    Of bytes, a word belongs to the block in which it starts.  Of ids, each is
    one of its own, and ``context`` ids before a block come with it.
    """
    if data.dtype == np.uint8:
        (starts, _, at), size = word_spans(data, offsets), BLOCK
    else:
        starts, at, size = np.arange(len(data)), offsets, BLOCK // data.itemsize
    blocks = np.maximum(1, -(-np.diff(offsets) // size))
    owner = np.repeat(np.arange(len(blocks)), blocks)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    mixed = mix64(mix64(keys[owner] + np.uint64(seed)) + number.astype(np.uint64)) % np.uint64(of)
    take = np.flatnonzero((mixed >= part[0]) & (mixed < part[1]))
    owner, number = owner[take], number[take]
    low, high = offsets[owner] + number * size, offsets[owner] + (number + 1) * size
    a, b = np.searchsorted(starts, low), np.minimum(np.searchsorted(starts, high), at[owner + 1])
    bounds = np.append(starts, len(data))
    begin = np.where(a < b, np.maximum(bounds[a] - context, offsets[owner]), offsets[owner])
    stop = np.where(a < b, np.minimum(bounds[b], offsets[owner + 1]), begin)
    pieces = [data[x:y] for x, y in zip(begin.tolist(), stop.tolist(), strict=True)]
    out = np.concatenate([data[:0], *pieces])
    return out, np.concatenate([[0], np.cumsum(stop - begin)]).astype(np.int64), a == at[owner], b == at[owner + 1]


def _train_round(
    texts: DataFrame, vocabulary: Vocabulary, seed: int, model: AttentionModel, part: tuple[int, int], of: int, repeats: int, rate: float
) -> AttentionModel:
    """The average of the parameters that the scan tasks reach from ``model``'s, weighted by windows.

    ``texts`` are keys and ids.  Tasks' parameters (some 400 KB each) are summed by at most 64 tasks first.
    """
    spark = texts.sparkSession
    shared = spark.sparkContext.broadcast((model.slot, model.group, model.p))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot, group, p = shared.value
        own = AttentionModel(slot, group, None, None, {k: v.copy() for k, v in p.items()})
        adam, rng = Adam(own), np.random.default_rng(seed)
        held: list[np.ndarray] = []
        seen = 0

        def learn() -> None:
            nonlocal seen
            windows = np.concatenate(held)
            seen += len(windows)
            for _ in range(repeats):
                order = rng.permutation(len(windows))
                for low in range(0, len(order), BATCH):
                    adam(windows[order[low : low + BATCH]], rate)
            held.clear()

        for batch, flat, offsets in _id_blocks(batches, _id_type(vocabulary), 1 << 20):
            keys = batch.column(0).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            ids, offsets, begins, _ = _picked_runs(keys, flat, offsets, part, of, seed, WINDOW - STRIDE + 1)
            held += [windows_of(ids[a:b], x, False, vocabulary.end) for a, b, x in zip(offsets[:-1], offsets[1:], begins.tolist(), strict=True)]
            if sum(map(len, held)) >= 1 << 15:
                learn()
        if held:
            learn()
        if seen:
            yield pa.record_batch([pa.array([seen]), pa.array([(_flatten(own.p).astype(np.float64) * seen).tobytes()], pa.binary())], names=["n", "p"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, summed = 0, None
        for batch in batches:
            for many, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                one = np.frombuffer(blob, np.float64)
                n, summed = n + many, one if summed is None else summed + one
        if n:
            yield pa.record_batch([pa.array([n]), pa.array([summed.tobytes()], pa.binary())], names=["n", "p"])

    parts = texts.select("key", "ids").mapInArrow(scan, "n long, p binary").repartition(64).mapInArrow(total, "n long, p binary").toArrow()
    shared.unpersist()
    n = sum(parts.column("n").to_pylist())
    if not n:
        return model
    mean = sum(np.frombuffer(b, np.float64) for b in parts.column("p").to_pylist()) / n
    return AttentionModel(model.slot, model.group, model.share, model.within, _unflatten(mean, model.p))


def _first_model(spark, sample: np.ndarray, slot: np.ndarray, group: np.ndarray, steps: int, seed: int) -> dict[str, np.ndarray]:
    """Parameters after the first steps on the sample's windows, in one task (its BLAS has one thread)."""
    start = AttentionModel.fresh(slot, group, None, None, seed)
    if not len(sample) or not steps:
        return start.p
    shared = spark.sparkContext.broadcast((slot, group, sample))

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                slot, group, windows = shared.value
                model = AttentionModel.fresh(slot, group, None, None, seed)
                first_fit(model, windows, steps, seed)
                yield pa.record_batch([pa.array([_flatten(model.p).tobytes()], pa.binary())], names=["p"])

    blob = spark.range(1).mapInArrow(fit, "p binary").first()[0]
    return _unflatten(np.frombuffer(blob, np.float32), start.p)


def train(training: DataFrame, rows: int, vocabulary: Vocabulary, sample_texts: int, first_steps: int, least_windows: int, seed: int) -> tuple:
    """(model, counts of frequent words, words in training, training texts, the encoded texts).

    Where ``training`` has a column ``train``, texts without it are encoded
    like the others and nothing is learnt from them.
    """
    spark = training.sparkSession
    docs = training if "train" in training.columns else training.withColumn("train", F.lit(True))
    share = min(1.0, sample_texts / max(1, rows))
    sample = docs.filter(F.col("train") & (F.pmod(F.xxhash64(F.col("k"), F.lit(seed)), F.lit(1_000_000)) < int(share * 1_000_000))).select("k", "t")
    common = sample.mapInArrow(_count_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    strings = common.orderBy(F.desc("n"), "word").limit(FREQUENT).select("word").toArrow().column(0).to_pylist()
    ranks = vocabulary.model()
    words = spark.sparkContext.broadcast(FrequentWords(strings, ranks))
    spaced = np.array([ranks.decode_single_token_bytes(i)[:1] == b" " for i in range(vocabulary.size - 1)] + [False])
    encoded = _encoded(docs, vocabulary, words)
    ids, frequent, totals = _totals(encoded, (vocabulary.size, len(words.value), 2))
    texts = encoded.filter("kind = -1 and train")
    often, top = often_ids(ids)
    group, slot = group_ids(ids, often, _neighbours(texts, vocabulary, often, top), spaced, seed)
    (pairs,) = _pair_counts(texts, vocabulary, [(slot, slot)])
    table, within = shares(slot, group, ids, pairs)
    del pairs
    start = _first_model(spark, _windows(sample, vocabulary, seed), slot, group, first_steps, seed)
    model = AttentionModel(slot, group, table, within, start)
    # Every block is in one of the rounds; a small corpus repeats its blocks there.
    repeats = int(min(MOST_REPEATS, max(1, round(least_windows / max(1.0, ids.sum() / STRIDE)))))
    for number in range(ROUNDS if least_windows else 0):
        model = _train_round(texts, vocabulary, seed, model, (number, number + 1), ROUNDS, repeats, 0.008 * 0.5**number)
    return model, frequent, int(totals[0]), int(totals[1]), encoded


def score_texts(
    docs: DataFrame,
    vocabulary: Vocabulary,
    key: str = "doc_id",
    text: str = "text",
    sample_texts: int = SAMPLE_TEXTS,
    first_steps: int = FIRST_STEPS,
    least_windows: int = LEAST_WINDOWS,
    seed: int = 8,
) -> DataFrame:
    """Scores of every whole text of ``docs``, learnt from those not held out.

    Held out is a row whose crc32(key as text) mod 5 is 1; a null key counts as
    an empty string.  Returns key, held_out, n_tokens (words and one end),
    n_known, train_tokens, base_score and score, both log10; one row per row of
    ``docs``.  Null texts are empty: one end.  Rows that repeat are scored each
    and count each.  Other columns are ignored.  Without training texts the
    counts are 0 and the model is that of an untrained network; an empty table
    gives an empty result.

    ``score`` is the model's log10 probability of the text's ids.  Counts of ids,
    of pairs of ids and of words cover all training texts, and training uses all
    blocks of all of them (see the module).  ``sample_texts`` bounds the texts
    (by a hash of their key) that choose frequent words and where training
    starts from; ``first_steps`` and ``least_windows`` are 0 to train less in
    tests.
    """
    spark = docs.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    picked = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"))
    picked = picked.withColumn("train", _is_training(F.col("k")))
    model, frequent, n_words, n_texts, encoded = train(picked, docs.count(), vocabulary, sample_texts, first_steps, least_windows, seed)
    shared = spark.sparkContext.broadcast((model, np.log10(frequent + 0.5), frequent > 0))
    train_tokens = n_words + n_texts

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row a text: sums over its frequent words, and its score."""
        net, logs, counted = shared.value
        scorer = attention_graph.Scorer(net) if attention_graph.onnxruntime else None
        for batch, flat, at in _id_blocks(batches, _id_type(vocabulary), 1 << 19):
            scores = np.add.reduceat(score_ids(net, flat, np.diff(at), vocabulary.end, attention_graph.AT_ONCE if scorer else 96, scorer), at[:-1])
            many = batch.num_rows
            number, ends = _numbers(batch.column(4), np.uint32)
            owner = np.repeat(np.arange(many), np.diff(ends))
            sums = np.bincount(owner, logs[number], many)
            n_known = np.bincount(owner, counted[number], many).astype(np.int64)
            columns = [*batch.columns[:4], pa.array(n_known), pa.array(sums), pa.array(scores)]
            yield pa.record_batch(columns, names=["k", "row", "train", "n_tokens", "known", "logs", "score"])

    texts = encoded.filter("kind = -1")
    of_texts = texts.select("key", "row", "train", "n", "numbers", "ids")
    scored = of_texts.mapInArrow(score, "k long, row long, train boolean, n_tokens long, known long, logs double, score double")
    rare = texts.select("row", "train", F.inline(F.arrays_zip("words", "times")))
    each = Window.partitionBy("words")
    rare = rare.select(
        "row", "times", F.sum(F.when(F.col("train"), F.col("times")).otherwise(0)).over(each).alias("c"), (F.min("row").over(each) == F.col("row")).alias("first")
    )
    by_row = rare.groupBy(F.col("row").alias("_row")).agg(
        F.sum(F.col("times") * F.log10(F.col("c") + 0.5)).alias("rare_logs"),
        F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("rare_known"),
        F.sum(((F.col("c") > 0) & F.col("first")).cast("long")).alias("new"),
    )
    by_row = cut(by_row, "rare")
    distinct = by_row.agg(F.sum("new")).first()[0] or 0
    distinct += int((frequent > 0).sum()) + int(n_texts > 0)
    whole = scored.join(by_row, F.col("row") == F.col("_row"), "left")
    end_log, scale = float(np.log10(n_texts + 0.5)), float(np.log10(train_tokens + 0.5 * (distinct + 1)))
    return whole.select(
        F.col("k").alias(key),
        (~F.col("train")).alias("held_out"),
        "n_tokens",
        (F.col("known") + F.coalesce("rare_known", F.lit(0)) + F.lit(int(n_texts > 0))).cast("long").alias("n_known"),
        F.lit(train_tokens).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce("rare_logs", F.lit(0.0)) + F.lit(end_log) - F.col("n_tokens") * F.lit(scale)).alias("base_score"),
        "score",
    )
