"""Vectorised helpers on Arrow batches of texts: words, tokens, checksums."""

from __future__ import annotations

import itertools
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

#: Words are runs of anything but space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts in a row, n + 1 offsets); null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end) of every word, and n + 1 word offsets of the documents."""
    n = len(data)
    inside = ~_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begins = offsets[:-1][offsets[:-1] < n]
    first[begins] = inside[begins]  # a document's first byte starts a word of its own
    starts = np.flatnonzero(first)
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    ends_at = offsets[1:][offsets[1:] > 0] - 1
    last[ends_at] = inside[ends_at]
    ends = np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


#: Bytes hashed at once; it bounds the power tables and temporaries.
_BLOCK = 1 << 20


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, also: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit polynomial hash of every span of bytes, and a sum of ``also``'s numbers of its bytes (0 without)."""
    out, sums_of = np.empty(len(starts), np.uint64), np.zeros(len(starts), np.uint64)
    low = 0
    while low < len(starts):
        base = starts[low]
        high = max(low + 1, int(np.searchsorted(ends, base + _BLOCK, "right")))
        stop = ends[high - 1]
        up, down = _power_tables(max(_BLOCK + 1, int(stop - base) + 1))
        sums = np.zeros(stop - base + 1, np.uint64)
        np.cumsum((data[base:stop].astype(np.uint64) + np.uint64(1)) * up[: stop - base], out=sums[1:])
        s, e = starts[low:high] - base, ends[low:high] - base
        out[low:high] = mix64((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
        if also is not None:
            np.cumsum(also[data[base:stop]], out=sums[1:])
            sums_of[low:high] = sums[e] - sums[s]
        low = high
    return out, sums_of


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit polynomial hash of every word, and word offsets of documents."""
    starts, ends, docs = word_spans(data, offsets)
    return span_hashes(data, starts, ends)[0], docs


def crc32_of_ids(ids: np.ndarray) -> int:
    """Unsigned CRC-32 of the ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())


class Remembered:
    """Numbers of 64-bit keys in the order in which they came: open addressing, a whole array at once."""

    def __init__(self):
        self.keys = np.zeros(0, np.uint64)
        self._grow(12)

    def _grow(self, bits: int) -> None:
        self.bits = bits
        self.slots = np.full((1 << bits) + 256, -1, np.int32)
        self._place(np.arange(len(self.keys)))

    def _place(self, rows: np.ndarray) -> None:
        at = (self.keys[rows] >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(rows):
            free = self.slots[at] < 0
            self.slots[at[free]] = rows[free]  # of several for one slot, one stays
            lost = self.slots[at] != rows
            rows, at = rows[lost], at[lost] + 1
            if len(at) and int(at.max()) >= len(self.slots):
                self._grow(self.bits + 1)
                return

    def add(self, keys: np.ndarray) -> None:
        """Distinct keys that are not there."""
        first = len(self.keys)
        self.keys = np.concatenate([self.keys, keys])
        if 2 * len(self.keys) > 1 << self.bits:
            self._grow(int(4 * len(self.keys)).bit_length())
        else:
            self._place(np.arange(first, len(self.keys)))

    def find(self, x: np.ndarray) -> np.ndarray:
        """The number of every key, or -1."""
        at = (x >> np.uint64(64 - self.bits)).astype(np.int64)
        out = self.slots[at]
        rows = np.flatnonzero((out >= 0) & (self.keys[np.maximum(out, 0)] != x)) if len(self.keys) else np.zeros(0, np.int64)
        at = at[rows] + 1
        while len(rows):
            got = self.slots[at]
            out[rows] = got
            go = (got >= 0) & (self.keys[np.maximum(got, 0)] != x[rows])
            rows, at = rows[go], at[go] + 1
        return out


class ChunkEncoder:
    """Byte-level BPE ids of whole texts, remembering the ids of chunks.

    The vocabulary's pre-tokeniser starts a new piece at a single space or line
    feed between two non-spaces, a line feed there is a piece of its own, and
    merges never cross pieces.  So a text whose white space is single spaces and
    line feeds has the ids of its chunks, where each chunk is a word with the
    one character before it; all other texts go to the library whole.  New
    chunks are encoded as the lines of one text.

    Chunks are remembered by a 64-bit hash and told apart by a second one, so
    two chunks would have to agree in 128 bits to be taken for each other; one
    that agrees in the first alone is encoded anew each time.  ``encode`` maps a
    list of strings to lists of ids; ``limit`` bounds the chunks that are
    remembered (about 50 bytes each): beyond it all are forgotten.
    """

    # What may be white space, or no text for the chunks: bytes to look at closely.
    _look = np.zeros(256, bool)
    _look[[0x00, 0x09, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3]] = True
    _odd = re.compile(r"[^\S \n]|\0")
    _second = np.random.default_rng(17).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
    _LINE = np.uint64(0x9D39247E33776D41)  # sets "\nword" apart from " word"

    def __init__(self, encode, limit: int = 2_000_000):
        self.encode, self.limit = encode, limit
        (self.feed,) = encode(["\n"])[0]
        self._clear()

    def _clear(self) -> None:
        """Two chunks are always known: a lone space and a lone line feed, which end texts."""
        space = np.array(self.encode([" "])[0], np.uint16)
        self.known = Remembered()
        self.known.add(np.array([1, 2], np.uint64))
        self.checks = np.zeros(2, np.uint64)
        self.flat = np.concatenate([space, [self.feed]]).astype(np.uint16)
        self.sizes, self.starts = np.array([len(space), 1], np.int32), np.array([0, len(space)], np.int32)

    def _new_ids(self, words: list[str], line: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, size and start of each) of words after a line feed (which is theirs) or a space."""
        flat, sizes, order = [np.zeros(0, np.uint16)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        # Some dozens of chunks a text: longer texts leave the encoder's caches.
        for kind in (True, False):
            rows = np.flatnonzero(line == kind)
            lines = [words[i] for i in rows.tolist()]
            parts = [lines[i : i + 50] for i in range(0, len(lines), 50)]
            texts = ["\n" + "\n".join(p) if kind else " " + "\n ".join(p) for p in parts]
            for part, got in zip(parts, self.encode(texts) if texts else [], strict=True):
                ids = np.array(got, np.uint16)
                feeds = ids == self.feed
                at = np.flatnonzero(feeds)
                if kind:
                    size = np.diff(np.append(at, len(ids)))
                else:
                    size, ids = np.diff(np.concatenate([[-1], at, [len(ids)]])) - 1, ids[~feeds]
                if len(size) != len(part):
                    raise AssertionError("the vocabulary merges over line feeds")
                flat.append(ids)
                sizes.append(size)
            order.append(rows)
        size, place = np.concatenate(sizes), np.argsort(np.concatenate(order), kind="stable")
        return np.concatenate(flat), size[place], (np.cumsum(size) - size)[place]

    def _numbers(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, line: np.ndarray) -> np.ndarray:
        """The number of every chunk; new ones are learnt, and get numbers after all known ones."""
        keys, checks = span_hashes(data, starts, ends, self._second)
        keys = np.where(line, mix64(keys ^ self._LINE), keys)
        number = self.known.find(keys)
        own = (number >= 0) & (self.checks[np.maximum(number, 0)] == checks)
        missing = np.flatnonzero(~own)
        if len(missing):
            pairs = np.stack([keys[missing], checks[missing]], 1)
            order = np.lexsort((pairs[:, 1], pairs[:, 0]))
            pairs = pairs[order]
            fresh = np.ones(len(pairs), bool)
            fresh[1:] = (pairs[1:] != pairs[:-1]).any(1)
            first = missing[order[fresh]]
            spans = zip(starts[first].tolist(), ends[first].tolist(), strict=True)
            raw = data.tobytes()
            flat, sizes, begin = self._new_ids([raw[a:b].decode("utf-8", "replace") for a, b in spans], line[first])
            base = len(self.sizes)
            number[missing[order]] = base + np.cumsum(fresh) - 1
            self.starts = np.concatenate([self.starts, (begin + len(self.flat)).astype(np.int32)])
            self.flat = np.concatenate([self.flat, flat])
            self.sizes = np.concatenate([self.sizes, sizes.astype(np.int32)])
            self.checks = np.concatenate([self.checks, checks[first]])
            # A key that another chunk has already stays with that one; this one's row gets a key that nothing has.
            mine = keys[first].copy()
            taken = self.known.find(mine) >= 0
            taken[1:] |= mine[1:] == mine[:-1]
            mine[taken] = mix64(mine[taken] ^ checks[first][taken])
            self.known.add(mine)
        return number

    def _whole(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Numbers of the texts that the library must see whole."""
        space = (data == 0x20) | (data == 0x0A)
        pairs = np.flatnonzero(space[1:] & space[:-1]) + 1 if len(data) else np.zeros(0, np.int64)
        marks = np.flatnonzero((data[:-1] == 0x3C) & (data[1:] == 0x7C)) if len(data) else np.zeros(0, np.int64)
        # A pair over the border of two texts is none.
        pairs = pairs[offsets[np.searchsorted(offsets, pairs, "right") - 1] != pairs]
        found = [np.searchsorted(offsets, np.concatenate([pairs, marks]), "right") - 1]
        close = np.flatnonzero(self._look[data])
        if len(close):
            texts = np.unique(np.searchsorted(offsets, close, "right") - 1)
            raw = data.tobytes()
            found.append(np.array([i for i in texts.tolist() if self._odd.search(raw[offsets[i] : offsets[i + 1]].decode("utf-8", "replace"))], np.int64))
        return np.unique(np.concatenate(found))

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        """Ids (unsigned 16-bit) of every text."""
        if not texts:
            return []
        if len(self.sizes) > self.limit:
            self._clear()
        data, offsets = string_bytes(pa.array(texts, pa.large_string()))
        odd = self._whole(data, offsets)
        if len(odd):
            out: list = [None] * len(texts)
            for i, got in zip(odd.tolist(), self.encode([texts[i] for i in odd.tolist()]), strict=True):
                out[i] = np.asarray(got, np.uint16)
            rest = [i for i, done in enumerate(out) if done is None]
            for i, got in zip(rest, self([texts[i] for i in rest]), strict=True):
                out[i] = got
            return out
        starts, ends, at = word_spans(data, offsets)
        begins = np.zeros(len(starts), bool)  # words that begin their text
        heads = at[:-1][np.diff(at) > 0]
        begins[heads] = starts[heads] == offsets[:-1][np.diff(at) > 0]
        line = begins | (data[np.maximum(starts - 1, 0)] == 0x0A)
        number = self._numbers(data, starts, ends, line)
        sizes, first = self.sizes[number], self.starts[number]
        # A text's first word was given a line feed, which goes again.
        sizes, first = sizes - begins, first + begins
        last = np.zeros(len(texts), np.uint8)
        some = np.diff(offsets) > 0
        last[some] = data[offsets[1:][some] - 1]
        tails = np.flatnonzero((last == 0x20) | (last == 0x0A))
        if len(tails):
            lone = (last[tails] == 0x0A).astype(np.int64)
            sizes, first = np.insert(sizes, at[1:][tails], self.sizes[lone]), np.insert(first, at[1:][tails], self.starts[lone])
            more = np.zeros(len(texts) + 1, np.int64)
            more[tails + 1] = 1
            at = at + np.cumsum(more)
        total = np.zeros(len(sizes) + 1, np.int64)
        np.cumsum(sizes, out=total[1:])
        where = np.repeat(first - total[:-1], sizes) + np.arange(total[-1])
        ids = self.flat[where]
        return [ids[a:b] for a, b in itertools.pairwise(total[at].tolist())]


_encoders: dict[tuple[str, str], ChunkEncoder] = {}


def bpe_encoder(path: str, limit: int = 2_000_000) -> ChunkEncoder:
    """One encoder a process for a ``tokenizers`` vocabulary file.

    Strings of special tokens within a text are ordinary text.
    """
    if (key := ("tokenizers", path)) not in _encoders:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(path)
        model.encode_special_tokens = True
        if model.get_vocab_size() > 1 << 16:
            raise ValueError("ids must fit in 16 bits")
        _encoders[key] = ChunkEncoder(
            lambda texts: [e.ids for e in model.encode_batch_fast(texts, add_special_tokens=False)]
        )
    _encoders[key].limit = limit
    return _encoders[key]


def rank_encoder(path: str, pattern: str) -> ChunkEncoder:
    """One encoder a process for a ``tiktoken`` rank file."""
    if (key := ("tiktoken", path)) not in _encoders:
        import base64

        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        model = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        _encoders[key] = ChunkEncoder(lambda texts: [model.encode_ordinary(t) for t in texts])
        _encoders[key].model = model
    return _encoders[key]


def small_batches(batches: Iterable[pa.RecordBatch], column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of one hold about ``most`` bytes at most."""
    for batch in batches:
        _, offsets = string_bytes(batch.column(column))
        low = 0
        while low < batch.num_rows:
            high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + most, "right")) - 1)
            yield batch.slice(low, high - low)
            low = high


def whole_groups(batches: Iterable[pa.RecordBatch], key: list[str], least: int = 16 << 20) -> Iterator[pa.Table]:
    """Tables of whole groups from batches sorted by ``key``.

    A table holds about ``least`` bytes unless the input ends; memory is that, a
    batch and the largest group.
    """
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.get_total_buffer_size()
        if size < least:
            continue
        table = pa.Table.from_batches(held)
        change = group_starts(table, key)
        if len(change) > 1:
            at = int(change[-1])
            yield table.slice(0, at)
            # A copy of the rest, so that the buffers of what is done go.
            rest = table.slice(at).take(pa.array(np.arange(table.num_rows - at)))
            held = rest.to_batches()
            size = rest.get_total_buffer_size()
    if held:
        yield pa.Table.from_batches(held)


def group_starts(table: pa.Table, key: list[str]) -> np.ndarray:
    """Row numbers at which a new group starts; keys are non-null numbers."""
    change = np.zeros(table.num_rows, bool)
    if table.num_rows:
        change[0] = True
    for name in key:
        values = table.column(name).to_numpy()
        change[1:] |= values[1:] != values[:-1]
    return np.flatnonzero(change)
