import os
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from ledgerline.llm import packing, texts, token_store

public_tokenizers = pytest.importorskip("public_tokenizers")
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, other string"


def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(VOCABULARY)
    t.encode_special_tokens = True
    return t


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab éß.,! \n\t\r\0  <|>1'", max_size=40), max_size=6))
def test_chunked_encoding_is_the_librarys(parts):
    parts = [*parts, "a <|endoftext|> b", "end ", " start", "x\n", "\ny"]
    got = texts.bpe_encoder(VOCABULARY)(parts)
    assert [g.tolist() for g in got] == [reference().encode(p, add_special_tokens=False).ids for p in parts]


def test_encoder_forgets_and_goes_on():
    encoder = texts.ChunkEncoder(texts.bpe_encoder(VOCABULARY).encode, limit=3)
    for text in ("one two three", "four five six", "one six"):
        assert encoder([text])[0].tolist() == reference().encode(text, add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab é \n\t\x1c ", max_size=30), max_size=8))
def test_word_hashes_follow_words(parts):
    hashes, at = texts.word_hashes(*texts.string_bytes(pa.array(parts, pa.string())))
    words = [re.findall(texts.WORD, p) for p in parts]
    assert np.diff(at).tolist() == [len(w) for w in words]
    flat = [w for ws in words for w in ws]
    assert len(set(flat)) == len({(w, h) for w, h in zip(flat, hashes.tolist(), strict=True)}) == len(set(hashes.tolist()))


def test_hashes_do_not_depend_on_blocks(monkeypatch):
    data, offsets = texts.string_bytes(pa.array(["lorem ipsum dolor " * 50, None, "", "sit amet"]))
    whole = texts.word_hashes(data, offsets)[0]
    monkeypatch.setattr(texts, "_BLOCK", 16)
    assert (texts.word_hashes(data, offsets)[0] == whole).all()


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 1 << 45), max_size=700).map(sorted))
def test_elias_fano_round_trip(values):
    code = token_store.EliasFano.encode(np.array(values, np.uint64))
    back, _ = token_store.EliasFano.from_bytes(memoryview(code.to_bytes()), 0)
    assert [x for b in range(len(back.samples)) for x in back.block(b).tolist()] == values
    assert [back.select(k) for k in range(0, len(values), 37)] == values[::37]


def test_elias_fano_is_small():
    values = np.arange(0, 10_000 * 700, 700, dtype=np.uint64)
    assert len(token_store.EliasFano.encode(values).to_bytes()) < 10_000 * 12 / 8 + 400


def test_segments_give_single_documents():
    ids = [np.array(x, np.uint16) for x in ([5, 0], [0], [7] * 300 + [0])]
    segment = token_store.Segment(memoryview(token_store.pack_segment([None, -4, 9], ids)))
    assert [(k, a, x.tolist()) for k, a, x in segment.documents()] == [(None, 0, [5, 0]), (-4, 2, [0]), (9, 3, ids[2].tolist())]
    assert list(segment.find(9)) == [2] and list(segment.find(None)) == [0] and list(segment.find(4)) == []
    for k, key in enumerate((None, -4, 9)):
        name, start, got = segment.document(k)
        assert name == key and got.tolist() == ids[k].tolist() and start == sum(map(len, ids[:k]))


ROWS = [(3, "hello world", "x"), (1, None, None), (None, "no key", "x"), (2, "", "x"), (2, "tie\n\ntwo", "x"), (9, "long " * 3000, "x"), (-7, "é", "x")]


def test_token_files(spark, tmp_path):
    docs = spark.createDataFrame(ROWS, DOCS)
    path = f"file://{tmp_path}/out"
    rows = [tuple(r) for r in token_store.token_store(docs, VOCABULARY, path).collect()]
    want = {}
    for key, text, _ in ROWS:
        ids = reference().encode(text or "", add_special_tokens=False).ids + [0]
        want.setdefault(key, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    rows.sort(key=lambda r: r[1])
    assert [r[0] for r in rows] == [None, -7, 1, 2, 2, 3, 9]
    assert [r[1] for r in rows] == np.cumsum([0, *(r[2] for r in rows[:-1])]).tolist()
    assert all(tuple(r[2:]) in want[r[0]] for r in rows)
    assert any(name.startswith("part-") for name in os.listdir(tmp_path / "out"))
    assert token_store.token_store(docs.limit(0), VOCABULARY).count() == 0
    some = sorted((r["doc_id"], len(r["token_ids"])) for r in token_store.read_documents(spark, path, [2, 9, 77]).collect())
    assert some == sorted((k, n) for k in (2, 9) for n, _ in want[k]) and token_store.read_documents(spark, path, []).count() == 0


def test_many_segments_a_file(spark, tmp_path, monkeypatch):
    """Texts longer than a segment, clashing column names and a broadcast that is too long."""
    monkeypatch.setattr(token_store, "SEGMENT_IDS", 50)
    rows = [(i, f"word{i} " * (i % 40), "x", 1, 2) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, segment string, file int, ids int").repartition(3)
    for limit in (500_000, 1):
        monkeypatch.setattr(token_store, "BROADCAST_SEGMENTS", limit)
        got = sorted(map(tuple, token_store.token_store(docs, VOCABULARY, f"file://{tmp_path}/s{limit}").collect()))
        ids = [[*reference().encode(t, add_special_tokens=False).ids, 0] for _, t, *_ in rows]
        starts = np.cumsum([0, *map(len, ids)])[:-1].tolist()
        assert got == [(i, a, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, (a, x) in enumerate(zip(starts, ids, strict=True))]


def test_packing_covers_every_document(spark):
    docs = spark.createDataFrame(ROWS, DOCS)
    rows = packing.pack(docs, VOCABULARY, packing.Capacity(tokens=64)).collect()
    by_bin = {}
    for r in rows:
        by_bin.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in by_bin.values():
        spans.sort()
        assert [o for o, _ in spans] == np.cumsum([0, *(n for _, n in spans[:-1])]).tolist() and sum(n for _, n in spans) <= 64
    long = sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows if r["doc_id"] == 9)
    ids = np.array(reference().encode("long " * 3000, add_special_tokens=False).ids + [0], "<u4")
    assert [p[2] for p in long[1:]] == [64] * (len(long) - 1) and sum(p[2] for p in long) == len(ids)
    assert all(zlib.crc32(ids[s : s + n].tobytes()) == c for _, s, n, c in long)
    assert len(rows) == len(long) + len(ROWS) - 1
    assert packing.pack(docs.limit(0), VOCABULARY).count() == 0


def test_packing_of_clashing_names_and_equal_ids(spark):
    """Columns of the operator's own names are ignored; equal and missing ids spread over tasks, each row packed."""
    rows = [(None if i % 2 else 5, "a b c", 1, 2, 3, 4) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, k int, t int, length int, sequence_id int").repartition(2)
    pieces = packing.cut_pieces(docs, VOCABULARY, 16)
    got = packing.best_fit(pieces, packing.Capacity(tokens=16), task_pieces=30).collect()
    assert Counter(r["doc_id"] for r in got) == Counter({None: 150, 5: 150})
    by_bin = {}
    for r in got:
        by_bin.setdefault(r["sequence_id"], []).append(r["offset"])
    assert all(sorted(v) == list(range(0, 4 * len(v), 4)) and len(v) <= 4 for v in by_bin.values())
    assert len(by_bin) <= 75 + 10 and len({k // 2 % 10 for k in by_bin}) > 5  # ten tasks, most of them used


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=120), st.sampled_from(["norm", "dot"]), st.one_of(st.none(), st.integers(1, 6)), st.one_of(st.none(), st.integers(10_000, 12_000)))
def test_every_constraint_holds(lengths, score, documents, attention):
    sizes = np.array(lengths, np.int64)
    bins, offsets, count = packing.pack_lengths(sizes, packing.Capacity(100, documents, attention, score=score))
    for b in range(count):
        mine = np.flatnonzero(bins == b)
        assert sizes[mine].sum() <= 100 and len(mine) <= (documents or 999) and (sizes[mine] ** 2).sum() <= (attention or 10**9)
        order = mine[np.argsort(offsets[mine])]
        assert offsets[order].tolist() == np.cumsum([0, *sizes[order][:-1]]).tolist()
    if score == "norm" and documents is None and attention is None:
        assert count <= 1.25 * -(-int(sizes.sum()) // 100) + 1


def test_too_long_is_an_error():
    with pytest.raises(ValueError):
        packing.pack_lengths(np.array([101]), packing.Capacity(100))


def test_queries_pack_by_three_capacities(monkeypatch):
    """What the query hands over bounds documents and attention, and the score uses them."""
    import corpus_pipeline
    from ledgerline.llm import queries

    handed = []
    for module in (queries, corpus_pipeline):
        monkeypatch.setattr(module, "pack", lambda docs, vocabulary, capacity=packing.Capacity(): handed.append(capacity))
    monkeypatch.setattr(queries, "table", lambda *a: None)
    queries.op10_packing(None, "")
    corpus_pipeline.packed(None, None, "")
    assert [(c.tokens, c.documents, c.attention) for c in handed] == [(2048, 2048, 2048 * 2048)] * 2
    capacity = packing.Capacity(100, 100, 10_000)
    sizes = np.random.default_rng(2).integers(1, 100, 400)
    bins, _, count = packing.pack_lengths(sizes, capacity)
    left: list[list[int]] = []  # brute force: the smallest weighted norm
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fits = [b for b in left if b[0] >= size and b[1] >= 1 and b[2] >= size * size]
        norm = {id(b): ((b[0] - size) / 100) ** 2 + 0.25 * ((b[1] - 1) / 100) ** 2 + 0.25 * ((b[2] - size * size) / 10_000) ** 2 for b in fits}
        mine = next((b for b in left if b[3] == bins[i]), None)
        if fits:
            assert norm[id(mine)] <= min(norm.values()) + 1e-12
        else:
            assert mine is None
            mine = [100, 100, 10_000, bins[i]]
            left.append(mine)
        mine[0], mine[1], mine[2] = mine[0] - size, mine[1] - 1, mine[2] - size * size
    assert count == len(left)
