import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import blocks, exact_dedup as e, jaccard, nn_descent

DOCS = "doc_id long, text string, keep_id string, size string"
TEXTS = [
    (4, "a  b\tc"), (2, "a b c"), (9, "a b c "), (1, None), (3, ""), (5, " "), (6, "\n\t"), (7, "x" * 50_000), (8, "x" * 50_000), (8, "x" * 50_000), (None, "a b c"), (None, "alone"), (None, "alone"), (10, "é"), (11, "a\x1cb"),
]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "clash", "clash") for i, t in rows], DOCS)


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    out = Counter()
    for text, ids in groups.items():
        some = [i for i in ids if i is not None]
        keep = min(some) if some else None
        done = False
        for i in sorted(ids, key=lambda x: (x is None, x or 0)):
            out[i, keep, len(ids), i == keep and not done, hashlib.sha256(text.encode()).hexdigest()] += 1
            done = done or i == keep
    return out


@pytest.mark.parametrize(("bits", "memtable"), [(256, 500_000), (8, 4)])
def test_exact(spark, bits, memtable):
    rows = TEXTS + [(100 + i, f"text {i % 300}") for i in range(900)]
    got = e.exact_dedup(frame(spark, rows).repartition(5), digest_bits=bits, memtable=memtable).collect()
    assert Counter(map(tuple, got)) == brute(rows)


def test_exact_hot_groups(spark, monkeypatch):
    monkeypatch.setattr(e, "HOT", 10)
    rows = [(i, "hot" if i % 3 == 0 else f"t{i}") for i in range(400)]
    for limit, hot in ((1_000_000, 100), (8, 100), (1_000_000, 0)):
        assert Counter(map(tuple, e.exact_dedup(frame(spark, rows), broadcast_ids=limit, hot_texts=hot).collect())) == brute(rows)


def test_exact_verifies_rows_without_ids(spark):
    """Eight bits of a digest put many texts together; rows without an id are told apart as well."""
    rows = [(None, f"text {i % 50}") for i in range(120)] + [(i, f"text {i}") for i in range(40, 60)] + [(None, None), (None, "")]
    for bits in (8, 256):
        assert Counter(map(tuple, e.exact_dedup(frame(spark, rows).repartition(3), digest_bits=bits).collect())) == brute(rows)


def test_levels_of_many_runs(spark):
    """More runs than merge at once: several levels."""
    rows = [(i, f"text {i % 700}") for i in range(2000)]
    keyed = e.digests(frame(spark, rows).repartition(4))
    hits = e.compact(e.flush_runs(keyed, 2, memtable=40), 32, fan_in=3).collect()
    want = {}
    for i, t in rows:
        want.setdefault(hashlib.sha256(t.encode()).digest(), []).append(i)
    assert {bytes(h["digest"]): (h["keep_id"], h["group_size"], h["ties"]) for h in hits} == {d: (min(v), len(v), 1) for d, v in want.items() if len(v) > 1}


def test_exact_empty(spark):
    assert e.exact_dedup(frame(spark, TEXTS).limit(0)).count() == 0


def test_filters_never_miss():
    lanes = np.random.default_rng(0).integers(0, 1 << 63, (2000, 4), np.uint64)
    blob = e.bloom(lanes[:1000])
    assert e.may_hold(blob, lanes[:1000]).all() and e.may_hold(blob, lanes[1000:]).mean() < 0.05


def shingles(text, n=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return frozenset(tuple(w[j : j + n]) for j in range(max(1, len(w) - n + 1))) if w else frozenset()


def near(rows, threshold=0.8):
    sets = [shingles(t) for _, t in rows]
    link = [[i != j and bool(a) and bool(b) and len(a & b) / len(a | b) >= threshold for j, b in enumerate(sets)] for i, a in enumerate(sets)]
    root = list(range(len(rows)))
    for _ in rows:
        root = [min([root[i], *(root[j] for j in range(len(rows)) if link[i][j])]) for i in range(len(rows))]
    lowest = {}
    for i, (key, _) in enumerate(rows):
        lowest[root[i]] = min(lowest.get(root[i], key), key)
    return {key: (lowest[root[i]], sum(link[i])) for i, (key, _) in enumerate(rows)}


def near_rows():
    rng = np.random.default_rng(3)
    rows, key = [], 0
    for group in range(12):
        base = [f"w{group}_{i}" for i in range(int(rng.integers(30, 90)))]
        for _ in range(6):
            words = list(base)
            for at in rng.integers(0, len(words), int(rng.integers(0, 3))):
                words[at] = f"z{rng.integers(1000)}"
            rows.append((key := key + 1, " ".join(words)))
    shared = " ".join(f"p{i}" for i in range(60))
    rows += [(500 + i, f"{shared} own{i} " + " ".join(f"q{i}_{j}" for j in range(12 + i % 9))) for i in range(40)]
    return rows + [(900, "one two"), (901, "one two"), (902, "one two three"), (903, ""), (904, None), (905, "one"), (906, "a a a a a a a"), (907, "a a a a a")]


@pytest.mark.parametrize("block", [256, 4])
def test_near_against_all_pairs(spark, block):
    rows = near_rows()
    got = jaccard.similarity_classes(frame(spark, rows).repartition(3), block=block, broadcast_rows=10**6 if block > 4 else 1).collect()
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in got} == near(rows)
    assert sum(r["kept"] for r in got) == len({r["class_id"] for r in got})


def test_near_odd_rows(spark):
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (None, "a b c d e f g"), (None, "only here " * 5), (2, None), (2, None)]
    got = Counter(map(tuple, jaccard.similarity_classes(frame(spark, rows)).collect()))
    assert got == Counter([(1, 1, 2, True), (1, 1, 2, False), (None, 1, 2, False), (None, None, 0, True), (2, 2, 0, True), (2, 2, 0, True)])
    assert jaccard.similarity_classes(frame(spark, rows).limit(0)).count() == 0


def test_near_rows_without_keys_are_linked(spark):
    base = " ".join(f"w{i}" for i in range(40))
    rows = [(None, base), (None, base + " tail"), (None, base + " tail"), (7, base + " end"), (None, "other " * 9), (None, " ".join(f"x{i}" for i in range(40))), (None, " ".join(f"x{i}" for i in range(41)))]
    got = Counter(map(tuple, jaccard.similarity_classes(frame(spark, rows).repartition(3)).collect()))
    assert got == Counter({(None, 7, 3, False): 3, (7, 7, 3, True): 1, (None, None, 0, True): 1, (None, None, 1, True): 1, (None, None, 1, False): 1})


def test_sets_of_one_hash_are_told_apart(spark, monkeypatch):
    real = jaccard._sets
    monkeypatch.setattr(jaccard, "_sets", lambda *a: (lambda s, k, c: (s, k % np.uint64(3), c))(*real(*a)))
    jaccard_rows = near_rows()
    source = frame(spark, jaccard_rows)
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard.similarity_classes(source).collect()} == near(jaccard_rows)


def test_near_long_texts_and_clashing_names(spark):
    long = " ".join(f"l{i}" for i in range(30_000))
    rows = [(1, long, 1, 2, 3), (2, long + " more", 1, 2, 3), (3, "short", 1, 2, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node int, bands int, component int")
    assert sorted(map(tuple, jaccard.similarity_classes(docs).collect())) == [(1, 1, 1, True), (2, 1, 1, False), (3, 3, 0, True)]


def test_bands():
    bands, rows = jaccard.choose_bands(0.8, 0.999, 160)
    assert bands * rows <= 160 and 1 - (1 - 0.8**rows) ** bands >= 0.999
    with pytest.raises(ValueError):
        jaccard.choose_bands(0.1, 0.999999, 3)


def test_jaccard_matrix():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 60, 50).astype(np.uint64)) for _ in range(30)]
    got = jaccard.jaccard_links(0.5)([s.tobytes() for s in sets[:10]], [s.tobytes() for s in sets[10:]])
    want = [[len({*a} & {*b}) / len({*a} | {*b}) >= 0.5 for b in sets[10:]] for a in sets[:10]]
    assert got.tolist() == want


def test_roots():
    m = np.zeros((6, 6), bool)
    for a, b in ((0, 5), (5, 3), (1, 2)):
        m[a, b] = m[b, a] = True
    assert blocks._roots(m).tolist() == [0, 1, 1, 0, 4, 0]


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, node string")


def test_embeddings_against_all_pairs(spark):
    rng = np.random.default_rng(1)
    rows = []
    for label in (0, 1, None):
        for group in range(4):
            base = rng.normal(size=16)
            size = 70 if group == 0 else 4
            for _ in range(size):
                rows.append((len(rows), (base + rng.normal(size=16) * 0.13).astype(np.float32).tolist(), label, "clash"))
    rows += [(len(rows) + i, v, 0, "clash") for i, v in enumerate([None, [0.0] * 16, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [1.0] * 15 + [None], [], [2.0, 0.0, 0.0], [1.0, 0.0, 0.0]])]
    rows += [(len(rows), rows[0][1], 0, "x"), (len(rows) + 1, rows[0][1], 1, "x")]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in nn_descent.embedding_links(vectors(spark, rows), threshold=0.98).collect()}
    ids, units = {}, {}
    for key, v, label, _ in rows:
        ok = label is not None and v and None not in v and np.isfinite(v).all() and np.any(v)
        units[key] = np.array(v, float) / np.linalg.norm(np.array(v, float)) if ok else None
        ids[key] = label
    link = {k: [j for j in ids if j != k and units[k] is not None and units[j] is not None and ids[j] == ids[k] and len(units[j]) == len(units[k]) and units[k] @ units[j] >= 0.98] for k in ids}
    root = {k: k for k in ids}
    for _ in ids:
        new = {k: min([root[k], *(root[j] for j in link[k])]) for k in ids}
        if new == root:
            break
        root = new
    assert got == {k: (len(link[k]), root[k], root[k] == k) for k in ids}
    assert max(len(x) for x in link.values()) > nn_descent.NEIGHBOURS


def test_embeddings_empty(spark):
    assert nn_descent.embedding_links(vectors(spark, [(1, [1.0], 0, "x")]).limit(0)).count() == 0


def test_embeddings_without_ids_and_twice(spark):
    """Rows without an id are linked and counted, and come last; rows that repeat count each."""
    a, b = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    rows = [(None, a, 0, "x"), (4, a, 0, "x"), (4, a, 0, "x"), (7, [1.0, 0.01, 0.0], 0, "x"), (None, b, 0, "x"), (None, b, 0, "x"), (9, None, 0, "x"), (None, None, 0, "x")]
    got = Counter(map(tuple, nn_descent.embedding_links(vectors(spark, rows)).collect()))
    assert got == Counter([
        (None, 3, 4, False), (4, 3, 4, True), (4, 3, 4, True), (7, 3, 4, False), (None, 1, None, True), (None, 1, None, True), (9, 0, 9, True), (None, 0, None, True),
    ])


def unit(v):
    return v / np.linalg.norm(v)


def test_embeddings_bridged_groups_larger_than_a_list(spark):
    """Two tight groups of more vectors than any list holds, every one linked with all of the other group."""
    rng = np.random.default_rng(3)
    a, off = np.linalg.qr(rng.normal(size=(32, 2)))[0].T
    b = 0.985 * a + np.sqrt(1 - 0.985**2) * off
    rows = [(len_, unit(base + rng.normal(size=32) * 0.0008).tolist(), 0, "x") for len_, base in enumerate([a] * 150 + [b] * 150)]
    x = np.array([np.array(r[1], np.float32).astype(float) for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = ((x @ x.T >= 0.98).sum(1) - 1).tolist()
    assert min(want) == 299  # one component; each group alone has 149 links
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in nn_descent.embedding_links(vectors(spark, rows)).collect()}
    assert got == {i: (n, 0) for i, n in enumerate(want)}


def test_saturated_lists_grow_and_others_do_not(spark):
    """A group of 30 near vectors fills lists of 6; grown twice they hold 24, all of the group, while pairs keep theirs."""
    rng = np.random.default_rng(6)
    base = unit(rng.normal(size=24))
    made = [unit(base + rng.normal(size=24) * 0.0008) for _ in range(30)] + [unit(c + rng.normal(size=24) * 0.0008) for c in rng.normal(size=(5, 24)) / np.sqrt(24) for _ in range(2)]
    vectors_ = spark.createDataFrame([(i, 0, bytearray(np.array(v).tobytes()), 1) for i, v in enumerate(made)], "node long, label long, vector binary, size long")
    lists = nn_descent._graph(vectors_, 40, 6, 3, 9, 24)
    assert {len(r["ids"]) for r in lists.collect()} == {6}
    grown = {r["node"]: r for r in nn_descent._enlarged(lists, vectors_, 6, 0.98, 59, 24).collect()}
    for i in range(30):
        assert len(grown[i]["ids"]) == 24 and set(grown[i]["ids"]) <= set(range(30)) - {i}
    for i in range(30, 40):
        near_ids = [j for j, c in zip(grown[i]["ids"], grown[i]["sims"], strict=True) if c >= 0.98]
        assert near_ids == [30 + (i - 30 ^ 1)]


def test_audit_sees_lost_small_groups_and_falls_back(spark, monkeypatch):
    """Pairs whose links are all lost weigh as much as one big group; lost links are then found exactly."""
    rng = np.random.default_rng(4)
    base = unit(rng.normal(size=32))
    big = [unit(base + rng.normal(size=32) * 0.0008) for _ in range(100)]
    pairs = [unit(c + rng.normal(size=32) * 0.0008) for c in rng.normal(size=(20, 32)) / np.sqrt(32) for _ in range(2)]
    blobs = [np.array(v).tobytes() for v in big + pairs]
    classes = spark.createDataFrame([(i, 0, bytearray(v), 1) for i, v in enumerate(blobs)], "node long, label long, vector binary, size long")
    named = spark.createDataFrame([(i, 99 if i < 100 else 0, 0 if i < 100 else i) for i in range(140)], "node long, n_links long, component long")
    assert nn_descent._audit(classes, named, 0.98, 512, 12) == 0

    empty = spark.createDataFrame([], "node long, ids array<long>, sims array<float>")
    monkeypatch.setattr(nn_descent, "_graph", lambda *a: empty)
    rows = [(i, v.tolist(), 0, "x") for i, v in enumerate(pairs)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in nn_descent.embedding_links(vectors(spark, rows)).collect()}
    assert got == {i: (1, i - i % 2) for i in range(40)}
