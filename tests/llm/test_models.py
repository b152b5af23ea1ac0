import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import language_id, lm_scoring, mixing, quality, warc
from ledgerline.llm.texts import string_bytes

public_tokenizers = pytest.importorskip("public_tokenizers")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def fold(key, n):
    return zlib.crc32(str("" if key is None else key).encode()) % n


# ------------------------------------------------------------------- mixing


def fill(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    """Targets by repeated clamping, as the contract words it."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    total = share * sum(sizes.values())
    target, free = {}, [s for s in order if sizes[s]]
    target.update({s: 0.0 for s in order if not sizes[s]})
    while free:
        left = total - sum(target.values())
        ask = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if ask[s] > cap * sizes[s]]
        if not over:
            target.update(ask)
            break
        target.update({s: cap * sizes[s] for s in over})
        free = [s for s in free if s not in over]
    return target


def test_mix(spark):
    rng = np.random.default_rng(0)
    rows = [(i, "w " * int(rng.integers(0, 60)), [None, "a", "b", "é", "Z", "empty"][i % 5]) for i in range(600)]
    rows += [(1000, None, "empty"), (1000, None, "empty"), (None, "null key", "a"), (1001, "big " * 3000, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash"))
    got = mixing.mix(docs.repartition(3)).collect()
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(words(t))
    want = fill(sizes)
    taken, longest = Counter(), Counter()
    for r in got:
        assert r["target"] == pytest.approx(want[r["source"]]) and r["source_size"] == sizes[r["source"]]
        assert r["taken"] <= 2 * r["size"] and r["taken"] == r["repeats"] * r["size"]
        taken[r["source"]] += r["taken"]
        longest[r["source"]] = max(longest[r["source"]], r["size"])
    assert len(got) == len(rows)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= longest[s]
    again = mixing.mix(docs.repartition(7)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    assert mixing.mix(docs.limit(0)).count() == 0


def test_repeats(spark):
    docs = spark.createDataFrame([(1, "a b", "s"), (2, "c", "s"), (None, "d", "s")], "doc_id long, text string, source string")
    counts = spark.createDataFrame([(1, 2), (2, 0), (None, 1)], "doc_id long, repeats int")
    assert Counter(map(tuple, mixing.repeat_rows(docs, counts).collect())) == Counter({(1, "a b", "s"): 2, (None, "d", "s"): 1})


# --------------------------------------------------------------------- warc


def records(spark, rows):
    schema = "record_id long, url string, captured_at long, kind string, status int, etag string, last_modified string, headers map<string,string>, payload string, canonical_url string"
    return spark.createDataFrame([(*r, "clash") for r in rows], schema)


def test_revisits(spark):
    old, new = {"etag": '"1"', "content-type": "text/html"}, {"date": "d", "etag": '"9"', "content-type": "no"}
    rows = [
        (1, "http://a.org/x/", 10, "response", 200, '"1"', "m", old, "one"), (2, "https://www.A.org:443/x#f", 20, "revisit", 304, 'W/"1"', None, new, None),
        (3, "a.org/x?utm_a=1", 30, "response", 200, None, "m2", old, "three"), (4, "http://a.org/x", 40, "revisit", 304, '"1"', "m2", new, None),
        (5, "http://a.org/x", 50, "revisit", 304, '"1"', "m", new, None), (6, "http://a.org/x", 60, "revisit", 304, '"1"', None, new, None),
        (7, "http://a.org/x", 5, "revisit", 304, None, None, new, None), (8, None, 70, "revisit", 304, None, None, None, None),
        (9, "http://a.org/y", 80, "response", 404, None, None, None, "gone"), (10, "http://a.org/y", None, "revisit", 304, None, None, None, None),
        (11, "http://b.org?b=2&a=1", 1, "response", 200, None, None, None, None), (12, "http://b.org/?a=1&ref=z&b=2", 2, "revisit", 304, None, None, None, None),
    ]
    got = {r["record_id"]: r for r in warc.resolve_revisits(records(spark, rows)).collect()}
    assert {k: (r["resolution"], r["refers_to"]) for k, r in got.items()} == {
        1: ("full", None), 2: ("resolved", 1), 3: ("full", None), 4: ("resolved", 3), 5: ("mismatch", None), 6: ("unverified", 3), 7: ("no response", None),
        8: ("no response", None), 9: ("other", None), 10: ("no response", None), 11: ("full", None), 12: ("unverified", 11),
    }
    assert got[2]["payload"] == "one" and got[2]["status"] == 200
    assert got[2]["headers"] == {"content-type": "text/html", "date": "d", "etag": '"9"'}
    assert got[5]["status"] == 304 and got[5]["payload"] is None and got[8]["canonical_url"] is None
    assert warc.resolve_revisits(records(spark, rows).limit(0)).count() == 0


def test_revisits_at_one_time_and_twice(spark):
    """At one time records are in order of their ids; equal rows are resolved each."""
    def row(i, at, kind):
        return (i, "http://a.org/", at, kind, 200 if kind == "response" else 304, None, None, None, f"p{i}" if kind == "response" else None)

    rows = [row(2, 5, "response"), row(1, 5, "revisit"), row(3, 5, "revisit"), row(4, 5, "response"), row(5, 5, "revisit"), row(5, 5, "revisit"), row(None, 9, "revisit"), row(4, 5, "response")]
    got = Counter((r["record_id"], r["kind"], r["refers_to"], r["payload"]) for r in warc.resolve_revisits(records(spark, rows)).collect())
    assert got == Counter([
        (2, "response", None, "p2"), (4, "response", None, "p4"), (4, "response", None, "p4"), (1, "revisit", None, None), (3, "revisit", 2, "p2"),
        (5, "revisit", 4, "p4"), (5, "revisit", 4, "p4"), (None, "revisit", 4, "p4"),
    ])


def test_revisits_and_their_sql_on_pages_without_urls(spark, tmp_path):
    import duckdb

    from ledgerline.llm import queries

    pages = [(1, "http://a.org/x", "one"), (2, None, "two"), (3, "https://www.a.org/x/?utm_a=1", "three"), (1500, "a.org/x", "four")]
    spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    rows = queries.op6_warc_revisits(spark, str(tmp_path))
    columns = sorted(rows.columns)
    want = duckdb.sql(queries.ORACLE_SQL["op6_warc_revisits"].replace("FROM pages)", f"FROM '{tmp_path}/pages.parquet/*.parquet')"))
    at = [want.columns.index(c) for c in columns]
    assert Counter(tuple(r[c] for c in columns) for r in rows.collect()) == Counter(tuple(r[i] for i in at) for r in want.fetchall())


def test_hot_url_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(warc, "ROWS_PER_BLOCK", 7)
    rows = [(i, "http://hot.org/", i, "response" if i % 17 == 3 else "revisit", 200 if i % 17 == 3 else 304, None, None, None, str(i)) for i in range(120)]
    got = {r["record_id"]: r["refers_to"] for r in warc.resolve_revisits(records(spark, rows)).collect()}
    last, want = None, {}
    for i in range(120):
        want[i] = None if i % 17 == 3 else last
        last = i if i % 17 == 3 else last
    assert got == want


# ------------------------------------------------------------------- models


def gradients_agree(loss_of, params, grads, seed=0):
    rng = np.random.default_rng(seed)
    for name, grad in grads.items():
        flat = params[name].reshape(-1)
        for at in rng.choice(flat.size, min(4, flat.size), replace=False):
            keep, step = flat[at], 1e-2
            flat[at] = keep + step
            up = loss_of()
            flat[at] = keep - step
            down = loss_of()
            flat[at] = keep
            assert grad.reshape(-1)[at] == pytest.approx((up - down) / (2 * step), abs=2e-3), name


def test_recurrent_gradients():
    rng = np.random.default_rng(0)
    net = language_id.Network(3, 1, hidden=4)
    x = rng.integers(97, 101, (9, 5))
    real = (np.arange(9)[:, None] < np.array([9, 3, 9, 6, 1])).astype(np.float32)
    goal, weight = np.array([0, 1, 2, 1, 0]), np.ones(5, np.float32)
    _, grads = net.step(x, real, goal, weight)
    gradients_agree(lambda: net.step(x, real, goal, weight)[0], net.p, grads)


def small_model(size, seed=1):
    group, slot = np.arange(size) % lm_scoring.CLASSES, np.arange(size)
    rng = np.random.default_rng(seed)
    counts = rng.integers(0, 9, size).astype(float)
    pairs = rng.integers(0, 3, (size, size)).astype(float)
    return lm_scoring.AttentionModel.fresh(slot, group, *lm_scoring.shares(slot, group, counts, pairs), seed)


def plain_scores(model, ids, end):
    """log10 probability of each id, one position and one key at a time."""
    p, width, stride = model.p, lm_scoring.WINDOW, lm_scoring.STRIDE
    line = [end] * width + list(ids)
    out = []
    for i, target in enumerate(ids):
        low, last = i // stride * stride + stride - 1, width + i - 1
        here = model.slot[line[last]]
        scores = [p["x"][here] @ p["q"] @ (p["x"][model.slot[line[j]]] @ p["k"]) / math.sqrt(lm_scoring.WIDTH) + p["near"][last - j] for j in range(low, last + 1)]
        weights = np.exp(np.array(scores) - max(scores))
        o = sum(w * (p["x"][model.slot[line[j]]] @ p["v"]) for w, j in zip(weights, range(low, last + 1), strict=True)) / weights.sum()
        logits = np.tanh(o @ p["oh"] + p["xh"][here]) @ p["hc"] + p["c"]
        of_class = logits[model.group[target]] - np.log(np.exp(logits).sum())
        out.append((of_class + model.share[here, model.slot[target]] + model.within[target]) / math.log(10))
    return np.array(out)


def test_attention_gradients():
    rng = np.random.default_rng(0)
    size = 60
    model = small_model(size)
    windows = rng.integers(0, size, (6, lm_scoring.WINDOW + 1))
    windows[0, -5:] = -1  # beyond the text
    _, grads = model.step(windows)
    gradients_agree(lambda: model.step(windows)[0], model.p, grads)


def test_windows_score_each_id_once_and_causally():
    rng = np.random.default_rng(0)
    size = 50
    model = small_model(size)
    texts = [np.append(rng.integers(0, size - 1, n), size - 1) for n in (0, 1, 31, 32, 33, 150)]

    def score(*some, **more):
        return lm_scoring.score_ids(model, np.concatenate(some), np.array([len(t) for t in some]), size - 1, **more)

    got = score(*texts, at_once=3)
    assert len(got) == sum(map(len, texts))
    assert np.allclose(np.concatenate([plain_scores(model, t, size - 1) for t in texts]), got, atol=1e-4)
    changed = texts[-1].copy()
    changed[100] = (changed[100] + 1) % (size - 1)
    a, b = score(texts[-1]), score(changed)
    assert np.allclose(a[:100], b[:100], atol=1e-5) and not np.allclose(a[101:], b[101:], atol=1e-5)


def test_runs_have_each_target_once():
    ids = np.arange(200)
    for begins, ends in ((True, True), (True, False), (False, True), (False, False)):
        windows = lm_scoring.windows_of(ids, begins, ends, 999)
        goals = windows[:, lm_scoring.WINDOW - lm_scoring.STRIDE + 1 :].ravel()
        first = 0 if begins else lm_scoring.WINDOW - lm_scoring.STRIDE + 1
        assert goals[goals >= 0].tolist() == [*range(first, 200), *([999] if ends else [])]


def test_blocks_cover_every_word_once():
    rng = np.random.default_rng(3)
    texts = [" ".join("w" * int(n) for n in rng.integers(1, 12, k)) for k in (0, 1, 40, 3000)] + ["x" * 9000, None]
    data, offsets = lm_scoring.lowered(pa.array(texts))
    keys = np.arange(len(texts)).astype(np.uint64)
    got = Counter()
    firsts = lasts = 0
    for number in range(5):
        some, at, begins, ends = lm_scoring._picked_runs(keys, data, offsets, (number, number + 1), 5, 8)
        firsts, lasts = firsts + begins.sum(), lasts + ends.sum()
        for a, b in zip(at[:-1], at[1:], strict=True):
            got.update(some[a:b].tobytes().decode().split())
    assert got == Counter(w for t in texts for w in (t or "").split())
    assert firsts >= len(texts) and lasts >= len(texts)


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(0)
    size = 300
    group = np.arange(size) % lm_scoring.CLASSES
    slot = np.where(np.arange(size) < 200, np.arange(size), 200 + group)  # ids without a slot of their own share their class's
    counts, pairs = rng.integers(0, 9, size).astype(float), rng.integers(0, 3, (slot.max() + 1, slot.max() + 1)).astype(float)
    pairs[:, ~np.isin(np.arange(len(pairs)), slot)] = 0  # no id is there to be counted
    model = lm_scoring.AttentionModel.fresh(slot, group, *lm_scoring.shares(slot, group, counts, pairs), 1)
    windows = rng.integers(0, size, (1, lm_scoring.WINDOW + 1))
    ids = np.repeat(windows[:1, :-1], size, 0)
    targets = np.tile(windows[0, lm_scoring.WINDOW - lm_scoring.STRIDE + 1 :], (size, 1))
    targets[:, -1] = np.arange(size)
    assert np.exp(model.log_probability(ids, targets, model.tables())[:, -1]).sum() == pytest.approx(1, abs=1e-3)


def vocabulary():
    return lm_scoring.Vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def test_words_are_encoded_as_with_their_space():
    model = vocabulary().model()
    strings = ["the", "é", "x\u00a0", "\u2003y", "it's", "1234", "a" * 300, "<|endoftext|>"]
    flat, sizes = lm_scoring.encode_words(model, strings)
    assert [x.tolist() for x in np.split(flat, np.cumsum(sizes)[:-1])] == [model.encode_ordinary(" " + s) for s in strings]


TEXTS = [(i, f"The Cat{i % 4} sat\non é{i} mat") for i in range(60)] + [(7, "The Cat3 sat\non é7 mat"), (None, "no key"), (70, None), (71, ""), (72, "only here"), (73, "long " * 4000)]
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_base_scores(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string").withColumn("row", F.lit("clash"))
    got = lm_scoring.score_texts(docs.repartition(3), vocabulary(), first_steps=5, least_windows=200).collect()
    tokens = [(k, words((t or "").translate(LOW)) + [None]) for k, t in TEXTS]
    counts = Counter(w for k, ws in tokens if fold(k, 5) != 1 for w in ws)
    total, distinct = sum(counts.values()), len(counts)
    want = Counter()
    for k, ws in tokens:
        base = sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in ws)
        want[k, fold(k, 5) == 1, len(ws), sum(counts[w] > 0 for w in ws), total, round(base, 4)] += 1
    assert Counter((*tuple(r)[:5], round(r["base_score"], 4)) for r in got) == want
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)
    same = [r["score"] for r in got if r["doc_id"] == 7]
    assert len(same) == 2 and lm_scoring.score_texts(docs.limit(0), vocabulary(), first_steps=1, least_windows=1).count() == 0


def test_scores_against_brute_force(spark, monkeypatch):
    """All words, few of them frequent, counted and scored one by one; the network is as it starts."""
    monkeypatch.setattr(lm_scoring, "FREQUENT", 5)
    docs = spark.createDataFrame(TEXTS[:64], "doc_id long, text string")
    ranks = vocabulary()
    got = Counter((r["doc_id"], round(r["score"], 2)) for r in lm_scoring.score_texts(docs.repartition(3), ranks, first_steps=0, least_windows=0).collect())
    encoder, end = ranks.model(), ranks.end
    texts = [(k, [i for w in words((t or "").translate(LOW)) for i in encoder.encode_ordinary(" " + w)] + [end]) for k, t in TEXTS[:64]]
    learnt = [ids for k, ids in texts if fold(k, 5) != 1]
    model = lm_scoring.train(docs.selectExpr("doc_id as k", "text as t").filter(lm_scoring._is_training(F.col("k"))), 64, ranks, 4000, 0, 0, 8)[0]
    counts, pairs = np.zeros(ranks.size), np.zeros((model.slot.max() + 1,) * 2)
    for ids in learnt:
        for before, i in zip([end, *ids], ids, strict=False):
            counts[i] += 1
            pairs[model.slot[before], model.slot[i]] += 1
    model.share, model.within = lm_scoring.shares(model.slot, model.group, counts, pairs)
    assert got == Counter((k, round(float(plain_scores(model, ids, end).sum()), 2)) for k, ids in texts)


def test_rounds_of_training_lower_the_loss(spark):
    docs = spark.createDataFrame([(i, " ".join(["red green blue", "one two three four"][i % 2] for _ in range(60))) for i in range(40)], "k long, t string").repartition(4)
    ranks = vocabulary()

    def loss(least):
        model = lm_scoring.train(docs, 40, ranks, 10, 0, least, 8)[0]
        ids = ranks.model().encode_ordinary(" one two three four" * 20)
        return -lm_scoring.score_ids(model, np.array(ids), np.array([len(ids)]), ranks.end).mean()

    assert loss(3000) < loss(0)


def test_languages(spark):
    rng = np.random.default_rng(0)
    kinds = {"xx": ["aba", "bab", "abba"], "yy": ["okö", "kök", "koko"]}
    rows = [(i, " ".join(rng.choice(kinds[k], int(rng.integers(1, 200)))), k) for i in range(160) for k in [["xx", "yy"][i % 2]]]
    odd = [(900, None, "xx"), (901, "123 !?", "yy"), (902, "", None), (None, "aba bab", "xx"), (903, "kök " * 9000, None), (904, "aba", "zz"), (904, "aba", "zz")]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    got = {r["doc_id"]: r for r in language_id.detect_languages(docs, steps=60).collect()}
    right = [got[i]["lang_pred"] == k for i, _, k in rows if got[i]["held_out"]]
    assert len(right) > 20 and np.mean(right) > 0.95
    assert [got[i]["lang_pred"] for i in (900, 901, 902)] == ["und"] * 3 and got[903]["lang_pred"] == "yy"
    assert all(0 <= r["score"] <= 1 and r["held_out"] == (fold(k, 4) == 2) for k, r in got.items())
    assert language_id.detect_languages(docs.limit(0)).count() == 0


def plain_language(net, text):
    """Mean probabilities of a text's bytes, window by window, one byte and one unit at a time."""
    raw, n = text.encode(), net.hidden
    total = np.zeros(len(net.p["b"]))
    for low in range(0, len(raw), language_id.WINDOW):
        part = raw[low : low + language_id.WINDOW]
        logits = np.tile(net.p["b"].astype(float), (len(part), 1))
        for d, order in (("f", range(len(part))), ("b", range(len(part) - 1, -1, -1))):
            h = np.zeros(n)
            for t in order:
                gates = 1 / (1 + np.exp(-(net.p[f"{d}g"][part[t]] + h @ net.p[f"{d}ug"])))
                new = np.tanh(net.p[f"{d}n"][part[t]] + gates[n:] * (h @ net.p[f"{d}un"]))
                h = gates[:n] * h + (1 - gates[:n]) * new
                logits[t] += h @ net.p[f"{d}w"]
        p = np.exp(logits - logits.max(1, keepdims=True))
        total += (p / p.sum(1, keepdims=True)).sum(0)
    return total / max(1, len(raw))


def test_languages_against_brute_force(spark, monkeypatch):
    """The query's scores are those of its network, read byte by byte."""
    nets = []
    fit = language_id.Network.fit
    monkeypatch.setattr(language_id.Network, "fit", lambda net, *a: (nets.append(net), fit(net, *a))[1])
    rows = [(i, ["aba bab abba", "okö kök koko"][i % 2] * (1 + i % 30), ["xx", "yy"][i % 2]) for i in range(40)] + [(99, "é" * 300, None)]
    got = {r["doc_id"]: r for r in language_id.detect_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string"), steps=5).collect()}
    (net,) = nets
    for key, text, _ in rows:
        want = plain_language(net, text)
        assert got[key]["lang_pred"] == ["xx", "yy"][int(want.argmax())] and got[key]["score"] == pytest.approx(want.max(), abs=1e-4)


def test_every_byte_is_in_one_window():
    data, offsets = string_bytes(pa.array(["", "a" * 5, None, "b" * 12]))
    x, sizes, owner = language_id.cut_windows(data, offsets, 4)
    assert owner.tolist() == [1, 1, 3, 3, 3] and sizes.tolist() == [4, 1, 4, 4, 4] and (x != 256).sum() == 17


def test_quality(spark):
    rng = np.random.default_rng(0)
    rows, labels = [], []
    for i in range(500):
        good = rng.random() < 0.7
        ws = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(int(rng.integers(20, 90)))]
        rows.append((i, " ".join(ws) + "." if good else " ".join(w.upper() + "!!" for w in ws)))
        labels.append((i, int(good)))
    odd = [(900, None), (901, ""), (None, "abc def."), (902, "word " * 9000), (903, "x y z."), (903, "x y z.")]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string").withColumn("x", F.lit("clash"))
    marks = spark.createDataFrame([*labels, (None, 1), (5000, 0), (3, None), (903, 1)], "doc_id long, quality int")
    got = quality.score_quality(docs, marks).collect()
    assert len(got) == len(rows) + len(odd) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)
    named = {r["doc_id"]: r for r in got}
    held = [named[i]["predicted"] == q for i, q in labels if named[i]["held_out"]]
    assert len(held) > 60 and np.mean(held) > 0.95 and named[1]["held_out"] == (fold(1, 4) == 2)
    kept = quality.accepted(docs, marks)
    assert kept.columns == docs.columns and Counter(r["doc_id"] for r in kept.collect()) == Counter(r["doc_id"] for r in got if r["predicted"])
    assert quality.score_quality(docs, marks.limit(0)).filter("score < 1").count() == 0
    assert quality.score_quality(docs.limit(0), marks).count() == 0


def test_quality_against_one_solve(spark):
    """Partition sums, folds and calibration give what one solve over all rows gives."""
    rng = np.random.default_rng(5)
    rows = [(i, " ".join("".join(rng.choice(list("abcDEF1!"), int(rng.integers(2, 9)))) for _ in range(int(rng.integers(1, 30))))) for i in range(1500)]
    marks = [(i, int(rng.random() < 0.3 + 0.4 * (len(t) > 80))) for i, t in rows if i % 7]
    got = {r["doc_id"]: r["score"] for r in quality.score_quality(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), spark.createDataFrame(marks, "doc_id long, quality int")).collect()}
    x = quality.statistics(*string_bytes(pa.array([t for _, t in rows]))).astype(float)
    fit = [(i, q) for i, q in marks if fold(i, 4) not in (2, 3)]
    at, y = [i for i, _ in fit], np.array([q for _, q in fit], float)
    mean, scale = x[at].mean(0), np.sqrt(np.maximum((x[at] ** 2).mean(0) - x[at].mean(0) ** 2, 0)) + 1e-3
    w, b = quality._projection(quality.STATISTICS, quality.FEATURES, quality.BANDWIDTH, 7)
    z = np.concatenate([np.cos((x - mean) / scale @ w + b) * np.sqrt(2 / quality.FEATURES), np.ones((len(x), 1))], 1)
    ridge = quality.RIDGE * len(at) * np.eye(z.shape[1]) / z.shape[1]
    ridge[-1, -1] = 0
    raw = z @ np.linalg.solve(z[at].T @ z[at] + ridge, z[at].T @ y)
    held = sorted((min(3.0, max(-2.0, round(raw[i] * 1000) / 1000)), q) for i, q in marks if fold(i, 4) == 3)
    places = sorted({p for p, _ in held})
    pools = [[p * sum(q == p for q, _ in held), sum(k for q, k in held if q == p), sum(q == p for q, _ in held)] for p in places]
    i = 0
    while i + 1 < len(pools):  # a pool that isn't below the next joins it
        if pools[i][1] / pools[i][2] >= pools[i + 1][1] / pools[i + 1][2]:
            pools[i : i + 2] = [[a + c for a, c in zip(pools[i], pools[i + 1], strict=True)]]
            i = max(0, i - 1)
        else:
            i += 1
    want = np.interp(raw, [p[0] / p[2] for p in pools], [p[1] / p[2] for p in pools])
    assert max(abs(got[i] - want[i]) for i, _ in rows) < 0.02
    assert np.mean([abs(got[i] - want[i]) < 1e-6 for i, _ in rows]) > 0.95


def test_isotonic_is_the_best_monotone_fit():
    at, value = quality.isotonic(np.array([0.3, 0.1, 0.2, 0.4]), np.array([1, 1, 1, 1]), np.array([0, 0, 1, 1]))
    assert value.tolist() == [0.0, 0.5, 1.0] and at.tolist() == pytest.approx([0.1, 0.25, 0.4])


def test_model_comes_from_all_training_texts(spark, monkeypatch):
    """Classes don't depend on the sample, and the rounds use every block of a corpus of any size."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("doc_id as k", "text as t").cache()
    few, many = (lm_scoring.train(docs, 200, vocabulary(), sample, 0, 0, 8)[0] for sample in (10, 4000))
    assert (few.group == many.group).all() and (few.slot == many.slot).all() and few.group.max() > 8
    used = []

    def spy(training, vocabulary, words, model, part, of, *rest):
        used.append((part, of))
        return model

    monkeypatch.setattr(lm_scoring, "_train_round", spy)
    lm_scoring.train(docs, 200, vocabulary(), 10, 0, 1, 8)
    assert {of for _, of in used} == {len(used)} and sorted(part for part, _ in used) == [(i, i + 1) for i in range(len(used))]


def test_graphs_do_what_numpy_does():
    """Scores and gradients of the onnxruntime graphs, over several chunks and with windows that end early."""
    pytest.importorskip("onnxruntime")
    rng = np.random.default_rng(0)
    size = 200
    model = small_model(size)
    model.p["near"][:] = rng.normal(size=lm_scoring.WINDOW)
    windows = rng.integers(0, size, (70, lm_scoring.WINDOW + 1))
    windows[3, -5:] = -1
    got, want = lm_scoring.attention_graph.Gradients(model)(windows), model.step(windows)[1]
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], rtol=1e-3, atol=1e-6) for k in want)
    texts = [np.append(rng.integers(0, size - 1, n), size - 1) for n in (0, 1, 31, 32, 33, 1500)]
    flat, sizes = np.concatenate(texts), np.array([len(t) for t in texts])
    scorer = lm_scoring.attention_graph.Scorer(model)
    assert np.allclose(lm_scoring.score_ids(model, flat, sizes, size - 1, 32, scorer), lm_scoring.score_ids(model, flat, sizes, size - 1), atol=1e-4)


def test_rounds_train_on_every_id_once():
    """Blocks of encoded texts lose no id at their borders."""
    sizes = np.array([1, 20, 1024, 1025, 5000])
    flat, offsets = np.arange(sizes.sum()).astype(np.uint16), np.concatenate([[0], np.cumsum(sizes)])
    goals = Counter()
    for number in range(4):
        ids, at, begins, _ = lm_scoring._picked_runs(np.arange(5).astype(np.uint64), flat, offsets, (number, number + 1), 4, 8, lm_scoring.WINDOW - lm_scoring.STRIDE + 1)
        for a, b, x in zip(at[:-1], at[1:], begins.tolist(), strict=True):
            targets = lm_scoring.windows_of(ids[a:b], x, False, 9999)[:, lm_scoring.WINDOW - lm_scoring.STRIDE + 1 :]
            goals.update(targets[targets >= 0].tolist())
    assert goals == Counter(flat.tolist())


def test_texts_are_encoded_once(spark):
    """The ids that training and scoring read are those of every text, held out or not; counts are of the others."""
    ranks = vocabulary()
    docs = spark.createDataFrame([(i, t, i % 3 > 0) for i, t in TEXTS[:64] if i is not None], "k long, t string, train boolean").repartition(3)
    encoded = lm_scoring.train(docs, 63, ranks, 4000, 0, 0, 8)[4]
    encoder = ranks.model()
    want = {k: [i for w in words((t or "").translate(LOW)) for i in encoder.encode_ordinary(" " + w)] + [ranks.end] for k, t in TEXTS[:64] if k is not None}
    rows = encoded.filter("kind = -1").collect()
    assert {r["key"]: np.frombuffer(r["ids"], np.uint16).tolist() for r in rows} == want
    counts = Counter(i for r in rows if r["train"] for i in want[r["key"]])
    assert {r["key"]: r["n"] for r in encoded.filter("kind = 0").groupBy("key").sum("n").withColumnRenamed("sum(n)", "n").collect()} == counts
