from collections import Counter

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")
import corpus_pipeline  # noqa: E402

from ledgerline.llm import packing  # noqa: E402


def test_stages_against_plain_versions(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows, labels = [], []
    for i in range(260):
        good = i % 5 != 0
        ws = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(int(rng.integers(30, 60)))]
        rows.append((i, " ".join(ws) if good else " ".join(w.upper() + "!!" for w in ws), "en", f"s{i % 3}", 1))
        labels.append((i, int(good), 0))
    rows += [(300 + i, rows[6][1].replace(" ", "  "), "en", "s1", 1) for i in range(3)] + [(400, rows[7][1] + " tail", "en", "s2", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen.append(docs)
    ids = [{r["doc_id"] for r in s.select("doc_id").collect()} for s in seen[:4]]
    good = {i for i in range(260) if i % 5} | {300, 301, 302, 400}
    assert ids[0] == good
    assert ids[1] == good - {300, 301, 302}
    assert ids[2] == ids[1] - {400} and 6 in ids[2] and 7 in ids[2]
    assert ids[3] <= ids[2] and all(s.columns == ["doc_id", "text", "lang", "source", "n_chars"] for s in seen[:4])
    repeats = Counter(r["doc_id"] for r in seen[3].collect())
    assert max(repeats.values()) <= 2
    total = sum(len(t.split()) for i, t, *_ in rows if i in ids[2])
    taken = sum(len(r["text"].split()) for r in seen[3].collect())
    assert abs(taken - 1.5 * total) < 0.1 * total
    pieces = seen[4].collect()
    assert Counter(r["doc_id"] for r in pieces) == repeats
    assert {(r["sequence_id"], r["offset"]) for r in pieces}.__len__() == len(pieces)
    assert Counter(r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == repeats
    assert packing.Capacity().tokens == 2048


def stages(spark, tmp_path, rows, labels=()):
    folder = f"{tmp_path}/in"
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        out.append(docs)
    return out


def test_rows_without_ids_and_repeated_ids_are_judged_each(spark, tmp_path):
    def words(k, n=40):
        return " ".join(f"w{k}_{i}" for i in range(n))

    rows = [(3, words(0), "a"), (5, words(0), "a"), (5, words(1), "a"), (5, words(2), "a"), (None, words(3), "b"), (None, words(3), "b"), (None, words(4), None), (6, words(4) + " tail", "b"), (7, None, "b"), (None, "", "b")]
    found = stages(spark, tmp_path, [(i, t, None, s, None) for i, t, s in rows])
    kept = [Counter((r["doc_id"], r["text"]) for r in f.collect()) for f in found[:3]]
    assert kept[0] == Counter((i, t) for i, t, _ in rows)  # without labels nothing is rejected
    one = Counter({(3, words(0)): 1, (5, words(1)): 1, (5, words(2)): 1, (None, words(3)): 1, (None, words(4)): 1, (6, words(4) + " tail"): 1, (7, None): 1})
    assert kept[1] == one
    assert kept[2] == one - Counter({(None, words(4)): 1})
    taken = Counter((r["doc_id"], r["text"]) for r in found[3].collect())
    assert set(taken) <= set(kept[2]) and max(taken.values()) <= 2 and (None, words(3)) in taken
    assert Counter(r["doc_id"] for r in found[4].collect()) == sum((Counter({i: n}) for (i, _), n in taken.items()), Counter())


def test_empty_tables_and_clashing_columns(spark, tmp_path):
    assert [f.count() for f in stages(spark, tmp_path, [])] == [0] * 5
    docs = spark.createDataFrame([(1, "a b c d e f", "en", "s", 1, 2), (2, "a b c d e f", "en", "s", 1, 2)], "doc_id long, text string, lang string, source string, node long, bands long")
    for stage in (corpus_pipeline.exact_copies, corpus_pipeline.near_copies):
        assert [tuple(r) for r in stage(spark, docs, "").collect()] == [(1, "a b c d e f", "en", "s", 1, 2)]
    assert corpus_pipeline.mixture(spark, docs, "").columns == docs.columns
