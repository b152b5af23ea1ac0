import json

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import loading, search, trees
from ledgerline.sources import captures, declarations as source


def test_word_similarity():
    assert search.word_similarity_of("donald", "McDonald Donald") == 1.0
    assert search.word_similarity_of("word", "two words") == pytest.approx(0.8)
    assert 0 < search.word_similarity_of("jahn smyth", "John Smith") < 1
    assert search.word_similarity_of("zzzzzz", "Alpha") == 0


def test_sounds(spark):
    words = ["Ashcraft", "Robert", "Rupert", "Tymczak", "Pfister", "jahn", "john", "jonathan", "123"]
    got = spark.createDataFrame([(w,) for w in words], "w string").select(search.word_sound(F.col("w"))).collect()
    assert [r[0] for r in got] == ["A226", "R163", "R163", "T522", "P236", "J500", "J500", "J535", ""]


def spelled(spark, names):
    return spark.createDataFrame([(i, n, i, True) for i, n in enumerate(names)], "id long, name string, group_id long, is_canonical boolean")


@pytest.mark.parametrize(
    ("term", "name", "hit"),
    [("jahn smyth", "John Smith", True), ("jahn unrelated", "John Smith", False), ("jahn jahn", "John", True), ("jahn", "Jonathan", False), ("jahn", "Jane", False), ("!!!", "John", False), ("jahn smyth", "John Extra Smith", True), ("j" + "a" * 255, "John", False)],
)
def test_phonetic(spark, term, name, hit):
    assert (search.phonetic_matches(spelled(spark, [name]), term).count() == 1) is hit


def test_groups_before_limit(spark):
    rows = spark.createDataFrame([(1, "Alpha", 1, True), (2, "Alpha Two", 1, True), (3, "Alphabet", 3, True), (3, "alpha", 3, False)], "id long, name string, group_id long, is_canonical boolean")
    got = search.text_matches(rows, "alpha", 0.5, 2).collect()
    assert [(r["group_id"], r["name"]) for r in got] == [(1, "Alpha"), (3, "alpha")]
    assert search.text_matches(rows, "zzzz", 0.0, 5).count() == 2


def test_merge_takes_turns(spark):
    def part(ids):
        return spark.createDataFrame([(i, str(i), 0.5) for i in ids], "id long, label string, similarity float")

    got = search.merge_ranked(part([1, 2]), part([11, 12, 13]), part([21])).orderBy("position").collect()
    assert [r["id"] for r in got] == [1, 11, 2, 12, 13, 21]


def test_requests():
    assert search.check_request(" né ", 1, 0.0) == "né"
    for bad in (("ab", 1, 0.5), ("abc", 0, 0.5), ("abc", 1, float("nan")), ("abc", 1, 1.5)):
        with pytest.raises(ValueError):
            search.check_request(*bad)


def field(name, value=None, values=None, currency=None):
    return {"name": name, "value": value, "values": values, "typeInfo": {"currencyCode": currency} if currency else None}


DOCUMENT = {
    "id": 7, "parentInterestId": 3, "category": {"id": 3, "name": "Gifts"},
    "versions": [
        {"register": {"id": 1, "publishedDate": "2025-01-01"}, "fields": []},
        {"register": {"id": 2, "publishedDate": "2025-02-01"}, "registrationDate": "2025-01-30", "fields": [
            field("Donors", values=[[field("Name", "Acme"), field("Value", 1.10, currency="GBP"), field("PublicAddress", "1 High Street")], [field("DonorName", "Bob")]]),
            field("PayerName", "Payer Ltd"),
            field("Other", values=[[field("Value", "5"), field("Value", "6", currency="EUR"), field("UltimatePayerName", "Ult")]]),
        ]},
        {"register": {"id": 2, "publishedDate": "2025-01-15"}, "fields": []},
    ],
}


def test_decoding(spark):
    captures = spark.createDataFrame([(1, json.dumps(DOCUMENT))], "member_id long, source_json string")
    scopes = source.decode_captures(captures)
    got = [(r["ordinal"], r["pointer"], r["donor"], r["amount"], r["currency"]) for r in scopes.collect()]
    assert got == [
        (0, "/versions/1/fields/0/values/0", "Acme", "1.1", "GBP"), (1, "/versions/1/fields/0/values/1", "Bob", None, None),
        (2, "/versions/1/fields/2/values/0", None, "6", None), (None, "/versions/1/fields", None, None, None),
    ]
    found = {r["obs_id"]: (r["name"], r["address"], r["is_root"]) for r in source.observations(scopes).collect()}
    assert found == {
        "1/7/2/funding/0/donor": ("Acme", "1 High Street", False), "1/7/2/funding/1/donor": ("Bob", None, False),
        "1/7/2/funding/2/ultimate_payer": ("Ult", None, False), "1/7/2/declaration/payer": ("Payer Ltd", None, True),
    }
    assert source.replay_differences(scopes, scopes, ["pointer", "amount"]).count() == 0


def test_bad_documents():
    with pytest.raises(source.SourceError):
        source.decode(json.dumps({"versions": []}))
    with pytest.raises(source.SourceError):
        list(source.addresses([field("PayerPublicAddress", "a"), field("PayerPublicAddress", "b")], ""))


def node(number, deleted=None, children=None):
    return {"id": number, "interest": f"i{number}", "deletedWhen": deleted, "isCorrection": False, "childInterests": children}


def test_registers(spark):
    deep = node(9)
    for i in range(2000):
        deep = node(100 + i, "gone", [deep])
    text = {
        "member": {"id": 5, "nameDisplayAs": "Lord X", "latestHouseMembership": {"house": 2}},
        "interestCategories": [{"id": 4, "name": "A", "sortOrder": 2, "interests": [node(1, None, [node(2, "then", [node(3)])]), node(4)]}, {"id": 4, "name": "A", "sortOrder": 1, "interests": None}],
    }
    assert len(trees.register_rows(json.loads(json.dumps(text)))) == 4
    assert len(trees.register_rows(text | {"interestCategories": [{"id": 1, "sortOrder": 1, "interests": [deep]}]})) == 2001
    nodes = trees.decode_registers(spark.createDataFrame([(json.dumps(text),)], "source_json string"))
    tree = ["member_id", "category_position"]
    assert trees.broken_trees(nodes, tree).count() == 0
    assert trees.broken_trees(nodes.filter("node_position <> 1"), tree).count() > 0
    live = {r["node_position"]: r["live_parent"] for r in trees.live_nodes(nodes, tree).collect()}
    assert live == {0: None, 2: 0, 3: None}
    with pytest.raises(ValueError):
        trees.register_rows(text | {"member": text["member"] | {"latestHouseMembership": {"house": 1}}})


def test_loads(spark, tmp_path):
    stored = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "k long, v string, id string")
    new = spark.createDataFrame([(2, "B", "z"), (3, None, "w")], "k long, v string, id string")
    got = sorted(map(tuple, loading.upsert(stored, new, "k", ["id"]).collect()))
    assert got == [(1, "a", "x"), (2, "B", "y"), (3, None, "w")]
    assert loading.fingerprint({"a": b"1", "b": b"2"}) == loading.fingerprint({"b": b"2", "a": b"1"}) != loading.fingerprint({"a": b"12", "b": b""})
    assert loading.check_run({}, "k", "m") == "load" and loading.check_run({"k": "m"}, "k", "m") == "already_loaded"
    with pytest.raises(loading.LoadError):
        loading.check_run({"k": "m"}, "k", "other")
    folder = f"file://{tmp_path}/018f0000-0000-7000-8000-000000000001"
    loading.publish(spark, {"t": stored}, folder)
    assert spark.read.parquet(f"{folder}/t.parquet").count() == 2
    with pytest.raises(loading.LoadError):
        loading.publish(spark, {"t": stored}, folder)
    assert loading.latest_run(spark, f"file://{tmp_path}") == folder.rsplit("/", 1)[-1]
    assert loading.latest_run(spark, f"file://{tmp_path}/none") is None


def test_stale_declarations(spark):
    schema = "declaration_id long, fetched_at int"
    entries = spark.createDataFrame([(1, 1), (2, 2)], "declaration_id long, entry_id long")
    stored = spark.createDataFrame([(1, 5), (2, 5)], schema)
    with pytest.raises(loading.LoadError):
        loading.replace_declarations(stored, spark.createDataFrame([(1, 4)], schema), entries, entries.limit(0))
    rows, left = loading.replace_declarations(stored, spark.createDataFrame([(1, 6)], schema), entries, spark.createDataFrame([(1, 9)], entries.schema))
    assert sorted(map(tuple, left.collect())) == [(1, 9), (2, 2)] and sorted(map(tuple, rows.collect())) == [(1, 6), (2, 5)]


def test_pages(spark):
    good = [(0, 2, 5, 2), (2, 2, 5, 2), (4, 2, 5, 1)]
    for bad, faults in ((good, 0), ([good[0], (3, 2, 5, 2)], 1), ([(0, 2, 5, 1), (1, 2, 5, 2)], 2), (good[:2], 1), ([(0, 2, 2, 3)], 1), ([(0, 0, 0, 0)], 1), ([(0, 2, 0, 0)], 0)):
        assert captures.page_faults(spark.createDataFrame(bad, "skip int, take int, total int, items int")).count() == faults
