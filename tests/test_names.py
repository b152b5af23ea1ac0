import pytest

from ledgerline.functions import names as n
from ledgerline.functions.names import features, name_features


def test_normal_tokens_and_initials():
    f = features("  Ｍｒ.  James O’Brien-Smith  ")
    assert f["name_normalized"] == "mr. james o’brien-smith"
    assert (f["name_tokens"], f["person_core"], f["person_initials"]) == ("mr james obrien smith", "james obrien smith", "jos")


@pytest.mark.parametrize(("raw", "want"), [("Example (U.K.), Ltd.", "example uk ltd"), ("U.K. Example LTD.", "uk example ltd"), ("A & B", "a and b")])
def test_tokens(raw, want):
    assert n.tokens(n.normal(raw)) == want


def test_accents_and_keys():
    assert n.unaccented(n.normal("Friends of Sinn Féin Canada")) == "friends of sinn fein canada"
    assert features("The Club Club")["token_key"] == "club club the"


def test_trading_name():
    f = features("CSC Computer Sciences Limited (Trading as DXC Technology Ltd) (UK)")
    assert f["primary_name"] == "csc computer sciences limited (uk)"
    assert f["aliases"] == ["DXC Technology Ltd"] and len(f["brackets"]) == 2


def test_organisation_core():
    assert features("Example Limited Edition")["organisation_core"] == "example limited edition"
    assert features("LABOUR TOGETHER LTD.")["organisation_core"] == features("Labour Together Limited")["organisation_core"] == "labour together"


def test_acronyms():
    full = "Associated Society of Locomotive Engineers and Firemen"
    assert n.acronym(f"ASLEF ({full})")[0] == n.acronym(f"{full} (ASLEF)")[0] == "aslef"
    assert n.acronym("BJD (GB) Limited") is None


@pytest.mark.parametrize(
    ("raw", "titles", "name"),
    [
        ("Rt. Hon. Dr. Dr Jane de la Cruz", ["rt", "hon", "dr", "dr"], "jane de la cruz"),
        ("Lord (Michael) Farmer", ["lord"], "michael farmer"),
        ("Lord", ["lord"], None),
        ("Lord (Michael)Farmer", ["lord"], "(michael)farmer"),
    ],
)
def test_persons(raw, titles, name):
    assert n.person(n.normal(raw))[:2] == (titles, name)


def test_brackets():
    assert n.brackets("a (b (c) d) e") == (["b (c) d"], False)
    assert n.brackets("a) (b") == (["b"], True)


def test_status_and_batches(spark):
    rows = spark.createDataFrame([(1, None), (2, " "), (3, "Anonymous"), (4, "Acme Ltd"), (5, "Acme Ltd")], "id long, name string")
    got = {r["id"]: r for r in name_features(rows).collect()}
    assert [got[i]["name_status"] for i in range(1, 6)] == ["missing", "missing", "withheld", "present", "present"]
    assert got[3]["name_normalized"] is None and got[4]["organisation_core"] == "acme" and got[1]["aliases"] == []


def test_company_numbers_and_addresses(spark):
    rows = spark.createDataFrame(
        [("Company", " sc012345 "), (None, "00527227"), ("Company", "527227"), ("company", "NI 016363"), (None, "AAAAAAAA"), ("Charity", "00527227")], "k string, c string"
    )
    from pyspark.sql import functions as F

    got = [r[0] for r in rows.select(n.company_number(F.col("k"), F.col("c"))).collect()]
    assert got == ["SC012345", "00527227", None, None, None, None]
    assert n.address_normal(" N/A ") is None and n.address_normal("1  High\tStreet") == "1 high street"
    qualities = spark.createDataFrame([("1 london",), ("sw1a 1aa",), ("12b high street",), ("high street",), (None,)], "a string")
    got = [r[0] for r in qualities.select(n.address_quality(F.col("a"))).collect()]
    assert got == ["partial", "partial", "numbered_street", "partial", "unavailable"]


def test_peerages():
    for raw in ("Baron Vale of Mere (Alice Vale)", "Lord Vale of Mere (Alice Vale )", "BARON  Vale of Mere ( Alice Vale )", "Lord D’Arcy of Île (Élodie D’Arcy)", "Baron Smith-Jones of Mere (Anne Smith-Jones)"):
        assert n.peerage(raw)["style"], raw
    inside = ["Alice Other", "Vale", "A Vale", "A. Vale", "Alice Vale 2", "Alice and Vale", "director Alice Vale", "on behalf of Alice Vale", "trading as Alice Vale", "(Alice Vale)", ""]
    bad = [f"Baron Vale of Mere ({x})" for x in inside]
    bad += ["Baron Vale of Mere (Alice Vale) (Alice Vale)", "Baron Vale of Mere (Alice Vale) annotation", "Baron Vale of Mere (Alice Vale", "Baron Vale of Mere Alice Vale)", "Baron Vale (Alice Vale)"]
    bad += [f"{t} Vale of Mere (Alice Vale)" for t in ("Lady", "Dame", "Baroness")] + ["Lady Vale of Mere", "Dame Alice Vale of Mere", "Vale of Mere", "Alice Vale of Mere"]
    for raw in bad:
        assert n.peerage(raw) is None, raw
    assert n.peerage("Baron Vale of Mere (Alice Vale )")["spelling"] == "vale of mere (alice vale)"


def test_organisation_initials_leave_connectives_out():
    assert features("Bank of England")["organisation_initials"] == "be"
    assert features("Jane of the Hill")["person_initials"] == "joth"
