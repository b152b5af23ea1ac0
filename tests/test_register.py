from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerline.functions.money import normal_currency, plain_amount, totals_by
from ledgerline.functions.periods import RegistrationWindow, day_range, month_window, period_window
from ledgerline.operators import registers
from ledgerline.operators.graph import connected_components


def rows(spark, data):
    return spark.createDataFrame(data, "member_id long, declaration_id long, entry_id long, amount decimal(38,18), currency string, registered timestamp_ntz")


DAY = datetime(2025, 3, 1)


def test_totals_keep_unknown_apart(spark):
    d = Decimal
    data = [
        (1, 1, 1, d("9007199254740993.123456789"), "GBP", DAY), (1, 1, 2, d("-9007199254740993.023456789"), "GBP", DAY),
        (2, 2, 3, None, "GBP", DAY), (3, 3, None, None, None, DAY), (4, 4, 4, d("5"), None, DAY), (5, 5, 5, d("5"), "EUR", DAY),
    ]
    got = {r["member_id"]: r for r in totals_by(rows(spark, data), ["member_id"]).collect()}
    assert got[1]["total"] == d("0.1") and not got[1]["incomplete"]
    assert got[2]["total"] is None and got[2]["incomplete"]
    assert got[3]["total"] is None and got[3]["declarations"] == 1 and got[3]["entries"] == 0 and not got[3]["incomplete"]
    assert got[4]["total"] is None and got[4]["incomplete"]
    assert got[5]["total"] is None and not got[5]["incomplete"]


def test_board_puts_unknown_last(spark):
    data = [(3, 1, 1, Decimal(-1), "GBP", DAY), (2, 2, None, None, None, DAY), (1, 3, 2, Decimal(-1), "GBP", DAY), (4, 4, 3, Decimal(0), "GBP", DAY)]
    board = registers.board(totals_by(rows(spark, data), ["member_id"]), "member_id")
    assert [r["member_id"] for r in board.orderBy("position").collect()] == [4, 1, 3, 2]


def test_currency_and_amounts(spark):
    got = spark.createDataFrame([("﻿ GBP ",), ("  ",), (None,)], "c string").select(normal_currency(F.col("c"))).collect()
    assert [r[0] for r in got] == ["GBP", None, None]
    amounts = [Decimal("10.500"), Decimal("0"), Decimal("-0.000000000000000001"), Decimal("12345678901234567890"), Decimal("-3.00"), None]
    got = spark.createDataFrame([(a,) for a in amounts], "a decimal(38,18)").select(plain_amount(F.col("a"))).collect()
    assert [r[0] for r in got] == ["10.5", "0", "-0.000000000000000001", "12345678901234567890", "-3", None]


def test_periods(spark):
    now = datetime(2026, 5, 5)
    assert period_window("historical", now) == RegistrationWindow()
    assert period_window(None, now).start == datetime(2024, 7, 9)
    assert period_window("current-year", now) == RegistrationWindow(datetime(2026, 1, 1), datetime(2027, 1, 1))
    assert month_window(2026, 12) == RegistrationWindow(datetime(2026, 12, 1), datetime(2027, 1, 1))
    with pytest.raises(ValueError):
        period_window("ever", now)
    dates = spark.createDataFrame([(datetime(2026, 1, 1),), (datetime(2026, 12, 31, 23),), (datetime(2027, 1, 1),), (None,)], "d timestamp_ntz")
    assert dates.filter(period_window("current-year", now).holds(F.col("d"))).count() == 2
    assert dates.filter(period_window("historical", now).holds(F.col("d"))).count() == 4
    assert dates.filter(day_range(F.col("d"), "2026-12-31", "2026-01-01")).count() == 0
    assert dates.filter(day_range(F.col("d"), None, "2026-12-31")).count() == 2


def test_timeline_fills_gaps(spark):
    data = [(1, 1, 1, Decimal(2), "GBP", datetime(2025, 1, 31)), (1, 2, 2, None, "GBP", datetime(2025, 3, 1)), (1, 3, 3, Decimal(4), "GBP", None), (1, 4, 4, Decimal(9), "EUR", datetime(2025, 9, 1))]
    got = registers.timeline(rows(spark, data)).orderBy(F.col("month").asc_nulls_last()).collect()
    assert [(r["month"] and r["month"].month, r["amount"], r["incomplete"]) for r in got] == [(1, 2, False), (2, 0, False), (3, 0, True), (None, 4, False)]


def test_alias_groups_are_transitive(spark):
    data = [(1, "Alpha"), (1, "Beta"), (2, " beta "), (2, "Gamma"), (3, "GAMMA"), (4, "Delta"), (None, "Delta"), (5, None)]
    got = registers.alias_groups(spark.createDataFrame(data, "funder_id long, alias string")).collect()
    assert sorted((r["funder_id"], r["group_id"]) for r in got) == [(1, 1), (2, 1), (3, 1)]


def test_components_in_any_order(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 101), (101, 100), (7, 7), (200, None), (None, 3)]
    want = {**dict.fromkeys(range(1, 61), 1), 100: 100, 101: 100}
    for seed in (1, 2):
        df = spark.createDataFrame(edges, "src long, dst long").orderBy(F.rand(seed)).repartition(3)
        assert {r["id"]: r["component"] for r in connected_components(df).collect()} == want
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0
