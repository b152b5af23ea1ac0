"""Queries over whole tables, against brute force on the smallest test tables."""

import hashlib
import itertools

import pyarrow.parquet as pq
import pytest

from __spark_entry__ import queries
from ledgerline.operators import linkage
from ledgerline.plans import queries as register

D = "/root/testdata/sf0.001"


def rows(name):
    return pq.read_table(f"{D}/{name}.parquet").to_pylist()


def declaration(x):
    return x["l_orderkey"] - (x["l_orderkey"] % 11 == 0 and x["l_orderkey"] > 0)


def test_boards_count_every_entry(spark):
    undated = {o["o_orderkey"] for o in rows("orders") if o["o_orderkey"] % 17 == 0}
    old = {o["o_orderkey"] for o in rows("orders") if o["o_orderkey"] not in undated and o["o_orderdate"].year < 1998}
    want = sum(1 for x in rows("lineitem") if declaration(x) not in undated | old)
    assert sum(r["entries"] for r in queries()["member_board"](spark, D).collect()) == want
    every = sum(1 for x in rows("lineitem") if x["l_returnflag"] in "NA")
    assert sum(r["entries"] for r in queries()["category_breakdown"](spark, D).collect()) == every


def test_sole_funders_of_every_declaration(spark):
    suppliers = rows("supplier")
    names = {s["s_suppkey"]: s["s_name"] for s in suppliers}
    low = {s["s_nationkey"]: min(t["s_suppkey"] for t in suppliers if t["s_nationkey"] == s["s_nationkey"]) for s in suppliers}

    def label(s):
        nation = s["s_nationkey"]
        if nation % 4 == 0:
            return f"Group {low[nation]}"
        return names[low[nation]] if nation % 2 == 0 else s["s_name"]

    labels = {s["s_suppkey"]: label(s) for s in suppliers}
    seen = {}
    for x in rows("lineitem"):
        seen.setdefault(declaration(x), set()).add(labels[x["l_suppkey"]])
    got = {r["declaration_id"]: r["canonical_name"] for r in queries()["sole_funders"](spark, D).collect()}
    assert got == {k: min(v) if len(v) == 1 else None for k, v in seen.items()}


def test_funders_and_continuity_read_every_row(spark):
    used = {x["l_suppkey"] for x in rows("lineitem") if x["l_suppkey"] % 7}
    assert {r["funder_id"] for r in queries()["funders_in_use"](spark, D).collect()} == used
    owners = {}
    for o in rows("orders"):
        owners.setdefault(o["o_custkey"] % 200, set()).add(o["o_orderkey"])
    got = {(r["identity"], r["id"]) for r in queries()["kept_identities"](spark, D).collect()}
    assert got == {(i + 5000, i) for i in owners if (i + 5000) % 4}


def part_observations(name):
    out = []
    for p in rows_of(name):
        key = p["p_partkey"]
        word = hashlib.md5(str(key % 1190).encode()).hexdigest().translate(str.maketrans("0123456789", "ghijklmnop"))
        text = f"{word[:5]} {word[5:10]}" + "x" * (key % 10 == 3)
        address = None if key % 4 == 0 else f"{key % 1190 % 400 + key % 2} {p['p_type'].lower()} street"
        company = f"0000{1000 + key % 7}" if key % 50 == 0 else None
        kind = "Company" if company else "Individual" if key % 1190 % 3 == 0 else "Company" if key % 7 == 1 else None
        out.append((key, text, address, company, kind))
    return out


def rows_of(path):
    return pq.read_table(f"{path}/part.parquet").to_pylist()


BIG = "/root/testdata/sf0.01"


def test_linkage_blocks_every_part(spark):
    profiles = {}
    for key, name, address, company, _ in part_observations(BIG):
        profiles.setdefault((name, address), []).append((key, company is None))
    found = sorted((min(i for i, _ in v), k, any(n for _, n in v)) for k, v in profiles.items())
    by_key = {}
    for i, (name, address), needs in found:
        last = name.rsplit(" ", 1)[-1]
        for key in {("n", name), ("p", name[:3]), ("i", name[0], last[:2])} | ({("a", address)} if address else set()):
            by_key.setdefault(key, []).append((i, needs))
    want = {(a, b) for group in by_key.values() for (a, x), (b, y) in itertools.combinations(sorted(group), 2) if x or y}
    got = queries()["scored_pairs"](spark, BIG).collect()
    assert {(r["left"], r["right"]) for r in got if r["left"] != r["right"]} == want
    twins = {min(i for i, _ in v) for v in profiles.values() if len(v) > 1 and any(n for _, n in v)}
    assert {r["left"] for r in got if r["left"] == r["right"]} == twins


def test_identities_of_every_part(spark):
    """Greedy merging over all observations at once, as the rules are worded."""
    facts = {key: (company, kind) for key, _, _, company, kind in part_observations(BIG)}
    sides = {"Individual": "person", "Company": "organisation"}
    links = sorted((r["left"], r["right"]) for r in queries()["classified_pairs"](spark, BIG).collect() if r["rule"] in linkage.LINKS)
    assert links and any(a in facts and facts[a][0] for a, _ in links)
    free, group = {i: i for i in facts}, {i: i for i in facts}

    def join(of, a, b):
        low, high = sorted((of[a], of[b]))
        for i in of:
            if of[i] == high:
                of[i] = low

    first = {}
    for i, (company, _) in sorted(facts.items()):
        if company:
            join(group, first.setdefault(company, i), i)
    for a, b in links:
        if not facts[a][0] and not facts[b][0]:
            join(free, a, b)
    reach = {}
    for a, b in links:
        for u, k in ((a, b), (b, a)):
            if not facts[u][0] and facts[k][0]:
                reach.setdefault(free[u], set()).add(facts[k][0])
    for a, b in links:
        if any(not facts[u][0] and facts[k][0] and len(reach[free[u]]) > 1 for u, k in ((a, b), (b, a))):
            continue
        members = [i for i in group if group[i] in (group[a], group[b])]
        if len({facts[i][0] for i in members} - {None}) > 1 or len({sides.get(facts[i][1]) for i in members} - {None}) > 1:
            continue
        join(group, a, b)
    number = {}
    for i, (company, _) in sorted(facts.items()):
        if company:
            number[group[i]] = company
    want = {i: f"source-reported:companies-house:{number[g]}" if g in number else f"run-local:run:{g}" for i, g in group.items()}
    got = queries()["resolved_identities"](spark, BIG).collect()
    assert {r["obs_id"]: r["identity_id"] for r in got} == want and len(got) == len(facts)
    size = {g: sum(1 for i in group if group[i] == g) for g in set(group.values())}
    for r in got:
        alone = size[group[r["obs_id"]]] == 1 and group[r["obs_id"]] not in number
        assert (r["basis"] == "provisional_singleton") == alone
        assert (r["basis"] == "source_reported_company") == (facts[r["obs_id"]][0] is not None)


def test_pairs_beyond_the_budget_are_an_error(spark, monkeypatch):
    """Pairs of whole parts beyond the ceiling are never cut: an error, before and after they are made."""
    found = linkage.profiles(register._observations(spark, BIG))
    keyed = linkage.blocking_keys(found)
    count = linkage.candidate_pairs(keyed).count()
    linkage.candidate_pairs(keyed, count)
    for budget in (count - 1, 10):
        with pytest.raises(linkage.BudgetExceeded):
            linkage.candidate_pairs(keyed, budget)
