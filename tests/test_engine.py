"""Kernels and small frames of the engine's newer operators, on hand-made inputs."""

from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from parchmint.functions import headings, labels, printed, scalars
from parchmint.operators import evidence, footing, library, links, lists, reading, search, tables


@pytest.mark.parametrize(
    "text,query,want",
    [
        ("due (1,234.50) now", "-1234.50", [(4, 14, "(1,234.50)", True)]),
        ("total 1,234 and 12,345", "234", [(8, 11, "1,234", False), (17, 21, "12,345", False)]),
        ("An answer, an", "an", [(0, 2, "An", True), (3, 5, "answer", False), (11, 13, "an", True)]),
        ("anana", "ana", [(0, 3, "anana", False), (2, 5, "anana", False)]),
        ("net $ — in all", "0", [(6, 7, "—", True)]),
        ("page 5—6", "5", [(5, 6, "5", False)]),
        ("", "x", []), ("x", "", []), (None, "x", []),
    ],
)
def test_hits_in_normal_form(text, query, want):
    got = search.hits(text, search.normal_query(query))
    assert [(h["start"], h["end"], h["exact"]) for h in got] == [(a, b, e) for a, b, _, e in want]
    assert all(h["token"].startswith(t.rstrip(".,")[:1]) for h, (_, _, t, _) in zip(got, want, strict=True))


@pytest.mark.parametrize("text,day", [("2024-3-5", "3/5/2024"), ("20240305", "3/5/2024"), ("3/5/24", "3/5/2024"), ("3/5/50", "3/5/1950"), ("5th Mar. 2024", "3/5/2024"), ("march 5, 2024", "3/5/2024"), ("2024-02-30", None), ("12024-03-05", None), ("3/5/24x", None)])
def test_days_in_search(text, day):
    form, places = search.normal_form(text, True)
    assert form == (day or search.normal_form(text)[0]) and len(form) == len(places) and places == sorted(places)


def test_dates_match_however_printed(spark):
    lines = spark.createDataFrame([(1, 1, "paid on 5 March 2024."), (1, 2, "on 03/05/2024 and 3/5/24"), (2, 1, "March 6, 2024")], "doc int, line int, text string")
    got = search.found(lines, "March 5, 2024", dates=True).collect()
    assert sorted((r["doc"], r["line"], r["start"], r["end"], r["exact"]) for r in got) == [(1, 1, 8, 20, True), (1, 2, 3, 13, True), (1, 2, 18, 24, True)]


def test_magnitudes_mean_their_figures(spark):
    hits = search.found(spark.createDataFrame([(1, 1, "exactly 1200000000 there")], "doc int, line int, text string"), "1,200,000,000")
    values = spark.createDataFrame([(1, 2, 4, 16, "$1.2 billion", "1200000000", 10**9), (1, 3, 0, 4, "1200", "1200", None)], "doc int, line int, start int, end int, text string, normalized string, magnitude long")
    assert sorted((r["line"], r["token"]) for r in search.with_aliases(hits, values, "1200000000").collect()) == [(1, "1200000000"), (2, "$1.2 billion")]


def test_cleaned_queries():
    assert search.cleaned_query(" $1,234.50​\t— ") == "1,234.50" and search.cleaned_query("(1,234).") == "(1,234)" and search.cleaned_query("€\n") == ""


def test_numbers_of_a_text():
    got = [(n["start"], n["value"], n["places"], n["percent"]) for n in printed.numbers_in("(1.5%) and (2,000) of 3.25 million, 7% - 4")]
    assert got == [(0, -0.015, 1, True), (11, -2000.0, 0, False), (22, 3250000.0, 0, False), (36, 0.07, 0, True), (41, 4.0, 0, False)]
    assert printed.numbers_in(None) == [] == printed.numbers_in("none, here")


def _run(values, total, decimals=0, taken=()):
    return footing.Run("leaves", tuple(range(len(values))), tuple(map(D, values)), D(total), decimals, taken)


def test_sign_readings():
    assert footing.signed(_run(["10", "4", "1"], "5")).taken == (1, 2)
    assert footing.signed(_run(["10", "0", "4"], "6")).taken == (2,)
    assert footing.signed(_run(["5", "10"], "5")) is None  # the first member keeps its sign
    assert footing.signed(_run(["10", "4", "4"], "10")) is None  # taking off what is added proves nothing
    assert footing.signed(_run(["1", "2"], "3")).taken == ()


def test_subtotals_within_a_run():
    assert footing.collapsed(_run(["1", "2", "3", "4"], "7")).values == (D(3), D(4))
    assert footing.collapsed(_run(["1", "2", "4"], "7")) is None
    assert footing.counts_twice(_run(["1", "2", "3"], "6")) and not footing.counts_twice(_run(["0", "0", "0"], "0"))


def test_what_misses_mean():
    assert footing.rounds(_run(["1.1", "2.2"], "3.4", 1)) and not footing.rounds(_run(["1", "2"], "4"))
    assert [footing.diagnosed(_run(["100", "200"], t)) for t in ("309", "100", "340", "304.5", "312")] == ["transposition", "sign", "single-glyph", None, None]
    assert not footing.plausible(_run(["1", "2"], "30")) and footing.proportional([D(1), D(0), D(2)], [D(2), D(0), D(4)]) and not footing.proportional([D(1), D(2)], [D(2), D(3)])


def _cell(row, col, label, value, signals=(), **more):
    return {"block": 1, "row": row, "col": col, "label": label, "value": None if value is None else D(value), "dash": False, "decimals": 0, "text": "x", "signals": list(signals), "closes_assets": False, "closes_claims": False, "name": label.lower(), "result_column": False, "rate_column": False} | more


def test_runs_across_gaps_confirm_and_never_accuse():
    rows = [_cell(0, 1, "a", 1), _cell(1, 0, "Caption:", None, text=""), _cell(2, 1, "b", 2), _cell(3, 1, "c", 4)]
    total = lambda v: {r["outcome"]: r["reason"] for r in footing.foot_block([*rows, _cell(4, 1, "Total", v, ["label-total"])])}
    assert total(7) == {"confirmed": None} and total(8) == {"unresolved": "run-too-short"}
    dashes = [_cell(0, 1, "a", 5), _cell(1, 1, "b", None, dash=True), _cell(2, 1, "c", 2), _cell(3, 1, "Total", 7, ["label-total"])]
    assert [r["outcome"] for r in footing.foot_block(dashes)] == ["confirmed"]
    mixed = [_cell(0, 1, "a", 5), _cell(1, 1, "b", 2, decimals=2), _cell(2, 1, "c", 1), _cell(3, 1, "Total", 8, ["label-total"])]
    assert [r["reason"] for r in footing.foot_block(mixed)] == ["mixed-decimals"]
    assert [r["reason"] for r in footing.foot_block([*mixed[:2], _cell(2, 1, "Total", 7, ["label-total"])])] == ["no-candidate-run"]


def test_deranged_columns_keep_their_figures(spark):
    cells = spark.createDataFrame([(1, r, c, f"r{r}", "", D(r * 10 + c), False, 0, "x", False, False) for r in range(6) for c in (1, 2)], "block int, row int, col int, label string, header string, value decimal(18,2), dash boolean, decimals int, text string, double_rule boolean, rule_above boolean")
    moved = footing.deranged(cells, 1).collect()
    assert sorted((r["col"], r["value"]) for r in moved) == sorted((r["col"], r["value"]) for r in cells.collect())
    assert all(r["value"] != r["row"] * 10 + r["col"] for r in moved) and footing.false_ties(cells).first()["confirmed"] == 0


def test_rules_around_rows(spark):
    rows = spark.createDataFrame([(1, 0, 0.1, 0.11), (1, 1, 0.13, 0.14), (1, 2, 0.16, 0.17)], "block int, row int, top double, bottom double")
    rules = spark.createDataFrame([(1, 0.12), (1, 0.173), (1, 0.175)], "block int, y double")
    assert sorted(tuple(r) for r in footing.rules_between(rows, rules).collect()) == [(1, 0, False, False), (1, 1, False, True), (1, 2, True, False)]


def test_labels(spark):
    def one(c):
        return spark.range(1).select(c.alias("x")).first()["x"]

    assert [one(labels.is_balance_state(F.lit(t))) for t in ("Balance at December 31", "Cash at beginning of year", "Balances", "Total")] == [True, True, False, False]
    assert one(labels.is_net_result(F.lit("Net income attributable to Us"))) and not one(labels.is_net_result(F.lit("Net sales")))
    assert [one(labels.is_rate_column(F.lit(t))) for t in ("Amount and interest rate", "Rate", "Corporate", "Amount per share", "")] == [False, True, False, True, False]
    arr = lambda *t: F.array(*map(F.lit, t))
    assert one(labels.is_equity_movement(F.lit("Net income"), arr("Common Stock", "Retained Earnings"), arr("Dividends"))) and not one(labels.is_equity_movement(F.lit("Net income"), arr("2024"), arr("Sales")))
    assert one(scalars.is_noncontrolling(F.lit("Net loss attributable to redeemable noncontrolling interests"))) and one(scalars.cash_flow_activity(F.lit("Net cash used in investing activities"))) == "investing"
    assert one(headings.title_after(F.lit(", “Revenue”, and")))["title"] == "Revenue" and one(headings.title_after(F.lit(" is told below")))["length"] == 0
    assert not one(scalars.names_itself(F.lit("As of December #, #"))) and one(scalars.names_itself(F.lit("Acme # Form")))
    assert one(reading.reference_kind(F.lit("tel 10-20"), F.lit(4), F.lit(9))) == "phone" and one(reading.reference_kind(F.lit("a 10-20"), F.lit(2), F.lit(7))) == "identifier"


def test_follows(spark):
    rows = [([3, 1], [3, 2], True), ([4, 4], [10, 1], True), ([1], [2], True), ([1], [3], False), ([2], [1], False), ([3, 9], [4, 2], False)]
    df = spark.createDataFrame(rows, "a array<int>, b array<int>, want boolean")
    assert all(r[0] == r[1] for r in df.select(lists.follows(F.col("a"), F.col("b")), "want").collect())


def test_ordinals_that_are_quantities():
    assert lists.ordinal("(5) % off", 0) is None and lists.ordinal("(1) million", 0) is None and lists.ordinal("(1 ", 0) is None and lists.ordinal("3.1 Exhibit", 0)[2] == "3.1"


def test_copies_of_a_table_link(spark):
    link = spark.createDataFrame([("d", 3, "s", 10, 2, 5, "table")], "doc string, page int, sheet string, row int, col int, rows int, kind string")
    targets = spark.createDataFrame([(5, 4, 1), (3, 9, 2), (1, 2, 3), (5, 7, 4)], "page int, rows int, seq int")
    assert sorted((r["page"], r["row"]) for r in links.copied(link, targets).collect()) == [(1, 15), (5, 17)]


def test_long_paths_and_cycles(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(150)] + [(500, 501), (501, 500)], "parent int, child int")
    got = {(r["parent"], r["child"]) for r in library.descendants(spark, edges).collect()}
    assert (0, 150) in got and (500, 500) in got and len(got) == 150 * 151 // 2 + 4


def test_rules_and_regions(spark):
    kept = tables.crossing_rules_kept([{"page": 1, "id": i, "vertical": v, "at": at, "lo": 0.0, "hi": 1.0} for i, v, at in ((1, True, 0.2), (2, True, 0.8), (3, False, 0.2), (4, False, 0.8))] + [{"page": 1, "id": 9, "vertical": True, "at": 0.5, "lo": 0.0, "hi": 0.3}])
    assert sorted(r["id"] for r in kept) == [1, 2, 3, 4]
    lines = spark.createDataFrame([(1, 0.1, 0.9), (1, 0.101, 0.85), (1, 0.05, 0.8), (2, 0.3, 0.7)], "region int, x0 double, x1 double")
    assert {r["region"]: r["edge"] for r in tables.supported_edges(lines, "x0").collect()} == {1: 0.1, 2: 0.3}
    regions = spark.createDataFrame([(1, 7, 0.0, 0.0, 1.0, 1.0)], "region int, page int, x0 double, y0 double, x1 double, y1 double")
    drawn = spark.createDataFrame([(7, 0.0, 0.0, 0.5, 1.0)], "page int, x0 double, y0 double, x1 double, y1 double")
    assert tables.covered_share(regions, drawn).first()["share"] == 0.5


def test_hidden_copies(spark):
    lines = spark.createDataFrame([("d", 1, 1, "a", 0.1, 0.1, 0.5, 0.2), ("d", 1, 2, "a", 0.1, 0.1, 0.48, 0.2), ("d", 2, 1, "a", 0.1, 0.1, 0.5, 0.2), ("d", 2, 2, "b", 0.1, 0.1, 0.5, 0.2)], "doc string, page int, id int, text string, x0 double, y0 double, x1 double, y1 double")
    assert [r["page"] for r in evidence.overlapping_copies(lines).collect()] == [1]


def test_spans_explain_themselves(spark):
    rows = [("value", None, "number", "$5", "5", "USD", None, None, True, 0), ("value", None, "date", "May 2024", "2024-05", None, None, "month", True, 1), ("noise", "citation-year", "date", "1933", "1933", None, None, "year", False, 1), ("value", None, "number", "7", "7", "EUR", 1000, None, True, 2)]
    df = spark.createDataFrame(rows, "category string, reason string, kind string, text string, normalized string, currency string, magnitude long, date_precision string, clickable boolean, page int")
    got = [(r["told"], list(r["facts"])) for r in reading.explained(df).collect()]
    assert got[0] == ("Read as 5.", ["value: 5", "currency: USD", "type: number", "click target: yes", "page: 1"])
    assert got[1][0] == "Read as 2024-05, to the month." and got[2][0] == "Not a figure: the year of a law." and "currency: EUR (from the page)" in got[3][1]
