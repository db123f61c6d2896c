"""Registered queries over whole tables, against SQL or a plain fold of all rows."""

import random
from collections import Counter
from decimal import Decimal

import duckdb

from parchmint.functions import spans
from parchmint.operators import geometry, library
from parchmint.plans import layout, statements
from parchmint.plans import library as library_plans

SMALL = "/root/testdata/sf0.001"


def _sql(query, *names):
    con = duckdb.connect()
    for n in names:
        con.execute(f"CREATE VIEW {n} AS SELECT * FROM read_parquet('{SMALL}/{n}.parquet')")
    return con.execute(query).fetchall()


def test_every_order_is_linked(spark):
    want = _sql("SELECT o_orderkey, o_custkey, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) // 4, 2, 2 FROM orders", "orders")
    got = [tuple(r) for r in library_plans.linked_rows(spark, SMALL).collect()]
    assert len(got) == 1500 and sorted(got) == sorted(want)


def test_links_of_keys_about_the_probe_length(spark):
    text = "abcdefghij"
    pages = spark.createDataFrame([(1, 1, text), (2, 1, "abcdefgh-fghij")], "doc int, page int, text string")
    cut = [text[i:j] for i in range(10) for j in range(i + 1, 11)]
    keys = spark.createDataFrame([(n, 0, key) for n, key in enumerate([*cut, "abcdefghj", "h-fghij", "gh-fghij"])], "row int, ord int, key string")
    got = {r["row"]: r["doc"] for r in library.link_rows(keys, pages).collect()}
    assert got == {n: 1 for n in range(len(cut))} | {len(cut) + 1: 2, len(cut) + 2: 2}


def _best_links(keys, pages):
    """The links of keys to pages by comparing all with all; texts are in normal form already."""
    met = {}
    for row, order, key in keys:
        for doc, page, text in pages:
            if key and None not in (row, doc, page) and key in (text or ""):
                met.setdefault(row, {}).setdefault(doc, {}).setdefault(page, set()).add(order)
    out = []
    for row, docs in met.items():
        n = {doc: len(set().union(*p.values())) for doc, p in docs.items()}
        doc = min(n, key=lambda d: (-n[d], d))
        page = min(docs[doc], key=lambda p: (-len(docs[doc][p]), p))
        out.append((row, doc, page, len(docs[doc][page]), n[doc]))
    return sorted(out)


def test_links_as_by_comparing_all_with_all(spark):
    rng = random.Random(7)
    word = lambda n: "".join(rng.choice("aab é𝄞") for _ in range(n)).strip() or "a"
    text = lambda n: " ".join(word(n).split())
    pages = [(d, p, text(rng.randint(1, 40))) for d in range(12) for p in range(5) for _ in range(rng.randint(1, 2))] + [(3, 9, None), (None, 1, "aaaa"), (1, None, "aaaa"), (2, 9, ""), (4, 9, "b" * 30)]
    keys = [(r, o, text(rng.randint(1, 7))) for r in range(150) for o in range(rng.randint(1, 4)) for _ in range(rng.randint(1, 2))] + [(None, 0, "a"), (900, 0, None), (901, 0, "b" * 30), (902, 0, "b" * 31), (903, 0, "a"), (903, 0, "a")]
    got = library.link_rows(spark.createDataFrame(keys, "row int, ord int, key string"), spark.createDataFrame(pages, "doc int, page int, text string"))
    assert sorted(tuple(r) for r in got.collect()) == _best_links(keys, pages)
    assert library.link_rows(spark.createDataFrame([], "row int, ord int, key string"), spark.createDataFrame(pages, "doc int, page int, text string")).count() == 0


def test_links_send_no_table_to_the_driver(spark):
    """Nothing that grows with the rows or pages is broadcast, however small its file looks; of openings there are few."""
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert int(spark.conf.get("spark.sql.autoBroadcastJoinThreshold").rstrip("b")) >= 10_000_000
    assert "Broadcast" not in plan(library_plans.linked_rows(spark, SMALL))
    names = [f"{n * 7919 % 1048576:05x}" for n in range(60_000)]
    keys = spark.createDataFrame([(n, 0, name) for n, name in enumerate(names)], "row int, ord int, key string")
    assert len({name[:4] for name in names}) > library._HEADS >= library._openings(keys).count() > 16
    pages = spark.createDataFrame([(n, 0, f"xx{name}yy") for n, name in enumerate(names[:500])], "doc int, page int, text string")
    found = library._occurrences(keys, pages)
    assert "SortMergeJoin" in next(x for x in plan(found).splitlines() if "LeftSemi" in x)
    assert {(n, n) for n in range(500)} <= {(r["row"], r["doc"]) for r in keys.join(found, "key").collect()}


def _pages_of_boxes():
    """Boxes of all order lines by page, built apart from the query."""
    rows = _sql("SELECT l_orderkey // 8, row_number() OVER (PARTITION BY l_orderkey // 8 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount), l_quantity, l_discount FROM lineitem", "lineitem")
    pages = {}
    for page, i, q, disc in rows:
        pages.setdefault(page, []).append({"page": page, "id": i, "x0": q / 64, "y0": disc * 5, "x1": q / 64 + 0.2, "y1": disc * 5 + 0.2, "confidence": q / 50})
    return pages


def test_boxes_of_all_order_lines(spark):
    pages = _pages_of_boxes()
    assert sum(map(len, pages.values())) == 6000 and max(map(len, pages.values())) < 100
    pairs = lambda df, *names: sorted(tuple(r[n] for n in names) for r in df.collect())
    every = sorted((p, r["id"]) for p, g in pages.items() for r in g)
    assert pairs(layout.value_clusters(spark, SMALL), "page", "id") == every
    assert pairs(layout.crossing_rules(spark, SMALL), "page", "id", "component") == sorted((p, c["id"], c["component"]) for p, g in pages.items() for c in geometry.rule_groups(g))
    assert pairs(layout.suppressed_boxes(spark, SMALL), "page", "id") == sorted((p, r["id"]) for p, g in pages.items() for r in geometry.suppress(g))
    texts = lambda g, n: [r | {"text": f"line {n}"} for r in g if r["id"] % 4 == n]
    assert pairs(layout.coincident_lines(spark, SMALL), "page", "id") == sorted((p, r["id"]) for p, g in pages.items() for n in range(4) for r in geometry.first_copies(texts(g, n)))
    moved = lambda g: [r | {"side": "predicted"} | {c: r[c] + 0.01 for c in ("x0", "y0", "x1", "y1")} for r in g]
    matches = [m for g in pages.values() for m in geometry.one_to_one([r | {"side": "expected"} for r in g] + moved(g), 0.5)]
    assert pairs(layout.matched_boxes(spark, SMALL), "page", "expected", "predicted") == sorted((m["page"], m["expected"], m["predicted"]) for m in matches)


def _orders():
    """(quantity, price) of all lines of each order, in the queries' order."""
    orders = {}
    for block, q, p in _sql("SELECT l_orderkey, l_quantity::DECIMAL(18,2), l_extendedprice::DECIMAL(18,2) FROM lineitem ORDER BY 1, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity", "lineitem"):
        orders.setdefault(block, []).append((q, p))
    return orders


def test_sections_of_all_lines(spark):
    """A subtotal needs three lines; the grand total is proved by two proved subtotals only."""
    want = []
    for block, lines in _orders().items():
        n, first = len(lines), (len(lines) + 1) // 2
        second, wrong = n - first, block % 3 == 0
        want.append((block, first + 1, *(("unresolved", 0) if first < 3 else ("break" if wrong else "confirmed", first))))
        want.append((block, n + 2, *(("unresolved", 0) if second < 3 else ("confirmed", second))))
        want.append((block, n + 3, *(("confirmed", 2) if second >= 3 and not wrong and block % 5 else ("unresolved", 0))))
    assert sorted(tuple(r) for r in statements.nested_footing(spark, SMALL).collect()) == sorted(want)
    assert {len(lines) for lines in _orders().values()} >= set(range(1, 9))


def test_witnesses_of_all_ties(spark):
    want = []
    for block, lines in _orders().items():
        columns = [[q for q, _ in lines], [p for _, p in lines], [2 * q for q, _ in lines]]
        columns = [c + [sum(c, Decimal(0))] for c in columns]
        for total in range(2, len(lines) + 1):
            for top in range(total - 1):
                shapes = {tuple(round(float(v) / float(c[top]), 9) for v in c[top:total]) for c in columns if sum(c[top:total]) == c[total]}
                if len(shapes) >= 2:
                    want.append((block, total + 1, top + 1, len(shapes)))
    assert sorted(tuple(r) for r in statements.parallel_columns(spark, SMALL).collect()) == sorted(want)
    assert {total - 1 for _, total, top, _ in want if top == 1} >= set(range(2, 9))


def test_cells_of_all_points(spark):
    cells = {}
    for page, x, y, key in _sql("SELECT l_orderkey % 50, l_quantity, round(l_discount * 100), l_orderkey FROM lineitem", "lineitem"):
        if x < 50 and y < 12:
            cells.setdefault((page, int(y // 3), int(x // 5)), []).append(key)
    got = [tuple(r) for r in layout.grid_cells(spark, SMALL).collect()]
    assert sorted(got) == sorted((*at, len(keys), keys[0] if len(keys) == 1 else None) for at, keys in cells.items())
    assert sum(r[3] for r in got) > 5000


def test_all_boxes_are_turned(spark):
    want = []
    for order, line, part, supplier, q, disc, y in _sql("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount, l_tax FROM lineitem", "lineitem"):
        x, w, h = q / 128, disc + 0.125, 0.25
        for _ in range(order % 4):
            x, y, w, h = 1 - y - h, x, h, w
        want.append((order, line, part, supplier, x, y, w, h))
    got = sorted(tuple(r) for r in layout.turned_boxes(spark, SMALL).collect())
    assert len(got) == 6000
    for g, w in zip(got, sorted(want), strict=True):
        assert g[:4] == w[:4] and max(abs(a - b) for a, b in zip(g[4:], w[4:], strict=True)) < 1e-8


def test_streamed_figures_are_those_of_the_batch_reader(spark):
    batch = Counter()
    for source, text in _sql("SELECT source, text FROM documents", "documents"):
        for line in (text or "").split("\n"):
            batch.update((source, s["kind"]) for s in spans.recognize(line))
    got = library_plans.streamed_figures(spark, SMALL).collect()
    assert {(r["source"], r["kind"]): r["figures"] for r in got} == batch and batch


def test_a_stream_reads_amounts_dates_and_percentages_whole(spark, tmp_path):
    rows = [("a", "paid 1,234.50 on December 31, 2025\nup 7%"), ("a", None), ("b", "none"), ("b", "see 10-K\n\n$ (1,234)")]
    spark.createDataFrame(rows, "source string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r["source"], r["kind"]): r["figures"] for r in library_plans.streamed_figures(spark, str(tmp_path)).collect()}
    assert got == {("a", "number"): 1, ("a", "date"): 1, ("a", "percent"): 1, ("b", "number"): 1}
