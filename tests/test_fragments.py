"""Regions, blocks and grids beside each other, on hand-made pages."""

from pyspark.sql import functions as F

from parchmint.operators import fragments as f

BOX = "page int, id int, x0 double, y0 double, x1 double, y1 double"


def _rows(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_grids_of_blocks(spark):
    blocks = spark.createDataFrame([(1, 1, 0.0, 0.0, 1.0, 0.4), (1, 2, 0.0, 0.5, 1.0, 0.9), (2, 3, 0.0, 0.0, 1.0, 1.0)], BOX)
    grids = spark.createDataFrame([(1, 7, 0.0, 0.0, 1.0, 0.2), (1, 8, 0.0, 0.1, 1.0, 0.4), (1, 9, 0.0, 0.5, 0.2, 0.9)], BOX)
    assert _rows(f.grid_of_block(blocks, grids), "id", "grid") == [(1, 8)]
    assert _rows(f.combined(grids.where("id = 8"), blocks.where("page = 1")), "id", "source") == [(2, "white"), (8, "ruled")]


def test_fragments_join(spark):
    t = spark.createDataFrame([(1, 1, 0.1, 0.2, [0.3, 0.6]), (1, 2, 0.21, 0.3, [0.301, 0.6]), (1, 3, 0.31, 0.4, [0.5]), (1, 4, 0.6, 0.7, [0.5])], "page int, id int, y0 double, y1 double, edges array<double>")
    assert _rows(f.merged_neighbours(t), "id", "group") == [(1, 1), (2, 1), (3, 2), (4, 3)]
    tables = spark.createDataFrame([(1, 1, 0.1, 0.2, 3), (1, 2, 0.22, 0.3, 3), (1, 3, 0.31, 0.4, 2), (1, 4, 0.33, 0.4, 3)], "page long, id long, y0 double, y1 double, columns int")
    regions = f.regions_of_tables(tables)
    assert _rows(regions, "id", "region") == [(1, 1), (2, 1), (4, 1)]
    values = spark.createDataFrame([(1, 1, "a"), (1, 3, "b"), (1, 4, "c")], "page long, table long, v string")
    assert _rows(f.composed(values, regions), "v", "block") == [("a", "r1"), ("b", "t3"), ("c", "r1")]


def test_edges_and_totals(spark):
    columns = spark.createDataFrame([(1, 0, 0.0, 0.3), (1, 1, 0.3, 0.6), (1, 2, 0.6, 0.9)], "page int, idx int, x0 double, x1 double")
    edges = spark.createDataFrame([(1, 0.4), (1, 0.5), (1, 0.8), (1, 0.95)], "page int, x double")
    assert _rows(f.edge_disagreements(edges, columns), "what", "at") == [("doubled", 0.3), ("missing", 0.0), ("outside", 0.95)]
    grid = spark.createDataFrame([("a", "confirmed"), ("b", "break"), ("c", "unresolved")], "span string, outcome string")
    assert _rows(f.grid_totals_kept(grid, spark.createDataFrame([("a", "break"), ("b", "confirmed")], "span string, outcome string")), "span") == [("a",), ("c",)]
    scores = spark.createDataFrame([(1, "expected", 0.1), (1, "expected", 0.2), (1, "actual", 0.105), (1, "actual", 0.104), (1, "actual", 0.5)], "page long, side string, at double")
    assert _rows(f.boundary_scores(scores), "matched", "missed", "extra") == [(1, 1, 2)]


def test_pieces_files_and_readings(spark):
    box = "struct<x:double,y:double,w:double,h:double>"
    pieces = spark.createDataFrame([("d", 1, 2, 0, "Risk", (0.1, 0.2, 0.1, 0.1)), ("d", 1, 1, 0, "Item 1A", (0.0, 0.1, 0.1, 0.1)), ("d", 2, 1, 0, "Item 2", (0.0, 0.1, 0.1, 0.1)), ("d", 2, 2, 0, "Lost", None)], f"doc string, id int, nth int, page int, text string, box {box}")
    assert _rows(f.fragment_geometry(pieces, True), "id", "text") == [(1, "Item 1A Risk")] and _rows(f.fragment_geometry(pieces, False), "id", "text") == [(1, "Item 1A Risk"), (2, "Item 2")]
    items = spark.createDataFrame([("d", "1", "I"), ("d", "1", "II"), ("d", "1A", "I")], "doc string, id string, part string")
    assert _rows(f.item_keys(items), "key") == [("item-1a",), ("item-i-1",), ("item-ii-1",)]
    files = spark.createDataFrame([(1, "b 10.pdf", 5, "x"), (2, "B 9.pdf", 5, "a"), (3, "a.pdf", 7, "X")], "seq int, name string, size int, folder string")
    order = lambda key, **how: [r["seq"] for r in f.ordered_files(files, key, **how).orderBy("place").collect()]
    assert order("name") == [3, 2, 1] and order("size", descending=True) == [3, 1, 2] and order("folder") == [2, 1, 3]
    reads = spark.createDataFrame([(1, "Net inc_", 99.0, "raw1"), (1, "Net income", 60.0, "clean1"), (1, "net-income", 70.0, "clean2"), (1, "Other", 90.0, "raw2")], "cell int, text string, confidence double, source string")
    assert f.general_reading(reads).first()["text"] == "net-income" and f.general_reading(reads, True).first()["text"] == "Other"


def test_documents_and_their_results(spark):
    docs = spark.createDataFrame([(1, "t", None, None, "pending"), (2, "t", None, None, "pending")], "id int, text_artifact string, table_artifact string, value_artifact string, status string")
    done = spark.createDataFrame([(1, "T", "U", "V"), (2, "T", None, "V")], "id int, text_artifact string, table_artifact string, value_artifact string")
    assert _rows(f.attached(docs, done), "id", "text_artifact", "status") == [(1, "T", "ready"), (2, "t", "pending")]
    assert f.json_lines(docs.limit(1).select("id", "status")).first()["value"] == '{"id":1,"status":"pending"}'
    made = spark.createDataFrame([(1, "g", "d"), (2, "g", "d"), (3, "g", "d"), (4, "g", "d")], "doc int, geometry string, digest string")
    now = spark.createDataFrame([(1, "g", "d"), (2, "h", "d"), (3, "g", "e")], "doc int, geometry string, digest string")
    assert _rows(f.lineage(made, now), "doc", "fault") == [(2, "geometry-changed"), (3, "tables-changed"), (4, "input-missing")]
    assert f.row_bands(spark.createDataFrame([(1, 0, 0.1, 0.2), (1, 0, 0.05, 0.15)], "block int, row int, y0 double, y1 double")).select(F.round("top", 3)).first()[0] == 0.05
