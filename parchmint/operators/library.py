"""Operators on collections of documents: linking rows to pages, search, catalogues, keyed updates, reviews, link values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parchmint.functions import scalars
from parchmint.operators.grouping import kept
from parchmint.operators.windows import first_wins


def normalized(c: Column) -> Column:
    """Text for matching: lower case, white space collapsed, digit-group commas dropped, (n) as -n, end marks stripped."""
    t = F.lower(scalars.collapsed(c))
    t = F.regexp_replace(t, r"(?<=[0-9]),(?=[0-9]{3}(?![0-9]))", "")
    t = F.regexp_replace(t, r"\(\$?([0-9][0-9.]*)\)", "-$1")
    return F.regexp_replace(t, r"[.,;:!?]+$", "")


_HEAD, _HEADS = 4, 10_000  # characters that open a key, at most, and how many openings are broadcast


def _openings(keys: DataFrame) -> DataFrame:
    """(head, lengths): how keys open, and how long those are that open so; ``_HEADS`` rows at most, so it can be broadcast.

    Heads have the most characters up to ``_HEAD`` that keep within that many rows; with none, one row has all lengths.
    """
    most = keys.select(F.left("key", F.lit(_HEAD)).alias("most"), F.length("key").alias("length")).distinct()
    cut = most.select(F.explode(F.sequence(F.lit(0), F.lit(_HEAD))).alias("cut"), "most", "length")
    heads = cut.groupBy("cut", F.left("most", F.col("cut")).alias("head")).agg(F.collect_set("length").alias("lengths"))
    fit = heads.groupBy("cut").agg(F.count("*").alias("n")).where(F.col("n") <= _HEADS).agg(F.max("cut").alias("cut"))
    return heads.join(F.broadcast(fit), "cut").select("head", "lengths")


def _occurrences(keys: DataFrame, pages: DataFrame) -> DataFrame:
    """(key, doc, page) once for each page whose text has the key anywhere. Each place of a text that opens like some keys
    gives the pieces of those keys' lengths, and pieces meet keys in one equi-join: no row is made but of whole candidates."""
    heads = _openings(keys)
    sizes = heads.select(F.length("head").alias("size")).distinct()
    n = F.length("text") - F.greatest("size", F.lit(1)) + 1
    places = pages.join(F.broadcast(sizes), n > 0).select("doc", "page", "text", "size", F.explode(F.sequence(F.lit(1), n)).alias("at"))
    opened = places.withColumn("head", F.substring("text", F.col("at"), F.col("size"))).join(F.broadcast(heads), "head").select("doc", "page", "text", "at", F.explode("lengths").alias("length"))
    pieces = opened.where(F.col("at") + F.col("length") - 1 <= F.length("text")).select(F.substring("text", F.col("at"), F.col("length")).alias("key"), "doc", "page")
    return pieces.join(keys.select("key").distinct().hint("merge"), "key", "left_semi").distinct()


def _most(keys: DataFrame, found: DataFrame, row: list[str], key: list[str], at: str, name: str) -> DataFrame:
    """(row, at, name): the place where most of a row's keys (``ord``) are found, the first of equals, and how many.

    ``found``: key, at, once each. A key found in many places is not spread over all rows that have it: a place with two of a
    row's keys has one besides the key that is found most, so the places of the others and the first place of that one are all
    that can win; their keys are then looked up by key and place. Joins are sort-merge joins: a table that looks small in its
    file is not sent to the driver.
    """
    spread = found.groupBy(*key).agg(F.count("*").alias("n"), F.min(at).alias("first"))
    met = keys.join(spread.hint("merge"), key).repartition("row").groupBy(*row).agg(F.collect_list(F.struct("n", "ord", "key", "first")).alias("met"))
    met = met.select(*row, "met", F.array_max("met")["ord"].alias("last"))
    of_last = F.filter("met", lambda x: x["ord"].eqNullSafe(F.col("last")))
    rest = met.select(*row, "last", F.transform(of_last, lambda x: x["key"]).alias("tail"), F.explode(F.filter("met", lambda x: ~x["ord"].eqNullSafe(F.col("last")))).alias("x"))
    able = rest.select(*row, "last", "tail", F.col("x")["ord"].alias("ord"), F.col("x")["key"].alias("key")).join(found.hint("merge"), key)
    asked = able.select(*row, at, "ord", "last", F.explode("tail").alias("key")).join(found.withColumn("hit", F.lit(True)).hint("merge"), [*key, at], "left")
    first = met.select(*row, F.array_min(F.transform(of_last, lambda x: x["first"])).alias(at), F.col("last").alias("ord"), F.lit(None).alias("also"))
    hits = asked.select(*row, at, "ord", F.when(F.col("hit"), F.col("last")).alias("also")).unionByName(first).repartition("row")
    counts = hits.select(*row, at, F.explode(F.array("ord", "also")).alias("ord")).groupBy(*row, at).agg(F.countDistinct("ord").alias(name))
    return first_wins(counts, row, [F.col(name).desc(), F.col(at)])


def link_rows(keys: DataFrame, pages: DataFrame) -> DataFrame:
    """(row, doc, page, found, keys): each row's best document, by how many of its keys occur anywhere in it, and that
    document's best page; the first document and page win ties; rows without a hit are left out.

    ``keys``: row, ord, key; ``pages``: doc, page, text. A key is found wherever its normalised text is a part of the
    page's.
    """
    k = keys.select("row", "ord", F.explode(F.array(normalized(F.col("key")))).alias("key")).where("key <> '' AND row IS NOT NULL")
    p = pages.where("doc IS NOT NULL AND page IS NOT NULL").select("doc", "page", F.explode(F.array(normalized(F.col("text")))).alias("text"))
    found = kept(_occurrences(k, p), once=True)
    best = _most(k, found.select("key", "doc").distinct(), ["row"], ["key"], "doc", "keys")
    inside = k.join(best.hint("merge"), "row")
    return _most(inside, found, ["row", "doc", "keys"], ["key", "doc"], "page", "found").select("row", "doc", "page", "found", "keys")


def search_lines(lines: DataFrame, query: str) -> DataFrame:
    """(doc, line, at, exact): every hit, overlapping ones too, of a query on one line, white space collapsed; exact where
    the query is a whole token. Texts are compared in normal form (see ``search``); ``at`` is the printed place, from 1."""
    from parchmint.operators import search

    rows = lines.select("doc", "line", scalars.collapsed(F.col("text")).alias("text"))
    hit = search.found(rows, " ".join(query.split()))
    return hit.select("doc", "line", (F.col("start") + 1).cast("long").alias("at"), "exact")


def exact_first(hits: DataFrame, after: int = 0, limit: int | None = None) -> DataFrame:
    """Hits ranked, exact ones before partial ones, each in reading order; ``after`` and ``limit`` page through them."""
    from parchmint.operators import search

    return search.ranked(hits, ["line", "at"], after=after, limit=limit)


def upserted(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """``table`` with each changed key's row replaced or added; of changes to one key the last (``seq``) holds."""
    last = first_wins(changes, [key], [F.col("seq").desc()]).drop("seq")
    return table.join(last.select(key), key, "left_anti").unionByName(last)


def cascaded(parents: DataFrame, children: DataFrame, gone: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Parents and children less those of deleted keys."""
    return parents.join(gone, key, "left_anti"), children.join(gone, key, "left_anti")


def carried_decisions(current: DataFrame, previous: DataFrame) -> DataFrame:
    """(id, decision, state): decisions kept where id and signature are unchanged, reset where the signature moved,
    archived where the id is gone. Both: id, signature; ``previous`` also decision."""
    p = previous.select("id", F.col("signature").alias("old"), F.col("decision").alias("was"))
    both = current.select("id", "signature", F.lit(True).alias("here")).join(p, "id", "full_outer")
    same = F.col("signature").eqNullSafe(F.col("old")) & F.col("was").isNotNull()
    state = F.when(F.col("here").isNull(), "archived").when(same, "kept").when(F.col("was").isNull(), "new").otherwise("reset")
    return both.select("id", F.when(F.col("here").isNull() | same, F.col("was")).otherwise("unreviewed").alias("decision"), state.alias("state"))


def scored(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """Full-outer comparison: matched, changed, missed and extra per key; both have ``outcome``."""
    e, a = expected.withColumnRenamed("outcome", "want"), actual.withColumnRenamed("outcome", "got")
    verdict = F.when(F.col("got").isNull(), "missed").when(F.col("want").isNull(), "extra").when(F.col("got") == F.col("want"), "matched").otherwise("changed")
    return e.join(a, keys, "full_outer").select(*keys, verdict.alias("verdict"))


def resolved_references(citations: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Citations whose normalised id names exactly one catalogue entry, by part where the id repeats; others drop.

    ``citations``: cite, raw, part (may be null); ``catalogue``: entry, raw, part.
    """
    c = catalogue.select("entry", scalars.decimal_identifier(F.col("raw")).alias("id"), F.col("part").alias("own_part"))
    once = c.withColumn("n", F.count("*").over(Window.partitionBy("id")))
    q = citations.select("cite", scalars.decimal_identifier(F.col("raw")).alias("id"), "part")
    return q.join(once, "id").where((F.col("n") == 1) | (F.col("part") == F.col("own_part"))).select("cite", "entry")


def canonical_text(rows: DataFrame, key: str, text: str) -> DataFrame:
    """The spelling a key has most often, case ignored; on ties the longer, then the first in order."""
    n = rows.groupBy(key, F.lower(text).alias("folded")).agg(F.count("*").alias("n"), F.min(text).alias("shown"))
    return first_wins(n, [key], [F.col("n").desc(), F.length("shown").desc(), F.col("folded")]).select(key, F.col("shown").alias("text"))


def free_names(taken: DataFrame, wanted: DataFrame) -> DataFrame:
    """(name, free): for each wanted file name the name itself or the lowest free "stem (n).ext"; case ignored."""
    n = F.lower("name")
    stem, ext = F.regexp_extract("name", r"^(.*?)(?: \([0-9]+\))?(\.[^.]*)?$", 1), F.regexp_extract("name", r"(\.[^.]*)?$", 1)
    parts = lambda df: df.withColumn("stem", stem).withColumn("ext", ext)
    used = parts(taken).select(F.lower(F.concat("stem", "ext")).alias("family"), F.coalesce(F.regexp_extract(n, r" \(([0-9]+)\)(?:\.[^.]*)?$", 1).try_cast("int"), F.lit(0)).alias("no")).distinct()
    w = Window.partitionBy("family").orderBy("no")
    gap = used.withColumn("nth", F.row_number().over(w) - 1).groupBy("family").agg(F.min(F.when(F.col("no") != F.col("nth"), F.col("nth"))).alias("hole"), F.count("*").alias("n"), F.max(F.col("no") == 0).alias("plain"))
    ask = parts(wanted.withColumn("name", F.col("name"))).withColumn("family", F.lower(F.concat("stem", "ext")))
    no = F.coalesce("hole", "n", F.lit(0))
    return ask.join(gap, "family", "left").select("name", F.when(no == 0, F.concat("stem", "ext")).otherwise(F.concat("stem", F.lit(" ("), no.cast("string"), F.lit(")"), "ext")).alias("free"))


def first_free(cells: DataFrame, width: int) -> DataFrame:
    """(sheet, row, col): the first free column of each row from 1 to ``width``; ``cells`` lists the taken ones."""
    w = Window.partitionBy("sheet", "row").orderBy("col")
    nth = cells.select("sheet", "row", "col").distinct().withColumn("nth", F.row_number().over(w))
    free = nth.groupBy("sheet", "row").agg(F.coalesce(F.min(F.when(F.col("col") != F.col("nth"), F.col("nth"))), F.max("nth") + 1).alias("col"))
    return free.where(F.col("col") <= width)


def sum_formulas(parts: DataFrame) -> DataFrame:
    """(cell, formula, total): the figures given to a cell, in their order, as "=a+b+c" and as an exact sum."""
    g = parts.groupBy("cell").agg(F.sort_array(F.collect_list(F.struct("seq", "value"))).alias("p"))
    values = F.transform("p", lambda x: x["value"])
    shown = F.transform(values, lambda v: F.regexp_replace(F.regexp_replace(v.cast("string"), r"(\.[0-9]*?)0+$", "$1"), r"\.$", ""))
    return g.select("cell", F.concat(F.lit("="), F.array_join(shown, "+")).alias("formula"), scalars.exact_sum(values, "decimal(38,2)").alias("total"))


def format_blocks(cells: DataFrame) -> DataFrame:
    """(sheet, format, row, from, to): neighbouring cells of one row and format as one block."""
    w = Window.partitionBy("sheet", "row", "format").orderBy("col")
    runs = cells.withColumn("run", F.col("col") - F.row_number().over(w))
    return runs.groupBy("sheet", "format", "row", "run").agg(F.min("col").alias("from"), F.max("col").alias("to")).drop("run")


def descendants(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(parent, child) of every path in an equation graph; a cycle shows as a node under itself.

    Each round joins the paths found so far with themselves, so paths double in length and n rounds reach 2^n steps; it ends
    when a round finds none.
    """
    whole = edges.select("parent", "child").distinct()
    keep = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    n = whole.count()
    while True:
        longer = whole.join(whole.select(F.col("parent").alias("child"), F.col("child").alias("next")), "child").select("parent", F.col("next").alias("child"))
        whole = whole.union(longer).distinct()
        whole = whole.checkpoint() if keep else whole
        now = whole.count()
        if now == n:
            return whole
        n = now


def committed(revisions: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests that name their document's latest revision are appended as the next one; stale ones are refused.

    ``revisions``: doc, revision; ``requests``: doc, expected, seq. Of several with one expectation the first is taken.
    """
    latest = revisions.groupBy("doc").agg(F.max("revision").alias("latest"))
    r = requests.join(latest, "doc", "left").withColumn("latest", F.coalesce("latest", F.lit(0).cast("long")))
    w = Window.partitionBy("doc", "expected").orderBy("seq")
    ok = (F.col("expected") == F.col("latest")) & (F.row_number().over(w) == 1)
    return r.withColumn("ok", ok).select("doc", "seq", F.when(F.col("ok"), F.col("latest") + 1).alias("revision"), F.when(F.col("ok"), "committed").otherwise("stale").alias("state"))
