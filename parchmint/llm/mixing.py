"""Mixing sources to target token weights by entropy balancing.

Each source has a target of tokens. Among all document rates that meet it, those nearest to one copy each by relative
entropy are exponentially tilted: rate = min(limit, exp(lambda * size / mean size of the source)). The lambdas solve the
convex dual, one constraint per source, by Newton steps that run for all sources at once on the table of (source, size,
documents): a step sums the tokens and their derivative per source over all partitions, falls back to bisection where it
leaves the bracket, and ends when all constraints hold to ``TOLERANCE``. Sums are exact (rates in whole millionths), so
reruns agree whatever order tasks end in.

Rates become whole copies: the whole part of every rate, and one more for the documents first in the order of
hash / fractional part whose sizes fill what the source lacks (sequential Poisson sampling). The prefix that fits is
found by counting ``1 << BIN_BITS`` bins of keys a source, then those of the bin in which the sum crosses, until it holds
at most ``BIN_ROWS`` rows, which alone are put in order; ``PASSES`` times, each time among the documents after it that
still fit. Where words are lacking then, the document that comes nearest to them, above or below, is taken once more.

Cases: a null text has no tokens and is taken 0 times its size; null sources are one source, the last; documents of one
text and doc_id have equal keys and get alike, all or none of them; a source without tokens has target 0; an empty table
gives an empty result; other columns are kept by ``mixed_documents`` and dropped by ``mix``, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parchmint.llm.shared import stored, text_or_empty, unused, word_count

LIMIT = 3
MILLION = 1_000_000
TOLERANCE = 1e-4
MAX_STEPS = 60
PASSES = 5
#: Rows that one source may have put in order at the end of a search.
BIN_ROWS = 2000
BIN_BITS = 8
#: Keys are whole numbers of so many bits.
KEY_BITS = 48
#: Single documents taken once more at the end.
FINISH = 3
#: Sources whose parameters are broadcast (some 500 bytes each); those of more are joined by shuffling.
BROADCAST_SOURCES = 20_000


def level_targets(sizes: list[float], weights: list[float], limit: float) -> list[float]:
    """Shares of all sizes by weight; none above ``limit`` times its size, the excess shared anew by weight."""
    total, target, open_ = float(sum(sizes)), [0.0] * len(sizes), set(range(len(sizes)))
    left = total
    while open_:
        mass = sum(weights[i] for i in open_)
        over = [i for i in open_ if mass and left * weights[i] / mass > limit * sizes[i]]
        if not over:
            for i in open_:
                target[i] = left * weights[i] / mass
            break
        for i in over:
            target[i] = float(limit * sizes[i])
            left -= target[i]
        open_ -= set(over)
    return target


def _key(source: dict) -> tuple[bool, str]:
    return source["none"], source["name"]


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_SOURCES else df


def _named(column: str | Column) -> Column:
    """A source as a struct that joins and groups null like any other."""
    c = F.col(column).cast("string") if isinstance(column, str) else column
    return F.struct(c.isNull().alias("none"), F.coalesce(c, F.lit("")).alias("name"))


def _rate(lam: Column, size: Column, mean: Column, limit: int) -> Column:
    """The tilted rate in whole millionths."""
    return F.when(size == 0, F.lit(0)).otherwise(F.round(F.least(F.lit(float(limit)), F.exp(F.least(lam * size / mean, F.lit(50.0)))) * MILLION)).cast("long")


def solve(spark: SparkSession, histogram: DataFrame, sources: list[dict], limit: int) -> None:
    """Newton on the dual: sets ``lam`` of each source. ``histogram`` has (source, size, n)."""
    for s in sources:
        s |= {"lam": 0.0, "low": -60.0, "high": 60.0, "done": False}
        if s["size"] == 0 or s["target"] >= limit * s["size"]:
            s |= {"lam": 60.0, "done": True}
        elif s["target"] <= 0:
            s |= {"lam": -60.0, "done": True}
    for _ in range(MAX_STEPS):
        open_ = [s for s in sources if not s["done"]]
        if not open_:
            return
        now = spark.createDataFrame([(s["none"], s["name"], s["lam"], s["mean"]) for s in open_], "none boolean, name string, lam double, mean double")
        rows = histogram.join(_small(now.select(F.struct("none", "name").alias("source"), "lam", "mean"), len(open_)), "source")
        rate = _rate(F.col("lam"), F.col("size"), F.col("mean"), limit)
        tokens = rate.cast("decimal(38,0)") * F.col("size") * F.col("n")
        slope = F.when(rate < limit * MILLION, F.round(tokens * F.col("size") / F.greatest(F.round("mean"), F.lit(1.0)).cast("decimal(20,0)"), 0))
        got = rows.groupBy("source").agg(F.sum(tokens.cast("decimal(38,0)")).alias("tokens"), F.sum(slope.cast("decimal(38,0)")).alias("slope")).collect()
        sums = {(r["source"]["none"], r["source"]["name"]): (float(r["tokens"]) / MILLION, float(r["slope"] or 0) / MILLION) for r in got}
        for s in open_:
            tokens_, slope_ = sums[s["none"], s["name"]]
            error = tokens_ - s["target"]
            if abs(error) <= TOLERANCE * s["target"] or s["high"] - s["low"] < 1e-9:
                s["done"] = True
                continue
            s["low" if error < 0 else "high"] = s["lam"]
            step = s["lam"] - error / slope_ if slope_ > 0 else None
            s["lam"] = step if step is not None and s["low"] < step < s["high"] else (s["low"] + s["high"]) / 2


def _keyed(docs: DataFrame, source: str, text: str, mix: str) -> DataFrame:
    """A column ``mix``: source, size and a uniform number in (0, 1) of each document."""
    spread = F.xxhash64(F.col("doc_id"), F.col(text), F.lit(17))
    uniform = (F.shiftrightunsigned(spread, 11).cast("double") + 0.5) / float(1 << 53)
    return docs.withColumn(mix, F.struct(_named(source).alias("source"), word_count(F.col(text).cast("string")).alias("size"), uniform.alias("u")))


def _plan(rows: DataFrame, limit: int) -> list[dict]:
    """Per source: size, target, lambda and the keys that get a copy more. ``rows`` has (source, size, u)."""
    spark = rows.sparkSession
    histogram = stored(rows.groupBy("source", "size").agg(F.count("*").alias("n")), "sizes")
    # one row per source comes to the driver: the mix is stated by source
    got = histogram.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("size"), F.sum(F.when(F.col("size") > 0, F.col("n"))).alias("n")).collect()
    sources = [{"none": r["source"]["none"], "name": r["source"]["name"], "size": r["size"], "n": r["n"] or 0, "ranges": [], "extra": [], "lack": 0} for r in got]
    sources.sort(key=_key)
    for s, target in zip(sources, level_targets([s["size"] for s in sources], [1 + i % 3 for i in range(len(sources))], limit), strict=True):
        s |= {"target": target, "mean": s["size"] / s["n"] if s["n"] else 1.0}
    solve(spark, histogram, sources, limit)
    _fill(rows, sources, limit)
    return sources


def _parameters(spark: SparkSession, sources: list[dict], p: str) -> DataFrame:
    """One row per source, a struct named ``p``."""
    rows = [(s["none"], s["name"], s["lam"], s["mean"], s["size"], s["target"], s["ranges"], s["extra"], s["lack"]) for s in sources]
    schema = "none boolean, name string, lam double, mean double, source_size long, target double, ranges array<struct<low:long,high:long,most:long>>, extra array<double>, lack long"
    fields = ("lam", "mean", "source_size", "target", "ranges", "extra", "lack")
    return _small(spark.createDataFrame(rows, schema).select(F.struct(F.struct("none", "name").alias("source"), *fields).alias(p)), len(rows))


def _place(rate: Column, u: Column) -> Column:
    """The key in whose order documents get a copy more: u / fraction, bent into (0, 1), in whole steps; null where the rate is whole."""
    part = (rate % MILLION) / float(MILLION)
    return F.when(part > 0, F.floor((u / part) / (1 + u / part) * float(1 << KEY_BITS)))


def _by_source(rows: list) -> dict:
    return {(r["source"]["none"], r["source"]["name"]): r for r in rows}


def _crossings(open_: DataFrame, sources: list[dict]) -> dict[tuple, dict]:
    """Per source with open rows: all their tokens and, where these exceed its lack, the bin of keys in which they cross it.

    ``open_`` has (source, size, key, lack). A round sends the sums of at most ``1 << BIN_BITS`` bins a source to the driver.
    """
    spark, out = open_.sparkSession, {}
    level = {_key(s): (0, 0) for s in sources if s["lack"] > 0}  # the bin searched, tokens before it
    lack = {_key(s): s["lack"] for s in sources}
    bits = 0
    while level:
        bits += BIN_BITS
        at = spark.createDataFrame([(*k, b) for k, (b, _) in level.items()], "none boolean, name string, bin long").select(F.struct("none", "name").alias("source"), "bin")
        inside = open_.join(_small(at, len(level)), "source").where(F.shiftright("key", KEY_BITS - bits + BIN_BITS) == F.col("bin"))
        got = inside.groupBy("source", F.shiftright("key", KEY_BITS - bits).alias("fine")).agg(F.sum("size").alias("tokens"), F.count("*").alias("n")).collect()
        found: dict[tuple, list] = {}
        for r in sorted(got, key=lambda r: r["fine"]):
            found.setdefault((r["source"]["none"], r["source"]["name"]), []).append(r)
        rest = {}
        for k, (_, before) in level.items():
            if k not in found:
                continue
            if bits == BIN_BITS:
                out[k] = {"all": sum(r["tokens"] for r in found[k]), "bin": None}
            for r in found[k]:
                if before + r["tokens"] > lack[k]:
                    if r["n"] <= BIN_ROWS or bits >= KEY_BITS:
                        out[k] |= {"bin": r["fine"], "bits": bits, "before": before}
                    else:
                        rest[k] = (r["fine"], before)
                    break
                before += r["tokens"]
        level = rest
    return out


def _fill(rows: DataFrame, sources: list[dict], limit: int) -> None:
    """Finds the keys of each source that bring its tokens near the target."""
    spark, p = rows.sparkSession, "_p"

    def now() -> DataFrame:
        return rows.join(_parameters(spark, sources, p), F.col("source") == F.col("_p.source"))

    rate = _rate(F.col("_p.lam"), F.col("size"), F.col("_p.mean"), limit)
    taken = _by_source(now().groupBy("source").agg(F.sum(F.floor(rate / MILLION) * F.col("size")).alias("t")).collect())
    for s in sources:
        s |= {"lack": round(s["target"]) - int(taken[_key(s)]["t"] or 0), "from": -1}
    for _ in range(PASSES):
        if not any(s["lack"] > 0 for s in sources):
            break
        begun = F.coalesce(F.get("_p.ranges", F.size("_p.ranges") - 1)["high"], F.lit(-1))
        keyed = now().withColumn("key", _place(rate, F.col("u"))).select("source", "size", "key", F.col("_p.lack").alias("lack"), begun.alias("begun"))
        open_ = keyed.where("lack > 0 and key > begun and size > 0 and size <= lack")
        crossing = _crossings(open_, sources)
        cut = [(*k, c["bin"], c["bits"], c["before"]) for k, c in crossing.items() if c["bin"] is not None]
        last = {}
        if cut:
            c = spark.createDataFrame(cut, "none boolean, name string, bin long, bits int, before long").select(F.struct("none", "name").alias("source"), "bin", "bits", "before")
            within = open_.join(_small(c, len(cut)), "source").where(F.call_function("shiftright", F.col("key"), F.lit(KEY_BITS) - F.col("bits")) == F.col("bin"))
            within = within.groupBy("source", "key", "lack", "before").agg(F.sum("size").alias("size"))
            run = within.withColumn("upto", F.col("before") + F.sum("size").over(Window.partitionBy("source").orderBy("key")))  # at most BIN_ROWS a source
            fits = F.col("upto") <= F.col("lack")
            last = _by_source(run.groupBy("source").agg(F.max(F.when(fits, F.struct("key", "upto"))).alias("last"), F.min("key").alias("first"), F.min(F.when(~fits, F.col("key"))).alias("over"), F.max("before").alias("before")).collect())
        for s in sources:
            k = _key(s)
            if s["lack"] <= 0 or k not in crossing:
                continue
            if r := last.get(k):
                # the range ends with the last key that fits; the key that didn't is passed over by all later ranges
                end, used = (r["last"]["key"], r["last"]["upto"]) if r["last"] else (r["first"] - 1, r["before"])
                s["ranges"] = [*s["ranges"], (s["from"], end, s["lack"]), (end, r["over"], 0)]
                s["from"] = r["over"]
            else:
                used = crossing[k]["all"]
                s["ranges"] = [*s["ranges"], (s["from"], 1 << KEY_BITS, s["lack"])]
                s["from"] = 1 << KEY_BITS
            s["lack"] -= used
    for _ in range(FINISH):
        if not any(s["lack"] > 0 for s in sources):
            return
        # the document whose size comes nearest to what is lacking, among those that may be taken once more
        size, lack = F.col("size"), F.col("_p.lack")
        more = now().where((lack > 0) & (size > 0) & (size < 2 * lack) & (_copies(limit, size, F.col("u"), p) < limit))
        best = more.groupBy("source").agg(F.min(F.struct(F.abs(size - lack), "u", size.alias("size"))).alias("x")).select("source", "x.u", "x.size").collect()
        if not best:
            return
        pick = spark.createDataFrame([(*k, r["u"]) for k, r in _by_source(best).items()], "none boolean, name string, pick double").select(F.struct("none", "name").alias("source"), "pick")
        alike = _by_source(rows.join(_small(pick, len(best)), "source").where("u = pick").groupBy("source").agg(F.sum("size").alias("size")).collect())
        for s in sources:
            if (r := _by_source(best).get(_key(s))) and abs(s["lack"] - alike[_key(s)]["size"]) < s["lack"]:
                s["extra"] = [*s["extra"], r["u"]]
                s["lack"] -= alike[_key(s)]["size"]
            elif s["lack"] > 0:
                s["lack"] = 0  # nothing comes nearer


def _copies(limit: int, size: Column, u: Column, p: str) -> Column:
    rate = _rate(F.col(f"{p}.lam"), size, F.col(f"{p}.mean"), limit)
    key = _place(rate, u)
    more = F.exists(f"{p}.ranges", lambda r: (key > r["low"]) & (key <= r["high"]) & (size <= r["most"]))
    single = F.size(F.filter(f"{p}.extra", lambda e: e == u))
    return (F.floor(rate / MILLION) + F.when(F.coalesce(more, F.lit(False)), 1).otherwise(0) + single).cast("int")


def _mixed(docs: DataFrame, source: str, text: str, limit: int, keep: tuple[str, ...]) -> tuple[DataFrame, Column, Column, str]:
    """Rows of ``docs`` (columns ``keep``) with their parameters; their size, their copies, and the name of the parameters."""
    mix, p = unused(docs.columns, "_mix"), unused(docs.columns, "_mix_of_source")
    keyed = _keyed(docs, source, text, mix).select(*keep, mix)
    written = stored(keyed if text not in keep else keyed.select(mix), "mix")  # texts aren't written twice
    rows = written.select(F.col(mix).alias("_mix")).select("_mix.source", "_mix.size", "_mix.u")
    joined = (written if text not in keep else keyed).join(_parameters(docs.sparkSession, _plan(rows, limit), p), F.col(f"{mix}.source") == F.col(f"{p}.source"))
    size = F.col(f"{mix}.size")
    return joined, size, _copies(limit, size, F.col(f"{mix}.u"), p), p


def mix(docs: DataFrame, source: str = "source", text: str = "text", limit: int = LIMIT, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep``, ``size``, ``source_size``, ``target`` and ``copies`` of every document."""
    joined, size, copies, p = _mixed(docs, source, text, limit, keep)
    return joined.select(*keep, size.alias("size"), F.col(f"{p}.source_size").alias("source_size"), F.col(f"{p}.target").alias("target"), copies.alias("copies"))


def mixed_documents(docs: DataFrame, source: str = "source", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it; documents without words have nothing to weigh: one copy."""
    joined, size, copies, _ = _mixed(docs, source, text, limit, tuple(docs.columns))
    n = F.when(size == 0, F.lit(1)).otherwise(copies)
    again = unused(docs.columns, "_copy")
    return joined.where(n > 0).select(*docs.columns, F.explode(F.sequence(F.lit(1), n)).alias(again)).select(*docs.columns)
