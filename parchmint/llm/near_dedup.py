"""Near-duplicate groups by SuperMinHash, banding, verification and union-find.

A document's set is its distinct ``shingle``-word shingles (ASCII letters lower-cased, words between ASCII white space).
SuperMinHash gives ``SLOTS`` values: in round j every shingle bids j plus a random fraction for the j-th place of its own
random permutation of the slots, and rounds stop as soon as every slot of the document is taken, after one or two for
all but short texts. Bands of ``ROWS`` values become bucket keys (a pair at similarity 0.8 shares none of the bands in 3
of a million cases) and one bit of each value makes a 256-bit sketch.

1. Documents with equal sets form a class, represented by its smallest doc_id; only representatives go on.
2. Buckets are counted; those with one member go, and of buckets with the same members one stays. A bucket is compared
   in blocks of ``BLOCK`` members, pairs of blocks for larger ones, so no task holds an unbounded bucket. Sketches that
   agree in ``AGREE`` of the bits (similarity 0.6 is expected there; 0.8 falls below in 1 of 10 million) join into
   families: a block gives only pairs that connect, not all of them.
3. Links are verified on the full sets, family by family, in bounded blocks: first each block by itself, with the family's
   smallest document in every one, which links most members of a group of copies at once; then the members not linked to
   it, in blocks of their own, against every block of the family. Every two members whose sketches agree are compared
   unless they are grouped already, and a block gives only the links that connect. So no link that could join two groups is
   left out, no group is expanded into all its pairs, and texts are dealt again only for the members that are left.
4. Families and links are both grouped by alternating large-star and small-star contraction, the union-find of a
   distributed edge list; a list of at most ``CLOSE_EDGES`` edges is closed in one task.

Cases: null and empty texts and texts of white space have an empty set and are linked with nothing; fewer words than a
shingle are one shingle; repeated rows get equal results; rows with one doc_id and different texts share their links;
rows with a null doc_id take no part and are kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parchmint.llm.codes import hashed
from parchmint.llm.shared import narrow_batches, sliced, stored

SLOTS, ROWS = 256, 6
BANDS = SLOTS // ROWS
BLOCK = 512
AGREE = 0.80
#: Shingles of a block whose full sets one task holds twice, at most, save a larger single document.
BLOCK_SHINGLES = 1_000_000
#: Rows that may be broadcast (some 100 bytes each at most); more are joined by shuffling.
BROADCAST_ROWS = 200_000
#: Edges per file of an edge list.
EDGE_ROWS = 250_000
#: An edge list of at most so many edges (some 200 MB in that task) is grouped by one task; larger ones by rounds of joins.
CLOSE_EDGES = 1_000_000
_CHUNK = 1 << 16
#: Bytes of text whose words are cut at a time, save one longer word.
PIECE = 1 << 17
_SPACE = re.compile(rb"[\x20\t-\r]")
_U = np.uint64


def split(text: str | None) -> list[bytes]:
    """Words: bytes.lower() and bytes.split() know ASCII letters and ASCII white space only, as asked."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shingle_set(text: str | None, shingle: int) -> set[tuple[bytes, ...]]:
    """A document's set, spelled out: what the hashes below stand for."""
    w = split(text)
    return set(zip(*(w[i:] for i in range(shingle)))) if len(w) >= shingle else {tuple(w)} if w else set()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.array([ord(chr(b).lower()) if b < 128 else b for b in range(256)], np.uint8)


def _words(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(starts, hashes) of the words of a row of bytes."""
    codes = _LOWER[np.frombuffer(raw, np.uint8)]
    edges = np.flatnonzero(np.diff(~_BLANK[codes], prepend=False, append=False))
    return edges[::2], hashed(codes, edges[::2], edges[1::2])


def _long_words(raw: bytes) -> np.ndarray:
    out, at = [], 0
    while at < len(raw):
        cut = _SPACE.search(raw, at + PIECE)
        end = cut.start() if cut else len(raw)
        out.append(_words(raw[at:end])[1])
        at = end
    return np.concatenate(out)


def _set_of(words: np.ndarray, shingle: int) -> np.ndarray:
    return np.unique(_shingled(words, min(shingle, len(words)))) if len(words) else np.empty(0, _U)


def hashed_sets(texts: list[str | None], shingle: int) -> list[np.ndarray]:
    """Per text: distinct 64-bit hashes of its shingles, ascending. Words are cut and hashed in rows of up to ``PIECE`` bytes."""
    out: list = [None] * len(texts)
    group, held = [], 0

    def close() -> None:
        sizes = np.array([len(r) + 1 for _, r in group])
        starts, words = _words(b"\n".join([r for _, r in group]))
        first = np.append(np.searchsorted(starts, np.cumsum(sizes) - sizes), len(starts)).tolist()
        for (i, _), a, b in zip(group, first, first[1:], strict=False):
            out[i] = _set_of(words[a:b], shingle)

    for i, t in enumerate(texts):
        raw = t.encode("utf-8", "surrogatepass") if t else b""
        if len(raw) > PIECE:
            out[i] = _set_of(_long_words(raw), shingle)
            continue
        if held + len(raw) > PIECE:
            close()
            group, held = [], 0
        group.append((i, raw))
        held += len(raw) + 1
    if group:
        close()
    return out


def _shingled(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of every n words in a row."""
    h = np.full(max(0, len(words) - n + 1), n, _U)
    for i in range(n):
        h = h * _U(0x9E3779B97F4A7C15) + _mix(words[i : i + len(h)])
        h ^= h >> _U(29)
    return _mix(h)


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    return hashed_sets([text], shingle)[0]


def super_minhash(sets: list[np.ndarray]) -> np.ndarray:
    """Signatures (one row of SLOTS per nonempty set): round number in the high half, random fraction in the low."""
    sizes = np.array([len(s) for s in sets])
    out = np.full(len(sets) * SLOTS, np.iinfo(np.uint64).max, _U)
    e, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    places = None
    for j in range(SLOTS):
        draw = _mix(e + _U((2 * j + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
        at = j + ((draw >> _U(40)) * _U(SLOTS - j) >> _U(24)).astype(np.int64)
        if j == 0:
            slot = at
        else:
            if places is None:  # the permutations so far: place 0 was swapped with slot
                places = np.tile(np.arange(SLOTS, dtype=np.uint8), (len(e), 1))
                row = np.arange(len(e))
                places[row, first] = 0
                places[:, 0] = first
            row = np.arange(len(e))
            slot = places[row, at].astype(np.int64)
            places[row, at] = places[:, j]
        cell = owner * SLOTS + slot
        np.minimum.at(out, cell, _U(j << 32) | (draw & _U(0xFFFFFFFF)))
        open_ = (out.reshape(-1, SLOTS)[:, :] == np.iinfo(np.uint64).max).any(axis=1)
        keep = open_[owner]
        if not keep.any():
            break
        if j == 0:
            first = slot[keep]
        else:
            places = places[keep]
        e, owner = e[keep], owner[keep]
    return out.reshape(-1, SLOTS)


_SKETCH = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("bits", pa.binary()), ("bands", pa.list_(pa.int64()))])
SKETCH = "doc_id long, n_shingles long, k1 long, k2 long, bits binary, bands array<long>"


def set_key(hashes: np.ndarray) -> tuple[int, int]:
    import xxhash

    d = xxhash.xxh3_128_intdigest(hashes.tobytes())
    return (d >> 64) - (1 << 63), (d & ((1 << 64) - 1)) - (1 << 63)


def _sketch(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    docs, sets, held = [], [], 0

    def drain() -> pa.RecordBatch:
        nonlocal docs, sets, held
        some = [i for i, s in enumerate(sets) if len(s)]
        bits, bands = [None] * len(sets), [None] * len(sets)
        if some:
            sig = super_minhash([sets[i] for i in some])
            packed = np.packbits((sig & _U(1)).astype(np.uint8), axis=1)
            used = sig[:, : BANDS * ROWS].reshape(len(sig), BANDS, ROWS)
            band = np.tile(np.arange(1, BANDS + 1, dtype=_U), (len(sig), 1))
            for r in range(ROWS):
                band = _mix(band * _U(0x9E3779B97F4A7C15) + used[:, :, r])
            rows = band.view(np.int64).tolist()
            for at, i in enumerate(some):
                bits[i], bands[i] = packed[at].tobytes(), rows[at]
        keys = [set_key(s) for s in sets]
        columns = [docs, [len(s) for s in sets], [k[0] for k in keys], [k[1] for k in keys], bits, bands]
        docs, sets, held = [], [], 0
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SKETCH, strict=True)], schema=_SKETCH)

    for batch in sliced(batches, 1, size=1 << 20):
        for doc, own in zip(batch.column(0).to_pylist(), hashed_sets(batch.column(1).to_pylist(), shingle), strict=True):
            docs.append(doc)
            sets.append(own)
            held += len(sets[-1])
            if held >= _CHUNK or len(sets) >= 4000:
                yield drain()
    if docs:
        yield drain()


def _connect(rows: list[tuple], similar: Callable[[int, int], bool] | None) -> list[tuple[int, int]]:
    """Pairs that connect the members of one block or pair of blocks; rows: (side, doc, bits, ...). With two sides only
    pairs across count. Sketches must agree, and ``similar`` must hold where it is given."""
    docs, side = [r[1] for r in rows], np.array([r[0] for r in rows])
    bits = np.frombuffer(b"".join(r[2] for r in rows), _U).reshape(len(rows), -1)
    crossing, most = rows[0][0] != rows[-1][0], SLOTS - int(AGREE * SLOTS)
    label, out = np.arange(len(rows)), []
    for i in range(len(rows) - 1):
        apart = np.bitwise_count(bits[i + 1 :] ^ bits[i]).sum(axis=1, dtype=np.int64)
        ok = (apart <= most) & (label[i + 1 :] != label[i])
        if crossing:
            ok &= side[i + 1 :] != side[i]
        found = np.flatnonzero(ok) + i + 1
        for j in found[np.argsort(apart[found - i - 1], kind="stable")].tolist() if similar else found.tolist():
            if label[j] != label[i] and docs[i] != docs[j] and (similar is None or similar(i, j)):
                label[label == label[j]] = label[i]
                out.append((min(docs[i], docs[j]), max(docs[i], docs[j])))
    return out


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two ascending sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int(np.count_nonzero(b[at] == a))


def _similar(sets: list[np.ndarray], percent: int) -> Callable[[int, int], bool]:
    def test(i: int, j: int) -> bool:
        n, m = len(sets[i]), len(sets[j])
        if 100 * min(n, m) < percent * max(n, m):
            return False
        both = _shared(sets[i], sets[j])
        return both > 0 and 100 * both >= percent * (n + m - both)

    return test


def _compare(batches: Iterator[pa.RecordBatch], shingle: int | None, percent: int) -> Iterator[pa.RecordBatch]:
    """Rows (key, p, q, side, doc, bits[, text]), sorted by key, p, q, side, doc: connecting pairs (a, b).

    Without texts (``shingle`` None) sketches decide; with them the full sets do.
    """
    now, rows, found = None, [], set()

    def close() -> None:
        if len(rows) > 1:
            sets = None if shingle is None else _similar([r[3] for r in rows], percent)
            found.update(_connect(rows, sets))

    def drain() -> pa.RecordBatch:
        some = sorted(found)
        found.clear()
        return pa.RecordBatch.from_arrays([pa.array([p[i] for p in some], pa.int64()) for i in (0, 1)], names=["a", "b"])

    for batch in batches:
        for key, p, q, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (key, p, q) != now:
                close()
                now, rows = (key, p, q), []
                if len(found) >= 50_000:
                    yield drain()
            if shingle is not None:
                row[3] = shingle_hashes(row[3], shingle)
            rows.append(row)
    close()
    if found:
        yield drain()


def _sorted_blocks(dealt: DataFrame, key: str) -> DataFrame:
    n = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(n, key, "p", "q").sortWithinPartitions(key, "p", "q", "side", "doc")


def _every(n: Column) -> Column:
    return F.explode(F.sequence(F.lit(0), n - 1))


def _block(key: str, n: Column) -> Column:
    return F.pmod(F.xxhash64("doc", key), n).cast("int")


def _in_blocks(members: DataFrame, key: str) -> DataFrame:
    """Rows (key, p, q, side, doc, bits) sorted for ``_compare``; ``members``: key, blocks, doc, bits."""
    dealt = members.withColumn("block", _block(key, F.col("blocks"))).select(key, "doc", "bits", "block", _every(F.col("blocks")).alias("other"))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    side = F.when(F.col("block") == low, 0).otherwise(1).alias("side")
    return _sorted_blocks(dealt.select(key, low.alias("p"), high.alias("q"), side, "doc", "bits"), key)


def _only(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    """Rows (..., doc, k1, k2, text) whose text has that set, once per doc, set and partition."""
    seen = set()
    for batch in batches:
        doc, k1, k2, text = (batch.column(batch.num_columns - i).to_pylist() for i in (4, 3, 2, 1))
        ok = []
        for d, x, y, t in zip(doc, k1, k2, text, strict=True):
            ok.append((d, x, y) not in seen and set_key(shingle_hashes(t, shingle)) == (x, y))
            if ok[-1]:
                seen.add((d, x, y))
        yield batch.filter(pa.array(ok, pa.bool_()))


def _links(docs: DataFrame, reps: DataFrame, families: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Links that connect the groups within each family (doc, family), verified on full sets."""
    spark = docs.sparkSession
    told = families.join(reps.select("doc", "k1", "k2", "bits", "n_shingles"), "doc")
    blocks = F.greatest(F.ceil(F.count("*") / (2 * BLOCK)), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES), F.lit(1)).cast("int")
    sizes = told.groupBy("family").agg(blocks.alias("blocks"))
    wanted = stored(told.join(sizes, "family").select("family", "blocks", "bits", "doc", "k1", "k2"), "wanted")
    counted = wanted.agg(F.count("*"), F.max("blocks")).first()
    texts = docs.join(F.broadcast(wanted) if counted[0] <= BROADCAST_ROWS else wanted, docs["doc_id"] == wanted["doc"])
    texts = texts.select("family", "blocks", "bits", "doc", "k1", "k2", "text")
    texts = texts.mapInArrow(partial(_only, shingle=shingle), "family long, blocks int, bits binary, doc long, k1 long, k2 long, text string").drop("k1", "k2")
    several = (counted[1] or 0) > 1
    if several:
        texts = stored(texts, "texts")
    kernel = partial(_compare, shingle=shingle, percent=percent)
    home, n, zero = _block("family", F.col("blocks")), F.col("blocks"), F.lit(0)
    # the family's smallest document stands in every block
    at = F.explode(F.when(F.col("doc") == F.col("family"), F.sequence(zero, n - 1)).otherwise(F.array(home))).alias("p")
    first = texts.select("family", at, zero.alias("q"), zero.alias("side"), "doc", "bits", "text")
    links = stored(_sorted_blocks(first, "family").mapInArrow(kernel, "a long, b long"), "links")
    if not several:
        return links
    large = texts.where("blocks > 1")
    grouped = components(spark, links)
    left = large.select("family", "doc").distinct().join(grouped, "doc", "left").where(F.coalesce("group", "doc") != F.col("family")).select("family", "doc")
    left = stored(left, "left")
    per_family = stored(left.groupBy("family").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("left_blocks")), "left-blocks")
    if per_family.limit(1).count() == 0:
        return links
    large = large.join(per_family, "family")
    mine = large.join(left, ["family", "doc"]).withColumn("q", F.pmod(F.xxhash64("family", "doc", F.lit(3)), F.col("left_blocks")).cast("int"))
    dealt = large.select("family", home.alias("p"), _every(F.col("left_blocks")).alias("q"), zero.alias("side"), "doc", "bits", "text")
    dealt = dealt.union(mine.select("family", _every(n).alias("p"), "q", F.lit(1).alias("side"), "doc", "bits", "text"))
    return stored(links.union(_sorted_blocks(dealt, "family").mapInArrow(kernel, "a long, b long")), "links")


def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over all edges (u, v) of one partition."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (above := up.get(top, top)) != top:
            top = above
        while x != top:
            up[x], x = top, up.get(x, x)
        return top

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(u), root(v)
            if a != b:
                up[max(a, b)] = min(a, b)
    nodes = sorted(up)
    for at in range(0, len(nodes), 50_000):
        some = nodes[at : at + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([root(x) for x in some], pa.int64())], names=["doc", "group"])


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """(doc, group): the smallest node reachable, for every node of an edge list (a, b) but those smallest themselves.

    Large-star joins each node's larger neighbours to its smallest one, small-star its smaller ones; when neither changes
    an edge, every component is a star around its smallest node.
    """
    def kept(rows: DataFrame, n: int) -> DataFrame:
        return stored(rows.coalesce(max(1, n // EDGE_ROWS)), "edges")

    n = links.count()
    pairs = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    if n <= CLOSE_EDGES:
        return stored(pairs.coalesce(1).mapInArrow(_close, "doc long, group long"), "groups")
    edges = kept(pairs.distinct(), n)
    state = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state or not now[0]:
            return edges.select(F.col("u").alias("doc"), F.col("v").alias("group"))
        state, n = now, now[0]
        if n <= CLOSE_EDGES:
            return stored(edges.coalesce(1).mapInArrow(_close, "doc long, group long"), "groups")
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = kept(small.union(small_least.select("u", F.col("m").alias("v"))).distinct(), n)


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: groups of documents whose sets overlap in ``percent`` of their union."""
    spark = docs.sparkSession
    narrow_batches(spark)
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    sketches = stored(docs.mapInArrow(partial(_sketch, shingle=shingle), SKETCH), "sketches")
    named = sketches.where("doc_id is not null and n_shingles > 0")
    first = named.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "n_shingles", "bits", "bands")).alias("x"))
    reps = first.select("k1", "k2", F.col("x.doc_id").alias("doc"), "x.n_shingles", "x.bits", "x.bands")
    reps = stored(reps, "representatives")

    # members are named by doc_id: one with two texts brings both of its sets along, of which one may be no member
    banded = reps.select("doc", F.explode("bands").alias("bucket"))
    buckets = banded.groupBy("bucket").agg(
        F.count("*").alias("n"), F.min("doc").alias("low"), F.max("doc").alias("high"),
        F.sum(F.xxhash64("doc").cast("decimal(20,0)")).alias("s"), F.bit_xor(F.xxhash64("doc", F.lit(5))).alias("x"),
    ).where("n > 1")
    buckets = stored(buckets.groupBy("n", "low", "high", "s", "x").agg(F.min("bucket").alias("bucket")).drop("s", "x"), "buckets")
    pairs_of_two = buckets.where("n = 2").select("bucket", "n", F.explode(F.array("low", "high")).alias("doc"))
    large = buckets.where("n > 2").select("bucket", "n")
    if large.count() <= BROADCAST_ROWS:
        large = F.broadcast(large)  # the bands needn't be dealt a second time
    larger = banded.join(large, "bucket").select("bucket", "n", "doc")
    members = pairs_of_two.union(larger).distinct().join(reps.select("doc", "bits"), "doc")
    members = members.select("bucket", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"), "doc", "bits")
    compared = _in_blocks(members, "bucket").mapInArrow(partial(_compare, shingle=None, percent=0), "a long, b long")
    pairs = stored(compared.distinct(), "pairs")

    families = components(spark, pairs).withColumnRenamed("group", "family")
    families = families.union(families.select("family", "family").distinct())
    links = _links(docs, reps, families, shingle, percent)
    texts = F.struct("k1", "k2")
    several = stored(named.groupBy("doc_id").agg(F.min(texts).alias("low"), F.max(texts).alias("high")).where("low <> high").select("doc_id"), "several")
    if several.count():  # one doc_id with two texts joins the classes of both
        of_both = named.select("doc_id", "k1", "k2").join(several, "doc_id").join(reps.select("k1", "k2", "doc"), ["k1", "k2"])
        links = stored(links.union(of_both.where("doc_id <> doc").select("doc_id", "doc")), "links")
    groups = components(spark, links)

    of_class = reps.select("k1", "k2", "doc").join(groups, "doc", "left").select("k1", "k2", F.coalesce("group", "doc").alias("component"))
    out = sketches.select("doc_id", "n_shingles", "k1", "k2").join(of_class, ["k1", "k2"], "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNull(), F.lit(None).cast("long")).otherwise(component)
    out = out.select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def without_near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` less the documents that aren't the smallest doc_id of their group; rows of one doc_id go together."""
    dropped = stored(near_duplicates(docs, shingle, percent).where("not kept").select(F.col("doc_id").alias("dropped")).distinct(), "dropped")
    if dropped.count() <= BROADCAST_ROWS:
        dropped = F.broadcast(dropped)
    return docs.join(dropped, docs["doc_id"] == dropped["dropped"], "left_anti")
