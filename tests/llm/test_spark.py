"""The training-data operators on small tables with every odd case: nulls, empty and long texts, ties, repeated rows,
empty tables, and extra columns whose names clash with the operators' own."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from parchmint.llm import ann, maxscore, mixing, near_dedup, packing, pii, secrets, sharding, toxicity, wavelet
from parchmint.llm.shared import word_count

PATH = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, source string, lang string, n_chars long, size long, score double, part int, key string, copies int, bits string"


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, s, "en", 1, 2, 0.5, 3, "k", 4, "b") for i, t, s in rows], DOCS)


ODD = [
    (3, "Paid with 4111 1111 1111 1111, call +1 (408) 555-2186. mail a.b@x.org", "a"),
    (1, None, None), (2, "", "b"), (None, "no id here", "b"), (5, "tie tie", "a"), (5, "tie tie", "a"), (4, "É ß 中文 😀 " * 40, "c"),
    (7, "word " * 5000, "a"), (8, "10.0.0.256 10.0.0.25 1.2.3.4.5.6.7.8", "a"), (9, "   \n\t ", "z"),
]


def _spans(text):
    text = text or ""
    digits = lambda s: sum(c in "0123456789" for c in s)

    def luhn(s):
        d = [int(c) for c in s if c in "0123456789"][::-1]
        return sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d)) % 10 == 0

    found = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= digits(s) <= 19 and luhn(s)),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= digits(s) <= 15),
    )
    return [(k, *m.span()) for k, p, ok in found for m in re.finditer(p, text) if ok(m[0])]


def _pii(spark, rows):
    out = pii.find_pii(_docs(spark, rows))
    every = F.concat(*[F.col("pii_" + k) for k in pii.BASE_KINDS])
    return out.select("doc_id", "text", every.alias("s")).collect()


def test_pii_against_brute_force(spark):
    rng = random.Random(4)
    bits = ["a@b.c", "@", ".", "1", "22", "255", "256", " ", "-", "+1", "(408)", "4111 1111 1111 1111", "x", "_", "a@b.c@d.ef", "1.2.3.4", "+1 408 555 2186", "é", "😀", "--", ".."]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(1, 25))), "a") for i in range(400)] + ODD
    for r in _pii(spark, rows):
        assert [(s["kind"], s["start"], s["end"]) for s in r["s"]] == _spans(r["text"]), r["text"]


def test_pii_long_runs_and_many_matches(spark):
    # the plain patterns take the square of a run: short runs are held against them, long ones must only end in time
    short = ["a@b" + ".c" * 500, "1" * 600, "1 " * 600, "x" * 900 + "@", "a@b.cd " * 700, "+1" * 500, "1." * 900]
    for r in _pii(spark, [(i, t, "a") for i, t in enumerate(short)]):
        assert [(s["kind"], s["start"], s["end"]) for s in r["s"]] == _spans(r["text"])
    long = ["a@b" + ".c" * 20_000, "1" * 50_000, "1 " * 30_000, "x" * 100_000 + "@", "a@b.cd " * 3000, "+1" * 20_000, "1." * 30_000]
    assert [len(r["s"]) for r in sorted(_pii(spark, [(i, t, "a") for i, t in enumerate(long)]), key=lambda r: r["doc_id"])] == [1, 0, 0, 0, 3000, 0, 7500]


def test_pii_added_kinds_and_redaction(spark):
    rows = [(1, "IBAN GB82 WEST 1234 5698 7654 32 ok", "a"), (2, "GB82WEST12345698765433", "a"), (3, "my ssn: 219-09-9999", "a"), (4, "part 219-09-9999", "a")]
    found = {r["doc_id"]: (len(r["pii_iban"]), len(r["pii_ssn"])) for r in pii.find_pii(_docs(spark, rows)).collect()}
    assert found == {1: (1, 0), 2: (0, 0), 3: (0, 1), 4: (0, 0)}
    clean = pii.redact(_docs(spark, [(1, "a@b.cd and 10.0.0.1", "a"), (2, None, "a")]))
    assert {r["doc_id"]: r["text"] for r in clean.collect()} == {1: "[email] and [ip]", 2: None}


def _ids(text):
    return np.array(Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids + [1], "<u4").tobytes()


def test_token_shards_round_trip(spark, tmp_path):
    wavelet.write_token_shards(_docs(spark, ODD), str(tmp_path / "s"), PATH, shard_tokens=64)
    got = sorted(wavelet.read_token_shards(spark, str(tmp_path / "s")).collect(), key=lambda r: r["start"])
    want = sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0))
    at = 0
    assert [r["doc_id"] for r in got] == [w[0] for w in want]
    for r, w in zip(got, want, strict=True):
        assert (r["start"], bytes(r["ids"])) == (at, _ids(w[1]))
        at += r["n_tokens"]


def test_shards_are_near_equal_and_gapless(spark):
    rng = random.Random(1)
    hot = [(i, "copy of one text", "a") for i in range(1000, 1600)]
    rows = [(i, "w" * rng.randint(1, 60), "a") for i in range(100, 1000)] + hot + ODD
    got = sharding.shard_documents(_docs(spark, rows), shards=4, part_rows=200).collect()
    assert len(got) == len(rows)
    total = sum(r["size"] for r in got)
    for s in range(4):
        mine = [r for r in got if r["shard"] == s]
        assert sorted(r["slot"] for r in mine) == list(range(len(mine)))
        assert abs(sum(r["size"] for r in mine) - total / 4) <= max(r["size"] for r in got)
    assert all(r["size"] == len((dict((a, b) for a, b, _ in rows).get(r["doc_id"]) or "").encode()) + 1 for r in got if r["doc_id"] not in (None, 5))
    place = [(r["key"], r["doc_id"] if r["doc_id"] is not None else -1) for r in sorted(got, key=lambda r: (r["shard"], r["slot"]))]
    assert place == sorted(place)


def test_packing_on_odd_rows(spark):
    got = packing.pack_documents(_docs(spark, ODD), PATH).collect()
    for doc in {r[0] for r in ODD}:
        pieces = [r for r in got if r["doc_id"] == doc]
        assert sum(r["length"] for r in pieces) == sum(len(_ids(t)) // 4 for i, t, _ in ODD if i == doc)
    room = {}
    for r in got:
        room.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in room.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048


def test_secrets_keep_columns_and_rows(spark):
    rows = [*ODD, (20, 'password = "abcdef12345" AKIA' + "Q" * 16, "a")]
    found = secrets.scan_secrets(_docs(spark, rows)).collect()
    assert len(found) == len(rows) and [len(r["secrets"]) for r in found if r["doc_id"] == 20] == [2]
    masked = secrets.mask_secrets(_docs(spark, rows))
    assert masked.columns == _docs(spark, rows).columns
    assert {r["text"] for r in masked.collect() if r["doc_id"] == 20} == {'password = "[secret]" [secret]'}


def test_mixing_meets_targets(spark):
    rng = random.Random(2)
    rows = [(i, "w " * rng.randint(1, 40), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(1500)] + ODD
    docs = _docs(spark, rows)
    got = mixing.mix(docs, keep=("doc_id", "source")).collect()
    assert len(got) == len(rows) and all(0 <= r["copies"] <= 3 for r in got)
    by = {}
    for r in got:
        x = by.setdefault(r["source"], [0, r["target"], r["source_size"], 0])
        x[0] += r["copies"] * r["size"]
        x[3] += r["size"]
    assert sum(x[1] for x in by.values()) == pytest.approx(sum(x[2] for x in by.values()))
    for taken, target, size, counted in by.values():
        assert size == counted and target <= 3 * size + 1e-6
    for s in ("a", "b", None):
        assert by[s][0] == pytest.approx(by[s][1], rel=0.02)
    again = mixing.mix(docs, keep=("doc_id", "source")).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    repeated = mixing.mixed_documents(docs)
    assert repeated.columns == docs.columns and repeated.count() == sum(r["copies"] if r["size"] else 1 for r in got)


def test_word_count(spark):
    df = spark.createDataFrame([("a b",), ("",), (None,), (" \x0b a\r\nb c ",)], "t string")
    assert [r[0] for r in df.select(word_count("t")).collect()] == [2, 0, 0, 2]


def _groups(rows, shingle, percent=80):
    ids = [(i, near_dedup.shingle_set(t, shingle)) for i, t, _ in rows if i is not None]
    parent = {i: i for i, _ in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (i, a) in enumerate(ids):
        for j, b in ids[n + 1 :]:
            if a and b and 100 * len(a & b) >= percent * len(a | b) and root(i) != root(j):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return {i: root(i) for i, _ in ids}


@pytest.mark.parametrize("shingle", [2, 5])
def test_near_duplicates_against_brute_force(spark, shingle):
    rng = random.Random(shingle)
    voc = ["w%d" % i for i in range(400)]
    rows, i = list(ODD), 100
    for _ in range(40):
        base = [rng.choice(voc) for _ in range(rng.randint(3, 120))]
        for _ in range(rng.randint(1, 9)):
            copy = [rng.choice(voc) if rng.random() < 0.02 else w for w in base]
            rows.append((i, " ".join(copy).upper() if rng.random() < 0.2 else " ".join(copy), "a"))
            i += 1
    chain = [rng.choice(voc) for _ in range(150)]
    for _ in range(60):  # drifts away word by word: far ends are linked only through the middle
        chain[rng.randrange(150)] = rng.choice(voc)
        rows.append((i, " ".join(chain), "a"))
        i += 1
    want = _groups(rows, shingle)
    got = near_dedup.near_duplicates(_docs(spark, rows), shingle).collect()
    assert len(got) == len(rows)
    texts = {a: t for a, t, _ in rows}
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["component_id"], r["kept"], r["n_shingles"]) == (want[r["doc_id"]], want[r["doc_id"]] == r["doc_id"], len(near_dedup.shingle_set(texts[r["doc_id"]], shingle)))
    left = near_dedup.without_near_duplicates(_docs(spark, rows), shingle)
    assert sorted(str(r["doc_id"]) for r in left.collect()) == sorted(str(a) for a, _, _ in rows if a is None or want[a] == a)


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r["doc"]: r["group"] for r in near_dedup.components(spark, edges).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {101: 100}


def _vectors(seed, n=400, d=16):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)).astype(np.float32)
    x[50:120] = x[50]  # one vector that many rows share
    rows = [(i, [float(v) for v in x[i]]) for i in range(n)]
    bad = [(1000, None), (1001, [None] * d), (1002, [float("nan")] * d), (1003, [float("inf")] * d), (1004, [0.0] * d), (None, rows[0][1]), (1005, []), (60, rows[60][1])]
    return rows, bad


def test_exact_search_against_brute_force(spark):
    rows, bad = _vectors(3)
    df = spark.createDataFrame(rows + bad, "id long, v array<float>")
    got = {}
    for r in maxscore.top_k(df, F.col("id") % 20 == 0, 5).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], -r["score"], r["id"]))
    whole = {i: np.floor(64 * np.array(v, np.float64)) for i, v in rows} | {1004: np.zeros(16)}
    for q in [i for i in whole if i % 20 == 0]:
        want = sorted((-int(whole[q] @ w), i) for i, w in whole.items() if i != q)[:5]
        assert [(s, i) for _, s, i in sorted(got[q])] == want
    assert set(got) == {i for i in whole if i % 20 == 0}


def test_nearest_against_brute_force(spark):
    rows, bad = _vectors(5)
    df = spark.createDataFrame(rows + bad, "id long, v array<float>")
    got, hit = {}, 0
    for r in ann.nearest(df, F.col("id") % 20 == 0, 5).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], -r["score"], r["id"]))
    x = {i: np.array(v, np.float64) for i, v in rows}
    assert set(got) == {i for i in x if i % 20 == 0}
    for q, found in got.items():
        want = sorted((-float(ann.exact_scores(w[None], x[q])[0]), i) for i, w in x.items() if i != q)[:5]
        assert [r for r, _, _ in sorted(found)] == [1, 2, 3, 4, 5] and [(s, i) for _, s, i in sorted(found)] == sorted((s, i) for _, s, i in found)
        hit += len({i for _, _, i in found} & {i for _, i in want})
    assert hit >= 0.9 * 5 * len(got)
    assert [i for _, _, i in sorted(got[60])] == [i for i in range(50, 120) if i != 60][:5]


def test_toxicity_learns_from_taught_rows_only(spark):
    rng = random.Random(8)
    voc = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(200)]
    rows, labels = [], []
    for i in range(600):
        words = [rng.choice(voc) for _ in range(rng.randint(3, 40))]
        if toxic := i % 5 == 0:
            words.insert(rng.randrange(len(words)), "zzgrr" + rng.choice(["ak", "el", "im"]))
        rows.append((i, " ".join(words), "a"))
        held = zlib.crc32(str(i).encode()) % 4 == 2
        labels.append((i, 1, int(toxic) if not held else int(not toxic)))
    docs = _docs(spark, rows + ODD[1:4])
    lab = spark.createDataFrame([*labels, (None, 1, 1), (1, 1, None), (99999, 1, 1)], "doc_id long, quality int, toxic int")
    got = [r for r in toxicity.fit(docs, lab).score(docs, keep=("doc_id", "text")).collect()]
    assert len(got) == len(rows) + 3 and all(0 <= r["score"] <= 1 for r in got)
    judged = [(r["score"] >= 0.3, "zzgrr" in (r["text"] or "")) for r in got]
    assert sum(a == b for a, b in judged) >= 0.97 * len(judged)
    none = toxicity.fit(docs, lab.where("toxic = 0")).score(docs).collect()
    assert {r["score"] for r in none} == {0.0}


def test_empty_tables(spark, tmp_path):
    docs = _docs(spark, [])
    vectors = spark.createDataFrame([], "id long, v array<float>")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    wavelet.write_token_shards(docs, str(tmp_path / "e"), PATH)
    for df in (
        pii.find_pii(docs), wavelet.read_token_shards(spark, str(tmp_path / "e")), sharding.shard_documents(docs), toxicity.fit(docs, labels).score(docs),
        ann.nearest(vectors, F.col("id") % 20 == 0), secrets.scan_secrets(docs), mixing.mix(docs), mixing.mixed_documents(docs),
        maxscore.top_k(vectors, F.col("id") % 20 == 0), near_dedup.near_duplicates(docs), packing.pack_documents(docs, PATH),
    ):
        assert df.count() == 0


def test_queries_are_registered():
    from parchmint.llm import queries

    assert sorted(int(re.match(r"op(\d+)_", q)[1]) for q in queries.queries()) == list(range(1, 11))
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")
