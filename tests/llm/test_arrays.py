"""The array forms of the kernels against their plain statements, at sizes where blocks and pieces matter."""

import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from parchmint.llm import near_dedup, tokens, toxicity, wavelet

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["réeux Größe naïve", "ΑΣ Σ ΣΑ İx", "it's he'll we''re 's's 'd", "a\x00b \x00 \x00\x00", "<|endoftext|> a<|endoftext|>b", "x" * 700, "中文 字 😀 é", "don 't  re ''ll .'s", "", " \t\n"]


def _texts(seed, n=40):
    rng = random.Random(seed)
    bits = ["the", "it's", "Größe", "12", "a.b@c", "İ", "Σ", "中", "''", "x" * 30, "\x85", " ", "é́", "'S", "10%"]
    return [" ".join(rng.choice(bits) for _ in range(rng.randint(0, 60))) for _ in range(n)] + ODD


def test_pieces_and_caches_change_no_token(monkeypatch):
    texts = _texts(1)
    plain = tokens.TextTokenizer(PATH)
    want = plain._raw(texts)
    assert plain.encode(texts) == want and plain.by_word
    monkeypatch.setattr(tokens, "PIECE", 40)
    monkeypatch.setattr(tokens, "CACHE_IDS", 50)
    assert tokens.TextTokenizer(PATH).encode(texts) == want


def _models(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 9)))
    return {word(): (rng.randint(0, 5), rng.randint(0, 2)) for _ in range(300)} | {"zzidiot": (0, 9), "q" * 90: (1, 0)}


def test_tables_equal_the_models(monkeypatch):
    counts = {w: c for w, c in _models(3).items() if sum(c)}
    names = sorted(counts)
    m = toxicity.Models(counts)
    for size in (7, 20_000):
        monkeypatch.setattr(toxicity, "CHUNK_WORDS", size)
        s = toxicity.Scorer(toxicity.Tables(names, np.array([counts[n] for n in names])), None)
        for w in [*names[:60], "zzidiots", "abc", "ééé", "y", "q" * 91]:
            assert s.evidence([w])[0] == pytest.approx(sum(m.score(w)), abs=1e-9)


def test_evidence_is_the_mean_of_the_most_toxic_words(monkeypatch):
    counts = {w: c for w, c in _models(4).items() if sum(c)}
    names, m = sorted(counts), toxicity.Models(counts)
    texts = [" ".join(random.Random(i).choices(names, k=i)) for i in range(30)] + [None, *ODD]

    def plain(text):
        best = sorted((sum(m.score(w)) for w in toxicity.words(text)), reverse=True)[: toxicity.FEW]
        return sum(best) / len(best) if best else 0.0

    for piece in (1 << 18, 30):
        monkeypatch.setattr(toxicity, "PIECE", piece)
        got = toxicity.Scorer(toxicity.Tables(names, np.array([counts[n] for n in names])), None).evidence(texts)
        assert got.tolist() == pytest.approx([plain(t) for t in texts], abs=1e-9)


def test_hashed_sets_stand_for_shingles(monkeypatch):
    texts = [*_texts(5), None]
    for piece in (1 << 18, 25):
        monkeypatch.setattr(near_dedup, "PIECE", piece)
        for n in (1, 2, 5):
            sets = near_dedup.hashed_sets(texts, n)
            assert [len(s) for s in sets] == [len(near_dedup.shingle_set(t, n)) for t in texts]
            assert all((near_dedup.shingle_hashes(t, n) == s).all() for t, s in zip(texts, sets, strict=True))


@pytest.mark.parametrize("close", [0, 1_000_000])
def test_families_of_many_blocks_lose_no_link(spark, monkeypatch, close):
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    monkeypatch.setattr(near_dedup, "CLOSE_EDGES", close)
    rng = random.Random(9)
    voc, rows = ["w%d" % i for i in range(500)], []
    for _ in range(2):  # drifting copies: far ends are no near copies of the first, and some stand alone
        base = [rng.choice(voc) for _ in range(120)]
        for _ in range(45):
            base[rng.randrange(120)] = rng.choice(voc)
            rows.append((len(rows) * 3 + 1, " ".join(base)))
            if rng.random() < 0.3:
                far = list(base)
                for _ in range(9):
                    far[rng.randrange(120)] = rng.choice(voc)
                rows.append((len(rows) * 3 + 1, " ".join(far)))
    sets, group = [(i, near_dedup.shingle_set(t, 2)) for i, t in rows], {i: i for i, _ in rows}

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[n + 1 :]:
            if 100 * len(a & b) >= 80 * len(a | b) and root(i) != root(j):
                group[max(root(i), root(j))] = min(root(i), root(j))
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: root(i) for i, _ in rows}
    assert len({root(i) for i, _ in rows}) > 2


def test_an_access_opens_a_block_a_plane():
    ids = np.random.default_rng(1).integers(0, 49408, 400_000).astype("<u4")
    record = wavelet.write_record([1], [len(ids)], ids, 16)
    _, _, m = wavelet.read_record(record)
    assert m.access(123_456) == ids[123_456] and m.inflated <= 16 * wavelet.BLOCK
    before = m.inflated
    assert m.rank(int(ids[5]), 300_000) == int((ids[:300_000] == ids[5]).sum()) and m.inflated - before <= 2 * 16 * wavelet.BLOCK
    assert m.select(int(ids[5]), 0) == int(np.flatnonzero(ids == ids[5])[0])


def test_columns_may_be_called_anything(spark):
    docs = spark.createDataFrame([(i, "word " * (i % 7), "a" if i % 3 else None, 0.5, "x", 1, "y") for i in range(60)], "doc_id long, text string, source string, score double, _mix string, _copy int, _mix_of_source string")
    from parchmint.llm import mixing

    assert mixing.mixed_documents(docs).columns == docs.columns and mixing.mix(docs).count() == 60
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    scored = toxicity.fit(docs, labels).score(docs, keep=tuple(docs.columns), name="_t")
    assert scored.columns == [*docs.columns, "_t"] and scored.where(F.col("_t").between(0, 1)).count() == 60
