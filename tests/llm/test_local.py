"""Kernels of the training-data operators without a session: against brute force and round trips."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from parchmint.llm import ann, maxscore, mixing, near_dedup, packing, secrets, toxicity, wavelet
from parchmint.llm.tokens import tokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")
PLAIN = Tokenizer.from_file(PATH)


def _plain(text):
    return np.array(PLAIN.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@settings(max_examples=150, deadline=None)
@given(st.text(st.characters(codec="utf-8"), max_size=60))
def test_tokens_equal_the_library(text):
    assert tokenizer(PATH).encode_one(text) == _plain(text)


@settings(max_examples=150, deadline=None)
@given(st.text("abIT's're0 9_-ÉéßΣσİ\x1c\x1f  \n<|endoftext|>#!", max_size=40))
def test_tokens_equal_the_library_on_odd_marks(text):
    assert tokenizer(PATH).encode_one(text, 1) == _plain(text) + b"\1\0\0\0"


def test_tokens_of_nothing():
    assert tokenizer(PATH).encode_one(None, 1) == tokenizer(PATH).encode_one("", 1) == b"\1\0\0\0"


@pytest.mark.parametrize("n", [0, 1, 7, 511, 512, 513, 3000])
def test_wavelet_round_trip_and_queries(n):
    rng = np.random.default_rng(n)
    ids = np.where(rng.random(n) < 0.4, 7, rng.integers(0, 49408, n)).astype("<u4")
    docs, counts = [None, 5], [n // 2, n - n // 2]
    names, sizes, m = wavelet.read_record(wavelet.write_record(docs, counts, ids, 16))
    assert names == docs and sizes.tolist() == counts and m.decode().tolist() == ids.tolist()
    for i in rng.integers(0, n, min(n, 25)).tolist() if n else ():
        assert m.access(i) == ids[i]
        assert m.rank(int(ids[i]), i) == int((ids[:i] == ids[i]).sum())
    where = np.flatnonzero(ids == 7).tolist()
    assert m.rank(7) == len(where) and m.rank(1 << 16) == 0
    assert [m.select(7, k) for k in range(min(40, len(where)))] == where[:40] and m.select(7, len(where)) == -1
    assert m.occurrences(int(ids[0])) == np.flatnonzero(ids == ids[0]).tolist() if 0 < n < 600 else True


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=60))
def test_differencing_keeps_every_part_and_the_capacity(sizes):
    groups = packing.deal(sizes, 64)
    assert sorted(i for g in groups for i in g) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in g) <= 64 for g in groups)


def test_differencing_is_near_equal():
    rng = random.Random(3)
    sizes = [rng.randint(1, 200) for _ in range(400)]
    sums = [sum(sizes[i] for i in g) for g in packing.difference(sizes, 40)]
    assert max(sums) - min(sums) <= 20


def test_packer_covers_documents():
    rng, p = random.Random(5), packing._Packer(128, 8, 4, 0)
    docs = [rng.choice([1, 5, 130, 300, 128, 2000]) for _ in range(80)]
    for i, n in enumerate(docs):
        p.add(i, bytes(4 * n))
    p.flush()
    for i, n in enumerate(docs):
        at = 0
        for _, start, length, *_ in sorted(r for r in p.out if r[0] == i):
            assert start == at
            at += length
        assert at == n
    used = {r[5] for r in p.out}
    assert len(used) * 128 / sum(docs) < 1.12


def _jaccard(a, b):
    return len(a & b) / len(a | b)


@pytest.mark.parametrize("n", [1, 2, 30, 400, 6000])
def test_super_minhash_estimates(n):
    rng = np.random.default_rng(n)
    all_ = rng.integers(0, 1 << 63, 2 * n + 2).astype(np.uint64)
    a, b = np.unique(all_[:n]), np.unique(all_[n // 4 : n + n // 4])
    sig = near_dedup.super_minhash([a, b, a])
    assert (sig != np.iinfo(np.uint64).max).all() and (sig[0] == sig[2]).all()
    want = _jaccard(set(a.tolist()), set(b.tolist()))
    assert abs((sig[0] == sig[1]).mean() - want) < 0.13


def test_super_minhash_bids_each_slot_once():
    # every slot's round numbers over one element are a permutation
    sig = near_dedup.super_minhash([np.array([12345], np.uint64)])[0]
    assert sorted((sig >> np.uint64(32)).tolist()) == list(range(near_dedup.SLOTS))


def test_shingles():
    assert near_dedup.shingle_set("A b c  D", 2) == {(b"a", "b c".encode()), ("b c".encode(), b"d")}
    assert near_dedup.shingle_set("Solo", 2) == {(b"solo",)} and near_dedup.shingle_set(" \n", 2) == set() == near_dedup.shingle_set(None, 2)
    for text in ("", None, " ", "one", "one two", "a a a a", "É É é"):
        assert len(near_dedup.shingle_hashes(text, 2)) == len(near_dedup.shingle_set(text, 2))


def test_multi_index_retrieves_all_within_the_radius():
    rng = np.random.default_rng(1)
    codes = rng.integers(0, 256, (600, 4)).astype(np.uint8)
    codes[:200] = codes[0] ^ (1 << rng.integers(0, 8, (200, 4)) * (rng.random((200, 4)) < 0.5)).astype(np.uint8)
    index = ann.MultiIndex(codes)
    for radius in (0, 1, 3, 4, 7, 9, 14, 32):
        q = codes[5]
        want = [i for i in range(600) if int(np.bitwise_count(codes[i] ^ q).sum()) <= radius]
        assert index.within(q, radius).tolist() == want


@pytest.mark.parametrize("seed", range(6))
def test_max_score_is_exact(seed):
    rng = np.random.default_rng(seed)
    density = (1.0, 0.6, 0.2, 0.05, 1.0, 0.3)[seed]
    w = np.floor(rng.normal(scale=9, size=(700, 24)) * (rng.random((700, 24)) < density))
    w[:50] = w[0]
    p = maxscore.Postings(w)
    for q in [*w[::60], np.zeros(24), -w[3]]:
        rows, scores = p.top(q, 11)
        full = w @ q
        assert (full[rows] == scores).all()
        assert set(np.flatnonzero(full >= np.sort(full)[-11]).tolist()) <= set(rows.tolist()) or not q.any()


def test_max_score_skips_rows():
    rng = np.random.default_rng(9)
    w = np.floor(rng.normal(scale=9, size=(4000, 32)))
    assert len(maxscore.Postings(w).top(w[0], 11)[0]) < 1000


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 1000), min_size=1, max_size=12))
def test_levelled_targets(sizes):
    weights = [1 + i % 3 for i in range(len(sizes))]
    t = mixing.level_targets(sizes, weights, 3)
    assert all(x <= 3 * s + 1e-6 for x, s in zip(t, sizes, strict=True))
    assert sum(t) == pytest.approx(sum(sizes))
    free = {round(x / w, 6) for x, s, w in zip(t, sizes, weights, strict=True) if x < 3 * s - 1e-6}
    assert len(free) <= 1


LITERALS = [
    ('db_password = "hunter2-Blue!9"', ['hunter2-Blue!9']),
    ('x = "q8Zr-44kd!pL0a"\nconfig.dbPassword = x', ["q8Zr-44kd!pL0a"]),
    ("clientSecret: 'aa' + 'Zk29!fj-Lq'", ["aa", "Zk29!fj-Lq"]),
    ('pass_phrase: str = "never tell"', []),
    ('signing_key := "kD93-kfm2/Xx~q"', ["kD93-kfm2/Xx~q"]),
    ('credential = "changeme"', []),
    ('title = "A Tale of Two Cities"', []),
    ('a = b = c', []),
    ('if x == "abc": y', []),
]


@pytest.mark.parametrize("text,want", LITERALS)
def test_assignment_aware_literals(text, want):
    got = [text[s[1] : s[2]] for s in secrets.find(text) if s[0] == "literal"]
    assert got == want


def test_base_secrets():
    text = 'Token : "abc123" token=ab1 AKIA' + "Z" * 16 + " AKIA12 " + "deadbeef" * 3 + " ſecret=abcdefg secret=secret=abcdef"
    assert [(s[0], text[s[1] : s[2]]) for s in secrets.base_spans(text)] == [
        ("assign", 'Token : "abc123'), ("assign", "secret=secret=abcdef"), ("access", "AKIA" + "Z" * 16), ("hex", "deadbeef" * 3),
    ]
    assert secrets.find(None) == [] == secrets.find("")
    assert secrets.masked('a password="abcdef1" b') == 'a password="[secret]" b'


def test_secret_scan_is_linear_in_runs():
    for text in ("a" * 200_000, "=" * 200_000, "token" * 40_000, 'x="' * 30_000, "a=b+" * 30_000, "password" + " " * 200_000):
        secrets.find(text)


def test_toxicity_learns_spelling():
    rng = random.Random(2)
    syl = ["ba", "do", "ri", "nu", "te", "la"]
    word = lambda: "".join(rng.choice(syl) for _ in range(3))
    counts = {word(): (3, 3) for _ in range(300)}
    counts |= {"grumx" + rng.choice(syl) + rng.choice(syl): (0, 4) for _ in range(25)}
    m = toxicity.Models(counts)
    bad, new, fine = m.score("grumxbado"), m.score("grumxlalala"), m.score("baridonu")
    assert bad[1] > 1 and new[1] > 1 and fine[1] < 0.5


def test_logistic_fit():
    rng = np.random.default_rng(0)
    x = np.hstack((np.ones((400, 1)), rng.normal(size=(400, 2))))
    y = (x[:, 1] + 0.1 * rng.normal(size=400) > 0).astype(float)
    p = 1 / (1 + np.exp(-(x @ toxicity.fit_weights(x, y))))
    assert ((p > 0.5) == y).mean() > 0.95


def test_crc_of_tokens():
    assert zlib.crc32(_plain("abc")) == zlib.crc32(tokenizer(PATH).encode_one("abc"))
