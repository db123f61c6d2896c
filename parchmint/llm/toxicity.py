"""Toxicity by class-conditional Kneser-Ney models.

Two language models, one of toxic and one of ordinary texts, give each word a log-likelihood, on two levels. By words: the
discounted count of the word in the class plus the discounted mass times a base that spells it. By spelling: character
5-grams whose own counts are the class's and whose lower orders are continuation counts shared by both classes, so an
expression too rare to count is judged by how it is written, and one unlike anything seen by neither. Log-likelihoods
are normalised by length (a spelling by the root of its letters, a stretch by its words), and a document's evidence is the
difference toxic less ordinary of its ``FEW`` most toxic words: an insult counts alike in a line and in a book. One
monotone logistic curve, fitted on the training rows under models of the other half, turns that difference into a score.

The models are fitted on at most ``MAX_DOCS`` labelled texts of each class, in the order of a hash of doc_id; equal
texts count once and a word counts once per text, so copies and spam weigh no more than their like. Labels, lang, source
and doc_id are no inputs of a score. ``Models`` states the models plainly; ``Tables`` holds the same numbers as sorted
arrays of a few megabytes, by which blocks of texts are scored at once. Scoring is a pass over the documents without
exchange; a task holds ``PIECE`` characters at a time, or one longer word.

Cases: null and empty texts have no word and no evidence (a difference of 0); labels without a row, null labels and
labels of unknown documents teach nothing; a doc_id labelled both ways counts as toxic; without labels of either class
every score is the share of toxic labels (0.5 without any); repeated rows get equal scores; an empty table gives an
empty result; columns of any name can be kept, ``score`` too (it then needs another ``name``); others are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import cached_property, lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parchmint.llm.codes import code_points, find_sorted, hashed, spread
from parchmint.llm.shared import free_memory, hold_cache, narrow_batches, sliced, stored, unused

#: Labelled texts of each class that the models are fitted on, at most.
MAX_DOCS = 4000
ORDER = 5
DISCOUNT = 0.75
#: Counts of the shared lower order that each class's 5-gram context is given besides its own.
SHARED_MASS = 4
#: The most toxic words whose mean evidence is a document's.
FEW = 3
#: Characters of text in memory at a time, and taught words whose grams are.
PIECE = 1 << 17
CHUNK_WORDS = 20_000
#: Spellings of untaught words a worker keeps (16 bytes each) before it starts anew; changes no result.
CACHE_WORDS = 500_000
_WORD = re.compile(r"[^\W_]+")
_SPACE = re.compile(r"\s")
_U = np.uint64
_P = 0x9E3779B97F4A7C15


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


class Models:
    """Both classes' models, stated plainly; ``score`` gives a word's differences, toxic less ordinary, on both levels."""

    def __init__(self, counts: dict[str, tuple[int, int]]):
        self.counts = counts
        self.total = [max(1, sum(c[k] for c in counts.values())) for k in (0, 1)]
        self.types = [sum(1 for c in counts.values() if c[k]) for k in (0, 1)]
        self.all_types = max(1, len(counts))

    @cached_property
    def top(self) -> list[dict[str, int]]:
        """Counts of the 5-grams of each class."""
        top = [Counter(), Counter()]
        for w, c in self.counts.items():
            s = "^" * (ORDER - 1) + w + "$"
            for i in range(len(s) - ORDER + 1):
                for k in (0, 1):
                    if c[k]:
                        top[k][s[i : i + ORDER]] += c[k]
        return [dict(t) for t in top]

    @cached_property
    def context(self) -> list[dict[str, tuple[int, int]]]:
        return [self._contexts(t) for t in self.top]

    @cached_property
    def lower(self) -> list[dict[str, int]]:
        """Continuation counts of the lower orders: in how many different longer grams of either class a gram ends."""
        out, grams = [], set(self.top[0]) | set(self.top[1])
        for _ in range(ORDER - 1):
            out.append(dict(Counter(g[1:] for g in grams)))
            grams = set(out[-1])
        return out

    @cached_property
    def lower_context(self) -> list[dict[str, tuple[int, int]]]:
        return [self._contexts(c) for c in self.lower]

    @staticmethod
    def _contexts(grams) -> dict[str, tuple[int, int]]:
        """Per context: sum of counts, number of different continuations."""
        out: dict[str, list[int]] = defaultdict(lambda: [0, 0])
        for g, c in grams.items():
            x = out[g[:-1]]
            x[0] += c
            x[1] += 1
        return {k: (a, b) for k, (a, b) in out.items()}

    def _shared(self, gram: str, level: int) -> float:
        """Kneser-Ney probability of the last character after the others, from continuation counts of both classes."""
        if level == len(self.lower):
            return 1 / (max(1, len(self.lower[-1])) + 1)
        below = self._shared(gram[1:], level + 1)
        total, kinds = self.lower_context[level].get(gram[:-1], (0, 0))
        if not total:
            return below
        return (max(self.lower[level].get(gram, 0) - DISCOUNT, 0) + DISCOUNT * kinds * below) / total

    def _gram(self, g: str) -> tuple[float, float]:
        """log P of the last character of a gram after the others, ordinary and toxic."""
        below, out = self._shared(g[1:], 0), []
        for k in (0, 1):
            total, kinds = self.context[k].get(g[:-1], (0, 0))
            # a context seen in one class only must not count as evidence by itself: a shared pseudo-mass
            p = (max(self.top[k].get(g, 0) - DISCOUNT, 0) + (DISCOUNT * kinds + SHARED_MASS) * below) / (total + SHARED_MASS)
            out.append(math.log(p))
        return out[0], out[1]

    def spelling(self, word: str) -> tuple[float, float, int]:
        """log P of the characters of a word in each class, toxic first, and their number."""
        s = "^" * (ORDER - 1) + word + "$"
        n = len(s) - ORDER + 1
        logs = [self._gram(s[i : i + ORDER]) for i in range(n)]
        return sum(t for _, t in logs), sum(o for o, _ in logs), n

    def score(self, word: str) -> tuple[float, float]:
        """Differences by words (0 for a word that neither class taught) and by spelling."""
        toxic, ordinary, n = self.spelling(word)
        by_word, c = 0.0, self.counts.get(word)
        if c:
            logs = [self._word(c[k], k, spelled) for k, spelled in ((1, toxic), (0, ordinary))]
            by_word = logs[0] - logs[1]
        return by_word, (toxic - ordinary) / n**0.5

    def _word(self, count: int, k: int, spelled: float) -> float:
        base = 0.5 / self.all_types + 0.5 * math.exp(spelled)
        return math.log((max(count - DISCOUNT, 0) + max(1.0, DISCOUNT * self.types[k]) * base) / self.total[k])


@lru_cache(1)
def _letters() -> np.ndarray:
    """By code point: whether it belongs to a word."""
    return np.array([chr(c).isalnum() for c in range(0x110000)])


def _cut_words(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, hashes) of the words of a row of code points."""
    inside = np.concatenate(([False], _letters()[codes.astype(np.int64)], [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    return starts, ends, hashed(codes, starts, ends)


def _listed_words(names: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(code points, starts, ends, hashes) of words in a list."""
    codes = code_points("\n".join(names))
    return codes, *_cut_words(codes)


class _Spelled:
    """The 5-grams of words that stand as (starts, ends) in a row of code points."""

    def __init__(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        self.n = ends - starts + 1  # each character and the end of the word
        room = self.n + ORDER - 1
        first = np.cumsum(room) - room
        self.codes = np.full(int(room.sum()), ord("^"), _U)
        self.codes[spread(first + ORDER - 1, self.n - 1)] = codes[spread(starts, self.n - 1)]
        self.codes[first + room - 1] = ord("$")
        self.owner = np.repeat(np.arange(len(self.n)), self.n)
        self.begin = np.cumsum(self.n) - self.n
        #: where each gram ends
        self.at = np.arange(int(self.n.sum())) + (ORDER - 1) * (self.owner + 1)

    def keys(self, order: int, at: np.ndarray) -> np.ndarray:
        out, p = np.zeros(len(at), _U), 1
        for j in range(order):
            out = out + self.codes[at - j] * _U(p)
            p = p * _P % (1 << 64)
        return out


class Tables:
    """The models as arrays sorted by hashes: 5-grams, their contexts and the taught words.

    Built in chunks of words, so that beside the tables only the grams of a chunk stand in memory.
    """

    def __init__(self, names: list[str], counts: np.ndarray):
        """``counts``: a row (ordinary, toxic) per name."""
        chunks = [slice(at, at + CHUNK_WORDS) for at in range(0, len(names), CHUNK_WORDS)]
        parts = [self._grams(names[c], counts[c]) for c in chunks] or [self._grams([], counts)]
        keys, rep, inverse = np.unique(np.concatenate([p[0][:, ORDER] for p in parts]), return_index=True, return_inverse=True)
        hashes, heads = (np.concatenate([p[i] for p in parts])[rep] for i in (0, 1))
        own = [np.bincount(inverse, np.concatenate([p[2][k] for p in parts]), len(keys)) for k in (0, 1)]
        logs, shared = [], self._shared(hashes, heads)
        self.contexts, of = np.unique(heads[:, ORDER], return_inverse=True)
        opened = []
        for k in (0, 1):
            total, kinds = np.bincount(of, own[k], len(self.contexts)), np.bincount(of, own[k] > 0, len(self.contexts))
            mass = DISCOUNT * kinds + SHARED_MASS
            logs.append(np.log((np.maximum(own[k] - DISCOUNT, 0) + mass[of] * shared) / (total[of] + SHARED_MASS)))
            opened.append(np.log(mass / (total + SHARED_MASS)))
        self.grams, self.gram_scores = keys, logs[1] - logs[0]
        self.context_scores = opened[1] - opened[0]
        made, total = [], [max(1, counts[:, k].sum()) for k in (0, 1)]
        types = [max(1.0, DISCOUNT * np.count_nonzero(counts[:, k])) for k in (0, 1)]
        for c in chunks:
            codes, starts, ends, own_hashes = _listed_words(names[c])
            s = _Spelled(codes, starts, ends)
            at = np.searchsorted(keys, s.keys(ORDER, s.at))
            spelled = [np.add.reduceat(logs[k][at], s.begin) for k in (0, 1)]
            base = [0.5 / len(names) + 0.5 * np.exp(x) for x in spelled]
            by_word = [np.log((np.maximum(counts[c, k] - DISCOUNT, 0) + types[k] * base[k]) / total[k]) for k in (0, 1)]
            made.append((own_hashes, by_word[1] - by_word[0] + (spelled[1] - spelled[0]) / np.sqrt(s.n)))
        self.names, self.name_scores = (np.concatenate([m[i] for m in made]) if made else np.zeros(0, t) for i, t in ((0, _U), (1, float)))
        order = np.argsort(self.names)
        self.names, self.name_scores = self.names[order], self.name_scores[order]

    @staticmethod
    def _grams(names: list[str], counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Per different 5-gram: the hashes of its last m characters, of those less the last one, and its counts."""
        codes, starts, ends, _ = _listed_words(names)
        s = _Spelled(codes, starts, ends)
        _, rep, inverse = np.unique(s.keys(ORDER, s.at), return_index=True, return_inverse=True)
        at = s.at[rep]
        hashes = np.stack([s.keys(m, at) for m in range(ORDER + 1)], axis=1)
        heads = np.stack([s.keys(max(0, m - 1), at - 1) for m in range(ORDER + 1)], axis=1)
        return hashes, heads, [np.bincount(inverse, counts[s.owner, k], len(rep)) for k in (0, 1)]

    @staticmethod
    def _shared(hashes: np.ndarray, heads: np.ndarray) -> np.ndarray:
        """Probabilities by the shared lower orders, one per different 5-gram."""
        at, tables = np.arange(len(hashes)), []
        for order in range(ORDER - 1, 0, -1):
            _, rep, of, count = np.unique(hashes[at, order], return_index=True, return_inverse=True, return_counts=True)
            at = at[rep]
            _, context = np.unique(heads[at, order], return_inverse=True)
            tables.append((of, count, np.bincount(context, count)[context], np.bincount(context)[context]))
        p = np.full(len(at), 1 / (max(1, len(at)) + 1))
        for of, count, total, kinds in reversed(tables):
            p = ((np.maximum(count - DISCOUNT, 0) + DISCOUNT * kinds * p) / total)[of]
        return p

    def spelling(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Differences by spelling; under a gram that neither class has, both back off to one shared probability."""
        s = _Spelled(codes, starts, ends)
        at, known = find_sorted(self.grams, s.keys(ORDER, s.at))
        out = np.where(known, self.gram_scores[at], 0.0) if len(self.grams) else np.zeros(len(s.at))
        rest = np.flatnonzero(~known)
        at, known = find_sorted(self.contexts, s.keys(ORDER - 1, s.at[rest] - 1))
        if len(self.contexts):
            out[rest] = np.where(known, self.context_scores[at], 0.0)
        return np.add.reduceat(out, s.begin) / np.sqrt(s.n)


class Scorer:
    """Evidence and scores of texts under ``tables``."""

    def __init__(self, tables: Tables, weights: np.ndarray | None):
        self.tables, self.weights = tables, weights
        self._new, self._new_scores = np.zeros(0, _U), np.zeros(0)

    def _words(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(place, evidence) of each word of a lower-cased text."""
        codes = code_points(text)
        starts, ends, hashes = _cut_words(codes)
        keys, rep, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        at, known = find_sorted(self.tables.names, keys)
        scores = np.where(known, self.tables.name_scores[at], 0.0) if len(self.tables.names) else np.zeros(len(keys))
        rest = np.flatnonzero(~known)
        at, known = find_sorted(self._new, keys[rest])
        if len(self._new):
            scores[rest] = np.where(known, self._new_scores[at], 0.0)
        rest = rest[~known]
        if len(rest):
            scores[rest] = self.tables.spelling(codes, starts[rep[rest]], ends[rep[rest]])
            if len(self._new) + len(rest) > CACHE_WORDS:
                self._new, self._new_scores = np.zeros(0, _U), np.zeros(0)
            place = np.searchsorted(self._new, keys[rest])
            self._new, self._new_scores = np.insert(self._new, place, keys[rest]), np.insert(self._new_scores, place, scores[rest])
        return starts, scores[inverse]

    def evidence(self, texts: list[str | None]) -> np.ndarray:
        """The mean evidence of each text's ``FEW`` most toxic words."""
        out, group, held = np.zeros(len(texts)), [], 0

        def close() -> None:
            lows = [texts[i].lower() for i in group]
            places, values = self._words("\n".join(lows))
            first = np.cumsum([0] + [len(x) + 1 for x in lows[:-1]])
            out[group] = _most(values, np.searchsorted(places, first))

        for i, t in enumerate(texts):
            if not t:
                continue
            if len(t) > PIECE:
                out[i] = self._long(t)
                continue
            group.append(i)
            held += len(t)
            if held >= PIECE:
                close()
                group, held = [], 0
        if group:
            close()
        return out

    def _long(self, text: str) -> float:
        """A text beyond ``PIECE``, cut at white space; only the best words of what was read are kept."""
        best, at = np.zeros(0), 0
        while at < len(text):
            cut = _SPACE.search(text, at + PIECE)
            end = cut.start() if cut else len(text)
            best = np.sort(np.concatenate((best, self._words(text[at:end].lower())[1])))[-FEW:]
            at = end
        return float(best.mean()) if len(best) else 0.0

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + self.weights[1] * self.evidence(texts), -30, 30)))


def _most(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Means of the ``FEW`` largest values (all, if fewer) of each run; runs begin at ``first`` and may be empty."""
    n = np.diff(np.append(first, len(values)))
    out, some = np.zeros(len(n)), np.flatnonzero(n)
    if not len(some):
        return out
    left, begin, owner = values.copy(), first[some], np.repeat(np.arange(len(some)), n[some])
    total = np.zeros(len(some))
    for turn in range(FEW):
        most = np.maximum.reduceat(left, begin)
        there = n[some] > turn
        total[there] += most[there]
        top = np.flatnonzero(left == most[owner])
        _, lead = np.unique(owner[top], return_index=True)
        left[top[lead]] = -np.inf
    out[some] = total / np.minimum(n[some], FEW)
    return out


def fit_weights(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 30) -> np.ndarray:
    """Logistic regression by Newton steps with a ridge on all but the constant."""
    w, keep = np.zeros(x.shape[1]), ridge * np.eye(x.shape[1]) * len(y) / 100
    keep[0, 0] = 1e-9
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + keep, x.T @ (y - p) - keep @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of each class and fold that have a word, as far as this partition goes."""
    held: dict[str, list[int]] = {}

    def drain() -> pa.RecordBatch:
        columns = [pa.array(held.keys(), pa.string()), *(pa.array([v[i] for v in held.values()], pa.int64()) for i in range(4))]
        out = pa.RecordBatch.from_arrays(columns, names=["word", *_CELLS])
        held.clear()
        return out

    for batch in batches:
        for text, toxic, fold in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            for w in set(words(text)):
                held.setdefault(w, [0, 0, 0, 0])[2 * fold + toxic] += 1
        if len(held) > 300_000:
            yield drain()
    if held:
        yield drain()


_CELLS = ("ordinary0", "toxic0", "ordinary1", "toxic1")


def _fold_evidence(batches: Iterator[pa.RecordBatch], tables) -> Iterator[pa.RecordBatch]:
    """Evidence of each taught text under the models of the other fold."""
    scorers = [Scorer(t, None) for t in tables.value]
    for batch in batches:
        text, toxic, fold = (batch.column(i).to_pylist() for i in range(3))
        for f in (0, 1):
            mine = [i for i in range(len(text)) if fold[i] == f]
            x = scorers[1 - f].evidence([text[i] for i in mine])
            yield pa.RecordBatch.from_arrays([pa.array([toxic[i] for i in mine], pa.int32()), pa.array(x, pa.float64())], names=["toxic", "x"])


def _score(batches: Iterator[pa.RecordBatch], fitted, text: str, own: bool, name: str) -> Iterator[pa.RecordBatch]:
    hold_cache("toxicity", _SCORERS.clear)
    tables, weights, constant = fitted.value
    scorer = _SCORERS.get(fitted.id) or Scorer(tables, weights) if tables else None
    _SCORERS.clear()
    _SCORERS[fitted.id] = scorer
    for batch in sliced(batches, text):
        at = batch.schema.get_field_index(text)
        scores = scorer.scores(batch.column(at).to_pylist()) if scorer else np.full(batch.num_rows, constant)
        kept = [i for i in range(batch.num_columns) if own or i != at]
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), pa.array(scores, pa.float64())], names=[*(batch.schema.names[i] for i in kept), name])


#: The scorer of the last model this worker used, with its words.
_SCORERS: dict = {}


class ToxicityModel:
    """Fitted models; ``score(docs)`` adds a column."""

    def __init__(self, spark, tables: Tables | None, weights: np.ndarray | None, constant: float, taught: tuple | None = None):
        self.weights, self.constant, self._taught = weights, constant, taught
        # some 30 bytes for each different word and 5-gram of at most 2 * max_docs texts
        self._shared = spark.sparkContext.broadcast(_Fitted(tables, weights, constant))

    @property
    def models(self) -> Models | None:
        """The models stated plainly; built anew each time."""
        return self._taught and Models({w: (o, t) for w, (o, t) in zip(self._taught[0].to_pylist(), self._taught[1].tolist(), strict=True)})

    def score(self, docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", name: str = "score") -> DataFrame:
        """Columns ``keep`` (none called ``name``) and the score ``name`` (0 to 1) of every row of ``docs``."""
        own = text in keep
        read = text if own else unused([*keep, name], "_scored_text")
        rows = docs.select(*keep) if own else docs.select(*keep, docs[text].cast("string").alias(read))
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if own or f.name != read)
        kernel = partial(_score, fitted=_Handle(self._shared), text=read, own=own, name=name)
        return rows.mapInArrow(kernel, f"{schema}, `{name}` double")


class _Fitted(tuple):
    def __new__(cls, *parts):
        return super().__new__(cls, parts)

    def __getnewargs__(self):
        return tuple(self)


class _Handle:
    """A broadcast with a name, so that a worker knows it again."""

    def __init__(self, shared):
        self.shared, self.id = shared, shared._jbroadcast.id() if shared._jbroadcast is not None else 0

    @property
    def value(self):
        return self.shared.value


def may_teach(doc_id: Column) -> Column:
    """Rows outside the held-out quarter: crc32 of the doc_id's digits mod 4 is not 2."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 != 2


def fit(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS) -> ToxicityModel:
    """Models from at most ``max_docs`` labelled documents of each class outside the held-out quarter."""
    spark = docs.sparkSession
    narrow_batches(spark)
    known = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["toxic"].cast("int").alias("toxic"))
    known = known.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & may_teach(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = known.agg(F.avg("toxic")).first()[0]
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    sample = known.where("toxic = 1").orderBy(*order).limit(max_docs).union(known.where("toxic = 0").orderBy(*order).limit(max_docs))
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).where("text is not null")
    # at most 2 * max_docs rows of two numbers
    taught = rows.join(F.broadcast(sample), "doc_id").groupBy("text").agg(F.max("toxic").alias("toxic"))
    taught = stored(taught.select("text", "toxic", (F.crc32(F.col("text").cast("binary")) % 2).cast("int").alias("fold")), "taught")
    classes = {r["toxic"]: r["count"] for r in taught.groupBy("toxic").count().collect()}
    if len(classes) < 2:
        return ToxicityModel(spark, None, None, 0.5 if share is None else float(share))
    counted = taught.mapInArrow(_count_words, "word string, ordinary0 long, toxic0 long, ordinary1 long, toxic1 long")
    counted = counted.groupBy("word").agg(*(F.sum(c).alias(c) for c in _CELLS)).orderBy("word")
    t = counted.toArrow()
    names, cells = t.column("word"), np.stack([t.column(c).to_numpy() for c in _CELLS], axis=1).reshape(-1, len(_CELLS))

    def of_fold(f: int) -> Tables:
        mine = np.flatnonzero(cells[:, 2 * f : 2 * f + 2].sum(axis=1))
        return Tables(names.take(mine).to_pylist(), cells[mine, 2 * f : 2 * f + 2])

    both = cells[:, :2] + cells[:, 2:]
    halves = spark.sparkContext.broadcast([of_fold(0), of_fold(1)])
    got = taught.mapInArrow(partial(_fold_evidence, tables=halves), "toxic int, x double").toArrow()
    halves.unpersist()
    y, x = got.column("toxic").to_numpy().astype(float), got.column("x").to_numpy()
    order_ = np.lexsort((x, y))
    weights = fit_weights(np.stack((np.ones(len(x)), x), axis=1)[order_], y[order_])
    share = min(max(float(share), 1e-3), 1 - 1e-3)
    weights[0] += math.log(share / (1 - share)) - math.log(max(y.mean(), 1e-6) / max(1 - y.mean(), 1e-6))
    whole = Tables(names.to_pylist(), both)
    free_memory()
    return ToxicityModel(spark, whole, weights, share, (names, both))
