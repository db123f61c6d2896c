"""Tokenising whole texts with a tokenizers-library file, in blocks of characters.

A text is cut at ASCII white space. For tokenizers that drop white space and never join characters across it
(``word_bpe_49k.json`` is one; probes on the loaded file decide) the ids of a text are the ids of its chunks in order.
Other files are encoded text by text.

Where the file's normalizer and pre-tokenizer are the lower-casing word splitter of ``WORD_SPLIT``, chunks of ASCII and
Latin-1 letters are cut into words here, on the row of code points; any other chunk goes through the library whole. Each
different word of a block is looked up by a 64-bit hash of its letters in sorted arrays; those not known yet go to the
merge table as one line, in which each word ends with the one token that closes a word, so the ids fall apart into words
again. (Two different words with one hash: in less than 1 of a million runs over a thousand million different words a
worker, as only those that a worker keeps at one time meet.)
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

from parchmint.llm.codes import code_points, find_sorted, hashed, spread
from parchmint.llm.shared import free_memory, hold_cache

#: Ids of known words and chunks a worker keeps before it starts anew; bounds its memory (some 12 bytes each) and changes no result.
CACHE_IDS = 3_000_000
#: Characters of text worked on at a time, save one longer chunk.
PIECE = 1 << 17

#: Texts on which encoding by chunk must equal encoding whole.
PROBES = (
    "a b",
    "it's  he'll\tgo\n\n12 3.4!? x\r\n\x0b\x0cy",
    "é é ́x ß Ünï 'S",
    "<|endoftext|> x",
    "don 't  re",
    "a\u0085b c　d e​f g h i j",
    "ΑΣ Σ ΣΑ İx",
)
#: The pre-tokenizer pattern (a fixed value of the public vocabulary file) that the word path below stands for.
WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_SPACE = re.compile(r"[ \t-\r]")
_U = np.uint64
_GAP, _LETTER, _DIGIT, _MARK, _ODD = range(5)


def _kinds() -> np.ndarray:
    """By code point up to 255 (256: all others): white space, letter, digit, other printable ASCII, or none of these."""
    out = np.full(257, _ODD, np.uint8)
    out[33:127] = _MARK
    out[[9, 10, 11, 12, 13, 32]] = _GAP
    out[48:58] = _DIGIT
    for first, last in ("AZ", "az", "ÀÖ", "Øö", "øÿ"):
        out[ord(first) : ord(last) + 1] = _LETTER
    return out


_KIND = _kinds()
_LOWER = np.array([ord(chr(c).lower()) for c in range(256)] + [0], _U)
#: What "'" takes with it, by the letters that follow.
_SHORT = [("s",), ("t",), ("m",), ("d",), ("r", "e"), ("v", "e"), ("l", "l")]


def _byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write each byte as one printable character: itself if printable, else the next from 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class TextTokenizer:
    """Encodes texts to little-endian unsigned 32-bit ids, as bytes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self._model = Tokenizer.from_file(path)
        spec = json.loads(self._model.to_str())
        self._special = [t["content"] for t in spec.get("added_tokens", [])]
        self._forget()
        self.by_word = False
        self.by_chunk = self._probes_hold()
        if self.by_chunk and self._lower_words(spec):
            self._line = Tokenizer(self._model.model)
            self._line.pre_tokenizer = WhitespaceSplit()
            letters = _byte_letters() | {32: " "}
            self._letters = np.array([ord(letters.get(b, "?")) for b in range(256)], "<u4")
            suffix, vocabulary = spec["model"]["end_of_word_suffix"], self._model.get_vocab()
            self._closes = np.zeros(max(vocabulary.values()) + 1, bool)
            self._closes[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
            self.by_word = True
            self.by_word = self._probes_hold()

    @staticmethod
    def _lower_words(spec: dict) -> bool:
        normal = (spec.get("normalizer") or {}).get("normalizers", [])
        cut = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        return (
            [x["type"] for x in normal] == ["NFC", "Replace", "Lowercase"]
            and [x["type"] for x in cut] == ["Split", "ByteLevel"]
            and cut[0]["pattern"] == {"Regex": WORD_SPLIT}
            and not cut[1]["add_prefix_space"]
            and spec["model"]["type"] == "BPE"
            and bool(spec["model"]["end_of_word_suffix"])
        )

    def _probes_hold(self) -> bool:
        try:
            return self._raw(list(PROBES)) == self._by_piece(list(PROBES))
        except ValueError:
            return False
        finally:
            self._forget()

    def _forget(self) -> None:
        """Empties the known words: ascending hashes, and where the ids of each stand in the pool."""
        self._keys, self._at, self._size = np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self._pool, self._used = np.zeros(1 << 16, "<u4"), 0

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self._model.encode_batch_fast(texts, add_special_tokens=False)]

    def _raw(self, texts: list[str]) -> list[bytes]:
        return [np.array(x, "<u4").tobytes() for x in self._ids(texts)]

    def _cut(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(code points, starts, ends, whole) of the words of a text; ``whole``: a chunk for the library as it is."""
        codes = code_points(text)
        kind = _KIND[np.minimum(codes, _U(256)).astype(np.int64)]
        edges = np.flatnonzero(np.diff(kind != _GAP, prepend=False, append=False))
        starts, ends = edges[::2], edges[1::2]
        odd = np.concatenate(([0], np.cumsum(kind == _ODD)))
        odd = odd[ends] > odd[starts] if self.by_word else np.ones(len(starts), bool)
        for special in self._special:  # their strings have no white space, so each stands in one chunk
            at = text.find(special)
            while at >= 0:
                odd[np.searchsorted(starts, at, "right") - 1] = True
                at = text.find(special, at + 1)
        low = codes
        if not odd.all():
            low = _LOWER[np.minimum(codes, _U(256)).astype(np.int64)]
        if odd.any():
            inside = spread(starts[odd], ends[odd] - starts[odd])
            kind[inside] = _ODD
            if low is not codes:
                low[inside] = codes[inside]
        begins = (kind != _GAP) & (np.diff(kind, prepend=_GAP) != 0) | (kind == _DIGIT)
        self._shorten(low, kind, begins)
        stops = np.flatnonzero(begins | (kind == _GAP))
        mine = np.flatnonzero(begins[stops])
        starts, ends = stops[mine], np.append(stops, len(codes))[mine + 1]
        return low, starts, ends, kind[starts] == _ODD

    @staticmethod
    def _shorten(low: np.ndarray, kind: np.ndarray, begins: np.ndarray) -> None:
        """Joins an apostrophe that stands alone with the letters of a short form after it."""
        n = len(low)
        at = np.flatnonzero(begins & (low == 39) & (kind == _MARK))
        at = at[at + 1 < n]
        at = at[kind[at + 1] == _LETTER]
        if not len(at):
            return
        first, after = low[at + 1], np.minimum(at + 2, n - 1)
        second = np.where((at + 2 < n) & (kind[after] == _LETTER), low[after], _U(0))
        taken = np.zeros(len(at), np.int64)
        for letters in _SHORT:
            hit = first == ord(letters[0])
            if len(letters) == 2:
                hit &= second == ord(letters[1])
            taken[hit & (taken == 0)] = len(letters)
        at, taken = at[taken > 0], taken[taken > 0]
        begins[at + 1] = False
        rest = at + 1 + taken
        rest = rest[rest < n]
        begins[rest[kind[rest] == _LETTER]] = True

    def _learn(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Encodes different words and chunks into the pool; where the ids of each stand there, and how many."""
        at, size = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        for odd in (False, True):
            mine = np.flatnonzero(whole == odd)
            if not len(mine):
                continue
            sizes = ends[mine] - starts[mine]
            if odd:
                chunks = [codes[a:b].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass") for a, b in zip(starts[mine].tolist(), ends[mine].tolist(), strict=True)]
                found = self._ids(chunks)
                size[mine] = [len(x) for x in found]
                ids = np.array([i for x in found for i in x], "<u4")
            else:
                line = np.full(int(sizes.sum()) + len(mine), 32, np.uint8)
                line[spread(np.cumsum(sizes + 1) - sizes - 1, sizes)] = codes[spread(starts[mine], sizes)]
                raw = np.frombuffer(line.tobytes().decode("latin-1").encode(), np.uint8)
                ids = np.array(self._ids_of_line(self._letters[raw].tobytes().decode("utf-32-le")), "<u4")
                closed = np.flatnonzero(self._closes[ids]) + 1
                if len(closed) != len(mine) or len(ids) != (closed[-1] if len(closed) else 0):
                    raise ValueError("a word without its closing token")
                size[mine] = np.diff(closed, prepend=0)
            at[mine] = self._used + np.cumsum(size[mine]) - size[mine]
            while self._used + len(ids) > len(self._pool):
                self._pool = np.concatenate((self._pool, np.zeros_like(self._pool)))
            self._pool[self._used : self._used + len(ids)] = ids
            self._used += len(ids)
        return at, size

    def _ids_of_line(self, line: str) -> list[int]:
        return self._line.encode_batch_fast([line], add_special_tokens=False)[0].ids

    def _piece(self, text: str, firsts: np.ndarray) -> list[bytes]:
        """The ids of the texts that begin at ``firsts`` within one row of characters, each after white space."""
        if self._used > CACHE_IDS:
            self._forget()
        codes, starts, ends, whole = self._cut(text)
        keys, rep, inverse = np.unique(hashed(codes, starts, ends), return_index=True, return_inverse=True)
        place, known = find_sorted(self._keys, keys)
        at, size = (np.where(known, x[place], 0) if len(x) else np.zeros(len(keys), np.int64) for x in (self._at, self._size))
        new = np.flatnonzero(~known)
        if len(new):
            at[new], size[new] = self._learn(codes, starts[rep[new]], ends[rep[new]], whole[rep[new]])
            place = np.searchsorted(self._keys, keys[new])
            self._keys, self._at, self._size = (np.insert(x, place, y) for x, y in ((self._keys, keys[new]), (self._at, at[new]), (self._size, size[new])))
        at, size = at[inverse], size[inverse]
        out = self._pool[spread(at, size)].tobytes()
        upto = np.concatenate(([0], np.cumsum(size)))
        cuts = [*(4 * upto[np.searchsorted(starts, firsts)]).tolist(), len(out)]
        return [out[a:b] for a, b in zip(cuts, cuts[1:])]

    def _long(self, text: str) -> bytes:
        out, at = [], 0
        while at < len(text):
            cut = _SPACE.search(text, at + PIECE)
            end = cut.start() if cut else len(text)
            out += self._piece(text[at:end], np.zeros(1, np.int64))
            at = end
        return b"".join(out)

    def _by_piece(self, texts: list[str]) -> list[bytes]:
        out, group, held = [], [], 0

        def close() -> None:
            sizes = np.array([len(t) + 1 for t in group])
            out.extend(self._piece("\n".join(group), np.cumsum(sizes) - sizes))

        for t in texts:
            if group and held + len(t) > PIECE:
                close()
                group, held = [], 0
            if len(t) > PIECE:
                out.append(self._long(t))
            else:
                group.append(t)
                held += len(t) + 1
        if group:
            close()
        return out

    def encode(self, texts: list[str | None], end_id: int | None = None) -> list[bytes]:
        """The ids of each text (null: empty), with ``end_id`` appended where it isn't None."""
        tail = b"" if end_id is None else int(end_id).to_bytes(4, "little")
        whole = [t or "" for t in texts]
        return [ids + tail for ids in (self._by_piece(whole) if self.by_chunk else self._raw(whole))]

    def encode_one(self, text: str | None, end_id: int | None = None) -> bytes:
        return self.encode([text], end_id)[0]


_LOADED: dict[str, TextTokenizer] = {}


def tokenizer(path: str) -> TextTokenizer:
    """The tokenizer of ``path``, loaded once per Python worker."""
    hold_cache("tokens", _LOADED.clear)
    if path not in _LOADED:
        _LOADED[path] = TextTokenizer(path)
        free_memory()  # what reading the file took
    return _LOADED[path]
