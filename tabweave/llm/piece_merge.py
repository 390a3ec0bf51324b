"""Byte-pair encoding of SentencePiece models by vectorised merge rounds."""

from __future__ import annotations

import heapq
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column
from pyspark.sql import functions as F

from tabweave.llm.common import binary_column, utf8
from tabweave.llm.memory import WordMemory, ordered

SPACE = "▁"             # fixed value: the mark that stands for a space
NONE = np.int32(2**31 - 1)   # rank of a pair that is no piece
LONG = 300                   # words of more symbols merge one by one, in n log n
MAX_WORDS = 300_000          # encoded words that a worker remembers at a time
SLICE = 4 << 20              # bytes of text that a step holds at once
_RUN = re.compile(f"({SPACE}+)")


class Pieces:
    """The pieces of a model and the pairs of symbols that make them.

    A symbol is a piece (its id), a letter that only occurs inside pieces (an id after
    the pieces), or any other letter (``unknown`` plus its code point), which merges
    with nothing.  Pairs are ranked by falling score; equal scores have equal ranks.
    """

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(size)]
        plain = [i for i in range(size) if not (
            model.is_control(i) or model.is_byte(i) or model.is_unknown(i) or model.is_unused(i))]
        self.bytes = np.full(256, -1, np.int64)
        for i in range(size):
            if model.is_byte(i):
                self.bytes[int(self.pieces[i][3:5], 16)] = i
        texts = {self.pieces[i]: i for i in plain}
        probe = " a  Åﬁ\t▁\n b "
        if (self.bytes < 0).any() or any(SPACE in t.lstrip(SPACE) for t in texts) or (
                model.normalize(probe) != SPACE + probe.replace(" ", SPACE)):
            raise ValueError("needs byte pieces, the mark only in front, and no normalisation")
        self.free = "\n" if not any("\n" in t for t in texts) else ""
        symbols = dict(texts)
        for letter in sorted({c for t in texts for c in t} - set(texts)):
            symbols[letter] = size + len(symbols) - len(texts)
        self.unknown = size + len(symbols) - len(texts)
        self.size = size
        self.symbol_of = self.unknown + np.arange(0x110000, dtype=np.int64)
        for text, i in symbols.items():
            if len(text) == 1:
                self.symbol_of[ord(text)] = i
        scores = np.array([model.get_score(i) for i in range(size)])
        _, rank = np.unique(-scores, return_inverse=True)
        self.width = self.unknown + 0x110000
        pairs = sorted(
            (symbols[text[:cut]] * self.width + symbols[text[cut:]], i)
            for text, i in texts.items() for cut in range(1, len(text))
            if text[:cut] in symbols and text[cut:] in symbols
        )
        self.keys = np.array([k for k, _ in pairs] + [2**62], np.int64)
        self.made = np.array([i for _, i in pairs] + [-1], np.int64)
        self.rank = np.array([rank[i] for _, i in pairs] + [NONE], np.int32)
        self.pair = dict(zip(self.keys.tolist(), range(len(pairs))))
        self.spoken = [
            bytes([int(p[3:5], 16)]) if model.is_byte(i) else b"" if model.is_control(i)
            else " ⁇ ".encode() if model.is_unknown(i) else p.replace(SPACE, " ").encode()
            for i, p in enumerate(self.pieces)
        ]
        self.marked = np.array([p.startswith(SPACE) for p in self.pieces])

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Places of the pairs in the table; its last row means none."""
        key = left * self.width + right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, at, len(self.keys) - 1)

    def words(self, text: str) -> list[str]:
        """Parts that no merge crosses: before a mark after another letter, around new lines."""
        if not text:
            return []
        marked = SPACE + text.replace(" ", SPACE)
        marked = _RUN.sub(r" \1", marked) if SPACE * 2 in marked else marked.replace(SPACE, " " + SPACE)
        if self.free:
            marked = marked.replace(self.free, f" {self.free} ")
        return marked.split(" ")  # spaces are free by now; empty parts have no symbols

    def merge_one(self, symbols: list[int]) -> list[int]:
        """The rule itself: the best pair first, the leftmost of equals, one merge at a time."""
        left = list(range(-1, len(symbols) - 1))
        right = list(range(1, len(symbols))) + [-1]
        queue: list[tuple[int, int, int, int]] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b >= 0:
                at = self.pair.get(symbols[a] * self.width + symbols[b])
                if at is not None:
                    heapq.heappush(queue, (int(self.rank[at]), a, symbols[a], symbols[b]))

        for i in range(len(symbols) - 1):
            offer(i, i + 1)
        while queue:
            _, a, one, two = heapq.heappop(queue)
            b = right[a]
            if symbols[a] != one or b < 0 or symbols[b] != two:
                continue
            symbols[a] = int(self.made[self.pair[one * self.width + two]])
            symbols[b] = -1
            right[a] = right[b]
            if right[a] >= 0:
                left[right[a]] = a
            offer(left[a], a)
            offer(a, right[a])
        return [s for s in symbols if s >= 0]

    def merge_all(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all words end to end, and how many each has.

        A round finds the smallest rank of each word and merges its occurrences, from
        the left and without overlap, in all words at once.  That is the one-by-one rule
        unless a merge makes a pair that ranks no later than its own; a word in which
        this comes up after several merges in a round is done again one by one, as are
        words of more than LONG letters.
        """
        letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        symbols = self.symbol_of[letters]
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths)
        done: dict[int, list[int]] = {
            int(w): self.merge_one(symbols[ends[w] - lengths[w]:ends[w]].tolist())
            for w in np.flatnonzero(lengths > LONG)
        }
        first, counted = symbols, lengths
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        word = np.flatnonzero((lengths > 0) & (lengths <= LONG))  # words still at work
        inside = np.repeat((lengths > 0) & (lengths <= LONG), lengths)
        symbols, lengths = symbols[inside], lengths[word]
        last = np.cumsum(lengths) - 1
        places = np.full(len(symbols), len(self.keys) - 1)
        places[:-1] = self.find(symbols[:-1], symbols[1:])
        places[last] = len(self.keys) - 1
        before = np.full(len(word), -1, np.int64)  # rank of the last round with several merges
        while len(word):
            rank = self.rank[places]
            starts = np.cumsum(lengths) - lengths
            least = np.minimum.reduceat(rank, starts)
            again = least <= before
            for w in word[again].tolist():
                at = int(ends[w])
                done[w] = self.merge_one(first[at - int(counted[w]):at].tolist())
            over = (least == NONE) | again
            if over.any():
                finished = over & ~again
                out.append((word[finished], lengths[finished], symbols[np.repeat(finished, lengths)]))
                stay = np.repeat(~over, lengths)
                symbols, places, rank = symbols[stay], places[stay], rank[stay]
                word, lengths, least = word[~over], lengths[~over], least[~over]
                if not len(word):
                    break
            owner = np.repeat(np.arange(len(word)), lengths)
            hit = np.flatnonzero(rank == least[owner])
            fresh = np.ones(len(hit), bool)
            fresh[1:] = hit[1:] != hit[:-1] + 1
            run = np.maximum.accumulate(np.where(fresh, np.arange(len(hit)), 0))
            hit = hit[(np.arange(len(hit)) - run) % 2 == 0]
            symbols[hit] = self.made[places[hit]]
            merges = np.bincount(owner[hit], minlength=len(word))
            before = np.where(merges > 1, least.astype(np.int64), -1)
            keep = np.ones(len(symbols), bool)
            keep[hit + 1] = False
            now = np.cumsum(keep)[hit] - 1
            symbols, places = symbols[keep], places[keep]
            lengths = lengths - merges
            ending = np.zeros(len(symbols), bool)
            ending[np.cumsum(lengths) - 1] = True
            beside = np.zeros(len(symbols), bool)
            beside[now] = beside[np.maximum(now - 1, 0)] = True
            touched = np.flatnonzero(beside & ~ending)
            places[touched] = self.find(symbols[touched], symbols[touched + 1])
            places[ending] = len(self.keys) - 1
        parts = [(which, values, length) for which, length, values in out]
        parts += [(np.array([w]), np.array(each, np.int64), np.array([len(each)])) for w, each in done.items()]
        return ordered(parts, len(words))

    def to_ids(self, flat: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Letters that are no piece become the pieces of their UTF-8 bytes."""
        strange = np.flatnonzero(flat >= self.size)
        if not len(strange):
            return flat, counts
        extra = {i: c for i, c in zip(range(self.size, self.unknown), self.inner_letters())}
        spelled = []
        for s in flat[strange].tolist():
            letter = extra[s] if s < self.unknown else chr(s - self.unknown)
            spelled.append(self.bytes[list(letter.encode())])
        sizes = np.ones(len(flat), np.int64)
        sizes[strange] = [len(x) for x in spelled]
        wide = np.repeat(flat, sizes)
        wide[np.repeat(flat >= self.size, sizes)] = np.concatenate(spelled)
        owner = np.repeat(np.arange(len(counts)), counts)
        return wide, np.bincount(owner, weights=sizes, minlength=len(counts)).astype(np.int64)

    def inner_letters(self) -> list[str]:
        """Letters with symbols between the pieces and the unknown ones, in order."""
        codes = np.flatnonzero((self.symbol_of >= self.size) & (self.symbol_of < self.unknown))
        return [chr(c) for c in codes[np.argsort(self.symbol_of[codes])]]


class Encoder:
    """Encodes texts; remembers up to MAX_WORDS words between calls."""

    def __init__(self, path: str):
        self.pieces = Pieces(path)
        self.memory = WordMemory(
            lambda words: self.pieces.to_ids(*self.pieces.merge_all(words)), MAX_WORDS)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and the number of each."""
        return self.memory.ids(list(map(self.pieces.words, texts)))

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of ids that ``encode`` gave, in UTF-8; the mark put in front goes."""
        text = b"".join(map(self.pieces.spoken.__getitem__, ids.tolist()))
        return text[1:] if len(ids) and self.pieces.marked[ids[0]] else text


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode(text: Column, model: str) -> Column:
    """Ids of each whole text as the library gives them, without begin and end ids.

    Null and empty texts have none.  ``model`` is the path of a BPE model with byte
    pieces, the same on all machines.
    """

    @F.arrow_udf("array<int>")
    def ids_of(texts: pa.Array) -> pa.Array:
        coder, parts = encoder(model), []
        _, offsets = binary_column(texts)
        start = 0
        while start < len(texts):
            stop = int(np.searchsorted(offsets, offsets[start] + SLICE, "right")) - 1
            stop = min(max(stop, start + 1), len(texts))
            ids, sizes = coder.encode([t.decode() for t in texts[start:stop].to_pylist()])
            bounds = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            parts.append(pa.ListArray.from_arrays(pa.array(bounds), pa.array(ids, pa.int32())))
            start = stop
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int32()))

    return ids_of(utf8(text))


def decode(ids: Column, model: str) -> Column:
    """The texts of arrays of ids; null and empty arrays give empty texts."""

    @F.arrow_udf("string")
    def text_of(arrays: pa.Array) -> pa.Array:
        coder = encoder(model)
        values = arrays.flatten().to_numpy(zero_copy_only=False)
        bounds = np.concatenate([[0], np.cumsum(
            arrays.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)
        return pa.array([coder.decode(values[a:b]).decode("utf-8", "replace")
                         for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())], pa.string())

    return text_of(ids)
