"""BPE encoding with a deterministic tokenization automaton.

Arcs carry vocabulary tokens.  The automaton starts as one state that loops on every base symbol, and each merge
``a b -> c`` (taken in order of rank) changes it by one gadget:

* the state that ``a`` leads to is copied without its ``b`` arc, and arcs labelled ``a`` now lead to the copy;
* every state with an ``a`` arc gets a ``c`` arc to where ``b`` led before.

What remains are exactly the token sequences that running the merges would give, one for each word.  All arcs of one label
lead to one state and a state never loses an arc.  A state is therefore named by a label and a time: the copies that the gadgets
made for that label, newest first, and below them the state that the label took over from its right part when it was made.  An
arc is looked up in that form in a few steps and then memorised.

A beginning of a sequence that stays is a sequence that stays, so every beginning of a word has exactly one path too, and the arc
it ends with is a function of the symbols read.  Read by symbols, the automaton is deterministic: a state holds that last arc
and, for each begun arc, the arc before it and its place in the trie of labels.  The table of states by symbols is filled as words
meet it; encoding a word is one lookup for each symbol, and the ids are read off from the end, each last arc telling where
the arc before it ended.

Texts are cut at white space, a chunk of them at a time, and only the distinct pieces of a chunk are encoded: their words go through
the automaton side by side, one symbol of all of them at a time.  Pieces that are not letters alone are memorised, as their words are
found one piece at a time.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

#: Distinct pieces, arcs, and states of the table by symbols that one worker memorises before it starts anew.
MEMORY, ARCS, STATES = 500_000, 500_000, 200_000
#: Characters of one chunk of texts, and the symbols of a word up to which it is read side by side with others.
CHUNK, SHORT = 4_000_000, 64

#: White space of the Unicode property White_Space; Python's split() takes four control characters more.
SPACES = re.compile("[\t-\r \x85\xa0  -     　]+")
CONTROLS = re.compile("[\x1c-\x1f]")
#: Pieces that no normalizer composes and that every Unicode version lowers and splits alike: ASCII and the letters of Latin-1.
PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
LETTERS = "^[A-Za-zÀ-ÖØ-öø-ÿ]+$"


def byte_symbols() -> list[str]:
    """The printable character for each byte: itself where it is visible Latin-1, else one from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in visible else chr(next(rest)) for b in range(256)]


class Arcs(dict):
    """Memorised answers to "has the state behind label x an arc t", keyed by x * 2**20 + t."""

    def __init__(self, owner: TokenizationAutomaton):
        self.owner = owner

    def __missing__(self, key: int) -> bool:
        if len(self) > ARCS:
            self.clear()
        self[key] = found = self.owner.has_arc(key >> 20, key & 0xFFFFF)
        return found


class TokenizationAutomaton:
    """Compiled from a tokenizers JSON file: BPE on byte symbols with a word-end suffix, NFC, lower case, regex pre-split."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.ids: dict[str, int] = dict(model["vocab"])
        self.end: str = model["end_of_word_suffix"] or ""
        self.special: dict[str, int] = {t["content"]: t["id"] for t in spec["added_tokens"]}
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"])
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.labels = [""] * (max([*self.ids.values(), *self.special.values()]) + 1)
        for label, token in [*self.ids.items(), *self.special.items()]:
            self.labels[token] = label
        self.symbols = byte_symbols()
        self.bytes = {symbol: byte for byte, symbol in enumerate(self.symbols)}
        whole = Tokenizer.from_file(path)
        self.normalizer, self.splitter = whole.normalizer, whole.pre_tokenizer
        self._compile([m.split(" ") if isinstance(m, str) else m for m in model["merges"]])
        self.arcs = Arcs(self)
        self.pieces: dict[str, bytes] = {}  # ids of the pieces met that are not letters alone, and those of the generation before
        self.older: dict[str, bytes] = {}
        self.widths = np.array([len(label.removesuffix(self.end) if self.end else label) for label in self.labels])
        self._empty_table()

    def _compile(self, merges: list[list[str]]) -> None:
        size = len(self.labels)
        self.made, self.left, self.right = [-1] * size, [-1] * size, [-1] * size
        self.copied = [len(merges) + 1] * size  # time of the first copy made for a label
        self.cut: dict[tuple[int, int], int] = {}  # (label, lost arc): time of that copy
        for symbol in self.symbols:
            for label in {symbol, symbol + self.end}:
                if label in self.ids:
                    self.made[self.ids[label]] = 0
        for time, (first, second) in enumerate(merges, 1):
            a, b, c = self.ids[first], self.ids[second], self.ids[first + second]
            if min(self.made[a], self.made[b]) < 0 or self.made[c] >= 0 or not self.has_arc(a, b):
                continue  # the pair never stands side by side, so the merge never applies
            self.made[c], self.left[c], self.right[c] = time, a, b
            self.cut[a, b] = time
            self.copied[a] = min(self.copied[a], time)
        self.steps: list[dict[str, int]] = [{}]  # trie of the labels that have arcs
        self.inner, self.final = [-1], [-1]  # token of a node inside a word, and at its end
        for label, token in self.ids.items():
            if self.made[token] < 0:
                continue
            ends = bool(self.end) and label.endswith(self.end)
            node = 0
            for symbol in label.removesuffix(self.end) if ends else label:
                if symbol not in self.steps[node]:
                    self.steps[node][symbol] = len(self.steps)
                    self.steps.append({})
                    self.inner.append(-1)
                    self.final.append(-1)
                node = self.steps[node][symbol]
            for tokens in [self.final] if ends else [self.inner] if self.end else [self.inner, self.final]:
                tokens[node] = token

    def has_arc(self, label: int, token: int) -> bool:
        """Whether ``token`` may follow ``label``."""
        before = len(self.labels) << 1  # only copies older than this count
        while True:
            if self.cut.get((label, token), before) < before:
                return False
            made = self.made[token]
            if self.copied[label] <= made and self.copied[label] < before:
                # the arc was added to a copy that was there: it has it where it has one for the token's left part
                before, token = min(before, made + 1), self.left[token]
            elif self.made[label] == 0:
                return True
            else:
                before, label = min(before, self.made[label]), self.right[label]

    def _empty_table(self) -> None:
        """Only the state that a word begins in, which is 0; as no symbol leads to it, a 0 in the table is a transition not met so far.

        ``begun`` holds (arc before, place in the trie) of every arc that the symbols read may have begun, longest first; ``last``
        is the arc that the path of the symbols read ends with, and ``ends`` the arc that the whole word ends with, by
        state * 256 + last byte.
        """
        self.states: dict[tuple[tuple[int, int], ...], int] = {}
        self.begun: list[tuple[tuple[int, int], ...]] = []
        self.table, self.last = np.zeros((1024, 256), np.int32), np.zeros(1024, np.int32)
        self.ends: dict[int, int] = {}
        self._state(((-1, 0),), -1)

    def _state(self, begun: tuple[tuple[int, int], ...], last: int) -> int:
        """The number of a state, which is added where it is new."""
        state = self.states.setdefault(begun, len(self.begun))
        if state == len(self.begun):
            self.begun.append(begun)
            if state == len(self.table):
                table, lasts = self.table, self.last
                self.table, self.last = np.zeros((2 * state, 256), np.int32), np.zeros(2 * state, np.int32)
                self.table[:state], self.last[:state] = table, lasts
            self.last[state] = last
        return state

    def next_state(self, state: int, byte: int) -> int:
        """The state behind one more symbol inside a word."""
        symbol = self.symbols[byte]
        steps, inner, arcs, begun, last = self.steps, self.inner, self.arcs, [], -1
        for before, node in self.begun[state]:
            node = steps[node].get(symbol, 0)
            if node:
                token = inner[node]
                if last < 0 <= token and (before < 0 or arcs[before << 20 | token]):
                    last = token
                if steps[node]:
                    begun.append((before, node))
        if last < 0:
            raise ValueError(f"symbol {symbol!r} is not in the vocabulary")
        begun.append((last, 0))
        found = self._state(tuple(begun), last)
        self.table[state, byte] = found
        return found

    def _end(self, at: int) -> int:
        """The arc that ends a word, by the state before its last byte * 256 + that byte."""
        found = self.ends.get(at)
        if found is not None:
            return found
        symbol = self.symbols[at & 255]
        for before, node in self.begun[at >> 8]:
            node = self.steps[node].get(symbol, 0)
            token = self.final[node] if node else -1
            if token >= 0 and (before < 0 or self.arcs[before << 20 | token]):
                self.ends[at] = token
                return token
        raise ValueError(f"symbol {symbol!r} is not in the vocabulary")

    def encode_word(self, word: bytes) -> list[int]:
        """Ids of one pre-split word of any length: one transition for each byte, then the arcs read off from the end."""
        state, lasts = 0, []
        for byte in word[:-1]:
            found = self.table.item(state, byte)
            if not found:
                if len(self.states) > STATES:
                    begun, last = self.begun[state], self.last.item(state)
                    self._empty_table()
                    state = self._state(begun, last)
                found = self.next_state(state, byte)
            state = found
            lasts.append(self.last.item(state))
        token = self._end(state << 8 | word[-1])
        ids, at, widths = [token], len(lasts) - self.widths.item(token), self.widths
        while at >= 0:
            ids.append(token := lasts[at])
            at -= widths.item(token)
        ids.reverse()
        return ids

    def encode_words(self, text: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pre-split words, and how many each has: ``text`` is the words' bytes one behind the other, none of them empty.

        All words of up to ``SHORT`` bytes take their transitions together, symbol by symbol; longer ones are read one by one.
        """
        ends = np.cumsum(sizes) - 1
        starts = ends - sizes + 1
        lasts, chosen = np.zeros(len(text), np.int32), np.zeros(len(text), bool)
        for k in np.flatnonzero(sizes > SHORT).tolist():
            ids = self.encode_word(text[starts[k] : ends[k] + 1].tobytes())
            place = slice(starts[k], starts[k] + len(ids))  # a word has no more ids than bytes
            lasts[place], chosen[place] = ids, True
        if len(self.states) > STATES:
            self._empty_table()
        order = np.argsort(-sizes, kind="stable")
        order = order[sizes[order] <= SHORT]
        first, last, falling = starts[order], ends[order], -sizes[order]
        state = np.zeros(len(order), np.int64)
        for k in range(-int(falling[0]) - 1 if len(order) else 0):
            at = first[: np.searchsorted(falling, -k - 1)] + k  # of the words that go on behind this symbol
            state[: len(at)] = moved = self._moved(state[: len(at)], text[at])
            lasts[at] = self.last[moved]
        keys, which = np.unique(state << 8 | text[last], return_inverse=True)
        lasts[last] = np.array([self._end(at) for at in keys.tolist()], np.int32)[which]
        while len(last):
            chosen[last] = True
            last = last - self.widths[lasts[last]]
            inside = last >= first
            last, first = last[inside], first[inside]
        return lasts[chosen], np.diff(np.cumsum(chosen)[ends], prepend=0)

    def _moved(self, states: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """The states behind one more symbol each; transitions that are not in the table yet are added to it."""
        found = self.table[states, symbols]
        missing = found == 0
        if missing.any():
            for at in np.unique((states << 8 | symbols)[missing]).tolist():
                self.next_state(at >> 8, at & 255)
            found = self.table[states, symbols]
        return found

    def _words(self, piece: str) -> list[bytes]:
        """The words of text without white space inside, normalized.  ASCII and Latin-1 letters are lowered and split here, other
        characters by the file's own normalizer and splitter, whose Unicode version counts."""
        if PLAIN.fullmatch(piece):
            return [word.encode() for word in self.words.findall(piece.lower())]
        return [bytes(map(self.bytes.__getitem__, w)) for w, _ in self.splitter.pre_tokenize_str(self.normalizer.normalize_str(piece))]

    def _learn(self, pieces: list[str]) -> None:
        """Memorises what distinct pieces encode to, in two generations: what is met again while the older one lasts is kept."""
        new = [p for p in pieces if p not in self.pieces]
        if len(self.pieces) + len(new) > MEMORY // 2:
            self.older, self.pieces, new = self.pieces, {}, pieces
        words = {}
        for piece in new:
            ids = self.older.get(piece)
            if ids is not None:
                self.pieces[piece] = ids
            elif piece.startswith(" "):
                self.pieces[piece] = np.array([self.special[piece[1:]]], "<u4").tobytes()
            else:
                words[piece] = self._words(piece)
        spelled = [word for found in words.values() for word in found]
        sizes = np.fromiter(map(len, spelled), np.int64, len(spelled))
        ids, counts = self.encode_words(np.frombuffer(b"".join(spelled), np.uint8), sizes)
        data, stops, at, start = ids.astype("<u4").tobytes(), [0, *(4 * np.cumsum(counts)).tolist()], 0, 0
        for piece, found in words.items():
            at += len(found)
            self.pieces[piece] = data[start : stops[at]]
            start = stops[at]

    def _encode_distinct(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct pieces in any order, and where those of each piece begin and how many they are."""
        letters = pc.match_substring_regex(pieces, LETTERS)
        lowered = pc.utf8_lower(pieces.filter(letters)).dictionary_encode()
        text, sizes = _bytes(lowered.dictionary)
        ids, counts = self.encode_words(text, sizes)
        others = pieces.filter(pc.invert(letters)).to_pylist()
        self._learn(others)
        parts = [self.pieces[p] for p in others]
        begin, number = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
        mask, which = letters.to_numpy(zero_copy_only=False), lowered.indices.to_numpy()
        begin[mask], number[mask] = (np.cumsum(counts) - counts)[which], counts[which]
        number[~mask] = sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        begin[~mask] = len(ids) + np.cumsum(sizes) - sizes
        return np.concatenate([ids.astype("<u4"), np.frombuffer(b"".join(parts), "<u4")]), begin, number

    def _odd(self, text: str) -> list[str]:
        """The pieces of a text with special tokens or control characters.  A special token's string becomes that token, as the
        tokenizers library reads it; it stands behind a space here, which no other piece has."""
        parts = self.specials.split(text) if self.specials is not None else [text]
        return [piece for k, part in enumerate(parts) for piece in ([" " + part] if k % 2 else SPACES.split(part))]

    def _chunk(self, texts: list[str]) -> Iterator[bytes]:
        odd = {k: self._odd(t) for k, t in enumerate(texts) if CONTROLS.search(t) or (self.specials is not None and self.specials.search(t))}
        lists = pc.utf8_split_whitespace(pa.array(["" if k in odd else t for k, t in enumerate(texts)], pa.large_string()))
        offsets = lists.offsets.to_numpy().astype(np.int64)
        starts, stops, end = offsets[:-1].copy(), offsets[1:].copy(), int(offsets[-1])
        for k, pieces in odd.items():  # theirs stand behind all others
            starts[k], stops[k] = end, end + len(pieces)
            end += len(pieces)
        flat = pa.concat_arrays([lists.flatten(), pa.array([p for pieces in odd.values() for p in pieces], pa.large_string())])
        coded = flat.dictionary_encode()
        ids, begin, number = self._encode_distinct(coded.dictionary)
        which = coded.indices.to_numpy()
        counts = number[which]
        reached = np.concatenate([[0], np.cumsum(counts)])
        whole = ids[np.repeat(begin[which] - reached[:-1], counts) + np.arange(reached[-1])]
        for a, b in zip(reached[starts].tolist(), reached[stops].tolist(), strict=True):
            yield whole[a:b].tobytes()

    def encode_all(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """Ids of each text, in order, as little-endian unsigned 32-bit integers; null and empty texts give no ids."""
        chunk, size = [], 0
        for text in texts:
            chunk.append(text or "")
            size += len(chunk[-1])
            if size >= CHUNK:
                yield from self._chunk(chunk)
                chunk, size = [], 0
        if chunk:
            yield from self._chunk(chunk)

    def encode(self, text: str | None) -> bytes:
        """Ids of one text."""
        return next(self.encode_all([text]))

    def decode(self, ids: bytes) -> str:
        """The labels of the arcs, in order; this tokenizer file has no decoder, so labels stand apart by one space."""
        return " ".join(map(self.labels.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _bytes(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all strings of an array, one behind the other, and the size of each."""
    if not len(words):
        return np.zeros(0, np.uint8), np.zeros(0, np.int64)
    _, offsets, data = words.buffers()
    reached = np.frombuffer(offsets, np.int64)[words.offset : words.offset + len(words) + 1]
    return np.frombuffer(data, np.uint8)[reached[0] : reached[-1]], np.diff(reached)


@functools.lru_cache(maxsize=2)
def automaton(path: str) -> TokenizationAutomaton:
    """One compiled automaton for each worker process and file."""
    return TokenizationAutomaton(path)


def encoder(path: str) -> Callable[[Column], Column]:
    """Column function: text to ids, as the bytes of little-endian unsigned 32-bit integers."""

    @F.pandas_udf(T.BinaryType())
    def encode(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        compiled = automaton(path)
        for batch in texts:
            yield pd.Series(list(compiled.encode_all(batch)), dtype=object)

    return encode


def decoder(path: str) -> Callable[[Column], Column]:
    """Column function: the bytes of ids to text."""

    @F.pandas_udf(T.StringType())
    def decode(ids: Iterator[pd.Series]) -> Iterator[pd.Series]:
        compiled = automaton(path)
        for batch in ids:
            yield pd.Series([None if b is None else compiled.decode(b) for b in batch], dtype=object)

    return decode


def codec(path: str) -> Callable[[Column], Column]:
    """Column function: text to (ids, decoded), in one pass through one worker for each task."""

    @F.pandas_udf("ids binary, decoded string")
    def both(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        compiled = automaton(path)
        for batch in texts:
            ids = list(compiled.encode_all(batch))
            yield pd.DataFrame({"ids": ids, "decoded": [compiled.decode(b) for b in ids]})

    return both
