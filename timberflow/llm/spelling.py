"""Spelling variants grouped by searches with one error in bidirectional FM-indexes.

Two words are near if one inserted, deleted or replaced code point separates them.  An edit leaves one half of a word as it
is, so a search matches either half exactly and crosses the other with one error.  The index is an FM-index of the words
between delimiters and one of the same text backwards, kept in step: an interval of suffix ranks in one determines the
interval in the other, so that a match grows to either side.

The vocabulary is spread by halves.  A word of length ``m`` is posted under its first ``m div 2`` and its last ``m - m div 2``
code points, marked by length and side; a word looks for near words of length ``m`` (replaced), ``m + 1`` (inserted) and
``m - 1`` (deleted) under its own beginnings and ends of that length's halves.  Postings go to buckets by hash.  A bucket with
more letters or searches than a task should hold is cut on both sides into a grid, where every part of its index meets every
part of its searches once; so a very frequent half costs more tasks and no larger ones, and no pair of words is ever formed
but the near ones, which are counted where they are found.

Forms: a word's form is its near word of largest count (ties: smallest in code-point order), if that count is at least twice
its own.  Counts double along forms, so following them ends, and pointers doubled by joins reach the end in as many rounds
as the logarithm of the longest walk.

Odd rows: null and empty texts have no words.  In a row without id no letter is dropped.  Repeated rows count each.  Long texts
are read whole; a run of any length is one word, and a word longer than :data:`LETTERS` has a part of the index to itself.
An empty vocabulary gives no rows.  Other columns are not looked at.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberflow.session import materialize

#: Shortest word in code points, least count, and the divisor that picks the runs which lose a letter.
SHORTEST, LEAST, DROP_EVERY = 5, 3, 97
#: Letters and searches of one part of a bucket, and searches whose states are held at a time.
LETTERS, SEARCHES, AT_A_TIME = 1 << 17, 1 << 17, 1 << 12
#: Distinct words that a counting task keeps before it hands them on.
HELD = 200_000

_RUN = re.compile("[a-zÀ-ÿ]{%d,}" % SHORTEST)
_COUNTS = pa.schema([("word", pa.string()), ("n", pa.int64())])
_FOUND = "word string, n_near long, n long, form string"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) sums of the rows seen, handed on whenever many words are held."""

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], schema=_COUNTS)

    held: Counter[str] = Counter()
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if not text.is_valid:
                continue
            # The lower-casing of bytes touches A-Z alone.
            runs = _RUN.findall(text.as_buffer().to_pybytes().lower().decode())
            held.update(runs)
            if doc_id is None:
                continue
            start = zlib.crc32(f"{doc_id}:".encode())
            for run in [w for w in set(runs) if zlib.crc32(w.encode(), start) % DROP_EVERY == 0]:
                n, at = runs.count(run), zlib.crc32(run.encode(), start) % len(run)
                held[run] -= n
                if len(run) > SHORTEST:
                    held[run[:at] + run[at + 1 :]] += n
        if len(held) > HELD:
            yield out()
            held.clear()
    if held:
        yield out()


def vocabulary(documents: DataFrame) -> DataFrame:
    """(``word``, ``n``) of the words that occur often enough; runs are counted in tasks before any of them moves."""
    counted = documents.select("doc_id", "text").mapInArrow(_count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST)


class TwoWay:
    """FM-indexes of the words between delimiters, forwards and backwards.

    Both are cyclic, with the delimiter (code 0) in front of each word; ``at[c]`` is the first rank of suffixes that begin
    with code ``c`` and ``seen[i, c]`` how often ``c`` stands before the suffixes of rank below ``i``.  Letters that no word
    has share a last code that never occurs.
    """

    def __init__(self, words: list[str]) -> None:
        letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        self.alphabet = np.unique(letters)
        self.other = len(self.alphabet) + 1
        starts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
        text = np.zeros(int(lengths.sum()) + len(words), np.int64)
        filled = np.ones(len(text), bool)
        filled[starts] = False
        text[filled] = np.searchsorted(self.alphabet, letters) + 1
        self.size = len(text)
        self.at = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=self.other + 1))[:-1]]).astype(np.int32)
        self.seen, order = self._index(text)
        # The delimiters' suffixes have the least ranks; the one in front of a word names it.
        self.word_of = np.searchsorted(starts, order[: len(words)])
        self.back_seen, order = self._index(text[::-1])
        behind = (self.size - 1 - order[: len(words)]).astype(np.int64)  # the delimiter behind the word, read forwards
        self.back_word_of = (np.searchsorted(starts, behind) - 1) % len(words)

    def _index(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Table of occurrences and the suffix order, by doubling of the compared length."""
        n, bits = len(text), max(1, int(self.other).bit_length())
        width = max(1, 62 // bits)
        key, at = np.zeros(n, np.int64), np.arange(n)
        for k in range(width):
            key = (key << bits) | text[(at + k) % n]
        while True:
            order = np.argsort(key, kind="stable")
            new = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
            rank = np.empty(n, np.int64)
            rank[order] = new
            if new[-1] == n - 1 or width >= n:
                break
            key = rank * n + rank[(at + width) % n]
            width *= 2
        before = text[order - 1]
        seen = np.zeros((n + 1, self.other + 1), np.int32)
        seen[at + 1, before] = 1
        np.cumsum(seen, axis=0, out=seen)
        return seen, order

    def codes(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Codes of all letters of the words, one after the other, and where each word begins."""
        letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        place = np.minimum(np.searchsorted(self.alphabet, letters), len(self.alphabet) - 1)
        codes = np.where(self.alphabet[place] == letters, place + 1, self.other)
        return codes, np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))])

    def grow(self, low, high, other, codes, left: bool):
        """Intervals after one more letter to the left (or right), and the start of the interval of the other side."""
        table = self.seen if left else self.back_seen
        a, b = table[low], table[high]
        smaller = np.cumsum(b - a, axis=1)
        row = np.arange(len(low))
        count = b[row, codes] - a[row, codes]
        other = other + smaller[row, codes] - count
        low = self.at[codes] + a[row, codes]
        return low, low + count, other

    def half(self, codes: np.ndarray, begin: np.ndarray, end: np.ndarray, left: bool):
        """Exact matches of ``codes[begin:end]`` and the delimiter at its outer side: (searches, low, high) of the inner side.

        ``left``: the half is the word's first, grown leftwards up to the delimiter; else its last, grown rightwards.
        """
        alive = np.arange(len(begin))
        low, high, other = (np.full(len(begin), x, np.int64) for x in (0, self.size, 0))
        for k in range(int((end - begin).max(initial=0)) + 1):
            size = end[alive] - begin[alive]
            inside, done = k < size, k > size
            place = np.where(inside, end[alive] - 1 - k if left else begin[alive] + k, 0)
            code = np.where(inside, codes[place], 0)
            new = self.grow(low, high, other, code, left)
            low, high, other = (np.where(done, old, x) for old, x in zip((low, high, other), new, strict=True))
            keep = high > low
            alive, low, high, other = alive[keep], low[keep], high[keep], other[keep]
            if not len(alive):
                break
        return alive, other, other + high - low

    def cross(self, codes, first, step, count, kind, alive, low, high, left: bool) -> tuple[np.ndarray, np.ndarray]:
        """(search, word) of the matches that reach the far delimiter with exactly one error in the remaining half.

        The remaining letters of search ``i`` are ``codes[first[i] + step * k]`` for ``k`` below ``count[i]``; ``kind`` is 1
        where the word found has a letter more, -1 where it has one less, 0 where one is replaced.
        """
        table, names = (self.seen, self.word_of) if left else (self.back_seen, self.back_word_of)
        clean = (alive, low, high)
        wrong = (np.empty(0, np.int64),) * 3
        found = []

        def forward(states, code):
            who, a, b = states
            a, b = self.at[code] + table[a, code], self.at[code] + table[b, code]
            keep = b > a
            return who[keep], a[keep], b[keep]

        def pick(states, keep):
            return tuple(x[keep] for x in states)

        def letter(states, k):
            return codes[first[states[0]] + step * k]

        for k in range(int(count.max(initial=0)) + 1):
            if len(clean[0]):
                # Any letter of the alphabet may stand where one is put in or replaced.
                more = kind[clean[0]] == 1
                swap = (kind[clean[0]] == 0) & (k < count[clean[0]])
                some = pick(clean, more | swap)
                if len(some[0]):
                    who, a, b = some
                    spot, code = np.nonzero(table[b, 1 : self.other] > table[a, 1 : self.other])
                    code = code + 1
                    put = kind[who[spot]] == 1
                    end = k >= count[who[spot]]
                    same = np.zeros(len(spot), bool)
                    same[~end] = letter((who[spot[~end]],), k) == code[~end]
                    spot, code, put = spot[~same], code[~same], put[~same]
                    born = (who[spot], self.at[code] + table[a[spot], code], self.at[code] + table[b[spot], code])
                    wrong = tuple(np.concatenate([x, y[put]]) for x, y in zip(wrong, born, strict=True))
                    swapped = pick(born, ~put)
                else:
                    swapped = some
                skipped = pick(clean, (kind[clean[0]] == -1) & (k < count[clean[0]]))
            else:
                swapped = skipped = clean
            # States with the error match the letter; those whose letters are used up must meet the delimiter.
            over = k >= count[wrong[0]]
            who, a, _ = forward(pick(wrong, over), 0)
            found.append((who, names[a]))
            wrong = pick(wrong, ~over)
            wrong = forward(wrong, letter(wrong, k))
            wrong = tuple(np.concatenate(x) for x in zip(wrong, swapped, skipped, strict=True))
            clean = pick(clean, k < count[clean[0]])
            clean = forward(clean, letter(clean, k))
            if not len(clean[0]) and not len(wrong[0]):
                break
        return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])

    def near(self, words: list[str], first_half: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(search, word) pairs: words of the index that are one edit of the given kind away and keep the given half."""
        codes, begin = self.codes(words)
        begin, end = begin[:-1], begin[1:]
        middle = begin + (end - begin + kind) // 2
        # The second half of the word found, counted from its end.
        middle = np.where(first_half, middle, end - ((end - begin + kind) - (end - begin + kind) // 2))
        pairs = []
        for side in (True, False):
            which = np.flatnonzero(first_half == side)
            if not len(which):
                continue
            b, m, e, kinds = begin[which], middle[which], end[which], kind[which]
            alive, low, high = self.half(codes, *((b, m) if side else (m, e)), left=side)
            rest = (e - m) if side else (m - b)
            who, word = self.cross(codes, m if side else m - 1, 1 if side else -1, rest, kinds, alive, low, high, left=not side)
            pairs.append((which[who], word))
        return tuple(np.concatenate(x) for x in zip(*pairs, strict=True))


def _search(pdf: pd.DataFrame) -> pd.DataFrame:
    """Per search of one part of a bucket: how many near words its part of the index has, and the best of them."""
    listed, asked = pdf[pdf["posted"]], pdf[~pdf["posted"]]
    out: dict[str, list] = {"word": [], "n_near": [], "n": [], "form": []}
    kinds_of = {"word": object, "n_near": "int64", "n": "int64", "form": object}
    if not len(listed) or not len(asked):
        return pd.DataFrame(out).astype(kinds_of)
    # In code-point order, so that a word's place also settles ties.
    listed = listed.sort_values("word", ignore_index=True)
    words, counts = listed["word"].tolist(), listed["n"].to_numpy()
    index = TwoWay(words)
    for k in range(0, len(asked), AT_A_TIME):
        part = asked.iloc[k : k + AT_A_TIME]
        mine = part["word"].tolist()
        sides, kinds = part["first_half"].to_numpy(bool), part["kind"].to_numpy(np.int64)
        who, word = index.near(mine, sides, kinds)
        pairs = np.unique(who.astype(np.int64) * len(words) + word)
        who, word = pairs // len(words), pairs % len(words)
        # What a search by the first half finds as well is left to that search.
        keep = np.fromiter(
            (sides[q] or words[v][: len(words[v]) // 2] != mine[q][: len(words[v]) // 2] for q, v in zip(who, word, strict=True)), bool, len(who)
        )
        who, word = who[keep], word[keep]
        best = np.lexsort((word, -counts[word], who))
        who, word = who[best], word[best]
        first = np.flatnonzero(np.diff(who, prepend=-1))
        sizes = np.diff(np.append(first, len(who)))
        out["word"] += [mine[q] for q in who[first]]
        out["n_near"] += sizes.tolist()
        out["n"] += counts[word[first]].tolist()
        out["form"] += [words[v] for v in word[first]]
    return pd.DataFrame(out).astype(kinds_of)


def postings(words: DataFrame, buckets: int) -> DataFrame:
    """Two postings and six searches of each word, with their bucket; the word of a search has no count."""
    size = F.char_length("word")

    def bucket(kind: int, first_half: bool):
        length = size + kind
        head = F.floor(length / 2).cast("int")
        half = F.substring(F.col("word"), F.lit(1), head) if first_half else F.right(F.col("word"), length - head)
        return F.pmod(F.xxhash64(F.lit(first_half), length, half), F.lit(buckets))

    # A word may have one bucket for both halves, and is listed there once.
    own = F.array_distinct(F.array(*(bucket(0, side) for side in (True, False))))
    listed = words.select("word", "n", F.explode(own).alias("bucket"), F.lit(True).alias("posted"), F.lit(None).cast("boolean").alias("first_half"), F.lit(0).alias("kind"))
    wanted = [F.struct(bucket(kind, side).alias("bucket"), F.lit(False).alias("posted"), F.lit(side).alias("first_half"), F.lit(kind).alias("kind")) for kind in (0, 1, -1) for side in (True, False)]
    asked = words.select("word", F.lit(None).cast("long").alias("n"), F.inline(F.array(*wanted))).filter(size + F.col("kind") >= SHORTEST)
    return listed.unionByName(asked)


def near_words(words: DataFrame, letters: int = LETTERS, searches: int = SEARCHES) -> DataFrame:
    """Per word with near ones: ``n_near`` and the best near word ``form`` with its count ``n``."""
    total = words.agg(F.sum(F.char_length("word") + 1)).first()[0] or 0
    rows = postings(words, max(1, math.ceil(4 * total / letters)))
    posted = F.col("posted")
    cuts = rows.groupBy("bucket").agg(
        F.ceil(F.sum(F.when(posted, F.char_length("word") + 1)) / letters).alias("rows"),
        F.ceil(F.count(F.when(~posted, 1)) / searches).alias("columns"),
    )
    hashed = F.xxhash64("word", F.lit(1))
    row, column = F.pmod(hashed, F.greatest("rows", F.lit(1))), F.pmod(hashed, F.greatest("columns", F.lit(1)))
    all_of = lambda name: F.sequence(F.lit(0).cast("long"), F.greatest(name, F.lit(1)) - 1)
    grid = F.when(posted, F.transform(all_of("columns"), lambda j: F.struct(row.alias("i"), j.alias("j")))).otherwise(
        F.transform(all_of("rows"), lambda i: F.struct(i.alias("i"), column.alias("j")))
    )
    parts = rows.join(cuts, "bucket").select("bucket", "word", "n", "posted", "first_half", "kind", F.explode(grid).alias("at"))
    found = parts.groupBy("bucket", "at").applyInPandas(_search, _FOUND)
    best = F.min(F.struct((-F.col("n")).alias("less"), F.col("form"))).alias("best")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("best.less")).alias("form_n"), "best.form")


def ends(forms: DataFrame) -> DataFrame:
    """(``word``, ``root``): where the pointers ``word`` -> ``form`` end, by doubling their reach."""
    step = materialize(forms.select("word", F.col("form").alias("root")))
    while True:
        further = step.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = step.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        moved = materialize(moved)
        step = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            return step


def variants(documents: DataFrame, letters: int = LETTERS, searches: int = SEARCHES) -> DataFrame:
    """All words with their form, the root of their group and counts: ``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n``."""
    words = materialize(vocabulary(documents))
    near = materialize(words.join(near_words(words, letters, searches), "word", "left"))
    accepted = F.col("form_n") >= 2 * F.col("n")
    formed = near.select(
        "word",
        F.when(accepted, F.col("form")).alias("form"),
        "n",
        F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(accepted, F.col("form_n")).alias("form_n"),
    )
    roots = ends(formed.filter(F.col("form").isNotNull()))
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
