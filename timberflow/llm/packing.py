"""Packing of documents into sequences of fixed length by linear grouping.

1. Every document becomes pieces of at most ``capacity`` tokens, and the pieces are counted by length: at most ``capacity``
   rows, whatever the corpus, which is all that the plan is made from.
2. Lengths above a limit are cut into groups of equal cardinality and rounded up to the longest of their group; for these
   few sizes the best mix of configurations (how many of each size share a sequence) is found by column generation, and
   rounded down to whole sequences.
3. In every slot of a configuration an actual piece of the slot's group takes its place, which leaves the room that rounding had
   added; what is left over, and all short pieces, are put by best fit, longest first.

The plan is a list of runs: "the pieces of length l with ranks from r on go to sequences from s on at offset o".  Pieces of one
length are interchangeable, so a piece needs its rank among its length only, which Spark computes over salted windows.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from timberflow.llm.bpe_automaton import automaton
from timberflow.llm.common import materialize

CAPACITY = 4096
#: (groups, divisor of the capacity above which a length is large); the plan with the fewest sequences is taken.
GROUPINGS = ((12, 4), (24, 4), (96, 4))
#: Pieces that one window of one length is meant to hold, and the least number of salts.
WINDOW_ROWS, LEAST_SALTS = 20_000, 16

Run = tuple[int, int, int, int, int]  # length, first rank, count, first sequence, offset


def pieces(documents: DataFrame, path: str, capacity: int = CAPACITY, end: int = 1, keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of each piece, and its ids' bytes where ``keep_ids`` is set.

    A document is the ids of its text followed by ``end``; only one longer than ``capacity`` is cut, every ``capacity`` ids.
    Null and empty texts are the one id ``end``; repeated rows give repeated pieces.
    """
    own = "piece int, start long, length long, ids_crc32 long" + (", ids binary" if keep_ids else "")

    @F.pandas_udf(f"array<struct<{own.replace(' int', ': int').replace(' long', ': long').replace(' binary', ': binary')}>>")
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        step, last = 4 * capacity, np.array([end], "<u4").tobytes()
        for texts in batches:
            rows = []
            for found in automaton(path).encode_all(texts):
                ids = found + last
                parts = [ids[k : k + step] for k in range(0, len(ids), step)]
                rows.append(
                    [
                        {"piece": k, "start": k * capacity, "length": len(p) // 4, "ids_crc32": zlib.crc32(p)} | ({"ids": p} if keep_ids else {})
                        for k, p in enumerate(parts)
                    ]
                )
            yield pd.Series(rows, dtype=object)

    return documents.select("doc_id", F.explode(cut("text")).alias("p")).select("doc_id", "p.*")


def _groups(lengths: np.ndarray, counts: np.ndarray, groups: int) -> list[tuple[int, int]]:
    """Index ranges of the lengths (longest first) that make groups of about equal cardinality."""
    total, found, start = counts.sum(), [], 0
    reached = np.cumsum(counts)
    for g in range(1, groups + 1):
        stop = int(np.searchsorted(reached, total * g / groups, "left")) + 1
        if stop > start:
            found.append((start, min(stop, len(lengths))))
            start = min(stop, len(lengths))
        if start >= len(lengths):
            break
    return found


def _configuration(sizes: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The dearest set of sizes that fits, by layers of one item more each."""
    best, steps = np.zeros(capacity + 1), []
    for _ in range(capacity // int(sizes.min())):
        layer, choice = best.copy(), np.full(capacity + 1, -1)
        for i, size in enumerate(sizes):
            offer = best[: capacity + 1 - size] + prices[i]
            better = offer > layer[size:] + 1e-12
            layer[size:][better] = offer[better]
            choice[size:][better] = i
        steps.append(choice)
        if (choice < 0).all():
            break
        best = layer
    counts, room = np.zeros(len(sizes), np.int64), capacity
    for choice in reversed(steps):
        if choice[room] >= 0:
            counts[choice[room]] += 1
            room -= int(sizes[choice[room]])
    return float(counts @ prices), counts


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 2000) -> list[tuple[np.ndarray, int]]:
    """(items of each size, times) for the mix of fewest sequences, rounded down: column generation on a square basis."""
    basis = np.diag([float(capacity // s) for s in sizes])
    times = demand / np.diag(basis)
    for _ in range(rounds):
        prices = np.linalg.solve(basis.T, np.ones(len(sizes)))
        value, column = _configuration(sizes, prices, capacity)
        if value <= 1 + 1e-7:
            break
        change = np.linalg.solve(basis, column.astype(float))
        ratio = np.where(change > 1e-9, times / np.where(change > 1e-9, change, 1), np.inf)
        out = int(ratio.argmin())
        step = float(ratio[out])
        times = np.maximum(times - step * change, 0)
        times[out] = step
        basis[:, out] = column
    return [(basis[:, k].astype(np.int64), int(np.floor(times[k] + 1e-9))) for k in np.argsort(-times) if times[k] >= 1 - 1e-9]


class _Plan:
    """Runs of placed pieces and of sequences with room, while the plan is made."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity, self.left, self.rank = capacity, dict(counts), defaultdict(int)
        self.runs: list[Run] = []
        self.sequences = 0
        self.room: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # by room: (first sequence, count)
        self.open = np.zeros(capacity + 1, bool)

    def put(self, length: int, count: int, sequence: int, offset: int) -> None:
        self.runs.append((length, self.rank[length], count, sequence, offset))
        self.rank[length] += count
        self.left[length] -= count

    def leave(self, room: int, sequence: int, count: int) -> None:
        if room and count:
            self.room[room].append((sequence, count))
            self.open[room] = True

    def fill(self, groups: list[list[int]], items: np.ndarray, times: int) -> None:
        """``times`` sequences of one configuration: slots take the longest pieces left in their group, in runs."""
        first, done = self.sequences, 0
        self.sequences += times
        slots = [g for g, n in enumerate(items) for _ in range(int(n))]
        while done < times:
            # lengths that the slots take next, and for how many sequences in a row all of them last
            need: dict[int, int] = defaultdict(int)
            taken = []
            for g in slots:
                length = next((x for x in groups[g] if self.left[x] > need.get(x, 0)), None)
                if length is not None:
                    need[length] += 1
                    taken.append(length)
            if not taken:
                break
            count = min(times - done, *(self.left[x] // n for x, n in need.items()))
            offset = 0
            for length in taken:
                self.put(length, count, first + done, offset)
                offset += length
            self.leave(self.capacity - offset, first + done, count)
            done += count
        if done < times:  # no piece of these groups is left: the last sequences are not needed
            self.sequences -= times - done

    def best_fit(self, length: int) -> None:
        """All pieces of the length that are left, each to the fullest sequence that takes it, in bulk."""
        while self.left[length]:
            n = self.left[length]
            at = int(self.open[length:].argmax()) + length
            if self.open[at]:
                sequence, count = self.room[at].pop()
                self.open[at] = bool(self.room[at])
                used = self.capacity - at
            else:
                at, used, sequence = self.capacity, 0, self.sequences
                count = -(-n // (self.capacity // length))
                self.sequences += count
            each = at // length
            whole = min(count, n // each)
            for k in range(each):
                if whole:
                    self.put(length, whole, sequence, used + k * length)
            self.leave(at - each * length, sequence, whole)
            n -= whole * each
            rest = min(n, each) if whole < count else 0
            for k in range(rest):
                self.put(length, 1, sequence + whole, used + k * length)
            if rest:
                self.leave(at - rest * length, sequence + whole, 1)
            untouched = count - whole - bool(rest)
            if used:
                self.leave(at, sequence + whole + bool(rest), untouched)


def plan(counts: dict[int, int], capacity: int = CAPACITY, groups: int = 24, divisor: int = 4) -> tuple[list[Run], int]:
    """Runs and number of sequences for the counts of pieces by length."""
    made = _Plan({k: v for k, v in counts.items() if v > 0}, capacity)
    large = np.array(sorted((k for k in made.left if capacity // divisor < k < capacity), reverse=True), np.int64)
    if len(large):
        number = np.array([made.left[int(k)] for k in large], np.int64)
        ranges = _groups(large, number, groups)
        sizes = np.array([large[a] for a, _ in ranges])
        demand = np.array([number[a:b].sum() for a, b in ranges], float)
        members = [[int(x) for x in large[a:b]] for a, b in ranges]
        for items, times in configurations(sizes, demand, capacity):
            made.fill(members, items, times)
    for length in sorted(made.left, reverse=True):
        made.best_fit(length)
    return made.runs, made.sequences


def best_plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[Run], int]:
    return min((plan(counts, capacity, *grouping) for grouping in GROUPINGS), key=lambda found: found[1])


def pack(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``found`` (doc_id, piece, start, length, ...) with sequence_id and offset added; no rows give no rows.

    ``found`` is read several times and must give the same rows each time: hand in a checkpoint or a written table.
    Repeated rows are packed as often as they stand there.
    """
    counts = {int(r["length"]): int(r["count"]) for r in found.groupBy("length").count().collect()}  # at most ``capacity`` rows
    runs = np.array(sorted(best_plan(counts, capacity)[0]), np.int64).reshape(-1, 5)
    salts = max(LEAST_SALTS, -(-sum(counts.values()) // WINDOW_ROWS))
    salted = found.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    sizes = salted.groupBy("length", "_salt").count()
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("length", "_salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    order = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "start")
    ranked = salted.withColumn("_rank", F.row_number().over(order)).join(starts, ["length", "_salt"])
    key = (runs[:, 0] << 44) + runs[:, 1]

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        at = np.searchsorted(key, (length.to_numpy(np.int64) << 44) + rank.to_numpy(np.int64), "right") - 1
        return pd.DataFrame({"sequence_id": runs[at, 3] + rank.to_numpy(np.int64) - runs[at, 1], "offset": runs[at, 4]})

    placed = ranked.withColumn("_place", place("length", F.col("_rank") + F.col("_before") - 1))
    return placed.select(*found.columns, "_place.sequence_id", "_place.offset")


def pack_documents(documents: DataFrame, path: str, capacity: int = CAPACITY, end: int = 1) -> DataFrame:
    """Pieces of ``documents`` (doc_id, text) with their places: the tokens are made once, and only their lengths shuffled."""
    return pack(materialize(pieces(documents.select("doc_id", "text"), path, capacity, end)), capacity)
