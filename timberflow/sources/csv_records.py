"""Strict CSV records from splittable text.

Whether a line starts a record depends on the quotes of all lines before it.  Each line is a function on two
states (inside or outside a quoted field at its start); such functions compose, so the state at every line
follows from running values and files are still read in blocks.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from timberflow.session import materialize
from timberflow.sources.lines import BLOCK, block_key, earlier_blocks, join_blocks, read_lines, runs_of_blocks

MALFORMED = "malformed_csv"

_INNER = r'[^"]*+(?:""[^"]*+)*+'
_QUOTED = rf'"{_INNER}"'
_PLAIN = r'[^",\n]*+'
_FIELD = rf"(?:{_QUOTED}|{_PLAIN})"
_OPENS = rf'\A(?:{_FIELD},)*+"{_INNER}\z'
_STAYS = rf"\A{_INNER}\z"
_REOPENS = rf'\A{_INNER}"(?:,{_FIELD}(?=,))*+,"{_INNER}\z'
_RECORD = rf"\A{_FIELD}(?:,{_FIELD})*+\z"


def check_headers(headers: Sequence[str]) -> list[str]:
    trimmed = [header.strip() for header in headers]
    for number, header in enumerate(trimmed, 1):
        if not header:
            raise ValueError(f"CSV header {number} is empty")
        if header in trimmed[: number - 1]:
            raise ValueError(f"duplicate CSV header {header!r}")
    return trimmed


def _first_record(lines: Sequence[str]) -> list[str] | None:
    """The first row of the lines, None if they end before it does."""
    try:
        return next(csv.reader((line.removesuffix("\r") + "\n" for line in lines if line.strip("\r")), strict=True))
    except (StopIteration, csv.Error):
        return None


def read_headers(spark: SparkSession, path: str) -> list[str]:
    """Header row from the start of the first file listed, however many lines and blocks its quoted names take."""
    top = spark.read.option("lineSep", "\n").text(path).filter("_metadata.file_block_start = 0")
    rows = top.select("value", "_metadata.file_path").take(64)
    header, asked = _first_record([row.value for row in rows if row.file_path == rows[0].file_path]), 64
    while header is None and rows:
        asked *= 16
        numbered = read_lines(spark, rows[0].file_path).filter(F.col("line") <= asked).orderBy("line").collect()
        header = _first_record([row.text for row in numbered])
        if len(numbered) < asked:
            break
    if header is None:
        raise ValueError("no CSV header row found")
    return check_headers(header)


def fields_of(record: Column) -> Column:
    """Field texts of a well-formed record, null for any other."""
    found = F.regexp_extract_all(F.concat(F.lit(","), record), F.lit(rf",({_QUOTED}|{_PLAIN})"), 1)
    plain = F.transform(
        found,
        lambda field: F.when(
            field.startswith('"'), F.replace(F.substr(field, F.lit(2), F.length(field) - 2), F.lit('""'), F.lit('"'))
        ).otherwise(field),
    )
    return F.when(record.rlike(_RECORD), plain)


def _states(out: np.ndarray, inside: np.ndarray, entry: int) -> tuple[np.ndarray, np.ndarray]:
    """State before and after each line (1: inside quotes), from the state before the first one.

    ``out`` and ``inside`` are the states a line leads to from outside and from inside.  A line that leads to one state from
    both is a fixed point; later states follow from the swaps since then.
    """
    swaps = np.cumsum((out == 1) & (inside == 0))
    fixed = np.maximum.accumulate(np.where(out == inside, np.arange(len(out)), -1))
    since = np.where(fixed < 0, entry + swaps, out[fixed] + swaps - swaps[fixed])
    after = since % 2
    return np.concatenate([[entry], after[:-1]]).astype(np.int64), after.astype(np.int64)


def _flags(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return tuple(part.column(name).to_numpy() for name in ("out", "inside", "solid"))


_FUNCTION = "file string, block bigint, exit0 int, exit1 int, count0 bigint, count1 bigint"


def _block_functions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per block: the state it is left in and the records that begin in it, for either state it is entered in."""
    rows: list[list] = []
    for begins, part in runs_of_blocks(batches):
        if begins:
            rows.append([part.column("file")[0].as_py(), part.column("block")[0].as_py(), 0, 1, 0, 0])
        row, (out, inside, solid) = rows[-1], _flags(part)
        for entry in (0, 1):
            before, after = _states(out, inside, row[2 + entry])
            row[2 + entry] = int(after[-1])
            row[4 + entry] += int(((before == 0) & (solid == 1)).sum())
    names = ["file", "block", "exit0", "exit1", "count0", "count1"]
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
    columns = list(zip(*rows)) or [()] * len(names)
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


_PART = "file string, rec bigint, block bigint, text string"


class _Cut:
    """Second pass: records that begin and end in one block, or (``edges``) the parts that stick out of their block."""

    def __init__(self, edges: bool):
        self.edges = edges

    def _rows(self, files, recs, blocks, texts) -> pa.RecordBatch:
        arrays = [pa.array(files, pa.string()), pa.array(recs, pa.int64()), pa.array(blocks, pa.int64()), pa.array(texts, pa.string())]
        return pa.RecordBatch.from_arrays(arrays, names=["file", "rec", "block", "text"])

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file = block = None
        held: list[str] | None = None  # lines of the record that is open
        whole, state, rec, lost = False, 0, 0, None

        def left() -> Iterator[pa.RecordBatch]:
            if self.edges and held is not None and rec != lost:
                yield self._rows([file], [rec], [block], ["\n".join(held)])

        for begins, part in runs_of_blocks(batches):
            if begins:
                yield from left()
                file, block, state, rec, lost = (part.column(n)[0].as_py() for n in ("file", "block", "entry", "carry", "unclosed"))
                held, whole = ([], False) if state else (None, False)
            out, inside, solid = _flags(part)
            before, after = _states(out, inside, state)
            starts = (before == 0) & (solid == 1)
            recs = rec + np.cumsum(starts)
            single = starts & (after == 0)
            if not self.edges and single.any():
                chosen = part.filter(pa.array(single))
                yield pa.RecordBatch.from_arrays([chosen.column("file"), pa.array(recs[single]), chosen.column("block"), chosen.column("text")], names=["file", "rec", "block", "text"])
            place = np.flatnonzero(~single & (starts | (before == 1)))
            texts = part.column("text").take(pa.array(place)).to_pylist()
            ready: list[tuple[int, str]] = []
            for k, text in zip(place.tolist(), texts):
                if starts[k]:
                    held, whole = [], True
                if recs[k] != lost:
                    held.append(text)
                if after[k] == 0:
                    if recs[k] != lost and whole != self.edges:
                        ready.append((int(recs[k]), "\n".join(held)))
                    held = None
            if ready:
                yield self._rows([file] * len(ready), [r for r, _ in ready], [block] * len(ready), [t for _, t in ready])
            state, rec = int(after[-1]), int(recs[-1])
        yield from left()


def _entries(functions: DataFrame) -> DataFrame:
    """Per block the state it is entered in, the records begun before it, whether one sticks out, and the record of the file
    whose quotes never close (null if there is none)."""
    moves = ((F.col("exit0") == 1) & (F.col("exit1") == 0)).cast("int")
    blocks = functions.withColumn("_moves", moves)
    blocks = blocks.withColumn("_moved", F.coalesce(F.sum("_moves").over(earlier_blocks()), F.lit(0)))
    settled = F.when(F.col("exit0") == F.col("exit1"), (F.col("exit0") + F.col("_moved") + F.col("_moves")) % 2)
    blocks = blocks.withColumn("_settled", F.last(settled, ignorenulls=True).over(earlier_blocks()))
    blocks = blocks.withColumn("entry", ((F.coalesce("_settled", F.lit(0)) + F.col("_moved")) % 2).cast("int"))
    pick = lambda name: F.when(F.col("entry") == 0, F.col(f"{name}0")).otherwise(F.col(f"{name}1"))
    blocks = blocks.withColumns({"_count": pick("count"), "_exit": pick("exit")})
    blocks = blocks.withColumn("carry", F.coalesce(F.sum("_count").over(earlier_blocks()), F.lit(0)))
    last = Window.partitionBy("file").orderBy("block").rowsBetween(0, Window.unboundedFollowing)
    total = F.when(F.last("_exit").over(last) == 1, F.last(F.col("carry") + F.col("_count")).over(last))
    sticks = (F.col("entry") == 1) | (F.col("_exit") == 1)
    return blocks.select(*BLOCK, "entry", "carry", sticks.alias("sticks"), total.alias("unclosed"))


def split_records(scanned: DataFrame) -> DataFrame:
    """Columns file, rec (1-based record number in the file), text (null when its quotes never close).

    Two passes over the blocks.  The first sees what each line does to the state and gives one function per block, from the
    state it is entered in; the second knows that state and cuts finished records out of the block where they lie.  Only the
    parts of records that stick out of a block are exchanged.  The parts of a record that never closes are not gathered.
    """
    text = F.col("text")
    flagged = scanned.select(
        *BLOCK,
        block_key().alias("key"),
        text.rlike(_OPENS).cast("int").alias("out"),
        (text.rlike(_STAYS) | text.rlike(_REOPENS)).cast("int").alias("inside"),
        (text != "").cast("int").alias("solid"),
        "text",
    )
    functions = flagged.drop("text").mapInArrow(_block_functions, _FUNCTION)
    blocks = materialize(_entries(materialize(functions)))
    columns = [*flagged.columns, "entry", "carry", "unclosed"]
    whole = join_blocks(flagged, blocks).select(*columns).mapInArrow(_Cut(False), _PART)
    sticking = blocks.filter("sticks")
    parts = join_blocks(flagged, sticking).select(*columns).mapInArrow(_Cut(True), _PART)
    ordered = F.sort_array(F.collect_list(F.struct("block", "text")))
    spanning = parts.groupBy("file", "rec").agg(F.array_join(F.transform(ordered, lambda part: part["text"]), "\n").alias("text"))
    broken = blocks.filter("unclosed is not null").select("file", F.col("unclosed").alias("rec")).distinct()
    return whole.select("file", "rec", "text").unionByName(spanning).unionByName(broken.withColumn("text", F.lit(None).cast("string")))


def records(scanned: DataFrame, headers: Sequence[str], has_header: bool = True) -> DataFrame:
    """Columns file, line (record number, header included), raw, joined, record and error."""
    headers = check_headers(headers)
    rows = split_records(scanned).withColumn("_fields", fields_of(F.col("text")))
    names = F.array(*[F.lit(header) for header in headers])
    if has_header:
        trimmed = F.transform("_fields", lambda field: F.trim(field))
        differs = F.concat(F.lit("CSV header differs in "), F.col("file"))
        same = F.coalesce(trimmed == names, F.lit(False))
        gate = F.when(F.col("rec") > 1, True).when(same, False).otherwise(F.raise_error(differs).cast("boolean"))
        rows = rows.filter(gate)
    values = F.col("_fields")
    count = F.size(values)
    error = F.when(values.isNull(), MALFORMED).when(
        count != len(headers), F.concat(F.lit(f"expected {len(headers)} columns, got "), count.cast("string"))
    )
    typed = F.transform(values, lambda value: F.struct(F.lit("string").alias("kind"), value.alias("text")))
    return rows.select(
        "file",
        F.col("rec").alias("line"),
        F.coalesce(F.array_join(values, ","), F.lit("")).alias("raw"),
        F.lit(0).alias("joined"),
        F.when(error.isNull(), F.map_from_arrays(names, typed)).alias("record"),
        error.alias("error"),
    )
