"""Raw records of each source format, with line numbers, raw text and decoding errors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timberflow.functions.text import trim_space
from timberflow.operators.predicates import java_pattern
from timberflow.session import materialize
from timberflow.settings import LogSource, Multiline
from timberflow.sources import csv_records
from timberflow.sources.json_documents import read_documents
from timberflow.sources.json_records import explode_documents, with_record
from timberflow.sources.lines import BLOCK, block_key, earlier_blocks, join_blocks, number_lines, runs_of_blocks, scan_lines

# Reasons of rejected lines.
TOO_LONG = "multiline record exceeds max_lines"
LINE_TOO_LONG = "line too long"

_BLOCKS = "file string, block bigint, lines bigint, first bigint, total bigint, last bigint, first_start bigint, last_start bigint"
_WHOLE = "file string, line bigint, text string, size int, over boolean"
_PART = "file string, start bigint, chunk bigint, line bigint, text string, size int, over boolean"


def _block_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per block: lines, first seq, solid lines, number of the last start among them, and seq of first and last start."""
    rows: list[list] = []
    for begins, part in runs_of_blocks(batches):
        seq, solid, starts = (part.column(name).to_numpy() for name in ("seq", "solid", "starts"))
        if begins:
            rows.append([part.column("file")[0].as_py(), part.column("block")[0].as_py(), 0, int(seq[0]), 0, None, None, None])
        row, found = rows[-1], np.flatnonzero(starts)
        if len(found):
            row[5] = row[4] + int(solid[: found[-1] + 1].sum())
            row[6] = int(seq[found[0]]) if row[6] is None else row[6]
            row[7] = int(seq[found[-1]])
        row[2] += len(seq)
        row[4] += int(solid.sum())
    names = [part.split()[0] for part in _BLOCKS.split(", ")]
    columns = list(zip(*rows)) or [()] * len(names)
    kinds = [pa.string()] + [pa.int64()] * (len(names) - 1)
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


class _Runs:
    """Second pass: runs of at most ``most`` lines of one record.

    Gives the runs that begin and end in a block, or (``edges``) the parts of those that stick out of it; a part without text
    only says that the run before the block overflowed.
    """

    def __init__(self, most: int, edges: bool):
        self.most, self.edges = most, edges

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.bool_()]
        names = ["file", "start", "chunk", "line", "text", "size", "over"]
        columns = [(n, pa.array(c, k)) for n, c, k in zip(names, list(zip(*rows)), kinds) if self.edges or n not in ("start", "chunk")]
        return pa.RecordBatch.from_arrays([c for _, c in columns], names=[n for n, _ in columns])

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: list[tuple] = []
        run = None  # the open run: start, chunk, line, texts, whether its first line is in this block

        def close(over: bool, ended: bool) -> None:
            start, chunk, line, texts, whole = run
            if (whole and ended) != self.edges:
                ready.append((file, start, chunk, line, "\n".join(texts), len(texts), over))

        for begins, part in runs_of_blocks(batches):
            if begins:
                if run is not None:
                    close(False, ended=False)
                run, fresh = None, True
                names = ("file", "first", "lines_before", "n_before", "carry", "last", "last_start")
                file, first, lines_before, n, start, last, last_start = (part.column(name)[0].as_py() for name in names)
                n_before = n
            seq, solid, starts = (part.column(name).to_numpy() for name in ("seq", "solid", "starts"))
            place = np.flatnonzero(solid)
            if not len(place):
                continue
            number = n + 1 + np.arange(len(place))
            jump = np.searchsorted(seq[place], last_start) if last_start is not None else len(place)
            if jump < len(place) and seq[place[jump]] == last_start:
                # In the pass over edges the lines between the first and the last start are left out.
                number[jump:] += n_before + last - number[jump]
            begun = np.maximum.accumulate(np.where(starts[place] == 1, number, start))
            chunk, within = np.divmod(number - begun, self.most)
            change = np.flatnonzero((begun[1:] != begun[:-1]) | (chunk[1:] != chunk[:-1])) + 1
            texts = part.column("text").take(pa.array(place)).to_pylist()
            for a, b in zip([0, *change.tolist()], [*change.tolist(), len(place)]):
                at = (int(begun[a]), int(chunk[a]))
                if run is not None and run[:2] == at:
                    run[3].extend(texts[a:b])
                    continue
                if run is not None:
                    close(over=run[0] == at[0], ended=True)
                elif fresh and within[a] == 0 and chunk[a] > 0 and self.edges:
                    ready.append((file, at[0], at[1] - 1, None, None, 0, True))
                run, fresh = (*at, lines_before + int(seq[place[a]]) - first + 1, texts[a:b], within[a] == 0), False
            n, start = int(number[-1]), int(begun[-1])
            if len(ready) >= 1024:
                yield self._batch(ready)
                ready.clear()
        if run is not None:
            close(False, ended=False)
        if ready:
            yield self._batch(ready)


def assemble_multiline(scanned: DataFrame, setting: Multiline) -> DataFrame:
    """Records that span lines: columns file, line (of the start), text, joined and overflow.

    A record starts at the first line, or at a start line that does not continue; it takes the lines that
    follow.  Every full run of ``max_lines`` that is followed by another line of the same record is rejected,
    and what is left over is the record.  Blank lines do not count.

    Two passes over the blocks: the first counts lines and finds starts without their text, the second puts records together
    where they lie.  Only the first and the last run of a block can reach into another one, and only they are exchanged.
    """
    text = F.col("text")
    solid = trim_space(text) != ""
    if setting.start_pattern:
        starts = text.rlike(java_pattern(setting.start_pattern))
    else:
        starts = trim_space(text).startswith("{")
    if setting.continue_space:
        starts = starts & ~text.rlike(r"\A[ \t]")
    flagged = scanned.select(*BLOCK, "seq", block_key().alias("key"), solid.cast("int").alias("solid"), (solid & starts).cast("int").alias("starts"), "text")
    blocks = materialize(flagged.drop("text").mapInArrow(_block_counts, _BLOCKS))
    sums = blocks.withColumns(
        {
            "lines_before": F.coalesce(F.sum("lines").over(earlier_blocks()), F.lit(0)),
            "n_before": F.coalesce(F.sum("total").over(earlier_blocks()), F.lit(0)),
        }
    )
    carry = F.coalesce(F.max(F.col("n_before") + F.col("last")).over(earlier_blocks()), F.lit(1)).alias("carry")
    carried = materialize(sums.select(*BLOCK, "first", "lines_before", "n_before", carry, "last", "first_start", "last_start"))
    lines = join_blocks(flagged, carried)
    outside = F.coalesce((F.col("seq") < F.col("first_start")) | (F.col("seq") >= F.col("last_start")), F.lit(True))
    whole = lines.mapInArrow(_Runs(setting.max_lines, False), _WHOLE)
    parts = lines.filter(outside).mapInArrow(_Runs(setting.max_lines, True), _PART)
    placed = F.sort_array(F.collect_list(F.when(F.col("line").isNotNull(), F.struct("line", "text"))))
    joined = parts.groupBy("file", "start", "chunk").agg(placed.alias("items"), F.sum("size").cast("int").alias("size"), F.max("over").alias("over"))
    met = joined.select(
        "file",
        F.col("items")[0]["line"].alias("line"),
        F.array_join(F.transform("items", lambda item: item["text"]), "\n").alias("text"),
        "size",
        "over",
    )
    rows = whole.unionByName(met)
    return rows.select("file", "line", "text", F.when(F.col("over"), 0).otherwise(F.col("size") - 1).alias("joined"), F.when(F.col("over"), TOO_LONG).alias("overflow"))


def _over_limit(text: Column, limit: int) -> Column:
    """Whether a line of the text has as many bytes as the limit or more; only long texts are taken apart."""
    if limit <= 0:
        return F.lit(False)
    return (F.octet_length(text) >= limit) & F.exists(F.split(text, "\n"), lambda line: F.octet_length(line) >= limit)


def jsonl_records(scanned: DataFrame, source: LogSource) -> DataFrame:
    """Records of lines; a line of ``source.max_line_bytes`` or more is rejected undecoded, with its text."""
    if source.multiline.enabled:
        texts = assemble_multiline(scanned, source.multiline)
    else:
        texts = number_lines(scanned).filter(trim_space(F.col("text")) != "").select(
            "file", "line", "text", F.lit(0).alias("joined"), F.lit(None).cast("string").alias("overflow")
        )
    too_long = F.when(_over_limit(F.col("text"), source.max_line_bytes), LINE_TOO_LONG)
    texts = texts.withColumn("_long", too_long).withColumn("_body", F.when(F.col("_long").isNull(), F.col("text")))
    decoded = with_record(texts, "_body")
    return decoded.select(
        "file",
        "line",
        F.make_valid_utf8(F.col("text")).alias("raw"),
        "joined",
        "record",
        F.coalesce("overflow", "_long", "error").alias("error"),
    )


def json_records(documents: DataFrame) -> DataFrame:
    """Records of whole documents given as columns file and text."""
    rows = explode_documents(documents)
    raw = F.regexp_replace("text", r"\A[ \t\r\n]++|[ \t\r\n]++\z", "").alias("raw")
    return rows.select("file", "line", raw, F.lit(0).alias("joined"), "record", "error")


def read_records(spark: SparkSession, source: LogSource) -> DataFrame:
    """Columns file, line, raw, joined, record and error of one source."""
    if source.format == "json":
        return read_documents(spark, source.path)
    scanned = scan_lines(spark, source.path)
    if source.format == "jsonl":
        return jsonl_records(scanned, source)
    headers = source.csv_columns or csv_records.read_headers(spark, source.path)
    return csv_records.records(scanned, headers, has_header=not source.csv_columns)


def line_count(spark: SparkSession, source: LogSource, records: DataFrame) -> DataFrame:
    """One row with the lines read: physical lines of JSONL, records (and header rows) of the other formats."""
    if source.format == "jsonl":
        return spark.read.option("lineSep", "\n").text(source.path).agg(F.count("*").alias("lines"))
    if source.format == "csv" and not source.csv_columns:
        files = F.count_distinct("file")
        return records.agg((F.count("*") + files).alias("lines"))
    return records.agg(F.count("*").alias("lines"))
