"""Records of JSON documents (an object, or an array of objects and nulls) of any size, read by many tasks.

A document is scanned as pieces that end with ``}``, whatever its line breaks.  What a piece does depends on two things at its
start: whether it lies inside a string, and how deep.  Unescaped quotes swap the first, brackets outside of strings add to the
second, so a block of pieces is a pair of sums for either state it is entered in, and all entry states follow from one value
per block.  With them every task cuts the records out of its blocks; only records that stick out of a block are exchanged.

Cutting follows the brackets alone.  Each cut is then held against the grammar: what stands before the object (commas, nulls,
the opening bracket), the object itself, and what stands behind the last one.  The cuts cover the document without a gap, so a
document passes exactly if it is valid; any other stops the job.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from timberflow.session import materialize
from timberflow.sources.json_records import with_record
from timberflow.sources.lines import BLOCK, block_key, earlier_blocks, join_blocks, runs_of_blocks

_ESCAPED = re.compile(r"\\.", re.DOTALL)
_STRUCTURE = re.compile(r"[{\[\],]")
_FIRST = re.compile(r"[^ \t\r\n]")

_SUMS = (
    "file string, block bigint, pieces bigint, bytes bigint, size bigint, head string, swaps int, "
    "depth0 bigint, depth1 bigint, commas0 map<bigint,bigint>, commas1 map<bigint,bigint>, ends0 map<bigint,bigint>, ends1 map<bigint,bigint>"
)
_CUTS = "file string, cut bigint, block bigint, text string, commas bigint, opens boolean, closes boolean"

_WS = r"[ \t\r\n]*+"
_NULLS = rf"(?:null{_WS},{_WS})*+"
#: What may stand before the first object, before a later one, behind the last one, and in a document without any.
_BEFORE_FIRST = {"[": rf"\A{_WS}\[{_WS}{_NULLS}\z", "{": rf"\A{_WS}\z"}
_BEFORE_LATER = rf"\A{_WS},{_WS}{_NULLS}\z"
_BEHIND = {"[": rf"\A{_WS}(?:,{_WS}null{_WS})*+\]{_WS}\z", "{": rf"\A{_WS}\z"}
_ALONE = rf"\A{_WS}(?:null|\[{_WS}(?:null{_WS}(?:,{_WS}null{_WS})*+)?\]){_WS}\z"
_MESSAGE = "JSON document is not an object or an array of objects: "


def _scan(text: str, inside: bool) -> tuple[bool, list[str]]:
    """Whether the piece ends inside a string, and its brackets and commas outside of strings."""
    parts = _ESCAPED.sub("", text).split('"')
    outside = parts[1::2] if inside else parts[0::2]
    return inside ^ bool((len(parts) - 1) & 1), _STRUCTURE.findall("".join(outside))


def _walk(marks: list[str], depth: int, commas: Counter) -> int:
    for mark in marks:
        if mark == ",":
            commas[depth] += 1
        else:
            depth += -1 if mark == "]" else 1
    return depth


def _block_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per block with what its pieces add up to, for a start outside (0) and inside (1) of a string."""
    rows: list[dict] = []
    for begins, part in runs_of_blocks(batches):
        if begins:
            rows.append({"file": part.column("file")[0].as_py(), "block": part.column("block")[0].as_py(), "size": part.column("size")[0].as_py(), "pieces": 0, "bytes": 0, "head": None})
            states = [[False, 0, Counter(), Counter()], [True, 0, Counter(), Counter()]]
            rows[-1]["states"] = states
        row = rows[-1]
        row["pieces"] += part.num_rows
        row["bytes"] += sum(part.column("bytes").to_pylist()) + part.num_rows
        for text in part.column("text").to_pylist():
            if row["head"] is None and (found := _FIRST.search(text + "}")):
                row["head"] = found[0]
            for state in states:
                state[0], marks = _scan(text, state[0])
                state[1] = _walk(marks, state[1], state[2])
                if not state[0]:
                    state[1] -= 1
                    state[3][state[1]] += 1
    out = []
    for row in rows:
        (swapped, depth0, commas0, ends0), (_, depth1, commas1, ends1) = row.pop("states")
        maps = {"commas0": commas0, "commas1": commas1, "ends0": ends0, "ends1": ends1}
        out.append(row | {"swaps": int(swapped), "depth0": depth0, "depth1": depth1} | {k: list(v.items()) for k, v in maps.items()})
    kinds = {"file": pa.string(), "head": pa.string(), "swaps": pa.int32()}
    names = [part.split()[0] for part in _SUMS.split(", ")]
    kind = lambda name: pa.map_(pa.int64(), pa.int64()) if name[:-1] in ("commas", "ends") else kinds.get(name, pa.int64())
    yield pa.RecordBatch.from_arrays([pa.array([row[n] for row in out], kind(n)) for n in names], names=names)


def _entries(sums: DataFrame) -> DataFrame:
    """Per block: the state it is entered in, depth-1 commas and records ended before it, the document's kind, and its end."""
    earlier, whole = earlier_blocks(), earlier_blocks().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = lambda value: F.coalesce(F.sum(value).over(earlier), F.lit(0))
    rows = sums.withColumn("inside", (before("swaps") % 2).cast("int"))
    pick = lambda name: F.when(F.col("inside") == 0, F.col(f"{name}0")).otherwise(F.col(f"{name}1"))
    rows = rows.withColumn("depth", before(pick("depth")))
    rows = rows.withColumn("head", F.first("head", ignorenulls=True).over(whole))
    rows = rows.withColumn("base", F.when(F.col("head") == "[", 1).otherwise(0).cast("bigint"))
    at = lambda name, depth: F.coalesce(F.try_element_at(pick(name), depth - F.col("depth")), F.lit(0))
    rows = rows.withColumns({"_commas": at("commas", F.lit(1)), "_ends": at("ends", F.col("base"))})
    rows = rows.withColumns({"commas": before("_commas"), "cut": before("_ends"), "_bytes": F.sum("bytes").over(whole), "_last": F.max("block").over(whole)})
    # Every piece but one that the file ends without a bracket counts a byte more than its text.
    ends = F.when(F.col("block") == F.col("_last"), F.when(F.col("_bytes") == F.col("size"), "closed").otherwise("open"))
    return rows.select(*BLOCK, "inside", "depth", "base", "head", "commas", "cut", "pieces", ends.alias("ends"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cuts, or the parts of cuts, that lie in each block: text up to the end of a record, or behind the last one."""
    ready: list[tuple] = []
    held, file = None, None

    def flush() -> pa.RecordBatch:
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.bool_()]
        names = [part.split()[0] for part in _CUTS.split(", ")]
        batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*ready), kinds)], names=names)
        ready.clear()
        return batch

    def leave() -> None:
        if file is not None and (held or ends is not None):
            ready.append((file, cut, block, "".join(held), started, opens, ends is not None))

    for begins, part in runs_of_blocks(batches):
        if begins:
            leave()
            names = ("file", "block", "inside", "depth", "base", "commas", "cut", "pieces", "ends")
            file, block, inside, depth, base, commas, cut, left, ends = (part.column(name)[0].as_py() for name in names)
            inside, held, started, opens = bool(inside), [], commas, block == 0
        for text in part.column("text").to_pylist():
            left -= 1
            found: Counter = Counter()
            inside, marks = _scan(text, inside)
            depth = _walk(marks, depth, found)
            commas += found[1]
            held.append(text)
            if left == 0 and ends == "open":
                break
            held.append("}")
            if not inside:
                depth -= 1
                if depth == base:
                    ready.append((file, cut, block, "".join(held), started, opens, True))
                    cut, held, started, opens = cut + 1, [], commas, True
            if len(ready) >= 512:
                yield flush()
    leave()
    if ready:
        yield flush()


def scan_pieces(spark: SparkSession, path: str) -> DataFrame:
    """Pieces of all files, each without the bracket that ends it."""
    rows = spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_size").alias("size"), "value"
    )
    return rows.select(*BLOCK, "size", block_key().alias("key"), F.octet_length("value").alias("bytes"), F.make_valid_utf8("value").alias("text"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Columns file, line (place in the document), raw (the record's own text), joined, record and error."""
    pieces = scan_pieces(spark, path)
    blocks = materialize(_entries(materialize(pieces.mapInArrow(_block_sums, _SUMS))))
    cuts = materialize(join_blocks(pieces, blocks).mapInArrow(_cut, _CUTS))
    within = F.col("opens") & F.col("closes")
    ordered = F.sort_array(F.collect_list(F.struct("block", "text")))
    joined = cuts.filter(~within).groupBy("file", "cut").agg(
        F.array_join(F.transform(ordered, lambda part: part["text"]), "").alias("text"), F.min_by("commas", "block").alias("commas")
    )
    whole = cuts.filter(within).select("file", "cut", "text", "commas").unionByName(joined)
    rows = whole.join(blocks.groupBy("file").agg(F.first("head").alias("head")), "file")
    has_object = F.contains("text", F.lit("{"))
    lead = F.substring_index("text", "{", 1)
    array = F.col("head") == "["
    later = array & lead.rlike(_BEFORE_LATER)
    before = F.when(F.col("cut") > 0, later).when(array, lead.rlike(_BEFORE_FIRST["["])).otherwise(lead.rlike(_BEFORE_FIRST["{"]))
    text = F.col("text")
    behind = F.when(F.col("cut") == 0, text.rlike(_ALONE)).when(array, text.rlike(_BEHIND["["])).otherwise(text.rlike(_BEHIND["{"]))
    # What stands between the objects is checked at once, over all documents; a filter further on must not pass over it.
    wrong = rows.filter(~F.coalesce(F.when(has_object, before).otherwise(behind), F.lit(False))).select("file").head()
    if wrong is not None:
        raise ValueError(_MESSAGE + wrong["file"])

    leading = F.length("lead") - F.length(F.replace("lead", F.lit(",")))
    body = F.expr("substring(text, length(lead) + 1)")
    objects = rows.filter(has_object).withColumn("lead", lead)
    decoded = with_record(objects.select("file", "cut", "commas", "lead", (F.col("commas") + leading + 1).alias("line"), body.alias("raw")), "raw")
    fails = F.raise_error(F.concat(F.lit(_MESSAGE), F.col("file"))).cast("boolean")
    decoded = decoded.filter(F.when(F.col("error").isNull(), True).otherwise(fails))

    # Nulls stand before an object or behind the last one, and count as records without fields.
    def nulls(df: DataFrame, text: str, from_: str) -> DataFrame:
        count = F.floor((F.length(text) - F.length(F.replace(text, F.lit("null")))) / 4)
        some = df.filter(F.contains(text, F.lit("null")))
        return some.select("file", F.explode(F.sequence(F.col(from_) + 1, F.col(from_) + count)).alias("line"))

    since = F.col("commas") + F.when(F.col("cut") > 0, 1).otherwise(0)
    between = nulls(objects.withColumn("_from", since), "lead", "_from")
    last = nulls(rows.filter(~has_object).withColumn("_from", since), "text", "_from")
    empty = between.unionByName(last).select(
        "file", "line", F.lit("null").alias("raw"), F.create_map().cast("map<string,struct<kind:string,text:string>>").alias("record")
    )
    found = decoded.select("file", "line", "raw", "record").unionByName(empty)
    return found.select("file", "line", "raw", F.lit(0).alias("joined"), "record", F.lit(None).cast("string").alias("error"))
