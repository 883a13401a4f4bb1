"""Text files as lines and as CSV records, in one splittable scan for all files.

A line scan gives each line with its file. What must be known about a file before its lines can be read - its encoding,
its header, whether a quoted field runs over a line end - is one aggregate over the same lines, one row per file. Files
without quoted breaks, all but a few as a rule, are then parsed line by line wherever their splits begin. For the others
a split may begin inside a quoted field. Their lines are stored once with their place; every block of them is a map from
"outside a quoted field" and "inside" at its left edge to the same at its right edge; the maps are composed in file order,
one per block; then each block reads its records, and the parts of a record that runs over block edges come together.
"""

from __future__ import annotations

import csv
import sys
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wirefold.session import scratch_path

QUOTE, COMMA, BOM = b'"', b",", b"\xef\xbb\xbf"


def lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """file, block (first byte of the split) and line, as bytes without the line feed."""
    return spark.read.option("lineSep", "\n").text(paths).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.col("value").cast("binary").alias("line"))


def stored_lines(spark: SparkSession, paths: list[str], only: list[str]) -> DataFrame:
    """Lines of the files `only` with `place`, their order within a block, written once: later reads need not split the
    files alike."""
    path = scratch_path(spark, "lines")
    some = lines(spark, paths).where(F.col("file").isin(only))
    some.withColumn("place", F.monotonically_increasing_id()).write.parquet(path)
    return spark.read.parquet(path)


def by_block(stored: DataFrame) -> DataFrame:
    """Stored lines with each block of a file in one task, in order."""
    return stored.repartition("file", "block").sortWithinPartitions("file", "block", "place")


def blocks(batches: Iterator[pa.RecordBatch]):
    """(file, block, whether it begins here, part of a batch) of sorted lines."""
    at = None
    for batch in batches:
        n = len(batch)
        if not n:
            continue
        file, block = batch["file"].dictionary_encode(), batch["block"].to_numpy()
        code = file.indices.to_numpy()
        cuts = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (block[1:] != block[:-1])])
        for a, b in zip(cuts, np.r_[cuts[1:], n]):
            key = (file.dictionary[int(code[a])].as_py(), int(block[a]))
            yield *key, key != at, batch.slice(int(a), int(b - a))
            at = key


# --- quotes ---------------------------------------------------------------------------------------------------------

def inside_after(line: bytes, inside: bool) -> bool:
    """Whether a quoted field is open at the end of the line. A quote opens a field only at its beginning; a doubled
    quote inside a quoted field is text."""
    i = 0
    while True:
        if inside:
            i = line.find(QUOTE, i)
            if i < 0:
                return True
            if line[i + 1:i + 2] == QUOTE:
                i += 2
                continue
            inside = False
        elif line[i:i + 1] == QUOTE:
            inside, i = True, i + 1
            continue
        i = line.find(COMMA, i)
        if i < 0:
            return False
        i += 1


def split_returns(line: bytes) -> list[bytes]:
    """The line without the carriage return of its line end; a lone one elsewhere outside quotes ends a line too."""
    line = line[:-1] if line.endswith(b"\r") else line
    return line.split(b"\r") if b"\r" in line and QUOTE not in line else [line]


class Records:
    """Puts lines together to records."""

    def __init__(self, inside: bool = False):
        self.inside, self.held = inside, []

    def add(self, line: bytes) -> list[bytes]:
        """The records that end with this line."""
        if not self.inside and QUOTE not in line:
            return split_returns(line)
        self.inside = inside_after(line, self.inside)
        self.held.append(line)
        if self.inside:
            return []
        out, self.held = [b"\n".join(self.held)], []
        return [out[0][:-1] if out[0].endswith(b"\r") else out[0]]


def fields(record: str) -> list[str]:
    csv.field_size_limit(sys.maxsize)
    return next(csv.reader([record]), [])


def utf8(line: bytes) -> bool:
    try:
        line.decode()
        return True
    except UnicodeDecodeError:
        return False


# --- what must be known of a file -----------------------------------------------------------------------------------

@dataclass
class FileFacts:
    """What must be known of a file: `head_block` has its header, `breaks` says that quoted fields run over line ends."""

    encoding: str
    columns: list[str]
    head_block: int
    breaks: bool


def column_names(header: list[str]) -> list[str]:
    """Trimmed names; a name that comes again gets its number."""
    out: list[str] = []
    for name in (c.strip() for c in header):
        k, new = 0, name
        while new in out:
            k += 1
            new = f"{name}.{k}"
        out.append(new)
    return out


def csv_facts(spark: SparkSession, paths: list[str]) -> dict[str, FileFacts]:
    """Facts of all files from one job. One row per file comes back; the header is the first line that is not blank."""
    def look(batches):
        rows: dict[str, list] = {}
        for file, block, _, part in blocks(batches):
            row = rows.setdefault(file, [True, False, None, None])
            data = np.frombuffer(part["line"].buffers()[2] or b"", np.uint8)
            plain = not (data >= 128).any() and not (data == QUOTE[0]).any()
            for line in part["line"].to_pylist() if not plain or row[2] is None or block < row[2] else []:
                row[0] = row[0] and (line.isascii() or utf8(line))
                row[1] = row[1] or inside_after(line, False)
                if (row[2] is None or block < row[2]) and line.strip():
                    row[2:] = block, line
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(rows)), *[pa.array([r[i] for r in rows.values()], t) for i, t in enumerate(
                    (pa.bool_(), pa.bool_(), pa.int64(), pa.binary()))]], ["file", "utf8", "breaks", "at", "head"])

    got = lines(spark, paths).mapInArrow(look, "file string, utf8 boolean, breaks boolean, at long, head binary")
    got = got.groupBy("file").agg(F.bool_and("utf8").alias("utf8"), F.bool_or("breaks").alias("breaks"),
                                  F.min_by("head", "at").alias("head"), F.min("at").alias("at"))
    out = {}
    for r in got.collect():
        encoding, head = "utf-8" if r["utf8"] else "latin-1", bytes(r["head"] or b"")
        if inside_after(head, False):
            raise ValueError(f"the header of {r['file']} has a line end inside quotes")
        names = fields(split_returns(head.removeprefix(BOM))[0].decode(encoding))
        out[r["file"]] = FileFacts(encoding, column_names(names), r["at"] or 0, bool(r["breaks"]))
    return out


# --- records --------------------------------------------------------------------------------------------------------

def plain_records(found: DataFrame, heads: dict[str, int]) -> DataFrame:
    """file, block, place and record (bytes), without headers, from the lines of the files of `heads` (with the block that
    has the header), in which a record is a line. Lines of other files go."""
    shared = found.sparkSession.sparkContext.broadcast(heads)

    def read(batches):
        n, header = 0, False
        for file, block, begins, part in blocks(batches):
            if file not in shared.value:
                continue
            if begins:
                n, header = 0, block == shared.value[file]
            out = [r for line in part["line"].to_pylist() for r in split_returns(line)]
            places = np.arange(n, n + len(out))
            n += len(out)
            if header and any(r.strip() for r in out):
                first = next(i for i, r in enumerate(out) if r.strip()) + 1
                out, places, header = out[first:], places[first:], False
            yield pa.RecordBatch.from_arrays(
                [pa.array([file] * len(out), pa.string()), pa.array([block] * len(out), pa.int64()), pa.array(places),
                 pa.array(out, pa.binary())], ["file", "block", "place", "record"])

    return found.mapInArrow(read, "file string, block long, place long, record binary")


# --- records of files with quoted breaks ----------------------------------------------------------------------------

def broken_records(spark: SparkSession, paths: list[str], heads: dict[str, int]) -> DataFrame:
    """file, block, place and record (bytes), without headers, of the files of `heads` (with the block that has the
    header), in which quoted fields run over line ends."""
    stored = stored_lines(spark, paths, list(heads))

    def edges(batches):
        rows: list[list] = []
        for file, block, begins, part in blocks(batches):
            if begins:
                rows.append([file, block, False, True, False])
            row = rows[-1]
            for line in part["line"].to_pylist():
                if QUOTE in line:
                    row[2], row[3] = inside_after(line, row[2]), inside_after(line, row[3])
                    row[4] = row[4] or not row[3]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*rows)],
                                             ["file", "block", "from_out", "from_in", "closes"])

    found = by_block(stored).mapInArrow(edges, "file string, block long, from_out boolean, from_in boolean, closes boolean")
    shared = spark.sparkContext.broadcast(owners(sorted(tuple(r) for r in found.collect())))

    def read(batches):
        rec, key, begun, first, header = None, None, None, 0, False
        rows: list[tuple] = []

        def left():
            return [(key[0], begun, key[1], first, b"\n".join(rec.held), True)] if rec is not None and rec.held else []

        for file, block, begins, part in blocks(batches):
            if begins:
                rows += left()
                key, begun, header = (file, block), shared.value.get((file, block)), block == heads[file]
                rec, first = Records(begun is not None), 0
                begun = block if begun is None else begun
            for place, line in zip(part["place"].to_pylist(), part["line"].to_pylist()):
                if not rec.held:
                    first = place
                done = rec.add(line)
                if done and begun != block:  # the end of a record that began in an earlier block
                    rows.append((file, begun, block, first, done[0], True))
                    begun, done = block, done[1:]
                if header and any(d.strip() for d in done):
                    done = done[next(i for i, d in enumerate(done) if d.strip()) + 1:]
                    header = False
                rows += [(file, block, block, first, d, False) for d in done]
            yield _record_batch(rows)
            rows = []
        yield _record_batch(left())

    rows = by_block(stored).mapInArrow(read, _RECORD)
    path = scratch_path(spark, "records")
    rows.write.parquet(path)
    rows = spark.read.parquet(path)
    whole = rows.where("not part").select("file", "block", "place", "record")

    def glue(key, table):
        table = table.sort_by([("piece", "ascending")])
        place = table["place"][0].as_py()
        return pa.table({"file": [key[0].as_py()], "block": [key[1].as_py()], "place": [place],
                         "record": [b"\n".join(table["record"].to_pylist())]})

    parts = rows.where("part").groupBy("file", "block").applyInArrow(
        glue, "file string, block long, place long, record binary")
    return whole.unionByName(parts)


def owners(edges: list[tuple]) -> dict[tuple[str, int], int]:
    """Per block that begins inside a quoted field: the block in which that record begins. `edges` are (file, block,
    state at the end if it begins outside, if it begins inside, whether a record that is open at its left edge ends in
    it), one per block as tasks are, in order."""
    out, inside, begun, at = {}, False, 0, None
    for file, block, from_out, from_in, closes in [*edges, (None, 0, False, False, False)]:
        if file != at:
            if inside:
                raise ValueError(f"a quote is still open at the end of {at}")
            at = file
        if inside:
            out[file, block] = begun
        if not inside or closes:
            begun = block
        inside = from_in if inside else from_out
    return out


_RECORD = "file string, block long, piece long, place long, record binary, part boolean"


def _record_batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [[]] * 6
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds)],
                                      ["file", "block", "piece", "place", "record", "part"])


# --- lines under headers --------------------------------------------------------------------------------------------

def headed_lines(spark: SparkSession, paths: str | list[str], mark: str) -> tuple[DataFrame, DataFrame, set[str]]:
    """line and head (the number of the header that rules it), head and names of every different header, and all names
    that occur. A header is a line that begins with `mark`.

    One job finds each file's headers. A file with one header needs no order: its lines join by file. A file with
    several is stored with its lines' places, and each block takes over the last header of the blocks before it.
    """
    files = [paths] if isinstance(paths, str) else list(paths)
    text = spark.read.text(files).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"))
    is_head = F.col("line").startswith(mark)
    per_file = text.groupBy("file").agg(F.min(F.when(is_head, F.col("line"))).alias("a"),
                                        F.max(F.when(is_head, F.col("line"))).alias("b")).collect()
    without = [r["file"] for r in per_file if r["a"] is None]
    if without or not per_file:
        raise ValueError(f"no {mark} line in {without[:3] or files}")
    many = [r["file"] for r in per_file if r["a"] != r["b"]]
    heads = {h: i for i, h in enumerate(sorted({r["a"] for r in per_file}))}
    of_file = spark.createDataFrame([(r["file"], heads[r["a"]]) for r in per_file if r["a"] == r["b"]],
                                    "file string, head int")
    out = text.join(of_file, "file").select("line", "head")
    if many:
        stored = stored_lines(spark, files, many).withColumn("line", F.col("line").cast("string"))
        marks = stored.where(is_head).select("file", "block", "place", F.rtrim(F.regexp_replace("line", "\r$", "")).alias(
            "line")).orderBy("file", "block", "place").collect()
        for r in marks:
            heads.setdefault(r["line"], len(heads))
        out = out.unionByName(_ruled(stored, [(r["file"], r["block"], r["place"], heads[r["line"]]) for r in marks]))
    names = {h: h.split()[1:] for h in heads}
    return (out, spark.createDataFrame([(heads[h], n) for h, n in names.items()], "head int, names array<string>"),
            {x for n in names.values() for x in n})


def _ruled(stored: DataFrame, marks: list[tuple]) -> DataFrame:
    """line and head of stored lines, the head being the last mark (file, block, place, head) at or before the line."""
    of_file: dict[str, list[tuple]] = {}
    for file, block, place, head in marks:
        of_file.setdefault(file, []).append((block, place, head))
    shared = stored.sparkSession.sparkContext.broadcast(of_file)  # header lines only

    def rule(batches):
        for batch in batches:
            out = []
            for file, block, place in zip(*[batch[c].to_pylist() for c in ("file", "block", "place")]):
                marks_here = shared.value[file]
                i = bisect_right(marks_here, (block, place, len(marks_here) + (1 << 30)))
                out.append(marks_here[i - 1][2] if i else None)
            yield pa.RecordBatch.from_arrays([batch["line"], pa.array(out, pa.int32())], ["line", "head"])

    found = stored.mapInArrow(rule, "line string, head int")
    return found.withColumn("line", F.regexp_replace("line", "\r$", ""))
