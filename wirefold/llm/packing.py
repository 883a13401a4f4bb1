"""Best-fit packing planned on a length histogram.

Documents longer than a sequence are cut into pieces. The pieces' lengths are counted, and best fit (longest first) runs
on the counts: open sequences with the same room form one class, and a whole class takes a length in one step. The plan
is a list of runs "ranks from..from+n of length l go to sequences s..s+n at offset o"; its size depends on the sequence
length alone. Pieces then get their rank within their length, exactly and without sorting a whole length together, and
take the slot of the run that holds their rank.

Defined results: null text is empty; an empty text is the end token alone; repeated rows are packed each; an empty table
gives no rows. Pieces of equal length and rank order are told apart by a hash; equal rows may swap slots.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirefold.llm.bpe import encode_texts
from wirefold.llm.common import bucket_ranks, documents, pick_places, vocabulary_path
from wirefold.llm.lengths import texts_by_slice
from wirefold.session import cut_lineage

SEQUENCE = 1024
END = 2
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, path: str | None = None, sequence: int = SEQUENCE, end: int = END,
           with_ids: bool = False) -> DataFrame:
    """The pieces of every document, the end token included; only the first piece of a cut document is shorter.
    `with_ids` adds the ids themselves."""
    path = vocabulary_path(path)

    def cut(batches):
        for batch in batches:
            for doc_ids, texts in texts_by_slice(batch):
                doc, piece, start, length, crc, ids = [], [], [], [], [], []
                for d, e in zip(doc_ids.to_pylist(), encode_texts(texts, path)):
                    e = np.append(e, np.uint32(end)).astype("<u4")
                    at = [0, *range(len(e) % sequence or sequence, len(e), sequence), len(e)]
                    for k, (a, b) in enumerate(zip(at, at[1:])):
                        doc.append(d)
                        piece.append(k)
                        start.append(a)
                        length.append(b - a)
                        crc.append(zlib.crc32(e[a:b].tobytes()))
                        if with_ids:
                            ids.append(e[a:b].astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                     pa.array(length, pa.int64()), pa.array(crc, pa.int64()),
                     *([pa.array(ids, pa.list_(pa.int32()))] if with_ids else [])],
                    ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])])

    return documents(docs).select("doc_id", "text").mapInArrow(cut, PIECES + (", ids array<int>" if with_ids else ""))


def plan(counts: dict[int, int], sequence: int = SEQUENCE) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, number, first sequence, offset) of best fit, longest length first.

    Sequences with the same room are kept as intervals of numbers. A step either uses up a length or a class of room, so
    the work depends on the number of distinct lengths and not on the counts.
    """
    rooms: list[int] = []  # sorted rooms that some open sequence has
    open_: dict[int, list[tuple[int, int]]] = {}  # room -> intervals (first sequence, number)
    runs, made = [], 0

    def put(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in open_:
                open_[room] = []
                insort(rooms, room)
            open_[room].append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            i = bisect_left(rooms, length)
            if i < len(rooms):
                room = rooms[i]
                first, n = open_[room].pop()
                if not open_[room]:
                    del open_[room]
                    rooms.pop(i)
                took = min(n, left)
                put(room, first + took, n - took)
                runs.append((length, rank, took, first, sequence - room))
                put(room - length, first, took)
                left, rank = left - took, rank + took
                continue
            each = sequence // length  # a new sequence is its own best fit until it has no room for this length
            full, rest = divmod(left, each)
            for n, fill in ((full, each), (1, rest)):
                if n and fill:
                    for k in range(fill):
                        runs.append((length, rank, n, made, k * length))
                        rank += n
                    put(sequence - fill * length, made, n)
                    made += n
            left = 0
    return runs


BUCKET_ROWS = 1 << 16  # pieces of one length that are ranked together, about


def pack(cut: DataFrame, sequence: int = SEQUENCE, bits: int | None = None) -> DataFrame:
    """Adds sequence_id and offset to rows with doc_id, piece, start, length and ids_crc32; further columns, such as ids,
    are carried by place. One that has the name of a column of the result, in any case, gets a `_` after it.

    Pieces of a length are ranked in 2^bits buckets; by default there are as many as the most frequent length needs.
    """
    names, columns = PIECES.replace(",", "").split()[::2], cut.columns
    places = pick_places(cut, *names)
    more = [i for i in range(len(cut.columns)) if i not in places.values()]
    flat = cut.toDF(*[f"c{i}" for i in range(len(cut.columns))])
    cut = cut_lineage(flat.select(*[F.col(f"c{i}").alias(n) for n, i in places.items()], *[F.col(f"c{i}") for i in more]))
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # at most `sequence` rows
    bits = max(6, (max(counts.values(), default=0) // BUCKET_ROWS).bit_length()) if bits is None else bits
    cut = cut.withColumn("bucket", F.shiftright(F.xxhash64("doc_id", "piece", "ids_crc32"), 64 - bits))
    runs: dict[int, list] = {}
    for length, rank, _, first, offset in plan(counts, sequence):
        runs.setdefault(length, []).append((rank, first, offset))
    planned = cut.sparkSession.createDataFrame(
        list(runs.items()), "length long, runs array<struct<rank: long, first: long, offset: long>>")
    ranked = bucket_ranks(cut, ["length"], "bucket", ["doc_id", "piece", "ids_crc32"], "rank")
    # The plan has one row per length, whatever the input, so it is broadcast.
    run = F.element_at(F.filter("runs", lambda r: r["rank"] <= F.col("rank")), -1)
    out = ranked.join(F.broadcast(planned), "length").withColumn("run", run).select(
        *names, *[f"c{i}" for i in more],
        (F.col("run.first") + F.col("rank") - F.col("run.rank")).alias("sequence_id"), F.col("run.offset").alias("offset"))
    taken, kept = {*names, "sequence_id", "offset"}, []
    for i in more:
        name = columns[i]
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        kept.append(name)
    return out.toDF(*names, *kept, "sequence_id", "offset")
