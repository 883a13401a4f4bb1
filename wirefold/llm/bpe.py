"""Byte-pair encoding and decoding through a distinct-word table.

Texts are split into words: a run of non-blank characters with the one space before it, or a run of other white space.
The tokenizer's own pattern never joins what is on both sides of such a cut, so a text's ids are its words' ids in a
row. Documents go in chunks; a chunk sends its distinct words to the word table, dealt by the words' hashes, where each
distinct word is encoded once, and keeps the position list of its documents' words. The words' ids come back to the
chunk and are joined to the positions. Only packed distinct words, their ids and positions are shuffled, never rows per
word. The documents are read twice, once for their words and once for the positions; a chunk's name holds a digest of
its texts, so an input that changes in between fails the job and cannot give wrong ids (write such an input first). Texts in which a cut could be wrong (other white space than ASCII, a special token's string) count as one word.

Decoding joins ids to the table of pieces, which is as large as the vocabulary, inside the tasks.

Defined results: null text is empty; an empty text has no ids and decodes to the empty text; unknown ids and null are
rejected by decode (null ids as a whole are none); repeated rows are kept; ids outside UTF-8 decode with U+FFFD as the tokenizer does.
"""

from __future__ import annotations

import hashlib
import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wirefold.llm import words
from wirefold.llm.common import documents, load_tokenizer, pick, vocabulary_path

CHUNK_BYTES = 8 << 20
_BLANK = 32


def _pack(a: np.ndarray, width: int | None = None) -> bytes:
    """An array as compressed byte planes, with its length before it."""
    planes = np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize).T[:width]
    raw = np.int64(len(a)).tobytes() + np.int64(planes.shape[0]).tobytes() + planes.tobytes()
    return np.int64(len(raw)).tobytes() + pa.compress(raw, codec="zstd", asbytes=True)


def _unpack(b: bytes, kind) -> np.ndarray:
    raw = pa.decompress(b[8:], decompressed_size=int(np.frombuffer(b, np.int64, 1)[0]), codec="zstd", asbytes=True)
    n, w = np.frombuffer(raw, np.int64, 2)
    out = np.zeros((n, np.dtype(kind).itemsize), np.uint8)
    out[:, :w] = np.frombuffer(raw, np.uint8, offset=16).reshape(w, n).T
    return out.view(kind).reshape(-1)


def word_starts(data: np.ndarray, offs: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Byte positions at which words start. `whole` flags values that are not cut."""
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    space = words._SPACE[data]
    after = np.append(~space[1:], False) & ~edge[1:]  # a word's character follows in the same text
    before = np.append(True, ~space[:-1]) | edge[:-1]
    before_not_blank = np.append(True, space[:-1] & (data[:-1] != _BLANK)) | edge[:-1]
    first = np.where(space, after | before, before_not_blank)
    if whole.any():
        for i in np.flatnonzero(whole):
            first[offs[i]:offs[i + 1]] = False
    starts = edge[:n]
    return np.flatnonzero(first | starts)


def uncut(data: np.ndarray, offs: np.ndarray, special: list[bytes]) -> np.ndarray:
    """Flags texts with white space outside ASCII or with the string of a special token."""
    flags = np.zeros(len(offs) - 1, bool)
    if not len(data):
        return flags
    nxt, third = np.append(data[1:], 0), np.append(data[2:], [0, 0])[:len(data)]
    hit = (data == 0xC2) & ((nxt == 0x85) | (nxt == 0xA0))
    hit |= (data == 0xE1) & (nxt == 0x9A) & (third == 0x80)
    hit |= (data == 0xE2) & (nxt == 0x80) & ((third <= 0x8A) | (third == 0xA8) | (third == 0xA9) | (third == 0xAF))
    hit |= (data == 0xE2) & (nxt == 0x81) & (third == 0x9F)
    hit |= (data == 0xE3) & (nxt == 0x80) & (third == 0x80)
    for s in special:
        at = np.flatnonzero((data == s[0]) & (nxt == s[1])) if len(s) > 1 else np.flatnonzero(data == s[0])
        raw = data.tobytes() if len(at) else b""
        at = [p for p in at.tolist() if raw.startswith(s, p)]
        hit[at] = True
    at = np.flatnonzero(hit)
    flags[np.searchsorted(offs, at, "right") - 1] = True
    return flags


def distinct_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """First place, hash, number (per place) and count of the distinct words of a chunk.

    Words of one hash are compared byte by byte with the first of them; one that differs gets an entry of its own, so
    the hash decides nothing.
    """
    h = np.zeros(len(starts), np.uint64)
    for a, b in _steps(len(starts)):
        h[a:b] = words.place_hashes(data[starts[a]:ends[b - 1]], starts[a:b] - starts[a], words.PLAIN)
    named, first, at = np.unique(h, return_index=True, return_inverse=True)
    size, odd = ends - starts, []
    for a, b in _steps(len(starts)):
        mine = np.arange(a, b)
        rep = first[at[a:b]]
        short = size[rep] != size[mine]
        odd += mine[short].tolist()
        mine, rep = mine[~short & (rep != mine)], rep[~short & (rep != mine)]
        if len(mine):
            n = size[mine]
            other = data[words.spread(starts[mine], n)] != data[words.spread(starts[rep], n)]
            odd += mine[np.logical_or.reduceat(other, np.cumsum(n) - n)].tolist()
    own: dict[bytes, int] = {}
    more = []
    for i in sorted(odd):
        word = data[starts[i]:ends[i]].tobytes()
        if word not in own:
            own[word] = len(named) + len(own)
            more.append(i)
        at[i] = own[word]
    first = np.append(first, np.array(more, np.int64)).astype(np.int64)
    return first, h[first], at, np.bincount(at, minlength=len(first))


def _steps(n: int, step: int = 1 << 15):
    return [(a, min(a + step, n)) for a in range(0, n, step)]


def _chunk_rows(name: str, doc_ids: pa.Array, texts: pa.Array, buckets: int, special: list[bytes],
                layout: bool) -> dict:
    """The rows of one chunk: the word positions of its documents, or its distinct words by bucket."""
    data, offs = words.utf8(texts)
    key = f"{name}:{hashlib.blake2b(data, digest_size=16).hexdigest()}:{len(texts)}"
    starts = word_starts(data, offs, uncut(data, offs, special))
    ends = np.append(starts[1:], len(data))
    first, distinct, at, count = distinct_words(data, starts, ends)
    bucket = (distinct % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    if layout:
        # Positions hold ranks by frequency, the first 255 in one byte; the words go by bucket, `turn` leads from one
        # to the other.
        rank = np.empty(len(distinct), np.uint32)
        rank[np.argsort(-count, kind="stable")] = np.arange(len(distinct), dtype=np.uint32)
        turn = np.empty(len(distinct), np.uint32)
        turn[rank[order]] = np.arange(len(distinct), dtype=np.uint32)
        at = rank[at]
        ids = np.array([-1 if x is None else x for x in doc_ids.to_pylist()], np.int64)
        null = np.array([x is None for x in doc_ids.to_pylist()], np.uint8)
        return {"target": [key], "chunk": [key], "bucket": [-1], "n": [len(texts)], "words": [_pack_all(
            ids, null, np.searchsorted(starts, offs).astype(np.int64), np.minimum(at, 255).astype(np.uint8),
            at[at >= 255] - np.uint32(255), turn)]}
    edge = np.searchsorted(bucket[order], np.arange(buckets + 1))
    rows: dict[str, list] = {"target": [], "chunk": [], "bucket": [], "n": [], "words": []}
    for b in range(buckets):
        chosen = order[edge[b]:edge[b + 1]]
        if len(chosen):
            size = (ends - starts)[first[chosen]].astype(np.uint32)
            packed = _pack_all(size, data[words.spread(starts[first[chosen]], size)])
            for c, v in zip(rows, (f"b{b}", key, b, len(chosen), packed)):
                rows[c].append(v)
    return rows


def _pack_all(*arrays: np.ndarray) -> bytes:
    parts = [_pack(a) for a in arrays]
    return np.array([len(parts), *map(len, parts)], np.int64).tobytes() + b"".join(parts)


def _unpack_all(b: bytes, *kinds) -> list[np.ndarray]:
    n = int(np.frombuffer(b, np.int64, 1)[0])
    cut = np.cumsum(np.append(8 * (n + 1), np.frombuffer(b, np.int64, n, 8)))
    return [_unpack(b[cut[i]:cut[i + 1]], k) for i, k in enumerate(kinds)]


def _join_words(key: str, layout: bytes, found: list[tuple[int, bytes]]) -> pa.Table:
    """Documents of a chunk with their ids: positions joined to the ids of the chunk's words."""
    ids, null, n_words, short, more, turn = _unpack_all(layout, np.int64, np.uint8, np.int64, np.uint8, np.uint32,
                                                        np.uint32)
    rank = short.astype(np.uint32)
    rank[short == 255] += more
    got = [_unpack_all(b, np.uint32, np.uint32) for _, b in sorted(found)]
    size = np.concatenate([g[0] for g in got] or [np.zeros(0, np.uint32)]).astype(np.int64)
    flat = np.concatenate([g[1] for g in got] or [np.zeros(0, np.uint32)]).astype(np.int32)
    if len(size) != len(turn):
        raise RuntimeError(f"chunk {key}: {len(size)} of {len(turn)} words came back; the documents changed between two "
                           "readings, write them to a table first")
    first = np.append(0, np.cumsum(size))
    word = turn[rank]
    step, out, ends = 1 << 18, [], [np.zeros(1, np.int64)]
    for a in range(0, len(word), step):  # a slice of positions at a time
        w = word[a:a + step]
        n = size[w]
        out.append(flat[words.spread(first[w], n)])
        ends.append(np.cumsum(n) + ends[-1][-1])
    offs = np.concatenate(ends)[n_words]
    values = pa.array(np.concatenate(out) if out else np.zeros(0, np.int32))
    return pa.table({"doc_id": pa.array(ids, mask=null.astype(bool)),
                     "ids": pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), values)})


def encode(docs: DataFrame, path: str | None = None, buckets: int | None = None,
           chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id and ids (array<int>) of every text, as the tokenizer file gives them without added special tokens.

    `buckets` deals the word table (default: the session's shuffle partitions); `chunk_bytes` bounds the text that a task
    joins at once (a longer text is a chunk of its own). Ids must stay below 2^31; a word may have any number of them.
    """
    path = vocabulary_path(path)
    spark = docs.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def split(batches, layout):
        from pyspark import TaskContext

        special = special_strings(path)
        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            offs = np.cumsum(np.append(0, pa.compute.fill_null(pa.compute.binary_length(batch["text"]), 0)))
            a = 0
            while a < len(batch):
                b = max(a + 1, int(np.searchsorted(offs, offs[a] + chunk_bytes, "right")) - 1)
                rows = _chunk_rows(f"c{part}:{n}", batch["doc_id"][a:b], batch["text"][a:b], buckets, special, layout)
                yield pa.RecordBatch.from_pydict(rows, schema=_ROWS)
                a, n = b, n + 1

    def encode_words(key, group):
        known: dict[bytes, np.ndarray] = {}
        out = []
        for packed in group["words"].to_pylist():
            size, data = _unpack_all(packed, np.uint32, np.uint8)
            raw, end = data.tobytes(), np.cumsum(size.astype(np.int64)).tolist()
            mine = [raw[a:b] for a, b in zip([0, *end], end)]
            new = [w for w in dict.fromkeys(mine) if w not in known]
            known.update(zip(new, encode_texts([w.decode() for w in new], path)))
            got = [known[w] for w in mine]
            n = np.fromiter(map(len, got), np.int64, len(got))
            out.append(_pack_all(n.astype(np.uint32), np.concatenate(got) if got else np.zeros(0, np.uint32)))
        return pa.table({"chunk": group["chunk"], "bucket": group["bucket"], "n": group["n"], "words": pa.array(
            out, pa.binary())})

    def join(key, found, layouts):
        if len(layouts) != 1:
            raise RuntimeError(f"chunk {key[0]}: the documents changed between two readings, write them to a table first")
        return _join_words(key[0].as_py(), layouts["words"][0].as_py(), list(zip(
            found["bucket"].to_pylist(), found["words"].to_pylist())))

    rows = "target string, chunk string, bucket int, n int, words binary"
    both = documents(docs).select("doc_id", "text")
    coded = both.mapInArrow(lambda batches: split(batches, False), rows).groupBy("target").applyInArrow(
        encode_words, "chunk string, bucket int, n int, words binary")
    layouts = both.mapInArrow(lambda batches: split(batches, True), rows).drop("target")
    return coded.groupBy("chunk").cogroup(layouts.groupBy("chunk")).applyInArrow(join, "doc_id long, ids array<int>")


_ROWS = pa.schema([("target", pa.string()), ("chunk", pa.string()), ("bucket", pa.int32()), ("n", pa.int32()),
                   ("words", pa.binary())])


@lru_cache(maxsize=4)
def special_strings(path: str) -> list[bytes]:
    with open(path, encoding="utf-8") as f:
        return [t["content"].encode() for t in json.load(f)["added_tokens"]]


@lru_cache(maxsize=4)
def piece_table(path: str) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all pieces in order of id, and where each starts; a missing id has no bytes."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    shown = byte_letters()
    pieces = {i: bytes(shown[c] for c in p) for p, i in spec["model"]["vocab"].items() if all(c in shown for c in p)}
    pieces |= {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
    rows = [pieces.get(i, b"") for i in range(max(pieces) + 1)]
    return np.frombuffer(b"".join(rows), np.uint8), np.cumsum([0, *map(len, rows)])


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write for bytes: printable Latin-1 stands for itself, the others take
    the code points from 256 on in order of byte."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=4)
def rank_encoder(path: str):
    """The vocabulary file as a rank encoder, which gives the same ids several times faster."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec["pre_tokenizer"]
    if spec["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get(
            "use_regex", True) or spec.get("post_processor"):
        return None
    import public_tokenizers

    shown, special = byte_letters(), {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(shown[c] for c in p): i for p, i in spec["model"]["vocab"].items() if p not in special}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


def encode_texts(texts: list[str], path: str) -> list[np.ndarray]:
    """Ids of each text as unsigned 32-bit numbers."""
    ranks = rank_encoder(path)
    if ranks is None:
        return [np.array(e.ids, np.uint32) for e in load_tokenizer(path).encode_batch(texts, add_special_tokens=False)]
    return [ranks.encode_to_numpy(t, allowed_special="all") for t in texts]


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text of rows with doc_id and ids: ids joined to the table of pieces, bytes read as UTF-8."""
    path = vocabulary_path(path)

    def join(batches):
        data, where = piece_table(path)
        size = np.diff(where)
        for batch in batches:
            ids = batch["ids"]
            offs = np.append(ids.offsets.to_numpy(), 0)[:len(ids) + 1]
            flat = ids.values.to_numpy(zero_copy_only=False)
            if len(flat) and (flat.min() < 0 or flat.max() >= len(size)):
                raise ValueError("an id is not in the vocabulary")
            for a, b in slices(offs, 1 << 20):
                got = flat[offs[a]:offs[b]]
                n = size[got]
                ends = np.append(0, np.cumsum(n))
                raw = data[words.spread(where[got], n)].tobytes()
                at = ends[offs[a:b + 1] - offs[a]].tolist()
                yield pa.RecordBatch.from_arrays([batch["doc_id"][a:b], pa.array(
                    [raw[x:y].decode("utf-8", "replace") for x, y in zip(at, at[1:])], pa.string())],
                    ["doc_id", "text"])

    got = pick(encoded, doc_id="doc_id", ids="ids").select("doc_id", F.coalesce(
        "ids", F.array().cast("array<int>")).alias("ids"))
    # doc_id passes through as it is, whatever its type
    schema = T.StructType([got.schema["doc_id"], T.StructField("text", T.StringType())])
    return got.mapInArrow(join, schema)


def slices(offs: np.ndarray, most: int):
    """Ranges of rows of at most `most` values together, or one row."""
    a = 0
    while a < len(offs) - 1:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + most, "right")) - 1)
        yield a, b
        a = b
