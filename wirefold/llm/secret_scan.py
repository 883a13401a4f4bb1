"""Secret scans: fixed patterns, and a token-efficiency test for random strings.

Three patterns are always reported: assignments to a secret-like name, access keys and long hexadecimal strings. On top
of these, runs of key-like characters are taken apart by a public vocabulary: written language needs one token for four
or more characters, random strings one for less than `ratio`. Only fixed forms are left out first: plain digests and
numbers (hexadecimal of a usual digest length, decimal groups), UUIDs, and runs of one repeated pattern; identifiers built
from words score above the ratio. A run that does is also tested between its separators. Spans carry code point offsets, end exclusive.

Defined results: null text is empty; empty text has no span; equal rows give equal spans; texts of any length are scanned
whole.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirefold.llm.bpe import encode_texts
from wirefold.llm.common import documents, pick_places, vocabulary_path
from wirefold.llm.lengths import SLICE_BYTES, slices, texts_by_slice
from wirefold.llm.words import utf8

# Fixed patterns of the base scan.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # AKIA[A-Z0-9]+ of 20 or more: a run that is too short holds no longer one
HEX = re.compile(r"[0-9a-f]{24,}")  # likewise for [0-9a-f]+
KINDS = ("assign", "access", "hex", "random")

LEAST = 16
RUN = re.compile(rf"[A-Za-z0-9+/_=-]{{{LEAST},}}", re.ASCII)
SEPARATOR = re.compile(r"[/=_-]")
PART = re.compile(r"[^/=_-]+")
DIGESTS = (32, 40, 48, 56, 64, 96, 128)
UUID = re.compile(r"(?<![0-9a-zA-Z])[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}(?![0-9a-zA-Z])")
HARMLESS = re.compile(rf"[0-9+/_=-]+|{UUID.pattern}|(.{{1,8}}?)\1{{2,}}.{{0,8}}")
HEXES = re.compile(r"[0-9a-fA-F]+")
RATIO = 2.0
SPANS = "array<struct<kind: string, start: int, end: int>>"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns. Overlaps between kinds stay."""
    got = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    got += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    got += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(got)


def harmless(s: str) -> bool:
    """The fixed forms: digests, numbers, UUIDs and repetitions."""
    return bool(HARMLESS.fullmatch(s) or (len(s) in DIGESTS and HEXES.fullmatch(s)))


def random_parts(s: str, path: str, ratio: float) -> list[tuple[int, int]]:
    """Stretches of LEAST or more characters, from part to part between separators, whose tokens outweigh their
    characters most: no stretch within or around them weighs more."""
    fixed = [m.span() for m in UUID.finditer(s)]
    parts = [m.span() for m in PART.finditer(s)]
    counts = [len(e) for e in encode_texts([s[a:b] for a, b in parts], path)]
    found: list[list] = []  # candidates: sum before, sum after, start, end (Ruzzo and Tompa's maximal sums)
    done: list[list] = []
    total = 0.0
    for (a, b), n in zip(parts, counts):
        if harmless(s[a:b]) or any(x <= a and b <= y for x, y in fixed):
            done, found, total = done + found, [], 0.0  # no stretch goes across a fixed form
            continue
        before, total = total, total + ratio * n - (b - a)
        if total <= before:
            continue
        new = [before, total, a, b]
        while True:
            j = next((j for j in range(len(found) - 1, -1, -1) if found[j][0] < new[0]), None)
            if j is None or found[j][1] >= new[1]:
                break
            new = [found[j][0], new[1], found[j][2], new[3]]
            del found[j:]
        found.append(new)
    return [(a, b) for _, _, a, b in done + found if b - a >= LEAST]


def random_spans(text: str, path: str, ratio: float = RATIO) -> list[tuple[int, int, int]]:
    """Runs whose characters per token lie below the ratio; of other runs, the stretches of parts that do."""
    runs = [m for m in RUN.finditer(text) if not harmless(m.group())]
    counts = [len(e) for e in encode_texts([m.group() for m in runs], path)]
    out = []
    for m, n in zip(runs, counts):
        if m.end() - m.start() < ratio * n:
            out.append((m.start(), 3, m.end()))
        elif SEPARATOR.search(m.group()):
            out += [(m.start() + a, 3, m.start() + b) for a, b in random_parts(m.group(), path, ratio)]
    return out


def scan(docs: DataFrame, path: str | None = None, ratio: float = RATIO, keep: list[str] | None = None) -> DataFrame:
    """doc_id, base spans and all spans (base and random) of every text; `keep` names more columns of docs to carry."""
    path = vocabulary_path(path)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def named(spans):
        return [{"kind": KINDS[k], "start": a, "end": b} for a, k, b in spans]

    def find(batches):
        for batch in batches:
            for ids, texts in texts_by_slice(batch):
                base = [base_spans(t) for t in texts]
                every = [sorted(b + random_spans(t, path, ratio)) for b, t in zip(base, texts)]
                yield pa.RecordBatch.from_arrays([ids, pa.array(map(named, base), kind), pa.array(
                    map(named, every), kind)], ["doc_id", "base", "spans"])

    return documents(docs).select("doc_id", "text").mapInArrow(find, f"doc_id long, base {SPANS}, spans {SPANS}")


def redact(docs: DataFrame, path: str | None = None, ratio: float = RATIO, mark: str = "[secret]") -> DataFrame:
    """All rows and columns of docs (which needs a text column), each secret replaced by the mark and n_chars, where
    there is one, counted anew. Null texts stay null."""
    path = vocabulary_path(path)
    where = pick_places(docs, "text")["text"]
    flat = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])

    def clean(t: str | None) -> str | None:
        out, at = [], 0
        for a, _, b in sorted(base_spans(t) + random_spans(t, path, ratio)) if t else ():
            if b > at:
                out += [t[at:a], mark] if a >= at else []
                at = b
        return t if t is None or not out else "".join(out) + t[at:]

    counted = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def rewrite(batches):
        for whole in batches:
            _, offs = utf8(whole.column(where))
            for a, b in slices(offs, SLICE_BYTES):
                batch = whole.slice(a, b - a)
                texts = [clean(t) for t in batch.column(where).to_pylist()]
                field = batch.schema.field(where)
                batch = batch.set_column(where, field, pa.array(texts, field.type))
                if counted is not None:
                    field = batch.schema.field(counted)
                    n = [old if t is None else len(t) for t, old in zip(texts, batch.column(counted).to_pylist())]
                    batch = batch.set_column(counted, field, pa.array(n, field.type))
                yield batch

    return flat.mapInArrow(rewrite, flat.schema).toDF(*docs.columns)
