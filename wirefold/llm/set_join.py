"""N-gram Jaccard join by universe partition and the pigeonhole principle.

A document is the set of its word shingles. Two sets whose Jaccard similarity reaches num/den differ in at most
H = (den - num)(a + b) / (den + num) members, a and b their sizes. The universe of shingles is hashed into m segments, m
chosen by size band and larger than H, so two similar sets agree in all but H segments at most. A set's signatures are
its non-empty segments; each set signs for its own band and for the band below, which covers all sizes it can match.

Cost-based allocation: signatures are counted over all distinct sets, and each set looks only at its H + 1 rarest ones;
under one common order, two sets that agree in all but H segments share one of these. A set with H + 1 signatures of its
own has no partner and leaves. Where hashing left a set fewer than H + 1 non-empty segments, its band is also indexed by
one-deletion neighbourhoods: the contents of each segment less one member, which finds a segment that differs by one
member, and so counts for two segments in the pigeonhole. Small sets use segments of single shingles.

Equal sets are one set throughout, known by a hash of all members, and of groups with the same members one is kept.
Candidates are not all pairs of a group: every set is first compared with one representative of the groups it is in,
then with a few drawn from them, and last with the members of other components in its groups. That last step runs inside
tasks, block against block: a task gets each set once, looks at a pair once however many groups hold it, leaves out pairs
that links found before have joined, and returns a forest of links, never pairs. Each comparison that decides intersects
the whole sets.

Defined results: null and empty texts have an empty set and link with nothing; texts with fewer words than a shingle
have one shingle; repeated rows have equal sets; a doc_id that stands at several texts belongs to all their components,
and each of its rows has its own; rows without doc_id get no links and component null.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wirefold.llm import words
from wirefold.llm.common import documents, pick_places
from wirefold.llm.components import components
from wirefold.llm.lengths import slices
from wirefold.session import cut_lineage

ROUNDS = (1, 3)  # comparisons of a set with group representatives, by round
BLOCK = 512  # members of a group that meet as many others in one cell
ROUTE_MEMBERS = 1 << 22  # shingles in groups with one smallest set that share a task, about
SEEN = 1 << 20  # pairs that a task remembers


@dataclass(frozen=True)
class Bands:
    """Size bands for similarity num/den: band k holds sizes in (edge k, edge k+1], and a size matches only sizes in its
    own band and the two beside it. Bands up to `single` members are one band of single-shingle segments."""
    num: int = 75
    den: int = 100
    slack: float = 1.6
    single: int = 64

    def edges(self, most: int) -> list[int]:
        out = [0, max(self.single, 1)]
        while out[-1] < most:
            out.append(max(out[-1] + 1, out[-1] * self.den // self.num))
        return out

    def errors(self, a: int, b: int) -> int:
        return (self.den - self.num) * (a + b) // (self.den + self.num)

    def largest_partner(self, n: int) -> int:
        return n * self.den // self.num

    def segments(self, top: int) -> int:
        """Number of segments of the band whose largest size is `top`; 0: one for each shingle."""
        if top <= self.single:
            return 0
        return int(self.slack * (self.errors(top, self.largest_partner(top)) + 1)) + 1

    def schemes(self, n: int, edges: list[int]) -> list[tuple[int, int, int]]:
        """(scheme, segments, errors) under which a set of n members signs: its own band, then the band below."""
        k = int(np.searchsorted(edges, n, "left")) - 1
        own = [(k, self.segments(edges[k + 1]), self.errors(n, self.largest_partner(n)))]
        if k:
            own.append((k - 1, self.segments(edges[k]), self.errors(n, min(n, edges[k]))))
        return own


def segment_of(members: np.ndarray, scheme: int, m: int) -> np.ndarray:
    h = words.mix(members ^ words.mix(np.array([scheme + 1], np.uint64)))
    return h if not m else h % np.uint64(m)


def signatures(members: np.ndarray, scheme: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signature and size of each non-empty segment, and the members in order of segment."""
    seg = segment_of(members, scheme, m)
    order = np.argsort(seg.astype(np.uint16) if 0 < m < 1 << 16 else seg, kind="stable")
    seg, members = seg[order], members[order]
    lead = np.flatnonzero(np.append(True, seg[1:] != seg[:-1]))
    total = np.add.reduceat(words.mix(members), lead)
    return _sign(seg[lead], total, scheme), np.diff(np.append(lead, len(seg))), members


def segment_sizes(members: np.ndarray, scheme: int, m: int) -> np.ndarray:
    """Sizes of the non-empty segments, in any order."""
    if not m:
        return np.ones(len(members), np.int64)
    n = np.bincount(segment_of(members, scheme, m).astype(np.int64), minlength=m)
    return n[n > 0]


def _sign(seg: np.ndarray, total: np.ndarray, scheme: int) -> np.ndarray:
    return words.mix(words.mix(seg ^ words.mix(np.array([scheme + 1000], np.uint64))) ^ total)


def deletion_keys(members: np.ndarray, scheme: int, m: int, empties: bool) -> np.ndarray:
    """Signatures of all segments and of all their one-deletion neighbours; `empties` adds empty ones."""
    sig, size, by_seg = signatures(members, scheme, m)
    seg = np.repeat(np.arange(len(sig)), size)
    names = np.unique(segment_of(members, scheme, m))
    lead = np.append(0, np.cumsum(size)[:-1])
    total = np.add.reduceat(words.mix(by_seg), lead)
    less = total[seg] - words.mix(by_seg)
    keep = np.ones(len(seg), bool) if empties else size[seg] > 1
    out = [sig, _sign(names[seg], less, scheme)[keep]]
    if empties and m:
        out.append(_sign(np.setdiff1d(np.arange(m, dtype=np.uint64), names), np.zeros(1, np.uint64), scheme))
    return np.unique(np.concatenate(out))


def set_id(members: np.ndarray) -> int:
    """Identity of a set: order-free, over all members and their number."""
    if not len(members):
        return 0
    h = words.mix(np.array([members.sum() ^ np.uint64(len(members)), words.mix(members).sum()], np.uint64))
    return int((h[:1] ^ words.mix(h[1:] + np.uint64(1))).astype(np.int64)[0])


def shingle_sets(column: pa.Array, shingle: int):
    """Sets of a column's texts, in order."""
    h, at = words.word_hashes(column)
    for a, b in zip(at, at[1:]):
        yield words.shingles(h[a:b], shingle)


def parts(batch: pa.RecordBatch, most: int = 4 << 20):
    _, offs = words.utf8(batch["text"])
    for a, b in slices(offs, most):
        yield batch.slice(a, b - a)


FACTS = "array<struct<role: int, scheme: int, errors: long, total: long, short: int>>"
_FACTS = pa.list_(pa.struct([("role", pa.int32()), ("scheme", pa.int32()), ("errors", pa.int64()), ("total", pa.int64()),
                             ("short", pa.int32())]))


def facts_of(members: np.ndarray, bands: Bands, edges: list[int]) -> list[dict]:
    """Per role of a set: how many signatures it has, how many segments may differ, and whether one-deletion
    neighbourhoods are needed (1) or, beyond them, empty segments (2)."""
    out = []
    for role, (scheme, m, errors) in enumerate(bands.schemes(len(members), edges) if len(members) else ()):
        size = segment_sizes(members, scheme, m)
        able = 2 * int((size > 1).sum()) + int((size == 1).sum())
        out.append({"role": role, "scheme": scheme, "errors": errors, "total": len(size),
                    "short": 0 if len(size) > errors else 1 if able > errors else 2})
    return out


def document_facts(docs: DataFrame, bands: Bands, most: int, shingle: int = 5) -> DataFrame:
    """doc_id, n_shingles, set_id and the facts of each document's set."""
    edges = bands.edges(most)

    def run(batches):
        for batch in batches:
            for part in parts(batch):
                got = list(shingle_sets(part["text"], shingle))
                yield pa.RecordBatch.from_arrays([
                    part["doc_id"], pa.array([len(s) for s in got], pa.int64()),
                    pa.array([set_id(s) for s in got], pa.int64()),
                    pa.array([facts_of(s, bands, edges) for s in got], _FACTS)],
                    ["doc_id", "n_shingles", "set_id", "facts"])

    return documents(docs).select("doc_id", "text").mapInArrow(
        run, f"doc_id long, n_shingles long, set_id long, facts {FACTS}")


def _bitmap(ids: DataFrame, most_bits: int = 27) -> np.ndarray:
    """A set of ids as bits at their hashes, about 32 bits an id and 16 MB at most, whatever the number of ids."""
    bits = max(16, min(most_bits, int(ids.count() * 32).bit_length()))
    at = F.shiftrightunsigned(F.xxhash64("doc"), 64 - bits)
    one = F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(31)).cast("int"))
    cells = ids.select(F.shiftright(at, 5).alias("w"), one.alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()
    out = np.zeros(1 << (bits - 5), np.uint32)
    out[cells["w"].to_numpy(np.int64)] = cells["b"].to_numpy(np.int64).astype(np.uint32)
    return out


def sets_of(docs: DataFrame, live: DataFrame, shingle: int) -> DataFrame:
    """set_id and sorted members of the sets in `live` (set_id, doc). A bitmap of the ids leaves most other
    texts out before the join that decides; a doc_id that stands at several texts brings all of them, and its own decide."""
    marks = _bitmap(live.select("doc").distinct())
    bits = len(marks).bit_length() + 4

    def kept(batches):
        for batch in batches:
            at = batch["at"].to_numpy().view(np.uint64) >> np.uint64(64 - bits)
            hit = marks[(at >> np.uint64(5)).astype(np.int64)] >> (at & np.uint64(31)).astype(np.uint32) & np.uint32(1)
            yield batch.select(["doc_id", "text"]).filter(pa.array(hit.astype(bool)))

    def run(batches):
        for batch in batches:
            for part in parts(batch):
                got = list(shingle_sets(part["text"], shingle))
                yield pa.RecordBatch.from_arrays([
                    pa.array([set_id(s) for s in got], pa.int64()),
                    pa.array([s.view(np.int64) for s in got], pa.list_(pa.int64()))], ["set_id", "members"])

    texts = docs.select("doc_id", "text", F.xxhash64("doc_id").alias("at")).mapInArrow(kept, "doc_id long, text string")
    texts = texts.join(live.select("doc").distinct(), F.col("doc_id") == F.col("doc"), "left_semi")
    got = texts.mapInArrow(run, "set_id long, members array<long>")
    return got.join(live.select("set_id"), "set_id", "left_semi").dropDuplicates(["set_id"])


def rare_signatures(docs: DataFrame, bands: Bands, most: int, shingle: int, buckets: int) -> DataFrame:
    """(set_id, role, errors, total, sigs): for each set and role, its number of signatures and those that another set
    has too, with their counts.

    Signatures travel packed: one row per slice of documents and bucket of signatures, with 6 bytes a signature (the
    bucket holds the rest of its bits), so the shuffle is a few bytes per shingle. Signatures that share these bits are
    taken for equal, which can only add candidates.
    """
    edges = bands.edges(most)

    def sign(batches):
        for batch in batches:
            for part in parts(batch):
                sets = {}
                for s in shingle_sets(part["text"], shingle):
                    if len(s):
                        sets[set_id(s)] = s
                keys, sigs = [], []
                for sid, s in sets.items():
                    for role, (scheme, m, _) in enumerate(bands.schemes(len(s), edges)):
                        sig, _, _ = signatures(s, scheme, m)
                        sigs.append(sig)
                        keys.append((sid, role, len(sig)))
                if not sigs:
                    continue
                sig = np.concatenate(sigs)
                owner = np.repeat(np.arange(len(keys)), [len(x) for x in sigs])
                bucket = ((sig >> np.uint64(48)) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                edge = np.searchsorted(bucket[order], np.arange(buckets + 1))
                sid = np.array([k[0] for k in keys], np.int64)
                role = np.array([k[1] for k in keys], np.uint8)
                out = {"bucket": [], "packed": []}
                for b in range(buckets):
                    mine = order[edge[b]:edge[b + 1]]
                    if len(mine):
                        who, n = np.unique(owner[mine], return_counts=True)  # mine is in order of owner
                        low = np.ascontiguousarray(sig[mine]).view(np.uint8).reshape(-1, 8)[:, :6]
                        out["bucket"].append(b)
                        out["packed"].append(b"".join((np.int64(len(who)).tobytes(), sid[who].tobytes(), n.astype(
                            np.uint32).tobytes(), role[who].tobytes(), np.ascontiguousarray(low).tobytes())))
                yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("bucket", pa.int32()), ("packed", pa.binary())]))

    def count(key, group):
        b = key[0].as_py()
        sid, role, sig = [], [], []
        for packed in group["packed"].to_pylist():
            n = int(np.frombuffer(packed, np.int64, 1)[0])
            each = np.frombuffer(packed, np.uint32, n, 8 + 8 * n)
            sid.append(np.repeat(np.frombuffer(packed, np.int64, n, 8), each))
            role.append(np.repeat(np.frombuffer(packed, np.uint8, n, 8 + 12 * n), each))
            low = np.zeros((int(each.sum()), 8), np.uint8)
            low[:, :6] = np.frombuffer(packed, np.uint8, -1, 8 + 13 * n).reshape(-1, 6)
            sig.append(low.view(np.int64).reshape(-1))
        sid, role, sig = np.concatenate(sid), np.concatenate(role), np.concatenate(sig)
        order = np.lexsort((sid, sig))
        sid, role, sig = sid[order], role[order], sig[order]
        new = np.append(True, (sig[1:] != sig[:-1]) | (sid[1:] != sid[:-1]))  # copies of a set count once
        sid, role, sig = sid[new], role[new], sig[new]
        lead = np.flatnonzero(np.append(True, sig[1:] != sig[:-1]))
        n = np.diff(np.append(lead, len(sig)))
        n = np.repeat(n, n)
        keep = n > 1
        return pa.table({"set_id": sid[keep], "role": role[keep].astype(np.int32), "sig": words.mix(
            sig[keep].view(np.uint64) + (np.uint64(b) << np.uint64(48))).view(np.int64), "n": n[keep]})

    packed = documents(docs).select("doc_id", "text").mapInArrow(sign, "bucket int, packed binary")
    return packed.groupBy("bucket").applyInArrow(count, "set_id long, role int, sig long, n long")


def _deletions(docs: DataFrame, bands: Bands, most: int, shingle: int, schemes: dict[int, int]) -> DataFrame:
    """Keys by one-deletion neighbourhoods for the schemes in which a set needs them."""
    edges = bands.edges(most)

    def run(batches):
        for batch in batches:
            for part in parts(batch, 1 << 20):
                for s in shingle_sets(part["text"], shingle):
                    for scheme, m, _ in bands.schemes(len(s), edges) if len(s) else ():
                        if scheme in schemes:
                            k = deletion_keys(s, scheme, m, schemes[scheme] > 1)
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), set_id(s))), pa.array(
                                k.view(np.int64))], ["set_id", "sig"])

    return documents(docs).select("doc_id", "text").mapInArrow(run, "set_id long, sig long").distinct()


def largest(docs: DataFrame) -> int:
    """No set has more members than its text has bytes."""
    return int(docs.agg(F.max(F.octet_length("text"))).first()[0] or 1)


def candidate_keys(docs: DataFrame, base: DataFrame, bands: Bands, most: int, shingle: int, buckets: int) -> DataFrame:
    """(sig, set_id): sets that may be similar share a sig. `base` holds the documents' facts."""
    facts = base.select("set_id", F.explode("facts").alias("f")).select("set_id", "f.*").distinct()
    shared = rare_signatures(docs, bands, most, shingle, buckets)
    mine = shared.groupBy("set_id", "role").agg(F.collect_list(F.struct("n", "sig")).alias("sigs"))
    need = F.col("errors") + 1 - (F.col("total") - F.size("sigs"))
    keys = mine.join(facts, ["set_id", "role"]).withColumn("need", need.cast("int")).filter("need > 0").select(
        "set_id", F.explode(F.slice(F.array_sort("sigs"), F.lit(1), F.col("need"))).alias("s")).select(
        F.col("s.sig").alias("sig"), "set_id")
    # One row per band at most.
    short = {r["scheme"]: r["short"] for r in facts.groupBy("scheme").agg(F.max("short").alias("short")).filter(
        "short > 0").collect()}
    if short:
        keys = keys.union(_deletions(docs, bands, most, shingle, short).select("sig", "set_id"))
    return keys.distinct()


def one_of_equal_groups(keys: DataFrame) -> DataFrame:
    """The keys of one signature of all that have the same members; groups of one member go."""
    names = [F.bit_xor(F.xxhash64("set_id", F.lit(k))).alias(f"h{k}") for k in (1, 2)]
    groups = keys.groupBy("sig").agg(F.count(F.lit(1)).alias("size"), *names).filter("size > 1")
    return keys.join(groups.groupBy("size", "h1", "h2").agg(F.min("sig").alias("sig")).select("sig"), "sig")


def _verified(pairs: DataFrame, sets: DataFrame, bands: Bands) -> DataFrame:
    """Pairs (a, b) of sets that reach the similarity, by whole sets."""
    left = sets.select(F.col("set_id").alias("a"), F.col("members").alias("ma"))
    right = sets.select(F.col("set_id").alias("b"), F.col("members").alias("mb"))
    both = F.size(F.array_intersect("ma", "mb")).cast("long")
    got = pairs.join(left, "a").join(right, "b").select("a", "b", both.alias("both"), (
        F.size("ma") + F.size("mb")).cast("long").alias("sum"))
    return got.filter(F.col("both") * bands.den >= (F.col("sum") - F.col("both")) * bands.num).select("a", "b")


def _joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels (set_id, component) after further links: only components that a link touches are worked on."""
    label = lambda side: labels.select(F.col("set_id").alias(side), F.col("component").alias(f"c{side}"))
    edges = links.join(label("a"), "a").join(label("b"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    moved = components(edges).select(F.col("node").alias("component"), F.col("component").alias("to"))
    return cut_lineage(labels.join(moved, "component", "left").select("set_id", F.coalesce("to", "component").alias(
        "component")))


def _mixed(keys: DataFrame, labels: DataFrame) -> DataFrame:
    """The keys, with the component of each set so far, of groups that hold more than one component."""
    now = keys.join(labels, "set_id")
    mixed = now.groupBy("sig").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low != high")
    return now.join(mixed.select("sig"), "sig")


def _tried(now: DataFrame, turn: int, tries: int) -> DataFrame:
    """Pairs (a, b): each set with the `tries` representatives that most of its groups have, of other components. The
    first round takes the smallest member of a group, later ones a member drawn by hash."""
    drawn = F.xxhash64("set_id", F.lit(turn)) if turn else F.col("set_id")
    group = now.groupBy("sig").agg(F.min_by(F.struct("set_id", "component"), drawn).alias("rep"))
    votes = now.join(group, "sig").filter("component != rep.component").groupBy(
        "set_id", F.col("rep.set_id").alias("rep")).count()
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("n"), "rep"))), 1, tries)
    return votes.groupBy("set_id").agg(best.alias("reps")).select(F.col("set_id").alias("a"), F.explode("reps.rep").alias("b"))


class Meeting:
    """The sets of a task's groups. Components that a link joins stay joined for the groups that follow."""

    def __init__(self, ids: list[int], members: list[np.ndarray], bands: Bands):
        self.bands, self.at = bands, {i: k for k, i in enumerate(ids)}
        self.size = np.array([len(m) for m in members], np.int64)
        self.start = np.cumsum(self.size) - self.size
        names, self.codes = np.unique(np.concatenate(members), return_inverse=True)
        self.here, self.seen, self.root = np.zeros(len(names), bool), set(), {}

    def find(self, c: int) -> int:
        while (up := self.root.get(c, c)) != c:
            self.root[c] = c = self.root.get(up, up)
        return c

    def common(self, i: int, js: np.ndarray) -> np.ndarray:
        """Sizes of the intersections of set i with the sets js."""
        mine = self.codes[self.start[i]:self.start[i] + self.size[i]]
        self.here[mine] = True
        found = self.here[self.codes[words.spread(self.start[js], self.size[js])]]
        self.here[mine] = False
        return np.add.reduceat(found, np.cumsum(self.size[js]) - self.size[js], dtype=np.int64)

    def links(self, rows: list[tuple[int, int, int]], cross: bool):
        """Links (a, b) that join the components of a group's rows (set, component, block); `cross` asks for different
        blocks."""
        num, den = self.bands.num, self.bands.den
        at = np.array([self.at[r[0]] for r in rows])
        by = np.argsort(self.size[at], kind="stable")
        at, ids, block = at[by], [rows[k][0] for k in by], np.array([r[2] for r in rows])[by]
        root = np.array([self.find(rows[k][1]) for k in by])
        n = self.size[at]
        last = np.searchsorted(n, n * den // num, "right")
        for i in range(len(at)):
            js = np.arange(i + 1, last[i])
            js = js[root[js] != root[i]]
            if cross:
                js = js[block[js] != block[i]]
            new = [j for j in js.tolist() if (at[i], at[j]) not in self.seen and (at[j], at[i]) not in self.seen]
            if not new:
                continue
            self.seen.update((at[i], at[j]) for j in new)
            js = np.array(new)
            both = self.common(int(at[i]), at[js])
            for j in js[both * den >= (n[js] + n[i] - both) * num].tolist():
                if root[j] != root[i]:
                    yield ids[i], ids[j]
                    low, high = sorted((int(root[i]), int(root[j])))
                    self.root[high] = low
                    root[root == high] = low


def links_in_groups(now: DataFrame, sets: DataFrame, bands: Bands, block: int = BLOCK) -> DataFrame:
    """Links (a, b) that join the components of sets that share a group and are similar.

    Groups go to tasks by their smallest member, so that groups of the same sets meet; where such groups hold many
    shingles they are dealt over several tasks. Groups of more than `block` members go as pairs of blocks.
    """
    groups = now.groupBy("sig").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("n"), F.min("set_id").alias("route"))
    routes = groups.groupBy("route").agg(F.sum("n").alias("all"))
    groups = groups.join(routes, "route").select("sig", "size", "route", F.pmod(
        F.xxhash64("sig"), F.expr(f"all div {ROUTE_MEMBERS} + 1")).alias("part"))
    rows = now.join(groups, "sig").withColumn("blocks", F.expr(f"cast((size - 1) div {block} + 1 as int)"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("set_id"), F.col("blocks")).cast("int")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cell = ["route", "part", "i", "j"]
    rows = rows.select("route", "part", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "sig",
                       "set_id", "component", "own")
    whole = rows.select(*cell, "set_id").distinct().join(sets, "set_id")
    both = rows.withColumn("members", F.lit(None).cast("array<long>")).unionByName(whole.select(
        *cell, F.lit(None).cast("long").alias("sig"), "set_id", F.lit(0).cast("long").alias("component"),
        F.lit(0).alias("own"), "members"))

    def meet(batches):
        key, sig, held, ids, members, here, out = None, None, [], [], [], None, []

        def flush():
            if len(held) > 1:
                out.extend(here.links(held, key[2] != key[3]))
                if len(here.seen) > SEEN:
                    here.seen.clear()

        for batch in batches:
            column = batch.column(batch.schema.get_field_index("members"))
            offs, flat = column.offsets.to_numpy(), column.values.to_numpy()
            names = [batch.column(c).to_pylist() for c in ("route", "part", "i", "j", "sig", "set_id", "component", "own")]
            for k, (*at, s, set_, comp, own) in enumerate(zip(*names)):
                if at != key or s != sig:
                    flush()
                    held = []
                    if at != key:
                        key, ids, members, here = at, [], [], None
                    sig = s
                if s is None:
                    ids.append(set_)
                    members.append(flat[offs[k]:offs[k + 1]])
                    continue
                if here is None:
                    here, members = Meeting(ids, members, bands), []
                held.append((set_, comp, own))
            yield _pairs(out)
            out = []
        flush()
        yield _pairs(out)

    return both.repartition(*cell).sortWithinPartitions(*cell, F.asc_nulls_first("sig")).mapInArrow(meet, "a long, b long")


def _pairs(rows: list[tuple]) -> pa.RecordBatch:
    a, b = zip(*rows) if rows else ([], [])
    return pa.RecordBatch.from_arrays([pa.array(list(a), pa.int64()), pa.array(list(b), pa.int64())], ["a", "b"])


def similar_components(docs: DataFrame, bands: Bands = Bands(), shingle: int = 5,
                       buckets: int | None = None) -> DataFrame:
    """doc_id, n_shingles, set_id, component_id (smallest doc_id reachable by links) and set_component (the component by
    links between texts alone) of every document."""
    docs = documents(docs)
    buckets = min(buckets or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1 << 16)
    most = largest(docs)
    base = cut_lineage(document_facts(docs, bands, most, shingle))
    distinct = base.filter("n_shingles > 0 and doc_id is not null").groupBy("set_id").agg(
        F.min("doc_id").alias("doc"), F.first("n_shingles").alias("n"))
    keys = candidate_keys(docs, base, bands, most, shingle, buckets).join(distinct.select("set_id", "n"), "set_id")
    keys = cut_lineage(one_of_equal_groups(cut_lineage(keys)))
    # Whole sets of the sets that have candidates: their texts alone are read into sets again.
    live = cut_lineage(keys.select("set_id").distinct().join(distinct.select("set_id", "doc"), "set_id"))
    sets = cut_lineage(sets_of(docs, live, shingle))
    labels = cut_lineage(live.select("set_id", F.col("set_id").alias("component")))
    for turn, tries in enumerate(ROUNDS):
        labels = _joined(labels, _verified(_tried(_mixed(keys, labels), turn, tries), sets, bands))
    labels = _joined(labels, cut_lineage(links_in_groups(cut_lineage(_mixed(keys, labels)), sets, bands)))
    own = base.filter("n_shingles > 0 and doc_id is not null").select("doc_id", "set_id").distinct().join(
        labels, "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))
    own = cut_lineage(own)
    # A doc_id that stands at several texts joins their components.
    low = own.groupBy("doc_id").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low != high")
    through = components(own.join(low, "doc_id").select(F.col("component").alias("a"), F.col("low").alias("b")))
    whole = own.join(through.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left")
    whole = whole.select("doc_id", "set_id", "component", F.coalesce("to", "component").alias("to"))
    names = whole.groupBy("to").agg(F.min("doc_id").alias("least"))
    by_set = whole.join(names, "to").select("set_id", F.col("component").alias("set_component"), "least").distinct()
    linked = F.when(F.col("n_shingles") > 0, F.col("least")).otherwise(F.col("doc_id"))
    return base.join(by_set, "set_id", "left").select(
        "doc_id", "n_shingles", "set_id", F.when(F.col("doc_id").isNotNull(), linked).alias("component_id"),
        F.coalesce("set_component", "set_id").alias("set_component"))


def one_of_each(docs: DataFrame, found: DataFrame, bands: Bands = Bands(), shingle: int = 5) -> DataFrame:
    """The rows of docs that are left when of each component of near copies one text stays, that of the smallest doc_id;
    `found` is what `similar_components` says of docs.

    Different texts under one doc_id are judged each on its own, equal rows of one doc_id stay once, and so do rows
    without words; rows without doc_id stay all. Columns are handled by place.
    """
    some = found.filter("doc_id is not null")
    first = some.filter("n_shingles > 0").groupBy("set_component").agg(F.min(F.struct("doc_id", "set_id")).alias("first"))
    kept = (F.col("n_shingles") == 0) | (F.struct("doc_id", "set_id") == F.col("first"))
    flags = cut_lineage(some.join(first, "set_component", "left").groupBy("doc_id", "set_id").agg(
        F.count(F.lit(1)).alias("rows"), F.bool_or(kept).alias("kept")))
    per_doc = cut_lineage(flags.groupBy("doc_id").agg(F.sum("rows").alias("rows"), F.bool_or("kept").alias("kept")).filter(
        "rows > 1 or not kept").select(F.col("doc_id").alias("at"), "rows"))
    flat = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    places = pick_places(docs, "doc_id", "text")
    at = F.col(f"c{places['doc_id']}").cast("long")
    plain = flat.join(per_doc.select("at"), at == F.col("at"), "left_anti")
    # Few rows as a rule: doc_ids that repeat. Their sets are made again to tell their texts apart.
    several = flat.join(per_doc.filter("rows > 1").select("at"), at == F.col("at"), "left_semi")
    kinds, text = several.schema, places["text"]

    def run(batches):
        for batch in batches:
            ids = [set_id(s) for s in shingle_sets(batch.column(text).cast(pa.string()), shingle)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.int64())], [*batch.schema.names, "s"])

    several = several.mapInArrow(run, T.StructType([*kinds.fields, T.StructField("s", T.LongType())]))
    stay = flags.filter("kept").select(F.col("doc_id").alias("at"), F.col("set_id").alias("stays"))
    several = several.join(stay, (at == F.col("at")) & (F.col("s") == F.col("stays")), "left_semi").dropDuplicates(
        [f"c{places['doc_id']}", "s"]).drop("s")
    return plain.unionByName(several).toDF(*docs.columns)
