"""Document fingerprints by a homomorphic multiset hash.

A text is cut into paragraphs: at line breaks and, since many texts are one long line, after sentence ends. Every
paragraph is hashed to a wide vector and the vectors are summed lane by lane modulo a power of two, so the order of
paragraphs does not matter, and adding or removing a paragraph adds or subtracts its vector. There are three parts:

* lock: 8 lanes modulo 2^32 (256 bits) for equality;
* count: number of paragraphs, modulo 2^32;
* likeness: 64 * `banks` lanes modulo 2^32, lane j counts paragraphs whose hash has bit j set. Twice the lane less the
  count is a random signed sum, so the mean square of the difference of two fingerprints estimates how many paragraphs
  (with multiplicity, squared) they do not share.

The hash is not keyed: it tells texts apart, it does not withstand an attacker. Everything here is a Column expression.

Defined results: a null text counts as empty; empty paragraphs do not count; empty texts have all lanes 0 and likeness
1 to each other, 0 to others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wirefold.llm.common import pick

PARAGRAPH = r"[\r\n]+|(?<=[.!?])\s+"
BANKS = 2
LOCKS = 4
SPLITS = 1024
_LOW = 0xFFFFFFFF


def _salted(salt: int):
    return lambda h: F.xxhash64(h, F.lit(salt))


def vector(text: Column, banks: int = BANKS) -> Column:
    """The fingerprint as array<long>: 8 lock lanes, the count, then the likeness lanes."""
    parts = F.filter(F.split(F.coalesce(text, F.lit("")), PARAGRAPH), lambda p: p != "")
    total = lambda xs, f: F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + f(x))

    def lanes(hashes: Column) -> Column:
        """Two lanes of 32 bits in each long: bit j and bit j + 32 of the hashes."""
        packed = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda j: total(
            hashes, lambda h: F.call_function("shiftrightunsigned", h, j).bitwiseAND(F.lit(0x100000001))))
        return F.concat(F.transform(packed, lambda v: v.bitwiseAND(F.lit(_LOW))),
                        F.transform(packed, lambda v: F.shiftrightunsigned(v, 32)))

    def of(hashes: Column) -> Column:
        locks = [total(hashes, lambda h, i=i, s=s: F.shiftrightunsigned(F.xxhash64(h, F.lit(i)), s).bitwiseAND(
            F.lit(_LOW))).bitwiseAND(F.lit(_LOW)) for i in range(LOCKS) for s in (0, 32)]
        banked = [lanes(hashes)] + [lanes(F.transform(hashes, _salted(1000 + b))) for b in range(1, banks)]
        return F.concat(F.array(*locks, F.size(hashes).cast("long")), *banked)

    # transform over a one-element array binds the hashes, so that they are computed once a text
    return F.element_at(F.transform(F.array(F.transform(parts, lambda p: F.xxhash64(p))), of), 1)


def text_form(v: Column) -> Column:
    """Lower-case hex, 8 digits a lane."""
    return F.array_join(F.transform(v, lambda x: F.lower(F.lpad(F.hex(x), 8, "0"))), "")


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """Fingerprint of the multiset sum (sign 1) or difference (sign -1) of two fingerprints."""
    return F.zip_with(a, b, lambda x, y: (x + F.lit(sign) * y).bitwiseAND(F.lit(_LOW)))


def likeness(a: Column, b: Column) -> Column:
    """Estimated share of paragraphs in common, 0 to 1; exactly 1 for equal fingerprints."""
    size = lambda v: F.element_at(v, 9)
    signed = lambda x: F.pmod(x + F.lit(1 << 31), F.lit(1 << 32)) - F.lit(1 << 31)

    def square(xs: Column, n: Column) -> Column:
        return F.aggregate(xs, F.lit(0.0), lambda s, x: s + F.pow((signed(x) * 2 - n).cast("double"), F.lit(2.0)))

    la, lb = F.slice(a, 10, 1 << 20), F.slice(b, 10, 1 << 20)
    apart = square(F.zip_with(la, lb, lambda x, y: x - y), size(a) - size(b))
    whole = square(la, size(a)) + square(lb, size(b))
    return F.when(a == b, F.lit(1.0)).when(whole == 0, F.lit(0.0)).otherwise(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(1.0) - apart / whole)))


def fingerprints(docs: DataFrame, banks: int = BANKS) -> DataFrame:
    """doc_id, n_chars and the fingerprint of every row."""
    d = pick(docs, doc_id="doc_id", text="text")
    return d.select("doc_id", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"),
                    vector(F.col("text"), banks).alias("fingerprint"))


def _range_of(key: Column, cuts: list[int]) -> Column:
    """Number of cuts below the key, found in two steps of about sqrt(len(cuts)) comparisons."""
    step = max(1, int(len(cuts) ** 0.5))
    fine = [cuts[i:i + step] for i in range(0, len(cuts), step)]
    below = lambda xs: F.size(F.filter(xs, lambda c: c < key))
    # cuts are written in the plan as text: a fixed number of them, whatever the input
    coarse = F.expr("array(" + ",".join(f"{f[-1]}L" for f in fine) + ")")
    lists = F.expr("array(" + ",".join("array(" + ",".join(f"{c}L" for c in f) + ")" for f in fine) + ")")
    at = below(coarse)
    return F.when(at >= len(fine), F.lit(len(cuts))).otherwise(
        at * step + below(F.element_at(lists, F.least(at + 1, F.lit(len(fine))))))


def with_next(docs: DataFrame, carry: list[str], splits: int | None = None) -> DataFrame:
    """Adds next_<c> for each c of `carry`: its value in the next row in descending doc_id (ties in descending text;
    null ids last); after the last row comes the first.

    Rows go into at most `splits` ranges of ids (twice the shuffle partitions, at least SPLITS) by quantiles; each range also gets a copy of the first row of the
    range below, so no window spans ranges. Two short lists of ids (one per range) pass through the driver.
    """
    low = -(2**63) + 1
    splits = splits or max(SPLITS, 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    d = docs.withColumn("__key", F.coalesce(F.col("doc_id").cast("long"), F.lit(low)))
    found = d.agg(F.percentile_approx("__key", [i / splits for i in range(1, splits)], 20 * splits)).first()[0] or []
    cuts = sorted(set(found))
    d = d.withColumn("__range", _range_of(F.col("__key"), cuts) if cuts else F.lit(0))
    tops = {r["__range"]: r["top"] for r in d.groupBy("__range").agg(F.max("__key").alias("top")).collect()}
    if not tops:
        return d.select("*", *[F.lit(None).cast(docs.schema[c].dataType).alias(f"next_{c}") for c in carry]).drop(
            "__key", "__range")
    order = sorted(tops)
    above = {r: order[(i + 1) % len(order)] for i, r in enumerate(order)}  # whose last row comes just before range r
    full = max(order) + 1
    as_array = lambda f: F.expr("array(" + ",".join(f(r) for r in range(full)) + ")")
    top = F.element_at(as_array(lambda r: f"{tops.get(r, low)}L"), F.col("__range") + 1)
    over = F.element_at(as_array(lambda r: str(above.get(r, -1))), F.col("__range") + 1)
    at = F.struct(F.col("__range").alias("r"), F.lit(False).alias("ghost"))
    ghost = F.struct(over.alias("r"), F.lit(True).alias("ghost"))
    d = d.withColumn("__at", F.explode(F.when(F.col("__key") == top, F.array(at, ghost)).otherwise(F.array(at))))
    d = d.withColumns({"__range": F.col("__at.r"), "__ghost": F.col("__at.ghost")}).drop("__at")
    w = Window.partitionBy("__range").orderBy("__ghost", F.col("__key").desc(), F.col("text").desc())
    d = d.withColumns({f"next_{c}": F.lead(c).over(w) for c in carry})  # one window for all
    return d.filter(~F.col("__ghost")).drop("__key", "__range", "__ghost")


def edited_fingerprints(docs: DataFrame, banks: int = BANKS, splits: int | None = None) -> DataFrame:
    """Fingerprint of every text, of its edited text and of the next document, and the likeness to both.

    Edited: the last floor(n_chars / 2) code points are replaced by the first as many (or all) of the next document.
    """
    d = pick(docs, doc_id="doc_id", text="text").withColumn("text", F.coalesce("text", F.lit("")))
    d = with_next(d.withColumn("v", vector(F.col("text"), banks)), ["text", "v"], splits)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    d = d.select("doc_id", n.cast("long").alias("n_chars"), "v", "next_v", F.concat(
        F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half)).alias("edited"))
    d = d.select("doc_id", "n_chars", "v", "next_v", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
                 vector(F.col("edited"), banks).alias("e"))
    return d.select("doc_id", "n_chars", "edited_sha256", text_form(F.col("v")).alias("fingerprint"),
                    text_form(F.col("e")).alias("edited_fingerprint"),
                    likeness(F.col("v"), F.col("e")).alias("near_edited"),
                    likeness(F.col("v"), F.col("next_v")).alias("near_next"),
                    F.element_at("v", 9).alias("n_paragraphs"))
