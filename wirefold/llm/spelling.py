"""Spelling variants: words one edit apart, each led to the far more frequent word it stands for.

The vocabulary is indexed bit-sliced: for every (position, letter) a bitset over the words that have the letter there.
A word is looked up by running along its letters with four bitsets at once: the words that agree so far, and those with
one replaced, one inserted or one missing letter, which read the index at the same, the next and the previous position.
One step moves every word of the index, a machine word of them at a time.

Two words one edit apart, the shorter of a letters, agree in their first or in their last h = a div 2 letters. So words
are dealt out by (a, side, those h letters), and only words of one such class meet; the last letters are handled as the
first ones of the reversed words. A pair of equal beginnings is counted on that side alone. Classes of more than BLOCK
words are cut in blocks of the index, and every word of the class passes all of them. A word leaves a class as its
number of near words and the best of them, never as pairs.

Words come from whole texts: runs of [A-Za-z\\u00C0-\\u00FF], with A-Z lower-cased. Per document and word a hash decides
whether one letter is dropped (`every`), which plants spellings to find.

Defined results: null and empty texts hold no word; a null doc_id is hashed as empty text; repeated rows count each;
an empty table has no words. Words may be of any length.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirefold.llm.common import documents
from wirefold.session import cut_lineage

LEAST_LETTERS, LEAST_N, FACTOR, EVERY = 6, 5, 5, 199
BLOCK = 1 << 15  # words of an index
PIECE = 1 << 20  # bytes of a text that are split at once
HELD, HELD_LETTERS = 1 << 19, 1 << 26  # words, and letters in all, that a task holds


def pieces(data: bytes, size: int = PIECE):
    """A text in UTF-8 cut between words, in parts of about `size` bytes. Only an ASCII byte that is no letter ends a
    part; where there is none, the part goes on."""
    a = 0
    while a < len(data):
        stop = _ENDS.search(data, a + size) if a + size < len(data) else None
        b = stop.end() if stop else len(data)
        yield data[a:b]
        a = b


_ENDS = re.compile(rb"[\x00-@\[-`{-\x7f]")


def word_counts(docs: DataFrame, every: int = EVERY, letters: int = LEAST_LETTERS, least: int = LEAST_N) -> DataFrame:
    """word and n of the words of at least `letters` letters that occur at least `least` times."""
    # shorter runs cannot give a word: dropping a letter only shortens them
    runs = re.compile("[A-Za-zÀ-ÿ]{%d,}" % letters)

    def split(batches):
        held: Counter = Counter()
        size = 0
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].cast(pa.large_binary())):
                head = f"{'' if doc_id is None else doc_id}:".encode()
                crc = zlib.crc32(head)
                for part in pieces(text.as_py() or b""):
                    for run, n in Counter(runs.findall(part.lower().decode())).items():  # bytes lower A-Z alone
                        h = zlib.crc32(run.encode(), crc)
                        if h % every == 0:
                            cut = h % len(run)
                            run = run[:cut] + run[cut + 1:]
                            if len(run) < letters:
                                continue
                        held[run] += n
                        size += len(run)
                if len(held) > HELD or size > HELD_LETTERS:
                    yield _counts(held)
                    held, size = Counter(), 0
        yield _counts(held)

    found = documents(docs).mapInArrow(split, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return found.filter(F.col("n") >= least)


def _counts(held: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())],
                                      ["word", "n"])


class BitIndex:
    """Bitsets over the words of a class block: by (position, letter) and by length."""

    def __init__(self, rests: list[str]):
        places: dict[tuple[int, str], list[int]] = {}
        lengths: dict[int, list[int]] = {}
        for j, w in enumerate(rests):
            lengths.setdefault(len(w), []).append(j)
            for key in enumerate(w):
                places.setdefault(key, []).append(j)
        size = -(-len(rests) // 8)
        self.all = (1 << len(rests)) - 1
        self.at = {k: _bits(v, size) for k, v in places.items()}
        self.length = {k: _bits(v, size) for k, v in lengths.items()}

    def near(self, w: str) -> int:
        """The words exactly one inserted, deleted or replaced letter away from w."""
        at, none = self.at, 0
        same, other, more, less = self.all, none, none, none
        before, here = none, at.get((0, w[0]), none) if w else none  # this letter one position back, and here
        for i, c in enumerate(w):
            ahead = at.get((i + 1, c), none)
            more = (more | same) & ahead        # the indexed word has one letter more, before this one
            less = (less & before) | same       # the indexed word lacks this letter, or lacked one earlier
            other = (other & here) | (same & ~here)
            same &= here
            if not (same or other or more or less):
                return none
            if i + 1 < len(w):
                before, here = at.get((i, w[i + 1]), none), at.get((i + 1, w[i + 1]), none)
        m, size = self.length, len(w)
        return (other & m.get(size, none)) | ((more | same) & m.get(size + 1, none)) | (less & m.get(size - 1, none))


def _bits(places: list[int], size: int) -> int:
    if len(places) < 4:
        return sum(1 << j for j in places)
    out = bytearray(size)
    for j in places:
        out[j >> 3] |= 1 << (j & 7)
    return int.from_bytes(out, "little")


def members(bits: int):
    """The numbers of the set bits."""
    while bits:
        low = bits & -bits
        yield low.bit_length() - 1
        bits ^= low


def _classes(words: DataFrame, block: int) -> DataFrame:
    """a, back, head, part, guest, word and n: every word in the four classes in which it can meet a near word. Words
    alone in a class are left out; a class of many words has a part per block, and a word is a guest where it is not in
    that block's index."""
    size = F.char_length("word")
    kinds = F.explode(F.array(*[F.struct(a.cast("int").alias("a"), F.lit(back).alias("back"))
                                for a in (size, size - 1) for back in (False, True)]))
    rows = words.select("word", "n", kinds.alias("k")).select("word", "n", "k.*").filter("a >= 1").withColumn(
        "spelt", F.when(F.col("back"), F.reverse("word")).otherwise(F.col("word"))).withColumn(
        "head", F.expr("substr(spelt, 1, a div 2)")).drop("spelt")
    counts = rows.groupBy("a", "back", "head").agg(F.count(F.lit(1)).alias("size"), F.min(F.char_length("word")).alias(
        "least")).filter("size > 1 and least = a").drop("least")
    dealt = rows.join(counts, ["a", "back", "head"]).withColumn("parts", F.expr(f"cast((size - 1) div {block} as int) + 1"))
    own = F.pmod(F.xxhash64("word"), F.col("parts")).cast("int")
    return dealt.withColumn("home", own).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        "a", "back", "head", "part", (F.col("home") != F.col("part")).alias("guest"), "word", "n")


class Block:
    """The index of one block, filled first and then asked."""

    def __init__(self, a: int, back: bool):
        self.a, self.back, self.h = a, back, a // 2
        self.words: list[str] = []
        self.n: list[int] = []
        self.index: BitIndex | None = None

    def rest(self, word: str) -> str:
        return (word[::-1] if self.back else word)[self.h:]

    def look_up(self, word: str) -> tuple[int, int, str] | None:
        """How many words of the block are near, and the most frequent of them (the first in order among equals)."""
        if self.index is None:
            self.index = BitIndex([self.rest(w) for w in self.words])
        n_near, best = 0, (0, "")
        for j in members(self.index.near(self.rest(word))):
            other = self.words[j]
            if min(len(word), len(other)) != self.a or (self.back and word[:self.h] == other[:self.h]):
                continue  # met in another class
            n_near += 1
            best = min(best, (-self.n[j], other))
        return (n_near, -best[0], best[1]) if n_near else None


def near_words(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """word, n_near (words one edit away), near and near_n (the most frequent of them, the first in code-point order
    among equals) of the words that have any. Words are distinct, with their counts n."""
    rows = _classes(words, block)

    def meet(batches):
        at, here, own = None, None, []
        out: list[tuple] = []

        def ask(word):
            found = here.look_up(word)
            if found:
                out.append((word, *found))

        for batch in batches:
            for *key, guest, word, n in zip(*[c.to_pylist() for c in batch.columns]):
                if key != at:
                    for w in own:
                        ask(w)
                    at, here, own = key, Block(key[0], key[1]), []
                if guest:
                    ask(word)
                else:
                    here.words.append(word)
                    here.n.append(n)
                    own.append(word)
            yield _found(out)
            out.clear()
        for w in own:
            ask(w)
        yield _found(out)

    order = ["a", "back", "head", "part", "guest"]
    met = rows.repartition("a", "back", "head", "part").sortWithinPartitions(*order).mapInArrow(
        meet, "word string, n_near long, near_n long, near string")
    best = F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("near")))
    return met.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select(
        "word", "n_near", F.col("best.near").alias("near"), (-F.col("best.m")).alias("near_n"))


def _found(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [[], [], [], []]
    return pa.RecordBatch.from_arrays(
        [pa.array(list(c), t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.string()))],
        ["word", "n_near", "near_n", "near"])


def with_roots(words: DataFrame, factor: int = FACTOR, least: int = LEAST_N) -> DataFrame:
    """Rows (word, n, form) with `root`: the last word that forms lead to, the word itself where there is no form.

    A form is `factor` times as frequent, so chains have at most log_factor(largest n) links, and each round doubles
    the links followed.
    """
    top = words.agg(F.max("n")).first()[0] or 1
    links = max(1, math.ceil(math.log(max(top / max(least, 1), 1), factor)) + 1)
    steps = cut_lineage(words.filter("form is not null").select("word", F.col("form").alias("root")))
    for _ in range(math.ceil(math.log2(links)) + 1):
        further = steps.select(F.col("word").alias("via"), F.col("root").alias("end"))
        steps = cut_lineage(steps.join(further, F.col("root") == F.col("via"), "left").select(
            "word", F.coalesce("end", "root").alias("root")))
    return words.join(steps, "word", "left").withColumn("root", F.coalesce("root", "word"))


def variants(docs: DataFrame, every: int = EVERY, letters: int = LEAST_LETTERS, least: int = LEAST_N,
             factor: int = FACTOR, block: int = BLOCK) -> DataFrame:
    """word, n, n_near, form, form_n and root of every word of the vocabulary. A word's form is its most frequent near
    word, if that occurs at least `factor` times as often."""
    words = cut_lineage(word_counts(docs, every, letters, least))
    near = cut_lineage(words.join(near_words(words, block), "word", "left"))
    leads = F.col("near_n") >= factor * F.col("n")
    out = near.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                      F.when(leads, F.col("near")).alias("form"), F.when(leads, F.col("near_n")).alias("form_n"))
    return with_roots(out, factor, least)
