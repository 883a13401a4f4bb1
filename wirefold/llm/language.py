"""Language identification of mixed text: script ranges, word scores and Viterbi spans.

Training counts letter trigrams of words (on UTF-8 bytes, hashed) and the scripts of words per language. A word's
candidates are the languages that use its script; their scores are the trigram log-likelihoods, cut off at a distance
from the best. The best path through a text's words, where every change of language costs a penalty, gives the spans; the
language with most letters is the prediction, its share of the letters the score. Where no language gains more than the
penalty on the best one over any stretch, nor over a first and a last stretch together, the path is the one-language path,
and the dynamic programme need not run.

Defined results: `und` with score 0 for null and empty texts and texts without a letter; `und` for all texts when nothing
could be learned; letters in scripts that no language uses are scored alike for all; rows repeat as they come.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wirefold.llm import words
from wirefold.llm.common import pick
from wirefold.llm.text_map import append_columns

BITS = 16
PENALTY = 12.0
FLOOR = 6.0
SCRIPT_SHARE = 0.01
# First code point of each range and its script (fixed values of the Unicode blocks).
RANGES = [(0x0, "latin"), (0x250, "other"), (0x370, "greek"), (0x400, "cyrillic"), (0x530, "armenian"),
          (0x590, "hebrew"), (0x600, "arabic"), (0x700, "other"), (0x750, "arabic"), (0x780, "other"),
          (0x900, "devanagari"), (0x980, "bengali"), (0xA00, "gurmukhi"), (0xA80, "gujarati"), (0xB00, "other"),
          (0xB80, "tamil"), (0xC00, "telugu"), (0xC80, "kannada"), (0xD00, "malayalam"), (0xD80, "other"),
          (0xE00, "thai"), (0xE80, "lao"), (0xF00, "other"), (0x10A0, "georgian"), (0x1100, "hangul"),
          (0x1200, "ethiopic"), (0x1380, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"),
          (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"),
          (0xD7B0, "other"), (0x20000, "han")]
SCRIPTS = sorted({s for _, s in RANGES})
_FIRST = np.array([a for a, _ in RANGES])
_SCRIPT = np.array([SCRIPTS.index(s) for _, s in RANGES])
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = _LETTER[65:91] = _LETTER[128:] = True
_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[65:91] += 32
_FOLD[words._SPACE] = 32


@dataclass
class Model:
    languages: list[str]
    grams: np.ndarray  # log-likelihood by gram and language
    allowed: np.ndarray  # by script and language


def _chunks(data: np.ndarray, offs: np.ndarray, bits: int = BITS):
    """Of each chunk: place, positions of letters, their grams, word starts, number of letters and script by word."""
    for a, part, space, s in words.chunks(data, offs):
        if not len(s):
            continue
        end = a + len(part)
        fold = np.concatenate([[32], _FOLD[part], [32]]).astype(np.uint32)
        # a word ends where the text ends, even if the next text begins at once
        fold_before, fold_after = fold[:-2].copy(), fold[2:].copy()
        fold_before[s] = 32
        fold_after[s[1:] - 1] = 32
        at = np.flatnonzero(_LETTER[part])
        key = (fold_before[at] << np.uint32(16)) | (fold[1:-1][at] << np.uint32(8)) | fold_after[at]
        gram = ((key * np.uint32(2654435761)) >> np.uint32(32 - bits)).astype(np.int64)
        edge = np.searchsorted(at, np.append(s, len(part)))
        n = np.diff(edge)
        script = np.full(len(s), -1)
        has = np.flatnonzero(n > 0)
        b = part[at[edge[has]]].astype(np.int64)
        p = at[edge[has]]
        byte = lambda k: part[np.minimum(p + k, len(part) - 1)].astype(np.int64) & 0x3F  # noqa: B023, E731
        code = np.select([b < 128, b < 0xE0, b < 0xF0], [
            b, (b & 0x1F) << 6 | byte(1), (b & 0x0F) << 12 | byte(1) << 6 | byte(2)],
            (b & 0x07) << 18 | byte(1) << 12 | byte(2) << 6 | byte(3))
        script[has] = _SCRIPT[np.searchsorted(_FIRST, code, "right") - 1]
        yield a, end, at, gram, s, edge, n, script


def train(docs: DataFrame, bits: int = BITS, allowed=None) -> Model:
    """Counts over all documents with a language (those that `allowed` selects). The table that reaches the driver has
    at most 2^bits rows and a row per script for each language."""
    d = pick(docs, doc_id="doc_id", text="text", lang="lang").filter("lang is not null and text is not null")
    d = (d.filter(allowed) if allowed is not None else d).select("text", "lang")

    def count(batches):
        for batch in batches:
            data, offs = words.utf8(batch["text"])
            lang, names = batch["lang"].to_pylist(), sorted(set(batch["lang"].to_pylist()))
            number = np.array([names.index(x) for x in lang])
            grams = np.zeros((len(names), 1 << bits), np.int64)
            scripts = np.zeros((len(names), len(SCRIPTS)), np.int64)
            for a, _, at, gram, s, _, _, script in _chunks(data, offs, bits):
                of = number[np.searchsorted(offs, at + a, "right") - 1]
                grams += np.bincount(of * (1 << bits) + gram, minlength=grams.size).reshape(grams.shape)
                of = number[np.searchsorted(offs, s + a, "right") - 1]
                ok = script >= 0
                scripts += np.bincount(of[ok] * len(SCRIPTS) + script[ok], minlength=scripts.size).reshape(scripts.shape)
            for kind, table in (("g", grams), ("s", scripts)):
                i, j = np.nonzero(table)
                yield pa.RecordBatch.from_arrays([
                    pa.array([names[k] for k in i], pa.string()), pa.array([kind] * len(i), pa.string()),
                    pa.array(j, pa.int32()), pa.array(table[i, j])], ["lang", "kind", "at", "n"])

    got = d.mapInArrow(count, "lang string, kind string, at int, n long").groupBy("lang", "kind", "at").agg(
        F.sum("n").alias("n")).toPandas()
    names = sorted(got["lang"].unique())
    grams = np.zeros((1 << bits, len(names)))
    scripts = np.zeros((len(SCRIPTS), len(names)))
    number = got["lang"].map({x: i for i, x in enumerate(names)}).to_numpy(dtype=np.int64)
    for kind, to in (("g", grams), ("s", scripts)):
        rows = (got["kind"] == kind).to_numpy()
        to[got["at"].to_numpy()[rows], number[rows]] = got["n"].to_numpy()[rows]
    if not names:
        return Model([], grams, scripts > 0)
    smooth = 0.5
    log = np.log((grams + smooth) / (grams.sum(0) + smooth * (grams.sum(1) > 0).sum() + smooth))
    return Model(names, log.astype(np.float32), scripts >= SCRIPT_SHARE * np.maximum(scripts.sum(0), 1))


def best_path(scores: np.ndarray, penalty: float) -> np.ndarray:
    """Language number of each word on the best path."""
    top = int(scores.sum(0).argmax())
    total = np.cumsum(scores - scores[:, top:top + 1], 0)
    low = np.minimum(np.minimum.accumulate(np.vstack([np.zeros(scores.shape[1]), total[:-1]]), 0), 0)
    # A path of k changes has a first stretch, a last one and k - 1 between; their gains over the best single language
    # cannot pay k penalties if first and last together gain at most one and no stretch gains more than one.
    last = np.minimum(low[-1], total[-1])
    if (total - low).max() <= penalty and max(total.max(), 0) + (total[-1] - last).max() <= penalty:
        return np.full(len(scores), top)
    value, back = [0.0] * scores.shape[1], []
    for row in scores.tolist():
        k = max(range(len(value)), key=value.__getitem__)
        switch = value[k] - penalty
        back.append([i if v >= switch else k for i, v in enumerate(value)])
        value = [max(v, switch) + x for v, x in zip(value, row)]
    path = np.empty(len(scores), np.int64)
    at = max(range(len(value)), key=value.__getitem__)
    for t in range(len(scores) - 1, -1, -1):
        path[t] = at
        at = back[t][at]
    return path


def label_texts(column: pa.Array, model: Model, penalty: float = PENALTY, floor: float = FLOOR):
    """Per text: language, score and spans (language, first and end code point)."""
    data, offs = words.utf8(column)
    n_texts, n_lang = len(offs) - 1, len(model.languages)
    text_at, starts, letters, scores = [], [], [], []
    for a, _, at, gram, s, edge, n, script in _chunks(data, offs):
        if not n_lang:
            break
        keep = n > 0
        if not keep.any():
            continue
        each = model.grams[gram]
        w = np.add.reduceat(each, edge[:-1][keep], axis=0).astype(np.float64)
        may = model.allowed[script[keep]]
        none = ~may.any(1)
        w[~may] = -np.inf
        w[none] = 0.0
        w = np.maximum(w - w.max(1, keepdims=True), -floor)
        scores.append(w)
        letters.append(n[keep])
        starts.append(s[keep] + a)
    if scores:
        scores, letters, starts = np.concatenate(scores), np.concatenate(letters), np.concatenate(starts)
        text_at = np.searchsorted(starts, offs)
    points = np.append(0, np.cumsum((data & 0xC0) != 0x80))
    texts = column.to_pylist()
    lang, score, spans = ["und"] * n_texts, [0.0] * n_texts, [[] for _ in range(n_texts)]
    for i in range(n_texts):
        if not len(text_at) or text_at[i] == text_at[i + 1] or not any(map(str.isalpha, texts[i])):
            continue
        r = slice(text_at[i], text_at[i + 1])
        path = best_path(scores[r], penalty)
        share = np.bincount(path, letters[r], n_lang)
        top = int(share.argmax())
        lang[i], score[i] = model.languages[top], float(share[top] / share.sum())
        turn = np.append(0, np.flatnonzero(path[1:] != path[:-1]) + 1)
        at = points[np.append(starts[r][turn], offs[i + 1])] - points[offs[i]]
        at[0] = 0
        spans[i] = [{"lang": model.languages[path[t]], "start": int(x), "end": int(y)}
                    for t, x, y in zip(turn, at, at[1:])]
    return lang, score, spans


_SPAN = pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def with_languages(docs: DataFrame, model: Model, penalty: float = PENALTY) -> DataFrame:
    """docs with lang_pred, lang_score and lang_spans of every whole text."""
    def make(column):
        lang, score, spans = label_texts(column, model, penalty)
        return [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(spans, _SPAN)]

    span = T.StructType([T.StructField("lang", T.StringType()), T.StructField("start", T.LongType()),
                         T.StructField("end", T.LongType())])
    return append_columns(docs, make, [T.StructField("lang_pred", T.StringType()), T.StructField(
        "lang_score", T.DoubleType()), T.StructField("lang_spans", T.ArrayType(span))])
