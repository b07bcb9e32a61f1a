"""Language identification with hyperdimensional profiles of letter n-grams."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuemill.session import stage

UNKNOWN = "und"


class Letters:
    """Random +1/-1 vectors per character, drawn from a seed and the character, and the symbols of texts."""

    def __init__(self, dims: int, seed: int):
        self.dims, self.seed = dims, seed
        self.kind = np.full(0x110000, -1, np.int8)
        self.vectors: dict[int, np.ndarray] = {}

    def symbols(self, text: str) -> np.ndarray:
        """Lower-case letters; each stretch of other characters, and both ends, are one 0."""
        points = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
        for p in np.unique(points[self.kind[points] < 0]).tolist():
            self.kind[p] = chr(p).isalpha()
        s = np.concatenate([[0], np.where(self.kind[points] == 1, points, 0), [0]]).astype(np.int64)
        return s[np.concatenate([[True], (s[1:] != 0) | (s[:-1] != 0)])]

    def table(self, symbols: np.ndarray) -> np.ndarray:
        for s in symbols.tolist():
            if s not in self.vectors:
                self.vectors[s] = np.random.default_rng([self.seed, s]).integers(0, 2, self.dims, np.int8) * 2 - 1
        return np.array([self.vectors[s] for s in symbols.tolist()], np.int8)


def gram_counts(texts: list[np.ndarray], n: int):
    """Symbols used, and per text the counts of its n-grams of symbols: (symbols, grams as places in them, text, gram, count)."""
    owner = np.repeat(np.arange(len(texts)), [max(len(t) - n + 1, 0) for t in texts])
    symbols, place = np.unique(np.concatenate(texts), return_inverse=True)
    at = np.cumsum([0, *map(len, texts)])[:-1]
    begin = np.arange(len(owner)) + (at - np.cumsum([0, *[max(len(t) - n + 1, 0) for t in texts]])[:-1])[owner]
    code = np.zeros(len(owner), np.int64)
    for i in range(n):
        code = code * len(symbols) + place[begin + i]
    kinds, code = np.unique(code, return_inverse=True)
    pair, count = np.unique(owner * max(len(kinds), 1) + code, return_counts=True)
    grams = np.array([kinds // len(symbols) ** (n - 1 - i) % len(symbols) for i in range(n)])
    return symbols, grams, pair // max(len(kinds), 1), pair % max(len(kinds), 1), count


def bundles(texts: list[np.ndarray], n: int, letters: Letters, rows: np.ndarray, groups: int) -> np.ndarray:
    """Sum of the n-gram vectors of the texts of each group (``rows``: a text's group). An n-gram's vector binds its letters by
    multiplication, each permuted (rotated) by its distance to the last. Sums are whole numbers, the same in any order."""
    symbols, grams, text, gram, count = gram_counts(texts, n)
    letter = letters.table(symbols)
    total = np.zeros((groups, letters.dims), np.int64)
    for a in range(0, grams.shape[1], 8192):
        part = grams[:, a : a + 8192]
        bound = np.ones((part.shape[1], letters.dims), np.int8)
        for i in range(n):
            bound *= np.roll(letter, n - 1 - i, axis=1)[part[i]]
        here = (gram >= a) & (gram < a + 8192)
        weights = np.zeros((groups, part.shape[1]), np.float64 if count.sum() > 1 << 22 else np.float32)
        np.add.at(weights, (rows[text[here]], gram[here] - a), count[here])
        total += (weights @ bound.astype(weights.dtype)).astype(np.int64)
    return total


def lots(rows: list[tuple], letters: Letters, size: int = 400_000, most: int = 128):
    """Rows with the symbols of their text, in lots of about ``size`` characters."""
    lot, held = [], 0
    for r in rows:
        s = letters.symbols(r[1] or "")
        lot.append((*r, s))
        held += len(s)
        if held > size or len(lot) >= most:
            yield lot
            lot, held = [], 0
    if lot:
        yield lot


def learn_profiles(docs: DataFrame, n: int = 3, dims: int = 512, seed: int = 23, most: int = 4096) -> dict[str, np.ndarray]:
    """Prototype per language from ``docs`` (text, lang): the bundle of all n-grams of all its texts.

    Each task adds up its texts, Spark adds up the tasks. The result is one vector of ``dims`` per language; more than ``most``
    different languages are an error, so what comes to the driver is bounded."""

    def run(batches):
        letters, sums = Letters(dims, seed), defaultdict(lambda: np.zeros(dims, np.int64))
        for batch in batches:
            for lot in lots(list(zip(batch.column(1).to_pylist(), batch.column(0).to_pylist())), letters):
                names = sorted({r[0] for r in lot})
                rows = np.array([names.index(r[0]) for r in lot])
                for name, v in zip(names, bundles([r[2] for r in lot], n, letters, rows, len(names))):
                    sums[name] += v
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.int64()))], ["lang", "sums"])

    used = docs.where("text is not null and lang is not null").select("text", "lang")
    added = used.mapInArrow(run, "lang string, sums array<long>").select("lang", F.posexplode("sums").alias("dim", "x")).groupBy("lang", "dim").agg(F.sum("x").alias("x"))
    profiles = stage(added.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("dim", "x"))).alias("v")).select("lang", F.col("v.x").alias("v")), "profiles")
    if profiles.count() > most:
        raise ValueError(f"more than {most} languages")
    return {r["lang"]: np.array(r["v"], np.float64) for r in profiles.orderBy("lang").collect()}


def identify(docs: DataFrame, profiles: dict[str, np.ndarray], n: int = 3, dims: int = 512, seed: int = 23) -> DataFrame:
    """(id, lang_pred, score) for ``docs`` (id, text): the language whose prototype has the largest cosine with the document's bundle,
    and that cosine (0 at least). Ties: the first language by code point. Null text, no letter or no prototype: ``und``, 0."""
    names = list(profiles)
    unit = np.array([v / max(np.linalg.norm(v), 1e-9) for v in profiles.values()]).reshape(len(names), dims)

    def run(batches):
        letters = Letters(dims, seed)
        for batch in batches:
            ids, found, scores = [], [], []
            for lot in lots(list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())), letters):
                v = bundles([r[2] for r in lot], n, letters, np.arange(len(lot)), len(lot)).astype(np.float64)
                cosine = v @ unit.T / np.maximum(np.linalg.norm(v, axis=1), 1e-9)[:, None] if names else np.zeros((len(lot), 1))
                best = cosine.argmax(axis=1)
                for k, (i, text, symbols) in enumerate(lot):
                    known = bool(names) and text is not None and bool(symbols.any())
                    ids.append(i), found.append(names[best[k]] if known else UNKNOWN)
                    scores.append(min(1.0, max(0.0, float(cosine[k, best[k]]))) if known else 0.0)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.string()), pa.array(scores, pa.float64())], ["id", "lang_pred", "score"])

    return docs.select("id", "text").mapInArrow(run, "id long, lang_pred string, score double")


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", n: int = 3, dims: int = 512, seed: int = 23) -> DataFrame:
    """Predict the language of every document: id, held_out, lang_pred, score.

    Two thirds of the documents teach: those with a language and crc32(id as text) mod 3 other than 1. A prediction sees the
    text alone. ``score`` is the cosine, from 0 to 1.

    * Null text or a text without letters: ``und``, 0. Null language or null id: does not teach; null id counts as not held out.
    * Repeated rows teach and are predicted each; an empty table gives no rows; other columns are not read."""
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    fold = F.crc32(F.col("id").cast("string")) % 3
    found = identify(d, learn_profiles(d.where(fold != 1), n, dims, seed), n, dims, seed)
    return found.select(F.col("id").alias(id_col), F.coalesce(fold == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")
