"""Ranked lexical search of a table of items against all documents, by buckets of vectors of like length.

A document is a vector of impacts over the terms of the items, an item a vector of how often it has each term, and the score
their product. Vectors are ordered by length. With the score an item's k-th document has at least, Cauchy and Schwarz rule out
whole buckets of vectors too short to reach it, in SQL and in the tasks; inside a bucket, the largest impact of each term and
the length that the terms read so far leave to a vector rule out single documents. What is left is scored anew in integers."""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuemill.llm.common import slices_by_bytes
from cuemill.session import stage

#: Items are searched in blocks of about so many rows and characters at most, whose terms every task holds.
BLOCK_ITEMS, BLOCK_CHARS = 4096, 16 << 20
#: Share of the vectors, the longest ones, from which the first thresholds come.
HEAD = 1 / 32
#: Bounds are worked out in doubles; widened by this they hold for the exact integers.
SLACK = 1 + 1e-9
SEPARATORS = bytes(b for b in range(128) if not (48 <= b < 58 or 65 <= b < 91 or 97 <= b < 123))
AS_TERMS = bytes.maketrans(SEPARATORS + bytes(range(65, 91)), b" " * len(SEPARATORS) + bytes(range(97, 123)))
COUNTS = "doc_id long, n long, terms array<int>, times array<long>"
VECTORS = "doc_id long, m long, norm double, terms array<int>, times array<long>"
FOUND = "row long, doc_id long, score long"


def terms_of(text: str | None) -> list[bytes]:
    """Maximal runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased."""
    return text.encode().translate(AS_TERMS).split() if text else []


def lists(values: list, sizes: list[int], kind) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(values, kind))


def count_terms(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """Documents with a term at least: number of terms with repeats, and how often each term of the vocabulary occurs."""

    def run(batches):
        wanted = vocabulary.keys()
        for part in slices_by_bytes(batches):
            ids, sizes, totals, terms, times = [], [], [], [], []
            for i, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                words = terms_of(text)
                if words:
                    counts = Counter(words)
                    hits = sorted((vocabulary[t], counts[t]) for t in wanted & counts.keys())
                    ids.append(i)
                    totals.append(len(words))
                    sizes.append(len(hits))
                    terms += [t for t, _ in hits]
                    times += [n for _, n in hits]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(totals, pa.int64()), lists(terms, sizes, pa.int32()), lists(times, sizes, pa.int64())], ["doc_id", "n", "terms", "times"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, COUNTS)


def impact(times: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * times // (1000 * times + 8 * m)


def vectors(counts: DataFrame, weights: np.ndarray, n_docs: int, n_terms: int) -> DataFrame:
    """Length of each document's vector of weighted impacts; documents with none are left out."""

    def run(batches):
        for batch in batches:
            m = 25 + 75 * batch.column(1).to_numpy() * n_docs // n_terms
            sizes = batch.column(2).value_lengths().to_numpy()
            doc = np.repeat(np.arange(len(batch)), sizes)
            v = weights[batch.column(2).flatten().to_numpy()] * impact(batch.column(3).flatten().to_numpy(), m[doc])
            norm = np.sqrt(np.bincount(doc, v.astype(float) ** 2, minlength=len(batch)))
            out = pa.RecordBatch.from_arrays([batch.column(0), pa.array(m), pa.array(norm), batch.column(2), batch.column(3)], ["doc_id", "m", "norm", "terms", "times"])
            yield out.filter(pa.array(norm > 0))

    return counts.mapInArrow(run, VECTORS)


@dataclass
class Item:
    row: int
    terms: np.ndarray
    times: np.ndarray
    norm: float
    least: int  # a score that k documents reach


class Best:
    """The k best documents of an item so far: highest scores, equal ones by id, rows without id last."""

    def __init__(self, k: int, least: int):
        self.k, self.least, self.rows = k, least, []

    def add(self, scores, ids) -> None:
        # Sorting keeps k rows at a time; a row below the k-th score never comes back.
        self.rows = sorted(self.rows + [(-s, i is None, i or 0) for s, i in zip(scores, ids) if s > 0])[: self.k]
        if len(self.rows) == self.k:
            self.least = max(self.least, -self.rows[-1][0])


class Bucket:
    """Vectors of like length, with a list of the vectors of each term."""

    def __init__(self, batch: pa.RecordBatch, weights: np.ndarray):
        self.ids, self.norm = batch.column(0), batch.column(2).to_numpy()
        self.longest = self.norm.max() * SLACK
        self.sizes = batch.column(3).value_lengths().to_numpy()
        self.first = np.cumsum(self.sizes) - self.sizes
        self.terms = batch.column(3).flatten().to_numpy()
        doc = np.repeat(np.arange(len(batch)), self.sizes)
        self.values = weights[self.terms] * impact(batch.column(4).flatten().to_numpy(), batch.column(1).to_numpy()[doc])
        order = np.argsort(self.terms, kind="stable")
        self.by_term, self.doc, self.value = self.terms[order], doc[order], self.values[order].astype(float)
        starts = np.flatnonzero(np.append(True, self.by_term[1:] != self.by_term[:-1]))
        self.span = {t: (a, b) for t, a, b in zip(self.by_term[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(order)])}
        self.most = dict(zip(self.span, np.maximum.reduceat(self.value, starts).tolist()))

    def search(self, item: Item, best: Best, scratch: np.ndarray) -> None:
        """Add to ``best`` every vector that may belong there."""
        least = max(best.least, 1)
        if item.norm * self.longest < least:
            return
        have = sorted(((n * self.most[t], t, n) for t, n in zip(item.terms.tolist(), item.times.tolist()) if t in self.most), reverse=True)
        left = sum(x[0] for x in have) * SLACK
        if left < least:
            return
        # Terms with the largest shares first, until what the others can add is too little for a vector without the first.
        seen, rest = np.zeros(len(self.norm)), self.norm**2
        unread = item.norm**2
        for share, t, n in have:
            if left < least and len(have) > 1:
                break
            a, b = self.span[t]
            seen[self.doc[a:b]] += n * self.value[a:b]
            rest[self.doc[a:b]] -= self.value[a:b] ** 2
            unread -= float(n) ** 2
            left -= share * SLACK
        room = np.minimum(max(left, 0.0) * SLACK, np.sqrt(max(unread, 0.0) * np.maximum(rest, 0.0)) * SLACK + 1e-6 * self.norm) if left > 0 else 0.0
        hit = np.flatnonzero((seen > 0) & ((seen + room) * SLACK >= least))
        if len(hit):
            scratch[item.terms] = item.times
            sizes = self.sizes[hit]
            at = np.repeat(self.first[hit] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
            scores = np.add.reduceat(scratch[self.terms[at]] * self.values[at], np.cumsum(sizes) - sizes)
            scratch[item.terms] = 0
            good = scores >= least
            best.add(scores[good].tolist(), self.ids.take(pa.array(hit[good])).to_pylist())


def search_vectors(found: DataFrame, items: list[Item], weights: np.ndarray, k: int, bucket_rows: int = 4096) -> DataFrame:
    """For each task and item, the k best vectors that reach the item's least score."""

    def run(batches):
        best, scratch = [Best(k, i.least) for i in items], np.zeros(len(weights), np.int64)
        for batch in batches:
            for at in range(0, len(batch), bucket_rows):
                bucket = Bucket(batch.slice(at, bucket_rows), weights)
                for item, b in zip(items, best):
                    bucket.search(item, b, scratch)
        rows = [(i.row, None if none else d, -s) for i, b in zip(items, best) for s, none, d in b.rows]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else ([], [], []))], ["row", "doc_id", "score"])

    return found.mapInArrow(run, FOUND)


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search_block(docs: DataFrame, asked: list, k: int, id_col: str, text_col: str) -> DataFrame | None:
    """Rows (row, rank, doc_id, score) for the items (row, text) of one block; None if none of them has a term."""
    bags = {r["row"]: Counter(terms_of(r["text"])) for r in asked}
    vocabulary = {t: i for i, t in enumerate(sorted(set().union(*bags.values())))}
    if not vocabulary:
        return None
    counts = stage(count_terms(docs, vocabulary, id_col, text_col), "term-counts")
    total = counts.agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
    if not total["docs"]:
        return None
    df = np.zeros(len(vocabulary), np.int64)
    for r in counts.select(F.explode("terms").alias("term")).groupBy("term").count().toLocalIterator():
        df[r["term"]] = r["count"]
    weights = np.array([math.floor(1000 * math.log((2 * total["docs"] + 2) / (2 * d + 1))) if d else 0 for d in df.tolist()], np.int64)
    by_length = vectors(counts, weights, total["docs"], total["terms"]).repartitionByRange(F.desc("norm"), F.col("doc_id"))
    by_length = stage(by_length.sortWithinPartitions(F.desc("norm")), "vectors")

    items = []
    for row, bag in bags.items():
        at = np.array([vocabulary[t] for t in bag], np.int64)
        times = np.array(list(bag.values()), np.int64)
        some = df[at] > 0
        if some.any():
            items.append(Item(row, at[some], times[some], float(np.sqrt((times[some].astype(float) ** 2).sum())), 0))
    if not items:
        return None
    # Buckets of lengths within a quarter of a power of two: a few hundred rows at most.
    sizes = {r["bucket"]: r["count"] for r in by_length.groupBy(F.floor(4 * F.log2("norm")).alias("bucket")).count().collect()}
    wanted, cut = HEAD * sum(sizes.values()), 0.0
    for b in sorted(sizes, reverse=True):
        wanted -= sizes[b]
        cut = 2.0 ** (b / 4)
        if wanted <= 0:
            break
    head = stage(ranked(search_vectors(by_length.where(F.col("norm") >= cut), items, weights, k), k), "head")
    reached = {r["row"]: r["score"] for r in head.where(F.col("rank") == k).select("row", "score").collect()}
    for i in items:
        i.least = reached.get(i.row, 0)
    shortest = min(i.least / i.norm for i in items) / SLACK
    rest = by_length.where((F.col("norm") < cut) & (F.col("norm") >= shortest))
    return ranked(head.select("row", "doc_id", "score").unionByName(search_vectors(rest, items, weights, k)), k)


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
           block_items: int = BLOCK_ITEMS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The ``k`` documents of highest score above 0 for each row of ``items``: item_id, rank from 1, doc_id, score.

    A term's weight is floor(1000 ln((2N+2)/(2df+1))); its impact (10^9 tf) div (1000 tf + 8 m) with m = 25 + (75 n N) div L, for N
    documents that have a term, L terms in all, n in the document. Equal scores are ordered by id, rows without id last. Null,
    empty and term-less texts match nothing. Every row of either table counts by itself: repeated documents are ranked one after
    the other, and rows of items with one id each get ranks of their own. Other columns are not read.

    Items are taken in blocks with a bound on rows and characters (a longer item is a block's surplus), whose terms and
    thresholds go to the tasks; each block reads all documents once. Documents reach the driver only as the k results of items."""
    rows = stage(items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text")).withColumn("row", F.monotonically_increasing_id()), "items")
    size = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).first()
    blocks = max(1, -(-size["n"] // block_items), -(-size["chars"] // block_chars))
    made = [search_block(docs, rows.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == b).collect(), k, id_col, text_col) for b in range(blocks)]
    made = [m for m in made if m is not None]
    schema = rows.select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score"))
    if not made:
        return schema.where(F.lit(False))
    found = made[0]
    for m in made[1:]:
        found = found.unionByName(m)
    return found.join(rows.select("row", "item_id"), "row").select(*schema.columns)
