"""Alignment of two tokenizers over a corpus: which tokens of a text overlap, where both end together, and how often two ids
are linked in the whole corpus.

Both token lists of a text lie on the same bytes. ``pandas.merge_asof``, once in each direction and keyed by document, finds
for the start of each token the other side's token that covers it; the two directions together are all overlaps, and overlaps
whose ends are equal cut the text into groups."""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuemill.llm.bpe import Encoder, cut_at_blanks, vocabulary
from cuemill.llm.common import slices_by_bytes
from cuemill.session import stage

#: Documents are put together in lots of about so many tokens or distinct id pairs; a lot's pairs are looked up in one group.
LOT_TOKENS, LOT_PAIRS = 8 << 20, 400_000
GROUPS = "doc_id long, n_a long, n_b long, overlaps array<struct<a:int,b:int,together:boolean>>, groups array<struct<a:array<int>,b:array<int>>>"
LINKED = (
    "lot long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, refs binary, times binary, "
    "pairs array<long>, pair_counts array<long>"
)
COUNTED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


class Pieces:
    """A SentencePiece model: ids of a text, and the bytes of each id (a byte piece is its byte, U+2581 a blank)."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.tokens = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
        self.sizes = np.array([len(t) for t in self.tokens])
        # A piece is made by joining neighbours, so none reaches over two characters that no piece has side by side.
        joined = {"▁": re.compile("[^▁]▁"), "\n": re.compile("\n.|.\n", re.S)}
        self.marks = "".join(c for c, p in ((" ", joined["▁"]), ("\n", joined["\n"])) if not any(p.search(n) for n in names))
        self.blank = self.model.piece_to_id("▁")

    def encode(self, stretches: list[str]) -> list[list[int]] | None:
        """Ids of each stretch of a text that stands after a blank. The model puts a blank before what it is given: a stretch's
        own first blank is left to it, and before a newline its token is dropped. None if that is not possible."""
        ids = self.model.encode([s[1:] if s[0] == " " else s for s in stretches], num_threads=1)
        for k, s in enumerate(stretches):
            if s[0] != " ":
                if not ids[k] or ids[k][0] != self.blank:
                    return None
                del ids[k][0]
        return ids


@lru_cache(maxsize=2)
def piece_model(path: str) -> Pieces:
    return Pieces(path)


@dataclass
class Aligned:
    """Texts of one batch on one line of bytes. ``doc`` is the number of the text, ``start`` and ``end`` are bytes from the first
    text's first; ``overlap_a`` and ``overlap_b`` number tokens of the batch, ``together`` says that the two end at one byte."""

    n: int
    a: pd.DataFrame
    b: pd.DataFrame
    overlap_a: np.ndarray
    overlap_b: np.ndarray
    together: np.ndarray

    def ends(self) -> np.ndarray:
        """Bytes at which tokens of both sides end, in order; none twice."""
        return self.a["end"].to_numpy()[self.overlap_a[self.together]]


class Aligner:
    """Token lists of texts by both tokenizers, a blank before the text in each, and their overlaps. Stretches between certain
    cuts of both are encoded once while they are remembered, in at most about ``memory`` bytes."""

    def __init__(self, byte_bpe: str, pieces: str, memory: int = 48 << 20):
        self.bpe, self.pieces = Encoder(byte_bpe, added=False, memory=0), piece_model(pieces)
        self.sizes = np.array([len(t) for t in vocabulary(byte_bpe).tokens])
        self.memory, self.held, self.remembered, self.unlike = memory, 0, {}, set()

    def learn(self, stretches: set[str]) -> None:
        new = list(stretches)
        first = self.bpe.known(new)
        second = self.pieces.encode(new)
        if second is None:
            raise ValueError("the piece model puts no blank token before a newline")
        tokens = self.pieces.tokens
        for s, a, b in zip(new, first, second):
            if b"".join([tokens[i] for i in b]) != s.encode():
                self.unlike.add(s)
            self.remembered[s] = (a, np.array(b, "<u4").tobytes())
            self.held += 330 + 5 * len(s) + 4 * len(b)

    def encode(self, texts: list[str | None]) -> tuple[list[bytes], list[bytes]]:
        """Ids of both sides for each text; none on either where the bytes are not those of blank and text."""
        if self.held > self.memory:
            self.remembered, self.unlike, self.held = {}, set(), 0
        parts = [cut_at_blanks(" " + t, self.pieces.marks) if t else [] for t in texts]
        first, second = [], []
        self.learn(set().union(*parts).difference(self.remembered))
        for t, p in zip(texts, parts):
            both = [self.remembered[x] for x in p]
            a, b = b"".join([x for x, _ in both]), b"".join([x for _, x in both])
            if self.unlike and not self.unlike.isdisjoint(p) and b"".join([self.pieces.tokens[i] for i in np.frombuffer(b, "<u4").tolist()]) != (" " + t).encode():
                a = b = b""
            first.append(a)
            second.append(b)
        return first, second

    def align(self, texts: list[str | None]) -> Aligned:
        a, b = (self.frame(ids, sizes) for ids, sizes in zip(self.encode(texts), (self.sizes, self.pieces.sizes)))
        ka, kb = ["doc", "start", "a"], ["doc", "start", "b"]
        a["a"], b["b"] = np.arange(len(a)), np.arange(len(b))
        over_a = pd.merge_asof(a[ka], b[kb], on="start", by="doc")
        over_b = pd.merge_asof(b[kb], a[ka].assign(a_start=a["start"]), on="start", by="doc")
        # Tokens that start together are found from both sides: kept from the first.
        later = over_b["start"].to_numpy() > over_b["a_start"].to_numpy()
        left = np.concatenate([over_a["a"].to_numpy(), over_b["a"].to_numpy()[later]]).astype(np.int64)
        right = np.concatenate([over_a["b"].to_numpy(), over_b["b"].to_numpy()[later]]).astype(np.int64)
        order = np.lexsort((right, left))
        left, right = left[order], right[order]
        return Aligned(len(texts), a, b, left, right, a["end"].to_numpy()[left] == b["end"].to_numpy()[right])

    @staticmethod
    def frame(ids: list[bytes], sizes: np.ndarray) -> pd.DataFrame:
        flat = np.frombuffer(b"".join(ids), "<u4").astype(np.int64)
        ends = np.cumsum(sizes[flat])
        doc = np.repeat(np.arange(len(ids)), [len(i) // 4 for i in ids])
        return pd.DataFrame({"doc": doc, "id": flat, "start": ends - sizes[flat], "end": ends}, copy=False)


def written_groups(found: Aligned) -> list[bytes]:
    """``a1,a2|b1;a3|b2,b3`` per text: ids of both sides of each group, as digits. All texts are written at once, digit by digit."""
    ends = found.ends()
    sides = []
    for side, tokens in enumerate((found.a, found.b)):
        group = np.searchsorted(ends, tokens["end"].to_numpy())
        sides.append((2 * group + side, tokens["id"].to_numpy(), tokens["doc"].to_numpy()))
    key, ids, doc = (np.concatenate(x) for x in zip(*sides))
    order = np.argsort(key, kind="stable")
    key, ids, doc = key[order], ids[order], doc[order]
    if not len(ids):
        return [b""] * found.n
    digits = 1 + sum((ids >= 10**k).astype(np.int64) for k in range(1, 10))
    at = np.cumsum(digits + 1)
    out = np.empty(at[-1], np.uint8)
    same = np.append(key[1:] == key[:-1], False)
    out[at - 1] = np.where(same, ord(","), np.where(key % 2 == 0, ord("|"), ord(";")))
    rest = ids.copy()
    for k in range(int(digits.max())):
        hit = np.flatnonzero(digits > k)
        out[at[hit] - 2 - k] = 48 + rest[hit] % 10
        rest //= 10
    buffer = out.tobytes()
    counts = np.bincount(doc, minlength=found.n)
    lasts = np.cumsum(counts)
    stops = np.where(counts > 0, at[np.maximum(lasts - 1, 0)], 0)
    firsts = np.where(counts > 0, np.append(0, at)[lasts - counts], 0)
    return [buffer[a : b - 1] if b else b"" for a, b in zip(firsts.tolist(), stops.tolist())]


def align_documents(docs: DataFrame, byte_bpe: str, pieces: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: n_a, n_b, ``overlaps`` (places of both tokens in their lists, and whether they end together) and
    ``groups`` (ids of both sides between places where tokens of both end). ``byte_bpe`` reads a blank and the text, ``pieces``
    the text, which its model puts a blank before; special tokens' strings are plain text.

    A null or empty text, and one that a side doesn't give back byte for byte, has no tokens. Rows without id, repeated rows and
    rows with one id are aligned like all others; other columns are not read."""

    def run(batches):
        aligner = Aligner(byte_bpe, pieces)
        for part in slices_by_bytes(batches, most=1 << 18):
            found = aligner.align(part.column(1).to_pylist())
            n_a, n_b = (np.bincount(t["doc"], minlength=found.n) for t in (found.a, found.b))
            ends = found.ends()
            base_a, base_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
            doc = found.a["doc"].to_numpy()[found.overlap_a]
            overlaps = [[] for _ in range(found.n)]
            for d, x, y, t in zip(doc.tolist(), (found.overlap_a - base_a[doc]).tolist(), (found.overlap_b - base_b[doc]).tolist(), found.together.tolist()):
                overlaps[d].append({"a": x, "b": y, "together": t})
            groups = [[] for _ in range(found.n)]
            cuts = [np.append(0, np.searchsorted(t["end"].to_numpy(), ends, side="right")).tolist() for t in (found.a, found.b)]
            ids_a, ids_b = found.a["id"].tolist(), found.b["id"].tolist()
            for k, d in enumerate(found.a["doc"].to_numpy()[found.overlap_a[found.together]].tolist()):
                groups[d].append({"a": ids_a[cuts[0][k] : cuts[0][k + 1]], "b": ids_b[cuts[1][k] : cuts[1][k + 1]]})
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0), pa.array(n_a, pa.int64()), pa.array(n_b, pa.int64()),
                    pa.array(overlaps, pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("together", pa.bool_())]))),
                    pa.array(groups, pa.list_(pa.struct([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))]))),
                ],
                ["doc_id", "n_a", "n_b", "overlaps", "groups"],
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, GROUPS)


def links_by_lot(docs: DataFrame, byte_bpe: str, pieces: str, id_col: str, text_col: str, lot_tokens: int, lot_pairs: int) -> DataFrame:
    """Rows of two kinds. A document: its figures, and its distinct linked id pairs as numbers into the list of its lot (the
    steps between them) with how often it holds each. A lot: its list of pairs and their counts. A task closes a lot when it
    has ``lot_tokens`` tokens or ``lot_pairs`` pairs."""
    kinds = [pa.int64()] * 6 + [pa.string(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
    names = [c.split()[0] for c in LINKED.split(", ")]

    def rows(columns):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    def run(batches):
        aligner, number = Aligner(byte_bpe, pieces), TaskContext.get().partitionId() << 32
        known: dict[int, int] = {}
        counts, tokens = np.zeros(1024, np.int64), 0

        def close():
            return rows([[number], *[[None]] * 8, [list(known)], [counts[: len(known)].tolist()]])

        for part in slices_by_bytes(batches, most=1 << 20):
            if known and (tokens >= lot_tokens or len(known) >= lot_pairs):
                yield close()
                known, counts, tokens, number = {}, np.zeros(1024, np.int64), 0, number + 1
            found = aligner.align(part.column(1).to_pylist())
            at_a, at_b = found.overlap_a[found.together], found.overlap_b[found.together]
            doc = found.a["doc"].to_numpy()[at_a]
            pair = found.a["id"].to_numpy()[at_a] << 32 | found.b["id"].to_numpy()[at_b]
            different, inverse, times = np.unique(pair, return_inverse=True, return_counts=True)
            place = np.array([known.setdefault(p, len(known)) for p in different.tolist()], np.int64)
            if len(known) > len(counts):
                counts = np.append(counts, np.zeros(max(len(counts), len(known)), np.int64))
            counts[place] += times
            tokens += len(found.a)
            own, times = np.unique(doc << 32 | place[inverse], return_counts=True)
            owner, ref = own >> 32, own & 0xFFFFFFFF
            n_refs = np.bincount(owner, minlength=found.n)
            first = np.cumsum(n_refs) - n_refs
            step = np.diff(ref, prepend=0)
            step[first[n_refs > 0]] = ref[first[n_refs > 0]]
            steps, times = step.astype("<u4").tobytes(), times.astype("<u4").tobytes()
            n_links = np.bincount(doc, minlength=found.n)
            n_groups = np.bincount(found.a["doc"].to_numpy()[np.searchsorted(found.a["end"].to_numpy(), found.ends())], minlength=found.n) if len(doc) else n_links
            texts = written_groups(found)
            cut = [(4 * x, 4 * (x + n)) for x, n in zip(first.tolist(), n_refs.tolist())]
            yield rows(
                [
                    [number] * found.n, part.column(0).to_pylist(), np.bincount(found.a["doc"], minlength=found.n), np.bincount(found.b["doc"], minlength=found.n), n_groups, n_links,
                    [hashlib.sha256(t).hexdigest() if t else "" for t in texts], [steps[x:y] for x, y in cut], [times[x:y] for x, y in cut], [None] * found.n, [None] * found.n,
                ]
            )
        if known:
            yield close()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, LINKED)


def pair_counts(lots: DataFrame) -> DataFrame:
    """Linked id pairs of the corpus (a << 32 | b) with their counts and whether no pair of the same b has more."""
    counted = stage(lots.select(F.explode(F.arrays_zip("pairs", "pair_counts")).alias("p")).groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.pair_counts").alias("links")), "pair-counts")
    b = F.col("pair").bitwiseAND((1 << 32) - 1)
    # One row per id of the second tokenizer: never more than its vocabulary.
    most = F.broadcast(counted.groupBy(b.alias("b")).agg(F.max("links").alias("most")))
    return counted.join(most, b == F.col("b")).select("pair", "links", (F.col("links") == F.col("most")).alias("best"))


def align_corpus(docs: DataFrame, byte_bpe: str, pieces: str, id_col: str = "doc_id", text_col: str = "text", lot_tokens: int = LOT_TOKENS, lot_pairs: int = LOT_PAIRS) -> DataFrame:
    """Per row of ``docs``: n_a, n_b, n_groups, n_links (tokens of both sides that end together), n_best (links whose id pair
    has the highest count of all pairs of its b, ties included), count_sum (counts over the links) and groups_sha256. A count
    is that of the pair's links in the whole corpus.

    Texts without tokens (see ``align_documents``) have zeros and an empty digest. An empty table gives no rows. Texts are
    tokenized once. Documents refer to their pairs through the list of a lot, so that what is shuffled by pair is one row per
    lot and pair, and the counts come back as one list per lot, whatever its size; nothing of them is broadcast."""
    found = stage(links_by_lot(docs, byte_bpe, pieces, id_col, text_col, lot_tokens, lot_pairs), "links")
    lots = found.where("pairs is not null").select("lot", "pairs", "pair_counts")
    places = lots.select("lot", F.posexplode("pairs").alias("place", "pair"))
    known = places.join(pair_counts(lots), "pair").select(F.col("lot").alias("of_lot"), "place", "links", "best")
    texts = found.where("pairs is null").select("lot", *COUNTED_FROM, "refs", "times")

    def look_up(documents: pa.Table, counts: pa.Table) -> pa.Table:
        links, best = np.zeros(len(counts), np.int64), np.zeros(len(counts), bool)
        place = counts.column("place").to_numpy()
        links[place], best[place] = counts.column("links").to_numpy(), counts.column("best").to_numpy()
        n_best, sums = [], []
        for refs, times in zip(documents.column("refs").to_pylist(), documents.column("times").to_pylist()):
            at, n = np.cumsum(np.frombuffer(refs, "<u4").astype(np.int64)), np.frombuffer(times, "<u4").astype(np.int64)
            n_best.append(int(n[best[at]].sum()))
            sums.append(int((n * links[at]).sum()))
        out = {c: documents.column(c) for c in COUNTED_FROM} | {"n_best": pa.array(n_best, pa.int64()), "count_sum": pa.array(sums, pa.int64())}
        return pa.table({c.split()[0]: out[c.split()[0]] for c in COUNTED.split(", ")})

    return texts.groupBy("lot").cogroup(known.groupBy("of_lot")).applyInArrow(look_up, COUNTED)


COUNTED_FROM = [c.split()[0] for c in COUNTED.split(", ") if c.split()[0] not in ("n_best", "count_sum")]
