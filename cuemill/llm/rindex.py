"""Substring dedup over a whole corpus: content-defined anchors bring equal passages together, a run-length index marks them."""

from __future__ import annotations

import hashlib
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuemill.llm.minhash import GOLDEN, mixed

GRAM = 20
PIECE = 1 << 23
_rng = np.random.default_rng(50)
LETTERS = _rng.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
BASE = int(_rng.integers(1 << 61, 1 << 62)) * 2 + 1
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE to the 0 .. n and its inverses, modulo 2 to the 64."""
    if len(_powers[0]) <= n:
        for i, b in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            p = np.full(max(n + 1, 1 << 20), b, np.uint64)
            p[0] = 1
            _powers[i] = np.multiply.accumulate(p)
    return _powers[0][: n + 1], _powers[1][: n + 1]


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if width > have else x


def passages(texts: list[bytes], length: int):
    """Cut all windows of ``length`` bytes into runs that share their anchor: (text number, start, bytes, anchor, content,
    left, right).

    The anchor of a window is its ``GRAM``-byte string of least hash, so equal windows have equal anchors, wherever they lie.
    A run of windows with one anchor is one stretch of at most 2 x length - GRAM bytes; ``content`` is the hash of it. A window
    reaches half of its other bytes or more to one side of the anchor, so two stretches with a window in common agree in
    ``left`` or in ``right``, the 16-bit hashes of so many bytes before and after the anchor (0: the stretch has fewer)."""
    parts, group, held = [], [], 0
    for i, t in enumerate(texts):
        for a in range(0, max(len(t) - length + 1, 0), PIECE):
            group.append((i, a, t[a : a + PIECE + length - 1]))
            held += len(group[-1][2])
            if held >= PIECE:
                parts.append(_passages(group, length))
                group, held = [], 0
    if group:
        parts.append(_passages(group, length))
    kinds = (np.int64, np.int64, np.int64, np.uint64, np.uint64, np.uint16, np.uint16)
    return [np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, kinds[k]) for k in range(7)]


def _passages(group, length: int):
    sizes = np.array([len(t) for _, _, t in group])
    data = np.frombuffer(b"".join(t for _, _, t in group), np.uint8)
    n = len(data)
    up, down = powers(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(LETTERS[data] * up[:n], out=total[1:])
    grams = mixed((total[GRAM:] - total[:-GRAM]) * down[: n - GRAM + 1])
    low = np.uint64((1 << 24) - 1)
    least = sliding_min((grams & ~low) | np.arange(len(grams), dtype=np.uint64), length - GRAM + 1)
    anchor_at = (least & low).astype(np.int64)
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(group)), sizes - length + 1)
    window = np.arange(len(owner)) + owner * (length - 1)
    at = anchor_at[window]
    new = np.concatenate([[True], (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(owner)))
    begin, bytes_ = window[first], count + length - 1
    content = mixed((total[begin + bytes_] - total[begin]) * down[begin] + bytes_.astype(np.uint64))
    half, place = -(-(length - GRAM) // 2), at[first]

    def side(a: np.ndarray, there: np.ndarray) -> np.ndarray:
        a = np.where(there, a, 0)
        h = mixed((total[a + half] - total[a]) * down[a])
        return np.where(there, h % np.uint64(65535) + np.uint64(1), 0).astype(np.uint16)

    left, right = side(place - half, place - half >= begin), side(place + GRAM, place + GRAM + half <= begin + bytes_)
    item = owner[first]
    number, shift = np.array([i for i, _, _ in group]), np.array([a for _, a, _ in group])
    return number[item], shift[item] + begin - (ends - sizes)[item], bytes_, grams[place], content, left, right


class RunLengthIndex:
    """Run-compressed Burrows-Wheeler transform of short stretches, each with the document it is from.

    Suffixes are sorted by prefix doubling. The transform is kept as runs: first row, byte, occurrences of the byte before.
    A run also ends where the first ``length`` bytes of the suffixes change, and each run keeps a sample, the smallest
    document of its rows. ``earlier`` streams all stretches backwards through the runs and gives the windows whose
    ``length`` bytes also start in a smaller document: there the matching statistic against smaller documents is ``length``
    or more."""

    def __init__(self, data: np.ndarray, sizes: np.ndarray, docs: np.ndarray, length: int):
        self.sizes, self.docs, self.length = sizes, docs, length
        count, n = len(sizes), len(data) + len(sizes)
        ends = np.cumsum(sizes + 1) - 1  # of the terminators
        text = np.zeros(n, np.int64)
        owner = np.repeat(np.arange(count), sizes + 1)
        inner = np.ones(n, bool)
        inner[ends] = False
        text[inner] = data.astype(np.int64) + 1
        left = ends[owner] - np.arange(n)  # bytes up to the terminator

        depth = 7
        key = np.zeros(n, np.int64)
        padded = np.concatenate([text, np.zeros(depth, np.int64)])
        for i in range(depth):
            key = key * 257 + np.where(left >= i, padded[i : i + n], 0)
        rank, equal = self._ranks(key), {}
        while depth <= 2 * length:
            equal[depth] = rank
            # Suffixes that end within ``depth`` are told apart by their stretch: its terminator is unlike all others.
            follow = np.where(left >= depth, count + rank[np.minimum(np.arange(n) + depth, n - 1)], owner)
            rank = self._ranks(rank * (n + count + 1) + follow)
            depth *= 2
        rows = np.empty(n, np.int64)
        rows[rank] = np.arange(n)  # all suffixes differ now

        half = max(d for d in equal if d <= length)
        shift = length - half
        long = left >= length
        ok = long[rows]
        a, b = rows[:-1], rows[1:]
        top = equal[half]
        same = ok[:-1] & ok[1:] & (top[a] == top[b]) & (top[np.minimum(a + shift, n - 1)] == top[np.minimum(b + shift, n - 1)])
        before = np.where(rows > 0, text[rows - 1], 0)
        classes = np.concatenate([[True], ~same])
        runs = np.flatnonzero(classes | np.concatenate([[True], before[1:] != before[:-1]]))
        self.starts, self.chars = runs, before[runs]
        lengths = np.diff(np.append(runs, n))
        self.base = np.zeros(len(runs), np.int64)
        smaller = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=258))])
        by_char = np.argsort(self.chars, kind="stable")
        running = np.cumsum(lengths[by_char]) - lengths[by_char]
        first = np.searchsorted(self.chars[by_char], np.arange(258))
        offset = running[np.minimum(first, len(runs) - 1)]
        self.base[by_char] = smaller[self.chars[by_char]] + running - offset[self.chars[by_char]]
        sample = np.minimum.reduceat(docs[owner[rows]], runs)
        class_start = np.flatnonzero(classes[runs])
        self.least = np.repeat(np.minimum.reduceat(sample, class_start), np.diff(np.append(class_start, len(runs))))

    @staticmethod
    def _ranks(key: np.ndarray) -> np.ndarray:
        by = np.argsort(key, kind="stable")
        new = np.concatenate([[0], np.cumsum(key[by][1:] != key[by][:-1])])
        rank = np.empty(len(key), np.int64)
        rank[by] = new
        return rank

    def earlier(self):
        """(stretch, start of the window in it) of the windows that also start in a smaller document."""
        live = np.arange(len(self.sizes))
        row = live.copy()  # the suffix of the terminator alone
        found = []
        for step in range(1, int(self.sizes.max(initial=0)) + 1):
            stay = self.sizes[live] >= step
            live, row = live[stay], row[stay]
            run = np.searchsorted(self.starts, row, side="right") - 1
            row = self.base[run] + row - self.starts[run]
            if step >= self.length:
                run = np.searchsorted(self.starts, row, side="right") - 1
                hit = self.least[run] < self.docs[live]
                found.append((live[hit], (self.sizes[live] - step)[hit]))
        return tuple(np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))


def spans_of(key: np.ndarray, start: np.ndarray, end: np.ndarray):
    """Union of spans per key: sorted, touching spans joined."""
    by = np.lexsort((start, key))
    key, start, end = key[by], start[by], end[by]
    if not len(key):
        return key, start, end
    # The furthest end so far inside each key: keys are set apart by more than any end.
    step = int(end.max()) + 2
    group = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
    reach = np.maximum.accumulate(end + group * step) - group * step
    new = np.concatenate([[True], (group[1:] != group[:-1]) | (start[1:] > reach[:-1])])
    first = np.flatnonzero(new)
    return key[first], start[first], reach[np.append(first[1:], len(key)) - 1]


def _sorted_docs(table: pa.Table) -> tuple[np.ndarray, list[bytes]]:
    """Ids and texts of a lot, in an order that any attempt repeats."""
    rows = sorted(zip(table.column("id").to_pylist(), ((t or "").encode() for t in table.column("text").to_pylist())))
    return np.array([i for i, _ in rows], np.int64), [t for _, t in rows]


class Lot:
    """The stretches of a lot, and one of each kind (anchor and content) that speaks for them: that of the smallest document.
    The others of a kind lie in larger documents of the lot, or again in that one."""

    def __init__(self, table: pa.Table, length: int, buckets: int):
        self.ids, self.texts = _sorted_docs(table)
        self.number, self.start, self.size, self.anchor, self.content, self.left, self.right = passages(self.texts, length)
        self.id = self.ids[self.number] if len(self.number) else np.zeros(0, np.int64)
        # Texts are in order of id, so the first of a kind is in the smallest document.
        _, first, self.kind = np.unique(mixed(self.anchor + self.content * np.uint64(3)), return_index=True, return_inverse=True)
        bucket = ((self.anchor[first] >> np.uint64(16)) % np.uint64(buckets)).astype(np.int64)
        self.by = np.lexsort((first, bucket))
        self.asked, self.bucket, self.first = first[self.by], bucket[self.by], first


def pack_anchors(anchor: np.ndarray) -> bytes:
    """The low six bytes of each; what is left out only makes more anchors seem equal, which is looked into later."""
    return np.ascontiguousarray(anchor).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpack_anchors(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return wide.view(np.uint64).ravel()


def answers(blobs: list[list[bytes]], crowd: int) -> list[np.ndarray]:
    """For each stretch asked about in one bucket (anchors, contents, lefts, rights, ids): 0 nothing like it elsewhere, 1 the same
    stretch is in a smaller document, 2 other stretches have its anchor and agree to one side of it, 3 so do more than
    ``crowd`` different ones."""
    anchor = np.concatenate([unpack_anchors(b[0]) for b in blobs])
    content, left, right = (np.concatenate([np.frombuffer(b[k], t) for b in blobs]) for k, t in ((1, np.uint64), (2, np.uint16), (3, np.uint16)))
    ids = np.concatenate([np.cumsum(np.frombuffer(b[4], np.int64)) for b in blobs])
    by = np.argsort(anchor, kind="stable")
    same = anchor[by][1:] == anchor[by][:-1]
    pick = by[np.concatenate([[False], same]) | np.concatenate([same, [False]])]
    code = np.zeros(len(anchor), np.uint8)
    if len(pick):
        pick = pick[np.lexsort((ids[pick], content[pick], anchor[pick]))]
        a, c = anchor[pick], content[pick]
        new_anchor = np.concatenate([[True], a[1:] != a[:-1]])
        new = new_anchor | np.concatenate([[True], c[1:] != c[:-1]])
        first, kind = np.flatnonzero(new), np.cumsum(new) - 1
        least = ids[pick][first][kind]
        agrees = np.zeros(len(first), bool)
        for side in (left, right):
            own = side[pick][first].astype(np.uint64)
            _, which, count = np.unique(mixed(a[first] + own * GOLDEN), return_inverse=True, return_counts=True)
            agrees |= (own > 0) & (count[which] > 1)
        start = np.flatnonzero(new_anchor[first])
        several = np.repeat(np.add.reduceat(agrees.astype(np.int64), start), np.diff(np.append(start, len(first))))
        code[pick] = np.where(ids[pick] > least, 1, np.where(~agrees[kind], 0, np.where(several[kind] > crowd, 3, 2)))
    return np.split(code, np.cumsum([len(b[1]) // 8 for b in blobs])[:-1])


def drop_repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50, lot_bytes: int = 4_000_000, bucket_rows: int = 100_000, crowd: int = 20_000) -> DataFrame:
    """Remove each byte of a text that a ``length``-byte string covers which also starts in a document with a smaller id.

    Returns id, n_bytes, n_removed, n_spans, ``spans`` (start, end: the maximal removed runs) and ``kept`` (bytes) per row; other columns
    are not read. Texts are UTF-8 bytes; cuts may fall inside a character. Strings are judged on the input and stay inside one text.

    * Null or empty text: nothing to remove. Texts shorter than ``length`` lose nothing.
    * Rows with one id are one document: they do not match each other; each row is judged. Rows without id take no part and
      stay whole. Repeated rows give repeated results; an empty table gives no rows.

    1. Documents are dealt by id into lots of about ``lot_bytes``; Spark reuses this one shuffle of the texts in all three passes.
    2. Each lot cuts its windows into stretches by anchor and asks the anchor's bucket: (anchor, hashes of the stretch and of the
       bytes to both sides of the anchor, smallest id in the lot). A stretch in many documents is asked about once a lot.
    3. A bucket answers as ``answers`` says. What has answer 1 is removed whole.
    4. Stretches with answer 2 are sent with their bytes and meet in one ``RunLengthIndex`` a bucket. Those with answer 3 are
       sent as single windows, dealt by their own bytes, so a frequent anchor never makes one large index.
    5. The spans go back to the lots, which cut the texts.

    A task holds one lot or one bucket. Equal stretches are told by 112 bits of hashes, all others by their bytes."""
    spark = docs.sparkSession
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    total = d.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    lots = max(1, -(-total // lot_bytes))
    buckets = max(1, -(-total // (bucket_rows * (length - GRAM + 2) // 2)))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(lots, 20_000))
    lotted = d.where("id is not null").withColumn("lot", F.pmod(F.xxhash64("id"), F.lit(lots))).repartition(parts, "lot")

    def ask(key, table):
        lot = Lot(table, length, buckets)
        out = [[] for _ in range(7)]
        for part in np.split(np.arange(len(lot.asked)), np.flatnonzero(np.diff(lot.bucket)) + 1) if len(lot.asked) else []:
            at = lot.asked[part]
            for column, v in zip(out, (key[0].as_py(), int(lot.bucket[part[0]]), pack_anchors(lot.anchor[at]), lot.content[at].tobytes(), lot.left[at].tobytes(), lot.right[at].tobytes(), np.diff(lot.id[at], prepend=0).tobytes())):
                column.append(v)
        kinds = [pa.int64()] * 2 + [pa.binary()] * 5
        return pa.table([pa.array(c, k) for c, k in zip(out, kinds)], ["lot", "bucket", "anchors", "contents", "lefts", "rights", "ids"])

    def answer(batches):
        now, held, where = None, [], []

        def out():
            got = answers(held, crowd) if held else []
            return pa.RecordBatch.from_arrays([pa.array(where, pa.int64()), pa.array([now] * len(where), pa.int64()), pa.array([c.tobytes() for c in got], pa.binary())], ["lot", "bucket", "codes"])

        for batch in batches:
            for lot, bucket, *blob in zip(*[batch.column(c).to_pylist() for c in range(7)]):
                if bucket != now:
                    yield out()
                    now, held, where = bucket, [], []
                held.append(blob)
                where.append(lot)
        yield out()

    def cut(key, left, right):
        lot = Lot(left, length, buckets)
        code = np.zeros(len(lot.first), np.uint8)
        code[lot.by] = np.frombuffer(b"".join(c for _, c in sorted(zip(right.column("bucket").to_pylist(), right.column("codes").to_pylist()))), np.uint8)
        code = np.where(lot.id > lot.id[lot.first][lot.kind], 1, code[lot.kind]) if len(lot.id) else code
        number, start, size = lot.number, lot.start, lot.size
        one, two, three = (np.flatnonzero(code == x) for x in (1, 2, 3))
        k, a, b = spans_of(number[one], start[one], (start + size)[one])
        many = size[three] - length + 1
        which = np.repeat(three, many)
        at = start[which] + np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)
        text = lot.texts
        windows = [text[number[i]][s : s + length] for i, s in zip(which, at)]
        data = [None] * len(k) + [text[number[i]][start[i] : start[i] + size[i]] for i in two] + windows
        own = np.array([int.from_bytes(hashlib.blake2b(x, digest_size=7).digest(), "little") % buckets for x in windows], np.int64)
        two_bucket = ((lot.anchor[two] >> np.uint64(16)) % np.uint64(buckets)).astype(np.int64)
        here = key[0].as_py()
        row = np.concatenate([k, number[two], number[which]])
        cols = [
            np.concatenate([np.full(len(k), here % buckets), two_bucket, own]), np.full(len(row), here), row, lot.ids[row] if len(row) else row,
            np.concatenate([a, start[two], at]), np.concatenate([b - a, size[two], np.full(len(which), -length)]),
        ]
        return pa.table([*[pa.array(c.astype(np.int64)) for c in cols], pa.array(data, pa.binary())], ["bucket", "lot", "row", "id", "start", "size", "data"])

    def mark(batches):
        now, held, single = None, [], []
        names = ["lot", "row", "start", "end"]

        def found():
            if held:
                lot, row, ids, start = (np.array([h[k] for h in held], np.int64) for k in range(4))
                sizes = np.array([len(h[4]) for h in held])
                which, at = RunLengthIndex(np.frombuffer(b"".join(h[4] for h in held), np.uint8), sizes, ids, length).earlier()
                k, a, b = spans_of(which, at, at + length)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (lot[k], row[k], start[k] + a, start[k] + b)], names)
            if single:
                least: dict[bytes, int] = {}
                for *_, i, _, data in single:
                    least[data] = min(i, least.get(data, i))
                rows = [(lot, row, start, start + length) for lot, row, i, start, data in single if least[data] < i]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(4)], names)

        for batch in batches:
            done = []
            for bucket, lot, row, i, start, size, data in zip(*[batch.column(c).to_pylist() for c in range(7)]):
                if bucket != now:
                    yield from found()
                    now, held, single = bucket, [], []
                if data is None:
                    done.append((lot, row, start, start + size))
                else:
                    (held if size > 0 else single).append((lot, row, i, start, data))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in done], pa.int64()) for k in range(4)], names)
        yield from found()

    def trim(key, left, right):
        ids, texts = _sorted_docs(left)
        k, a, b = spans_of(*[right.column(c).to_numpy() for c in ("row", "start", "end")])
        cuts = np.searchsorted(k, np.arange(len(ids) + 1))
        out = [[], [], [], [], [], []]
        for n, text in enumerate(texts):
            spans = list(zip(a[cuts[n] : cuts[n + 1]].tolist(), b[cuts[n] : cuts[n + 1]].tolist()))
            edges = [0, *[x for s in spans for x in s], len(text)]
            kept = b"".join(text[x:y] for x, y in zip(edges[::2], edges[1::2]))
            for column, v in zip(out, (ids[n], len(text), len(text) - len(kept), len(spans), [{"start": x, "end": y} for x, y in spans], kept)):
                column.append(v)
        pair = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pair, pa.binary())
        return pa.table([pa.array(c, t) for c, t in zip(out, kinds)], ["id", "n_bytes", "n_removed", "n_spans", "spans", "kept"])

    asked = lotted.groupBy("lot").applyInArrow(ask, "lot long, bucket long, anchors binary, contents binary, lefts binary, rights binary, ids binary")
    answered = asked.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(answer, "lot long, bucket long, codes binary")
    stretches = lotted.groupBy("lot").cogroup(answered.repartition(parts, "lot").groupBy("lot")).applyInArrow(cut, "bucket long, lot long, row long, id long, start long, size long, data binary")
    marked = stretches.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(mark, "lot long, row long, start long, end long")
    result = "id long, n_bytes long, n_removed long, n_spans long, spans array<struct<start: long, end: long>>, kept binary"
    cleaned = lotted.groupBy("lot").cogroup(marked.repartition(parts, "lot").groupBy("lot")).applyInArrow(trim, result)
    whole = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    zero = F.lit(0).cast("long")
    alone = d.where("id is null").select("id", F.octet_length(whole).cast("long"), zero, zero, F.array().cast("array<struct<start: long, end: long>>"), whole)
    return cleaned.union(alone).withColumnRenamed("id", id_col)
