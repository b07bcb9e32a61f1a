"""Best-fit packing of token sequences: bin completion over the counts of piece lengths."""

from __future__ import annotations

import bisect
from array import array
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuemill.llm.common import ranks, slices_by_bytes, tidied
from cuemill.session import stage

PIECES = "doc_id long, piece int, start long, length long, ids binary"


# Fixed value: the pattern by which this family of byte-level BPE files cuts a text before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The letter that such a file writes for each byte: printable Latin-1 bytes stand for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class TokenCache(dict):
    """Bytes of the little-endian 32-bit ids per stretch of text between blanks; each stretch is tokenized once while it is
    remembered.

    The vocabulary and its order are those of the tokenizer file; the merging is done by tiktoken, which gives the same ids as
    the tokenizers library for such files (tests compare both) in a fraction of its time for short strings."""

    def __init__(self, path: str, entries: int = 100_000):
        import json

        import tiktoken

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        special = {t["content"] for t in file.get("added_tokens", [])}
        letters = byte_letters()
        ranks = {bytes(letters[c] for c in t): i for t, i in file["model"]["vocab"].items() if t not in special}
        self.encode, self.entries = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary, entries

    def __missing__(self, stretch: str) -> bytes:
        if len(self) > self.entries:
            self.clear()
        self[stretch] = ids = array("I", self.encode(stretch)).tobytes()
        return ids


def added_tokens(path: str) -> list[str]:
    """Contents of the added tokens of a tokenizer file."""
    import json

    with open(path, encoding="utf-8") as f:
        return [t["content"] for t in json.load(f).get("added_tokens", []) if t["content"]]


def stretches(text: str) -> list[str]:
    """Cut a text before blanks where no token of a byte-level BPE can reach across: between two characters that are not
    white space. A text with two white-space characters in a row stays whole there."""
    parts = text.split(" ")
    out = [parts[0]]
    for p in parts[1:]:
        if not p or p[0].isspace() or not out[-1] or out[-1][-1].isspace():
            out[-1] += " " + p
        else:
            out.append(" " + p)
    return out


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end: int = 0, added: bool = False) -> DataFrame:
    """Tokenize whole texts and cut what is longer than ``capacity``: one row (doc_id, piece, start, length, ids) a piece.

    ``tokenizer`` is the path of a byte-level BPE file that every worker can read. Each document's ids are followed by ``end``.
    A text that holds one of the file's added tokens (``<|endoftext|>``) has it split into ordinary tokens; with ``added``, it is
    encoded by the tokenizers library at its default settings, which gives the added token's own id.
    Pieces have ``capacity`` tokens, but for the first. Null or empty text: one piece that holds ``end``. Ids are
    little-endian 32-bit. Other columns are not read; rows without id or with one id are pieces like all others."""

    def run(batches):
        cache, tail = TokenCache(tokenizer), np.array([end], dtype="<u4").tobytes()
        names, whole = added_tokens(tokenizer) if added else [], None
        for batch in slices_by_bytes(batches, most=1 << 20):
            rows = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            for at in range(0, len(rows), 256):
                out = [[] for _ in range(5)]
                for i, t in rows[at : at + 256]:
                    if t and any(name in t for name in names):
                        if whole is None:
                            from tokenizers import Tokenizer

                            whole = Tokenizer.from_file(tokenizer)
                            whole.no_truncation(), whole.no_padding()
                        ids = np.array(whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes() + tail
                    else:
                        ids = b"".join(map(cache.__getitem__, stretches(t or ""))) + tail
                    n = len(ids) // 4
                    starts = [0, *range(n % capacity or capacity, n, capacity)] if n > capacity else [0]
                    for k, (a, b) in enumerate(zip(starts, [*starts[1:], n])):
                        for column, v in zip(out, (i, k, a, b - a, ids[4 * a : 4 * b])):
                            column.append(v)
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["doc_id", "piece", "start", "length", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(tidied(run), PIECES)


Plan = list[tuple[int, tuple[int, ...]]]


def best_fit(counts: dict[int, int], capacity: int) -> Plan:
    """Best-fit decreasing over counts: lengths from the longest, each to the fullest open filling that has room."""
    open_: dict[int, Counter] = defaultdict(Counter)  # room left -> fillings
    rooms: list[int] = []

    def put(filling: tuple[int, ...], room: int, n: int) -> None:
        if not open_[room]:
            bisect.insort(rooms, room)
        open_[room][filling] += n

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            k = bisect.bisect_left(rooms, length)
            if k == len(rooms):
                fit = capacity // length
                if left >= fit:
                    put((length,) * fit, capacity - fit * length, left // fit)
                if left % fit:
                    put((length,) * (left % fit), capacity - left % fit * length, 1)
                break
            room = rooms[k]
            filling, n = next(iter(open_[room].items()))
            n = min(n, left)
            open_[room][filling] -= n
            if not open_[room][filling]:
                del open_[room][filling]
                if not open_[room]:
                    rooms.pop(k)
            put((*filling, length), room - length, n)
            left -= n
    return [(n, f) for fillings in open_.values() for f, n in fillings.items()]


def bound(counts: dict[int, int], capacity: int) -> int:
    """Fewest sequences that any packing needs: all that is longer than a cut-off stands alone or fills what is left."""
    best = -(-sum(k * n for k, n in counts.items()) // capacity)
    for cut in [k for k in counts if 2 * k <= capacity]:
        big = sum(n for k, n in counts.items() if k > capacity - cut)
        half = [(k, n) for k, n in counts.items() if capacity - cut >= k > capacity / 2]
        small = sum(k * n for k, n in counts.items() if capacity / 2 >= k >= cut)
        room = sum((capacity - k) * n for k, n in half)
        best = max(best, big + sum(n for _, n in half) + max(0, -(-(small - room) // capacity)))
    return best


def fillings(lengths: list[int], counts: dict[int, int], room: int, waste: int, width: int, effort: int = 4000) -> list[tuple[int, ...]]:
    """Undominated fillings of ``room`` that waste at most ``waste``, the fullest first, at most ``width``.

    Lengths go in from the longest. A filling is dominated if one more length would fit, or a length could be replaced by a
    longer one that is left: what is packed then is harder to place than what would be freed. The search gives up branches
    whose open room the shorter lengths left can't bring under ``waste``. If it runs out of ``effort`` before it has found any,
    the greedy filling stands in, the longest that fits first, so that an unfinished search is not taken for a proof that
    there is none."""
    found: list[tuple[int, tuple[int, ...]]] = []
    least, tries = lengths[0], effort

    def undominated(taken: list[int], gap: int) -> bool:
        used = Counter(taken)
        if any(used[k] < counts[k] for k in lengths[: bisect.bisect_right(lengths, gap)]):
            return False
        for k in used:
            for longer in lengths[bisect.bisect_right(lengths, k) : bisect.bisect_right(lengths, k + gap)]:
                if used[longer] < counts[longer]:
                    return False
        return True

    def search(gap: int, top: int, taken: list[int]) -> None:
        nonlocal tries
        tries -= 1
        if gap <= waste and (gap == 0 or undominated(taken, gap)):
            found.append((gap, tuple(taken)))
        if gap < least or tries < 0 or sum(g == 0 for g, _ in found) >= width:
            return
        for i in range(min(top, bisect.bisect_right(lengths, gap) - 1), -1, -1):
            k = lengths[i]
            if taken.count(k) < counts[k]:
                search(gap - k, i, [*taken, k])
                if tries < 0 or sum(g == 0 for g, _ in found) >= width:
                    return

    search(room, len(lengths) - 1, [])
    if not found and tries < 0:
        taken, gap = [], room
        for k in reversed(lengths):
            n = min(counts[k], gap // k)
            taken += [k] * n
            gap -= n * k
        return [tuple(taken)] if gap <= waste else []
    return [f for _, f in sorted(found, key=lambda x: (x[0], len(x[1]), [-k for k in x[1]]))[:width]]


def complete_bins(counts: dict[int, int], capacity: int, width: int = 3, nodes: int = 2500) -> Plan:
    """Pack ``counts`` documents of each length into few sequences: (how many sequences, lengths in each).

    Bin completion by depth first: take the longest length left, try the undominated fillings around it, the fullest first,
    each as often as the counts allow, and go on. A branch ends when the room wasted so far leaves no way below the best
    packing known. Best-fit decreasing is the first incumbent; each complete branch that needs fewer sequences replaces it.
    The search stops at the lower bound or after ``nodes`` nodes, with the incumbent. Its work depends on the number of
    different lengths (``capacity`` at most), not on the number of documents."""
    counts = {k: n for k, n in counts.items() if n}
    if not counts:
        return []
    best, floor = best_fit(counts, capacity), bound(counts, capacity)
    total = sum(k * n for k, n in counts.items())
    size = lambda plan: sum(n for n, _ in plan)
    # A node: counts left, plan so far (linked), sequences so far, waste so far.
    todo, left = [(counts, None, 0, 0)], nodes
    while todo and left and size(best) > floor:
        now, plan, used, lost = todo.pop()
        left -= 1
        allowed = (size(best) - 1) * capacity - total
        if lost > allowed:
            continue
        if not now:
            done = []
            while plan:
                done.append(plan[0])
                plan = plan[1]
            if used < size(best):
                best = done
            continue
        long = max(now)
        rest = {k: n - (k == long) for k, n in now.items() if n - (k == long)}
        lengths = sorted(rest)
        room = capacity - long
        options = fillings(lengths, rest, room, min(room, allowed - lost), width) if lengths and lengths[0] <= room else [()] if room <= allowed - lost else []
        for f in reversed(options):
            need = Counter((long, *f))
            times = min(now[k] // n for k, n in need.items())
            gap = room - sum(f)
            if gap:
                times = min(times, max(1, (allowed - lost) // gap))
            after = {k: n - times * need.get(k, 0) for k, n in now.items() if n > times * need.get(k, 0)}
            todo.append((after, ((times, (long, *f)), plan), used + times, lost + times * gap))
    return best


def pack(parts: DataFrame, capacity: int = 2048, seed: int = 11, width: int = 3, nodes: int = 2500) -> DataFrame:
    """Columns ``sequence_id`` and ``offset`` for ``parts`` (doc_id, piece, start, length, ...), lengths from 1 to ``capacity``.

    Only the counts by length (``capacity`` rows at most) come to the driver, where ``complete_bins`` plans them. The plan is
    at most a few thousand fillings, whatever the number of pieces; it goes to the tasks, which look up the piece of
    rank r among those of its length. No piece is split, sequences have no gaps. ``parts`` is read more than once: hand in a
    written table. Repeated rows are packed each; no rows give no rows."""
    spark = parts.sparkSession
    counts = {r["length"]: r["rows"] for r in parts.groupBy("length").agg(F.count("*").alias("rows")).collect()}
    if any(not 0 < k <= capacity for k in counts):
        raise ValueError(f"lengths have to be from 1 to {capacity}")
    starts, first, places, sequence, given = defaultdict(list), defaultdict(list), defaultdict(list), 0, Counter()
    for times, filling in complete_bins(counts, capacity, width, nodes):
        at = 0
        for k in filling:
            starts[k].append(given[k]), first[k].append(sequence), places[k].append(at)
            given[k] += times
            at += k
        sequence += times
    keys = [c for c in parts.columns if c not in ("sequence_id", "offset")]
    ranked = ranks(parts.select(*keys).withColumn("draw", F.xxhash64(F.lit(seed), "doc_id", "piece")), ["length"], "draw", ["doc_id", "piece"], buckets=1024).drop("draw")
    table = {k: tuple(np.array(x[k], dtype=np.int64) for x in (starts, first, places)) for k in starts}
    schema = ranked.drop("rank").schema.add("sequence_id", "long").add("offset", "long")

    def place(batches):
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            seq, off = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            for group in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else []:
                begin, number, offset = table[int(length[group[0]])]
                i = np.searchsorted(begin, rank[group], side="right") - 1
                seq[group], off[group] = number[i] + rank[group] - begin[i], offset[i]
            kept = [n for n in batch.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in kept], pa.array(seq), pa.array(off)], names=[*kept, "sequence_id", "offset"])

    return ranked.mapInArrow(tidied(place), schema) if counts else spark.createDataFrame([], schema)


def assemble(packed: DataFrame) -> DataFrame:
    """Training sequences: (sequence_id, ids binary, spans) of packed pieces that still carry ``ids``. One sequence is at most
    ``capacity`` tokens, so a group is small."""
    spans = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "length", "ids")))
    joined = F.aggregate("spans", F.lit(b""), lambda a, s: F.concat(a, s["ids"]))
    return packed.groupBy("sequence_id").agg(spans.alias("spans")).select("sequence_id", joined.alias("ids"), F.transform("spans", lambda s: s.dropFields("ids")).alias("spans"))


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, added: bool = False) -> DataFrame:
    """Pieces of all documents with their checksum and place: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    The ids of each piece are summed up in the task that tokenized it (``pieces`` and ``assemble`` give them in full)."""
    parts = stage(pieces(docs, tokenizer, id_col, text_col, capacity, added=added).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), "pieces")
    return pack(parts, capacity)
