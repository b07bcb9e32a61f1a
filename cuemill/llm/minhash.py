"""Near-duplicate documents by word shingles: SuperMinHash sketches, banding, exact verification, union-find grouping."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuemill.llm.common import beside, components, slices_by_bytes, tidied
from cuemill.session import stage

GOLDEN = np.uint64(0x9E3779B97F4A7C15)
SKETCH = "id long, n long, f1 long, f2 long, bands array<long>, nibbles array<long>"


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hash per word, computed once while it is remembered."""

    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: str, width: int, known: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``width``-word shingles; fewer words are one shingle, no words none.
    ``bytes.lower`` and ``bytes.split`` know A-Z and the six ASCII white-space characters only, as the contract does."""
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(known) > 200_000:
        known.clear()
    w = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    width = min(width, len(w))
    h = np.full(len(w) - width + 1, width, np.uint64)
    for i in range(width):
        h = mixed((h + GOLDEN) ^ w[i : len(w) - width + 1 + i])
    return np.unique(h)


def superminhash(values: np.ndarray, owner: np.ndarray, sets: int, size: int) -> np.ndarray:
    """Signatures (sets x size) of the sets whose elements are ``values``, each owned by set ``owner``.

    In round j every element draws a rank in [j, j + 1) and swaps position j of its own random permutation of the slots with
    one from j on; the slot it gets keeps the least rank. So each element meets each slot once, at correlated ranks. A set
    leaves as soon as all its slots are filled from the rounds so far: later ranks can't be smaller."""
    signature = np.full(sets * size, np.iinfo(np.uint64).max, np.uint64)
    order = np.tile(np.arange(size, dtype=np.uint8), (len(values), 1))
    base = owner * size
    for j in range(size):
        draw, jump = (mixed(values + np.uint64(int(GOLDEN) * (2 * j + i) % (1 << 64))) for i in (1, 2))
        k = j + ((jump >> np.uint64(11)) % np.uint64(size - j)).astype(np.int64)
        row = np.arange(len(values))
        slot = order[row, k]
        order[row, k] = order[:, j]
        np.minimum.at(signature, base + slot, (draw >> np.uint64(8)) | (np.uint64(j) << np.uint64(56)))
        open_ = signature.reshape(sets, size).max(axis=1) >= np.uint64(j + 1) << np.uint64(56) if j < size - 1 else np.zeros(sets, bool)
        stay = open_[owner]
        if not stay.all():
            values, owner, base, order = values[stay], owner[stay], base[stay], order[stay]
        if not len(values):
            break
    return signature.reshape(sets, size)


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    h = np.zeros((len(signature), bands), np.uint64) + np.arange(bands, dtype=np.uint64)
    for r in range(rows):
        h = mixed((h + GOLDEN) ^ signature[:, r : bands * rows : rows])
    return h.view(np.int64)


def nibble_keys(signature: np.ndarray) -> np.ndarray:
    """Four hashed bits of every slot, sixteen slots to a 64-bit number: equal slots have equal bits, others half of them."""
    four = mixed(signature) & np.uint64(15)
    packed = np.zeros((len(four), -(-four.shape[1] // 16)), np.uint64)
    for i in range(four.shape[1]):
        packed[:, i // 16] |= four[:, i] << np.uint64(4 * (i % 16))
    return packed.view(np.int64)


def sketches(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """(id, n, f1, f2, bands, nibbles) for ``docs`` (id, text): set size, 128-bit fingerprint of the set, key of each band,
    four bits of each slot."""
    if bands * rows > 255:
        raise ValueError("at most 255 slots")

    def run(batches):
        known = WordHashes()
        for batch in slices_by_bytes(batches):
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            group, held = [], 0
            for i, t in zip(ids, texts):
                group.append((i, shingles(t or "", width, known)))
                held += len(group[-1][1])
                if held > 60_000 or len(group) >= 4000:
                    yield pack(group)
                    group, held = [], 0
            if group:
                yield pack(group)

    def pack(group) -> pa.RecordBatch:
        sets = [s for _, s in group]
        n = np.array([len(s) for s in sets])
        keys = np.zeros((len(sets), bands), np.int64)
        some = np.flatnonzero(n)
        bits = np.zeros((len(some), -(-bands * rows // 16)), np.int64)
        if len(some):
            owner = np.repeat(np.arange(len(some)), n[some])
            signature = superminhash(np.concatenate([sets[i] for i in some]), owner, len(some), bands * rows)
            keys[some], bits = band_keys(signature, bands, rows), nibble_keys(signature)
        prints = np.array([np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64) for s in sets])
        lists = [pa.ListArray.from_arrays(pa.array(np.cumsum([0, *np.where(n > 0, x.shape[1], 0)]).astype(np.int32)), pa.array(x.ravel())) for x in (keys[some], bits)]
        return pa.RecordBatch.from_arrays([pa.array([i for i, _ in group], pa.int64()), pa.array(n, pa.int64()), pa.array(prints[:, 0]), pa.array(prints[:, 1]), *lists], ["id", "n", "f1", "f2", "bands", "nibbles"])

    return docs.mapInArrow(tidied(run), SKETCH)


def verified(pairs: DataFrame, texts: DataFrame, width: int, percent: int, block: int = 64, lot: int = 512) -> DataFrame:
    """Those ``pairs`` (a, b, near) whose full shingle sets are similar enough, as links (src, dst).

    The b of one ``near`` are put into blocks of about ``block``; each a is sent once to a block that asks for it, however many
    of its b it has to meet. Blocks that many a are sent to are cut into lots of ``lot``, with the b's texts in each. A task
    holds the sets of one block and one a at a time, so the number of copies does not matter to its memory."""
    spread = pairs.select("near", "b").distinct().groupBy(F.col("near").alias("s_near")).agg(F.ceil(F.count("*") / block).alias("blocks"))
    placed = pairs.join(spread, F.col("near") == F.col("s_near")).withColumn("block", F.xxhash64("near", F.pmod(F.xxhash64("b"), "blocks")))
    asked = stage(placed.groupBy("block", "a").agg(F.collect_set("b").alias("bs")), "asked")
    lots = stage(asked.groupBy(F.col("block").alias("l_block")).agg(F.ceil(F.count("*") / lot).alias("lots")), "lots")
    met = asked.join(lots, F.col("block") == F.col("l_block"))
    others = met.select("block", F.pmod(F.xxhash64("a"), "lots").alias("lot"), F.lit(1).alias("turn"), F.col("a").alias("need"), "bs")
    homes = met.select("block", F.explode("bs").alias("need"), "lots").distinct().select("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("lots") - 1)).alias("lot"), F.lit(0).alias("turn"), "need", F.array().cast("array<long>").alias("bs"))
    sent = others.union(homes).join(texts, F.col("need") == texts["id"]).select("block", "lot", "turn", "id", "bs", "text")

    def run(batches):
        known, at, own = WordHashes(), None, {}
        for batch in slices_by_bytes(batches, column=5):
            src, dst = [], []
            for block_, lot_, turn, i, bs, text in zip(*[batch.column(c).to_pylist() for c in range(6)]):
                s = shingles(text, width, known)
                if (block_, lot_) != at:
                    at, own = (block_, lot_), {}
                if not turn:
                    own.setdefault(i, []).append(s)
                    continue
                for b in bs:
                    for o in own[b]:
                        both = len(np.intersect1d(s, o, assume_unique=True))
                        if 100 * both >= percent * (len(s) + len(o) - both):
                            src.append(i), dst.append(b)
                            break
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], ["src", "dst"])

    return sent.repartition("block", "lot").sortWithinPartitions("block", "lot", "turn").mapInArrow(tidied(run), "src long, dst long")


def united(links: DataFrame, most: int = 1_000_000) -> DataFrame:
    """Union-find inside each partition: its links become one link from each node to its smallest node there. Forests of more
    than ``most`` nodes are handed on and begun anew, which loses no connection."""

    def run(batches):
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        def forest():
            pairs = [(x, root(x)) for x in parent if root(x) != x]
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], ["src", "dst"])

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                parent.setdefault(a, a), parent.setdefault(b, b)
                a, b = root(a), root(b)
                parent[max(a, b)] = min(a, b)
            if len(parent) > most:
                yield forest()
                parent.clear()
        yield forest()

    return links.mapInArrow(tidied(run), "src long, dst long")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, bands: int = 32, rows: int = 4, rounds: int = 1
) -> DataFrame:
    """Groups of documents whose sets of ``width``-word shingles have 100 x intersection >= ``percent`` x union.

    Returns per row of ``docs``: id, n_shingles, component_id (smallest id reachable by links), kept (id = component_id).
    Other columns are not read.

    * Null or empty text, or no words: no shingles, linked with nothing, own component, kept.
    * Rows with one id are one document: they share links; repeated rows give repeated results. Rows without id take no
      part: component null, kept. An empty table gives no rows.

    1. Documents with equal sets are one class, found by fingerprint; one document stands for it.
    2. SuperMinHash signatures, ``bands`` bands of ``rows`` slots. At the similarity s a pair shares no band with
       probability (1 - s^rows)^bands, 5e-8 at 0.8.
    3. In each bucket every document is compared with the bucket's smallest, on full sets; the links found are grouped.
    4. ``rounds`` times: in buckets that still hold several groups, each document outside the bucket's largest group is compared
       with one document of that group, drawn anew per bucket. So the members of a large group of copies join it after
       a few comparisons each, as links of one bucket or another lead them there.
    5. What is still apart in a bucket is compared in full (``compared_in_full``), unless sizes rule the similarity out, or the
       signatures do: a pair is left out if its slots agree so little that a pair at the threshold would with a probability
       below 1e-8 (six deviations).
    """
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sketch = stage(sketches(d, width, bands, rows), "sketches")
    able = sketch.where("n > 0 and id is not null")
    one = F.min(F.struct("id", "bands", "nibbles"))
    classes = stage(able.groupBy("f1", "f2", "n").agg(one.alias("first")).select("f1", "f2", "n", "first.*"), "classes")
    members = classes.select("id", "n", F.posexplode("bands").alias("band", "key"))
    heads = stage(members.groupBy("band", "key").agg(F.count("*").alias("size"), F.min(F.struct("id", "n")).alias("head")).where("size > 1").select("band", "key", "head"), "heads")
    met = stage(members.join(heads, ["band", "key"]), "buckets")
    alike = lambda n, m: F.least(n, m) * 100 >= F.greatest(n, m) * percent
    wanted = stage(met.select(F.col("id").alias("want")).distinct(), "wanted")
    texts = stage(d.join(beside(wanted), d["id"] == F.col("want"), "left_semi"), "texts")
    pairs = met.where(F.col("id") > F.col("head.id")).where(alike(F.col("n"), F.col("head.n"))).select(F.col("id").alias("a"), F.col("head.id").alias("b"), F.col("head.id").alias("near")).distinct()
    known = components(united(verified(stage(pairs, "pairs"), texts, width, percent)))
    # The groups found stand for their links from here on: each later search begins with stars.
    joined = lambda more: components(united(known.select(F.col("node").alias("src"), F.col("component").alias("dst")).union(more)))
    for turn in range(rounds):
        left = apart(met, known, turn)
        drawn = left.where(F.col("c") != F.col("pivot.c")).where(alike(F.col("n"), F.col("pivot.n"))).select(F.col("id").alias("a"), F.col("pivot.id").alias("b"), F.col("pivot.id").alias("near")).distinct()
        known = joined(verified(stage(drawn, "drawn-pairs"), texts, width, percent))
    left = apart(met, known, rounds)
    facts = texts.join(classes.select(F.col("id").alias("c_id"), "bands", "nibbles"), F.col("id") == F.col("c_id")).drop("c_id")
    final = joined(compared_in_full(left, facts, width, percent, bands * rows))
    named = stage(classes.join(final, classes["id"] == final["node"], "left").select("f1", "f2", "n", F.coalesce("component", "id").alias("component")), "named")
    out = sketch.join(named, ["f1", "f2", "n"], "left").withColumn("component_id", F.when(F.col("n") > 0, F.when(F.col("id").isNotNull(), F.col("component"))).otherwise(F.col("id")))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def apart(met: DataFrame, known: DataFrame, turn: int) -> DataFrame:
    """The rows (band, key, id, n) of buckets with several groups, each with its group ``c`` and the bucket's ``pivot`` (id, n, c): a
    document of its largest group, drawn by a hash of bucket and turn."""
    grouped = stage(met.select("band", "key", "id", "n").join(known, F.col("id") == F.col("node"), "left").select("band", "key", "id", "n", F.coalesce("component", "id").alias("c")), "grouped")
    draw = F.struct(F.xxhash64("id", "band", "key", F.lit(turn)).alias("draw"), "id", "n", "c")
    groups = grouped.groupBy("band", "key", "c").agg(F.count("*").alias("size"), F.min(draw).alias("pivot"))
    several = groups.groupBy("band", "key").agg(F.count("*").alias("groups"), F.max(F.struct("size", "c", "pivot")).alias("top")).where("groups > 1").select("band", "key", F.col("top.pivot").alias("pivot"))
    return stage(grouped.join(stage(several, "several"), ["band", "key"]), "apart")


def compared_in_full(left: DataFrame, facts: DataFrame, width: int, percent: int, slots: int, block: int = 256, held: int = 500_000, lot: int = 2048) -> DataFrame:
    """Links across the groups of each bucket: every document outside the largest group with all documents of other groups.

    Those outside are put into blocks of about ``block`` documents and ``held`` shingles; every document of the bucket is sent to each block, in lots of ``lot``. A
    task holds one block and one document at a time, and gives out links only. A pair is looked at in the first band that it
    shares, and not if its sizes or the bits of its slots rule the similarity out."""
    s = percent / 100
    # Differing bits of a pair at the threshold: two of four bits of each slot that differs; six deviations on top.
    most = int(2 * slots * (1 - s) + 6 * (4 * slots * s * (1 - s) + slots * (1 - s)) ** 0.5)
    outside = F.col("c") != F.col("pivot.c")
    plan = left.groupBy("band", "key").agg(F.count("*").alias("all"), F.greatest(F.count_if(outside) / block, F.sum(F.when(outside, F.col("n"))) / held).alias("some"))
    plan = stage(plan.select("band", "key", F.ceil("some").alias("blocks"), F.ceil(F.col("all") / lot).alias("lots")), "block-plan")
    met = left.join(plan, ["band", "key"]).withColumn("lone", outside)
    spot = ["band", "key", "block", "lot", "turn"]
    here = F.col("lone") & (F.pmod(F.xxhash64("id"), "blocks") == F.col("block"))
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    each = met.withColumn("block", upto("blocks"))
    others = each.withColumn("lot", F.pmod(F.xxhash64("id", F.lit(1)), "lots")).withColumn("turn", F.lit(1))
    homes = each.where(here).withColumn("lot", upto("lots")).withColumn("turn", F.lit(0))
    sent = others.unionByName(homes).select(*spot, F.col("id").alias("need"), "n", "c", "lone").join(facts, F.col("need") == F.col("id"))
    names = [*spot, "id", "n", "c", "lone", "bands", "nibbles", "text"]

    def run(batches):
        known, at, own, table = WordHashes(), None, [], None
        for batch in slices_by_bytes(batches, column=names.index("text")):
            src, dst = [], []
            for band, key, block_, lot_, turn, i, n, c, lone, bands, nibbles, text in zip(*[batch.column(x).to_pylist() for x in names]):
                if (band, key, block_, lot_) != at:
                    at, own, table = (band, key, block_, lot_), [], None
                if not turn:
                    own.append((i, n, c, bands, nibbles, shingles(text, width, known)))
                    continue
                if table is None:
                    table = [np.array([o[k] for o in own], np.int64) for k in range(5)]
                ids, sizes, groups, theirs, bits = table
                able = (groups != c) & ((ids < i) if lone else True) & (np.minimum(sizes, n) * 100 >= np.maximum(sizes, n) * percent)
                able &= np.bitwise_count((bits ^ np.array(nibbles, np.int64)).view(np.uint64)).sum(axis=1) <= most
                able &= ~(theirs[:, :band] == np.array(bands[:band], np.int64)).any(axis=1)
                found = np.flatnonzero(able)
                if len(found):
                    mine = shingles(text, width, known)
                    for k in found:
                        both = len(np.intersect1d(mine, own[k][5], assume_unique=True))
                        if 100 * both >= percent * (len(mine) + len(own[k][5]) - both):
                            src.append(i), dst.append(own[k][0])
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], ["src", "dst"])

    return sent.select(*names).repartition(*spot[:-1]).sortWithinPartitions(*spot).mapInArrow(tidied(run), "src long, dst long")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one document of each group, all columns. Rows without id stay; rows with one id stay or go together."""
    found = stage(near_duplicates(docs, id_col, text_col, **options), "near-duplicates")
    gone = stage(found.where("not kept").select(F.col(id_col).alias("gone id")).distinct(), "gone")
    return docs.join(beside(gone), docs[id_col] == gone["gone id"], "left_anti")
