"""Quality rules: counts per document and perplexity under a modified Kneser-Ney model counted over the whole corpus."""

from __future__ import annotations

from collections import Counter, defaultdict
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuemill.llm.common import SPACES, beside, slices_by_bytes, tidied
from cuemill.llm.minhash import GOLDEN, mixed
from cuemill.session import stage

BEGIN, END = "\x02", "\x03"
# Marks of running text: white space, so no word holds them.
START, GAP = "\n", " "
PAD = 0x110000  # no code point
SYMBOLS = "#*$%&|<>"
SCORES = "id long, th long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, units long, logp double"
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def text_stats(text: str, words: list[bytes], window: int = 5) -> tuple[int, int, int, int, int]:
    """Words, code points in words, symbols, lines with a word that equal an earlier line, words in repeated windows."""
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    repeated = 0
    if len(words) > window:
        grams = list(zip(*[words[i:] for i in range(window)]))
        if len(set(grams)) < len(grams):
            seen, end = Counter(grams), 0
            for i, g in enumerate(grams):
                if seen[g] > 1:
                    repeated += i + window - max(end, i)
                    end = i + window
    return len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated


def word_counts(docs: DataFrame, hold: int = 200_000, symbol_percent: int = 10) -> DataFrame:
    """(lang, word, docs): in how many reference documents of a language each lower-cased word occurs; 0 where only others
    have it. A reference document has at most ``symbol_percent`` symbols per 100 words: junk of symbols in every word doesn't
    teach the model its word ends. Each task adds up what it holds before it hands it on. Counting documents, a text can't
    teach the model its own repetitions."""

    def run(batches):
        held: dict[str, Counter] = defaultdict(Counter)

        def out():
            rows = [(lang, w.decode(), n) for lang, c in held.items() for w, n in c.items()]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64()))], ["lang", "word", "docs"])

        for batch in slices_by_bytes(batches):
            for text, lang in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                words = (text or "").lower().encode().split()
                counted = int(sum(map((text or "").count, SYMBOLS)) * 100 <= len(words) * symbol_percent)
                held[lang].update(dict.fromkeys(words, counted))
                if sum(map(len, held.values())) > hold:
                    yield out()
        yield out()

    parts = docs.select("id", "text", "lang").mapInArrow(tidied(run), "lang string, word string, docs long")
    return parts.groupBy("lang", "word").agg(F.sum("docs").alias("docs"))


def running(text: str | None) -> str:
    """The lower-cased words of a text in order, a gap after each, behind a start mark; '' without words."""
    words = (text or "").lower().encode().split()
    return START + GAP.encode().join(words).decode() + GAP if words else ""


def windows(texts: list[str], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of running texts, each behind ``order`` - 2 pads, where the window of each character but the start marks
    begins, and the text it is in. A window has ``order`` characters and ends with its own."""
    size = np.array([len(t) + order - 2 for t in texts], int)
    codes = np.full(size.sum(), PAD, np.uint32)
    at = np.arange(len(codes)) - np.repeat(np.cumsum(size) - size, size)
    codes[at >= order - 2] = code_points("".join(texts))
    begin = np.flatnonzero(at <= np.repeat(size, size) - order)
    return codes, begin, np.repeat(np.arange(len(texts)), size - order + 1)


def by_key(key: np.ndarray) -> np.ndarray:
    """A stable order by keys. The first bits of a key with its place behind them are sorted, which is faster than places by keys;
    only where these bits are the same for different keys is the order wrong, and made that way."""
    bits = np.uint64(len(key).bit_length())
    places = (np.uint64(1) << bits) - np.uint64(1)
    packed = (key & ~places) | np.arange(len(key), dtype=np.uint64)
    packed.sort()
    by = (packed & places).astype(np.int64)
    packed >>= bits
    mixed_up = (packed[1:] == packed[:-1]) & (key[by[1:]] != key[by[:-1]])
    return np.argsort(key, kind="stable") if mixed_up.any() else by


def distinct_windows(codes: np.ndarray, begin: np.ndarray, text: np.ndarray, order: int):
    """Key, count, number of texts and characters of each different window."""
    ends = len(codes) - order + 1
    key = keys([codes[i : ends + i] for i in range(order)], np.zeros(1, np.uint64))[begin]
    by = by_key(key)
    key, text = key[by], text[by]
    new = np.append(True, key[1:] != key[:-1])
    first = np.flatnonzero(new)
    texts = np.add.reduceat(new | np.append(True, text[1:] != text[:-1]), first, dtype=np.int64)
    return key[first], np.diff(np.append(first, len(key))), texts, codes[begin[by[first]][:, None] + np.arange(order)]


def window_texts(chars: np.ndarray) -> list[str]:
    """Windows as strings, without their pads."""
    size, out = (chars != PAD).sum(axis=1), np.empty(len(chars), object)
    for n in np.unique(size):
        rows = np.flatnonzero(size == n)
        joined = chars[rows][:, chars.shape[1] - n :].tobytes().decode("utf-32-le")
        out[rows] = [joined[i : i + n] for i in range(0, len(joined), n)]
    return out.tolist()


def text_grams(docs: DataFrame, order: int, hold: int = 400_000, symbol_percent: int = 10) -> DataFrame:
    """(lang, gram, c, docs): how often each gram stands in the running texts of reference documents (``word_counts``), and in how
    many of them. Grams have ``order`` characters, shorter ones begin at a text's start. Each task adds up what it holds
    before it hands it on."""

    def added(lots):
        key, c, n, chars = (np.concatenate(x) for x in zip(*lots))
        by = np.argsort(key, kind="stable")
        first = np.flatnonzero(np.append(True, key[by][1:] != key[by][:-1]))
        return key[by][first], np.add.reduceat(c[by], first), np.add.reduceat(n[by], first), chars[by[first]]

    def run(batches):
        held: dict[str, list] = defaultdict(list)

        def out():
            for lang, lots in held.items():
                _, c, n, chars = added(lots)
                for at in range(0, len(c), 1 << 16):
                    part = slice(at, at + (1 << 16))
                    grams = window_texts(chars[part])
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams, pa.string()), pa.array(c[part]), pa.array(n[part])], ["lang", "gram", "c", "docs"])
            held.clear()

        for batch in slices_by_bytes(batches, most=1 << 20):
            texts = defaultdict(list)
            for text, lang in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                line = running(text)
                if line and sum(map(text.count, SYMBOLS)) * 100 <= line.count(GAP) * symbol_percent:
                    texts[lang].append(line)
            for lang, lines in texts.items():
                held[lang].append(distinct_windows(*windows(lines, order), order))
            if sum(len(x[0]) for lots in held.values() for x in lots) > hold:
                for lang, lots in held.items():
                    held[lang] = [added(lots)]
                if sum(len(x[0]) for lots in held.values() for x in lots) > hold // 2:
                    yield from out()
        yield from out()

    parts = docs.select("id", "text", "lang").mapInArrow(tidied(run), "lang string, gram string, c long, docs long")
    return parts.groupBy("lang", "gram").agg(F.sum("c").alias("c"), F.sum("docs").alias("docs"))


def kneser_ney(words: DataFrame, order: int) -> DataFrame:
    """Model (``smoothed``) of the characters of words. Words stand between a begin and an end mark; contexts do not cross words."""
    marked = F.concat(F.lit(BEGIN), F.col("word"), F.lit(END))
    at = words.where("docs > 0").select("lang", "docs", marked.alias("word")).select("lang", "docs", "word", F.explode(F.sequence(F.lit(2), F.length("word"))).alias("i"))
    said = at.select("lang", F.substring("word", F.greatest(F.col("i") - order + 1, F.lit(1)), F.least(F.col("i"), F.lit(order))).alias("gram"), "docs")
    return smoothed(said.groupBy("lang", "gram").agg(F.sum("docs").alias("c")))


def smoothed(full: DataFrame) -> DataFrame:
    """Modified Kneser-Ney model of grams (lang, gram, c), each in its language: (lang, gram, logp, backoff).

    Grams of the highest order, and shorter ones from the begin mark, have their counts; all others count the different
    characters before them. Three discounts per language and order come from the counts of counts. logp: interpolated
    probability of the last character after the others; backoff: log weight of the shorter context after this gram (0 where
    it is never a context)."""
    full = stage(full.select("lang", "gram", "c"), "grams")

    # Every shorter gram is the end of a full one; its count is that of the different characters before it.
    ends = full.where(F.length("gram") > 1).select("lang", "gram", F.explode(F.sequence(F.lit(1), F.length("gram") - 1)).alias("k"))
    before = ends.selectExpr("lang", "substring(gram, length(gram) - k + 1) AS gram", "substring(gram, length(gram) - k, 1) AS before").distinct()
    counts = stage(full.union(before.groupBy("lang", "gram").agg(F.count("*").alias("c"))), "counts")

    n = [F.count(F.when(F.col("c") == x, 1)).alias(f"n{x}") for x in (1, 2, 3, 4)]
    d = counts.groupBy(F.col("lang").alias("d_lang"), F.length("gram").alias("d_size")).agg(*n, F.count("*").alias("kinds"))
    y = F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2"))

    def discount(i: int, otherwise: float):
        fit = F.greatest(F.lit(0.05), F.least(F.lit(i - 0.05), i - F.try_divide((i + 1) * y * F.col(f"n{i + 1}"), F.col(f"n{i}"))))
        return F.coalesce(F.when((F.col("n1") > 0) & (F.col(f"n{i}") > 0), fit), F.lit(otherwise)).alias(f"d{i}")

    d = stage(d.select("d_lang", "d_size", "kinds", discount(1, 0.5), discount(2, 1.0), discount(3, 1.5)), "discounts")
    cut = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
    t = counts.join(d, (F.col("lang") == F.col("d_lang")) & (F.length("gram") == F.col("d_size"))).select("lang", "gram", "c", cut.alias("cut"), F.expr("substring(gram, 1, length(gram) - 1)").alias("context"))
    sums = t.groupBy(F.col("lang").alias("s_lang"), F.col("context").alias("s_context")).agg(F.sum("c").alias("total"), F.sum("cut").alias("freed"))
    t = t.join(sums, (F.col("lang") == F.col("s_lang")) & (F.col("context") == F.col("s_context")))
    parts = stage(t.select("lang", "gram", "context", ((F.col("c") - F.col("cut")) / F.col("total")).alias("own"), (F.col("freed") / F.col("total")).alias("weight")), "parts")

    # Interpolation: own share, plus the weight of the context times the probability after the context less its first character.
    chain = parts.select("lang", "gram", F.explode(F.sequence(F.lit(1), F.length("gram"))).alias("k")).selectExpr("lang", "gram", "k", "substring(gram, length(gram) - k + 1) AS shorter")
    shares = parts.select(F.col("lang").alias("p_lang"), F.col("gram").alias("p_gram"), "own", "weight")
    met = chain.join(shares, (F.col("lang") == F.col("p_lang")) & (F.col("shorter") == F.col("p_gram")))
    folded = met.groupBy("lang", "gram").agg(F.array_sort(F.collect_list(F.struct("k", "own", "weight"))).alias("steps"))
    single = d.where("d_size = 1").select(F.col("d_lang").alias("v_lang"), (1 / (F.col("kinds") + 1)).alias("even"))
    p = folded.join(single, F.col("lang") == F.col("v_lang")).select("lang", "gram", F.log(F.aggregate("steps", F.col("even"), lambda below, x: x["own"] + x["weight"] * below)).alias("logp"))
    contexts = parts.groupBy("lang", F.col("context").alias("gram")).agg(F.log(F.first("weight")).alias("backoff"))
    return p.join(contexts, ["lang", "gram"], "full").select("lang", "gram", "logp", F.coalesce("backoff", F.lit(0.0)).alias("backoff"))


def keys(codes: list[np.ndarray], seeds: np.ndarray) -> np.ndarray:
    """64-bit keys of grams from their characters, first to last, and a seed per language."""
    h = seeds + np.uint64(len(codes))
    for c in codes:
        h = mixed((h + GOLDEN) ^ c.astype(np.uint64, copy=False))
    return h


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def seed_of(lang: str) -> int:
    return xxhash.xxh3_64_intdigest(lang)


def telling(order: int) -> int:
    """How many characters before a character tell which part of a model scores it."""
    return min(2, order - 1)


def part_of(before: list[np.ndarray], parts: int) -> np.ndarray:
    """The part of a model that scores a character behind these."""
    h = np.zeros_like(before[0], np.uint64) if before else np.uint64(0)
    for c in before:
        h = (h ^ c) * GOLDEN
    return ((h >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)


@dataclass
class HashedModel:
    """A model as sorted hash arrays: keys, log probability (nan: a context only), backoff weight.

    A model may come in parts. A character is scored by the part that the ``telling`` characters before it name: all longer grams
    that end with it, and their contexts, share those; shorter ones are in every part."""

    order: int
    key: np.ndarray
    logp: np.ndarray
    backoff: np.ndarray
    part: int = 0
    parts: int = 1

    def __post_init__(self):
        # Keys are evenly spread: their first bits tell where to look, a step or two off at most times.
        self.shift = np.uint64(64 - max(len(self.key).bit_length(), 1))
        rows = np.bincount((self.key >> self.shift).astype(np.int64), minlength=1 << int(64 - self.shift))
        self.begin = (np.cumsum(rows) - rows).astype(np.int32)

    @classmethod
    def of(cls, grams: DataFrame, order: int, part: int = 0, parts: int = 1) -> HashedModel:
        """The grams are hashed where they are; the driver gets 16 bytes of each, or of those that a part needs."""
        tells = telling(order)

        def run(batches):
            for batch in batches:
                texts = batch.column(1).to_pylist()
                seed = np.array([seed_of(x) for x in batch.column(0).to_pylist()], np.uint64)
                length = np.array([len(g) for g in texts], int)
                key, here = np.zeros(len(texts), np.uint64), np.ones(len(texts), bool)
                for k in set(length.tolist()):
                    i = np.flatnonzero(length == k)
                    chars = code_points("".join(texts[j] for j in i)).reshape(len(i), k)
                    key[i] = keys([chars[:, c] for c in range(k)], seed[i])
                    if parts > 1 and k > tells:
                        # Asked for its last character, or as the context of the next one.
                        here[i] = part_of([chars[:, c] for c in range(k - 1 - tells, k - 1)], parts) == part
                        if k < order:
                            here[i] |= part_of([chars[:, c] for c in range(k - tells, k)], parts) == part
                made = pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column(2), batch.column(3)], ["key", "logp", "backoff"])
                yield made if parts == 1 else made.filter(pa.array(here))

        narrow = grams.select("lang", "gram", F.coalesce(F.col("logp").cast("float"), F.lit(float("nan")).cast("float")).alias("logp"), F.col("backoff").cast("float").alias("backoff"))
        got = narrow.mapInArrow(run, "key long, logp float, backoff float").toArrow()
        key = got["key"].to_numpy().view(np.uint64)
        by = np.argsort(key)
        return cls(order, key[by], got["logp"].to_numpy()[by], got["backoff"].to_numpy()[by], part, parts)

    def find(self, key: np.ndarray) -> np.ndarray:
        """Place of each key, -1 where it is not."""
        found = np.full(len(key), -1)
        if not len(self.key):
            return found
        asked = np.arange(len(key))
        at = self.begin[key >> self.shift]
        while len(asked):
            here = self.key[np.minimum(at, len(self.key) - 1)]
            hit = here == key
            found[asked[hit]] = at[hit]
            on = np.flatnonzero((here < key) & (at < len(self.key) - 1))
            asked, at, key = asked[on], at[on] + 1, key[on]
        return found

    def score(self, lang: str, words: list[str]) -> np.ndarray:
        """Log probability of each word."""
        return self.score_marked(lang, [f"{BEGIN}{w}{END}" for w in words])

    def score_marked(self, lang: str, texts: list[str]) -> np.ndarray:
        """Log probability of each text after its first mark: from the longest context down, with backoff weights where a gram is
        unknown. A part of a model adds up its own characters only."""
        if not texts:
            return np.zeros(0)
        text = code_points("".join(texts)).astype(np.uint64)
        size = np.array([len(t) for t in texts])
        begin = np.cumsum(size) - size
        place = np.arange(len(text), dtype=np.int32) - np.repeat(begin.astype(np.int32), size)
        mine = place > 0
        if self.parts > 1:
            before = [np.where(place >= c, np.roll(text, c), np.uint64(PAD)) for c in range(telling(self.order), 0, -1)]
            mine &= part_of(before, self.parts) == self.part
        open_ = np.flatnonzero(mine)
        total, seed = np.zeros(len(text)), np.array([seed_of(lang)], np.uint64)
        for k in range(self.order, 0, -1):
            # Characters with a shorter history use it whole; a gram of one character has no context.
            long_enough = place[open_] >= k - 1
            ready = open_[long_enough]
            if not len(ready):
                continue
            chars = [text[ready - k + 1 + i] for i in range(k)]
            at = self.find(keys(chars, seed))
            own = self.logp[at]
            known = (at >= 0) & ~np.isnan(own)
            total[ready[known]] += own[known]
            lost = ready[~known]
            if k > 1 and len(lost):
                context = self.find(keys([c[~known] for c in chars[:-1]], seed))
                total[lost] += np.where(context >= 0, self.backoff[context], 0)
            elif len(lost):
                total[lost] += -15.0
            open_ = np.concatenate([open_[~long_enough], lost])
        return np.add.reduceat(total, begin)


def score_by_broadcast(docs: DataFrame, model: HashedModel, remembered: int = 150_000) -> DataFrame:
    """Counts and the summed log probability of all words, per document (id, text, lang). A task remembers the scores of at most
    ``remembered`` words, of all languages together, beside those of the texts at hand."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        known: dict[str, dict[bytes, float]] = defaultdict(dict)
        for batch in slices_by_bytes(batches, most=1 << 20):
            rows = list(zip(*[batch.column(k).to_pylist() for k in range(4)]))
            for at in range(0, len(rows), 512):
                lots, new = [], defaultdict(set)
                for i, text, lang, th in rows[at : at + 512]:
                    lower = (text or "").lower().encode().split()
                    lots.append((i, th, lang, text or "", lower))
                    new[lang].update(lower)
                if sum(map(len, known.values())) > remembered:
                    known.clear()
                for lang, words in new.items():
                    cache = known[lang]
                    fresh = [w for w in words if w not in cache]
                    cache.update(zip(fresh, shared.value.score(lang, [w.decode() for w in fresh]).tolist()))
                out = [(i, th, lang, *text_stats(text, text.encode().split()), len(text.lower()) - sum(map(text.count, SPACES)) + len(lower), sum(map(known[lang].__getitem__, lower))) for i, th, lang, text, lower in lots]
                cols = list(zip(*out))
                kinds = [pa.int64(), pa.int64(), pa.string()] + [pa.int64()] * (len(STATS) + 1) + [pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["id", "th", "lang", *STATS, "units", "logp"])

    return docs.select("id", "text", "lang", "th").mapInArrow(tidied(run), SCORES)


def score_texts(docs: DataFrame, model: HashedModel) -> DataFrame:
    """As ``score_by_broadcast`` for a model of running text: every character is scored where it stands. Of a model in parts,
    the later ones give id, th, lang and logp only."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    counted = model.part == 0

    def run(batches):
        for batch in slices_by_bytes(batches, most=1 << 20):
            rows = list(zip(*[batch.column(k).to_pylist() for k in range(4)]))
            lines, places, logp = [running(r[1]) for r in rows], defaultdict(list), np.zeros(len(rows))
            for at, (r, line) in enumerate(zip(rows, lines)):
                if line:
                    places[r[2]].append(at)
            for lang, at in places.items():
                logp[at] = shared.value.score_marked(lang, [lines[k] for k in at])
            if counted:
                out = [(i, th, lang, *text_stats(text or "", (text or "").encode().split()), max(len(line) - 1, 0)) for (i, text, lang, th), line in zip(rows, lines)]
            else:
                out = [(i, th, lang) for i, _, lang, th in rows]
            kinds = [pa.int64(), pa.int64(), pa.string()] + [pa.int64()] * (len(out[0]) - 3)
            yield pa.RecordBatch.from_arrays([*[pa.array(c, k) for c, k in zip(zip(*out), kinds)], pa.array(logp)], names)

    schema = SCORES if counted else "id long, th long, lang string, logp double"
    names = schema.replace(",", "").split()[0::2]
    return docs.select("id", "text", "lang", "th").mapInArrow(tidied(run), schema)


def score_texts_by_parts(docs: DataFrame, grams: DataFrame, order: int, parts: int) -> DataFrame:
    """As ``score_texts`` for a model too large to send to every task at once: its parts go over the texts one after another, each
    scores the characters that are its own, and the sums of a document are added. Nothing of the texts is written or shuffled."""
    scored = [stage(score_texts(docs, HashedModel.of(grams, order, k, parts)), "part-scores") for k in range(parts)]
    # Rows with the same id, text and language have the same scores: each gets the mean over them.
    rest = reduce(DataFrame.unionAll, scored[1:]).groupBy("id", "th", "lang").agg((F.sum("logp") / (F.count("*") / (parts - 1))).alias("logp"))
    rest = rest.select(F.col("id").alias("r_id"), F.col("th").alias("r_th"), F.col("lang").alias("r_lang"), F.col("logp").alias("r_logp"))
    same = F.col("id").eqNullSafe(F.col("r_id")) & (F.col("th") == F.col("r_th")) & (F.col("lang") == F.col("r_lang"))
    return scored[0].join(rest, same).withColumn("logp", F.col("logp") + F.col("r_logp")).select(*scored[0].columns)


def backed_off(lost: DataFrame, grams: DataFrame) -> DataFrame:
    """(lang, gram, logp) of grams without a probability of their own: that of the longest known end, -15 if there is none,
    plus the backoff weights of the contexts on the way to it."""
    ends = lost.select("lang", "gram", F.explode(F.sequence(F.lit(1), F.length("gram"))).alias("k")).selectExpr(
        "lang", "gram", "k", "substring(gram, length(gram) - k + 1) AS shorter", "substring(gram, length(gram) - k + 1, k - 1) AS context"
    )
    shares = grams.where("logp is not null").select("lang", F.col("gram").alias("shorter"), "logp")
    weights = grams.where("gram <> ''").select("lang", F.col("gram").alias("context"), "backoff")
    met = ends.join(shares, ["lang", "shorter"], "left").join(weights, ["lang", "context"], "left")
    steps = met.groupBy("lang", "gram").agg(F.array_sort(F.collect_list(F.struct("k", "logp", F.coalesce("backoff", F.lit(0.0)).alias("backoff")))).alias("steps"))
    # From the shortest end up: a known one starts anew, an unknown one adds the weight of its context.
    total = F.aggregate("steps", F.lit(-15.0), lambda below, x: F.coalesce(x["logp"], below + x["backoff"]))
    return steps.select("lang", "gram", total.alias("logp"))


def score_by_join(docs: DataFrame, words: DataFrame, grams: DataFrame, order: int) -> DataFrame:
    """The same for a model too large to send to every task: words get their sums by joining their grams with the model, and
    documents theirs by joining their words with that table. Grams that the model lacks back off as in ``HashedModel.score``."""
    marked = words.select("lang", "word", F.concat(F.lit(BEGIN), F.col("word"), F.lit(END)).alias("marked"))
    at = marked.select("lang", "word", "marked", F.explode(F.sequence(F.lit(2), F.length("marked"))).alias("i"))
    asked = at.select("lang", "word", F.substring("marked", F.greatest(F.col("i") - order + 1, F.lit(1)), F.least(F.col("i"), F.lit(order))).alias("gram"))
    asked = stage(asked, "asked")
    own = grams.where("logp is not null").select("lang", "gram", "logp")
    known = own.union(backed_off(asked.select("lang", "gram").distinct().join(own, ["lang", "gram"], "left_anti"), grams))
    scored = stage(asked.join(known, ["lang", "gram"]).groupBy("lang", "word").agg(F.sum("logp").alias("logp")), "word-scores")

    def run(batches):
        for batch in batches:
            for i, text, lang, th, number in zip(*[batch.column(k).to_pylist() for k in range(5)]):
                text = text or ""
                lower = text.lower().encode().split()
                units = len(text.lower()) - sum(map(text.count, SPACES)) + len(lower)
                stats = text_stats(text, text.encode().split())
                row = {"number": number, "id": i, "th": th, "lang": lang} | dict(zip(STATS, stats)) | {"units": units}
                found = Counter(lower) or {b"": 0}
                yield pa.RecordBatch.from_pylist([row | {"word": w.decode(), "n": n} for w, n in found.items()], schema)

    kinds = [("number", pa.int64()), ("id", pa.int64()), ("th", pa.int64()), ("lang", pa.string()), *[(s, pa.int64()) for s in STATS], ("units", pa.int64()), ("word", pa.string()), ("n", pa.int64())]
    schema = pa.schema(kinds)
    numbered = docs.select("id", "text", "lang", "th", F.monotonically_increasing_id().alias("number"))
    asked = numbered.mapInArrow(tidied(run), ", ".join(f"{n} {'string' if t == pa.string() else 'long'}" for n, t in kinds))
    whole = [c for c in SCORES.replace(",", "").split()[0::2] if c != "logp"]
    return asked.join(scored, ["lang", "word"], "left").groupBy("number", *whole).agg(F.sum(F.coalesce(F.col("logp") * F.col("n"), F.lit(0.0))).alias("logp")).drop("number")


def perplexity_bands(scores: DataFrame, reach: float, step: float = 0.002) -> DataFrame:
    """(lang, low, high): the quartiles of log perplexity among reference documents (``word_counts``) that pass the base rules,
    widened by ``reach`` times their distance. Quartiles are read off counts in steps of ``step``, so they are sums that any order of tasks repeats."""
    bins = scores.where("not base_failed and reference").groupBy("lang", F.floor(F.col("log_ppl") / step).alias("bin")).agg(F.count("*").alias("n"))
    upto = Window.partitionBy("lang").orderBy("bin")
    share = bins.select("lang", "bin", (F.sum("n").over(upto) / F.sum("n").over(Window.partitionBy("lang"))).alias("share"))
    q = share.groupBy("lang").agg(*[(F.min(F.when(F.col("share") >= x, F.col("bin"))) * step).alias(name) for x, name in ((0.25, "q1"), (0.75, "q3"))])
    reach_ = (F.col("q3") - F.col("q1") + step) * reach
    return q.select("lang", (F.col("q1") - reach_).alias("low"), (F.col("q3") + reach_ + step).alias("high"))


def quality_rules(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    order: int = 5, reach: float = 3.0, noise: float = 1.0, least_words: int = 10, repeat_percent: int = 20, model_rows: int = 2_000_000,
    symbol_percent: int = 10, least_docs: int = 1, across: bool = False, passes: int = 16,
) -> DataFrame:
    """Counts, perplexity and verdict per document: id, th (hash of the text), lang, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, log_ppl, low, high, kept. Other columns are not read.

    base_failed: fewer than ``least_words`` words, or more than ``repeat_percent`` % of them in repeated 5-word windows.
    kept: not base_failed, and the log perplexity per character lies in the language's band (``perplexity_bands``), widened on
    both sides by ``noise`` / sqrt(characters), the spread of a mean over so few characters.

    The model and the quartiles come from reference documents, those with at most ``symbol_percent`` symbols per 100 words; all
    are judged. With ``least_docs`` = 2 a word has to be in two of them to count, so no document vouches for words of its own.

    With ``across`` the model is one of running text: contexts cross words, so the order of words tells too, each occurrence in a
    reference document counts, and ``least_docs`` applies to grams. Without it, it is one of the characters inside words, each word
    counted once a document.

    * A language without reference documents has no band and keeps none.
    * Null or empty text: no words, base_failed. Null language: a language of its own, '' in the result.
    * Repeated rows and rows with one id are judged each; an empty table gives no rows.

    Words or grams are counted by Spark over all documents, the model is made of joins and sums of grams. It goes to the tasks as
    sorted hash arrays if it has at most ``model_rows`` grams (16 bytes of each). A larger one of running text goes there in parts
    of about that size, which read the texts one after another (at most ``passes`` times, so parts of a model beyond ``passes`` *
    ``model_rows`` are larger); a larger one of words stays a table and is joined."""
    spark = docs.sparkSession
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.coalesce(F.col(lang_col), F.lit("")).alias("lang")).withColumn("th", F.xxhash64("text"))
    if across:
        grams = stage(smoothed(text_grams(d, order, symbol_percent=symbol_percent).where(F.col("docs") >= least_docs)), "model")
    else:
        words = stage(word_counts(d, symbol_percent=symbol_percent), "words")
        grams = stage(kneser_ney(words.where(F.col("docs") >= least_docs), order), "model")
    size, contexts = grams.agg(F.count("*"), F.count_if(F.length("gram") < order)).first()
    small = size <= model_rows
    if across and not small:
        # A gram that is also a context may stand in two parts.
        raw = score_texts_by_parts(d, grams, order, max(2, min(passes, -(-(size + contexts) // max(model_rows, 1)))))
    elif across:
        raw = score_texts(d, HashedModel.of(grams, order))
    elif small:
        raw = score_by_broadcast(d, HashedModel.of(grams, order))
    else:
        raw = score_by_join(d, words, grams, order)
    failed = (F.col("n_words") < least_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * repeat_percent)
    scores = stage(raw.withColumn("log_ppl", F.try_divide(-F.col("logp"), F.col("units"))).withColumns({"base_failed": failed, "reference": F.col("n_symbols") * 100 <= F.col("n_words") * symbol_percent}), "scores")
    bands = stage(perplexity_bands(scores, reach), "bands").withColumnRenamed("lang", "band_lang")
    met = scores.join(F.broadcast(bands) if bands.count() <= 10_000 else bands, F.col("lang") == F.col("band_lang"), "left")
    slack = F.try_divide(F.lit(noise), F.sqrt(F.col("units")))
    met = met.withColumns({"low": F.col("low") - slack, "high": F.col("high") + slack})
    kept = ~F.col("base_failed") & F.coalesce(F.col("log_ppl").between(F.col("low"), F.col("high")), F.lit(False))
    return met.select(F.col("id").alias(id_col), "th", "lang", *STATS, "base_failed", "log_ppl", "low", "high", kept.alias("kept"))


def keep_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """The documents that ``quality_rules`` keeps, with all their columns."""
    found = quality_rules(docs, id_col, text_col, lang_col, **options)
    gone = stage(found.where("not kept").select(F.col(id_col).alias("gone id"), F.col("th").alias("gone th"), F.col("lang").alias("gone lang")).distinct(), "rejected")
    same = docs[id_col].eqNullSafe(F.col("gone id")) & (F.xxhash64(docs[text_col]) == F.col("gone th")) & (F.coalesce(docs[lang_col], F.lit("")) == F.col("gone lang"))
    return docs.join(beside(gone), same, "left_anti")
