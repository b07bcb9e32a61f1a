"""Byte-level BPE encoding and decoding of whole corpora, by forced boundaries.

A pair of neighbouring bytes that no token of the vocabulary has inside it can never be joined by a merge, since every
merge makes a token. So a token ends between the two for certain, and what lies on both sides can be encoded by itself:
the ids of a text are those of its fragments, one after the other."""

from __future__ import annotations

import heapq
import json
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuemill.llm.common import slices_by_bytes

# The characters with the Unicode property White_Space, and the pattern by which this family of files cuts a
# text before merging.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?{letter}+| ?{number}+| ?{other}+|[{white}]+(?![^{white}])|[{white}]+"
CROWDED = re.compile(r"\s\s|\s\Z|\0")
LONG_FRAGMENT = 48
NEVER = np.iinfo(np.int64).max
ENCODED = "doc_id long, n_tokens long, ids binary"


def letters_of_bytes() -> list[str]:
    """The letter that such a file writes for each byte: printable Latin-1 stands for itself, the others follow from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in shown else next(others)) for b in range(256)]


class Vocabulary:
    """What a tokenizer file says: tokens as bytes, merges by rank, added tokens, and ``inside[a, b]``: whether any token has
    byte b right after byte a. A file with settings that this encoder doesn't follow is refused."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model, cut, back = file["model"], file.get("pre_tokenizer") or {}, file.get("decoder") or {}
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
        if model.get("type") != "BPE" or file.get("normalizer") or odd or file.get("post_processor"):
            raise ValueError(f"{path}: not a plain byte-level BPE file {odd}")
        if cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True) or back.get("type") != "ByteLevel":
            raise ValueError(f"{path}: texts are cut or joined in another way")
        added = file.get("added_tokens", [])
        if any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError(f"{path}: added tokens with conditions")
        self.added = {t["content"]: t["id"] for t in added if t["content"]}
        letters = letters_of_bytes()
        byte_of = {c: b for b, c in enumerate(letters)}

        def as_bytes(token: str) -> bytes:
            try:
                return bytes([byte_of[c] for c in token])
            except KeyError:
                return token.encode()

        vocab = model["vocab"]
        self.tokens = [b""] * (max([*vocab.values(), *self.added.values()]) + 1)
        for t, i in [*vocab.items(), *self.added.items()]:
            self.tokens[i] = as_bytes(t)
        self.byte_ids = [vocab[c] for c in letters]
        self.merges = {}
        for rank, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            self.merges[vocab[a], vocab[b]] = (rank, vocab[a + b])
        pairs = np.array([[*p, *m] for p, m in self.merges.items()], np.int64).reshape(-1, 4)
        order = np.argsort(pairs[:, 0] << 32 | pairs[:, 1])
        self.pair_keys = np.append((pairs[:, 0] << 32 | pairs[:, 1])[order], np.iinfo(np.int64).max)
        self.pair_ranks, self.pair_made = np.append(pairs[order, 2], NEVER), np.append(pairs[order, 3], 0)
        self.inside = np.zeros((256, 256), bool)
        whole = np.frombuffer(b"".join(as_bytes(t) for t in vocab), np.uint8)
        ends = np.cumsum([len(as_bytes(t)) for t in vocab])
        within = np.ones(len(whole), bool)
        within[ends - 1] = False
        at = np.flatnonzero(within[:-1])
        self.inside[whole[at], whole[at + 1]] = True


@lru_cache(maxsize=1)
def pretokens():
    """A function that cuts a text by the pattern. The regex library may know letters of a later Unicode version than the
    tokenizers library, so the characters too new for ``unicodedata`` are asked for: those that do not continue a letter or a
    number there are neither."""
    import unicodedata

    import regex
    from tokenizers.pre_tokenizers import ByteLevel

    parts = ByteLevel(add_prefix_space=False).pre_tokenize_str

    known = regex.findall(r"[\p{L}\p{N}]", "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)])))
    spans = []
    for c in (ord(c) for c in known if unicodedata.category(c) == "Cn" and len(parts("a" + c)) > 1 and len(parts("1" + c)) > 1):
        if spans and spans[-1][1] == c - 1:
            spans[-1][1] = c
        else:
            spans.append([c, c])
    plain = regex.compile(PATTERN.format(letter=r"\p{L}", number=r"\p{N}", other=rf"[^{WHITE}\p{{L}}\p{{N}}]", white=WHITE)).findall
    if not spans:
        return plain
    late = "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in spans)
    letter, number = (rf"[\p{{{k}}}--[{late}]]" for k in "LN")
    careful = regex.compile(PATTERN.format(letter=letter, number=number, other=rf"[[^{WHITE}\p{{L}}\p{{N}}]||[{late}]]", white=WHITE), regex.V1).findall
    any_late = regex.compile(f"[{late}]").search
    least = chr(spans[0][0]).encode()[0]

    def cut(text: str) -> list[str]:
        new = not text.isascii() and np.frombuffer(text.encode(), np.uint8).max() >= least and any_late(text)
        return careful(text) if new else plain(text)

    return cut


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def cut_at_blanks(text: str, marks: str = " \n") -> list[str]:
    """Cut a text before each of ``marks`` that stands alone between two characters that are not white space: no match of the
    pattern above reaches over such a place."""
    if CROWDED.search(text):
        return [p for p in re.split(rf"(?<=\S)(?=[{marks}]\S)", text) if p]
    for c in marks:
        text = text.replace(c, "\0" + c)
    return [p for p in text.split("\0") if p]


class Encoder(dict):
    """Bytes of the little-endian 32-bit ids per stretch of text, each encoded once while it is remembered; what is remembered
    is bounded by ``memory`` bytes beside the stretches of the batch at hand. With ``added``, the added tokens of the file are
    found in texts and have their own ids; without, their strings are plain text."""

    def __init__(self, path: str, added: bool = True, memory: int = 48 << 20):
        self.v, self.memory, self.held = vocabulary(path), memory, 0
        self.words = pretokens()
        names = sorted(self.v.added, key=len, reverse=True) if added else []
        self.names = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None
        self.own = {n: array("I", [self.v.added[n]]).tobytes() for n in names}
        self.update(self.own)

    def encode_batch(self, texts: list[str], block: int = 200_000) -> list[bytes]:
        parts = [self.stretches(t) for t in texts]
        if self.held > self.memory:
            self.clear()
            self.update(self.own)
            self.held = 0
        if max(map(len, parts), default=0) > block:
            return [b"".join(i for at in range(0, len(p), block) for i in self.known(p[at : at + block])) for p in parts]
        self.learn(set().union(*parts).difference(self))
        return [b"".join(map(self.__getitem__, p)) for p in parts]

    def encode(self, text: str) -> bytes:
        return self.encode_batch([text])[0]

    def known(self, stretches: list[str]) -> list[bytes]:
        if self.held > self.memory:
            self.clear()
            self.update(self.own)
            self.held = 0
        self.learn(set(stretches).difference(self))
        return list(map(self.__getitem__, stretches))

    def stretches(self, text: str) -> list[str]:
        if not self.names:
            return cut_at_blanks(text)
        out = []
        for k, part in enumerate(self.names.split(text)):
            out += [part] if k % 2 else cut_at_blanks(part)
        return out

    def learn(self, new: set[str]) -> None:
        """Encode stretches that are not remembered, all in one go."""
        if not new:
            return
        plain = [s for s in new if s[0] in " \n" and not s[1:2].isspace() and not s[-1].isspace()]
        odd = list(new.difference(plain))
        words = self.words("".join(plain))
        for s in odd:
            words += self.words(s)
        stretches = plain + odd
        text = np.frombuffer("".join(stretches).encode(), np.uint8)
        # Places of the bytes that begin a character; ends in characters become ends in bytes.
        begins = np.append(np.flatnonzero(text & 0xC0 != 0x80), len(text))
        ids, places = self.merge(text, begins[np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))])
        ends = begins[np.cumsum(np.fromiter(map(len, stretches), np.int64, len(stretches)))]
        at = [0, *(4 * np.searchsorted(places, ends)).tolist()]
        buffer = ids.astype("<u4").tobytes()
        self.update(zip(stretches, [buffer[a:b] for a, b in zip(at, at[1:])]))
        self.held += 220 * len(stretches) + len(text) + len(buffer)

    def fragments(self, word: bytes) -> list[bytes]:
        """One word, cut between two bytes that no token has side by side."""
        at = np.flatnonzero(self.cuts(np.frombuffer(word, np.uint8))).tolist()
        return [word[i:j] for i, j in zip(at, at[1:])]

    def cuts(self, text: np.ndarray) -> np.ndarray:
        """For each place of a text, its start and its end, whether no token can reach over it."""
        cut = np.ones(len(text) + 1, bool)
        cut[1:-1] = ~self.v.inside[text[:-1], text[1:]]
        return cut

    def merge(self, text: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and first bytes of the tokens of words that end at ``ends``. Words are cut where no token has the two bytes side by
        side; in every fragment, the pair of lowest rank is joined, the first of equal ones, until no pair has a rank. A round
        does so in all fragments at once."""
        if not len(text):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        v = self.v
        cut = self.cuts(text)
        cut[ends] = True
        starts = np.flatnonzero(cut)
        sizes = np.diff(starts)
        done_ids, done_at = [], []
        for k in np.flatnonzero(sizes > LONG_FRAGMENT):
            a = int(starts[k])
            made = merge_long([v.byte_ids[b] for b in text[a : a + int(sizes[k])].tolist()], v.merges)
            done_ids.append(np.array(made))
            done_at.append(a + np.cumsum([0, *[len(v.tokens[i]) for i in made[:-1]]]))
        short = np.repeat(sizes <= LONG_FRAGMENT, sizes)
        at = np.flatnonzero(short)
        ids, group = np.array(v.byte_ids)[text[at]], np.repeat(np.arange(len(sizes)), sizes)[at]

        def pair_of(left, right):
            key = ids[left] << 32 | ids[right]
            k = np.searchsorted(v.pair_keys, key)
            return np.where(v.pair_keys[k] == key, k, len(v.pair_ranks) - 1)

        last = np.append(group[1:] != group[:-1], True) if len(group) else np.zeros(0, bool)
        pair = np.full(len(ids), len(v.pair_ranks) - 1)
        inner = np.flatnonzero(~last)
        pair[inner] = pair_of(inner, inner + 1)
        while len(ids):
            rank = v.pair_ranks[pair]
            first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
            sizes = np.diff(np.append(first, len(ids)))
            least = np.minimum.reduceat(rank, first)
            live = np.repeat(least < NEVER, sizes)
            if not live.all():
                done_ids.append(ids[~live])
                done_at.append(at[~live])
                if not live.any():
                    break
                best = np.repeat(least, sizes)[live]
                ids, at, group, pair, rank = ids[live], at[live], group[live], pair[live], rank[live]
            else:
                best = np.repeat(least, sizes)
            hit = np.flatnonzero(rank == best)
            hit = hit[np.append(True, group[hit][1:] != group[hit][:-1])]
            ids[hit] = v.pair_made[pair[hit]]
            keep = np.ones(len(ids), bool)
            keep[hit + 1] = False
            moved = hit - np.arange(len(hit))
            ids, at, group, pair = ids[keep], at[keep], group[keep], pair[keep]
            for left in (moved - 1, moved):
                left = left[left >= 0]
                ok = np.flatnonzero(left + 1 < len(ids))
                joint = np.zeros(len(left), bool)
                joint[ok] = group[left[ok]] == group[left[ok] + 1]
                pair[left[~joint]] = len(v.pair_ranks) - 1
                left = left[joint]
                pair[left] = pair_of(left, left + 1)
        ids, at = np.concatenate(done_ids), np.concatenate(done_at)
        order = np.argsort(at)
        return ids[order], at[order]


def merge_long(ids: list[int], merges: dict) -> list[int]:
    """The same for a long fragment: pairs wait in a heap by rank and place, tokens are a linked list; n log n steps."""
    n = len(ids)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(m[0], i, ids[i], ids[i + 1], m[1]) for i in range(n - 1) if (m := merges.get((ids[i], ids[i + 1])))]
    heapq.heapify(heap)
    while heap:
        _, i, a, b, made = heapq.heappop(heap)
        j = after[i]
        if ids[i] != a or j >= n or ids[j] != b:
            continue
        ids[i], ids[j] = made, -1
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if m := merges.get((made, ids[k])):
                heapq.heappush(heap, (m[0], i, made, ids[k], m[1]))
        h = before[i]
        if h >= 0 and (m := merges.get((ids[h], made))):
            heapq.heappush(heap, (m[0], h, ids[h], made, m[1]))
    return [i for i in ids if i >= 0]


def encode_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", added: bool = True) -> DataFrame:
    """One row (doc_id, n_tokens, ids) per row of ``docs``: the ids of the whole text as little-endian 32-bit integers.

    ``tokenizer`` is the path of a byte-level BPE file that every worker can read. Null and empty texts have no tokens. Rows
    without id, with one id or repeated rows are encoded like all others; other columns are not read. No shuffle."""

    def run(batches):
        encoder = Encoder(tokenizer, added)
        for part in slices_by_bytes(batches, most=1 << 20):
            ids = encoder.encode_batch([t or "" for t in part.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "n_tokens", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, ENCODED)


def decode_documents(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """Add ``decoded`` to rows with ``ids`` as ``encode_documents`` makes them: the text they stand for, added tokens with
    their strings. Bytes that are no UTF-8 become U+FFFD; ids beyond the vocabulary stand for nothing. Null ids give null."""
    from pyspark.sql.types import StringType, StructType

    schema = StructType([f for f in encoded.schema if f.name != "decoded"]).add("decoded", StringType())
    names = [f.name for f in schema][:-1]

    def run(batches):
        tokens = vocabulary(tokenizer).tokens
        for part in slices_by_bytes(batches, names.index("ids")):
            texts = []
            for ids in part.column(names.index("ids")).to_pylist():
                if ids is None:
                    texts.append(None)
                    continue
                at = np.frombuffer(ids, "<u4")
                if len(at) and at.max() >= len(tokens):
                    at = at[at < len(tokens)]
                texts.append(b"".join(map(tokens.__getitem__, at.tolist())).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*names, "decoded"])

    return encoded.select(*[F.col(f"`{c}`") for c in names]).mapInArrow(run, schema)
