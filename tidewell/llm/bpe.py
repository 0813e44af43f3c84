"""BPE encoding and decoding by batched numpy merge rounds.

Words of many texts are cut out by array operations on code points and looked up in a bounded cache of encoded
words, by their own bytes: short words as one 64-bit number that holds all of them, longer ones as byte strings.
Words not yet seen are encoded together: their symbols stand in one flat array, the rank of every adjacent pair is
found by binary search over the sorted pair keys of the merge table, and in each round every word merges all places
of its lowest-ranked pair. In a word of more than LONG symbols only the places of that pair and their neighbours
are looked at in a round, which merges the same pairs in the same order.

What is a letter, a digit or white space is the library's own view: each code point that comes up is put to its
pre-tokenizer once. Normalising is the library's too, but for texts of letters on which Unicode has long been
settled (STABLE), where Python's is the same.

Null and empty texts give no ids. Texts may hold the strings of special tokens, which become their ids, as the
vocabulary's own library does by default. Repeated rows are encoded alike. Other columns are left out, whatever
their names.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidewell.llm.common import chunks, documents, once, released

#: Bytes that a worker's cache of encoded words takes, about, before it starts anew.
CACHE_BYTES = 32 << 20
#: Symbols from which on a word is merged by places.
LONG = 2048
#: Texts are normalised in pieces of about this many letters, cut before an ASCII letter, which never joins what is before it.
PIECE = 1 << 16

L, N, OTHER, SPACE, BREAK, UNKNOWN = range(6)
#: ASCII, Latin, Greek and Cyrillic with combining marks, general punctuation, kana, Han and Hangul.
STABLE = "[^\x00-\u036f\u0400-\u052f\u2010-\u2027\u2030-\u205e\u3041-\u3094\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3]"


def classes() -> np.ndarray:
    """L, N, OTHER, SPACE or BREAK of each code point by Python's tables."""

    def make():
        kinds = {"L": L, "N": N}
        out = np.array([kinds.get(unicodedata.category(chr(i))[0], OTHER) for i in range(0x110000)], np.uint8)
        out[[i for i in range(0x3001) if chr(i).isspace() and not 0x1C <= i <= 0x1F]] = BREAK
        out[0x20] = SPACE
        return out

    return once("classes", make)


def folded() -> np.ndarray:
    """Each code point in lower case, where that is one code point."""

    def make():
        out = np.arange(0x110000, dtype=np.uint32)
        for i in range(0x1E944):
            low = chr(i).lower()
            if len(low) == 1:
                out[i] = ord(low)
        return out

    return once("folded", make)


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + rest.index(b)) for b in range(256)]


class Cutter:
    """Cuts texts into the words of a pre-tokenizer, of which it learns the class of each code point by asking.

    attach_space: a space before a word belongs to it and other white space is kept; otherwise white space goes and
    each digit is a word.
    """

    def __init__(self, pre_tokenize: Callable[[str], list], attach_space: bool) -> None:
        self.pieces, self.attach = lambda text: len(pre_tokenize(text)), attach_space
        self.kinds = np.full(0x110000, UNKNOWN, np.uint8)

    def kind(self, c: str) -> int:
        if self.pieces(f"a{c}a") == 1:
            return L
        if self.pieces(f"!{c}!") == 1:
            return OTHER
        if self.pieces(f"1{c}1") == (1 if self.attach else 3):
            return N
        return SPACE if c == " " else BREAK

    def classes(self, cps: np.ndarray) -> np.ndarray:
        out = self.kinds[cps]
        if (out == UNKNOWN).any():
            for i in np.unique(cps[out == UNKNOWN]).tolist():
                self.kinds[i] = self.kind(chr(i))
            out = self.kinds[cps]
        return out

    def cut(self, texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
        """The joined texts in UTF-8, and each word's text index, start and end in bytes."""
        joined = "".join(texts)
        raw = joined.encode("utf-8", "surrogatepass")
        plain = len(raw) == len(joined)
        cps = np.frombuffer(raw, np.uint8) if plain else np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        n = len(cps)
        bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        c = self.classes(cps)
        first, last = np.zeros(n + 1, bool), np.zeros(n + 1, bool)
        first[bounds], last[bounds] = True, True
        first, last = first[:n], last[1:]
        prev, after = np.empty(n, np.uint8), np.empty(n, np.uint8)
        prev[1:], after[:-1] = c[:-1], c[1:]
        prev[:1], after[-1:] = BREAK, BREAK
        white, prev_white, after_white = c >= SPACE, prev >= SPACE, after >= SPACE
        if self.attach:
            start = np.where(white, first | ~prev_white | (~after_white & ~last), first | (prev == BREAK) | (~prev_white & (prev != c)))
        else:
            start = ~white & (first | prev_white | (prev != c) | (c == N))
        quotes = np.flatnonzero((cps == 39) & start)
        if len(quotes):  # 's, 't, 're, 've, 'm, 'll and 'd are words where a word can begin, whatever letters follow
            to = bounds[np.searchsorted(bounds, quotes, side="right")]
            one, two = (np.where(quotes + k < to, cps[np.minimum(quotes + k, n - 1)], 0) for k in (1, 2))
            short = np.isin(one, [ord(x) for x in "stmd"])
            long = np.isin(one * 256 + np.minimum(two, 255), [ord(x) * 256 + ord(y) for x, y in ("re", "ve", "ll")])
            for hit, size in ((short, 2), (long, 3)):
                at, end = quotes[hit], to[hit]
                start[at + 1] = False
                behind = (at + size)[at + size < end]
                start[behind] |= ~white[behind]
        starts = np.flatnonzero(start)
        ends = np.append(starts[1:], n)
        doc = np.searchsorted(bounds, starts, side="right") - 1
        ends = np.minimum(ends, bounds[doc + 1])
        if not self.attach:  # white space after a word isn't part of it
            gap = np.flatnonzero(white)
            at = np.searchsorted(gap, starts)
            nearest = np.where(at < len(gap), np.append(gap, n)[np.minimum(at, len(gap))], n)
            ends = np.minimum(ends, nearest)
        if not plain:
            place = np.concatenate([[0], np.cumsum(1 + (cps >= 0x80).astype(np.int8) + (cps >= 0x800) + (cps >= 0x10000), dtype=np.int64)])
            starts, ends = place[starts], place[ends]
        return raw, doc, starts, ends


class Words:
    """A cache of encoded words, by their bytes: sorted numbers for those of 7 at most, a dict for the others."""

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], cutter: Cutter, most: int = CACHE_BYTES) -> None:
        self.encode, self.cutter, self.most = encode, cutter, most
        self.clear()

    def clear(self) -> None:
        self.keys, self.row, self.long, self.bytes = np.zeros(0, np.uint64), np.zeros(0, np.int64), {}, 0
        self.at, self.size, self.pool, self.used = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1 << 16, np.uint32), 0

    def add(self, words: list[bytes]) -> np.ndarray:
        """The rows of new words."""
        ids, sizes = self.encode(words)
        if self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(len(self.pool), len(ids)), np.uint32)])
        self.pool[self.used : self.used + len(ids)] = ids
        rows = len(self.at) + np.arange(len(words))
        self.at = np.concatenate([self.at, self.used + np.cumsum(sizes) - sizes])
        self.size = np.concatenate([self.size, sizes])
        self.used += len(ids)
        self.bytes += 4 * len(ids) + sum(32 if len(w) < 8 else 150 + len(w) for w in words)
        return rows

    def texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and the number of ids of each."""
        if self.bytes > self.most:
            self.clear()
        raw, doc, starts, ends = self.cutter.cut(texts)
        length = ends - starts
        short = length < 8
        row = np.empty(len(starts), np.int64)
        padded = np.zeros(len(raw) + 8, np.uint8)
        padded[: len(raw)] = np.frombuffer(raw, np.uint8)
        wide = np.ndarray(len(raw) + 1, np.uint64, padded, strides=(1,))
        n = length[short].astype(np.uint64)
        key = wide[starts[short]] & (np.uint64(1) << np.uint64(8) * n) - np.uint64(1) | n << np.uint64(56)
        seen, index, back = np.unique(key, return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, seen)
        known = np.zeros(len(seen), bool)
        if len(self.keys):
            known = self.keys[np.minimum(at, len(self.keys) - 1)] == seen
        new = np.flatnonzero(~known)
        if len(new):
            a, b = (x[short][index[new]].tolist() for x in (starts, ends))
            rows = self.add([raw[i:j] for i, j in zip(a, b, strict=True)])
            self.keys, self.row = np.insert(self.keys, at[new], seen[new]), np.insert(self.row, at[new], rows)
            at = np.searchsorted(self.keys, seen)
        if len(seen):
            row[short] = self.row[at][back.reshape(-1)]
        words = [raw[i:j] for i, j in zip(starts[~short].tolist(), ends[~short].tolist(), strict=True)]
        fresh = [w for w in dict.fromkeys(words) if w not in self.long]
        if fresh:
            self.long.update(zip(fresh, self.add(fresh).tolist(), strict=True))
        row[~short] = list(map(self.long.__getitem__, words))
        sizes = self.size[row]
        total = int(sizes.sum())
        base = np.cumsum(sizes) - sizes
        ids = self.pool[np.repeat(self.at[row] - base, sizes) + np.arange(total)]
        return ids, np.bincount(doc, weights=sizes, minlength=len(texts)).astype(np.int64)


class Merges:
    """Batched merge rounds over the symbols of many words."""

    def __init__(self, path: str) -> None:
        spec = json.loads(Path(path).read_text())
        model = spec["model"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ", 1)) for m in model["merges"]]
        v: dict[str, int] = model["vocab"]
        keys = np.array([v[a] << 32 | v[b] for a, b in pairs], np.uint64)
        made = np.array([v[a + (b if not model.get("continuing_subword_prefix") else b[len(model["continuing_subword_prefix"]) :])] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.made = keys[order], order.astype(np.int64), made
        end = model.get("end_of_word_suffix") or ""
        letters = byte_letters()
        self.plain = np.array([v.get(x, -1) for x in letters], np.int64)
        self.closing = np.array([v.get(x + end, -1) for x in letters], np.int64)
        if (self.plain < 0).any() or (self.closing < 0).any():
            raise ValueError("the vocabulary doesn't hold every byte")
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        names = {i: t for t, i in v.items()} | {i: t for t, i in self.special.items()}
        self.names = [names.get(i, "") for i in range(max(names) + 1)]

    NONE = np.int64(1 << 40)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], self.NONE)

    #: Words whose merge rounds run together; it bounds the flat arrays.
    TOGETHER = 16_384

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        ids, sizes = [], []
        long = [k for k, w in enumerate(words) if len(w) > LONG]
        for a, z in zip([-1, *long], [*long, len(words)], strict=True):
            for at in range(a + 1, z, self.TOGETHER):
                i, n = self._rounds(words[at : min(z, at + self.TOGETHER)])
                ids.append(i)
                sizes.append(n)
            if z < len(words):
                ids.append(self._places(words[z]))
                sizes.append(np.array([len(ids[-1])]))
        return np.concatenate(ids), np.concatenate(sizes)

    def _places(self, word: bytes) -> np.ndarray:
        """One word by the places of its lowest-ranked pair, which a heap of ranks gives; links lead over what has merged."""
        data = np.frombuffer(word, np.uint8)
        n = len(data)
        sym = self.plain[data]
        sym[-1] = self.closing[data[-1]]
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        alive = np.ones(n, bool)
        waiting: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def add(at: np.ndarray) -> None:
            rank = self.ranks(sym[at], sym[after[at]])
            at, rank = at[rank < self.NONE], rank[rank < self.NONE]
            if not len(at):
                return
            order = np.argsort(rank, kind="stable")
            found, first = np.unique(rank[order], return_index=True)
            for r, own in zip(found.tolist(), np.split(at[order], first[1:]), strict=True):
                if r not in waiting:
                    waiting[r] = []
                    heapq.heappush(heap, r)
                waiting[r].append(own)

        add(np.arange(n - 1))
        while heap:
            r = heapq.heappop(heap)
            at = np.unique(np.concatenate(waiting.pop(r)))
            at = at[alive[at]]
            at = at[after[at] < n]
            at = at[self.ranks(sym[at], sym[after[at]]) == r]
            if not len(at):
                continue
            run = np.concatenate([[True], after[at[:-1]] != at[1:]])  # x x x: every second place, from the left
            begin = np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - begin) % 2 == 0]
            gone = after[at]
            sym[at], alive[gone] = self.made[r], False
            after[at] = after[gone]
            behind = after[at] < n
            before[after[at[behind]]] = at[behind]
            left = before[at][before[at] >= 0]
            add(np.unique(np.concatenate([left, at[behind]])))
        return sym[alive].astype(np.uint32)

    def _rounds(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        size = np.array([len(x) for x in raw], np.int64)
        data = np.frombuffer(b"".join(raw), np.uint8)
        ends = np.cumsum(size)
        sym = self.plain[data]
        sym[ends - 1] = self.closing[data[ends - 1]]
        word = np.repeat(np.arange(len(raw)), size)
        done_sym, done_word = [], []
        while len(sym):
            n = len(sym)
            rank = np.full(n, self.NONE)
            inside = np.flatnonzero(word[1:] == word[:-1])
            rank[inside] = self.ranks(sym[inside], sym[inside + 1])
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            best = np.minimum.reduceat(rank, first)
            count = np.diff(np.append(first, n))
            live = np.repeat(best < self.NONE, count)
            done_sym.append(sym[~live])
            done_word.append(word[~live])
            hit = (rank == np.repeat(best, count)) & live
            at = np.flatnonzero(hit)
            if len(at):  # of overlapping places (x x x) every second one, from the left, merges
                run = np.concatenate([[True], np.diff(at) != 1])
                begin = np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
                at = at[(np.arange(len(at)) - begin) % 2 == 0]
                sym[at] = self.made[rank[at]]
                live[at + 1] = False
            sym, word = sym[live], word[live]
        sym, word = np.concatenate(done_sym or [sym]), np.concatenate(done_word or [word])
        order = np.argsort(word, kind="stable")
        return sym[order].astype(np.uint32), np.bincount(word, minlength=len(raw)).astype(np.int64)


class Normal:
    """NFC and lower case, as the library's normalizer gives it but for white space, which isn't part of any word."""

    def __init__(self, normalize: Callable[[str], str]) -> None:
        self.normalize, self.other = normalize, re.compile(STABLE)
        self.ascii = re.compile("[\x00-\x7f]")

    def __call__(self, text: str) -> str:
        if text.isascii():
            return text.lower()
        if not self.other.search(text):
            return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        out, at = [], 0
        while at < len(text):
            m = self.ascii.search(text, at + PIECE)
            to = m.start() if m else len(text)
            out.append(self.normalize(text[at:to]))
            at = to
        return "".join(out)


class Encoder:
    """Whole texts to ids: strings of special tokens are cut out, the rest goes through the cache of words."""

    def __init__(self, words: Words, special: dict[str, int], normal: Callable[[str], str]) -> None:
        self.words, self.special, self.normal = words, special, normal
        self.pattern = re.compile("|".join(re.escape(x) for x in sorted(special, key=len, reverse=True))) if special else None

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many each text has."""
        marked = {k for k, t in enumerate(texts) if self.pattern and self.pattern.search(t)}
        if not marked:
            return self.words.texts([self.normal(t) for t in texts])
        parts, owner, fixed = [], [], []
        for k, t in enumerate(texts):
            at = 0
            for m in self.pattern.finditer(t) if k in marked else ():
                parts += [self.normal(t[at : m.start()]), ""]
                owner += [k, k]
                fixed += [-1, self.special[m[0]]]
                at = m.end()
            parts.append(self.normal(t[at:]))
            owner.append(k)
            fixed.append(-1)
        ids, sizes = self.words.texts(parts)
        fixed_at = np.flatnonzero(np.array(fixed) >= 0)
        place = np.cumsum(sizes)[fixed_at]
        ids = np.insert(ids, place, np.array(fixed, np.int64)[fixed_at])
        sizes[fixed_at] = 1
        return ids, np.bincount(owner, weights=sizes, minlength=len(texts)).astype(np.int64)


class Tokenizer(Encoder):
    """Encodes whole texts with a word-end vocabulary and decodes ids again."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer as Library

        merges = Merges(path)
        spec = json.loads(Path(path).read_text())
        library = Library.from_str(json.dumps(spec | {"model": spec["model"] | {"vocab": {}, "merges": []}, "added_tokens": []}))
        super().__init__(Words(merges.encode, Cutter(library.pre_tokenizer.pre_tokenize_str, attach_space=False)), merges.special, Normal(library.normalizer.normalize_str))
        self.names = merges.names

    def decode(self, ids: np.ndarray) -> str:
        """Without a decoder of its own, a vocabulary's tokens are joined by single spaces."""
        return " ".join(map(self.names.__getitem__, ids.tolist()))


def tokenizer(path: str) -> Tokenizer:
    return once(("tokenizer", path), lambda: Tokenizer(path))


def encode_column(docs: DataFrame, path: str, text: str = "text", ids: str = "token_ids") -> DataFrame:
    """docs with a column of token ids added after all others; a column of that name is replaced."""
    docs = docs.drop(ids)
    from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

    schema = StructType([*docs.schema.fields, StructField(ids, ArrayType(IntegerType(), False), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        for b in chunks(batches, text):
            flat_ids, sizes = t.encode([x or "" for x in b.column(text).to_pylist()])
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            column = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat_ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*b.columns, column], [*b.schema.names, ids])

    return docs.mapInArrow(released(run), schema)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, and hashes of the ids and of the text decoded from them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        for b in chunks(batches, "text"):
            ids, sizes = t.encode([x or "" for x in b.column("text").to_pylist()])
            raw, ends = ids.astype("<u4"), np.cumsum(sizes).tolist()
            of_ids, of_text, at = [], [], 0
            for to in ends:
                of_ids.append(hashlib.sha256(raw[at:to]).hexdigest())
                of_text.append(hashlib.sha256(t.decode(raw[at:to]).encode("utf-8", "surrogatepass")).hexdigest())
                at = to
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sizes), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(released(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(documents(spark, sf_dir, "doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
