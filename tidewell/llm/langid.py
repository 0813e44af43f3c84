"""Language ID by interpolated Kneser-Ney character models.

Each letter, case folded, is a symbol (its UTF-16 units, so that all fit in 16 bits), everything else a word gap.
For each language the counts of all four-symbol codes of all training texts are summed by Spark; continuation
counts, totals and discounts of the lower orders follow from them. The models of orders 2 to 4 stand in sorted arrays
of exact keys, one key array for all languages with one column of discounted mass and of back-off weight for each. A text goes to the
language of the lowest cross-entropy per symbol. The score is a posterior whose temperature is fitted on a fold of
the training texts that a model of the other folds has not seen (on all, where the fold has under FOLD_ROWS). A text
is rejected where its entropy lies far above what texts of its length in that language have there: above the median
by DEVIATIONS times the distance from the 16 % quantile to the median. Junk lies on the upper side, so that a third
of it moves both but little. A length with under ENOUGH texts takes in its neighbours, and a language with none at
all takes the texts of all languages.

Size: the tables grow with the distinct codes seen. Orders 3 and 4 are cut into parts of about PART_BYTES by the two
middle symbols of the code, which all tables that one code needs have in common; each part is collected, broadcast
and used in a pass of its own over the texts.

Defined results: a null text, or one without a letter, is `und` with score 0; without any labelled text all are
`und`. Ties go to the language that sorts first. Repeated rows are predicted alike and count each as training
text. Columns other than doc_id, text and lang are not read; accept() hands them on untouched.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from tidewell.llm.bpe import L as LETTER
from tidewell.llm.bpe import classes, folded
from tidewell.llm.common import chunks, documents, once, released, stored

#: Bits of a symbol in counted codes, and the least in a model's own.
BITS, LEAST_BITS = 16, 6
#: Bytes of orders 3 and 4 that one pass carries, and codes that a task counts before it hands them on.
PART_BYTES, TASK_CODES = 32 << 20, 1 << 20
#: Temperatures among which the calibration chooses.
HEAT = np.array([0.05, 0.1, 0.2, 0.4, 0.8, 1.6, 3.2, 6.4])
#: A text is rejected beyond its language's median entropy by this many deviations, and by this many nats at least.
DEVIATIONS, NATS = 6.0, 0.6
#: Calibration: one in FOLDS texts is held out; entropies are counted in steps of 1 / STEPS nats.
FOLDS, FOLD_ROWS, ENOUGH, STEPS = 5, 200, 30, 100


def symbols() -> np.ndarray:
    def make():
        out = folded().copy()
        out[classes() != LETTER] = 0
        return out

    return once("symbols", make)


def codes(texts: list[str], ids: np.ndarray | None = None, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """The four-symbol code that ends at each letter or gap after a letter, and its text's index.

    ids are the symbols of UTF-16 units, if not the units themselves.
    """
    joined = "".join("\n" + t for t in texts)
    s = symbols()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.int64)
    size = np.array([len(t) + 1 for t in texts], np.int64)
    doc = np.repeat(np.arange(len(texts)), size)
    first = np.zeros(len(s), bool)
    first[np.cumsum(size) - size] = True
    keep = first | (s > 0)
    keep[1:] |= s[:-1] > 0
    s, doc, first = s[keep], doc[keep], first[keep]
    far = s > 0xFFFF
    if far.any():
        twice = 1 + far
        at = (np.cumsum(twice) - twice)[far]
        high, low = 0xD800 + (s[far] - 0x10000 >> 10), 0xDC00 + (s[far] & 0x3FF)
        s, doc, first = np.repeat(s, twice), np.repeat(doc, twice), np.repeat(first, twice)
        s[at], s[at + 1] = high, low
    if ids is not None:
        s = ids[s]
    s = s.astype(np.uint64)
    code = s.copy()
    for k in (1, 2, 3):
        back = np.zeros_like(s)
        back[k:] = np.where(doc[k:] == doc[:-k], s[:-k], np.uint64(0))
        code |= back << np.uint64(bits * k)
    return code[~first], doc[~first]


def counts(train: DataFrame) -> DataFrame:
    """lang, code, n over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for name, (keys, sums) in held.items():
                for at in range(0, len(keys), 100_000):
                    k = keys[at : at + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(k), pa.string()), pa.array(k.view(np.int64)), pa.array(sums[at : at + 100_000])], ["lang", "code", "n"])
            held.clear()

        for b in chunks(batches, "text"):
            names, lang = np.unique(np.array(b.column("lang").to_pylist(), object), return_inverse=True)
            code, doc = codes(b.column("text").to_pylist())
            for i, name in enumerate(names.tolist()):
                k, n = np.unique(code[lang[doc] == i], return_counts=True)
                old, sums = held.get(name, (k[:0], n[:0]))
                keys, back = np.unique(np.concatenate([old, k]), return_inverse=True)
                held[name] = keys, np.bincount(back, weights=np.concatenate([sums, n]), minlength=len(keys)).astype(np.int64)
            if sum(len(k) for k, _ in held.values()) > TASK_CODES:
                yield from out()
        yield from out()

    return train.select("text", "lang").mapInArrow(released(run), "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))


def discount(one: int, two: int) -> float:
    return one / (one + 2 * two) if one else 0.5


def part_of(middle, parts: int):
    """The part of a code by its two middle symbols, as UTF-16 units; for columns and arrays."""
    return middle % 65521 % parts


def side_by_side(own: list[tuple[np.ndarray, np.ndarray]], missing: float) -> tuple[np.ndarray, np.ndarray]:
    """All keys of all languages, sorted, and a column of values for each language."""
    keys = np.unique(np.concatenate([k for k, _ in own]))
    values = np.full((len(keys), len(own)), missing, np.float32)
    for i, (k, v) in enumerate(own):
        values[np.searchsorted(keys, k), i] = v
    return keys, values


def tables(own: list[tuple[np.ndarray, np.ndarray]], discounts: list[float], bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys, discounted mass, contexts and back-off weight of one order, of distinct codes and counts by language."""
    mass, gap = [], []
    for (code, n), d in zip(own, discounts, strict=True):
        context, back, kinds = np.unique(code >> np.uint64(bits), return_inverse=True, return_counts=True)
        total = np.bincount(back, weights=n, minlength=len(context))
        mass.append((code, np.maximum(n - d, 0) / total[back]))
        gap.append((context, d * kinds / total))
    return *side_by_side(mass, 0.0), *side_by_side(gap, 1.0)


def find(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, missing: float) -> np.ndarray:
    if not len(keys):
        return np.full((len(wanted), values.shape[1]), missing)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where((keys[at] == wanted)[:, None], values[at], missing)


class Model:
    """Alphabet and orders 1 and 2; part(i) has orders 3 and 4 of the codes whose middle symbols belong to part i."""

    def __init__(self, langs: list[str], table: DataFrame) -> None:
        """table: lang, code, n in Parquet."""
        self.langs, n = langs, len(langs)
        self.heat, self.limits, self.table, self.only = 1.0, np.full((n, 64), np.inf), table, None
        index = {x: i for i, x in enumerate(langs)}
        code = F.col("code")
        units = [r.u for r in table.select(code.bitwiseAND(F.lit(0xFFFF)).alias("u")).distinct().collect()]
        # 0 is the gap, 1 to 26 are a-z; the last stands for every letter not seen.
        self.raw = np.array([0, *range(97, 123), *sorted(set(units) - {0, *range(97, 123)}), 0xFFFF], np.int64)
        self.ids = np.full(1 << BITS, len(self.raw) - 1, np.int64)
        self.ids[self.raw] = np.arange(len(self.raw))
        self.bits = max(LEAST_BITS, (len(self.raw) - 1).bit_length())
        triples = table.groupBy("lang", code.bitwiseAND(F.lit((1 << 3 * BITS) - 1)).alias("code")).agg(F.count("*").alias("n"))
        triples = stored(triples, "triples")
        pairs = self.listed(triples.groupBy("lang", code.bitwiseAND(F.lit((1 << 2 * BITS) - 1)).alias("code")).agg(F.count("*").alias("n")))
        self.discounts = {2: [discount((x == 1).sum(), (x == 2).sum()) for _, x in pairs]}
        size = 0
        for k, t in ((3, triples), (4, table)):
            self.discounts[k] = [0.5] * n
            for r in t.groupBy("lang").agg(F.count_if(F.col("n") == 1).alias("one"), F.count_if(F.col("n") == 2).alias("two"), F.count("*").alias("rows")).collect():
                self.discounts[k][index[r.lang]] = discount(r.one, r.two)
                size += r.rows * 2 * (8 + 4 * n)  # mass and back-off weight, if no language shared a key
        self.parts = max(1, -(-size // PART_BYTES))
        self.pairs = tables(pairs, self.discounts[2], self.bits)
        one = np.zeros((1 << self.bits, n))
        one[: len(self.raw)] = 1.0
        for i, (x, _) in enumerate(pairs):
            one[:, i] += np.bincount((x & np.uint64((1 << self.bits) - 1)).astype(np.int64), minlength=len(one))
        self.base = one / one.sum(axis=0)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"table": None, "only": None}

    def listed(self, df: DataFrame) -> list[tuple[np.ndarray, np.ndarray]]:
        """Codes in the model's own symbols and counts of each language; df: lang, code, n."""
        got = df.select("lang", "code", "n").toArrow()
        code = got["code"].to_numpy().view(np.uint64)
        own = np.zeros_like(code)
        for k in range(4):
            own |= self.ids[(code >> np.uint64(BITS * k) & np.uint64(0xFFFF)).astype(np.int64)].astype(np.uint64) << np.uint64(self.bits * k)
        lang = np.array(got["lang"].to_pylist(), object)
        n = got["n"].to_numpy()
        return [(own[lang == x], n[lang == x]) for x in self.langs]

    def part(self, i: int) -> dict[int, tuple]:
        if self.only is None or self.parts > 1:
            middle = F.shiftrightunsigned("code", BITS).bitwiseAND(F.lit((1 << 2 * BITS) - 1))
            quads = self.listed(self.table.where(part_of(middle, self.parts) == i) if self.parts > 1 else self.table)
            triples = [np.unique(x & np.uint64((1 << 3 * self.bits) - 1), return_counts=True) for x, _ in quads]
            self.only = {3: tables(triples, self.discounts[3], self.bits), 4: tables(quads, self.discounts[4], self.bits)}
        return self.only

    def logs(self, code: np.ndarray, part: dict[int, tuple] | None = None) -> np.ndarray:
        """log p of each code's last symbol after the three before it, for each language."""
        code = code.astype(np.uint64)
        p = self.base[(code & np.uint64((1 << self.bits) - 1)).astype(np.int64)]
        for k, t in {2: self.pairs, **(part or self.part(0))}.items():
            own = code & np.uint64((1 << self.bits * k) - 1)
            p = find(*t[:2], own, 0.0) + find(*t[2:], own >> np.uint64(self.bits), 1.0) * p
        return np.log(np.maximum(p, 1e-12))

    def sums(self, texts: list[str], part: dict[int, tuple], i: int) -> tuple[np.ndarray, np.ndarray]:
        """-log p of all symbols whose codes belong to part i, in each language, and the number of all symbols."""
        code, doc = codes(texts, self.ids, self.bits)
        n = np.bincount(doc, minlength=len(texts))
        seen, back = np.unique(code, return_inverse=True)
        logs = np.zeros((len(seen), len(self.langs)))
        b, c = (self.raw[(seen >> np.uint64(self.bits * k) & np.uint64((1 << self.bits) - 1)).astype(np.int64)] for k in (2, 1))
        mine = part_of(b << BITS | c, self.parts) == i
        logs[mine] = self.logs(seen[mine], part)
        return -np.stack([np.bincount(doc, weights=logs[back, k], minlength=len(texts)) for k in range(len(self.langs))], 1), n


def with_entropies(docs: DataFrame, model: Model, finish: Callable, schema) -> DataFrame:
    """finish(batches of docs with the cross-entropy a symbol in each language and the number of symbols (0: no letter))."""
    spark, column = docs.sparkSession, "_sums"
    while column in {c.lower() for c in docs.columns}:
        column += "_"
    held = spark.sparkContext.broadcast(model)
    for i in range(model.parts):
        part, last = spark.sparkContext.broadcast(model.part(i)), i == model.parts - 1

        def run(batches: Iterator[pa.RecordBatch], part=part, i=i, last=last) -> Iterator[pa.RecordBatch]:
            def each() -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
                for b in chunks(batches, "text"):
                    h, n = held.value.sums([x or "" for x in b.column("text").to_pylist()], part.value, i)
                    if i:
                        h = h + np.array(b.column(column).to_pylist()).reshape(h.shape)
                        b = b.select([x for x in b.schema.names if x != column])
                    yield b, h, n

            if last:
                yield from finish((b, h / np.maximum(n, 1)[:, None], n) for b, h, n in each())
                return
            for b, h, _ in each():
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(h.tolist(), pa.list_(pa.float64()))], [*b.schema.names, column])

        if last:
            return docs.mapInArrow(released(run), schema)
        fields = [f for f in docs.schema.fields if f.name != column]
        docs = stored(docs.mapInArrow(released(run), StructType([*fields, StructField(column, ArrayType(DoubleType()))])), "sums")


def posterior(h: np.ndarray, n: np.ndarray, heat: float) -> np.ndarray:
    x = -heat * np.sqrt(n)[:, None] * (h - h.min(axis=1, keepdims=True))
    e = np.exp(x)
    return e / e.sum(axis=1, keepdims=True)


def robust(counted: list[dict[int, int]]) -> tuple[float, float]:
    """Median, and its distance from the 16 % quantile, of counted steps."""
    bins: dict[int, int] = {}
    for one in counted:
        for x, n in one.items():
            bins[x] = bins.get(x, 0) + n
    x = np.array(sorted(bins))
    run = np.cumsum([bins[i] for i in x.tolist()])
    low, middle = ((x[np.searchsorted(run, q * run[-1])] + 0.5) / STEPS for q in (0.16, 0.5))
    return middle, middle - low


def limits(seen: dict[int, dict[int, int]], langs: int) -> np.ndarray:
    """The entropy limit of each language and log2 length, from counts of entropies in steps, by language * 64 + log2."""
    out = np.full((langs, 64), np.inf)
    every: dict[int, dict[int, int]] = {}
    for k, bins in seen.items():
        for x, n in bins.items():
            every.setdefault(k % 64, {})[x] = every.get(k % 64, {}).get(x, 0) + n
    for lang in range(langs):
        own = {k % 64: bins for k, bins in seen.items() if k // 64 == lang} or every
        if not own:
            continue
        # A length that is mostly junk doesn't set its own limit: no limit lies above that of all lengths together.
        middle, spread = robust(list(own.values()))
        common, run = sorted(own), np.cumsum([sum(own[s].values()) for s in sorted(own)])
        usual = common[np.searchsorted(run, run[-1] / 2)]
        for size in range(64):
            near: list[dict[int, int]] = []
            for far in sorted({abs(s - size) for s in own}):
                near += [own[s] for s in {size - far, size + far} & own.keys()]
                if sum(sum(x.values()) for x in near) >= ENOUGH:
                    break
            m, d = robust(near)
            # Shorter texts than those at hand spread the wider.
            here, cap = (max(NATS, DEVIATIONS * x) * 2 ** (max(0, y - size) / 2) for x, y in ((d, min(own)), (spread, usual)))
            out[lang, size] = min(m + here, middle + cap)
    return out


def model_of(table: DataFrame) -> Model | None:
    """table: lang, code, n."""
    langs = [r.lang for r in table.select("lang").distinct().orderBy("lang").collect()]
    if not langs:
        return None
    return Model(langs, table)


def fit(train: DataFrame) -> Model | None:
    """train: text, lang; rows without either are left out."""
    train = train.select("text", "lang").where("text is not null and lang is not null")
    apart = F.pmod(F.xxhash64("text"), F.lit(FOLDS)) == 0  # copies of a text are on one side
    table = stored(counts(train.where(~apart)), "codes")
    unseen = train.where(apart)
    held_back = model_of(table)
    model = model_of(stored(table.union(counts(unseen)).groupBy("lang", "code").agg(F.sum("n").alias("n")), "codes"))
    if model is None:
        return None
    if held_back is None or unseen.count() < FOLD_ROWS:
        held_back, unseen = model, train
    places = np.array([model.langs.index(x) for x in held_back.langs], np.int64)

    index = {x: i for i, x in enumerate(held_back.langs)}

    def run(scored: Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        sums, loss = {}, np.zeros(len(HEAT))
        for b, h, n in scored:
            true = np.array([index.get(x, -1) for x in b.column("lang").to_pylist()], np.int64)
            some = (n > 0) & (true >= 0)
            h, n, true = h[some], n[some], true[some]
            at = np.arange(len(n))
            loss += [-np.log(np.maximum(posterior(h, n, t)[at, true], 1e-9)).sum() for t in HEAT]
            size = np.log2(np.maximum(n, 1)).astype(np.int64)
            key = (places[true] * 64 + size) << 16 | (h[at, true] * STEPS).astype(np.int64)
            for k, c in zip(*(x.tolist() for x in np.unique(key, return_counts=True)), strict=True):
                sums[k] = sums.get(k, 0) + c
        rows = [(-1 - i, 1, float(x)) for i, x in enumerate(loss)] + [(k, c, 0.0) for k, c in sums.items()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["k", "n", "x"])

    rows = with_entropies(unseen, held_back, run, "k long, n long, x double").groupBy("k").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).collect()
    loss = {-1 - r.k: r.x for r in rows if r.k < 0}
    model.heat = float(HEAT[min(loss, key=loss.get)])
    seen: dict[int, dict[int, int]] = {}
    for r in rows:
        if r.k >= 0:
            seen.setdefault(r.k >> 16, {})[r.k & 0xFFFF] = r.n
    model.limits = limits(seen, len(model.langs))
    return model


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score, entropy and rejected of every row."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if model is None:
        return docs.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0.0).alias("entropy"), F.lit(True).alias("rejected"))
    langs, heat, limit = model.langs, model.heat, model.limits

    def run(scored: Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for b, h, n in scored:
            best, some = h.argmin(axis=1), n > 0
            lang = [langs[i] if ok else "und" for i, ok in zip(best.tolist(), some.tolist(), strict=True)]
            entropy = np.where(some, h.min(axis=1), 0.0)
            score = np.where(some, posterior(h, n, heat).max(axis=1), 0.0)
            rejected = ~some | (entropy > limit[best, np.log2(np.maximum(n, 1)).astype(np.int64)])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(lang, pa.string()), pa.array(score), pa.array(entropy), pa.array(rejected)], ["doc_id", "lang_pred", "score", "entropy", "rejected"])

    return with_entropies(docs, model, run, "doc_id long, lang_pred string, score double, entropy double, rejected boolean")


def accept(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of docs whose text is not rejected, all columns as they were."""
    if model is None:
        return docs.where(F.lit(False))
    limits = model.limits

    def run(scored: Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for b, h, n in scored:
            limit = limits[h.argmin(axis=1), np.log2(np.maximum(n, 1)).astype(np.int64)]
            yield b.filter(pa.array((n > 0) & (h.min(axis=1) <= limit)))

    return with_entropies(docs, model, run, docs.schema)


def held_out(column: str = "doc_id", modulus: int = 5, remainder: int = 0) -> F.Column:
    return F.coalesce(F.crc32(F.col(column).cast("string")) % modulus == remainder, F.lit(False))


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text", "lang")
    model = fit(docs.where(~held_out() & F.col("doc_id").isNotNull()))
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "entropy", "rejected")
