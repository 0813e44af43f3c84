"""Personal data: exact patterns, and terms that disclose a protected entity by corpus co-occurrence.

Base spans are the matches of four kinds of pattern. Each distinct matched value is a protected entity. For all
words of the documents that have it the corpus tells how strongly they reveal it: with p(e) and p(e|t) over all
documents, the pointwise information that term t gives about entity e, log p(e|t)/p(e), is held against the
information content of the entity itself, -log p(e). No pair is too rare to count: p(e|t) is smoothed towards p(e)
as if PRIOR more document had been seen, and documents of the same words in the same order (copies) are one document there. A term
that gives SHARE of the information or more is over the disclosure threshold and becomes a span of kind `term`
wherever it occurs; all runs of letters and digits are terms, of any length. sanitise() generalises each span to its
kind, terms to number, name or word, or removes terms.

Defined results: a null text is empty and has no spans; repeated rows give equal rows; an empty table gives an
empty result. sanitise() keeps every other column, whatever its name. Overlapping spans are replaced as one.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.bpe import N, classes, folded
from tidewell.llm.common import chunks, documents, released, sized, span_hashes, stored

KINDS = ("email", "ip", "card", "phone", "term")
SHARE, PRIOR = 0.9, 1.0
#: Pairs of a term and an entity that one batch hands to Spark.
PAIRS_A_BATCH = 1 << 17
#: Counts of terms, and of entities, that rule out pairs before they are formed; of further ones the pairs are dropped later.
KNOWN = 1 << 19
#: Term hashes that one pass over the documents carries; further ones take further passes.
TERMS_A_PASS = 1 << 21

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """kind, start, end of all base matches, by start and kind."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and _LOCAL.match(text[start - 1]):
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            out.append(("email", start, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    for m in _IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if 12 <= m.end() - m.start() <= 37 and 12 <= len(d := re.sub("[ -]", "", m[0])) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
            out.append(("phone", *m.span()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def shown(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def letter_runs(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text index, start and end (in the text) of every run of letters and digits, case folded."""
    cps = np.frombuffer("".join("\n" + t for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    bounds = np.cumsum([0, *(len(t) + 1 for t in texts)])
    inner = np.concatenate([classes()[cps] <= N, [False]])
    starts = np.flatnonzero(inner[1:] & ~inner[:-1]) + 1
    ends = np.flatnonzero(~inner[1:] & inner[:-1]) + 1
    doc = np.searchsorted(bounds, starts, side="right") - 1
    return span_hashes(folded()[cps], starts, ends), doc, starts - bounds[doc] - 1, ends - bounds[doc] - 1


def entity(text: str, kind: str) -> int:
    value = text.lower() if kind in ("email", "ip") else re.sub("[^0-9]", "", text)
    return int.from_bytes(hashlib.blake2b(f"{kind}:{value}".encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def with_entities(docs: DataFrame) -> DataFrame:
    """words (distinct terms outside base spans), entities, and place (that of all words in order) of each text that has an entity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "text"):
            found = [(t, s) for x in b.column("text").to_pylist() if (s := base_spans(t := x or ""))]
            h, doc, starts, ends = letter_runs([t for t, _ in found])
            first = np.searchsorted(doc, np.arange(len(found) + 1))
            words, entities, places = [], [], []
            for k, (text, spans) in enumerate(found):
                lo, hi = first[k], first[k + 1]
                inside = np.zeros(hi - lo, bool)
                for _, a, z in spans:
                    inside[np.searchsorted(ends[lo:hi], a, side="right") : np.searchsorted(starts[lo:hi], z)] = True
                words.append(np.unique(h[lo:hi][~inside]).view(np.int64))
                entities.append(np.unique(np.array([entity(text[a:z], kind) for kind, a, z in spans], np.int64)))
                places.append(int.from_bytes(hashlib.blake2b(h[lo:hi].tobytes(), digest_size=8).digest(), "little", signed=True))
            yield pa.RecordBatch.from_arrays([listed(words), listed(entities), pa.array(places, pa.int64())], ["words", "entities", "place"])

    return docs.select("text").mapInArrow(released(run), "words array<long>, entities array<long>, place long")


def listed(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int64), *arrays])))


def lists(column: pa.Array) -> Iterator[np.ndarray]:
    for x in column:
        yield x.values.to_numpy()


def occurring(found: DataFrame) -> DataFrame:
    """term or entity, n: in how many documents that have any entity it occurs; found: what with_entities() gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, name in enumerate(("words", "entities")):
                key, n = np.unique(b.column(name).flatten().to_numpy(), return_counts=True)
                cols = [pa.array(key), pa.nulls(len(key), pa.int64())]
                yield pa.RecordBatch.from_arrays([cols[k], cols[1 - k], pa.array(n.astype(np.int64))], ["term", "entity", "n"])

    return found.mapInArrow(released(run), "term long, entity long, n long").groupBy("term", "entity").agg(F.sum("n").alias("n"))


class Bounds:
    """Which pairs can't reach the threshold whatever else is counted: terms in more documents than an entity allows.

    The counts of the most common terms and entities are held, KNOWN of each at most; a term that isn't held counts
    as in one document, an entity that isn't as in so many as the rarest that is.
    """

    def __init__(self, seen: DataFrame, documents: int, share: float, prior: float) -> None:
        self.documents, self.share, self.prior = documents, share, prior
        self.terms, self.entities = (self.held(seen, c) for c in ("term", "entity"))
        self.rest = int(self.entities[1].min()) if len(self.entities[0]) == KNOWN else 1

    @staticmethod
    def held(seen: DataFrame, column: str) -> tuple[np.ndarray, np.ndarray]:
        got = seen.where(f"{column} is not null and n > 1").orderBy(F.desc("n"), column).limit(KNOWN).select(column, "n").toArrow()
        key, n = got[column].to_numpy(), got["n"].to_numpy()
        order = np.argsort(key)
        return key[order], n[order]

    @staticmethod
    def counts(known: tuple[np.ndarray, np.ndarray], wanted: np.ndarray, missing: int) -> np.ndarray:
        if not len(known[0]):
            return np.full(len(wanted), missing)
        at = np.minimum(np.searchsorted(known[0], wanted), len(known[0]) - 1)
        return np.where(known[0][at] == wanted, known[1][at], missing)

    def most(self, entities: np.ndarray) -> np.ndarray:
        """The most documents that a term over the threshold for each entity may be in, had all of the entity's the term."""
        has = self.counts(self.entities, entities, self.rest).astype(float)
        p = has / max(1, self.documents)
        least = (has + self.prior) * p ** (1 - self.share) - self.prior * p
        return np.where(p < 1, has * has / np.maximum(least, 1e-300), 0.0) * (1 + 1e-9)


def together(found: DataFrame, bounds: Bounds) -> DataFrame:
    """term, entity, place: each pair of a document's distinct words and entities, but those that bounds rule out.

    place stands for the whole sequence of the document's words.
    """
    held = found.sparkSession.sparkContext.broadcast(bounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            size = 0
            for words, entities, place in zip(lists(b.column("words")), lists(b.column("entities")), b.column("place").to_pylist(), strict=True):
                n = held.value.counts(held.value.terms, words, 1)
                order = np.argsort(n, kind="stable")
                for one, some in zip(entities.tolist(), np.searchsorted(n[order], held.value.most(entities), side="right").tolist(), strict=True):
                    rows.append((words[order[:some]], one, place))
                    size += some
                    if size >= PAIRS_A_BATCH:
                        yield pairs(rows)
                        rows, size = [], 0
            yield pairs(rows)

    def pairs(rows: list[tuple]) -> pa.RecordBatch:
        number = [len(w) for w, _, _ in rows]
        cols = np.concatenate([np.zeros(0, np.int64), *(w for w, _, _ in rows)]), *(np.repeat(np.array([r[k] for r in rows], np.int64), number) for k in (1, 2))
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["term", "entity", "place"])

    return found.mapInArrow(released(run), "term long, entity long, place long")


def blocks(terms: DataFrame) -> Iterator[np.ndarray]:
    """Sorted term hashes, at most about TERMS_A_PASS at a time."""
    parts = max(1, math.ceil(terms.count() * 1.25 / TERMS_A_PASS))
    for k in range(parts):
        part = terms if parts == 1 else terms.where(F.pmod(F.xxhash64("term"), F.lit(parts)) == k)
        yield np.sort(part.select("term").toArrow()["term"].to_numpy().astype(np.int64))


def in_sorted(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(wanted), bool)
    return keys[np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)] == wanted


def document_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """term, docs: in how many of all documents each of the terms occurs."""
    out = None
    for keys in blocks(terms):
        held = docs.sparkSession.sparkContext.broadcast(keys)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(held.value), np.int64)
            for b in chunks(batches, "text"):
                h, doc, _, _ = letter_runs([x or "" for x in b.column("text").to_pylist()])
                h = h.view(np.int64)
                hit = in_sorted(held.value, h)
                at = np.unique(np.searchsorted(held.value, h[hit]) + len(held.value) * doc[hit]) % max(1, len(held.value))
                total += np.bincount(at, minlength=len(total))
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(held.value[some]), pa.array(total[some])], ["term", "docs"])

        counted = docs.select("text").mapInArrow(released(run), "term long, docs long").groupBy("term").agg(F.sum("docs").alias("docs"))
        out = counted if out is None else out.union(counted)
    return out


def disclosing(docs: DataFrame, share: float = SHARE, prior: float = PRIOR) -> DataFrame:
    """The terms over the disclosure threshold."""
    found = stored(with_entities(docs), "found")
    seen, documents = stored(occurring(found), "seen"), docs.count()
    beside, known = seen.where("term is not null").select("term", F.col("n").alias("docs")), seen.where("entity is not null").select("entity", F.col("n").alias("has"))
    p = F.col("has") / F.lit(documents)
    least = F.pow(p, F.lit(1 - share))  # told >= share as a bound of p(e|t)
    given = (F.col("places") * F.least(F.lit(1.0), F.col("both") / F.col("docs")) + prior * p) / (F.col("places") + prior)
    over = (p < 1) & (given >= least)
    pairs = together(found, Bounds(seen, documents, share, prior)).groupBy("term", "entity", "place").agg(F.count("*").alias("n")).groupBy("term", "entity").agg(F.count("*").alias("places"), F.sum("n").alias("both"))
    # Terms are in no fewer documents than those that have an entity: what falls short there falls short of the whole.
    pairs = stored(pairs.join(beside, "term").join(sized(known, 16), "entity").where(over).drop("docs"), "pairs")
    if pairs.isEmpty():
        return pairs.select("term")
    terms = stored(pairs.select("term").distinct(), "terms")
    return stored(pairs.join(document_counts(docs, terms), "term").where(over).select("term").distinct(), "disclosing")


def with_spans(docs: DataFrame, terms: DataFrame, finish: Callable, schema) -> DataFrame:
    """finish(batch, base spans, term spans) of every batch of docs.

    As long as one pass can carry all terms, patterns, terms and finish share one Python worker.
    """
    if terms.count() > TERMS_A_PASS * 0.75:
        first = unused(docs.columns, "_base")
        second = unused([*docs.columns, first], "_more")
        marked = _term_passes(_with_base(docs, first, second), terms, second)

        def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                base, more = ([parsed(x) for x in b.column(c).to_pylist()] for c in (first, second))
                yield finish(b.select(list(range(b.num_columns - 2))), base, more)

        return marked.mapInArrow(released(last), schema)
    held = docs.sparkSession.sparkContext.broadcast(next(blocks(terms)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "text"):
            texts = [x or "" for x in b.column("text").to_pylist()]
            more: list[list] = [[] for _ in texts]
            if len(held.value):
                h, doc, starts, ends = letter_runs(texts)
                for k in np.flatnonzero(in_sorted(held.value, h.view(np.int64))).tolist():
                    more[doc[k]].append(("term", int(starts[k]), int(ends[k])))
            yield finish(b, [base_spans(t) for t in texts], more)

    return docs.mapInArrow(released(run), schema)


def unused(columns: list[str], name: str) -> str:
    """name, made longer until no column has it."""
    taken = {c.lower() for c in columns}
    while name in taken:
        name += "_"
    return name


def _with_base(docs: DataFrame, at: str, more_at: str) -> DataFrame:
    from pyspark.sql.types import StringType, StructField, StructType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "text"):
            base = [shown(base_spans(x or "")) for x in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(base, pa.string()), pa.array([""] * b.num_rows, pa.string())], [*b.schema.names, at, more_at])

    return docs.mapInArrow(released(run), StructType([*docs.schema.fields, StructField(at, StringType()), StructField(more_at, StringType())]))


def _term_passes(df: DataFrame, terms: DataFrame, column: str) -> DataFrame:
    for keys in blocks(terms):
        if not len(keys):
            continue
        held, schema = df.sparkSession.sparkContext.broadcast(keys), df.schema

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for b in chunks(batches, "text"):
                more = [x.split(",") if x else [] for x in b.column(column).to_pylist()]
                h, doc, starts, ends = letter_runs([x or "" for x in b.column("text").to_pylist()])
                for k in np.flatnonzero(in_sorted(held.value, h.view(np.int64))).tolist():
                    more[doc[k]].append(f"term:{starts[k]}:{ends[k]}")
                at = b.schema.get_field_index(column)
                yield b.set_column(at, b.schema.field(at), pa.array([",".join(sorted(x, key=lambda s: int(s.split(":")[1]))) for x in more], pa.string()))

        df = df.mapInArrow(released(run), schema)
        if len(keys) * 2 > TERMS_A_PASS:  # no executor holds several blocks at once
            df = stored(df, "spans")
    return df


def parsed(text: str) -> list[tuple[str, int, int]]:
    return [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in text.split(","))] if text else []


def in_order(base: list, more: list) -> list[tuple[str, int, int]]:
    return sorted(base + more, key=lambda s: (s[1], KINDS.index(s[0])))


def general(kind: str, text: str) -> str:
    """What stands for a span: its kind, and for a term only whether it's a number, a name (a capital first) or a word."""
    if kind != "term":
        return f"[{kind.upper()}]"
    return "[NUMBER]" if any(c.isdigit() for c in text) else "[NAME]" if text[:1].isupper() else "[WORD]"


def sanitise(docs: DataFrame, remove: bool = False) -> DataFrame:
    """docs with every span of text generalised, or with its terms removed altogether."""

    def finish(b: pa.RecordBatch, base: list, more: list) -> pa.RecordBatch:
        texts = b.column("text").to_pylist()
        for i, spans in enumerate(map(in_order, base, more)):
            out, at = [], 0
            for kind, a, z in spans:
                if a >= at:
                    out += [texts[i][at:a], "" if remove and kind == "term" else general(kind, texts[i][a:z])]
                at = max(at, z)
            if spans:
                texts[i] = "".join(out) + texts[i][at:]
        at = b.schema.get_field_index("text")
        return b.set_column(at, b.schema.field(at), pa.array(texts, b.schema.field(at).type))

    return with_spans(docs, disclosing(docs), finish, docs.schema)


def digests(docs: DataFrame) -> DataFrame:
    def finish(b: pa.RecordBatch, base: list, more: list) -> pa.RecordBatch:
        rows = []
        for own, terms in zip(base, more, strict=True):
            kinds = [k for k, _, _ in own]
            rows.append((*(kinds.count(k) for k in KINDS[:4]), hashlib.sha256(shown(own).encode()).hexdigest(), shown(in_order(own, terms))))
        cols = list(zip(*rows, strict=True)) or [[]] * 6
        types = [*[pa.int64()] * 4, pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], ["doc_id", *(f"n_{k}" for k in KINDS[:4]), "base_sha256", "spans"])

    docs = docs.select("doc_id", "text")
    return with_spans(docs, disclosing(docs), finish, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir, "doc_id", "text"))
