"""Benchmark decontamination: a BM25 index of the test items, searched by every passage with block-max WAND.

The index holds, for each term, the test items (in segments of SEGMENT words at most) that have it in ascending
order, each with its BM25 weight as a share of the segment's own full score, the greatest weight of the list, and
that of each block of BLOCK segments. Document frequencies and the mean length are those of all test items. Every
window of 2 * SEGMENT words, a new one each SEGMENT words, is a query with a cursor in each of its terms' lists.
In each turn the cursors are put in the order of their segments; the pivot is the segment at which the lists'
maxima up to there reach the threshold. If the maxima of the pivot's block reach it as well, cursors move to the
pivot and it is scored in full; otherwise they skip the block. Many windows take their
turns together, in array operations; WINDOWS bounds how many. All segments at or above the threshold are
retrieved. A retrieved item is then verified on exact five-word shingles of its question and of its answer, the
last sentence: OVERLAP of all of them, and PART_OVERLAP of each part (of a part with fewer than 2 * WIDTH words,
in which one edit leaves no shingle whole, PART_OVERLAP of its words).

Defined results: a null or empty text, or a null or wordless item, is part of no pair; an item without a second
sentence is all question; a part of fewer than five words is one shingle; repeated rows give repeated pairs of
documents, and items of the same id count each for itself; empty tables give no pairs. Other columns are not
read by search(); clean() hands them on untouched, whatever their names, and decides row by row. Items beyond
PART_BYTES are searched part after part, with the same weights. A text of any length is searched in memory that
grows by a word hash a word.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.common import chunks, documents, flat, mix, released, span_hashes, stored

SEGMENT, BLOCK, WIDTH = 64, 16, 5
THRESHOLD, OVERLAP, PART_OVERLAP = 0.7, 0.8, 0.5
K1, B = 1.2, 0.75
#: Bytes of test items that one index holds, about; it is what a broadcast carries.
PART_BYTES = 8 << 20
#: Windows that take their turns together, and bytes of text that are hashed together.
WINDOWS, PIECE = 4096, 4 << 20

_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text index of every run of letters, digits and non-ASCII bytes; A-Z count as a-z."""
    hashes, owners, at = [], [], 0
    while at < len(data):
        to = min(len(data), at + PIECE)
        if to < len(data):  # a piece ends behind a letter run
            gap = np.flatnonzero(~_LETTER[data[to : to + PIECE]])
            to = to + int(gap[0]) if len(gap) else len(data)
        inner = _LETTER[data[at:to]]
        edge = np.zeros(to - at + 1, bool)
        edge[offsets[(offsets >= at) & (offsets <= to)] - at] = True
        other = np.ones(to - at + 1, bool)
        other[1:] = ~inner
        starts = np.flatnonzero(inner & (other[:-1] | edge[:-1]))
        other[:-1], other[-1] = ~inner, True
        ends = np.flatnonzero(inner & (other[1:] | edge[1:])) + 1
        hashes.append(span_hashes(_FOLD[data[at:to]], starts, ends))
        owners.append((np.searchsorted(offsets, starts + at, side="right") - 1).astype(np.int32))
        at = to
    return (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((hashes, np.uint64), (owners, np.int32)))


def text_terms(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    return next(iter(terms(data, np.array([0, len(data)]))))


def runs(h: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """Hashes of each stretch of width terms; all of a shorter sequence."""
    width = min(width, len(h))
    if not width:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - width + 1, np.uint64)
    for k in range(width):
        out = out * np.uint64(0xD6E8FEB86659FD93) + h[k : len(h) - width + 1 + k]
    return mix(out)


def question_and_answer(text: str) -> tuple[str, str]:
    at = [m.end() for m in re.finditer(r"[.?!](?=\s+\S)|\n(?=\s*\S)", text.rstrip())]
    return (text[: at[-1]], text[at[-1] :]) if at else (text, "")


def segments(text: str) -> list[np.ndarray]:
    """The words of an item, in even stretches of SEGMENT at most."""
    h = text_terms(text)
    cut = -(-len(h) // SEGMENT)
    return [h[len(h) * k // cut : len(h) * (k + 1) // cut] for k in range(cut)]


class Part:
    """A question or an answer: its five-word shingles, their width, and the units on which the part alone is held."""

    def __init__(self, text: str) -> None:
        h = text_terms(text)
        self.width = min(WIDTH, len(h)) or WIDTH
        self.shingles = np.unique(runs(h))
        self.alone = 1 if len(h) < 2 * WIDTH else WIDTH
        self.units = np.unique(runs(h, self.alone))


class Index:
    """Postings, list and block maxima, and questions and answers of one part of the test items."""

    def __init__(self, items: list[tuple[int, str]], known: tuple[np.ndarray, np.ndarray], number: int, mean: float) -> None:
        """known: sorted terms and in how many of all segments each is; number, mean: of all segments."""
        self.items, bags, owner = [], [], []
        for item, text in items:
            cut = segments(text)
            if not cut:
                continue
            question, answer = map(Part, question_and_answer(text))
            if not len(question.shingles):
                question, answer = answer, question
            owner += [len(self.items)] * len(cut)
            bags += cut
            self.items.append((item, question, answer))
        self.owner, self.number = np.array(owner, np.int64), len(bags)
        size = np.array([len(x) for x in bags], np.float64)
        of = np.repeat(np.arange(len(bags)), size.astype(np.int64))
        self.vocabulary, term = np.unique(np.concatenate([np.zeros(0, np.uint64), *bags]), return_inverse=True)
        # Where the terms of each leading bits begin, so that a look-up is a step or a few.
        self.shift = np.uint64(64 - min(22, max(8, len(self.vocabulary).bit_length() + 4)))
        self.near = np.searchsorted(self.vocabulary >> self.shift, np.arange((1 << 64 - int(self.shift)) + 1)).astype(np.int32)
        self.steps = int(np.diff(self.near).max(initial=0))
        wide = self.number + 1
        self.key, tf = np.unique(term * wide + of, return_counts=True)
        term, self.segment = self.key // wide, self.key % wide
        df = known[1][np.searchsorted(known[0], self.vocabulary)] if len(self.vocabulary) else np.zeros(0)
        idf = np.log(1 + (number - df + 0.5) / (df + 0.5))
        weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[self.segment] / mean))
        self.weight = weight / np.bincount(self.segment, weights=weight, minlength=self.number)[self.segment]
        self.first = np.searchsorted(term, np.arange(len(self.vocabulary) + 1))
        self.most = np.maximum.reduceat(self.weight, self.first[:-1]) if len(term) else np.zeros(0)
        self.blocks = -(-self.number // BLOCK)
        self.block_key, begin = np.unique(term * self.blocks + self.segment // BLOCK, return_index=True)
        self.block_most = np.maximum.reduceat(self.weight, begin) if len(begin) else np.zeros(0)

    def search(self, h: np.ndarray, doc: np.ndarray, docs: int) -> Iterator[tuple[int, int, float]]:
        """Text index, place in self.items and score of all that reach THRESHOLD, the best of each pair."""
        if not len(self.vocabulary) or not len(h):
            return
        count = np.bincount(doc, minlength=docs)
        begin = np.cumsum(count) - count
        of_doc = np.concatenate([[0], np.cumsum(-(-count // SEGMENT))])
        hit, term = self.found(h)
        unit = of_doc[doc[hit]] + (hit - begin[doc[hit]]) // SEGMENT
        units = int(of_doc[-1])
        same = np.ones(units + 1, bool)  # does the next unit belong to the same text
        same[of_doc[1:][of_doc[1:] > 0] - 1] = False
        owner = np.repeat(np.arange(docs), np.diff(of_doc))
        found = []
        for low in range(0, units, WINDOWS):
            high = min(units, low + WINDOWS)
            a, b = np.searchsorted(unit, [low, high + 1])
            u, t = unit[a:b], term[a:b]
            late = (u > low) & same[u - 1]
            win, t = np.concatenate([u[u < high], u[late] - 1]), np.concatenate([t[u < high], t[late]])
            key = np.unique((win - low) * len(self.vocabulary) + t)
            for w, s, score in self.turns(key // len(self.vocabulary), key % len(self.vocabulary)):
                found.append((owner[w + low] * len(self.items) + self.owner[s], score))
        if found:
            pair, score = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.lexsort((-score, pair))
            pair, first = np.unique(pair[order], return_index=True)
            for p, x in zip(pair.tolist(), score[order][first].tolist(), strict=True):
                yield p // len(self.items), p % len(self.items), x

    def found(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of h that are in the vocabulary, ascending, and where there."""
        slot = (h >> self.shift).astype(np.int64)
        at, end = self.near[slot], self.near[slot + 1]
        rest = np.flatnonzero(at < end)
        places, terms = [], []
        for k in range(self.steps):
            rest = rest[at[rest] + k < end[rest]]
            same = self.vocabulary[at[rest] + k] == h[rest]
            places.append(rest[same])
            terms.append(at[rest[same]] + k)
            rest = rest[~same]
        place, term = np.concatenate(places), np.concatenate(terms).astype(np.int64)
        order = np.argsort(place, kind="stable")
        return place[order], term[order]

    def turns(self, win: np.ndarray, term: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Windows, segments and scores at or above the threshold; one cursor for each window and term."""
        least, wide = THRESHOLD - 1e-9, self.number + 1
        able = np.bincount(win, weights=self.most[term]) >= least
        win, term = win[able[win]], term[able[win]]
        at = self.first[term]
        while len(win):
            segment = self.segment[at]
            order = np.argsort(win * wide + segment, kind="stable")
            win, term, at, segment = win[order], term[order], at[order], segment[order]
            head = np.flatnonzero(np.concatenate([[True], win[1:] != win[:-1]]))
            group = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(win))))
            most = self.most[term]
            run = np.cumsum(most)
            run -= (run[head] - most[head])[group]
            short = np.add.reduceat(run < least, head, dtype=np.int64)
            some = short < np.diff(np.append(head, len(win)))
            pivot = segment[np.minimum(head + short, len(win) - 1)]
            live = some[group]
            end = (pivot // BLOCK + 1) * BLOCK  # of the pivot's block
            near = np.flatnonzero(live & (segment < end[group]))
            g, own = group[near], term[near]
            wanted = own * self.blocks + (pivot // BLOCK)[g]
            block = np.minimum(np.searchsorted(self.block_key, wanted), len(self.block_key) - 1)
            full = np.bincount(g, weights=np.where(self.block_key[block] == wanted, self.block_most[block], 0.0), minlength=len(head)) >= least
            moved = ~full[g] | (segment[near] <= pivot[g])
            near, g, own = near[moved], g[moved], own[moved]
            wanted = own * wide + np.where(full, pivot, end)[g]
            to = np.searchsorted(self.key, wanted)
            last = np.minimum(to, len(self.key) - 1)
            exact = full[g] & (self.key[last] == wanted)
            score = np.bincount(g, weights=np.where(exact, self.weight[last], 0.0), minlength=len(head))
            good = np.flatnonzero(full & some & (score >= least))
            if len(good):
                yield win[head[good]], pivot[good], score[good]
            at[near] = to + exact
            live &= at < self.first[term + 1]
            win, term, at = win[live], term[live], at[live]


def indexes(benchmark: DataFrame) -> Iterator[Index]:
    """The test items in indexes of about PART_BYTES, one after another; statistics are those of all items."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text in b.column("text").to_pylist():
                cut = segments(text)
                if cut:
                    own, n = np.unique(np.concatenate([np.unique(x) for x in cut]), return_counts=True)
                    sums = np.array([len(cut), sum(map(len, cut))])
                    yield pa.RecordBatch.from_arrays([pa.array(np.append(own.view(np.int64), [0, 0])), pa.array(np.concatenate([n, sums])), pa.array([0] * len(own) + [1, 2])], ["term", "n", "what"])

    found = stored(items.mapInArrow(released(run), "term long, n long, what long").groupBy("what", "term").agg(F.sum("n").alias("n")), "terms")
    sums = {r.what: r.n for r in found.where("what > 0").collect()}
    if not sums:
        return
    total = items.agg(F.sum(F.octet_length("text") * 4)).first()[0]
    parts = -(-total // PART_BYTES)
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(parts))
    for i in range(parts):
        own = items.where(part == i) if parts > 1 else items
        rows = sorted(((r.item_id, r.text) for r in own.toLocalIterator()), key=lambda r: (r[0] is None, r))
        mine = np.unique(np.concatenate([np.zeros(0, np.uint64), *(x for _, text in rows for x in segments(text))])).view(np.int64)
        words = found.where("what = 0").select("term", "n")
        if parts > 1:  # only the frequencies of this part's terms
            words = words.join(found.sparkSession.createDataFrame(pa.table({"term": mine})), "term", "left_semi")
        got = words.toArrow()
        term, n = got["term"].to_numpy().view(np.uint64), got["n"].to_numpy()
        order = np.argsort(term)
        yield Index(rows, (term[order], n[order].astype(np.float64)), sums[1], sums[2] / sums[1])


def verified(index: Index, b: pa.RecordBatch) -> Iterator[tuple[int, int, float, float, float]]:
    """Row, item_id, score, question_overlap and answer_overlap of every verified pair of a batch."""
    h, doc = terms(*flat(b.column("text")))
    row, seen = -1, {}
    for k, p, score in index.search(h, doc, b.num_rows):
        if k != row:  # the text's shingles by width, sorted once
            row, seen = k, {}
            own = h[np.searchsorted(doc, k) : np.searchsorted(doc, k, side="right")]
        item, *both = index.items[p]

        def share(units: np.ndarray, width: int) -> int:
            if width not in seen:
                seen[width] = np.unique(runs(own, width))
            at = np.minimum(np.searchsorted(seen[width], units), len(seen[width]) - 1)
            return int((seen[width][at] == units).sum())

        held = [share(x.shingles, x.width) for x in both]
        alone = [share(x.units, x.alone) / len(x.units) if len(x.units) else 1.0 for x in both]
        if sum(held) >= OVERLAP * sum(len(x.shingles) for x in both) and min(alone) >= PART_OVERLAP:
            yield k, item, score, *(n / len(x.shingles) if len(x.shingles) else 1.0 for n, x in zip(held, both, strict=True))


PAIR = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"


def search(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, score, question_overlap and answer_overlap of every verified pair."""
    spark, out = docs.sparkSession, None
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    for index in indexes(benchmark):
        held = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for b in chunks(batches, "text"):
                ids = b.column("doc_id").to_pylist()
                rows = [(ids[k], *found) for k, *found in verified(held.value, b)]
                cols = list(zip(*rows, strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(cols, (pa.int64(), pa.int64(), *[pa.float64()] * 3), strict=True)], ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

        found = docs.mapInArrow(released(run), PAIR)
        out = found if out is None else out.union(found)
    return spark.createDataFrame([], PAIR) if out is None else out


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows that hold a test item, whatever their doc_id."""
    for i, index in enumerate(indexes(benchmark)):
        held = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for b in chunks(batches, "text"):
                keep = np.ones(b.num_rows, bool)
                keep[[k for k, *_ in verified(held.value, b)]] = False
                yield b.filter(pa.array(keep))

        if i:  # no task holds several indexes at once
            docs = stored(docs, "clean")
        docs = docs.mapInArrow(released(run), docs.schema)
    return docs


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search(documents(spark, sf_dir, "doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.withColumn("score", F.round("score", 9))  # sums of doubles in whatever order


#: Every window against every segment, scored in full, and the shingles of whole texts.
ORACLE = r"""
WITH item AS (SELECT row_number() OVER () AS i, item_id, text, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark WHERE text IS NOT NULL),
cut AS (SELECT i, w, unnest(range((len(w) + 63) // 64)) AS k FROM item),
seg AS (SELECT i, k, w[len(w) * k // ((len(w) + 63) // 64) + 1 : len(w) * (k + 1) // ((len(w) + 63) // 64)] AS w FROM cut),
number AS (SELECT count(*) AS n, sum(len(w)) / count(*) AS mean FROM seg),
tf AS (SELECT i, k, term, size, count(*) AS tf FROM (SELECT i, k, len(w) AS size, unnest(w) AS term FROM seg) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
weight AS (SELECT i, k, term, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean)) AS x FROM tf JOIN df USING (term), number),
share AS (SELECT i, k, term, x / sum(x) OVER (PARTITION BY i, k) AS x FROM weight),
doc AS (SELECT row_number() OVER () AS d, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents),
unit AS (SELECT d, (generate_subscripts(w, 1) - 1) // 64 AS u, unnest(w) AS term FROM doc),
query AS (SELECT d, u, term FROM unit UNION SELECT d, u - 1, term FROM unit WHERE u > 0),
hit AS (SELECT d, i, sum(x) AS score FROM query JOIN share USING (term) GROUP BY d, u, i, k HAVING sum(x) >= 0.7 - 1e-9),
best AS (SELECT d, i, max(score) AS score FROM hit GROUP BY 1, 2),
split AS (SELECT i, item_id, regexp_extract(rtrim(text, E' \t\n\x0b\x0c\r'), '(?s)^(.*(?:[.?!]\s+|\n\s*))(\S.*)$', ['q', 'a']) AS x, text FROM item),
half AS (SELECT i, item_id, unnest([{'part': 0, 't': CASE WHEN x.q = '' THEN text ELSE x.q END}, {'part': 1, 't': CASE WHEN x.q = '' THEN '' ELSE x.a END}], recursive := true) FROM split),
word AS (SELECT i, item_id, part, regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM half),
part AS (SELECT i, item_id, part, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct([array_to_string(w[j : j + 4], ' ') FOR j IN range(1, len(w) - 3)]) END AS shingles,
  CASE WHEN len(w) < 10 THEN list_distinct(w) ELSE list_distinct([array_to_string(w[j : j + 4], ' ') FOR j IN range(1, len(w) - 3)]) END AS units FROM word),
held AS (SELECT b.d, b.i, any_value(p.item_id) AS item_id, any_value(b.score) AS score, p.part, any_value(len(p.shingles)) AS n,
  any_value(len([s FOR s IN p.shingles IF contains(' ' || array_to_string(doc.w, ' ') || ' ', ' ' || s || ' ')])) AS got,
  any_value(CASE WHEN len(p.units) = 0 THEN 1.0 ELSE len([s FOR s IN p.units IF contains(' ' || array_to_string(doc.w, ' ') || ' ', ' ' || s || ' ')]) / len(p.units) END) AS alone
  FROM best b JOIN doc USING (d) JOIN part p USING (i) GROUP BY b.d, b.i, p.part),
pair AS (SELECT d, i, any_value(item_id) AS item_id, any_value(score) AS score, sum(got) AS got, sum(n) AS n, min(alone) AS alone,
  max(CASE WHEN part = 0 THEN CASE WHEN n = 0 THEN 1.0 ELSE got / n END END) AS q, max(CASE WHEN part = 1 THEN CASE WHEN n = 0 THEN 1.0 ELSE got / n END END) AS a FROM held GROUP BY 1, 2)
SELECT doc_id, item_id, round(score, 9) AS score, q::DOUBLE AS question_overlap, a::DOUBLE AS answer_overlap FROM pair JOIN doc USING (d) WHERE got >= 0.8 * n AND alone >= 0.5
"""
