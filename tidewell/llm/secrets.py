"""Secret scans, in DataFrame functions only.

Base spans are the matches of three patterns. Further candidates are long runs of encoding letters. For each the
encoding is inferred (hex, base32 or base64), and a battery of tests asks how far the run is from what words and
names in that alphabet look like: chi-squared uniformity over the alphabet (through the index of coincidence),
the number of runs of one letter class, and the serial correlation of neighbouring letters, which counts against
a run that counts up or repeats. The first two are combined by Stouffer's rule; the resulting p-values of all
candidates of the whole table go through Benjamini-Hochberg at FDR, each weighted by its length (weights of mean
1), on a scale of tenths of a decade, so that only the counts of DECADES * 10 bins are ever collected. What passes
is a span of kind `random`, unless it lies within a base span.

Defined results: a null text is empty and has no spans; repeated rows give equal rows (copies count in the
false-discovery control as often as they occur); an empty table gives an empty result. Only doc_id and text are
read. Positions are code points, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.common import documents, stored

KINDS = ("assign", "access", "hex", "random")
#: Runs of these letters never retry, so a run of the whole pattern is the same as the pattern with a least length.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX = "AKIA[A-Z0-9]{14,}", "[0-9a-f]{16,}"
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}"
FDR, DECADES, LONGEST = 0.01, 40, 64
#: Matches that are added up together.
GROUP = 256
#: Per encoding the number of letters, the index of coincidence of words and names in it (second
#: and third moment of their letter frequencies), and how often their letter class changes.
ENCODINGS = {"hex": (16, 0.100, 0.0125, 0.20), "base32": (32, 0.066, 0.0055, 0.10), "base64": (64, 0.066, 0.0055, 0.08)}
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_="


def found(t: DataFrame, patterns: list[str], keep: dict) -> DataFrame:
    """t with `spans0`, `spans1`, ...: arrays of (start, kind, end, match) of all matches of each pattern in column t.

    keep: kind to a condition on a match's index. Starts are running sums of the lengths between and of the matches,
    added up in groups of GROUP and then over the groups, as an array that grows by one element is copied each time.
    Each step is a column of its own that the next one uses twice, so that none is computed again for each element.
    """
    empty = F.array().cast("array<struct<start:int,kind:int,end:int,match:string>>")
    kinds, begin = range(len(patterns)), F.struct(F.lit(0).alias("at"), empty.alias("spans"))
    t = t.withColumns({f"gap{k}": F.transform(F.split("t", p, -1), lambda g: F.length(g)) for k, p in enumerate(patterns)} | {f"hit{k}": F.regexp_extract_all("t", F.lit(p), F.lit(0)) for k, p in enumerate(patterns)})
    step = lambda k: F.arrays_zip(F.col(f"gap{k}").alias("gap"), F.col(f"hit{k}").alias("hit"), F.sequence(F.lit(0), F.size(f"gap{k}") - 1).alias("i"))
    t = t.withColumns({f"step{k}": F.when(F.size(f"gap{k}") > 1, step(k)) for k in kinds})  # null without a match

    def one(k: int):
        def add(acc: Column, x: Column) -> Column:
            start = acc["at"] + x["gap"]
            end = start + F.coalesce(F.length(x["hit"]), F.lit(0))
            span = F.struct(start.alias("start"), F.lit(k).alias("kind"), end.alias("end"), x["hit"].alias("match"))
            wanted = x["hit"].isNotNull() & keep[k](x["i"]) if k in keep else x["hit"].isNotNull()
            return F.struct(end.alias("at"), F.when(wanted, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

        return add

    number = lambda k: F.ceil(F.size(f"step{k}") / GROUP).cast("int")
    groups = lambda k: F.transform(F.sequence(F.lit(0), number(k) - 1), lambda i: F.aggregate(F.slice(f"step{k}", i * GROUP + 1, F.lit(GROUP)), begin, one(k)))
    t = t.withColumns({f"groups{k}": F.when(F.col(f"step{k}").isNotNull(), groups(k)) for k in kinds})

    def place(acc: Column, g: Column) -> Column:
        return F.struct((acc["at"] + g["at"]).alias("at"), F.concat(acc["bases"], F.array(acc["at"])).alias("bases"))

    bases = lambda k: F.aggregate(f"groups{k}", F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("bases")), place, lambda acc: acc["bases"])
    moved = lambda s, base: F.struct((s["start"] + base).alias("start"), s["kind"].alias("kind"), (s["end"] + base).alias("end"), s["match"].alias("match"))
    spans = lambda k: F.flatten(F.zip_with(f"groups{k}", bases(k), lambda g, base: F.transform(g["spans"], lambda s: moved(s, base))))
    return t.withColumns({f"spans{k}": F.when(F.col(f"groups{k}").isNotNull(), spans(k)).otherwise(empty) for k in kinds})


def upper_tail(x: Column) -> Column:
    """P(N > x) of a standard normal, to 1e-7 in absolute and well in relative terms for x > 0."""
    return let(x, _upper_tail)


def _upper_tail(z: Column) -> Column:
    a = F.abs(z)
    t = 1 / (1 + 0.2316419 * a)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-a * a / 2) * 0.3989422804014327 * poly
    return F.when(z >= 0, tail).otherwise(1 - tail)


def let(value: Column, use) -> Column:
    """use(value), with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def battery(match: Column) -> Column:
    """The p-value of one candidate: small where it looks drawn evenly from its alphabet. One pass over its letters for each test."""
    number = lambda x: F.lit(0.0).alias(x)
    start = F.struct(F.lit(None).cast("double").alias("first"), number("last"), number("sum"), number("square"), number("lagged"))
    value = lambda body: F.transform(F.split(body, ""), lambda c: F.instr(F.lit(LETTERS), c).cast("double"))

    def add(a: Column, v: Column) -> Column:
        before = F.when(a["first"].isNull(), 0.0).otherwise(a["last"])
        return F.struct(F.coalesce(a["first"], v).alias("first"), v.alias("last"), (a["sum"] + v).alias("sum"), (a["square"] + v * v).alias("square"), (a["lagged"] + before * v).alias("lagged"))

    def tested(body: Column, n: Column, kind: Column, sums: Column) -> Column:
        size, ic, third, change = (F.element_at(F.create_map(*[F.lit(y) for k, v in ENCODINGS.items() for y in (k, float(v[i]))]), kind) for i in range(4))
        counts = F.transform(F.array_distinct(F.split(body, "")), lambda c: (n - F.length(F.replace(body, c, F.lit("")))))
        squares = F.aggregate(counts, F.lit(0.0), lambda s, c: s + c * c)
        chi = size / n * squares - n
        # Expected and spread of the same statistic for words: sum of squares = n + n (n - 1) ic.
        usual = size * (1 + (n - 1) * ic) - n
        spread = size * (n - 1) * F.sqrt(4 * (third - ic * ic) / n + 2 * (ic - ic * ic) / (n * (n - 1)))
        even = (usual - chi) / spread
        classes = F.translate(body, LETTERS, "A" * 26 + "a" * 26 + "0" * 10 + "+" * 5)
        # A single mark between letters, and a capital that begins a word, go with the word, as in names.
        joined = F.regexp_replace(F.regexp_replace(classes, r"(?<=[Aa0])\+(?=[Aa0])", ""), "(^|[^A])A(?=a)", "$1a")
        runs = F.length(F.regexp_replace(joined, r"(.)\1*", "$1")) - 1
        mixed = (runs - (n - 1) * change) / F.sqrt((n - 1) * change * (1 - change))
        mean = sums["sum"] / n
        around = sums["square"] - n * mean * mean
        lagged = sums["lagged"] - mean * (2 * sums["sum"] - sums["first"] - sums["last"]) + (n - 1) * mean * mean
        serial = F.when(around > 1e-9 * n, F.abs(lagged / around)).otherwise(1.0) * F.sqrt(n)
        return upper_tail((even + mixed) / 2**0.5 - F.greatest(serial - 2.5, F.lit(0.0)))

    kind = lambda body: F.when(body.rlike("^([0-9a-f]+|[0-9A-F]+)$"), "hex").when(body.rlike("^[A-Z2-7]+$"), "base32").otherwise("base64")
    parts = lambda body: F.struct(body.alias("body"), F.length(body).cast("double").alias("n"), kind(body).alias("kind"), F.aggregate(value(body), start, add).alias("sums"))
    return let(F.regexp_replace(match, "=+$", ""), lambda body: let(parts(body), lambda x: tested(x["body"], x["n"], x["kind"], x["sums"])))


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, base and candidates (with length and p-value) of every row."""
    t = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    value = F.transform(F.regexp_extract_all("t", F.lit(ASSIGN), F.lit(2)), lambda g: F.length(g) >= 12)
    t = found(t.withColumn("long", value), [ASSIGN, ACCESS, HEX, CANDIDATE], {0: lambda i: F.get("long", i)})
    t = t.select("doc_id", F.concat("spans0", "spans1", "spans2").alias("base"), F.col("spans3").alias("more"))
    free = F.filter("more", lambda c: ~F.exists("base", lambda b: (b["start"] <= c["start"]) & (c["end"] <= b["end"])))
    span = lambda x: (x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"))
    weighed = F.transform(free, lambda c: F.struct(*span(c), F.least(c["end"] - c["start"], F.lit(LONGEST)).cast("double").alias("weight"), battery(c["match"]).alias("p")))
    return t.select("doc_id", F.array_sort(F.transform("base", lambda b: F.struct(*span(b)))).alias("base"), weighed.alias("more"))


def bin_of(p: Column, weight: Column, mean: float) -> Column:
    return F.floor(-10 * F.log10(F.greatest(p * mean / weight, F.lit(10.0**-DECADES)))).cast("int")


def limit(rows: DataFrame) -> tuple[float, int]:
    """Mean weight, and the least bin whose discoveries stay within FDR."""
    every = rows.select(F.explode("more").alias("c")).select("c.weight", "c.p")
    mean, total = every.agg(F.avg("weight"), F.count("*")).first()
    if not total:
        return 1.0, DECADES * 10 + 1
    bins = every.groupBy(bin_of(F.col("p"), F.col("weight"), mean).alias("bin")).count().collect()
    seen, best = 0, DECADES * 10 + 1
    for r in sorted(bins, key=lambda r: -r.bin):
        seen += r["count"]
        if total * 10 ** (-r.bin / 10) <= FDR * seen:
            best = r.bin
    return mean, best


def shown(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat(names[s["kind"]], F.lit(":"), s["start"], F.lit(":"), s["end"])), ",")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256, spans, n_random of every row."""
    rows = stored(scanned(docs), "secrets")
    mean, best = limit(rows)
    random = F.transform(F.filter("more", lambda c: bin_of(c["p"], c["weight"], mean) >= best), lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end")))
    number = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    every = F.array_sort(F.concat("base", random))
    return rows.select("doc_id", *(number(k) for k in range(3)), F.sha2(F.encode(shown(F.col("base")), "UTF-8"), 256).alias("base_sha256"), shown(every).alias("spans"), F.size(random).cast("long").alias("n_random"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir, "doc_id", "text"))
