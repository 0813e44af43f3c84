"""Token counts as delta-maintained rollups.

A batch of changes (insert, delete, or revise with the old count) is summed to signed deltas by source, language
and tokenizer version, and committed under its batch id as a folder of Parquet with Spark's own success mark. A
batch that has its mark is not written again, one without it is overwritten, so a batch that comes twice or is
retried counts once. The totals are the sums over all marked batches; compact() folds them into one.

Defined results: sources, languages or versions that are null are groups of their own; a null count is 0; a
change of another kind than the three, or none, has no effect; repeated rows are changes each; an empty batch
commits with no effect; groups whose documents and tokens are all gone leave the totals. Further columns of the
changes are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tidewell.llm.bpe import encode_column
from tidewell.llm.common import documents, stored, work_dir

GROUP = ("source", "lang", "tokenizer")
DELTAS = StructType([*(StructField(c, StringType()) for c in GROUP), StructField("n_docs", LongType()), StructField("n_tokens", LongType())])
#: Words between white space; the same without digits; letter runs, digits and other letters one by one.
WORDS, NO_DIGITS, PIECES = r"[^\x20\x09-\x0D]+", r"[^\x20\x09-\x0D0-9]+", r"[A-Za-z]+|[0-9]|[^A-Za-z0-9\x20\x09-\x0D]"


def deltas(changes: DataFrame) -> DataFrame:
    """Signed sums of one batch; changes: source, lang, tokenizer, op, n_tokens, old_tokens."""
    n, old = F.coalesce("n_tokens", F.lit(0)).cast("long"), F.coalesce("old_tokens", F.lit(0)).cast("long")
    docs = F.when(F.col("op") == "insert", 1).when(F.col("op") == "delete", -1).otherwise(0)
    tokens = F.when(F.col("op") == "insert", n).when(F.col("op") == "delete", -n).when(F.col("op") == "revise", n - old).otherwise(0)
    return changes.groupBy(*(F.col(c).cast("string").alias(c) for c in GROUP)).agg(F.sum(docs).cast("long").alias("n_docs"), F.sum(tokens).cast("long").alias("n_tokens"))


class Ledger:
    """The committed batches below one folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _marked(self, name: str) -> bool:
        return self._fs.exists(self._path(f"{self.folder}/{name}/_SUCCESS"))

    def batches(self) -> list[str]:
        """Folders that count: the newest compacted one and all batches that it doesn't hold."""
        if not self._fs.exists(self._path(self.folder)):
            return []
        names = sorted(x.getPath().getName() for x in self._fs.listStatus(self._path(self.folder)))
        marked = [x for x in names if self._marked(x)]
        bases = [x for x in marked if x.startswith("base-")]
        held = set()
        if bases:
            held = {r.name for r in self.spark.read.schema("name string").json(f"{self.folder}/{bases[-1].replace('base-', 'held-')}").collect()}
        return bases[-1:] + [x for x in marked if x.startswith("batch-") and x not in held]

    def known(self, batch: int) -> bool:
        return self._marked(f"batch-{batch:012d}")

    def commit(self, batch: int, changes: DataFrame) -> bool:
        """False, and nothing done, if the batch is there already."""
        if self.known(batch):
            return False
        deltas(changes).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/batch-{batch:012d}")
        return True

    def totals(self, names: list[str] | None = None) -> DataFrame:
        """The sums over the named folders, by default over all that count now."""
        names = self.batches() if names is None else names
        if not names:
            return self.spark.createDataFrame([], DELTAS)
        rows = self.spark.read.schema(DELTAS).parquet(*(f"{self.folder}/{x}" for x in names))
        return rows.groupBy(*GROUP).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).where("n_docs <> 0 or n_tokens <> 0")

    def compact(self) -> None:
        """Folds all batches into a new base; which ones it holds is written first, so that a crash leaves the old state.

        The folders of batches stay as marks against redelivery; they're small.
        """
        names = self.batches()  # what is committed after this stays out of both the base and its list
        batches = [x for x in names if x.startswith("batch-")]
        if not batches:
            return
        old = [x for x in names if x.startswith("base-")]
        every = {x.getPath().getName() for x in self._fs.listStatus(self._path(self.folder))}
        number = 1 + max([int(x.split("-")[1]) for x in every if x.startswith(("base-", "held-"))], default=0)
        held = self.spark.createDataFrame([(x,) for x in batches], "name string")
        if old:
            held = held.union(self.spark.read.schema("name string").json(f"{self.folder}/{old[0].replace('base-', 'held-')}"))
        held.coalesce(1).write.mode("overwrite").json(f"{self.folder}/held-{number:06d}")
        self.totals(names).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/base-{number:06d}")


def token_changes(docs: DataFrame, path: str, version: str, op: str = "insert") -> DataFrame:
    """Changes for deltas(): each document's number of tokens by a vocabulary of the tokenizers library, named `version`.

    A null text has no tokens.
    """
    ids = encode_column(docs.select("source", "lang", "text"), path, ids="token_ids")
    return ids.select("source", "lang", F.lit(version).alias("tokenizer"), F.lit(op).alias("op"), F.size("token_ids").cast("long").alias("n_tokens"), F.lit(0).cast("long").alias("old_tokens"))


def counted(docs: DataFrame) -> DataFrame:
    n = lambda p: F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(p), F.lit(0))).cast("long")
    return docs.select("source", "lang", n(WORDS).alias("words"), n(NO_DIGITS).alias("no_digits"), n(PIECES).alias("pieces"))


def op2_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A history of all documents: two versions inserted, one revised, its short documents deleted; the first batch comes twice."""
    rows = stored(counted(documents(spark, sf_dir, "source", "lang", "text")), "counts")
    change = lambda version, op, n, old="0": rows.select("source", "lang", F.lit(version).alias("tokenizer"), F.lit(op).alias("op"), F.col(n).alias("n_tokens"), F.expr(old).alias("old_tokens"))
    first = change("words-1", "insert", "words")
    ledger = Ledger(spark, work_dir(spark, "rollup"))
    ledger.commit(1, first)
    ledger.commit(2, change("pieces-1", "insert", "pieces"))
    ledger.commit(3, change("words-1", "revise", "no_digits", "words"))
    ledger.compact()
    ledger.commit(1, first)
    ledger.commit(4, rows.where("words < 5").select("source", "lang", F.lit("words-1").alias("tokenizer"), F.lit("delete").alias("op"), F.col("no_digits").alias("n_tokens"), F.lit(0).alias("old_tokens")))
    return ledger.totals()


ORACLE = rf"""
WITH counts AS (
  SELECT source, lang,
    len(regexp_extract_all(coalesce(text, ''), '{WORDS}')) AS words,
    len(regexp_extract_all(coalesce(text, ''), '{NO_DIGITS}')) AS no_digits,
    len(regexp_extract_all(coalesce(text, ''), '{PIECES}')) AS pieces
  FROM documents)
SELECT source, lang, 'words-1' AS tokenizer, count(*) AS n_docs, CAST(sum(no_digits) AS BIGINT) AS n_tokens
FROM counts WHERE words >= 5 GROUP BY source, lang
UNION ALL
SELECT source, lang, 'pieces-1', count(*), CAST(sum(pieces) AS BIGINT) FROM counts GROUP BY source, lang
"""
