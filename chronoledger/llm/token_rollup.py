"""Token counts as delta-maintained rollups.

Tokens are counted once per document and tokenizer version. A change is a signed row: an insert adds a document's tokens,
a delete takes them off, a revised count takes the old one off and adds the new one. A batch of changes is reduced to one
row of additive deltas per (source, lang, tokenizer version) in a folder of its own, and one row in a log publishes it
under its batch id; a batch id that is published counts once, however often it is run. ``compact`` folds all
published deltas into a snapshot that remembers their ids.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import remove, scratch_path, written

KEYS = ("source", "lang", "tokenizer")
WORDS, PIECES = r"[^\x20\x09-\x0D]+", r"[A-Za-z]+|[0-9]+|[^A-Za-z0-9\x20\x09-\x0D]"

#: Tokenizer versions by name: an expression over the text. Any Column of token counts may be added.
TOKENIZERS = {"words-1": WORDS, "words-2": PIECES}


def count_tokens(text: Column, tokenizer: str) -> Column:
    """Tokens of a text under a version of TOKENIZERS; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(TOKENIZERS[tokenizer])), F.lit(0)).cast("long")


def counted(docs: DataFrame, *tokenizers: str) -> DataFrame:
    """source, lang and ``counts``, the tokens under each version (all of TOKENIZERS by default), of every row.

    Takes source, lang and text; other columns, whatever their names, are ignored. Null texts count 0.
    """
    counts = F.struct(*[count_tokens(F.col("text"), t).alias(t) for t in tokenizers or TOKENIZERS])
    return docs.select("source", "lang", counts.alias("counts"))


def _change(tokenizer: str, sign: int) -> Column:
    n = F.col("counts").getField(tokenizer)
    return F.struct(F.lit(tokenizer).alias("tokenizer"), F.lit(sign).cast("long").alias("docs"), (n * sign).alias("tokens"))


def inserted(counts: DataFrame, tokenizer: str, sign: int = 1) -> DataFrame:
    """Changes that add (sign 1) or take off (-1) counted documents under a version. Null keys are keys of their own."""
    return counts.select("source", "lang", _change(tokenizer, sign).alias("c")).select("source", "lang", "c.*")


def deleted(counts: DataFrame, tokenizer: str) -> DataFrame:
    """Changes that take counted documents off; of documents that were never inserted, totals go below 0."""
    return inserted(counts, tokenizer, -1)


def revised(counts: DataFrame, old: str, new: str) -> DataFrame:
    """Changes that move counted documents from one version to another. Repeated rows move as often as they occur."""
    both = F.explode(F.array(_change(old, -1), _change(new, 1)))
    return counts.select("source", "lang", both.alias("c")).select("source", "lang", "c.*")


class Rollup:
    """Totals by source, language and tokenizer version in a folder that all executors share.

    Null and empty keys are keys of their own; null texts count 0 tokens and 1 document. A group whose documents are
    all taken off again has totals 0 and is left out of ``totals``. Repeated rows count as often as they occur.

    A folder is seen once a row of the log names it, and a log row is one small file that appears as a whole, so a crash
    at any point leaves the totals before or after the commit. Of two runs that publish one batch id, one counts.
    """

    _LOG = "batch_id long, folder string, covers array<long>"
    _DELTA = "source string, lang string, tokenizer string, docs long, tokens long"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        spark.createDataFrame([], self._LOG).write.mode("ignore").parquet(f"{self.path}/log")

    def _publish(self, batch_id: int | None, folder: str, covers: list[int] | None) -> None:
        self.spark.createDataFrame([(batch_id, folder, covers)], self._LOG).coalesce(1).write.mode("append").parquet(f"{self.path}/log")

    def _state(self) -> tuple[set[int], list[str], list[str]]:
        """Ids that are published, folders that hold the totals, and folders that no longer do. The log has a row a commit."""
        rows = sorted(self.spark.read.schema(self._LOG).parquet(f"{self.path}/log").collect(), key=lambda r: r.folder)
        shots = [r for r in rows if r.batch_id is None]
        best = max(shots, key=lambda r: len(r.covers), default=None)
        ids, used = set(best.covers) if best else set(), [best.folder] if best else []
        for r in rows:
            if r.batch_id is not None and r.batch_id not in ids:
                ids.add(r.batch_id)
                used.append(r.folder)
        return ids, used, [r.folder for r in rows if r.folder not in used]

    def commit(self, batch_id: int, changes: DataFrame) -> bool:
        """Reduces, stores and publishes a batch; False, and nothing changes, if its id is published."""
        if batch_id in self._state()[0]:
            return False
        folder = f"delta-{batch_id}-{uuid.uuid4().hex}"
        changes.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).write.parquet(f"{self.path}/{folder}")
        self._publish(batch_id, folder, None)
        return True

    def _totals(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], "source string, lang string, tokenizer string, n_docs long, n_tokens long")
        deltas = self.spark.read.schema(self._DELTA).parquet(*[f"{self.path}/{f}" for f in folders])
        out = deltas.groupBy(*KEYS).agg(F.sum("docs").alias("n_docs"), F.sum("tokens").alias("n_tokens"))
        return out.where("n_docs <> 0 or n_tokens <> 0")

    def totals(self) -> DataFrame:
        return self._totals(self._state()[1])

    def compact(self) -> None:
        """Folds what is published into one snapshot; its batch ids stay published."""
        ids, folders, _ = self._state()
        folder = f"snapshot-{uuid.uuid4().hex}"
        self._totals(folders).withColumnsRenamed({"n_docs": "docs", "n_tokens": "tokens"}).write.parquet(f"{self.path}/{folder}")
        self._publish(None, folder, sorted(ids))

    def vacuum(self) -> None:
        """Removes folders that a snapshot has replaced; only when nobody reads older totals."""
        for folder in self._state()[2]:
            remove(self.spark, f"{self.path}/{folder}")


ROLLUP_SQL = """
WITH d AS (
  SELECT source, lang, CASE WHEN lang IN ('de', 'fr') THEN 'words-2' ELSE 'words-1' END AS tokenizer, text
  FROM documents WHERE coalesce(source, '') <> 'src3'
)
SELECT source, lang, tokenizer, count(*) AS n_docs,
  CAST(sum(CASE WHEN tokenizer = 'words-1' THEN coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)
           ELSE coalesce(len(regexp_extract_all(text, '[A-Za-z]+|[0-9]+|[^A-Za-z0-9\\x20\\x09-\\x0D]')), 0) END) AS BIGINT) AS n_tokens
FROM d GROUP BY ALL
"""


def op10_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents inserted, German and French ones moved to the second tokenizer version, source src3 deleted."""
    counts = written(counted(spark.read.parquet(f"{sf_dir}/documents.parquet")), "counts")  # texts are read once
    rollup = Rollup(spark, scratch_path(spark, "token-rollup"))
    moved = F.coalesce(F.col("lang").isin("de", "fr"), F.lit(False))
    gone = F.col("source") == "src3"
    rollup.commit(1, inserted(counts, "words-1"))
    rollup.commit(2, revised(counts.where(moved), "words-1", "words-2"))
    rollup.compact()
    rollup.commit(2, revised(counts.where(moved), "words-1", "words-2"))  # run again after a failure: no change
    rollup.commit(3, deleted(counts.where(gone & ~moved), "words-1").unionByName(deleted(counts.where(gone & moved), "words-2")))
    return rollup.totals()
