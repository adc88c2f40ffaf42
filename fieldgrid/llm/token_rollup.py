"""Token counts as delta-maintained rollups.

A rollup is a folder of committed batches. A batch holds signed changes of the
additive totals (documents, tokens) by source, language and tokenizer version:
an insert adds a document's count, a delete takes it away, a revision adds the
difference between the new count and the old. Changes are summed before they are
written, so a batch is as small as its number of groups, and totals are the sum
over batches.

A batch is committed once: it is written to a folder of the writer's own and then
renamed to one named by its id, a single step of the store that fails if the name
is taken. So a commit with a known id does nothing, two writers of one id leave
one batch, and what a writer that died has left behind is never read. ``compact``
folds the committed batches into a new base with the list of their ids, renamed in
the same way, and then drops them; one process compacts at a time.

Defined cases: null source or language form groups of their own; null counts
add nothing; null texts have no tokens; an empty batch commits and changes
nothing; groups whose totals are all zero are left out.
"""

from __future__ import annotations

import uuid
from urllib.parse import quote, unquote

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldgrid.llm.tokens import count_tokens

GROUPS = ["source", "lang", "tokenizer"]
TOTALS = ["n_docs", "n_tokens"]
SCHEMA = "source string, lang string, tokenizer string, n_docs long, n_tokens long"


def inserts(docs: DataFrame, tokens: Column, tokenizer: str) -> DataFrame:
    return docs.select("source", "lang", F.lit(tokenizer).alias("tokenizer"), F.lit(1).cast("long").alias("n_docs"), tokens.cast("long").alias("n_tokens"))


def deletes(docs: DataFrame, tokens: Column, tokenizer: str) -> DataFrame:
    return docs.select("source", "lang", F.lit(tokenizer).alias("tokenizer"), F.lit(-1).cast("long").alias("n_docs"), (-tokens).cast("long").alias("n_tokens"))


def revisions(docs: DataFrame, old: Column, new: Column, tokenizer: str) -> DataFrame:
    return docs.select("source", "lang", F.lit(tokenizer).alias("tokenizer"), F.lit(0).cast("long").alias("n_docs"), (new - old).cast("long").alias("n_tokens"))


class TokenRollup:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop, self._settings = spark.sparkContext._jvm.org.apache.hadoop, spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._at("").getFileSystem(self._settings)

    def _at(self, name: str):
        return self._hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _names(self, kind: str) -> list[str]:
        """Names of the committed folders of a kind, sorted."""
        if not self._fs.exists(self._at("")):
            return []
        return sorted(n for s in self._fs.listStatus(self._at("")) if (n := s.getPath().getName()).startswith(f"{kind}-"))

    def _publish(self, draft: str, name: str) -> bool:
        """Rename a draft to its committed name; False if that is taken."""
        files = self._hadoop.fs.FileContext.getFileContext(self._at("").toUri(), self._settings)
        none = self.spark.sparkContext._gateway.new_array(getattr(self._hadoop.fs, "Options$Rename"), 0)
        try:
            files.rename(self._at(draft), self._at(name), none)
        except Py4JJavaError as e:
            if not self._fs.exists(self._at(name)):
                raise
            self._fs.delete(self._at(draft), True)
            if "FileAlreadyExists" not in str(e.java_exception):
                raise
            return False
        return True

    def _ids(self) -> DataFrame:
        """Ids that the newest base holds."""
        bases = self._names("base")
        return self.spark.read.schema("id string").parquet(f"{self.path}/{bases[-1]}/ids") if bases else self.spark.createDataFrame([], "id string")

    def _open(self) -> list[str]:
        """Batches that the newest base doesn't hold: few, for compact drops what it folds."""
        names = self._names("batch")
        folded = {r.id for r in self._ids().filter(F.col("id").isin([_id(n) for n in names])).collect()} if names else set()
        return [n for n in names if _id(n) not in folded]

    def committed(self) -> set[str]:
        return {r.id for r in self._ids().collect()} | {_id(n) for n in self._names("batch")}

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Add a batch of changes; False if that id is already in."""
        name = f"batch-{quote(batch_id, safe='')}"
        if self._fs.exists(self._at(name)) or not self._ids().filter(F.col("id") == batch_id).isEmpty():
            return False
        draft = f"draft-{uuid.uuid4().hex}"
        sums = [F.sum(F.coalesce(F.col(c), F.lit(0))).alias(c) for c in TOTALS]
        changes.groupBy(*GROUPS).agg(*sums).write.parquet(f"{self.path}/{draft}")
        return self._publish(draft, name)

    def totals(self) -> DataFrame:
        parts = [f"{self.path}/{b}/sums" for b in self._names("base")[-1:]] + [f"{self.path}/{n}" for n in self._open()]
        if not parts:
            return self.spark.createDataFrame([], SCHEMA)
        sums = [F.sum(c).alias(c) for c in TOTALS]
        return self.spark.read.schema(SCHEMA).parquet(*parts).groupBy(*GROUPS).agg(*sums).filter(" OR ".join(f"{c} <> 0" for c in TOTALS))

    def compact(self) -> None:
        """Fold all committed batches into a new base, then drop what it replaces."""
        bases, batches, draft = self._names("base"), self._names("batch"), f"draft-{uuid.uuid4().hex}"
        new = [n for n in self._open()]
        self.totals().write.parquet(f"{self.path}/{draft}/sums")
        added = self.spark.createDataFrame([(_id(n),) for n in new], "id string")
        self._ids().union(added).write.parquet(f"{self.path}/{draft}/ids")
        number = int(bases[-1].rpartition("-")[2]) + 1 if bases else 0
        if self._publish(draft, f"base-{number:08d}"):
            for name in [*batches, *bases]:
                self._fs.delete(self._at(name), True)


def _id(name: str) -> str:
    return unquote(name.partition("-")[2])


def load_corpus(spark: SparkSession, docs: DataFrame, path: str, tokenizer: str = "byte_bpe_50k", vocabulary: str | None = None, keep_empty: bool = False) -> DataFrame:
    """A corpus's life in a rollup: estimates are inserted at once, exact counts revise them, documents without
    tokens are deleted, and every batch is sent twice, as after a crash. The totals are exact all the same.
    With ``keep_empty`` documents without tokens stay in n_docs: what is deleted is a second insert of them."""
    rollup = TokenRollup(spark, path)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    estimate = F.ceil(F.octet_length(text) / F.lit(3.0))
    counted = docs.select("source", "lang", estimate.alias("estimate"), count_tokens(text, vocabulary).alias("exact"))
    empty = docs.filter(text == "").select("source", "lang")
    batches = {
        "estimates": lambda: inserts(docs.select("source", "lang", estimate.alias("estimate")), F.col("estimate"), tokenizer),
        "exact": lambda: revisions(counted, F.col("estimate"), F.col("exact"), tokenizer),
        "empty": lambda: deletes(empty, F.lit(0), tokenizer),
    }
    if keep_empty:
        batches = {"empty-again": lambda: inserts(empty, F.lit(0), tokenizer)} | batches
    for batch_id, changes in batches.items():
        for _ in range(2):
            rollup.commit(batch_id, changes())
    rollup.compact()
    return rollup.totals()
