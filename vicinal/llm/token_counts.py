"""Token counts as delta-maintained rollups.

A ledger in a shared folder holds signed rows, one set for each committed batch: +1 with a document's token count when it
comes, -1 with the old count when it goes, both when it is revised. Totals by source, language and tokenizer version are
the sum of the batches' own small sums, so a batch touches only its documents and never recounts the corpus.

A batch is committed by Spark's success marker of its totals, written last. A committed batch is never applied again; one
that broke off is written over. So replaying any batch leaves the totals as they are, however often it is sent.

Defined results: a null text has no tokens, though its document counts. Null sources and languages are groups of their
own. Rows of one doc_id in one batch are one change, the greatest row; inserting a document that is there revises it,
deleting one that is not does nothing. A null doc_id is an id of its own. Empty batches commit and change nothing.
"""

from __future__ import annotations

import base64
import hashlib
import importlib.util
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


FOLDER, VOCABULARY = "/opt/tokenizers", "byte_bpe_50k.tiktoken"
_ID = "coalesce(doc_id, 9223372036854775807L)"
SIGNED = "id long, source string, lang string, tokenizer string, sign int, tokens long"
KEYS = ["source", "lang", "tokenizer"]


@lru_cache
def encoder(folder: str, vocabulary: str):
    import tiktoken

    spec = importlib.util.spec_from_file_location("tokenizer_folder", f"{folder}/__init__.py")
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    with open(f"{folder}/{vocabulary}", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=module.PATTERN, mergeable_ranks=ranks, special_tokens={})


def version(folder: str, vocabulary: str) -> str:
    """The vocabulary's name and a digest of its file."""
    with open(f"{folder}/{vocabulary}", "rb") as f:
        return f"{vocabulary.rpartition('.')[0]}@{hashlib.sha256(f.read()).hexdigest()[:12]}"


def count_tokens(docs: DataFrame, folder: str = FOLDER, vocabulary: str = VOCABULARY) -> DataFrame:
    """``docs(doc_id, source, lang, text, op)`` as (doc_id, source, lang, op, tokens), whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(folder, vocabulary).encode_ordinary
        for batch in batches:
            n = [len(encode(t.as_py())) if t.is_valid else 0 for t in batch.column(4)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(n, pa.int64())], ["doc_id", "source", "lang", "op", "tokens"])

    return docs.select("doc_id", "source", "lang", "op", "text").mapInArrow(run, "doc_id long, source string, lang string, op string, tokens long")


class Ledger:
    def __init__(self, spark: SparkSession, folder: str, tokenizer: str):
        self.spark, self.folder, self.tokenizer = spark, folder.rstrip("/"), tokenizer

    def _exists(self, path: str) -> bool:
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def _batches(self) -> list[str]:
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/totals")
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
        return sorted(n for n in names if self._exists(f"{self.folder}/totals/{n}/_SUCCESS"))

    def _read(self, kind: str, schema: str) -> DataFrame:
        paths = [f"{self.folder}/{kind}/{b}" for b in self._batches()]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def live(self, ids: DataFrame | None = None) -> DataFrame:
        """(id, source, lang, tokenizer, tokens) of the documents that are there; of ``ids(id)``, if they are given."""
        signed = self._read("signed", SIGNED)
        net = (signed if ids is None else signed.join(ids, "id", "left_semi")).groupBy("id", *KEYS).agg(F.sum("sign").alias("n"), F.sum(F.col("sign") * F.col("tokens")).alias("tokens"))
        return net.where("n > 0").drop("n")

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens over all committed batches."""
        parts = self._read("totals", "source string, lang string, tokenizer string, n_docs long, n_tokens long")
        return parts.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).where("n_docs != 0 or n_tokens != 0")

    def apply(self, batch: str, changes: DataFrame) -> bool:
        """Commits ``changes(doc_id, source, lang, op, tokens)``, op being insert, revise or delete. False if it was."""
        if self._exists(f"{self.folder}/totals/{batch}/_SUCCESS"):
            return False
        signed = f"{self.folder}/signed/{batch}"
        new = changes.select(F.expr(_ID).alias("id"), F.struct("op", "source", "lang", "tokens").alias("c")).groupBy("id").agg(F.max("c").alias("c")).select("id", "c.*")
        plus = new.where("op != 'delete'").select("id", "source", "lang", F.lit(self.tokenizer).alias("tokenizer"), F.lit(1).alias("sign"), "tokens")
        if self._batches():
            old = self.live(new.select("id"))  # other documents' rows are read, but neither shuffled nor summed
            plus = plus.union(old.select("id", *KEYS, F.lit(-1).alias("sign"), "tokens"))
        plus.write.mode("overwrite").parquet(signed)
        rows = self.spark.read.schema(SIGNED).parquet(signed)
        delta = rows.groupBy(*KEYS).agg(F.sum("sign").cast("long").alias("n_docs"), F.sum(F.col("sign") * F.col("tokens")).alias("n_tokens"))
        delta.write.mode("overwrite").parquet(f"{self.folder}/totals/{batch}")
        return True
