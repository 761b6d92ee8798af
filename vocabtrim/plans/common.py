"""Shared building blocks of the registered queries.

``Inputs`` gathers the frames most queries start from.  The vocabulary is
materialised once per (session, data folder) — it is the checkpointed output of
a distributed ranking — and reused by every query that encodes text.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from ..sources.corpus import lay_out, pair_corpus, scan_layout, table, with_labels
from ..functions.text import SPECIAL_TOKENS
from ..operators.ordering import stored
from ..operators.tokens import counting_words, texts, vocab_size, vocabulary_of, word_counts, words

_VOCAB_CACHE: dict[tuple, tuple[DataFrame, int]] = {}
_SHARED: dict[tuple, DataFrame] = {}
_LAYOUTS: dict[tuple, str] = {}


@dataclass
class Inputs:
    spark: SparkSession
    sf_dir: str

    def table(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    def layout(self, *groups: str) -> DataFrame:
        """The documents corpus laid out by split, written once per session."""
        key = (*self._key(), "layout")
        if key not in _LAYOUTS:
            path = f"{ensure_checkpoint_dir(self.spark)}/corpus-{uuid.uuid4().hex}"
            lay_out(self.spark, self.sf_dir, path)
            _LAYOUTS[key] = path
        return scan_layout(self.spark, _LAYOUTS[key], groups)

    def corpus(self) -> DataFrame:
        return with_labels(self.spark, self.sf_dir, self.text_corpus())

    def text_corpus(self, *extra: str) -> DataFrame:
        return self.layout(*extra).select("example_id", "split", "text_a", *extra)

    def pairs(self) -> DataFrame:
        return pair_corpus(self.spark, self.sf_dir)

    def texts(self, corpus: DataFrame | None = None) -> DataFrame:
        return texts(self.text_corpus() if corpus is None else corpus)

    def words(self, corpus: DataFrame | None = None, specials: bool = False) -> DataFrame:
        return words(self.texts(corpus), add_special_tokens=specials)

    def counting_words(self, corpus: DataFrame | None = None, specials: bool = False) -> DataFrame:
        return counting_words(self.texts(corpus), add_special_tokens=specials)

    def vocab(self) -> DataFrame:
        return self._vocab()[0]

    def vocab_rows(self) -> int:
        return self._vocab()[1]

    def _key(self):
        # the application id changes with every SparkContext, so a stopped
        # session's frames are never reused; nor are those of files replaced since
        return (id(self.spark), self.spark.sparkContext.applicationId, self.sf_dir, self._listing())

    def _listing(self):
        """Names, lengths and times of the document files, on whatever file system they lie."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(f"{self.sf_dir}/documents.parquet")
        return tuple((f.getPath().getName(), f.getLen(), f.getModificationTime())
                     for f in path.getFileSystem(conf).listStatus(path))

    def _vocab(self):
        key = self._key()
        if key not in _VOCAB_CACHE:
            counts = self.split_words().filter(~F.col("word").isin(list(SPECIAL_TOKENS)))
            v = vocabulary_of(counts.groupBy("word").agg(F.sum("cnt").alias("cnt")))
            _VOCAB_CACHE[key] = (v, vocab_size(v))
        return _VOCAB_CACHE[key]

    def split_words(self) -> DataFrame:
        """``(split, word, cnt, df)`` of the documents corpus, CLS and SEP of each text among
        the words: the one pass over the texts that the vocabulary and all counts come from."""
        return self.shared("split_words", lambda: word_counts(self.counting_words(specials=True), ["split"]))

    def shared(self, name: str, build):
        """A corpus-level intermediate (e.g. the train-split token counts) that
        several jobs read: materialised once per session in the checkpoint folder."""
        key = (*self._key(), name)
        if key not in _SHARED:
            _SHARED[key] = stored(build(), name)
        return _SHARED[key]
