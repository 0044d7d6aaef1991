"""Corpus tables built once per session and kept in the shared folder.

The index is a persisted table, not a cached plan: every search reads it back with
column pruning, and a lost executor costs a re-read only.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.session import BROADCAST_ROWS, fresh_path, write_table
from lectern.operators.packed import Corpus, Lines, block_bases, placed_verses, tokenised_lines, tokenised_verses, with_norms_of_texts
from lectern.operators.text_jobs import phoneme_table
from lectern.sources import bindings

_built: dict[tuple, tuple] = {}
_blocks: dict[tuple, int] = {}


def _written(spark: SparkSession, sf_dir: str) -> int:
    """When the source table was last written: a rewritten one is read anew."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/documents.parquet")
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).getModificationTime()


def _once(spark: SparkSession, sf_dir: str, name: str, make) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf_dir, _written(spark, sf_dir), name)
    if key in _built:
        path, schema = _built[key]
        try:
            return spark.read.schema(schema).parquet(path)
        except AnalysisException:
            # the folder has been cleared since
            del _built[key]
    df = make()
    path = fresh_path(spark, name)
    write_table(df, path)
    _built[key] = (path, df.schema)
    return spark.read.schema(df.schema).parquet(path)


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _once(spark, sf_dir, "verses", lambda: bindings.verses(spark, sf_dir))


def arabic_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _once(spark, sf_dir, "arabic_verses", lambda: bindings.verses(spark, sf_dir, arabic=True))


def _packed(spark: SparkSession, sf_dir: str, name: str, verses, need_space: bool = False, with_norms: bool = True) -> Corpus:
    """The packed corpus as a view of its tokenised verses: they are written once, offsets are joined on reading."""
    tokens = _once(spark, sf_dir, name, lambda: tokenised_verses(verses(), need_space=need_space, with_norms=with_norms))
    bases = _once(spark, sf_dir, f"{name}_bases", lambda: block_bases(tokens))
    key = (spark.sparkContext.applicationId, sf_dir, _written(spark, sf_dir), name)
    if key not in _blocks:
        _blocks[key] = bases.count()
    tokens = tokens if with_norms else with_norms_of_texts(tokens)
    return Corpus(placed_verses(tokens, F.broadcast(bases) if _blocks[key] <= BROADCAST_ROWS else bases))


def corpus_lines(spark: SparkSession, sf_dir: str) -> Lines:
    """Words by verse, not placed in the corpus: written without a shuffle."""
    return Lines(_once(spark, sf_dir, "lines", lambda: tokenised_lines(bindings.plain_verses(spark, sf_dir))))


def packed_corpus(spark: SparkSession, sf_dir: str) -> Corpus:
    return _packed(spark, sf_dir, "packed", lambda: bindings.verses(spark, sf_dir))


def packed_arabic(spark: SparkSession, sf_dir: str) -> Corpus:
    """The Arabic-lettered corpus, split as the aligner splits it; few ask for normal forms, which nearly all differ and are not written."""
    return _packed(spark, sf_dir, "packed_arabic", lambda: bindings.verses(spark, sf_dir, arabic=True), need_space=True, with_norms=False)


def corpus_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per word: a view of the packed corpus."""
    return packed_corpus(spark, sf_dir).words()


def arabic_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the Arabic-lettered corpus with phonemes, a view too: what a query leaves out is not computed."""
    return phoneme_table(packed_arabic(spark, sf_dir).words())
