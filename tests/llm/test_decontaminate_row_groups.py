"""What a task holds of the index does not grow with its input."""

import glob

import corpus_pipeline as cp
import numpy as np
import pyarrow.parquet as pq
from lectern.llm import decontaminate


def test_row_groups_of_a_large_partition_are_bounded(spark, monkeypatch, tmp_path):
    rng = np.random.default_rng(7)
    words = [f"w{n:x}" for n in range(50_000)]
    texts = [" ".join(words[k] for k in rng.integers(0, len(words), 180_000)) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    monkeypatch.setattr(decontaminate, "fresh_path", lambda _, name: str(tmp_path / name))
    index = decontaminate.build_index(docs)
    assert index.count() >= 10
    sizes = [pq.ParquetFile(f).metadata.row_group(g).total_byte_size for f in glob.glob(f"{tmp_path}/postings/*.parquet") for g in range(pq.ParquetFile(f).metadata.num_row_groups)]
    assert max(sizes) < 24 << 20


def test_the_stage_keeps_texts_out_of_the_index_and_judges_rows_one_by_one(spark, monkeypatch, tmp_path):
    item = " ".join(f"item{n}" for n in range(12))
    rows = [(1, "clean text", 5), (1, f"a {item} b", 6), (None, f"{item}", 7), (None, None, 8), (2, None, 9), (3, "", None), (1, f"a {item} b", 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = []
    build = decontaminate.build_index
    monkeypatch.setattr(decontaminate, "build_index", lambda docs, keep: kept.append(tuple(keep)) or build(docs, keep))
    got = cp.decontamination(spark, docs, str(tmp_path))
    assert got.columns == docs.columns
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, [rows[0], rows[3], rows[4], rows[5]]))
    assert kept and all("text" not in k for k in kept)
