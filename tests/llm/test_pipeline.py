import corpus_pipeline as cp
from lectern.llm import quality_qda
from pyspark.sql import functions as F

from tests.llm import test_decontaminate, test_near_dup, test_packing, test_substring_dedup
from tests.llm.cases import SPACED, count, frame, table, texts_of


def test_stages_equal_brute_force_one_by_one(spark, small_dir, tmp_path):
    docs = table(spark, small_dir, "documents")
    names = [n for n, _ in cp.STAGES]
    assert names == ["quality", "near_dedup", "substring_dedup", "decontamination", "packing"]
    for name, stage in cp.STAGES:
        made = stage(spark, docs, small_dir)
        made.write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        before = texts_of(docs)
        if name != "packing":
            assert after.columns == docs.columns and after.dtypes == docs.dtypes
        got = dict(texts_of(after)) if name != "packing" else {}
        if name == "quality":
            judged = quality_qda.classify(docs, table(spark, small_dir, "labels")).where("predicted = 1")
            assert set(got) == {r.doc_id for r in judged.select("doc.doc_id").collect()} and got.items() <= dict(before).items()
        elif name == "near_dedup":
            assert got == {i: t for (i, t), (_, c) in zip(before, test_near_dup._brute(before)) if i == c}
        elif name == "substring_dedup":
            assert got == {r[0]: r[4] for r in test_substring_dedup._brute(before)}
            assert count(after.where(F.char_length("text") != F.col("n_chars"))) == 0
        elif name == "decontamination":
            items = [(r.item_id, r.text) for r in table(spark, small_dir, "benchmark").collect()]
            hit = {r[0] for r in test_decontaminate._brute(before, items) if r[3]}
            assert got == {i: t for i, t in before if i not in hit}
        else:
            test_packing._check(after.collect(), before)
        docs = after


def test_run_and_cases(spark, small_dir, tmp_path):
    odd = frame(spark)
    for name in ("labels", "benchmark"):
        table(spark, small_dir, name).write.parquet(str(tmp_path / f"{name}.parquet"))
    odd.write.parquet(str(tmp_path / "documents.parquet"))
    rows = cp.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in rows} <= {r.doc_id for r in odd.collect()}
    docs = odd
    for name, stage in cp.STAGES[1:4]:  # nothing of these rows is lost but copies and contamination
        docs = stage(spark, docs, small_dir)
        assert docs.columns == odd.columns
    assert any(SPACED.search(r.text or "") for r in docs.collect())
    for name, stage in cp.STAGES:
        assert count(stage(spark, odd.where("false"), small_dir)) == 0
