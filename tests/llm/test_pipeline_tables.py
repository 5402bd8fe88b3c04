"""What a stage's result reads goes once the next stage has the result itself."""

import glob

import corpus_pipeline
from plumbline.functions.tables import scratch_dir, written

from tests.llm.test_pipeline import corpus


def test_a_stage_leaves_no_second_copy_of_its_result(spark):
    rows, _ = corpus()
    docs = spark.createDataFrame([(i, t, k, "s", len(t or "")) for i, t, k in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = lambda: set(glob.glob(f"{scratch_dir(spark)}/known-language-*"))
    before = left()
    known = corpus_pipeline.known_language(spark, docs, "")
    (own,) = left() - before
    chained = corpus_pipeline.without_repeated_lines(spark, known, "")  # reads the table itself
    assert own in left() and chained.count() == known.count()
    result = written(known, "result")
    assert corpus_pipeline.without_repeated_lines(spark, result, "").count() == result.count()
    assert own not in left()
