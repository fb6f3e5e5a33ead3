"""The pipeline's stages on odd and empty tables; each stage's result is told from its input, plainly."""

import pytest

import corpus_pipeline as P

from . import cases

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"
BENCHMARK = "item_id long, text string"


def tables(spark, at, docs, labels, items):
    for name, rows, schema in (("documents", docs, DOCS), ("labels", labels, LABELS), ("benchmark", items, BENCHMARK)):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{at}/{name}.parquet")
    return spark.read.parquet(f"{at}/documents.parquet")


def odd():
    return [(i, t, None if i == 3 else "en", "s", None if t is None else len(t)) for i, t, *_ in cases.rows()]


@pytest.mark.parametrize("docs", [[], odd()], ids=["empty", "odd"])
def test_stages_without_labels_or_benchmark(spark, tmp_path, docs):
    """No labels and no benchmark: nothing is rejected and nothing is contaminated, whatever the rows are."""
    read = tables(spark, tmp_path, docs, [], [])
    for stage in (P.keep_quality, P.drop_contaminated):
        out = stage(spark, read, str(tmp_path))
        assert out.columns == P.COLUMNS and sorted(map(str, out.collect())) == sorted(map(str, read.collect()))


def test_no_documents(spark, tmp_path):
    read = tables(spark, tmp_path, [], [(1, 1, 0), (2, 0, 1)], [(1, "a b c d e f g"), (None, None)])
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, read, str(tmp_path))
        assert (name, out.columns, out.collect()) == (name, P.COLUMNS, [])
    assert P.pack(spark, read, str(tmp_path)).collect() == []


def test_rows_of_odd_documents(spark, tmp_path):
    docs = odd()
    read = tables(spark, tmp_path, docs, [(i, 1, 0) for i, *_ in docs], [(1, " ".join(cases.words(2, 45)))])
    lines = P.drop_lines(spark, read, str(tmp_path)).collect()
    assert sorted(str(r.doc_id) for r in lines) == sorted(str(d[0]) for d in docs)
    assert all(r.n_chars == (0 if r.text is None else len(r.text)) or r.text is None for r in lines)
    apart = {str(r.doc_id) for r in P.drop_near_duplicates(spark, read, str(tmp_path)).collect()}
    assert {"1", "5", "6", "7", "8", "10", "18"} <= apart and not {"2", "3"} & apart
    clean = {str(r.doc_id) for r in P.drop_contaminated(spark, read, str(tmp_path)).collect()}
    assert not {"4", "14", "17"} & clean and {"1", "2", "3", "5", "6", "10", "16"} <= clean
