import corpus_pipeline
from pyspark.sql import functions as F

from tesserae.llm import mixing
from tesserae.llm.common import read

from test_operators import documents, plain_components, plain_spans


def test_stages(spark, tmp_path):
    rows = [r for r in documents() if r[0] is not None]
    rows = [(i, f"{t} mail me{i}@x.org" if t and i % 3 == 0 and i < 30 else t, lang, source, n) for i, t, lang, source, n in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    docs = read(spark, str(tmp_path), "documents")
    held = docs
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "personal_data", "mixture", "packing"]
    before = None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, path = held, str(tmp_path / name)
        stage(spark, held, str(tmp_path)).write.parquet(path)
        held = spark.read.parquet(path)
        assert held.columns == docs.columns
        got = [tuple(r) for r in held.collect()]
        came = [tuple(r) for r in before.collect()]
        if name == "language":
            assert {r[0] for r in came} - {r[0] for r in got} == {300, 301, 302}
        elif name == "near_duplicates":
            named = {c for _, _, c in plain_components(came, 5, 4, 5)}
            assert sorted({r[0] for r in got}) == sorted(named) and len(got) == len(named)
        elif name == "personal_data":
            assert len(got) == len(came) and not any(plain_spans(r[1]) for r in got) and any("[EMAIL]" in r[1] for r in got)
        else:
            sizes = {}
            for r in came:
                sizes[r[0]] = len(r[1].split())
            taken = {r["doc_id"]: r["taken"] for r in mixing.mix(before).collect()}
            made = {i: 0 for i in sizes}
            for r in got:
                made[r[0]] += len(r[1].split())
            assert made == taken
    last = corpus_pipeline.STAGES[-1][1](spark, held, str(tmp_path))
    assert last.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == last.count()
