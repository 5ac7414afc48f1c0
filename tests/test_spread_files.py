"""Files that are as many as the rows: written, listed and read by tasks, so that the driver holds no name of them."""

import os

from pagemill.plans import catalog_files
from pagemill.sources import files, formats
from pagemill.sources.pdf import write_pages


def test_a_task_answers_with_its_folder_alone(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(formats, "MOST", 3)
    rows = spark.createDataFrame([(f"{i:012d}.json", f'{{"doc_id": {i}}}'.encode()) for i in range(20)], "name string, content binary").repartition(2)
    formats.register(spark)
    folder = str(tmp_path / "out")
    said = []
    monkeypatch.setattr(formats, "Written", lambda *a, plain=formats.Written: said.append(a) or plain(*a))
    writer = formats.FileWriter({"path": folder, "spread": "true"}, rows.schema, False)

    class Task:
        partitionId, taskAttemptId = staticmethod(lambda: 0), staticmethod(lambda: 5)

    import pyspark

    monkeypatch.setattr(pyspark, "TaskContext", type("T", (), {"get": staticmethod(Task)}))
    message = writer.write(iter(rows.toArrow().to_batches()))
    assert message.names == [] and len(said) == 1
    writer.commit([message, None])
    assert [d for d in os.listdir(folder)] == [f"spread-{writer.run}-0-5"]
    assert sorted(len(os.listdir(d)) for d in formats.spread_folders(folder)) == [2, 3, 3, 3, 3, 3, 3]


def test_spread_files_are_read_back(spark, tmp_path):
    texts = {i: [f"page {k} of {i}" for k in range(1, 3 + i % 2)] for i in range(30)}
    rows = spark.createDataFrame([(f"{i:012d}.pdf", write_pages(t, {"Title": str(i)})) for i, t in texts.items()], "name string, content binary").repartition(3)
    folder = catalog_files.written(spark, rows)
    assert not [f for f in os.listdir(folder) if f.endswith(".pdf")] and formats.spread_folders(folder)
    want = sorted((i, k, t) for i, ts in texts.items() for k, t in enumerate(ts, 1))
    number = catalog_files.NUMBER("path").alias("doc_id")
    read = spark.read.format("pdf_pages").load(folder)
    assert sorted((r.doc_id, r.page_no, r.text) for r in read.select(number, "page_no", "text").collect()) == want
    assert sorted((r.doc_id, r.page_no, r.text) for r in files.pdf_pages(files.pdf_files(spark, folder)).select(number, "page_no", "text").collect()) == want
    first = spark.read.format("pdf_pages").option("limit", 7).load(folder).select(number).distinct().collect()
    assert sorted(r.doc_id for r in first) == [*range(7)]
    assert sorted(r.doc_id for r in files.pdf_files(spark, folder, 7).select(number).collect()) == [*range(7)]
    rows.limit(1).write.format("row_files").option("spread", True).mode("overwrite").save(folder)
    assert spark.read.format("spread_files").load(folder).count() == 1


def test_results_in_spread_files(spark, tmp_path):
    content = [b'{"doc_id": 1, "text": "a\\nb"}', b'[{"doc_id": 2}, {"doc_id": 3, "text": ""}]', b'{"doc_id": 4, "te', b'{\n "doc_id": 5}']
    rows = spark.createDataFrame([(f"{i}.json", c) for i, c in enumerate(content)], "name string, content binary")
    plain = str(tmp_path / "plain")
    formats.register(spark)
    rows.write.format("row_files").mode("append").save(plain)
    schema = "doc_id long, text string"
    got = [sorted(map(str, files.read_results(spark, f, schema).collect())) for f in (plain, catalog_files.written(spark, rows))]
    assert got[0] == got[1] and len(got[0]) == 5
