"""What Python workers hold at a time does not grow with the rows of a batch."""

import pyarrow as pa

from pagemill.batches import PART, parts
from pagemill.operators import chunking, flows, generate
from pagemill.plans import catalog_files
from pagemill.sources import formats, sinks


def batch(rows, text):
    return pa.RecordBatch.from_arrays([pa.array(range(rows), pa.int64()), pa.array([text] * rows, pa.string())], ["doc_id", "text"])


def test_parts_hold_all_rows_in_order():
    whole = batch(5000, "x" * 2000)
    cut = list(parts([whole, batch(0, ""), batch(3, "y")]))
    assert pa.Table.from_batches(cut).column("doc_id").to_pylist() == [*range(5000), 0, 1, 2]
    assert len(cut) > 4 and max(p.num_rows for p in cut) * 2000 <= PART


def test_workers_give_small_batches():
    texts = batch(5000, "a word. " * 250)
    made = list(chunking._cut(iter([texts]), chunking.chunker("sliding", size=1200, overlap=200)))
    assert len(made) > 4 and sum(b.num_rows for b in made) == 5000 * made[0].num_rows // (made[0].column(0).to_pylist()[-1] + 1)
    asked = list(generate._call(iter([texts]), generate.Echo(), 10, 1, 0.0, whole=False))
    assert len(asked) > 4 and asked[0].schema.names == ["doc_id", "reply", "error", "tokens"] and sum(b.num_rows for b in asked) == 5000
    pages = pa.RecordBatch.from_arrays([pa.array(["n"] * 3000), pa.array([["p" * 200] * 10] * 3000, pa.list_(pa.string()))], ["name", "pages"])
    assert len(list(catalog_files._paged(iter([pages])))) > 2
    records = pa.RecordBatch.from_arrays([pa.array(["n"] * 1500), pa.array(["s" * 3000] * 1500)], ["_name", "summary"])
    assert len(list(sinks._exported(iter([records]), "docx"))) > 2


def test_the_writer_takes_arrow():
    assert issubclass(formats.FileWriter, formats.DataSourceArrowWriter)
