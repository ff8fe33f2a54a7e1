"""A task holds chunks of bounded size, however many texts a batch has."""

import pyarrow as pa
from pyspark.sql.types import StructType

from quillmill.operators import chunk


def test_chunks_go_on_in_parts(spark, monkeypatch):
    texts = [f"# T{i}\n" + "word " * 300 + "\n\n" + "other " * 300 for i in range(12)]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, t string").coalesce(1)
    whole = [tuple(r) for r in chunk.chunk(df, "k", "t").drop("chunk_strategy").collect()]
    monkeypatch.setattr(chunk, "CHARS", 4000)
    kinds = {"int": pa.int32(), "string": pa.string(), "array<string>": pa.list_(pa.string())}
    sent = pa.schema([("k", pa.int64()), *[(f.name, kinds[f.dataType.simpleString()]) for f in StructType.fromDDL(chunk.CHUNK)]])
    batch = pa.RecordBatch.from_arrays([pa.array(range(12)), pa.array(texts)], names=["k", "t"])
    parts = list(chunk._chunker("k", sent, "structured", 500, 50, True)(iter([batch])))
    assert all(sum(map(len, p.column("content").to_pylist())) < 4000 + 600 for p in parts) and len(parts) > 5
    assert [tuple(r.values()) for p in parts for r in p.to_pylist()] == whole
