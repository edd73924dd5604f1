import pyarrow as pa
import pytest

from peptrove.llm import _common as C


def test_slices_are_whole_rows():
    texts = ["a" * 10, None, "", "b" * 300, "c", "d" * 50, None]
    for kind in (pa.string(), pa.large_string(), pa.binary()):
        batch = pa.record_batch({"i": pa.array(range(7)), "t": pa.array(texts).cast(kind) if kind != pa.binary() else pa.array([None if t is None else t.encode() for t in texts], kind)})
        for own in (batch, batch.slice(2, 4), batch.slice(0, 0)):
            for most in (1, 60, 10_000):
                parts = list(C.slices([own, own], "t", most))
                assert [i for p in parts for i in p.column(0).to_pylist()] == own.column(0).to_pylist() * 2 and all(p.num_rows for p in parts)
                assert [x for p in parts for x in C.texts_of(p, "t")] == C.texts_of(own, "t") * 2
                assert all(p.num_rows == 1 or sum(map(len, C.texts_of(p, "t"))) <= most for p in parts)


def test_written_tables_are_deleted_on_request(spark):
    out = C.materialize(spark.range(5), "five")
    assert out.count() == 5 and C.materialize(out.groupBy().count(), "one").first()[0] == 5
    before = spark.conf.get(C.CLEANUP, None)
    C.materialize(spark.range(9).repartition(3), "nine")
    assert spark.conf.get(C.CLEANUP, None) == before
    C.discard(spark)
    with pytest.raises(Exception, match="(?i)path|exist"):
        spark.read.parquet(f"{C.own_dir(spark)}/five-*").count()
