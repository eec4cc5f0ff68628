import pytest

from corpusloom import session, tables
from corpusloom.errors import InvalidConfiguration


@pytest.mark.parametrize("most", [400_000, 0])
def test_each_record_once(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(tables, "MAX_REPEATED", most)  # sent to every task, and joined
    rows = [(k, f"t{k}".encode(), "a") for k in range(200)] + [(7, b"t7", "a")] * 500 + [(3, b"other", "a"), (4, None, "a"), (None, b"x", "a"), (900, b"no form", "b"), (901, b"no corpus", None)]
    base = str(tmp_path)
    spark.createDataFrame(rows, "index bigint, bytes binary, corpus string").repartition(5).write.parquet(f"{base}/records.parquet")
    spark.createDataFrame([("a", "txt"), ("a", "txt"), (None, "xml")], "corpus string, form string").selectExpr("*", "null as record_element", "10L as target_record_bytes", "0L as overlap_bytes").write.parquet(f"{base}/stream_configs.parquet")
    found = [(r["index"], bytes(r["bytes"])) for r in tables.records_with_form(spark, base).collect()]
    assert sorted(i for i, _ in found) == list(range(200))
    assert all(b == f"t{i}".encode() for i, b in found if i != 3) and dict(found)[3] in (b"t3", b"other")
    assert found == sorted(found, key=found.index) and dict(found)[3] == dict((r["index"], bytes(r["bytes"])) for r in tables.records_with_form(spark, base).collect())[3]
    assert tables.records_with_form(spark, base, tables.F.col("form") == "json").count() == 0


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"
        _jsc = type("J", (), {"sc": lambda self: type("S", (), {"getCheckpointDir": lambda self: type("O", (), {"isEmpty": lambda self: True})()})()})()
        getConf = lambda self: type("C", (), {"get": lambda self, name: None})()

    with pytest.raises(InvalidConfiguration, match="share"):
        session.shared_folder(type("Spark", (), {"sparkContext": Context()})())


def test_written_tables(spark):
    df = spark.createDataFrame([(1, [2, 3]), (None, None)], "a bigint, b array<bigint>")
    own = session.written(df)
    assert sorted(map(repr, own.collect())) == sorted(map(repr, df.collect())) and own.schema == df.schema
    session.forget(own)
    with pytest.raises(Exception, match="(?i)not exist|no such file"):
        own.collect()
