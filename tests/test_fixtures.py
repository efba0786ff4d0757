import datetime as dt

import pytest
from pyspark.sql import functions as F

from lightbox.fixtures import VIEWS, Library
from lightbox.workload import QUERIES, registry

N = 60


@pytest.fixture()
def lib(spark):
    out, day = Library(spark, "/none"), dt.datetime(2024, 1, 1)
    texts = [None if i == 3 else "" if i == 4 else f"text {i % 10} é" for i in range(N)]
    out._cache |= {
        "documents": spark.createDataFrame([(i, t, len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, n_chars long"),
        "orders": spark.createDataFrame([(i, day + dt.timedelta(i)) for i in range(N + 5)], "o_orderkey long, o_orderdate timestamp_ntz"),
        "events": spark.createDataFrame([(i, day) for i in range(N - 2)], "event_id long, ts timestamp_ntz"),
        "embeddings": spark.createDataFrame([(i, [1.0, float(i)]) for i in range(0, 2 * N, 4)], "vec_id long, embedding array<float>"),
    }
    return out


def test_media_is_its_view_without_texts_in_joins(spark, lib, rows):
    view = lib.sql(VIEWS["media"])
    assert lib.media.schema == view.schema and lib.media.count() == N - 2
    assert rows(lib.media.fillna("null")) == rows(view.fillna("null"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = spark._jvm.PythonSQLUtils.explainString(lib.media._jdf.queryExecution(), "formatted")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    sent = [part for part in plan.split("\n\n") if "Exchange" in part.split("\n")[0] and "Input" in part]
    assert len(sent) == 3 and not any("text#" in part for part in sent)


def test_appended_media_are_derived_once(spark, lib, rows, monkeypatch):
    derived = spark.sparkContext.accumulator(0)

    def counted(i):
        derived.add(1)
        return i

    once = F.udf(counted, "long").asNondeterministic()
    lib._cache["documents"] = lib.documents.withColumn("doc_id", once("doc_id"))
    monkeypatch.setattr(registry, "Library", lambda *_: lib)
    got = rows(QUERIES["a3_append_media"](spark, "/none"))
    assert got == sorted([("media", str(i)) for i in range(N - 2)] + [("vectors", str(i)) for i in range(0, N - 2, 4)])
    assert derived.value == N
