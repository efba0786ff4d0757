"""Empty inputs give empty results, not errors."""

from lightbox.operators import dedup as K
from lightbox.operators import export as M
from lightbox.operators import similarity as I
from lightbox.operators import tagging as J
from lightbox.streaming import windows as W

MODELS = "tag string, weights array<double>, bias double, platt_a double, platt_b double"


def test_vectors(spark):
    none = spark.createDataFrame([], "id long, embedding array<float>")
    one = spark.createDataFrame([(1, [1.0, 0.0])], none.schema)
    assert I.similar_pairs(none, 0.2).count() == 0
    assert I.similarity_components(one, 0.2).count() == 0
    assert I.knn_join(none, one, 3).count() == 0
    assert I.knn_join(one, none, 3).count() == 0
    assert I.knn_join(one, one, 3).count() == 0
    assert I.pair_guard(none, 0.2) == (0, 0)
    assert J.batch_predict(one, spark.createDataFrame([], MODELS)).count() == 0
    dated = spark.createDataFrame([], "id long, original_date string, embedding array<float>")
    assert I.group_similar(dated, 0.2).count() == 0


def test_lists(spark):
    items = spark.createDataFrame([], "plan string, pos long, id long, size_bytes long")
    assert M.pack_parts(items, 10).count() == 0
    assert W.gap_sessions(spark.createDataFrame([], "k string, ts timestamp"), ["k"], 500).count() == 0
    batch = spark.createDataFrame([], "id long, phash string, original_filename string, uploaded_at timestamp")
    assert K.dedup_ingest(batch, batch).count() == 0
