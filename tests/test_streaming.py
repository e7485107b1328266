from quirewright.operators.value_profile import ValueCounts, value_deltas
from quirewright.streaming.feeds import deliveries, maintain_counts


def test_counts_follow_the_deliveries(spark, tmp_path):
    rows = spark.createDataFrame([(i % 3, f"v{i % 7}") for i in range(200)], "load_id INT, language STRING")
    folder = f"{tmp_path}/in"
    rows.repartition(4).write.parquet(folder)
    store, whole = ValueCounts(spark, f"{tmp_path}/streamed", merge_at=3), ValueCounts(spark, f"{tmp_path}/whole")
    whole.apply(value_deltas(rows, ["language"], "load_id"))
    for _ in range(2):  # the second run finds nothing new
        maintain_counts(deliveries(spark, folder, 1), ["language"], "load_id", store, f"{tmp_path}/checkpoint").awaitTermination()
        assert sorted(map(tuple, store.counts().collect())) == sorted(map(tuple, whole.counts().collect()))
    rows.write.mode("append").parquet(folder)
    maintain_counts(deliveries(spark, folder, 2), ["language"], "load_id", store, f"{tmp_path}/checkpoint").awaitTermination()
    assert sum(r.n for r in store.counts().collect()) == 400
