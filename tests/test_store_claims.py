"""Of two savers of one name one wins; a name is free after a failed write and after a deletion."""

import threading

import pytest
from pyspark.sql import functions as F

from tessera.sources import store


def test_two_savers_of_one_name_give_one_winner(spark, tmp_path):
    path, outcomes, start = str(tmp_path / "store"), [], threading.Barrier(4)

    def run(k):
        start.wait()
        try:
            store.save(spark.range(20).select(F.col("id"), F.lit(k).alias("saver")), path, "a name/with signs=%")
            outcomes.append(k)
        except FileExistsError:
            pass

    threads = [threading.Thread(target=run, args=(k,)) for k in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    rows = store.load(spark, path, "a name/with signs=%").collect()
    assert len(outcomes) == 1 and [r.saver for r in rows] == outcomes * 20


def test_a_failed_write_frees_the_name(spark, tmp_path):
    path = str(tmp_path / "store")
    broken = spark.range(3).select(F.raise_error(F.lit("no")).cast("long").alias("id"))
    with pytest.raises(Exception, match="no"):
        store.save(broken, path, "r")
    store.save(spark.range(3), path, "r")
    with pytest.raises(FileExistsError):
        store.save(spark.range(3), path, "r")
    assert store.load(spark, path, "r").count() == 3
    store.delete(spark, path, "r")
    store.save(spark.range(2), path, "r")
    assert store.load(spark, path, "r").count() == 2
    store.delete(spark, path, "never stored")


def test_a_resource_stored_without_a_claim_is_refused(spark, tmp_path):
    path = str(tmp_path / "store")
    spark.range(3).withColumn("resource", F.lit("old")).write.partitionBy("resource").parquet(path)
    with pytest.raises(FileExistsError):
        store.save(spark.range(1), path, "old")
    store.delete(spark, path, "old")
    store.save(spark.range(1), path, "old")
    assert store.load(spark, path, "old").count() == 1
