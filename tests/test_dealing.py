"""Work that costs more than reading its rows is dealt by rows: a table may be one file of one row group."""

import pytest

from tessera import registry

#: 20,000 parts and 1,000 suppliers, each in one row group.
WIDER = "/root/testdata/sf0.1"


@pytest.mark.parametrize("name", ["code_calls_by_language", "code_places", "code_defs_by_language", "code_chunks", "callbacks_left_out"])
def test_files_of_one_row_group_are_many_tasks(spark, name):
    assert registry.QUERIES[name](spark, WIDER).rdd.getNumPartitions() == 5


def test_few_rows_are_one_task(spark, sf):
    from tessera.plans.dealing import dealt

    assert dealt(spark.range(0), "id").rdd.getNumPartitions() == 1 == dealt(spark.range(200), "id").rdd.getNumPartitions()
    many = dealt(spark.range(0, 9000, 1, 1), "id")
    assert many.rdd.getNumPartitions() == 3 and many.count() == 9000 == many.distinct().count()
