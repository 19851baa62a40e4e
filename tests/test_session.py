"""Where lineage is cut to."""

import pyarrow as pa

from subsumo.session import checkpoint_folder, materialize, new_folder, small_table


def test_the_named_folder_is_used(spark):
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    assert named in checkpoint_folder(spark)
    df = materialize(spark.range(3))
    assert all(named in path for path in df.inputFiles())


def test_rows_are_added_to_a_given_folder(spark):
    folder = new_folder(spark, "test")
    assert materialize(spark.range(3), folder).count() == 3
    assert materialize(spark.range(2), folder).count() == 5
    assert materialize(spark.range(0)).count() == 0


def test_small_tables(spark):
    schema = pa.schema([("a", pa.int32()), ("b", pa.list_(pa.int32()))])
    assert [tuple(r) for r in small_table(spark, [(1, [2]), (3, [])], schema).collect()] == [(1, [2]), (3, [])]
    assert small_table(spark, [], schema).count() == 0
