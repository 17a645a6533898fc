import pytest

from spindlewatch.shared import scratch_path, shared_dir, written


class Session:
    """Only what the functions read."""

    def __init__(self, **conf):
        settings = {key.replace("_", "."): value for key, value in conf.items()}
        self.conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: settings.get(key, default))})


def test_the_cluster_names_the_folder():
    session = Session(spark_checkpoint_dir="hdfs:///shared/", spark_master="yarn")
    assert shared_dir(session) == "hdfs:///shared"
    first, second = scratch_path(session, "x"), scratch_path(session, "x")
    assert first != second
    assert first.startswith("hdfs:///shared/x-")


@pytest.mark.parametrize("master", [{"spark_master": "spark://host:7077"}, {"spark_master": "local-cluster[3,2,1024]"}, {}])
@pytest.mark.parametrize("warehouse", [{"spark_sql_warehouse_dir": "file:/work/spark-warehouse"}, {}])
def test_a_cluster_without_the_setting_is_an_error(master, warehouse):
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(Session(**master, **warehouse))


def test_the_warehouse_serves_where_all_tasks_reach_it():
    local = Session(spark_master="local[8]", spark_sql_warehouse_dir="file:/work/spark-warehouse")
    assert shared_dir(local) == "file:/work/spark-warehouse/_scratch"
    far = Session(spark_master="yarn", spark_sql_warehouse_dir="hdfs:///warehouse/")
    assert shared_dir(far) == "hdfs:///warehouse/_scratch"


def test_a_written_table_keeps_its_rows_and_schema(spark):
    df = spark.createDataFrame([(1, "a"), (None, "b")], "n long, s string")
    table = written(spark, df, "t")
    assert table.schema == df.schema
    assert sorted(table.collect(), key=str) == sorted(df.collect(), key=str)
