from flagframe import session


class _Conf:
    def __init__(self, values):
        self.values = values

    def get(self, key, default=None):
        return self.values.get(key, default)


class _Context:
    def __init__(self, master, current=None):
        self.master, self.current = master, current

    def getCheckpointDir(self):
        return self.current

    def setCheckpointDir(self, path):
        self.current = path


class _Session:
    def __init__(self, master, values=(), current=None):
        self.conf, self.sparkContext = _Conf(dict(values)), _Context(master, current)


def test_the_folder_the_cluster_names_is_used():
    s = _Session("spark://host:7077", {"spark.checkpoint.dir": "hdfs:///shared"})
    assert session.ensure_checkpoint_dir(s) == "hdfs:///shared" == s.sparkContext.current


def test_a_folder_that_is_set_is_kept():
    s = _Session("spark://host:7077", {"spark.checkpoint.dir": "hdfs:///shared"}, "hdfs:///mine")
    assert session.ensure_checkpoint_dir(s) == "hdfs:///mine"


def test_without_setting_a_folder_of_the_warehouse_is_taken():
    s = _Session("yarn", {"spark.sql.warehouse.dir": "hdfs:///warehouse"})
    assert session.ensure_checkpoint_dir(s).startswith("hdfs:///warehouse/")


def test_staged_table_is_written_and_removed(spark):
    table = session.staged(spark.range(7).selectExpr("id", "id % 2 as odd"), "numbers")
    assert table.where("odd = 1").count() == 3 and table.inputFiles()
    session.discard(table)
    assert not spark._jvm.java.io.File(table.inputFiles()[0].removeprefix("file://")).exists()


def test_lineage_is_cut(spark):
    df = session.cut_lineage(spark.range(5).selectExpr("id * 2 as x"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ExistingRDD" in plan and "Range" not in plan
    assert session.scratch_path(spark, "t") != session.scratch_path(spark, "t")


def test_a_warehouse_on_a_local_disk_is_no_scratch_folder_for_a_cluster():
    for folder, master, shared in [
        ("file:/w", "local[4]", True), ("/w", "local", True), ("file:/w", "yarn", False), ("/w", "spark://h:7077", False),
        ("file:/w", "local-cluster[2,1,1024]", False), ("hdfs://n/w", "yarn", True), ("s3a://b/w", "k8s://h", True),
    ]:
        assert session.shared_by_all(folder, master) == shared
