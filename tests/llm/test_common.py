import os

import pytest

from millrace.llm import common


def test_intermediate_files_can_be_deleted(spark):
    common.clean_up(spark)
    df = common.stored(spark.range(5), "five")
    path = common._NAMED[-1].removeprefix("file:").replace("//", "/")
    assert df.count() == 5 and os.path.isdir(path)
    assert common.clean_up(spark) == 1 and not os.path.exists(path) and common.clean_up(spark) == 0


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

    with pytest.raises(ValueError):
        common.shared_dir(Session())
