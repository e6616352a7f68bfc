"""Where lineage is cut."""

from types import SimpleNamespace

import pytest

from postloom.checkpoints import cut, shared_folder


def _session(master: str, folder: str | None):
    get = lambda key, default=None: folder if key == "spark.checkpoint.dir" and folder else default
    return SimpleNamespace(sparkContext=SimpleNamespace(master=master, getConf=lambda: SimpleNamespace(get=get)), conf=SimpleNamespace(get=get))


def test_folder_of_the_session_comes_first():
    assert shared_folder(_session("spark://a:7077", "hdfs://x/y")) == "hdfs://x/y"
    assert shared_folder(_session("local[4]", None)).startswith("file:///")


@pytest.mark.parametrize("master", ["spark://a:7077", "yarn", "local-cluster[2,1,1024]"])
def test_a_cluster_without_a_shared_folder_is_an_error(master):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(_session(master, None))


def test_cut_keeps_rows(spark):
    assert sorted(x["id"] for x in cut(spark.range(5)).collect()) == list(range(5))
