"""Tables that are folders of part files give streams the same rows as tables of one file."""

import pytest
from plumbline.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    """Tables that queries stream, each as a folder of three part files."""
    at = str(tmp_path_factory.mktemp("folders"))
    for name in ("documents", "embeddings", "orders"):
        spark.read.parquet(f"{SF}/{name}.parquet").repartition(3).write.parquet(f"{at}/{name}.parquet")
    return at


def rows(query, spark, path):
    return sorted(map(str, QUERIES[query](spark, path).collect()))


def test_stream_admit_reads_all_part_files(spark, folders):
    found = rows("stream_admit", spark, folders)
    assert len(found) == spark.read.parquet(f"{folders}/documents.parquet").count()
    assert found == rows("stream_admit", spark, SF)


@pytest.mark.parametrize("query", ["repeat_uploads", "stream_score"])
def test_streams_of_folders_equal_those_of_one_file(spark, folders, query):
    found = rows(query, spark, folders)
    assert found
    assert found == rows(query, spark, SF)
