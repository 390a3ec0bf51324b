"""Files of the shared folder go with the work that reads them."""

import os

import pytest

from tabweave.sources.scratch import Workspace, shared_folder
from tabweave.workload import queries as registered


@pytest.mark.parametrize("name", ["csv_roundtrip", "csv_sweep_roundtrip", "generate_files", "profile_merged"])
def test_queries_leave_no_files(spark, name):
    folder = shared_folder(spark)
    before = set(os.listdir(folder))
    found = registered.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert set(os.listdir(folder)) == before
    assert found.count() > 0  # the result does not need them


def test_a_failure_leaves_no_files(spark):
    folder = shared_folder(spark)
    before = set(os.listdir(folder))
    with pytest.raises(KeyError):
        with Workspace(spark) as work:
            assert work.keep(spark.range(5)).count() == 5 and os.path.exists(work.folder)
            raise KeyError
    assert set(os.listdir(folder)) == before
