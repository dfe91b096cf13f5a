"""Every registered query against its SQL on the smallest driver tables."""

from pathlib import Path

import pandas as pd
import pytest

import __spark_entry__ as driver
import workload
from workload.compare import compare

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="driver tables are not here")


@pytest.mark.parametrize("name", sorted(workload.QUERIES))
def test_query_matches_its_sql(spark, name):
    assert compare(spark, SF, name) is None


def test_slide_lines_keep_their_digits(spark, tmp_path):
    """The number of a line is no set of characters to trim: line 0 ends in 0, line 1 begins with 1."""
    texts = ["call 555-8630\n1 and 205.171", "0 first\nlast 1", "plain"]
    rows = [{"doc_id": i, "text": x, "lang": "en", "source": "src0", "n_chars": len(x)} for i, x in enumerate(texts * 5)]
    pd.DataFrame(rows).to_parquet(tmp_path / "documents.parquet")
    assert compare(spark, str(tmp_path), "slide_plan") is None


def test_entry(spark):
    assert driver.entry(spark).limit(1).count() == 1


def test_every_query_has_its_sql():
    assert set(workload.QUERIES) <= set(driver.oracle_sql())
