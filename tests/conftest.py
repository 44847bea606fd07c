import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

from sitegrain.session import local_session, shared_dir  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = local_session("4", "tests")
    s.sparkContext.setLogLevel("ERROR")
    shared_dir(s)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def page(spark):
    """Extract rows for hand-written pages: page(html, ..., url=, parts=)."""
    from sitegrain.operators.extract import extract

    def make(*htmls, url="https://acme.test/", parts=None):
        rows = [(i, url, h) for i, h in enumerate(htmls)]
        df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
        return extract(df, parts).orderBy("page_id").collect()

    return make
