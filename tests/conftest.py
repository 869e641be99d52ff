import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ.setdefault("PYSPARK_PYTHON", sys.executable)
os.environ["PYTHONPATH"] = os.path.dirname(os.path.dirname(os.path.abspath(__file__))) + os.pathsep + os.environ.get("PYTHONPATH", "")

#: The smallest tables of the test data; tests that need them are skipped where they are not.
DATA = os.environ.get("QUIREFOLD_TESTDATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from quirefold.session import session

    return session(4, "tests")


@pytest.fixture(scope="session")
def data():
    if not os.path.isdir(DATA):
        pytest.skip("no test data")
    return DATA


ELEMENT = (
    "doc_id bigint, page int, idx int, kind string, bbox struct<x0:double,y0:double,x1:double,y1:double>, text string, font string, size double, "
    "style struct<italic:boolean,bold:boolean,serifed:boolean>, sentences array<string>, image binary, image_ext string, skip boolean, ingested_at timestamp"
)


@pytest.fixture(scope="session")
def make_elements(spark):
    """Elements from dicts; what a dict leaves out is null, the kind is text."""
    names = [c.split(" ")[0] for c in "doc_id page idx kind bbox text font size style sentences image image_ext skip ingested_at".split()]

    def make(*rows):
        full = [tuple({"page": 1, "idx": i, "kind": "text", **r}.get(n) for n in names) for i, r in enumerate(rows)]
        return spark.createDataFrame(full, ELEMENT)

    return make
