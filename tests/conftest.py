import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

from debatelens.session import local_session  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return local_session("debatelens-tests", cores=4, memory="4g")


@pytest.fixture(scope="session")
def msgs(spark):
    from debatelens.plans.catalog import load

    return load(spark, DATA)
