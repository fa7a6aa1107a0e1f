import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(autouse=True, scope="session")
def quick():
    """Shuffle files of small tests may stay: no garbage collection between jobs."""
    from tracklane.llm import common

    before, common.release = common.release, lambda spark: None
    yield
    common.release = before
