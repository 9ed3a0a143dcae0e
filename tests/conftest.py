import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from lociq.session import local_session  # noqa: E402

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    # A folder of its own: models and tables of a test run must not be found by other jobs.
    session = local_session(8, memory="8g", app="tests", shared=str(tmp_path_factory.mktemp("shared")))
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def folder():
    return DATA


@pytest.fixture
def large_mode(monkeypatch):
    """Make every side too large to broadcast, every key hot and every group too large for one task."""
    monkeypatch.setattr("lociq.operators.joins.BROADCAST_BYTES", -1)
    monkeypatch.setattr("lociq.operators.joins.HOT_KEY_ROWS", 5)
    monkeypatch.setattr("lociq.operators.ranking.GROUP_ROWS", 20)


@pytest.fixture
def short_training(monkeypatch):
    """Models of two shallow rounds, for tests that look at what is done with a model."""
    from lociq.plans.study import Study

    whole = Study.models
    monkeypatch.setattr(Study, "models", lambda self, names=None, **settings: whole(self, names, **{"rounds": 2, "depth": 2} | settings))
