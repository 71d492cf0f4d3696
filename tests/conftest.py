import os
import sys

import pytest

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, os.path.dirname(HERE))
# Python workers unpickle test helpers by module name.
os.environ["PYTHONPATH"] = os.pathsep.join([os.path.dirname(HERE), HERE, os.environ.get("PYTHONPATH", "")])

from spanlake.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "spanlake-tests")
    yield session
    session.stop()


ENT = "array<struct<start:int,end:int,label:string,text:string,score:double,score_original:double,score_calibrated:double,score_context_boosted:double>>"


def ent(label=None, text=None, start=None, end=None, score=None, original=None, calibrated=None, boosted=None):
    return (start, end, label, text, score, original, calibrated, boosted)


@pytest.fixture
def make_ent():
    return ent
