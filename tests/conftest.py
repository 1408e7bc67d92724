import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]


@pytest.fixture(scope="session")
def spark():
    from oracle import session

    return session()


@pytest.fixture
def staged(monkeypatch):
    """No table counts as small: sketches, salted joins and range sums do the work."""
    from ampledger.operators import grouped

    monkeypatch.setattr(grouped, "EXACT_ROWS", -1)
    monkeypatch.setattr(grouped, "BROADCAST_ROWS", -1)
    monkeypatch.setattr(grouped, "HOT_ROWS", 100)
    return grouped
