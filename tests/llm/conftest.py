import pytest

from graphloom.llm import parts


@pytest.fixture(autouse=True)
def several_parts(monkeypatch):
    """Small tables in as many parts as shuffle partitions, so that parts exchange messages in tests."""
    monkeypatch.setattr(parts, "LEAST_BYTES", 1)
