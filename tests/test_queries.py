"""Every registered query against its SQL on the smallest tables."""

import compare
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return compare.connect(FOLDER)


CORE = __import__("basewise.plans.registry", fromlist=["QUERIES"])


@pytest.mark.parametrize("name", sorted(CORE.SQL))
def test_query(spark, con, name):
    ok, message = compare.same(entry.queries()[name](spark, FOLDER), CORE.SQL[name], con)
    assert ok, message


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    """Intermediate tables never go to a folder of one machine unless all runs on that machine."""
    from basewise import session

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):  # noqa: N802
            return None

    class Session:
        def __init__(self, **settings):
            self.sparkContext, self.conf = Context(), settings

    monkeypatch.setattr(session, "_temporary_folder", lambda: pytest.fail("a folder of this machine"))
    with pytest.raises(RuntimeError):
        session.shared_folder(Session())
    named = []
    monkeypatch.setattr(Context, "setCheckpointDir", lambda _, folder: named.append(folder), raising=False)
    session.shared_folder(Session(**{"spark.checkpoint.dir": "hdfs://shared/work"}))
    assert named == ["hdfs://shared/work"]


def test_entry_without_a_library_of_the_subpackage(monkeypatch):
    import importlib
    import sys

    for name in [m for m in sys.modules if m.startswith("basewise.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "basewise.llm.queries", None)
    assert set(importlib.reload(entry).queries()) == set(CORE.QUERIES)
    monkeypatch.undo()
    importlib.reload(entry)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
