"""Every relational query against its SQL, and the driver's three functions."""

import pytest

from tessera import catalogue
from tests.oracle import connect, differences

SF = "/root/testdata/sf0.01"
QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_agrees_with_sql(spark, con, name):
    assert not differences(QUERIES[name](spark, SF), con, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_has_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 6
    assert set(e.oracle_sql()) <= set(e.queries())


def test_only_a_missing_subpackage_is_passed_over(monkeypatch):
    import builtins
    import importlib

    import __spark_entry__ as e

    real = importlib.import_module

    def without(name):
        def load(wanted, *a):
            if wanted == "tessera.llm.queries":
                raise ModuleNotFoundError(f"No module named {name!r}", name=name)
            return real(wanted, *a)

        monkeypatch.setattr(importlib, "import_module", load)
        return load

    source = open(e.__file__).read()
    without("tessera.llm")
    there = {"__file__": e.__file__, "__name__": "entry", "__builtins__": builtins}
    exec(compile(source, e.__file__, "exec"), there)
    assert there["llm"] is None and set(there["queries"]()) == set(QUERIES)
    without("regex")
    with pytest.raises(ModuleNotFoundError):
        exec(compile(source, e.__file__, "exec"), dict(there))


def test_nothing_outside_imports_the_text_operators():
    import pathlib
    import re

    import tessera

    root = pathlib.Path(tessera.__file__).parent
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert not re.search(r"tessera\.llm|corpus_pipeline", path.read_text()), path


def test_sketches_are_near_the_truth(spark):
    exact = {r["l_returnflag"]: r["parts"] for r in QUERIES["count_distinct"](spark, SF).collect()}
    for r in QUERIES["sketches"](spark, SF).collect():
        assert abs(r["hll"] - exact[r["l_returnflag"]]) < 0.1 * exact[r["l_returnflag"]]
        assert abs(r["theta"] - exact[r["l_returnflag"]]) < 0.1 * exact[r["l_returnflag"]]
    for r in QUERIES["approximate_distinct"](spark, SF).collect():
        assert abs(r["parts"] - exact[r["l_returnflag"]]) < 0.1 * exact[r["l_returnflag"]]


def test_sample_is_stable_and_of_the_right_size(spark):
    a, b = (QUERIES["sample_rows"](spark, SF) for _ in range(2))
    assert a.exceptAll(b).count() == 0 and 5000 < a.count() < 7000
