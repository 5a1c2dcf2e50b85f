"""The entry module's contract, with and without the training-data subpackage."""

import importlib

import __spark_entry__


def test_every_sql_has_its_query():
    assert __spark_entry__.oracle_sql().keys() <= __spark_entry__.queries().keys()


def test_it_works_without_the_subpackage(monkeypatch):
    module = importlib.reload(__spark_entry__)
    monkeypatch.setattr(module, "find_spec", lambda name: None)
    assert module.queries() and not [q for q in module.queries() if q.startswith("op") and q[2].isdigit()]
    assert module.oracle_sql().keys() <= module.queries().keys()


def test_the_rest_of_the_library_does_not_import_it():
    import subprocess
    import sys

    code = "import sys, loomtext.workload, loomtext.sources, loomtext.plans; assert not [m for m in sys.modules if m.startswith('loomtext.llm')]"
    subprocess.run([sys.executable, "-c", code], check=True)
