"""The driver contract, without running every query."""

import subprocess
import sys

import __spark_entry__ as entry


def test_import_needs_no_session():
    code = "import __spark_entry__ as e; assert e.queries() and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=entry.__file__.rsplit("/", 1)[0])


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_general_problems_are_there():
    assert {"p1_found", "p2_found", "p7_found"} <= set(entry.queries())


def test_core_does_not_import_the_subpackage_for_training_data():
    code = "import sys; import ledgerloom.plans.catalog as c; c.queries(); assert not [m for m in sys.modules if m.startswith('ledgerloom.llm')]"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=entry.__file__.rsplit("/", 1)[0])
