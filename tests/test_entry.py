"""The contract of the entry module, with and without the optional subpackage."""

import subprocess
import sys

import __spark_entry__ as entry


def test_every_oracle_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 90


def test_core_does_not_import_the_optional_subpackage():
    code = "import sys; sys.modules['oddsmith.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert not any(k.startswith('op') for k in e.queries()); assert 'walk_forward' in e.queries()"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=entry.os.path.dirname(entry.os.path.abspath(entry.__file__)))


def test_flagship_runs(spark):
    assert entry.entry(spark).count() > 0
