import subprocess
import sys

import __spark_entry__ as entry


def test_entry_and_names(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_rest_imports_without_the_training_text_part():
    code = """
import sys
for name in ("attestor.llm", "corpus_pipeline"):
    sys.modules[name] = None
import __spark_entry__ as e
assert not [n for n in e.queries() if n.startswith("op") or n == "pipeline"] and len(e.queries()) > 100
"""
    subprocess.run([sys.executable, "-c", code], check=True)
