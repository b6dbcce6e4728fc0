"""The entry from a folder that is not the repository's: workers must get the package from the driver."""

import os
import subprocess
import sys

import pytest

from lectern import shipping

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

_SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.driver.host", "127.0.0.1").config("spark.driver.bindAddress", "127.0.0.1").config("spark.checkpoint.dir", "file://" + sys.argv[1]).config("spark.sql.shuffle.partitions", "2").getOrCreate()
{work}
print("rows", rows)
"""
_ENTRY = 'import __spark_entry__ as e; rows = e.queries()["parse_md"](spark, "/root/testdata/sf0.001").count()'
_LIBRARY = 'from lectern.operators.narration import sentence_groups; rows = sentence_groups(spark.createDataFrame([("a", 0, 0, "One. Two is two.")], "doc_id string, c int, p int, text string")).count()'


@pytest.mark.parametrize("work", [_ENTRY, _LIBRARY])
def test_package_is_shipped(tmp_path, work):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", _SCRIPT.format(root=ROOT, work=work), str(tmp_path)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows " in done.stdout and "rows 0" not in done.stdout, done.stderr[-2000:]


def test_other_machines_get_the_package(monkeypatch, spark):
    """What the driver's PYTHONPATH says holds for its own machine only."""
    monkeypatch.setenv("PYTHONPATH", ROOT)

    class Context:
        master = "spark://host:7077"

    class Session:
        sparkContext = Context()

    assert shipping._beside(spark) and not shipping._beside(Session())


def test_entry_without_llm(tmp_path):
    """Without what the subpackage needs, the other queries are still there."""
    code = f"import sys; sys.path.insert(0, {ROOT!r}); sys.modules['tokenizers'] = None; sys.modules['public_tokenizers'] = None\nimport __spark_entry__ as e\nq = e.queries(); print(len(q), any(k.startswith('op') and k[2].isdigit() for k in q), len(e.oracle_sql()) > 50)"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=60)
    n, llm, oracles = done.stdout.split()
    assert int(n) > 100 and llm == "False" and oracles == "True", done.stderr[-500:]
