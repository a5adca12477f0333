"""The driver contract works from a foreign working directory (executors
must not need the package installed)."""

import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = f"""
import importlib.util
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master('local[2]').config('spark.sql.shuffle.partitions', '4')
         .config('spark.ui.enabled', 'false').getOrCreate())
spec = importlib.util.spec_from_file_location('e', {os.path.join(REPO, '__spark_entry__.py')!r})
m = importlib.util.module_from_spec(spec)
spec.loader.exec_module(m)
assert m.entry(spark).count() > 0
q, o = m.queries(), m.oracle_sql()
assert set(o) <= set(q)
assert q['rate_limit'](spark, '/root/testdata/sf0.001').count() > 0
print('OK')
"""


def test_entry_from_foreign_cwd(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    r = subprocess.run([sys.executable, "-c", SCRIPT], cwd=tmp_path, env=env, capture_output=True, text=True,
                       timeout=600)
    assert "OK" in r.stdout, r.stderr[-3000:]
