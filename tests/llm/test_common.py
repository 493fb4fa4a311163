import os
import subprocess
import sys


def test_operators_run_in_a_plain_local_session(tmp_path):
    """Where nobody names spark.checkpoint.dir, intermediate tables go to a folder of the session's own."""
    code = """
from pyspark.sql import SparkSession
from tallyloom.llm import exactdedup
s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').config('spark.sql.shuffle.partitions', '2').getOrCreate()
assert s.conf.get('spark.checkpoint.dir', None) is None
for _ in range(2):
    rows = exactdedup.exact_dedup(s.createDataFrame([(1, 'a b'), (2, 'ab')], 'doc_id bigint, text string')).collect()
    assert sorted((r.doc_id, r.keep_id) for r in rows) == [(1, 1), (2, 1)]
print('fine')
"""
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path)}
    done = subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, timeout=300)
    assert "fine" in done.stdout, done.stderr[-2000:]
