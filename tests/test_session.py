"""A session on a plain installation, whose defaults name no shared folder."""

import os
import subprocess
import sys

from lightsieve.session import PACKAGE_ROOT

PLAIN = """
from lightsieve.session import build_session, clean, discard, materialize, shared_dir
spark = build_session("plain", master="local[2]", shuffle_partitions=2)
assert spark.conf.get("spark.checkpoint.dir", None) is None
written = materialize(spark.range(3), "three")
assert written.count() == 3 and shared_dir(spark) == shared_dir(spark)
discard(written)
clean(spark)
spark.stop()
"""


def test_starts_without_defaults(tmp_path):
    env = {k: v for k, v in os.environ.items() if not k.startswith(("SPARK_", "PYSPARK_"))} | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": PACKAGE_ROOT}
    ran = subprocess.run([sys.executable, "-c", PLAIN], env=env, capture_output=True, text=True, timeout=300)
    assert ran.returncode == 0, ran.stderr[-2000:]
