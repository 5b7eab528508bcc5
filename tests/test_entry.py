"""What the driver calls: listing needs no session, every SQL has its query, and the smoke query gives rows."""

import os
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(entry.__file__).parent


def test_listing_needs_no_session():
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries())"
    env = os.environ | {"PYTHONPATH": str(ROOT)}
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, env=env, check=True, timeout=120)


def test_smoke(spark):
    rows = entry.entry(spark).collect()
    assert rows and set(rows[0].asDict()) == {"id", "match", "original_match"}
