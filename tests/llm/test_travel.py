"""Queries run from another folder, with a package that only the driver can import."""

import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parents[2]
CODE = """
import sys; sys.path.insert(0, {repo!r})
import __spark_entry__ as e
from answerframe.session import local_session
spark = local_session(4)
for name, query in e.queries().items():
    if name.startswith("op") and name[2].isdigit():
        print(name, query(spark, "/root/testdata/sf0.001").count(), flush=True)
"""


def test_executors_need_no_copy_of_the_package(tmp_path):
    done = subprocess.run([sys.executable, "-c", CODE.format(repo=str(REPO))], cwd=tmp_path, capture_output=True, text=True, timeout=600)
    rows = dict(x.split() for x in done.stdout.split("\n") if x.startswith("op"))
    assert len(rows) == 10 and all(int(n) > 0 for n in rows.values()), done.stderr[-2000:]
