"""The driver contract with the subpackage present."""

import os
import subprocess
import sys

import __spark_entry__ as ent


def test_entry_misses_no_library_in_silence():
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    code = "import sys; sys.modules['xxhash'] = None; import __spark_entry__"
    done = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True)
    assert done.returncode != 0 and "xxhash" in done.stderr


def test_every_operator_query_is_registered():
    numbers = sorted(int(n[2:].split("_")[0]) for n in ent.queries() if n.startswith("op"))
    assert numbers == list(range(1, 14)) and "pipeline" in ent.queries()
