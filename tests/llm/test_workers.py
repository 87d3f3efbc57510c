"""Every query of the subpackage on workers that have no copy of the package."""

import os
import subprocess
import sys

import pytest

from qaloom.llm.queries import QUERIES

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.mark.parametrize("names", [[*QUERIES][i::2] for i in range(2)])
def test_workers_need_no_installed_package(tmp_path, sf, names):
    code = (
        f"import sys; sys.path.insert(0, {ROOT!r})\n"
        "from qaloom.llm.queries import QUERIES\nfrom qaloom.session import build_session\n"
        f"s = build_session('elsewhere', 'local[4]', 4)\nfor n in {names!r}: print(n, QUERIES[n](s, {sf!r}).count())\nprint('fine')\n"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert "fine" in out.stdout, out.stderr[-2000:]
