"""Every registered query against its SQL on the smallest tables."""

import importlib.util
import os

import pytest

from qaloom.plans import CHECKS, QUERIES

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def load(path):
    spec = importlib.util.spec_from_file_location("m_" + os.path.basename(path)[:-3].strip("_"), os.path.join(ROOT, path))
    m = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(m)
    return m


check = load("tools/check.py")


@pytest.fixture(scope="module")
def con(sf):
    return check.connect(sf)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, sf, name):
    line = check.compare(spark, con, name, sf)
    assert line.startswith("ok") and "[" not in line, line


def test_entry_contract(spark):
    e = load("__spark_entry__.py")
    assert set(e.oracle_sql()) <= set(e.queries()) and e.queries().keys() - e.LLM_QUERIES.keys() == QUERIES.keys()
    assert e.oracle_sql().keys() - e.LLM_CHECKS.keys() == CHECKS.keys()
    df = e.entry(spark)
    assert df.columns == ["query_id", "n", "block"] and df.count() > 0


def test_python_tasks_need_no_installed_package(tmp_path, sf):
    """Workers started elsewhere get the code with the task."""
    import subprocess
    import sys

    code = (
        f"import sys; sys.path.insert(0, {ROOT!r})\n"
        "from qaloom.plans import QUERIES\nfrom qaloom.session import build_session\n"
        "s = build_session('elsewhere', 'local[2]', 2)\n"
        f"print('rows', *[QUERIES[n](s, {sf!r}).count() for n in ('dom_map_parser', 'gray_resize', 'knn_topk')])\n"
        "QUERIES['dom_map_parser'](s, %r).agg({'dom_map': 'max'}).collect(); QUERIES['ssim'](s, %r).collect(); print('fine')\n" % (sf, sf)
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=200)
    assert "fine" in out.stdout, out.stderr[-2000:]
