"""The driver's contract, with and without the training-data subpackage."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__

ROOT = Path(__file__).resolve().parents[1]


def test_queries_and_oracles_agree():
    queries, oracle = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(oracle) <= set(queries) and "impact_flagship" in queries


def test_entry_without_the_subpackage(tmp_path):
    (tmp_path / "siftwright").symlink_to(ROOT / "siftwright")
    code = (
        "import sys; sys.modules['siftwright.llm'] = None\n"
        f"sys.path.insert(0, {str(ROOT)!r})\n"
        "import __spark_entry__ as e\n"
        "names = set(e.queries())\n"
        "assert 'evidence_merge' in names and 'pipeline' not in names and not any(n.startswith('op1_') for n in names)\n"
    )
    subprocess.run([sys.executable, "-c", code], check=True)
