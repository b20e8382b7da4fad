"""The entry point: names, column agreement, and independence of the llm subpackage."""

import subprocess
import sys

import __spark_entry__ as entry


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 100


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "momentum" in df.columns


def test_works_without_llm(tmp_path):
    code = (
        "import sys\n"
        "class Gone:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name == 'corpus_pipeline' or name.startswith('quarrylane.llm'):\n"
        "            raise ModuleNotFoundError(name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import importlib.util\n"
        "real = importlib.util.find_spec\n"
        "importlib.util.find_spec = lambda n, p=None: None if n == 'corpus_pipeline' or n.startswith('quarrylane.llm') else real(n, p)\n"
        "import __spark_entry__ as e\n"
        "assert e.queries() and not any(k.startswith('op') and k[2:3].isdigit() for k in e.queries()) and 'pipeline' not in e.queries()\n"
    )
    subprocess.run([sys.executable, "-c", code], check=True)
