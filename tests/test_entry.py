"""Without the corpus operators the rest still imports and registers its queries."""

import os
import shutil
import subprocess
import sys

TOP = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_without_the_corpus_folders(tmp_path):
    shutil.copytree(os.path.join(TOP, "quirelake"), tmp_path / "quirelake", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(TOP, "__spark_entry__.py"), tmp_path)
    shown = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); print(len(q), len(s), any(n.startswith('op') and n[2].isdigit() for n in q), 'pipeline' in q)"
    pipeline = os.path.join(TOP, "corpus_pipeline.py")
    for _ in range(2):
        out = subprocess.run([sys.executable, "-c", shown], cwd=tmp_path, capture_output=True, text=True, check=True).stdout.split()
        assert int(out[-4]) > 100 and int(out[-3]) > 80 and out[-2:] == ["False", "False"]
        if os.path.exists(pipeline):  # left behind alone, it can't be imported and is no query
            shutil.copy(pipeline, tmp_path)
