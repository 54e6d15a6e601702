import os
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_entry_runs(spark):
    import __spark_entry__

    rows = __spark_entry__.entry(spark).collect()
    assert len(rows) == 10 and all(0 < r.rel_mse < 1e-2 and r.bits == 432 for r in rows)


def test_rest_stands_without_training_operators(tmp_path):
    shutil.copytree(ROOT / "vecforge", tmp_path / "vecforge", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert len(q) > 80 and not [k for k in q if k.startswith('op') or k == 'pipeline']"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})


def test_rest_stands_without_tokenizer_files():
    code = "import sys; sys.modules['public_tokenizers'] = None; import __spark_entry__ as e; assert len(e.queries()) > 80 and len(e.oracle_sql()) > 80 and 'pipeline' not in e.queries()"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, env=os.environ | {"PYTHONPATH": str(ROOT)})
