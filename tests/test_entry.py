"""The entry module, with and without the training-data subpackage."""

import os
import re
import shutil
import subprocess
import sys

import __spark_entry__ as engine

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry(spark):
    rows = engine.entry(spark)
    assert rows.columns == ["vec_id", "similarity", "lang", "source"] and 0 < rows.count() <= 5


def test_each_sql_belongs_to_a_query():
    assert set(engine.oracle_sql()) <= set(engine.queries())


def test_without_training_data(tmp_path):
    shutil.copytree(f"{HERE}/millrace", tmp_path / "millrace", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{HERE}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; names = list(e.queries()); assert 'vector_topk' in names and not any(n.startswith('op') or n == 'pipeline' for n in names); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})


def test_nothing_imports_the_training_data_folder():
    for folder, _, names in os.walk(f"{HERE}/millrace"):
        if not folder.endswith("llm"):
            assert not any(re.search(r"import.*\bllm\b|\bllm\b.*import", open(os.path.join(folder, n)).read()) for n in names if n.endswith(".py"))
