import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_works_without_the_llm_folders(tmp_path):
    ignore = shutil.ignore_patterns("llm", "__pycache__")
    shutil.copytree(f"{ROOT}/quire", tmp_path / "quire", ignore=ignore)
    code = "import __spark_entry__ as e; q = e.queries(); s = e.oracle_sql(); print(len(q), len(s), 'pipeline' in q)"
    found = []
    for files in (["__spark_entry__.py"], ["corpus_pipeline.py"]):  # without the pipeline, and with it left behind
        for f in files:
            shutil.copy(f"{ROOT}/{f}", tmp_path)
        found.append(subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={"PATH": os.environ["PATH"]}))
    assert all(r.returncode == 0 for r in found), found[-1].stderr
    assert len({r.stdout for r in found}) == 1 and found[0].stdout.split()[2] == "False" and int(found[0].stdout.split()[0]) > 100
