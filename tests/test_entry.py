import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
WITHOUT = """
import sys

class Gone:
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name.startswith("pixelseries.llm"):
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)

sys.meta_path.insert(0, Gone())
sys.path.insert(0, sys.argv[1])
import __spark_entry__ as entry

names = entry.queries()
assert "q_baseline_scores" in names and "pipeline" not in names and not any(n.startswith("op") for n in names), names
assert set(entry.oracle_sql()) <= set(names)
"""


def test_entry_works_without_the_corpus_operators():
    subprocess.run([sys.executable, "-c", WITHOUT, ROOT], check=True, timeout=120)


def test_nothing_else_imports_the_corpus_operators():
    for folder in ("pixelseries", "checks"):
        for path, _, files in os.walk(os.path.join(ROOT, folder)):
            if os.path.basename(path) == "llm":
                continue
            for name in files:
                if name.endswith(".py"):
                    with open(os.path.join(path, name), encoding="utf-8") as file:
                        assert "llm" not in file.read(), name
