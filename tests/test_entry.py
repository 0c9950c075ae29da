"""The entry module works without the corpus operators."""

import re
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry_without_the_corpus_operators():
    code = "import sys; sys.modules['tessera.llm'] = None; sys.modules['corpus_pipeline'] = None\nimport __spark_entry__ as e\nassert e.queries() and not [k for k in e.queries() if k.startswith('op') or k == 'pipeline']\nassert set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


def test_entry_without_a_package_of_the_corpus_operators():
    code = "import sys; sys.modules['zstandard'] = None\nimport __spark_entry__ as e\nassert len(e.queries()) > 40 and 'op8_toxicity' not in e.queries()"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


def test_nothing_else_imports_the_corpus_operators():
    for path in ROOT.glob("tessera/**/*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert not re.search(r"\bllm\b", path.read_text()), path
