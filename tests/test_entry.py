import subprocess
import sys
from pathlib import Path

import __spark_entry__

ROOT = Path(__spark_entry__.__file__).parent


def test_every_sql_has_its_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert len(__spark_entry__.queries()) > 100


def test_entry_works_without_the_training_data_operators(tmp_path):
    code = "import sys; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; print(*e.queries())"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True).stdout.split()
    assert "flagship_porosity_phantom" in out and "pipeline" not in out and not any(n.startswith("op1") for n in out)


def test_nothing_else_imports_the_training_data_operators():
    for path in (ROOT / "brickwise").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "brickwise.llm" not in path.read_text()
