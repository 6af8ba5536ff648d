import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def names(hidden):
    """The registered queries in a new interpreter that can't import `hidden`."""
    code = f"import sys; sys.path.insert(0, {str(ROOT)!r}); sys.modules[{hidden!r}] = None; import __spark_entry__ as e; print(*e.queries()); assert set(e.oracle_sql()) <= set(e.queries())"
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    return set(done.stdout.split())


def test_core_queries_stay_when_the_text_operators_or_what_they_need_cannot_be_imported():
    for hidden in ("ammolite.llm", "xxhash"):
        found = names(hidden)
        assert "alpha_diversity" in found and not any(n.startswith("op") and n[2].isdigit() for n in found) and "pipeline" not in found
    assert "pipeline" not in names("corpus_pipeline")
