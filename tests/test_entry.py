import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.count() > 0 and set(df.columns) == {"doc_id", "language", "score", "gate"}
    assert set(e.oracle_sql()) <= set(e.queries())


def test_imports_without_the_training_data_operators(tmp_path):
    code = f"""
import sys
sys.path.insert(0, {str(ROOT)!r})
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name == 'corpus_pipeline' or name.startswith('foliant.llm'):
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert e.queries() and not any(k.startswith('op') or k == 'pipeline' for k in e.queries())
import foliant.plans.registry, foliant.sources.readers, foliant.sources.writers, foliant.streaming.quality
assert not any(m.startswith('foliant.llm') for m in sys.modules)
"""
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path).returncode == 0
