import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_flagship(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["lang", "source", "docs", "chars"] and df.count() > 0


def test_entry_works_without_the_training_data_part(tmp_path):
    """As after its folders and the pipeline file were deleted."""
    for p in ["__spark_entry__.py", *(str(p.relative_to(ROOT)) for p in (ROOT / "vellumspark").rglob("*.py"))]:
        if "llm" not in Path(p).parts:
            (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / p).write_text((ROOT / p).read_text())
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 50 and not any(k.startswith('op') or k == 'pipeline' for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
