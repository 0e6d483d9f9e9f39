import pathlib
import re
import subprocess
import sys

ROOT = pathlib.Path(__file__).resolve().parent.parent


def test_queries_can_be_listed_without_spark():
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), set(e.oracle_sql()) <= set(e.queries()))"], cwd=ROOT, capture_output=True, text=True, check=True)
    n, known = out.stdout.split()
    assert int(n) > 140 and known == "True"


def test_core_queries_are_listed_without_the_packages_of_the_texts():
    block = "import sys; sys.modules.update({m: None for m in ('xxhash', 'zstandard', 'tiktoken', 'tokenizers', 'regex')})"
    out = subprocess.run([sys.executable, "-c", f"{block}; import __spark_entry__ as e; q = e.queries(); print(len(q), 'p1_found' in q, 'p6_ids' in q)"], cwd=ROOT, capture_output=True, text=True, check=True)
    n, core, texts = out.stdout.split()
    assert int(n) >= 165 and core == "True" and texts == "False"


def test_nothing_imports_the_text_subpackage():
    for p in (ROOT / "punctum").rglob("*.py"):
        if p.parent.name != "llm":
            assert not re.search(r"punctum\.llm|from \.+llm", p.read_text()), p


def test_entry_gives_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["sphere_id", "tx_id"]
