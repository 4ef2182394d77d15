import ast
import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_runs(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.count() > 0 and set(e.oracle_sql()) <= set(e.queries())


def test_core_does_not_import_the_subpackage():
    for folder, _, files in os.walk(os.path.join(ROOT, "corvane")):
        if os.path.basename(folder) == "llm" or f"{os.sep}llm" in folder:
            continue
        for f in files:
            if f.endswith(".py"):
                for node in ast.walk(ast.parse(open(os.path.join(folder, f)).read())):
                    names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
                    assert not any("llm" in n.split(".") for n in names), f


def test_entry_without_the_subpackage():
    code = "import importlib.util as u; f = u.find_spec\nu.find_spec = lambda n, *a: None if n == 'corvane.llm' else f(n, *a)\nimport __spark_entry__ as e; assert 'p3_found' in e.queries() and 'p1_found' not in e.queries() and 'p3_found' in e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, env=os.environ | {"PYTHONPATH": ROOT})
