import subprocess
import sys

import pytest

HIDE = """
import sys, warnings
warnings.simplefilter("ignore")
class Hidden:
    def find_spec(self, name, path=None, target=None):
        if name.partition(".")[0] == {name!r}:
            raise ModuleNotFoundError(f"No module named {{name!r}}", name=name)
sys.meta_path.insert(0, Hidden())
import __spark_entry__ as e
names = e.queries()
print(len(names), any(n.startswith("op") and n[2].isdigit() for n in names), set(e.oracle_sql()) <= set(names))
"""


@pytest.mark.parametrize("name", ["public_tokenizers", "xxhash", "corpus_pipeline"])
def test_other_queries_stay_without_a_library(name):
    out = subprocess.run([sys.executable, "-c", HIDE.format(name=name)], capture_output=True, text=True, timeout=120)
    count, has_ops, sql_known = out.stdout.split()[-3:]
    assert int(count) > 170 and has_ops == "False" and sql_known == "True", out.stderr
