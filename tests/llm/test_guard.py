"""What the registry may pass over when it is imported, and what must show."""

import os
import subprocess
import sys

import pytest

import corpus_pipeline
from steadfetch.llm import queries


@pytest.mark.parametrize("name, starts, n", [("xxhash", False, 0), ("corpus_pipeline", True, len(queries.QUERIES)), ("steadfetch.llm", True, 0)])
def test_only_the_training_subpackage_may_be_missing(name, starts, n):
    code = f"import sys; sys.modules[{name!r}] = None; import __spark_entry__ as e; print(sum(q.startswith('op') or q == 'pipeline' for q in e.queries()))"
    folder = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))
    done = subprocess.run([sys.executable, "-c", code], cwd=folder, capture_output=True, text=True)
    assert (done.returncode == 0) == starts
    assert not starts or int(done.stdout) == n
