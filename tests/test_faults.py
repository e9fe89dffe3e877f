"""Distances survive the loss of an executor."""

import json
import subprocess
import sys
from pathlib import Path

import pytest
from graphs import dijkstra, random_graph


@pytest.mark.parametrize("strategy,options", [("frontier", {}), ("owner", {"owners": 3})])
def test_an_executor_is_killed(strategy, options):
    said = subprocess.run([sys.executable, str(Path(__file__).parent / "fault_run.py"), strategy, json.dumps(options)], capture_output=True, text=True, timeout=400)
    assert "RESULT" in said.stdout, said.stderr[-2000:]
    found = json.loads(said.stdout.rpartition("RESULT")[2])
    assert found["killed"] == 1
    assert {v: (d, h) for v, d, h in found["rows"]} == dijkstra(random_graph(1), [(0, 0)])
