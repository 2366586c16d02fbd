import subprocess
import sys
from pathlib import Path

import pytest

HELD = """
import re
from pathlib import Path
import numpy as np
from vitalscope.llm import common

def held():
    return sum(map(int, re.findall(r"\\nPss_Anon:\\s+(\\d+)", Path("/proc/self/smaps_rollup").read_text()))) // 1024

def run(batches):
    for n in batches:
        parts = [np.ones(n, np.int8) for _ in range(20_000)]
        last = parts[-1].copy()  # behind them: freed, they stay with the process
        yield last
        del parts

before = held()
kept = list(run(iter([4096])))
print(held() - before)
kept += list(common.released(run)(iter([4096])))
print(held() - before, *map(len, kept))
"""


@pytest.mark.skipif(not Path("/proc/self/smaps_rollup").exists(), reason="needs Linux")
def test_freed_memory_goes_back_to_the_system():
    out = subprocess.run([sys.executable, "-c", HELD], capture_output=True, text=True, check=True, cwd=Path(__file__).parents[2]).stdout
    plain, tidy, *sizes = map(int, out.split())
    assert plain > 40 and tidy < 20 and sizes == [4096, 4096]
