import ctypes
import re
import subprocess
import sys
from pathlib import Path

import pyarrow as pa
import pytest

from tidewatch.llm.common import WordHashes, texts

ROOT = Path(__file__).parents[2]
#: An earlier task took small blocks through the C library and freed all but the last, which holds the heap's end.
EARLIER = """
import ctypes, re
from tidewatch.llm.common import texts

def own():
    return sum(map(int, re.findall(r"Anonymous: +(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024

libc = ctypes.CDLL(None)
libc.malloc.restype, libc.free.argtypes = ctypes.c_void_p, [ctypes.c_void_p]
taken = [libc.malloc(4000) for _ in range(25_000)]
for block in taken:
    ctypes.memset(block, 1, 4000)
for block in taken[:-1]:
    libc.free(block)
before = own()
list(texts(iter(()), "text"))
print(before - own())
"""


def test_a_task_hands_back_what_earlier_ones_freed():
    """Spark's workers outlive their tasks: those of one stage would go on holding what the stages before it took."""
    if not hasattr(ctypes.CDLL(None), "malloc_trim"):
        pytest.skip("not glibc")
    out = subprocess.run([sys.executable, "-c", EARLIER], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert re.fullmatch(r"[\d.]+\n", out.stdout), out.stderr
    assert float(out.stdout) > 80


def test_tables_are_emptied_after_the_last_text():
    batch = pa.record_batch([pa.array(["a b", None, ""])], ["text"])
    hashes = WordHashes()
    for _, documents in texts(iter([batch, batch]), "text", hashes):
        hashes.of([w for text in documents for w in text.split()])
        assert len(hashes) == 2
    assert not hashes
