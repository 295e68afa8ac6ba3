"""What the pipeline's stages leave in a Python worker for the next stage, and what blocks of text need at most."""

import random
import subprocess
import sys
import tracemalloc

import pytest

from tidemark.llm import quality

HELD = '''
import random, re
import pyarrow as pa
from tidemark.llm import bpe, decontamination, neardup, toxicity

def held():
    return sum(map(int, re.findall(r"\\nPss_(?:Anon|Shmem):\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024

def batch(n, r=random.Random(5)):
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 9)))
    texts = [" ".join(word() for _ in range(300)) for _ in range(n)]
    return pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array(range(n)), pa.array(texts)], names=["doc_id", "key", "text"])

class Docs:  # hands out the function that a worker would run
    schema = columns = sparkSession = sparkContext = property(lambda self: self)
    def __getattr__(self, name): return lambda *a, **k: self
    def mapInArrow(self, run, schema): self.run = run; return self

class Shared:
    def __init__(self, value): self.value = value

F = neardup.F = bpe.F = decontamination.F = toxicity.F = Docs()
docs = Docs()
WHAT
def go(n):
    for _ in run(iter([batch(n)])):
        pass
go(3)
before = held()
go(2000)
print(held() - before)
'''


@pytest.mark.skipif(sys.platform != "linux", reason="reads /proc")
@pytest.mark.parametrize("what", [
    "run = neardup._sketches",
    "bpe.text_of = docs.text_of; bpe.encode_documents(docs, bpe.default_vocabulary()); run = docs.run",
    "docs.broadcast = lambda items: Shared(items); decontamination._blocks = lambda b: [[(1, 'one two three four five six seven eight nine')]]; decontamination.clean(docs, docs); run = docs.run",
    "toxicity._stem_counts(docs); run = lambda bs: docs.run(pa.RecordBatch.from_arrays([b.column(0).take(pa.array([0] * len(b))), b.column(0).take(pa.array([0] * len(b))), b.column(2)], names=['fold', 'toxic', 'text']) for b in bs)",
])
def test_a_worker_keeps_little_of_a_task(what):
    got = subprocess.run([sys.executable, "-c", HELD.replace("WHAT", what)], capture_output=True, text=True, timeout=120)
    assert got.returncode == 0, got.stderr
    assert float(got.stdout) < 20, got.stdout  # MB


def test_grams_need_few_bytes_a_character():
    r = random.Random(3)
    texts = ["".join(r.choice("abcdefghij klmnop") for _ in range(2000)) for _ in range(2000)]
    tracemalloc.start()
    try:
        quality.Grams(texts)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert most < 20 * 4_000_000
