"""Workers outlive tasks: what a stage has freed must not count against the next."""

import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import types as T

from talkspan.llm import arrays as ar


def private_mb():
    try:
        with open("/proc/self/smaps_rollup") as f:
            return int(re.search(r"\nPss_Anon:\s+(\d+)", f.read()).group(1)) / 1024
    except (OSError, AttributeError):
        pytest.skip("memory can't be read here")


def held_then_freed() -> np.ndarray:
    """200 MB in pieces that malloc keeps in its heap, freed but for the last one."""
    return [np.ones(8_192) for _ in range(3_200)][-1]


def test_freed_memory_goes_back():
    if not hasattr(ar.ctypes.CDLL(None), "malloc_trim"):
        pytest.skip("not glibc")
    last = held_then_freed()
    before = private_mb()
    ar.given_back()
    assert private_mb() < before - 100 and last.all()


def test_a_task_gives_its_memory_back_when_it_ends(spark, monkeypatch):
    given = []
    monkeypatch.setattr(ar, "given_back", lambda: given.append(1))

    class Frame:
        schema, sparkSession = T.StructType([T.StructField("text", T.StringType())]), spark

        def mapInArrow(self, run, schema):
            return run

    run = ar.arrow_map(Frame(), lambda part: {"n": [1] * part.num_rows}, [T.StructField("n", T.LongType())])
    batch = pa.RecordBatch.from_arrays([pa.array(["a", None])], names=["text"])
    assert [b.num_rows for b in run(iter([batch, batch]))] == [2, 2] and given == [1]
