"""What must not grow with the input: rows of a task, Python values of a batch, scans of the texts."""

import re
import tracemalloc

import pyarrow as pa

from ballast.functions import helpers
from ballast.operators import isolate
from ballast.plans import sources, workflows  # noqa: F401
from ballast.plans.fixtures import examples
from ballast.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"


def test_rows_are_dealt_to_the_sessions_partitions(spark):
    plan = QUERIES["partition_fingerprint"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert re.findall(r"RepartitionByExpression \[.*\], (\d+)", plan) == ["4"]


def test_few_messages_are_python_values_at_once():
    raw = pa.array([b"Content-Type: text/plain\n\n" + b"word " * 4000] * 3000 + [None], pa.binary())
    tracemalloc.start()
    made = helpers.mail_bodies(raw)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert made.slice(2999).to_pylist() == [helpers.mail_body(raw[0].as_py()), ""] and len(made) == 3001
    assert helpers.mail_bodies(raw.slice(0, 0)).to_pylist() == []
    assert peak < 0.5 * raw.nbytes


def test_keys_are_made_in_one_scan(spark):
    plan = isolate._keys_of(examples(spark, SF))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1
