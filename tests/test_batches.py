"""Column functions by runs of rows: the values of plain Python, and how much is held at once."""

import re
import tracemalloc

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.util import PythonEvalType

from tidemark.functions import batches
from tidemark.functions import text as fts
from tidemark.model import TSVECTOR
from tidemark.operators import chunk, scrub
from tidemark.runtime import ship


def peak(run):
    tracemalloc.start()
    before = pa.total_allocated_bytes()
    try:
        n = run()
        return n, tracemalloc.get_traced_memory()[1] + pa.total_allocated_bytes() - before
    finally:
        tracemalloc.stop()


def test_runs_are_bounded_by_rows_and_by_text():
    texts = pa.array(["a"] * 300 + [None, "b" * batches.BYTES, "c" * (batches.BYTES + 1), ""])
    got = [values for (values,) in batches.runs((texts,))]
    assert [len(x) for x in got] == [256, 45, 1, 1, 1] and [t for x in got for t in x] == texts.to_pylist()
    assert list(batches.runs((texts.slice(0, 0),))) == []


def test_search_vectors_hold_a_few_rows_at_a_time():
    texts = pa.array([" ".join(f"w{i % 7}x{j}" for j in range(200)) for i in range(2000)])
    whole = peak(lambda: len([fts.vector_of(t) for t in texts.to_pylist()]))
    parts = peak(lambda: sum(map(len, batches.pieces(fts.vector_of, to_arrow_type(TSVECTOR), iter([(texts,)])))))
    assert whole[0] == parts[0] == 2000 and parts[1] < whole[1] / 4


def test_vectors_of_a_large_batch_against_plain_python(spark):
    ship(spark)
    texts = [None if i % 97 == 0 else "" if i % 89 == 0 else f"The runner {i} runs, {'far ' * (i % 5)}away" for i in range(1000)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").coalesce(1)
    plan = df.select("i", fts.english_vector(F.col("t")).alias("v"))
    assert re.search(rf"ArrowEvalPython .*, {PythonEvalType.SQL_SCALAR_ARROW_ITER_UDF}\b", plan._jdf.queryExecution().toString())  # results leave run by run
    got = {r["i"]: [(x["lexeme"], list(x["positions"])) for x in r["v"]] for r in plan.collect()}
    assert got == {i: [(x["lexeme"], x["positions"]) for x in fts.vector_of(t)] if t is not None else [] for i, t in enumerate(texts)}


def test_chunks_and_findings_leave_run_by_run(spark):
    ship(spark)
    df = spark.createDataFrame([(i, f"line {i}\n\npassword = hunter{i:04d}x") for i in range(600)], "i int, t string").coalesce(1)
    none = F.lit(None).cast("string")
    both = df.select("i", chunk.chunk_udf(F.col("t"), none, none).alias("c"), scrub.scrub_udf(F.col("t"), F.lit("drive_folder")).alias("s"))
    assert len(re.findall(rf"ArrowEvalPython .*, {PythonEvalType.SQL_SCALAR_ARROW_ITER_UDF}\b", both._jdf.queryExecution().executedPlan().toString())) == 2
    for r in both.collect():
        text = f"line {r['i']}\n\npassword = hunter{r['i']:04d}x"
        assert (*r["c"].asDict(True).values(),) == chunk.chunk(text, None, None) and r["s"].asDict(True) == scrub.scrub(text, "drive_folder")
