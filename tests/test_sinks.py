"""What a run tells on the error stream, and flat JSON of scores."""

import io
import json
import time

from storelens.operators import scoring
from storelens.sinks.progress import Progress
from storelens.sinks.text import json_rows


def test_progress_gives_dots_phases_and_memory():
    out = io.StringIO()
    with Progress(out, verbose=True, interval=0.02) as p, p.phase("work"):
        time.sleep(0.2)
    dots, phase, memory = out.getvalue().splitlines()
    assert set(dots) == {"."} and len(dots) >= 2
    assert phase.startswith("phase work: 0.") and memory.startswith("peak memory: ")


def test_quiet_run_says_nothing_and_a_closed_stream_is_no_error():
    out = io.StringIO()
    with Progress(out, quiet=True) as p, p.phase("work"):
        pass
    assert out.getvalue() == "" and p.phases[0][0] == "work"
    out.close()
    with Progress(out, verbose=True, interval=0.01):
        time.sleep(0.05)


def test_score_as_flat_json(spark):
    files = spark.createDataFrame([("a/x.js", 'import x from "./y"\nif (a) {}\n'), ("db/t.sql", "create table a (b int)"), ("vendor/z.js", "x")], "path string, text string")
    row = json.loads(json_rows(scoring.complexity(files)).first()[0])
    assert row["source_files"] == 2 and row["sql_tables"] == 1 and row["branch_lines"] == 1 and row["excluded_files"] == 1
    assert all(not isinstance(v, (dict, list)) for v in row.values())
