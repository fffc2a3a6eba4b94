"""What the Python workers of a query hold at once, in a session of its own; every character through the functions made in Python."""

import json
import subprocess
import sys
import unicodedata
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quillmill.functions import text as T

#: Queries whose Python workers get a partition of TEXTS texts of 60 KB.
NAMES, TEXTS, MOST_MB = ("token_rollup", "pack_blocks", "coverage_cursor", "cross_split_duplicates", "audit_summary"), 1500, 150

PEAKS = """
import json, sys
import psutil
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
import __spark_entry__

folder, n, names = sys.argv[1], int(sys.argv[2]), sys.argv[3:]
conf = {"spark.driver.memory": "2g", "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "2", "spark.checkpoint.dir": f"file://{folder}/shared"}
spark = SparkSession.builder.master("local[1]").config(map=conf).getOrCreate()
text = F.concat(F.lit("Élan für señor Übel, à côté. " * 1800), F.col("id") % 100)
rows = spark.range(0, n, 1, 1).select(F.col("id").alias("doc_id"), text.alias("text"), F.lit("fr").alias("lang"), F.concat(F.lit("s"), F.col("id") % 3).alias("source"), F.lit(1).cast("long").alias("n_chars"))
rows.write.parquet(f"{folder}/documents.parquet")
for name in names:
    __spark_entry__.queries()[name](spark, folder).write.format("noop").mode("overwrite").save()
    workers = [p.pid for p in psutil.Process().children(recursive=True) if "pyspark.daemon" in p.cmdline()]
    status = [open(f"/proc/{pid}/status").read() for pid in workers]
    print(json.dumps([name, max(int(s.split("VmHWM:")[1].split()[0]) for s in status) // 1024]), flush=True)
    for pid in workers:
        open(f"/proc/{pid}/clear_refs", "w").write("5")  # the peak begins anew
"""


@pytest.fixture(scope="module")
def peaks(tmp_path_factory):
    root = str(Path(__file__).resolve().parents[1])
    run = subprocess.run([sys.executable, "-c", f"import os, sys; sys.path.insert(0, {root!r}); os.environ['PYTHONPATH'] = {root!r}\n{PEAKS}", str(tmp_path_factory.mktemp("peaks")), str(TEXTS), *NAMES], capture_output=True, text=True, timeout=600)
    assert run.returncode == 0, run.stderr[-2000:]
    return dict(json.loads(x) for x in run.stdout.splitlines() if x.startswith("["))


@pytest.mark.parametrize("name", NAMES)
def test_workers_hold_few_texts(peaks, name):
    assert peaks[name] < MOST_MB


def test_every_character(spark):
    texts = ["a" + "".join(map(chr, range(k, k + 512))) for k in range(0, 0x110000, 512) if not 0xD800 <= k < 0xE000]
    rows = spark.createDataFrame([(t,) for t in [*texts, "Plain ASCII"]], "text string").select("text", T.nfkc(F.col("text")).alias("n"), T.casefolded(F.col("text")).alias("c")).collect()
    assert len(rows) == len(texts) + 1 and all(r.n == unicodedata.normalize("NFKC", r.text) and r.c == r.text.casefold() for r in rows)
