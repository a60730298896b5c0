"""Operators in a session whose workers can't import the package by themselves."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SCRIPT = f"""
import sys
sys.path.insert(0, {ROOT!r})
from pyspark.sql import SparkSession
from recollect.llm import line_dedup, byte_bpe
import public_tokenizers
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
docs = spark.createDataFrame([(1, "one line"), (2, None)], "doc_id long, text string")
assert line_dedup.line_digests(docs).count() == 2
tokens = byte_bpe.encode_digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
assert sorted(r["n_tokens"] for r in tokens.collect())[0] == 0
print("both ran")
"""


def test_from_another_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "both ran" in done.stdout, done.stderr[-3000:]
