"""The stored index has as many ranges as shuffles have partitions, and nothing else is left beside it."""

import os

from corpusloom.operators import searchindex as search


def test_blocks_stay_in_their_ranges(spark, tmp_path):
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * j) % 97}" for j in range(60))) for i in range(600)], "id long, text string")
    index = search.save_index(docs, str(tmp_path), "id", "text")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert len([f for f in os.listdir(tmp_path / "blocks") if f.endswith(".parquet")]) == parts
    assert sorted(os.listdir(tmp_path)) == ["blocks", "words"] and index.n_docs == 600
