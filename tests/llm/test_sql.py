"""The corpus queries against their SQL twins, on the smallest tables and on odd rows."""

from __future__ import annotations

import pytest
from compare import TABLES, differences
from test_contracts import EDGES, ITEM, ITEMS
from test_contracts import sentences as lines_of

from heronry.llm.queries import QUERIES
from heronry.llm.sql import ORACLE_SQL

FOLDER = "/root/testdata/sf0.001"
MORE = [(20, "\n".join(lines_of(" ।"))), (21, "\n".join([*lines_of("."), "Home | News | Contact", "AAAAAAAAAA BBBBBBBBBB CCC", "All Rights Reserved"])), (22, "\n\n".join(["\n".join(lines_of(",")) + ".", " ".join(f"j{k}" for k in range(30))])), (23, "\r\n".join(lines_of("!”  "))), (24, f"{ITEM} and {ITEM} {ITEM}")]
TALKS = [(1, 0, "user", "hi"), (2, 0, "user", "hi"), (2, 1, "assistant", "hello"), (3, 0, "user", "hi"), (3, 1, "assistant", "hello"), (4, 0, "user", None), (4, None, "system", "<|im_end|>"), (5, 0, None, ""), (6, 0, "user", "hi"), (6, 0, "user", "hi"), (7, 1, "user", "b"), (7, 1, "user", "a")]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("odd"))
    for name in TABLES:
        spark.read.parquet(f"{FOLDER}/{name}.parquet").limit(5).write.parquet(f"{folder}/{name}.parquet", mode="overwrite")
    spark.createDataFrame([*EDGES, *MORE], "doc_id long, text string").coalesce(1).write.parquet(f"{folder}/documents.parquet", mode="overwrite")
    spark.createDataFrame([*ITEMS, ("c", f"{ITEM} {ITEM}")], "item_id string, text string").coalesce(1).write.parquet(f"{folder}/benchmark.parquet", mode="overwrite")
    spark.createDataFrame(TALKS, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{folder}/conversations.parquet", mode="overwrite")
    return folder


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows_as_sql(spark, name):
    assert differences(spark, FOLDER, QUERIES[name], ORACLE_SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_odd_rows_as_sql(spark, odd, name):
    assert differences(spark, odd, QUERIES[name], ORACLE_SQL[name]) == ""
