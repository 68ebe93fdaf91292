import pyarrow.parquet as pq

import corpus_pipeline as C
from graphloom.llm import common
from graphloom.llm.common import READ_ROWS, ROW_GROUP, saved, small_batches


def largest_group(folder):
    files = [pq.ParquetFile(p).metadata for p in folder.glob("*.parquet")]
    return max(m.row_group(k).total_byte_size for m in files for k in range(m.num_row_groups))


def test_writers_hold_bounded_row_groups(spark, tmp_path, monkeypatch):
    hashes = spark.range(0, 5_000_000, 1, 1).selectExpr("xxhash64(id) as doc_id")  # 40 MB in one task
    for module in (C, common):
        monkeypatch.setattr(module, "shared_dir", lambda spark: f"file://{tmp_path}")
    monkeypatch.setattr(C, "STAGES", [("all", lambda spark, docs, sf_dir: hashes)])
    assert saved(hashes, "hashes").count() == 5_000_000
    assert C.run(spark, "/root/testdata/sf0.001").count() == 5_000_000
    for folder in (next(tmp_path.glob("hashes-*")), next(tmp_path.glob("pipeline-*")) / "0"):
        assert largest_group(folder) < 1.5 * ROW_GROUP


def test_readers_decode_few_rows_at_a_time(spark):
    small_batches(spark.range(1))
    assert spark.conf.get("spark.sql.parquet.columnarReaderBatchSize") == str(READ_ROWS)


def test_folder_of_a_session_that_names_none(spark, monkeypatch):
    monkeypatch.setattr(type(spark.conf), "get", lambda self, key, default=None: default)
    found = common.shared_dir(spark)
    assert found.startswith("file:///") and common.shared_dir(spark) == found
