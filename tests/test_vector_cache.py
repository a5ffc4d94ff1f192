import time

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from spindrift.catalogue import ORACLES, QUERIES
from spindrift.operators import vector_cache


def both(spark, folder, ids, vectors):
    """The rows of the query and those of its SQL over a table of these vectors."""
    pq.write_table(pa.table({"vec_id": pa.array(ids, pa.int64()), "embedding": pa.array(vectors, pa.list_(pa.float32()))}), folder / "embeddings.parquet")
    got = sorted(map(tuple, QUERIES["vector_cache_hits"](spark, str(folder)).collect()))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
    return got, sorted(db.execute(ORACLES["vector_cache_hits"]).fetchall())


def test_odd_rows(spark, tmp_path, monkeypatch):
    """Cosines at the threshold, vectors without a direction, nulls, repeated ids and vectors, over many tiles."""
    monkeypatch.setattr(vector_cache, "ASKED_VALUES", 40)
    monkeypatch.setattr(vector_cache, "PAIRS", 500)
    vectors = np.random.default_rng(1).integers(-3, 4, (600, 4)).astype("float32").tolist()
    vectors[0], vectors[9], vectors[17] = [1, 0, 0, 0], [3, 9, 3, 1], [6, 18, 6, 2]
    vectors[7] = vectors[50] = [0, 0, 0, 0]
    vectors[100], vectors[150], vectors[8] = [float("nan"), 1, 1, 1], [float("inf"), 1, 0, 0], [float("-inf"), 0, 0, 0]
    vectors[10] = vectors[200] = None
    ids = list(range(600))
    ids[1] = ids[2] = 0
    ids[11], ids[12], ids[13], ids[14] = None, -50, -100, 50
    got, expected = both(spark, tmp_path, ids, vectors)
    assert got == expected and len(got) > 10


def test_lengths_and_null_components(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0, 0.0]), (2, [1.0, None]), (3, []), (4, [2.0, 1.0]), (50, [1.0, 0.0, 0.0]), (5, [1e200, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, vector_cache.cache_hits(df, "vec_id % 50 = 0", 0.3).collect())) == [(0, 2), (50, 1)]
    assert not vector_cache.cache_hits(df.where("vec_id = 3"), "vec_id % 50 = 0", 0.3).collect()


def test_time_of_a_larger_table(spark, tmp_path):
    vectors = np.random.default_rng(2).standard_normal((16000, 64)).astype("float32")
    vectors[:, :4] += 1
    began = time.monotonic()
    got, expected = both(spark, tmp_path, range(len(vectors)), list(vectors))
    assert got == expected and len(got) > 300
    assert time.monotonic() - began < 60
