"""array_diff scales embeddings in single precision, as its SQL does."""

import numpy as np
import oracle

from cuemill.catalog import load


def test_scaled_in_single_precision(spark, tmp_path):
    x = np.random.default_rng(3).uniform(-1, 1, 200_000).astype("float32")
    near = x[np.rint(x * np.float32(1000)) != np.rint(x.astype("float64") * 1000)]
    assert len(near) > 1
    rows = [(0, [0.0] * len(near)), (1, [float(v) for v in near])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    q = load()["array_diff"]
    got = q.run(spark, str(tmp_path)).collect()[0]
    con = oracle.duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    cur = con.execute(q.sql)
    want = dict(zip([d[0] for d in cur.description], cur.fetchall()[0]))
    assert got.asDict() == want
