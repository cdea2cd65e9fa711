from datetime import datetime

from edgeloom.streaming.edges import degree_windows, edge_stream, new_edges

SCHEMA = "edge_id bigint, node1 string, node2 string, node1_type string, node2_type string, relation string, database string, loaded_at timestamp_ntz"


def run(frame, name, mode="append"):
    q = frame.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.processAllAvailable()
    q.awaitTermination(60)
    return frame.sparkSession.table(name)


def test_edges_arrive_once(spark, tmp_path):
    rows = [(1, "A", "B", "X", "Y", "r", "db", datetime(2025, 1, 1)), (2, "a", "b ", "X", "Y", "r", "DB", datetime(2025, 1, 2)), (3, None, "b", "X", "Y", "r", "db", datetime(2025, 1, 2)), (4, "c", "b", None, "Y", "r", "db", None)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"))
    out = run(new_edges(edge_stream(spark, str(tmp_path / "in"), SCHEMA)), "new_edges")
    assert [(r.node1, r.node2) for r in out.collect()] == [("a", "b")]
    degrees = run(degree_windows(edge_stream(spark, str(tmp_path / "in"), SCHEMA)), "degrees", "complete")
    assert {r.node: r.degree for r in degrees.collect()} == {"a": 2, "b": 2}
