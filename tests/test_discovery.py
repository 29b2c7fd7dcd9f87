from pyspark.sql import functions as F

from trailspan.operators import discovery, slates


def test_a_slate_of_different_places(spark):
    """Two open quarters far apart in a town that is otherwise done: missions close, fit, differ and come from both."""
    n, rows, seg = 12, [], 0
    for i in range(n):
        for j in range(n):
            for k, m in ((i + 1, j), (i, j + 1)):
                if k < n and m < n:
                    rows.append((seg, i * n + j, k * n + m, 120.0, 3, "REQUIRED", f"street {i if k == i else 100 + j}", i < 4 and j < 4 and k < 4 and m < 4 or i > 7 and j > 7))
                    seg += 1
    members = spark.createDataFrame(rows, "segment_id long, u long, v long, length_m double, households long, role string, display_name string, open boolean")
    done = members.where("NOT open").select("segment_id")
    nodes = spark.createDataFrame([(i * n + j, i * 120.0 / slates.METRES_PER_LON, j * 120.0 / slates.METRES_PER_LAT) for i in range(n) for j in range(n)], "node long, lon double, lat double")
    members = members.drop("open")
    starts = discovery.cluster_starts(members, done, nodes, 1.0).collect()
    assert len({s.cluster for s in starts}) == 2 and 6 <= len(starts) <= discovery.MOST_WALKS
    held = spark.createDataFrame([], "segment_id long")
    got = discovery.discovered(members, done, nodes, held, 1.0, 4, 2).orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, len(got) + 1)) and {r.cluster for r in got[:2]} == {s.cluster for s in starts}
    assert all(r.miles <= 1.0 and r.new_miles >= 0.1 and r.homes > 0 and r.score >= discovery.TOLERANCE * got[0].score and not r.completes for r in got)
    taken = members.join(done, "segment_id", "left_anti").where(F.col("u") < 60).select("segment_id")
    moved = discovery.discovered(members, done, nodes, taken, 1.0, 4, 2).orderBy("rank").first()
    assert moved.start >= 8 * n  # where nobody is yet
    assert discovery.discovered(members, members.select("segment_id"), nodes, held, 1.0).count() == 0
