"""What later stages read is aggregated for the reports that collisions leave only."""

from tessera.operators import funnel
from tessera.storage import materialize


def test_sets_of_collapsed_reports_are_not_made(spark, monkeypatch):
    written = {}

    def kept(df, name):
        written[name] = materialize(df, name)
        return written[name]

    monkeypatch.setattr(funnel, "materialize", kept)
    ids = range(40)
    inventory = spark.createDataFrame([(i, "original", f"n{i // 10} - 1") for i in ids], "report_id long, batch string, name string")
    telemetry = spark.createDataFrame([(i, i // 10 + 1, "d", "exact") for i in ids], "report_id long, execs long, last string, tier string")
    features = spark.createDataFrame([(i, "m", "t", f"f{i}") for i in ids], "report_id long, m string, t string, f string")
    statements = spark.createDataFrame([(i, f"SELECT a{i} FROM t") for i in ids], "report_id long, sql string")
    hashes = spark.createDataFrame([(i, [f"h{i}"]) for i in ids], "report_id long, hashes array<string>")
    result = funnel.run_pipeline(inventory, features, telemetry, statements, hashes)
    left = {r.report_id for r in result.kept["collision"].collect()}
    assert left == {0, 10, 20, 30}
    assert {r.report_id for r in written["sets"].collect()} == left == {r.report_id for r in written["hashes"].collect()}
