"""End-to-end flows on the sf0.001 stand-in log (files in the checkpoint folder)."""

from pyspark.sql import functions as F

from clickfeat.plans import entrypoints as EP
from clickfeat.schema import RAW_LOG
from clickfeat.session import scratch_path
from clickfeat.sources import logs as IO
from clickfeat.sources.standin import events_log

SF = "/root/testdata/sf0.001"


def test_end_to_end(spark):
    raw = events_log(spark, SF)
    # the reference reads space-delimited text: go through a file
    path = scratch_path(spark, "raw")
    IO.write_log(raw, path)
    log = IO.read_log(spark, path)
    assert log.schema == RAW_LOG
    train = log.where(F.col("instance_id") % 5 != 0)  # a test file without labels
    test = log.where(F.col("instance_id") % 5 == 0).drop("is_trade")
    full = EP.prepare_log(train, test)
    assert full.count() == raw.count()

    stage = scratch_path(spark, "stage")
    EP.stage_features(full, stage)
    preds = scratch_path(spark, "preds")
    ll = {r["part"]: r for r in EP.train_and_score(spark, stage, preds, max_iter=5, max_depth=3).collect()}
    assert set(ll) == {"train", "holdout"} and all(r["log_loss"] > 0 for r in ll.values())
    p = IO.read_predictions(spark, preds)
    assert p.count() == full.where("day = 24").count()

    out = scratch_path(spark, "ffm")
    table = EP.export_ffm(full, out)
    assert table.where(F.col("Neg") + F.col("Pos") != F.col("Total")).count() == 0
    lines = spark.read.text(f"{out}/tr")
    assert lines.count() == full.where("day < 24").count()

    blended = scratch_path(spark, "blend")
    b = EP.blend_files(spark, [(preds, 0.6), (preds, 0.4)], blended)
    diff = b.join(p, "instance_id").where(F.abs(b.predicted_score - p.predicted_score) > 1e-12).count()
    assert diff == 0
