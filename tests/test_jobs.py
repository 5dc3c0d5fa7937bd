"""Jobs: a run that breaks off goes on after its last stage and leaves no tables of steps."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from shoal.plans import jobs
from shoal.sources import shared
from tests.world import AS_OF, CFG, CLUB, DAY, make


def left(base):
    return {os.path.basename(x) for x in glob.glob(f"{base.removeprefix('file:')}/job-*")}


def test_run_resumes(spark, tmp_path):
    calls = {"load": 0, "analysis": 0}
    run, base = str(tmp_path / "run"), shared.shared_dir(spark)

    def load():
        calls["load"] += 1
        return make(spark, AS_OF - 75 * DAY)

    def analysis(t, cfg):
        calls["analysis"] += 1
        assert shared.shared_dir(spark).endswith(jobs.named(run)) and left(base) == {jobs.named(run)}
        first = shared.table(t["accounts"].select("id"))
        breaks = F.raise_error(F.lit("lost")).cast("int") if calls["analysis"] == 1 else F.lit(1)
        return {"first": shared.cut(first), "second": first.select(breaks.alias("x"), "id"), "third": first.groupBy().count()}

    names = ("first", "second", "third")
    with pytest.raises(Exception, match="lost"):
        jobs.report(spark, load, run, CFG, analysis, names)
    assert jobs.done(spark, f"{run}/results/first") and not jobs.done(spark, f"{run}/results/second") and left(base) == set()
    at = os.path.getmtime(f"{run}/results/first/_SUCCESS")
    # what a killed process leaves: its folder of tables, and a stage without the mark
    os.makedirs(f"{base.removeprefix('file:')}/{jobs.named(run)}/table-dead")
    os.makedirs(f"{run}/results/third/_temporary")
    got = jobs.report(spark, load, run, CFG, analysis, names)
    assert calls == {"load": 1, "analysis": 2} and os.path.getmtime(f"{run}/results/first/_SUCCESS") == at and left(base) == set()
    n = make(spark, AS_OF - 75 * DAY)["accounts"].count()
    assert got["second"].count() == n and got["third"].first()[0] == n
    jobs.report(spark, load, run, CFG, analysis, names)
    assert calls == {"load": 1, "analysis": 2}


def test_engagement_run(spark, tmp_path):
    run, base = str(tmp_path / "run"), shared.shared_dir(spark)
    got = jobs.engagement_run(spark, lambda: make(spark, AS_OF - 75 * DAY), run, CFG, ["c9", "no such post"])
    post = got["engagements"].collect()
    assert [(r.tweet_id, r.engagers) for r in post] == [("c9", 50)] and post[0].score > 0.5
    assert {r.signal for r in got["signals"].collect()} >= {"engager_creation_spike", "reply_velocity", "duplicate_replies"}
    top = got["suspicious"].orderBy("rank").collect()
    assert len(top) == 20 and all(r.id.startswith("r") for r in top) and CLUB not in {r.id for r in top} and left(base) == set()
    again = jobs.engagement_run(spark, lambda: 1 / 0, run, CFG, ["c9"])
    assert again["suspicious"].count() == 20


def test_command(spark, tmp_path):
    for args in (["report", "--run", "x", "--as-of", "2025-02-01"], ["engagement", "--dataset", "d", "--run", "x", "--as-of", "2025-02-01"], ["report", "--dataset", "d", "--run", "x", "--as-of", "soon"]):
        with pytest.raises(SystemExit):
            jobs.main(args)
