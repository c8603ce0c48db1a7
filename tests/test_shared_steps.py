"""Steps that the analysis takes once."""

from pyspark.sql import functions as F

from txintel.operators import flow, origin
from txintel.plans import operations as O

SF = "/root/testdata/sf0.001"


def test_delays_follow_from_the_links_times(spark):
    tx = O.ledger(spark, SF)
    odd = spark.createDataFrame([(-1, None), (-2, 5.0)], "txid bigint, ts double").join(tx.drop("txid", "ts").limit(1))
    tx = tx.unionByName(odd, allowMissingColumns=True).localCheckpoint()
    for hot in (flow.HOT, 1):
        links = flow.spend_links(flow.inputs(tx), flow.outputs(tx), hot, times=True).localCheckpoint()
        plain = flow.spend_links(flow.inputs(tx), flow.outputs(tx), hot)
        assert links.count() and links.drop("parent_ts", "child_ts").exceptAll(plain).count() == 0 == plain.exceptAll(links.drop("parent_ts", "child_ts")).count()
        want, got = flow.delays(tx, flow.flow_edges(links)), flow.link_delays(tx, links)
        assert got.exceptAll(want).count() == 0 == want.exceptAll(got).count() and got.filter(F.col("since") < flow.NEVER_S).count()


def test_attribution_reads_the_announcements_twice(spark, monkeypatch):
    obs, asked = O.observations(spark, SF), []
    real = type(obs).groupBy
    monkeypatch.setattr(type(obs), "groupBy", lambda df, *cols: asked.append(df is obs) or real(df, *cols))
    monkeypatch.setattr(type(obs), "select", lambda df, *cols, real=type(obs).select: asked.append(df is obs) or real(df, *cols))
    got = origin.attribute(obs)
    assert sum(asked) == 2  # by address and by sensor; before, all four signals grouped them anew
    monkeypatch.undo()
    first = origin.first_seen(obs)
    want = origin.rated_by(first.join(origin.sensor_agreement(obs, first).drop("origin_ip"), "txid").join(origin.relay_ratio(obs, first).select("origin_ip", "relay_ratio"), "origin_ip"))
    assert got.count() and got.exceptAll(want).count() == 0 == want.exceptAll(got).count()
