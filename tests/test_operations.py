"""What the operations laid over the orders exercise; their results are held against SQL with all other queries."""

import duckdb

from txintel.plans import operations as O

SF = "/root/testdata/sf0.01"


def asked(sql):
    c = duckdb.connect()
    for name in ("orders", "lineitem"):
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return c.execute(sql).fetchall()


def test_every_typology_severity_and_shape_occurs():
    tags, severities, most, bridges = asked(f"SELECT list_distinct(flatten(list(string_split(typology, ' + ')))), list_distinct(list(severity)), max(tx_count), count(*) FILTER (bridges > 0) FROM ({O.CASES_SQL})")[0]
    assert set(tags) == {"CoinJoin mixing", "Peeling chain", "Fan-out / fan-in structuring", "Consolidation sweep", "Anomalous flow"}
    assert set(severities) == {"CRITICAL", "HIGH", "MEDIUM"} and most >= 10 and bridges >= 20
    rows = asked(f"SELECT severity, count(*), count(*) FILTER (peel_hops >= 3), count(*) FILTER (coinjoin >= 0.5), count(*) FILTER (NOT resolved), count(*) FILTER (burst > 3) FROM ({O.EVIDENCE_SQL}) GROUP BY severity")
    assert {r[0] for r in rows} == {"CRITICAL", "HIGH", "MEDIUM", "LOW"}
    assert all(sum(r[k] for r in rows) > 100 for k in range(1, 6))
    stats = asked(f"SELECT entities, peel_chains, flagged_transactions, cases, coinjoin_transactions FROM ({O.STATS_SQL})")[0]
    assert all(n > 100 for n in stats)
