import random

from recallforge.operators import grammar


def test_zones_stream_by_subject(spark):
    """Many short chains in batches that cut through them, without a call a subject."""
    rng = random.Random(4)
    nodes, edges, want = [], [], {}
    for s in range(40):
        chain = [s * 100 + k for k in range(rng.randrange(1, 9))]
        nodes += [(f"s{s}", x, k) for k, x in enumerate(chain)]
        zones = [[chain[0]]]
        for a, b in zip(chain, chain[1:], strict=False):
            kind = rng.choice(["refines", "supersedes"])
            edges.append((f"s{s}", b, a, kind))
            zones[-1].append(b) if kind == "refines" else zones.append([b])
        want[f"s{s}"] = [(z, m, m[0], m[-1], zones[z + 1][0] if z + 1 < len(zones) else None) for z, m in enumerate(zones)]
    rng.shuffle(nodes), rng.shuffle(edges)
    n = spark.createDataFrame(nodes, "subject string, node_id long, at int")
    e = spark.createDataFrame(edges, "subject string, source_id long, target_id long, edge_type string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        found = grammar.graph_zones(n, e)
        got = {s: sorted((r.zone, list(r.members), r.start, r.terminal, r.ended_by) for r in rows) for s, rows in _by(found.collect()).items()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == want
    assert "CoGroups" not in found._jdf.queryExecution().executedPlan().toString()


def _by(rows):
    out = {}
    for r in rows:
        out.setdefault(r.subject, []).append(r)
    return out
