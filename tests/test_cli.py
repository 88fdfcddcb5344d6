"""The command line runs the dashboard and contract jobs on a stored table."""

import json
import os

from eventscope.__main__ import COMMANDS, parser
from eventscope.plans.tables import canonical_table_path
from eventscope.session import work_path


def _local(spark, name):
    p = work_path(spark, "tests", name)
    return p[len("file:"):] if p.startswith("file:") else p


def _run(spark, argv):
    args = parser().parse_args(argv)
    COMMANDS[args.command](spark, args)


def test_dashboard_and_contracts_commands(spark, sf_small, capsys):
    table = canonical_table_path(spark, sf_small)
    out = _local(spark, "cli")
    _run(spark, ["dashboard", "--table", table, "--out", f"{out}/dash", "--window", "24h", "--bucket", "1h"])
    printed = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert printed["kpis"]["total_events"] > 0
    for name in ("kpis", "journey_funnel", "events_over_time", "category_event_matrix", "download"):
        assert os.path.isdir(f"{out}/dash/{name}")
    _run(spark, ["dashboard", "--table", table, "--out", f"{out}/scan", "--page", "scan"])
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1])["page"] == "scan"
    assert os.path.isdir(f"{out}/scan/category_share")
    _run(spark, ["contracts", "--table", table, "--out", f"{out}/checks"])
    t = spark.read.parquet(f"{out}/checks/taxonomy")
    assert sorted(r.rule for r in t.collect()) == ["brand_for_category", "category_domain",
                                                   "product_type_for_category"]


def test_ingest_log_and_compact_commands(spark):
    d = _local(spark, "cli_ingest")
    os.makedirs(f"{d}/log")
    with open(f"{d}/log/a.json", "w") as f:
        f.write(json.dumps({"event_id": "U1000", "event_type": "login", "timestamp": 1.0}) + "\n")
        f.write("broken\n")
    _run(spark, ["ingest-log", "--log", f"{d}/log", "--table", f"{d}/table", "--checkpoint", f"{d}/ck",
                 "--quarantine", f"{d}/bad", "--available-now"])
    assert spark.read.parquet(f"{d}/table").count() == 1
    assert spark.read.parquet(f"{d}/bad").count() == 1
    _run(spark, ["compact", "--source", f"{d}/table", "--target", f"{d}/compact"])
    assert spark.read.parquet(f"{d}/compact").count() == 1


def test_store_commands(spark, capsys):
    d = _local(spark, "cli_store")
    os.makedirs(f"{d}/log")
    day = 86400.0
    rows = [{"event_id": f"U{k}", "event_type": ["login", "purchase"][k % 2], "timestamp": k // 10 * day + k} for k in range(40)]
    rows.append({"user_id": "U99", "event_type": "login", "timestamp": "1970-01-04T00:00:39Z"})
    with open(f"{d}/log/a.json", "w") as f:
        f.write("\n".join(json.dumps(r) for r in rows) + "\nbroken\nhalf")
    ingest = ["ingest-store", "--log", f"{d}/log", "--table", f"{d}/store", "--checkpoint", f"{d}/ck", "--mixed", "--available-now"]
    _run(spark, ingest)
    _run(spark, ["compact", "--source", f"{d}/store"])
    from eventscope.streaming import store
    assert store.read_store(spark, f"{d}/store").count() == 41
    assert store.read_store(spark, f"{d}/store", kind=store.MALFORMED).count() == 1
    _run(spark, ["dashboard", "--table", f"{d}/store", "--out", f"{d}/dash", "--window", "24h", "--bucket", "1h"])
    kpis = json.loads(capsys.readouterr().out.strip().splitlines()[-1])["kpis"]
    assert kpis["total_events"] == 11
    _run(spark, ["dashboard", "--table", f"{d}/store", "--out", f"{d}/scan", "--page", "scan", "--window", "24h"])
    status = spark.read.parquet(f"{d}/scan/data_status").first()
    assert 41 in tuple(status) and 11 in tuple(status)
