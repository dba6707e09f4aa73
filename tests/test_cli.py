"""The command line: bulk CSV load, backup with reset, search."""

import json

from pyspark.sql import functions as F

from mnemospark import cli
from mnemospark.operators import integrity as I
from mnemospark.session import work_dir
from mnemospark.sources import csv_io
from mnemospark.sources.tables import messages
from tests.conftest import SF_SMALL


def lines(capsys):
    return [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.strip()]


def test_load_backup_search(spark, capsys):
    root = work_dir(spark, "t-cli")
    rows = I.stamp_provenance(messages(spark, SF_SMALL), "m", 64)
    bad = rows.limit(1).withColumn("speaker", F.lit(None).cast("string"))  # a reject in the last chunk
    csv_io.write_csv(rows.unionByName(bad), root + "/in", mode="errorifexists")
    n = rows.count()

    assert cli.main(["load-csv", "--csv", root + "/in", "--store", root + "/store", "--chunk-rows",
                     "100000"]) == 0
    report = [x["chunk"] for x in lines(capsys)]
    assert sum(r["rows"] for r in report) == n + 1 and sum(r["errors"] for r in report) == 1
    # one chunk holds every row and it has a reject: nothing is loaded (prefix commit)
    from mnemospark.sources.store import MessageStore
    assert MessageStore(spark, root + "/store").read().count() == 0

    assert cli.main(["load-csv", "--csv", root + "/in", "--store", root + "/store2", "--chunk-rows",
                     "1"]) == 0
    lines(capsys)
    loaded = MessageStore(spark, root + "/store2").read()
    assert loaded.count() == n  # one row per chunk: every chunk before the bad last row is loaded

    assert cli.main(["backup", "--store", root + "/store2", "--out", root + "/bk",
                     "--reset-session", "nothing-to-drop"]) == 0
    out = lines(capsys)
    assert out[0]["manifest"]["rows"] == loaded.count() and out[1]["version"] == 1

    q = rows.select("embedding").first()[0]
    assert cli.main(["search", "--store", root + "/store2", "--vector", json.dumps(list(q)), "--k", "3"]) == 0
    hits = lines(capsys)
    assert len(hits) == 3 and hits[0]["distance"] < 1e-6
