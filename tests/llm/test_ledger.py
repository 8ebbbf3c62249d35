"""The ledger of secret scans: each pair of blob and rule version once, whatever repeats."""

from collections import Counter

from barspark.llm import secrets as S
from barspark.llm.storage import new_path

KEY = "password = hunter2hunter2"


def scanned(spark, ledger):
    return Counter(r.blob for r in spark.read.parquet(f"{ledger}/scans").collect())


def versions(spark, rows):
    return spark.createDataFrame(rows, "path string, content string")


def spans(df):
    return Counter((r.path, tuple(tuple(s) for s in r.spans)) for r in df.collect())


def test_a_new_version_of_a_path_scans_only_itself(spark):
    ledger = new_path(spark, "ledger-test")
    S.scan(versions(spark, [("p", "v1"), ("p", f"v2 {KEY}")]), ledger).count()
    assert sum(scanned(spark, ledger).values()) == 2
    found = S.scan(versions(spark, [("p", "v1"), ("p", f"v2 {KEY}"), ("p", f"v3 {KEY}")]), ledger)
    assert spans(found) == {("p", ()): 1, ("p", ((3, 0, 28),)): 2}
    assert set(scanned(spark, ledger).values()) == {1} and len(scanned(spark, ledger)) == 3


def test_null_paths_repeated_rows_and_old_and_new_texts(spark):
    ledger = new_path(spark, "ledger-test")
    old = [(None, f"text {k}") for k in range(30)] + [("a", "same")] * 5 + [("b", "same")] + [(None, None), ("c", "")]
    S.scan(versions(spark, old), ledger).count()
    assert len(scanned(spark, ledger)) == 32 and set(scanned(spark, ledger).values()) == {1}
    new = old + [(None, f"text {k}") for k in range(30, 50)] + [(None, KEY)] * 7 + [("long", "x " * 400_000 + KEY)]
    found = S.scan(versions(spark, new), ledger)
    assert found.count() == len(new)
    assert spans(found)[None, ((0, 0, 25),)] == 7 and spans(found)["long", ((800_000, 0, 800_025),)] == 1
    assert len(scanned(spark, ledger)) == 54 and set(scanned(spark, ledger).values()) == {1}
    plan = S.scan(versions(spark, new), ledger)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Cartesian" not in plan
    assert len(scanned(spark, ledger)) == 54
    assert S.scan(versions(spark, new).limit(0), new_path(spark, "ledger-test")).count() == 0


def test_other_rules_scan_all_blobs_anew(spark):
    ledger = new_path(spark, "ledger-test")
    rows = [("a", KEY), ("b", "none")]
    S.scan(versions(spark, rows), ledger).count()
    S.scan(versions(spark, rows), ledger, S.RULES[:1]).count()
    assert set(scanned(spark, ledger).values()) == {2}
