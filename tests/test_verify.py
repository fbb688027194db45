from pyspark.sql import functions as F

from conftest import as_set, reading
from fleetspc.operators import verify
from fleetspc.sources.workspace import materialize, new_path


def test_row_order_and_partitioning_do_not_matter(history):
    rows = [reading(f"E{i % 3}", at=i, value=i / 7) for i in range(50)]
    a, b = history(*rows), history(*rows[::-1]).repartition(7)
    assert as_set(verify.table_fingerprint(a, ["entity"])) == as_set(verify.table_fingerprint(b, ["entity"]))
    assert verify.table_fingerprint(a).count() == 1


def test_any_cell_matters(history):
    base = verify.table_fingerprint(history(reading(value=1.0))).collect()
    for other in (reading(value=1.00001), reading(value=None), reading("CPR0"), reading(at=0.001), reading(failure=None), reading(mode="")):
        assert verify.table_fingerprint(history(other)).collect() != base
    near = history(reading(value=1.00000000001))
    assert verify.table_fingerprint(near).collect() != base
    rounded = [verify.table_fingerprint(df, digits=6).collect() for df in (near, history(reading(value=1.0)))]
    assert rounded[0] == rounded[1]


def test_whole_tables_are_compared_without_keys(history):
    a, b = history(reading(value=1.0)), history(reading(value=1.0 + 1e-9))
    assert verify.compare_runs(a, a).count() == 0
    assert as_set(verify.compare_runs(a, b)) == [("mismatched",)]


def test_copies_count_and_cells_do_not_run_together(spark):
    df = lambda *rows: spark.createDataFrame(list(rows), "a string, b string")
    one, two = (verify.table_fingerprint(df(*[("x", "y")] * n)).collect() for n in (1, 2))
    assert one != two
    assert verify.table_fingerprint(df(("ab", "c"))).collect() != verify.table_fingerprint(df(("a", "bc"))).collect()
    assert verify.table_fingerprint(df((None, "-"))).collect() != verify.table_fingerprint(df(("-", None))).collect()


def test_huge_doubles_have_a_text(spark):
    df = spark.createDataFrame([(1e300,), (float("nan"),), (None,)], "x double")
    assert verify.table_fingerprint(df).collect()[0].row_count == 3


def compare(history, expected, actual):
    both = (verify.table_fingerprint(history(*rows), ["entity"]) for rows in (expected, actual))
    return dict(as_set(verify.manifest_compare(*both, ["entity"]), "entity", "status"))


def test_manifest_statuses(history):
    expected = [reading("A"), reading("B", value=1.0), reading("C"), reading(None)]
    actual = [reading("A"), reading("B", value=2.0), reading("D"), reading(None)]
    assert compare(history, expected, actual) == {"A": "ok", "B": "mismatched", "C": "missing", "D": "extra", None: "ok"}


def test_scopes_fail_on_their_own(history):
    def manifest(scope, *rows):
        return verify.table_fingerprint(history(*rows), ["entity"]).withColumn("scope", F.lit(scope))

    expected = manifest("base", reading("A"), reading("B")).unionByName(manifest("replot/1", reading("A")))
    later = manifest("replot/2", reading("A"))
    good = verify.verify_scopes(expected, expected, ["entity"])
    assert verify.all_ok(good).collect()[0].ok is True
    bad = verify.verify_scopes(expected, expected.unionByName(later), ["entity"])
    assert as_set(bad) == [("base", 0, 0, 0, True), ("replot/1", 0, 0, 0, True), ("replot/2", 0, 1, 0, False)]
    assert verify.all_ok(bad).collect()[0].ok is False


def test_runs_and_differing_rows(history):
    a = history(reading("A"), reading("A"), reading("B"), reading(None, value=1.0))
    b = history(reading("A"), reading("B"), reading(None, value=2.0))
    assert verify.compare_runs(a, a, ["entity"]).count() == 0
    assert as_set(verify.compare_runs(a, b, ["entity"])) == sorted([("A", "mismatched"), (None, "mismatched")], key=repr)
    got = as_set(verify.differing_rows(a, b), "entity", "value", "copies_original", "copies_repeated")
    assert got == sorted([("A", 1.0, 2, 1), (None, 1.0, 1, 0), (None, 2.0, 0, 1)], key=repr)


def test_differences_are_found_from_the_top(history):
    rows = [reading(entity, at=i, value=i / 3, sensor=sensor) for entity in ("CPR01", "CPR02", None) for sensor in ("rpm", "temp") for i in range(4)]
    changed = [*rows[:-1], reading(None, at=3, value=9.0, sensor="temp"), reading("CPR03", sensor="rpm")]
    changed = [r for r in changed if r != rows[0]] + [rows[9]]
    by = ["entity_group", "entity", "sensor"]
    a, b = history(*rows), history(*changed)
    tree = verify.difference_tree(verify.table_fingerprint(a, by), verify.table_fingerprint(b, by), by)
    assert as_set(tree) == sorted([
        (0, None, None, None, 24, 25, "mismatched"),
        (1, "CPR", None, None, 24, 25, "mismatched"),
        (2, "CPR", "CPR01", None, 8, 7, "mismatched"), (2, "CPR", "CPR02", None, 8, 9, "mismatched"),
        (2, "CPR", None, None, 8, 8, "mismatched"), (2, "CPR", "CPR03", None, 0, 1, "extra"),
        (3, "CPR", "CPR01", "rpm", 4, 3, "mismatched"), (3, "CPR", "CPR02", "rpm", 4, 5, "mismatched"),
        (3, "CPR", None, "temp", 4, 4, "mismatched"), (3, "CPR", "CPR03", "rpm", 0, 1, "extra"),
    ], key=repr)
    same = verify.table_fingerprint(a, by)
    assert verify.difference_tree(same, same, by).count() == 0
    assert as_set(verify.located_differences(a, b, by)) == as_set(verify.differing_rows(a, b)) != []
    assert verify.located_differences(a, a, by).count() == 0
    assert verify.located_differences(a.limit(0), b, by).count() == verify.differing_rows(a.limit(0), b).count()


def test_equal_folders_are_not_read_again(spark, history):
    rows = [reading(entity, at=i, value=float(i), sensor=f"s{j}") for entity in ("CPR01", "CPR02") for j in range(20) for i in range(3)]
    paths, keys = [], ["entity_group", "sensor"]
    for changed in (0.0, 1.0):
        df = history(*rows).withColumn("value", F.when(F.col("sensor") == "s7", F.col("value") + changed).otherwise(F.col("value")))
        paths.append(new_path(spark, "printed"))
        df.write.partitionBy(*keys).parquet(paths[-1])
    a, b = (spark.read.parquet(path) for path in paths)
    stored = tuple(materialize(verify.table_fingerprint(df, keys), "fingerprints") for df in (a, b))
    frame = verify.located_differences(a, b, keys, stored)
    assert as_set(frame) == as_set(verify.differing_rows(a, b)) != []
    frame.collect()
    read = [
        s.metrics().apply("numOutputRows").value() for s in scans(frame._jdf.queryExecution().executedPlan())
        if any(path in s.relation().location().rootPaths().toString() for path in paths)
    ]
    assert read == [6, 6]


def scans(node):
    if "FileSourceScan" in node.getClass().getSimpleName():
        yield node
    if "AdaptiveSparkPlan" in node.getClass().getSimpleName():
        yield from scans(node.executedPlan())
    if "QueryStage" in node.getClass().getSimpleName():
        yield from scans(node.plan())
    for i in range(node.children().size()):
        yield from scans(node.children().apply(i))
