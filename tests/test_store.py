"""An index on disk from a source tree, run after run; layouts that filters reach; results of writes."""

import pytest
from pyspark.sql import functions as F

from quarry.operators import catalog, collection, filters, index, store
from quarry.sources import catalog_store, files, stored


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "src"
    (root / "lib").mkdir(parents=True)
    (root / "a.go").write_text("package a\n\nfunc ParseConfig() {}\n")
    (root / "lib" / "b.py").write_text("def serve():\n    return 1\n" * 100)
    (root / "blank.md").write_text("  \n")
    (root / "bad.txt").write_bytes(b"caf\xe9 table\n")
    return root


def named(df):
    return sorted((r.source_file, r.start_line, r.content) for r in df.select("source_file", "start_line", "content").collect())


def test_runs(spark, tree, tmp_path):
    s = store.Store(spark, str(tmp_path / "store"))
    assert s.version == 0 and s.counts is None
    c = s.run(str(tree), "p")
    assert (c.files, c.handled, c.unchanged, c.removed, c.skipped, c.mended) == (3, 3, 0, 0, 1, 1) and c.points == c.chunks == 1 + 4 + 1
    assert s.version == 1 and s.counts == c
    assert [r.id for r in s.keywords.boolean("parse AND config").collect()] == [r.id for r in s.points.where("source_file = 'a.go'").collect()]
    again = s.run(str(tree), "p")
    assert (again.handled, again.unchanged, again.chunks, again.points) == (0, 3, 0, 6)
    (tree / "a.go").write_text("package a\n\nfunc Fresh() {}\n")
    (tree / "lib" / "b.py").unlink()
    (tree / "c.rs").write_text("fn main() {}\n")
    third = s.run(str(tree), "p")
    assert (third.files, third.handled, third.unchanged, third.removed, third.points) == (3, 2, 1, 1, 3)
    assert s.keywords.boolean("config").collect() == [] and s.keywords.boolean("fresh").count() == 1
    # the same as an index of the tree as it is now
    assert named(s.points) == named(index.full(files.walk(spark, str(tree)), F.lit("p")).points)
    assert s.snapshot.count() == 3
    s.vacuum(1)
    assert not (tmp_path / "store" / "v1").exists() and s.points.count() == 3


def test_a_run_that_fails_leaves_the_last_version(spark, tree, tmp_path):
    s = store.Store(spark, str(tmp_path / "store"))
    s.run(str(tree), "p")
    before = named(s.points)
    (tree / "a.go").write_text("package b\n")

    def broken(df):
        return df.withColumn("vector", F.raise_error(F.lit("no embedder")))

    with pytest.raises(Exception, match="no embedder"):
        s.run(str(tree), "p", broken)
    assert s.version == 1 and named(s.points) == before
    assert s.run(str(tree), "p").handled == 1 and s.version == 2


def rows_read(df):
    """Rows that the scan gave out, after files and row groups were skipped."""
    df.collect()
    return sum(leaf.metrics().apply("numOutputRows").value() for leaf in leaves(df._jdf.queryExecution().executedPlan()))


def leaves(plan):
    found = plan.collectLeaves()
    return [found.apply(i) for i in range(found.size())]


def test_filters_reach_the_files(spark, tmp_path):
    df = spark.range(20_000).select(F.col("id"), F.concat(F.lit("k"), (F.col("id") * 7919 % 20_000).cast("string")).alias("name"))
    was = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = stored.laid_out(df, str(tmp_path / "p"), ["id"], ("name",), files=10)
        by_range, by_name = out.where(filters.store_filter("id BETWEEN 4100 AND 4150")), out.where(filters.store_filter("name = 'k77'"))
        assert by_range.count() == 51 and by_name.count() == 1
        assert 51 <= rows_read(by_range) <= 2500 and 1 <= rows_read(by_name) <= 4500
        assert rows_read(out.where(filters.store_filter("name LIKE '%7'"))) == 20_000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", was)


def test_written(spark):
    points = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "id int, v string")
    fresh = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (3, "z", 1), (None, "n", 1), (2, None, 1), (4, None, 1)], "id int, v string, seq int")
    got = {(r.id, r.v): r.outcome for r in collection.written(points, fresh, F.col("v") != "", seq="seq").collect()}
    assert got == {(1, "x"): "superseded", (1, "y"): "updated", (3, "z"): "inserted", (None, "n"): "rejected", (2, None): "rejected", (4, None): "rejected"}


def test_catalog_is_opened_migrated_and_written(spark, tmp_path):
    path = str(tmp_path / "catalog")
    old = catalog_store.Catalog(spark, path, catalog_store.MIGRATIONS[:2])
    assert old.migrated == 2 and old.names == ["jobs", "projects", "settings"]
    old.write(projects=spark.createDataFrame([(1, "a", "/a")], "id long, name string, root_path string"))
    new = catalog_store.Catalog(spark, path)
    assert new.migrated == 4 and new.names == ["jobs", "models", "projects", "settings"]
    assert [tuple(r) for r in new.table("projects").collect()] == [(1, "a", "/a", "", "code")]
    new.write(projects=catalog.insert_project(new.table("projects"), {"id": 2, "name": "b", "root_path": "/b", "machine_id": "m"}), models=catalog.insert_model(new.table("models"), {"name": "x", "dim": 3}))
    again = catalog_store.Catalog(spark, path)
    assert again.table("projects").count() == 2 and again.table("models").first().id == 1
    with pytest.raises(ValueError, match="columns"):
        again.write(jobs=again.table("models"))
    with pytest.raises(ValueError, match="later version"):
        catalog_store.Catalog(spark, path, catalog_store.MIGRATIONS[:3])

    def broken(session, tables):
        return tables | {"models": tables["models"].withColumn("x", F.raise_error(F.lit("no such form")))}

    with pytest.raises(Exception, match="no such form"):
        catalog_store.Catalog(spark, path, (*catalog_store.MIGRATIONS, broken))
    assert catalog_store.Catalog(spark, path).table("models").count() == 1
