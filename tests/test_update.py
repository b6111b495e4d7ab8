import datetime as dt
import gzip

import pytest
from pyspark.sql import functions as F

from tessera.operators import changes as ch
from tessera.operators import elements, features
from tessera.plans import build, update
from tessera.sources.store import Store
from tessera.streaming import replication

W, R = 1 << 62, -(1 << 63)
NODE = "id long, version int, visible boolean, tags map<string,string>"
DAY = dt.datetime(2024, 1, 1)


@pytest.fixture(autouse=True)
def plans_without_code(spark):
    """The tables here have a few rows, and compiling the plans would take most of the time."""
    spark.conf.set("spark.sql.codegen.wholeStage", "false")
    yield
    spark.conf.unset("spark.sql.codegen.wholeStage")


@pytest.fixture
def store(spark, tmp_path):
    """Six nodes, two ways of them and a relation of a closed way, assembled."""
    made = Store(spark, str(tmp_path / "store"))
    places = {1: (10, 10), 2: (400_000, 10), 3: (400_000, 400_000), 4: (10, 400_000), 5: (900_000, 900_000), 6: (20, 30)}
    ways = [(10, 1, True, {"building": "yes"}, [1, 2, 3, 4, 1]), (11, 1, True, {"highway": "x"}, [5, 6])]
    tables = {
        "nodes": spark.createDataFrame([(i, 1, True, {}) for i in places], NODE),
        "points": spark.createDataFrame([(i, *p) for i, p in places.items()], "id long, x int, y int"),
        "ways": spark.createDataFrame(ways, NODE + ", nodes array<long>"),
        "relations": spark.createDataFrame([(20, 1, True, {"type": "multipolygon"}, [(W + 10, "outer")])], NODE + ", members array<struct<combined_id:long,role:string>>"),
    }
    made.commit(tables | {"refs": elements.references(tables["ways"], tables["relations"])}, sequence=4)
    build.assemble_geometry(made)
    return made


def change(seq, ord, op, kind, i, version, tags=None, refs=(), x=None, y=None):
    return (seq, ord, op, kind, i, version, DAY + dt.timedelta(days=seq), tags or {}, list(refs), x, y)


def rows(table):
    plain = lambda x: sorted(x.items()) if isinstance(x, dict) else x
    return sorted(str([plain(x) for x in r]) for r in table.select(sorted(table.columns)).collect())


def as_rebuilt(store, tmp_path):
    """The store's tables, and those of a store with the same elements that is assembled from nothing."""
    other = Store(store.spark, str(tmp_path / "rebuilt"))
    kept = {name: store.read(name) for name in ("nodes", "points", "ways", "relations")}
    ways = kept["ways"].filter("visible")
    other.commit(kept | {"refs": elements.references(ways, kept["relations"].filter("visible"))})
    build.assemble_geometry(other)
    for name in ("refs", "features", "tiles"):
        assert rows(store.read(name)) == rows(other.read(name)), name


def test_a_patched_store_equals_a_rebuilt_one(spark, store, tmp_path):
    first = rows(store.read("tiles"))
    changes = [
        change(5, 0, "modify", 0, 3, 2, x=500_000, y=450_000),
        change(5, 1, "create", 0, 7, 1, x=1_500_000, y=5),
        change(5, 2, "modify", 1, 11, 2, {"highway": "y"}, [5, 6, 7]),
        change(5, 3, "create", 1, 12, 1, {"highway": "z"}, [7, 6]),
    ]
    update.apply_changeset(store, spark.createDataFrame(changes, ch.CHANGE), 5)
    assert store.properties()["sequence"] == 5 and rows(store.read("tiles")) != first
    as_rebuilt(store, tmp_path)
    update.apply_changeset(store, spark.createDataFrame([change(6, 0, "delete", 1, 10, 2), change(6, 1, "delete", 1, 12, 2)], ch.CHANGE), 6)
    as_rebuilt(store, tmp_path)
    gone = {W + 10, W + 12, R + 20}
    assert not gone & {r.combined_id for r in store.read("tiles").collect()}


def test_only_what_differs_is_written(spark, store):
    tables = build.tables_of(store)
    changes = spark.createDataFrame([change(5, 0, "modify", 0, 6, 2, x=21, y=31)], ch.CHANGE).withColumn("roles", F.array().cast("array<string>"))
    before = update.touched(tables, changes.select("type", "id"))
    made = update.deltas(ch.final_states(before, changes).withColumn("roles", F.array().cast("array<string>"))) | {"refs": update.edge_delta(before, changes)}
    patch = update.geometry_deltas(store, tables, made, ch.final_states(before, changes))
    assert {r.combined_id for r in patch["tiles"][0].collect()} == {W + 11}
    assert update.pending(made["points"]).first().asDict() == {"n_replaced": 1, "n_written": 1}


def test_broken_references_are_rejected(spark, store):
    refs = store.read("refs").filter(~((F.col("ref") == 6) & (F.col("referrer") == W + 11)))
    store.commit({"refs": refs})
    before = store.manifest()
    for op in (change(5, 0, "modify", 1, 11, 2, refs=[5, 6]), change(5, 0, "delete", 1, 11, 2)):
        with pytest.raises(ch.ChangesetRejected, match="does not list it"):
            update.apply_changeset(store, spark.createDataFrame([op], ch.CHANGE), 5)
    assert store.manifest() == before


def test_late_changes_are_dropped(spark, store):
    states = spark.createDataFrame([(100, DAY + dt.timedelta(days=2))], "sequence long, timestamp timestamp")
    assert update.start(store, states, "2024-01-04 00:00:00") == 40
    late = [change(2, 0, "modify", 0, 6, 2, x=1, y=1), change(5, 0, "modify", 0, 5, 2, x=2, y=2)]
    update.apply_changeset(store, spark.createDataFrame(late, ch.CHANGE), 41)
    assert {(r.id, r.x) for r in store.read("points").filter("id > 4").collect()} == {(5, 2), (6, 20)}


OSC = """<osmChange version="0.6"><{op}><node id="6" version="{v}" timestamp="2024-02-0{v}T00:00:00Z" lat="0.00{v}" lon="0.00{v}"/></{op}></osmChange>"""


def test_update_to_and_back(spark, store, tmp_path):
    for sequence, v in ((5, 2), (6, 3)):
        path = tmp_path / "replication" / "000" / "000" / f"{sequence:03d}.osc.gz"
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(gzip.compress(OSC.format(op="modify", v=v).encode()))
    place = lambda: store.read("points").filter("id = 6").first().x
    assert update.update_to(store, str(tmp_path / "replication"), 6) == [5, 6] and place() == 30_000
    assert update.info(store)["back_to"] == [4, 5]
    with pytest.raises(Exception, match="007.osc.gz"):
        update.update_to(store, str(tmp_path / "replication"), 7)
    update.rollback_to(store, 5)
    assert place() == 20_000 and store.properties()["sequence"] == 5
    update.rollback_to(store, 4)
    assert place() == 20
    with pytest.raises(ValueError, match="no savepoint"):
        store.rollback()
    assert update.get(store, "way", 10).first().nodes == [1, 2, 3, 4, 1] and len(update.get(store, "way", 10, "geometry").first().shapes) == 1
    assert update.get(store, "way", 11, "tiles").count() > 0 and update.get(store, "way", 11, "json").filter("level = 0").count() == 1


def test_a_digested_store_follows_a_stream(spark, store, tmp_path):
    source, checkpoint = str(tmp_path / "source"), str(tmp_path / "checkpoint")
    changes = [change(5, 0, "modify", 0, 6, 2, x=7, y=8), change(6, 0, "modify", 0, 6, 3, x=9, y=9)]
    spark.createDataFrame(changes, ch.CHANGE).write.parquet(source)
    replication.follow(spark, store, source, checkpoint).awaitTermination()
    assert store.properties()["sequence"] == 6 and store.read("points").filter("id = 6").first().x == 9


def test_nodes_in_tiles_are_kept_up(spark, store, tmp_path):
    tags = {i: {"shop": "x"} if i in (1, 5) else {} for i in range(1, 7)}
    store.commit({"nodes": spark.createDataFrame([(i, 1, True, t) for i, t in tags.items()], NODE)})
    build.assemble_geometry(store, nodes=True)
    changes = [change(5, 0, "modify", 0, 5, 2, {"shop": "y"}, x=1, y=1), change(5, 1, "modify", 0, 6, 2, {"shop": "z"}, x=20, y=30), change(5, 2, "modify", 0, 1, 2, {}, x=10, y=10), change(5, 3, "create", 0, 8, 1, {"shop": "w"}, x=9, y=9)]
    update.apply_changeset(store, spark.createDataFrame(changes, ch.CHANGE), 5)
    assert {r.combined_id for r in store.read("tiles").filter("combined_id BETWEEN 0 AND 100").collect()} == {5, 6, 8}
    rebuilt = Store(spark, str(tmp_path / "rebuilt"))
    rebuilt.commit({name: store.read(name) for name in ("nodes", "points", "ways", "relations", "refs")})
    build.assemble_geometry(rebuilt, nodes=True)
    for name in ("features", "tiles"):
        assert rows(store.read(name)) == rows(rebuilt.read(name)), name


def test_roles_of_a_feed_are_kept(spark, store, tmp_path):
    source = str(tmp_path / "source")
    row = (*change(5, 0, "modify", 2, 20, 2, {"type": "multipolygon"}, [W + 10, W + 11]), ["outer", "inner"])
    spark.createDataFrame([row], ch.FEED).write.parquet(source)
    replication.follow(spark, store, source, str(tmp_path / "checkpoint")).awaitTermination()
    assert [tuple(m) for m in store.read("relations").first().members] == [(W + 10, "outer"), (W + 11, "inner")]


def test_only_edges_that_come_or_go_are_written(spark, store):
    tables = build.tables_of(store)
    changes = spark.createDataFrame([change(5, 0, "modify", 1, 11, 2, {}, [5, 4]), change(5, 1, "modify", 1, 11, 3, {}, [4, 6, 2])], ch.CHANGE)
    gone, come = update.edge_delta(update.touched(tables, changes.select("type", "id").distinct()), changes)
    assert {tuple(r) for r in gone.collect()} == {(5, W + 11)} and {tuple(r) for r in come.collect()} == {(4, W + 11), (2, W + 11)}


def test_an_update_shuffles_no_table_of_points(spark, tmp_path):
    """What an update reads of points, ways and references it reads by key: their scans meet the keys by broadcast."""
    spark.range(1000).select("id", F.col("id").cast("int").alias("x"), F.lit(0).alias("y")).write.parquet(str(tmp_path / "points"))
    points = spark.read.parquet(str(tmp_path / "points"))
    ways = spark.createDataFrame([(1, 1, True, {}, [3, 4, 900])], NODE + ", nodes array<long>")
    lines = elements.way_geometries(ways, points, by_key=True)
    text = lines._jdf.queryExecution().executedPlan().toString()
    scan = text.index("FileScan parquet")
    between = text[text.rindex("Exchange", 0, scan) : scan]
    # the filter by key is between the exchange of what is wanted and the scan of the points
    assert "id#" in between and "900" in between and len(lines.first().line) == 3


def test_deltas_are_made_one_and_keep_the_layout(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    store.commit({"t": spark.range(100_000).withColumn("v", F.lit(0))}, sort={"t": "id"})
    for i in range(20):
        store.commit({}, deltas={"t": (spark.range(i, i + 2), spark.range(i + 1, i + 2).withColumn("v", F.lit(i)))})
    assert len(store.manifest()["tables"]["t"]) <= 9 and store.manifest()["sort"] == {"t": ["id"]}
    assert [(r.id, r.v) for r in store.read("t").filter("id < 22").orderBy("id").collect()] == [(20, 19), (21, 0)]
    before = store.manifest()["tables"]["t"]
    store.commit({}, deltas={"t": (spark.range(0), spark.range(0).withColumn("v", F.lit(1)))})
    assert store.manifest()["tables"]["t"] == before
    store.commit({}, deltas={"t": (spark.range(50_000), spark.range(50_000).withColumn("v", F.lit(7)))})
    assert len(store.manifest()["tables"]["t"]) == 1 and store.read("t").filter("v = 7").count() == 50_000


def test_back_to_where_no_savepoint_is(spark, store):
    store.savepoint()
    store.set_properties(sequence=9)
    with pytest.raises(ValueError, match="no savepoint"):
        update.rollback_to(store, 3)
    assert len(store.manifest()["savepoints"]) == 1 and store.properties()["sequence"] == 9


def test_nodes_in_tiles_if_asked_for(spark, store):
    store.commit({"nodes": spark.createDataFrame([(1, 1, True, {"shop": "x"}), (2, 1, True, {}), (3, 1, False, {"shop": "y"})], NODE)})
    assert store.read("tiles").filter("combined_id BETWEEN 0 AND 100").count() == 0
    build.assemble_geometry(store, nodes=True)
    found = store.read("tiles").filter("combined_id BETWEEN 0 AND 100").collect()
    assert [(r.combined_id, r.level) for r in found] == [(1, 0)] and '"type":"Point"' in found[0].json


def test_a_text_in_several_tiles_is_written_once(spark, store):
    kept = {(r.combined_id, r.json) for r in store.read("tiles").collect()}
    assert store.read("tiles").filter(F.col("combined_id") == W + 11).count() > 1 and {t for i, t in kept if i == W + 11} == {None}
    places = store.read("tiles").select("level", "tile_pos", "combined_id")
    before = rows(places)
    changes = [change(5, 0, "modify", 1, 11, 2, {"highway": "y"}, [5, 6]), change(5, 1, "modify", 0, 6, 2, {"a": "b"}, x=20, y=30)]
    update.apply_changeset(store, spark.createDataFrame(changes, ch.CHANGE), 5)
    # its tiles stay as they are, and have the new text
    assert rows(store.read("tiles").select(places.columns)) == before
    whole = build.tile_rows(store)
    assert rows(whole) == rows(features.tile_rows(store.read("features"))) and whole.filter("json is null").isEmpty()
    assert '"highway":"y"' in build.tile(store, 0, 1, 1) and build.tile_rows(store, F.md5).filter("length(json) <> 32").isEmpty()
    other = store.snapshot(f"{store.root}-other")
    update.apply_changeset(other, spark.createDataFrame([change(6, 0, "modify", 1, 11, 3, {"highway": "z"}, [5, 6])], ch.CHANGE), 6)
    found = {(r.table_name, r.change): r.n for r in build.compare_stores(store, other, ["tiles", "features"]).collect()}
    assert found == {("features", "changed"): 1, ("tiles", "changed"): whole.filter(F.col("combined_id") == W + 11).count()}


def test_a_text_goes_to_its_tile_and_back(spark, store, tmp_path):
    """A line that comes to lie in one tile has its text there, and one that leaves it has it no more."""
    update.apply_changeset(store, spark.createDataFrame([change(5, 0, "modify", 0, 5, 2, x=40, y=50)], ch.CHANGE), 5)
    assert [r.json is None for r in store.read("tiles").filter(F.col("combined_id") == W + 11).collect()] == [False]
    as_rebuilt(store, tmp_path)
    update.apply_changeset(store, spark.createDataFrame([change(6, 0, "modify", 0, 5, 3, x=160_000, y=50)], ch.CHANGE), 6)
    assert [r.json is None for r in store.read("tiles").filter(F.col("combined_id") == W + 11).collect()] == [True, True]
    assert rows(build.tile_rows(store)) == rows(features.tile_rows(store.read("features")))
