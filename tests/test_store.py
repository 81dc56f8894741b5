import pytest

from lodestone import Engine
from lodestone import errors as e
from lodestone.operators.indexes import IndexKind


COLUMNS = "serial LONG, goods STRING, weight DOUBLE, slots INT, sealed BOOLEAN"
#: Crates by a rule; row k has the row id k.
CRATES = [(500 + 11 * k, f"{('Öl', 'tea', 'salt')[k % 3]} #{k // 3}", k * 1.25, (k * k) % 7, k % 2 == 0) for k in range(6)]


def literal(v):
    return str(v).upper() if isinstance(v, bool) else f"'{v}'" if isinstance(v, str) else str(v)


def add(engine, *values):
    return engine.execute(f"INSERT INTO crates (serial, goods, weight, slots, sealed) VALUES ({', '.join(map(literal, values))})")


@pytest.fixture
def engine(spark, tmp_path):
    out = Engine(spark, f"file://{tmp_path}/warehouse")
    for sql in ("CREATE DATABASE port", "USE port", f"CREATE TABLE crates ({COLUMNS})"):
        out.execute(sql)
    for r in CRATES:
        assert add(out, *r).affected_rows == 1
    return out


def crates(engine, where="serial > 0"):
    return sorted(tuple(r) for r in engine.sql(f"SELECT * FROM crates WHERE {where}").collect())


def test_changes_persist(engine, spark):
    grow = lambda r: r[3] >= 2 and not r[1].startswith("tea")
    want = [(s, g, 77.5, 6, z) if grow((s, g, w, n, z)) else (s, g, w, n, z) for s, g, w, n, z in CRATES]
    assert engine.execute("UPDATE crates SET weight = 77.5, slots = 6 WHERE slots >= 2 AND NOT goods LIKE 'tea%'").affected_rows == sum(map(grow, CRATES))
    drop = lambda r: r[1].startswith("Öl") or r[3] in (1,)
    assert engine.execute("DELETE FROM crates WHERE goods LIKE 'Ö%' OR crates.slots IN (1)").affected_rows == sum(map(drop, want))
    want = [r for r in want if not drop(r)]
    again = Engine(spark, engine.store.root)
    again.execute("USE DATABASE port")
    assert crates(again) == sorted(want)
    assert again.execute("DELETE FROM crates").affected_rows == len(want)
    assert crates(again) == []
    again.execute("INSERT INTO crates (sealed, slots, goods, serial, weight) VALUES (FALSE, 3, 'd''Or', 7, 2.5)")
    assert crates(again, "goods = 'd''Or'") == [(7, "d'Or", 2.5, 3, False)]
    assert again.stored("crates").rows(with_rid=True).collect()[0]._rid == len(CRATES)  # ids aren't used again


def test_nothing_matches(engine):
    before = engine.stored("crates").manifest().version
    assert engine.execute("UPDATE crates SET slots = 1 WHERE serial = 1").affected_rows == 0
    assert engine.execute("DELETE FROM crates WHERE serial = 1").affected_rows == 0
    assert engine.stored("crates").manifest().version == before


def test_only_touched_files_are_rewritten(engine):
    before = set(engine.stored("crates").manifest().files)
    engine.execute(f"UPDATE crates SET slots = 9 WHERE serial = {CRATES[2][0]}")
    assert len(before & set(engine.stored("crates").manifest().files)) == len(CRATES) - 1


def test_records(engine):
    table = engine.stored("crates")
    table.delete_record(1)
    table.update_record(0, (1, "moved", 0.5, 4, False))
    assert table.active_count() == len(CRATES) - 1 and table.total_count() == len(CRATES)
    assert table.contains(1) and not table.is_active(1) and not table.contains(99)
    assert {(r._rid, r._deleted) for r in table.all_rows().collect()} == {(k, k == 1) for k in range(len(CRATES))}
    assert table.need_record(0).goods == "moved"
    place = table.place_of(2)
    assert table.at(*place).goods == CRATES[2][1]
    for bad in (lambda: table.need_record(1), lambda: table.delete_record(1), lambda: table.place_of(1), lambda: table.at("nowhere", 0)):
        with pytest.raises(e.RecordNotFound):
            bad()
    assert table.rows(version=len(CRATES)).count() == len(CRATES)  # as it was


def test_changes_by_place(engine):
    table = engine.stored("crates")
    rid, file, position = table.insert_with_place((9, "new", 1.0, 1, True))
    assert rid == len(CRATES) and table.at(file, position).goods == "new"
    moved = table.update_at(file, position, (9, "changed", 1.0, 1, True))
    assert table.at(*moved).goods == "changed" and table.need_record(rid).goods == "changed"
    table.delete_at(*moved)
    assert not table.is_active(rid) and table.contains(rid)
    with pytest.raises(e.RecordNotFound):
        table.delete_at(*moved)


def test_statistics_and_vacuum(engine):
    table = engine.stored("crates")
    engine.execute("UPDATE crates SET slots = 0")
    engine.execute("DELETE FROM crates WHERE sealed = TRUE")
    before, stats = crates(engine), table.statistics()
    assert (stats["row_count"], stats["deleted_count"], stats["version"]) == (3, 3, len(CRATES) + 2) and stats["bytes"] > 0
    assert table.vacuum(keep=1) == 0  # all files are young
    with pytest.raises(e.CorruptManifest):
        table.rows(version=1)
    engine.execute("UPDATE crates SET slots = 5")
    assert table.vacuum(keep=1, older_than=-60) > 0
    assert crates(engine) == [(*r[:3], 5, r[4]) for r in before] and table.all_rows().count() == len(CRATES)


def test_lost_or_stale_hint(engine):
    """The newest version is found without the hint, and behind an old one."""
    table = engine.stored("crates")
    now = table.manifest().version
    for text in ("0", "nonsense", "999"):
        table.fs.create(f"{table.path}/_latest", text, replace=True)
        assert table.manifest().version == now
    table.fs.remove(f"{table.path}/_latest")
    assert table.manifest().version == now


def test_append_frames(engine, spark):
    engine.execute("CREATE TABLE big (id LONG, x DOUBLE)")
    big = engine.stored("big")
    assert big.append(spark.range(1000).selectExpr("id", "id * 0.5 AS x").repartition(7)) == 1000
    assert big.append(spark.range(0).selectExpr("id", "1.0 AS x")) == 0
    assert big.append(spark.range(3).selectExpr("id", "id * 1.0 AS x")) == 3
    rids = sorted(r._rid for r in big.rows(with_rid=True).collect())
    assert rids == list(range(1003)) and big.active_count() == 1003
    big.merge()
    assert big.rows().count() == 1003 and len(big.manifest().files) < 9


def test_all_types(engine):
    engine.execute("CREATE TABLE kinds (a INTEGER, b BIGINT, c REAL, d BOOL, e VARCHAR)")
    engine.execute("INSERT INTO kinds (a, b, c, d, e) VALUES (-17, 123456789012, 0.375, TRUE, 'Größe ≥ 3 𝄞')")
    engine.execute("INSERT INTO kinds (a, b, c, d, e) VALUES (1, 2, 3, FALSE, '')")  # widened
    assert {tuple(r) for r in engine.sql("SELECT * FROM kinds").collect()} == {(-17, 123456789012, 0.375, True, "Größe ≥ 3 𝄞"), (1, 2, 3.0, False, "")}
    assert engine.sql("SELECT * FROM kinds").dtypes == [("a", "int"), ("b", "bigint"), ("c", "double"), ("d", "boolean"), ("e", "string")]


@pytest.mark.parametrize(
    "sql,error",
    [
        ("INSERT INTO crates (serial, goods) VALUES (1, 'x')", e.InsertError),
        ("INSERT INTO crates (serial, goods) VALUES (1)", e.InsertError),
        ("INSERT INTO crates (serial, serial, weight, slots, sealed) VALUES (1, 2, 3, 4, TRUE)", e.InsertError),
        ("INSERT INTO crates (serial, colour, weight, slots, sealed) VALUES (1, 'n', 3, 4, TRUE)", e.InsertError),
        ("INSERT INTO crates (serial, goods, weight, slots, sealed) VALUES ('1', 'n', 3, 4, TRUE)", e.InsertError),
        ("INSERT INTO crates (serial, goods, weight, slots, sealed) VALUES (1, NULL, 3, 4, TRUE)", e.InsertError),
        ("INSERT INTO crates (serial, goods, weight, slots, sealed) VALUES (1, 'n', 3, 9000000000, TRUE)", e.InsertError),
        ("INSERT INTO crates (serial, goods, weight, slots, sealed) VALUES (1.5, 'n', 3, 4, TRUE)", e.InsertError),
        ("UPDATE crates SET slots = 'many'", e.UpdateError),
        ("UPDATE crates SET slots = NULL", e.UpdateError),
        ("UPDATE crates SET slots = 1, slots = 2", e.ParseError),
        ("UPDATE crates SET colour = 'x'", e.UnknownColumn),
        ("DELETE FROM crates WHERE colour = 'x'", e.UnknownColumn),
        ("DELETE FROM crates WHERE other.serial = 1", e.UnknownColumn),
        ("DELETE FROM quays", e.TableNotFound),
        ("CREATE TABLE crates (serial INT)", e.AlreadyExists),
        ("CREATE TABLE t (serial INT, SERIAL INT)", e.DuplicateColumn),
        ("CREATE TABLE t (serial BLOB)", e.InvalidSchema),
        ("CREATE DATABASE port", e.AlreadyExists),
        ("CREATE DATABASE _x", e.InvalidSchema),
        ("USE harbour", e.DatabaseNotFound),
        ("DROP DATABASE harbour", e.DatabaseNotFound),
        ("DROP TABLE quays", e.TableNotFound),
    ],
)
def test_errors(engine, sql, error):
    with pytest.raises(error):
        engine.execute(sql)


def test_drop_and_recreate(engine):
    engine.indexes.create("by_goods", "port", "crates", "goods")
    engine.execute("DROP TABLE crates")
    assert engine.indexes.known == {}
    engine.execute("CREATE TABLE crates (serial INT)")
    assert engine.sql("SELECT * FROM crates").collect() == []
    assert engine.store.tables("port") == ["crates"] and engine.store.databases() == ["port"]
    engine.indexes.create("by_serial", "port", "crates", "serial")
    engine.execute("DROP DATABASE port")
    assert engine.database is None and engine.store.databases() == [] and engine.indexes.known == {}
    with pytest.raises(e.NoDatabaseSelected):
        engine.execute("DELETE FROM crates")


def test_one_of_two_writers_wins(engine):
    table = engine.stored("crates")
    before = table.manifest()
    table._commit(before)
    with pytest.raises(e.EngineError):
        table._commit(before)


def test_many_writers_put_one_manifest(engine):
    from concurrent.futures import ThreadPoolExecutor

    table = engine.stored("crates")
    at = table._at(table.manifest().version + 1)
    with ThreadPoolExecutor(8) as pool:
        won = list(pool.map(lambda k: table.fs.create(at, "x" * 10_000 + str(k)), range(24)))
    assert sum(won) == 1 and table.fs.read(at) == "x" * 10_000 + str(won.index(True))


def test_damaged_manifest(engine):
    table = engine.stored("crates")
    table.fs.create(table._at(table.manifest().version + 1), '{"table": 1}')
    with pytest.raises(e.CorruptManifest):
        table.rows()


def test_indexes(engine):
    ix = engine.indexes
    ix.create("by_slots", "port", "crates", "slots")
    ix.create("by_serial", "port", "crates", "serial", IndexKind.PRIMARY)
    two = [k for k, r in enumerate(CRATES) if r[3] == 2]
    assert len(two) > 1 and sorted(r.rid for r in ix.search("by_slots", 2).collect()) == two
    assert sorted(tuple(r) for r in ix.resolve("by_slots", 2).collect()) == [CRATES[k] for k in two]
    assert [(r.key, r.rid) for r in ix.entries("by_serial").collect()] == [(r[0], k) for k, r in enumerate(CRATES)]
    later = Engine(engine.spark, engine.store.root).indexes
    assert later.get("BY_SERIAL").kind is IndexKind.PRIMARY and [r.rid for r in later.search("by_serial", CRATES[3][0]).collect()] == [3]
    ix.insert("by_serial", 5, 77)
    ix.update("by_serial", 5, 6, 77)
    assert ix.resolve("by_serial", 6).collect() == [] and ix.delete("by_serial", 6) == 1 and ix.search("by_serial", 6).count() == 0
    assert len(ix.of_table("port", "crates")) == 2 and len(ix.of_column("port", "crates", "SLOTS")) == 1
    taken = CRATES[0][0]
    for bad in (lambda: ix.create("by_serial", "port", "crates", "serial"), lambda: ix.create("u", "port", "crates", "slots", IndexKind.UNIQUE), lambda: ix.insert("by_serial", taken, 9), lambda: ix.search("none", 1), lambda: ix.update("by_serial", 40, 41, 1), lambda: ix.drop("none"), lambda: ix.insert("by_serial", None, 1)):
        with pytest.raises(e.IndexError_):
            bad()
    with pytest.raises(e.UnknownColumn):
        ix.create("x", "port", "crates", "colour")
    assert ix.drop_of_table("port", "crates") == 2 and ix.known == {}
    assert Engine(engine.spark, engine.store.root).indexes.known == {}


@pytest.mark.parametrize("few", [1000, 0])
def test_indexes_follow_changes(engine, monkeypatch, few):
    from lodestone.operators import indexes

    monkeypatch.setattr(indexes, "FEW", few)
    ix = engine.indexes
    ix.create("by_slots", "port", "crates", "slots")
    ix.create("by_serial", "port", "crates", "serial", IndexKind.UNIQUE)
    check = lambda: [sorted(map(tuple, ix.resolve("by_slots", k).collect())) == crates(engine, f"slots = {k}") for k in range(9)]
    engine.execute(f"UPDATE crates SET slots = 8 WHERE serial = {CRATES[1][0]}")
    assert all(check()) and ix.resolve("by_slots", 8).count() == 1
    add(engine, 3, "late", 1.0, 8, True)
    engine.execute("DELETE FROM crates WHERE slots = 2")
    assert all(check()) and ix.search("by_slots", 2).count() == 0 and ix.search("by_slots", 8).count() == 2
    engine.execute("UPDATE crates SET slots = 1")
    engine.stored("crates").merge()
    assert all(check()) and ix.entries("by_slots").count() == engine.stored("crates").active_count()
    engine.execute("UPDATE crates SET serial = 4 WHERE sealed = TRUE")
    with pytest.raises(e.IndexError_):
        ix.search("by_serial", 4)


def test_an_index_reads_the_files_of_its_entries_only(engine):
    ix = engine.indexes
    ix.create("by_serial", "port", "crates", "serial")
    plan = ix.resolve("by_serial", CRATES[2][0])
    assert len(plan.inputFiles()) == 1 and [tuple(r) for r in plan.collect()] == [CRATES[2]]


def test_stream(engine, spark, tmp_path):
    from lodestone.streaming import start, streaming_select

    spark.range(10).selectExpr("id", "id % 3 AS k").write.parquet(str(tmp_path / "in"))
    engine.tables.register("moving", spark.readStream.schema("id long, k long").parquet(str(tmp_path / "in")))
    start(engine, "SELECT id FROM moving WHERE k = 1", str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 4, 7]
    with pytest.raises(e.QueryError):
        streaming_select(engine, "SELECT id FROM moving LIMIT 1")
