import datetime

import duckdb
import pytest

from lodestone import Engine
from lodestone import errors as e
from lodestone.plans import tree as t


#: Tables of a river survey, computed by rules; expectations come from these rows or from DuckDB on the same tables.
TABLES = {
    "readings": ([("seq", "LONG"), ("probe", "STRING"), ("level", "DOUBLE"), ("depth", "INT"), ("sealed", "BOOLEAN")], [(i, f"Pr{i * 7 % 5}-{'αβÇ'[i % 3]}", i * 37 % 23 / 4, i * i % 13, i % 4 == 1) for i in range(17)]),
    "buoys": ([("tag", "INT"), ("label", "STRING"), ("basin_no", "INT"), ("mass", "INT")], [(k, f"buoy-{chr(122 - k)}", 3 * (k % 5), k * 211 % 97) for k in range(9)]),
    "basins": ([("no", "INT"), ("label", "STRING"), ("river_code", "LONG")], [(n, f"basin {n}", 10**10 + n % 4) for n in (0, 3, 6, 9, 15, 18)]),
    "rivers": ([("code", "LONG"), ("label", "STRING"), ("tidal", "BOOLEAN")], [(10**10 + n, f"Fluß {n}", n != 2) for n in range(3)]),
    "marks": ([("spot", "DOUBLE"), ("note", "STRING")], [(3.0, "a\\b"), (6.0, "7%"), (9.5, "x_y"), (18.0, "xzy")]),
    "nothing": ([("tag", "INT"), ("label", "STRING")], []),
}
KINDS = {"LONG": "bigint", "STRING": "varchar", "DOUBLE": "double", "INT": "int", "BOOLEAN": "boolean"}
ROWS = {name: [dict(zip([c for c, _ in columns], r)) for r in rows_] for name, (columns, rows_) in TABLES.items()}


@pytest.fixture(scope="module")
def engine(spark):
    out = Engine(spark)
    for name, (columns, rows_) in TABLES.items():
        out.tables.register_rows(name, columns, rows_)
    return out


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name, (columns, rows_) in TABLES.items():
        con.execute(f"create table {name} ({', '.join(f'{c} {KINDS[k]}' for c, k in columns)})")
        for r in rows_:
            con.execute(f"insert into {name} values ({', '.join('?' * len(r))})", r)
    return con


def rows(engine, sql):
    return [tuple(r) for r in engine.execute(sql).collect()]


def alike(engine, duck, ours, theirs=None, ordered=False):
    got, want = rows(engine, ours), duck.execute(theirs or ours).fetchall()
    assert (got if ordered else sorted(got, key=repr)) == (want if ordered else sorted(want, key=repr)), ours
    return got


def test_projection_and_names(engine):
    out = engine.execute("SELECT PROBE AS p, readings.depth FROM readings")
    assert out.columns == ["p", "depth"] and sorted(map(tuple, out.collect())) == sorted((r["probe"], r["depth"]) for r in ROWS["readings"])
    assert engine.execute("SELECT * FROM readings").columns == [c for c, _ in TABLES["readings"][0]]
    joined = engine.execute("SELECT * FROM buoys b JOIN basins ON b.basin_no = basins.no").columns
    assert joined == [f"b.{c}" for c, _ in TABLES["buoys"][0]] + [f"basins.{c}" for c, _ in TABLES["basins"][0]]


@pytest.mark.parametrize(
    "where,holds",
    [
        ("depth > 4", lambda r: r["depth"] > 4),
        ("depth >= 9 AND sealed = FALSE", lambda r: r["depth"] >= 9 and not r["sealed"]),
        ("probe = 'Pr0-α' OR seq = 11", lambda r: r["probe"] == "Pr0-α" or r["seq"] == 11),
        ("NOT probe = 'Pr0-α'", lambda r: r["probe"] != "Pr0-α"),
        ("level BETWEEN 1.5 AND 3.75", lambda r: 1.5 <= r["level"] <= 3.75),
        ("depth NOT BETWEEN 1 AND 9", lambda r: not 1 <= r["depth"] <= 9),
        ("probe LIKE 'Pr3%'", lambda r: r["probe"].startswith("Pr3")),
        ("probe LIKE 'pr%'", lambda r: False),
        ("probe ILIKE 'pr_-ç' OR probe ILIKE 'PR4-Β'", lambda r: r["probe"][-1] == "Ç" or r["probe"] == "Pr4-β"),
        ("probe NOT LIKE '%-α'", lambda r: r["probe"][-1] != "α"),
        ("seq IN (2, 5, 400)", lambda r: r["seq"] in (2, 5)),
        ("seq NOT IN (2, 5)", lambda r: r["seq"] not in (2, 5)),
        ("depth = 4.0", lambda r: r["depth"] == 4),
        ("depth = '4'", lambda r: False),
        ("depth != '4'", lambda r: True),
        ("depth IN ('4', 9)", lambda r: r["depth"] == 9),
        ("level > NULL", lambda r: False),
        ("probe = NULL", lambda r: False),
        ("probe != NULL", lambda r: True),
        ("NOT probe = NULL", lambda r: True),
        ("depth LIKE '1_'", lambda r: 10 <= r["depth"] <= 19),
        ("sealed = TRUE", lambda r: r["sealed"]),
        ("probe = 'Pr2-Ç'", lambda r: r["probe"] == "Pr2-Ç"),
        ("9 < seq AND level < depth", lambda r: r["seq"] > 9 and r["level"] < r["depth"]),
        ("readings.level <= 0.25", lambda r: r["level"] <= 0.25),
    ],
)
def test_where(engine, where, holds):
    assert sorted(r[0] for r in rows(engine, f"SELECT seq FROM readings WHERE {where}")) == [r["seq"] for r in ROWS["readings"] if holds(r)]


def test_like_takes_backslash_and_wildcards_as_they_are(engine):
    assert rows(engine, r"SELECT spot FROM marks WHERE note LIKE 'a\b'") == [(3.0,)]
    assert sorted(rows(engine, "SELECT spot FROM marks WHERE note LIKE 'x_y'")) == [(9.5,), (18.0,)]
    assert rows(engine, "SELECT spot FROM marks WHERE note LIKE '7%'") == [(6.0,)]


@pytest.mark.parametrize("kind", ["INNER", "LEFT", "RIGHT", "FULL"])
def test_joins(engine, duck, kind):
    """Every match once, every row without one once, padded; some keys stand on one side only."""
    got = alike(engine, duck, f"SELECT u.tag AS tag, u.label AS buoy, s.label AS basin FROM buoys u {kind} JOIN basins s ON u.basin_no = s.no")
    met = {r["basin_no"] for r in ROWS["buoys"]} & {r["no"] for r in ROWS["basins"]}
    matched = [r["tag"] for r in ROWS["buoys"] if r["basin_no"] in met]
    assert sorted(r[0] for r in got if None not in r) == matched
    assert sum(r[2] is None for r in got) == (len(ROWS["buoys"]) - len(matched)) * (kind in ("LEFT", "FULL"))
    assert sum(r[0] is None for r in got) == (len(ROWS["basins"]) - len(met)) * (kind in ("RIGHT", "FULL"))


@pytest.mark.parametrize("kind", ["LEFT", "RIGHT", "FULL"])
def test_outer_join_with_an_empty_side(engine, duck, kind):
    alike(engine, duck, f"SELECT u.label, n.label AS other FROM buoys u {kind} JOIN nothing n ON u.tag = n.tag")


def test_join_across_numeric_types(engine, duck):
    assert len(alike(engine, duck, "SELECT s.label FROM basins s JOIN marks m ON s.no = m.spot")) == 3


NULLS = [
    ("s.label = NULL", "s.label IS NULL"),
    ("s.label != 'basin 3'", "s.label IS DISTINCT FROM 'basin 3'"),
    ("s.no > 2", "COALESCE(s.no > 2, FALSE)"),
    ("NOT s.no > 4", "NOT COALESCE(s.no > 4, FALSE)"),
    ("s.no NOT IN (6)", "s.no IS DISTINCT FROM 6"),
    ("s.no IN (9, NULL)", "(s.no = 9 OR s.no IS NULL)"),
    ("s.label NOT LIKE '%3'", "COALESCE(s.label NOT LIKE '%3', FALSE)"),
    ("s.no NOT BETWEEN 1 AND 6", "COALESCE(s.no NOT BETWEEN 1 AND 6, FALSE)"),
]


@pytest.mark.parametrize("ours,theirs", NULLS)
def test_null_after_outer_join(engine, duck, ours, theirs):
    base = "SELECT u.tag FROM buoys u LEFT JOIN basins s ON u.basin_no = s.no WHERE "
    assert alike(engine, duck, base + ours, base + theirs)


def test_null_keys_meet_in_a_chain(engine, duck):
    """Padding on both sides of a later condition is equal."""
    chain = "SELECT u.tag, x.code AS other FROM buoys u LEFT JOIN basins s ON u.basin_no = s.no LEFT JOIN rivers r ON s.river_code = r.code LEFT JOIN rivers x ON "
    got = alike(engine, duck, chain + "r.code = x.code", chain + "r.code IS NOT DISTINCT FROM x.code")
    assert any(r[1] is None for r in got)
    got = rows(engine, "SELECT u.tag, v.tag AS other FROM buoys u LEFT JOIN basins s ON u.basin_no = s.no FULL JOIN buoys v ON s.no = v.basin_no")
    want = duck.execute("SELECT u.tag, v.tag FROM buoys u LEFT JOIN basins s ON u.basin_no = s.no FULL JOIN buoys v ON s.no IS NOT DISTINCT FROM v.basin_no").fetchall()
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_left_join_counts_no_padding(engine, duck):
    got = dict(alike(engine, duck, "SELECT s.label, COUNT(u.tag) AS n FROM basins s LEFT JOIN buoys u ON s.no = u.basin_no GROUP BY s.label"))
    assert 0 in got.values() and sum(got.values()) < len(ROWS["buoys"])


def test_three_tables(engine, duck):
    sql = "SELECT r.label, COUNT(*) AS n, SUM(u.mass) AS s, AVG(u.mass) AS a, MIN(u.mass) AS lo, MAX(u.mass) AS hi FROM buoys u JOIN basins s ON u.basin_no = s.no JOIN rivers r ON s.river_code = r.code WHERE r.tidal = TRUE GROUP BY r.label"
    assert len(alike(engine, duck, sql)) > 0


def test_aggregates(engine, duck):
    alike(engine, duck, "SELECT COUNT(*) AS n, SUM(level) AS s, AVG(depth) AS a, MIN(probe) AS lo, MAX(level) AS hi FROM readings")
    assert rows(engine, "SELECT COUNT(*) AS n, SUM(tag) AS s, AVG(tag) AS a, MIN(label) AS lo, MAX(tag) AS hi FROM nothing") == [(0, 0.0, 0.0, None, None)]
    assert rows(engine, "SELECT label, COUNT(*) AS n FROM nothing GROUP BY label") == []
    types = dict(engine.execute("SELECT COUNT(depth), SUM(depth), AVG(depth), MIN(depth), MAX(probe) FROM readings").dataframe.dtypes)
    assert types == {"count_depth": "bigint", "sum_depth": "double", "avg_depth": "double", "min_depth": "int", "max_probe": "string"}


def test_having_order_limit(engine, duck):
    alike(engine, duck, "SELECT probe, COUNT(*) AS times FROM readings WHERE sealed = FALSE GROUP BY probe HAVING times > 1 ORDER BY times DESC, probe LIMIT 2", "SELECT probe, COUNT(*) AS times FROM readings WHERE NOT sealed GROUP BY probe HAVING COUNT(*) > 1 ORDER BY times DESC, probe LIMIT 2", ordered=True)
    alike(engine, duck, "SELECT probe FROM readings GROUP BY probe HAVING AVG(level) > 2.5 ORDER BY MAX(level) DESC, probe", ordered=True)
    alike(engine, duck, "SELECT probe, mass FROM readings e JOIN buoys u ON e.seq = u.tag GROUP BY probe, u.mass ORDER BY probe, mass LIMIT 3", ordered=True)


@pytest.mark.parametrize("way,nulls", [("ASC", "LAST"), ("DESC", "FIRST")])
def test_order_puts_null_last_ascending_and_first_descending(engine, duck, way, nulls):
    base = "SELECT u.tag, s.label AS d FROM buoys u LEFT JOIN basins s ON u.basin_no = s.no ORDER BY d "
    got = alike(engine, duck, base + f"{way}, u.tag", base + f"{way} NULLS {nulls}, u.tag", ordered=True)
    assert got[0 if way == "DESC" else -1][1] is None


def test_limits(engine, duck):
    assert rows(engine, "SELECT seq FROM readings ORDER BY seq LIMIT 0") == []
    assert len(rows(engine, "SELECT seq FROM readings LIMIT 99")) == len(ROWS["readings"])
    alike(engine, duck, "SELECT probe FROM readings ORDER BY readings.level DESC FETCH NEXT 1 ROW ONLY", "SELECT probe FROM readings ORDER BY level DESC LIMIT 1")


def test_statement_helpers(engine):
    low = t.Comparison("<", t.ColumnRef("depth"), t.Literal(2))
    assert engine.execute(t.select_all("readings", low)).columns == [c for c, _ in TABLES["readings"][0]]
    got = engine.execute(t.select_columns("readings", "readings.seq", "depth", where=low)).collect()
    assert sorted(map(tuple, got)) == [(r["seq"], r["depth"]) for r in ROWS["readings"] if r["depth"] < 2]


def test_statement_objects(engine, duck):
    s = t.Select(
        t.TableRef("buoys", "u"),
        (t.SelectItem(t.ColumnRef("label", "s"), "d"), t.SelectItem(t.AggregateCall("COUNT"), "n")),
        (t.Join(t.JoinKind.LEFT, t.TableRef("basins", "s"), t.And(t.Comparison("=", t.ColumnRef("basin_no", "u"), t.ColumnRef("no", "s")), t.Comparison(">", t.ColumnRef("mass", "u"), t.Literal(40)))),),
        group_by=(t.ColumnRef("label", "s"),),
    )
    assert {tuple(r) for r in engine.execute(s).collect()} == set(duck.execute("SELECT s.label, COUNT(*) FROM buoys u LEFT JOIN basins s ON u.basin_no = s.no AND u.mass > 40 GROUP BY s.label").fetchall())


@pytest.mark.parametrize(
    "sql,error",
    [
        ("SELECT width FROM readings", e.UnknownColumn),
        ("SELECT x.seq FROM readings", e.UnknownColumn),
        ("SELECT seq FROM lakes", e.TableNotFound),
        ("SELECT label FROM buoys u JOIN basins s ON u.basin_no = s.no", e.AmbiguousColumn),
        ("SELECT u.tag FROM buoys u JOIN basins s ON u.basin_no = s.no WHERE label = 'x'", e.AmbiguousColumn),
        ("SELECT COUNT(*) AS n FROM buoys u JOIN basins s ON u.basin_no = s.no GROUP BY label", e.AmbiguousColumn),
        ("SELECT seq, depth AS SEQ FROM readings", e.DuplicateColumn),
        ("SELECT COUNT(*), COUNT(*) FROM readings", e.DuplicateColumn),
        ("SELECT * FROM buoys u JOIN nothing u ON u.tag = u.tag", e.DuplicateColumn),
        ("SELECT probe, COUNT(*) AS n FROM readings", e.AggregationError),
        ("SELECT * FROM readings GROUP BY probe", e.AggregationError),
        ("SELECT probe FROM readings GROUP BY probe HAVING depth > 1", e.AggregationError),
        ("SELECT SUM(probe) AS s FROM readings", e.TypeError_),
        ("SELECT AVG(sealed) AS s FROM readings", e.TypeError_),
        ("SELECT seq FROM readings WHERE probe > 5", e.TypeError_),
        ("SELECT seq FROM readings WHERE depth BETWEEN 'a' AND 'b'", e.TypeError_),
        ("SELECT u.tag FROM buoys u JOIN basins s ON u.tag = 5", e.ParseError),
        ("SELECT u.tag FROM buoys u JOIN basins s ON u.tag = u.basin_no", e.ParseError),
        ("SELECT seq FROM readings ORDER BY COUNT(*)", e.ParseError),
        ("INSERT INTO readings (seq) VALUES (1)", e.NoDatabaseSelected),
    ],
)
def test_errors(engine, sql, error):
    with pytest.raises(error):
        engine.execute(sql)


def test_both_limits_and_having_in_objects(engine):
    of = t.TableRef("readings")
    for bad in (t.Select(of, limit=1, fetch=1), t.Select(of, limit=-1), t.Select(of, having=t.Literal(True)), t.Select(of, items=())):
        with pytest.raises(e.ParseError):
            engine.execute(bad)
    with pytest.raises(e.QueryError):
        engine.execute(None)


def test_memory_tables_are_checked(spark):
    tables = Engine(spark).tables
    with pytest.raises(e.InvalidSchema):
        tables.register_rows("t", [("a", "INT")], [(1, 2)])
    with pytest.raises(e.InvalidSchema):
        tables.register_rows("t", [("a", "INT")], [(None,)])
    with pytest.raises(e.InvalidSchema):
        tables.register_rows("t", [], [])
    with pytest.raises(e.InvalidSchema):
        tables.register_rows("t", [("a", "BLOB")], [])
    with pytest.raises(e.DuplicateColumn):
        tables.register_rows("t", [("a", "INT"), ("A", "INT")], [])


def test_source_callback_and_timestamps(spark):
    engine = Engine(spark)
    frame = spark.createDataFrame([(1, datetime.datetime(2024, 1, 2, 3)), (2, datetime.datetime(2024, 5, 1))], "id int, at timestamp_ntz")
    engine.tables.register_source(lambda name: frame if name == "moments" else None)
    assert engine.sql("SELECT id FROM moments WHERE at >= '2024-02-01'").collect()[0].id == 2
    with pytest.raises(e.TypeError_):
        engine.sql("SELECT id FROM moments WHERE at > 'soon'")


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    spark.range(100).selectExpr("id", "id % 7 AS k", "cast(id AS string) AS s").write.parquet(str(tmp_path / "t.parquet"))
    engine = Engine(spark)
    engine.tables.register_parquet(str(tmp_path), ["t"])
    plan = engine.sql("SELECT id FROM t WHERE k = 3 AND id > 10 OR k IN (1, 2)")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<id:bigint,k:bigint>" in plan and "GreaterThan(id,10)" in plan and "EqualTo(k,3)" in plan
    joined = engine.sql("SELECT a.id FROM t a JOIN t b ON a.id = b.k WHERE b.s = '5'")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(s,5)" in joined and "NestedLoop" not in joined


def test_advice(engine):
    advice = engine.explain_rules("SELECT u.label FROM buoys u JOIN basins s ON u.basin_no = s.no JOIN rivers r ON u.tag = r.code WHERE u.mass > 5 AND s.label = 'x' OR r.code = 1", {"rivers": 3, "basins": 60})
    assert advice.order == ["r", "s"] and "R3" not in advice.applied and {"R1", "R2", "R4", "R5", "R6"} <= set(advice.applied)
    pushed = engine.explain_rules("SELECT u.label FROM buoys u LEFT JOIN basins s ON u.basin_no = s.no WHERE u.mass > 5 AND s.label = 'x'")
    assert set(pushed.pushed) == {"u", "s"} and pushed.columns["u"] == {"label", "basin_no", "mass"}
    with pytest.raises(e.ParseError):
        engine.explain_rules("SELECT * FROM buoys u JOIN basins s ON basin_no = river_code")
