"""The registered queries of the relational engine and their SQL twins.

Sums and means of doubles depend on the order of addition, so both sides round them to two places.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import EngineError
from .operators.indexes import IndexKind
from .plans.parser import parse
from .session import Engine

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
Query = Callable[[SparkSession, str], DataFrame]

#: name: (the engine's statement, the twin's SQL or None if the text is the same, columns to round)
SELECTS: dict[str, tuple[str, str | None, tuple[str, ...]]] = {
    # scans and projections
    "scan_all": ("SELECT * FROM region", None, ()),
    "project_columns": ("SELECT c_custkey, c_name FROM customer", None, ()),
    "project_alias": ("SELECT c_custkey AS id, c_name label FROM customer c", None, ()),
    "case_insensitive_columns": ("SELECT C_CUSTKEY AS id, Customer.C_Name AS name FROM CUSTOMER", None, ()),
    "passthrough_types": ("SELECT vec_id, embedding, label FROM embeddings WHERE label >= 1", None, ()),
    # predicates
    "filter_eq": ("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F'", None, ()),
    "filter_ne": ("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus != 'F'", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IS DISTINCT FROM 'F'", ()),
    "filter_ne_brackets": ("SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'O'", "SELECT o_orderkey FROM orders WHERE o_orderstatus IS DISTINCT FROM 'O'", ()),
    "filter_gt": ("SELECT o_orderkey FROM orders WHERE o_totalprice > 200000.5", None, ()),
    "filter_lt": ("SELECT o_orderkey FROM orders WHERE o_totalprice < 20000", None, ()),
    "filter_ge": ("SELECT p_partkey, p_size FROM part WHERE p_size >= 25", None, ()),
    "filter_le": ("SELECT p_partkey, p_size FROM part WHERE p_size <= 5", None, ()),
    "filter_between": ("SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 10 AND 20", None, ()),
    "filter_not_between": ("SELECT p_partkey, p_size FROM part WHERE p_size NOT BETWEEN 10 AND 20", None, ()),
    "filter_in": ("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')", None, ()),
    "filter_not_in": ("SELECT o_orderkey FROM orders WHERE o_orderstatus NOT IN ('F', 'P')", None, ()),
    "filter_like": ("SELECT c_custkey, c_name FROM customer WHERE c_name LIKE '%0_1%'", None, ()),
    "filter_not_like": ("SELECT c_custkey FROM customer WHERE c_name NOT LIKE '%1'", None, ()),
    "filter_ilike": ("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment ILIKE 'buil%'", None, ()),
    "filter_not_ilike": ("SELECT c_custkey FROM customer WHERE c_mktsegment NOT ILIKE '%o%'", None, ()),
    "filter_like_number": ("SELECT p_partkey FROM part WHERE p_size LIKE '1%'", "SELECT p_partkey FROM part WHERE CAST(p_size AS VARCHAR) LIKE '1%'", ()),
    "filter_and": ("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 100000", None, ()),
    "filter_or": ("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' OR o_totalprice > 300000", None, ()),
    "filter_not": ("SELECT o_orderkey FROM orders WHERE NOT o_orderstatus = 'O'", None, ()),
    "filter_precedence": ("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' OR o_orderstatus = 'F' AND NOT o_totalprice < 150000", None, ()),
    "filter_parens": ("SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'P' OR o_orderstatus = 'F') AND o_totalprice > 150000", None, ()),
    "filter_numeric_promotion": ("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity = 10 AND l_linenumber > 1.5", None, ()),
    "filter_mixed_types": ("SELECT p_partkey FROM part WHERE p_size = '5' OR p_size = 7", "SELECT p_partkey FROM part WHERE p_size = 7", ()),
    "filter_col_to_col": ("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey > l_suppkey AND l_discount = l_tax", None, ()),
    "filter_literal_left": ("SELECT p_partkey FROM part WHERE 40 < p_size", None, ()),
    "filter_timestamp": ("SELECT o_orderkey FROM orders WHERE o_orderdate >= '1996-01-01' AND o_orderdate < '1997-01-01'", None, ()),
    "filter_quote": ("SELECT c_custkey FROM customer WHERE c_name != 'O''Brien'", "SELECT c_custkey FROM customer WHERE c_name IS DISTINCT FROM 'O''Brien'", ()),
    # joins
    "join_inner": ("SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey", None, ()),
    "join_left": ("SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id", None, ()),
    "join_right": ("SELECT l.doc_id AS labelled, d.doc_id AS doc_id FROM labels l RIGHT JOIN documents d ON l.doc_id = d.doc_id", None, ()),
    "join_full": ("SELECT c.c_custkey, s.s_suppkey FROM customer c FULL OUTER JOIN supplier s ON c.c_custkey = s.s_suppkey", None, ()),
    "join_chain3": (
        "SELECT c.c_custkey, n.n_name, r.r_name FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey",
        None,
        (),
    ),
    "join_chain_mixed": (
        "SELECT n.n_name, s.s_name, c.c_name FROM nation n LEFT JOIN supplier s ON n.n_nationkey = s.s_suppkey FULL JOIN customer c ON s.s_suppkey = c.c_custkey",
        "SELECT n.n_name, s.s_name, c.c_name FROM nation n LEFT JOIN supplier s ON n.n_nationkey = s.s_suppkey FULL JOIN customer c ON s.s_suppkey = c.c_custkey",
        (),
    ),
    "join_self": ("SELECT a.n_name AS one, b.n_name AS two FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey", None, ()),
    "join_theta": ("SELECT a.n_nationkey AS low, b.n_nationkey AS high FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey", None, ()),
    "join_select_star": (
        "SELECT * FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey",
        'SELECT n.n_nationkey AS "n.n_nationkey", n.n_name AS "n.n_name", n.n_regionkey AS "n.n_regionkey", r.r_regionkey AS "r.r_regionkey", r.r_name AS "r.r_name" FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey',
        (),
    ),
    "join_where": ("SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE c.c_acctbal > 5000 AND o.o_orderstatus = 'F'", None, ()),
    "join_key_promotion": ("SELECT n.n_name, s.s_name FROM nation n JOIN supplier s ON n.n_nationkey = s.s_suppkey", None, ()),
    "join_table_name_qualifier": ("SELECT orders.o_orderkey, customer.c_mktsegment FROM orders JOIN customer ON orders.o_custkey = customer.c_custkey", None, ()),
    # NULL after outer joins
    "null_eq_after_left": ("SELECT d.doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality = NULL", "SELECT d.doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality IS NOT DISTINCT FROM NULL", ()),
    "null_ne_after_left": ("SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality != 1", "SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality IS DISTINCT FROM 1", ()),
    "null_gt_after_right": ("SELECT d.doc_id FROM labels l RIGHT JOIN documents d ON l.doc_id = d.doc_id WHERE NOT l.quality > 0", "SELECT d.doc_id FROM labels l RIGHT JOIN documents d ON l.doc_id = d.doc_id WHERE NOT COALESCE(l.quality > 0, FALSE)", ()),
    "null_not_in_after_left": ("SELECT d.doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality NOT IN (1, 7)", "SELECT d.doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE NOT COALESCE(l.quality IN (1, 7), FALSE)", ()),
    "null_not_like_after_left": ("SELECT c.c_custkey FROM customer c LEFT JOIN supplier s ON c.c_custkey = s.s_suppkey WHERE s.s_name NOT LIKE '%7%'", "SELECT c.c_custkey FROM customer c LEFT JOIN supplier s ON c.c_custkey = s.s_suppkey WHERE COALESCE(s.s_name NOT LIKE '%7%', FALSE)", ()),
    "null_not_between_after_left": ("SELECT d.doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE NOT l.quality BETWEEN 1 AND 2", "SELECT d.doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE NOT COALESCE(l.quality BETWEEN 1 AND 2, FALSE)", ()),
    # aggregates
    "agg_count_star": ("SELECT COUNT(*) AS n FROM lineitem", None, ()),
    "agg_count_col": ("SELECT COUNT(l_orderkey) AS n FROM lineitem", None, ()),
    "agg_sum": ("SELECT SUM(l_quantity) AS s, SUM(l_linenumber) AS k FROM lineitem", "SELECT SUM(l_quantity) AS s, SUM(CAST(l_linenumber AS DOUBLE)) AS k FROM lineitem", ("s", "k")),
    "agg_avg": ("SELECT AVG(l_extendedprice) AS a FROM lineitem", None, ("a",)),
    "agg_min": ("SELECT MIN(l_extendedprice) AS low, MIN(l_shipdate) AS first_day FROM lineitem", None, ()),
    "agg_max": ("SELECT MAX(l_extendedprice) AS high, MAX(l_shipdate) AS last_day FROM lineitem", None, ()),
    "agg_minmax_string": ("SELECT MIN(c_name) AS first_name, MAX(c_mktsegment) AS last_segment FROM customer", None, ()),
    "agg_empty_defaults": (
        "SELECT COUNT(*) AS n, SUM(o_totalprice) AS s, AVG(o_totalprice) AS a, MIN(o_totalprice) AS low, MAX(o_orderstatus) AS high FROM orders WHERE o_totalprice < 0",
        "SELECT COUNT(*) AS n, COALESCE(SUM(o_totalprice), 0.0) AS s, COALESCE(AVG(o_totalprice), 0.0) AS a, MIN(o_totalprice) AS low, MAX(o_orderstatus) AS high FROM orders WHERE o_totalprice < 0",
        (),
    ),
    "agg_group_single": ("SELECT o_orderstatus, COUNT(*) AS n, SUM(o_totalprice) AS s FROM orders GROUP BY o_orderstatus", None, ("s",)),
    "agg_group_multi": ("SELECT l_returnflag, l_linestatus, COUNT(*) AS n, AVG(l_discount) AS a, MAX(l_quantity) AS m FROM lineitem GROUP BY l_returnflag, l_linestatus", None, ("a",)),
    "agg_where_then_group": ("SELECT p_brand, COUNT(*) AS n FROM part WHERE p_size > 25 GROUP BY p_brand", None, ()),
    "agg_group_without_aggregate": ("SELECT c_mktsegment FROM customer GROUP BY c_mktsegment", None, ()),
    "agg_join_group": ("SELECT n.n_name, COUNT(*) AS n, SUM(c.c_acctbal) AS s FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey GROUP BY n.n_name", None, ("s",)),
    "agg_multi_join_group": (
        "SELECT r.r_name, COUNT(*) AS n, MIN(c.c_acctbal) AS low, MAX(c.c_acctbal) AS high, AVG(c.c_acctbal) AS a FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY r.r_name",
        None,
        ("a",),
    ),
    "agg_count_skips_padding": ("SELECT d.lang, COUNT(*) AS docs, COUNT(l.quality) AS labelled FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY d.lang", None, ()),
    "agg_global_join": ("SELECT COUNT(*) AS n, SUM(l.l_quantity) AS q FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey WHERE o.o_orderstatus = 'F'", None, ("q",)),
    "agg_null_group": ("SELECT l.quality, COUNT(*) AS n FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY l.quality", None, ()),
    "agg_default_names": ("SELECT o_orderstatus, COUNT(*), MAX(o_totalprice) FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, COUNT(*) AS count_all, MAX(o_totalprice) AS max_o_totalprice FROM orders GROUP BY o_orderstatus", ()),
    # HAVING
    "having_alias": ("SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING n > 12", "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 12", ()),
    "having_aggregate": ("SELECT o_custkey FROM orders GROUP BY o_custkey HAVING COUNT(*) > 12 AND MAX(o_totalprice) > 100000", None, ()),
    "having_between": ("SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING n BETWEEN 8 AND 10", "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) BETWEEN 8 AND 10", ()),
    "having_group_column": ("SELECT o_orderpriority, COUNT(*) AS n FROM orders GROUP BY o_orderpriority HAVING o_orderpriority LIKE '%-%H%'", None, ()),
    "having_and_or": ("SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING n > 14 OR n = 1 AND NOT o_custkey > 700", "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 14 OR COUNT(*) = 1 AND NOT o_custkey > 700", ()),
    # order and limits
    "sort_multi": ("SELECT o_orderkey, o_orderpriority FROM orders ORDER BY o_orderpriority DESC, o_orderkey ASC", None, ()),
    "sort_by_aggregate_alias": ("SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey ORDER BY n DESC, o_custkey LIMIT 10", None, ()),
    "sort_by_hidden_column": ("SELECT c_name FROM customer c ORDER BY c.c_custkey DESC LIMIT 7", None, ()),
    "sort_nulls": ("SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id ORDER BY l.quality DESC, d.doc_id LIMIT 20", "SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id ORDER BY l.quality DESC NULLS FIRST, d.doc_id LIMIT 20", ()),
    "limit_n": ("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 25", None, ()),
    "limit_zero": ("SELECT o_orderkey FROM orders LIMIT 0", None, ()),
    "fetch_first": ("SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC FETCH FIRST 5 ROWS ONLY", "SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 5", ()),
    "fetch_next": ("SELECT o_orderkey FROM orders ORDER BY o_totalprice, o_orderkey FETCH NEXT 1 ROW ONLY", "SELECT o_orderkey FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 1", ()),
    "topk_total_order": ("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50", None, ()),
    # pipelines
    "pipeline_full": (
        "SELECT o_orderpriority, COUNT(*) AS n, MAX(o_totalprice) AS m FROM orders WHERE o_totalprice > 50000 GROUP BY o_orderpriority HAVING n > 10 ORDER BY n DESC, o_orderpriority LIMIT 3",
        "SELECT o_orderpriority, COUNT(*) AS n, MAX(o_totalprice) AS m FROM orders WHERE o_totalprice > 50000 GROUP BY o_orderpriority HAVING COUNT(*) > 10 ORDER BY n DESC, o_orderpriority LIMIT 3",
        (),
    ),
    "pipeline_join_full": (
        "SELECT n.n_name, COUNT(*) AS orders, SUM(o.o_totalprice) AS spent FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey "
        "WHERE o.o_totalprice > 1000 GROUP BY n.n_name HAVING orders > 5 ORDER BY spent DESC, n.n_name LIMIT 10",
        "SELECT n.n_name, COUNT(*) AS orders, SUM(o.o_totalprice) AS spent FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey "
        "WHERE o.o_totalprice > 1000 GROUP BY n.n_name HAVING COUNT(*) > 5 ORDER BY spent DESC, n.n_name LIMIT 10",
        ("spent",),
    ),
}

FLAGSHIP = "pipeline_join_full"

#: Statements that also run as text; the others above run as statement objects.
AS_TEXT = (
    "project_alias",
    "filter_precedence",
    "filter_in",
    "filter_between",
    "filter_ilike",
    "join_inner",
    "join_left",
    "join_full",
    "join_chain3",
    "agg_group_multi",
    "agg_join_group",
    "having_alias",
    "fetch_first",
    "topk_total_order",
    "pipeline_full",
    "pipeline_join_full",
)


def engine_on(spark: SparkSession, sf_dir: str, warehouse: str | None = None) -> Engine:
    engine = Engine(spark, warehouse)
    engine.tables.register_parquet(sf_dir, TABLES)
    return engine


def scratch(spark: SparkSession) -> str:
    """A new folder for a store: in the cluster's shared folder, or a temporary one where none is set."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    return f"{shared.rstrip('/')}/store-{uuid.uuid4().hex}" if shared else "file://" + tempfile.mkdtemp(prefix="lodestone-store-")


def _select(name: str, as_text: bool) -> Query:
    text, _, rounded = SELECTS[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = engine_on(spark, sf_dir).execute(text if as_text else parse(text)).dataframe
        return out.withColumns({c: F.round(c, 2) for c in rounded}) if rounded else out

    return run


def _oracle(name: str) -> str:
    text, twin, rounded = SELECTS[name]
    sql = twin or text
    if not rounded:
        return sql
    return f"SELECT * REPLACE ({', '.join(f'ROUND({c}, 2) AS {c}' for c in rounded)}) FROM ({sql})"


# ---- statements that change tables, on a store of their own

_NATION = [("n_nationkey", "INT"), ("n_name", "STRING"), ("n_regionkey", "INT")]


def _nations(spark: SparkSession, sf_dir: str) -> Engine:
    engine = engine_on(spark, sf_dir, scratch(spark))
    for sql in ("CREATE DATABASE work", "USE work", "CREATE TABLE nations (n_nationkey INT, n_name STRING, n_regionkey INT)"):
        engine.execute(sql)
    engine.stored("nations").append(engine.tables.get("nation"))
    return engine


def _changed(*statements: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine = _nations(spark, sf_dir)
        for sql in statements:
            engine.execute(sql)
        return engine.sql("SELECT * FROM nations")

    return run


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active and deleted rows of a table after a delete."""
    engine = _nations(spark, sf_dir)
    engine.execute("DELETE FROM nations WHERE n_regionkey = 2")
    return engine.stored("nations").all_rows().drop("_rid")


def _lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = _orders_index(spark, sf_dir)
    return engine.indexes.search("orders_by_customer", 7).join(engine.stored("orders_kept").rows(with_rid=True).withColumnRenamed("_rid", "rid"), "rid").select("o_orderkey")


def _resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders_index(spark, sf_dir).indexes.resolve("orders_by_customer", 11)


def _orders_index(spark: SparkSession, sf_dir: str) -> Engine:
    engine = engine_on(spark, sf_dir, scratch(spark))
    for sql in ("CREATE DATABASE work", "USE work", "CREATE TABLE orders_kept (o_orderkey LONG, o_custkey LONG, o_totalprice DOUBLE)"):
        engine.execute(sql)
    engine.stored("orders_kept").append(engine.tables.get("orders"))
    engine.indexes.create("orders_by_customer", "work", "orders_kept", "o_custkey", IndexKind.NON_UNIQUE)
    return engine


CHANGES: dict[str, tuple[Query, str]] = {
    "dml_insert": (_changed("INSERT INTO nations (n_name, n_nationkey, n_regionkey) VALUES ('ATLANTIS', 99, 4)"), "SELECT * FROM nation UNION ALL SELECT 99, 'ATLANTIS', 4"),
    "dml_update": (
        _changed("UPDATE nations SET n_name = 'north', n_regionkey = 9 WHERE nations.n_regionkey = 1 OR n_nationkey BETWEEN 20 AND 22"),
        "SELECT n_nationkey, CASE WHEN h THEN 'north' ELSE n_name END AS n_name, CASE WHEN h THEN 9 ELSE n_regionkey END AS n_regionkey FROM (SELECT *, n_regionkey = 1 OR n_nationkey BETWEEN 20 AND 22 AS h FROM nation)",
    ),
    "dml_delete": (_changed("DELETE FROM nations WHERE n_name LIKE '%A' OR n_nationkey IN (3, 4)"), "SELECT * FROM nation WHERE NOT (n_name LIKE '%A' OR n_nationkey IN (3, 4))"),
    "dml_update_all": (_changed("UPDATE nations SET n_regionkey = 0"), "SELECT n_nationkey, n_name, 0 AS n_regionkey FROM nation"),
    "dml_delete_all": (_changed("DELETE FROM nations"), "SELECT * FROM nation WHERE FALSE"),
    "dml_lifecycle": (
        _changed("INSERT INTO nations (n_nationkey, n_name, n_regionkey) VALUES (50, 'ISLE', 1)", "UPDATE nations SET n_name = 'ISLAND' WHERE n_nationkey = 50", "DELETE FROM nations WHERE n_nationkey < 20", "UPDATE nations SET n_regionkey = 7 WHERE n_name NOT LIKE 'I%'"),
        "SELECT n_nationkey, n_name, CASE WHEN n_name NOT LIKE 'I%' THEN 7 ELSE n_regionkey END AS n_regionkey FROM nation WHERE n_nationkey >= 20 UNION ALL SELECT 50, 'ISLAND', 1",
    ),
    "store_all_records": (_records, "SELECT n_nationkey, n_name, n_regionkey, n_regionkey = 2 AS _deleted FROM nation"),
    "index_point_lookup": (_lookup, "SELECT o_orderkey FROM orders WHERE o_custkey = 7"),
    "index_resolve": (_resolved, "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_custkey = 11"),
}


# ---- sources, records, the catalog, indexes and refusals

_ENGINE_ROWS = [(k, f"row {k * k % 10}", k / 4, k % 3 == 0) for k in range(40)]


def _memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = Engine(spark)
    engine.tables.register_rows("made", [("k", "INT"), ("name", "STRING"), ("x", "DOUBLE"), ("third", "BOOLEAN")], _ENGINE_ROWS)
    return engine.sql("SELECT name, COUNT(*) AS n, SUM(x) AS s FROM made WHERE third = FALSE GROUP BY name")


def _callback(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = Engine(spark)
    engine.tables.register_source(lambda name: spark.read.parquet(f"{sf_dir}/supplier.parquet") if name.lower() == "makers" else None)
    return engine.sql("SELECT m.s_suppkey, m.s_name FROM makers m WHERE m.s_acctbal > 5000")


def _rid(engine: Engine, key: int) -> int:
    """The row id of a nation."""
    return engine.stored("nations").rows(with_rid=True).where(F.col("n_nationkey") == key).first()["_rid"]


def _by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = _nations(spark, sf_dir)
    return engine.stored("nations").record(_rid(engine, 7)).drop("_rid")


def _by_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = _nations(spark, sf_dir)
    nations = engine.stored("nations")
    file, position = nations.place_of(_rid(engine, 13))
    return nations.located().where((F.col("_file") == file) & (F.col("_position") == position)).select("n_nationkey", "n_name", "n_regionkey")


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = _nations(spark, sf_dir)
    gone, nations = _rid(engine, 4), engine.stored("nations")
    nations.delete_record(gone)
    row = (nations.active_count(), nations.total_count(), nations.contains(gone), nations.is_active(gone), nations.contains(10**9))
    return spark.createDataFrame([row], "active long, total long, known boolean, alive boolean, stranger boolean")


def _places_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = _nations(spark, sf_dir)
    nations = engine.stored("nations")
    _, file, position = nations.insert_with_place((70, "CAPE", 3))
    nations.update_at(file, position, (71, "HEAD", 4))
    nations.delete_at(*nations.place_of(_rid(engine, 0)))
    return nations.rows()


def _affected(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = _nations(spark, sf_dir)
    statements = ("INSERT INTO nations (n_nationkey, n_name, n_regionkey) VALUES (80, 'BAY', 1)", "UPDATE nations SET n_name = 'x' WHERE n_regionkey = 1", "DELETE FROM nations WHERE n_regionkey >= 3", "DELETE FROM nations WHERE n_regionkey = 99")
    return spark.createDataFrame([(k, engine.execute(sql).affected_rows) for k, sql in enumerate(statements)], "statement int, affected long")


def _listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Databases and tables after creating and dropping some, as a later session finds them."""
    engine = _nations(spark, sf_dir)
    for sql in ("CREATE TABLE kept (a INT)", "CREATE TABLE dropped (a INT)", "DROP TABLE dropped", "CREATE DATABASE spare", "USE DATABASE spare", "CREATE TABLE one (a INT)", "CREATE DATABASE gone", "DROP DATABASE gone", "CREATE DATABASE bare"):
        engine.execute(sql)
    store = Engine(spark, engine.store.root).store
    found = [(d, t) for d in store.databases() for t in store.tables(d) or [None]]
    return spark.createDataFrame(found, "database_name string, table_name string")


def _recovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = _nations(spark, sf_dir)
    engine.execute("UPDATE nations SET n_name = 'found again' WHERE n_regionkey = 4")
    later = Engine(spark, engine.store.root)
    later.execute("USE work")
    return later.sql("SELECT n_nationkey, n_name FROM nations WHERE n_regionkey > 2")


def _statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = _nations(spark, sf_dir)
    engine.execute("DELETE FROM nations WHERE n_regionkey = 0")
    found = engine.stored("nations").statistics()
    return spark.createDataFrame([(found["table"], found["row_count"], found["deleted_count"], found["version"])], "table_name string, row_count long, deleted_count long, version long")


def _index_follows(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = _orders_index(spark, sf_dir)
    engine.execute("UPDATE orders_kept SET o_custkey = 11 WHERE o_custkey BETWEEN 12 AND 14")
    engine.execute("DELETE FROM orders_kept WHERE o_totalprice < 100000")
    engine.execute("INSERT INTO orders_kept (o_orderkey, o_custkey, o_totalprice) VALUES (0, 11, 1.5)")
    return engine.indexes.resolve("orders_by_customer", 11)


def _nation_index(spark: SparkSession, sf_dir: str) -> Engine:
    engine = _nations(spark, sf_dir)
    engine.indexes.create("nation_keys", "work", "nations", "n_nationkey", IndexKind.PRIMARY)
    engine.indexes.create("nation_regions", "work", "nations", "n_regionkey")
    return engine


def _index_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries made, moved and removed by hand, and a refused one."""
    engine = _nation_index(spark, sf_dir)
    ix = engine.indexes
    ix.insert("nation_keys", 500, 10**6)
    ix.update("nation_keys", 500, 501, 10**6)
    ix.delete("nation_keys", 3)
    refused = _refusals(engine, [("taken", lambda: ix.insert("nation_keys", 5, 1)), ("unknown", lambda: ix.search("no_index", 1))])
    entries = ix.entries("nation_keys").select(F.concat(F.lit("key "), F.col("key").cast("string")).alias("attempt"), F.lit(None).cast("string").alias("error"))
    return entries.union(refused)


def _index_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = _nation_index(spark, sf_dir)
    rows = engine.stored("nations").rows(with_rid=True).select(F.col("_rid").alias("rid"), "n_nationkey")
    return engine.indexes.entries("nation_regions").join(rows, "rid").select("key", "n_nationkey")


def _index_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = _nation_index(spark, sf_dir)
    engine.indexes.create("spare", "work", "nations", "n_name", build=False)
    engine.indexes.drop("spare")
    later = Engine(spark, engine.store.root).indexes
    found = [(i.name, i.column, i.kind.value, len(later.of_column("work", "nations", i.column))) for i in later.of_table("work", "nations")]
    return spark.createDataFrame(found, "name string, column_name string, kind string, on_column int")


def _refusals(engine: Engine, cases: list) -> DataFrame:
    """(attempt, error): the class of error that each statement or call ends in."""
    found = []
    for name, do in cases:
        try:
            engine.execute(do) if isinstance(do, str) else do()
            found.append((name, None))
        except EngineError as e:
            found.append((name, type(e).__name__))
    return engine.spark.createDataFrame(found, "attempt string, error string")


_JOINED = "FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey"
_REFUSED: dict[str, tuple[tuple[str, str, str], ...]] = {
    "errors_names": (
        ("ambiguous", "SELECT x.n_name FROM nation x JOIN nation y ON x.n_nationkey = y.n_regionkey WHERE n_name = 'X'", "AmbiguousColumn"),
        ("ambiguous in a projection", "SELECT n_name FROM nation x JOIN nation y ON x.n_nationkey = y.n_regionkey", "AmbiguousColumn"),
        ("twice in the output", "SELECT c_name, c_custkey AS C_NAME FROM customer", "DuplicateColumn"),
        ("unknown column", f"SELECT c.n_name {_JOINED}", "UnknownColumn"),
        ("unknown qualifier", f"SELECT z.n_name {_JOINED}", "UnknownColumn"),
        ("unknown table", "SELECT a FROM nowhere", "TableNotFound"),
    ),
    "errors_grouping": (
        ("ungrouped column", "SELECT c_name, COUNT(*) AS n FROM customer", "AggregationError"),
        ("star", "SELECT * FROM customer GROUP BY c_name", "AggregationError"),
        ("having without group", "SELECT COUNT(*) AS n FROM customer HAVING n > 1", "ParseError"),
        ("sum of text", "SELECT SUM(c_name) AS s FROM customer", "TypeError_"),
        ("sum of all", "SELECT SUM(*) AS s FROM customer", "ParseError"),
    ),
    "errors_limits": (
        ("both", "SELECT n_name FROM nation LIMIT 1 FETCH FIRST 1 ROW ONLY", "ParseError"),
        ("negative", "SELECT n_name FROM nation LIMIT -1", "ParseError"),
        ("fraction", "SELECT n_name FROM nation LIMIT 1.5", "ParseError"),
        ("too large", "SELECT n_name FROM nation LIMIT 3000000000", "ParseError"),
        ("fetch of words", "SELECT n_name FROM nation FETCH FIRST 'a' ROWS ONLY", "ParseError"),
    ),
    "errors_changes": (
        ("wrong type", "INSERT INTO nations (n_nationkey, n_name, n_regionkey) VALUES ('a', 'b', 1)", "InsertError"),
        ("null", "INSERT INTO nations (n_nationkey, n_name, n_regionkey) VALUES (1, NULL, 1)", "InsertError"),
        ("missing column", "INSERT INTO nations (n_nationkey, n_name) VALUES (1, 'b')", "InsertError"),
        ("set twice", "UPDATE nations SET n_name = 'a', N_NAME = 'b'", "ParseError"),
        ("set to a wrong type", "UPDATE nations SET n_regionkey = 'b'", "UpdateError"),
        ("set an unknown column", "UPDATE nations SET size = 1", "UnknownColumn"),
        ("no such table", "DELETE FROM nowhere", "TableNotFound"),
        ("table exists", "CREATE TABLE nations (a INT)", "AlreadyExists"),
        ("database exists", "CREATE DATABASE work", "AlreadyExists"),
        ("no such database", "DROP DATABASE nowhere", "DatabaseNotFound"),
    ),
}


def _refused(name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine = _nations(spark, sf_dir) if name == "errors_changes" else engine_on(spark, sf_dir)
        return _refusals(engine, [(case, sql) for case, sql, _ in _REFUSED[name]])

    return run


def _values(rows, *names: str) -> str:
    text = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(text, r)) + ')' for r in rows)}) AS t({', '.join(names)})"


CHANGES |= {
    "source_memory": (_memory, "SELECT 'row ' || (k * k % 10) AS name, COUNT(*) AS n, SUM(k / 4) AS s FROM range(40) r(k) WHERE k % 3 <> 0 GROUP BY 1"),
    "source_callback": (_callback, "SELECT s_suppkey, s_name FROM supplier WHERE s_acctbal > 5000"),
    "record_by_id": (_by_id, "SELECT * FROM nation WHERE n_nationkey = 7"),
    "record_by_place": (_by_place, "SELECT * FROM nation WHERE n_nationkey = 13"),
    "record_counts": (_counts, "SELECT COUNT(*) - 1 AS active, COUNT(*) AS total, TRUE AS known, FALSE AS alive, FALSE AS stranger FROM nation"),
    "dml_by_place": (_places_changed, "SELECT * FROM nation WHERE n_nationkey <> 0 UNION ALL SELECT 71, 'HEAD', 4"),
    "dml_affected": (
        _affected,
        "SELECT 0 AS statement, 1::BIGINT AS affected UNION ALL SELECT 1, COUNT(*) + 1 FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 2, COUNT(*) FROM nation WHERE n_regionkey >= 3 UNION ALL SELECT 3, 0",
    ),
    "catalog_listing": (_listing, _values([("bare", None), ("spare", "one"), ("work", "kept"), ("work", "nations")], "database_name", "table_name")),
    "catalog_recovered": (_recovered, "SELECT n_nationkey, CASE WHEN n_regionkey = 4 THEN 'found again' ELSE n_name END AS n_name FROM nation WHERE n_regionkey > 2"),
    "table_statistics": (_statistics, "SELECT 'nations' AS table_name, COUNT(*) FILTER (n_regionkey <> 0) AS row_count, COUNT(*) FILTER (n_regionkey = 0) AS deleted_count, 2::BIGINT AS version FROM nation"),
    "index_follows_changes": (
        _index_follows,
        "SELECT o_orderkey, 11::BIGINT AS o_custkey, o_totalprice FROM orders WHERE o_custkey BETWEEN 11 AND 14 AND o_totalprice >= 100000 UNION ALL SELECT 0, 11, 1.5",
    ),
    "index_changes": (_index_changed, "SELECT 'key ' || k AS attempt, NULL::VARCHAR AS error FROM (SELECT n_nationkey AS k FROM nation WHERE n_nationkey <> 3 UNION ALL SELECT 501) UNION ALL SELECT * FROM (VALUES ('taken', 'IndexError_'), ('unknown', 'IndexError_'))"),
    "index_entries": (_index_entries, "SELECT n_regionkey AS key, n_nationkey FROM nation"),
    "index_catalog": (_index_catalog, _values([("nation_keys", "n_nationkey", "primary", 1), ("nation_regions", "n_regionkey", "non_unique", 1)], "name", "column_name", "kind", "on_column")),
}
CHANGES |= {name: (_refused(name), _values([(case, error) for case, _, error in cases], "attempt", "error")) for name, cases in _REFUSED.items()}


def queries() -> dict[str, Query]:
    out = {name: _select(name, as_text=False) for name in SELECTS}
    out |= {f"sql_{name}": _select(name, as_text=True) for name in AS_TEXT}
    return out | {name: run for name, (run, _) in CHANGES.items()}


def oracle_sql() -> dict[str, str]:
    out = {name: _oracle(name) for name in SELECTS}
    out |= {f"sql_{name}": out[name] for name in AS_TEXT}
    return out | {name: sql for name, (_, sql) in CHANGES.items()}
