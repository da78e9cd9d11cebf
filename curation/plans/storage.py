"""Queries of whole-database storage: export and checked import, snapshots, merges by folder, co-located children, footers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from curation.operators import joins
from curation.plans import star
from curation.plans.exports import COUNTS_SQL, TABLES
from curation.plans.registry import ORACLES, query, table
from curation.plans.relational import with_fees
from curation.plans.star import CTE
from curation.sources import colocated, tables
from curation.sources.database import Key, SnapshotStore, export_database, import_database
from curation.sources.keyed import KeyedTable

#: The foreign keys of the tables of a data folder.
KEYS = [
    Key("nation", "n_regionkey", "region", "r_regionkey"),
    Key("customer", "c_nationkey", "nation", "n_nationkey"),
    Key("supplier", "s_nationkey", "nation", "n_nationkey"),
    Key("orders", "o_custkey", "customer", "c_custkey"),
    Key("lineitem", "l_orderkey", "orders", "o_orderkey"),
    Key("lineitem", "l_partkey", "part", "p_partkey"),
    Key("lineitem", "l_suppkey", "supplier", "s_suppkey"),
    Key("labels", "doc_id", "documents", "doc_id"),
]


def held(spark, d):
    return {t: table(spark, d, t) for t in TABLES}


def compared(left, right):
    """(name, same) for each table of both."""
    return reduce(lambda a, b: a.union(b), [joins.same_rows(df, right[t], t) for t, df in left.items()])


@query("k3_s10_database", f"SELECT name, n AS rows, true AS typed FROM ({COUNTS_SQL})")
def database_round_trip(spark, d):
    """All tables exported with a manifest, imported with every foreign key checked, and equal to what was written."""
    own, path = held(spark, d), tables.scratch(spark)
    export_database(own, f"{path}/export", KEYS)
    back = import_database(spark, f"{path}/export", f"{path}/database", {t: df.schema for t, df in own.items()}, KEYS)
    rows = spark.read.schema("name string, rows long").json(f"{path}/export/manifest")
    return rows.join(F.broadcast(compared(own, back)), "name").select("name", "rows", F.col("same").alias("typed"))


@query("k5_database_snapshots", f"SELECT name, true AS same, CAST(1 + (name = 'orders')::INT AS INT) AS parts, 3 AS snapshots FROM ({COUNTS_SQL})")
def database_snapshots(spark, d):
    """Four snapshots of all tables, of which one lost rows; the newest three are kept and that from before the loss restored.

    A table that never changed has one part, whatever the number of snapshots.
    """
    own, path = held(spark, d), tables.scratch(spark)
    store = SnapshotStore(spark, path)
    before = [store.snapshot(own) for _ in range(3)]
    store.snapshot(own | {"orders": own["orders"].where("o_orderstatus = 'F'")})
    store.restore(before[-1])
    left = store.retain(3)
    parts = spark.createDataFrame([(t, len({store.manifest(v)["tables"][t]["digest"] for v in left})) for t in TABLES], "name string, parts int")
    return compared(own, store.tables()).join(parts, "name").select("name", "same", "parts", F.lit(len(left)).alias("snapshots"))


@query("w1_w4_w11_w19_keyed_orders", """
WITH o AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 100 <> 9),
n AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 200 = 7 THEN ' ' ELSE 'X' END AS s, CASE WHEN o_orderkey % 300 <> 7 THEN o_totalprice + 1 END AS p FROM orders WHERE o_orderkey % 100 IN (7, 9)),
u AS (SELECT coalesce(o.o_orderkey, n.o_orderkey) AS o_orderkey, coalesce(n.o_custkey, o.o_custkey) AS o_custkey, coalesce(CASE WHEN trim(n.s) <> '' THEN n.s END, o.o_orderstatus) AS o_orderstatus, coalesce(n.p, o.o_totalprice) AS o_totalprice
      FROM o FULL JOIN n ON o.o_orderkey = n.o_orderkey)
SELECT o_orderkey, o_custkey, CASE WHEN o_orderstatus = 'X' THEN 'O' ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM u WHERE o_orderkey % 100 <> 8""")
def keyed_orders(spark, d):
    """Orders upserted, recomputed and deleted in a table whose merges rewrite only the folders their keys fall in."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    kept = KeyedTable.create(orders.where("o_orderkey % 100 <> 9"), tables.scratch(spark), ["o_orderkey"], 32)
    new = orders.where("o_orderkey % 100 in (7, 9)")
    status, price = F.when(F.col("o_orderkey") % 200 == 7, " ").otherwise("X"), F.when(F.col("o_orderkey") % 300 != 7, F.col("o_totalprice") + 1)
    kept.upsert(new.withColumns({"o_orderstatus": status, "o_totalprice": price}))
    kept.recompute("o_orderstatus", F.when(F.col("o_orderstatus") == "X", "O").otherwise(F.col("o_orderstatus")))
    kept.delete(orders.where("o_orderkey % 100 = 8"))
    return kept.read()


@query("w4_keyed_fees", CTE + """
SELECT program_id, line, amount FROM fee WHERE program_id % 50 <> 3 OR line % 2 = 1
UNION ALL SELECT program_id, 100 + line, amount FROM fee WHERE program_id % 50 = 3 AND line = 1""")
def keyed_fees(spark, d):
    """Fees of some programmes replaced by what came in: stale ones go, new ones come, other programmes' files stay."""
    fees = star.fee(spark, d).select("program_id", "line", "amount")
    kept = KeyedTable.create(fees, tables.scratch(spark), ["program_id"], 32)
    some = fees.where("program_id % 50 = 3")
    incoming = some.where("line % 2 = 1").unionByName(some.where("line = 1").withColumn("line", F.col("line") + 100))
    stale = some.join(incoming.select("program_id").distinct(), "program_id", "left_anti").select("program_id").distinct()
    kept.delete(stale)
    kept.sync(incoming, ["program_id"])
    return kept.read()


@query("j8_children_colocated", ORACLES["j8_children_nested"])
def children_colocated(spark, d):
    """Every programme with its fees, both bucketed by programme: nothing is shuffled for the join or the grouping."""
    store = colocated.Colocated({"program": star.program(spark, d), "fee": star.fee(spark, d)}, "program_id", 16)
    return with_fees(store["program"], store["fee"])


@query("a3_footer_counts", COUNTS_SQL)
def footer_counts(spark, d):
    """Row counts of all tables from the footers of their files: no column is read."""
    return colocated.row_counts(spark, {t: f"{d}/{t}.parquet" for t in TABLES})
