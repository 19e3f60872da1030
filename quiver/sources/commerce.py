"""A property graph derived from the tables of an order-processing schema."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quiver.graph import PropertyGraph

C, L = F.col, F.lit


def _id(prefix: str, key: Column) -> Column:
    return F.concat(L(prefix), key.cast("string"))


def _node(kind: str, node_id: Column, name: Column, **more: Column) -> list[Column]:
    text, zero = L(""), L(0)
    return [
        node_id.alias("id"), L(kind).alias("type"), name.alias("name"), more.get("pkg", text).alias("pkg_path"),
        more.get("file", text).alias("file_path"), more.get("start", zero).cast("int").alias("line_start"),
        more.get("end", zero).cast("int").alias("line_end"), more.get("repo", text).alias("repo_id"),
    ]


class Commerce:
    """The mapping's tables; see :func:`commerce_graph`."""

    def __init__(self, spark: SparkSession, folder: str):
        read = lambda name: spark.read.parquet(f"{folder}/{name}.parquet")
        self.spark = spark
        self.region = read("region")
        self.nation = read("nation").join(F.broadcast(self.region), C("n_regionkey") == C("r_regionkey"))
        self.nation = self.nation.select("n_nationkey", C("n_name").alias("n"), C("r_name").alias("r"))
        place = F.broadcast(self.nation)  # one row for each nation
        self.customer = read("customer").join(place, C("c_nationkey") == C("n_nationkey"))
        self.supplier = read("supplier").join(place, C("s_nationkey") == C("n_nationkey"))
        self.part, self.orders, self.lineitem = read("part"), read("orders"), read("lineitem")
        self.events, self.pages = read("events"), read("pages")
        self.package = F.concat(L("tpch/"), C("r"), L("/"), C("n"))
        self.folder = F.concat(L("/data/"), C("r"), L("/"), C("n"))
        self.folder_id = F.concat(L("repo:"), C("r"), L(":folder:"), C("n"))
        self.root_id = F.concat(L("repo:"), C("r"), L(":folder:."))

    def nodes(self) -> DataFrame:
        regions = self.region.select(C("r_name").alias("r"))
        order = {t: Window.partitionBy("n_nationkey").orderBy(f"{t[0]}_{k}") for t, k in (("customer", "custkey"), ("supplier", "suppkey"))}

        def placed(table: DataFrame, kind: str, prefix: str, key: str, name: str, file: str) -> DataFrame:
            rn = F.row_number().over(order["customer" if prefix == "c/" else "supplier"])
            return table.withColumn("rn", rn).select(
                *_node(
                    kind, _id(prefix, C(key)), C(name), pkg=self.package, file=F.concat(self.folder, L(file)),
                    start=10 * (C("rn") - 1) + 1, end=10 * C("rn"), repo=C("r"),
                )
            )

        def file(name: str) -> DataFrame:
            path = F.concat(self.folder, L("/" + name))
            return self.nation.select(*_node("FILE", path, L(name), pkg=self.package, file=path, repo=C("r")))

        customers = self.customer.select(C("c_custkey").alias("custkey"), self.package.alias("k"), "r")
        users = self.events.select("user_id").distinct().join(customers, C("user_id") == C("custkey"))
        path = F.regexp_replace(C("url"), "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", "")
        parts = [
            self.spark.range(1).select(*_node("WORKSPACE", L("workspace:tpch"), L("tpch"))),
            regions.select(*_node("REPO", _id("repo:", C("r")), C("r"), repo=C("r"))),
            regions.select(*_node("FOLDER", self.root_id, C("r"), file=_id("/data/", C("r")), repo=C("r"))),
            self.nation.select(*_node("FOLDER", self.folder_id, C("n"), file=self.folder, repo=C("r"))),
            self.nation.select(*_node("PACKAGE", self.package, C("n"), pkg=self.package, repo=C("r"))),
            file("customers.go"), file("suppliers.go"),
            placed(self.customer, "FUNC", "c/", "c_custkey", "c_name", "/customers.go"),
            placed(self.supplier, "STRUCT", "s/", "s_suppkey", "s_name", "/suppliers.go"),
            self.orders.join(customers, C("o_custkey") == C("custkey")).select(
                *_node("METHOD", _id("o/", C("o_orderkey")), C("o_orderpriority"), pkg=C("k"), repo=C("r"))
            ),
            self.part.select(*_node("INTERFACE", _id("p/", C("p_partkey")), C("p_name"))),
            self.part.select("p_brand").distinct().select(
                *_node("BOUNDARY", _id("brand/", C("p_brand")), C("p_brand"), pkg=C("p_brand"))
            ),
            self.events.select("event_type").distinct().select(
                *_node("CHANNEL", _id("channel:", C("event_type")), F.concat(C("event_type"), L(" (chan double)")))
            ),
            users.select(*_node("GOROUTINE", _id("u/", C("user_id")), _id("goroutine_U", C("user_id")), pkg=C("k"), repo=C("r"))),
            self.pages.select(*_node("ROUTE", _id("page/", C("page_id")), F.concat(L("GET "), F.regexp_replace(path, "[?#].*$", "")))),
        ]
        return reduce(DataFrame.unionByName, parts)

    def edges(self) -> DataFrame:
        none = F.array().cast("array<struct<filepath:string,line:int,column:int>>")
        counts = {t: getattr(self, t).count() for t in ("customer", "supplier")}

        def link(table: DataFrame, kind: str, src: Column, dst: Column, repo: Column = L("")) -> DataFrame:
            rows = table.select(src.alias("src"), dst.alias("dst"), L(kind).alias("type"), repo.alias("repo_id")).distinct()
            return rows.withColumn("occurrences", none)

        def used(kind: str, dst: Column, key: str) -> DataFrame:
            """Edges of orders with the distinct places of their line items, in order."""
            place = F.struct(
                L("order").alias("filepath"), C("l_linenumber").cast("int").alias("line"), C(key).cast("int").alias("column")
            )
            rows = self.lineitem.select(_id("o/", C("l_orderkey")).alias("src"), dst.alias("dst"), place.alias("place"))
            grouped = rows.groupBy("src", "dst").agg(F.array_sort(F.collect_set("place")).alias("occurrences"))
            return grouped.select("src", "dst", L(kind).alias("type"), L("").alias("repo_id"), "occurrences")

        regions = self.region.select(C("r_name").alias("r"))
        repo, customer_file = _id("repo:", C("r")), F.concat(self.folder, L("/customers.go"))
        supplier_file = F.concat(self.folder, L("/suppliers.go"))
        region_of = self.customer.select(C("c_custkey").alias("custkey"), "r")
        orders = self.orders.join(region_of, C("o_custkey") == C("custkey"))
        events = self.events.join(region_of, C("user_id") == C("custkey"))
        user, channel = _id("u/", C("user_id")), _id("channel:", C("event_type"))
        items = self.lineitem.join(self.supplier.select("s_suppkey", "r"), C("l_suppkey") == C("s_suppkey"))
        supplier, part = _id("s/", C("l_suppkey")), _id("p/", C("l_partkey"))
        brands = items.filter(C("l_quantity") >= 49).join(self.part.select("p_partkey", "p_brand"), C("l_partkey") == C("p_partkey"))
        page = _id("page/", C("page_id"))
        parts = [
            link(regions, "CONTAINS", L("workspace:tpch"), repo, C("r")),
            link(regions, "CONTAINS", repo, self.root_id, C("r")),
            link(self.nation, "CONTAINS", self.root_id, self.folder_id, C("r")),
            link(self.nation, "CONTAINS", self.folder_id, self.package, C("r")),
            link(self.nation, "CONTAINS", self.package, customer_file, C("r")),
            link(self.nation, "CONTAINS", self.package, supplier_file, C("r")),
            link(self.customer, "CONTAINS", customer_file, _id("c/", C("c_custkey")), C("r")),
            link(self.supplier, "CONTAINS", supplier_file, _id("s/", C("s_suppkey")), C("r")),
            link(orders, "CALLS", _id("c/", C("o_custkey")), _id("o/", C("o_orderkey")), C("r")),
            used("CALLS", _id("s/", C("l_suppkey")), "l_suppkey"),
            link(events, "CALLS", user, _id("c/", (C("user_id") + 1) % counts["customer"]), C("r")),
            used("REFERENCES", _id("p/", C("l_partkey")), "l_partkey"),
            link(self.pages, "REFERENCES", page, _id("c/", C("page_id") % counts["customer"])),
            link(items.filter(C("l_returnflag") == "R"), "IMPLEMENTS", supplier, part, C("r")),
            link(self.part, "IMPORTS", _id("p/", C("p_partkey")), _id("brand/", C("p_brand"))),
            link(brands, "INSTANTIATES", supplier, _id("brand/", C("p_brand")), C("r")),
            link(events, "SPAWNS", _id("c/", C("user_id")), user, C("r")),
            link(events.filter(C("value") > 100), "SENDS_TO", user, channel, C("r")),
            link(
                events.filter((C("event_type") == "purchase") & (C("user_id") % 3 == 0)),
                "SENDS_TO", _id("c/", C("user_id")), channel, C("r"),
            ),
            link(events.filter(C("value") <= 100), "RECEIVES_FROM", user, channel, C("r")),
            link(self.pages, "REGISTERS_ROUTE", _id("s/", C("page_id") % counts["supplier"]), page),
        ]
        return reduce(DataFrame.unionByName, parts)


def commerce_graph(spark: SparkSession, folder: str) -> PropertyGraph:
    """Regions are repositories, nations packages, customers functions, orders methods, and so on. All edges are live."""
    tables = Commerce(spark, folder)
    return PropertyGraph(tables.nodes(), tables.edges(), resolved=True)


#: The same mapping as common table expressions ``nodes``, ``edges`` and ``occ`` (an edge's occurrences) in SQL.
SQL = """
WITH RECURSIVE nat AS (SELECT n_nationkey, n_name AS n, r_name AS r FROM nation JOIN region ON n_regionkey = r_regionkey),
cust AS (SELECT *, row_number() OVER (PARTITION BY n_nationkey ORDER BY c_custkey) AS rn FROM customer JOIN nat ON c_nationkey = n_nationkey),
supp AS (SELECT *, row_number() OVER (PARTITION BY n_nationkey ORDER BY s_suppkey) AS rn FROM supplier JOIN nat ON s_nationkey = n_nationkey),
nodes AS MATERIALIZED (
  SELECT 'workspace:tpch' AS id, 'WORKSPACE' AS type, 'tpch' AS name, '' AS pkg_path, '' AS file_path,
         CAST(0 AS INTEGER) AS line_start, CAST(0 AS INTEGER) AS line_end, '' AS repo_id
  UNION ALL SELECT 'repo:' || r_name, 'REPO', r_name, '', '', 0, 0, r_name FROM region
  UNION ALL SELECT 'repo:' || r_name || ':folder:.', 'FOLDER', r_name, '', '/data/' || r_name, 0, 0, r_name FROM region
  UNION ALL SELECT 'repo:' || r || ':folder:' || n, 'FOLDER', n, '', '/data/' || r || '/' || n, 0, 0, r FROM nat
  UNION ALL SELECT 'tpch/' || r || '/' || n, 'PACKAGE', n, 'tpch/' || r || '/' || n, '', 0, 0, r FROM nat
  UNION ALL SELECT '/data/' || r || '/' || n || '/' || f, 'FILE', f, 'tpch/' || r || '/' || n, '/data/' || r || '/' || n || '/' || f, 0, 0, r
            FROM nat, (VALUES ('customers.go'), ('suppliers.go')) AS v(f)
  UNION ALL SELECT 'c/' || c_custkey, 'FUNC', c_name, 'tpch/' || r || '/' || n, '/data/' || r || '/' || n || '/customers.go',
            CAST(10 * (rn - 1) + 1 AS INTEGER), CAST(10 * rn AS INTEGER), r FROM cust
  UNION ALL SELECT 's/' || s_suppkey, 'STRUCT', s_name, 'tpch/' || r || '/' || n, '/data/' || r || '/' || n || '/suppliers.go',
            CAST(10 * (rn - 1) + 1 AS INTEGER), CAST(10 * rn AS INTEGER), r FROM supp
  UNION ALL SELECT 'o/' || o_orderkey, 'METHOD', o_orderpriority, 'tpch/' || r || '/' || n, '', 0, 0, r FROM orders JOIN cust ON o_custkey = c_custkey
  UNION ALL SELECT 'p/' || p_partkey, 'INTERFACE', p_name, '', '', 0, 0, '' FROM part
  UNION ALL SELECT DISTINCT 'brand/' || p_brand, 'BOUNDARY', p_brand, p_brand, '', 0, 0, '' FROM part
  UNION ALL SELECT DISTINCT 'channel:' || event_type, 'CHANNEL', event_type || ' (chan double)', '', '', 0, 0, '' FROM events
  UNION ALL SELECT DISTINCT 'u/' || user_id, 'GOROUTINE', 'goroutine_U' || user_id, 'tpch/' || r || '/' || n, '', 0, 0, r FROM events JOIN cust ON user_id = c_custkey
  UNION ALL SELECT 'page/' || page_id, 'ROUTE',
            'GET ' || regexp_replace(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*', ''), '[?#].*$', ''), '', '', 0, 0, '' FROM pages),
edges AS MATERIALIZED (
  SELECT 'workspace:tpch' AS src, 'repo:' || r_name AS dst, 'CONTAINS' AS type, r_name AS repo_id FROM region
  UNION SELECT 'repo:' || r_name, 'repo:' || r_name || ':folder:.', 'CONTAINS', r_name FROM region
  UNION SELECT 'repo:' || r || ':folder:.', 'repo:' || r || ':folder:' || n, 'CONTAINS', r FROM nat
  UNION SELECT 'repo:' || r || ':folder:' || n, 'tpch/' || r || '/' || n, 'CONTAINS', r FROM nat
  UNION SELECT 'tpch/' || r || '/' || n, '/data/' || r || '/' || n || '/' || f, 'CONTAINS', r FROM nat, (VALUES ('customers.go'), ('suppliers.go')) AS v(f)
  UNION SELECT '/data/' || r || '/' || n || '/customers.go', 'c/' || c_custkey, 'CONTAINS', r FROM cust
  UNION SELECT '/data/' || r || '/' || n || '/suppliers.go', 's/' || s_suppkey, 'CONTAINS', r FROM supp
  UNION SELECT 'c/' || o_custkey, 'o/' || o_orderkey, 'CALLS', r FROM orders JOIN cust ON o_custkey = c_custkey
  UNION SELECT 'o/' || l_orderkey, 's/' || l_suppkey, 'CALLS', '' FROM lineitem
  UNION SELECT 'u/' || user_id, 'c/' || ((user_id + 1) % (SELECT count(*) FROM customer)), 'CALLS', r FROM events JOIN cust ON user_id = c_custkey
  UNION SELECT 'o/' || l_orderkey, 'p/' || l_partkey, 'REFERENCES', '' FROM lineitem
  UNION SELECT 'page/' || page_id, 'c/' || (page_id % (SELECT count(*) FROM customer)), 'REFERENCES', '' FROM pages
  UNION SELECT 's/' || l_suppkey, 'p/' || l_partkey, 'IMPLEMENTS', r FROM lineitem JOIN supp ON l_suppkey = s_suppkey WHERE l_returnflag = 'R'
  UNION SELECT 'p/' || p_partkey, 'brand/' || p_brand, 'IMPORTS', '' FROM part
  UNION SELECT 's/' || l_suppkey, 'brand/' || p_brand, 'INSTANTIATES', r
        FROM lineitem JOIN supp ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey WHERE l_quantity >= 49
  UNION SELECT 'c/' || user_id, 'u/' || user_id, 'SPAWNS', r FROM events JOIN cust ON user_id = c_custkey
  UNION SELECT 'u/' || user_id, 'channel:' || event_type, 'SENDS_TO', r FROM events JOIN cust ON user_id = c_custkey WHERE value > 100
  UNION SELECT 'c/' || user_id, 'channel:' || event_type, 'SENDS_TO', r FROM events JOIN cust ON user_id = c_custkey
        WHERE event_type = 'purchase' AND user_id % 3 = 0
  UNION SELECT 'u/' || user_id, 'channel:' || event_type, 'RECEIVES_FROM', r FROM events JOIN cust ON user_id = c_custkey WHERE value <= 100
  UNION SELECT 's/' || (page_id % (SELECT count(*) FROM supplier)), 'page/' || page_id, 'REGISTERS_ROUTE', '' FROM pages),
occ AS (
  SELECT DISTINCT 'o/' || l_orderkey AS src, 's/' || l_suppkey AS dst, 'CALLS' AS type, 'order' AS filepath,
         CAST(l_linenumber AS INTEGER) AS line, CAST(l_suppkey AS INTEGER) AS col FROM lineitem
  UNION SELECT DISTINCT 'o/' || l_orderkey, 'p/' || l_partkey, 'REFERENCES', 'order', CAST(l_linenumber AS INTEGER), CAST(l_partkey AS INTEGER) FROM lineitem)
"""
