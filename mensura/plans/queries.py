"""The engine's operators as queries over the driver's tables, each with the SQL that must agree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mensura.fit import grid, odr
from mensura.fit import spark as fits
from mensura.functions import elimination, matrix, sheetlike, special, units
from mensura.operators import catalog, cellgraph, selection, sheet, textindex, uncertainty
from mensura.scratch import shared_dir
from mensura.sources import files

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _r(c, n: int = 6):
    """Rounded, and without negative zero."""
    return F.round(c, n) + F.lit(0.0)


# ---------------------------------------------------------------- uncertainty


@query("""SELECT l_returnflag, round(sum(v), 2) AS revenue, round(sqrt(sum(s2)), 4) AS revenue_sigma, count(*) AS n FROM (SELECT l_returnflag, l_extendedprice * (1 - l_discount) AS v,
power((1 - l_discount) * 0.01 * l_extendedprice, 2) + power(l_extendedprice * 0.005, 2) AS s2 FROM lineitem) GROUP BY l_returnflag""")
def propagate_revenue(spark, sf_dir):
    """Uncertainty of discounted revenue by return flag; rows count as independent."""
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_extendedprice", "l_discount", (F.col("l_extendedprice") * 0.01).alias("sp"), F.lit(0.005).alias("sd"))
    out = uncertainty.propagate(rows, "p*(1-d)", {"p": ("l_extendedprice", "sp"), "d": ("l_discount", "sd")})
    return out.groupBy("l_returnflag").agg(F.round(F.sum("value"), 2).alias("revenue"), F.round(F.sqrt(F.sum(F.col("sigma") * F.col("sigma"))), 4).alias("revenue_sigma"), F.count("*").alias("n"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, round(l_quantity * l_extendedprice, 4) AS value, round(sqrt(power(l_extendedprice * 0.5, 2) + power(l_quantity * 0.01 * l_extendedprice, 2)), 4) AS upper,
round(sqrt(power(l_extendedprice * 0.25, 2) + power(l_quantity * 0.02 * l_extendedprice, 2)), 4) AS lower FROM lineitem""")
def propagate_rows_asymmetric(spark, sf_dir):
    p = F.col("l_extendedprice")
    out = uncertainty.propagate_asymmetric(table(spark, sf_dir, "lineitem"), "q*p", {"q": ("l_quantity", F.lit(0.5), F.lit(0.25)), "p": (p, p * 0.01, p * 0.02)})
    return out.select("l_orderkey", "l_linenumber", "l_partkey", *(F.round(c, 4).alias(c) for c in ("value", "upper", "lower")))


@query("""SELECT p_partkey, round(sin(p_size) * p_retailprice, 6) AS value, round(sqrt(power(cos(p_size) * p_retailprice * 0.1, 2) + power(sin(p_size) * 0.01 * p_retailprice, 2)), 6) AS sigma FROM part""")
def propagate_trig(spark, sf_dir):
    r = F.col("p_retailprice")
    out = uncertainty.propagate(table(spark, sf_dir, "part"), "sin(s)*r", {"s": (F.col("p_size").cast("double"), F.lit(0.1)), "r": (r, r * 0.01)})
    return out.select("p_partkey", _r("value").alias("value"), _r("sigma").alias("sigma"))


@query("""SELECT p_partkey, round(p_retailprice * 0.01 * 2.5758293035489004 / 1.959963984540054, 6) AS sigma99 FROM part""")
def rescale_confidence(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", _r(uncertainty.rescale(F.col("p_retailprice") * 0.01, 95, 99)).alias("sigma99"))


@query("""SELECT percent, z, percent AS back, count(*) AS n FROM (SELECT c_custkey % 5 AS k FROM customer) JOIN (VALUES (0, 50.0::DOUBLE, 0.67449::DOUBLE), (1, 68.0, 0.994458), (2, 95.0, 1.959964), (3, 99.0, 2.575829), (4, 99.9, 3.290527)) t(k, percent, z) USING (k) GROUP BY percent, z""")
def confidence_table(spark, sf_dir):
    """Coverage factors of the confidence levels that occur, and the levels that follow from them."""
    levels = (50.0, 68.0, 95.0, 99.0, 99.9)
    percent = F.element_at(F.array(*map(F.lit, levels)), (F.col("c_custkey") % 5 + 1).cast("int"))
    found = table(spark, sf_dir, "customer").groupBy(percent.alias("percent")).agg(F.count("*").alias("n"))
    z = F.create_map(*(F.lit(x) for p in levels for x in (p, uncertainty.z_of(p))))
    back = F.create_map(*(F.lit(x) for p in levels for x in (p, uncertainty.percent_of(uncertainty.z_of(p)))))
    return found.select("percent", _r(z[F.col("percent")]).alias("z"), _r(back[F.col("percent")]).alias("back"), "n")


@query("""SELECT p_partkey, p_retailprice AS nominal, p_size::DOUBLE AS upper, CASE WHEN p_partkey % 3 = 1 THEN 2.5::DOUBLE END AS lower, CASE WHEN p_partkey % 3 = 2 THEN 'relative' ELSE 'absolute' END AS upper_type FROM part""")
def parse_plus_minus(spark, sf_dir):
    v, s, k = F.col("p_retailprice").cast("string"), F.col("p_size").cast("string"), F.col("p_partkey") % 3
    text = F.when(k == 0, F.concat(v, F.lit(" ± "), s)).when(k == 1, F.concat(v, F.lit(" +"), s, F.lit("/-2.5"))).otherwise(F.concat(v, F.lit(" +- "), s, F.lit("%")))
    rows = table(spark, sf_dir, "part").select("p_partkey", uncertainty.parse_plus_minus(text).alias("u"))
    return rows.select("p_partkey", "u.nominal", "u.upper", "u.lower", "u.upper_type")


@query("""SELECT p_partkey, CASE WHEN s > 0 THEN greatest(0, CASE WHEN s / power(10.0, floor(log10(s))) < 2.95 THEN 1 ELSE 0 END - floor(log10(s)))::INTEGER ELSE 0 END AS digits FROM (SELECT p_partkey, p_size * 0.013 AS s FROM part)""")
def format_uncertainty(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", uncertainty.decimals(F.col("p_size") * 0.013).alias("digits"))


# ---------------------------------------------------------------- units


@query("""SELECT event_id, round(value * 0.393701, 6) AS inches, round(value * 2.20462, 6) AS pounds, round(value / 1.602176634 , 6) AS ev19, round(value / 3.6, 6) AS mps FROM events""")
def unit_convert_linear(spark, sf_dir):
    v = F.col("value")
    return table(spark, sf_dir, "events").select(
        "event_id", _r(units.convert(v, "cm", "in")).alias("inches"), _r(units.convert(v, "kg", "lb")).alias("pounds"), _r(units.convert(v, "J", "eV") / 1e19).alias("ev19"), _r(units.convert(v, "km/h", "m/s")).alias("mps")
    )


@query("""SELECT event_id, round(value + 273.15, 6) AS kelvin, round(value * 9 / 5 + 32, 6) AS fahrenheit, round(value * 0.8, 6) AS reaumur FROM events""")
def unit_convert_temperature(spark, sf_dir):
    v = F.col("value")
    return table(spark, sf_dir, "events").select("event_id", *(_r(units.convert(v, "°C", u)).alias(n) for u, n in (("K", "kelvin"), ("°F", "fahrenheit"), ("°Ré", "reaumur"))))


@query("""SELECT event_id, f AS source_unit, t AS target_unit, round(value * k, 6) AS converted FROM (SELECT event_id, value, event_id % 4 AS m FROM events) JOIN
(VALUES (0, 'm', 'ft', 3.28084), (1, 'g', 'kg', 0.001), (2, 'h', 's', 3600.0), (3, 'm', 'kg', NULL)) u(m, f, t, k) USING (m)""")
def unit_lookup_join(spark, sf_dir):
    m = F.col("event_id") % 4
    pick = lambda *x: F.element_at(F.array(*map(F.lit, x)), (m + 1).cast("int"))
    rows = table(spark, sf_dir, "events").select("event_id", "value", pick("m", "g", "h", "m").alias("source_unit"), pick("ft", "kg", "s", "kg").alias("target_unit"))
    out = units.convert_columns(rows, "value", "source_unit", "target_unit")
    return out.select("event_id", "source_unit", "target_unit", _r("converted").alias("converted"))


@query("""SELECT event_id, symbol, formula, category FROM (SELECT event_id, event_id % 6 AS k FROM events) JOIN (VALUES (0, 'N', '[M·L·T^-2]', 'force'), (1, 'J', '[M·L^2·T^-2]', 'energy'), (2, 'Ω', '[M·L^2·T^-3·I^-2]', 'resistance'), (3, 'rad', '[dimensionless]', 'angle'), (4, '°C', '[Θ]', 'temperature'), (5, 'kPa', '[M·L^-1·T^-2]', 'pressure')) t(k, symbol, formula, category) USING (k)""")
def dimension_formula(spark, sf_dir):
    """The dimension of each event's unit: the unit table, of a few hundred rows, goes by broadcast."""
    symbol = F.element_at(F.array(*map(F.lit, ("N", "J", "Ω", "rad", "°C", "kPa"))), (F.col("event_id") % 6 + 1).cast("int"))
    rows = table(spark, sf_dir, "events").select("event_id", symbol.alias("symbol"))
    return rows.join(F.broadcast(units.unit_table(spark)), "symbol", "left").select("event_id", "symbol", "formula", "category")


@query(r"""SELECT event_id, CASE WHEN x = 0 THEN '0' WHEN abs(x) >= 1e6 OR abs(x) < 1e-6 THEN printf('%.6e', x) WHEN abs(x) >= 1 THEN regexp_replace(printf('%.6f', x), '\.?0+$', '') ELSE regexp_replace(printf('%.8f', x), '\.?0+$', '') END AS "text"
FROM (SELECT event_id, round(value, 2) * [1.0, 0.00001, 1000000.0, 0.000000001][event_id % 4 + 1]::DOUBLE AS x FROM events)""")
def unit_text(spark, sf_dir):
    """Converted values as the text that is shown: plain or with an exponent by size."""
    scale = F.element_at(F.array(*map(F.lit, (1.0, 1e-5, 1e6, 1e-9))), (F.col("event_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", units.format_column(F.round("value", 2) * scale).alias("text"))


# ---------------------------------------------------------------- catalog


@query("""SELECT user_id, list(value ORDER BY event_id) AS data, count(*) AS n FROM events GROUP BY user_id""")
def sequence_build(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id"), F.col("event_id").alias("idx"), "value")
    return catalog.to_wide(rows, ["user_id"], sigma=None).select("user_id", "data", F.size("data").cast("long").alias("n"))


@query("""SELECT user_id, count(value) AS "count", round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std_dev, min(value) AS min, max(value) AS max, round(median(value), 6) AS median FROM events GROUP BY user_id""")
def sequence_stats(spark, sf_dir):
    s = catalog.statistics(table(spark, sf_dir, "events"), ["user_id"])
    return s.select("user_id", "count", _r("mean").alias("mean"), _r("std_dev").alias("std_dev"), "min", "max", _r("median").alias("median"))


_SEQ = "SELECT user_id // 2 AS pair, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS idx, value FROM events WHERE user_id % 2 = {}"


@query(f"""SELECT pair, idx, a.value AS left_value, b.value AS right_value FROM ({_SEQ.format(0)}) a FULL JOIN ({_SEQ.format(1)}) b USING (pair, idx)""")
def sequence_zip_full(spark, sf_dir):
    """Every user of an even number beside the next: all users' sequences, padded pair by pair."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "value")
    placed = catalog.positions(rows, ["user_id"], ["event_id"]).withColumn("pair", F.floor(F.col("user_id") / 2))
    even = F.col("user_id") % 2 == 0
    return catalog.zip_full(placed.where(even), placed.where(~even), keys=["pair"])


_TYPES = ("click", "error", "purchase", "signup", "view")


@query("""WITH p AS (SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS idx, value FROM events)
SELECT idx, """ + ", ".join(f"max(CASE WHEN event_type = '{t}' THEN value END) AS \"{t}\"" for t in _TYPES) + """ FROM p GROUP BY idx""")
def sequence_pivot_fit_input(spark, sf_dir):
    """The values of every event type as a column, by place: each type is a sequence."""
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("name"), "event_id", "value")
    return catalog.fit_input(catalog.positions(rows, ["name"], ["event_id"]), _TYPES, sigma=None)


@query(r"""SELECT doc_id, source FROM documents WHERE (regexp_matches(lower(text), '(^|[^\pL\pN])haed') AND regexp_matches(lower(text), '(^|[^\pL\pN])lic')) OR lower(source) LIKE '%haed lic%'""")
def catalog_search(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").withColumns({"name": F.col("source"), "description": F.col("text"), "tags": F.array().cast("array<string>"), "source": F.col("source")})
    return catalog.search(rows, "haed lic").select("doc_id", "source")


@query(r"""SELECT doc_id, source FROM documents WHERE (regexp_matches(lower(text), '(^|[^\pL\pN])haed') AND regexp_matches(lower(text), '(^|[^\pL\pN])lic')) OR lower(source) LIKE '%haed lic%'""")
def catalog_search_index(spark, sf_dir):
    """The same search by an inverted index, which is built from the table first."""
    d = table(spark, sf_dir, "documents")
    path = shared_dir(spark)
    textindex.build(d.select(F.col("doc_id").alias("id"), F.col("source").alias("name"), F.col("text").alias("description"), F.array().cast("array<string>").alias("tags"), "source"), path)
    return textindex.search_catalog(d.select("doc_id", "source"), path, "haed lic", id_col="doc_id")


@query("""WITH a AS (SELECT o_orderkey + 1 AS k, o_totalprice AS v FROM orders), f AS (SELECT 1.5 AS r, 0.1 AS s), b AS (SELECT k, v, v * r AS bv, sqrt(power(0.01 * v * r, 2) + power(v * s, 2)) AS bs FROM a, f)
SELECT 'A' || k AS cell, round(v, 4) AS value, round(0.01 * v, 4) AS upper, NULL::DOUBLE AS lower, NULL AS source FROM b UNION ALL SELECT 'B' || k, round(bv, 4), round(bs, 4), round(sqrt(power(0.01 * v * 1.5, 2) + power(v * 0.05, 2)), 4), 'propagated' FROM b
UNION ALL SELECT 'C' || k, round(bv - v / 2, 4), round(sqrt(bs * bs + power(0.005 * v, 2)), 4), round(sqrt(power(0.01 * v * 1.5, 2) + power(v * 0.05, 2) + power(0.005 * v, 2)), 4), 'propagated' FROM b UNION ALL SELECT 'F1', 1.5, 0.1, 0.05, NULL UNION ALL SELECT 'D' || k, 6.0, NULL, NULL, NULL FROM b""")
def cell_graph(spark, sf_dir):
    """A sheet of four columns over all orders: B and C follow from A and one rate, by formulas of two levels; D from constants."""
    none = F.lit(None).cast("string")
    k = (F.col("o_orderkey") + 1).cast("string")
    o = table(spark, sf_dir, "orders").select(k.alias("k"), F.col("o_totalprice").alias("v"))

    def column(name, formula, value=None, upper=None):
        zero = F.lit(None).cast("double")
        return o.select(F.concat(F.lit(name), "k").alias("cell"), (zero if value is None else value).alias("value"), formula.alias("formula"), (zero if upper is None else upper).alias("upper"), zero.alias("lower"), none.alias("source"))

    v = F.col("v")
    cells = column("A", none, v, v * 0.01).unionByName(column("B", F.concat(F.lit("=A"), "k", F.lit("*$F$1")))).unionByName(column("C", F.concat(F.lit("=b"), "k", F.lit(" - A"), "k", F.lit("/2")))).unionByName(column("D", F.lit("=2*3"), upper=v))
    rate = spark.createDataFrame([("F1", 1.5, None, 0.1, 0.05, None)], cells.schema)
    out = cellgraph.propagate_table(cells.unionByName(rate))
    return out.select("cell", *(F.round(c, 4).alias(c) for c in ("value", "upper", "lower")), "source")


@query("""SELECT l_returnflag, p, CASE p WHEN 0.25 THEN q[1] WHEN 0.5 THEN q[2] ELSE q[3] END AS quantile FROM (SELECT CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_returnflag END AS l_returnflag, quantile_cont(l_extendedprice, [0.25, 0.5, 0.9]) AS q FROM lineitem GROUP BY 1), unnest([0.25::DOUBLE, 0.5::DOUBLE, 0.9::DOUBLE]) AS t(p)""")
def exact_quantiles(spark, sf_dir):
    """Exact quartile, median and ninth decile of prices by flag, one of a null key."""
    flag = F.when(F.col("l_returnflag") != "R", F.col("l_returnflag")).alias("l_returnflag")
    rows = table(spark, sf_dir, "lineitem").select(flag, "l_extendedprice")
    return selection.exact_quantiles(rows, "l_extendedprice", ["l_returnflag"], [0.25, 0.5, 0.9])


@query("""SELECT l_returnflag AS flag, l_extendedprice AS price FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice DESC) AS r FROM lineitem) WHERE r = 5""")
def sheet_large(spark, sf_dir):
    """The fifth largest price of each flag, from one numbering of all rows."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_extendedprice").alias("price"))
    return sheetlike.nth(rows, "price", ["flag"], 5)


@query("""SELECT DISTINCT unnest(string_split(p_name, ' ')) AS tag FROM part""")
def catalog_tags(spark, sf_dir):
    return catalog.all_tags(table(spark, sf_dir, "part").select(F.split("p_name", " ").alias("tags")))


def _orders_listed(spark, sf_dir):
    none = F.lit(None).cast("string")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderstatus").alias("name"), none.alias("description"), F.array().cast("array<string>").alias("tags"), none.alias("unit"), none.alias("source"),
        F.array().cast("array<double>").alias("data"), (F.col("o_orderpriority") == "1-URGENT").alias("is_pinned"), F.col("o_orderdate").alias("created_at"), F.col("o_orderdate").alias("modified_at"),
    )


@query("""SELECT o_orderkey::VARCHAR AS id, o_orderstatus AS name, o_orderpriority = '1-URGENT' AS is_pinned, (SELECT count(*) FROM orders) AS total FROM orders ORDER BY o_orderpriority = '1-URGENT' DESC, o_orderdate DESC, id LIMIT 25 OFFSET 50""")
def catalog_page(spark, sf_dir):
    head, page = catalog.page(_orders_listed(spark, sf_dir), "modified", True, 2, 25)
    return page.select("id", "name", "is_pinned", F.lit(head["total"]).cast("long").alias("total"))


@query("""SELECT o_orderkey::VARCHAR AS id, o_orderstatus AS name, o_orderpriority = '1-URGENT' AS is_pinned, (SELECT count(*) FROM orders) AS total FROM orders ORDER BY o_orderpriority = '1-URGENT' DESC, o_orderdate DESC, id LIMIT 10 OFFSET (SELECT least(1000, (count(*) + 9) // 10 - 1) * 10 FROM orders)""")
def catalog_seek_page(spark, sf_dir):
    """Page 1,000 of the orders (the last, if they are fewer), read as a range of a written listing."""
    path = shared_dir(spark)
    catalog.write_listing(_orders_listed(spark, sf_dir), path)
    head, page = catalog.read_page(spark, path, 1000, 10)
    return page.select("id", "name", "is_pinned", F.lit(head["total"]).cast("long").alias("total"))


@query("""SELECT doc_id, lang FROM documents WHERE source = 'src3'""")
def catalog_source_filter(spark, sf_dir):
    return catalog.search(table(spark, sf_dir, "documents"), source="src3").select("doc_id", "lang")


@query("""SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)""")
def catalog_semijoin(spark, sf_dir):
    picked = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id")
    return table(spark, sf_dir, "documents").join(picked, "doc_id", "left_semi").select("doc_id", "source")


@query("""SELECT c_custkey, c_name, c_nationkey, c_acctbal + CASE WHEN c_custkey % 10 = 0 THEN 100 ELSE 0 END AS c_acctbal, c_mktsegment FROM customer UNION ALL SELECT 900000000, 'new', 0, 0.0, 'NONE'""")
def catalog_upsert(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    changed = c.where("c_custkey % 10 = 0").withColumn("c_acctbal", F.col("c_acctbal") + 100)
    new = spark.createDataFrame([(900000000, "new", 0, 0.0, "NONE")], c.schema)
    return catalog.upsert(c, changed.unionByName(new), "c_custkey")


@query("""SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)""")
def catalog_delete(spark, sf_dir):
    return catalog.delete(table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey").select("c_custkey", "c_mktsegment")


# ---------------------------------------------------------------- files


def _quoted(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.concat("o_orderpriority", F.lit(', "x"')).alias("o_orderpriority"), "o_custkey")


@query("""SELECT o_orderkey::DOUBLE AS c0, o_orderpriority || ', "x"' AS c1, o_custkey::DOUBLE AS c2 FROM orders""")
def text_export_roundtrip(spark, sf_dir):
    path = shared_dir(spark)
    files.write(_quoted(spark, sf_dir), "csv", path)
    return files.read(spark, "csv", path, numeric=["c0", "c2"])


@query("""SELECT o_orderkey::VARCHAR AS c0, o_orderpriority AS c1 FROM orders""")
def text_import(spark, sf_dir):
    path = shared_dir(spark)
    files.write(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), "txt", path, delimiter="|")
    return files.read(spark, "txt", path, delimiter="|")


@query("""SELECT count(*) AS rows, 4::BIGINT AS columns FROM orders""")
def file_metadata(spark, sf_dir):
    path = shared_dir(spark)
    files.write(_quoted(spark, sf_dir), "csv", path)
    m = files.metadata(spark, path, ",")
    return spark.createDataFrame([(m["rows"], m["columns"])], "rows long, columns long")


@query("""SELECT o_orderkey::VARCHAR AS column_1, o_orderpriority AS column_2 FROM orders""")
def parquet_as_text(spark, sf_dir):
    path = shared_dir(spark)
    files.write(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), "parquet", path, as_text=True)
    return files.read(spark, "parquet", path)


@query("""SELECT '<tr><td>' || o_orderkey || '</td><td>' || o_orderpriority || ', &quot;x&quot;' || '</td><td>' || o_custkey || '</td></tr>' AS line FROM orders""")
def html_rows(spark, sf_dir):
    return files.html_rows(_quoted(spark, sf_dir))


@query(r"""SELECT '| ' || o_orderkey || ' | ' || o_orderpriority || '\|z |' AS line FROM orders""")
def markdown_rows(spark, sf_dir):
    return files.markdown_rows(table(spark, sf_dir, "orders").select("o_orderkey", F.concat("o_orderpriority", F.lit("|z")).alias("n")))


@query(r"""SELECT o_orderkey || ' & ' || replace(o_orderpriority, '_', '\_') || '\_100\%\textbackslash{} \\' AS line FROM orders""")
def latex_rows(spark, sf_dir):
    return files.latex_rows(table(spark, sf_dir, "orders").select("o_orderkey", F.concat("o_orderpriority", F.lit("_100%\\")).alias("n")))


@query("""SELECT event_id::DOUBLE AS event_id, epoch_us(ts)::DOUBLE AS ts, value, event_type FROM events""")
def sheet_values(spark, sf_dir):
    return files.sheet_values(table(spark, sf_dir, "events").select("event_id", "ts", "value", "event_type"))


# ---------------------------------------------------------------- sheets


def _cells(spark, sf_dir):
    return sheet.to_cells(table(spark, sf_dir, "orders"), ["o_orderkey"], ["o_orderkey", "o_orderpriority", "o_custkey"])


_CELLS_SQL = """(SELECT (row_number() OVER (ORDER BY o_orderkey) - 1)::INTEGER AS r, unnest([0, 1, 2])::INTEGER AS c, unnest([o_orderkey::VARCHAR, o_orderpriority, o_custkey::VARCHAR]) AS v FROM orders)"""


@query(f"""SELECT r AS "row", c AS col, v AS value FROM {_CELLS_SQL} WHERE r BETWEEN 1 AND 9998 AND c BETWEEN 0 AND 1""")
def range_read(spark, sf_dir):
    return sheet.read_range(_cells(spark, sf_dir), "A2:B9999")


@query(f"""SELECT r AS "row", c AS col, v AS value FROM {_CELLS_SQL} WHERE r < 9990 AND c < 2""")
def truncate_range(spark, sf_dir):
    return sheet.truncate(_cells(spark, sf_dir), "D10:E9999")


@query(f"""SELECT (r - 2)::INTEGER AS "row", c AS col, CASE WHEN r % 5 < 4 THEN v END AS value FROM {_CELLS_SQL} WHERE r >= 2 AND r <= (SELECT max(r) FROM {_CELLS_SQL} WHERE r % 5 < 4)""")
def clean_bounding_box(spark, sf_dir):
    """Two empty rows before the first filled one go, every fifth inside stays empty."""
    filled = (F.col("row") >= 2) & (F.col("row") % 5 < 4)
    return sheet.clean_bounding_box(_cells(spark, sf_dir).withColumn("value", F.when(filled, F.col("value"))))


@query(f"""SELECT r AS "row", list(CASE WHEN (r + c) % 2 = 0 THEN v END ORDER BY c) AS "values" FROM {_CELLS_SQL} GROUP BY r""")
def dense_rows(spark, sf_dir):
    return sheet.dense(_cells(spark, sf_dir).where((F.col("row") + F.col("col")) % 2 == 0), 3)


@query(f"""SELECT r AS "row", c AS col, v::DOUBLE AS value FROM {_CELLS_SQL} WHERE c <> 1""")
def numeric_cells(spark, sf_dir):
    return sheet.numeric_cells(_cells(spark, sf_dir))


@query("""SELECT count(*) AS rows, count(*) FILTER (value IS NULL) AS value_null, 0::BIGINT AS value_blank, 0::BIGINT AS value_non_numeric, 0::BIGINT AS value_non_finite,
0::BIGINT AS event_type_null, 0::BIGINT AS event_type_blank, count(*) FILTER (event_type IS NOT NULL) AS event_type_non_numeric, 0::BIGINT AS event_type_non_finite FROM events""")
def validation_report(spark, sf_dir):
    return sheet.validation_report(table(spark, sf_dir, "events"), ["value", "event_type"])


# ---------------------------------------------------------------- special functions


@query("""SELECT p_partkey, round(acos(1 / x), 9) AS asec, round(asin(1 / x), 9) AS acsc, round(acosh(1 / y), 9) AS asech, round(asinh(1 / x), 9) AS acsch, round(sin(x) / x, 9) AS sinc, round(cbrt(x), 9) AS cbrt
FROM (SELECT p_partkey, p_size + 1.0::DOUBLE AS x, 1.0 / (p_size + 1.0::DOUBLE) AS y FROM part)""")
def special_native(spark, sf_dir):
    from mensura.expr import formula as X

    rows = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") + F.lit(1.0)).alias("x"), (F.lit(1.0) / (F.col("p_size") + F.lit(1.0))).alias("y"))
    at = {"x": F.col("x"), "y": F.col("y")}
    return rows.select("p_partkey", *(F.round(X.to_column(X.parse(f"{n}({v})"), at), 9).alias(n) for n, v in (("asec", "x"), ("acsc", "x"), ("asech", "y"), ("acsch", "x"), ("sinc", "x"), ("cbrt", "x"))))


@query("""SELECT p_size::BIGINT AS p_size, round(log10(gamma(p_size)), 9) AS gamma, round(lgamma(p_size), 9) AS lgamma, round((lgamma(p_size) + lgamma(2.5) - lgamma(p_size + 2.5)) / ln(10), 9) AS beta FROM (SELECT DISTINCT p_size::DOUBLE AS p_size FROM part)""")
def special_gamma_beta(spark, sf_dir):
    x = F.col("p_size").cast("double")
    rows = table(spark, sf_dir, "part").select("p_size").distinct()
    return rows.select(F.col("p_size").cast("long").alias("p_size"), F.round(F.log10(special.column("gamma")(x)), 9).alias("gamma"), F.round(special.lgamma_native(x), 9).alias("lgamma"), F.round(F.log10(special.column("beta")(x, F.lit(2.5))), 9).alias("beta"))


def _zeta_by_sum(s, n: int = 400):
    """Riemann's zeta for s > 1 from its series: n terms, the integral of the rest, and two corrections."""
    terms = F.aggregate(F.sequence(F.lit(1), F.lit(n - 1)), F.lit(0.0), lambda a, k: a + F.pow(k.cast("double"), -s))
    m = F.lit(float(n))
    return terms + F.pow(m, 1 - s) / (s - 1) + F.pow(m, -s) / 2 + s * F.pow(m, -s - 1) / 12


@query("""SELECT p_size::BIGINT AS p_size, round((SELECT sum(power(k::DOUBLE, -s)) FROM range(1, 400) t(k)) + power(400.0::DOUBLE, 1 - s) / (s - 1) + power(400.0::DOUBLE, -s) / 2 + s * power(400.0::DOUBLE, -s - 1) / 12, 9) AS zeta,
round(-0.5772156649015329 + (SELECT coalesce(sum(1.0::DOUBLE / k), 0) FROM range(1, 400) t(k) WHERE k < p_size), 9) AS digamma, round(pi() * pi() / 6 - (SELECT coalesce(sum(1.0::DOUBLE / (k * k)), 0) FROM range(1, 400) t(k) WHERE k < p_size), 9) AS trigamma
FROM (SELECT DISTINCT p_size, p_size + 1.0::DOUBLE AS s FROM part)""")
def special_zeta(spark, sf_dir):
    """Zeta, digamma and trigamma against their series."""
    c, s = special.column, F.col("p_size").cast("double")
    rows = table(spark, sf_dir, "part").select("p_size").distinct()
    return rows.select(F.col("p_size").cast("long").alias("p_size"), F.round(c("zeta")(s + 1), 9).alias("zeta"), F.round(c("digamma")(s), 9).alias("digamma"), F.round(c("trigamma")(s), 9).alias("trigamma"))


@query("""SELECT p_size::BIGINT AS p_size, round((SELECT sum(cos(2 * t - x * sin(t))) FROM a) / 2000, 8) AS j2, round((SELECT sum(exp(x * cos(t)) * cos(t)) FROM a) / 2000, 8) AS i1,
round(2 / sqrt(pi()) * (SELECT sum(exp(-power(x * (k + 0.5) / 2000, 2))) FROM range(2000) r(k)) * x / 2000, 5) AS erf,
round((SELECT sum(1 / sqrt(1 - power(m * sin(t / 2), 2))) FROM a) * pi() / 2 / 2000, 8) AS elliptic_k, round((SELECT sum(sqrt(1 - power(m * sin(t / 2), 2))) FROM a) * pi() / 2 / 2000, 8) AS elliptic_e
FROM (SELECT DISTINCT p_size, p_size / 10.0::DOUBLE AS x, p_size / 60.0::DOUBLE AS m FROM part), (SELECT 1) one""".replace("FROM a)", "FROM (SELECT (k + 0.5) * pi() / 2000 AS t FROM range(2000) r(k)) a)"))
def special_integrals(spark, sf_dir):
    """Bessel, error and elliptic functions against their integrals by the midpoint rule."""
    c, s = special.column, F.col("p_size").cast("double")
    rows = table(spark, sf_dir, "part").select("p_size").distinct()
    x, m = s / 10, s / 60
    return rows.select(
        F.col("p_size").cast("long").alias("p_size"), _r(c("besselj")(F.lit(2.0), x), 8).alias("j2"), _r(c("besseli")(F.lit(1.0), x), 8).alias("i1"), _r(c("erf")(x), 5).alias("erf"), _r(c("elliptic_k")(m), 8).alias("elliptic_k"), _r(c("elliptic_e")(m), 8).alias("elliptic_e")
    )


@query("""SELECT p_size::BIGINT AS p_size, round(8 * x * x * x - 12 * x, 6) AS h3, round((3 * t * t - 1) / 2, 9) AS p2, round(sqrt(5 / (4 * pi())) * (3 * power(cos(t), 2) - 1) / 2, 9) AS y20, TRUE AS digamma_ok, TRUE AS lambertw_ok, TRUE AS elliptic_ok, TRUE AS zeta_ok
FROM (SELECT DISTINCT p_size, p_size / 10.0::DOUBLE AS x, p_size / 51.0::DOUBLE AS t FROM part)""")
def special_other(spark, sf_dir):
    """Closed forms where SQL has them, identities where it has not."""
    c = special.column
    s = F.col("p_size").cast("double")
    x, t = s / 10, s / 51
    rows = table(spark, sf_dir, "part").select("p_size").distinct()
    near = lambda a, b: F.abs(a - b) < 1e-9 * F.greatest(F.lit(1.0), F.abs(b))
    comp = F.sqrt(1 - t * t)
    legendre = c("elliptic_e")(t) * c("elliptic_k")(comp) + c("elliptic_e")(comp) * c("elliptic_k")(t) - c("elliptic_k")(t) * c("elliptic_k")(comp)
    return rows.select(
        F.col("p_size").cast("long").alias("p_size"), _r(special.hermite_native(F.lit(3), x)).alias("h3"), _r(c("assoc_legendre")(F.lit(2.0), F.lit(0.0), t), 9).alias("p2"),
        _r(c("spherical_harmonic")(F.lit(2.0), F.lit(0.0), t, F.lit(0.3)), 9).alias("y20"), near(c("digamma")(x + 1), c("digamma")(x) + 1 / x).alias("digamma_ok"),
        near(c("lambertw")(x) * F.exp(c("lambertw")(x)), x).alias("lambertw_ok"), near(legendre, F.lit(1.5707963267948966)).alias("elliptic_ok"), near(c("zeta")(s + 1), _zeta_by_sum(s + 1)).alias("zeta_ok"),
    )


# ---------------------------------------------------------------- fits


@query("""SELECT user_id, count(*) AS n, round(regr_slope(value, x), 5) AS slope, round(regr_intercept(value, x), 4) AS intercept, round(regr_r2(value, x), 7) AS r2 FROM (SELECT user_id, value, event_id / 1000.0::DOUBLE AS x FROM events) GROUP BY user_id HAVING count(*) > 2""")
def fit_linear_grouped(spark, sf_dir):
    """The general solver on every user's points; without uncertainty in x it must be least squares."""
    rows = table(spark, sf_dir, "events").select("user_id", (F.col("event_id") / F.lit(1000.0)).alias("x"), F.col("value").alias("y"), F.lit(1.0).alias("sy"))
    spec = odr.FitSpec.single("a*x + b", "y", ["x"], ["a", "b"], sigmas={"y": "sy"}, guesses=(0.0, 0.0), tolerance=1e-11)
    out = fits.fit_grouped(rows, ["user_id"], spec).where("n > 2")
    return out.select("user_id", "n", _r(F.get("parameters", F.lit(0)), 5).alias("slope"), _r(F.get("parameters", F.lit(1)), 4).alias("intercept"), _r("r_squared", 7).alias("r2"))


@query("""SELECT l_returnflag, count(*) AS n, round((sw * swxy - swx * swy) / (sw * swxx - swx * swx), 4) AS slope, round((swy * swxx - swx * swxy) / (sw * swxx - swx * swx), 2) AS intercept FROM lineitem JOIN
(SELECT l_returnflag, sum(w) AS sw, sum(w * x) AS swx, sum(w * y) AS swy, sum(w * x * x) AS swxx, sum(w * x * y) AS swxy FROM (SELECT l_returnflag, l_quantity AS x, l_extendedprice AS y, 1 / power(1 + l_tax * 10, 2) AS w FROM lineitem) GROUP BY l_returnflag) USING (l_returnflag) GROUP BY ALL""")
def fit_linear_weighted(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("s", 1 + F.col("l_tax") * 10)
    return fits.fit_line(rows, "l_quantity", "l_extendedprice", ["l_returnflag"], "s").select("l_returnflag", "n", _r("slope", 4).alias("slope"), _r("intercept", 2).alias("intercept"))


_DEMING = """SELECT event_type, n, round(slope, 4) AS slope, round(my - slope * mx, 4) AS intercept FROM (SELECT event_type, n, mx, my, (syy - sxx + sqrt(power(syy - sxx, 2) + 4 * sxy * sxy)) / (2 * sxy) AS slope FROM
(SELECT event_type, count(*) AS n, avg(x) AS mx, avg(y) AS my, var_pop(x) AS sxx, var_pop(y) AS syy, covar_pop(x, y) AS sxy FROM (SELECT event_type, value / 100 AS x, 2 * value / 100 + sin(event_id) AS y FROM events) GROUP BY event_type))"""


@query(_DEMING)
def fit_odr_errors_in_x(spark, sf_dir):
    """Equal uncertainties in x and y: the general solver must give the orthogonal line."""
    rows = table(spark, sf_dir, "events").select("event_type", (F.col("value") / 100).alias("x"), (2 * F.col("value") / 100 + F.sin("event_id")).alias("y"), F.lit(0.5).alias("s"))
    spec = odr.FitSpec.single("a*x + b", "y", ["x"], ["a", "b"], sigmas={"x": "s", "y": "s"}, guesses=(1.0, 0.0))
    out = fits.fit_grouped(rows, ["event_type"], spec)
    return out.select("event_type", "n", _r(F.get("parameters", F.lit(0)), 4).alias("slope"), _r(F.get("parameters", F.lit(1)), 4).alias("intercept"))


@query(_DEMING)
def fit_deming(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_type", (F.col("value") / 100).alias("x"), (2 * F.col("value") / 100 + F.sin("event_id")).alias("y"))
    return fits.fit_deming(rows, "x", "y", ["event_type"]).select("event_type", "n", _r("slope", 4).alias("slope"), _r("intercept", 4).alias("intercept"))


@query("""SELECT k, count(*) AS n, round((syy - sxx + sqrt(power(syy - sxx, 2) + 4 * sxy * sxy)) / (2 * sxy), 5) + 0.0 AS slope,
round(my - (syy - sxx + sqrt(power(syy - sxx, 2) + 4 * sxy * sxy)) / (2 * sxy) * mx, 4) + 0.0 AS intercept FROM (SELECT *, avg(x) OVER w AS mx, avg(y) OVER w AS my,
var_pop(x) OVER w AS sxx, var_pop(y) OVER w AS syy, covar_pop(x, y) OVER w AS sxy FROM (SELECT CASE WHEN l_suppkey % 7 = 0 THEN NULL ELSE l_suppkey % 7 END AS k, l_extendedprice / 1000 AS x, l_extendedprice * (1 - l_discount) * (1 + l_tax) / 1000 AS y FROM lineitem)
WINDOW w AS (PARTITION BY k)) GROUP BY ALL""")
def fit_batched_groups(spark, sf_dir):
    """Lines with equal uncertainties in both variables for groups of suppliers, one of a null key, all advanced together."""
    k = F.col("l_suppkey") % 7
    rows = table(spark, sf_dir, "lineitem").select(F.when(k != 0, k).alias("k"), (F.col("l_extendedprice") / 1000).alias("x"), (F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax")) / 1000).alias("y"), F.lit(0.5).alias("s"))
    spec = odr.FitSpec.single("a*x + b", "y", ["x"], ["a", "b"], sigmas={"x": "s", "y": "s"}, guesses=(1.0, 0.0), tolerance=1e-11)
    out = fits.fit_batched(rows, ["k"], spec)
    return out.select("k", "n", _r(F.get("parameters", F.lit(0)), 5).alias("slope"), _r(F.get("parameters", F.lit(1)), 4).alias("intercept"))


@query("""SELECT count(*) AS n, round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 5) AS intercept, round(regr_r2(y, x), 7) AS r2 FROM (SELECT p_size::DOUBLE AS x, p_retailprice AS y FROM part)""")
def fit_large_table(spark, sf_dir):
    """One fit whose every step is a job over the whole table."""
    rows = table(spark, sf_dir, "part").select(F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"), F.lit(1.0).alias("sy"))
    out = fits.fit_large(rows, odr.FitSpec.single("a*x + b", "y", ["x"], ["a", "b"], sigmas={"y": "sy"}, guesses=(0.0, 900.0), tolerance=1e-11))
    n = out["dof"] + out["rank"]
    return spark.createDataFrame([(n, round(out["parameters"][0], 6), round(out["parameters"][1], 5), round(out["r_squared"], 7))], "n long, slope double, intercept double, r2 double")


@query("""SELECT DISTINCT (p_size % 3)::INTEGER AS k, (p_size % 3 + 2)::DOUBLE AS a, 0.7::DOUBLE AS b, 0.5::DOUBLE AS c, TRUE AS success FROM part""")
def fit_nonlinear(spark, sf_dir):
    """Gaussians of known parameters at places that follow from the parts, with uncertainty in both variables."""
    rows = table(spark, sf_dir, "part").select((F.col("p_size") % 3).cast("int").alias("k"), (F.col("p_partkey") % 81 * 0.05 - 2).alias("x"), F.lit(0.02).alias("sx"), F.lit(0.03).alias("sy"))
    rows = rows.withColumn("y", (F.col("k") + 2) * F.exp(-0.7 * F.col("x") * F.col("x")) + 0.5)
    out = fits.fit_grouped(rows, ["k"], odr.FitSpec.single("a*exp(-b*x^2)+c", "y", ["x"], ["a", "b", "c"], sigmas={"x": "sx", "y": "sy"}, guesses=(1.0, 0.2, 0.0)))
    return out.select("k", *(_r(F.get("parameters", F.lit(i)), 5).alias(n) for i, n in enumerate("abc")), "success")


@query("""SELECT DISTINCT (p_size % 2)::INTEGER AS k, 2.0::DOUBLE AS a, 1.0::DOUBLE AS b, -3.0::DOUBLE AS c, TRUE AS success FROM part""")
def fit_two_layer(spark, sf_dir):
    t = (F.col("p_partkey") % 20).cast("double")
    rows = table(spark, sf_dir, "part").select((F.col("p_size") % 2).cast("int").alias("k"), t.alias("t"), (2 * t + 1).alias("x1"), (2 * (2 * t + 1) - 3).alias("y"), F.lit(0.01).alias("st"), F.lit(0.05).alias("s"))
    spec = odr.FitSpec((odr.Layer("a*t+b", "x1", ("t",)), odr.Layer("a*x1+c", "y", ("x1",))), ("a", "b", "c"), (1.0, 0.0, 0.0), sigmas={"t": "st", "x1": "s", "y": "s"})
    return fits.fit_grouped(rows, ["k"], spec).select("k", *(_r(F.get("parameters", F.lit(i)), 4).alias(n) for i, n in enumerate("abc")), "success")


@query("""SELECT DISTINCT (p_partkey % 2)::INTEGER AS k, 1.0::DOUBLE AS a, TRUE AS success, TRUE AS warned FROM part""")
def fit_poisson(spark, sf_dir):
    x = (F.col("p_size") % 10).cast("double")
    rows = table(spark, sf_dir, "part").select((F.col("p_partkey") % 2).cast("int").alias("k"), x.alias("x"), (x * x).alias("y"))
    out = fits.fit_grouped(rows, ["k"], odr.FitSpec.single("a*x^2", "y", ["x"], ["a"], guesses=(0.5,), poisson=True))
    return out.select("k", _r(F.get("parameters", F.lit(0)), 2).alias("a"), "success", F.exists("warnings", lambda w: w.contains("Poisson")).alias("warned"))


@query("""SELECT DISTINCT (p_partkey % 2)::INTEGER AS k, 1 AS rank, TRUE AS infinite, TRUE AS warned FROM part""")
def fit_rank_deficient(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select((F.col("p_partkey") % 2).cast("int").alias("k"), F.col("p_size").cast("double").alias("x"), F.lit(3.0).alias("y"), F.lit(0.1).alias("s"))
    out = fits.fit_grouped(rows, ["k"], odr.FitSpec.single("a+b", "y", ["x"], ["a", "b"], sigmas={"x": "s", "y": "s"}, guesses=(1.0, 2.0)))
    return out.select("k", "rank", F.forall("sigmas", lambda s: s == float("inf")).alias("infinite"), F.exists("warnings", lambda w: w.contains("rank-deficient")).alias("warned"))


@query("""SELECT l_returnflag, count(*) AS n, round(sum(r * r), 1) AS ssr, round(sqrt(avg(r * r)), 4) AS rmse, round(1 - sum(r * r) / (var_pop(y) * count(*)), 6) AS r2 FROM (SELECT l_returnflag, l_extendedprice AS y, l_extendedprice - 1500 * l_quantity AS r FROM lineitem) GROUP BY l_returnflag""")
def fit_metrics(spark, sf_dir):
    rows = fits.residuals(table(spark, sf_dir, "lineitem"), "a*q", "l_extendedprice", {"q": "l_quantity"}, {"a": 1500.0})
    return fits.fit_metrics(rows, "l_extendedprice", "fitted", ["l_returnflag"]).select("l_returnflag", "n", F.round("ssr", 1).alias("ssr"), _r("rmse", 4).alias("rmse"), _r("r2").alias("r2"))


@query("""SELECT round(sum(l_quantity * l_quantity), 2) AS l_quantity_l_quantity, round(sum(l_quantity * l_discount), 4) AS l_quantity_l_discount, round(sum(l_discount * l_discount), 6) AS l_discount_l_discount FROM lineitem""")
def normal_matrix(spark, sf_dir):
    m = fits.normal_matrix(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount"])
    return m.select(F.round("l_quantity_l_quantity", 2).alias("l_quantity_l_quantity"), F.round("l_quantity_l_discount", 4).alias("l_quantity_l_discount"), F.round("l_discount_l_discount", 6).alias("l_discount_l_discount"))


@query("""SELECT i, round(x, 9) AS x, round(2.5 * x - 4, 9) AS y FROM (SELECT range AS i, CASE WHEN range = 299 THEN hi ELSE lo + range * ((hi - lo) / 299) END AS x FROM range(300), (SELECT min(p_retailprice) - (max(p_retailprice) - min(p_retailprice)) * 0.1 AS lo, max(p_retailprice) + (max(p_retailprice) - min(p_retailprice)) * 0.1 AS hi FROM part))""")
def curve_grid(spark, sf_dir):
    """A line over the padded range of the parts' prices."""
    low, high = grid.padded_range(table(spark, sf_dir, "part"), "p_retailprice")
    return grid.curve(spark, "a*x + b", "x", low, high, {"a": 2.5, "b": -4.0}).select("i", _r("x", 9).alias("x"), _r("y", 9).alias("y"))


@query("""SELECT i, round(x, 9) AS x, round(y, 9) AS y, round(x * x + 2 * y, 9) AS z FROM (SELECT range AS i, CASE WHEN range % 30 = 29 THEN a.hi ELSE a.lo + (range % 30) * ((a.hi - a.lo) / 29) END AS x, CASE WHEN range // 30 = 29 THEN b.hi ELSE b.lo + (range // 30) * ((b.hi - b.lo) / 29) END AS y FROM range(900), (SELECT min(l_discount) - (max(l_discount) - min(l_discount)) * 0.1 AS lo, max(l_discount) + (max(l_discount) - min(l_discount)) * 0.1 AS hi FROM lineitem) a, (SELECT min(l_tax) - (max(l_tax) - min(l_tax)) * 0.1 AS lo, max(l_tax) + (max(l_tax) - min(l_tax)) * 0.1 AS hi FROM lineitem) b)""")
def surface_grid(spark, sf_dir):
    """A surface over the padded ranges of discounts and taxes."""
    rows = table(spark, sf_dir, "lineitem")
    spans = [grid.padded_range(rows, c) for c in ("l_discount", "l_tax")]
    return grid.surface(spark, "u^2 + k*v", ("u", "v"), *spans, {"k": 2.0}).select("i", *(_r(c, 9).alias(c) for c in "xyz"))


@query("""SELECT p_partkey, round(900 + 2.0 * p_size, 6) AS fitted, round(p_retailprice - 900 - 2.0 * p_size, 6) AS residual FROM part""")
def residual_table(spark, sf_dir):
    rows = fits.residuals(table(spark, sf_dir, "part"), "c + m*s", "p_retailprice", {"s": "p_size"}, {"c": 900.0, "m": 2.0})
    return rows.select("p_partkey", _r("fitted").alias("fitted"), _r("residual").alias("residual"))


@query("""SELECT round(min(least(y, f)) - (max(greatest(y, f)) - min(least(y, f))) * 0.05, 6) AS low, round(max(greatest(y, f)) + (max(greatest(y, f)) - min(least(y, f))) * 0.05, 6) AS high FROM (SELECT p_retailprice AS y, 900 + 2.0 * p_size AS f FROM part)""")
def predicted_range(spark, sf_dir):
    rows = fits.residuals(table(spark, sf_dir, "part"), "c + m*s", "p_retailprice", {"s": "p_size"}, {"c": 900.0, "m": 2.0})
    return grid.predicted_observed(rows, "p_retailprice").select(_r("low").alias("low"), _r("high").alias("high"))


@query("""SELECT event_type, n, round(slope, 8) AS slope, round(sqrt(scale / sxx), 8) AS slope_sigma, round(sqrt(scale * (1.0 / n + mx * mx / sxx)), 8) AS intercept_sigma, round(sqrt(1 / sxx) * 0.5, 8) AS slope_raw, round(-mx * scale / sxx, 8) AS covariance,
round(-mx / sqrt(sxx / n + mx * mx), 8) AS correlation, round(ssr / 0.25, 4) AS chi2, round(ssr / 0.25 / (n - 2), 6) AS chi2_reduced, n - 2 AS dof, (n - 2)::DOUBLE AS effective_dof, round(sqrt(ssr / n), 8) AS rmse, 2 AS rank, TRUE AS k_ok
FROM (SELECT *, sxy / sxx AS slope, syy - sxy * sxy / sxx AS ssr, (syy - sxy * sxy / sxx) / (n - 2) AS scale FROM (SELECT event_type, count(*) AS n, avg(x) AS mx, regr_sxx(y, x) AS sxx, regr_sxy(y, x) AS sxy, regr_syy(y, x) AS syy
FROM (SELECT event_type, event_id / 1000.0::DOUBLE AS x, 3 * event_id / 1000.0::DOUBLE + sin(value) AS y FROM events) GROUP BY event_type))""")
def fit_inference(spark, sf_dir):
    """The general solver's inference: covariance raw and scaled, correlation, degrees of freedom, metrics."""
    x = F.col("event_id") / F.lit(1000.0)
    rows = table(spark, sf_dir, "events").select("event_type", x.alias("x"), (3 * x + F.sin("value")).alias("y"), F.lit(0.5).alias("s"))
    out = fits.fit_groups(rows, ["event_type"], odr.FitSpec.single("a*x + b", "y", ["x"], ["a", "b"], sigmas={"y": "s"}, guesses=(1.0, 0.0), tolerance=1e-11))
    at = lambda c, i, n=8: _r(F.get(c, F.lit(i)), n)
    k = F.col("coverage_factor")
    # Cornish and Fisher's expansion of Student's quantile about the normal one
    z, v = 1.959963984540054, F.col("effective_dof")
    want = F.lit(z) + (z**3 + z) / (4 * v) + (5 * z**5 + 16 * z**3 + 3 * z) / (96 * v * v)
    good = (F.abs(k - want) < 1e-3) & (F.abs(F.get("expanded", F.lit(0)) - k * F.get("sigmas", F.lit(0))) < 1e-12)
    return out.select(
        "event_type", "n", at("parameters", 0).alias("slope"), at("sigmas", 0).alias("slope_sigma"), at("sigmas", 1).alias("intercept_sigma"), at("sigmas_raw", 0).alias("slope_raw"), _r(F.get(F.get("covariance", F.lit(0)), F.lit(1)), 8).alias("covariance"),
        _r(F.get(F.get("correlation", F.lit(0)), F.lit(1)), 8).alias("correlation"), _r("chi2", 4).alias("chi2"), _r("chi2_reduced").alias("chi2_reduced"), "dof", "effective_dof", _r("rmse", 8).alias("rmse"), "rank", good.alias("k_ok"),
    )


@query("""SELECT event_id, value, row_number() OVER (ORDER BY value, event_id) - 1 AS "row" FROM events""")
def row_numbers(spark, sf_dir):
    """Every event's place in the order of values: no single-partition window."""
    return sheet.numbered(table(spark, sf_dir, "events").select("event_id", "value"), ["value", "event_id"])


# ---------------------------------------------------------------- sheet functions over tables


@query("""SELECT l_returnflag, sum(q) AS "SUM", count(q) AS "COUNT", count(*) FILTER (q > 25) AS "COUNTIF", sum(p) FILTER (q > 25) AS "SUMIF", round(avg(p), 4) AS "AVERAGE", median(q) AS "MEDIAN", round(var_samp(q), 6) AS "VAR", round(stddev_pop(q), 6) AS "STDEVP",
round(quantile_cont(q, 0.25), 6) AS "QUARTILE", round(corr(q, p), 8) AS "CORREL", round(regr_slope(p, q), 4) AS "SLOPE", round(regr_r2(p, q), 8) AS "RSQ", round(exp(avg(ln(q))), 6) AS "GEOMEAN", round(1 / avg(1 / q), 6) AS "HARMEAN", sum(q * q) AS "SUMSQ",
round(var_pop(q) * count(q), 2) AS "DEVSQ", round(skewness(q), 5) AS "SKEW", round(kurtosis(q), 5) AS "KURT", round(sum((q - t) * (q - t)), 3) AS "SUMXMY2", round(sqrt((regr_syy(p, q) - power(regr_sxy(p, q), 2) / regr_sxx(p, q)) / (count(*) - 2)), 4) AS "STEYX"
FROM (SELECT l_returnflag, l_quantity AS q, round(l_extendedprice, 0) AS p, l_tax AS t FROM lineitem) GROUP BY l_returnflag""")
def sheet_aggregates(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_quantity").alias("q"), F.round("l_extendedprice", 0).alias("p"), F.col("l_tax").alias("t"))
    q, p, t, a = F.col("q"), F.col("p"), F.col("t"), sheetlike.aggregate
    return rows.groupBy("l_returnflag").agg(
        *(a(n, q).alias(n) for n in ("SUM", "COUNT", "MEDIAN", "SUMSQ")), a("COUNTIF", q > 25).alias("COUNTIF"), a("SUMIF", p, q > 25).alias("SUMIF"), F.round(a("AVERAGE", p), 4).alias("AVERAGE"),
        *(F.round(a(n, q), 6).alias(n) for n in ("VAR", "STDEVP", "GEOMEAN", "HARMEAN")), F.round(a("QUARTILE", q, F.lit(1)), 6).alias("QUARTILE"), F.round(a("CORREL", q, p), 8).alias("CORREL"), F.round(a("SLOPE", p, q), 4).alias("SLOPE"), F.round(a("RSQ", p, q), 8).alias("RSQ"),
        F.round(a("DEVSQ", q), 2).alias("DEVSQ"), F.round(a("SKEW", q), 5).alias("SKEW"), F.round(a("KURT", q), 5).alias("KURT"), F.round(a("SUMXMY2", q, t), 3).alias("SUMXMY2"), F.round(a("STEYX", p, q), 4).alias("STEYX"),
    )


@query("""SELECT p_partkey, upper(left(p_name, 3)) AS head, length(p_name) AS n, p_size % 7 AS "mod", CASE WHEN p_size % 2 = 0 THEN p_size ELSE p_size + 1 END::DOUBLE AS even, gcd(p_size, 12)::BIGINT AS gcd, lcm(p_size, 12)::DOUBLE AS lcm, trunc(p_retailprice / 7 * 100) / 100 AS trunc,
p_size BETWEEN 10 AND 20 AS between_, bin(p_size) AS bin, replace(p_name, ' ', '_') AS sub FROM part""")
def sheet_scalars(spark, sf_dir):
    s, n, f = F.col("p_size"), F.col("p_name"), sheetlike.scalar
    return table(spark, sf_dir, "part").select(
        "p_partkey", f("UPPER", f("LEFT", n, 3)).alias("head"), f("LEN", n).cast("long").alias("n"), f("MOD", s, 7).cast("int").alias("mod"), f("EVEN", s).cast("double").alias("even"), f("GCD", s, 12).alias("gcd"), f("LCM", s, 12).cast("double").alias("lcm"),
        f("TRUNC", F.col("p_retailprice") / 7, 2).alias("trunc"), f("ISBETWEEN", s, 10, 20).alias("between_"), f("DEC2BIN", s).alias("bin"), f("SUBSTITUTE", n, " ", "_").alias("sub"),
    )


@query("""SELECT event_id, r AS found FROM events ASOF LEFT JOIN (SELECT s_acctbal AS k, min(s_suppkey) AS r FROM supplier GROUP BY s_acctbal) ON value * 20 >= k""")
def sheet_lookup_approximate(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", (F.col("value") * 20).alias("x"))
    return sheetlike.lookup(rows, table(spark, sf_dir, "supplier"), "x", "s_acctbal", "s_suppkey", "found", approximate=True).select("event_id", "found")


@query("""SELECT o_orderkey, c_mktsegment AS segment FROM orders LEFT JOIN customer ON o_custkey = c_custkey""")
def sheet_lookup_exact(spark, sf_dir):
    return sheetlike.lookup(table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer"), "o_custkey", "c_custkey", "c_mktsegment", "segment").select("o_orderkey", "segment")


@query("""SELECT p_brand, p_partkey, rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC)::INTEGER AS rank, round(percent_rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice), 9) AS percent_rank FROM part""")
def sheet_ranks(spark, sf_dir):
    out = sheetlike.ranks(table(spark, sf_dir, "part"), "p_retailprice", ["p_brand"])
    return out.select("p_brand", "p_partkey", F.col("rank").cast("int").alias("rank"), F.round("percent_rank", 9).alias("percent_rank"))


@query("""SELECT l_returnflag, count(*) AS n, round(power(sum(u2), 2) / sum(u2 * u2 / nu), 3) AS effective_dof FROM (SELECT l_returnflag, power(0.01 * l_extendedprice, 2) AS u2, l_linenumber + 3 AS nu FROM lineitem) GROUP BY l_returnflag""")
def welch_satterthwaite(spark, sf_dir):
    """Effective degrees of freedom of a sum from its components: two sums, then the closed form."""
    u = F.pow(F.col("l_extendedprice") * 0.01, F.lit(2))
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", u.alias("u2"), (F.col("l_linenumber") + 3).alias("nu"))
    out = rows.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.sum("u2").alias("a"), F.sum(F.col("u2") * F.col("u2") / F.col("nu")).alias("b"))
    return out.select("l_returnflag", "n", F.round(F.col("a") * F.col("a") / F.col("b"), 3).alias("effective_dof"))


@query("""SELECT l_returnflag, count(*) FILTER (q > 10 AND t < 0.05) AS countifs, round(sum(p) FILTER (q > 10 AND t < 0.05), 2) AS sumifs, round(avg(p) FILTER (q > 10 AND t < 0.05), 4) AS averageifs, max(q) AS subtotal_max, sum(q) FILTER (t >= 0.05) AS subtotal_visible,
median(q) AS aggregate_median, sum(q) FILTER ((q > 40 AND t < 0.02) OR t > 0.07) AS dsum, max(q) FILTER (q > 40) AS dmax, round(var_samp(q) FILTER (t > 0.07), 6) AS dvar FROM (SELECT l_returnflag, l_quantity AS q, l_extendedprice AS p, l_tax AS t FROM lineitem) GROUP BY l_returnflag""")
def sheet_conditions(spark, sf_dir):
    q, p, t = F.col("l_quantity"), F.col("l_extendedprice"), F.col("l_tax")
    a, d = sheetlike.aggregate, sheetlike.database
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(
        a("COUNTIFS", q > 10, t < 0.05).alias("countifs"), F.round(a("SUMIFS", p, q > 10, t < 0.05), 2).alias("sumifs"), F.round(a("AVERAGEIFS", p, q > 10, t < 0.05), 4).alias("averageifs"), sheetlike.subtotal(4, q).alias("subtotal_max"), sheetlike.subtotal(109, q, t < 0.05).alias("subtotal_visible"),
        sheetlike.numbered_aggregate(12, q).alias("aggregate_median"), d("DSUM", q, [{"q": q > 40, "t": t < 0.02}, {"t": t > 0.07}]).alias("dsum"), d("DMAX", q, q > 40).alias("dmax"), F.round(d("DVAR", q, t > 0.07), 6).alias("dvar"),
    )


@query("""SELECT event_type, round(avg(abs(value - m)), 6) AS avedev FROM events JOIN (SELECT event_type, avg(value) AS m FROM events GROUP BY event_type) USING (event_type) GROUP BY event_type""")
def sheet_average_deviation(spark, sf_dir):
    return sheetlike.average_deviation(table(spark, sf_dir, "events"), "value", ["event_type"]).select("event_type", _r("avedev").alias("avedev"))


@query("""SELECT o_orderkey, c.place AS position FROM orders LEFT JOIN (SELECT c_custkey, row_number() OVER (ORDER BY c_name, c_custkey) AS place FROM customer) c ON o_custkey = c_custkey""")
def sheet_match(spark, sf_dir):
    return sheetlike.match(table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer"), "o_custkey", "c_custkey", ["c_name", "c_custkey"]).select("o_orderkey", "position")


@query("""SELECT DISTINCT c_nationkey AS k, c_mktsegment AS t FROM customer UNION ALL SELECT s_nationkey, NULL FROM (SELECT DISTINCT s_nationkey FROM supplier)""")
def sheet_unique_vstack(spark, sf_dir):
    a = sheetlike.unique(table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_mktsegment").alias("t")))
    return sheetlike.vstack(a, sheetlike.unique(table(spark, sf_dir, "supplier"), ["s_nationkey"]))


@query("""SELECT "row", p_partkey, s_suppkey FROM (SELECT row_number() OVER (ORDER BY p_retailprice, p_partkey) - 1 AS "row", p_partkey FROM part) FULL JOIN (SELECT row_number() OVER (ORDER BY s_acctbal, s_suppkey) - 1 AS "row", s_suppkey FROM supplier) USING ("row")""")
def sheet_hstack(spark, sf_dir):
    a, b = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal")
    return sheetlike.hstack(a, b, ["p_retailprice", "p_partkey"], ["s_acctbal", "s_suppkey"]).select("row", "p_partkey", "s_suppkey")


@query("""SELECT o_orderkey::DOUBLE AS o_orderkey, o_orderstatus, o_totalprice FROM orders""")
def text_header_roundtrip(spark, sf_dir):
    """A table of many parts, each with its header, as tab-separated text and back."""
    path = shared_dir(spark)
    files.write(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice").repartition(5), "tsv", path, header=True)
    return files.read(spark, "tsv", path, header=True, numeric=["o_orderkey", "o_totalprice"])


@query("""SELECT p_size::DOUBLE AS x, p_retailprice AS y FROM part""")
def numeric_import(spark, sf_dir):
    """The strict reader of numbers: the delimiter is guessed, columns are named by the header."""
    path = shared_dir(spark)
    files.write(table(spark, sf_dir, "part").select(F.col("p_size").alias("x"), F.col("p_retailprice").alias("y")), "txt", path, delimiter=";", header=True)
    return files.read_numeric(spark, path)


@query("""SELECT a.r AS "row", b.c AS col, sum(a.v * b.v) AS value FROM (SELECT o_custkey % 200 AS r, o_orderkey % 300 AS c, sum(floor(o_totalprice)) AS v FROM orders GROUP BY ALL) a JOIN (SELECT l_orderkey % 300 AS r, l_suppkey % 40 AS c, sum(floor(l_quantity)) AS v FROM lineitem GROUP BY ALL) b ON a.c = b.r GROUP BY ALL""")
def matrix_product(spark, sf_dir):
    """Customers by orders times orders by suppliers, in blocks; whole numbers, so that sums are exact."""
    o = table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 200).alias("row"), (F.col("o_orderkey") % 300).alias("col")).agg(F.sum(F.floor("o_totalprice")).alias("value"))
    i = table(spark, sf_dir, "lineitem").groupBy((F.col("l_orderkey") % 300).alias("row"), (F.col("l_suppkey") % 40).alias("col")).agg(F.sum(F.floor("l_quantity")).alias("value"))
    return matrix.mmult(o, i)


@query("""SELECT l_returnflag, round(regr_intercept(y, x), 4) AS intercept, round(regr_slope(y, x), 6) AS slope, round(regr_r2(y, x), 6) AS r2, round(sqrt((regr_syy(y, x) - power(regr_sxy(y, x), 2) / regr_sxx(y, x)) / (count(*) - 2)), 4) AS se_y, count(*) - 2 AS dof
FROM (SELECT l_returnflag, l_extendedprice / 1000 AS x, l_extendedprice * (1 - l_discount) / 1000 AS y FROM lineitem) GROUP BY l_returnflag""")
def sheet_linest(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", (F.col("l_extendedprice") / 1000).alias("x"), (F.col("l_extendedprice") * (1 - F.col("l_discount")) / 1000).alias("y"))
    out = matrix.linest(rows, "y", ["x"], ["l_returnflag"])
    return out.select("l_returnflag", _r(F.get("coefficients", F.lit(0)), 4).alias("intercept"), _r(F.get("coefficients", F.lit(1))).alias("slope"), _r("r2").alias("r2"), _r("se_y", 4).alias("se_y"), "dof")


@query("""WITH b AS (SELECT DISTINCT s_acctbal AS bound FROM supplier), e AS (SELECT bound, lag(bound) OVER (ORDER BY bound) AS before FROM b UNION ALL SELECT NULL, max(bound) FROM b), v AS (SELECT l_extendedprice / 10 AS v FROM lineitem)
SELECT bound, (SELECT count(*) FROM v WHERE (before IS NULL OR v > before) AND (bound IS NULL OR v <= bound))::BIGINT AS n FROM e""")
def sheet_frequency(spark, sf_dir):
    """Prices counted between the suppliers' balances."""
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_extendedprice") / 10).alias("v"))
    return matrix.frequency(rows, "v", table(spark, sf_dir, "supplier"), "s_acctbal")


@query("""SELECT l_returnflag, round(avg(v), 4) AS trimmean FROM (SELECT l_returnflag, l_extendedprice AS v, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) AS r, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem) WHERE r > floor(n * 0.25 / 2) AND r <= n - floor(n * 0.25 / 2) GROUP BY l_returnflag""")
def sheet_trimmean(spark, sf_dir):
    out = matrix.trimmean(table(spark, sf_dir, "lineitem"), "l_extendedprice", ["l_returnflag"], 0.25)
    return out.select("l_returnflag", _r("trimmean", 4).alias("trimmean"))


@query("""WITH c AS (SELECT l_suppkey % 5 AS suppliers, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS r, l_linenumber % 3 AS c, avg(l_extendedprice) / 1000 AS v FROM lineitem GROUP BY ALL),
m AS (SELECT suppliers, max(v) FILTER (r = 0 AND c = 0) AS a, max(v) FILTER (r = 0 AND c = 1) AS b, max(v) FILTER (r = 0 AND c = 2) AS c, max(v) FILTER (r = 1 AND c = 0) AS d, max(v) FILTER (r = 1 AND c = 1) AS e, max(v) FILTER (r = 1 AND c = 2) AS f, max(v) FILTER (r = 2 AND c = 0) AS g, max(v) FILTER (r = 2 AND c = 1) AS h, max(v) FILTER (r = 2 AND c = 2) AS i FROM c GROUP BY suppliers)
SELECT suppliers, 3::INTEGER AS n, round(a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g), 4) AS determinant FROM m""")
def matrix_determinant(spark, sf_dir):
    """For each fifth of the suppliers, the determinant of mean prices by return flag and line."""
    row = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    means = table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 5).alias("suppliers"), row.alias("row"), (F.col("l_linenumber") % 3).alias("col")).agg((F.avg("l_extendedprice") / 1000).alias("value"))
    return elimination.mdeterm(means, ["suppliers"]).select("suppliers", "n", _r("determinant", 4).alias("determinant"))


# ---------------------------------------------------------------- changes of the library, uncertain cells


def _rows_to_insert(spark, sf_dir):
    """Customers as rows of the library; by their key some lack what a row needs."""
    k = F.col("c_custkey") % 7
    return table(spark, sf_dir, "customer").select(
        F.when(k == 0, F.lit(None).cast("string")).when(k == 1, F.concat(F.lit("s"), (F.col("c_custkey") % 5 + 1).cast("string"))).otherwise(F.concat(F.lit("c"), F.col("c_custkey").cast("string"))).alias("id"),
        F.when(k == 2, " ").otherwise(F.col("c_name")).alias("name"),
        F.when(k != 3, F.array("c_acctbal")).alias("data"),
        F.when(k == 4, F.array(F.lit(0.1), F.lit(0.2))).when(k == 5, F.array(F.lit(0.1))).alias("uncertainties"),
    )


def _suppliers_listed(spark, sf_dir):
    none = F.lit(None).cast("array<double>")
    return table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"), F.col("s_name").alias("name"), F.array("s_acctbal").alias("data"), none.alias("uncertainties"))


@query("""SELECT 's' || s_suppkey AS id, s_name AS name, NULL::VARCHAR AS error FROM supplier UNION ALL SELECT CASE c_custkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 's' || (c_custkey % 5 + 1) ELSE 'c' || c_custkey END, CASE WHEN c_custkey % 7 = 2 THEN ' ' ELSE c_name END,
CASE c_custkey % 7 WHEN 0 THEN 'missing id' WHEN 1 THEN 'id exists' WHEN 2 THEN 'missing name' WHEN 3 THEN 'missing data' WHEN 4 THEN 'uncertainties differ in length' END FROM customer""")
def catalog_insert(spark, sf_dir):
    """Customers inserted beside the suppliers: what is valid stays, the rest comes back with its error."""
    kept, rejected = catalog.insert(_suppliers_listed(spark, sf_dir), _rows_to_insert(spark, sf_dir))
    return kept.select("id", "name", F.lit(None).cast("string").alias("error")).unionByName(rejected.select("id", "name", "error"))


@query("""SELECT c_custkey, c_name, CASE WHEN c_custkey % 6 = 3 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal, CASE WHEN c_custkey % 6 = 0 THEN 'MOVED' ELSE c_mktsegment END AS c_mktsegment FROM customer""")
def catalog_update(spark, sf_dir):
    """Partial changes of every third customer: fields that a change leaves null stay."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    even = F.col("c_custkey") % 2 == 0
    changes = c.where("c_custkey % 3 = 0").select("c_custkey", F.when(~even, F.col("c_acctbal") + 1).alias("c_acctbal"), F.when(even, "MOVED").alias("c_mktsegment"))
    return catalog.update(c, changes, "c_custkey")


@query("""SELECT 's' || s_suppkey AS id, s_name AS name, s_suppkey IN (1, 3) AS is_pinned FROM supplier UNION ALL SELECT 'copy', s_name || ' (copy)', FALSE FROM supplier WHERE s_suppkey = 3""")
def catalog_pin_duplicate(spark, sf_dir):
    """Two suppliers pinned, one of them duplicated: the copy is not pinned."""
    listed = _suppliers_listed(spark, sf_dir).withColumn("is_pinned", F.lit(False))
    return catalog.duplicate(catalog.pin(listed, ["s1", "s3"]), "s3", "copy").select("id", "name", "is_pinned")


def _sequences(spark, sf_dir):
    """Users' values as sequences, with uncertainties for odd users, and an empty sequence for each customer."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("id"), F.col("event_id").alias("idx"), "value", F.when(F.col("user_id") % 2 == 1, F.abs("value") * 0.5).alias("sigma"))
    none = F.array().cast("array<double>")
    empty = table(spark, sf_dir, "customer").select(F.concat(F.lit("e"), F.col("c_custkey").cast("string")).alias("id"), none.alias("data"), none.alias("uncertainties"))
    return catalog.to_wide(rows).unionByName(empty)


@query("""SELECT user_id::VARCHAR AS id, count(*) AS "count", round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std_dev, min(value) AS min, max(value) AS max, round(median(value), 6) AS median, user_id % 2 = 1 AS has_uncertainties FROM events GROUP BY user_id
UNION ALL SELECT 'e' || c_custkey, 0, 0, 0, 0, 0, 0, FALSE FROM customer""")
def sequence_catalog_stats(spark, sf_dir):
    """Statistics by row of the library; an empty sequence has zeros."""
    out = catalog.sequence_statistics(_sequences(spark, sf_dir))
    return out.select("id", F.col("count").cast("long").alias("count"), _r("mean").alias("mean"), _r("std_dev").alias("std_dev"), "min", "max", _r("median").alias("median"), "has_uncertainties")


@query("""SELECT user_id::VARCHAR AS id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1)::INTEGER AS idx, value, CASE WHEN user_id % 2 = 1 THEN abs(value) * 0.5 END AS sigma FROM events""")
def sequence_points(spark, sf_dir):
    """Sequences as points, each value beside its uncertainty; sequences whose lengths differ would raise."""
    return catalog.zip_strict(_sequences(spark, sf_dir))


@query("""SELECT count(*) FILTER (event_id % 10 = 2) AS v_null, count(*) FILTER (event_id % 10 < 2) AS v_nonfinite, count(*) FILTER (value IS NULL) AS value_null, 0::BIGINT AS value_nonfinite FROM events""")
def finite_report(spark, sf_dir):
    k = F.col("event_id") % 10
    v = F.when(k == 0, float("nan")).when(k == 1, float("inf")).when(k > 2, F.lit(1.0))
    return uncertainty.finite_report(table(spark, sf_dir, "events").select("value", v.alias("v")), ["v", "value"])


@query("""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN abs(p_retailprice) * p_size * 0.01 ELSE p_size END::DOUBLE AS bound, p_partkey || ' ± ' || p_size AS edited, printf(f, p_partkey::DOUBLE) || ' ± ' || printf(f, u) AS shown, printf(f, p_partkey::DOUBLE) || ' +' || printf(f, u) || '/-' || printf(f, u / 4) AS sides
FROM (SELECT *, '%.' || (CASE WHEN u / power(10.0, floor(log10(u))) < 2.95 THEN 1 ELSE 0 END - floor(log10(u)))::INTEGER || 'f' AS f FROM (SELECT *, p_size * 0.0137 AS u FROM part))""")
def uncertain_text(spark, sf_dir):
    """Bounds in percent made absolute, and the texts of uncertain values as shown and as edited."""
    key, size = F.col("p_partkey"), F.col("p_size")
    upper = size * 0.0137
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        uncertainty.absolute(F.col("p_retailprice"), size.cast("double"), F.when(key % 2 == 0, "relative").otherwise("absolute")).alias("bound"),
        uncertainty.edit_text(key, size).alias("edited"),
        uncertainty.format_uncertain(key.cast("double"), upper).alias("shown"),
        uncertainty.format_uncertain(key.cast("double"), upper, upper / 4).alias("sides"),
    )


@query("""SELECT o_orderkey AS idx, formula, CASE WHEN formula IS NULL THEN u ELSE -1.0 END::DOUBLE AS upper, CASE WHEN formula IS NULL THEN u / 2 ELSE -2.0 END::DOUBLE AS lower FROM (SELECT o_orderkey, CASE WHEN o_custkey % 4 = 0 THEN 'A1*2' END AS formula, o_orderkey % (SELECT count(*) FROM part) AS place FROM orders)
JOIN (SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS place, p_size::DOUBLE AS u FROM part) USING (place)""")
def uncertainty_autofill(spark, sf_dir):
    """The parts' uncertainties copied cyclically over the orders; rows with a formula keep theirs."""
    source = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("idx"), F.col("p_size").cast("double").alias("upper"), (F.col("p_size") / 2.0).alias("lower"))
    targets = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("idx"), F.when(F.col("o_custkey") % 4 == 0, "A1*2").alias("formula"), F.lit(-1.0).alias("upper"), F.lit(-2.0).alias("lower"))
    return uncertainty.autofill(targets, source)


# ---------------------------------------------------------------- fits with correlated and several variables


@query("""SELECT event_type, n, round(slope, 4) AS slope, round(my - slope * mx, 4) AS intercept FROM (SELECT *, (syy - sxx + sqrt(power(syy - sxx, 2) + 4 * (sxy - 0.5 * sxx) * (sxy - 0.5 * syy))) / (2 * (sxy - 0.5 * sxx)) AS slope FROM
(SELECT event_type, count(*) AS n, avg(x) AS mx, avg(y) AS my, var_pop(x) AS sxx, var_pop(y) AS syy, covar_pop(x, y) AS sxy FROM (SELECT event_type, value / 100 AS x, 2 * value / 100 + sin(event_id) AS y FROM events) GROUP BY event_type))""")
def fit_correlated(spark, sf_dir):
    """Errors of x and y correlated by 0.5: the profiled line has a closed form by moments. All groups advance together."""
    rows = table(spark, sf_dir, "events").select("event_type", (F.col("value") / 100).alias("x"), (2 * F.col("value") / 100 + F.sin("event_id")).alias("y"), F.lit(0.5).alias("s"))
    spec = odr.FitSpec.single("a*x + b", "y", ["x"], ["a", "b"], sigmas={"x": "s", "y": "s"}, guesses=(1.0, 0.0), correlation=((1.0, 0.5), (0.5, 1.0)))
    out = fits.fit_batched(rows, ["event_type"], spec)
    return out.select("event_type", "n", _r(F.get("parameters", F.lit(0)), 4).alias("slope"), _r(F.get("parameters", F.lit(1)), 4).alias("intercept"))


@query("""SELECT event_type, count(*) AS n, 2.0::DOUBLE AS p, -3.0::DOUBLE AS q, 0.5::DOUBLE AS r, 1.0::DOUBLE AS s, 4 AS rank, TRUE AS success FROM events GROUP BY event_type""")
def fit_three_variables(spark, sf_dir):
    """A plane over three uncertain, correlated variables, through places that follow from the events."""
    x1, x2, x3 = F.col("value") / 100, F.sin("event_id") * 2, F.cos(F.col("event_id") * 0.7)
    rows = table(spark, sf_dir, "events").select("event_type", x1.alias("x1"), x2.alias("x2"), x3.alias("x3"), (2 * x1 - 3 * x2 + 0.5 * x3 + 1).alias("y"), F.lit(0.05).alias("s"))
    rho = ((1.0, 0.3, 0.1, 0.2), (0.3, 1.0, 0.25, -0.1), (0.1, 0.25, 1.0, 0.15), (0.2, -0.1, 0.15, 1.0))
    spec = odr.FitSpec.single("p*x1 + q*x2 + r*x3 + s", "y", ["x1", "x2", "x3"], list("pqrs"), sigmas=dict.fromkeys(("x1", "x2", "x3", "y"), "s"), guesses=(0.0,) * 4, correlation=rho)
    out = fits.fit_batched(rows, ["event_type"], spec)
    return out.select("event_type", "n", *(_r(F.get("parameters", F.lit(i)), 5).alias(c) for i, c in enumerate("pqrs")), "rank", "success")
