"""Registered queries of the engine over the driver's tables, each with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Engine
from .functions import trigrams
from .functions.rosmsg import parse, spark_type
from .functions.schema import flatten
from .operators import asof, stats
from .operators.visibility import deduplicated, masked, visible, without_range
from .plans.lower import union
from .sources import mcap
from .sources.base import Topics
from .sources.scratch import scratch_dir
from .sources.store import LogStore, databases
from .sources.tables import driver_topics

Query = Callable[[SparkSession, str], DataFrame]
ROW = ("log_time", "producer", "topic", "sequence")
DAY_NS = 86_400 * 10**9

_EVENTS = """ev AS (SELECT epoch_ns(ts) AS log_time, CAST(user_id AS VARCHAR) AS producer, '/' || event_type AS topic, event_id AS sequence, value, event_type, props FROM events)"""
_ORDERS = """od AS (SELECT epoch_ns(o_orderdate) AS log_time, o_orderstatus AS producer, '/orders' AS topic, o_orderkey AS sequence, o_custkey, o_totalprice, o_orderpriority FROM orders)"""
_LINES = """li AS (SELECT epoch_ns(l_shipdate) AS log_time, l_returnflag AS producer, '/lineitem' AS topic, l_orderkey * 1000 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_shipdate, l_extendedprice) AS sequence, l_linenumber, l_quantity, l_extendedprice, l_discount, l_linestatus FROM lineitem)"""
_ROW = "log_time, producer, topic, sequence"

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def engine(spark: SparkSession, sf_dir: str, **options) -> Engine:
    return Engine(spark, driver_topics(spark, sf_dir), **options)


def register(name: str, make: Query, sql: str | None = None) -> None:
    QUERIES[name] = make
    if sql:
        ORACLE_SQL[name] = sql


def _ql(name: str, text: str, sql: str, ranked: bool = False, **options) -> None:
    """A query in the query language; the result is its rows without payloads, with their rank if asked for."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = engine(spark, sf_dir, **options)
        return (e.ranked(text).select(*ROW, F.col("rank").cast("long").alias("rank"))) if ranked else e.query(text).select(*ROW)

    register(name, run, sql)


def _events(kinds: str, where: str = "true") -> str:
    return f"WITH {_EVENTS} SELECT {_ROW} FROM ev WHERE topic IN ({kinds}) AND ({where})"


def _top(inner: str, order: str, paging: str) -> str:
    return f"SELECT {_ROW}, row_number() OVER (ORDER BY {order}) AS rank FROM (SELECT * FROM ({inner}) ORDER BY {order} {paging})"


# scans
_ql("scan_topic", "from * /purchase;", _events("'/purchase'"))
_ql("scan_between", "from * between '2024-01-05' and '2024-01-12T12:00:00' /purchase;", _events("'/purchase'", "log_time >= epoch_ns(TIMESTAMP '2024-01-05') AND log_time < epoch_ns(TIMESTAMP '2024-01-12 12:00:00')"))
_ql("scan_desc_limit", "from * /error desc limit 25;", f"WITH {_EVENTS} " + _top("SELECT * FROM ev WHERE topic = '/error'", "log_time DESC, producer, sequence DESC", "LIMIT 25"), ranked=True)
_ql("scan_multi_producer", "from 7, 8, 46 /view;", _events("'/view'", "producer IN ('7', '8', '46')"))
_ql("scan_wildcard", "from * /orders;", f"WITH {_ORDERS} SELECT {_ROW} FROM od")
_ql("scan_offset", "from * /signup limit 20 offset 1000;", f"WITH {_EVENTS} " + _top("SELECT * FROM ev WHERE topic = '/signup'", "log_time, producer, sequence", "LIMIT 20 OFFSET 1000"), ranked=True)
register("scan_external_paging_ties", lambda s, d: engine(s, d).query("from * /lineitem limit 2000;", limit=40, offset=500).select(*ROW), f"WITH {_LINES} SELECT {_ROW} FROM (SELECT * FROM (SELECT * FROM li ORDER BY log_time, producer, sequence LIMIT 2000) ORDER BY log_time, producer, sequence LIMIT 40 OFFSET 500)")
register("skeleton", lambda s, d: engine(s, d).query("from * /click where /click.value > 50;", skeleton=True).select(*ROW, "publish_time"), f"WITH {_EVENTS} SELECT {_ROW}, log_time AS publish_time FROM ev WHERE topic = '/click' AND value > 50")

# predicates
_SQL_OP = {"eq": "=", "lt": "<", "gt": ">", "le": "<=", "ge": ">=", "ne": "!="}
for _name, _op in _SQL_OP.items():
    _ql(f"filter_{_name}_int", f"from * /lineitem where /lineitem.l_linenumber {_op} 4;", f"WITH {_LINES} SELECT {_ROW} FROM li WHERE l_linenumber {_op} 4")
    if _name == "eq":  # discounts repeat, values of purchases hardly do
        _ql("filter_eq_float", "from * /lineitem where /lineitem.l_discount = 0.05;", f"WITH {_LINES} SELECT {_ROW} FROM li WHERE l_discount = 0.05")
    else:
        _ql(f"filter_{_name}_float", f"from * /purchase where /purchase.value {_op} 50;", _events("'/purchase'", f"value {_op} 50"))
    _ql(f"filter_{_name}_str", f"from * /orders where /orders.o_orderpriority {_op} '3-MEDIUM';", f"WITH {_ORDERS} SELECT {_ROW} FROM od WHERE o_orderpriority {_op} '3-MEDIUM'")
_ql("filter_and", "from * /purchase as p where p.value > 10 and p.value < 20.5 and p.props ~ '7';", _events("'/purchase'", "value > 10 AND value < 20.5 AND regexp_matches(props, '7')"))
_ql("filter_or", "from * /purchase as p where p.value > 200 or p.value < 1 or p.props = '{\"k\": 29}';", _events("'/purchase'", "value > 200 OR value < 1 OR props = '{\"k\": 29}'"))
_ql("filter_parentheses", "from * /view as v where (v.value > 100 or v.value < 2) and (v.props ~ '1' or v.props ~ '2');", _events("'/view'", "(value > 100 OR value < 2) AND (regexp_matches(props, '1') OR regexp_matches(props, '2'))"))
_ql("filter_nested", "from * /orders as o where o.header.status = 'F' and o.header.key < 5000;", f"WITH {_ORDERS} SELECT {_ROW} FROM od WHERE producer = 'F' AND sequence < 5000")
_ql("filter_regex", "from * /orders where /orders.o_orderpriority ~ '^[1-2]-[A-Z]+';", f"WITH {_ORDERS} SELECT {_ROW} FROM od WHERE regexp_matches(o_orderpriority, '^[1-2]-[A-Z]+')")
_ql("filter_iregex", "from * /orders where /orders.o_orderpriority ~* 'medium|low';", f"WITH {_ORDERS} SELECT {_ROW} FROM od WHERE regexp_matches(o_orderpriority, 'medium|low', 'i')")

# merges
_ql("merge_two", "from * /signup, /purchase;", _events("'/signup', '/purchase'"))
_ql("merge_three", "from * /signup, /orders, /purchase;", f"WITH {_EVENTS}, {_ORDERS} SELECT {_ROW} FROM ev WHERE topic IN ('/signup', '/purchase') UNION ALL SELECT {_ROW} FROM od")
_ql("merge_where_cross_or", "from * /signup as s, /purchase as p, /error where s.value > 100 or p.value < 5;", _events("'/signup', '/purchase', '/error'", "topic = '/error' OR topic = '/signup' AND value > 100 OR topic = '/purchase' AND value < 5"))
_ql(
    "merge_limit_offset", "from * /orders, /lineitem limit 50 offset 300;",
    f"WITH {_ORDERS}, {_LINES} " + _top(f"SELECT {_ROW}, 0 AS branch FROM od UNION ALL SELECT {_ROW}, 1 AS branch FROM li", "log_time, producer, branch, sequence", "LIMIT 50 OFFSET 300"), ranked=True,
)


# as-of joins
def _asof_sql(left: str, right: str, within: str = "true", immediate: bool = False, where_left: str = "true", right_topics: str | None = None, swapped: bool = False) -> str:
    """Matches by a running maximum, then the distinct left rows and the right rows. Events of one user have distinct times."""
    topics = right_topics or f"'{right}'"
    return f"""
        WITH {_EVENTS}, u AS (SELECT {_ROW}, 0 AS side FROM ev WHERE topic = '{left}' AND ({where_left}) UNION ALL SELECT {_ROW}, 1 AS side FROM ev WHERE topic IN ({topics})),
        m AS (SELECT *, last_value(CASE WHEN side = 0 THEN sequence END IGNORE NULLS) OVER w AS ls, last_value(CASE WHEN side = 0 THEN log_time END IGNORE NULLS) OVER w AS lt
            FROM u WINDOW w AS (PARTITION BY producer ORDER BY log_time, side, sequence ROWS UNBOUNDED PRECEDING)),
        f AS (SELECT *, row_number() OVER (PARTITION BY producer, ls ORDER BY log_time, sequence) AS k FROM m WHERE side = 1 AND ls IS NOT NULL),
        g AS (SELECT * FROM f WHERE ({within}) {"AND k = 1" if immediate else ""})
        SELECT {_ROW} FROM g UNION ALL SELECT {_ROW} FROM ev WHERE topic = '{left}' AND sequence IN (SELECT ls FROM g)"""


_ql("asof_precedes", "from * /signup precedes /purchase;", _asof_sql("/signup", "/purchase"))
_ql("asof_precedes_immediate", "from * /signup precedes immediate /purchase;", _asof_sql("/signup", "/purchase", immediate=True))
_ql("asof_succeeds", "from * /signup succeeds /purchase;", _asof_sql("/purchase", "/signup"))
_ql("asof_threshold", "from * /signup precedes /purchase by less than 1440 minutes;", _asof_sql("/signup", "/purchase", f"log_time - lt < {DAY_NS}"))
_ql("asof_threshold_immediate", "from * /view precedes immediate /purchase by less than 36000 seconds;", _asof_sql("/view", "/purchase", "log_time - lt < 36000000000000", immediate=True))
_ql("asof_filtered", "from * /signup as s precedes /purchase as p by less than 4320 minutes where s.value > 20;", _asof_sql("/signup", "/purchase", f"log_time - lt < {3 * DAY_NS}", where_left="value > 20"))
_ql("asof_multi_producer", "from 7, 8, 46, 99 /error precedes /view;", _asof_sql("/error", "/view") .replace("FROM events)", "FROM events WHERE user_id IN (7, 8, 46, 99))"))
_ql("asof_over_merge", "from * /signup precedes /purchase, /error by less than 1440 minutes;", _asof_sql("/signup", "/purchase", f"log_time - lt < {DAY_NS}", right_topics="'/purchase', '/error'"))
_ql("asof_bucketed", "from * /signup precedes immediate /purchase by less than 2880 minutes;", _asof_sql("/signup", "/purchase", f"log_time - lt < {2 * DAY_NS}", immediate=True), asof_bucket_ns=DAY_NS)
_ql("asof_desc_limit", "from * /click precedes /purchase desc limit 30;", f"SELECT {_ROW}, row_number() OVER (ORDER BY log_time DESC, producer, sequence DESC) AS rank FROM ({_asof_sql('/click', '/purchase')} ORDER BY log_time DESC, producer, sequence DESC LIMIT 30)", ranked=True)


def _nested_sql() -> str:
    inner = _asof_sql("/purchase", "/error", f"log_time - lt < {DAY_NS}")
    ctes, final = inner.rsplit("SELECT log_time, producer, topic, sequence FROM g UNION ALL", 1)
    return f"""{ctes}, i AS (SELECT {_ROW} FROM g UNION ALL {final}),
        u2 AS (SELECT {_ROW}, 0 AS side FROM ev WHERE topic = '/signup' UNION ALL SELECT {_ROW}, 1 AS side FROM i),
        m2 AS (SELECT *, last_value(CASE WHEN side = 0 THEN sequence END IGNORE NULLS) OVER (PARTITION BY producer ORDER BY log_time, side, sequence ROWS UNBOUNDED PRECEDING) AS ls FROM u2)
        SELECT {_ROW} FROM m2 WHERE side = 1 AND ls IS NOT NULL UNION ALL SELECT {_ROW} FROM ev WHERE sequence IN (SELECT ls FROM m2 WHERE side = 1)"""


_ql("asof_nested", "from * /signup precedes /purchase precedes /error by less than 1440 minutes;", _nested_sql())


def _sides(spark: SparkSession, sf_dir: str, left: str, right: str) -> tuple[DataFrame, DataFrame]:
    source = driver_topics(spark, sf_dir)
    return tuple(source.frames(t)[0].withColumn("branch", F.lit(k)) for k, t in enumerate((left, right)))


def _pairs(spark: SparkSession, sf_dir: str, bucket_ns: int | None = None) -> DataFrame:
    out = asof.pairs(*_sides(spark, sf_dir, "/signup", "/purchase"), within=DAY_NS, bucket_ns=bucket_ns)
    return out.select("producer", F.col("left.sequence").alias("left_sequence"), F.col("right.sequence").alias("right_sequence"), (F.col("right.log_time") - F.col("left.log_time")).alias("gap_ns"), F.col("right.data.value").alias("right_value"))


register("asof_pairs", _pairs, f"""
    WITH {_EVENTS}, u AS (SELECT *, CASE WHEN topic = '/signup' THEN 0 ELSE 1 END AS side FROM ev WHERE topic IN ('/signup', '/purchase')),
    m AS (SELECT *, last_value(CASE WHEN side = 0 THEN sequence END IGNORE NULLS) OVER w AS ls, last_value(CASE WHEN side = 0 THEN log_time END IGNORE NULLS) OVER w AS lt
        FROM u WINDOW w AS (PARTITION BY producer ORDER BY log_time, side, sequence ROWS UNBOUNDED PRECEDING))
    SELECT producer, ls AS left_sequence, sequence AS right_sequence, log_time - lt AS gap_ns, value AS right_value FROM m WHERE side = 1 AND ls IS NOT NULL AND log_time - lt < {DAY_NS}""")  # fmt: skip


def _neighbors(spark: SparkSession, sf_dir: str, bucket_ns: int | None = None) -> DataFrame:
    out = asof.neighbor_pairs(*_sides(spark, sf_dir, "/signup", "/purchase"), within=DAY_NS, bucket_ns=bucket_ns)
    return out.select("producer", F.col("left.sequence").alias("left_sequence"), F.col("right.sequence").alias("right_sequence"), "left_first")


def _neighbor_half(first: str, second: str, flag: str) -> str:
    left, right = ("ls", "sequence") if flag == "true" else ("sequence", "ls")
    return f"""SELECT producer, {left} AS left_sequence, {right} AS right_sequence, {flag} AS left_first FROM (
        SELECT *, last_value(CASE WHEN topic = '{first}' THEN sequence END IGNORE NULLS) OVER w AS ls, last_value(CASE WHEN topic = '{first}' THEN log_time END IGNORE NULLS) OVER w AS lt
        FROM ev WHERE topic IN ('{first}', '{second}') WINDOW w AS (PARTITION BY producer ORDER BY log_time, topic <> '{first}', sequence ROWS UNBOUNDED PRECEDING))
        WHERE topic = '{second}' AND ls IS NOT NULL AND log_time - lt < {DAY_NS}"""


register("asof_pairs_bucketed", lambda s, d: _pairs(s, d, DAY_NS // 4), ORACLE_SQL["asof_pairs"])
register("asof_neighbors_bucketed", lambda s, d: _neighbors(s, d, DAY_NS // 2), f"WITH {_EVENTS} {_neighbor_half('/signup', '/purchase', 'true')} UNION ALL {_neighbor_half('/purchase', '/signup', 'false')}")
register("asof_neighbors_extension", _neighbors, f"WITH {_EVENTS} {_neighbor_half('/signup', '/purchase', 'true')} UNION ALL {_neighbor_half('/purchase', '/signup', 'false')}")


# statistics
def _bins(width: int) -> tuple[Query, str]:
    names = ["count", "min", "max", "mean", "messageCount"]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = engine(spark, sf_dir).statistics("/purchase", "value", names, 1_704_067_200, 1_706_745_600, width + 7)
        return out.select("start", "end", "count", "min", "max", F.round("mean", 6).alias("mean"), "messageCount")

    w = width * stats.SECOND
    return run, f"""WITH {_EVENTS} SELECT log_time // {w} * {w} AS "start", (log_time // {w} + 1) * {w} AS "end", count(value) AS count, min(value) AS min, max(value) AS max, round(avg(value), 6) AS mean, count(*) AS "messageCount"
        FROM ev WHERE topic = '/purchase' GROUP BY log_time // {w}"""


for _w in (60, 3840, 245_760):
    register(f"stats_bins_{_w}", *_bins(_w))


def _by_producer(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = engine(spark, sf_dir).statistics("/orders", "o_totalprice", ["count", "min", "max"], 0, 2_000_000_000, 15_728_640, by_producer=True)
    return out.select("producer", "start", "count", "min", "max")


_W3 = 15_728_640 * stats.SECOND
register("stats_by_producer", _by_producer, f'WITH {_ORDERS} SELECT producer, log_time // {_W3} * {_W3} AS "start", count(o_totalprice) AS count, min(o_totalprice) AS min, max(o_totalprice) AS max FROM od GROUP BY producer, log_time // {_W3}')
register("stats_text", lambda s, d: engine(s, d).statistics("/orders", "o_orderpriority", ["min", "max"], 0, 2_000_000_000, 15_728_640).select("start", "min", "max"), f'WITH {_ORDERS} SELECT log_time // {_W3} * {_W3} AS "start", min(o_orderpriority) AS min, max(o_orderpriority) AS max FROM od GROUP BY log_time // {_W3}')


def _statrange(spark: SparkSession, sf_dir: str, quantiles: str | None, names: list[str] | None) -> DataFrame:
    out = engine(spark, sf_dir).statrange("/click", 0, 2 * 10**18, 245_760 * stats.SECOND, names=names, quantiles=quantiles)
    return out.select("start", "end", "type", "field", "name", F.round("value", 4).alias("value"), "text_value")


_W2 = 245_760 * stats.SECOND
_LONG = f"""WITH {_EVENTS}, b AS (SELECT log_time // {_W2} * {_W2} AS "start", * FROM ev WHERE topic = '/click'),
    g AS (SELECT "start", avg(value) AS mean, min(value) AS lo, max(value) AS hi, sum(value) AS total, count(value) AS n, min(event_type) AS e0, max(event_type) AS e1, min(props) AS p0, max(props) AS p1, count(*) AS m, min(log_time) AS t0, max(log_time) AS t1 FROM b GROUP BY 1)"""
register("statrange_long", lambda s, d: _statrange(s, d, None, None), _LONG + f"""
    SELECT "start", "start" + {_W2} AS "end", t AS type, f AS field, n2 AS name, round(v, 4) AS value, x AS text_value FROM (
        SELECT "start", 'numeric' AS t, 'value' AS f, unnest(['mean', 'min', 'max', 'sum', 'count']) AS n2, unnest([mean, lo, hi, total, CAST(n AS DOUBLE)]) AS v, CAST(NULL AS VARCHAR) AS x FROM g
        UNION ALL SELECT "start", 'text', 'event_type', unnest(['min', 'max']), CAST(NULL AS DOUBLE), unnest([e0, e1]) FROM g
        UNION ALL SELECT "start", 'text', 'props', unnest(['min', 'max']), CAST(NULL AS DOUBLE), unnest([p0, p1]) FROM g
        UNION ALL SELECT "start", 'message', '', unnest(['messageCount', 'bytesUncompressed', 'minObservedTime', 'maxObservedTime']), unnest([CAST(m AS DOUBLE), NULL, CAST(t0 AS DOUBLE), CAST(t1 AS DOUBLE)]), CAST(NULL AS VARCHAR) FROM g)""")  # fmt: skip
register("stats_message_summary", lambda s, d: engine(s, d).tables().select("producer", "topic", "messages", "first", "last").where("topic = '/error' or topic = '/orders'"), f"WITH {_EVENTS}, {_ORDERS} SELECT producer, topic, count(*) AS messages, min(log_time) AS first, max(log_time) AS last FROM (SELECT {_ROW} FROM ev UNION ALL SELECT {_ROW} FROM od) WHERE topic IN ('/error', '/orders') GROUP BY producer, topic")


def _quantiles(spark: SparkSession, sf_dir: str, how: str) -> DataFrame:
    frame = driver_topics(spark, sf_dir).frames("/click")[0]
    rows = stats.quantile_rows(frame, 245_760, stats.fields(frame, ["value"]), (), how)
    return rows.select("start", "field", "name", F.round("value", 6).alias("value"))


_POINTS = ", ".join(f"('{n}', {q})" for n, q in stats.QUANTILES.items())
_QUANTILE_SQL = f"""WITH {_EVENTS}, p(name, q) AS (VALUES {_POINTS}), b AS (SELECT log_time // {_W2} * {_W2} AS "start", list_sort(list(value)) AS v FROM ev WHERE topic = '/click' GROUP BY 1),
    r AS (SELECT "start", name, v, CAST(floor(q * (len(v) - 1)) AS BIGINT) AS k, q * (len(v) - 1) - floor(q * (len(v) - 1)) AS f FROM b, p)
    SELECT "start", 'value' AS field, name, round(v[k + 1] + f * (v[least(k + 2, len(v))] - v[k + 1]), 6) AS value FROM r"""
register("stats_quantiles_exact", lambda s, d: _quantiles(s, d, "exact"), _QUANTILE_SQL)
register("stats_quantiles_sketch", lambda s, d: _quantiles(s, d, "sketch"), f"""WITH {_EVENTS}, p(name, q) AS (VALUES {_POINTS}),
    b AS (SELECT log_time // {_W2} * {_W2} AS "start", list_sort(list(value)) AS v FROM ev WHERE topic = '/click' GROUP BY 1)
    SELECT "start", 'value' AS field, name, round(2 * pow({stats._GAMMA!r}, ceil(ln(v[CAST(floor(q * (len(v) - 1)) AS BIGINT) + 1]) / ln({stats._GAMMA!r}))) / ({stats._GAMMA!r} + 1), 6) AS value FROM b, p""")  # fmt: skip


def _rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = driver_topics(spark, sf_dir).frames("/click")[0]
    out = stats.merged(stats.partials(frame, 60, ["value"], ("producer",)), 245_760, ())
    return out.where("type = 'numeric'").select("start", "field", "n", F.round("total", 4).alias("total"), "low", "high")


register("stats_rollup", _rollup, f'WITH {_EVENTS} SELECT log_time // {_W2} * {_W2} AS "start", \'value\' AS field, count(value) AS n, round(sum(value), 4) AS total, min(value) AS low, max(value) AS high FROM ev WHERE topic = \'/click\' GROUP BY 1')


def _available(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).available_statistics("/orders").select("field", "type", F.array_join("statistics", ",").alias("statistics"))


register("available_statistics", _available, "SELECT * FROM (VALUES ('header.key', 'numeric', 'mean,min,max,count,P25,P50,P75,P90,P95,P99'), ('header.status', 'text', 'min,max'), ('o_custkey', 'numeric', 'mean,min,max,count,P25,P50,P75,P90,P95,P99'), ('o_orderpriority', 'text', 'min,max'), ('o_totalprice', 'numeric', 'mean,min,max,count,P25,P50,P75,P90,P95,P99')) t(field, type, statistics)")


def _trigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = driver_topics(spark, sf_dir).frames("/orders")[0]
    signed = frame.withColumn("sig", trigrams.signature(F.col("data.o_orderpriority"))).groupBy(F.col("data.o_orderpriority").alias("priority")).agg(trigrams.merge("sig").alias("sig"))
    return signed.select("priority", trigrams.may_contain(F.col("sig"), F.lit("3-MEDIUM")).alias("may_have_medium"))


register("trigram_signature", _trigrams, "SELECT o_orderpriority AS priority, o_orderpriority = '3-MEDIUM' AS may_have_medium FROM orders GROUP BY 1")


# paging from outside, results without rows, kinds of values that the tables' own queries don't meet
register("external_paging", lambda s, d: engine(s, d).query("from * /orders;", limit=250, offset=1000).select(*ROW), f"WITH {_ORDERS} SELECT {_ROW} FROM od ORDER BY log_time, producer, sequence LIMIT 250 OFFSET 1000")
register("empty_result", lambda s, d: engine(s, d).query("from * /orders limit 0;").agg(F.count("*").alias("rows")), "SELECT CAST(0 AS BIGINT) AS rows")
_ql("filter_eq_float_found", "from * /lineitem where /lineitem.l_quantity = 18.0;", f"WITH {_LINES} SELECT {_ROW} FROM li WHERE l_quantity = 18.0")


def _flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = driver_topics(spark, sf_dir).frames("/orders")[0]
    flags = rows.select("log_time", "producer", "sequence", F.struct((F.col("data.o_totalprice") > 1000).alias("large"), (F.col("data.o_custkey") % 2 == 0).alias("even")).alias("data"))
    return Engine(spark, Topics().add("/flags", flags)).query("from * /flags as f where f.large = true and f.even != true;").select("log_time", "producer", "sequence")


register("filter_bool", _flags, f"WITH {_ORDERS} SELECT log_time, producer, sequence FROM od WHERE o_totalprice > 1000 AND o_custkey % 2 <> 0")


# changes: versions are made from ids, as the tables have none
def _versioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = driver_topics(spark, sf_dir)
    return union([frames.frames(t)[0].select(*ROW) for t in ("/purchase", "/error")]).withColumn("version", F.pmod(F.col("sequence"), F.lit(5)) + 1)


_VERSIONED = f"{_EVENTS}, v AS (SELECT {_ROW}, sequence % 5 + 1 AS version FROM ev WHERE topic IN ('/purchase', '/error'))"
_DELETES = [("7", "/purchase", 1_704_067_200 * 10**9, 1_705_000_000 * 10**9, 3), ("8", "/error", 1_705_000_000 * 10**9, 1_706_000_000 * 10**9, 5)]
_CUTS = [("46", "/error", 2), ("46", "/error", 1), ("7", "/error", 4)]


def _visible(spark: SparkSession, sf_dir: str, deletes: bool, cuts: bool, least: int | None) -> DataFrame:
    d = spark.createDataFrame(_DELETES, "producer string, topic string, start_ns long, end_ns long, version long") if deletes else None
    c = spark.createDataFrame(_CUTS, "producer string, topic string, version long") if cuts else None
    return visible(_versioned(spark, sf_dir), d, c, least, (len(_DELETES), len(_CUTS)))


_D_SQL = "NOT EXISTS (SELECT 1 FROM (VALUES " + ", ".join(f"('{p}', '{t}', {a}, {b}, {n})" for p, t, a, b, n in _DELETES) + ") d(p, t, a, b, n) WHERE d.p = v.producer AND d.t = v.topic AND v.log_time >= d.a AND v.log_time < d.b AND d.n > v.version)"
_C_SQL = "version > coalesce((SELECT max(n) FROM (VALUES " + ", ".join(f"('{p}', '{t}', {n})" for p, t, n in _CUTS) + ") c(p, t, n) WHERE c.p = v.producer AND c.t = v.topic), 0)"
register("delete_range", lambda s, d: _visible(s, d, True, False, None), f"WITH {_VERSIONED} SELECT * FROM v WHERE {_D_SQL}")
register("truncate_visibility", lambda s, d: _visible(s, d, False, True, None), f"WITH {_VERSIONED} SELECT * FROM v WHERE {_C_SQL}")
register("tail_since_version", lambda s, d: _visible(s, d, True, True, 3), f"WITH {_VERSIONED} SELECT * FROM v WHERE version > 3 AND {_D_SQL} AND {_C_SQL}")


def _dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = driver_topics(spark, sf_dir).frames("/lineitem")[0].select("producer", "topic", "log_time", F.col("data.l_linenumber").cast("long").alias("sequence"), "publish_time")
    stored = rows.where("sequence = 3")
    return deduplicated(rows, stored).select(*ROW)


register("dedupe_ingest", _dedupe, f"WITH {_LINES} SELECT DISTINCT log_time, producer, topic, CAST(l_linenumber AS BIGINT) AS sequence FROM li WHERE l_linenumber <> 3")

# catalog
register("list_topics", lambda s, d: engine(s, d).tables().select("topic").distinct(), "SELECT DISTINCT '/' || event_type AS topic FROM events UNION SELECT unnest(['/orders', '/lineitem'])")
register("list_producers", lambda s, d: engine(s, d).tables().select("producer").distinct(), "SELECT DISTINCT CAST(user_id AS VARCHAR) AS producer FROM events UNION SELECT o_orderstatus FROM orders UNION SELECT l_returnflag FROM lineitem")
register("list_tables", lambda s, d: engine(s, d).tables().groupBy("topic").agg(F.count("*").alias("producers"), F.sum("messages").alias("messages")), "SELECT '/' || event_type AS topic, count(DISTINCT user_id) AS producers, CAST(count(*) AS BIGINT) AS messages FROM events GROUP BY 1 UNION ALL SELECT '/orders', count(DISTINCT o_orderstatus), count(*) FROM orders UNION ALL SELECT '/lineitem', count(DISTINCT l_returnflag), count(*) FROM lineitem")
register("json_lines", lambda s, d: engine(s, d).json_lines("from * /purchase, /error where /purchase.value > 100 or /error.value > 100;"), f"""WITH {_EVENTS} SELECT '{{"topic":"' || topic || '","sequence":' || sequence || ',"log_time":' || log_time // 1000000000 || '.' || lpad(CAST(log_time % 1000000000 AS VARCHAR), 9, '0') || ',"publish_time":' || log_time // 1000000000 || '.' || lpad(CAST(log_time % 1000000000 AS VARCHAR), 9, '0') || ',"data":{{"value":' || value || ',"event_type":"' || event_type || '","props":"' || replace(props, '"', '\\"') || '"}}}}' AS line FROM ev WHERE topic IN ('/purchase', '/error') AND value > 100""")
register("array_element", lambda s, d: _elements(s, d), "SELECT vec_id AS sequence, label FROM embeddings WHERE embedding[4] > 0.05 AND embedding[1] < 0.1")


def _elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("log_time"), F.lit("v").alias("producer"), F.col("vec_id").alias("sequence"), F.struct(F.col("embedding"), F.col("label")).alias("data"))
    out = Engine(spark, Topics().add("/vectors", rows)).query("from v /vectors as x where x.embedding[3] > 0.05 and x.embedding[0] < 0.1;")
    return out.select("sequence", F.col("data_0.label").alias("label"))


# plans that ran
register("explain_analyze", lambda s, d: engine(s, d).analyze("from * /purchase where /purchase.value > 50;").where("depth = 0").select("operator", "rows"), f"WITH {_EVENTS} SELECT 'Result' AS operator, count(*) AS rows FROM ev WHERE topic = '/purchase' AND value > 50")


# a store that the query writes: purchases, then errors as a second schema of one topic; then a range delete and a truncation
def _store(spark: SparkSession, sf_dir: str, change: bool = True) -> LogStore:
    store, source = LogStore(spark, scratch_dir(spark, "store")), driver_topics(spark, sf_dir)
    for topic, data in (("/purchase", F.struct("data.value")), ("/error", F.struct("data.value", "data.props"))):
        rows = source.frames(topic)[0].select("producer", "sequence", "log_time", data.alias("data"))
        store.ingest(rows, "/t", topic)
    if change:
        store.delete("7", "/t", 1_704_067_200 * 10**9, 1_705_000_000 * 10**9)
        store.truncate("8", "/t")
    return store


_STORED = f"{_EVENTS}, st AS (SELECT log_time, producer, '/t' AS topic, sequence, value, topic AS name FROM ev WHERE topic IN ('/purchase', '/error'))"
_LEFT = "producer <> '8' AND NOT (producer = '7' AND log_time >= 1704067200000000000 AND log_time < 1705000000000000000)"


def _compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _store(spark, sf_dir)
    store.compact("/t")
    return union([f.select(*ROW, "version") for f in store.frames("/t")])


def _by_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _store(spark, sf_dir, change=False)
    rows = Engine(spark, store).statrange("/t", 0, 2 * 10**18, 245_760 * stats.SECOND, quantiles=None).where("name = 'messageCount'")
    names = spark.createDataFrame([(h, store.schema(h)["name"]) for h, _, _ in store._hashes("/t")], "schema_hash string, schema string")
    return rows.join(names, "schema_hash").select("schema", "start", "value")


register("compact_visible", _compacted, f"WITH {_STORED} SELECT {_ROW}, CASE name WHEN '/purchase' THEN 1 ELSE 2 END AS version FROM st WHERE {_LEFT}")
register("export_since_version", lambda s, d: _store(s, d).export({"/t": 1}, 0, 2 * 10**18)[0].select(*ROW, F.get_json_object("data", "$.value").cast("double").alias("value")), f"WITH {_STORED} SELECT {_ROW}, value FROM st WHERE name = '/error' AND {_LEFT}")
register("statistics_at_version", lambda s, d: Engine(s, _store(s, d)).statistics("/t", "value", ["count", "min", "max"], 0, 2_000_000_000, 245_760, at_version=1), f'WITH {_STORED} SELECT log_time // {_W2} * {_W2} AS "start", (log_time // {_W2} + 1) * {_W2} AS "end", count(value) AS count, min(value) AS min, max(value) AS max FROM st WHERE name = \'/purchase\' GROUP BY log_time // {_W2}')
register("statistics_per_schema", _by_schema, f'WITH {_STORED} SELECT name AS schema, log_time // {_W2} * {_W2} AS "start", CAST(count(*) AS DOUBLE) AS value FROM st GROUP BY name, log_time // {_W2}')
register("table_history", lambda s, d: _store(s, d).tables(history=True).groupBy("topic", "version").agg(F.count("*").alias("producers")), f"WITH {_STORED} SELECT topic, CASE name WHEN '/purchase' THEN 1 ELSE 2 END AS version, count(DISTINCT producer) AS producers FROM st GROUP BY topic, name")
register("store_files", lambda s, d: _store(s, d).files("/t").groupBy("version", "bucket").agg(F.sum("rows").alias("rows"), F.min("low").alias("low"), F.max("high").alias("high")), f"WITH {_STORED} SELECT CASE name WHEN '/purchase' THEN 1 ELSE 2 END AS version, log_time // {_W2} AS bucket, CAST(count(*) AS BIGINT) AS rows, min(log_time) AS low, max(log_time) AS high FROM st GROUP BY name, log_time // {_W2}")


def _masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = driver_topics(spark, sf_dir)
    both = union([source.frames(t)[0].select("log_time", "sequence") for t in ("/purchase", "/error", "/purchase")])
    return masked(both, source.frames("/error")[0].where("data.value > 50"))


# the same store at versions, by ranges of time, and with rows that come late or again
register("store_at_version", lambda s, d: union([f.select(*ROW, "version") for f in _store(s, d).frames("/t", at_version=2)]), f"WITH {_STORED} SELECT {_ROW}, CASE name WHEN '/purchase' THEN 1 ELSE 2 END AS version FROM st")
register("store_since_version", lambda s, d: union([f.select(*ROW) for f in _store(s, d).frames("/t", min_version=1)]), f"WITH {_STORED} SELECT {_ROW} FROM st WHERE name = '/error' AND {_LEFT}")
register("store_between", lambda s, d: Engine(s, _store(s, d)).query("from * between '2024-01-05' and '2024-01-12T12:00:00' /t where /t.value > 20;").select(*ROW), f"WITH {_STORED} SELECT {_ROW} FROM st WHERE value > 20 AND {_LEFT} AND log_time >= epoch_ns(TIMESTAMP '2024-01-05') AND log_time < epoch_ns(TIMESTAMP '2024-01-12 12:00:00')")


def _late(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, rows = LogStore(spark, scratch_dir(spark, "store")), driver_topics(spark, sf_dir).frames("/purchase")[0].select("producer", "sequence", "log_time", "data")
    store.ingest(rows.where(F.col("log_time") >= _MIDDLE), "/t")
    store.ingest(rows.where(F.col("log_time") < _MIDDLE + DAY_NS), "/t")  # earlier rows come later, a day of them again
    store.ingest(rows.union(rows), "/t")
    return Engine(spark, store).query("from * /t;").select(*ROW).join(union([f.select("producer", "sequence", "version") for f in store.frames("/t")]), ["producer", "sequence"])


_MIDDLE = 1_705_000_000 * 10**9
register("store_late_data", _late, f"WITH {_EVENTS} SELECT log_time, producer, '/t' AS topic, sequence, CASE WHEN log_time >= {_MIDDLE} THEN 1 ELSE 2 END AS version FROM ev WHERE topic = '/purchase'")


def _schemas(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _store(spark, sf_dir, change=False)
    found = [store.schema(r["schema_hash"]) for r in store.catalog("commits").select("schema_hash").distinct().collect()]
    return spark.createDataFrame([(x["name"], x["encoding"], x["definition"]) for x in found], "name string, encoding string, definition string")


register("schema_by_hash", _schemas, "SELECT * FROM (VALUES ('/purchase', '', 'struct<value:double>'), ('/error', '', 'struct<value:double,props:string>')) t(name, encoding, definition)")


def _databases(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, source = scratch_dir(spark, "stores"), driver_topics(spark, sf_dir)
    for topic in ("/purchase", "/error"):
        rows = source.frames(topic)[0].select("producer", "sequence", "log_time", "data")
        LogStore(spark, base, f"fleet of {topic}").ingest(rows, topic, unique=True)
    found = [(name, LogStore(spark, base, name)) for name in databases(spark, base)]
    return union([store.tables().select(F.lit(name).alias("database"), "producer", "topic", "version") for name, store in found])


register("list_databases", _databases, f"WITH {_EVENTS} SELECT DISTINCT 'fleet of ' || topic AS database, producer, topic, CAST(1 AS BIGINT) AS version FROM ev WHERE topic IN ('/purchase', '/error')")


def _without(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranges = [(0, 2**62)]
    for left, right in _GONE:
        ranges = without_range(ranges, left, right)
    rows = driver_topics(spark, sf_dir).frames("/purchase")[0]
    return union([rows.where((F.col("log_time") >= a) & (F.col("log_time") < b)).select(*ROW) for a, b in ranges])


_GONE = [(_MIDDLE, _MIDDLE + DAY_NS), (_MIDDLE + 3 * DAY_NS, _MIDDLE + 5 * DAY_NS), (_MIDDLE + DAY_NS // 2, _MIDDLE + 2 * DAY_NS), (2**61, 2**62)]
register("ranges_split", _without, f"WITH {_EVENTS} SELECT {_ROW} FROM ev WHERE topic = '/purchase' AND NOT (" + " OR ".join(f"log_time >= {a} AND log_time < {b}" for a, b in _GONE) + ")")


register("masked_merge", _masked, f"WITH {_EVENTS} SELECT DISTINCT log_time, sequence FROM ev WHERE topic = '/purchase' OR topic = '/error' AND value <= 50")

# message files that the query writes and imports
_DEFINITION = "float64 value\nstring kind\nInner inner\n===\nMSG: p/Inner\nint64 user\nstring[] words\n"


def _written(spark: SparkSession, sf_dir: str, *topics: str) -> str:
    source, folder = driver_topics(spark, sf_dir), scratch_dir(spark, "mcap")
    data = F.struct(F.col("data.value").alias("value"), F.col("data.event_type").alias("kind"), F.struct(F.col("producer").cast("long").alias("user"), F.array("producer", F.lit("x")).alias("words")).alias("inner"))
    for topic in topics:
        mcap.write_files(source.frames(topic)[0].withColumn("data", data), f"{folder}/files{topic}", _DEFINITION, "p/Event")
    return folder


def _imported(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _written(spark, sf_dir, "/purchase")
    store = LogStore(spark, folder)
    mcap.import_file(store, f"{folder}/files/purchase/*.mcap", "robot")
    out = Engine(spark, store).query("from robot /purchase where /purchase.value > 5;")
    return out.select(*ROW, F.col("data_0.value").alias("value"), F.col("data_0.kind").alias("kind"), F.col("data_0.inner.user").alias("user"), F.col("data_0.inner.words")[0].alias("word"))


register("mcap_import", _imported, f"WITH {_EVENTS} SELECT log_time, 'robot' AS producer, topic, sequence, value, event_type AS kind, CAST(producer AS BIGINT) AS user, producer AS word FROM ev WHERE topic = '/purchase' AND value > 5")


def _merged_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of two topics, merged in time without a store."""
    rows, topics = mcap.read(spark, f"{_written(spark, sf_dir, '/purchase', '/error')}/files/*/*.mcap"), Topics()
    for topic in ("/purchase", "/error"):
        topics.add(topic, mcap.decoded(rows, topic, _DEFINITION, "robot"), _DEFINITION)
    return Engine(spark, topics).ranked("from robot /purchase, /error where /purchase.value > 50 or /error.inner.user > 3;").select(*ROW, F.col("rank").cast("long").alias("rank"))


def _projected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some fields of bytes, at two depths: the others aren't decoded."""
    rows = mcap.read(spark, f"{_written(spark, sf_dir, '/purchase')}/files/*/*.mcap")
    out = mcap.decoded(rows, "/purchase", _DEFINITION, "robot", ["value", "inner.words"])
    return out.select("sequence", "data.value", "data.kind", "data.inner.user", F.array_join("data.inner.words", " ").alias("words"))


_ROS2 = "int32 LIMIT=5\nfloat64 speed 1.5\nstring<=10 name \"none\"\nuint8[<=4] codes\nPoint[2] corners\n===\nMSG: shapes/msg/Point\nfloat32 x\nfloat32 y 2.0\n"


def _ros2(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = parse(_ROS2, "shapes", ros2=True)
    leaves = [(x.name, x.kind.simpleString()) for x in flatten(spark_type(fields))]
    return spark.createDataFrame(leaves, "field string, type string")


register("mcap_merge", _merged_files, f"WITH {_EVENTS}, m AS (SELECT log_time, 'robot' AS producer, topic, sequence, topic = '/error' AS second FROM ev WHERE topic = '/purchase' AND value > 50 OR topic = '/error' AND CAST(producer AS BIGINT) > 3) SELECT {_ROW}, row_number() OVER (ORDER BY log_time, second, sequence) AS rank FROM m")
register("ros1_projection", _projected, f"WITH {_EVENTS} SELECT sequence, value, CAST(NULL AS VARCHAR) AS kind, CAST(NULL AS BIGINT) AS user, producer || ' x' AS words FROM ev WHERE topic = '/purchase'")
register("ros2_definition", _ros2, "SELECT * FROM (VALUES ('speed', 'double'), ('name', 'string'), ('codes', 'binary'), ('corners[0].x', 'float'), ('corners[0].y', 'float'), ('corners[1].x', 'float'), ('corners[1].y', 'float')) t(field, type)")


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship query: purchases within a day after their user's last signup, in time order."""
    return engine(spark, sf_dir).query("from * /signup as s precedes /purchase as p by less than 1440 minutes where s.value > 0 or p.value > 10;").select(*ROW, F.coalesce("data_0.value", "data_1.value").alias("value"))
