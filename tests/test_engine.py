"""Operators and the dialect on small hand-made tables."""

import datetime
import itertools
import math
import random
import time

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.functions.python import farm_fingerprint, format_string, initcap, instr
from millrace.operators import aggregation, dml, graph, match, nearest, relational, timeseries, vectors
from millrace.plans import dialect


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize(
    ("query", "want"),
    [
        ("SELECT [1, 2, 3][OFFSET(0)], [1][SAFE_OFFSET(4)], [1, 2][ORDINAL(2)], SAFE_CAST('x' AS INT64)", (1, None, 2, None)),
        ("SELECT SPLIT('a.b', '.'), REGEXP_EXTRACT('ab12', r'([0-9]+)'), REGEXP_EXTRACT('ab', r'x'), REGEXP_REPLACE('ab', r'(a)', r'<\\1>')", (["a", "b"], "12", None, "<a>b")),
        ("SELECT GENERATE_ARRAY(1, 5, 2), GENERATE_ARRAY(3, 1), GREATEST(1, NULL), TRUNC(-1.5), IEEE_DIVIDE(1, 0)", ([1, 3, 5], [], None, -1.0, float("inf"))),
        ("SELECT DATE_TRUNC(DATE '2024-02-15', WEEK), DATE_TRUNC(DATE '2024-02-15', WEEK(MONDAY)), DATE_TRUNC(DATE '2021-01-02', ISOYEAR)", (datetime.date(2024, 2, 11), datetime.date(2024, 2, 12), datetime.date(2019, 12, 30))),
        ("SELECT DATE_DIFF(DATE '2017-10-15', DATE '2017-10-14', WEEK), DATE_DIFF(DATE '2017-10-15', DATE '2017-10-14', DAY), DATE_DIFF(DATE '2018-01-01', DATE '2017-12-31', YEAR)", (1, 1, 1)),
        ("SELECT DATE_ADD(DATE '2024-01-31', INTERVAL 1 MONTH), DATE_SUB(DATE '2024-03-01', INTERVAL 1 DAY), LAST_DAY(DATE '2024-02-03')", (datetime.date(2024, 2, 29),) * 3),
        ("SELECT FORMAT_DATE('%d/%m/%y', DATE '2024-02-03'), PARSE_DATE('%d.%m.%Y', '05.03.2020'), EXTRACT(ISOWEEK FROM DATE '2021-01-03')", ("03/02/24", datetime.date(2020, 3, 5), 53)),
        ("SELECT JSON_VALUE('{\"a\": {\"b\": 1}}', '$.a.b'), JSON_VALUE('{\"a\": [1]}', '$.a'), JSON_QUERY('{\"a\": [1]}', '$.a'), TO_JSON_STRING('x')", ("1", None, "[1]", '"x"')),
        ("SELECT NET.REG_DOMAIN('http://a.b.co.uk/x'), NET.IP_TO_STRING(NET.IP_FROM_STRING('10.1.2.3')), NET.IPV4_TO_INT64(NET.IP_FROM_STRING('0.0.1.0'))", ("b.co.uk", "10.1.2.3", 256)),
        ("SELECT x FROM UNNEST([3]) AS x WHERE x NOT IN UNNEST([1, 2]) AND x IN UNNEST([3])", (3,)),
        ("SELECT SAFE.LN(-1), SAFE.SQRT(-1.0), SAFE.SUBSTR('abc', 1, -1), SAFE_DIVIDE(1, 0), NULLIFZERO(0), ZEROIFNULL(NULL)", (None, None, None, None, None, 0)),
        ("SELECT ARRAY_SLICE([1, 2, 3, 4], 1, -2), ARRAY_FIRST_N([1, 2, 3], 2), ARRAY_INCLUDES_ALL([1, 2], [2]), ARRAY_IS_DISTINCT([1, 1]), ARRAY_OFFSETS([5, 6, 5], 5)", ([2, 3], [1, 2], True, False, [0, 2])),
        ("SELECT RANGE_OVERLAPS(RANGE(1, 5), RANGE(5, 9)), RANGE_INTERSECT(RANGE(1, 5), RANGE(3, 9)).start, RANGE_BUCKET(20, [0, 10, 20])", (False, 3, 3)),
        ("SELECT MAP_GET(map('a', 1), 'b', 7), MAP_KEYS_SORTED(map('b', 1, 'a', 2)), MAP_CARDINALITY(MAP_INSERT(map('a', 1), 'c', 3))", (7, ["a", "b"], 2)),
        ("SELECT CAST(b'ab' AS STRING), BYTE_LENGTH(b'abc'), TO_HEX(SHA1('a')), CODE_POINTS_TO_STRING(TO_CODE_POINTS('aé'))", ("ab", 3, "86f7e437faa5a7fce15d1ddcb9eaeaea377667b8", "aé")),
        ("SELECT DATE_BUCKET(DATE '1950-01-04', INTERVAL 2 DAY), TIMESTAMP_BUCKET(TIMESTAMP '2020-01-01 00:07:00', INTERVAL 5 MINUTE)", (datetime.date(1950, 1, 3), datetime.datetime(2020, 1, 1, 0, 5))),
    ],
)
def test_dialect(spark, query, want):
    assert tuple(dialect.run(spark, query).first()) == want


@pytest.mark.parametrize("query", ["SELECT SQRT(-1)", "SELECT LN(0)", "SELECT SUBSTR('abc', 1, -1)", "SELECT [1][OFFSET(3)]", "SELECT ERROR('x')", "SELECT 1 |> ASSERT 1 = 2, 'no'"])
def test_errors(spark, query):
    with pytest.raises(Exception):  # noqa: B017
        dialect.run(spark, query).collect()


def test_parameters_and_scripts(spark):
    assert dialect.run(spark, "SELECT @a + 1 AS x", {"a": 2}).first().x == 3
    out = dialect.script(spark, "CREATE OR REPLACE TEMP VIEW tv AS SELECT 1 AS x; FROM tv |> EXTEND x + 1 AS y")
    assert rows(out) == [(1, 2)]


def test_pipe_call(spark):
    @dialect.table_function
    def doubled(df, column):
        return df.withColumn(column, F.col(column) * 2)

    assert rows(dialect.run(spark, "SELECT 3 AS x |> CALL DOUBLED(x)")) == [(6,)]


def test_fingerprint_and_text():
    assert farm_fingerprint(b"1footrue") == -1541654101129638711
    assert farm_fingerprint(b"2applefalse") == 2794438866806483259
    assert initcap("hello-wORLD x", "- ") == "Hello-World X"
    assert [instr("banana", "an", p, n) for p, n in ((1, 1), (1, 2), (-1, 1), (3, 1), (1, 3))] == [2, 4, 4, 4, 0]
    assert format_string("%05d|%'d|%s|%.2f|%%|%t", ["42", "1234567", "x", "1.5", None]) == "00042|1,234,567|x|1.50|%|NULL"


def test_joins(spark):
    nan = float("nan")
    a = spark.createDataFrame([(nan, 1), (0.0, 2), (None, 3), (1.0, 4)], "k double, i int")
    b = spark.createDataFrame([(nan, 5), (-0.0, 6), (None, 7), (1.0, 8)], "k double, j int")
    assert rows(relational.equi_join(a, b, ["k"]).select("i", "j")) == [(2, 6), (4, 8)]
    assert relational.equi_join(a, b, ["k"], "full").count() == 6


def test_set_operations_by_name(spark):
    a = spark.createDataFrame([(1, 2)], "x int, y int")
    b = spark.createDataFrame([(3, 4)], "z int, x int")
    op = relational.set_operation
    assert rows(op(a, b, "union", distinct=False, by_name="inner")) == [(1,), (4,)]
    assert rows(op(a, b, "union", distinct=False, by_name="left")) == [(1, 2), (4, None)]
    assert rows(op(a, b, "union", distinct=False, by_name="full")) == [(1, 2, None), (4, None, 3)]
    with pytest.raises(ValueError):
        op(a, b, "union", distinct=False, by_name="strict")


def test_unnest_modes(spark):
    df = spark.createDataFrame([(1, [1, 2], [9])], "id int, a array<int>, b array<int>")
    arrays = {"x": F.col("a"), "y": F.col("b")}
    cols = ["x", "y", "o"]
    assert rows(relational.unnest(df, arrays, offset="o").select(cols)) == [(1, 9, 0), (2, None, 1)]
    assert rows(relational.unnest(df, arrays, offset="o", mode="TRUNCATE").select(cols)) == [(1, 9, 0)]
    with pytest.raises(Exception):  # noqa: B017
        relational.unnest(df, arrays, mode="STRICT").collect()


def test_samples(spark):
    df = spark.range(1000).withColumn("g", F.col("id") % 3)
    assert relational.sample_rows(df, 10, seed=1).count() == 10
    assert [r.w for r in relational.sample_rows(df, 10, seed=1, weight="w").collect()] == [100.0] * 10
    assert rows(relational.sample_rows(df, 5, by=["g"]).groupBy("g").count()) == [(0, 5), (1, 5), (2, 5)]


def test_recursion(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "a int, b int")
    seed = spark.createDataFrame([(1,)], "n int")
    out = relational.recursive_union(seed, lambda d: d.join(edges, F.col("n") == F.col("a")).select(F.col("b").alias("n")), depth="d")
    assert rows(out) == [(1, 0), (2, 1), (3, 2), (4, 3)]


def test_aggregates(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, 7), ("a", 2, None), ("b", None, 1)], "k string, y int, v int")
    got = df.groupBy("k").agg(aggregation.ordered_array_agg(F.col("v"), F.col("y"), limit=2).alias("x"), aggregation.string_agg(F.col("v").cast("string"), "+", F.col("y")).alias("s"))
    assert rows(got) == [("a", [5, None], "5+7"), ("b", [1], "1")]
    assert ("a", 1) in rows(aggregation.having_extreme(df, ["k"], F.col("y"), {"n": F.count("v")}))
    assert rows(aggregation.unpivot(df, ["k"], {"y": "Y", "v": "V"}, name="n", value="x").where("k = 'b'")) == [("b", "V", 1)]
    assert rows(aggregation.pivot(df, ["k"], "y", {"one": 1, "two": 2}, {"s": F.sum("v")})) == [("a", 5, 7), ("b", None, None)]


def test_private_sums(spark):
    df = spark.range(20000).select((F.col("id") % 2).alias("g"), F.col("id").alias("u"), F.lit(1.0).alias("v")).unionByName(spark.createDataFrame([(9, 1, 1.0)], "g long, u long, v double"))
    got = {r.g: r for r in aggregation.private_sums(df, ["g"], "u", F.col("v"), low=0, high=1, epsilon=3.0, delta=1e-6, groups_per_unit=2).collect()}
    assert set(got) == {0, 1} and all(abs(r.anon_sum - 10000) < 200 and abs(r.anon_count - 10000) < 200 for r in got.values())


def test_range_sessionize(spark):
    d = lambda n: None if n is None else datetime.date(2024, 1, n)
    df = spark.createDataFrame([(1, d(1), d(3)), (1, d(3), d(5)), (1, d(4), d(6)), (1, d(8), None), (1, d(20), d(21)), (2, None, d(2))], "k int, s date, e date")
    meets = rows(timeseries.range_sessionize(df, "s", "e", ["k"]).select("k", "session_start", "session_end").distinct())
    assert meets == sorted([(1, d(1), d(6)), (1, d(8), None), (2, None, d(2))], key=repr)
    overlaps = timeseries.range_sessionize(df, "s", "e", ["k"], meets=False).select("session_start", "session_end").distinct()
    assert (d(1), d(3)) in rows(overlaps) and (d(3), d(6)) in rows(overlaps)


PATTERNS = ["A B* C", "(A|B)+? C", "A{2,3} B?", "^A+", "B+ $", "(A B|A) C?", "A?? B"]


@pytest.mark.parametrize("pattern", PATTERNS)
def test_patterns(pattern):
    """Against Python's own regular expressions, where each row has one symbol."""
    import re

    code = match.compile_pattern(match.parse(pattern))
    symbols = {"A": 0, "B": 1, "C": 2}
    known = re.compile(pattern.replace(" ", ""))
    for text in map("".join, itertools.chain.from_iterable(itertools.product("ABC", repeat=n) for n in range(6))):
        bits = [1 << symbols[c] for c in text]
        for at in range(len(text) + 1):
            m = known.match(text, at) if not pattern.startswith("^") or at == 0 else None
            got = match.find(code, bits, symbols, at, False)
            assert got == (list(m[0]) if m else None), (text, at)


def test_match_recognize(spark):
    df = spark.createDataFrame([(1, k, v) for k, v in enumerate([5, 6, 7, 3, 4, 2, 9])] + [(2, 0, 1), (2, 1, 2), (2, 2, 0)], "p int, o int, v int")
    before = F.lag("v").over(Window.partitionBy("p").orderBy("o"))
    define = {"UP": F.col("v") > before, "DOWN": F.col("v") < before}
    measures = {"start": match.first(None, F.col("o")), "peak": F.max("v"), "n": F.count(F.lit(1))}
    past = match.match_recognize(df, ["p"], ["o"], "S UP+ DOWN", define, measures)
    assert rows(past.drop("match_number")) == [(1, 0, 7, 4), (2, 0, 2, 3)]
    to_next = match.match_recognize(df, ["p"], ["o"], "S UP+ DOWN", define, measures, after="to next row")
    assert rows(to_next.where("p = 1").select("start")) == [(0,), (1,), (3,)]


def test_match_recognize_text(spark):
    spark.createDataFrame([(1, k, v) for k, v in enumerate([5, 6, 7, 3, 4, 2, 9])], "p int, o int, v int").createOrReplaceTempView("prices")
    clause = """MATCH_RECOGNIZE (PARTITION BY p ORDER BY o
      MEASURES FIRST(S.v) AS first_v, LAST(UP.v) AS peak, COUNT(UP.*) AS ups, MATCH_NUMBER() AS n
      {skip} PATTERN (S UP+ DOWN) DEFINE UP AS v > PREV(v), DOWN AS DOWN.v < PREV(v))"""
    out = dialect.run(spark, f"SELECT * FROM prices {clause.format(skip='')}")
    assert out.columns == ["p", "first_v", "peak", "ups", "n"] and rows(out) == [(1, 5, 7, 2, 1)]
    out = dialect.run(spark, f"FROM prices |> {clause.format(skip='AFTER MATCH SKIP TO NEXT ROW')} |> SELECT first_v")
    assert rows(out) == [(3,), (5,), (6,)]


def test_time_tables_and_star_replace(spark):
    q = "SELECT TIMESTAMP '2024-01-01 00:07:00' AS ts, 1 AS x"
    spark.sql(q).createOrReplaceTempView("one")
    at = lambda h, m: datetime.datetime(2024, 1, 1, h, m)
    got = dialect.run(spark, "SELECT window_start, window_end FROM TUMBLE(TABLE one, 'ts', INTERVAL 5 MINUTE)")
    assert rows(got) == [(at(0, 5), at(0, 10))]
    got = dialect.run(spark, "SELECT window_start FROM HOP(TABLE one, 'ts', INTERVAL 10 MINUTE, INTERVAL 5 MINUTE)")
    assert rows(got) == [(at(0, 0),), (at(0, 5),)]
    got = dialect.run(spark, "SELECT * REPLACE (x + 1 AS x) FROM one WHERE x = 1")
    assert got.columns == ["ts", "x"] and rows(got) == [(at(0, 7), 2)]
    ranges = "SELECT * FROM VALUES (1, named_struct('start', DATE'2024-01-01', 'end', DATE'2024-01-03')), (1, named_struct('start', DATE'2024-01-03', 'end', DATE'2024-01-05')), (1, named_struct('start', DATE'2024-01-09', 'end', NULL)) AS t(k, r)"
    spark.sql(ranges).createOrReplaceTempView("ranges")
    got = dialect.run(spark, "SELECT DISTINCT session_range.start AS a, session_range.end AS b FROM RANGE_SESSIONIZE(TABLE ranges, 'r', ['k'])")
    d = lambda n: datetime.date(2024, 1, n)
    assert rows(got) == sorted([(d(1), d(5)), (d(9), None)], key=repr)


def test_graph(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    r = random.Random(4)
    pairs = sorted({(r.randrange(8), r.randrange(8)) for _ in range(18)})
    nodes = spark.createDataFrame([(i, "n") for i in range(8)], "id long, label string")
    edges = spark.createDataFrame([(k, "e", a, b, float(1 + k % 4)) for k, (a, b) in enumerate(pairs)], "id long, label string, src long, dst long, cost double")
    g = graph.Graph(nodes, edges)
    cost = {(a, b): float(1 + k % 4) for k, (a, b) in enumerate(pairs)}
    best = dict(cost)
    hops = {p: 1 for p in pairs}
    for _ in range(8):
        for (a, b), c in list(cost.items()):
            for (x, y), d in list(best.items()):
                if b == x:
                    best[a, y] = min(best.get((a, y), 1e9), c + d)
                    hops[a, y] = min(hops.get((a, y), 99), 1 + hops[x, y])
    far = graph.Hop("e", low=1, high=None)
    got = {(s, e): c for s, e, c in g.match(far, search="CHEAPEST").select("start", "end", "cost").collect()}
    assert got == best
    got = {(s, e): n for s, e, n in g.match(far, search="ANY SHORTEST").select("start", "end", "length").collect()}
    assert got == hops
    trails = g.match(graph.Hop("e", low=2, high=3), mode="TRAIL").collect()
    assert trails and all(len(set(t.edges)) == len(t.edges) for t in trails)
    assert all(len(set(t.nodes)) == len(t.nodes) for t in g.match(graph.Hop("e", low=1, high=4), mode="ACYCLIC").collect())


def test_dml(spark):
    t = spark.createDataFrame([(1, "a", 1), (2, "b", None)], "k int, s string, n int")
    new = spark.createDataFrame([(2, "c", 5), (3, "d", 6)], "k int, s string, n int")
    assert rows(dml.insert(t, new, ["k"], mode="ignore")) == [(1, "a", 1), (2, "b", None), (3, "d", 6)]
    assert rows(dml.insert(t, new, ["k"], mode="replace")) == [(1, "a", 1), (2, "c", 5), (3, "d", 6)]
    assert rows(dml.insert(t, new.drop("n"), ["k"], mode="update")) == [(1, "a", 1), (2, "c", None), (3, "d", None)]
    with pytest.raises(ValueError):
        dml.insert(t, new, ["k"])
    assert rows(dml.update(t, F.col("n") > 0, {"s": F.lit("z")})) == [(1, "z", 1), (2, "b", None)]
    assert rows(dml.delete(t, F.col("n") > 0)) == [(2, "b", None)]
    got = dml.merge(t, new, ["k"], matched={"s": F.concat("t.s", "s.s")}, delete_when=F.col("s.n") > 9, not_by_source_delete=True)
    assert rows(got) == [(2, "bc", None), (3, "d", 6)]


def test_streaming(spark, tmp_path):
    from millrace.streaming import windows

    folder = str(tmp_path / "in")
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(2).write.parquet(folder)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in events.schema)
    stream = windows.read_stream(spark, folder, schema, files=2)
    out = windows.windowed(stream, "ts", "1 hour", {"n": F.count(F.lit(1))}, by=("event_type",))
    q = out.writeStream.outputMode("update").format("memory").queryName("w1").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    want = events.groupBy(F.window("ts", "1 hour").start.alias("s"), "event_type").count()
    assert rows(spark.sql("SELECT window_start, event_type, n FROM w1")) == rows(want)


@pytest.mark.parametrize(
    ("query", "want"),
    [
        ("SELECT x FROM UNNEST([1, 2, 3]) AS x |> IF 1 = 2 THEN (WHERE x > 1) ELSE (WHERE x > 2)", [(3,)]),
        ("SELECT x FROM UNNEST([1, 2, 3]) AS x |> IF false THEN (WHERE x > 1) ELSEIF TRUE THEN (|> WHERE x > 2 |> EXTEND x + 1 AS y) ELSE (WHERE x = 1)", [(3, 4)]),
        ("SELECT x FROM UNNEST([1, 2]) AS x |> IF NULL THEN (WHERE x > 1)", [(1,), (2,)]),
        ("SELECT a, b FROM UNNEST([1, 2] AS a, [3] AS b)", [(1, 3), (2, None)]),
        ("SELECT a, b, o FROM UNNEST([1, 2] AS a, [3] AS b, mode => 'TRUNCATE') WITH OFFSET AS o", [(1, 3, 0)]),
        ("SELECT id, a, b FROM (SELECT 7 AS id), UNNEST([1, 2] AS a, ['x', 'y'] AS b, mode => 'STRICT')", [(7, 1, "x"), (7, 2, "y")]),
        ("SELECT a FROM UNNEST(CAST(NULL AS ARRAY<INT64>) AS a, [5] AS b)", [(None,)]),
        ("SELECT TRUNC(NUMERIC '1234567890123456789.123456789', 2) = NUMERIC '1234567890123456789.12', CEIL(NUMERIC '-0.5') = 0, FLOOR(-1.2), TRUNC(IEEE_DIVIDE(1, 0))", [(True, True, -2, float("inf"))]),
        ("SELECT SAFE.PARSE_DATE('%Y', 'x'), SAFE.CHR(-1), SAFE.LOG10(-1), SAFE.REPEAT('a', -1), SAFE.ACOS(2), SAFE.DATE(2024, 13, 1)", [(None,) * 6]),
        ("SELECT 1 AS a, 2 AS b UNION ALL CORRESPONDING SELECT 3 AS c, 4 AS a", [(1,), (4,)]),
        ("SELECT 1 AS a, 2 AS b LEFT UNION ALL BY NAME SELECT 3 AS c, 4 AS a", [(1, 2), (4, None)]),
        ("SELECT DISTINCT PERCENTILE_CONT(x, 0.5) OVER (), PERCENTILE_DISC(x, 0.5) OVER (), SUM(DISTINCT x) OVER () FROM UNNEST([3, 1, 2, 2]) AS x", [(2.0, 2, 6)]),
        ("SELECT window_start, k FROM TUMBLE(TABLE (SELECT TIMESTAMP '2024-01-01 00:07:00' AS ts, 1 AS k, 'old' AS window_start), 'ts', INTERVAL 5 MINUTE)", [(datetime.datetime(2024, 1, 1, 0, 5), 1)]),
    ],
)
def test_dialect_forms(spark, query, want):
    assert rows(dialect.run(spark, query)) == want


@pytest.mark.parametrize(
    "query",
    ["SELECT a FROM UNNEST([1, 2] AS a, [3] AS b, mode => 'STRICT')", "SELECT 1 AS a UNION ALL BY NAME SELECT 2 AS b", "SELECT 1 AS x |> IF true (WHERE x = 1)", "SELECT 1 AS x |> IF false THEN (WHERE x = 1) ELSE WHERE x = 2"],
)
def test_dialect_form_errors(spark, query):
    with pytest.raises(Exception):  # noqa: B017
        dialect.run(spark, query).collect()


def test_table_changes_as_text(spark):
    dialect.script(spark, "CREATE TABLE tchange (k INT64, v STRING, PRIMARY KEY (k)); INSERT INTO tchange (k, v) VALUES (1, 'a'), (2, 'b')")
    with pytest.raises(ValueError):
        dialect.run(spark, "INSERT INTO tchange VALUES (2, 'x')")
    with pytest.raises(ValueError):
        dialect.run(spark, "DELETE FROM tchange")
    out = dialect.script(spark, "UPDATE tchange AS c SET v = CONCAT(c.v, '!') WHERE c.k = 2; DELETE tchange WHERE k = 1; INSERT OR UPDATE INTO tchange (k, v) VALUES (2, 'n'), (3, 'm'); SELECT * FROM tchange")
    assert rows(out) == [(2, "n"), (3, "m")]
    assert dialect.run(spark, "TRUNCATE TABLE tchange").count() == 0


def test_merge_with_several_matches(spark):
    t, s = spark.createDataFrame([(1, "a")], "k int, v string"), spark.createDataFrame([(1, "x"), (1, "y")], "k int, v string")
    with pytest.raises(ValueError):
        dml.merge(t, s, ["k"], matched={"v": F.col("s.v")})
    twice = spark.createDataFrame([(1, "x"), (2, "y"), (2, "z")], "k int, v string")
    assert rows(dml.merge(t, twice, ["k"], matched={"v": F.col("s.v")})) == [(1, "x"), (2, "y"), (2, "z")]


def test_having_extreme_keeps_groups_without_values(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, 7), ("b", None, 1)], "k string, y int, v int")
    got = rows(aggregation.having_extreme(df, ["k"], F.col("y"), {"n": F.count("v"), "s": F.sum("v")}))
    assert got == [("a", 1, 7), ("b", 0, None)]


def _plain_search(base, queries, k, distance):
    """Every pair, in Catalyst."""
    score = vectors.DISTANCES[distance](F.col("v"), F.col("q"))
    met = base.join(queries.withColumnRenamed("v", "q").withColumnRenamed("id", "query_id").drop("tag"), F.size("v") == F.size("q"))
    met = met.select("query_id", "tag", "id", score.alias("distance"))
    return met.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "tag", "id"))).where(f"rank <= {k}")


@pytest.mark.parametrize("distance", list(vectors.DISTANCES))
@pytest.mark.parametrize("many", [1, 1 << 30])
def test_vector_search_on_ties_nulls_and_extremes(spark, monkeypatch, distance, many):
    """The same rows, ranks and distances, to the last bit, as all pairs compared one by one."""
    monkeypatch.setattr(vectors, "MANY_QUERIES", many)
    rng = random.Random(5)
    made = [[float(rng.randint(-1, 1)) for _ in range(2)] + [1.0] for _ in range(150)]  # most are equal to others
    made += [[1000 + rng.random() * 1e-4 for _ in range(3)] for _ in range(50)]  # differences below single precision
    made += [[rng.gauss(0, 1) for _ in range(n)] for n in [3, 5] * 40]
    made += [None, [None, 1.0, 2.0], [math.nan, 1.0, 2.0], [math.inf, 1.0, 2.0], [-math.inf, 1.0, 2.0], [1e200, 1.0, 2.0], [1e-30, 1.0, 0.0]]
    rng.shuffle(made)
    base = spark.createDataFrame([(rng.choice([None, "a", "b"]), i, v) for i, v in enumerate(made)], "tag string, id long, v array<double>").repartition(3).cache()
    for k, queries in ((4, base.where("id % 3 = 0")), (200, base.where("id % 20 = 0 OR v[0] IS NULL OR abs(v[0]) > 1e100"))):
        got = vectors.vector_search(base, queries, "v", "v", "id", top_k=k, distance=distance)
        assert got.columns == ["query_id", "tag", "id", "distance", "rank"]
        assert repr(rows(got)) == repr(rows(_plain_search(base, queries, k, distance)))  # NaN is equal to NaN there
    blocks = vectors.vector_search(base, queries, "v", "v", "id", top_k=4, distance=distance, block_bytes=500)
    assert repr(rows(blocks)) == repr(rows(_plain_search(base, queries, 4, distance)))
    base.unpersist()


def test_vector_search_of_vectors_without_length(spark):
    base = spark.createDataFrame([(None, 1, [0.0, 0.0]), (None, 2, [1.0, 0.0])], "tag string, id long, v array<float>")
    with pytest.raises(Exception, match="without length"):
        vectors.vector_search(base, base, "v", "v", "id", top_k=1).collect()


def test_vector_search_does_not_compare_pairs_one_by_one(spark):
    """24 million pairs; one by one they took more than a minute."""
    vector = F.transform(F.sequence(F.lit(1), F.lit(64)), lambda c: F.cos(F.col("id") * F.sqrt(c) * 7.3).cast("float"))
    base = spark.range(12_000).select("id", vector.alias("v")).cache()
    base.count()
    began = time.perf_counter()
    got = vectors.vector_search(base, base.where("id < 2000"), "v", "v", "id", top_k=3, distance="EUCLIDEAN").collect()
    assert time.perf_counter() - began < 25
    assert len(got) == 6000
    assert all(r["id"] == r["query_id"] and r["distance"] == 0 for r in got if r["rank"] == 1)
    x = {r["id"]: r["v"] for r in base.where("id % 40 = 0 OR id < 5").collect()}
    last = {r["query_id"]: r["distance"] for r in got if r["rank"] == 3 and r["query_id"] < 5}
    found = {(r["query_id"], r["id"]) for r in got}
    assert len(last) == 5
    assert all(math.dist(x[q], v) >= last[q] for q in last for i, v in x.items() if (q, i) not in found)
    base.unpersist()


def test_one_vector_in_many_rows_makes_few_pairs(monkeypatch):
    """Of equal rows, each slab sends on as many as can be among the best."""
    import numpy as np
    import pyarrow as pa

    class Packed:
        value = nearest.pack(pa.table({"id": list(range(50)), "v": pa.array([[1.0, 2.0]] * 50, pa.list_(pa.float32()))}))

    pairs, measure = [], nearest.measure
    monkeypatch.setattr(nearest, "measure", lambda kind, a, b, ansi: pairs.append(len(a)) or measure(kind, a, b, ansi))
    batch = pa.record_batch({"id": np.arange(3000), "v": pa.array([[1.0, 2.0]] * 3000, pa.list_(pa.float32()))})
    out = pa.Table.from_batches(nearest.nearest([batch], packed=Packed, kind="EUCLIDEAN", k=2, ansi=True))
    assert sum(pairs) <= 2
    assert out.sort_by([("query_id", "ascending"), ("id", "ascending")])["id"].to_pylist() == [0, 1] * 50
