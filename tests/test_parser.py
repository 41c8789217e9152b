"""Parsing and refusals; no session needed."""

import pytest

from tidemark.engine import bind, point_in_time
from tidemark.plans import nodes as N
from tidemark.plans.lexer import QueryError, tokens
from tidemark.plans.parser import parse, parse_expression, seconds

REFUSED = [
    ("", "empty statement"),
    ("FROB x", "no statement begins"),
    ("SELECT a FROM t extra", "after statement"),
    ("SELECT *, a FROM t", "stands alone"),
    ("SELECT a FROM t JOIN u ON a = b", "reads one table"),
    ("SELECT a FROM t, u", "reads one table"),
    ("SELECT a FROM t LIMIT x", "LIMIT expects a number"),
    ("SELECT a FROM t LIMIT 1.5", "invalid LIMIT"),
    ("SELECT a FROM t WHERE b = 'x", "unterminated string"),
    ("SELECT SUM(*) FROM t", "only COUNT takes"),
    ("SELECT SUM(a + b) FROM t", "is one attribute"),
    ("SELECT SUM(DISTINCT a) FROM t", "take DISTINCT"),
    ("SELECT COUNT(DISTINCT *) FROM t", "values of one attribute"),
    ("SELECT SUM(CASE WHEN a = 1 THEN 1 ELSE 2 END) FROM t", "ELSE NULL"),
    ("SELECT SUM(CASE WHEN a = 1 THEN 1 WHEN a = 2 THEN 1 END) FROM t", "single WHEN"),
    ("SELECT MAX(CASE WHEN a = 1 THEN 1 END) FROM t", "THEN 1 counts rows"),
    ("SELECT SUM(CASE WHEN COUNT(*) = 1 THEN 1 END) FROM t", "nest"),
    ("SELECT a, COUNT(*) FROM t", "need GROUP BY"),
    ("SELECT * FROM t GROUP BY a", "groups have no"),
    ("SELECT a, b, COUNT(*) FROM t GROUP BY a", "differs within a group"),
    ("SELECT COUNT(*) FROM t GROUP BY a / 2", "has to be selected"),
    ("SELECT time_bucket(ts, '1h') FROM t", "add GROUP BY"),
    ("SELECT time_bucket(ts) FROM t", "a width such as"),
    ("SELECT COUNT(*) FROM t HAVING b > 1", "no column of the groups"),
    ("SELECT a FROM t HAVING COUNT(*) > 1", "without GROUP BY"),
    ("SELECT RANK() FROM t", "add OVER"),
    ("SELECT RANK(a) OVER (ORDER BY a) FROM t", "nothing goes between"),
    ("SELECT RANK() OVER (PARTITION BY a) FROM t", "add ORDER BY"),
    ("SELECT a FROM t QUALIFY a = 1", "no ranking to QUALIFY"),
    ("SELECT a, RANK() OVER (ORDER BY a) AS r FROM t WHERE r = 1", "in QUALIFY"),
    ("SELECT a, RANK() OVER (ORDER BY a) AS r FROM t QUALIFY a = 1", "no ranking of this SELECT"),
    ("SELECT COUNT(*), RANK() OVER (ORDER BY a) FROM t", "no groups or aggregates"),
    ("INSERT INTO t VALUES (1)", "names its columns"),
    ("INSERT INTO t (a, b) VALUES (1)", "2 columns but 1 values"),
    ("INSERT INTO t (a) VALUES ('x\ny')", "no line breaks"),
    ("UPDATE t SET a 1", "expected `=`"),
    ("CREATE FROG x", "CREATE makes"),
    ("CREATE MATERIALIZED TABLE x", "expected VIEW"),
    ("CREATE MATERIALIZED VIEW v AS SELECT a, MAX(b) FROM t GROUP BY a", "not MAX"),
    ("CREATE MATERIALIZED VIEW v AS SELECT COUNT(*) FROM t", "add GROUP BY"),
    ("CREATE MATERIALIZED VIEW v AS SELECT a, COUNT(*) FROM t WHERE b GROUP BY a", "no WHERE"),
    ("CREATE MATERIALIZED VIEW v AS SELECT a, COUNT(*) FROM t GROUP BY a WITH (grace='10m')", "only views over a time_bucket"),
    ("CREATE MATERIALIZED VIEW v AS SELECT a, COUNT(*) FROM t GROUP BY a WITH (frog='1')", "grace and retention, not"),
    ("WATCH COUNT(*) FROM t", "no aggregates"),
    ("WATCH * FROM t SINCE YESTERDAY", "SINCE NOW or SINCE BEGINNING"),
    ("EXPLAIN EXPLAIN SELECT a FROM t", "takes a SELECT"),
]


@pytest.mark.parametrize(("text", "message"), REFUSED)
def test_refused(text, message):
    with pytest.raises(QueryError, match=message.replace("*", r"\*").replace("(", r"\(").replace(")", r"\)")):
        parse(text)


def test_lexer():
    assert [t.text for t in tokens("a=?=b;c <> 'it''s' \"x\"")] == ["a", "=?=", "b", "c", "<>", "it's", "x", ""]


def test_spellings_agree():
    assert parse_expression("a = 1 AND NOT b <> 2") == parse_expression("a == 1 && !(b != 2)")
    assert parse_expression("a IS NOT NULL") == parse_expression("a =!= undefined")


def test_precedence():
    assert parse_expression("1 + 2 * 3") == N.Binary("+", N.Literal(1), N.Binary("*", N.Literal(2), N.Literal(3)))
    assert parse_expression("a || b && c") == N.Binary("||", N.Ref("a"), N.Binary("&&", N.Ref("b"), N.Ref("c")))


def test_case_lowering():
    item = parse("SELECT SUM(CASE WHEN s = 2 THEN 1 ELSE 0 END) AS n FROM t").items[0].node
    assert item == N.Aggregate("COUNT", "*", where=N.Binary("==", N.Ref("s"), N.Literal(2)))


def test_view_options():
    v = parse("CREATE MATERIALIZED VIEW v MAXSERIES 5 AS SELECT time_bucket(t, '1h') AS b, COUNT(*) AS n FROM x GROUP BY b WITH (grace='10m', retention='30d')")
    assert (v.max_series, v.grace, v.retention) == (5, 600, 2592000)


def test_match():
    m = parse("MATCH KEY '1.0' IN jobs TO machines USING (Owner) NOPREEMPT WHERE Cpus > 1 WHERE TARGET Arch = 'X' LIMIT 3")
    assert (m.key, m.requests, m.resources, m.using, m.no_preempt, m.limit) == ("1.0", "jobs", "machines", ("Owner",), True, 3)
    assert m.where is not None and m.target is not None


def test_durations_and_times():
    assert [seconds(x) for x in ("30s", "5m", "1h", "1d", "1w", "90")] == [30, 300, 3600, 86400, 604800, 90]
    assert point_in_time("-1h30m", 10_000) == 10_000 - 5400
    assert point_in_time("2024-01-01T00:00:00+00:00") == 1704067200
    with pytest.raises(QueryError):
        point_in_time("sometime")


def test_bind():
    assert bind("a = ? AND b = '?' AND c =?= ?", [1, "o'k"]) == "a = 1 AND b = '?' AND c =?= 'o''k'"
    assert bind("x = ?", [[1, None, True]]) == "x = {1, UNDEFINED, true}"
    for params in ([], [1, 2]):
        with pytest.raises(QueryError):
            bind("a = ? and b = ? and c = ?", [1, *params][:2]) if params == [] else bind("a = ?", params)
    with pytest.raises(QueryError):
        bind("a = ?", [float("nan")])
