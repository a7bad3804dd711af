import pytest

from tarnlake.plans.dialect import ParseError, Parser
from tarnlake.plans.logical import Aggregate, CostModel, Filter, Join, LogicalPlanner, Optimizer, Projection, Scan, Sort, StatsCatalog, TableStats, With, render
from tarnlake.plans.syntax import BinaryExpression, FunctionCall, Identifier, Literal, Star

parse = Parser().parse
plan = LogicalPlanner().plan


def test_clauses():
    q = parse("SELECT name, count(*), 1, 'x y' FROM crew JOIN ports ON port_id = id WHERE years >= 9 GROUP BY port, 1 ORDER BY name DESC, years ASC, id")
    assert [i.expression for i in q.select] == [Identifier("name"), FunctionCall("count", (Star(),)), Literal(1), Literal("x y")]
    assert q.joins[0].condition == BinaryExpression(Identifier("port_id"), "=", Identifier("id"))
    assert q.where == BinaryExpression(Identifier("years"), ">=", Literal(9))
    assert q.group_by == (Identifier("port"), Literal(1))
    assert [o.descending for o in q.order_by] == [True, False, False]


def test_or_binds_less_than_and_and_signs_may_stand_apart():
    w = parse("select a from t where a < 1 or b > = 2 and c = 3").where
    assert w.operator == "OR" and w.right.operator == "AND" and w.right.left.operator == ">="


def test_clause_words_are_not_reserved():
    q = parse("select from from crew")
    assert q.select[0].expression == Identifier("from") and q.table.name == "crew"
    assert parse("select order, f() from select where by = 1").select[1].expression == FunctionCall("f")


def test_ctes_nest():
    q = parse("with a as (with b as (select x from t) select x from b), c as (select x from a) select x from c")
    assert [c.name for c in q.ctes] == ["a", "c"] and q.ctes[0].query.ctes[0].name == "b"


@pytest.mark.parametrize(
    "text",
    ["select @ from crew", "select 1", "", "select a from t limit 1", "select a from t where a != 1", "select a from t where a <> 1", "select a from t left join u on a = b", "select a, from t", "select a from t where (a = 1)", "select f(a from t", "select 'a from t", "select a from t;", "select a from t where a = 1 = 2", "select t.a from t", "select -1 from t"],
)
def test_not_in_the_dialect(text):
    with pytest.raises(ParseError):
        parse(text)


def test_plan_shapes():
    assert plan(parse("select a from t")) == Projection(Scan("t"), parse("select a from t").select)
    p = plan(parse("with c as (select a from t) select a, max(b) from c join u on a = b where a > 1 group by a order by a"))
    assert isinstance(p, With) and isinstance(p.input, Sort) and isinstance(p.input.input, Aggregate)
    assert isinstance(p.input.input.input, Filter) and isinstance(p.input.input.input.input, Join)
    assert isinstance(plan(parse("select a from t group by a")), Aggregate)


def test_constants_fold():
    p = Optimizer().optimize(plan(parse("select name from crew where 1 = 1 and 2 = 2")))
    assert p.input.predicate == Literal(True)
    p = Optimizer().optimize(plan(parse("select name from crew where a = 1 and 2 < 1")))
    assert p.input.predicate.right == Literal(False)


def test_join_strategies_follow_statistics():
    join = plan(parse("select a from crew join ports on x = y"))
    assert Optimizer().optimize(join).input.strategy is None
    for rows, strategy in (((1000, 10), "broadcast"), ((6000, 6000), "sort_merge"), ((1000, 1000), "hash")):
        stats = StatsCatalog()
        for name, n in zip(("crew", "ports"), rows, strict=True):
            stats.register(name, TableStats(n))
        assert Optimizer(stats=stats).optimize(join).input.strategy == strategy


def figures(text, **options):
    cost = CostModel(**options).estimate(plan(parse(text)))
    return cost.rows, cost.cpu, cost.io, cost.network


def test_costs():
    scan = CostModel().estimate(Scan("t"))
    assert (scan.rows, scan.cpu, scan.io, scan.network, scan.total) == (1000, 1000, 500, 0, 1500)
    assert figures("select a from t") == (1000, 1100, 500, 0)
    assert figures("select a from t where a = 1") == (500, 1000 + 125 + 50, 500, 0)
    assert figures("select a from t join u on a = b") == (1000, 2000 + 3000 + 100, 1000, 2000)
    assert figures("select count(*) from t group by a") == (100, 1000 + 150, 500, 0)
    assert figures("select a from t order by a") == (1000, 1100 + 2000, 500, 0)
    assert figures("with c as (select a from t) select a from c") == (1000, 1100, 500, 0)
    assert CostModel().estimate(Scan("t"), 10).total == 15
    stats = StatsCatalog()
    stats.register("t", TableStats(40))
    assert figures("select a from t join u on a = b", stats=stats)[0] == 1000 and CostModel(stats).estimate(Scan("t")).rows == 40
    query = parse("select a, * from t where 1 = 1")
    assert Optimizer().optimize_query(query) == query
    assert "Filter (a = 1)" in render(plan(parse("select a from t where a = 1")))
