from pyspark.sql import functions as F

from docsql.operators import assistant


def test_statements_and_guard(spark):
    assert assistant.statements("select 1; -- x;\nselect ';' ; ") == ["select 1", "-- x;\nselect ';'"]
    got = assistant.run_sql(spark, "select 1 as a; select id from range(300); drop table x; select 2")
    assert got[0]["rows"] == [[1]] and got[1]["truncated"] and len(got[1]["rows"]) == 100 and "only queries" in got[2]["error"] and len(got) == 3
    assert assistant.run_sql(spark, "create table t_x (a int)")[0]["error"]
    assert "internal" in assistant.run_sql(spark, "select * from secret.t", internal=("secret",))[0]["error"]
    assert assistant.run_sql(spark, "selec 1")[0]["error"] and assistant.run_sql(spark, "") == []


def test_tagged(spark):
    t = 'Hi <think>a plan</think>there<tool_call>{"name":"f","arguments":{"x":1}}</tool_call><tool_call><function=g><parameter=k>v</parameter></function></tool_call><tool_call>oops</tool_call><tool_response>no'
    r = spark.createDataFrame([(t,), (None,)], "t string").select(assistant.tagged(F.col("t")).alias("x")).collect()
    assert r[0]["x"]["text"] == "Hi there" and r[0]["x"]["reasoning"] == "a plan"
    assert [(c["name"], c["input"]) for c in r[0]["x"]["calls"]][:2] == [("f", '{"x": 1}'), ("g", '{"k": "v"}')] and r[0]["x"]["calls"][2]["error"]
    assert r[1]["x"]["text"] == ""
    for n in (1, 3, 7, 1000):
        p, got = assistant.Tagged(), []
        for i in range(0, len(t), n):
            got += p.push(t[i : i + n])
        got += p.flush()
        join = lambda k: "".join(x for s, x in got if s == k)  # noqa: B023, E731
        assert join("text") == "Hi there" and join("think") == "a plan" and join("call").startswith('{"name"')


def test_packed(spark):
    df = spark.createDataFrame([("a", i, s) for i, s in enumerate([5, 5, 20, 1, 1, 9])] + [("b", 0, 3)], "k string, i int, s int")
    got = {(r["k"], r["i"]): r["batch"] for r in assistant.packed(df, "k", "i", "s", 10).collect()}
    assert [got["a", i] for i in range(6)] == [0, 0, 1, 2, 2, 3] and got["b", 0] == 0
    got = {(r["k"], r["i"]): r["batch"] for r in assistant.packed(df, "k", "i", "s", 10, True).collect()}
    assert [got["a", i] for i in range(6)] == [0, 0, 1, 2, 2, 3]


def test_history(spark):
    rows = [("t", i, "user" if i % 3 == 0 else "assistant", 10) for i in range(10)]
    df = spark.createDataFrame(rows, "t string, i int, role string, size int")
    got = lambda most, chars: sorted(r["i"] for r in assistant.recent_history(df, "t", ["i"], most, chars, "size").collect())
    assert got(5, 1000) == [6, 7, 8, 9] and got(10, 40) == [6, 7, 8, 9] and got(10, 1) == [9]


def test_calls_grades_memory(spark):
    df = spark.createDataFrame([("r", 1, "a"), ("r", 2, "a"), ("r", 3, "b"), ("r", 4, "a"), ("r", 5, "b")], "r string, i int, s string")
    assert [r["repeated"] for r in assistant.repeated_calls(df, "r", "i", "s").orderBy("i").collect()] == [False, True, False, True, False]
    g = spark.createDataFrame([(["a"], ["b"], ["a"]), (["a"], None, None), (None, ["b"], ["b"])], "required array<string>, forbidden array<string>, used array<string>")
    assert [r["passed"] for r in assistant.graded(g).collect()] == [True, False, False]
    m = spark.createDataFrame([("likes tea",), (" ",), (None,), ("password is Tr0ub4dor&3",)], "t string")
    assert [r["t"] for r in assistant.memorable(m, "t").collect()] == ["likes tea"]
    b = spark.createDataFrame([(8192, 1024, 2000), (100, 50, 0)], "w int, r int, f int").select(assistant.budget(F.col("w"), F.col("r"), F.col("f")).alias("b"))
    assert [r["b"] for r in b.collect()] == [20937, 1500]
