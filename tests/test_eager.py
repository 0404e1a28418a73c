from strandloom.operators.eager import eager_join_aggregate, heavy_keys


def rows(df):
    return {r["k"]: r for r in df.collect()}


def test_states_give_what_the_join_would(spark):
    left = spark.createDataFrame([("a", 1, 9), ("a", 2, 9), ("a", None, 9), ("b", 5, 9), (None, 7, 9)], "k string, x int, extra int")
    right = spark.createDataFrame([("a", 10, "z"), ("a", 20, "z"), ("c", 1, "z")], "k string, y int, extra string")
    got = rows(eager_join_aggregate(left, right, ["k"], ["x"], ["y"], [("x", "y")]))
    assert set(got) == {"a", "b"}
    a = got["a"]
    assert (a["n_left"], a["n_right"], a["pairs"]) == (3, 2, 6)
    assert (a["joined_left_sum_x"], a["joined_right_sum_y"], a["joined_product_x_y"]) == (6, 90, 90)
    assert got["b"]["pairs"] == 0 and got["b"]["joined_left_sum_x"] == 0
    full = rows(eager_join_aggregate(left, right, ["k"], ["x"], ["y"], how="full"))
    assert full["c"]["n_left"] == 0 and full["c"]["n_right"] == 1


def test_same_as_plain_join(spark):
    left = spark.range(2000).selectExpr("case when id % 3 = 0 then 'hot' else concat('k', id % 17) end as k", "id % 7 as x", "id % 2 as g")
    right = spark.range(300).selectExpr("case when id % 3 = 0 then 'hot' else concat('k', id % 11) end as k", "id % 5 as y", "id as g")
    got = {k: (r["pairs"], r["joined_left_sum_x"], r["joined_right_sum_y"]) for k, r in rows(eager_join_aggregate(left, right, ["k"], ["x"], ["y"], how="inner")).items()}
    left.select("k", "x").join(right.select("k", "y"), "k").createOrReplaceTempView("j")
    want = {r["k"]: (r["n"], r["sx"], r["sy"]) for r in spark.sql("select k, count(*) n, sum(x) sx, sum(y) sy from j group by k").collect()}
    assert got == want


def test_roll_up_and_heavy_keys(spark):
    left = spark.createDataFrame([("a", "g", 1)] * 24 + [("b", "g", 1)] + [("c", "h", 1)] * 75, "k string, g string, x int")
    right = spark.createDataFrame([("a", "g")], "k string, g string")
    states = eager_join_aggregate(left, right, ["k", "g"], ["x"])
    up = {r["g"]: r["n_left"] for r in eager_join_aggregate(left, right, ["k", "g"], ["x"], roll_up=["g"]).collect()}
    assert up == {"g": 25, "h": 75}
    assert {r["k"] for r in heavy_keys(states, "k", "n_left", (24, 100)).collect()} == {"a", "c"}


def test_empty_sides(spark):
    none = spark.createDataFrame([], "k string, x int")
    some = spark.createDataFrame([("a", 1)], "k string, x int")
    assert eager_join_aggregate(none, some, ["k"], ["x"]).count() == 0
    assert rows(eager_join_aggregate(some, none, ["k"], ["x"], ["x"]))["a"]["right_sum_x"] == 0
    assert heavy_keys(eager_join_aggregate(none, none, ["k"]), "k", "n_left", (1, 25)).count() == 0


def test_roll_up_to_what_the_other_side_says(spark):
    left = spark.createDataFrame([("chr1", 1)] * 3 + [("1", 5)] * 4 + [("2", 1), (None, 1), ("x", 1)], "k string, x int")
    right = spark.createDataFrame([("chr1", "1"), ("1", "1"), ("2", "2"), ("3", "3"), (None, "n")], "k string, g string")
    up = eager_join_aggregate(left, right, ["k"], ["x"], how="inner", roll_up=["g"], right_attributes=["g"])
    assert {r["g"]: (r["n_left"], r["pairs"], r["left_sum_x"]) for r in up.collect()} == {"1": (7, 7, 23), "2": (1, 1, 1)}
