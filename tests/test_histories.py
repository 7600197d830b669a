import random

from pyspark.sql import functions as F

from lodestep.functions.money import price_sheet
from lodestep.operators import stats, trajectory


def prefix_of(spark, histories):
    rows = [(h, k, len(x), hash(x) % (1 << 60), hash((1, x)) % (1 << 60)) for h, items in histories.items() for k, x in enumerate(items)]
    return trajectory.prefixes(spark.createDataFrame(rows, "history string, pos int, tokens int, h1 long, h2 long"), ["h1", "h2"])


def leading(a, b):
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    return k


def test_shared_lengths_against_a_walk(spark):
    rng = random.Random(1)
    histories, pairs = {}, []
    for g in range(40):
        base = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(0, 30))]
        for v in range(3):
            cut = rng.randint(0, len(base))
            histories[f"{g}.{v}"] = base[:cut] + [rng.choice("abc") for _ in range(rng.choice([0, 0, 1, 5]))]
        for a, b in ((1, 0), (2, 1), (2, 2)):
            x, y = histories[f"{g}.{a}"], histories[f"{g}.{b}"]
            n, m = rng.randint(0, len(x)), rng.randint(0, len(y))
            pairs.append((f"{g}.{a}", n, f"{g}.{b}", m, leading(x[:n], y[:m])))
        pairs.append((f"{g}.0", len(histories[f"{g}.0"]), None, None, None))
    df = spark.createDataFrame(pairs, "history string, n_items int, previous_history string, previous_items int, want int")
    prefix = prefix_of(spark, histories)
    for rows in (100_000, 0):
        got = trajectory.shared_lengths(df, prefix, rows)
        assert got.count() == len(pairs) and got.where("not (shared <=> want)").isEmpty()


def test_costs_of_two_histories_and_of_a_change_of_model(spark):
    histories = {"x": ["aaaa", "bb", "c"], "y": ["aaaa", "bb", "d", "eee"], "z": []}
    calls = [("g", "x", 2, "gpt-5.6-sol", 0), ("g", "x", 3, "gpt-5.6-sol", 1), ("g", "y", 4, "gpt-5.6-sol", 2), ("g", "y", 4, "gpt-5.6-luna", 3), ("h", "z", 0, "claude-opus-5", 0)]
    df = spark.createDataFrame(calls, "grp string, history string, n_items int, model string, k int")
    got = {(r["grp"], r["k"]): (r["input_tokens"], r["cached_tokens"], round(r["usd"] * 1e6, 6)) for r in trajectory.cached_cost(df, prefix_of(spark, histories), "grp", "k", price_sheet(spark)).collect()}
    assert got == {("g", 0): (6, 0, 30.0), ("g", 1): (7, 6, 8.0), ("g", 2): (10, 6, 23.0), ("g", 3): (10, 0, 2.0), ("h", 0): (0, 0, 0.0)}


def test_a_conversation_of_100_000_turns(spark):
    n = 100_000
    items = spark.range(n).select(F.lit("long").alias("history"), F.col("id").cast("int").alias("pos"), F.lit(2).alias("tokens"), F.xxhash64("id").alias("h1"), F.xxhash64(F.lit(1), "id").alias("h2"))
    prefix = trajectory.prefixes(items, ["h1", "h2"])
    calls = prefix.where("length % 2 = 0").select("history", F.col("length").alias("n_items"), F.lit("gpt-5.6-sol").alias("model"))
    ordered = trajectory.call_order(calls, "history")
    got = trajectory.cached_cost(ordered, prefix, "history", "call_index", price_sheet(spark)).agg(F.count("*"), F.sum("input_tokens"), F.sum("cached_tokens"), F.max("call_index")).first()
    lengths = range(2, n + 1, 2)
    assert tuple(got) == (n // 2, 2 * sum(lengths), 2 * sum(k - 2 for k in lengths), n // 2 - 1)


def test_prefix_sums_of_groups_ties_and_nulls(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), rng.randint(0, 9), rng.randint(-5, 1 << 40), k) for k in range(300)]
    df = spark.createDataFrame(rows, "g string, o int, v long, k int").repartition(6)
    got = {r["k"]: (r["s"], r["n"]) for r in stats.prefix_sums(df.withColumn("one", F.lit(1)), ["g"], ["o", "k"], {"s": "v", "n": "one"}).collect()}
    for g, o, _, k in rows:
        upto = [r[2] for r in rows if r[0] == g and (r[1], r[3]) <= (o, k)]
        assert got[k] == (sum(upto), len(upto))
