"""Aging of every day, spells at risk, calendar burn, as-of balances, rollup, sketches, phrases, stored checks."""

import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from cashweave.operators import aging, as_of, cash, ledger, phrases, receivables as ar, sales, sketches
from cashweave.plans import answers, registry
from cashweave.schemas import SOURCES
from cashweave.session import checkpointed
from cashweave.sources.star_tables import StarTables
from helpers import customers, day, invoices, payments, position, spans

FOLDER = "/root/testdata/sf0.001"


# --- aging -------------------------------------------------------------------


def test_aging_of_every_day_is_that_of_each_day(spark):
    inv = invoices(spark, [
        ("A", "C1", "2024-01-05", 100), ("A", "C1", "2024-01-05", 100), ("A", "C1", "2024-02-01", 40), ("A", "C2", "2023-10-01", 7),
        ("A", "C2", "2024-01-20", None), ("B", "C3", "2024-01-31", 9), ("A", "nobody", "2024-01-05", 5), ("A", "C4", "2024-01-10", 3),
    ])
    pay = payments(spark, [("A", "C1", "2024-01-20", 100), ("A", "C1", "2024-05-30", 100), ("A", "C4", "2024-01-01", 3), ("A", "C2", "2024-01-02", 8)])
    who = customers(spark, [("A", "C1", "n", 10, False), ("A", "C2", "n", 0, False), ("B", "C3", "n", 45, False), ("A", "C4", "n", 5, False)])
    span = spans(spark, [("A", "2024-01-01", "2024-06-30", 0), ("B", "2024-01-01", "2024-04-01", 0)])
    got = {}
    for r in aging.aging_by_day(inv, pay, who, span).collect():
        got[r["tenant_id"], r["as_of"], r["bucket"]] = (r["open_invoices"], r["open_amount"])
    for on in ("2024-01-01", "2024-01-05", "2024-01-15", "2024-01-16", "2024-01-20", "2024-02-14", "2024-02-15", "2024-03-16", "2024-05-29", "2024-05-30", "2024-06-30"):
        want = {}
        # an unpriced invoice counts, with no money
        for r in ar.ar_aging(inv, pay, who, day(on)).collect():
            if r["tenant_id"] == "B" and on > "2024-04-01":
                continue
            n, money = want.get((r["tenant_id"], day(on), r["bucket"]), (0, Decimal(0)))
            want[r["tenant_id"], day(on), r["bucket"]] = (n + r["open_invoices"], money + (r["open_amount"] or 0))
        assert {k: v for k, v in got.items() if k[1] == day(on)} == want, on


def test_aging_without_invoices_or_terms(spark):
    span = spans(spark, [("A", "2024-01-01", "2024-01-03", 0)])
    none = invoices(spark, [])
    who = customers(spark, [("A", "C1", "n", None, False)])
    assert aging.aging_by_day(none, payments(spark, []), who, span).count() == 0
    got = aging.aging_by_day(invoices(spark, [("A", "C1", "2024-01-02", 5)]), payments(spark, []), who, span).collect()
    assert sorted((r["as_of"].day, r["bucket"]) for r in got) == [(2, "over 90"), (3, "over 90")]


# --- cash --------------------------------------------------------------------


def at_risk(spark, days, start="2024-01-01"):
    """days: balances, None for a missing day."""
    first = day(start)
    rows = [("A", first + dt.timedelta(days=i), Decimal(b), None) for i, b in enumerate(days) if b is not None]
    return spark.createDataFrame(rows, "tenant_id string, position_date date, closing_balance decimal(18,2), estimated_cash_runway_days double")


@pytest.mark.parametrize("days, want", [
    ([5000, 1000, 500, 5000], [(2, 3, 2, 500, 3, 4, False)]),
    ([1000, 1000], [(1, 2, 2, 1000, 1, None, True)]),
    ([1000, None, 900, 5000], [(1, 1, 1, 1000, 1, None, False), (3, 3, 1, 900, 3, 4, False)]),
    ([1000, 3000, 1000, None, 3000], [(1, 1, 1, 1000, 1, 2, False), (3, 3, 1, 1000, 3, None, False)]),
    ([5000], []), ([], []),
])
def test_spells(spark, days, want):
    got = cash.crunch_episodes(at_risk(spark, days)).orderBy("first_day").collect()
    at = lambda d: d and d.day
    assert [(at(r["first_day"]), at(r["last_day"]), r["days"], int(r["lowest_balance"]), at(r["lowest_day"]), at(r["recovered_on"]), r["open"]) for r in got] == want
    assert all(r["depth"] == 2000 - r["lowest_balance"] for r in got)


def test_a_short_runway_is_a_spell_too(spark):
    rows = at_risk(spark, [9000, 9000, 9000]).withColumn("estimated_cash_runway_days", F.when(F.dayofmonth("position_date") == 2, 10.0))
    assert [r["first_day"].day for r in cash.crunch_episodes(rows).collect()] == [2]


def test_burn_by_calendar(spark):
    dense = position(spark, [(-1) ** i * i for i in range(80)])
    same = cash.burn_runway(dense).exceptAll(cash.burn_by_calendar(dense))
    assert same.count() == 0
    gappy = dense.where(F.dayofmonth("position_date").isin(1, 10, 28))
    got = {r["position_date"]: r["avg_daily_net_burn_30d"] for r in cash.burn_by_calendar(gappy).collect()}
    flows = {r["position_date"]: float(r["total_outflows"] - r["total_inflows"]) for r in gappy.collect()}
    first = min(flows)
    for on, burn in got.items():
        inside = [f for d, f in flows.items() if 0 <= (on - d).days < 30]
        assert burn == pytest.approx(sum(inside) / min(30, (on - first).days + 1))


def test_as_of(spark):
    series = spark.createDataFrame(
        [("A", day("2024-01-05"), 1), ("A", day("2024-01-10"), 2), ("A", day("2024-01-10"), 3), ("B", day("2024-01-07"), 9), ("A", None, 7)],
        "tenant_id string, position_date date, closing_balance int")
    asked = [("A", "2024-01-04"), ("A", "2024-01-05"), ("A", "2024-01-09"), ("A", "2024-01-10"), ("A", "2025-01-01"), ("A", "2025-01-01"), ("C", "2024-01-09"), ("B", None), (None, "2024-01-09")]
    requests = spark.createDataFrame([(i, t, d and day(d)) for i, (t, d) in enumerate(asked)], "id int, tenant_id string, asked_date date")
    got = {r["id"]: (r["closing_balance"], r["age_days"]) for r in as_of.as_of(requests, series).collect()}
    assert got == {0: (None, None), 1: (1, 0), 2: (1, 4), 3: (3, 0), 4: (3, 357), 5: (3, 357), 6: (None, None), 7: (None, None), 8: (None, None)}


def test_seasons(spark):
    span = spans(spark, [("A", "2024-01-01", "2024-12-31", 0)])
    duty = spark.createDataFrame([("A", "utilities", "u", Decimal("380.00"), "monthly", 0, 0, None)],
                                 "tenant_id string, category string, description string, amount decimal(18,2), cadence string, offset_days int, step_days int, due_date date")
    season = duty.withColumn("season", F.array(*[F.lit(Decimal("1.15" if m in (1, 7, 8, 12) else "1.00")) for m in range(1, 13)]))
    got = {r["entry_date"].month: r["amount"] for r in ledger.recurring_entries(season, span).collect()}
    assert got == {m: Decimal("437.00") if m in (1, 7, 8, 12) else Decimal("380.00") for m in range(1, 13)}
    for odd in (F.lit(None).cast("array<decimal(4,2)>"), F.array(F.lit(Decimal("2.00")))):
        amounts = [r["amount"] for r in ledger.recurring_entries(duty.withColumn("season", odd), span).orderBy("entry_date").collect()]
        assert set(amounts[1:]) == {Decimal("380.00")}


# --- sales ---------------------------------------------------------------------


def bought(spark, rows):
    return spark.createDataFrame([("A", "retail", c, day(d)) for c, d in rows], "tenant_id string, channel string, customer_id string, transaction_date date")


def test_trailing_customers(spark):
    rows = [("a", "2024-01-01"), ("a", "2024-01-01"), ("a", "2024-01-20"), ("b", "2024-01-30"), ("b", "2024-01-31"), ("c", "2024-02-18"), ("a", "2024-02-19"), (None, "2024-03-25"), ("d", "2024-06-01")]
    lines = bought(spark, rows)
    exact = {r["as_of"]: r["customers"] for r in sketches.trailing_customers_exact(lines).collect()}
    for on in {day(d) for _, d in rows}:
        assert exact[on] == len({c for c, d in rows if c and 0 <= (on - day(d)).days < 30}), on
    got = sketches.sketch_error(sketches.trailing_customers(sketches.customer_sketches(lines)), sketches.trailing_customers_exact(lines)).collect()
    assert len(got) == len(exact) and all(r["estimate_within_error"] for r in got)
    assert sketches.period_customers(sketches.customer_sketches(lines), "tenant_id").first()["customers"] == 4


def test_sketches_of_many_customers_are_within_their_error(spark):
    lines = spark.range(60_000).select(
        F.lit("A").alias("tenant_id"), F.lit("retail").alias("channel"), (F.col("id") % 20_000).cast("string").alias("customer_id"),
        F.date_add(F.lit(dt.date(2024, 1, 1)), (F.col("id") % 40).cast("int")).alias("transaction_date"))
    got = sketches.sketch_error(sketches.trailing_customers(sketches.customer_sketches(lines)), sketches.trailing_customers_exact(lines)).collect()
    assert len(got) == 40 and all(r["estimate_within_error"] for r in got) and max(r["customers"] for r in got) >= 14_000


def test_rollup_has_one_exchange_for_all_levels(spark):
    t = StarTables(spark, FOLDER)
    lines, listed = checkpointed(t.sales().drop("delay_days")), checkpointed(t.products)
    rolled = sales.revenue_rollup(lines, listed)
    plan = rolled._jdf.queryExecution().executedPlan().toString()
    joined = plan.index("Join")
    assert plan[:joined].count("Exchange") == 1 and plan[:joined].count("Expand") == 1
    by = {r["level"]: r["s"] for r in rolled.groupBy("level").agg(F.sum("sales").alias("s")).collect()}
    assert set(by.values()) == {lines.count()} and len(by) == len(sales.LEVELS)


# --- phrases ---------------------------------------------------------------------


@pytest.mark.parametrize("text, want", [
    ("How much cash do we have?", ["how much cash do we have"]), ("At-Risk Customers!", ["at-risk customer"]),
    ("who owes us money, and what owes us", ["who owes us money", "owes us"]), ("Who’s late", ["who's late"]),
    ("retail revenue revenue wholesale   revenue", ["retail revenue", "revenue", "wholesale revenue"]),
    ("month to date", []), ("sale of best seller", ["sales", "best sellers"]), ("", []), (None, []), ("bar car", []), ("the A/R: ar", ["ar"]),
])
def test_longest_phrases(spark, text, want):
    got = phrases.question_metrics(spark.createDataFrame([(text,)], "question string")).orderBy("place").collect()
    assert [r["term"] for r in got] == want and all(r["metric"] for r in got)


def plain_terms(text, vocabulary):
    """The terms of a text without accents, word by word in Python."""
    tokens = phrases.normal(text or "").split()
    known = {phrases.normal(t): t for t in reversed(vocabulary)}
    out, at = [], 0
    while at < len(tokens):
        size = next((n for n in range(len(tokens) - at, 0, -1) if " ".join(tokens[at : at + n]) in known), 0)
        if size:
            out.append((at + 1, known[" ".join(tokens[at : at + size])]))
        at += max(size, 1)
    return out


def test_words_are_cut_once_a_row_and_terms_equal_a_plain_search(spark):
    vocabulary = ["a", "a b", "b c", "a b c d", "c", "d a", "A-B", "c c", "a", "revenues", "x revenue"]
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["a", "b", "c", "d", "A-b", "revenue", "x", "Revenues!", "é"]) for _ in range(rng.randrange(12))) for _ in range(300)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None, "", "a b", "a b c"])], "i int, text string")
    found = rows.select("i", "text", phrases.terms_in(F.col("text"), vocabulary).alias("found"))
    for r in found.collect():
        assert [tuple(x) for x in r["found"]] == plain_terms(r["text"], vocabulary), r["text"]
    plan = phrases.question_metrics(rows.withColumnRenamed("text", "question"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1  # a copy at each look-up cut the words some hundred times a row


# --- checks over written tables -----------------------------------------------------


def test_a_corrupted_table_fails_its_check(spark):
    tables = registry.stored_tables(StarTables(spark, FOLDER))

    def report(**changed):
        stored = answers.Stored(spark, tables={**tables, **changed}.__getitem__)
        return {r["check_name"] for r in answers.stored_checks(stored).where("tenant_id = 'T07' AND violations > 0").collect()}

    before = report()
    position, last = tables["gold_cash_position"], F.col("position_date") == F.lit(dt.date(2001, 8, 1))
    balance = F.when(last, F.col("closing_balance") + 1).otherwise(F.col("closing_balance"))
    off = position.withColumn("closing_balance", balance.cast(position.schema["closing_balance"].dataType))
    assert "latest_balance" in report(gold_cash_position=off) - before
    flipped = tables["gold_product_performance"].withColumn("needs_reorder", ~F.col("needs_reorder"))
    assert report(gold_product_performance=flipped) - before == {"reorder_flag"}
    changed = {}
    for name in SOURCES:  # every table with each row twice, one of them without its key
        silver, key = tables[f"silver_{name}"], SOURCES[name].key[1]
        changed[f"silver_{name}"] = silver.unionByName(silver).unionByName(silver.withColumn(key, F.lit(None).cast(silver.schema[key].dataType)))
    assert {f"{name}_{check}" for name in SOURCES for check in ("key", "required")} <= report(**changed) - before


def test_stored_tables_join_sales_once_and_are_read_by_column(spark, tmp_path):
    rows = lambda data, schema, name: spark.createDataFrame(data, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    rows([(0, "n0"), (1, "n1")], "n_nationkey int, n_name string", "nation")
    rows([(1, "c1", 0, -5.0, "BUILDING"), (2, "c2", 1, 9.0, "HOUSEHOLD"), (3, "c3", 0, None, None), (None, "c4", 1, 1.0, "MACHINERY")],
         "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string", "customer")
    rows([(i, 1 + i % 3, dt.datetime(1997, 1, 1) + dt.timedelta(days=40 * i)) for i in range(9)] + [(9, 2, None), (10, None, dt.datetime(1998, 1, 1))],
         "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz", "orders")
    line = [(i, 1 + (i + j) % 4, 1, j, 2.0, 10.0 * i + j, dt.datetime(1998, 1, 1)) for i in range(11) for j in range(3)]
    rows([*line, *line[:7], (3, 2, 1, 9, 0.0, None, None)], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
         "l_extendedprice double, l_shipdate timestamp_ntz", "lineitem")
    rows([(i, f"p{i}", "PROMO", i, 9.5) for i in range(1, 5)], "p_partkey long, p_name string, p_type string, p_size int, p_retailprice double", "part")
    t, calls = StarTables(spark, str(tmp_path)), []
    t.sales = lambda *period: calls.append(period) or StarTables.sales(t, *period)
    tables = registry.stored_tables(t)
    assert len(calls) == 1
    assert all(df.inputFiles() for df in tables.values())
    plain = StarTables(spark, str(tmp_path))
    for name, want in {"products": plain.products, "customers": plain.customers, "sales_transactions": plain.sales().drop("delay_days"),
                       "cash_ledger": plain.ledger, "daily_cash_position": plain.position}.items():
        got = tables[f"silver_{name}"]
        assert got.dtypes == want.dtypes
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) != []
