"""Files in any order, twice, in any batches, with a lost driver between: the table of the full refresh."""

import random

import pytest

from cashweave.operators.clean import mark_rejects, rejects, to_silver
from cashweave.sources.files import read_bronze
from cashweave.streaming import incremental
from cashweave.streaming.incremental import Feed, load_new_files, rejected

HEAD = "tenant_id,transaction_id,transaction_date,customer_id,product_id,quantity,unit_price,total_amount,payment_method,channel"


def lines(rng, n, tenants=("A", "B'", "007", "a/b=c")):
    out = []
    for _ in range(n):
        # few keys, so that rows of one key with different values lie in many files
        out.append(f"{rng.choice(tenants)},K{rng.randint(0, 40)},2024-01-{rng.randint(1, 28):02},C{rng.randint(0, 5)},P1,{rng.randint(1, 9)},2.5,{rng.randint(1, 50)}.25,card,retail")
    out += ["A,K1,someday,C0,P1,1,1,1,card,retail", ",K1,2024-01-01,C0,P1,1,1,1,card,retail"]
    return out


@pytest.fixture
def feed(spark, tmp_path):
    spark.sql("CREATE DATABASE IF NOT EXISTS cw_feed")
    name = f"cw_feed.sales_{abs(hash(str(tmp_path)))}"
    (tmp_path / "in").mkdir()
    return Feed("sales_transactions", str(tmp_path / "in"), name, str(tmp_path / "store"), str(tmp_path / "ck"), buckets=3, files_per_batch=2)


def put(feed, number, rows):
    from pathlib import Path

    hidden = Path(feed.folder) / f"_{number}"
    hidden.write_text("\n".join([HEAD, *rows]) + "\n")
    hidden.rename(Path(feed.folder) / f"part-{number}.csv")


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def full(spark, feed):
    bronze = mark_rejects(read_bronze(spark, feed.folder, feed.table), feed.table)
    silver = to_silver(bronze, feed.table)
    return silver, rejects(bronze, feed.table)


def check(spark, feed):
    silver, refused = full(spark, feed)
    assert rows_of(spark.table(feed.target).select(*silver.columns)) == rows_of(silver)
    lineage = ["_ingested_at", "_source_file"]
    assert rows_of(rejected(spark, feed).drop(*lineage).distinct()) == rows_of(refused.drop(*lineage).distinct())


def test_any_order_and_twice(spark, feed):
    rng = random.Random(3)
    files = [lines(rng, 40) for _ in range(4)]
    order = [0, 1, 2, 3, 1, 0]
    rng.shuffle(order)
    for step, which in enumerate(order):
        put(feed, step, files[which])
        if step % 2:  # sometimes two files at a time
            load_new_files(spark, feed)
            check(spark, feed)
    again = load_new_files(spark, feed)
    put(feed, 99, rng.sample(files[2], len(files[2])))  # the same rows in another order
    assert again == 0 and load_new_files(spark, feed) == 0
    check(spark, feed)


def test_only_touched_partitions_are_rewritten(spark, feed):
    put(feed, 0, lines(random.Random(5), 80))
    load_new_files(spark, feed)
    where = lambda: {r["p"].rpartition("/")[0] for r in spark.table(feed.target).selectExpr("_metadata.file_path AS p").distinct().collect()}
    before = where()
    put(feed, 1, ["A,K3,2020-01-01,C0,P1,1,1,1.5,card,retail"])
    assert load_new_files(spark, feed) == 1
    after = where()
    assert len(before - after) == 1 == len(after - before)
    check(spark, feed)


def test_a_driver_lost_between_two_switches(spark, feed, monkeypatch):
    rng = random.Random(9)
    put(feed, 0, lines(rng, 60))
    load_new_files(spark, feed)
    put(feed, 1, lines(rng, 60))
    real, left = incremental._text, [5]

    def text(value):
        left[0] -= 1
        if left[0] < 0:
            raise RuntimeError("driver lost")
        return real(value)

    monkeypatch.setattr(incremental, "_text", text)
    with pytest.raises(Exception, match="driver lost"):
        load_new_files(spark, feed)
    monkeypatch.undo()
    assert load_new_files(spark, feed) > 2  # the same batch again
    check(spark, feed)


def test_files_without_good_rows_and_empty_ones(spark, feed):
    put(feed, 0, [])
    assert load_new_files(spark, feed) == 0 and spark.table(feed.target).count() == 0
    put(feed, 1, ["A,,2024-01-01,C0,P1,1,1,1,card,retail", "A,K1,2024-01-01,C0,P1,many,1,1,card,retail"])
    assert load_new_files(spark, feed) == 0
    check(spark, feed)


def test_a_hot_tenant_is_many_partitions(spark, feed):
    put(feed, 0, lines(random.Random(1), 300, tenants=("A",)))
    assert load_new_files(spark, feed) == feed.buckets
    check(spark, feed)
