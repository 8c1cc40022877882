from __future__ import annotations

import csv
import json
import random

import pytest
from pyspark.sql import functions as F

from shopmetrics.operators.clean import dedup_raw
from shopmetrics.operators.normalize import normalize_marketplace, normalize_primary
from shopmetrics.plans.pipelines import build_products, build_scored
from shopmetrics.sources import csv_records, listings, staging, tables


def landed(tmp_path, page, data):
    folder = tmp_path / "category=8322" / f"page={page}"
    folder.mkdir(parents=True)
    (folder / "response.json").write_text(json.dumps({"data": data}, ensure_ascii=False))


def test_pages_keep_arrival_order(spark, tmp_path):
    landed(tmp_path, 2, [{"id": 1, "name": "second", "price": 5, "quantity_sold": {"value": 3}}])
    landed(tmp_path, 10, [{"id": 1, "name": "third", "price": 6.5}])
    landed(tmp_path, 1, [{"id": 7, "name": "Tên", "price": "8", "quantity_sold": "Đã bán 4"}, {"id": 1, "name": "first"}])
    landed(tmp_path, 3, [])
    df = listings.read_listing_pages(spark, str(tmp_path))
    assert df.count() == 4
    kept = {r.id: r.name for r in dedup_raw(df).collect()}
    assert kept == {"1": "first", "7": "Tên"}
    units = {r.product_name: r.units_sold for r in normalize_primary(df).collect()}
    assert units == {"first": 0, "second": 3, "third": 0, "Tên": 4}


def test_pages_one_per_line(spark, tmp_path):
    lines = [{"data": [{"id": i, "name": f"n{i}", "seller": "s"}]} for i in range(3)]
    (tmp_path / "pages.json").write_text("\n".join(map(json.dumps, lines)))
    df = listings.read_listing_pages(spark, str(tmp_path), one_per_line=True, fields=["id", "name", "seller"])
    assert {r.shop for r in normalize_primary(df).collect()} == {"s"}


def test_contract(spark):
    df = spark.createDataFrame([("1", None, 3.0)], "id string, name string, price double")
    assert tuple(listings.check_source_contract(df).first()) == (1, 0, 1, 0, "", True)
    row = listings.check_source_contract(df.drop("price", "id")).first()
    assert (row.missing, row.ok, row.null_id) == ("id,price", False, None)
    assert not listings.check_source_contract(df.limit(0)).first().ok


def test_csv_order_and_quotes(spark, tmp_path):
    (tmp_path / "m.csv").write_text(
        '﻿id,name,price,slug\n1,"Áo ""đẹp""\nmới","1,200đ",ao\n1,later,5,x\n2,b,,\n', encoding="utf-8"
    )
    df = listings.read_marketplace_csv(spark, str(tmp_path / "m.csv"))
    kept = {r.id: r.name for r in dedup_raw(df).collect()}
    assert kept == {"1": 'Áo "đẹp"\nmới', "2": "b"}
    prices = sorted(r.price for r in normalize_marketplace(df).collect())
    assert prices == [0.0, 5.0, 1200.0]


def spark_rows(spark, path):
    """What Spark's own reader gets in one task a file, in order."""
    reader = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"')
    return [tuple(r) for r in reader.csv(path).collect()]


def split_rows(spark, path, most_bytes):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", most_bytes)
    spark.conf.set("spark.sql.files.openCostInBytes", 0)
    try:
        df = listings.read_text_csv(spark, path)
        rows = df.orderBy("arrival").collect()
        return [tuple(r)[:-1] for r in rows], len({r.arrival.block for r in rows})
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])


def test_quoted_line_breaks_in_many_blocks(spark, tmp_path):
    """Blocks that begin inside quotes, long records over several blocks, doubled quotes, blank lines."""
    rng = random.Random(5)
    pieces = ["a", "b c", '"quoted"', "line\nbreak", '"\n"', "", "\n\n", "x,y", "Áo", "long " * 40, '""', " "]
    path = tmp_path / "many.csv"
    with path.open("w", encoding="utf-8", newline="") as file:
        file.write("\ufeff")
        writer = csv.writer(file, lineterminator="\n")
        writer.writerow(["id", "na me", "note\nof two lines"])
        for i in range(400):
            writer.writerow([i, "".join(rng.choices(pieces, k=3)), rng.choice(pieces)])
            if i % 50 == 0:
                file.write("\n")
    want = spark_rows(spark, str(path))
    for size in (64, 700, 5000):
        rows, blocks = split_rows(spark, str(path), size)
        assert rows == want and len(rows) == 400
        assert blocks > path.stat().st_size / size / 4
    assert listings.read_text_csv(spark, str(path)).columns[:2] == ["id", "na me"]


def test_windows_line_ends_and_open_quotes(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b'id,name\r\n1,"two\r\nlines"\r\n2,b\r\n')
    assert split_rows(spark, str(tmp_path / "a.csv"), 5)[0] == [("1", "two\r\nlines"), ("2", "b")]
    (tmp_path / "b.csv").write_text('id,name\n1,a\n2,"never closed\n3,c\n')
    rows, _ = split_rows(spark, str(tmp_path / "b.csv"), 6)
    assert rows[0] == ("1", "a") and len(rows) == 2 and rows[1][0] == "2"


def test_lines_stay_where_they_are(spark, tmp_path):
    """The table of blocks goes to the lines, however large these are."""
    (tmp_path / "a.csv").write_text('id,name\n1,"a\nb"\n2,c\n')
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        records = csv_records.numbered_records(spark, str(tmp_path / "a.csv"))
        plan = records._jdf.queryExecution().sparkPlan().toString()
        assert records.count() == 3
    finally:
        spark.conf.set(name, before)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_folder_of_files(spark, tmp_path):
    """Each file has a header; rows keep the order of files and lines."""
    for i in range(3):
        (tmp_path / f"part-{i}.csv").write_text("id,name\n" + "".join(f'{i}{j},"n\n{j}"\n' for j in range(20)))
    (tmp_path / "part-3.csv").write_text("id,name\n")
    rows, _ = split_rows(spark, str(tmp_path), 50)
    assert rows == [(f"{i}{j}", f"n\n{j}") for i in range(3) for j in range(20)]


def test_raw_round_trip(spark, tmp_path):
    df = spark.createDataFrame(
        [("1", 'a "b", c', 2.5, (4,), 0)],
        "id string, name string, price double, quantity_sold struct<value:int>, arrival int",
    )
    csv_path, json_path = str(tmp_path / "c"), str(tmp_path / "j")
    assert tables.write_raw(df, csv_path, json_path)
    row = normalize_primary(listings.read_raw_csv(spark, csv_path)).first()
    assert (row.product_name, row.price, row.units_sold) == ('a "b", c', 2.5, 4)
    assert spark.read.json(json_path).first().quantity_sold.value == 4
    assert not tables.write_raw(df.limit(0), str(tmp_path / "e"), str(tmp_path / "f"))
    assert not (tmp_path / "e").exists()


def test_json_files_are_small(spark, tmp_path, monkeypatch):
    """Compressed, and cut into files that a task can read."""
    monkeypatch.setitem(tables.JSON_OPTIONS, "maxRecordsPerFile", 100)
    df = spark.range(250).select(F.col("id").cast("string"), F.lit("same name").alias("name")).coalesce(1)
    path = tmp_path / "j"
    tables.write_raw(df, str(tmp_path / "c"), str(path))
    files = [f for f in path.iterdir() if f.name.endswith(".json.gz")]
    assert len(files) == 3
    assert sum(f.stat().st_size for f in files) < 250 * 10
    assert spark.read.json(str(path)).distinct().count() == 250


def test_product_table_is_replaced(spark, products, tmp_path):
    path = str(tmp_path / "p")
    tables.write_products(products([{}, {}]), path)
    tables.write_products(products([{"price_outlier": True}]), path)
    back = tables.read_products(spark, path)
    assert back.count() == 1 and back.first().price_outlier is True
    assert dict(back.dtypes)["price_outlier"] == "boolean"
    products([{}]).drop("price").write.parquet(str(tmp_path / "bad"))
    with pytest.raises(ValueError):
        tables.read_products(spark, str(tmp_path / "bad"))


def test_failed_replacement_keeps_the_table(spark, products, tmp_path):
    path = str(tmp_path / "p")
    tables.write_products(products([{}, {}]), path)
    reader = tables.read_products(spark, path)
    broken = products([{"price": float(i)} for i in range(9)]).withColumn(
        "price", F.when(F.col("price") > 7, F.raise_error(F.lit("lost")).cast("double")).otherwise(F.col("price"))
    )
    with pytest.raises(Exception, match="lost"):
        tables.write_products(broken, path)
    assert tables.read_products(spark, path).count() == 2 and reader.count() == 2
    tables.write_products(tables.read_products(spark, path).union(products([{"price": 5.0}])), path)
    assert tables.read_products(spark, path).count() == 3
    assert reader.count() == 2  # begun before the replacement
    assert tables.read_products(spark, path, back=1).count() == 2


def test_versions_are_dropped(spark, products, tmp_path):
    path = tmp_path / "p"
    for n in range(1, 5):
        tables.write_products(products([{}] * n), str(path), keep=2)
    assert len(list((path / "snapshots").iterdir())) == 2
    assert [tables.read_products(spark, str(path), back=b).count() for b in (0, 1)] == [4, 3]
    with pytest.raises(ValueError):
        tables.read_products(spark, str(path), back=2)


def test_outlier_file_only_when_needed(products, tmp_path):
    assert not tables.write_outliers(products([{}]), str(tmp_path / "none"))
    assert not (tmp_path / "none").exists()
    assert tables.write_outliers(products([{}, {"price_outlier": True}]), str(tmp_path / "some"))


def test_quality_report(spark, products, tmp_path):
    path = str(tmp_path / "q")
    tables.write_quality_report(products([{"shop": "x"}, {"shop": "y", "price": 300.0}]), path)
    rows = spark.read.csv(path, header=True).collect()
    got = {(int(r.section), r.metric): float(r.value) for r in rows}
    assert got[1, "n_products"] == 2 and got[2, "price_median"] == 200.0
    assert got[6, "x"] == 1 and got[7, "A %"] == 100.0
    assert {s for s, _ in got} == set(range(1, 8))


def test_flow_from_products_to_scores(products):
    rows = [{"price": float(10 + 40 * (i % 3)), "rating": float(i % 5), "units_sold": i} for i in range(60)]
    table = build_products(products(rows).drop("price_outlier"))
    scored = build_scored(table, k=3)
    assert scored.count() == 60
    assert scored.select("segment", "segment_name").distinct().count() == 3


def test_staging_needs_a_shared_folder(spark):
    assert staging.new_path(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))


def test_only_blocks_with_open_values_are_gathered(spark, tmp_path):
    """Other blocks aren't numbered twice; one row a block tells which they are."""
    lines = [f'{i},"n ""{i}"""' for i in range(60)]
    lines[30] = '30,"n\n\n30"'
    (tmp_path / "a.csv").write_text("id,name\n" + "\n".join(lines) + "\n")
    (tmp_path / "b.csv").write_text("id,name\n" + "\n".join(f"{i},n" for i in range(60)) + "\n")
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(name) for name in names]
    for name, value in zip(names, ("120", "0")):
        spark.conf.set(name, value)
    try:
        blocks = csv_records._blocks(csv_records._text(spark, str(tmp_path))).collect()
        records = csv_records.numbered_records(spark, str(tmp_path))
        found = {(r.file[-5:], r.record): r.text for r in records.collect()}
        plan = records._jdf.queryExecution().sparkPlan().toString()
    finally:
        for name, value in zip(names, before):
            spark.conf.set(name, value)
    broken = [b for b in blocks if b.spans or b.open_before]
    assert len(blocks) == len({(b.file, b.block) for b in blocks}) > 8 and 1 <= len(broken) <= 3
    assert all(b.file.endswith("a.csv") for b in broken)
    assert len(found) == 122 and found["a.csv", 32] == '30,"n\n\n30"'
    assert plan.count("LeftSemi") == 1
