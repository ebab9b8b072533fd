"""Whole-file repair: damaged files on disk against hand and brute-force results."""

import csv
import io
import random

import pytest

from mendframe.plans.repair import Limits, repair
from mendframe.sources import files as S
from mendframe.sources.sinks import read_manifest, write_manifest


def write(folder, **files):
    for name, data in files.items():
        stem, _, ext = name.rpartition("_")
        (folder / f"{stem}.{ext}").write_bytes(data if isinstance(data, bytes) else data.encode())
    return str(folder)


def by_name(result):
    names = {r["file"]: r["name"] for r in result.files.select("file", "name").collect()}
    out = {n: [] for n in names.values()}
    for r in result.rows.orderBy("file", "_row_id").collect():
        out[names[r["file"]]].append(r["cells"])
    return out


def reports(result):
    return {r["name"]: r for r in result.files.collect()}


def test_kinds_of_damage(spark, tmp_path):
    path = write(
        tmp_path,
        extra_csv='id,name,amount\n1,"ACME, Inc",100\n2,Widget,200,EXTRA\n',
        euro_csv="id;amount;description\n1;1.234,56;Invoice\n2;12,34;Refund\n3;(5,00);Chargeback\n4;7,50;Fee\n5;2.000,00;Invoice\n",
        preamble_csv="Report: Q1\nGenerated 2024\nid,name,amount\n1,a,5\n2,b,6\n3,c,7\n",
        multi_csv='key,text\na,"x\ny"\nb,"c ""q"" d\n\ne"\nc,"open\nto the end\n',
        dos_tsv=b"id\tname\r\n1\tAnn\r\n2\t Bob \r\n2\tBob\r\n",
        mac_csv=b"id,name\r1,Ann\r2,Bob\r",
        bom_csv=b"\xef\xbb\xbfid,name\n1,Ann\n",
        win_csv="name,note\ncafé,“x”\n".encode("cp1252"),
        latin_csv=b"name,note\n\x81,\xe9\n",
        nohead_csv="1000001,R17,01/02/2024\n1000002,E10,01/03/2024\n",
        blank_csv="id,name\n1,a\n\n2,b\n\n",
        binary_csv=b"a,b\n1,\x002\n",
        empty_csv=b"",
        sheet_xlsx="a,b\n1,2\n",
    )
    result = repair(spark, path, normalize_numbers=True)
    rows, info = by_name(result), reports(result)
    assert rows["extra.csv"] == [["1", "ACME, Inc", "100"], ["2", "Widget", "200"]]
    assert info["extra.csv"]["too_long"] == 1
    assert rows["euro.csv"] == [["1.0", "1234.56", "Invoice"], ["2.0", "12.34", "Refund"], ["3.0", "-5.0", "Chargeback"],
                                ["4.0", "7.5", "Fee"], ["5.0", "2000.0", "Invoice"]]
    assert info["euro.csv"]["delimiter"] == ";"
    assert rows["preamble.csv"] == [["1", "a", "5"], ["2", "b", "6"], ["3", "c", "7"]]
    assert info["preamble.csv"]["header"] == ["id", "name", "amount"]
    # header detection rewrites the file without its final newline
    assert rows["multi.csv"] == [["a", "x\ny"], ["b", 'c "q" d\n\ne'], ["c", "open\nto the end"]]
    m = info["multi.csv"]
    assert (m["physical_lines"], m["logical_lines"], m["stitched_records"], m["max_physical_per_record"]) == (9, 4, 3, 3)
    assert rows["dos.tsv"] == [["1", "Ann"], ["2", "Bob"]] and info["dos.tsv"]["has_cr"]
    assert rows["mac.csv"] == [["1", "Ann"], ["2", "Bob"]]
    assert rows["bom.csv"] == [["1", "Ann"]] and info["bom.csv"]["encoding"] == "utf-8-sig"
    assert info["bom.csv"]["header"] == ["id", "name"]
    assert rows["win.csv"] == [["café", "“x”"]] and info["win.csv"]["encoding"] == "cp1252"
    assert rows["latin.csv"] == [["\x81", "é"]] and info["latin.csv"]["encoding"] == "latin-1"
    assert info["nohead.csv"]["header"] == ["col_1", "col_2", "col_3"] and len(rows["nohead.csv"]) == 2
    assert rows["blank.csv"] == [["1", "a"], ["2", "b"]] and info["blank.csv"]["empty_rows"] == 2
    rejected = {r["name"]: r["reason"] for r in result.rejected.collect()}
    assert rejected == {"binary.csv": "binary", "empty.csv": "empty", "sheet.xlsx": "extension"}
    log = info["extra.csv"]["changelog"]
    assert log[0] == "Detected encoding: utf-8."
    assert "Fixed 1 rows with extra columns (import repair)." in log
    assert log[-1] == "Wrote output as UTF-8 with standard newlines using delimiter ','."
    assert "Fixed 1 rows with extra columns (import repair)." in info["extra.csv"]["repairs"]
    euro = next(r["file"] for r in result.files.collect() if r["name"] == "euro.csv")
    table = result.table(euro)
    assert dict(table.dtypes)["amount"] == "double"
    assert sum(r["amount"] for r in table.collect()) == pytest.approx(1234.56 + 12.34 - 5 + 7.5 + 2000)


def test_strict_compat_keeps_blank_row_and_adds_header(spark, tmp_path):
    path = write(tmp_path, blank_csv="id,name\n1,a\n\n2,b\n\n", title_csv="Name,Amount\nAlice,5")
    rows = by_name(repair(spark, path, strict_compat=True))
    assert rows["blank.csv"] == [["1", "a"], ["", ""], ["2", "b"]]
    assert rows["title.csv"] == [["Name", "Amount"], ["Alice", "5"]]
    assert by_name(repair(spark, path))["title.csv"] == [["Alice", "5"]]


def test_limits(spark, tmp_path):
    path = write(tmp_path, rows_csv="id,name\n1,a\n2,b\n3,c\n", cols_csv="a_x,b_x,c_x\n1,2,3\n", ok_csv="id,name\n1,a\n",
                 big_csv="id,name\n" + "1,aaaaaaaaaaaaaaaaaaaaa\n" * 9, open_csv='id,name\n1,a\n2,"' + "y" * 70 + "\n" + "z" * 50)
    result = repair(spark, path, limits=Limits(max_bytes=150, max_rows=2, max_cols=2, max_record_chars=60))
    assert {r["name"]: r["reason"] for r in result.rejected.collect()} == {
        "rows.csv": "too_many_rows", "cols.csv": "too_many_columns", "big.csv": "too_large", "open.csv": "record_too_long"}
    assert by_name(result) == {"ok.csv": [["1", "a"]]}


NEAR = ("id,date,name,amount,balance\n1,2024-01-01,Acme  Inc,5,10\n2,2024-01-02,acme inc,5,20\n"
        "1,2024-01-01,Acme  Inc,5,10\n3,2024-01-03,Beta,7,30\n")


@pytest.mark.parametrize("broadcast_ids", [0, 1_000_000])
def test_near_duplicates(spark, tmp_path, monkeypatch, broadcast_ids):
    monkeypatch.setattr("mendframe.plans.repair.BROADCAST_IDS", broadcast_ids)
    path = write(tmp_path, near_csv=NEAR, other_csv=NEAR, ids_csv="id,user_id\n1,1\n2,2\n")
    result = repair(spark, path, near_dupes="remove")
    rows = by_name(result)
    assert [r[0] for r in rows["near.csv"]] == ["1", "3"] and len(rows["ids.csv"]) == 2
    info = reports(result)
    assert info["near.csv"]["near_dupes"] == 1 and info["near.csv"]["rows"] == 2
    assert "Removed 1 near-duplicate rows." in info["near.csv"]["changelog"]
    assert "Near-duplicate rule: compare all columns except id, date, balance." in info["near.csv"]["changelog"]
    ex = result.examples.collect()
    assert len(ex) == 2 and ex[0]["kept"][2] == "Acme  Inc" and ex[0]["removed"][2] == "acme inc"
    preview = repair(spark, path, near_dupes="preview")
    assert len(by_name(preview)["near.csv"]) == 3
    assert "Dry run: 1 near-duplicate rows would be removed." in reports(preview)["near.csv"]["changelog"]


def test_output_and_manifest(spark, tmp_path):
    src, out, man = tmp_path / "in", tmp_path / "out", tmp_path / "manifest"
    src.mkdir()
    path = write(src, a_csv='Id,Name\n1,"x, y"\n2,"say ""hi"""\n', b_tsv="id\tname\n1\tz\n")
    result = repair(spark, path)
    result.write_delimited(str(out))
    texts = {}
    for d in out.iterdir():
        if d.is_dir():
            texts[d.name.split("-", 1)[1]] = "".join(p.read_text() for p in sorted(d.glob("part-*")))
    assert texts == {"a.csv": 'id,name\n1,"x, y"\n2,"say ""hi"""\n', "b.tsv": "id\tname\n1\tz\n"}
    write_manifest(result.manifest(), str(man))
    rows = {r["original_filename"]: r for r in read_manifest(spark, str(man)).collect()}
    assert rows["a.csv"]["rows"] == 2 and rows["a.csv"]["cols"] == 2 and rows["b.tsv"]["out_file"] == "cleaned.tsv"
    assert read_manifest(spark, str(man), "unknown").count() == 0
    a = next(r["file"] for r in result.files.collect() if r["name"] == "a.csv")
    assert b"\n".join(r["raw"] for r in S.original_lines(result.bronze, a).collect()) == b'Id,Name\n1,"x, y"\n2,"say ""hi"""'


@pytest.fixture
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def brute(text):
    rows = list(csv.reader(io.StringIO(text, newline="")))
    n, seen, out = len(rows[0]), set(), []
    for r in rows[1:]:
        cells = tuple(c.strip() for c in (r + [""] * n)[:n])
        if cells not in seen and any(cells):
            seen.add(cells)
            out.append(list(cells))
    return out


def test_blocks_match_csv_reader(spark, tmp_path, small_splits):
    """Records that cross input splits, for files of many splits."""
    rng = random.Random(1)
    texts = {}
    for k in range(4):
        lines = ["row_id,first_name,last_name"]
        for i in range(250):
            cells = [str(i)]
            for _ in range(rng.choice([2, 2, 2, 2, 1, 3])):
                body = "".join(rng.choice("abc ,\"\n") for _ in range(rng.randrange(8)))
                quoted = rng.random() < (0.5 if k % 2 else 0.1)
                cells.append('"' + body.replace('"', '""') + '"' if quoted else body.replace(",", "").replace("\n", "").replace('"', "'" if k < 2 else '"').lstrip('" '))
            lines.append(",".join(cells))
        lines += ['z,"' + "long\n" * 400 + '",end', "y,1,2"]
        if k == 3:
            lines += ['x,"never closed', "to,the", "end,here"]
        texts[f"f{k}.csv"] = "\n".join(lines)
        (tmp_path / f"f{k}.csv").write_text(texts[f"f{k}.csv"])
    result = repair(spark, str(tmp_path))
    assert result.bronze.select("blk").distinct().count() > 5
    rows = by_name(result)
    for name, text in texts.items():
        assert rows[name] == brute(text), name
    n = result.files.collect()
    for r in n:
        text = texts[r["name"]]
        logical, open_, longest, cur = 0, False, 1, 0
        for line in text.split("\n"):
            cur += 1
            open_ ^= line.count('"') % 2 == 1
            if not open_:
                logical, longest, cur = logical + 1, max(longest, cur), 0
        if cur:
            logical, longest = logical + 1, max(longest, cur)
        assert (r["physical_lines"], r["logical_lines"], r["max_physical_per_record"]) == (text.count("\n") + 1, logical, longest)


def test_cr_only_files_in_splits(spark, tmp_path, small_splits, monkeypatch):
    """No switch: CR files are found by their facts and read again in many blocks, BOM and last line end kept."""
    monkeypatch.setattr(S, "MAX_SEGMENT_BYTES", 1000)
    (tmp_path / "mac file.csv").write_bytes(b"row_id,full_name\r" + b"".join(b"%d,name %d\r" % (i, i) for i in range(300)))
    (tmp_path / "mac_bom.csv").write_bytes(b"\xef\xbb\xbfrow_id,full_name\r" + b"\r".join(b"%d,name %d" % (i, i) for i in range(200)))
    (tmp_path / "small_mac.csv").write_bytes(b"row_id,full_name\r1,a\r2,b\r")
    (tmp_path / "dos.csv").write_bytes(b"row_id,full_name\r\n" + b"".join(b'%d,"a\r\nb%d"\r\n' % (i, i) for i in range(100)))
    (tmp_path / "long.csv").write_bytes(b"row_id,full_name\n" + b"1," + b"x" * 3000 + b"\n" + b"".join(b"%d,n\n" % i for i in range(2, 200)))
    result = repair(spark, str(tmp_path))
    assert result.bronze.filter("file LIKE '%mac%20file.csv'").select("blk").distinct().count() > 1
    rows = by_name(result)
    assert rows["mac file.csv"] == [[str(i), f"name {i}"] for i in range(300)]
    assert rows["mac_bom.csv"] == [[str(i), f"name {i}"] for i in range(200)]
    assert rows["small_mac.csv"] == [["1", "a"], ["2", "b"]]
    assert rows["dos.csv"] == [[str(i), f"a\nb{i}"] for i in range(100)]
    assert rows["long.csv"] == [["1", "x" * 3000]] + [[str(i), "n"] for i in range(2, 200)]
    facts = {r["name"]: r for r in result.files.collect()}
    assert (facts["mac_bom.csv"]["bom"], facts["mac_bom.csv"]["ends_nl"], facts["mac file.csv"]["ends_nl"]) == (True, False, True)
    assert facts["mac file.csv"]["has_cr"] and not facts["long.csv"]["has_cr"]


def test_file_profile_equals_text_profile(spark, tmp_path):
    """Heads of files give the profile of the whole text, also far below line 60."""
    from mendframe.operators.profile import profile

    texts = {
        "deep.csv": "id;name\n" + "\n" * 80 + "x,y\n" * 200,
        "deeper.csv": "id;name\n" + "\n" * 17000 + "x,y\n" * 200,
        "wide.csv": "k,v\n" + ("a" * 20000 + ",b\n") * 3,
        "plain.csv": "some_id|some_name\n" + "1|x\n" * 100,
    }
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    got = reports(repair(spark, str(tmp_path)))
    df = spark.createDataFrame(list(texts.items()), "name string, text string")
    for r in profile(df).collect():
        assert (got[r["name"]]["delimiter"], got[r["name"]]["modal"], got[r["name"]]["header_ln"]) == (r["delimiter"], r["modal"], r["header_ln"])
    assert got["deep.csv"]["delimiter"] == "," and got["deeper.csv"]["delimiter"] == ";"


def test_a_million_blocks_need_no_shuffle_of_rows(spark):
    """Facts of 1,000,000 blocks are broadcast under short keys; only beyond that are rows exchanged."""
    from pyspark.sql import functions as F

    from mendframe.sources import files as S

    rows = spark.range(20).select(F.concat(F.lit("f"), F.col("id") % 3).alias("file"), (F.col("id") % 5).alias("blk"), F.lit("x").alias("raw"))
    facts = spark.range(1_000_000).select(F.concat(F.lit("f"), F.col("id") % 3).alias("file"), F.floor(F.col("id") / 3).alias("blk"), "id")
    joined = S.with_facts(rows, facts, 1_000_000)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan
    want = sorted(map(tuple, rows.join(facts, ["file", "blk"]).collect()))
    assert sorted(map(tuple, joined.select("file", "blk", "raw", "id").collect())) == want
    assert sorted(map(tuple, S.with_facts(rows, facts, 1_000_001).select("file", "blk", "raw", "id").collect())) == want


def test_result_view_examples_and_release(spark, tmp_path):
    path = write(tmp_path, near_csv=NEAR)
    result = repair(spark, path, near_dupes="remove")
    row = result.manifest().first()
    assert row.near_dupes_mode == "remove" and len(row.near_dupe_examples) == 1
    assert "Acme  Inc" in row.near_dupe_examples[0] and "acme inc" in row.near_dupe_examples[0]
    view = result.view(result.files.first()["file"])
    assert view.summary.first().encoding_label == "UTF-8" and view.first.count() == 2 and view.repaired.count() == 0
    result.release()


def test_read_back_of_nothing(spark, tmp_path):
    from mendframe.sources import sinks

    back = sinks.read_delimited(spark, str(tmp_path / "none"))
    assert back.columns == [] and back.count() == 0
    rows = spark.createDataFrame([("a", float("nan")), ("b", 3.0)], "job_id string, rows double")
    assert {r.job_id: r.rows for r in sinks.manifest_rows(rows).collect()} == {"a": None, "b": 3}


def test_one_file_is_written_without_a_sort(spark):
    """Rows that go to one file in order are sorted by several tasks before; the task that writes them sorts nothing."""
    from mendframe.plans import file_queries

    rows = [((i * 7919) % 1000, f"r{(i * 7919) % 1000}") for i in range(1000)] + [(None, "none"), (5, "r5")]
    df = spark.createDataFrame(rows, "k long, record string").repartition(5)
    got = file_queries._in_order(df, "k")
    assert got.columns == ["record"] and got.rdd.getNumPartitions() == 1
    assert "Sort" not in got._jdf.queryExecution().executedPlan().toString()
    assert [r.record for r in got.collect()] == [t for _, t in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0))]
