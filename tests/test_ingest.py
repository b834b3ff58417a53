"""Payroll CSV ingest on the literal edge rows (two files, CRLF, header mid-file)."""
from __future__ import annotations

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from conftest import FIXTURES
from wagelens.session import scratch_path
from wagelens.sources import silver as sv
from wagelens.sources.lines import PAIRWISE, lines_of_files, lines_of_texts, stitch
from wagelens.sources.payroll_csv import parse_records, read_payroll, read_payroll_lenient, split_valid

GLOB = str(FIXTURES / "20*-payroll.csv")


def by_name(df):
    return {r["employee_name"]: r for r in df.collect() if r["employee_name"] is not None}


@pytest.fixture(scope="module")
def parity(spark):
    return read_payroll(spark, GLOB, "quotes").cache()


@pytest.fixture(scope="module")
def pairwise(spark):
    return read_payroll(spark, GLOB, "pairwise").cache()


def test_cells_and_types(parity):
    rows = by_name(parity)
    doe = rows["Doe, Jane"]
    assert doe["job_title"] == "Clerk" and doe["other_pay"] is None and doe["notes"] == ""
    assert doe["total_pay_benefits"] == Decimal("110.50") and doe["year"] == 2011
    assert doe["reason"] is None
    assert rows["Multi"]["job_title"] == "LineTitle" and rows["Multi"]["n_lines"] == 2
    esc = rows["Esc"]
    assert esc["job_title"] == 'say "hi"' and esc["total_pay_benefits"] == Decimal("600.00")
    assert esc["notes"] == "" and esc["agency"] == "Fresno"
    assert rows["Eleven"]["status"] is None and rows["Eleven"]["reason"] is None
    assert rows["Thirteen"]["reason"] == "extra_cells" and rows["Thirteen"]["status"] == "FT"
    assert rows["Lower"]["base_pay"] is None and rows["Lower"]["reason"] == "not_numeric"
    assert rows["Three"]["job_title"] == "abc" and rows["Three"]["n_lines"] == 3
    assert rows["Huge"]["total_pay_benefits"] is None and rows["Huge"]["reason"] == "out_of_range"
    assert rows["NullPay"]["total_pay_benefits"] is None and rows["NullPay"]["reason"] is None


def test_marker_row(parity):
    row = [r for r in parity.collect() if r["job_title"] == "x" and r["year"] == 2012
           and r["employee_name"] is None][0]
    assert row["notes"] is None                      # quoted marker -> null
    assert row["base_pay"] == Decimal("0.50")        # .5
    assert row["overtime_pay"] is None               # 5. is text
    assert row["other_pay"] == Decimal("1.00")       # +1
    assert row["benefits"] == Decimal("-2.00")
    assert row["total_pay"] == Decimal("100000.00")  # 1e5
    assert row["reason"] == "not_numeric"


def test_headers_blank_lines_and_rejects(parity):
    rows = parity.collect()
    assert all(r["employee_name"] != "Employee Name" for r in rows)
    rejected = [r for r in rows if r["reason"] == "malformed_quote"]
    # "Bad"tail, and the unclosed quote: its own line only
    assert len(rejected) == 2
    assert sorted(r["n_lines"] for r in rejected) == [1, 1]
    assert "After" in {r["employee_name"] for r in rows}      # the record behind the unclosed quote


def test_pairwise_rule(pairwise):
    rows = by_name(pairwise)
    assert rows["Multi"]["job_title"] == "LineTitle"
    assert "After" in rows                      # the unclosed-quote line is rejected alone
    # a cell over three lines: first two lines glued and refused, third line stands alone
    glued = [r for r in pairwise.collect() if r["n_lines"] == 2 and r["reason"] == "malformed_quote"]
    assert len(glued) == 1
    assert 'c"' in rows


def test_split_invariance(spark):
    """Tiny input splits (many per file) give the same records as whole files."""
    base_p = read_payroll(spark, GLOB, "quotes").drop("file").collect()
    base_w = read_payroll(spark, GLOB, "pairwise").drop("file").collect()
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    try:
        lines = lines_of_files(spark, GLOB)
        assert lines.select("file", "blk").distinct().count() > 10
        small_p = read_payroll(spark, GLOB, "quotes").drop("file").collect()
        small_w = read_payroll(spark, GLOB, "pairwise").drop("file").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    key = lambda r: (r["line_no"], r["raw"])
    assert sorted(small_p, key=key) == sorted(base_p, key=key)
    assert sorted(small_w, key=key) == sorted(base_w, key=key)


ROW = "{n},{job},1,2,3,4,5,6,2011,n,Oak,FT\n"


def read_text(spark, tmp_path, text, name="2011-payroll.csv"):
    f = tmp_path / name
    f.write_text(text)
    return read_payroll(spark, str(f)).collect()


def test_stray_quote_in_an_unquoted_cell_is_text(spark, tmp_path):
    rows = read_text(spark, tmp_path, "".join(ROW.format(n=f"N{i}", job='5" pipe fitter' if i == 20 else "x") for i in range(50)))
    assert len(rows) == 50 and all(r["reason"] is None for r in rows)
    assert {r["job_title"] for r in rows} == {"x", '5" pipe fitter'}


@pytest.mark.parametrize("strays,job", [([5], "x"), ([5, 120], "x"), ([5], '"y, z"'), ([5, 120], '"y, z"')])
def test_unclosed_quote_costs_its_own_record_only(spark, tmp_path, strays, job):
    rows = read_text(spark, tmp_path, "".join(ROW.format(n=f"N{i}", job='"open' if i in strays else job) for i in range(200)))
    assert sorted(r["employee_name"] for r in rows if r["reason"] is None) == sorted(
        f"N{i}" for i in range(200) if i not in strays)
    assert [(r["reason"], r["n_lines"]) for r in rows if r["reason"]] == [("malformed_quote", 1)] * len(strays)


def test_a_cell_of_ten_thousand_lines(spark, tmp_path):
    cell = '"' + "\n".join(["line"] * 10_050) + '"'
    rows = read_text(spark, tmp_path, ROW.format(n="A", job="x") + ROW.format(n="B", job=cell) + ROW.format(n="C", job="x"))
    assert sorted((r["employee_name"], r["n_lines"], r["reason"]) for r in rows) == [
        ("A", 1, None), ("B", 10_050, None), ("C", 1, None)]


def test_pairwise_matches_sequential_rule(spark):
    """Window form of the pairwise rule equals a line-by-line simulation."""
    import random
    rnd = random.Random(7)
    texts = []
    for _ in range(40):
        lines = [",".join(["a"] * rnd.choice([1, 3, 11, 12])) for _ in range(rnd.randint(1, 15))]
        texts.append("\n".join(lines))

    def simulate(text):
        out, held, start = [], None, 0
        for i, line in enumerate(text.split("\n")):
            if held is not None:
                out.append((start, held + line))
                held = None
            elif len(line.split(",")) < 11:
                held, start = line, i
            else:
                out.append((i, line))
        if held is not None:
            out.append((start, held))
        return out

    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "file string, text string")
    got = stitch(lines_of_texts(df, "file", "text"), PAIRWISE, whole=True).collect()
    got = sorted((int(r["file"]), r["line_no"], r["raw"]) for r in got)
    want = sorted((i, s, raw) for i, t in enumerate(texts) for s, raw in simulate(t))
    assert got == want


def test_lenient_reader(spark):
    rows = by_name(read_payroll_lenient(spark, GLOB))
    assert rows["Multi"]["job_title"] == "LineTitle"
    assert rows["Doe, Jane"]["other_pay"] is None


def ingest(spark, table, *paths):
    from wagelens.plans.jobs import ingest_job
    for p in paths:
        ingest_job(spark, str(p), table)
    return sv.silver(spark, table)


def test_silver_roundtrip_prunes_years(spark):
    path = scratch_path(spark, "silver-test")
    silver = ingest(spark, path, GLOB)
    assert sv.quarantine(spark, path).count() == 2
    assert silver.where(F.col("year") == 2012).count() == 3
    plan = silver.where(F.col("year") == 2012).select("total_pay_benefits")._jdf \
        .queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "year" in plan


def test_long_quoted_cells(spark):
    """A 300 kB quoted cell with quotes and newlines parses in linear time."""
    body = ('word "" ' * 40000) + "\n" + ("tail, " * 2000)
    text = f'A,"{body}",1,2,3,4,5,6,2011,n,Oak,FT\n'
    df = spark.createDataFrame([("f", text)], "file string, text string")
    rows = parse_records(stitch(lines_of_texts(df, "file", "text"), whole=True)).collect()
    assert len(rows) == 1 and rows[0]["reason"] is None and rows[0]["n_cells"] == 12
    assert rows[0]["job_title"] == body.replace('""', '"').replace("\n", "")


def test_fail_mode_names_the_record(spark, tmp_path):
    f = tmp_path / "2016-payroll.csv"
    f.write_text('A,x,1,2,3,4,5,6,2016,n,Oak,FT\n"Bad"tail,x,1,2,3,4,5,6,2016,n,Oak,FT\n')
    assert len(read_payroll(spark, str(f)).collect()) == 2
    with pytest.raises(Exception, match="malformed_quote"):
        read_payroll(spark, str(f), on_error="fail").collect()
    good = tmp_path / "2017-payroll.csv"
    good.write_text("A,x,1,2,3,4,5,6,2017,n,Oak,FT\n")
    assert len(read_payroll(spark, str(good), on_error="fail").collect()) == 1


def _sequential_quotes(lines):
    """The rule line by line, with a small state machine on characters."""
    def walk(line, inside):
        """(inside after, failed) of one line."""
        i, n, start, first = 0, len(line), not inside, inside
        while i < n:
            c = line[i]
            if inside:
                if c == '"':
                    if line[i + 1:i + 2] == '"':
                        i += 1
                    else:
                        inside = False
                        if first and i + 1 < n and line[i + 1] != ",":
                            return False, True
                        first = False
            elif c == ",":
                start = True
            elif c == '"' and start:
                inside, start = True, False
            elif c != " ":
                start = False
            i += 1
        return inside, False

    out, held, inside = [], [], False
    for i, line in enumerate(lines):
        if inside:
            after, failed = walk(line, True)
            if not failed:
                held.append((i, line))
                if not after:
                    out.append((held[0][0], len(held), "".join(x for _, x in held)))
                    held = []
                inside = after
                continue
            out += [(k, 1, x) for k, x in held]          # the failed record's lines, one by one
            held = []
        inside, failed = walk(line, False)
        if inside:
            held = [(i, line)]
        else:
            out.append((i, 1, line))
    return out + [(k, 1, x) for k, x in held]


def _sequential_pairwise(lines):
    out, held = [], None
    for i, line in enumerate(lines):
        if held is not None:
            out.append((held[0], 2, held[1] + line))
            held = None
        elif len(line.split(",")) < 11:
            held = (i, line)
        else:
            out.append((i, 1, line))
    if held is not None:
        out.append((held[0], 1, held[1]))
    return out


@pytest.mark.parametrize("seed,eol", [(11, "\n"), (12, "\n"), (13, "\r\n")])
def test_random_files_tiny_splits_match_sequential_rules(spark, tmp_path, seed, eol):
    import random
    rnd = random.Random(seed)
    tokens = ["a", "b", ",", ",,,,,", '"', '""', " ", "x,y,z,w,v,u,t,s,r,q,p"]
    files = {}
    for k in range(3):
        lines = ["".join(rnd.choice(tokens) for _ in range(rnd.randint(0, 8)))
                 for _ in range(rnd.randint(30, 70))]
        path = tmp_path / f"f{k}.csv"
        path.write_bytes((eol.join(lines) + eol).encode("utf-8"))
        files[str(path)] = lines
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50")
    try:
        lines_df = lines_of_files(spark, str(tmp_path / "*.csv"))
        assert lines_df.select("file", "blk").distinct().count() > 6
        par = stitch(lines_df).collect()
        pw = stitch(lines_df, PAIRWISE).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)

    def by_file(rows):
        got = {}
        for r in rows:
            name = r["file"].replace("file://", "").replace("file:", "")
            got.setdefault(name, []).append((r["line_no"], r["n_lines"], r["raw"]))
        return {k: sorted(v) for k, v in got.items()}

    got_par, got_pw = by_file(par), by_file(pw)
    for name, lines in files.items():
        assert got_par[name] == sorted(_sequential_quotes(lines)), name
        assert got_pw[name] == sorted(_sequential_pairwise(lines)), name


def test_blank_and_space_lines_give_no_record(spark):
    text = "\n   \nA,x,1,2,3,4,5,6,2011,n,Oak,FT\n\t\n"
    df = spark.createDataFrame([("f", text)], "file string, text string")
    rows = parse_records(stitch(lines_of_texts(df, "file", "text"), whole=True)).collect()
    assert [r["employee_name"] for r in rows] == ["A"]


@pytest.mark.parametrize("mode", ["quotes", "pairwise"])
def test_unclosed_quote_at_end_of_file(spark, tmp_path, mode):
    f = tmp_path / "2018-payroll.csv"
    f.write_text('A,x,1,2,3,4,5,6,2018,n,Oak,FT\nB,"never closed,1,2,3,4,5,6,2018,n,Oak,FT\n')
    rows = read_payroll(spark, str(f), mode).collect()
    assert [r["employee_name"] for r in rows if r["reason"] is None] == ["A"]
    assert [r["reason"] for r in rows if r["employee_name"] is None] == ["malformed_quote"]


def test_lenient_and_strict_readers_agree_on_well_formed_records(spark):
    """Rendered orders (multi-line job cells, quoted commas): both readers give the same cells."""
    from conftest import SF_SMALL
    from wagelens.sources import delimited as dl
    from wagelens.sources import tables as tb
    path = scratch_path(spark, "lenient-vs-strict")
    dl.write_lines(tb.orders_as_payroll_lines(spark, SF_SMALL), "value", path)
    cols = ["employee_name", "job_title", "total_pay_benefits", "year", "agency", "notes"]
    strict = read_payroll(spark, path).where("ok").select(*cols)
    # the lenient reader has no strictness: it also accepts the malformed '"Bad"...' names
    lenient = read_payroll_lenient(spark, path).where(~F.col("employee_name").startswith('"Bad"')) \
        .select(*cols)
    assert strict.count() > 1000
    assert sorted(strict.collect()) == sorted(lenient.collect())


def test_bytes_that_are_no_utf8_and_replacement_characters(spark, tmp_path):
    """Invalid bytes become U+FFFD when the cells are parsed; a U+FFFD of the file is kept."""
    f = tmp_path / "2019-payroll.csv"
    f.write_bytes(b"Jos\xffe,x,1,2,3,4,5,6,2019,n,Caf\xc3\xa9,FT\n" + "A\ufffdB,x,1,2,3,4,5,6,2019,n,Oak,FT\n".encode())
    rows = read_payroll(spark, str(f)).collect()
    assert [(r["employee_name"], r["agency"]) for r in rows] == [("Jos\ufffde", "Café"), ("A\ufffdB", "Oak")]


def test_strict_check_matches_python_csv_strict(spark):
    """strict_ok agrees with Python's csv reader (strict, skipinitialspace) on random records."""
    import csv
    import random
    from wagelens.functions.cells import strict_ok
    rnd = random.Random(5)
    alphabet = ["a", "b", ",", '"', " ", '""']
    samples = sorted({"".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 10))) for _ in range(6000)})

    def python_ok(s):
        try:
            rows = list(csv.reader([s], strict=True, skipinitialspace=True, quotechar='"', delimiter=","))
        except csv.Error:
            return False
        return len(rows) == 1

    df = spark.createDataFrame([(s,) for s in samples], "raw string")
    got = {r["raw"]: r["ok"] for r in df.select("raw", strict_ok(F.col("raw")).alias("ok")).collect()}
    wrong = [s for s in samples if got[s] != python_ok(s)]
    assert len(samples) > 3000 and not wrong, wrong[:10]


def test_cell_kind_matches_python_rule(spark):
    import random
    import re as pyre
    from wagelens.functions.cells import cell_kind
    from wagelens.schema import NULL_MARKER, NUMBER_PATTERN
    rnd = random.Random(9)
    parts = ["1", "2", "0", ".", "e", "E", "+", "-", "a", " ", "$", ","]
    samples = sorted({"".join(rnd.choice(parts) for _ in range(rnd.randint(0, 6))) for _ in range(4000)}
                     | {NULL_MARKER, "not provided", "5.", ".5", "1e5", "+1", "-2", "6e2", "1.005"})

    def python_kind(s):
        if pyre.match(NUMBER_PATTERN, s) is None:
            return "null" if s == NULL_MARKER else "text"
        return "float" if "." in s else "int"

    df = spark.createDataFrame([(s,) for s in samples], "cell string")
    got = {r["cell"]: r["kind"] for r in df.select("cell", cell_kind(F.col("cell")).alias("kind")).collect()}
    wrong = [s for s in samples if got[s] != python_kind(s)]
    assert not wrong, wrong[:10]


def names(df):
    return sorted(r["employee_name"] for r in df.collect())


def test_a_file_read_again_replaces_its_own_rows_only(spark, tmp_path):
    """Stray year, null year, equal base names, a repaired file, all by further ingests."""
    row = "{},x,1,2,3,4,5,6,{},n,Oak,FT\n"
    for d in ("x", "y z"):
        (tmp_path / d).mkdir()
    x, y = tmp_path / "x" / "part-0.csv", tmp_path / "y z" / "part-0.csv"
    x.write_text(row.format("A", 2011) + row.format("B", 2011) + row.format("N", "none") + '"Bad"1,x\n')
    y.write_text(row.format("C", 2012) + row.format("D", 2011) + row.format("M", "none") + '"Bad"2,x\n"Bad"3,x\n')
    table = scratch_path(spark, "table")
    silver = ingest(spark, table, x, y)
    assert names(silver) == ["A", "B", "C", "D", "M", "N"]
    assert names(silver.where("year = 2011")) == ["A", "B", "D"] and names(silver.where("year IS NULL")) == ["M", "N"]
    assert sv.quarantine(spark, table).count() == 3
    assert names(ingest(spark, table, y)) == ["A", "B", "C", "D", "M", "N"]          # again: the same
    y.write_text(row.format("C", 2012))                                             # repaired
    silver = ingest(spark, table, y)
    assert names(silver) == ["A", "B", "C", "N"]
    bad = sv.quarantine(spark, table).collect()
    assert [r["raw"] for r in bad] == ['"Bad"1,x']
    told = {r["reason"]: r["n"] for r in sv.summary(spark, table).collect()}
    assert told == {None: 3, "not_numeric": 1, "malformed_quote": 1}
    x.write_text("")                                                                # emptied
    assert names(ingest(spark, table, x)) == ["C"] and sv.quarantine(spark, table).count() == 0


def test_batch_and_stream_read_the_same_lines(spark, tmp_path):
    from wagelens.streaming.ingest import start_payroll_ingest
    landing = tmp_path / "landing"
    landing.mkdir()
    (landing / "a.csv").write_bytes("\ufeffA\ufffdB,x,1,2,3,4,5,6,2011,n,Oak,FT\nC,\"y\nz\",1,2,3,4,5,6,2012,n,Oak,FT\n".encode())
    one, two = scratch_path(spark, "batch"), scratch_path(spark, "stream")
    start_payroll_ingest(spark, str(landing), two, scratch_path(spark, "ck")).awaitTermination(300)
    columns = ["employee_name", "job_title", "year", "line_no", "n_lines", "file"]
    assert ingest(spark, one, landing).select(columns).collect() == sv.silver(spark, two).select(columns).collect()


def test_tsv_writer_format(spark, tmp_path):
    import glob
    from wagelens.sources.delimited import write_tsv
    df = spark.createDataFrame([("a\tb", 'x"y', 1, " lead")], "c1 string, c2 string, c3 int, c4 string")
    out = str(tmp_path / "tsv")
    write_tsv(df.coalesce(1), out)
    text = "".join(open(f, encoding="utf-8").read() for f in glob.glob(out + "/part-*"))
    assert text == '"a\tb"\t"x""y"\t"1"\t" lead"\n'


def test_tsv_keeps_every_cell(spark, tmp_path):
    from pyspark.sql import types as T
    from wagelens.sources.delimited import read_tsv, write_tsv
    rows = [(1, None, ""), (2, "", None), (3, "a\r\nb", "a\rb"), (4, "a\nb", '"'), (5, '"a"\t"', " x "), (6, "\\N", ","),
            (None, "\n", "\r\n"), (8, "x\n\ny", 'q"\n"q')]
    schema = T.StructType([T.StructField("k", T.LongType()), T.StructField("a", T.StringType()), T.StructField("b", T.StringType())])
    df = spark.createDataFrame(rows, schema)
    write_tsv(df.coalesce(1), str(tmp_path / "t"))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in (old, "9"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            got = read_tsv(spark, str(tmp_path / "t"), schema).collect()
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        assert sorted(map(repr, got)) == sorted(map(repr, df.collect()))


def test_year_cell_must_be_integral(spark):
    text = ("A,x,1,2,3,4,5,6,2011.0,n,Oak,FT\nB,x,1,2,3,4,5,6,2011.7,n,Oak,FT\n"
            "C,x,1,2,3,4,5,6,2e3,n,Oak,FT\nD,x,1,2,3,4,5,6,1e30,n,Oak,FT\n")
    df = spark.createDataFrame([("f", text)], "file string, text string")
    rows = {r["employee_name"]: r for r in parse_records(stitch(lines_of_texts(df, "file", "text"), whole=True)).collect()}
    assert rows["A"]["year"] == 2011 and rows["A"]["reason"] is None
    assert rows["B"]["year"] is None and rows["B"]["reason"] == "out_of_range"
    assert rows["C"]["year"] == 2000
    assert rows["D"]["year"] is None and rows["D"]["reason"] == "out_of_range"
