"""Mapping, assurance, comprehension and knowledge store, on small fixtures of our own."""

import subprocess
import sys
from datetime import date

import pytest
from pyspark.sql import functions as F

from tieout.functions import text as T
from tieout.legacy import graph, programs
from tieout.operators import assure as A
from tieout.operators import codegen, match, profile, relate
from tieout.operators import conformance as C
from tieout.plans import checks as K
from tieout.plans import transforms as X
from tieout.sources import csv as files


@pytest.fixture(scope="module")
def policies(spark):
    data = []
    for i in range(60):
        stat = "CL" if i % 8 == 0 else "LA" if i % 6 == 0 else "IF"
        data.append((f"{i + 1000000:010d}", stat, f"201902{i % 28 + 1:02d}" if stat == "CL" else "00000000", "MAT" if stat == "CL" else None, "P12" if i % 4 == 0 else None, f"{100 + i}.50", "M", "2000" + f"{i % 12 + 1:02d}01", "", f"SURNAME{i}, ANN", "  pad " if i == 3 else "x"))
    cols = "POLNO STATCD EXITDT EXITRSN SCHNO PREMAMT PREMFRQ COMMDT XA08 MBRNAME NOTE".split()
    return spark.createDataFrame(data, ", ".join(f"{c} string" for c in cols)).cache()


SOURCES = [
    match.SourceColumn("POLNO", "Policy Number", "IDENTIFIER", aliases=("Policy Reference",)),
    match.SourceColumn("STATCD", "Policy Status", "CATEGORICAL_CODE", decode=(("IF", "In Force"), ("LA", "Lapsed"), ("CL", "Closed"))),
    match.SourceColumn("EXITDT", "Exit Date", "DATE_YYYYMMDD"),
    match.SourceColumn("EXITRSN", "Exit Reason", "CATEGORICAL_CODE", decode=(("MAT", "Maturity"), ("DTH", "Death Claim"))),
    match.SourceColumn("PREMAMT", "Premium Amount", "DECIMAL", aliases=("Annual Premium",)),
    match.SourceColumn("PREMFRQ", "Premium Frequency", "CATEGORICAL_CODE", decode=(("M", "Monthly"), ("A", "Annual"))),
    match.SourceColumn("COMMDT", "Commencement Date", "DATE_YYYYMMDD"),
]
TARGETS = [
    match.Target("policy_reference", nullable=False),
    match.Target("policy_status", "enum", allowed=("IN_FORCE", "LAPSED", "CLOSED"), nullable=False),
    match.Target("exit_date", "date"),
    match.Target("exit_reason", "enum", allowed=("MATURITY", "DEATH")),
    match.Target("annual_premium", "decimal", nullable=False),
    match.Target("commencement_date", "date", nullable=False),
    match.Target("tax_file_number", "string"),
    match.Target("source_system", "string", nullable=False),
]


@pytest.fixture(scope="module")
def mapped(policies):
    return match.map_all(policies, SOURCES, TARGETS)


# ------------------------------------------------------------ profile


def test_profile_types_roles_and_keys(policies):
    p = {r.colname: r for r in profile.profile(policies).collect()}
    assert (p["POLNO"].inferred_type, p["XA08"].inferred_type, p["EXITDT"].inferred_type, p["PREMAMT"].inferred_type, p["STATCD"].inferred_type) == ("IDENTIFIER", "EMPTY", "DATE_YYYYMMDD", "DECIMAL", "CATEGORICAL_CODE")
    assert p["EXITDT"].role == "date (conditionally populated)" and p["PREMFRQ"].role == "constant"
    assert A.candidate_keys(policies)[0] == "POLNO"


def test_dependencies_and_copopulation(policies):
    d = {r.dependent: (r.driver, r.driver_values, r.support, r.confidence) for r in profile.dependencies(policies).collect()}
    assert d["EXITDT"] == ("STATCD", "CL", 8, 1.0)
    assert [tuple(r) for r in profile.copopulated(policies, ["EXITDT", "EXITRSN", "SCHNO"]).collect()] == [("EXITDT", "EXITRSN")]


def test_empty_table_profiles_to_nothing(spark, policies):
    none = policies.limit(0)
    assert profile.profile(none).count() == 0 and profile.copopulated(none).count() == 0


def test_findings_and_personal_data(policies):
    f = {r.colname: r for r in profile.findings(policies).collect()}
    assert f["NOTE"].whitespace and f["NOTE"].severity == "minor" and f["POLNO"].severity == "ok"
    assert profile.personal_data(policies, ["MBRNAME", "POLNO"]).count() == 0  # digits in the surnames


# ----------------------------------------------------------- relation


def test_edges_primary_plan_and_workset(spark, policies):
    schemes = spark.createDataFrame([("P12  ", "Acme", "A"), ("P13", "Bolt", "C")], "SCHREF string, NAME string, STATCD string")
    data = spark.createDataFrame([(f"{i}", "P12" if i % 2 else "P13") for i in range(40)], "POLNO string, SCHNO string")
    tabs = {"sch": schemes, "pol": data}
    found = relate.discover(tabs, {"sch": ["SCHREF", "NAME"], "pol": ["POLNO", "SCHNO"]})
    assert [(e.left_column, e.right_column, e.cardinality, e.kind) for e in found] == [("SCHNO", "SCHREF", "N:1", "join_key")]
    assert relate.primary({"sch": 2, "pol": 40}, found) == "pol"
    steps, out = relate.join_plan("pol", ["sch", "pol"], found)
    w = relate.workset({"pol": data.withColumn("STATCD", F.lit("IF")), "sch": schemes}, "pol", steps)
    assert not out and w.count() == 40 and w.columns == ["POLNO", "SCHNO", "STATCD", "SCHREF", "NAME", "sch_STATCD"]
    refused, why = relate.join_plan("sch", ["sch", "pol"], found)
    assert not refused and "aggregation" in why["pol"]


def test_workset_refuses_a_repeating_key(spark):
    a, b = spark.createDataFrame([("1",)], "k string"), spark.createDataFrame([("1", 1), ("1 ", 2)], "k string, v int")
    with pytest.raises(ValueError, match="repeats"):
        relate.workset({"a": a, "b": b}, "a", [relate.Step("a", "k", "b", "k")])


# ----------------------------------------------------------- mapping


def test_mapping_finds_what_names_types_and_values_say(mapped):
    m = {x.target: x for x in mapped}
    assert m["policy_reference"].sources == ("POLNO",) and m["policy_reference"].gate == "auto_accept"
    assert m["policy_status"].transform == X.EnumDecode("STATCD", (("IF", "IN_FORCE"), ("LA", "LAPSED"), ("CL", "CLOSED")))
    assert m["exit_reason"].unmapped_codes == ("DTH",) and m["exit_reason"].gate != "auto_accept"
    assert isinstance(m["annual_premium"].transform, X.Annualise)
    assert m["tax_file_number"].transform is None and m["source_system"].transform is None
    assert [x.target for x in mapped] == [t.name for t in TARGETS]


def test_a_copy_never_satisfies_another_unit(policies):
    src = [match.SourceColumn("PREMAMT", "Premium Pence", "DECIMAL", description="premium in pence")]
    t = match.Target("premium_pounds", "decimal", "premium in pounds")
    m = match.map_all(policies, src, [t])[0]
    assert m.gap.startswith("unit") and m.gate != "auto_accept" and m.confidence <= match.GAP_CAP


def test_one_column_feeds_one_target():
    s = [match.SourceColumn("A", "Scheme Name"), match.SourceColumn("B", "Other")]
    t = {n: match.Target(n) for n in ("scheme_name", "scheme_title")}
    maps = [match.Mapping("scheme_name", ("A",), X.Copy("A"), 0.9, 1.0, 0.95, "auto_accept"), match.Mapping("scheme_title", ("A",), X.Copy("A"), 0.6, 1.0, 0.8, "review")]
    out = {m.target: m for m in match.settle(maps, t, s)}
    assert out["scheme_name"].gate == "auto_accept" and out["scheme_title"].transform is None


def test_proposals_are_tested_and_never_accepted_outright(policies, mapped):
    now = next(m for m in mapped if m.target == "exit_date")
    for sql, reads in (("drop table x", ("POLNO",)), ("NOPE + 1", ("POLNO",)), ("`X`", ("X",)), ("CAST(NULL AS STRING)", ("EXITDT",))):
        kept, why = match.accept_proposal(policies, now, sql, reads)
        assert kept is now and why
    better, why = match.accept_proposal(policies, now, "try_to_date(EXITDT, 'yyyyMMdd')", ("EXITDT",))
    assert not why and better.gate == "review"


@pytest.mark.parametrize(("value", "want"), [("20240229", date(2024, 2, 29)), ("20230229", None), ("00000000", None), ("1986021", None), (None, None)])
def test_dates(spark, value, want):
    assert spark.createDataFrame([(value,)], "d string").select(X.DateYmd("d").column_of()).first()[0] == want


@pytest.mark.parametrize(("parts", "want"), [(("2020", "02", "29"), date(2020, 2, 29)), (("2020", "0", None), date(2020, 1, 1)), (("2020", "13", "1"), None), (("2021", "2", "30"), None), ((None, "1", "1"), None), (("0", "1", "1"), None)])
def test_split_dates(spark, parts, want):
    df = spark.createDataFrame([parts], "y string, m string, d string")
    assert df.select(X.SplitDate("y", "m", "d").column_of()).first()[0] == want


def test_numbers_are_stricter_than_a_cast(spark):
    df = spark.createDataFrame([("1d",), ("NaN",), (" 1.5 ",), ("1e3",), ("",), (None,), ("1_000",)], "v string")
    assert [r[0] for r in df.select(X.Numeric("v").column_of()).collect()] == [None, None, 1.5, 1000.0, None, None, None]


def test_literals_with_quotes_and_odd_names(spark):
    df = spark.createDataFrame([("o'b",)], "`we``ird col` string")
    t = X.EnumDecode("we`ird col", (("o'b", "it's"),))
    assert df.select(t.column_of().alias("v")).first()[0] == "it's"
    assert A.decode_pairs("CASE c WHEN 'o''b' THEN 'it''s' END") == {"o'b": "it's"}


def test_nondeterministic_expressions_are_seen():
    assert X.nondeterministic("Current_Timestamp ()") and X.nondeterministic("uuid()") and not X.nondeterministic("trim(a)")


def test_doubles_are_delivered_without_exponents(spark):
    df = spark.createDataFrame([(1e7,), (1e-4,), (0.1,), (123456789012.0,)], "v double")
    assert [r[0] for r in df.select(T.canonical_text(F.col("v"), "double")).collect()] == ["10000000.0", "0.0001", "0.1", "123456789012.0"]


# --------------------------------------------------------- assurance


@pytest.fixture(scope="module")
def delivered(policies, mapped):
    live = {m.target: m.transform for m in mapped if m.gate != "reject" and m.transform is not None}
    defaults = {t.name: A.default_value(t, "EFAS") for t in TARGETS if t.name not in live}
    return X.as_delivered(X.project(policies, live, defaults)).cache()


def statuses(results):
    return {r.name: r.status for r in results}


def test_sound_delivery_is_certified_and_nothing_is_skipped_silently(policies, mapped, delivered):
    v, out = A.delivered_report(delivered, TARGETS, mapped, policies, "policy_reference")
    assert v == "certified", [(r.name, r.sample) for r in out if r.status == "fail"]
    assert {t.name for t in TARGETS} <= {r.attribute for r in out}
    assert all(r.reason for r in out if r.status == "skipped") and all(r.sql for r in out if r.status in ("pass", "fail"))


def tamper(df, column, value, key="0001000007"):
    return df.withColumn(column, F.when(F.col("policy_reference") == key, value).otherwise(F.col(column)))


@pytest.mark.parametrize(("column", "value", "check"), [("policy_status", "LAPSED", "transform_rule:policy_status"), ("policy_status", "GONE", "domain:policy_status"), ("exit_date", "2020-13-01", "data_type:exit_date"), ("commencement_date", None, "required_present:commencement_date"), ("annual_premium", "12x", "data_type:annual_premium")])
def test_one_changed_cell_is_found(policies, mapped, delivered, column, value, check):
    v, out = A.delivered_report(tamper(delivered, column, F.lit(value)), TARGETS, mapped, policies, "policy_reference")
    assert statuses(out)[check] == "fail" and v in ("blocked", "needs_review")
    assert next(r for r in out if r.name == check).offending == 1


def test_an_extra_row_suspends_the_comparison(policies, mapped, delivered):
    v, out = A.delivered_report(delivered.unionByName(delivered.limit(1)), TARGETS, mapped, policies, "policy_reference")
    s = statuses(out)
    assert v == "blocked" and s["row_count_preserved"] == s["no_duplicate_rows"] == s["key_unique_not_null"] == "fail"
    assert s["transform_rule:policy_status"] == "skipped"


def test_ordinals_follow_file_order(spark, tmp_path):
    spark.range(5000).coalesce(1).selectExpr("cast(id as string) v").write.option("header", True).csv(str(tmp_path / "f"))
    df = C.ordinal(files.stage_text(spark, str(tmp_path / "f")))
    assert df.where("_rn <> cast(v as bigint) + 1").count() == 0 and df.count() == 5000


def test_mapping_report_demotes_and_blocks(policies, mapped):
    v, out, demoted = A.mapping_report(mapped, TARGETS, policies, "POLNO", [("EXITDT", "STATCD", ["LA"])])
    s = statuses(out)
    assert s["crossfield:EXITDT~STATCD"] == "fail" and s["required_present:source_system"] == "warn" and s["transforms_execute"] == "pass" and v == "needs_review"
    broken = [*mapped, match.Mapping("x", ("NOPE",), X.Copy("NOPE"), 0.9, 1.0, 0.9, "auto_accept")]
    assert A.mapping_report(broken, TARGETS, policies, "POLNO")[0] == "blocked"


def test_rules_are_derived_certified_and_catch_a_lost_bucket(policies, mapped, delivered):
    rules = A.certify(A.derive_rules(mapped, TARGETS, ["POLNO"], [("EXITDT", "STATCD", ["CL"])]), {}, "me", TARGETS)
    assert [r.id for r in rules] == [r.id for r in A.certify(rules, {}, "me", TARGETS)]
    v, out = A.reconcile(rules, policies, delivered, mapped, TARGETS)
    assert v == "certified", [(r.name, r.sample) for r in out if r.status == "fail"]
    moved = delivered.withColumn("policy_status", F.regexp_replace("policy_status", "LAPSED", "IN_FORCE"))
    v, out = A.reconcile(rules, policies, moved, mapped, TARGETS)
    assert v == "blocked" and statuses(out)["category_profile:policy_status"] == "fail"
    assert next(r for r in rules if r.kind == "crossfield").params["values"] == ["CLOSED"]


@pytest.mark.parametrize("rule", [A.Rule("median"), A.Rule("crossfield", {"attribute": "exit_date", "driver": "policy_status", "values": ["NOPE"]}), A.Rule("aggregate_by", {"function": "sum", "column": "policy_status"}), A.Rule("aggregate_by", {"function": "count", "group_by": ["nope"]}), A.Rule("category_profile", {"attribute": "nope"})])
def test_rules_that_can_t_be_run_faithfully_are_refused(policies, mapped, delivered, rule):
    assert A.rule_fault(rule, TARGETS)
    assert A.reconcile([rule], policies, delivered, mapped, TARGETS)[1][0].status == "skipped"


def test_aggregates_keep_null_groups_apart(spark):
    df = spark.createDataFrame([(None, "a", 1), ("a", None, 2)], "x string, y string, v int")
    g = {"x": F.col("x"), "y": F.col("y")}
    got = C.aggregate_by(df, df, g, g, F.col("v"), F.col("v"), "sum").collect()
    assert len(got) == 2 and all(r.ties for r in got)


def test_review_converges(mapped):
    decisions = {"exit_reason": {"action": "edit", "sql": "`EXITRSN`"}, "source_system": {"action": "default", "value": "EFAS"}, "tax_file_number": {"action": "reject"}}
    once = A.decide(mapped, decisions, TARGETS)
    assert A.decide(once, decisions, TARGETS) == once
    assert {q["target"] for q in A.review_queue(mapped, [])} > {q["target"] for q in A.review_queue(once, [])}
    assert A.nearest_values(("LAPS",), ("LAPSED", "CLOSED")) == {"LAPS": "LAPSED"}


def test_scripts_run_and_agree_with_the_engine(spark, tmp_path, policies, delivered):
    delivered.coalesce(1).write.option("header", True).csv(str(tmp_path / "out"))
    checks, _ = A.delivered_checks(TARGETS, delivered.columns)
    (tmp_path / "check.py").write_text(codegen.check_script(checks))
    good = subprocess.run([sys.executable, tmp_path / "check.py", str(tmp_path / "out")], capture_output=True, text=True, timeout=200)
    assert good.returncode == 0, good.stderr[-2000:]
    assert {line.split()[1] for line in good.stdout.splitlines()} == {c.name for c in checks}


def test_csv_text_keeps_zeros_blanks_and_line_breaks(spark):
    df = files.from_text(spark, 'A,B,C\n007,"x\ny","say ""hi"""\n  ,,\n')
    assert [tuple(r) for r in df.collect()] == [("007", "x\ny", 'say "hi"'), ("  ", None, None)]


def test_streamed_checks_equal_batch_ones(spark, tmp_path, policies):
    from tieout.streaming.checks import watch

    policies.coalesce(1).write.parquet(str(tmp_path / "in"))
    checks = [K.Check("c", "domain", K.SOFT, "STATCD", "true", "STATCD <> 'IF'")]
    stream = spark.readStream.schema(policies.schema).parquet(str(tmp_path / "in"))
    watch(stream, checks, str(tmp_path / "res"), str(tmp_path / "cp")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "res")).agg(F.sum("violations")).first()[0] == policies.where("STATCD <> 'IF'").count()


# ------------------------------------------------------ comprehension

COBOL = """
       IDENTIFICATION DIVISION.
       PROGRAM-ID. POLUPD.
       FILE-CONTROL.
           SELECT POLFILE ASSIGN TO EFAS.
       DATA DIVISION.
       01 POL-REC.
          05 POL-NO      PIC X(10).
          05 STAT-CD     PIC X(2).
             88 IN-FORCE VALUE 'IF'.
             88 LAPSED   VALUE 'LA'.
          05 PREM-AMT    PIC 9(5)V99.
       01 WS-AREA.
          05 WS-FACTOR   PIC 99.
       COPY SCHREC.
       PROCEDURE DIVISION.
       CALC-RATE.
           MOVE 12 TO WS-RATE.
       CALC-FACTOR.
           COMPUTE WS-MULT = WS-RATE * 2.
       CALC-PREM.
           IF STAT-CD = 'IF'
           COMPUTE ANN-PREM = PREM-AMT * WS-MULT
           END-IF.
       PRINT-IT.
           DISPLAY 'DONE'.
       SHOW-STATUS.
           EVALUATE STAT-CD
           WHEN 'CL'
           DISPLAY 'Closed policy'
           END-EVALUATE.
"""


def test_programs_are_read(spark):
    g = programs.parse(COBOL)
    assert g.name == "POLUPD" and g.files == {"POLFILE": "EFAS"} and g.copybooks == ["SCHREC"]
    assert [f.name for f in g.records["POL-REC"]] == ["POL-NO", "STAT-CD", "PREM-AMT"]
    meanings = programs.code_meanings(g)["STAT-CD"]
    assert meanings == {"IF": "In Force", "LA": "Lapsed", "CL": "Closed policy"}
    live, reached, coverage = programs.backward_slice(g, "ANN-PREM")
    assert [p.name for p in live] == ["CALC-RATE", "CALC-FACTOR", "CALC-PREM"] and "WS-RATE" in reached and coverage > 0.8
    assert programs.guarded_rules(g, "ANN-PREM")[0][1] == ("STAT-CD = 'IF'",)
    assert programs.layout_for(g, ["A", "B", "C"]) == [("POL-NO", "A"), ("STAT-CD", "B"), ("PREM-AMT", "C")] and not programs.layout_for(g, ["A", "B"])
    estate = programs.parse_estate(spark.createDataFrame([("p", COBOL), ("q", None)], "path string, text string"))
    assert estate.where("record = 'POL-REC'").count() == 3


def test_screens_are_read():
    s = programs.screen("$q = 'SELECT polno, statcd FROM pol'; $st = array('IF' => 'In Force', 'LA' => 'Lapsed'); <td>Policy No:</td><td><?= $r['polno'] ?></td>")
    assert s == {"columns": ["polno", "statcd"], "decodes": {"st": {"IF": "In Force", "LA": "Lapsed"}}, "labels": {"polno": "Policy No"}}


def test_versions_live_and_supersede(spark, tmp_path):
    s = graph.Store(spark, str(tmp_path / "kg"))
    assert s.latest() is None
    print_ = graph.fingerprint({("src", "a"): b"1"})
    a = s.create([("f:1", "field", "Policy", {})], [("f:1", "rec:1", "IN"), ("f:1", "rec:1", "IN")], print_)
    s.amend(a, [("f:2", "field", "Scheme", {})], "added")
    s.certify(a)
    s.certify(a)
    with pytest.raises(ValueError, match="drafts"):
        s.amend(a, [], "no")
    b = s.create([], [], graph.fingerprint({("src", "a"): b"2"}))
    s.certify(b)
    assert s.latest() == b and s.state(a) == "superseded" and s.replay(print_) == a and s.edges().where(f"version = {a}").count() == 1
    assert '"Scheme"' in s.export(a)


def test_lineage_stops_at_hubs(spark):
    e = spark.createDataFrame([("f:1", "pgm:x", "R"), ("pgm:x", "f:2", "W"), ("f:1", "f:3", "D"), ("f:3", "f:1", "D")], "src string, dst string, kind string")
    assert {(r.src, r.dst) for r in graph.lineage(e, "f:1").collect()} == {("f:1", "pgm:x"), ("f:1", "f:3"), ("f:3", "f:1")}


def test_command_line(spark, tmp_path, capsys):
    from tieout import cli

    (tmp_path / "pol.csv").write_text("POLNO,SCHNO\n" + "".join(f"{i:010d},P{i % 2}\n" for i in range(30)))
    (tmp_path / "sch.csv").write_text("SCHREF,NAME\nP0,Acme\nP1,Bolt\n")
    assert cli.main(["profile", str(tmp_path / "pol.csv")]) == 0
    assert '"inferred_type": "IDENTIFIER"' in capsys.readouterr().out
    assert cli.main(["relate", str(tmp_path / "pol.csv"), str(tmp_path / "sch.csv")]) == 0
    assert '"primary": "pol"' in capsys.readouterr().out


# ------------------------------------------------- mended this round


def test_ordinals_follow_files_whatever_their_sizes(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/part-0.csv").write_text("k\n" + "".join(f"a{i}\n" for i in range(5)))
    (tmp_path / "in/part-1.csv").write_text("k\n" + "".join(f"b{i:06d}\n" for i in range(60_000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        df = files.stage_text(spark, tmp_path / "in").select("k")
        assert df.rdd.getNumPartitions() > 3
        got = [r.k for r in C.ordinal(df).orderBy("_rn").collect()]
        assert got == [f"a{i}" for i in range(5)] + [f"b{i:06d}" for i in range(60_000)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r._rn for r in C.ordinal(spark.range(5).coalesce(1)).orderBy("id").collect()] == [1, 2, 3, 4, 5]
    assert C.ordinal(spark.range(0)).count() == 0


def test_lines_in_quotes_are_kept_and_other_files_are_split(spark, tmp_path):
    (tmp_path / "a.csv").write_text('k,v\n1,"x\ny"\n2,z\n')
    assert [tuple(r) for r in files.stage_text(spark, tmp_path / "a.csv").collect()] == [("1", "x\ny"), ("2", "z")]
    (tmp_path / "b.csv").write_text('k,v\n1,"x, ""y"""\n')
    assert [tuple(r) for r in files.stage_text(spark, tmp_path / "b.csv").collect()] == [("1", 'x, "y"')]


@pytest.mark.parametrize(("sql", "fine"), [("CASE WHEN a = 'please select one; now' THEN 'x' END", True), ("(select 1)", False), ("a; drop table x", False), ("`a`", True), ("concat(a, 'it''s; create ')", True)])
def test_refusal_reads_expressions_not_literals(spark, sql, fine):
    assert (X.refusal(spark.createDataFrame([("v",)], "a string"), sql) is None) is fine


@pytest.mark.parametrize("sql", ["transaction_timestamp()", "statement_timestamp()", "currval('s')", "localtime", "NOW ( )", "rand()"])
def test_what_changes_from_run_to_run(sql):
    assert X.nondeterministic(sql) and not X.nondeterministic("upper(name)")


def _gap(target, description, source, *others):
    cols = {s.name: s for s in (source, *others)}
    m = match.Mapping(target, (source.name,), X.Copy(source.name), 1.0)
    return match.derivation_gap(match.Target(target, "string", description), m, cols)


def test_units_conflict_only_within_a_dimension():
    gross = match.SourceColumn("AMT", "Gross Amount")
    assert _gap("annual_amount", "annual amount", gross) == ""
    assert _gap("net_amount", "net amount", gross).startswith("unit")
    assert _gap("premium_gbp", "premium in pounds", match.SourceColumn("PREM", "Premium in Pence")).startswith("unit")


def test_compositions_need_distinctive_words():
    no, name, ref = (match.SourceColumn(a, b) for a, b in (("SCHNO", "Scheme Number"), ("SCHNM", "Scheme Name"), ("EMPNM", "Employer Name")))
    assert _gap("scheme_name", "name of the scheme", name, no, ref) == ""
    sur, fore = match.SourceColumn("SURNAME", "Surname"), match.SourceColumn("FORENAME", "Forename")
    assert _gap("full_name", "Forename Surname", sur, fore).startswith("composition")


def test_a_date_in_parts_is_put_together_from_the_right_group(spark):
    cols = [match.SourceColumn(f"{g}{p[0]}", f"{p} of {n}", "INTEGER", description="Day, month and year in other columns") for g, n in (("E", "Entry"), ("M", "Maturity")) for p in ("Day", "Month", "Year")]
    cols.append(match.SourceColumn("XY", "Year of Review", "INTEGER"))
    for target, want in (("entry_date", ("ED", "EM", "EY")), ("maturity_date", ("MD", "MM", "MY")), ("review_date", ("XY",))):
        m = match.propose(match.Target(target, "date"), cols)
        assert m.sources == want and isinstance(m.transform, X.SplitDate) and m.cardinality != "1:1"
    assert match.propose(match.Target("loss_date", "date"), cols).transform is None or match.propose(match.Target("loss_date", "date"), cols).sources not in (("ED", "EM", "EY"), ("MD", "MM", "MY"))


def test_a_reassigned_source_is_not_its_own_alternative():
    sources = [match.SourceColumn("A", "Exit Date"), match.SourceColumn("B", "Exit Date")]
    targets = {n: match.Target(n, "string", "exit date") for n in ("exit_date", "exit_date_two")}
    maps = [match.Mapping(n, ("A",), X.Copy("A"), 0.5, 1.0, c, "review", alternatives=(("B", 0.5),)) for n, c in (("exit_date", 0.7), ("exit_date_two", 0.6))]
    moved = next(m for m in match.settle(maps, targets, sources) if m.sources == ("B",))
    assert [n for n, _ in moved.alternatives] == ["A"]


def test_copopulation_of_many_columns(spark):
    import time

    n = 200
    df = spark.createDataFrame([tuple(("x" if (i % 7) >= (k % 3) else "") for i in range(n)) for k in range(10)], ", ".join(f"c{i} string" for i in range(n)))
    began = time.perf_counter()
    got = {(r.col_a, r.col_b) for r in profile.copopulated(df).collect()}
    some = [i for i in range(n) if i % 7 in (0, 1)]
    assert got == {(f"c{i}", f"c{j}") for i in some for j in some if i < j and i % 7 == j % 7}
    assert time.perf_counter() - began < 30


def test_mined_rules_find_planted_faults(spark):
    from tieout.operators import rules

    data = []
    for i in range(50):
        closed = i % 7 == 0
        data.append((f"{i + 1000000:010d}", "CL" if closed else "IF", f"2019{i % 12 + 1:02d}15" if closed else "00000000", "QQ123456C" if i == 3 else f"AB{i:06d}C", "ZZ999" if i == 5 else f"AB{i % 9 + 1} {i % 10}CD", "20000230" if i == 9 else f"2000{i % 12 + 1:02d}01"))
    df = spark.createDataFrame(data, "POLNO string, STATCD string, EXITDT string, NINO string, PCODE string, COMMDT string")
    mined = rules.mine(df)
    got = {r.rule: r for r in rules.run(df, mined).collect()}
    assert {k for k, r in got.items() if r.failed} == {"ni_format:NINO", "uk_postcode:PCODE", "date_valid:COMMDT"}
    assert {"key_unique:POLNO", "conditional:EXITDT", "date_order:COMMDT<=EXITDT", "date_valid:EXITDT"} <= got.keys() - {"date_order:COMMDT<=EXITDT"} | {"date_order:COMMDT<=EXITDT"}
    assert rules.samples(df, next(r for r in mined if r.id == "ni_format:NINO")) == ["QQ123456C"]
    df.createOrReplaceTempView("mined_t")
    for r in mined:  # each rule is SQL that finds the same again
        assert spark.sql(r.sql("mined_t")).first()[0] == got[r.id].failed, r.id
    assert rules.mine(df.limit(0)) == [] and rules.run(df, []).count() == 0
    again = df.unionByName(df.where("POLNO = '0001000000'"))
    assert {r.rule: r.failed for r in rules.run(again, mined).collect()}["key_unique:POLNO"] == 2


# ------------------------------------------- specifications, scripts, command line


def _write(path, df):
    files.deliver(df, str(path))
    return str(path)


def test_a_specification_survives_json(mapped):
    from tieout.plans import spec

    ts = TARGETS
    found = A.derive_rules(mapped, ts, ["POLNO"], [("EXITDT", "STATCD", ["CL"])])
    maps, targets, certified, key, left = spec.load(spec.dump(mapped, ts, found, "policy_reference", {"source_system": "X"}))
    assert maps == mapped and targets == ts and [r.id for r in certified] == [r.id for r in found] and key == "policy_reference" and left == {"source_system": "X"}


def test_the_command_line_maps_delivers_and_proves(policies, tmp_path, capsys):
    import json

    from tieout import cli

    src = _write(tmp_path / "pol.csv", policies)
    (tmp_path / "s.json").write_text(json.dumps({"columns": [{"name": s.name, "business_name": s.business_name, "inferred_type": s.inferred_type, "aliases": list(s.aliases), "value_decode": dict(s.decode)} for s in SOURCES]}))
    (tmp_path / "t.json").write_text(json.dumps({"attributes": [{"name": t.name, "type": t.type, "allowed_values": list(t.allowed), "required": not t.nullable} for t in TARGETS]}))
    spec, out = str(tmp_path / "spec.json"), str(tmp_path / "out.csv")
    run = lambda *a: (cli.main(list(a)), [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")])
    assert run("map", src, str(tmp_path / "s.json"), str(tmp_path / "t.json"), spec)[0] == 0
    assert {i["target"] for i in run("review", spec)[1]} >= {"tax_file_number"}
    assert run("transform", spec, src, out)[0] == 0
    assert all(r["by"] == "ann" and r["enabled"] for r in run("certify", spec, "ann")[1])
    code, lines = run("validate", spec, src, out)
    assert code == 0, [x for x in lines if x.get("status") == "fail"]
    code, lines = run("reconcile", spec, src, out)
    assert code == 0 and lines[-1]["verdict"] == "certified"
    # a tampered delivery is told
    bad = _write(tmp_path / "bad.csv", files.stage_text(policies.sparkSession, out).withColumn("policy_status", F.when(F.col("policy_reference").endswith("3"), "LAPSED").otherwise(F.col("policy_status"))))
    assert run("validate", spec, src, bad)[0] == 1 and run("reconcile", spec, src, bad)[0] == 1
    for kind in ("etl", "validate", "reconcile"):
        assert run("script", spec, kind, str(tmp_path / f"{kind}.py"))[0] == 0
        compile((tmp_path / f"{kind}.py").read_text(), kind, "exec")
    done = subprocess.run([sys.executable, str(tmp_path / "reconcile.py"), src, bad], capture_output=True, text=True, timeout=300)
    assert done.returncode == 1 and "FAIL category_profile:policy_status" in done.stdout, done.stderr[-2000:]


def test_insights_are_kept_by_content(spark, tmp_path):
    from tieout.operators import insights

    df = spark.createDataFrame([("0000000001", "a", None), ("0000000002", "b", "")], "K string, S string, T string")
    first, had = insights.get_or_derive(df, "t", str(tmp_path))
    again, kept = insights.get_or_derive(df.repartition(2).orderBy(F.desc("K")), "t", str(tmp_path))
    assert not had and kept and again == first
    assert not insights.get_or_derive(df.withColumn("S", F.lit("a")), "t", str(tmp_path))[1]
    assert insights.fingerprint(df) != insights.fingerprint(df.withColumn("T", F.when(F.col("S") == "a", "")))
    assert insights.fingerprint(df.limit(0)) != insights.fingerprint(df)


class Says:
    def __init__(self, proposals=(), values=None):
        self.proposals, self.values, self.asked = proposals, values or {}, []

    def propose(self, targets, sources):
        self.asked.append(len(targets))
        return self.proposals

    def map_values(self, target, source, codes):
        return self.values


def test_proposals_are_tested_not_trusted(policies, mapped):
    from tieout.operators import proposals as P

    weak = [match.Mapping(m.target, (), None, 0.0) for m in mapped]
    says = Says([P.Proposal("annual_premium", "CAST(PREMAMT AS DOUBLE) * 12", ("PREMAMT",), "monthly"), P.Proposal("exit_date", "MBRNAME", ("MBRNAME",)), P.Proposal("policy_status", "STATCD", ("STATCD",)), P.Proposal("exit_reason", "nope", ("NOPE",)), P.Proposal("unknown", "1")])
    got = {m.target: (m, why) for m, why in P.recover(policies, weak, TARGETS, SOURCES, says)}
    assert got["annual_premium"][0].gate == "review" and got["annual_premium"][1] == ""
    assert "look like date" in got["exit_date"][1] and "permitted" in got["policy_status"][1] and "no such column" in got["exit_reason"][1]
    assert all(got[t][0].transform is None for t in ("exit_date", "policy_status", "exit_reason", "tax_file_number")) and says.asked == [len(TARGETS)]
    contested = [match.Mapping("a", ("X",), X.Copy("X"), 0.5, gate="review", notes=("contested with b",)), match.Mapping("b", ("X",), X.Copy("X"), 0.5, gate="review")]
    two = [match.Target("a"), match.Target("b")]
    assert P.verify(contested, two, [], Says([P.Proposal("a", None)]))[0].transform is None
    assert P.verify(contested, two, [], Says([P.Proposal("a", "X", ("X",))])) == contested and P.verify(contested, two, [], Says()) == contested


def test_codes_are_mapped_to_permitted_values_only(policies):
    from tieout.operators import proposals as P

    t = match.Target("flag", "enum", allowed=("0", "1"))
    s = match.SourceColumn("STATCD", "Status", decode=(("IF", "In Force"), ("LA", "Lapsed"), ("CL", "Closed")))
    m = match.Mapping("flag", ("STATCD",), X.EnumDecode("STATCD", ()), 0.6, gate="review", unmapped_codes=("IF", "LA", "CL"))
    new, why = P.map_codes(policies, m, t, s, Says(values={"IF": "1", "LA": "0", "CL": None}))
    assert why == "" and new.unmapped_codes == ("CL",) and new.gate == "review" and dict(new.transform.pairs) == {"IF": "1", "LA": "0"}
    assert P.map_codes(policies, m, t, s, Says(values={"ZZ": "1"}))[0] == m and P.map_codes(policies, m, t, s, Says(values={"IF": "maybe"}))[0] == m


COB = """       PROGRAM-ID. CALC1.
           SELECT POLFILE ASSIGN TO "POL.DAT".
       01  POL-REC.
           05  POL-NO        PIC 9(10).
           05  STAT-CD       PIC X(2).
           05  PREM-AMT      PIC 9(7)V99.
       01  OTHER-REC.
           05  A-TXT         PIC X(10).
           05  B-TXT         PIC X(2).
           05  C-TXT         PIC X(9).
       PROCEDURE DIVISION.
       MAIN-PARA.
           IF STAT-CD = 'LA'
           MOVE 2 TO WS-RATE.
           END-IF.
           COMPUTE PREM-AMT = WS-BASE * WS-RATE.
       BASE-PARA.
           COMPUTE WS-BASE = POL-NO + 1.
"""


def test_columns_are_enriched_and_programs_become_a_graph(spark, tmp_path):
    g = programs.parse(COB)
    cols = [("POLNO", "IDENTIFIER", "key"), ("STATCD", "CATEGORICAL_CODE", "code"), ("PREM", "DECIMAL", "measure")]
    assert programs.layout_for(g, [c for c, _, _ in cols], [t for _, t, _ in cols]) == [("POL-NO", "POLNO"), ("STAT-CD", "STATCD"), ("PREM-AMT", "PREM")]
    e = {x.name: x for x in programs.enrich(cols, g, {"labels": {"PREM": "Annual Premium"}, "decodes": {"STATCD": {"LA": "Lapsed"}}})}
    assert (e["PREM"].business_name, e["PREM"].confidence, e["POLNO"].confidence) == ("Annual Premium", 0.95, 0.7) and dict(e["STATCD"].decode) == {"LA": "Lapsed"}
    assert "Calculated by CALC1" in e["PREM"].description and "WS-BASE" in e["PREM"].derivation
    assert programs.enrich([("Q", "EMPTY", "dead")])[0].confidence == 0.4
    assert programs.input_roles(g, "PREM-AMT") == {"POL-NO": ["operand"], "STAT-CD": ["condition"]}
    nodes, edges = programs.program_graph(g, {"PREM-AMT": "PREM"}, {"PREM-AMT": "Annual Premium"})
    kinds = {k for _, _, k in edges}
    assert {"READS", "STORED_ON", "HAS_FIELD", "ALIGNED_TO", "LABELLED_AS", "DERIVED_BY", "DEPENDS_ON", "USES", "DEFINED_IN"} == kinds
    store = graph.Store(spark, str(tmp_path / "kg"))
    v = store.create(nodes, edges)
    assert store.edges().where(F.col("version") == v).count() == len(edges)


def test_dictionaries_are_paired_and_files_named(spark):
    d = {"table": "B", "attributes": []}
    assert relate.pair_dictionaries(["A", "B"], [("x", d), ("A", {})]) == ({"B": d, "A": {}}, [])
    assert relate.pair_dictionaries(["A"], [("x", {"table": "odd"})])[1] == [] and relate.pair_dictionaries(["A", "B"], [("x", d)])[1] == ["A"]
    maps = [match.Mapping("t", ("N", "E"), X.Copy("N"), 1.0), match.Mapping("u", ("N",), X.Copy("N"), 1.0), match.Mapping("w", ("E",), X.Copy("E"), 1.0)]
    got = relate.annotate_files(maps, {"E": ("emp", "NAME")}, "pol")
    assert got["t"][0] == ("pol", "emp") and got["u"] == (("pol",), "") and got["w"][1].endswith("emp")
    from tieout.sources.tables import catalog

    spark.range(1).createOrReplaceTempView("seen_here")
    assert [(r.column_name, r.data_type) for r in catalog(spark).where("table_name = 'seen_here'").collect()] == [("id", "bigint")]
