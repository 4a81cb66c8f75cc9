import pytest
from pyspark.sql import functions as F

from portage.functions import rewrite_rules as R
from portage.operators import stored_code as code
from portage.operators.textdep import _candidates, contains_join

SCHEMA = "app"
LINES = "owner string, name string, type string, line int, text string"
PAY = [
    "PROCEDURE pay(a IN NUMBER, b OUT VARCHAR2) IS", "v emp.sal%TYPE; -- don't touch NUMBER", "PRAGMA AUTONOMOUS_TRANSACTION;",
    "BEGIN", "DBMS_OUTPUT.PUT_LINE('total ' || a || ' rows ' || b);", "DBMS_LOCK.SLEEP(5);", "EXECUTE IMMEDIATE q;", "END;",
]


def lines_of(name, kind, *texts):
    # Stored out of order, as a catalog may return them.
    return [("APP", name, kind, i + 1, t) for i, t in reversed(list(enumerate(texts)))]


@pytest.fixture(scope="module")
def bodies(spark):
    rows = (
        lines_of("PAY", "PROCEDURE", *PAY)
        + lines_of(
            "TOTAL", "FUNCTION", "FUNCTION total(a NUMBER) RETURN NUMBER IS", "CURSOR c1 IS SELECT 1;", "BEGIN",
            "FOR r IN (SELECT 1 FROM emp e JOIN dept d ON 1=1) LOOP x := 1; END LOOP;", "RETURN 1;",
            "EXCEPTION WHEN too_big THEN RETURN 0;", "END total;",
        )
        + lines_of(
            "T_EMP", "TRIGGER", "TRIGGER t_emp BEFORE INSERT ON emp FOR EACH ROW", "BEGIN",
            ":new.id := sq.nextval;", "SELECT 1 INTO x FROM dual;", "END;",
        )
        + lines_of("T_CALL", "TRIGGER", "TRIGGER t_call AFTER INSERT ON emp FOR EACH ROW CALL pay(1, 'x')")
        + lines_of("T_LOST", "TRIGGER", "TRIGGER t_lost AFTER INSERT ON emp FOR EACH ROW CALL nobody(1)")
        + lines_of("NESTED", "PROCEDURE", "PROCEDURE nested IS", "BEGIN", "BEGIN", "x := 1;", "END;", "END;")
        + lines_of("LOB", "PROCEDURE", "PROCEDURE lob IS", "BEGIN", "DBMS_LOB.WRITE(x);", "END;")
        + lines_of("DEEP", "PROCEDURE", "PROCEDURE deep IS", "BEGIN", "DBMS_OUTPUT.PUT_LINE(f(x));", "END;")
        + lines_of("REVIEW", "PROCEDURE", "PROCEDURE review IS", "BEGIN", "raise_application_error(f(1), 'x');", "END;")
        + lines_of("META", "PROCEDURE", "PROCEDURE meta IS", "BEGIN", "SELECT 1 INTO x FROM all_tables;", "END;")
        + lines_of("QUOTED", "PROCEDURE", "PROCEDURE quoted IS", "BEGIN", "y := 'NUMBER one';", "END;")
    )
    return code.assemble(spark.createDataFrame(rows, LINES))


@pytest.fixture(scope="module")
def views(spark):
    return spark.createDataFrame(
        [("SYS", "ALL_TABLES", "x"), ("APP", "V_EMP", 'SELECT "A"."B", \'"q"\' FROM "EMP"')],
        "owner string, view_name string, text string",
    )


def one_rule(spark, text, rules, late=None):
    df = spark.createDataFrame([("o", "n", "PROCEDURE", text)], "owner string, name string, type string, body string")
    return code.apply_rules(df, rules, late).first()["body"]


@pytest.mark.parametrize(
    "text, rules, expected",
    [
        ("a NUMBER; b Varchar2(9); c := 'NUMBER'; -- NUMBER", [R.types], "a numeric; b varchar(9); c := 'NUMBER'; -- NUMBER"),
        ("v emp.sal%TYPE;", [R.pct_type(SCHEMA)], "v app.emp.sal%TYPE;"),
        ("v emp.sal%TYPE;", [R.pct_type("public")], "v emp.sal%TYPE;"),
        ("a hr.t.c%TYPE; b v%TYPE; c t.c%TYPE", [R.pct_type(SCHEMA)], "a hr.t.c%TYPE; b v%TYPE; c app.t.c%TYPE"),
        (
            "SELECT EXTRACT(YEAR FROM d) FROM emp JOIN x.dept ON 1 = 1 WHERE 1 IN (SELECT 1 FROM dual)", [R.qualify(SCHEMA)],
            "SELECT EXTRACT(YEAR FROM d) FROM app.emp JOIN x.dept ON 1 = 1 WHERE 1 IN (SELECT 1 FROM dual)",
        ),
        (":new.a := :OLD.b || ':new'", [R.trigger_rows], "NEW.a := OLD.b || ':new'"),
        ("x := app.sq.nextval;", [R.nextval], "x := nextval('app.sq');"),
        ("PROCEDURE p(a IN NUMBER, b IN OUT t.c%TYPE) IS c IN d", [R.params], "PROCEDURE p(IN a NUMBER, IN OUT b t.c%TYPE) IS c IN d"),
        ("CURSOR c1 IS SELECT 1;", [R.cursors], "c1 CURSOR FOR SELECT 1;"),
        ("PRAGMA X(a, b); too_big EXCEPTION; k NUMBER;", [R.pragmas], "  k NUMBER;"),
        ("RAISE too_big;", [R.raise_name], "RAISE EXCEPTION 'EXCEPTION_too_big';"),
        ("dbms_lock.sleep(5);", [R.sleep], "PERFORM pg_sleep(5);"),
        ("SELECT 1 INTO x FROM dual;", [R.drop_dual], "SELECT 1 INTO x;"),
        ("FOR r IN ( SELECT 1 ) LOOP", [R.for_paren], "FOR r IN  SELECT 1  LOOP"),
    ],
)
def test_single_rules(spark, text, rules, expected):
    assert one_rule(spark, text, rules) == expected


def test_calls_with_literals(spark):
    notice = one_rule(spark, "dbms_output.put_line('it''s (100%) ' || v_n || ' || ' || v_m); x := 'a';", [], [R.notices])
    assert notice == "RAISE NOTICE 'it''s (100%%) % || %', v_n, v_m; x := 'a';"
    assert one_rule(spark, "DBMS_OUTPUT.PUT_LINE(x);", [], [R.notices]) == "RAISE NOTICE '%', x;"
    raised = one_rule(spark, "raise_application_error(-20001, 'bad 5%');", [], [R.raise_call])
    assert raised == "RAISE EXCEPTION '-20001, ''bad 5%%''';"
    assert one_rule(spark, "y := 'dbms_output.put_line(x);';", [], [R.notices]) == "y := 'dbms_output.put_line(x);';"


def test_masking_survives_any_text(spark):
    for text in ["", "'", "a'b", "x \x01 y \x02 'z'", "'a''b' /* it's */ -- 'c\n'd'", "/* open 'q'", "''" * 20000]:
        assert one_rule(spark, text, [R.types]) == text


def test_triage(bodies, views):
    found = {r["name"]: r["reason"] for r in code.triage(bodies, views, SCHEMA).collect()}
    assert found == {
        "PAY": None, "TOTAL": None, "T_EMP": None, "T_CALL": None, "T_LOST": None, "NESTED": "factory", "LOB": "unsupported",
        "DEEP": "review", "REVIEW": "review", "META": "untranslatable", "QUOTED": None,
    }


def test_whole_translation(spark, bodies, views):
    out = {r["target_name"]: r for r in code.rewrite_all(bodies, views, SCHEMA).collect()}
    assert set(out) == {"pay", "total", "fn_t_emp", "t_emp", "fn_pay", "t_call", "quoted", "v_emp"}
    assert out["pay"]["script"] == (
        "CREATE OR REPLACE PROCEDURE app.pay(IN a numeric, OUT b varchar)\nLANGUAGE PLPGSQL AS\n$$\nDECLARE\n"
        "v app.emp.sal%TYPE; -- don't touch NUMBER\nBEGIN\nRAISE NOTICE 'total % rows %', a, b;\nPERFORM pg_sleep(5);\nEXECUTE q;"
        "\nEXCEPTION WHEN OTHERS THEN\nraise notice 'Transaction has failed and rolledback!';\n"
        "raise notice '% %', SQLERRM, SQLSTATE;\nEND;\n$$;"
    )
    total = out["total"]["script"]
    assert total.startswith("CREATE OR REPLACE FUNCTION app.total(a numeric) RETURNS numeric\n")
    assert "DECLARE\nr record;\nc1 CURSOR FOR SELECT 1;\nBEGIN\n" in total
    assert "FOR r IN SELECT 1 FROM app.emp e JOIN app.dept d ON 1=1 LOOP x := 1; END LOOP;\nRETURN 1;\nEXCEPTION WHEN OTHERS" in total
    assert out["fn_t_emp"]["script"] == (
        "CREATE OR REPLACE FUNCTION app.fn_t_emp() RETURNS TRIGGER LANGUAGE PLPGSQL AS \n$$\nBEGIN\n"
        "NEW.id := nextval('sq');\nSELECT 1 INTO x;\nRETURN NEW;\n\nEND;\n$$;"
    )
    assert out["t_emp"]["script"] == (
        "CREATE OR REPLACE TRIGGER t_emp BEFORE INSERT ON app.emp FOR EACH ROW\nEXECUTE FUNCTION app.fn_t_emp();"
    )
    assert "DECLARE\na numeric := TG_ARGV[0];\nb varchar := TG_ARGV[1];\nv app.emp.sal%TYPE;" in out["fn_pay"]["script"]
    assert out["t_call"]["script"].endswith("EXECUTE FUNCTION app.fn_pay(1, 'x');")
    assert out["v_emp"]["script"] == "CREATE OR REPLACE VIEW app.v_emp AS SELECT A.B, '\"q\"' FROM app.EMP"
    existing = spark.createDataFrame([("T_EMP", "trigger")], "name string, type string")
    dropped = {r["target_name"]: r["script"] for r in code.with_drop(code.rewrite_all(bodies, views, SCHEMA), existing, SCHEMA).collect()}
    assert dropped["t_emp"].startswith("DROP TRIGGER IF EXISTS t_emp ON app.emp;\nCREATE")
    assert dropped["pay"].startswith("CREATE")


def test_long_objects_are_translated_like_short_ones(spark, views):
    def body(n):
        return ["PROCEDURE big IS", "a NUMBER;", "BEGIN", *["x := 1;"] * n, "/* a", "NUMBER */", "y := 'NUMBER';", "END;"]

    rows = lines_of("BIG", "PROCEDURE", *body(60_000)) + lines_of("SMALL", "PROCEDURE", *body(1))
    bodies = code.assemble(spark.createDataFrame(rows, LINES))
    big, small = (r["body"] for r in code.apply_rules(bodies, [R.types]).orderBy("name").collect())
    assert big.replace("x := 1;\n" * 60_000, "x := 1;\n") == small
    assert "/* a\nNUMBER */" in big and "a numeric;" in big
    assert {r["status"] for r in code.triage(bodies, views, SCHEMA).collect()} == {"ok"}


def test_calls_of_missing_routines_are_set_aside(spark, views):
    rows = lines_of("PAY", "PROCEDURE", "PROCEDURE pay IS", "BEGIN", "x := 1;", "END;")
    rows += lines_of("BAD", "PROCEDURE", "PROCEDURE bad IS", "BEGIN", "DBMS_LOB.WRITE(x);", "END;")
    for name, callee in (("T1", "pay"), ("T2", "bad"), ("T3", "gone")):
        rows += lines_of(name, "TRIGGER", f"TRIGGER {name} BEFORE INSERT ON emp FOR EACH ROW", f"CALL {callee}(1)")
    accepted = code.ready(code.assemble(spark.createDataFrame(rows, LINES)), views, SCHEMA)
    aside = code.without_routine(accepted).collect()
    assert {(r["name"], r["reason"]) for r in aside} == {("T2", "missing routine"), ("T3", "missing routine")}
    balance = code.trigger_balance(accepted, SCHEMA).collect()
    assert [(r["accepted"], r["emitted"], r["quarantined"]) for r in balance] == [(3, 1, 2)]


def test_every_loop_variable_is_declared(spark):
    text = "c CURSOR FOR q; FOR z IN 1 BEGIN FOR r IN (a) LOOP FOR S IN b LOOP FOR c IN d LOOP FOR s IN e LOOP END"
    df = spark.createDataFrame([(text,), ("BEGIN x END",)], "code string")
    assert [r[0] for r in df.select(R.loop_record(F.col("code"))).collect()] == ["r record;\ns record;", ""]


def test_nested_calls_are_for_review(spark, views):
    rows = lines_of("A", "PROCEDURE", "PROCEDURE a IS", "BEGIN", "dbms_output.put_line('n ' || to_char(x));", "END;")
    rows += lines_of("B", "PROCEDURE", "PROCEDURE b IS", "BEGIN", "dbms_output.put_line(f(x)); DBMS_LOB.WRITE(x);", "END;")
    reasons = {r["name"]: r["reason"] for r in code.triage(code.assemble(spark.createDataFrame(rows, LINES)), views, SCHEMA).collect()}
    assert reasons == {"A": "review", "B": "unsupported"}


def test_tokens_detach_the_parenthesis(spark):
    df = spark.createDataFrame([(1, "  PROCEDURE pay(a IN\n NUMBER)")], "id int, body string")
    assert [r["token"] for r in code.tokens(df, ["id"], "body").orderBy("pos").collect()] == ["PROCEDURE", "pay", "(a", "IN", "NUMBER)"]


def test_containment_against_brute_force(spark):
    texts = [
        "select * from app.emp;", "employees of app.empire", "a-b c", "the quick brown fox jumps", "quick brown  fox jumps over",
        "x", "", "  lead and trail  ", "über-größe und mehr und noch mehr", "app.employee app .emp", "and,so,on and so on it goes",
        "emp", "tempo", "漢字" * 100 + "終", "漢字" * 100, "z" * 70 + ".y",
    ]
    names = [
        "emp", "app.emp", "quick brown fox", "quick brown fox jumps", "the quick brown fox jumps", "brown  fox", "b c", "-", ".",
        "x", " trail  ", "größe und mehr und noch", "so on it", "mp", "nowhere to be found at all", "p.e", "and so on it goes", "e",
        "字漢" * 60 + "字終", "z" * 66 + ".", "z" * 71,
    ]
    t = spark.createDataFrame(list(enumerate(texts)), "tid int, body string")
    n = spark.createDataFrame(list(enumerate(names)), "nid int, needle string")
    found = {(r["nid"], r["tid"]) for r in contains_join(t, n, "tid", "body", "nid", "needle").collect()}
    assert found == {(i, j) for i, name in enumerate(names) for j, text in enumerate(texts) if name in text}


@pytest.mark.parametrize("name", ["k{} the z{}", "t{}.id", "k{} the of z{}", "k{} the "])
def test_common_words_do_not_make_all_pairs(spark, name):
    texts = spark.createDataFrame([(i, f"a k{i} the z{i} and of the id t{i}.id k{i} the of z{i}") for i in range(500)], "tid int, body string")
    names = spark.createDataFrame([(i, name.format(1000 + i, 1000 + i)) for i in range(500)], "nid int, needle string")
    _, _, pairs = _candidates(texts, names, "tid", "body", "nid", "needle")
    assert pairs.count() < 10 * 500


@pytest.mark.parametrize("name", ["db.app.customer_{0}", "db{0}.app.customer", "db{1}.app.hr.emp{2}", "db{1}.app.emp{2}"])
@pytest.mark.parametrize("shift", [0, 10_000])
def test_names_of_one_schema_meet_their_own_texts_only(spark, name, shift):
    of = lambda i: name.format(i, i % 40, i // 40)
    texts = spark.createDataFrame([(i, f"select * from {of(i + shift)} where x") for i in range(600)], "tid int, body string")
    names = spark.createDataFrame([(i, of(i)) for i in range(600)], "nid int, needle string")
    _, _, pairs = _candidates(texts, names, "tid", "body", "nid", "needle")
    matches = contains_join(texts, names, "tid", "body", "nid", "needle").count()
    assert pairs.count() <= matches + 600


def test_containment_has_no_nested_loop(spark):
    t = spark.createDataFrame([(1, "a b c d e f")], "tid int, body string")
    n = spark.createDataFrame([(1, "b c d e f"), (2, "c")], "nid int, needle string")
    plan = contains_join(t, n, "tid", "body", "nid", "needle")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def assembled(spark, objects):
    return code.assemble(spark.createDataFrame(
        [(owner, name, kind, i, line) for (owner, name, kind), body in objects.items() for i, line in enumerate(body.split("\n"))],
        "owner string, name string, type string, line int, text string",
    ))


OBJECTS = {
    ("APP", "bad", "PROCEDURE"): "PROCEDURE bad(a IN NUMBER) IS\nBEGIN\nDBMS_LOB.WRITE(x);\nEND;",
    ("APP", "one", "PROCEDURE"): "PROCEDURE one(a IN NUMBER) IS\nBEGIN\nbad(1); -- two(1)\nEND;",
    ("APP", "two", "FUNCTION"): "FUNCTION two(a NUMBER) RETURN NUMBER IS\nBEGIN\nRETURN app.ONE(1) + length('bad(2)');\nEND;",
    ("APP", "ring", "FUNCTION"): "FUNCTION ring(a NUMBER) RETURN NUMBER IS\nBEGIN\nRETURN ring(1) + ring2(1);\nEND;",
    ("APP", "ring2", "FUNCTION"): "FUNCTION ring2(a NUMBER) RETURN NUMBER IS\nBEGIN\nRETURN ring(1) + two(3);\nEND;",
    ("APP", "fine", "PROCEDURE"): "PROCEDURE fine(a IN NUMBER) IS\nBEGIN\nx := 'bad(1);'; y := other.bad(2); z := nobody(3);\nEND;",
    ("APP", "lost", "TRIGGER"): "TRIGGER lost BEFORE INSERT ON t FOR EACH ROW CALL nowhere(1)",
    ("APP", "kept", "TRIGGER"): "TRIGGER kept BEFORE INSERT ON t FOR EACH ROW CALL two(1)",
    ("APP", "cut", "TRIGGER"): "TRIGGER cut BEFORE INSERT ON t FOR EACH ROW CALL bad(1)",
    ("OTHER", "one", "PROCEDURE"): "PROCEDURE one(a IN NUMBER) IS\nBEGIN\nx := 1;\nEND;",
}


def test_every_object_is_emitted_or_set_aside(spark):
    bodies, views = assembled(spark, OBJECTS), spark.createDataFrame([], "owner string, view_name string, text string")
    aside = {(r.owner, r.name, r.type): (r.reason, r.body) for r in code.quarantined(bodies, views, "app").collect()}
    emitted = {(r.owner, r.name, r.type) for r in code.rewrite_all(bodies, views, "app").collect()}
    assert {k[1]: v[0] for k, v in aside.items()} == {"bad": "unsupported", "lost": "missing routine", "cut": "missing routine"}
    assert all(OBJECTS[k] == body for k, (_, body) in aside.items())
    assert emitted | set(aside) == set(OBJECTS) and not emitted & set(aside)


def test_callers_of_what_is_set_aside_are_blocked(spark):
    bodies, views = assembled(spark, OBJECTS), spark.createDataFrame([], "owner string, view_name string, text string")
    found = {(r.owner, r.name): (r.blocked_by, r.reason) for r in code.blocked_by_calls(bodies, views, "app").collect()}
    root = ("APP.bad.procedure", "unsupported")
    assert found == {("APP", n): root for n in ("one", "two", "ring", "ring2", "kept")}


def test_judging_moves_no_code(spark):
    """Only keys and verdicts meet the objects that read system views."""
    bodies = spark.createDataFrame([("A", "f", "FUNCTION", "FUNCTION f IS BEGIN NULL; END;")], "owner string, name string, type string, body string")
    views = spark.createDataFrame([("SYS", "V", "SELECT 1")], "owner string, view_name string, text string")
    plan = code.triage(bodies, views, "app")._jdf.queryExecution().optimizedPlan().toString()
    joined = plan[: plan.index("Join LeftOuter")]
    assert "_left" not in joined and "_code" not in joined and "body" not in joined


def test_texts_are_not_read_again_for_plain_names(spark):
    """Names of one or two words are found exactly, repeated, glued and unmatched ones too; equals brute force."""
    texts = [
        ("t1", "call part_12(app.emp); xapp.employee"), ("t2", "app..emp part_1"), ("t3", ""), ("t4", "app emp " * 300 + "longword" + "y" * 80),
        ("t4", "second row with seq_7"), ("t5", ".app.emp."), ("t6", "ünï.cödé_1 emp"),
    ]
    names = [
        ("n1", "part_1"), ("n2", "app.emp"), ("n3", "emp"), ("n4", "app emp"), ("n5", "y" * 70), ("n6", ".emp"), ("n7", "emp."), ("n8", "cödé"),
        ("n9", "ï.cö"), ("n3", "seq_7"), ("n10", "."), ("n11", "missing"), ("n12", " "), ("n13", "longwordyy"),
    ]
    docs = spark.createDataFrame(texts, "tid string, body string")
    asked = spark.createDataFrame(names, "nid string, needle string")
    expected = {(n, t) for t, body in texts for n, needle in names if needle.strip() and needle in body}
    found = [tuple(r) for r in contains_join(docs, asked, "tid", "body", "nid", "needle").collect()]
    assert len(found) == len(set(found)) and set(found) == expected
    plain = asked.where("nid IN ('n1', 'n2', 'n3')")
    plan = contains_join(docs, plain, "tid", "body", "nid", "needle")._jdf.queryExecution().optimizedPlan().toString()
    assert "Contains(text" not in plan


def test_rules_run_where_their_words_are(spark):
    """Judged code is what all rules make of it, in any case of letters, and where a rule removes text between words."""
    texts = [
        "PROCEDURE p(a IN NUMBER) IS v t.c%Type; BEGIN Select s.NextVal Into x From dual; END;", "", "x", "BEGIN x := :NEW.a || :Old.b; END;",
        "FUNCTION f(a Out VarChar2) RETURN NUMBER IS cursor c IS SELECT 1 from T; too EXCEPTION; PRAGMA x; BEGIN Raise too; END;",
        "begin dbms_$x EXCEPTION;lock.sleep(1); execute Immediate q; for r in (select 1 from a Join dual) Loop x; end loop; end;",
        "begin Begin DBMS_LOB.write(x); end; end;", "begin raise_it(f(1)); end;", "begin Dbms_Output.Put_Line('a' || b); end;", "İf loſ Kelvin from x",
    ]
    bodies = spark.createDataFrame([("A", f"n{i}", "PROCEDURE", t) for i, t in enumerate(texts)], "owner string, name string, type string, body string")
    judged = {r["name"]: r for r in code._ruled(bodies, "app").collect()}
    plain = code.masked(bodies)
    for rule in R.general_rules("app"):
        plain = plain.withColumn("_code", rule(F.col("_code")))
    assert {n: r["_code"] for n, r in judged.items()} == {r["name"]: r["_code"] for r in plain.collect()}
    assert [judged[f"n{i}"]["_verdict"] for i in (3, 6, 7, 8)] == [None, "factory", "review", None]
    # Each rule tells the words that it needs.
    assert all(words for _, words in R.general_steps("app")) and R.general_steps("public")
