"""Files, guarded SQL, record tables, findings and text checks on small tables."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from veritab import registry
from veritab.functions import text as text_functions
from veritab.operators import combine, insights, profile, records, texts
from veritab.plans import guard, verdict
from veritab.sources import files, tables


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_csv_is_typed_and_reported(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text("Id;Größe (cm);zip;ok\n1;1.5;01234;yes\n2;NA;04567;no\n3;2;00001;yes\n4;5;6;7;8\n")
    df, report = files.load(spark, str(path))
    assert df.dtypes == [("id", "bigint"), ("groe_cm", "double"), ("zip", "string"), ("ok", "boolean")]
    assert [tuple(r) for r in df.orderBy("id").collect()] == [(1, 1.5, "01234", True), (2, None, "04567", False), (3, 2.0, "00001", True)]
    assert [(w[0], w[2]) for w in report.warnings] == [("rejected_rows", 1)]


def test_latin1_and_missing_headers_are_told(spark, tmp_path):
    (tmp_path / "latin1.csv").write_bytes("name;grp;flag\nÉva;a;\nJosé;b;\nÉva;a;\nNoël;b;x\n".encode("latin-1"))
    df, report = files.load(spark, f"{tmp_path}/latin1.csv")
    assert {r["name"] for r in df.collect()} == {"Éva", "José", "Noël"} and [w[0] for w in report.warnings] == ["encoding_fallback"]
    assert profile.duplicate_rows(df).first()["duplicates"] == 1
    (tmp_path / "utf8.csv").write_text("name;grp\nÉva �;a\n", encoding="utf-8")
    assert files.load(spark, f"{tmp_path}/utf8.csv")[1].warnings == []
    (tmp_path / "bare.csv").write_text("1,2\n3,4\n")
    df, report = files.load(spark, f"{tmp_path}/bare.csv")
    assert df.columns == ["column0", "column1"] and df.count() == 2 and report.warnings[0][0] == "no_header"


def test_null_strings(spark):
    values = ["Null", "MISSING", "None", "?", "#N/A", "Missing", "#NA", " NA ", "0"]
    found = spark.createDataFrame([(v,) for v in values], "a string").select(files.without_null_strings(F.col("a")).alias("a")).collect()
    assert [r["a"] for r in found] == [None] * 5 + ["Missing", "#NA", None, "0"]


def test_dictionaries_match_columns(spark, tmp_path):
    (tmp_path / "d.csv").write_text("Variable;Label\nTotal_Price;The price\nunused;x\n;y\n")
    entries = files.read_dictionary(spark, f"{tmp_path}/d.csv")
    columns = spark.createDataFrame([("totalprice",), ("other",)], "column string")
    assert {tuple(r) for r in combine.match_descriptions(columns, entries).collect()} == {("totalprice", "The price"), ("other", None)}
    (tmp_path / "e.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError):
        files.read_dictionary(spark, f"{tmp_path}/e.csv")


def test_tables_are_saved_logged_and_exported(spark, tmp_path):
    first = spark.createDataFrame([(1, "a"), (2, None)], "dataset_id int, v string")
    assert tables.save(first, str(tmp_path), "kept").count() == 2
    assert tables.save(tables.replace_dataset(first, first.where("dataset_id = 2").withColumn("v", F.lit("b"))), str(tmp_path), "kept").count() == 2
    assert {tuple(r) for r in spark.table("kept").collect()} == {(1, "a"), (2, "b")}
    assert tables.drop(spark, "kept") and not tables.drop(spark, "kept")
    tables.log_query(spark, f"{tmp_path}/log", "SELECT 1", 1, 0.5, None, ["a"], [[1]])
    tables.log_query(spark, f"{tmp_path}/log", "SELECT 2", 3, 1.5, "bad", [], [])
    log = spark.read.parquet(f"{tmp_path}/log")
    assert tables.query_stats(log.withColumn("k", F.lit("p")), "k").first()["seconds"] == 1.0
    files.write_csv(first, f"{tmp_path}/out")
    text = next((tmp_path / "out").glob("*.csv")).read_text(encoding="utf-8")
    assert text.startswith("\ufeffdataset_id,v")
    assert [r["json"] for r in tables.as_json(first).collect()] == ['{"dataset_id":1,"v":"a"}', '{"dataset_id":2,"v":null}']
    assert tables.catalog({"t": first}).count() == 2


def test_bibtex(spark):
    rows = [(1, "On trees", ["Ann Lee", "B. Ray"], 2020, "Journal of Woods", "10.1/x"), (2, "On rocks", ["C. Lee"], 2020, "Proceedings of Stones", None), (3, None, None, None, None, None)]
    found = {r["id"]: r for r in tables.bibtex(spark.createDataFrame(rows, "id int, title string, authors array<string>, year int, venue string, doi string")).collect()}
    assert [found[i]["key"] for i in (1, 2, 3)] == ["lee2020ona", "lee2020onb", "anonnduntitled"]
    assert found[1]["entry"].startswith("@article{lee2020ona,") and "author = {Ann Lee and B. Ray}" in found[1]["entry"] and found[2]["entry"].startswith("@inproceedings{")


def test_lost_values_are_counted(spark):
    df = spark.createDataFrame([(str(i),) for i in range(99)] + [("x",)], "a string")
    kinds = files.infer_types(df)
    assert kinds == {"a": "bigint"}
    assert [tuple(r) for r in files.coercion_report(df, kinds).collect()] == [("a", 1, ["x"])]


def test_kinds_and_names(spark):
    assert files.file_kind("x.CSV") == "csv" and files.file_kind("x") is None and files.file_kind("a.xyz") is None
    taken: set[str] = set()
    names = ["Age (yrs)", "age yrs", "2024 score", "___", "Années d'études", "Âge"]
    assert [files.clean_name(n, taken) for n in names] == ["age_yrs", "age_yrs_2", "col_2024_score", "col", "annees_d_etudes", "age"]
    with pytest.raises(ValueError):
        files.load(spark, "a.xyz")
    whole = files.whole_floats_as_integers(spark.createDataFrame([(1.0, 1.5)], "a double, b double"))
    assert whole.dtypes == [("a", "bigint"), ("b", "double")]


@pytest.mark.parametrize(
    "sql",
    [
        "SELECT * FROM t", "SELECT a, rank() OVER (ORDER BY a) AS r FROM t;", "WITH c AS (SELECT a FROM t) SELECT count(*) AS n FROM c",
        "SELECT a FROM t UNION ALL SELECT a FROM t", "SELECT x.a FROM t x LEFT JOIN t y ON x.a = y.a", "SELECT * FROM range(3)",
        "SELECT a FROM t WHERE a IN (SELECT max(a) FROM t) ORDER BY a LIMIT 1", "WITH c AS (SELECT a FROM t), d AS (SELECT a FROM c) SELECT * FROM d JOIN c USING (a)",
        "WITH t2 AS (SELECT a FROM t) SELECT (SELECT max(a) FROM t2) AS m FROM t", "SELECT percentile(a, 0.5) AS p, date_trunc('month', current_date()) AS d FROM t GROUP BY 2",
        "SELECT a, lag(a) OVER (ORDER BY a) AS b FROM t", "SELECT CASE WHEN a > 1 THEN 'x' END AS c, try_cast(a AS string) AS s FROM t",
    ],
)
def test_queries_pass_the_guard(spark, sql):
    assert guard.execute(spark, sql, {"t": spark.range(3).toDF("a")}).error is None


@pytest.mark.parametrize(
    "sql",
    [
        "", "DROP TABLE t", "SELECT 1; DROP TABLE t", "SET a=b", "INSERT INTO t VALUES (1)", "CACHE TABLE t", "DESCRIBE t", "SELECT * FROM other", "SELECT * FROM a.t", "SELECT * FROM parquet.`/tmp`",
        "SELECT java_method('java.lang.System', 'getenv', 'HOME')", "SELECT reflect('java.lang.System', 'exit')", "SELECT * FROM t WHERE EXISTS (SELECT * FROM other)", "WITH c AS (SELECT * FROM other) SELECT * FROM c",
        "SELECT (SELECT max(a) FROM other) FROM t", "CREATE TABLE x AS SELECT 1", "SELECT * FROM read_files('x')", "WITH secret AS (SELECT * FROM secret) SELECT * FROM secret",
        "SELECT s.* FROM secret s, (WITH secret AS (SELECT 1 AS x) SELECT x FROM secret) y", "WITH a AS (SELECT * FROM b), b AS (SELECT 1 AS x) SELECT * FROM a", "SELECT my_udf(a) FROM t", "SELECT version()",
        "SELECT current_user()", "SELECT input_file_name() FROM t", "DELETE FROM t", "UPDATE t SET a = 1", "ALTER TABLE t RENAME TO u", "TRUNCATE TABLE t", "EXPLAIN SELECT 1", "SHOW TABLES", "USE x", "MERGE INTO t USING t ON true WHEN MATCHED THEN DELETE",
        "ADD JAR x", "SELECT * FROM spark_catalog.default.t", "SELECT spark_catalog.default.f(a) FROM t", "VALUES (java_method('java.lang.System', 'exit'))", "DROP VIEW t", "LOAD DATA INPATH 'x' INTO TABLE t", "REFRESH TABLE t", "SELECT * FROM json.`/etc/passwd`",
    ],
)
def test_the_guard_refuses(spark, sql):
    with pytest.raises(guard.Refused):
        guard.check(spark, sql, {"t": spark.range(3).toDF("a")})


@pytest.mark.parametrize(
    "sql",
    [
        "SELECT gender, count(*) AS n FROM survey GROUP BY gender ORDER BY n DESC", "WITH x AS (SELECT * FROM survey) SELECT avg(age) FROM x", "SELECT * FROM survey s JOIN orders o ON s.id = o.customer_id",
        "SELECT age, rank() OVER (ORDER BY age) FROM survey", "SELECT * FROM survey WHERE age > (SELECT avg(age) FROM survey);", "SELECT 1 AS a UNION ALL SELECT 2", "SELECT * FROM range(10)",
        "SELECT percentile_cont(0.5) WITHIN GROUP (ORDER BY age) FROM survey", "SELECT * FROM survey PIVOT (count(id) FOR gender IN ('M', 'F'))", "SELECT * FROM survey UNPIVOT (v FOR n IN (id, age))",
        "SELECT id FROM survey s WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.customer_id = s.id) AND id IN (SELECT customer_id FROM orders)", "SELECT s.*, x.m FROM survey s, LATERAL (SELECT max(customer_id) AS m FROM orders WHERE customer_id < s.id) x",
        "SELECT grouping_id(), gender, sum(age) FROM survey GROUP BY CUBE (gender)", "SELECT w FROM survey LATERAL VIEW explode(split(gender, '')) e AS w", "SELECT date '2024-01-02' - day, day + interval 1 month, extract(year FROM day) FROM survey",
        "SELECT transform(array(age), x -> x + 1), struct(*), age::string, current_date FROM survey", "SELECT * EXCEPT (day) FROM survey UNION SELECT 1, 2, 'x' INTERSECT SELECT 1, 2, 'x'",
    ],
)
def test_what_a_reader_asks_passes(spark, survey, sql):
    guard.check(spark, sql, survey)


@pytest.fixture(scope="module")
def survey(spark):
    rows = spark.range(100).selectExpr("id", "cast(20 + id % 50 AS int) AS age", "if(id % 3 = 0, 'M', 'F') AS gender", "date_add(date '2024-01-01', cast(id AS int)) AS day")
    return {"survey": rows, "orders": spark.range(5).toDF("customer_id")}


@pytest.mark.parametrize(
    "sql",
    [
        "", "DROP TABLE survey", "SELECT 1; DROP TABLE survey", "DELETE FROM survey", "UPDATE survey SET age = 0", "INSERT INTO survey VALUES (1)", "CREATE TABLE z AS SELECT * FROM survey", "COPY survey TO '/tmp/out.csv'",
        "ATTACH '/tmp/other.db' AS other", "PRAGMA database_list", "SET threads = 1", "INSTALL httpfs", "LOAD httpfs", "EXPORT DATABASE '/tmp/x'", "CALL pragma_version()", "DESCRIBE survey",
        "SELECT * FROM read_csv('/etc/passwd')", "SELECT * FROM read_csv_auto('/etc/passwd')", "SELECT * FROM '/etc/passwd'", "SELECT * FROM 'https://example.com/data.csv'", "SELECT read_text('/etc/passwd')",
        "SELECT getenv('API_JWT_SECRET')", "SELECT current_setting('memory_limit')", "SELECT * FROM duckdb_settings()", "SELECT * FROM duckdb_tables()", "SELECT * FROM glob('/data/*')", "SELECT * FROM query('SELECT 1')",
        "SELECT * FROM other_db.main.survey", "SELECT * FROM secrets", "WITH x AS (SELECT * FROM read_parquet('/x.parquet')) SELECT * FROM x", "SELECT * FROM survey WHERE id IN (SELECT id FROM read_json('/x.json'))",
        # Names that the parser leaves open and the analyser fills in.
        "SELECT IDENTIFIER('java_method')('java.lang.System', 'getProperty', 'user.home') FROM survey", "SELECT IDENTIFIER('reflect')('java.lang.System', 'getenv', 'PATH')", "SELECT IDENTIFIER('current_user')()",
        "SELECT IDENTIFIER('ge' || 'nder') FROM survey", "SELECT * FROM IDENTIFIER('survey')", "SELECT current_user", "SELECT user FROM survey", "SELECT session_user", "SELECT * FROM VALUES (current_user) x(u)",
        "SELECT * FROM survey WHERE current_user = 'root'", "SELECT 1 FROM survey ORDER BY current_user", "SELECT max(current_user) OVER () FROM survey", "SELECT (SELECT current_user)", "SELECT transform(array(1), x -> current_user)",
        "SELECT * FROM survey s LEFT JOIN orders o ON s.id = o.customer_id AND user = 'r'", "SELECT * FROM survey LATERAL VIEW explode(array(current_user)) e AS u", "SELECT * FROM survey, LATERAL (SELECT current_user AS u)",
        "SELECT id FROM survey GROUP BY id HAVING max(current_user) = 'r'", "SELECT id FROM survey WHERE id IN (SELECT length(user) FROM orders)", "WITH c AS (SELECT user AS u) SELECT u FROM c", "FROM survey |> SELECT current_user",
    ],
)
def test_what_reaches_outside_is_refused(spark, survey, sql):
    with pytest.raises(guard.Refused):
        guard.check(spark, sql, survey)


def test_an_unknown_table_is_told_what_there_is(spark, survey):
    with pytest.raises(guard.Refused, match="Available tables: orders, survey"):
        guard.check(spark, "SELECT * FROM surveys", survey)


def test_all_functions_of_the_allowed_groups_pass_and_no_other(spark):
    """Spark's own examples of its functions: each passes, or is refused, by the group it is in."""
    registry = spark._jvm.org.apache.spark.sql.catalyst.analysis.FunctionRegistry.builtin()
    names = registry.listFunction()
    wrong = []
    for i in range(names.size()):
        about = registry.lookupFunction(names.apply(i)).get()
        examples = re.findall(r"> (SELECT.*?);\n", about.getExamples(), re.S)
        for example in examples[:1]:
            sql = example.replace("_FUNC_", about.getName())
            try:
                guard.check(spark, sql, {})
                passed = True
            except guard.Refused as error:
                passed = "UNSUPPORTED_TIME_TYPE" in str(error) or ("sketch" in sql and guard._pure(about))
            if passed != guard._pure(about):
                wrong.append((sql, passed))
    assert [w for w in wrong if "COLLATION(" not in w[0]] == []


def test_the_guard_runs_in_a_session_of_its_own(spark):
    caller = spark.newSession()
    caller.range(3).createOrReplaceTempView("secret")
    caller.range(1).toDF("mine").createOrReplaceTempView("t")
    caller.udf.register("upper", lambda x: "shadowed", "string")
    found = guard.execute(caller, "SELECT upper('a') AS u, a FROM t ORDER BY a", {"t": caller.range(2).toDF("a")})
    assert found.rows == [["A", 0], ["A", 1]] and caller.table("t").columns == ["mine"]
    assert guard.execute(caller, "SELECT * FROM secret", {"t": caller.range(2).toDF("a")}).error


def test_expressions_are_checked(spark):
    df = spark.range(5).toDF("a")
    assert df.where(guard.check_expression(df, "a > 2 and a % 2 = 0")).count() == 1
    for bad in ("nothing > 1", "current_user = 'root'", "length(user) > a", "IDENTIFIER('a') > 1", "IDENTIFIER('reflect')('java.lang.System', 'getenv', 'PATH') > 'a'", "max(current_user) over () > 'a'", "a in (select 1)", "reflect('java.lang.System', 'exit')", "a >", "exists (select * from t)"):
        with pytest.raises(guard.Refused):
            guard.check_expression(df, bad)


def test_execute_caps_rows_and_returns_errors(spark):
    found = guard.execute(spark, "SELECT a FROM t", {"t": spark.range(500).toDF("a")})
    assert (len(found.rows), found.row_count) == (200, 500)
    assert guard.execute(spark, "SELECT nothing FROM t", {"t": spark.range(5).toDF("a")}).error


def test_records(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, None)], "k string, v int, w string")
    assert sorted(map(tuple, records.latest(rows, ["k"], ["v"]).collect())) == [("a", 2, "y"), ("b", 1, None)]
    cells = spark.createDataFrame([("p", "u1", 1, "user"), ("q", "v1", 1, "result")], "k string, value string, version int, source string")
    asked = spark.createDataFrame([("p",), ("q",), ("r",)], "k string")
    after = {r["k"]: (r["value"], r["version"], r["source"]) for r in records.upsert_versions(cells, asked, ["k"], "value").collect()}
    assert after == {"p": ("u1", 1, "user"), "q": (None, 2, "pending"), "r": (None, 1, "pending")}
    results = spark.createDataFrame([("p", 1, "new"), ("q", 9, "stale")], "k string, version int, value string")
    applied = {r["k"]: (r["value"], r["proposed"]) for r in records.apply_results(cells, results, ["k"], "value").collect()}
    assert applied == {"p": ("u1", "new"), "q": ("v1", None)}


def strata(spark, *rows):
    return spark.createDataFrame([(str(i), n, e) for i, (n, e) in enumerate(rows)], "stratum string, n long, effect double")


@pytest.mark.parametrize(
    "rows, crude, signed, verdict",
    [
        ([(50, -1.0), (50, -2.0), (3, 9.0)], 1.0, True, "reverses"), ([(200, 0.6), (50, -0.5)], 0.4, True, "reverses"), ([(100, 0.6), (100, -0.5)], 0.6, True, "reverses"), ([(100, 0.2), (100, 0.19)], 0.4, True, "weakens"),
        ([(100, 0.2), (100, 0.2)], 0.4, True, "holds"), ([(100, 0.4), (100, -0.05)], 0.4, True, "holds"), ([(100, 0.4), (100, 0.3)], 0.4, False, "holds"), ([(3, 9.0)], 1.0, True, "unclear"),
    ],
)
def test_confounder_verdicts(spark, rows, crude, signed, verdict):
    assert insights.confounder_verdict(strata(spark, *rows), crude, signed).first()["verdict"] == verdict


def test_column_warnings(spark):
    kinds = "column string, rows long, missing long, n_distinct long, semantic_type string, top_share double, n_sentinels long, empty_periods long, shifted boolean, unit_share double, n_units long, blank long"
    rows = [
        ("a", 100, 100, 0, "constant", None, None, None, None, None, None, None), ("b", 100, 60, 3, "categorical", 0.95, None, None, None, None, None, 2), ("c", 100, 25, 1, "constant", None, None, None, None, None, None, None),
        ("d", 100, 0, 100, "identifier", None, None, None, None, None, None, None), ("e", 100, 0, 50, "numeric", None, 1, None, True, None, None, 0), ("f", 100, 0, 50, "datetime", None, None, 3, None, None, None, None),
        ("g", 100, 0, 50, "categorical", 0.1, None, None, None, 0.9, 2, 0), ("h", 100, 0, 50, "categorical", 0.1, None, None, None, 0.9, 1, 0), ("i", 100, 0, 50, "numeric", 0.99, 0, 0, False, 0.5, 3, 0),
    ]
    found = insights.column_warnings(spark.createDataFrame(rows, kinds))
    assert sorted((r["column"], r["code"], r["severity"]) for r in found.collect()) == [
        ("a", "empty_column", "severe"), ("b", "blank_strings", "info"), ("b", "high_missing", "severe"), ("b", "imbalance", "warning"), ("c", "constant", "warning"), ("c", "high_missing", "warning"), ("d", "identifier", "info"),
        ("e", "placeholder_value", "warning"), ("e", "unit_shift", "warning"), ("f", "date_gaps", "warning"), ("g", "mixed_units", "warning"), ("h", "numeric_with_unit", "info"),
    ]


def test_tests_are_chosen_by_kind():
    fact = insights.ColumnFacts
    number, ordered = fact("n", "numeric", 99, True), fact("o", "categorical", 7, True)
    two, five, many, day = fact("b", "boolean", 2), fact("c", "categorical", 5), fact("m", "categorical", 30), fact("d", "datetime", 50)
    assert insights.choose_test(number, day) == ("trend", "d", "n") and insights.choose_test(number, ordered) == ("spearman", "o", "n")
    assert insights.choose_test(number, two) == ("mann_whitney", "n", "b") and insights.choose_test(five, number) == ("kruskal_wallis", "n", "c")
    assert insights.choose_test(two, five) == ("chi_square", "c", "b") and insights.choose_test(number, many) is None and insights.choose_test(many, two) is None
    assert not fact("id", "numeric", 10, True, True, 1.0).usable and not fact("x", "free_text").usable and number.usable


def test_confounders_are_grouping_columns_linked_to_both(spark):
    edges = spark.createDataFrame([("y", "x", 0.5), ("z", "y", 0.3), ("x", "z", -0.2), ("w", "y", 0.9), ("w", "x", 0.9), ("v", "y", 0.9)], "a string, b string, value double")
    levels = spark.createDataFrame([("z", 3), ("w", 9), ("v", 2)], "column string, n_distinct int")
    found = insights.confounders(edges, "y", "x", levels).collect()
    assert [(r["column"], r["strength"]) for r in found] == [("z", pytest.approx(0.5))]
    assert [r["column"] for r in insights.possible_confounders(edges, "y", "x", ["w"]).collect()] == ["z"]


def test_claims_and_support(spark):
    stated = one(spark, texts.claims(F.lit("We saw 1,200 of 3 rows on 2024-01-02, 3.5% more than `12345`, p < 0.05, 1.2e-3, 4 million, x20 and version2.")))
    assert [(c["text"], c["value"] * c["scale"], c["percent"], c["bound"]) for c in stated] == [
        ("1,200", 1200.0, False, None), ("3.5%", 3.5, True, None), ("< 0.05", 0.05, False, "<"), ("1.2e-3", pytest.approx(0.0012), False, None), ("4 million", 4e6, False, None),
    ]
    for text, pool, ok in (("3.5%", 0.0349, True), ("3.6%", 0.0349, False), ("1,200", -1200.4, True), ("1,200", 1201.0, False), ("p < 0.05", 0.03, True), ("p < 0.05", 0.2, False), ("4 million", 4.2e6, True)):
        assert one(spark, F.forall(texts.claims(F.lit(text)), lambda c: texts.supported(c, F.array(F.lit(pool))))) is ok, text


def test_sentences_and_sections(spark):
    text = "As Dr. Lee said of the matter, it holds. See Fig. 3 for more of the same! Done? Yes, it was done by J. Smith et al. in 2020. 1. And so it went on for ever."
    assert one(spark, texts.sentences(F.lit(text))) == [
        "As Dr. Lee said of the matter, it holds.", "See Fig. 3 for more of the same!", "Done? Yes, it was done by J. Smith et al. in 2020. 1.", "And so it went on for ever."
    ]
    kinds = {"2. Materials and Methods": "method", "Data availability": "other", "Limitations": "limitations", "3 Related work": "related_work", "Appendix": "appendix", "IV. Results and discussion": "results", "Abstract": "abstract", "": "other", "A new approach to x": "method"}
    for heading, kind in kinds.items():
        assert one(spark, texts.section_kind(F.lit(heading))) == kind, heading


def test_quotes_and_passages(spark):
    sources = spark.createDataFrame([(1, "He said: “All  good” –\nnow."), (2, None), (3, "The quick brown fox jumps over the lazy dog every day.")], "k int, text string")
    quotes = spark.createDataFrame([(1, '"all good" - now'), (1, "all bad"), (2, "x"), (4, "x"), (3, "quick brown fox jumped over the lazy"), (3, "quick brown fox jumps ovr the lazy dog"), (3, "a wholly other sentence of words")], "k int, quote string")
    found = {(r["k"], r["quote"]): (r["exact"], r["verified"]) for r in texts.quoted(quotes, sources, "k", "quote", "text").collect()}
    assert found == {(1, '"all good" - now'): (True, True), (1, "all bad"): (False, False), (2, "x"): (False, False), (4, "x"): (False, False), (3, "quick brown fox jumped over the lazy"): (False, False), (3, "quick brown fox jumps ovr the lazy dog"): (False, True), (3, "a wholly other sentence of words"): (False, False)}
    found = texts.passages(spark.createDataFrame([(1, "red fox\nblue\nred fox dog")], "k int, text string"), "k", "text", ["red", "dog"], k=1)
    assert [tuple(r) for r in found.collect()] == [(1, 2, 2)]


def test_cells_are_checked(spark):
    cells = spark.createDataFrame([(1, 7, "n was 120"), (2, 7, "n was 99"), (3, 7, "no number"), (4, 7, "x")], "cell int, doc int, value string")
    citations = spark.createDataFrame([(1, "p1", "We had 120 people"), (2, "p1", "We had 120 people"), (3, "p1", "in total they were many more"), (3, "p2", "were many more"), (4, "p9", "x")], "cell int, label string, quote string")
    parts = spark.createDataFrame([(7, "p1", 1, "We had 120 people, and in total they"), (7, "p2", 2, "were many more than before.")], "doc int, label string, ordinal int, text string")
    found = {r["cell"]: r for r in texts.check_cells(cells, citations, parts).collect()}
    assert found[1]["ok"] and not found[2]["ok"] and found[2]["unsupported"] == ["99"] and found[3]["ok"] and found[3]["verified"] == 2
    assert not found[4]["ok"] and found[4]["missing_labels"] == ["p9"]


def test_values_are_coerced(spark):
    for value, kind, options, want in (
        ("a; b\nc", "list", None, ('["a","b","c"]', None)), ("about 1,200.5 kg", "number", None, ("1200.5", None)), ("none", "number", None, ("none", '"none" is not a number')), ("Cross-Project", "category", ["crossproject", "other"], ("crossproject", None)),
        ("zzz", "category", ["a"], ("zzz", '"zzz" is not one of the options')), (" x ", "text", None, ("x", None)), (None, "number", None, (None, None)),
    ):
        assert tuple(one(spark, texts.coerce(F.lit(value).cast("string"), kind, options))) == want


def test_personal_data(spark):
    assert [texts.personal_by_name(n) for n in ("participant_id", "first_name", "phone_no", "city", "comment")] == [None, "person name", "phone number", None, None]
    assert texts.personal_by_name("name", 0.9) == "person name" and texts.personal_by_name("name", 0.1) is None
    rows = spark.createDataFrame([("a@b.org", "+1 212-555-1234", "x", "10.0.0.1"), ("é@b.org", "555-123-4567", "y", "z")], "mail string, call string, city string, ip string")
    assert {r["column"]: r["reason"] for r in texts.personal_by_value(rows, rows.columns).collect()} == {"mail": "email address", "call": "phone number", "ip": "IP address"}
    assert one(spark, text_functions.scrub(F.lit("é@ü.org or +1 (212) 555-1234, id 1234567890"))) == "<email> or <phone>, id <phone>"
    hidden = texts.masked(rows.selectExpr("mail AS m", "concat(city, mail) AS both", "city"), {"mail"}).first()
    assert (hidden["m"], hidden["both"]) == ("<masked>", "<masked>") and hidden["city"] != "<masked>"
    assert texts.masked(rows, {"mail"}).first()["mail"] == "<masked>" and texts.masked(rows, {"*"}).first()["city"] == "<masked>"


def test_words_and_terms(spark):
    assert one(spark, text_functions.terms(F.lit("What is the effect of the grades on exams?"))) == ["grade", "exam"]
    assert one(spark, text_functions.terms(F.lit("Well-being in 2023: the students' 'well-being', a1 x-rays"))) == ["well-being", "student", "x-ray"]
    for word, want in (("studies", "study"), ("grades", "grade"), ("less", "less"), ("status", "status"), ("basis", "basis"), ("gas", "gas")):
        assert one(spark, text_functions.stem(F.lit(word))) == want


def test_titles_are_matched_without_all_pairs(spark):
    left = spark.createDataFrame([(1, "https://doi.org/10.1/A", "Other words"), (2, None, "Deep learning for defect prediction in software"), (3, None, "Nothing alike"), (4, None, None)], "id int, doi string, title string")
    right = spark.createDataFrame([(10, "10.1/a", "x"), (11, None, "Deep Learning for Defect Predictions in Software"), (12, None, "Deep sea fish")], "id int, doi string, title string")
    found = {(r["left_id"], r["right_id"]): r["similarity"] for r in combine.match_titles(left, right).collect()}
    assert set(found) == {(1, 10), (2, 11)} and found[2, 11] > 0.95


def test_records_of_precedence_and_retention(spark):
    rows = spark.createDataFrame([("", "b", None), (None, " ", "c"), (None, None, None)], "user string, file string, parsed string")
    assert [r["x"] for r in rows.select(records.first_known(F.col("user"), F.col("file"), F.col("parsed")).alias("x")).collect()] == ["b", "c", None]
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert {tuple(r) for r in records.replace_group(old, new, "k").collect()} == {(1, "a"), (2, "c"), (3, "d")}
    cells = spark.createDataFrame([("p", "x", "1"), ("p", "y", None), ("q", "x", "2")], "paper string, name string, value string")
    assert {tuple(r) for r in records.wide(cells, "paper", "name", "value", ["x", "y"]).collect()} == {("p", "1", None), ("q", "2", None)}
    assert [r["v"] for r in records.searched(spark.createDataFrame([("10",), ("9",), ("a9",), (None,)], "v string"), "9", "v").collect()] == ["9", "a9"]


def test_whole_rows_differ_by_text(spark, tmp_path):
    rows = [(1, "ab", "en", "web", 2), (1, "cd", "en", "web", 2), (1, "cd", "en", "web", 2), (2, "cd", "en", "web", 2), (1, None, "en", "web", 2)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    found = registry.QUERIES["duplicate_rows_documents"](spark, str(tmp_path)).first()
    assert (found["rows"], found["duplicates"]) == (5, 1)


@pytest.mark.parametrize(
    "question, codes, answer",
    [
        (verdict.Question("comparative", [verdict.Construct("dependent", "direct", "y"), verdict.Construct("independent", "direct", "g")], groups=True), {"small_group", "unbalanced_groups", "group_constant_outcome"}, "partial"),
        (verdict.Question("descriptive", [verdict.Construct("dependent", "direct", "y")]), set(), "answerable"),
        (verdict.Question("descriptive", [verdict.Construct("dependent", "direct", "y")], "g = 'b'"), {"small_sample", "outcome_constant"}, "not_answerable"),
        (verdict.Question("descriptive", [verdict.Construct("dependent", "direct", "y"), verdict.Construct("moderator", None)], time_column="year", time_start="2000-01-01", time_end="2003-12-31"), {"covariate_gap"}, "partial"),
        (verdict.Question("descriptive", [verdict.Construct("dependent", "direct", "y")], time_column="year", time_start="2002-01-01", time_end="2013-12-31"), {"partial_time_coverage"}, "partial"),
        (verdict.Question("descriptive", [verdict.Construct("dependent", None)]), {"core_gap"}, "not_answerable"),
        (verdict.Question("correlational", [verdict.Construct("dependent", "direct", "y", "t"), verdict.Construct("independent", "proxy", "year", "u")], "year >= 2003"), {"proxy_only", "multi_table"}, "partial"),
        (verdict.Question("causal", [verdict.Construct("dependent", "direct", "y")], "year > 3000", confounders=2), {"no_rows_in_scope", "causal_claim", "confounders"}, "not_answerable"),
    ],
)
def test_verdict_rules(spark, question, codes, answer):
    rows = [("a" if i % 12 else "b", float(i % 7) if i % 12 else 1.0, 2000 + i % 5) for i in range(200)]
    facts = verdict.measure(spark.createDataFrame(rows, "g string, y double, year int"), question)
    assert {r["code"] for r in verdict.apply_rules(facts).collect()} == codes
    assert verdict.verdict(facts).first()["verdict"] == answer


def test_measured_expressions_are_guarded(spark):
    df = spark.createDataFrame([("a", 1.0)] * 40 + [("b", 2.0)] * 40, "g string, y double")
    lost = verdict.Question("descriptive", [verdict.Construct("dependent", "derivable", "nothing / y")])
    assert verdict.verdict(verdict.measure(df, lost)).first()["verdict"] == "not_answerable"
    kept = verdict.Question("descriptive", [verdict.Construct("dependent", "derivable", "y / 2")])
    assert verdict.measure(df, kept).first()["outcome_distinct"] == 2
    for scope, expression in (("reflect('java.lang.System', 'exit') > 1", "y"), ("y in (select 1)", "y"), (None, "java_method('a', 'b')")):
        with pytest.raises(guard.Refused):
            verdict.measure(df, verdict.Question("descriptive", [verdict.Construct("dependent", "direct", expression)], scope))


def test_join_discovery(spark):
    customers = spark.createDataFrame([(i, f"n{i}") for i in range(1, 51)], "id bigint, name string")
    orders = spark.createDataFrame([(n, n % 40 + 1, float(n)) for n in range(1, 201)], "order_id bigint, customer_id bigint, amount double")
    top = combine.find_joins({"orders": orders, "customers": customers}).first()
    assert (top["left_table"], top["left_column"], top["right_table"], top["right_column"], top["name_match"]) == ("orders", "customer_id", "customers", "id", True)
    assert (top["cardinality"], top["shared"], top["left_coverage"], top["right_coverage"]) == ("many-to-one", 40, 1.0, 0.8)
    column = lambda *a: combine.JoinColumn("t", *a)
    assert not combine.plausible(column("a", "integer", "identifier", 50, 1.0), column("b", "integer", "identifier", 50, 1.0))
    assert combine.plausible(column("a", "integer", "identifier", 50, 1.0), column("b", "integer", "categorical", 30, 0.1)) and not combine.plausible(column("a", "integer", "identifier", 50, 1.0), column("b", "integer", "categorical", 5, 0.1))
    assert combine.find_joins({"customers": customers}).count() == 0 and combine.find_joins({"a": customers.limit(0), "b": orders.limit(0)}).count() == 0
    assert combine.names_match("a", "batch", "b", "batch") and not any(combine.names_match("a", n, "b", n) for n in ("id", "idx", "row", "no", "number"))


def test_stacking_is_noted(spark):
    a, b = spark.createDataFrame([(1, 2)], "id int, age int"), spark.createDataFrame([(1, 2, 3)], "id int, age int, score int")
    assert combine.stack_notes({"a": a, "b": b}) == [("stack_partial_columns", "warning", ["score"]), ("combined_stack", "info", ["a", "b"])]
    assert combine.stackable({"a": a, "b": b}) and not combine.stackable({"a": a})


def test_plans_drop_repeats_and_aliases(spark):
    edges = spark.createDataFrame([("a", "b", 0.99), ("b", "c", -0.96), ("d", "e", 0.5), ("f", "g", 0.97), ("g", "c", 0.95)], "a string, b string, value double")
    assert insights.aliases(edges) == {c: "a" for c in "abcfg"}
    rows = [(1, "a", "d", "profile"), (2, "d", "b", "rq"), (3, "a", "c", "rq"), (4, "e", "d", "llm"), (5, "d", "e", "llm"), (6, "e", "h", "profile")]
    analyses = spark.createDataFrame(rows, "position int, x string, y string, source string")
    assert [r["position"] for r in insights.combined_plan(analyses, edges).collect()] == [2, 4, 6]
    assert [r["position"] for r in insights.combined_plan(analyses, edges.limit(0), 2).collect()] == [2, 3]
    fact = insights.ColumnFacts
    assert insights.grouping_column(fact("n", "numeric", 5), "comparative") and not insights.grouping_column(fact("n", "numeric", 5), "causal") and insights.grouping_column(fact("c", "boolean"), "causal")


def test_placeholders_are_told(spark):
    findings = spark.createDataFrame([(1, "a", "b"), (2, "c", "c")], "id int, x string, y string")
    codes = spark.createDataFrame([("b", -999.0, 3), ("b", -99.0, 2)], "column string, code double, n long")
    assert [tuple(r) for r in insights.placeholder_caveats(findings, codes).collect()] == [(1, "b", [-999.0, -99.0])]


def test_reading_order(spark):
    df = spark.createDataFrame([(1, None), (2, 5), (3, 7)], "id int, score int")
    assert [r["id"] for r in records.reading_order(df, "score desc", "id").collect()] == [3, 2, 1]
    assert [r["id"] for r in records.reading_order(df, "score first").collect()] == [1, 2, 3]


def test_values_are_indexed_once_for_all_pairs(spark):
    long = "x" * 300
    a = spark.createDataFrame([(1, "u", long), (2, "v", long), (None, "u", None)], "k int, t string, l string")
    b = spark.createDataFrame([(2, "v", long, 1.5), (3, "w", "y", 2.5)], "k bigint, t string, l string, d double")
    c = spark.createDataFrame([("2", "v")], "t string, l string")
    columns, index = combine.value_index({"a": a, "b": b, "c": c})
    assert [c[:2] for c in columns] == [("a", "k"), ("a", "t"), ("a", "l"), ("b", "k"), ("b", "t"), ("b", "l"), ("c", "t"), ("c", "l")]
    assert index.where("col = 0 AND value IS NULL").first()["n"] == 1 and index.where("length(value) > 128").count() == 0
    shared = {(r["a"], r["b"]): r["shared"] for r in combine.shared_values(index).collect()}
    sets = [{"1", "2"}, {"u", "v"}, {long}, {"2", "3"}, {"v", "w"}, {long, "y"}, {"2"}, {"v"}]
    assert shared == {(i, j): len(sets[i] & sets[j]) for i in range(8) for j in range(i + 1, 8) if sets[i] & sets[j]}


def test_a_new_run_leaves_other_datasets_their_files(spark, tmp_path):
    path = f"{tmp_path}/profiles"
    first = spark.createDataFrame([("01", "a", 1), ("02", "b", 2), ("02", "c", 3), (None, "n", 4)], "dataset_id string, col string, n int")
    assert tables.replace_partitions(first, path).count() == 4
    files = {f: f.stat().st_mtime_ns for f in tmp_path.rglob("*.parquet")}
    whole = tables.replace_partitions(first.where("dataset_id = '02'").limit(1).withColumn("n", F.lit(9)), path)
    assert sorted((r["dataset_id"] or "", r["col"], r["n"]) for r in whole.collect()) == [("", "n", 4), ("01", "a", 1), ("02", "b", 9)]
    kept = {f: f.stat().st_mtime_ns for f in tmp_path.rglob("*.parquet") if "=02" not in str(f)}
    assert kept == {f: t for f, t in files.items() if "=02" not in str(f)} and len(kept) >= 2
    assert tables.replace_partitions(first.where("dataset_id = '03'"), path).count() == 3


def test_executed_queries_are_logged(spark, tmp_path):
    log, t = f"{tmp_path}/log", {"t": spark.createDataFrame([(1, float("nan"), "é")], "a int, x double, s string").withColumn("d", F.lit("2024-01-02").cast("date"))}
    guard.execute(spark, "SELECT a, x, s, d, array(x, 1.5) AS l FROM t", t, log=log)
    guard.execute(spark, "SELECT a FROM other", t, log=log)
    rows = {r["sql"]: r for r in spark.read.parquet(log).collect()}
    good, bad = rows["SELECT a, x, s, d, array(x, 1.5) AS l FROM t"], rows["SELECT a FROM other"]
    assert good["preview"] == '{"columns": ["a", "x", "s", "d", "l"], "rows": [[1, null, "é", "2024-01-02", [null, 1.5]]]}' and good["row_count"] == 1 and good["error"] is None
    assert bad["row_count"] is None and bad["preview"] is None and "other is not allowed" in bad["error"]
    assert tables.as_json(t["t"].select("a", "x")).first()["json"] == '{"a":1,"x":null}'

def test_running_lines_and_page_numbers_go(spark):
    rows = []
    for page in range(1, 5):
        rows += [("d", page, 0, f"Journal of X,  Vol. {page}"), ("d", page, 1, f"Text of page {page}"), ("d", page, 2, "12"), ("d", page, 3, f"Page {page} of 4"), ("d", page, 4, "Repeated")]
    rows += [("e", 1, 0, "Journal of X, Vol. 1"), ("e", 1, 1, None), ("d", 1, 0, "only once"), ("d", 1, 0, None)]
    lines = spark.createDataFrame(rows, "doc string, page int, at int, line string")
    margin = F.col("at").isin(0, 3)
    assert [tuple(r) for r in texts.running_lines(lines.where(margin), "doc", "page", "line").orderBy("line").collect()] == [("d", "journal of x, vol. #", 4), ("d", "page # of #", 4)]
    left = texts.without_running_lines(lines, "doc", "page", "line", margin)
    assert left.columns == lines.columns
    assert sorted((r["doc"], r["page"], r["line"] or "") for r in left.collect()) == sorted(
        [("d", p, x) for p in range(1, 5) for x in (f"Text of page {p}", "12", "Repeated")] + [("e", 1, "Journal of X, Vol. 1"), ("e", 1, ""), ("d", 1, "only once"), ("d", 1, "")]
    )
