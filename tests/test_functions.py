"""Hand-computed values."""

import re

import pytest
from pyspark.sql import functions as F

from lodestar.functions import extract, naming, text
from lodestar.operators import query


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(("name", "want"), [("CustomerOrder.plsql", "Customer_Order_API"), ("ABCFoo", "A_B_C_Foo_API"), ("Customer_Order", "Customer_Order_API"), ("FndSession", "Fnd_Session_API"), ("", ""), (None, None)])
def test_api_name(spark, name, want):
    assert one(spark, name, naming.api_name) == want


@pytest.mark.parametrize(("name", "want"), [("CUSTOMER_ORDER_API", "CUSTOMER_ORDER_API"), ("CustomerOrderAPI", "CUSTOMER_ORDER_API"), ("Customer_Order_API", "CUSTOMER__ORDER_API"), ("CustomerOrder", "CUSTOMER_ORDER"), ("", "")])
def test_api_key(spark, name, want):
    assert one(spark, name, naming.api_key) == want


def test_calls(spark):
    assert one(spark, "a Cust_Api.x; ORDER_API.y CUST_API.z", extract.api_calls) == ["CUST_API", "ORDER_API"]
    assert one(spark, "Cust_API.Get(x) Ord_API.New (y)", extract.qualified_calls) == ["Cust_API.Get", "Ord_API.New"]


@pytest.mark.parametrize(("n", "want"), [(0, []), (1, [0]), (10, list(range(10))), (11, [0, 2, 3, 4, 5, 6, 7, 8, 9, 10]), (12, [0, 2, 3, 4, 5, 6, 7, 8, 9, 11]), (20, [0, 3, 5, 7, 9, 11, 13, 15, 17, 19]), (37, [0, 4, 8, 12, 16, 20, 24, 28, 32, 36])])
def test_evenly_spaced(spark, n, want):
    assert one(spark, list(range(n)), lambda a: text.evenly_spaced(a, 10), "array<int>") == want


@pytest.mark.parametrize(("n", "count", "want"), [(7, 1, [0]), (7, 2, [0, 6]), (7, 3, [0, 3, 6]), (2, 1, [0]), (7, 0, [])])
def test_evenly_spaced_few(spark, n, count, want):
    assert one(spark, list(range(n)), lambda a: text.evenly_spaced(a, count), "array<int>") == want


MINI = """-- Date    Sign    History
-- 240115  ABCD    Added credit check
-- 240116  EFGH    Added credit check
-- 02/03/2024  IJKL  Fixed rounding in totals
PROCEDURE Calculate_Total (x_ IN NUMBER) IS
FUNCTION Get_Total RETURN NUMBER IS
PROCEDURE Build_Lines___ IS
   Customer_API.Get_Name(x_);
"""


def test_mini_source_file(spark):
    assert one(spark, MINI, extract.change_notes) == ["Added credit check", "Fixed rounding in totals"]
    assert one(spark, MINI, extract.declared_names) == ["PROCEDURE CALCULATE_TOTAL", "PROCEDURE BUILD_LINES___"]
    assert one(spark, MINI, extract.api_calls) == ["CUSTOMER_API"]


def test_undated_notes(spark):
    assert one(spark, "-- This one was created by hand\n-- short fixed\n-- nothing to see in here\n", extract.change_notes) == ["This one was created by hand"]


def test_excluded_names(spark):
    source = "\n".join(f"PROCEDURE {n} IS" for n in ("Get_Name", "Exist", "Validate_Item___", "New__", "Lock__", "Check_Insert___", "Calculate_Total"))
    assert one(spark, source, extract.declared_names) == ["PROCEDURE NEW__", "PROCEDURE CHECK_INSERT___", "PROCEDURE LOCK__", "PROCEDURE CALCULATE_TOTAL"]


def test_excerpt(spark):
    assert one(spark, MINI, extract.excerpt).startswith("Comments: Date    Sign    History | 240115  ABCD    Added credit check | ")
    assert one(spark, "x" * 3000, extract.excerpt) == "x" * 1000


def test_clean_source(spark):
    assert one(spark, "-- Some note\n--\n/* wrapped text */\nA_API.Do(x_, 'b');\n  y   :=  1.5;\n", text.clean_source) == "Some note wrapped text A_API.Do x_ b y 1.5"


def test_tokens_and_stopwords(spark):
    assert one(spark, "été, a_b 12-x", text.basic_tokens) == ["été", "a_b", "12", "x"]
    words = text.stopwords()
    assert {"the", "todo", "v", "7", "//"} <= words and "q" not in words and "invoice" not in words
    assert one(spark, ["The", "Invoice", "x", "42", "été", "line_no"], lambda a: text.identifier_tokens(a, words), "array<string>") == ["invoice", "line_no"]


def test_best_line(spark):
    source = "short\nthe credit check is done here\n  the credit limit of a customer  \n"
    line = lambda q: one(spark, source, lambda c: text.best_line(c, text.query_words(F.lit(q))))
    assert line("Credit check") == "the credit check is done here"
    assert line("credit") == "the credit check is done here"
    assert line("customer") == "the credit limit of a customer"
    assert line("") == line("absent") == "No preview available"
    assert len(one(spark, "y" * 300, lambda c: text.best_line(c, text.query_words(F.lit("y"))))) == 203


CLASSES = {"exact_match": ["CUSTOMER_ORDER_API", "ORDER", "okapi", "e.g. orders", "Error_SYS.Record_General"], "code_pattern": ["Error_SYS.", "select a from t", "procedure New___"], "semantic": ["how to validate customer", "process order"], "mixed": ["customer validation", ""]}


def test_query_types_agree(spark):
    queries = [(q, k) for k, qs in CLASSES.items() for q in qs]
    assert [query.analyse(q).type for q, _ in queries] == [k for _, k in queries]
    rows = spark.createDataFrame(queries, "q string, k string").select("q", "k", query.query_type(F.col("q")).alias("got"), query.expansions(F.col("q")).alias("e")).collect()
    assert all(r.got == r.k and r.e == query.analyse(r.q).expansions for r in rows)
    assert query.analyse("CUSTOMER_ORDER").expansions == ["CustomerOrder"]
    assert query.analyse("create order error").expansions == ["insert", "add", "new"]


def test_versions_and_paths(spark):
    assert one(spark, "25.1 beta/β-1", text.safe_version) == "25.1betaβ-1"
    assert one(spark, "_work\\a\\b.x", text.resolve_path) == "source/a/b.x"
    assert one(spark, "abcdefghi", text.estimated_tokens) == 2
    assert re.fullmatch("[0-9a-f]{16}", one(spark, "a", lambda c: text.content_hash(c, 16)))


def test_nulls(spark):
    for f in (extract.api_calls, extract.change_notes, extract.declared_names, extract.excerpt, text.clean_source, text.basic_tokens):
        one(spark, None, f)
