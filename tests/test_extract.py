"""Extraction and diffs on small sources."""

from sedimark.extract import diffs
from sedimark.extract.code import extract, extract_sources, functions_of
from sedimark.functions.snip import snip_quotes
from sedimark.operators import graph

GRAPH = """
#include "h.h"
static int add_numbers(int a, int b) { return a + b; }
int multiply_numbers(int a, int b)
{
    return a * b;
}
void print_result(int r) { printf("%d add_numbers(1)\\n", r); }
int calculate_sum(int n) { /* multiply_numbers(1, 2) */ return add_numbers(n, 1); }
int calculate_product(int n) { int r = multiply_numbers(n, 2); print_result(r); return r; }
void process_math(int x)
{
    print_result(add_numbers(calculate_sum(x), calculate_product(x)));
}
int main(void)
{
    process_math(3);
    print_result(calculate_sum(2)); // calculate_product(1)
    return 0;
}
"""


def test_call_graph(spark):
    sources = spark.createDataFrame([("a.c", "h", GRAPH)], "file_path string, git_file_hash string, content string")
    functions = functions_of(extract_sources(sources)).cache()
    calls = {r["name"]: sorted(r["calls"] or []) for r in functions.collect()}
    assert calls == {
        "main": ["calculate_sum", "print_result", "process_math"],
        "process_math": ["add_numbers", "calculate_product", "calculate_sum", "print_result"],
        "calculate_sum": ["add_numbers"],
        "calculate_product": ["multiply_numbers", "print_result"],
        "print_result": ["printf"],
        "add_numbers": [],
        "multiply_numbers": [],
    }
    edges = graph.call_edges(functions)
    assert [r["name"] for r in graph.entry_points(edges).collect()] == ["main"]
    assert {r["name"] for r in graph.callers(functions, "add_numbers").collect()} == {"calculate_sum", "process_math"}
    start = spark.createDataFrame([("main",)], "name string")
    assert {r["path"][-1] for r in graph.paths_to(edges, start, "multiply_numbers").collect()} == {"multiply_numbers"}
    assert functions.where("name = 'multiply_numbers'").first()["line_start"] == 4


def test_languages():
    rust = {f.name: f for f in extract("pub fn go(&self, x: i32) -> u8 { self.run(x) }\nstruct P { pub a: i32, b: Foo }", "x.rs")}
    assert rust["go"].parameters == [("&self", "Self"), ("x", "i32")] and rust["go"].calls == ["run"] and rust["go"].return_type == "u8"
    assert rust["P"].fields == [("a", "i32"), ("b", "Foo")]
    python = {f.name: f for f in extract("class A:\n    def f(self, x: int = 3):\n        '''g(1)'''\n        return h(x)\n", "x.py")}
    assert python["f"].calls == ["h"] and python["f"].line_end == 4
    c = {f.name: f for f in extract("struct s { int a, *b; unsigned f : 3; char n[4]; int (*cb)(void); };\ntypedef struct s *s_t;\nint f(const struct s *x, int (*cb)(int), ...);", "x.h")}
    assert c["s"].fields == [("a", "int"), ("b", "int *"), ("f", "unsigned"), ("n", "char[4]")]
    assert c["s_t"].kind == "typedef" and c["f"].parameters == [("x", "const struct s *"), ("cb", "int (*)(int)"), ("...", "...")]
    assert extract("int f(void) {}", "notes.txt") == [] and extract("", "a.c") == []


def test_declarations():
    assert diffs.declaration("static struct foo *bar(int a)") == ("function", "bar")
    assert diffs.declaration("struct foo {") == ("struct", "foo")
    assert diffs.declaration("#define M(x) x") == ("macro", "M")
    assert diffs.declaration("typedef int (*f)(void), g;") == ("typedef", "g")
    assert diffs.declaration("\tcall(a);") is None and diffs.declaration("out:") is None and diffs.declaration("if (x)") is None


DIFF = """diff --git a/a.c b/a.c
--- a/a.c
+++ b/a.c
@@ -10,9 +10,9 @@ int before(int x)
 {
 	int y;
-	old_call(y);
+	new_call(y);
 }
 
 static int
 after(int z)
 {
+	helper(z);
 }
diff --git a/README b/README
--- a/README
+++ b/README
@@ -1 +1 @@ x
-a()
+b()
"""


def test_diff():
    rows = diffs.parse_diff(DIFF)
    assert [(r[1], r[3], r[4]) for r in rows] == [("a.c", "before()", ["new_call", "old_call"]), ("a.c", "after()", ["helper"])]
    assert diffs.symbols_of_diff("Hi,\n\n" + DIFF) == ["after()", "before()"]
    assert diffs.symbols_of_diff("no diff, f() {") == [] and diffs.parse_diff("") == []
    text = diffs.unified("int f(void)\n{\n\treturn 1;\n}\n", "int f(void)\n{\n\treturn g();\n}\n", "a.c")
    assert diffs.symbols_of_diff(text) == ["f()"] and diffs.unified("a", "a", "a.c") == ""


def test_sql_functions(spark):
    diffs.register(spark)
    df = spark.createDataFrame([(DIFF,)], "d string")
    df.createOrReplaceTempView("diff_rows")
    found = spark.sql("SELECT h.modifies FROM diff_rows, LATERAL diff_hunks(d) h").collect()
    assert [r[0] for r in found] == ["before()", "after()"]
    assert spark.sql("SELECT diff_symbols(d) FROM diff_rows").first()[0] == ["after()", "before()"]


def test_snip():
    body = "On Monday X wrote:\n" + "> q\n" * 20 + "answer\n" + "> r\n" * 20
    short = snip_quotes(body).split("\n")
    assert short.count("[...]") == 2 and "answer" in short and short.count("> q") == 6
    assert snip_quotes("plain\ntext") == "plain\ntext" and snip_quotes("> only\n> quotes") == "> only\n> quotes"
