"""The syntax chunkers, run through the column function that the chunk rows use."""

from pyspark.sql import functions as F

from tidemark.operators import chunk

SOURCE = "import os\n\n\nclass A:\n    def b(self):\n        return 1\n\n    async def c(self):\n        return 2\n\n\ndef d():\n    pass\n"


def test_python_runs_its_syntax_chunker(spark):
    rows = spark.createDataFrame([(1, SOURCE, "python"), (2, "def broken(:\n", "python"), (3, "function d() {}\n", "javascript")], "id long, text string, lang string")
    got = {r["id"]: r["c"] for r in rows.select("id", chunk.chunk_udf(F.col("text"), F.col("lang"), F.lit(None).cast("string")).alias("c")).collect()}
    assert got[1]["quality"] == "syntax" and [(c["breadcrumb"], c["start_line"], c["end_line"]) for c in got[1]["items"]] == [("A > b", 5, 6), ("A > c", 8, 9), ("d", 12, 13)]
    assert got[2]["parse_status"] == "crashed_fallback" and got[3]["quality"] == "syntax"


def crumbs(source, language):
    found, status, quality = chunk.chunk(source, language, None)
    assert status == "ok" and quality == "syntax"
    lines = source.split("\n")
    for c in found:
        assert c["text"].split("\n")[0] in lines[c["start_line"] - 1] and c["text"].split("\n")[-1] in lines[c["end_line"] - 1]
    return [(c["breadcrumb"], c["kind"]) for c in found]


def test_javascript():
    assert [c for c, _ in crumbs("function foo() { return 1 }\nclass A { bar() { return 2 } }\n", "javascript")] == ["foo", "A > bar"]
    source = """// function no() {
const s = "function no() {", r = /function no\\(\\) {/;
export async function* gen(a, b = {x: 1}) { if (a) { call(b) } }
class B extends A {
  static async one(x) { for (const y of x) { y() } }
  get two() { return `}${1}` }
  #three() {}
  constructor() { super() }
}
const o = { m() { return 1 } }
class Empty {}
"""
    assert crumbs(source, "javascript") == [
        ("gen", "generator_function_declaration"), ("B > one", "method_definition"), ("B > two", "method_definition"), ("B > #three", "method_definition"),
        ("B > constructor", "method_definition"), ("m", "method_definition"), ("Empty", "class_declaration"),
    ]


def test_typescript():
    source = """export interface Shape<T> { area(): number; name: string }
type Id = string | { id: number }
enum Color { Red, Green }
export default class Box<T> implements Shape<T> {
  private x: number = 1
  area(): number { return this.x }
  static of<U>(u: U): Box<U> { return new Box() }
}
export function make(n: number): Box<number> { return Box.of(n) }
"""
    assert crumbs(source, "typescript") == [
        ("Shape", "interface_declaration"), ("Id", "type_alias_declaration"), ("Color", "enum_declaration"), ("Box > area", "method_definition"), ("Box > of", "method_definition"), ("make", "function_declaration"),
    ]


def test_go():
    source = """package p

type Point struct {
\tX, Y int
}

type Names []string

func New(x int) (*Point, error) {
\treturn &Point{x, 0}, nil // }
}

func (p *Point) Move(d int) { p.X += d; s := `}` ; _ = s }
"""
    assert crumbs(source, "go") == [("type_declaration", "type_declaration"), ("type_declaration", "type_declaration"), ("New", "function_declaration"), ("Move", "method_declaration")]


def test_rust():
    source = """pub struct P<'a> { x: &'a str }
struct Unit;
#[derive(Debug)]
enum E { A, B }
impl<'a> P<'a> {
    pub fn get(&self) -> &'a str { let c = '{'; let r = r#"}"#; self.x }
    const fn two() -> i32 { 2 }
}
trait T { fn f(&self); fn g(&self) -> i32 { 1 } }
mod inner { pub(crate) async fn h() {} /* { /* { */ */ }
"""
    assert crumbs(source, "rust") == [
        ("P", "struct_item"), ("Unit", "struct_item"), ("E", "enum_item"), ("impl_item > get", "function_item"), ("impl_item > two", "function_item"),
        ("T > f", "function_item"), ("T > g", "function_item"), ("inner > h", "function_item"),
    ]


def test_ruby():
    source = """module M
  class A < B
    def one(x)
      return 1 if x
      [1].each do |y|
        puts "end #{y}"
      end
    end

    def self.two = 2

    def three?
      z = if true
        1
      end
      while z do z = nil end
    end
  end
end

def top; 1; end
"""
    assert crumbs(source, "ruby") == [("M > A > one", "method"), ("M > A > two", "singleton_method"), ("M > A > three?", "method"), ("top", "method")]


def test_java():
    source = """package p;
import java.util.*;
@Deprecated
public class A<T> extends B {
    private final Map<String, List<T>> m = new HashMap<>();
    public A(int x) { super(x); run(); }
    @Override
    public <U> List<U> one(final U[] a, int b) throws IOException { if (b > 0) { return two(); } return null; }
    abstract void two();
    enum Color { RED, GREEN }
    static class Inner { int f() { return 1; } }
}
interface I { void g(); default int h() { return '}'; } }
record R(int a, int b) {}
"""
    assert crumbs(source, "java") == [
        ("A > A", "constructor_declaration"), ("A > one", "method_declaration"), ("A > two", "method_declaration"), ("A > Color", "enum_declaration"), ("A > Inner > f", "method_declaration"),
        ("I > g", "method_declaration"), ("I > h", "method_declaration"), ("R", "record_declaration"),
    ]


def test_broken_and_slow_texts_fall_back(monkeypatch):
    for language, source in [("javascript", "function f() { return 1"), ("java", "class A { void f() { } } }"), ("ruby", "def f\n  1\n"), ("python", "def f(:\n")]:
        found, status, quality = chunk.chunk(source, language, None)
        assert found and status == "crashed_fallback" and quality == "heuristic_fallback"
    assert chunk.chunk("const x = 1\n", "javascript", None)[1:] == ("heuristic_fallback", "heuristic_fallback")

    def hang(source):
        while True:
            pass

    monkeypatch.setattr(chunk, "PARSE_SECONDS", 0.1)
    monkeypatch.setitem(chunk.CHUNKERS, "go", hang)
    assert chunk.chunk("package p", "go", None)[1] == "crashed_fallback"
    assert chunk.chunk("package p", "go", "too_large") == ([], "ok", "skipped")


def test_heuristic_keeps_open_braces_together():
    body = "\n".join(f"  line {i};" for i in range(5))
    source = f"int f() {{\n{body}\n\n  more;\n}}\n\nnext"
    assert [(c["start_line"], c["end_line"]) for c in chunk.heuristic(source)] == [(1, 9), (11, 11)]
    assert chunk.heuristic("a\r\nb\r\rc") == chunk.heuristic("a\nb\n\nc")
