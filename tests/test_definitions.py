"""Definitions of languages that are scanned: true ends, whatever stands in strings, comments and heredocs."""

import random

import pytest

from quarry.operators import chunk, chunkers

CASES = {
    "go": (
        'package main\n\nimport "fmt"\n\n// func no() {\nfunc add(a, b int) int {\n\treturn a + b // }\n}\n\n/*\nfunc no() {\n*/\nvar x = 1\n\ntype T struct {\n\ts string `json:"}"`\n}\ntype Id int\n\n'
        'func (t *T) Say() string {\n\tx := func() { fmt.Println("}{") }\n\tx()\n\treturn `\nfunc raw() {\n`\n}\n\nfunc long(\n\ta int,\n\tb int,\n) (int, error) {\n\treturn a, nil\n}\nfunc one() { return }\n',
        [("func", "add", 6, 8), ("type", "T", 15, 17), ("type", "Id", 18, 18), ("func", "Say", 20, 26), ("func", "long", 28, 33), ("func", "one", 34, 34)],
    ),
    "javascript": (
        "import x from 'y';\n\nexport default async function f(a = {b: '}'}) {\n  return `${a} {`;\n}\nclass A extends B {\n  m() { /* } */ }\n  n() {}\n}\nconst g = (x) => {\n  return x;\n};\nlet h = [\n  1,\n  2\n]\nvar i = 1, j = 2\nconst k = a\n  .map(x => x)\n  .join('')\nf();\n",
        [("function", "f", 3, 5), ("class", "A", 6, 9), ("const", "g", 10, 12), ("let", "h", 13, 16), ("var", "i", 17, 17), ("const", "k", 18, 20)],
    ),
    "java": (
        'package a.b;\nimport c.D;\n\n/** class No { */\npublic final class First<T extends Object> {\n  String s = "}";\n  char c = \'{\';\n  String t = """\n    } class Nope {\n    """;\n  int m() { return 1; }\n}\n\ninterface Second {\n  void x();\n}\n',
        [("class", "First", 5, 12), ("interface", "Second", 14, 16)],
    ),
    "rust": ("use a::b;\nstruct P;\npub struct Q<'a> {\n    s: &'a str,\n}\nimpl<'a> Q<'a> {\n    fn f(&self) -> char { '{' }\n}\nfn main() {\n    let s = r#\"}\" fn x() {\"#;\n}\n", [("struct", "P", 2, 2), ("struct", "Q", 3, 5), ("impl", "Q", 6, 8), ("fn", "main", 9, 11)]),
    "ruby": (
        "require 'x'\n\nclass User < Base\n  def name\n    return 1 if @x\n    items.each do |i|\n      puts \"end #{i}\"\n    end\n  end\n\n  def short = 1\n  # end\nend\n\ndef top(a)\n  s = <<~TEXT\n    end\n    def no\n  TEXT\n  v = if a\n    1\n  else\n    2\n  end\n  x.end?\nend\nmodule M\nend\n",
        [("class", "User", 3, 13), ("def", "top", 15, 26), ("module", "M", 27, 28)],
    ),
    "sql": (
        "-- create table no (\nCREATE TABLE users (\n  id INTEGER, -- ;\n  name TEXT DEFAULT ';'\n);\n\nCREATE INDEX idx_users_name ON users(name);\ncreate or replace function f() returns int as $$\nbegin\n  insert into t values (1);\nend;\n$$ language plpgsql;\nselect 1\nfrom users;\n",
        [("CREATE", "users", 2, 5), ("CREATE", "idx_users_name", 7, 7), ("create", "f", 8, 12), ("select", "", 13, 14)],
    ),
    "lua": ("local function f(a)\n  if a then return 1 end\n  for i = 1, 2 do\n    print('end')\n  end\nend\n-- function no()\nfunction M.g()\n  --[[ end ]]\n  repeat x() until y\nend\n", [("function", "f", 1, 6), ("function", "M.g", 8, 11)]),
    "bash": ("#!/bin/bash\n# f() {\nf() {\n  echo \"}\" ${x}\n  cat <<EOF\n}\nEOF\n}\nfunction g() {\n  :\n}\n", [("definition", "f", 3, 8), ("definition", "g", 9, 11)]),
    "cpp": ('#include <a>\nstatic int add(int a, int b) {\n  return a; // }\n}\nclass A : public B {\n  void f() {}\n};\nstruct S { int x; };\nint main()\n{\n  puts("{");\n}\n', [("definition", "add", 2, 4), ("class", "A", 5, 7), ("struct", "S", 8, 8), ("definition", "main", 9, 12)]),
    "css": ("/* a { */\n.a, .b {\n  color: red;\n}\n@media print {\n  .c { x: y }\n}\n#d { content: '}' }\n", [("definition", ".a, .b", 2, 4), ("definition", "#d", 8, 8)]),
    "hcl": ('resource "a" "b" {\n  x = "}"\n  y { z = 1 }\n}\nvariable "v" {}\n', [("resource", "", 1, 4), ("variable", "", 5, 5)]),
    "dockerfile": ("FROM golang:1.25\nWORKDIR /app\nCOPY . .\nRUN a && \\\n  b\nCMD [\"./app\"]\n", [("FROM", "", 1, 1), ("COPY", "", 3, 3), ("RUN", "", 4, 5), ("CMD", "", 6, 6)]),
    "kotlin": ("data class P(\n  val a: Int,\n)\nfun f(): Int = 1\nfun g() {\n  h { }\n}\nobject O {\n}\n", [("class", "P", 1, 3), ("fun", "f", 4, 4), ("fun", "g", 5, 7), ("object", "O", 8, 9)]),
    "protobuf": ("syntax = \"proto3\";\nmessage A {\n  message B { int32 x = 1; }\n}\nenum E { Z = 0; }\n", [("message", "A", 2, 4), ("enum", "E", 5, 5)]),
    "php": ("<?php\nfunction f() {\n  $x = '}'; # }\n  return <<<T\n}\nT;\n}\nabstract class A {\n  function g() {}\n}\n", [("function", "f", 2, 7), ("class", "A", 8, 10)]),
}


@pytest.mark.parametrize("language", sorted(CASES))
def test_definitions_end_where_they_end(language):
    text, want = CASES[language]
    assert chunk.definitions(text, language) == want


@pytest.mark.parametrize("language", sorted(chunk._STARTS))
def test_any_text_is_scanned(language):
    """Broken and hostile texts give definitions within the text, in order and apart, in linear time."""
    r = random.Random(1)
    bits = ["{", "}", "(", ")", '"', "'", "`", "\\", "\n", " ", "#", "//", "/*", "*/", "--", "$$", "<<X", "X", "func f", "def g", "end", "class A", "do", ";", "create table t", "é", "=begin", "[[", "]]", 'r#"']
    for _ in range(150):
        text = "".join(r.choice(bits) for _ in range(r.randint(0, 120)))
        at = 0
        for _, _, a, b in chunk.definitions(text, language):
            assert at < a <= b <= text.count("\n") + 1
            at = b
    for big in ('"' * 200_000, "/*" * 100_000, "<<X\n" * 20_000, "{" * 200_000, "'" * 200_000, "`" * 200_000, "$a$" * 60_000, "r#" * 100_000):
        chunk.definitions(big, language)


def test_long_definitions_are_split_at_lines(spark):
    body = "".join(f'\tx("{i} }}")\n' for i in range(400))
    df = spark.createDataFrame([("a.go", f"package a\n\nfunc Big() {{\n{body}}}\n\nfunc Small() {{}}\n")], "path string, content string")
    got = chunk.chunks(df).orderBy("start_line").collect()
    assert [r.name for r in got] == [f"Big (part {i + 1})" for i in range(len(got) - 1)] + ["Small"] and len(got) > 2
    assert got[0].start_line == 3 and got[-2].end_line == 404 and all(len(r.chunk.encode()) <= 3000 for r in got)


def test_chunkers_by_name_and_language(spark, monkeypatch):
    monkeypatch.setattr(chunkers, "CHUNKERS", dict(chunkers.CHUNKERS))
    monkeypatch.setattr(chunkers, "BY_LANGUAGE", {})
    df = spark.createDataFrame([("a/b.go", "func f() {\n}\n", 1), ("x.sql", "select 1;\n", 2), ("n.txt", "one\ntwo", 3), (None, None, 4)], "path string, content string, name int")
    plain = sorted(map(tuple, chunk.chunks(df.where("path is not null")).collect()))
    assert sorted(map(tuple, chunkers.applied(df.where("path is not null")).collect())) == plain
    assert {r.symbol for r in chunkers.applied(df, "lines").collect()} == {"chunk"}
    chunkers.register("whole", lambda text, path, language: [(language, "file", path, 1, text.count("\n") + 1, 0, text)])
    chunkers.choose("sql", "whole")
    assert {(r.path, r.symbol) for r in chunkers.applied(df.where("name < 4")).collect()} == {("a/b.go", "func"), ("x.sql", "file"), ("n.txt", "chunk")}
    with pytest.raises(ValueError, match="exists"):
        chunkers.register("lines", len)
    with pytest.raises(KeyError):
        chunkers.choose("go", "none")
    with pytest.raises(Exception, match="is no chunker"):
        chunkers.applied(df, "none").collect()
