import random
import time

import pytest

from loomspark.llm import grammars as G
from loomspark.llm import lexing as L
from loomspark.llm import shapes as H
from loomspark.llm import syntaxcheck as S

VALID = {
    "python": "def f(a):\n    return f'{a!r}'\n",
    "javascript": "// it's\nconst a = /[/']\\//g.test(`x${[1, 2].map((b) => `${b}`)}`);\nexport { a };\n",
    "typescript": "interface A { b?: string }\nexport const f = (x: A): number => x.b!.length;\n",
    "go": "package a\n\nimport \"fmt\"\n\nfunc (s *S) F(x map[string]int) error {\n\tfmt.Println(`{`)\n\treturn nil\n}\n",
    "rust": "/* a /* b */ c */\npub fn f<'a>(x: &'a str) -> char {\n    let s = r#\"\"{\"#;\n    '{'\n}\n",
    "java": "package a.b;\n\npublic class C<T> {\n    String s = \"\"\"\n        it's {\n        \"\"\";\n    char c = '\\'';\n}\n",
    "c": "#if 0\nit's {\n#endif\n#include <a.h>\nstatic int f(int a) {\n    return a ? '{' : 0; /* } */\n}\n",
    "cpp": "template <typename T> class A : public B<T> {\n  A() : x(1'000) {}\n  const char* s = R\"x({)\")x\";\n};\nint A<int>::f() const noexcept { return 0; }\n",
}


@pytest.mark.parametrize("language", VALID)
def test_valid_and_broken(language):
    text = VALID[language]
    assert S.fault_of(language, text) is None
    assert S.fault_of(language, text.rstrip() + "\n{")
    assert S.fault_of(language, "<<<<<<< HEAD\n" + text)
    assert S.fault_of(language, text + "\n)")


@pytest.mark.parametrize("language", [x for x in VALID if x != "python"])
def test_stretches_agree_with_the_whole(language):
    rng = random.Random(language)
    for _ in range(60):
        pieces = VALID[language].splitlines(keepends=True)
        for _ in range(rng.randrange(3)):
            pieces.insert(rng.randrange(len(pieces)), rng.choice(["/*\n", "*/\n", "`\n", '"""\n', "{\n", "])\n", "#if A\n", "#endif\n", "'\n"]))
        text = "".join(pieces) * 3
        cut = S.stretches(language, text, 20)
        assert "".join(cut) == text
        maps = [L.state_map(language, part, k == 0) for k, part in enumerate(cut)]
        folded = L.fold(maps)
        half = rng.randrange(1, len(maps)) if len(maps) > 1 else 0
        if half:  # any grouping gives the same
            two = L.fold([L.chain(language, maps[:half]), L.chain(language, maps[half:])])
            assert (folded and folded.row()) == (two and two.row())
        assert bool(S.fault_of(language, text, folded)) == bool(S.fault_of(language, text))


FILES = "filepath string, sha256 string, last_modified double, chunk_count int, project string, content string"
SOURCES = "filepath string, sha256 string, last_modified double, content string, language string, project string"


def tables(spark, long):
    go = VALID["go"]
    files = [
        ("a/x.go", "2", 2.0, 1, " P "), ("a/x.go", "1", 1.0, 1, "p"), ("a/y.go", "1", 1.0, 1, "p"), ("a/n.py", "1", 1.0, 1, None),
        ("a/b.md", "1", 1.0, 1, "p"), ("a/none.c", "1", None, None, "p"), (None, "1", 1.0, 1, "p"), ("a/long.go", "1", 1.0, 1, "p"), ("a/long2.go", "1", 1.0, 1, "p"),
    ]
    body = go + "".join(f"func f{k}() {{\n\treturn\n}}\n" for k in range(long))
    texts = [
        ("a/x.go", "1", "package a\nfunc f() {"), ("a/x.go", "2", go), ("a/y.go", "1", "package a\nfunc f() {"), ("a/y.go", "1", "package a\nfunc f() {"),
        ("a/n.py", "1", None), ("a/b.md", "1", "((("), ("a/long.go", "1", body), ("a/long2.go", "1", body + "}"),
    ]
    return (
        spark.createDataFrame([(*f, "clash") for f in files], FILES),
        spark.createDataFrame([(p, s, 0.0, t, "clash", "clash") for p, s, t in texts], SOURCES),
    )


def test_files(spark):
    files, sources = tables(spark, 4000)
    assert {r.filepath for r in S.invalid_files(files, sources).collect()} == {"a/y.go", "a/long2.go"}
    assert S.invalid_files(files.where("false"), sources).count() == 0
    chunks = spark.createDataFrame([("a/y.go", "Go"), ("a/x.go", None), ("a/y.go", "go ")], "filepath string, language string")
    got = {(r.project, r.language): (r.n_files, r.n_invalid) for r in S.rates(files, chunks, S.invalid_files(files, sources)).collect()}
    assert got == {("p", "go"): (1, 1), ("p", None): (5, 1), (None, None): (1, 0)}
    hints = spark.createDataFrame([("./a\\y.go", 1, "bad"), ("a/y.go", 1, None)], "filepath string, line int, message string")
    assert {r.filepath: r.n_hints for r in S.hinted(S.invalid_files(files, sources), hints).collect()} == {"a/y.go": 1, "a/long2.go": 0}


JAVA, C, RUST, GO = "class A {{\n    int f(int a) {{\n        {}\n    }}\n}}\n", "int f(int a) {{\n    {}\n}}\n", "fn f(a: i32) -> i32 {{\n    {}\n}}\n", "package a\n\nfunc f(a int) int {{\n\t{}\n}}\n"
BROKEN = [
    ("javascript", "{}\n", ["const x = ;", "f = x * ;", "g(a, b ||\n);", "const x;", "function f(a) { return a + ; }"]),
    ("typescript", "{}\n", ["const x: number = ;", "f = x * ;", "function f(a: number) { return a + ; }"]),
    ("java", JAVA, ["int x = ;", "return a + ;", "g(a * );", "int x = 1\n        return x;", "return a\n"]),
    ("c", C, ["int x = ;", "return a + ;", "int x = 1\n    return x;", "return a\n"]),
    ("cpp", C, ["auto x = ;", "return a + ;", "int x = g(a)\n    return x;"]),
    ("rust", RUST, ["let x = ;", "a + ;", "let x = a\n    return x;"]),
    ("go", GO, ["x := ;", "return a + ;", "x := a *\n}\n\nfunc g() {"]),
]
SOUND = [
    ("javascript", "{}\n", ["i++;\nlet x;", "f(...a, b,);", "const x = 1.;", "export { x as new };"]),
    ("typescript", "{}\n", ["const f = (a?: number, b?) => a!;\nlet x: Array<string>;", "type A =\n  | 'a'\n  | 'b';", "declare const x: number;"]),
    ("java", JAVA, ["List<?> x = g(a);\n        return a++;", "int[] x = {1, 2,};\n        return\n            a;"]),
    ("c", C, ["char *p = (char *)g;\n    return a++;", "int x =\n        a;\n    return x;", "for (;;)\n        a--;"]),
    ("cpp", C, ["auto g = [=] { return a; };\n    auto h = [&](const B&) { return 1.; };"]),
    ("rust", RUST, ["let x = &a[1..];\n    let y = |b: &mut i32| *b;\n    a", "let x = if a == 1 { 2 } else { 3 };\n    x"]),
    ("go", GO, ["x := g(a...)\n\ty := [...]int{1, 2,}\n\ti++\n\treturn a"]),
]


@pytest.mark.parametrize("language, frame, shapes", BROKEN)
def test_missing_operands_and_semicolons(language, frame, shapes):
    assert [s for s in shapes if S.fault_of(language, frame.format(s)) is None] == []


@pytest.mark.parametrize("language, frame, shapes", SOUND)
def test_sound_operators_and_line_ends(language, frame, shapes):
    assert [(s, f) for s in shapes if (f := S.fault_of(language, frame.format(s)))] == []


BODIES = {"c": C, "cpp": C, "java": JAVA, "rust": RUST, "go": GO, "javascript": "{}\n", "typescript": "{}\n"}
INVALID = [
    ("c", "x = 1\n    y = 2;"), ("c", "foo(1,,2);"), ("c", "else { a = 1; }"), ("c", "for (i = 0; i < 3) { }"), ("c", "int x = 3 4;"), ("c", "return a b;"),
    ("c", "foo(a b);"), ("c", "x = a ? b;"), ("c", "while () { }"), ("c", "do { a++; } (a < 3);"), ("c", "if a > 1 { return 1; }"), ("c", "return (a;)"),
    ("cpp", "foo(1,,2);"), ("cpp", "std::vector<int> v = {1 2};"), ("cpp", "for (auto x v) { }"), ("go", "foo(1,,2)"), ("go", "else { a = 1 }"),
    ("go", "if a > 1 return a"), ("go", "x := []int{1 2}"), ("go", "for i := 0; i < 3 { }"), ("go", "a = b c"), ("go", "func g() { }"), ("go", "x := map[string]int{\"a\" 1}"),
    ("java", "int x = 1\n        int y = 2;"), ("java", "foo(1,,2);"), ("java", "else { a = 1; }"), ("java", "foo(a b);"), ("java", "String s = \"a\" \"b\";"),
    ("java", "int[] x = {1 2};"), ("java", "switch (a) { case 1 return 2; }"), ("java", "try { a(); }"), ("java", "a = b +* c;"),
    ("rust", "foo(1,,2);"), ("rust", "else { 1 }"), ("rust", "let x = 1\n    let y = 2;"), ("rust", "if a > { 1 }"), ("rust", "match a { 1 => }"), ("rust", "for i 0..3 { }"), ("rust", "let x: = 3;"),
    ("javascript", "const x = {a: 1 b: 2};"), ("javascript", "foo(1,,2);"), ("javascript", "else { a(); }"), ("javascript", "const x = [1 2];"),
    ("javascript", "class A { x = 1 y = 2 }"), ("javascript", "for (let i = 0; i < 3) { }"), ("javascript", "x = a ? b;"), ("javascript", "const {a, b} c = d;"), ("javascript", "export const;"),
    ("typescript", "interface A { a: number b: string }"), ("typescript", "const x = {a: 1 b: 2};"), ("typescript", "function f(a: ) { }"), ("typescript", "class A { x: number = 1 y = 2 }"),
]
WHOLE = [("java", "class A { int x = 1 }\n", True), ("java", "class A { void f() { } int }\n", True), ("cpp", "struct B { int a; }\n", True), ("rust", "enum A { B C }\n", True)] + [
    ("cpp", "A::A() : x{1}, y(2) { }\nint operator+(const A& a, const A& b) { return a[0] - b; }\n", False),
    ("java", "@A(value = {1, 2}, b = @B)\nclass D<T extends E & F> implements H {\n  enum K { P, Q(1) { void t() { } }; K(int a) { } }\n  int[] z = {1, 2,}, w[] = {{1}};\n  int g(Object o) { return switch (o) { case Integer i when i > 1 -> i; case String s -> { yield 2; } default -> 0; }; }\n}\n", False),
    ("javascript", "if (a) /re'[/]/.test(b)\nconst x = [1, , 2], {c, ...d} = e\nclass B { static #p = 1; f = () => {} }\nlet y = a\n  ? b\n  : c\n", False),
    ("typescript", "abstract class A<T = string> implements B { private readonly x?: number; f?(a: number): void; [k: string]: any }\ntype F = { [K in keyof T]?: T[K] } & (A | B)[]\n", False),
    ("go", "package a\n\nfunc f(a int) int {\n\tif x, err := g(a); err != nil {\n\t\treturn 1\n\t} else if a > 1 {\n\t\treturn x &^ 2\n\t}\n\tm := map[string][]int{\"a\": {1, 2}}\n\treturn len(m)\n}\n", False),
]


def test_local_grammars_inside_bodies():
    assert [(lang, s) for lang, s in INVALID if S.fault_of(lang, BODIES[lang].format(s) if BODIES[lang] != "{}\n" else s + "\n") is None] == []
    assert [(t, S.fault_of(lang, t)) for lang, t, bad in WHOLE if bool(S.fault_of(lang, t)) != bad] == []


def test_stretches_find_what_the_whole_has():
    body = "int f%d(int a) {\n    int x = g(a, 1);\n    return x;\n}\n"
    text = "".join(body % k for k in range(40))
    for broken in (text, text.replace("f20(int a) {\n", "f20(int a) {\n    foo(1,,2);\n"), text.replace("f20(int a) {", "f20(int a {")):
        maps = [L.state_map("c", part, k == 0) for k, part in enumerate(S.stretches("c", broken, 100))]
        assert len(maps) > 10
        assert bool(L.verdict(L.fold(maps))) == bool(S.fault_of("c", broken)) == (broken is not text)


def test_patterns_jump_to_their_own_signs():
    code = "".join(
        f"export async function load{k}(first, second) {{\n  const found = await first.read(second[{k}], {{ limit: 10 }});\n"
        f"  if (!found || found.size > 0x1f) {{\n    return found.map((x) => x.value + {k}.5);\n  }}\n  return [];\n}}\n" for k in range(400)
    )
    assert G.patterns("javascript", code) is None

    def least(f):
        took = []
        for _ in range(5):
            began = time.process_time()
            f("javascript", code)
            took.append(time.process_time() - began)
        return min(took)

    # all patterns together against the cutting into tokens: 7 times as long where each is tried at every sign
    assert least(G.patterns) < 4 * least(H.letters)


TOLD = [
    ("javascript", "const a = 0x1g;", "malformed number"), ("javascript", "f(1n, 0b101, 1_000, .5e3, a1.b2)", None), ("java", "long a = 0x1FL + 09_1L;", None), ("rust", "let a = 1u65;", "malformed number"),
    ("c", "int a = 0b12;", "malformed number"), ("javascript", "class A { #p = 1; }", None), ("javascript", "a # b", "alien sign"), ("javascript", "a = <!b", None), ("javascript", "x\n  <!b", "alien sign"),
    ("javascript", "-  a: 1", "alien sign"), ("javascript", "a.if x", None), ("javascript", "if x", "malformed statement"), ("javascript", "$if (x)", None), ("javascript", "a; { \" : 1 }", "malformed statement"),
    ("javascript", "a = { \" : 1 }", None), ("javascript", "i++;", None), ("javascript", "i = a+;", "operator without operand"), ("javascript", "a = 1.;", None), ("javascript", "export { x as new };", None),
    ("javascript", "let a: string = b", "types in an untyped language"), ("javascript", "a!.b", "types in an untyped language"), ("javascript", "bas any", "words in a row"), ("javascript", "x(a, b) : T {", "types in an untyped language"),
    ("java", "a - ;", "operator without operand"), ("cpp", "a + ;", "operator without operand"), ("rust", "#[a] b", None), ("rust", "a @ b", None), ("rust", "x@ b", None), ("rust", "f()@ b", "alien sign"),
]


@pytest.mark.parametrize("language, code, fault", TOLD)
def test_patterns_tell(language, code, fault):
    assert G.patterns(language, code) == fault
