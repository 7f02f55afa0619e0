from loomspark.llm import docpairs as D

CHUNKS = "id long, filepath string, chunk_type string, name string, qualified_name string, symbol_name string, content string, start_line int, end_line int, parent_id long, header string"
SYMBOLS = "name string, symbol_type string, filepath string, line int, signature string, id long"
REAL = "Merges sorted postings before scoring every candidate row."


def chunk(id_, path, text, name="f", kind="code"):
    return (id_, path, kind, f"def {name}", f"m.{name}", name, text, 1, text.count("\n") + 1 if text else None, None, "x")


CASES = [
    chunk(1, "a.py", f'def f(a):\n    """{REAL}"""\n    return a\n'),
    chunk(2, "a.py", "def f(a):\n    return a\n"),
    chunk(3, "a.py", 'def f(a):\n    """TODO"""\n    return a\n'),
    chunk(4, "a.py", f'def f(a):\n    x = 1\n    """{REAL}"""\n    return a\n'),
    chunk(5, "a.go", f"// {REAL}\nfunc f() {{\n}}\n"),
    chunk(6, "a.go", f"// {REAL}\n\nvar x = 1\n\nfunc f() {{\n}}\n"),
    chunk(7, "A.java", f"/**\n * {REAL}\n * @param a the thing to be merged in here\n */\n@Override\npublic int f(int a) {{\n}}\n"),
    chunk(8, "A.java", "/**\n * @param a the thing to be merged in here\n */\npublic int f(int a) {\n}\n"),
    chunk(9, "a.rs", f'#[doc = "{REAL}"]\n#[inline]\nfn f() {{}}\n'),
    chunk(10, "a.py", None),
    chunk(11, None, "def f(): pass"),
    chunk(12, "a.py", ""),
    chunk(13, "a.py", f'def f(a):\n    """{REAL}\n', kind="txt"),
]


MORE = [
    (chunk(21, "a.c", f"// {REAL}\nint counter = 0;\nint f(int a) {{\n}}\n"), False),
    (chunk(22, "a.c", f"int counter = 0;\n/* {REAL} */\nint f(int a) {{\n}}\n"), True),
    (chunk(23, "a.c", f"int counter = 0; // {REAL}\nint f(int a) {{\n}}\n"), False),
    (chunk(24, "a.go", f"var x = 1\n\n// {REAL}\nfunc f() {{\n}}\n"), True),
    (chunk(25, "a.go", f"// {REAL}\nvar x = 1\nfunc f() {{\n}}\n"), False),
    (chunk(26, "a.ts", f"const s = '/* no';\n/** {REAL} */\nexport const f = (a: number) => {{\n  return a;\n}};\n"), True),
    (chunk(27, "a.rs", f"/// {REAL}\n#[cfg(feature = \"x\")]\n#[inline(\n  always)]\npub fn f<'a>(x: &'a str) {{}}\n"), True),
    (chunk(28, "A.java", f"/** {REAL} */\n@Named(value = \"(\")\npublic\nint f(int a) {{\n  // other\n}}\n"), True),
    (chunk(29, "a.py", f'x = 1\ndef g():\n    pass\n\n@d\ndef f(a=")", *, b=[1]) -> "x":\n    # note\n    ("{REAL}"\n     " More.")\n'), True),
    (chunk(30, "a.py", f'def f(a): "{REAL}"\n'), True),
    (chunk(31, "a.py", f'def f(a):\n    "{REAL}".strip()\n'), False),
    (chunk(32, "a.cpp", f"// {REAL}\n#ifdef A\nint A::f(int a) : x{{1}} {{\n}}\n#endif\n"), True),
    (chunk(33, "a.c", f"// {REAL}\n// clang-format off\nint f(int a) {{\n}}\n"), True),
    (chunk(34, "a.c", f"int g(void) {{\n  // {REAL}\n}}\nint f(int a) {{\n}}\n"), False),
]


def test_intervening_statements_decide(spark):
    df = spark.createDataFrame([c for c, _ in MORE], CHUNKS)
    assert sorted(r.id for r in D.documented(df).collect()) == [c[0] for c, real in MORE if real]


def test_found_and_pairs(spark):
    df = spark.createDataFrame(CASES + CASES[:1], CHUNKS)
    symbols = spark.createDataFrame([("f", "def", "a.py", 1, "def f(a):", 9), ("f", "def", "a.go", 2, None, 9)], SYMBOLS)
    assert sorted(r.id for r in D.documented(df).collect()) == [1, 5, 7, 9]
    rows = {r.id: r for r in D.pairs(df, symbols).collect()}
    assert set(rows) == {1, 5, 7, 9}
    assert rows[1].signature == "def f(a):" and rows[5].signature is None
    assert "merges sorted postings" in rows[1].description.lower() and rows[1].code.startswith("def f")
    assert D.documented(df.where("false")).count() == 0


def test_partition_without_any_description(spark):
    df = spark.createDataFrame([chunk(2, "a.py", "def f(a):\n    return a\n"), chunk(41, "a.c", "int f(int a) {\n}\n")], CHUNKS).coalesce(1)
    symbols = spark.createDataFrame([], SYMBOLS)
    assert D.documented(df).count() == 0 and D.pairs(df, symbols).count() == 0
    both = df.union(spark.createDataFrame([chunk(1, "a.py", f'def f(a):\n    """{REAL}"""\n    return a\n')], CHUNKS))
    assert [r.id for r in D.documented(both).collect()] == [1]
