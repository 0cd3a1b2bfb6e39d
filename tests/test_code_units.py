"""Functions, calls and shapes of sources."""

import pytest

from tallyloom.operators import code_units

C = r'''
#define MAX(a, b) \
    ((a) > (b) ? (a) : (b)) /* { */
static const int table[] = { 1, 2, call(3) };
struct point { int x; };
enum kind { A, B };
int declared(int);
// int commented(void) { }
static inline struct point *
make(int x, void (*done)(int))
{
    char c = '{'; const char *s = "a \" }" "b";
    if (x) { done(x); obj->method(x, 0x1F); sizeof(x); }
    return helper(x) + other (1.5f);
}
int
main(void) { return make(1, 0)->x; }
'''
RUST = r'''
mod inner {
    pub struct S<'a> { s: &'a str }
    impl<'a> S<'a> {
        #[inline]
        pub(crate) const fn new(s: &'a str) -> Self { Self { s } }
        fn run<T: Fn(u32) -> u32>(&self, f: T) -> u32 where T: Copy {
            let r = r#"raw " }"#; let c = '\u{7d}';
            println!("{}", hidden(1));
            fn nested() { deep(); }
            vec![1, 2]; std::mem::swap(a, b); self.go().then(true); f(2_000)
        }
    }
}
trait T { fn declared(&self) -> u32; fn given(&self) -> u32 { 7 } }
unsafe extern "C" fn entry() { inner::start() }
fn Some() { }
'''


def test_c_functions():
    make, main = code_units.functions(C, "c")
    assert (make.name, make.line, make.end_line) == ("make", 9, 15)
    assert make.calls == ["done", "helper", "method", "other"] and main.calls == ["make"]
    assert make.literals == sorted(["'{'", '"a \\" }" "b"', "0x1F", "1.5f"])
    assert (main.name, main.line, main.end_line) == ("main", 16, 17)


def test_rust_functions():
    found = {f.name: f for f in code_units.functions(RUST, "rust")}
    assert list(found) == ["new", "run", "given", "entry"]
    assert found["run"].calls == ["deep", "f", "go", "swap", "then", "vec"] and found["entry"].calls == ["start"]
    assert found["run"].literals == sorted(['r#"raw " }"#', "'\\u{7d}'", '"{}"', "1", "2", "true", "2_000"])
    assert (found["new"].line, found["run"].line, found["run"].end_line, found["given"].line) == (6, 7, 12, 15)


def test_cpp_functions():
    source = 'namespace n { class A : public B { public: A(int x) : x_(x) { init(); } int get() const { return x_; } int x_; }; }\nint n::A::far(int y) { return R"x(a " } )x"[y]; }\nint v{3};'
    assert [f.name for f in code_units.functions(source, "cpp")] == ["A", "get", "far"]


def test_shapes():
    shape = lambda s: code_units.functions(s, "c")[0].shape
    one = shape("int f(int a) { return a + 1; }")
    assert one == shape("int  g(int count)\n{ /* x */ return count + 42; }")
    for other in ("int f(int a) { return a - 1; }", "int f(int a) { return (a + 1); }", "long f(int a) { return a + 1; }", 'int f(int a) { return a + "1"; }'):
        assert shape(other) != one


@pytest.mark.parametrize("bad", ["int f() {", "int f() { ) }", "int f() { \"open }"])
def test_sources_that_cannot_be_read(bad):
    with pytest.raises(ValueError):
        code_units.functions(bad, "c")


def test_units_of_works(spark):
    rows = [
        ("w", "a.c", "b1", "int f(int x) { return g(x) + f(x); } int f2(void) { return g(1); }"),
        ("w", "b.c", "b2", "int g(int x) { return twice(x); } int twice(int x) { return x; }"),
        ("w", "c.c", "b3", "int twice(int x) { return x; } int f(void) { return 1; } "),
        ("v", "a.c", "b1", "int g(void) { return unknown(); }"),
        ("v", "bad.c", "b4", "int g( {"),
        ("v", "worse.c", "b5", "}"),
        ("v", "notes.md", "b6", "int h() { }"),
    ]
    found = code_units.extract(spark.createDataFrame(rows, "work_id string, path string, blob string, text string"))
    got = {(r["work_id"], r["path"], r["symbol"]): (r["outgoing_names"], r["incoming_names"]) for r in code_units.units(found).collect()}
    assert got == {
        ("w", "a.c", "f"): (["f", "g"], []),
        ("w", "a.c", "f2"): (["g"], []),
        ("w", "b.c", "g"): (["twice"], ["f", "f2"]),
        ("w", "b.c", "twice"): ([], []),
        ("w", "c.c", "twice"): ([], []),
        ("w", "c.c", "f"): ([], []),
        ("v", "a.c", "g"): (["unknown"], []),
    }
    assert [r["warning"].split(":")[1].strip() for r in code_units.warnings(found).orderBy("warning").collect()] == ["bad.c", "worse.c"]
    assert code_units.warnings(found, 1).count() == 1


def test_namesakes_on_one_line(spark):
    rows = [("w", "a.c", "b", "int f(int x) { return one(); } int f(long x) { return two(); }")]
    found = code_units.extract(spark.createDataFrame(rows, "work_id string, path string, blob string, text string")).collect()
    assert [(r["symbol"], r["calls"]) for r in found] == [("f", ["one"])]
