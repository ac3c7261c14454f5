import numpy as np

from nnprobe.functions.vectext import parse, render


def test_parse_fixtures(spark):
    df = spark.createDataFrame([("[1,2,3]",), (" [ 1 , 2 ] ",), ("[]",), ("1,2",), ("[1,x]",), (None,)], "s string")
    v, e = parse("s")
    got = [tuple(r) for r in df.select(v, e).collect()]
    assert got[0] == ([1.0, 2.0, 3.0], False)
    assert got[1] == ([1.0, 2.0], False)
    assert got[2] == ([], False)
    assert got[3] == (None, True)
    assert got[4] == (None, True)
    assert got[5] == (None, False)


def test_parse_render_roundtrip(spark):
    rng = np.random.default_rng(3)
    vals = [rng.normal(size=16).astype(np.float32).tolist() for _ in range(40)] + [[1e-30, 3.4e38, -0.0, 1.0]]
    df = spark.createDataFrame([(x,) for x in vals], "v array<float>")
    v, e = parse(render("v"))
    out = df.select("v", v.alias("p"), e.alias("err")).collect()
    for r in out:
        assert r.err is False
        assert r.p == r.v


def test_number_syntax(spark):
    from nnprobe.functions.vectext import parse
    cases = [("[1f]", True), ("[2d]", True), ("[1e40]", True), ("[-1e39]", True), ("[1e38]", False), ("[inf,-Infinity,NaN]", False),
             ("[+.5,1.,-0]", False), ("[1_0]", True), ("[0x1]", True), ("[1e]", True), ("[.]", True), ("[1e-60]", False), ("[ 1 ,\t2 ]", False)]
    df = spark.createDataFrame([(t,) for t, _ in cases], "t string")
    vec, err = parse("t")
    got = [(r.t, r.e) for r in df.select("t", err.alias("e"), vec.alias("v")).collect()]
    assert got == cases
