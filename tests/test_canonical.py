import json
import math

from pyspark.sql import functions as F

from tiersight.functions.canonical import canonical_json
from tiersight.operators import rollups


def plain(value, key=None):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        n = math.floor(value * (100 if key == "share" else 10) + 0.5) / (100 if key == "share" else 10)
        return int(n) if n == int(n) else n
    if isinstance(value, list):
        return [plain(v) for v in value]
    if isinstance(value, dict):
        return {k: plain(value[k], k) for k in sorted(value)}
    return value


def test_canonical_json(spark):
    schema = "z double, share double, text string, flag boolean, n long, list array<double>, inner struct<b:double,a:string>, m map<string,double>"
    rows = [
        (1.25, 0.055, 'quote " and \\ é\n', True, 12, [1.0, None, 2.449], ("x",), None),
        (-0.04, 0.004, "", False, -3, [], None, {"b": 1.0, "a": 2.75}),
        (100.0, 12.5, None, None, None, None, None, {}),
        (None, 1e6, "tab\t", True, 0, [10.0], None, {"é": 0.05}),
    ]
    data = [(z, s, t, f, n, xs, None if i is None else (0.96, "x"), m) for z, s, t, f, n, xs, i, m in rows]
    table = spark.createDataFrame(data, schema).withColumn("k", F.monotonically_increasing_id())
    whole = table.select("k", F.struct(*[c for c in table.columns if c != "k"]).alias("s"))
    got = [r.j for r in whole.select("k", canonical_json(F.col("s"), whole.schema["s"].dataType, 1, {"share": 2}).alias("j")).orderBy("k").collect()]
    names = ["z", "share", "text", "flag", "n", "list", "inner", "m"]
    for text, row in zip(got, data):
        value = {k: ({"b": v[0], "a": v[1]} if k == "inner" else v) for k, v in zip(names, row) if v is not None}
        assert text == json.dumps(plain(value), separators=(",", ":"), ensure_ascii=False).replace("\\u001f", "")


def test_equal_checks_have_equal_signatures(spark):
    rows = spark.createDataFrame([(1, 0.0501), (2, 0.0499), (3, 0.06)], "id int, share double")
    kind = rows.select(F.struct("share").alias("s")).schema["s"].dataType
    got = {r.id: r.j for r in rows.select("id", canonical_json(F.struct("share"), kind, 1, {"share": 2}).alias("j")).collect()}
    assert got[1] == got[2] == '{"share":0.05}' and got[3] == '{"share":0.06}'


def test_nearest_ranks_of_many_groups(spark):
    rows = [(g, k * 37 % 101 if k % 9 else None) for g, n in (("a", 1), ("b", 2), (None, 50), ("c", 777)) for k in range(1, n + 1)] + [("none", None)]
    table = spark.createDataFrame(rows, "g string, v long").repartition(5)
    shares = [0.9, 0.0, 0.5, 1.0]
    got = {r.g: (r.n, list(r.ranks)) for r in rollups.nearest_ranks(table, ["g"], "v", shares).collect()}
    want = {}
    for g in {g for g, _ in rows}:
        values = sorted(v for h, v in rows if h == g and v is not None)
        if values:
            want[g] = (len(values), [values[min(len(values) - 1, math.floor(len(values) * q))] for q in shares])
    assert got == want
    assert rollups.nearest_ranks(table.where("false"), ["g"], "v", shares).count() == 0
