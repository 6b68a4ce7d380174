import json

import pytest

from tiersight.operators import textsearch
from tiersight.sources import files


def test_places_and_postcodes_of_units(spark):
    units = spark.createDataFrame([(1, 0, "Old Town", "old-town"), (2, 0, "Harbour", "harbour")], "entry int, level_rank int, name string, slug string")
    index = textsearch.build_index(units)
    schema = "place string, entry int, also array<string>"
    places = spark.createDataFrame([("Riad", 1, ["Ryad", "RIAD"]), ("Côte", 2, None)], schema)
    got = {tuple(r) for r in textsearch.attached_places(index, places).collect()}
    assert got == {("riad", "Riad", 1), ("ryad", "Riad", 1), ("cote", "Côte", 2)}
    with pytest.raises(Exception, match="place Sea is placed in a unit"):
        textsearch.attached_places(index, spark.createDataFrame([("Sea", 3, None)], schema)).collect()
    codes = spark.createDataFrame([("10000", 1, list("abcde")), ("10000", 2, [])], "postcode string, entry int, names array<string>")
    assert {(r.postcode, r.entry, tuple(r.names)) for r in textsearch.attached_postcodes(index, codes).collect()} == {("10000", 1, tuple("abcd")), ("10000", 2, ())}
    with pytest.raises(Exception, match="postcode 20000"):
        textsearch.attached_postcodes(index, spark.createDataFrame([("20000", 9, [])], codes.schema)).collect()


def test_search_of_names_places_codes_and_postcodes(spark):
    units = [(1, 1, "Old Town", "old-town"), (2, 2, "Harbour", "harbour"), (3, 1, "Riad Hill", "riad-hill"), (4, 3, "Harbour West", "harbour-west")]
    index = textsearch.build_index(spark.createDataFrame(units, "entry int, level_rank int, name string, slug string"))
    places = [("Riad", 1, None), ("Riad", 2, None), ("Petit Riad", 4, ["Ryad"]), ("Harbour", 1, None)]
    places = textsearch.attached_places(index, spark.createDataFrame(places, "place string, entry int, also array<string>"))
    postcodes = textsearch.attached_postcodes(index, spark.createDataFrame([("10000", 4, ["Quay"]), ("10000", 2, [])], "postcode string, entry int, names array<string>"))
    codes = spark.createDataFrame([("00001.0000", "000010000", 1), ("00000.0002", "000000002", 2)], "code string, digits string, entry int")

    def found(query, **options):
        rows = textsearch.search_all(index, spark.createDataFrame([(query,), (None,)], "query string"), codes, places, postcodes, **options).collect()
        return [(r.entry, r.matched, r.place_name) for r in sorted(rows, key=lambda r: r.place)]

    assert found("riad") == [(1, "place", "Riad"), (2, "place", "Riad"), (3, "prefix", None), (4, "place", "Petit Riad")]
    assert found("riad", placed_level=2)[:2] == [(2, "place", "Riad"), (1, "place", "Riad")]
    assert found("Harbour")[:3] == [(2, "exact", None), (1, "place", "Harbour"), (4, "prefix", None)]
    assert found("harbour", levels=[3]) == [(4, "prefix", None)]
    assert found("10000") == [(1, "code", None), (2, "postcode", None), (4, "postcode", None)] and found(" 2 ") == [(2, "code", None)]
    assert found("10000", limit=1) == [(1, "code", None)] and found("99") == found("", limit=3) == []
    bare = textsearch.search_all(index, spark.createDataFrame([("ryad",)], "query string"), codes)
    assert "place" not in {r.matched for r in bare.collect()}


def test_finding_files(spark):
    found = spark.createDataFrame([("01", "b", 1.0, None), ("01", "a", 1.0, "x"), ("01", "c", 3.0, "y"), ("02", "d", 2.0, "z")], "code string, id string, score double, kind string")
    bodies = {r.path: json.loads(r.body) for r in files.finding_files(found).collect()}
    assert [f["id"] for f in bodies["units/01.json"]["findings"]] == ["c", "a", "b"] and bodies["units/01.json"]["findings"][2]["kind"] is None
    assert bodies["units/02.json"] == {"code": "02", "findings": [{"id": "d", "score": 2.0, "kind": "z"}]}
    assert {tuple(r) for r in files.finding_index(found).collect()} == {("01", 3, 3.0), ("02", 1, 2.0)}
    assert files.finding_files(found.where("false")).count() == 0
