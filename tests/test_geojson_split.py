"""Feature collections in byte ranges: any split gives the same features, whatever strings and nesting hold."""

import io
import json
import random

import pytest

from townrisk.sources import files as S
from townrisk.sources import geojson_split as X

ODD = ['plain', 'quote " inside', 'back\\slash', 'ends with \\', '\\"', '{[', ']}', '"features":[{', 'ünïcode 日本', '\n\t', '\\\\', ', :']


def collection(rng, n, indent=None):
    feats = []
    for k in range(n):
        x = float(rng.randrange(50))
        feats.append({"type": "Feature", "properties": {"id": str(k), rng.choice(ODD): rng.choice(ODD), "n": rng.choice(ODD) * rng.randrange(4)},
                      "geometry": {"type": "Polygon", "coordinates": [[[x, 0.0], [x + 4, 0.0], [x + 4, 3.0 + k], [x, 3.0], [x, 0.0]]]}})
    whole = {"type": "FeatureCollection", "name": rng.choice(ODD), "crs": {"type": "name", "properties": {"features": [{"a": 1}], "name": "x"}},
             "others": [{"type": "Feature", "properties": {"id": "no"}}, [{"deep": {}}]], "features": feats, "tail": {"more": [1, {"z": "]"}]}}
    return json.dumps(whole, ensure_ascii=rng.random() < 0.5, indent=indent), feats


def plain_state(data):
    """(in_string, depth) before every byte."""
    out, inside, depth, escaped = [], False, 0, False
    for c in data:
        out.append((inside, depth))
        if inside:
            if escaped:
                escaped = False
            elif c == 92:
                escaped = True
            elif c == 34:
                inside = False
        elif c == 34:
            inside = True
        elif c in b"{[":
            depth += 1
        elif c in b"}]":
            depth -= 1
    return out


@pytest.mark.parametrize("seed", range(6))
def test_any_split_finds_the_same_parts(seed):
    rng = random.Random(seed)
    text, feats = collection(rng, 12, indent=rng.choice((None, 1)))
    data = text.encode()
    file, state = io.BytesIO(data), plain_state(data)
    whole = list(X.parts(file, 0, len(data), False, 0))
    assert [json.loads(t) for _, k, t in whole if k == "object" and b'"Polygon"' in t] == feats
    assert [t for _, k, t in whole if k == "array"] == [b"others", b"features"]
    for split in (1, 2, 7, 64, 1000):
        got, inside, depth = [], 0, 0
        for first in range(0, len(data), split):
            end = min(len(data), first + split)
            assert (bool(inside), depth) == state[first]     # from the sums alone
            piece, slashes = data[first:end], X.slashes_before(file, first)
            got += X.parts(file, first, end, bool(inside), depth)
            depth += int(X.marks(piece, slashes, bool(inside))[1].sum())
            inside = (inside + X.marks(piece, slashes, False)[2]) % 2
        assert got == whole


def test_same_rows_as_the_plain_reader(spark, tmp_path):
    rng = random.Random(9)
    for k in range(3):
        (tmp_path / f"f{k}.geojson").write_text(collection(rng, 40 * k)[0], encoding="utf-8")
    paths = [str(tmp_path / f"f{k}.geojson") for k in range(3)]
    want = sorted(map(str, S.load_geojson(spark, paths).collect()))
    assert len(want) == 120
    for split in (300, 5000, 1 << 20):
        assert sorted(map(str, S.load_geojson_split(spark, paths, split).collect())) == want
    assert X.ranges(spark, paths, 300).rdd.getNumPartitions() > 20   # many tasks a file
    (tmp_path / "empty.geojson").write_text('{"type": "FeatureCollection", "features": []}')
    assert S.load_geojson_split(spark, str(tmp_path / "empty.geojson")).count() == 0
    with pytest.raises(FileNotFoundError):
        S.load_geojson_split(spark, [])


def test_written_collections_are_whole(spark, tmp_path):
    out = str(tmp_path / "out")
    feats = spark.range(50).selectExpr("""concat('{"type":"Feature","properties":{"id":"', id, '"},"geometry":{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,0]]]}}') as feature""")
    X.write_collections(feats.repartition(3), out)
    found = [json.loads(p.read_text()) for p in (tmp_path / "out").glob("part-*")]
    assert sorted(int(f["properties"]["id"]) for c in found for f in c["features"]) == list(range(50))
    assert S.load_geojson_split(spark, out, 500).count() == 50
