"""Concatenated JSON by ranges of bytes against a decoder over the whole file."""

import json
import random

import pytest

from plumbline.sources import ranges


def whole(text):
    decoder, out, at = json.JSONDecoder(), [], text.find("{")
    while at >= 0:
        value, end = decoder.raw_decode(text, at)
        out.append((len(text[:at].encode()), value))
        at = text.find("{", end)
    return out


def made(rng):
    odd = ["}", "{", '"', "\\", "\\\\", "é", "日本", "}{", 'a"}', "\n", "x" * 30, "😀"]
    value = lambda deep: "".join(rng.choice(odd) for _ in range(rng.randint(0, 6))) if deep > 2 or rng.random() < 0.6 else rng.choice([{rng.choice(odd): value(deep + 1)}, [value(deep + 1), {"a": value(deep + 1)}], rng.random(), None, True])
    return {rng.choice(odd) + str(i): value(0) for i in range(rng.randint(0, 5))}


@pytest.mark.parametrize("size", [7, 64, 1000, 1 << 20])
def test_same_objects(spark, tmp_path, size):
    rng = random.Random(size)
    want = {}
    for name in ("a", "b"):
        text = "".join(rng.choice(["", " ", "\n", " , "]) + json.dumps(made(rng), ensure_ascii=rng.random() < 0.5) for _ in range(30 if size < 60 else 150))
        (tmp_path / f"{name}.json").write_text(text, encoding="utf-8")
        want |= {(name, at): value for at, value in whole(text)}
    (tmp_path / "empty.json").write_text("")
    rows = ranges.concatenated_ranges(spark, str(tmp_path), size)
    got = {(r.file.split("/")[-1][0], r.position): json.loads(r.object) for r in rows.collect()}
    assert got == want


def test_what_is_no_object(spark, tmp_path):
    (tmp_path / "x.json").write_text('no braces here {"a": 1}{not json}{"b": 2} {"c": "unfinished')
    for size in (5, 1000):
        assert [json.loads(r.object) for r in ranges.concatenated_ranges(spark, str(tmp_path), size).orderBy("position").collect()] == [{"a": 1}, {"b": 2}]
