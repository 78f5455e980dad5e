import json
import random

import pytest
from pyspark.sql import functions as F

from stowage.functions.payload import payload_udf, register_sql, replace_cell, structured_replace
from tests.php import Std, decode, encode

OLD, NEW = "https://old.example", "https://new-site.example.com"
PAIRS = [(OLD, NEW)]


def run(cell, pairs=PAIRS):
    encoded = [(a.encode(), b.encode()) for a, b in pairs]
    value, hits, kind = replace_cell(cell if isinstance(cell, bytes) else cell.encode(), encoded)
    return value.decode(), hits, kind


def test_plain_text():
    assert run(f"go to {OLD}/page") == (f"go to {NEW}/page", 1, "plain")
    assert run("nothing here") == ("nothing here", 0, "plain")


@pytest.mark.parametrize(
    "value, expected",
    [
        (f"{OLD}/path", f"{NEW}/path"),
        (
            {"logo": f"{OLD}/l.png", "count": 7, "on": True, "nested": {"u": OLD}},
            {"logo": f"{NEW}/l.png", "count": 7, "on": True, "nested": {"u": NEW}},
        ),
        (Std(home=OLD, n=42), Std(home=NEW, n=42)),
        (f"Ścieżka {OLD}/ąęś", f"Ścieżka {NEW}/ąęś"),
        ({OLD: "key stays"}, {OLD: "key stays"}),
    ],
)
def test_serialized(value, expected):
    text, _, kind = run(encode(value))
    assert kind == "serialized"
    assert decode(text.encode()) == expected


def test_serialized_inside_serialized():
    blob = {"blob": encode(f"{OLD}/deep").decode(), "x": 1}
    text, hits, _ = run(encode(blob))
    outer = decode(text.encode())
    assert decode(outer["blob"].encode()) == f"{NEW}/deep" and outer["x"] == 1 and hits == 1


def test_three_levels_with_a_serialized_leaf():
    deep = {"a": {"b": {"c": encode({"d": OLD}).decode()}}}
    top = decode(run(encode(deep))[0].encode())
    assert decode(top["a"]["b"]["c"].encode()) == {"d": NEW}


@pytest.mark.parametrize(
    "cell",
    [
        f'O:7:"Unknown":1:{{s:3:"url";s:{len(OLD)}:"{OLD}";}}',
        f'a:2:{{s:4:"safe";s:{len(OLD)}:"{OLD}";s:3:"obj";O:7:"Unknown":0:{{}}}}',
        f'C:3:"Foo":{len(OLD)}:{{{OLD}}}',
        f'a:2:{{i:0;s:{len(OLD)}:"{OLD}";i:1;C:3:"Foo":{len(OLD)}:{{{OLD}}}}}',
        f'a:2:{{i:0;E:7:"Foo:Bar";i:1;s:{len(OLD)}:"{OLD}";}}',
        'E:7:"Foo:Bar";',
    ],
)
def test_opaque_values_stay_as_they_are(cell):
    assert run(cell) == (cell, 0, "opaque")


def test_opaque_leaf_is_skipped_alone():
    leaf = f'O:7:"Unknown":1:{{s:3:"url";s:{len(OLD)}:"{OLD}";}}'
    text, hits, _ = run(encode({"leaf": leaf, "url": OLD}))
    assert decode(text.encode()) == {"leaf": leaf, "url": NEW} and hits == 1


def test_class_name_in_any_letter_case():
    cell = f'O:8:"STDclass":1:{{s:3:"url";s:{len(OLD)}:"{OLD}";}}'
    assert run(cell) == (f'O:8:"STDclass":1:{{s:3:"url";s:{len(NEW)}:"{NEW}";}}', 1, "serialized")


def test_json():
    text, hits, kind = run(json.dumps({"shipping": {"url": f"{OLD}/x"}, "id": 5}))
    assert json.loads(text) == {"shipping": {"url": f"{NEW}/x"}, "id": 5}
    assert hits == 1 and kind == "json"


def test_serialized_inside_json():
    cell = json.dumps({"meta": encode({"link": f"{OLD}/y"}).decode()})
    text, hits, _ = run(cell)
    assert decode(json.loads(text)["meta"].encode()) == {"link": f"{NEW}/y"} and hits == 1


def test_json_without_a_match_keeps_every_byte():
    cell = '{"a":  "keep me","b":[1, 2,3]}'
    assert run(cell) == (cell, 0, "json")


def test_json_keeps_objects_numbers_and_order():
    cell = f'{{"z": {{}}, "a": [], "n": 1.0, "big": 12345678901234567890, "e": 1e3, "u": "{OLD}"}}'
    expected = f'{{"z":{{}},"a":[],"n":1.0,"big":12345678901234567890,"e":1e3,"u":"{NEW}"}}'
    assert run(cell)[0] == expected


def test_json_escaped_slashes_and_line_separators():
    cell = '{"u":"https:\\/\\/old.example\\/x","s":"\\u2028\\u00e9\\u0001"}'
    assert run(cell)[0] == f'{{"u":"{NEW}/x","s":"\\u2028é\\u0001"}}'


def test_json_key_with_a_match_is_replaced_when_no_value_matched():
    cell = f'{{"{OLD}":1}}'
    assert run(cell) == (f'{{"{NEW}":1}}', 1, "json")
    both = f'{{"{OLD}":"{OLD}"}}'
    assert run(both) == (f'{{"{OLD}":"{NEW}"}}', 1, "json")


def test_json_around_an_opaque_value_is_left_alone():
    opaque = f'O:7:"Unknown":1:{{s:3:"url";s:{len(OLD)}:"{OLD}";}}'
    cell = json.dumps({"o": opaque, "n": 1})
    assert run(cell) == (cell, 0, "json")


@pytest.mark.parametrize(
    "cell",
    [f'[gallery link="{OLD}"]', f'{{"u":"{OLD}"', f'{{"u":NaN,"v":"{OLD}"}}', f'["\\ud800","{OLD}"]'],
)
def test_bracket_text_that_is_not_json(cell):
    assert run(cell) == (cell.replace(OLD, NEW), 1, "plain")


def test_json_depth():
    fits = "[" * 512 + f'"{OLD}"' + "]" * 512
    assert run(fits)[2] == "json"
    deeper = "[" + fits + "]"
    assert run(deeper) == (deeper.replace(OLD, NEW), 1, "plain")


@pytest.mark.parametrize(
    "cell",
    [
        " " + encode(OLD).decode(),
        encode({"u": OLD}).decode()[:-1],
        f's:5:"{OLD}";',
        f'a:1:{{i:0;s:{len(OLD)}:"{OLD}";i:1;N;}}',
    ],
)
def test_broken_serialized_text_gets_a_plain_replace(cell):
    assert run(cell) == (cell.replace(OLD, NEW), 1, "malformed")


def test_back_references_pass_through():
    cell = f'a:3:{{i:0;s:{len(OLD)}:"{OLD}";i:1;R:2;i:2;r:1;}}'
    assert run(cell) == (f'a:3:{{i:0;s:{len(NEW)}:"{NEW}";i:1;R:2;i:2;r:1;}}', 1, "serialized")


def test_float_text_stays():
    cell = f'a:3:{{i:0;d:0.10000000000000001;i:1;d:-INF;i:2;s:{len(OLD)}:"{OLD}";}}'
    assert "d:0.10000000000000001;i:1;d:-INF" in run(cell)[0]


def test_pairs_in_order_and_shorter_text():
    pairs = [(OLD, "https://x.io"), ("/var/www/old", "/srv/new"), ("x.io", "y.io")]
    text, hits, _ = run(encode({"url": OLD, "path": "/var/www/old/wp"}), pairs)
    assert decode(text.encode()) == {"url": "https://y.io", "path": "/srv/new/wp"} and hits == 3


def test_deep_nesting_of_strings_does_not_fail():
    cell = OLD
    for _ in range(1500):
        cell = encode(cell).decode()
    frame = payload_udf(PAIRS).func
    import pandas as pd

    row = frame(pd.Series([cell, None])).iloc[0]
    assert row["hits"] == 1 and row["kind"] == "serialized"


def random_value(rng: random.Random, level: int = 0):
    pick = rng.random()
    if level < 4 and pick < 0.35:
        made = Std() if rng.random() < 0.3 else {}
        for n in range(rng.randrange(4)):
            made[f"k{n}ż" if rng.random() < 0.5 or isinstance(made, Std) else n] = random_value(
                rng, level + 1
            )
        return made
    if pick < 0.5:
        return rng.choice([None, True, False, -3, 17, 1.5, -0.25])
    text = "".join(rng.choice(["a", "ż", " ", "日", OLD, '"', ";", "}", "\\"]) for _ in range(5))
    if level < 4 and rng.random() < 0.2:
        return encode({"in": text, "n": level}).decode()
    return "t" + text


def replaced(value):
    if isinstance(value, dict):
        return type(value)((k, replaced(v)) for k, v in value.items())
    if isinstance(value, str):
        if value.startswith("a:2:{"):
            return encode(replaced(decode(value.encode()))).decode()
        return value.replace(OLD, NEW)
    return value


def test_random_values_decode_to_the_replaced_value():
    rng = random.Random(7)
    for _ in range(400):
        value = {"top": random_value(rng), "more": random_value(rng)}
        text, _, kind = run(encode(value))
        assert kind == "serialized"
        assert decode(text.encode()) == replaced(value)


def test_column_agrees_with_the_cell_function(spark):
    rng = random.Random(11)
    cells = [encode({"v": random_value(rng)}).decode() for _ in range(60)]
    cells += [json.dumps({"v": OLD, "n": n}) for n in range(20)]
    cells += [f"{OLD} {n}" for n in range(20)] + [None, "", "N;", " b:1;", "{", f'C:1:"x":3:{{{OLD}}}']
    df = spark.createDataFrame([(c,) for c in cells], "c string")
    rows = df.select("c", structured_replace(F.col("c"), PAIRS).alias("r")).select("c", "r.*").collect()
    assert len(rows) == len(cells)
    for row in rows:
        if row.c is None:
            assert (row.value, row.hits, row.kind) == (None, None, None)
            continue
        value, hits, kind = run(row.c)
        assert (row.value, row.hits) == (value, hits)
        assert row.kind == kind or (row.kind == "unmatched" and hits == 0)


def test_sql_function(spark):
    register_sql(spark, "move_site", PAIRS)
    row = spark.sql(f"SELECT move_site('{encode(OLD).decode()}').value AS v").head()
    assert decode(row.v.encode()) == NEW
