"""Splitters on small cases and against plain rules; the memory pipeline against a plain computation."""

import json
import math
import random
import string

import pytest
from pyspark.sql import functions as F

from tideglass.operators import memory as M
from tideglass.operators import splitters as S


def plain(text, most):
    """One character at a time."""
    safe = set(string.punctuation) - set("([{<'\"") | {" "}
    out = []
    while len(text) > most:
        end = max((k for k in range(1, most + 1) if text[k - 1] in safe), default=most)
        run = 0
        while run < end and text[end - 1 - run] == "\\":
            run += 1
        if run % 2 and end > 1:
            end -= 1
        out.append(text[:end])
        text = text[end:].lstrip()
    return out + [text] if text else out


def test_plain_chunks():
    assert S.plain_chunks("abcdef", 3) == ["abc", "def"]
    assert S.plain_chunks("", 3) == []
    pick = random.Random(5)
    for _ in range(3000):
        text = "".join(pick.choices("ab (\\,\"\n.", k=pick.randrange(40)))
        most = pick.randrange(1, 9)
        assert S.plain_chunks(text, most) == plain(text, most)


def test_json_array_packs():
    assert S.json_array_packs('[1, 22, {"a": "é"}, 3]', 3) == ["[1, 22]", '[{"a": "é"}]', "[3]"]
    assert S.json_array_packs('{"a": 1}', 3) == S.json_array_packs("no", 3) == S.json_array_packs("[]", 3) == []
    pick = random.Random(7)
    for _ in range(300):
        items = [pick.choice([pick.randrange(10**6), "ü" * pick.randrange(9)]) for _ in range(pick.randrange(20))]
        packs = [json.loads(p) for p in S.json_array_packs(json.dumps(items), 20)]
        assert [x for p in packs for x in p] == items
        size = lambda pack: sum(len(json.dumps(x, ensure_ascii=False).encode()) for x in pack)
        assert all(len(p) == 1 or size(p) <= 20 for p in packs)
        assert all(size(a) + size(b[:1]) > 20 for a, b in zip(packs, packs[1:]))


def test_markdown_parts():
    text = "# A\nintro\n## B\nbbbb bbbb\n## C\ncccc cccc\n# D\nd\n"
    assert S.markdown_parts(text, 1000) == [text]
    assert S.markdown_parts(text, 22) == ["# A\nintro\n", "# A\n## B\nbbbb bbbb\n", "# A\n## C\ncccc cccc\n", "# D\nd\n"]
    assert S.markdown_parts("no heading " * 9, 10) == ["no heading " * 9]
    assert S.markdown_parts("", 10) == []


def test_xml_parts():
    text = "<r v='1'>" + "".join(f"<i>{k:03}</i>tail" for k in range(40)) + "</r>"
    parts = [S.ElementTree.fromstring(p) for p in S.xml_parts(text, 200)]
    assert [i.text for p in parts for i in p] == [f"{k:03}" for k in range(40)] and {p.get("v") for p in parts} == {"1"}
    assert len(parts) > 1 and all(len(p) <= 200 for p in map(S.ElementTree.tostring, parts))
    assert len(S.xml_parts("<r><a>" + "x" * 99 + "</a><b/></r>", 40)) == 2


@pytest.mark.parametrize(("text", "first"), [("['50']", "50"), ('["it\'s", 2]', "it's"), ("[7, 8]", "7"), (" x ", "x"), ("[", "["), (None, None)])
def test_first_of_list(spark, text, first):
    assert spark.range(1).select(S.first_of_list(F.lit(text).cast("string")).alias("x")).first()["x"] == first


def test_memory_pipeline(spark):
    pick = random.Random(3)
    words = "red green blue cat dog bird tree".split()
    rows = [
        (k % 2, i, 100 * k + i, pick.random(), " ".join(pick.choices(words, k=4)), pick.choice(["agent", "user", None]), pick.choice(["short_term", "long_term"]), pick.random() < 0.3, pick.choice([None, 3.0, 14.0]), pick.randrange(1, 9))
        for k in range(2)
        for i in range(30)
    ]
    schema = "key int, pos int, id int, score double, text string, layer string, memory_type string, external boolean, age_days double, tokens int"
    got = {(r["key"], r["rank"]): (r["id"], round(r["mmr"], 9)) for r in M.retrieve(spark.createDataFrame(rows, schema), "key", 14).collect()}
    want = {}
    for key in (0, 1):
        pool, seen = [], set()
        for r in sorted(r for r in rows if r[0] == key and r[5] not in ("user", "tenant")):
            if r[4] not in seen:
                seen.add(r[4])
                score = r[3] * (0.8 if r[7] else 1) * (0.5 ** (r[8] / 14) if r[8] is not None and r[6] == "short_term" and not r[7] else 1)
                pool.append((score, r[2], set(r[4].split()), r[9]))
        like = lambda a, b: len(a & b) / len(a | b)
        left, chosen, used = [], [], 0
        for c in pool:
            if all(like(c[2], d[2]) < 0.92 for d in left):
                left.append(c)
        while left and len(chosen) < 5:
            value = lambda c: 0.7 * c[0] + (0.3 * (1 - max(like(c[2], d[2]) for d in chosen)) if chosen else 0)
            best = max(left, key=value)
            used += best[3]
            if used <= 14:
                want[key, len(chosen) + 1] = best[1], round(value(best), 9)
            chosen.append(best)
            left.remove(best)
    assert got == want and not any(math.isnan(v) for _, v in got.values())


def test_json_chunks_fall_back_to_plain_text():
    """Commas of depth one first; from where there is none, and for what is no JSON, as plain text."""
    from tideglass.operators import chunking

    assert chunking.json_chunks('{"k": {"a": 1, "b": 22, "c": 333}}', 20) == ['k: {"a":1,"b":22,', '"c":333}']
    assert chunking.json_chunks('["one two three four"]', 10) == ['"one two ', 'three ', 'four"']
    assert chunking.json_chunks("no json, but words here", 9) == S.plain_chunks("no json, but words here", 9) == ["no json, ", "but ", "words ", "here"]
    assert chunking.json_chunks('[1, "a, b", {"c": [1, 2]}, null]') == ["1", '"a, b"', '{"c":[1,2]}', "null"] and chunking.json_chunks("17") == ["17"]
    text = '{"k": ' + "[1," * 50 + "2" + "]" * 50 + "}"
    assert "".join(chunking.json_chunks(text, 30)) == "k: " + "[1," * 50 + "2" + "]" * 50


def test_xml_that_is_none():
    assert S.xml_parts("<r><a></r>", 5) == ["<r><a></r>"] and S.xml_parts(" ", 5) == [] and S.xml_parts("", 5) == []
