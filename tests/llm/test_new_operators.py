"""Conversation repair, embedding whitening and document fingerprints against brute force, and their edge cases."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from tideglass.llm import conversation_repair, lz_fingerprint, queries, whitening

# --- conversation repair ---


def brute_damage(rows):
    """rows: (conv_id, turn, role, text), nulls first by turn, in their order."""
    out = []
    for conv_id, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv_id, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def brute_audit(rows):
    """What one conversation's rows (turn, role, text), in order, give: counts, cost, letters, repaired hash."""
    seen, faults = set(), []
    for _, role, text in rows:
        plain = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not plain else "duplicate" if (role, text) in seen else "truncated" if plain[-1] not in ".!?" else None)
        seen.add((role, text))
    memo = {}

    def best(i, have, inserts=0):
        """Cheapest (cost, letters) from row i on, with these initials before."""
        state = have[-1:] if have else ""
        if (i, state, inserts) in memo:
            return memo[i, state, inserts]
        found = []
        if i == len(rows) and state in ("", "a"):
            found.append((0, ""))
        fit = "a" if state == "u" else "u"
        if inserts < 3:
            cost, letters = best(i, fit, inserts + 1)
            found.append((cost + 5, "I" + letters))
        if i < len(rows):
            cost, letters = best(i + 1, have)
            found.append((cost + 2, "D" + letters))
            if faults[i] not in ("blank", "duplicate"):
                extra, initial = 5 * (faults[i] == "truncated"), rows[i][1][:1]
                if initial == fit or initial == "s" and state == "":
                    cost, letters = best(i + 1, initial)
                    found.append((cost + extra, "K" + letters))
                cost, letters = best(i + 1, fit)
                found.append((cost + 1 + extra, "R" + letters))
        memo[i, state, inserts] = min(found, default=(math.inf, ""))
        return memo[i, state, inserts]

    cost, letters = best(0, "")
    state, lines, left = "", [], iter(rows)
    for letter in letters:
        row = None if letter == "I" else next(left)
        if letter == "D":
            continue
        fit = "a" if state == "u" else "u"
        role = row[1] if letter == "K" else {"a": "assistant", "u": "user"}[fit]
        lines.append(f"{role}:{row[2] if row else ''}")
        state = role[:1]
    turns = [t for t, *_ in rows if t is not None]
    initials = [r[:1] for _, r, _ in rows]
    return {
        "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        **{k: faults.count(k) for k in ("blank", "duplicate", "truncated")},
        "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
        "cost": cost, "audit": letters, "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    }


def in_turn(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).digest()))


def check_audits(got, rows, ids):
    by = {i: [] for i in ids}
    for conv_id, *rest in rows:
        by.setdefault(conv_id, []).append(tuple(rest))
    assert len(got) == len(by)
    for r in got:
        assert {k: r[k] for k in r.asDict() if k != "conv_id"} == brute_audit(in_turn(by[r["conv_id"]])), r["conv_id"]


def test_repair_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    check_audits(queries.op11_conversation_repair(spark, sf_dir).collect(), brute_damage(rows), {r[0] for r in rows})


SCHEMA = "conv_id bigint, turn bigint, role string, text string, digest string, start int"


def random_rows(seed, n, ids):
    rng = random.Random(seed)
    texts = ["", " ", None, "one.", "two!", "three", "four?", "é中. ", "five"]
    return [(rng.choice(ids), rng.choice([None, *range(12)]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), rng.choice(texts), "x", 1) for _ in range(n)]


@pytest.mark.parametrize("slab", [conversation_repair._SLAB_BITS, 1])
def test_repair_random(spark, monkeypatch, slab):
    """Ties, nulls, repeated rows, clashing names; with slabs of two rows, that every conversation spans."""
    monkeypatch.setattr(conversation_repair, "_SLAB_BITS", slab)
    monkeypatch.setattr(conversation_repair, "_COPIES", 3)
    rows = random_rows(slab, 400, [None, *range(25)]) + [(77, 5, "user", "same.", "x", 1)] * 20
    df = spark.createDataFrame(rows, SCHEMA)
    plain = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x, *_ in rows]
    check_audits(conversation_repair.audit(df).collect(), plain, [])
    check_audits(conversation_repair.audit(conversation_repair.damage(df), df).collect(), brute_damage([r[:4] for r in rows]), {r[0] for r in rows})
    by = {}
    for r in sorted(conversation_repair.repair(df).collect(), key=lambda r: r["position"]):
        by.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    for r in conversation_repair.audit(df).collect():
        assert r["repaired_sha256"] == hashlib.sha256("\n".join(by.get(r["conv_id"], [])).encode()).hexdigest()


def test_repair_edges(spark):
    """No rows; a conversation whose rows are all dropped; one long conversation; a very long text."""
    df = spark.createDataFrame(random_rows(3, 5, [1]), SCHEMA)
    assert conversation_repair.audit(df.where("false")).collect() == []
    (r,) = conversation_repair.audit(df.where("false"), df).collect()
    assert (r["gaps"], r["cost"], r["audit"], r["repaired_sha256"]) == (0, 0, "", hashlib.sha256(b"").hexdigest())
    rows = [(9, t, ("user", "assistant")[t % 2], f"turn {t}." if t % 7 else "cut off", "x", 1) for t in range(5000)] + [(8, 0, "user", "long. " * 200_000, "x", 1)]
    got = conversation_repair.audit(spark.createDataFrame(rows, SCHEMA)).collect()
    import sys

    sys.setrecursionlimit(40_000)
    check_audits(got, [r[:4] for r in rows], [])


# --- embedding whitening ---


def brute_whitening(vectors, k=4):
    """n, deviations, whitened rows up to sign, shares, from a dense eigendecomposition."""
    d = max(len(v) for v in vectors)
    x = np.zeros((len(vectors), d), np.int64)
    for row, v in zip(x, vectors):
        row[: len(v)] = [math.floor(256 * c) for c in v]
    fit = np.unique(x, axis=0)
    n, total = len(fit), fit.sum(axis=0)
    centred = fit - total / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1][:k], axes[:, ::-1][:, :k]
    return n, ((n * x - total) ** 2).sum(axis=1), (x - total / n) @ (axes / np.sqrt(values)), values / np.trace(centred.T @ centred / n)


def check_whitening(got, want, ids):
    n, deviation, whitened, shares = want
    assert len(got) == len(ids) * len(shares)
    by = {}
    for r in got:
        by.setdefault(r["component"], {})[r["vec_id"]] = r
    for c, rows in by.items():
        own = np.array([rows[i]["whitened"] for i in ids])
        sign = np.sign(own @ whitened[:, c - 1])
        assert own * sign == pytest.approx(whitened[:, c - 1], abs=1e-9)
        assert [rows[i]["deviation"] for i in ids] == deviation.tolist()
        assert {rows[i]["n"] for i in ids} == {n} and rows[ids[0]]["explained"] == pytest.approx(shares[c - 1], rel=1e-10)
        assert rows[ids[0]]["identity_error"] < 1e-9


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.1"])
def test_whitening_query(spark, folder):
    path = f"/root/testdata/{folder}"
    rows = spark.read.parquet(f"{path}/embeddings.parquet").select("vec_id", "embedding").collect()
    check_whitening(queries.op12_embedding_whitening(spark, path).collect(), brute_whitening([r["embedding"] for r in rows]), [r["vec_id"] for r in rows])


def test_whitening_beyond_the_first_basis(spark):
    """200 dimensions, in which three blocks do not span all; close eigenvalues."""
    rng = np.random.default_rng(1)
    vectors = (rng.standard_normal((600, 200)) * np.linspace(1, 2, 200)).round(3).tolist()
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id bigint, embedding array<double>")
    rows = whitening.whole(df)
    check_whitening(whitening.whiten(rows, model := whitening.fit(rows)).collect(), brute_whitening(vectors), list(range(600)))
    assert model.residual <= whitening.TOLERANCE * model.values[0]


def test_whitening_edges(spark):
    """Nulls, NaN, infinite entries, repeated vectors, short ones, clashing names; fewer components than asked for; no rows."""
    nan, inf = float("nan"), float("inf")
    vectors = [[0.5, 1.0, 0.25], [0.5, 1.0, 0.25], [0.5], [], [2.0, -1.0, 0.0], None, [1.0, None], [nan, 1.0], [inf], [1.0, 0.1, 0.2], [-3.0, 0.0]]
    df = spark.createDataFrame([(k, v, 7, "a") for k, v in enumerate(vectors)], "vec_id int, embedding array<float>, n int, x string")
    rows = whitening.whole(df)
    kept = [v for v in vectors if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    found = whitening.whiten(rows, whitening.fit(rows)).collect()
    assert len(found) == 3 * len(kept) and {r["vec_id"] for r in found} == {0, 1, 2, 3, 4, 9, 10}
    n, deviation, whitened, shares = brute_whitening([[float(np.float32(c)) for c in v] for v in kept], 3)
    check_whitening(found, (n, deviation, whitened, shares), [0, 1, 2, 3, 4, 9, 10])
    for few in (rows.where("false"), rows.where("vec_id < 2"), rows.where("vec_id = 3")):
        assert whitening.whiten(few, whitening.fit(few)).collect() == []
    assert set(whitening.whiten(rows.where("false"), None).columns) == {"vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"}
    wide = spark.createDataFrame([(k, [v, 1.0]) for k, v in enumerate((1e12, -1e12, 3e11))], "vec_id int, embedding array<double>")
    wide = whitening.whole(wide)
    assert {r["deviation"] for r in whitening.whiten(wide, whitening.fit(wide)).collect()} == {None}


# --- document fingerprints ---


def brute_phrases(text):
    found, phrase = set(), ""
    for c in text:
        phrase += c
        if phrase not in found:
            found.add(phrase)
            phrase = ""
    return found


def brute_rows(rows):
    """rows (doc_id, text) in order: (doc_id, n_chars, digest, share of common phrases with the edited text, with the next)."""
    out = []
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    for k, (doc_id, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        few = len(text) // 4
        edited = text[: len(text) - few] + after[:few]
        own = brute_phrases(text)
        out.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), like(own, brute_phrases(edited)), like(own, brute_phrases(after))))
    return out


def check_fingerprints(got, want):
    assert len(got) == len(want)
    got, want = sorted(got, key=lambda r: (r["doc_id"] is not None, r["doc_id"], r["n_chars"], r["edited_sha256"])), sorted(want, key=lambda r: (r[0] is not None, r[0], r[1], r[2]))
    errors = []
    for r, (doc_id, n, digest, near, after) in zip(got, want):
        assert (r["doc_id"], r["n_chars"], r["edited_sha256"]) == (doc_id, n, digest)
        assert lz_fingerprint.likeness(r["fingerprint"], r["edited_fingerprint"]) == r["near_edited"]
        errors += [r["near_edited"] - near, r["near_next"] - after]
    # 128 minima: a standard deviation of at most 0.044
    assert np.abs(errors).max() < 0.25 and abs(np.mean(errors)) < 0.005 + 0.1 / math.sqrt(len(errors))


def test_fingerprint_query(spark, sf_dir):
    rows = sorted((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    got = queries.op13_lz_fingerprint(spark, sf_dir).collect()
    check_fingerprints(got, brute_rows(rows))
    by = {}
    for r, (_, text) in zip(sorted(got, key=lambda r: r["doc_id"]), rows):
        assert by.setdefault(text, r["fingerprint"]) == r["fingerprint"]
    assert np.mean([r["near_edited"] > r["near_next"] for r in got if r["n_chars"] > 100]) > 0.97


def test_fingerprint_edges(spark):
    """Nulls, empty and long texts, equal ids, repeated rows, clashing names; one row; no rows; ids as text."""
    rows = [(3, None), (1, ""), (2, "x" * 300_000), (None, "no id here"), (5, "😀é中" * 50), (4, "abcabc abc"), (9, "same text"), (9, "same text"), (7, "last but two"), (8, "a")]
    df = spark.createDataFrame([(i, t, 1, "p") for i, t in rows], "doc_id bigint, text string, part int, ahead string")
    plain = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0))
    check_fingerprints(lz_fingerprint.fingerprint_documents(df.repartition(3)).collect(), brute_rows(plain))
    one = lz_fingerprint.fingerprint_documents(df.where("doc_id = 4")).collect()
    check_fingerprints(one, brute_rows([(4, "abcabc abc")]))
    assert lz_fingerprint.fingerprint_documents(df.where("false")).collect() == []
    named = df.where("doc_id is not null").selectExpr("concat('d', doc_id) AS doc_id", "text")
    assert len(lz_fingerprint.fingerprint_documents(named).collect()) == len(rows) - 1
    twice = spark.createDataFrame([(1, "b one"), (1, "a two"), (1, "c three"), (2, "d four")], "doc_id int, text string")
    got = lz_fingerprint.fingerprint_documents(twice).collect()
    assert len(got) == 4 and len({r["edited_sha256"] for r in got}) == 4
