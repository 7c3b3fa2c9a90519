"""Training-data operators against brute force, exact round trips and held-out accuracy, on whole small tables and edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from tideglass.llm import decontaminate, language_id, mixing, ordinal_quality, quality_rules, queries, sentence_dedup, simhash, token_files, toxicity, url_filter

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LONG = "lorem ipsum. " * 20_000
EDGE = [(1, None), (2, ""), (3, "  \n\t "), (4, "One two three."), (4, "One two three."), (5, LONG), (None, "no id here at all"), (6, "İ ﬁ x\u0301 <|endoftext|> 中文"), (7, "a\x00b\x1c c")]


def lower(t):
    return "".join(c.lower() if c.isascii() else c for c in t)


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls, empty and long texts, repeated rows, columns with names that operators use themselves."""
    rows = [(i, t, "en" if k % 2 else None, None if k % 3 else "s", 0, 1, "x") for k, (i, t) in enumerate(EDGE)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, size int, sig string")


@pytest.fixture(scope="session")
def empty(edge):
    return edge.where("false")


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


# --- SimHash ---


def fingerprint(text):
    words = SPACE.findall(lower(text or ""))
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def reachable(nodes, linked):
    label = {n: n for n in nodes}

    def root(n):
        while label[n] != n:
            n = label[n]
        return n

    nodes = list(nodes)
    for k, a in enumerate(nodes):
        for b in nodes[k + 1 :]:
            if linked(a, b):
                x, y = root(a), root(b)
                label[max(x, y)] = min(x, y)
    return {n: root(n) for n in nodes}


def test_simhash(spark, sf_dir, texts):
    want = {i: fingerprint(t) for i, t in texts.items()}
    groups = reachable(want, lambda a, b: bin(want[a] ^ want[b]).count("1") <= 2)
    got = queries.op10_simhash_near_dedup(spark, sf_dir).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == {i: (f"{f:016x}", groups[i]) for i, f in want.items()}


@pytest.mark.parametrize(("bits", "budget"), [(9, 2), (14, 3), (64, 2)])
def test_trie_pairs(bits, budget):
    rng = random.Random(bits)
    base = [rng.getrandbits(bits) for _ in range(40)]
    keys = sorted({b ^ sum(1 << rng.randrange(bits) for _ in range(rng.randrange(4))) & ((1 << bits) - 1) for b in base for _ in range(5)})
    other = sorted({rng.getrandbits(bits) for _ in range(60)} | set(keys[::7]))
    near = lambda a, b: bin(a ^ b).count("1") <= budget
    flat = lambda found: sorted((a, b) for u, v in found for a, b in zip(u.tolist(), v.tolist()))
    a, b = np.array(keys, np.uint64), np.array(other, np.uint64)
    assert sorted((min(p), max(p)) for p in flat(simhash.trie_pairs(a, None, bits, budget))) == [(i, j) for i in range(len(keys)) for j in range(i + 1, len(keys)) if near(keys[i], keys[j])]
    assert flat(simhash.trie_pairs(a, b, bits, budget)) == [(i, j) for i in range(len(keys)) for j in range(len(other)) if near(keys[i], other[j])]


@pytest.mark.parametrize("node_size", [16, 2])
def test_trie_with_deep_prefixes(spark, node_size):
    """Small groups: prefixes with masks, and crowded ones walked further down in Spark."""
    rng = random.Random(4)
    base = [rng.getrandbits(63) for _ in range(30)]
    sigs = sorted({b ^ sum(1 << rng.randrange(62) for _ in range(rng.randrange(3))) for b in base for _ in range(6)})
    nodes = spark.createDataFrame([(k, [s]) for k, s in enumerate(sigs)], "node bigint, sig array<bigint>")
    found = simhash.components(simhash.trie_edges(nodes, len(sigs), 1, 64, 2, 2, node_size=node_size)).collect()
    want = reachable(sigs, lambda a, b: bin(a ^ b).count("1") <= 2)
    number = {s: k for k, s in enumerate(sigs)}
    assert {k: k for k in number.values()} | {r["node"]: r["root"] for r in found} == {number[s]: number[r] for s, r in want.items()}


def test_trie_with_crowded_keys(spark):
    """Rows that share all bits of a trie are dealt over pairs of blocks; one crowded prefix goes down by levels."""
    rng = random.Random(6)
    rows = [(k, [rng.getrandbits(60) if k % 3 else 5, sum(1 << rng.randrange(60) for _ in range(rng.randrange(5)))]) for k in range(90)]
    nodes = spark.createDataFrame(rows, "node bigint, sig array<bigint>")
    found = simhash.components(simhash.trie_edges(nodes, len(rows), 1, 24, 2, 6, node_size=4, width=128)).collect()
    low = (1 << 24) - 1
    apart = lambda a, b: sum(bin(x ^ y).count("1") for x, y in zip(rows[a][1], rows[b][1]))
    want = reachable(range(90), lambda a, b: bin((rows[a][1][0] ^ rows[b][1][0]) & low).count("1") <= 2 and apart(a, b) <= 6)
    assert {k: k for k in range(90)} | {r["node"]: r["root"] for r in found} == want


def test_least_forest():
    rng = np.random.default_rng(1)
    i, j, w = rng.integers(0, 40, 200), rng.integers(0, 40, 200), rng.integers(0, 9, 200)
    kept, root = simhash.least_forest(40, i, j, w), list(range(40))
    total = 0
    for k in np.argsort(w, kind="stable"):  # edge by edge
        a, b = root[i[k]], root[j[k]]
        if a != b:
            total += w[k]
            root = [a if r == b else r for r in root]
    assert w[kept].sum() == total and len(kept) == 40 - len(set(root))


def test_near_dedup(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows, near = [], []
    for k in range(60):
        words = [word() for _ in range(200)]
        rows.append((10 * k, " ".join(words)))
        words[rng.randrange(200)] = word()  # some 5 of 196 shingles change
        rows.append((10 * k + 1, " ".join(words)))
        near.append(10 * k + 1)
    docs = spark.createDataFrame([*rows, rows[0]], "doc_id bigint, text string").withColumn("lang", F.lit("x"))
    kept = simhash.near_dedup(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [10 * k for k in range(60)]


@pytest.mark.parametrize(("changed", "similarity"), [(21, 0.806), (25, 0.773)])
def test_near_dedup_at_the_limit(spark, changed, similarity):
    """Pairs just above 0.8 go, pairs just below stay: the bits alone can't tell them apart."""
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    rows = []
    for k in range(60):
        words = [word() for _ in range(200)]
        rows.append((2 * k, " ".join(words)))
        rows.append((2 * k + 1, " ".join(words[:-changed] + [word() for _ in range(changed)])))
    same = 196 - changed
    assert same / (196 + changed) == pytest.approx(similarity, abs=0.001)
    kept = {r["doc_id"] for r in simhash.near_dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    gone = 120 - len(kept)
    assert gone >= 59 if similarity >= 0.8 else gone == 0


def five_word_sets(rows):
    """{doc_id: distinct five-word shingles}."""
    out = {}
    for i, t in rows:
        w = SPACE.findall(lower(t or ""))
        out[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    return out


def similar_groups(sets, least):
    """{doc_id: smallest doc_id reachable over pairs of this Jaccard similarity}, by counting shared shingles, and the pairs."""
    holders, shared = defaultdict(list), Counter()
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    for found in holders.values():
        for k, a in enumerate(sorted(found)):
            shared.update((a, b) for b in sorted(found)[k + 1 :])
    pairs = {p: n / (len(sets[p[0]]) + len(sets[p[1]]) - n) for p, n in shared.items()}
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    near = {p: j for p, j in pairs.items() if j >= least}
    for a, b in near:
        x, y = top(a), top(b)
        root[max(x, y)] = min(x, y)
    return {i: top(i) for i in sets}, near


def test_near_dedup_on_a_larger_table(spark):
    """All pairs from 0.8 on are found among 10,000 documents, those just above included, and no others."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    first = {}
    for r in docs.select("doc_id", "text").orderBy("doc_id").collect():
        first.setdefault(r["text"], r["doc_id"])
    groups, near = similar_groups(five_word_sets((i, t) for t, i in first.items()), 0.8)
    assert sum(0.8 <= j < 0.95 for j in near.values()) >= 20
    kept = {r["doc_id"] for r in simhash.near_dedup(docs).select("doc_id").collect()}
    both = [p for p in near if p[0] in kept and p[1] in kept]
    assert len(both) <= 0.01 * len(near) and not {i for i, g in groups.items() if i == g} - kept


def test_near_dedup_of_a_crowd(spark):
    """A group of near copies around the limit, larger than a block: the same classes as by brute force."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    base, rows = [word() for _ in range(120)], []
    for k in range(90):
        words = list(base)
        for _ in range(rng.randrange(1, 5)):
            words[rng.randrange(120)] = word()
        rows.append((k, " ".join(words)))
    docs = spark.createDataFrame([*rows, rows[5], (None, rows[7][1] + " x"), (7, "another text of id seven")], "doc_id bigint, text string")
    groups, near = similar_groups(five_word_sets(rows), 0.8)
    assert any(j < 0.85 for j in near.values()) and len(set(groups.values())) > 1
    linked = {r["doc_id"]: r["component_id"] for r in simhash.link_documents(spark.createDataFrame(rows, "doc_id bigint, text string"), 5, 6, None, 2, 80, 0.99, 0.8, 1 << 17, 30).collect()}
    assert linked == groups
    assert simhash.near_dedup(docs).count() >= len(set(groups.values()))


@pytest.mark.parametrize("block", [8, 1 << 10])
def test_exact_check_in_blocks(spark, block):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    base = [word() for _ in range(100)]
    rows = [(k, " ".join(base[: 100 - k] + [f"{w}{k}" for w in base[100 - k :]])) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    nodes = simhash.signatures(docs, 5, 6).withColumnsRenamed({"doc_id": "first_id"}).withColumn("node", F.col("first_id"))
    chain = spark.createDataFrame([(k, k + 1, True) for k in range(39)], "a bigint, b bigint, unsure boolean")
    got = {r["node"]: r["root"] for r in simhash.components(simhash.checked_edges(chain, nodes, docs, 5, 6, 384, 0.8, block)).collect()}
    want = similar_groups(five_word_sets(rows), 0.8)[0]
    assert {k: k for k, _ in rows} | got == want


def test_near_dedup_of_equal_ids(spark):
    """Rows of one id are judged each for itself: an unrelated text stays, a copy goes, rows equal in all are one."""
    rng = random.Random(5)
    text = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(150))
    p, u, v = text(), text(), text()
    near = p + " more"
    kept = lambda rows: sorted(map(tuple, simhash.near_dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()), key=str)
    assert kept([(2, p), (2, u)]) == sorted([(2, p), (2, u)], key=str)
    assert kept([(1, p), (2, p), (2, u)]) == sorted([(1, p), (2, u)], key=str)
    assert len(kept([(2, p), (2, near), (2, u), (2, u)])) == 2
    assert kept([(None, p), (None, u), (3, near), (3, v), (4, v)]) == sorted([(None, p), (None, u), (3, v)], key=str)


def test_near_dedup_edges(spark, edge, empty):
    kept = simhash.near_dedup(edge)
    assert kept.columns == edge.columns and kept.count() == 6  # the texts without words, and the two equal rows, are one each
    assert simhash.near_dedup(empty).count() == 0
    linked = simhash.link_documents(edge).collect()
    assert len(linked) == len(EDGE) and simhash.link_documents(empty).count() == 0


def test_tries_for_overlapping_slices():
    apart = math.acos(1.6 / 1.8) / math.pi
    differ = np.random.default_rng(7).random((20_000, 384)) < apart
    tables = simhash.tries_needed(384, 28, 7, 2, apart, 0.99)
    found = np.zeros(len(differ), bool)
    for at in simhash._places(tables, 28, 384):
        found |= (differ[:, at : at + 21].sum(axis=1) <= 2) & ~differ[:, at + 21 : at + 28].any(axis=1)
    assert found.mean() >= 0.985


# --- decontamination ---


def brute_hits(text, windows):
    words = WORD.findall(lower(text or ""))
    hit, items = set(), set()
    for n, of in windows.items():
        for k in range(len(words) - n + 1):
            if found := of.get(tuple(words[k : k + n])):
                hit.update(range(k, k + n))
                items |= found
    return len(words), len(hit), items


def windows_of(items):
    out = defaultdict(lambda: defaultdict(set))
    for i, t in items:
        words = WORD.findall(lower(t or ""))
        for k in range(max(1, len(words) - 9)) if words else ():
            window = tuple(words[k : k + 10])
            out[len(window)][window].add(str(i))
    return out


def test_decontamination(spark, sf_dir, texts):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    windows = windows_of(items)
    rows = queries.op2_benchmark_decontamination(spark, sf_dir).collect()
    assert len(rows) == len(texts) and any(r["contaminated"] for r in rows)
    for r in rows:
        n, hit, found = brute_hits(texts[r["doc_id"]], windows)
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == (n, hit, len(found), digest, hit > 0)


@pytest.mark.parametrize("block_words", [1, 1 << 20])
def test_decontamination_edges(spark, edge, empty, block_words):
    items = [(1, "one TWO"), (2, ""), (3, None), (4, "three"), (5, "lorem ipsum " * 8), (6, "one two")]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    windows = windows_of(items)
    rows = decontaminate.find_contamination(edge, benchmark, block_words=block_words).collect()
    assert sorted((r["n_words"], r["n_hit"], tuple(r["items"])) for r in rows) == sorted((n, h, tuple(sorted(s))) for n, h, s in (brute_hits(t, windows) for _, t in EDGE))
    cut = {r["doc_id"]: r["left"] for r in decontaminate.find_contamination(edge, benchmark).join(edge.where("doc_id = 4").dropDuplicates().select(F.col("doc_id").alias("d"), "text"), F.col("doc_id") == F.col("d")).select("doc_id", decontaminate.cut_spans("text", "spans").alias("left")).collect()}
    assert cut == {4: "."}
    clean = decontaminate.drop_contaminated(edge, benchmark)
    assert clean.columns == edge.columns and clean.count() == len(EDGE) - 3
    assert decontaminate.find_contamination(empty, benchmark).count() == 0
    assert decontaminate.find_contamination(edge, benchmark.where("false")).where("n_hit > 0").count() == 0


# --- quality rules ---


def brute_counts(text):
    w = SPACE.findall(text or "")
    windows = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    count = Counter(windows)
    covered = {k + j for k, x in enumerate(windows) if count[x] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if SPACE.search(x)]
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(spark, sf_dir, texts):
    rows = queries.op3_quality_rules(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n = brute_counts(texts[r["doc_id"]])
        assert tuple(r[c] for c in quality_rules.BASE) == n
        assert r["base_failed"] == (n[0] < 50 or 100 * n[4] > 50 * n[0])
        assert not (r["base_failed"] and r["kept"])


def test_quality_learning_and_edges(spark, edge, empty):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9)))
    rows = [(k, " ".join(word() + ("%%%" if k % 4 == 0 and rng.random() < 0.8 else "") for _ in range(80)), int(k % 4 > 0)) for k in range(400)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id bigint, quality int")
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.judge(docs, labels).collect()}
    assert sum(kept[i] == bool(q) for i, _, q in rows) >= 398
    out = quality_rules.filter_documents(docs.withColumn("extra", F.lit(1)), labels)
    assert out.columns == ["doc_id", "text", "extra"] and sorted(r["doc_id"] for r in out.collect()) == sorted(i for i, k in kept.items() if k)
    found = quality_rules.judge(edge, labels.where("false")).collect()
    assert sorted(tuple(r[c] for c in quality_rules.BASE) for r in found) == sorted(brute_counts(t) for _, t in EDGE)
    assert quality_rules.judge(empty, labels).count() == 0


# --- mixing ---


def test_mixing(spark, sf_dir, texts):
    rows = queries.op4_mix_sources(spark, sf_dir).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, queries.op4_mix_sources(spark, sf_dir).collect()))
    source = {r["doc_id"]: r["source"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    size, taken, target = Counter(), Counter(), {}
    for r in rows:
        assert r["size"] == len(SPACE.findall(texts[r["doc_id"]])) and r["taken"] in (0, r["size"], 2 * r["size"])
        s = source[r["doc_id"]]
        size[s] += r["size"]
        taken[s] += r["taken"]
        target[s] = r["target"]
    longest = max(r["size"] for r in rows)
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sorted(size))}
    total, full = 1.5 * sum(size.values()), set()
    while True:  # water filling
        level = (total - sum(2 * size[s] for s in full)) / sum(w for s, w in weight.items() if s not in full)
        more = {s for s in size if s not in full and level * weight[s] > 2 * size[s]}
        if not more:
            break
        full |= more
    for s in size:
        assert target[s] == pytest.approx(2 * size[s] if s in full else level * weight[s])
        assert abs(taken[s] - target[s]) <= longest


@pytest.mark.parametrize(("cap", "share"), [(1.0, 0.6), (1.0, 1.5), (1.5, 1.2), (3.0, 2.8), (3.0, 0.5), (2.0, 1.9)])
def test_mixing_caps(spark, cap, share):
    """Every cap bounds targets and copies, and the words taken come near the targets."""
    rng = random.Random(11)
    rows = [(k, "ab"[k % 7 == 0], " ".join("w" for _ in range(rng.randint(1, 40)))) for k in range(700)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    got = mixing.mix(docs, mixing.repeating_weights(docs), share, cap).collect()
    size, taken, target = Counter(), Counter(), {}
    for r in got:
        assert 0 <= r["copies"] <= math.ceil(cap)
        size[r["source"]] += r["size"]
        taken[r["source"]] += r["size"] * r["copies"]
        target[r["source"]] = r["target"]
    total = share * sum(size.values())
    assert sum(target.values()) == pytest.approx(min(total, cap * sum(size.values())))
    for s in size:
        assert target[s] <= cap * size[s] + 1e-6 and abs(taken[s] - target[s]) <= 40


def test_mixing_order(spark):
    """Within a source the fraction goes by random odds over inclusion odds: all taken ones come before all that are not, and larger texts are likelier."""
    rng = random.Random(12)
    docs = spark.createDataFrame([(k, "a", " ".join("w" for _ in range(1 + k % 60))) for k in range(3000)], "doc_id bigint, source string, text string")
    rows = mixing.mix(docs, mixing.repeating_weights(docs), 0.5, 2.0, seed=17).withColumn("u", (F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(17)), 11).cast("double") + 0.5) / float(1 << 53)).collect()
    measure = lambda n: max(1.0, round(math.log2(n + 2) * mixing.STEP)) / mixing.STEP
    rate = rows[0]["target"] / sum(r["size"] * measure(r["size"]) for r in rows)
    rank = lambda r: (lambda p: r["u"] / (1 - r["u"]) / (p / (1 - p)))(rate * measure(r["size"]))
    assert max(rate * measure(r["size"]) for r in rows) < 1
    assert max(rank(r) for r in rows if r["copies"]) < min(rank(r) for r in rows if not r["copies"])
    rng.shuffle(rows)
    large, small = ([r["copies"] for r in rows if (r["size"] > 30) == big] for big in (True, False))
    assert np.mean(large) > np.mean(small)


def test_mixing_edges(spark, edge, empty):
    rows = mixing.mix(edge, mixing.repeating_weights(edge)).collect()
    assert len(rows) == len(EDGE) and all(0 <= r["copies"] <= 2 for r in rows)
    assert mixing.mix(empty, mixing.repeating_weights(empty)).count() == 0


# --- token files ---


def test_simple8b():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 59, 60, 61, 3000):
        for bits in (1, 7, 16, 31, 60, 64):
            ids = rng.integers(0, 1 << 32, n, np.uint64) * rng.integers(0, 1 << 32, n, np.uint64) >> np.uint64(64 - bits)
            starts = np.unique(np.r_[0, rng.integers(0, max(n, 1), 3)])
            words, first = token_files.pack(ids, starts)
            assert (token_files.unpack(words) == ids).all()
            for a, b, x, y in zip(starts, [*starts[1:], n], first, [*first[1:], len(words)]):
                assert (token_files.unpack(words[x:y]) == ids[a:b]).all()


def check_tokens(rows, texts):
    from tokenizers import Tokenizer

    tokenizer, start = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0
    for r, (doc_id, text) in zip(rows, texts, strict=True):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (doc_id, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_token_files(spark, sf_dir, texts):
    check_tokens(queries.op5_token_files(spark, sf_dir).orderBy("start").collect(), sorted(texts.items()))


def test_token_files_edges(spark, edge, empty, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    token_files.encode_documents(edge, str(tmp_path / "a"), path, 1)
    rows = token_files.decode_documents(spark, str(tmp_path / "a")).orderBy("start").collect()
    check_tokens(rows, sorted(EDGE, key=lambda r: (r[0] is not None, r[0] or 0)))
    token_files.encode_documents(empty, str(tmp_path / "b"), path, 1)
    assert token_files.decode_documents(spark, str(tmp_path / "b")).count() == 0
    token_files.encode_documents(edge, str(tmp_path / "c"), public_tokenizers.path("byte_bpe_50k.json"), 50256)  # not word by word
    assert token_files.decode_documents(spark, str(tmp_path / "c")).count() == len(EDGE)


# --- language ---


def test_kneser_ney_sums_to_one():
    import pandas as pd

    counts = Counter()
    text = "\0\0\0abracadabra cad abra bra"
    for k in range(3, len(text)):
        counts[text[k - 3 : k + 1]] += 1
    model = language_id.build(pd.DataFrame([("x", g, n) for g, n in counts.items()], columns=["lang", "gram", "n"]))
    own = language_id._Language(np.array([[ord(c) for c in g] for g in counts], np.uint32), np.array(list(counts.values()), float), 7)
    for context in ("abr", "\0\0a", "zzz", "ra "):
        p = sum(math.exp(own.log_p(np.array([[ord(c) for c in context + w]], np.uint32))[0]) for w in "abrcd zq"[:7])
        assert p == pytest.approx(1, abs=1e-6)
    entropy, sizes = model.entropies(["abra", "", None, "12"])
    want = -sum(own.log_p(np.array([[ord(c) for c in ("\0\0\0abra")[k - 3 : k + 1]]], np.uint32))[0] for k in range(3, 7)) / 4
    assert entropy[0, 0] == pytest.approx(want, rel=1e-4) and sizes.tolist() == [4, 0, 0, 0]


def test_language(spark, sf_dir):
    found = queries.op1_language_id(spark, sf_dir)
    rows = found.join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.95
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)


def test_language_edges(spark, edge, empty, docs):
    model = language_id.train(docs.select("doc_id", "text", "lang"), per_language=50)
    rows = language_id.identify(edge, model, reject=False).collect()
    letters = lambda t: any(c.isalpha() for c in t or "")
    assert sorted(r["lang"] == "und" for r in rows) == sorted(not letters(t) for _, t in EDGE)
    assert language_id.identify(edge, language_id.train(empty)).where("lang = 'und'").count() == len(EDGE)
    assert language_id.identify(empty, model).count() == 0


# --- words: toxicity, grades ---


@pytest.fixture(scope="session")
def insults(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    common = [word() for _ in range(150)]
    rows = []
    for k in range(1500):
        sentences = [[rng.choice(common) for _ in range(8)] for _ in range(6)]
        if k % 5 == 0:
            sentences[rng.randrange(6)][rng.randrange(8)] = rng.choice(["vile", "rotten"]) + rng.choice(["", "er", "est"])
        rows.append((k, ". ".join(" ".join(s) for s in sentences) + ".", int(k % 5 == 0)))
    return spark.createDataFrame(rows, "doc_id bigint, text string, y int")


def test_toxicity(spark, insults, edge, empty):
    model = toxicity.train(insults.select("doc_id", "text"), insults.where("doc_id % 3 > 0").select("doc_id", "y"))
    rows = toxicity.score(insults, model).join(insults, "doc_id").where("doc_id % 3 = 0").collect()
    assert np.mean([(r["score"] >= 0.5) == bool(r["y"]) for r in rows]) > 0.95
    for r in rows:
        for s in r["sentences"]:
            assert re.search("vile|rotten", r["text"][s["start"] : s["end"]]) or not r["y"]
    got = {r["doc_id"]: r["score"] for r in toxicity.score(edge, model).collect()}
    assert got[1] == got[2] == got[3] == 0 and all(0 <= s <= 1 for s in got.values())
    assert toxicity.score(empty, model).count() == 0
    assert toxicity.score(edge, toxicity.train(empty, insults.select("doc_id", "y").where("false"))).where("score < 0.5").count() == len(EDGE)


def test_grades(spark, insults, edge, empty):
    graded = insults.withColumn("y", F.when(F.col("y") == 1, 1).when(F.col("doc_id") % 7 == 0, 0).otherwise(2)).withColumn("text", F.when(F.col("y") == 0, F.regexp_replace("text", " ", "## ")).otherwise(F.col("text")))
    model = ordinal_quality.train(graded.select("doc_id", "text"), graded.where("doc_id % 3 > 0").select("doc_id", "y"))
    assert (np.diff(model.thresholds) >= 0).all()
    rows = ordinal_quality.score(graded, model).join(graded, "doc_id").where("doc_id % 3 = 0").collect()
    assert np.mean([round(r["expected_grade"]) == r["y"] for r in rows]) > 0.9
    assert all(r["tails"][0] >= r["tails"][1] for r in rows)
    assert ordinal_quality.score(edge, model).count() == len(EDGE) and ordinal_quality.score(empty, model).count() == 0
    assert ordinal_quality.score(edge, ordinal_quality.train(empty, graded.select("doc_id", "y").where("false"))).where("expected_grade = 0").count() == len(EDGE)


@pytest.mark.parametrize("name", ["op6_ordinal_quality", "op8_toxicity"])
def test_word_models_run_on_tables(spark, sf_dir, texts, name):
    assert queries.QUERIES[name](spark, sf_dir).count() == len(texts)


# --- sentences ---


def sentences_of(text):
    """[(start, end, words)] by plain string search: cut after . ! ? before white space, and at line ends."""
    out, start, k, t = [], 0, 0, text or ""
    while k <= len(t):
        at_end = k == len(t) or t[k] == "\n" or (t[k] in " \t\r" and k > 0 and t[k - 1] in ".!?")
        if at_end:
            if words := SPACE.findall(lower(t[start:k])):
                out.append((start, start + len(t[start:k].rstrip(" \t\r")), words))
            start = k + 1
        k += 1
    return out


def brute_removed(rows, min_words=20, least=2):
    """For each distinct (doc_id, text) the sentences that go: every pair of places of equal words is tried from each sentence on."""
    split = {row: [w for _, _, w in sentences_of(row[1])] for row in rows}
    holders = defaultdict(set)
    places = defaultdict(set)
    for row, sentences in split.items():
        for i in range(len(sentences)):
            for step in (1, -1):
                run, n = [], 0
                j = i
                while 0 <= j < len(sentences) and (len(run) < least or n < min_words):
                    run.append(j)
                    n += len(sentences[j])
                    j += step
                if len(run) >= least and n >= min_words:
                    words = tuple(w for k in sorted(run) for w in sentences[k])
                    holders[words].add(row)
                    places[row].add((words, tuple(sorted(run))))
    first = {words: min(found, key=lambda r: (r[0] is not None, r[0] or 0)) for words, found in holders.items()}
    return {row: {k for words, run in found if first[words] != row for k in run} for row, found in places.items()}


def test_sentence_dedup(spark, sf_dir, texts):
    want = brute_removed(set(texts.items()))
    rows = queries.op7_sentence_dedup(spark, sf_dir).collect()
    assert len(rows) == len(texts) and any(r["n_removed"] for r in rows)
    for r in rows:
        found = sentences_of(texts[r["doc_id"]])
        gone = want.get((r["doc_id"], texts[r["doc_id"]]), set())
        assert (r["n_sentences"], set(r["removed"]), r["n_removed"]) == (len(found), gone, len(gone))
        left = [w for k, (_, _, ws) in enumerate(found) if k not in gone for w in ws]
        assert SPACE.findall(lower(r["text"] or "")) == left
    assert all(r["text"] == texts[r["doc_id"]] for r in rows if not r["n_removed"])


def test_sentence_dedup_equal_ids(spark):
    """Rows of one doc_id with different texts are different documents; unique text stays, exact repeats of a row are one place."""
    rng = random.Random(5)
    text = lambda: " ".join(" ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(10)) + "." for _ in range(6))
    p, u, v = text(), text(), text()
    rows = [(1, p), (2, p), (2, u), (None, v), (None, u + " " + v), (3, u), (3, u)]
    got = sentence_dedup.remove_repeated(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    left = sorted((r["doc_id"] or 0, r["text"].strip()) for r in got)
    v_first = sorted((r["doc_id"] or 0, r["n_removed"]) for r in got)
    assert len(got) == len(rows) and (1, p) in left and left.count((3, "")) == 2
    assert [n for i, n in v_first if i == 1] == [0] and [n for i, n in v_first if i == 3] == [6, 6]
    assert sorted(n for i, n in v_first if i == 2) == [6, 6]  # u is held by the row of null before
    assert sum(t.count(v) for _, t in left) == 1 and sum(t.count(u) for _, t in left) == 1
    alone = sentence_dedup.remove_repeated(spark.createDataFrame([(1, p), (2, p), (2, u)], "doc_id bigint, text string")).collect()
    assert sorted((r["doc_id"], r["n_removed"], r["text"].strip()) for r in alone) == sorted([(1, 0, p), (2, 6, ""), (2, 0, u)])
    own = sentence_dedup.remove_repeated(spark.createDataFrame([(1, f"{p}\n{p}"), (2, v)], "doc_id bigint, text string")).collect()
    assert all(r["n_removed"] == 0 for r in own)  # repeated in one text alone


def test_sentence_dedup_passages(spark, edge, empty):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    text = lambda n: ". ".join(" ".join(word() for _ in range(rng.randint(3, 12))) for _ in range(n)) + "."
    passage = text(9) + " " + text(3)
    rows = [(k, f"{text(5)}\n{passage}\n{text(4)}" if k % 3 == 0 else text(9)) for k in range(12)]
    out = {r["doc_id"]: r for r in sentence_dedup.remove_repeated(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert passage in out[0]["text"] and [i for i, r in out.items() if r["n_removed"]] and all(passage not in out[i]["text"] and out[i]["n_removed"] == 12 for i in (3, 6, 9))
    assert all(out[i]["text"] == t for i, t in rows if i % 3)
    assert sentence_dedup.remove_repeated(edge).count() == len(EDGE) and sentence_dedup.remove_repeated(empty).count() == 0


@pytest.mark.parametrize("inner", [(13, 9), (13, 11), (20, 8, 4)])
def test_sentence_dedup_inside_sentences(spark, inner):
    """A repeated passage of 51 to 60 words whose ends lie inside sentences loses its whole sentences."""
    rng = random.Random(9)
    words = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    ends = 55 - sum(inner)
    left, middle, right = words(ends // 2), ". ".join(words(n) for n in inner), words(ends - ends // 2)
    rows = [(k, f"{words(30)}. {words(6)} {left}. {middle}. {right} {words(6)}. {words(30)}.") for k in range(2)]
    out = {r["doc_id"]: r for r in sentence_dedup.remove_repeated(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert out[0]["n_removed"] == 0 and out[1]["removed"] == list(range(2, 2 + len(inner))) and middle not in out[1]["text"]


# --- urls ---


def test_urls(spark):
    urls = ["https://Blog.Example.com/en/12?x#y", "http://example.com/en/7x", "ftp://a.example.net/de/8", "x://example.network/de/1", None, "no scheme", "http://h", "http://u.org/es/#f", "a://b://c/d"]
    pages = spark.createDataFrame([(k, u) for k, u in enumerate(urls)], "page_id int, url string")
    texts = spark.createDataFrame([("cheap pills cheap blog example",)], "text string")
    rows = {r["page_id"]: r for r in url_filter.judge(pages, texts).collect()}
    assert [(rows[k]["host"], rows[k]["path"], rows[k]["rule"]) for k in range(len(urls))] == [
        ("blog.example.com", "/en/12", "com/en/"), ("example.com", "/en/7x", "example.com/en/7"), ("a.example.net", "/de/8", "example.net/de/8"), ("example.network", "/de/1", None),
        ("", "", None), ("", "", None), ("h", "", None), ("u.org", "/es/", "org/es/"), ("b:", "//c/d", None),
    ]
    assert [rows[k]["verdict"] for k in (0, 1, 2, 7)] == ["block", "allow", "block", "block"]
    assert url_filter.judge(pages.where("false"), texts).count() == 0


def test_url_rules_are_those_of_the_contract(spark):
    rules = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
    assert sorted(url_filter.RULES) == sorted(rules)
    urls = [f"http://{h}{p}" for _, h, p in rules]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string")
    rows = {r["page_id"]: r for r in url_filter.judge(pages, spark.createDataFrame([("cheap pills",)], "text string")).collect()}
    assert [(rows[k]["verdict"], rows[k]["rule"]) for k in range(len(rules))] == [(v, h + p) for v, h, p in rules]


def test_segmenter():
    cut = url_filter.Segmenter({"cheap": 5, "pills": 4, "spam": 3, "farm": 3, "a": 50})
    assert cut("cheappills") == ["cheap", "pills"] and cut.tokens("spamfarm.com/12") == ["spam", "farm", *cut("com"), "0"]


def brute_cut(name, counts):
    """The most likely segmentation among all, each word priced by itself."""
    total = sum(counts.values())
    price = lambda w: math.log(counts[w] / total) if w in counts else -math.log(total + 1) - 2.5 * len(w)
    best = [(0.0, [])]
    for end in range(1, len(name) + 1):
        best.append(max(((best[k][0] + price(name[k:end]), best[k][1] + [name[k:end]]) for k in range(end)), key=lambda o: o[0]))
    return best[-1]


def test_segmenter_by_brute_force():
    rng = random.Random(4)
    counts = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 6))): rng.randint(1, 90) for _ in range(60)} | {"abcabcabcabcabcabcabcabcabcabc": 9}
    cut, total = url_filter.Segmenter(counts), sum(counts.values())
    price = lambda w: math.log(counts[w] / total) if w in counts else -math.log(total + 1) - 2.5 * len(w)
    for name in ["".join(rng.choice("abcx") for _ in range(rng.randint(1, 40))) for _ in range(200)] + ["x" * 60, "abc" * 10, ""]:
        got = cut(name)
        assert "".join(got) == name and sum(map(price, got)) == pytest.approx(brute_cut(name, counts)[0])


def test_url_query_by_brute_force(spark, sf_dir):
    """op9 on the whole table: hosts are cut, and every verdict without a rule is that of naive Bayes computed here."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    words = Counter(w for r in pages.select(url_filter.page_text("html").alias("t")).collect() for w in re.findall(r"[^\W\d_]+", (r["t"] or "").lower()) if len(w) > 1)
    rows = queries.op9_url_filter(spark, sf_dir).collect()
    assert len(rows) == pages.count()
    cut, by, seen = url_filter.Segmenter(words), defaultdict(Counter), Counter()
    tokens = lambda r: cut.tokens(r["host"]) + cut.tokens(re.sub(r"\d+", "0", r["path"]))
    kinds = [r["verdict"] if r["rule"] else "allow" for r in rows]
    for r, kind in zip(rows, kinds):
        by[kind].update(tokens(r))
        seen[kind] += 1
    vocabulary = set(by["block"]) | set(by["allow"])
    size = {k: sum(by[k].values()) + len(vocabulary) + 1 for k in ("block", "allow")}
    for r in rows:
        odds = math.log((seen["block"] + 1) / (seen["allow"] + 1)) + sum(math.log((by["block"][w] + 1) / size["block"]) - math.log((by["allow"][w] + 1) / size["allow"]) for w in tokens(r))
        assert r["odds"] == pytest.approx(odds, abs=1e-6)
        assert r["rule"] or r["verdict"] == ("block" if odds > 0 else "allow") or abs(odds) < 1e-6
    labels = {x for r in rows for x in re.findall("[a-z]+", r["host"])}
    assert any(len(cut(x)) > 1 for x in labels)


def test_url_edges(spark):
    """Repeated rows, nulls, long names and columns with names that the operator uses itself."""
    urls = ["http://" + "ab" * 300 + ".com/x", "http://a.org/es/1", "http://a.org/es/1", None, "", "http:///", "HTTP://A.COM/en/é中文"]
    pages = spark.createDataFrame([(1, u, "w", 3) for u in urls], "page_id int, url string, host string, odds int")
    texts = spark.createDataFrame([(None,), ("ab abab",)], "text string")
    rows = url_filter.judge(pages, texts).collect()
    assert len(rows) == len(urls) and sum(r["rule"] == "org/es/" for r in rows) == 2 and sum(r["host"] == "a.com" and r["rule"] == "com/en/" for r in rows) == 1
    assert url_filter.judge(pages, texts.where("false")).count() == len(urls)


def test_frequent_hosts_are_segmented(spark, tmp_path):
    """Through op9: a concatenated host seen many times is cut into words, which hosts share."""
    page = "<title>Cheap pills</title><script>cheappills()</script><p>cheap &amp; pills, http://cheappills.info/ cheappills.info me@cheappills.info pills cheap"
    urls = ["http://cheappills.com/en/1"] * 40 + ["http://cheappills.info/x"] * 400 + ["http://pillscheap.info/x"] * 3 + ["http://cheap-pills.info/x", "http://quiet.info/x"]
    spark.createDataFrame([(k, u, page if k % 4 == 0 else None) for k, u in enumerate(urls)], "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    odds = {r["host"]: r["odds"] for r in queries.op9_url_filter(spark, str(tmp_path)).collect()}
    assert odds["cheappills.info"] == pytest.approx(odds["cheap-pills.info"]) == pytest.approx(odds["pillscheap.info"])
    assert abs(odds["quiet.info"] - odds["cheap-pills.info"]) > 0.1


def test_rare_url_words_count(spark):
    """No bound on the words of either model: 120,000 frequent ones do not push out rarer ones."""
    pages = spark.range(120_000).selectExpr("id AS page_id", "concat('http://x.info/', translate(concat('j', id, '/', 'j', id), '0123456789', 'qwrtzpsdfg')) AS url").unionByName(
        spark.createDataFrame([(-1, "http://zzrare.com/en/1"), (-2, "http://zzrare.info/"), (-3, "http://redbarn.info/"), (-4, "http://red-barn.info/"), (-5, "http://zzonce.info/")], "page_id bigint, url string")
    )
    texts = pages.where("page_id >= 0").selectExpr("substring(url, 15) AS text").unionByName(spark.createDataFrame([("red barn zzrare zzonce",)], "text string"))
    odds = {r["page_id"]: r["odds"] for r in url_filter.judge(pages, texts).where("page_id < 0").collect()}
    assert odds[-3] == pytest.approx(odds[-4])  # dictionary: once each, behind 120,000 words seen twice
    assert odds[-2] - odds[-5] == pytest.approx(math.log(2))  # classifier: blocked once and allowed once, against allowed once


def test_window_hashes_are_those_of_words(monkeypatch):
    """Any window's hash is that of the same letters as a word, whatever stands before it; texts are cut in pieces between runs."""
    runs = ["cheappills", "ab", "straße", "a" * 30, "pills"]
    words = sorted({r[k:e] for r in runs for k in range(len(r)) for e in range(k + 2, min(len(r), k + 6) + 1)})
    hashed = pd.concat(url_filter._hash_words(iter([pd.DataFrame({"word": words, "n": range(len(words))})])))
    assert list(hashed["word"]) == words and list(hashed["n"]) == list(range(len(words)))
    of = dict(zip(hashed["word"], hashed["hash"]))
    assert len(set(of.values())) == len(words)
    for size in (3, 12, 500_000):
        monkeypatch.setattr(url_filter, "_PIECE", size)
        found = pd.concat(url_filter._windows(iter([pd.DataFrame({"id": range(len(runs)), "run": runs})]), [2, 3, 4, 5, 6]))
        assert sorted(zip(found["id"], found["hash"])) == sorted((k, of[w]) for k, r in enumerate(runs) for w in words if w in r)


def test_long_runs_and_long_words(spark):
    """A run of 10,000 letters beside a word of 10,000, and an empty table of pages."""
    import resource

    word = "".join(random.Random(3).choices("abcdefgh", k=10_000))
    counts = spark.createDataFrame([(word[:9_000], 2), (word, 1), ("cheap", 9), ("pills", 9)], "word string, n long")
    runs = spark.createDataFrame([("cheap" + word,), (word[:9_000] + "pills",), ("cheap" * 2_000,), ("xq",)], "run string")
    cut = {r["run"]: r["tokens"] for r in url_filter.segment(runs, counts).collect()}
    assert cut["cheap" + word] == ["cheap", word] and cut[word[:9_000] + "pills"] == [word[:9_000], "pills"]
    assert cut["cheap" * 2_000] == ["cheap"] * 2_000 and cut["xq"] == ["xq"]

    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    frame = pd.DataFrame({"id": [1], "run": [word]})
    assert sum(len(f) for f in url_filter._windows(iter([frame]), list(range(2, 10_001, 50)))) > 900_000
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 200_000
    pages = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.judge(pages, spark.createDataFrame([("cheap pills",)], "text string")).count() == 0
