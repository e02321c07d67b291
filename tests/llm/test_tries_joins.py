"""Prefix trie, n-gram join and fill-in-middle against brute force, and on odd input."""

import collections
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from prosegauge.llm import fim, ngramjoin, prefixtrie

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
TURNS = "conv_id long, turn long, role string, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- fill-in-middle


def plain_fim(i, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    d = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(d[k : k + 8], 16) for k in range(0, 32, 8))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    if h4 % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def scraps(rng, n):
    return "".join(rng.choice(["<P>", "<", "P", "S>", "<M>", "é", "zwölf", "漢", "😀", " ", "\n", "a", "Word", "<<S>", ">", "<S"]) for _ in range(n))


def test_fim_automaton_forgets():
    """From any state, the same FORGETS bytes lead to the same state: lanes may start anywhere."""
    for kinds in np.ndindex(*[fim.CLASSES] * fim.FORGETS):
        ends = set()
        for state in range(fim.STATES):
            for kind in kinds:
                state = fim.STEP[state, kind]
            ends.add(int(state))
        assert len(ends) == 1


@pytest.mark.parametrize("lanes", [1, 3, 4096])
def test_fim_scan(lanes):
    rng = random.Random(lanes)
    for _ in range(40):
        texts = [scraps(rng, rng.choice([0, 1, 3, 20, 400])) for _ in range(rng.randint(1, 9))]
        scan = fim.Scan([t.encode() for t in texts], lanes)
        assert (scan.counts @ fim.POINT).tolist() == [len(t) for t in texts]
        assert scan.sentinels.tolist() == [len(re.findall("<[PSM]>", t)) for t in texts]
        for k, t in enumerate(texts):
            units = re.findall(r"[A-Za-z]+|[^A-Za-z]", t)
            assert scan.units[k] == len(units)
            for cut in {0, len(units), rng.randint(0, len(units))}:
                assert scan.places(np.array([k]), np.array([cut]), 2)[0] == len("".join(units[:cut]).encode())


def test_fim_rows(spark):
    rng = random.Random(1)
    rows = [(i, scraps(rng, rng.choice([0, 1, 5, 60])).replace("<P>", "<").replace("<M>", ">"), "x") for i in range(150)]
    rows += [(150, None, "x"), (151, "", "x"), (None, "some text", "x"), (7, "twice the id", "x"), (7, "twice the id", "x"), (152, "ab " * 70_000 + "é", "x"), (153, "has <S> in it", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, output string")
    out = fim.fill_in_middle(df).withColumn("again", fim.restored(F.col("output"), F.col("form"))).collect()
    got = collections.Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, sha(r.output), r.again) for r in out)
    want = collections.Counter((i, *plain_fim(i, t)[:4], sha(plain_fim(i, t)[4]), t or "") for i, t, _ in rows)
    assert got == want
    assert {r.form for r in out} == {"plain", "psm", "spm"}
    assert fim.fill_in_middle(df.limit(0)).count() == 0


# --- prefix trie


def plain_trie(rows):
    """Node by node, as the contract says it."""
    convs = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            convs[c].append((turn is not None, turn or 0, hashlib.md5(f"{role}\x1f{text}".encode()).hexdigest(), role, text))
    original = {c: [t[3:] for t in sorted(ts)] for c, ts in convs.items()}
    made = {}
    for c, ts in original.items():
        h = zlib.crc32(str(c).encode()) % 6
        made[c] = original.get(c - int(np.fmod(c, 100)), [])[:h] + ts[h:]
    members = collections.defaultdict(list)
    for c, ts in made.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
    out = {}
    for node, cs in members.items():
        below = [x for x in members if x[: len(node)] == node]
        leaves = sum(not any(len(y) == len(x) + 1 and y[: len(x)] == x for y in members) for x in below)
        saved = sum((len(members[x]) - 1) * len(x[-1][1]) for x in below if x)
        ends = ",".join(map(str, sorted(c for c in cs if len(made[c]) == len(node))))
        children = sum(len(x) == len(node) + 1 for x in below)
        out[min(cs), len(node)] = (min(members[node[:-1]]) if node else None, len(cs), children, leaves, saved, sha(ends))
    return out


def told(df):
    rows = df.collect()
    out = {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in rows}
    assert len(out) == len(rows)
    return out


def some_turns(seed):
    rng = random.Random(seed)
    rows = []
    for c in [*range(0, 330, 7), 100, 200, 101, 102, 205, -5, -100]:
        for turn in range(rng.randint(1, 9)):
            rows.append((c, turn, rng.choice(["user", "assistant"]), rng.choice(["a", "bb", "é😀", ""])))
    for c in range(400, 430):  # copies, and beginnings of one another
        rows += [(c, turn, "user", f"line {turn}") for turn in range(c % 5 + 1)]
    rows += [(500, None, None, None), (500, 1, "user", "x"), (500, 1, "user", "w"), (500, 1, "user", "x"), (None, 0, "user", "no id"), (501, 0, "user", "long " * 20_000), (502, 0, "user", None)]
    rng.shuffle(rows)
    return list(dict.fromkeys(rows)) + [(500, 1, "user", "x")]


def test_trie_brute_force_and_sql(spark):
    rows = some_turns(1)
    df = spark.createDataFrame(rows, TURNS).withColumns({"depth": F.lit("x"), "first": F.lit(1), "a": F.lit(None).cast("int")})
    got = told(prefixtrie.prefix_trie(df.repartition(3), block=3))
    assert got == plain_trie(rows)
    con = duckdb.connect()
    con.register("conversations", pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"}))
    found = con.sql(f"SELECT conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 FROM ({prefixtrie.OP11_SQL})").fetchall()
    assert {r[:2]: r[2:] for r in found} == got and len(found) == len(got)


def test_trie_of_nested_chains(spark):
    """Chains that hang one on the other, 12 deep: each conversation leaves the one before a turn later."""
    rows = [(c, turn, "user", f"{turn}" if turn < c else f"own {c}") for c in range(12) for turn in range(13)]
    df = spark.createDataFrame(rows, TURNS)
    got = told(prefixtrie.prefix_trie(df, heads=F.lit(0)))
    members = collections.defaultdict(list)
    for c in range(12):
        for d in range(14):
            members[tuple(f"{t}" if t < c else f"own {c}" for t in range(d))].append(c)
    assert {(min(v), len(k)): len(v) for k, v in members.items()} == {k: v[1] for k, v in got.items()}
    assert got[0, 0][3] == 12 and got[0, 0][4] == sum((len(v) - 1) * len(k[-1]) for k, v in members.items() if k)


def test_trie_empty(spark):
    assert prefixtrie.prefix_trie(spark.createDataFrame([], TURNS)).count() == 0
    lone = told(prefixtrie.prefix_trie(spark.createDataFrame([(3, 0, "user", "x")], TURNS)))
    h = zlib.crc32(b"3") % 6
    assert set(lone) == ({(3, 0)} if h else {(3, 0), (3, 1)})


# --- n-gram join


def plain_classes(rows, percent=85, width=4):
    sets = []
    for _, text, *_ in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))))
        sets.append({tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    at = list(range(len(rows)))

    def root(k):
        while at[k] != k:
            k = at[k]
        return k

    for i in range(len(rows)):
        for k in range(i):
            both = len(sets[i] & sets[k])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[k]) - both):
                at[root(i)] = root(k)
    least = {}
    for k, (i, *_) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    return collections.Counter((i, len(sets[k]), least.get(root(k))) for k, (i, *_) in enumerate(rows))


@pytest.fixture(scope="module")
def near_rows():
    rng = random.Random(8)
    text = lambda n: " ".join(rng.choice("alpha Beta gamma delta eps zeta eta theta été iota".split()) + rng.choice("123456") for _ in range(n))
    rows = []
    for n in (1, 3, 4, 9, 12, 14, 17, 20, 22, 25, 28, 31, 35, 60, 200):  # sizes on both sides of any boundary
        for _ in range(3):
            base = text(n).split(" ")
            rows.append(" ".join(base))
            for _ in range(4):
                w = list(base)
                for _ in range(rng.choice([0, 1, 1, 2])):
                    w.insert(rng.randint(0, len(w)), rng.choice(["new", "word", "x"])) if rng.random() < 0.5 else w.pop(rng.choice([0, -1]))
                    w = w or ["w"]
                rows.append(" ".join(w))
    common = text(40)
    rows += [f"{text(3)} {common} {text(k)}" for k in range(12)]  # a passage most of a text, in unlike texts
    rows += [f"{common} {text(1)}" for _ in range(12)]  # and nearly all of it
    rows += [None, "", " \n ", "one", "ONE", "word " * 3000, "Word " * 2000]
    out = [(i, t, "en", "s", 0) for i, t in enumerate(rows)]
    return [*out, (None, rows[0], None, None, None), (None, "only rows without an id hold this text here", None, None, None), (3, rows[3], None, None, None)]


@pytest.mark.parametrize("edge", [None, 14])
def test_ngram_join_brute_force(spark, near_rows, edge):
    df = spark.createDataFrame(near_rows, DOCS).withColumns({"node": F.lit(1), "key": F.lit("x"), "n": F.lit(2.0)}).repartition(3)
    got = collections.Counter(tuple(r) for r in ngramjoin.ngram_classes(df, edge=edge).collect())
    assert got == plain_classes(near_rows)
    if edge is None:
        con = duckdb.connect()
        rows = pd.DataFrame(near_rows, columns=["doc_id", "text", "lang", "source", "n_chars"]).astype({"doc_id": "Int64"})
        con.register("documents", rows)
        found = con.sql(f"SELECT doc_id, n_shingles, component_id FROM ({ngramjoin.OP12_SQL})").fetchall()
        assert collections.Counter(found) == got


@pytest.mark.parametrize("percent, width", [(85, 4), (80, 5)])
def test_group_of_near_copies_is_not_compared_in_pairs(spark, monkeypatch, percent, width):
    """Classes of a group of near copies, changed at random places by nothing to beyond any link, against brute force; few pairs are compared."""
    from prosegauge.llm import setring

    rng = random.Random(17)
    base = [f"w{k}" for k in range(150)]
    rows = []
    for i in range(240):
        w = list(base)
        for at in rng.sample(range(len(w)), rng.choice([1, 2, 3, 4, 4, 4, 5])):
            w[at] = rng.choice(["some", f"new{rng.randrange(10**6)}"])
        rows.append((i, " ".join(w[rng.randrange(3) :])))
    compared, plain = [], setring.verified

    def counted(pairs, *more):
        compared.append(pairs.count())
        return plain(pairs, *more)

    monkeypatch.setattr(setring, "verified", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    if width == 4:
        got = {r.doc_id: r.component_id for r in ngramjoin.ngram_classes(docs).collect()}
    else:
        got = {r.doc_id: r.component_id for r in setring.set_classes(docs).collect()}
    assert got == {i: root for i, _, root in plain_classes(rows, percent, width)}
    assert 20 < len(set(got.values())) < 200
    assert sum(compared) < len(rows) ** 2 / 40  # of half as many times 20


def test_null_id_rows_join_classes(spark):
    """A set that only rows without an id hold links others, though it names nothing."""
    from prosegauge.llm import setring

    w = [f"w{k}" for k in range(100)]
    rows = [(1, " ".join(w)), (None, " ".join(w[10:] + [f"x{k}" for k in range(8)])), (2, " ".join(w[20:] + [f"x{k}" for k in range(16)]))]
    got = {r.doc_id: r.component_id for r in setring.set_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, None: 1, 2: 1}


def test_ngram_join_empty(spark):
    assert ngramjoin.ngram_classes(spark.createDataFrame([], DOCS)).count() == 0


def test_subsets_of_linked_sets_meet():
    """Any two sets of Jaccard 0.85 have an enumerated subset in common, and only equal subsets have equal keys."""
    rng = np.random.default_rng(2)
    for _ in range(300):
        n = int(rng.integers(1, 24))
        one = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
        other = np.unique(np.concatenate((one[rng.random(len(one)) > 0.08], rng.integers(0, 1 << 62, int(rng.integers(0, 3))).astype(np.uint64))))
        both = len(np.intersect1d(one, other))
        linked = both and 100 * both >= 85 * (len(one) + len(other) - both)
        met = len(other) and np.intersect1d(ngramjoin.subset_keys(one), ngramjoin.subset_keys(other)).size
        assert met or not linked
        if met:
            assert both >= min(ngramjoin.subset_sizes(len(one)))


def test_boundary_follows_cost():
    assert ngramjoin.boundary({}) == 0
    cheap_lists = {n: (1000, 1000) for n in range(1, 25)}
    dear_lists = {n: (1000, 10**9) for n in range(1, 25)}
    assert ngramjoin.boundary(cheap_lists) < ngramjoin.boundary(dear_lists)
    assert ngramjoin.light_sizes()[-1] >= 20
