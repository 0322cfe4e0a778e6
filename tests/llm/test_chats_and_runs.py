"""Chat formatting, periodic runs and the prefix trie against plain Python, on odd input too."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from weftwork.llm import chat_format, periodic_runs, prefix_trie
from weftwork.llm.common import read_table

TINY = "/root/testdata/sf0.001"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- periodic runs -------------------------------------------------------------------------------


def runs_by_hand(w):
    out = []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            a = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            n = i + q - a
            if n >= max(6, 4 * q) and not any(all(w[t] == w[t + r] for t in range(a, a + n - r)) for r in range(1, q)):
                out.append((a, n, q))
            i += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_against_every_period(spark):
    rng, texts = random.Random(7), []
    for i in range(600):
        w = []
        while len(w) < rng.randint(0, 60):
            w += [rng.choice("ab" if i % 2 else "abcd") for _ in range(rng.randint(1, 6))] * rng.choice([1, 1, 2, 4, 5, 9])
        texts.append(w)
    df = spark.createDataFrame([(i, "\t".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    for r in periodic_runs.periodic_runs(df).collect():
        w = texts[r.doc_id]
        want = runs_by_hand(w)
        gone = {i for s, n, q in want for i in range(s + q, s + n)}
        assert [tuple(x) for x in r.runs] == want
        assert r.collapsed == " ".join(x for i, x in enumerate(w) if i not in gone) and r.n_words == len(w)


def test_runs_query_against_plain_python(spark):
    docs = {r.doc_id: r.text for r in read_table(spark, TINY, "documents").collect()}
    got = periodic_runs.op12_periodic_runs(spark, TINY).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    assert sum(r.n_runs > 0 for r in got) >= 2
    for r in got:
        w = (docs[r.doc_id] or "").encode().split()
        h = zlib.crc32(str(r.doc_id).encode())
        if h % 10 == 0 and w:
            g = h // 10
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
        numbers = {x: i for i, x in enumerate(dict.fromkeys(w))}
        want = runs_by_hand([numbers[x] for x in w]) if len(w) < 1500 or r.n_runs else []
        gone = {i for s, n, q in want for i in range(s + q, s + n)}
        best = max(want, key=lambda x: (x[1] / x[2], -x[0], -x[2]), default=None)
        assert (r.start, r.length, r.period) == (best or (None,) * 3)
        assert r.exponent_milli == (best and 1000 * best[1] // best[2])
        assert r.n_runs == len(want) and r.runs_sha256 == sha("".join(f"{s},{n},{q}\n" for s, n, q in want))
        assert r.collapsed_sha256 == hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()


def test_runs_on_odd_texts(spark):
    long = " ".join(["hm"] * 50_000)
    rows = [(1, None), (2, ""), (3, " \n\t\x0b "), (4, long), (4, long), (None, "x\u00a0x " * 7), (5, "\U0001f600 é " * 3), (6, "a b c d e")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("runs", "collapsed", "n_words", "_best")})
    got = periodic_runs.periodic_runs(df).collect()
    assert sorted((str(r.doc_id), r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got) == sorted([
        ("1", 0, [], ""), ("2", 0, [], ""), ("3", 0, [], ""), ("4", 50_000, [(0, 50_000, 1)], "hm"), ("4", 50_000, [(0, 50_000, 1)], "hm"),
        ("None", 7, [(0, 7, 1)], "x\u00a0x"), ("5", 6, [], "\U0001f600 é \U0001f600 é \U0001f600 é"), ("6", 5, [], "a b c d e"),
    ])
    assert periodic_runs.periodic_runs(df.limit(0)).count() == 0
    best = spark.createDataFrame([([(0, 9, 2), (1, 18, 4), (20, 9, 2)],)], "runs array<struct<start:long,length:long,period:long>>").select(periodic_runs.highest(F.col("runs")).alias("b"))
    assert tuple(best.first().b) == (0, 9, 2)


# --- chat formatting -----------------------------------------------------------------------------

TEXTS = ["", "plain", r"\### Assistant: </turn> ok", "a\\", "### ", "#### x</turn>\n### user: hi", "</turn", ">\n", ": :", "\\\\</turn>\n", "\U0001f600\u2028", None]
MESSAGES = "tree long, id long, parent long, role string, text string, score double, t string, piece string"


@pytest.fixture(scope="module")
def forest(spark):
    rng, rows = random.Random(3), []
    for tree in [1, 2, 3, None]:
        for i in range(40):
            rows.append((tree, i, rng.randrange(max(0, i - 9), i) if i else None, rng.choice(["user", "assistant", "sys: ### x", None, ""]), rng.choice(TEXTS), rng.choice([None, 0.5, 1.0, -2.0]), "clash", "clash"))
    rows += [(4, 0, 77, "user", "root whose parent is absent", 1.0, "", ""), (4, 1, 0, "assistant", "reply", 2.0, "", ""), (4, 1, 0, "assistant", "reply", 2.0, "", "")]
    rows += [(5, 1, 2, "user", "round", 1.0, "", ""), (5, 2, 1, "user", "and round", 1.0, "", ""), (5, 3, 2, "user", "tail", 1.0, "", ""), (5, None, 1, "user", "no id", 1.0, "", "")]
    return rows


def paths_by_hand(rows):
    nodes = {(r[0], r[1]): r for r in rows if r[1] is not None}
    parents = {(r[0], r[2]) for r in nodes.values() if (r[0], r[2]) in nodes}
    found = defaultdict(list)
    for key, r in nodes.items():
        path, at = [r], r
        while (at := nodes.get((at[0], at[2]))) is not None and len(path) < 1000:
            path.append(at)
        if key not in parents and len(path) < 1000:
            found[key[0]].append((-(sum(x[5] or 0 for x in path) / len(path)), key[1], path[::-1]))
    return {(tree, leaf): (rank, path) for tree, those in found.items() for rank, (_, leaf, path) in enumerate(sorted(those, key=lambda x: x[:2]))}


def test_paths_ranks_and_round_trip(spark, forest):
    df = spark.createDataFrame(forest, MESSAGES)
    want = paths_by_hand(forest)
    pieces = chat_format.formatted_paths(df)
    whole = {(r.tree, r.leaf): r for r in chat_format.assembled(pieces).collect()}
    back = {(r.tree, r.leaf): r for r in chat_format.read_back(pieces).collect()}
    assert set(whole) == set(back) == set(want)
    assert {k: r["rank"] for k, r in whole.items()} == {k: v[0] for k, v in want.items()}
    for key, (_, path) in want.items():
        said = [(r[3] or "", r[4] or "") for r in path]
        learned = [t for role, t in said if role == "assistant"]
        text, spans = whole[key].text, whole[key].mask
        assert [chat_format.unescaped(text[s.start : s.end]) for s in spans] == learned
        assert back[key].turns_sha256 == sha("".join(f"{r}\n{t}\n" for r, t in said)) and back[key].n_turns == len(said)
        assert back[key].loss_sha256 == sha("".join(learned)) and back[key].loss_chars == len("".join(learned)) and back[key].formatted_chars == len(text)
        assert len(re.findall(r"(?<!\\)(?:\\\\)*</turn>\n", text)) == len(said)
    best = chat_format.formatted_paths(df, per_tree=2)
    assert {(r.tree, r.leaf) for r in best.select("tree", "leaf").distinct().collect()} == {k for k, v in want.items() if v[0] < 2}
    assert chat_format.formatted_paths(df.limit(0)).count() == 0


def test_reader_takes_any_cut_of_the_text():
    text = "### user: a\\</turn>\n\\\\</turn>\n### x\\:y: </turn>\n"
    for cut in range(len(text)):
        reader = chat_format.Reader()
        reader.feed(text[:cut], [])
        reader.feed(text[cut:], [])
        assert reader.result()["turns_sha256"] == sha("user\na</turn>\n\\\nx:y\n\n")
    with pytest.raises(ValueError):
        chat_format.Reader().feed("no turn</turn>\n", [])


def test_conversations_with_nulls_and_ties(spark):
    rows = [(1, None, "assistant", "first"), (1, 0, None, None), (1, 0, "assistant", None), (1, 5, "assistant", "x"), (1, 5, "assistant", "x"), (None, 1, "user", "no id"), (2, 0, "user", "y" * 200_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("id", F.lit("clash"))
    got = {r.tree: r for r in chat_format.read_back(chat_format.formatted_paths(chat_format.as_chains(df))).collect()}
    assert got[1].turns_sha256 == sha("assistant\nfirst\n\n\nassistant\n\nassistant\nx\nassistant\nx\n") and got[1].loss_sha256 == sha("firstxx")
    assert got[None].n_turns == 1 and got[2].formatted_chars == 200_018 and got[2].loss_chars == 0


# --- prefix trie ---------------------------------------------------------------------------------


def trie_by_hand(convs):
    members = defaultdict(set)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].add(c)
    out = set()
    for node, who in members.items():
        below = [x for x in members if x[: len(node)] == node]
        kids = [x for x in below if len(x) == len(node) + 1]
        leaves = sum(not any(y[:-1] == x and y for y in below) for x in below)
        saved = sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in below if x)
        ends = ",".join(map(str, sorted(c for c in who if len(convs[c]) == len(node))))
        out.add((min(who), len(node), min(members[node[:-1]]) if node else None, len(who), len(kids), leaves, saved, sha(ends)))
    return out


def plain(df):
    rows = [tuple(r) for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize(("levels", "limit"), [(32, 100_000), (3, 40), (1, 0)])
def test_trie_in_blocks_and_one_by_one(spark, levels, limit):
    rng, convs = random.Random(5), {}
    for c in range(-3, 90):
        base = convs[rng.choice(list(convs))] if convs and rng.random() < 0.7 else []
        convs[c] = base[: rng.randint(0, 12)] + [(rng.choice("ab"), rng.choice(["x", "é", ""])) for _ in range(rng.randint(0, 4))]
    rows = [(c, i, r, t, "clash") for c, turns in convs.items() for i, (r, t) in enumerate(turns)] + [(c, None, None, None, "clash") for c, turns in convs.items() if not turns]
    df = spark.createDataFrame(rows + [(None, 0, "a", "lost", "clash")], "conv_id long, pos long, role string, text string, keys string")
    assert plain(prefix_trie.prefix_trie(df, levels=levels, limit=limit)) == trie_by_hand(convs)


def test_trie_on_odd_input(spark):
    rows = [(1, 0, "ab", "c"), (2, 0, "a", "bc"), (3, None, "a", None), (3, 1, None, None), (3, 1, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, pos long, role string, text string")
    assert plain(prefix_trie.prefix_trie(df)) == trie_by_hand({1: [("ab", "c")], 2: [("a", "bc")], 3: [("a", ""), ("", ""), ("", "")]})
    assert prefix_trie.prefix_trie(df.limit(0)).count() == 0


def test_rebuilt_conversations(spark):
    rows = [(c, t if t != 3 else None, "user" if t % 2 == 0 else None, f"{c // 5}-{t}" if t != 2 else None) for c in range(40) if c not in (5, 20) for t in range(c % 11 + 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    own = defaultdict(list)
    for c, t, r, x in rows:
        own[c].append((-1 if t is None else t, r or "", x or ""))
    own = {c: [x[1:] for x in sorted(v)] for c, v in own.items()}
    want = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        want[c] = own.get(c - c % 5, [])[:h] + own[c][h:]
    assert any(not v for v in want.values())
    assert plain(prefix_trie.prefix_trie(prefix_trie.rebuilt(df))) == trie_by_hand(want)
