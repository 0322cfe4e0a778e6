"""Labels within two edits against all pairs."""

import random
import re

from weftwork.operators import mapping


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def normal(s):
    return re.sub(r"[\W_]+", " ", s.lower()).strip()


def test_near_labels_against_all_pairs(spark):
    rng = random.Random(3)
    terms = ["".join(rng.choice("abcé ") for _ in range(rng.randint(1, 16))) for _ in range(150)]
    variables = []
    for t in terms:
        v = list(t)
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, len(v))
            v[at : at + rng.randint(0, 1)] = rng.choice(["", "x", "_", "B"])
        variables.append("".join(v))
    frame = spark.createDataFrame([*enumerate(variables), (900, None), (901, "--")], "variable long, label string")
    known = spark.createDataFrame([*enumerate(terms), (0, terms[0]), (902, None)], "term long, label string")

    def may(n):
        return 2 if n >= 7 else 1 if n >= 4 else 0

    want = {}
    for i, v in enumerate(map(normal, variables)):
        for j, t in enumerate(map(normal, terms)):
            if v and t and (d := edits(v, t)) <= min(may(len(v)), may(len(t))):
                want[i, j] = d
    got = mapping.near_labels(frame, known).collect()
    assert len(got) == len(want) > 100 and {(r.variable, r.term): r.edits for r in got} == want
    table = {r.variable: r for r in mapping.mapping_table(frame, known).collect()}
    for i in {i for i, _ in want}:
        best = sorted((d, j) for (k, j), d in want.items() if k == i)
        assert (table[i].edits, table[i].term) == best[0]
        assert table[i].margin == (best[1][0] - best[0][0] if len(best) > 1 else None) and table[i].sure == (len(best) == 1 or best[1][0] > best[0][0])
    assert set(table) == {i for i, _ in want} and mapping.mapping_table(frame, known.limit(0)).count() == 0
