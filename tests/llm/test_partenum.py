"""Jaccard components against brute force."""

import random
import re

import pytest

from lumaframe.llm import components, partenum, queries


def shingles(text):
    w = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", w) if x]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    """rows: (id, text) -> (size, component) of each."""
    sets = [shingles(t) for _, t in rows]
    at = list(range(len(rows)))

    def find(i):
        while at[i] != i:
            at[i] = at[at[i]]
            i = at[i]
        return i

    where = {}
    for i, s in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(i)
    for i, s in enumerate(sets):
        shared = {}
        for x in s:
            for j in where[x]:
                if j < i:
                    shared[j] = shared.get(j, 0) + 1
        for j, n in shared.items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                at[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if sets[i] and k is not None:
            least[find(i)] = min(k, least.get(find(i), k))
    return sorted((k is None, k or 0, len(s), (least.get(find(i)) if s else k) or 0) for i, ((k, _), s) in enumerate(zip(rows, sets)))


def found(df):
    return sorted((r["_id"] is None, r["_id"] or 0, r.n_shingles, r.component_id or 0) for r in df.collect())


def corpus(seed, n=250):
    rng, vocab = random.Random(seed), [f"w{i}" for i in range(300)]
    passage, rows = [rng.choice(vocab) for _ in range(40)], []
    for i in range(n):
        kind = rng.random()
        if kind < 0.4 and rows:
            w = rows[rng.randrange(len(rows))][1].split()
            for _ in range(rng.randrange(0, 1 + len(w) // 15)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            if rng.random() < 0.5:
                w = w[: max(1, int(len(w) * rng.uniform(0.7, 1)))]
        elif kind < 0.7:
            w = passage + [rng.choice(vocab) for _ in range(rng.randrange(0, 40))]
        else:
            w = [rng.choice(vocab) for _ in range(rng.choice([1, 2, 4, 5, 6, 7, 9, 12, 30, 200]))]
        rows.append((i, " ".join(w) if rng.random() < 0.8 else "\n ".join(w).upper()))
    return rows


@pytest.mark.parametrize(("seed", "few", "many"), [(1, 12, 256), (2, 2, 3), (3, 1, 1), (4, 1, 100)])
def test_components_are_those_of_brute_force(spark, monkeypatch, seed, few, many):
    monkeypatch.setattr(partenum, "FEW", few)
    monkeypatch.setattr(partenum, "MANY", many)
    monkeypatch.setattr(partenum, "MEET", 3000)
    monkeypatch.setattr(partenum, "HELD", 500)
    rows = [*corpus(seed), (500, None), (501, ""), (502, " \n"), (None, "a b c d e f g"), (503, "A b c d e f g"), (7, "a b c d e f g"), (504, "x " * 30000), (505, "a b"), (505, "a b")]
    docs = spark.createDataFrame([(k, t, "x", 1) for k, t in rows], "doc_id long, text string, n string, node int")
    assert found(partenum.classes(docs)) == brute(rows)
    kept = [(r.doc_id, r.text) for r in partenum.keep_one(docs).collect()]
    apart = brute([(i, t) for i, (_, t) in enumerate(rows)])  # two components are named 7
    assert len(kept) == len({x[3] for x in apart}) and {k for k, t in kept if shingles(t)} >= {b[3] for b in brute(rows) if b[2]} - {0}


def test_empty(spark):
    docs = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert found(partenum.classes(docs)) == [(False, 1, 0, 1), (False, 2, 0, 2)]
    assert partenum.classes(docs.limit(0)).count() == 0


def test_components_of_one_name_are_kept_apart(spark):
    """Unrelated texts without an id, or of one id, are components of their own; a copy without an id goes."""
    rows = [(None, "one two three four five six"), (None, "red green blue grey black white"), (None, "lone"), (4, "sun moon star sky rain snow"), (4, "iron lead tin zinc gold silver"), (None, "Sun moon star sky rain snow"), (None, "one two three  four five six")]
    kept = sorted((r.doc_id or 0, " ".join(r.text.split())) for r in partenum.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert kept == sorted((k or 0, t) for k, t in rows[:5])
    rows = [*corpus(1), (7, "a b c d e f g"), (503, "A b c d e f g")]  # row 7 of the corpus has another text
    apart = brute([(i, t) for i, (_, t) in enumerate(rows)])
    assert partenum.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).count() == len({x[3] for x in apart})


def test_bands_hold_all_similar_sizes():
    table = partenum.bands(5000)
    of = lambda n: next(i for i, (a, b) in enumerate(table) if a <= n <= b)
    for s in range(1, 1500):
        for r in range(s, 4 * s // 3 + 1):
            assert of(r) - of(s) in (0, 1)
            assert (r + s) // 7 <= partenum.shape(table[of(s)][1])[1]


def test_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    got = {r.node: r.root for r in components.components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, 101: 100}


def test_query(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    got = sorted((False, r.doc_id, r.n_shingles, r.component_id) for r in queries.op4_partenum_jaccard(spark, "/root/testdata/sf0.01").collect())
    assert got == brute(rows)


def test_few_links_take_no_rounds_and_many_the_same_result(spark, monkeypatch):
    rng = random.Random(3)
    links = [(x, x) for x in range(3)] + [tuple(rng.sample(range(400), 2)) for _ in range(220)] + [(500 + i, 501 + i) for i in range(50)] + [(2**62, -(2**62))]
    edges, labels = spark.createDataFrame(links + links[:40], "a long, b long"), []
    real = components.written
    monkeypatch.setattr(components, "written", lambda df, label, *few, **more: labels.append(label) or real(df, label, *few, **more))
    few = sorted(map(tuple, components.components(edges).collect()))
    assert "edges" not in labels
    monkeypatch.setattr(components, "SMALL", 0)
    assert sorted(map(tuple, components.components(edges).collect())) == few and labels.count("edges") > 2
    least = {x: x for link in links for x in link}
    for _ in range(len(least)):
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    assert few == sorted((x, r) for x, r in least.items() if x != r)
    assert components.components(edges.limit(0)).count() == 0


def test_members_of_differences_are_counted_by_blocks(spark):
    """Of 600 nodes of a pivot that have 40 members in common and 5 of their own, the rows joined with the counts go by blocks; ranks are those of all nodes."""
    rng = random.Random(8)
    nodes = [(p, x, x % 2 == 0, rng.randrange(1, 12), sorted({t * 7 - 100 for t in range(60) if rng.random() < 0.6} | {10**9 * (x + 1) + i for i in range(5)})) for p, top in ((3, 600), (4, 7)) for x in range(top)]
    outer = spark.createDataFrame([(p, x % 3, x, 150, len(v), out, x, least, v) for p, x, out, least, v in nodes] + [(5, 0, 1, 9, 0, True, 1, 1, [])], "p long, s long, x long, n long, d long, out boolean, root long, least long, tokens array<long>")
    join = partenum.Join(spark.createDataFrame([(1, "a")], "doc_id long, text string"))
    got = sorted((r.p, r.x, r.i, r.t, r.some, r.d, r.out) for r in join.first(outer).collect())
    want = []
    for pivot in (3, 4):
        of = {}
        for p, *_, v in nodes:
            for t in v if p == pivot else ():
                of[t] = of.get(t, 0) + 1
        for p, x, out, least, v in nodes:
            if p == pivot:
                held = sorted((of[t], t) for t in v if of[t] > 1)
                want += [(p, x, i + 1, t, len(held), len(v), out) for i, (_, t) in enumerate(held[: max(0, len(held) + 1 - least)])]
    assert got == sorted(want)
    joined = join.spent[-1].where("t < 1000").count()
    assert joined <= 6 * 60 and sum(t < 1000 for *_, v in nodes for t in v) > 50 * joined


def near_copies(seed, n, most):
    """n texts of 150 words that are one text with 0 to `most` words changed each; without the text itself, so that only some pairs are similar."""
    rng = random.Random(seed)
    base = [f"b{i}" for i in range(150)]
    rows = []
    for i in range(n):
        w = list(base)
        for at in rng.sample(range(150), rng.randrange(1, most + 1)):
            w[at] = f"x{rng.randrange(10**9)}"
        rows.append((i, " ".join(w)))
    return rows


def test_one_group_of_near_copies(spark):
    """Of 2,000 near copies, most pairs of which are just not similar, no link is lost and the candidates stay far from the square."""
    rows = near_copies(5, 2000, 9)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(partenum.classes(docs)) == brute(rows)
    join = partenum.Join(docs)
    central, seen = join.central(), []
    led, scheme = components.components(join.verified(join.led(central))), join.scheme()
    signed = join.signed(scheme, central, led)
    near, more = join.pivoted(scheme, signed, led, central)
    seen = [join.led(central).count(), signed.count(), near.count(), more.count()]
    assert max(seen) < 100_000, seen  # of 1,999,000 pairs


def thue_morse(n):
    w = "a"
    while len(w) < n:
        w += w.translate(str.maketrans("ab", "ba"))
    return w


def test_words_that_cancel_out(spark):
    """A word of 1,024 letters and its complement, equal under any polynomial hash modulo a power of two, are different words."""
    one = thue_morse(1024)
    two = one.translate(str.maketrans("ab", "ba"))
    rows = [(1, f"a b c d {one}"), (2, f"a b c d {two}"), (3, f"a b c d {one[:40]}"), (4, f"a b c d {two[:40]}"), (5, f"A b c d {one}")]
    assert found(partenum.classes(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)
