import random
import re
import tracemalloc

import pytest

from hearken.llm import jaccard_join as J
from hearken.llm.queries import QUERIES
from tests.llm.data import SMALL


def shingles(text, k=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return set()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)}


def brute(rows):
    """component by id, over all pairs."""
    sets = [(i, shingles(t)) for i, t in rows]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in range(len(sets)):
        for y in range(x):
            a, b = sets[x][1], sets[y][1]
            if a and b and 100 * min(len(a), len(b)) >= 80 * max(len(a), len(b)):
                both = len(a & b)
                if 100 * both >= 80 * (len(a) + len(b) - both):
                    parent[find(x)] = find(y)
    roots = [find(x) for x in range(len(sets))]
    return [min(sets[y][0] for y in range(len(sets)) if roots[y] == roots[x]) for x in range(len(sets))], [len(s) for _, s in sets]


def check(spark, rows, **options):
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in J.groups(spark.createDataFrame(rows, "doc_id long, text string"), **options).collect())
    comp, n = brute(rows)
    assert got == sorted(zip([i for i, _ in rows], n, comp, strict=True))


def made(seed, documents=60, shared=False):
    rng = random.Random(seed)
    passage = " ".join(rng.choice("abcdefghij") * 3 for _ in range(60))
    rows, words = [], [f"w{i}" for i in range(500)]
    for i in range(documents):
        if rows and rng.random() < 0.6:
            base = rng.choice(rows)[1].split()
            for _ in range(rng.randint(0, 4)):
                if base:
                    base[rng.randrange(len(base))] = rng.choice(words)
        else:
            base = [rng.choice(words) for _ in range(rng.choice([0, 1, 3, 5, 8, 20, 80, 200]))]
            base += passage.split() if shared else []
        rows.append((rng.randrange(10_000_000), " ".join(base)))
    return rows


@pytest.mark.parametrize("options", [{}, {"often": 2, "large": 3}, {"often": 1, "large": 1, "most_often": 20}])
def test_groups_match_brute_force(spark, options):
    check(spark, made(1, 80, shared=bool(options)), **options)


def test_large_tiles_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(J, "BLOCK", 3)
    rng = random.Random(9)
    rows = []
    for i in range(60):
        words = ["same"] * 2 + [f"c{k}" for k in range(rng.choice([8, 9, 10, 11, 12, 13]))]
        if rng.random() < 0.5:
            words[rng.randrange(len(words))] = f"r{rng.randrange(6)}"
        rows.append((1000 - i, " ".join(words)))
    check(spark, rows, often=1, large=2)
    check(spark, rows, often=100, large=2)


def test_query_on_the_small_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    comp, n = brute([tuple(r) for r in docs])
    want = {d["doc_id"]: (k, c) for d, k, c in zip(docs, n, comp, strict=True)}
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in next(f for q, f in QUERIES.items() if q.startswith("op6_"))(spark, SMALL).collect()}
    assert got == want


def test_edges(spark):
    text = " ".join(f"x{i}" for i in range(50))
    rows = [(5, text), (5, text), (3, text.upper()), (None, text), (7, None), (8, ""), (9, "one"), (10, "One "), (11, "x " * 40000)]
    docs = spark.createDataFrame([(*r, 1, 2, "x", None, 3, 4, 5) for r in rows], "doc_id long, text string, n int, comp int, _id string, _key int, _gone int, cls int, row int")
    got = sorted((str(r["doc_id"]), r["n_shingles"], r["component_id"]) for r in J.groups(docs).collect())
    assert got == sorted([("5", 46, 3), ("5", 46, 3), ("3", 46, 3), ("None", 46, 3), ("7", 0, 7), ("8", 0, 8), ("9", 1, 9), ("10", 1, 9), ("11", 1, 11)])
    kept = J.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [3, 7, 8, 9, 11]
    assert J.groups(docs.limit(0)).count() == 0


def test_bit_counts_bound_the_overlap():
    rng = random.Random(3)
    shingle = J.Shingler()
    for _ in range(50):
        a = [f"t{rng.randrange(3000)}" for _ in range(rng.randint(5, 300))]
        b = list(a)
        for _ in range(rng.randint(0, 6)):
            b[rng.randrange(len(b))] = "new"
        x, y = shingle(" ".join(a)), shingle(" ".join(b))
        both = len(set(x.tolist()) & set(y.tolist()))
        if 100 * both >= 80 * (len(x) + len(y) - both):
            assert J.may_link(J.bitmap(x), len(x), J.bitmap(y), len(y))


def test_one_of_each_goes_by_component_and_not_by_id(spark):
    one, two, three = (" ".join(f"{k}{i}" for i in range(50)) for k in "abc")
    schema = "doc_id long, text string"

    def kept(rows):
        return sorted((str(r["doc_id"]), r["text"][0]) for r in J.one_of_each(spark.createDataFrame(rows, schema)).collect())

    # Unrelated texts without an id both stay.
    assert kept([(None, one), (None, two), (None, two)]) == [("None", "a"), ("None", "b")]
    # So do two texts of one id; the second text's copy under another id goes.
    assert kept([(7, one), (7, two), (12, two), (9, three)]) == [("7", "a"), ("7", "b"), ("9", "c")]


def test_lists_of_members(spark):
    rows = spark.createDataFrame([(1, c, 20 + c % 2) for c in range(30)] + [(2, c, 20 + c % 2) for c in range(30)] + [(3, 5, 21), (4, 5, 21), (4, 6, 20)], "shingle long, cls long, size long")
    got = [tuple(r) for r in J._lists(rows, 80).select("shingle", "cls", "n", "short", "c").collect()]
    assert sorted(got) == sorted([(1, c, 10, c % 2 == 1, 30) for c in range(30)] + [(4, 5, 10, True, 2), (4, 6, 10, False, 2)])


def test_quarter_of_the_hashes_bounds_the_overlap():
    """Texts with a passage in common go by a bitmap of a quarter of the width; no pair that links goes."""
    pick = random.Random(8)
    hashes = lambda n: {pick.getrandbits(64) for _ in range(n)}
    array = lambda s: J.np.array(sorted(s), J.np.uint64)
    gone = 0
    for size in (3, 40, 300, 2000):
        for share in (0.05, 0.8, 0.95):
            for _ in range(10):
                x = hashes(size)
                y = set(list(x)[: int(size * share) + 1]) | hashes(size - int(size * share) - 1)
                a, b = array(x), array(y)
                few, other = J.bitmap(a, J.QUARTER), J.bitmap(b, J.QUARTER)
                may = J.may_link(few, len(a), other, len(b))
                assert may or 100 * len(x & y) < 80 * len(x | y)
                if size >= 300:
                    assert len(few) * J.QUARTER == len(J.bitmap(a))
                gone += share == 0.05 and size >= 300 and not may
    assert gone == 20


def test_sums_of_a_shingle_are_short(spark):
    """An exchange carries a shingle, its count and one sum of its classes: most shingles are of one class."""
    rows = spark.createDataFrame([(1, 7, 21), (1, 8, 20), (2, 7, 21), (3, 9, 20), (4, 7, 21), (4, 8, 20)], "shingle long, cls long, size long")
    seen = []
    keep = J.stored
    J.stored = lambda df, name, **options: seen.append((name, df._jdf.queryExecution().optimizedPlan().toString())) or keep(df, name, **options)
    try:
        got = [tuple(r) for r in J._lists(rows, 80).select("cls", "n", "short", "c").collect()]
    finally:
        J.stored = keep
    assert sorted(got) == [(7, 10, True, 2), (8, 10, False, 2)]
    plan = next(plan for name, plan in seen if name == "chosen")
    assert "bit_xor" in plan and "max(cls" not in plan and "min(cls" not in plan


def test_only_recurring_shingles_leave_their_shard(spark, monkeypatch):
    """Shingles of one class, which are most, go packed to their shard and no further; frequent ones, in lots of
    few rows too, all come out with their classes."""
    monkeypatch.setattr(J, "IN_LOT", 40)
    pick = random.Random(5)
    often, pair = 1 << 30, (2 << 40) + 7
    sets = {c: sorted({often, *([pair] if c in (3, 20) else []), *(pick.getrandbits(64) | 1 << 63 for _ in range(60))}) for c in range(1, 31)}
    row = lambda c: (c % 2 << 33) + c
    firsts = spark.createDataFrame([(row(c), c, len(s), bytearray(J.np.array(s, J.np.uint64).tobytes())) for c, s in sets.items()], "row long, cls long, n int, shingles binary")
    classes = firsts.select("cls", "n", firsts["row"].alias("first"))
    for shards in (1, 8):
        got = sorted(tuple(r) for r in J._postings(firsts, classes, J.np.zeros(0, J.np.uint64), 80, shards).collect())
        assert got == sorted([(often >> 24, c, 2 * len(s) + 1) for c, s in sets.items()] + [(pair >> 24, c, 2 * len(sets[c]) + 1) for c in (3, 20)])


def test_packed_shingles():
    pick = random.Random(6)
    keys = J.np.unique(J.np.array([pick.getrandbits(40) for _ in range(50_000)], J.np.uint64))
    beside = J.np.arange(len(keys))
    got = [J._unpacked(J.pa.Table.from_batches([b])) for b in (J._packed(keys, beside, 9, n, False) for n in (1, 16))]
    assert all((k == keys).all() and (b == beside).all() and (base == 9).all() for k, b, base in got)
    assert sum(len(x.as_buffer()) for x in J._packed(keys, beside, 9, 16, False).column("keys")) < 4 * len(keys)


def test_sets_do_not_go_to_every_tile_of_a_class(spark, monkeypatch):
    """Classes in many large tiles: their sets go to the pairs that may link, each once, and to no block; blocks of
    very many candidates, which do get sets, give the same components."""
    pick = random.Random(12)
    sets = {}
    for g in range(4):
        own = [pick.getrandbits(64) for _ in range(190)]
        sets |= {10 * g + k: J.np.array(sorted([*own, *(pick.getrandbits(64) for _ in range(5))]), J.np.uint64) for k in range(3)}
    firsts = spark.createDataFrame([(c, len(x), bytearray(x.tobytes()), bytearray(J.bitmap(x)), bytearray(J.bitmap(x, J.QUARTER))) for c, x in sets.items()], "cls long, n long, shingles binary, bits binary, few binary")
    large = J.stored(spark.createDataFrame([(t, c, len(x), True, 23, 12, c) for t in range(5) for c, x in sets.items()], "shingle long, cls long, n long, short boolean, band int, c long, comp long"), "test")
    asked = []
    needed = J._needed
    monkeypatch.setattr(J, "_needed", lambda firsts, rows, by, columns: asked.append((*by, *columns)) or needed(firsts, rows, by, columns))
    for most, seen in ((4, ("a", "b", "shingles")), (0, ("cls", "bits", "shingles"))):
        monkeypatch.setattr(J, "MOST_PAIRS", most)
        asked.clear()
        got = {tuple(r) for r in J._within_large(large, firsts, 80).collect()}
        assert all(a // 10 == b // 10 for a, b in got) and all(len({*got} & {(x, x + 1), (x, x + 2), (x + 1, x + 2)}) >= 2 for x in (0, 10, 20, 30))
        assert seen in asked and (most == 0) == (("cls", "bits", "shingles") in asked)


def test_a_shard_is_not_unpacked_whole():
    pick = random.Random(7)
    parts = []
    for base in range(8):
        keys = J.np.unique(J.np.array([pick.getrandbits(40) for _ in range(60_000)], J.np.uint64))
        parts.append(J._packed(keys, J.np.arange(len(keys)) % 1000, base, 1, False))
    rows = J.pa.Table.from_batches(parts)

    def most(work):
        tracemalloc.start()
        out = work()
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return out, peak

    (keys, beside, _), whole = most(lambda: J._unpacked(rows))
    both, own = most(lambda: J._sorted_keys(rows, 24))
    assert (both >> J.np.uint64(24) == keys).all() and sorted(both.tolist()) == sorted((keys << J.np.uint64(24) | beside.astype(J.np.uint64)).tolist())
    assert own < 20 * len(keys) < 0.6 * whole


def test_workers_let_go_what_other_modules_keep():
    from hearken.llm import sentencepiece_codec, shared

    def work(batches):
        yield from batches

    sentencepiece_codec.decoder(sentencepiece_codec.public_model())
    work.__module__ = sentencepiece_codec.__name__
    assert list(shared.lean(work)([1])) == [1] and sentencepiece_codec.decoder.cache_info().currsize
    work.__module__ = J.__name__
    assert list(shared.lean(work)([1])) == [1] and not sentencepiece_codec.decoder.cache_info().currsize
