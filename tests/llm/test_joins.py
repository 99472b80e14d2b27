"""Jaccard join, hard negatives and conversation repair against brute force."""

import hashlib
import heapq
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from accordant.llm import conversations, hard_negatives, jaccard_join
from accordant.llm.common import table


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set()


def brute_components(rows):
    """doc_id, n_shingles, component_id of every row by all pairs that share a shingle."""
    own, above = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while above[x] != x:
            x = above[x]
        return x

    lists = {}
    for i, s in enumerate(own):
        times = {}
        for g in s:
            for j in lists.setdefault(g, []):
                times[j] = times.get(j, 0) + 1
            lists[g].append(i)
        for j, k in times.items():
            if 100 * k >= 85 * (len(s) + len(own[j]) - k):
                above[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        k = find(i)
        if d is not None:
            least[k] = min(least.get(k, d), d)
    return sorted((str(d), len(own[i]), str(least.get(find(i)))) for i, (d, _) in enumerate(rows))


def joined(docs):
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard_join.jaccard_components(docs).collect())


def test_jaccard_join_on_documents(spark, sf):
    docs = table(spark, sf.replace("0.001", "0.01"), "documents")
    assert joined(docs) == brute_components([(r.doc_id, r.text) for r in docs.collect()])


def test_jaccard_join_of_mutated_families(spark):
    """Families round the threshold, chains, a hot passage, sizes on both sides of block edges, copies, short and empty texts."""
    draw = random.Random(4)
    word = lambda: f"w{draw.randrange(10**6)}"
    rows, hot = [], [word() for _ in range(40)]
    for size in (4, 5, 8, 13, 20, 40, 75, 150, 300):
        base = [word() for _ in range(size)]
        for k in range(40):
            text = list(base)
            for _ in range(draw.randrange(0, max(2, size // 25))):
                text[draw.randrange(len(text))] = word()
            rows.append(" ".join(text[draw.randrange(3) :] + [word() for _ in range(draw.randrange(max(1, size // 20)))]))
        chain = list(base)
        for k in range(12):  # each like the one before, the first unlike the last
            chain = chain[max(1, size // 40) :] + [word() for _ in range(max(1, size // 40))]
            rows.append(" ".join(chain))
    rows += [" ".join(hot + [word() for _ in range(draw.randrange(5, 120))]) for _ in range(80)]
    rows += [None, "", " \t\n", "one", "One", "a b", "a b c", "A B C d", "À b c d e", rows[5], rows[5].upper(), "x " * 50_000]
    draw.shuffle(rows)
    rows = [(k if k % 17 else None, t) for k, t in enumerate(rows)] + [(3, rows[3]), (3, "other words of the same number here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("node", "digest", "label", "n", "key", "row")})
    got = joined(docs.repartition(7))
    want = brute_components(rows)
    empty = [(str(d), 0, str(d)) for d, t in rows if not shingles(t)]
    assert [r for r in got if r[1]] == [r for r in want if r[1]] and sorted(r for r in got if not r[1]) == sorted(empty)
    assert jaccard_join.jaccard_components(docs.limit(0)).count() == 0


def test_reach_loses_no_partner():
    """For all sizes: a partner of any fitting size that shares just enough is still within reach when the first common token stands last."""
    for n in range(1, 400):
        block, own, below = jaccard_join.reach(n)
        q, _ = jaccard_join.listed(n)
        for m in range(-(-85 * n // 100), 100 * n // 85 + 1):
            overlap = -(-85 * (n + m) // 185)
            other = int(np.searchsorted(jaccard_join.EDGES, m, "right")) - 1
            assert abs(other - block) <= 1
            shared = min(overlap - n + q, overlap - m + jaccard_join.listed(m)[0])
            assert shared >= 1
            assert (below if other < block else own) >= q - shared + 1


VECTORS = [(k, k % 3, None) for k in range(0, 40)]


def as_rows(draw, n, size=6, spread=1.0):
    return [(k, draw.randrange(4), [draw.gauss(0, spread) for _ in range(size)]) for k in range(n)]


def brute_negatives(rows):
    known = {(i, label, tuple(v)) for i, label, v in rows if i is not None and label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    known = [(i, label, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, label, v in known]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = set()
    for i, label, v in known:
        if i % 5 == 0:
            rest = sorted((-dot(v, w), j, other) for j, other, w in known if j != i)
            for s, j, _ in [r for r in rest if r[2] == label][:5]:
                near = [r for r in rest if r[2] != label and 50 * -s <= 100 * -r[0] <= 95 * -s][:3]
                out |= {(i, j, k + 1, r[1], -s, -r[0]) for k, r in enumerate(near)}
    return out


@pytest.mark.parametrize("case", ["spread", "ties", "clusters"])
def test_hard_negatives_by_all_pairs(spark, case, monkeypatch):
    draw = random.Random(len(case))
    rows = as_rows(draw, 300)
    if case == "ties":
        rows = [(k, label, [round(x) / 256 for x in v]) for k, label, v in rows] + [(k, k % 4, rows[7][2]) for k in range(300, 500)]
    if case == "clusters":
        mid = [[draw.gauss(0, 3) for _ in range(7)] for _ in range(12)]
        rows = [(k, k % 4, [x + draw.gauss(0, 0.2) for x in mid[k % 12]]) for k in range(400)]
        monkeypatch.setattr(hard_negatives, "ANCHORS", 30)  # several blocks
    rows += [rows[5], rows[10], (None, 1, [1.0] * 6), (600, None, [1.0] * 6), (601, 1, None), (602, 1, [1.0, None]), (603, 2, [float("nan")]), (604, 2, [float("inf")]), (605, 1, []), (610, 1, [2.0, 1.0])]
    docs = spark.createDataFrame([(i, label, v and [None if x is None else float(np.float32(x)) for x in v]) for i, label, v in rows], "vec_id long, label int, vector array<float>")
    docs = docs.withColumns({c: F.lit("x") for c in ("cell", "score", "id", "anchor")})
    got = hard_negatives.hard_negatives(docs.repartition(5), F.col("vec_id") % 5 == 0).collect()
    assert len(got) == len({tuple(r) for r in got}) and {tuple(r) for r in got} == brute_negatives(rows)
    assert hard_negatives.hard_negatives(docs.limit(0), F.col("vec_id") % 5 == 0).count() == 0
    assert hard_negatives.hard_negatives(docs, F.lit(False)).count() == 0


def test_hard_negatives_equal_their_sql(spark, sf):
    for at in (sf, sf.replace("0.001", "0.1")):
        known = duckdb.connect()
        known.execute(f"create view embeddings as select * from '{at}/embeddings.parquet'")
        want = known.execute(hard_negatives.SQL).fetchall()
        got = hard_negatives.op12_hard_negatives(spark, at).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()
        assert sorted(map(tuple, got)) == sorted(want)


def test_cells_are_visited_in_order_and_bounds_hold():
    draw = np.random.default_rng(2)
    x = np.floor(256 * draw.normal(0, 1, (500, 9)))
    books = hard_negatives.Codebooks(x.astype(int).tolist(), 9)
    part = hard_negatives.Part(np.arange(500), np.zeros(500, int), books.cells(x), x, books)
    for a in x[:20]:
        bounds, rows = [], 0
        for high, low, (begin, end) in part.visit(a):
            scores = part.scores(a, (begin, end))
            assert low <= scores.min() and scores.max() <= high
            bounds.append(high)
            rows += end - begin
        assert rows == 500 and bounds == sorted(bounds, reverse=True)


def brute_repair(rows):
    """The cheapest edits by search over all of them, in order of cost and then of the string of edits."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, faults = set(), []
    for _, r, x in rows:
        bare = re.sub(r"[\x20\x09-\x0D]+\Z", "", x)
        faults.append("b" if not bare else "d" if (r, x) in seen else "t" if bare[-1] not in ".!?" else "")
        seen.add((r, x))
    letters, turns = [r[:1] for _, r, _ in rows], [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(letters, letters[1:]))
    heap = [(0, "", 0, "", ())]
    fits = lambda s: re.fullmatch(r"(s?(ua)*u?)?", s)
    while True:
        cost, audit, i, s, lines = heapq.heappop(heap)
        if i == len(rows) and re.fullmatch(r"(s?(ua)+)?", s):
            return gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()
        if i < len(rows):
            _, r, x = rows[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, s, lines))
            if faults[i] not in ("b", "d"):
                more = 3 * (faults[i] == "t")
                if r and fits(s + r[0]):
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, s + r[0], (*lines, f"{r}:{x}")))
                for q in ("user", "assistant"):
                    if fits(s + q[0]):
                        heapq.heappush(heap, (cost + 3 + more, audit + "R", i + 1, s + q[0], (*lines, f"{q}:{x}")))
        if audit[-2:] != "II":
            for q in ("user", "assistant"):
                if fits(s + q[0]):
                    heapq.heappush(heap, (cost + 3, audit + "I", i, s + q[0], (*lines, f"{q}:")))


def brute_damage(rows):
    out = {}
    for c, t, r, x in rows:
        kept, kind = out.setdefault(c, []), zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        x = "" if kind == 1 else re.sub("[.!?]", "", x) if kind == 2 else x
        kept += [(t, "user" if kind == 4 else r, x)] * (kind != 0) * (1 + (kind == 3))
    return out


def repaired(df):
    return {r[0]: tuple(r)[1:] for r in conversations.repaired(conversations.damaged(df)).collect()}


@pytest.mark.parametrize("segment", [4096, 3])
def test_conversations_by_all_edits(spark, segment, monkeypatch):
    """Segments of three rows put every conversation on the way of the long ones."""
    monkeypatch.setattr(conversations, "SEGMENT", segment)
    draw, rows = random.Random(8), {}
    for c in range(120):
        for _ in range(draw.randrange(1, 8)):
            t = draw.choice([None, 0, 1, 2, 3, 4, 7])
            rows[c, t] = c, t, draw.choice(["user", "assistant", "system", "user", "assistant", "tool", None, "", "sage"]), draw.choice(["a.", "b", "", " \n", "hello!", "x y?", None, "c. ", "a.\t"])
    rows = [*rows.values(), (None, 1, "user", "hi."), (None, None, "user", "yo"), (-5, 1, "user", "hi. " * 50_000), (-5, 2, "assistant", "."), (1 << 60, 1, "user", "x"), ((1 << 60) + 1, 1, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("x") for c in ("same", "fault", "no", "id", "done")})
    assert repaired(df.repartition(4)) == {c: brute_repair(v) for c, v in brute_damage(rows).items()}
    assert repaired(df.limit(0)) == {}


def test_a_long_conversation_over_many_segments(spark, monkeypatch):
    """One conversation holds nearly all rows: the same result in one segment as in many, and repeated rows are duplicates."""
    draw = random.Random(3)
    rows = [(7, k // 2, draw.choice(["user", "assistant", "system"]), f"t{draw.randrange(900)}{draw.choice('.!?xyz')}") for k in range(3000)] + [(8, 1, "user", "a.")] * 3
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    whole = repaired(df.coalesce(1))
    monkeypatch.setattr(conversations, "SEGMENT", 50)
    assert repaired(df.repartition(6)) == whole and whole[7][6].count("D") > 500 and len(whole[7][6]) > 2500
    blocks = conversations.Blocks()
    kept = [r for r in sorted(rows[:9])]
    assert len(blocks.vectors) < 100 and len(kept) == 9


def test_block_tables_equal_single_steps():
    draw, one = random.Random(6), conversations.Blocks(1)
    blocks = conversations.Blocks()
    for _ in range(200):
        symbols = bytes(draw.randrange(conversations.SYMBOLS) for _ in range(draw.randrange(1, 30)))
        (_, a, m), (_, b, n) = blocks.behind(blocks.cut(symbols), 0), one.behind(one.cut(symbols), 0)
        assert (blocks.vectors[a], m) == (one.vectors[b], n)
        at, more = blocks.table(blocks.cut(symbols))
        assert (at[0], more[0]) == (a, m)
