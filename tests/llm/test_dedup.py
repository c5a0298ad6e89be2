"""Exact, near and substring deduplication against brute force."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pigeonhole.llm import chains, exact, graph, minhash

SCHEMA = "doc_id long, text string, kept string, digest string"
WORDS = [f"w{i}" for i in range(900)]


def prose(rng, n):
    return [rng.choice(WORDS) for _ in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def brute_groups(rows):
    norm = lambda t: re.sub("[\x20\x09-\x0D]+", " ", t or "")
    by = {}
    for doc, text, *_ in rows:
        by.setdefault(norm(text), []).append(doc)
    out = []
    for members in by.values():
        least = min((m for m in members if m is not None), default=None)
        first = True
        for m in sorted(members, key=lambda m: (m is None, m or 0)):
            out.append((m, least, len(members), m == least and first))
            first = first and m != least
    return sorted(out, key=repr)


ROWS = [(4, "a  b\tc", "x", "y"), (1, "a b c", None, None), (2, "A b c", "x", "y"), (3, None, "x", "y"), (9, "", "x", "y"), (None, "a b c", "x", "y"), (None, "alone", "x", "y"), (2, "A b c", "x", "y"), (5, " a b c", "x", "y"), (6, "a b", "x", "y"), (7, "\n", "x", "y"), (8, " ", "x", "y")]


@pytest.mark.parametrize("digest", [exact.sha256, lambda c: F.substring(F.sha2(F.col(c), 256), 1, 1), lambda c: F.lit("same")])
def test_exact_groups(spark, digest):
    got = exact.duplicate_groups(spark.createDataFrame(ROWS, SCHEMA), digest).collect()
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.kept) for r in got], key=repr) == brute_groups(ROWS)


def test_exact_keeps_one_row_each(spark, docs):
    twice = docs.union(docs).withColumn("__kept", F.lit(1))
    kept = exact.drop_duplicates(twice)
    assert kept.columns == twice.columns
    assert kept.count() == len({re.sub("[\x20\x09-\x0D]+", " ", r.text) for r in docs.collect()})
    assert exact.duplicate_groups(docs.limit(0)).count() == 0


def test_exact_keeps_every_text_of_an_id(spark):
    rows = [(None, "a"), (None, "b c"), (None, "b  c"), (None, "c"), (1, "c"), (2, "d"), (2, "e"), (2, "e"), (3, "d"), (2, None), (None, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    kept = exact.drop_duplicates(frame).collect()
    found = sorted([(r.doc_id, " ".join((r.text or "").split())) for r in kept], key=repr)
    assert found == sorted([(None, "a"), (None, "b c"), (1, "c"), (2, "d"), (2, "e"), (2, "")], key=repr)
    assert exact.duplicate_groups(frame).where("kept").count() == len(kept)


def shingles(text, k):
    words = (text or "").encode().lower().split()
    return {tuple(words[i:i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def brute_components(rows, k, percent):
    sets = {d: shingles(t, k) for d, t in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                a1, b1 = find(a), find(b)
                root[max(a1, b1)] = min(a1, b1)
    return {d: (len(sets[d]), find(d)) for d in ids}


def test_near_duplicates_equal_brute_force(spark):
    """Groups with links only through others, short texts, empty ones and ones on the very threshold."""
    rng = random.Random(5)
    texts = []
    for _ in range(6):
        base = prose(rng, 120)
        for step in range(14):
            base = list(base)
            for _ in range(rng.choice([1, 2, 4])):
                base[rng.randrange(len(base))] = rng.choice(WORDS)
            texts.append(" ".join(base))
        texts += [texts[-1].upper(), texts[-1]]
    same = prose(rng, 13)
    texts += [" ".join(same), " ".join(same[:-1] + ["other"]), " ".join(same[:11]), "", None, " \n", "one", "ONE", "one two", "one two three four", "ü Ü", "Ü ü"]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    frame = spark.createDataFrame([(d, t, "x", "y") for d, t in rows], "doc_id long, text string, component_id string, bands string")
    for k in (4, 5):
        got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(frame, k).collect()}
        want = brute_components(rows, k, 80)
        assert got == {d: (n, c, d == c) for d, (n, c) in want.items()}


def test_near_duplicates_of_odd_rows(spark):
    rows = [(None, "a b c d e f g"), (1, "a b c d e f g"), (1, "a b c d e f g"), (2, None)]
    got = sorted([(r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()], key=repr)
    assert got == sorted([(None, None, True), (1, 1, True), (1, 1, True), (2, 2, True)], key=repr)
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_circulant_signature_estimates_similarity():
    rng = np.random.default_rng(2)
    common, one, two = (rng.integers(0, 2**63, n).astype(np.uint64) for n in (800, 100, 100))
    a, b = minhash.signature(np.concatenate([common, one])), minhash.signature(np.concatenate([common, two]))
    assert abs((a == b).mean() - 0.8) < 0.12
    first, shifted = minhash.tables()
    assert sorted(first.tolist()) == list(range(minhash.CIRCLE)) and (shifted[1, :-1] == shifted[0, 1:]).all()


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 60)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(80)] + [(300, 301 + i) for i in range(40)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        root[max(find(a), find(b))] = min(find(a), find(b))
    assert got == {x: find(x) for x in root if find(x) != x}


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(0, 60)), min_size=1, max_size=40, unique=True))
def test_chain_scores_are_the_best(pairs):
    pairs.sort()
    at, there = np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])
    best = []
    for j in range(len(pairs)):
        best.append(chains.K + max([0, *(best[i] - chains.GAP_COST * (at[j] - at[i] + there[j] - there[i]) for i in range(j) if at[i] < at[j] and there[i] < there[j])]))
    found = chains.chain(at, there)
    assert sorted(int(m) for c in found for m in c) == list(range(len(pairs)))
    assert all((np.diff(at[c]) > 0).all() and (np.diff(there[c]) > 0).all() for c in found)
    c = found[0]
    score = chains.K * len(c) - chains.GAP_COST * (at[c[-1]] - at[c[0]] + there[c[-1]] - there[c[0]])
    assert abs(score - max(best)) < 1e-9


def test_passages(spark):
    rng = random.Random(8)
    passage, fuzzy, short = prose(rng, 55), prose(rng, 90), prose(rng, 40)
    changed = [w if i % 13 else "changed" for i, w in enumerate(fuzzy)]
    grown = fuzzy[:45] + ["new", "words"] + fuzzy[45:]
    noise = lambda: prose(rng, 70)
    texts = {1: noise() + passage + noise(), 2: passage + noise(), 3: noise() + [w.upper() + "," for w in passage], 4: noise() + fuzzy, 5: noise() + changed + noise(),
             6: noise() + grown, 7: noise() + short, 8: short + noise(), 9: noise(), 10: ["ha"] * 80, 11: ["ha"] * 70}
    rows = [(d, " ".join(t), "x") for d, t in texts.items()] + [(12, None, "x"), (13, "", "x"), (None, " ".join(passage), "x")]
    got = chains.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string, source_id string")).collect()
    found = {(r.doc_id, r.source_id): r for r in got if r.doc_id != r.source_id}
    assert set(found) == {(2, 1), (3, 1), (5, 4), (6, 4), (11, 10)}
    assert (found[2, 1].start, found[2, 1].words, found[2, 1].source_start) == (0, 55, 70)
    assert (found[3, 1].start, found[3, 1].agreeing) == (70, 55)
    assert found[5, 4].words >= 85 and found[5, 4].agreeing == sum(a == b for a, b in zip(fuzzy, changed[:]))
    assert found[6, 4].words == 92 and found[6, 4].agreeing == 90
    assert chains.repeated_passages(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_passage_of_many_is_matched_once_each(spark):
    rng = random.Random(1)
    passage = prose(rng, 60)
    rows = [(i, " ".join(prose(rng, 30) + passage + prose(rng, 30))) for i in range(300)]
    got = chains.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in got if r.source_id == 0) == list(range(1, 300)) and len(got) < 320
    assert all(r.words >= 60 for r in got)  # words beside it may be shared too


def test_every_repeated_run_of_words_is_in_a_passage(spark, docs):
    from pigeonhole.llm.decontaminate import EDGES

    words = {r.doc_id: [w.strip(EDGES) or w for w in r.text.lower().split()] for r in docs.orderBy("doc_id").collect()}
    held = {}
    for r in chains.repeated_passages(docs).collect():
        held.setdefault(r.doc_id, []).append((r.start, r.start + r.words))
    first, places = {}, 0
    for doc, own in words.items():
        for k in range(len(own) - 50):
            run = tuple(own[k:k + 51])
            if first.setdefault(run, doc) != doc:
                places += 1
                assert any(a <= k and k + 51 <= b for a, b in held.get(doc, [])), (doc, k)
    assert places > 100


def test_edited_passages_need_one_seed(spark):
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(10**6)}"
    hashes, rows, due = chains.PlainWords(), [], set()
    for n in range(60):
        passage = [word() for _ in range(rng.randrange(50, 101))]
        copy = list(passage)
        for i in range(rng.randrange(6, 13), len(copy) - 6, 12):
            copy[i] = word()
        texts = [[word() for _ in range(40)] + p + [word() for _ in range(40)] for p in (passage, copy)]
        seeds = [set(zip(*(x.tolist() for x in chains.minimisers(hashes.of(t))))) for t in texts]
        gain = np.concatenate([[0], np.cumsum([1 if a == b else -4 for a, b in zip(passage, copy)])])
        best = max((gain[j] - gain[i], j - i) for i in range(len(gain)) for j in range(i, len(gain)))
        if seeds[0] & seeds[1] and best[1] >= 50:
            due.add((2 * n + 1, 2 * n))
        rows += [(2 * n + k, " ".join(t)) for k, t in enumerate(texts)]
    assert len(due) > 30
    got = {(r.doc_id, r.source_id) for r in chains.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == due


def test_links_equal_the_first_and_the_one_before(spark, monkeypatch):
    rng = random.Random(4)
    rows = list({(rng.choice([-9, 3, 5, 5, 5, 5, 5, 8, 10**9 + rng.randrange(40)]), rng.randrange(60), rng.randrange(5)) for _ in range(400)})
    frame = spark.createDataFrame(rows + rows[:50], "seed long, doc_id long, at int")
    by = {}
    for seed, *place in sorted(rows):
        by.setdefault(seed, []).append(tuple(place))
    due = {(*p, seed, *at[0], *at[max(0, k - 1)]) for seed, at in by.items() if len(at) > 1 for k, p in enumerate(at)}
    for per_task in (7, 60, 10**6):
        monkeypatch.setattr(chains, "SEEDS_A_TASK", per_task)
        got = [tuple(r)[:7] for r in chains.link_table(frame).collect()]
        assert len(got) == len(set(got)) and {r for r in got if len(by[r[2]]) > 1} == due


def test_passages_of_parts_that_occur_earlier(spark):
    rng = random.Random(6)
    word = lambda: f"w{rng.randrange(10**6)}"
    prose_of = lambda n: [word() for _ in range(n)]
    rows, due = [], set()
    for n in range(25):
        parts = [prose_of(rng.randrange(30, 45)) for _ in range(2)] if n % 2 else [prose_of(rng.randrange(20, 30)) for _ in range(3)]
        parts_in = lambda: [prose_of(20) + p + prose_of(20) for p in parts]
        whole = lambda: prose_of(20) + sum(parts, []) + prose_of(20)
        texts = [*parts_in(), whole(), *(parts_in() if n % 3 else []), whole()]
        due.add((100 * n + len(texts) - 1, 100 * n + len(parts), sum(map(len, parts))))
        rows += [(100 * n + k, " ".join(t)) for k, t in enumerate(texts)]
    got = {(r.doc_id, r.source_id, r.agreeing) for r in chains.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == due


@pytest.mark.parametrize("least, rate", [(50, 0.02), (50, 0.05), (50, 0.1), (20, 0.1), (20, 0.2)])
def test_stretches_meet_every_passage(least, rate):
    rng, hard = np.random.default_rng(7), 0
    for _ in range(150):
        same = np.concatenate([rng.random(30) < 0.05, rng.random(int(rng.integers(least, 2 * least))) >= rate, rng.random(30) < 0.05])
        gain = np.concatenate([[0], np.cumsum(np.where(same, 1, -chains.SUBSTITUTION))])
        due = [(i, j) for i in range(len(same)) for j in range(i + least, len(same) + 1) if gain[j] > gain[i] and same[i] and same[j - 1]]
        found = chains.stretches(same, least)
        assert all(e - s >= least and gain[e] > gain[s] for s, e in found)
        assert all(a[1] <= b[0] for a, b in zip(found, found[1:]))
        assert all(any(s < j and i < e for s, e in found) for i, j in due)
        hard += bool(due)
    assert hard > 10


def plain_align(a, b, shift, band):
    """Place of each word of a in b (-1: none) by edit distance inside a band, one word and pair at a time."""
    width = 2 * band + 1
    cost, steps, far = [0] * width, [], 1 << 20
    for i, word in enumerate(a):
        new, step = [], []
        for w in range(width):
            j = w + shift - band + i
            stay, skip = cost[w] + (not (0 <= j < len(b) and b[j] == word)), (cost[w + 1] if w + 1 < width else far) + 1
            best, kind = min(stay, skip), int(stay > skip)
            if w and new[-1] + 1 < best:
                best, kind = new[-1] + 1, 2
            new.append(best)
            step.append(kind)
        cost = new
        steps.append(step)
    w, places = cost.index(min(cost)), [-1] * len(a)
    for i in range(len(a) - 1, -1, -1):
        while steps[i][w] == 2:
            w -= 1
        j = w + shift - band + i
        if steps[i][w] == 0 and 0 <= j < len(b) and b[j] == a[i]:
            places[i] = j
        w += steps[i][w]
    return places


def test_alignments_made_together_equal_those_made_alone(monkeypatch):
    rng, pairs = random.Random(4), []
    for k in range(150):
        a = [rng.randrange(5) for _ in range(rng.randrange(60))]
        b = list(a)
        for _ in range(rng.randrange(8)):
            at = rng.randrange(len(b) + 1)
            b[at:at + rng.randrange(2)] = [rng.randrange(5)] * rng.randrange(2)
        pairs.append((np.array(a, np.int32), np.array(b, np.int32)[:rng.randrange(80)], rng.randrange(-15, 15), rng.randrange(1, 30)))
    due = [plain_align(a.tolist(), b.tolist(), shift, band) for a, b, shift, band in pairs]
    for cells in (1, 4000, chains.ALIGN_CELLS):
        monkeypatch.setattr(chains, "ALIGN_CELLS", cells)
        assert [x.tolist() for x in chains.align(*map(list, zip(*pairs)))] == due


def test_chains_with_gaps_are_aligned_together(monkeypatch):
    groups, real = [], chains.align_group
    monkeypatch.setattr(chains, "align_group", lambda group, *rest: (groups.append(len(group)), real(group, *rest)))
    words = np.arange(300, dtype=np.int32)
    got = chains.align([words] * 200, [np.delete(words, 150)] * 200, [0] * 200, [30] * 200)
    assert groups == [200] and all(x.tolist() == [*range(150), -1, *range(150, 299)] for x in got)


def test_words_of_chains_are_shuffled_only_for_their_joins(spark):
    docs = spark.createDataFrame([(1, "one two three"), (2, "four"), (3, "five")], "doc_id long, text string")
    words = chains.word_table(docs, spark.createDataFrame([(1,), (1,), (3,)], "doc_id long"))
    assert "Exchange" not in words._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.doc_id, len(r.words)) for r in words.collect()) == [(1, 3), (3, 1)]


class Kernel:
    """Stands for a table: keeps the function that a step hands to Arrow."""

    def repartition(self, *_):
        return self

    sortWithinPartitions = repartition

    def mapInArrow(self, run, _):
        self.run = run
        return self


def plain_minimisers(words):
    seeds = chains.runs(words, list(range(chains.K))).tolist()
    windows = [range(i, i + chains.WINDOW) for i in range(max(1, len(seeds) - chains.WINDOW + 1))]
    at = sorted({min(w, key=lambda i: (seeds[i], i)) for w in ([i for i in w if i < len(seeds)] for w in windows) if w})
    return at, chains.told_apart(words, np.array(at, int), np.array([seeds[i] for i in at], np.uint64)).tolist()


def test_words_and_seeds_of_many_texts_equal_those_of_each():
    rng, hashes = random.Random(3), chains.PlainWords()
    texts = [" ".join(rng.choices("ab" if k % 2 else "abcdefghijkl", k=rng.randrange(70))) for k in range(200)]
    texts += ["", None, " \t\n", "  “Quoted,” (words) -- … İİ ΑΣ a\x1cb\x85c　d​e ", *(f"a{chr(c)}b" for c in range(0x3100) if not 0xD800 <= c < 0xE000)]
    words, size = chains.words_of(pa.array(texts, pa.string()))
    row, at, found = chains.seeds_of_all(words, size)
    assert len(size) == len(texts) and size.sum() == len(words)
    for k, (text, end) in enumerate(zip(texts, np.cumsum(size))):
        own = words[end - size[k]:end]
        assert own.tolist() == hashes.of((text or "").lower().split()).tolist()
        assert (at[row == k].tolist(), found[row == k].tolist()) == plain_minimisers(own)


def test_matches_in_order_are_chained_for_all_pairs_together(monkeypatch):
    calls, real = [], chains.chain
    monkeypatch.setattr(chains, "chain", lambda at, there: (calls.append(len(at)), real(at, there))[1])
    rng, rows, due, others = random.Random(5), [], set(), 0
    for doc in range(60):
        for source in range(rng.randrange(1, 6)):
            at = np.sort(rng.sample(range(900), rng.randrange(1, 25)))
            there = at + 40 + np.cumsum([rng.choice([0, 0, 0, 0, 1, 30]) for _ in at])
            if doc % 7 == 0:
                rng.shuffle(there)
            others += bool((np.diff(there) <= 0).any())
            rows += [(doc, source, *p) for p in zip(at.tolist(), there.tolist())]
            parts = [(at[p[0]], at[p[-1]] + chains.K, there[p[0]], there[p[-1]] + chains.K, np.ptp(at[p] - there[p])) for c in real(at, there) for p in chains.parts_of(c, at, there)]
            last = None
            for p in sorted(parts, key=lambda p: (p[4] > 0, p[0] - p[2], p[0])):
                if last and not p[4] and p[0] - p[2] == last[0] - last[2] and p[0] - last[1] <= 2 * chains.REACH:
                    p = (last[0], max(last[1], p[1]), last[2], max(last[3], p[3]), 0)
                    due.remove((doc, source, *map(int, last)))
                due.add((doc, source, *map(int, p)))
                last = p
    table = pa.table([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], ["doc_id", "source_id", "at", "source_at"])
    kernel = chains.chain_table(Kernel())
    for together, size in ((1, 7), (100, 50), (10**6, 10**6)):
        monkeypatch.setattr(chains, "MATCHES_TOGETHER", together)
        calls.clear()
        got = [tuple(r.values()) for b in kernel.run(iter(table.to_batches(size))) for r in b.to_pylist()]
        assert set(got) == due and len(got) == len(due)
        assert others <= len(calls) < others + 40  # and those where a score is as high as a cost


def test_gapped_chains_of_all_batches_are_aligned_together(monkeypatch):
    groups, real = [], chains.align_group
    monkeypatch.setattr(chains, "align_group", lambda group, *rest: (groups.append(len(group)), real(group, *rest)))
    words = list(range(200))
    row = {"doc_id": 2, "source_id": 1, "lo": 0, "hi": 200, "source_lo": 0, "from": 0, "source_from": 0, "drift": 1, "part": words, "source_part": words[:80] + words[81:]}
    batch = pa.Table.from_pylist([row] * 5, pa.schema([(n, pa.list_(pa.int32()) if "part" in n else pa.int64()) for n in row])).to_batches()[0]
    got = [tuple(r.values()) for b in chains.align_chains(Kernel(), 50).run(iter([batch] * 4)) for r in b.to_pylist()]
    assert groups == [20] and got == [(2, 1, 0, 200, 0, 199, 199)] * 20
