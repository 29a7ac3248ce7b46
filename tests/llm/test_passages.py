"""Fuzzy passages: planted cases, chains against brute force."""

import itertools
import random

import numpy as np

from readloom.llm import passages
from readloom.llm.passages import PassageOptions

SCHEMA = "doc_id long, text string, chain string, side string"


def prose(rng, n):
    return [f"w{rng.randrange(100000)}" for _ in range(n)]


def test_planted_passages_are_found_and_clean_texts_left_alone(spark):
    rng = random.Random(8)
    passage, fuzzy = prose(rng, 60), prose(rng, 90)
    rows, exact, near = [], set(), set()
    for i in range(60):
        text = prose(rng, rng.randrange(1, 300))
        at = rng.randrange(len(text))
        if i % 10 == 0:
            text[at:at] = passage
            exact.add(i)
        elif i % 10 == 1:
            copy = list(fuzzy)
            for _ in range(5):
                spot = rng.randrange(len(copy))
                copy[spot : spot + 1] = rng.choice([[], ["new"], ["two", "more"]])
            text[at:at] = copy
            near.add(i)
        rows.append((i, " ".join(text), "c", "s"))
    rows += [(100, None, None, None), (101, "", "c", "s"), (None, " ".join(passage), "c", "s"), (102, "a " * 4000, "c", "s"), (0, rows[0][1], "c", "s")]
    got = passages.repeated_passages(spark.createDataFrame(rows, SCHEMA)).collect()
    texts = {r[0]: r[1].split() for r in rows if r[0] is not None and r[1]}
    assert {r.doc_id for r in got} | {r.other_id for r in got} == exact | near
    for group, size in ((exact, 60), (near, 55)):
        found = [r for r in got if r.doc_id in group]
        assert len({r.doc_id for r in found} | {r.other_id for r in found}) == len(group)
        assert all(r.matched_words >= size for r in found)
    for r in got:
        if r.doc_id in exact and r.identity == 1.0:
            assert texts[r.doc_id][r.start_word : r.end_word] == texts[r.other_id][r.other_start : r.other_end]


def test_empty_table(spark):
    assert passages.repeated_passages(spark.createDataFrame([], SCHEMA)).count() == 0


def test_best_chain_against_all_chains():
    rng = random.Random(3)
    o = PassageOptions()
    for _ in range(60):
        seeds = sorted({(rng.randrange(40), rng.randrange(40)) for _ in range(rng.randrange(1, 9))})
        x, y = [s[0] for s in seeds], [s[1] for s in seeds]

        def value(chain):
            total = o.gain
            for i, j in zip(chain, chain[1:]):
                if x[j] <= x[i] or y[j] <= y[i]:
                    return None
                total += o.gain - o.gap / 2 * (x[j] - x[i] + y[j] - y[i])
            return total

        every = [v for n in range(1, len(seeds) + 1) for c in itertools.combinations(range(len(seeds)), n) if (v := value(c)) is not None]
        found = passages.chains(x, y, o)
        assert abs(value(found[0]) - max(every)) < 1e-9
        assert sorted(i for c in found for i in c) == list(range(len(seeds)))


def test_alignment_and_sketches():
    a, b = np.arange(50), np.concatenate([np.arange(10), [900], np.arange(12, 50)])
    assert passages.align(a, b, 24) == (50, 49, 48)
    assert passages.align(np.array([1, 2]), np.array([3, 4]), 24) == (0, 0, 0)
    grams = np.random.default_rng(1).integers(0, 1 << 63, 140).astype(np.uint64)
    bounds = np.array([0, 3, 3, 100, 140])
    got = passages.sketches(grams, bounds)
    for row, (first, end) in enumerate(zip(bounds, bounds[1:])):
        for p in range(first, end):
            for i, begin in enumerate(passages.SKETCHES):
                seen = grams[max(p + begin, first) : max(min(p + begin + passages.WIDTH, end), first)]
                assert int(got[p]) >> 16 * i & 0xFFFF == ((int(seen.min()) & 0x7FFF) + 1 if len(seen) else 0), (row, p, begin)


def plain_align(a, b, reach):
    """The rule of ``align_ends`` word by word."""
    i = j = matched = 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            i, j, matched = i + 1, j + 1, matched + 1
            continue
        options = sorted(((da + db, 0 if da + db < 3 and da == 1 else 1, da, db) for da in range(reach + 1) for db in range(reach + 1 - da) if da + db), key=lambda x: x[:3])
        for _, _, da, db in options:
            if i + da + 3 <= len(a) and j + db + 3 <= len(b) and list(a[i + da : i + da + 3]) == list(b[j + db : j + db + 3]):
                i, j = i + da, j + db
                break
        else:
            break
    return matched


def test_alignment_against_a_plain_one():
    rng = np.random.default_rng(4)
    for _ in range(200):
        a = rng.integers(0, 4, rng.integers(0, 60))
        b = np.concatenate([a[: rng.integers(0, len(a) + 1)], rng.integers(0, 4, rng.integers(0, 8)), a[rng.integers(0, len(a) + 1) :]])
        assert passages.align(a, b, 10)[2] == plain_align(a, b, 10)


def test_common_seeds_dealt_out_by_document_meet_the_same_hubs(spark):
    from readloom.llm.common import Scratch

    rng = random.Random(13)
    line = prose(rng, 30)
    rows = [(i, " ".join(prose(rng, 20) + line[: rng.randrange(8, 30)] + prose(rng, 20) + line)) for i in range(60)]
    o = PassageOptions(sampled=1.0)
    texts = spark.createDataFrame(rows, "uid long, text string")

    def links(hot):
        seeds = texts.mapInArrow(passages._seeder(o, hot), passages._SEEDS)
        return seeds.repartition("key", "salt").sortWithinPartitions("key", "uid", "pos").mapInArrow(passages._linker(o), passages._LINKS)

    plain = links(np.empty(0, np.int64)).select("uid", "hub", "pos", "hub_pos").collect()
    keys = np.array([r.key for r in texts.mapInArrow(passages._seeder(o, np.empty(0, np.int64)), passages._SEEDS).select("key").distinct().collect()])
    for hot in (keys, keys[::2]):
        got = links(hot)
        dealt = passages._hot_links(got.where("hub IS NULL"), o, Scratch(spark, "test")).select("uid", "hub", "pos", "hub_pos")
        assert sorted(got.where("hub IS NOT NULL").select("uid", "hub", "pos", "hub_pos").unionByName(dealt).collect()) == sorted(plain)


def alike(a, b, least=40):
    """Whether two word lists share a passage by brute force over all diagonals, where only words are changed."""
    a, b = np.array(a), np.array(b)
    for d in range(least - len(b), len(a) - least + 1):
        x, y = (a[d:], b) if d >= 0 else (a, b[-d:])
        n = min(len(x), len(y))
        same = np.concatenate([[0], np.cumsum(x[:n] == y[:n])])
        z = np.arange(n + 1)
        width = z[None, :] - z[:, None]
        got = same[None, :] - same[:, None]
        if ((got >= least) & (got >= 0.8 * width)).any():
            return True
    return False


def test_recall_where_smaller_documents_hold_halves(spark):
    rng = random.Random(33)
    rows, groups = [], []
    ids = rng.sample(range(10**6), 40 * 12)
    for g in range(40):
        whole = prose(rng, 60)
        copy = [w if g % 2 or rng.random() > 0.1 else f"x{rng.randrange(10**6)}" for w in whole]
        group = [prose(rng, rng.randrange(10, 40)) + p + prose(rng, rng.randrange(10, 40)) for p in [whole, copy] + [whole[:30]] * 5 + [whole[30:]] * 5]
        mine = [ids.pop() for _ in group]
        rows += [(i, " ".join(t), "c", "s") for i, t in zip(mine, group)]
        want = {frozenset((mine[x], mine[y])) for x in range(len(group)) for y in range(x) if alike(group[x], group[y])}
        groups.append(want)
    found = {frozenset((r.doc_id, r.other_id)) for r in passages.repeated_passages(spark.createDataFrame(rows, SCHEMA)).collect()}
    every = set().union(*groups)
    assert found <= every
    assert len(found & every) >= 0.9 * len(every)


def test_a_passage_is_found_though_smaller_documents_hold_its_pieces(spark):
    rng = random.Random(21)
    rows, pairs = [], []
    for g in range(20):
        parts = [prose(rng, 26), prose(rng, 26)] if g % 2 else [prose(rng, 18) for _ in range(3)]
        whole = [w for p in parts for w in p]
        for p in parts:  # many copies of each piece, so that some have smaller uids
            rows += [(len(rows) + i, " ".join(prose(rng, 60) + p + prose(rng, 60)), "c", "s") for i in range(12)]
        pairs.append({len(rows), len(rows) + 1})
        rows += [(len(rows) + i, " ".join(prose(rng, 60) + whole + prose(rng, 60)), "c", "s") for i in range(2)]
    got = passages.repeated_passages(spark.createDataFrame(rows, SCHEMA)).collect()
    found = [{r.doc_id, r.other_id} for r in got]
    assert all(p in found for p in pairs)
    assert all(f in pairs for f in found)


def test_recall_of_passages_at_the_least_identity(spark):
    rng = random.Random(5)
    rows, planted = [], []
    for share, even in ((0.1, True), (0.12, True), (0.15, True), (0.18, True), (0.1, False), (0.15, False), (0.18, False)):
        for _ in range(30):
            passage = prose(rng, 60)
            copy, edits = list(passage), round(share * 60)
            for at in (int((i + 0.5) * 60 / edits) for i in range(edits)) if even else rng.sample(range(60), edits):
                copy[at] = "changed" + str(rng.randrange(100000))
            # brute force: the best stretch without a shift, as only words are changed
            same = np.concatenate([[0], np.cumsum([p == c for p, c in zip(passage, copy)])])
            assert any(same[z] - same[a] >= 40 and same[z] - same[a] >= 0.8 * (z - a) for a in range(60) for z in range(a + 40, 61))
            planted.append((share, even, {len(rows), len(rows) + 1}))
            rows += [(len(rows) + i, " ".join(prose(rng, 70) + p + prose(rng, 70)), "c", "s") for i, p in enumerate((passage, copy))]
    found = [{r.doc_id, r.other_id} for r in passages.repeated_passages(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert all(f in [p for _, _, p in planted] for f in found)
    kinds = {(share, even) for share, even, _ in planted}
    recall = {k: np.mean([p in found for share, even, p in planted if (share, even) == k]) for k in kinds}
    assert min(recall.values()) >= 0.9 and np.mean(list(recall.values())) >= 0.97


def test_every_copy_inside_a_document_is_reported(spark):
    rng = random.Random(9)
    rows, copies = [], {}
    for g in range(20):
        passage = prose(rng, 60)
        for n in (1, 3) if g % 2 else (2,):
            text = prose(rng, 50)
            for _ in range(n):
                copies.setdefault(len(rows), []).append((len(text), len(text) + 60))
                text += passage + prose(rng, 0 if g % 4 == 0 else 50)
            rows.append((len(rows), " ".join(text), "c", "s"))
    got = passages.repeated_passages(spark.createDataFrame(rows, SCHEMA)).collect()
    spans = {(r.doc_id, r.start_word, r.end_word) for r in got} | {(r.other_id, r.other_start, r.other_end) for r in got}
    assert spans == {(i, a, z) for i, c in copies.items() for a, z in c}
    assert all(r.doc_id != r.other_id or r.other_end <= r.start_word for r in got)


def test_no_pair_is_lost_whose_seeds_are_few(spark):
    rng = random.Random(71)
    rows, pairs = [], []
    for _ in range(80):
        passage = prose(rng, 50)
        copy = [f"other{rng.randrange(10**6)}" if i % 5 == 4 else w for i, w in enumerate(passage)]  # four words agree at a time: one seed each
        pairs.append({len(rows), len(rows) + 1})
        rows += [(len(rows) + i, " ".join(prose(rng, 70) + p + prose(rng, 70)), "c", "s") for i, p in enumerate((passage, copy))]
    found = [{r.doc_id, r.other_id} for r in passages.repeated_passages(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert all(p in found for p in pairs) and all(f in pairs for f in found)


def test_two_passages_of_a_pair_far_apart_are_both_found(spark):
    rng = random.Random(72)
    first, second = prose(rng, 60), prose(rng, 60)
    rows = [(i, " ".join(first + prose(rng, 90) + second), "c", "s") for i in range(2)]
    got = passages.repeated_passages(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(r.start_word, r.end_word) for r in got} == {(0, 60), (150, 210)}


def test_a_passage_inside_two_longer_chains_is_found(spark):
    # document 0 shares 90 words with 1 and with 2, of which a fifth is changed too many; 3 has the 45 in their midst as they are
    rng = random.Random(73)
    ends, core = [prose(rng, 40), prose(rng, 40)], prose(rng, 45)
    texts = [prose(rng, 20) + ends[0] + core + ends[1]]
    for _ in range(2):
        texts.append(prose(rng, 20) + ends[0] + [w if i % 9 < 6 else f"x{rng.randrange(10**6)}" for i, w in enumerate(core)] + ends[1])
    texts.append(prose(rng, 60) + core + prose(rng, 60))
    want = {frozenset((0, 3))}
    got = {frozenset((r.doc_id, r.other_id)) for r in passages.repeated_passages(spark.createDataFrame([(i, " ".join(t), "c", "s") for i, t in enumerate(texts)], SCHEMA)).collect()}
    assert want <= got


def test_packed_seeds_link_as_rows_do(spark):
    rng = random.Random(74)
    line = prose(rng, 30)
    rows = [(i, " ".join(prose(rng, 20) + line[: rng.randrange(8, 30)] + ["same"] * 50 + line)) for i in range(60)]
    texts = spark.createDataFrame(rows, "uid long, text string").repartition(3)
    o = PassageOptions()
    keys = np.array([r.key for r in texts.mapInArrow(passages._seeder(o, np.empty(0, np.int64)), passages._SEEDS).select("key").distinct().collect()])
    for hot in (np.empty(0, np.int64), keys[::3]):
        seeds = texts.mapInArrow(passages._seeder(o, hot), passages._SEEDS)
        plain = seeds.repartition("key", "salt").sortWithinPartitions("key", "uid", "pos").mapInArrow(passages._linker(o), passages._LINKS).collect()
        for bits in (8, 11):
            got = []
            for turn in range(passages.ROUNDS):
                packed = texts.mapInArrow(passages._packer(o, hot, turn, bits), passages._PACKED)
                got += packed.repartition("part").sortWithinPartitions("part").mapInArrow(passages._part_linker(o, bits), passages._LINKS).collect()
            assert sorted(got, key=repr) == sorted(plain, key=repr) and got


def test_what_is_passed_over_can_hold_no_passage():
    rng = np.random.default_rng(75)
    o = PassageOptions()
    assert o.pairs == 19
    least = 10**9
    for _ in range(300):
        # ten words put in on either side, where they part as many pairs as they can
        a, b = [], []
        matched = list(range(1000, 1040))
        spots = rng.permutation(np.arange(1, 40))[:20]
        for i, w in enumerate(matched):
            if i in spots[:10]:
                a.append(int(rng.integers(10**6, 10**9)))
            if i in spots[10:]:
                b.append(int(rng.integers(10**6, 10**9)))
            a.append(w)
            b.append(w)
        least = min(least, passages.pairs_in_common(np.array(a, "<u4"), np.array(b, "<u4")))
    assert least == o.pairs
    assert passages.pairs_in_common(np.array([1], "<u4"), np.array([1, 2], "<u4")) == 0


def test_runs_on_a_diagonal_keep_their_ends():
    o = PassageOptions()
    rows = sorted((u, h, x, x + d, 16 if x == 7 else 4) for u in (1, 2) for h in (3, 5) for d, xs in ((0, range(5, 25)), (9, (5, 6)), (-4, (30, 60))) for x in xs)
    uid, hub, x, y, span = (np.array(c) for c in zip(*rows))
    keep, longest = passages.thinned(uid, hub, x, y, span, o)
    kept = {r[:4] for r, k in zip(rows, keep) if k}
    for u in (1, 2):
        for h in (3, 5):
            assert {(u, h, a, a + d) for a, d in ((5, 0), (24, 0), (5, 9), (6, 9), (30, -4), (60, -4))} <= kept
            middle = sorted(r[2] for r in kept if r[:2] == (u, h) and r[2] == r[3])
            assert len(middle) < 20 and max(np.diff(middle)) <= passages.STRIDE
    assert all(s == (16 if r[2] == r[3] else 4) for r, s in zip(rows, longest))


def test_text_that_repeats_at_once():
    o = PassageOptions()
    rng = np.random.default_rng(76)
    rows = [np.full(200, 7), np.tile(rng.integers(100, 10**9, 9), 5), np.tile(rng.integers(100, 10**9, 45), 3), rng.integers(100, 10**9, 90)]
    line = rng.integers(100, 10**9, 20)
    rows.append(np.concatenate([line, rng.integers(100, 10**9, 10), line]))
    hashes, bounds = np.concatenate(rows).astype(np.uint64), np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    grams, starts = passages.ngrams(hashes, bounds, o.k)
    got = passages.repeated_at_once(grams, starts, o)
    left = [np.flatnonzero(~got[a:z]).tolist() for a, z in zip(starts, starts[1:])]
    assert left == [[0], list(range(9)), list(range(132)), list(range(87)), list(range(47))]
