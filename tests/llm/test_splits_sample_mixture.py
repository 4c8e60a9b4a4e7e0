from __future__ import annotations

import math
import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from folioflow.llm import mixture, sample, splits


def test_components_with_hot_vertices(spark, monkeypatch):
    from folioflow.plans import skew

    rng = random.Random(21)
    edges = [(0, i) for i in range(1, 60)] + [(rng.randrange(60, 120), rng.randrange(60, 120)) for _ in range(70)] + [(200 + i, 201 + i) for i in range(40)]
    want = components(edges)
    for hot in (3, 1_000_000):
        monkeypatch.setattr(skew, "HOT", hot)
        monkeypatch.setattr(skew, "SALTS", 3)
        got = splits.connected_components(spark.createDataFrame(edges, "u int, v int")).collect()
        assert {r.vertex: r.component for r in got} == {v: c for v, c in want.items() if any(v in e and e[0] != e[1] for e in edges)} and len(got) == len({r.vertex for r in got})


DOCS = "doc_id long, document_id string, author string, dataset_split string, group_id long, component string, u int"


def components(edges):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in list(parent)}


@pytest.mark.parametrize("shape", ["random", "chain", "star", "empty"])
def test_components_agree_with_union_find(spark, shape):
    rng = random.Random(3)
    edges = {
        "random": [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(5, 5), (7, 8), (8, 7)],
        "chain": [(i, i + 1) for i in range(120)], "star": [(0, i) for i in range(1, 400)] + [(1000, 1001)], "empty": [],
    }[shape]
    got = {r.vertex: r.component for r in splits.connected_components(spark.createDataFrame(edges + [(None, 1)], "u long, v long")).collect()}
    want = components([e for e in edges if e[0] != e[1]])
    assert got == want


def documents(spark, n=240):
    rng = random.Random(9)
    rows = []
    for i in range(1, n + 1):
        volume = "ab12-000000001" if i % 3 == 0 else f"cd13-{rng.randrange(90):09d}"
        page = f"{volume}-p{rng.randrange(9):03d}"
        page = rng.choice([page, page.upper(), page.replace("-", "_"), page.replace("-", ""), None, ""])
        number = f"{rng.randrange(120):08d}"
        author = rng.choice([None, "", "미상", f"김가온 (S-{number})", f"김가온/s{number}", f"S {number} x", f"(Ｓ–{number})", f"Jones {number}", f"AS{number}", f"S{number}9"])
        rows.append((i, page, author, rng.choice(["train", "train", "dev", "final", None]), 7, "x", 1))
    return rows, spark.createDataFrame(rows, DOCS)


def grouped(rows):
    import re
    import unicodedata

    by = defaultdict(list)
    for i, page, author, *_ in rows:
        key = re.sub(r"[^0-9a-z]", "", (page or "").lower())
        if key:
            by["v", re.sub(r"p\d{1,4}$", "", key)].append(i)
        plain = re.sub(r"[\s\W_]", "", unicodedata.normalize("NFKC", author or "").upper())
        m = re.search(r"(?<![A-Z])S(\d{8})(?!\d)", plain)
        if m:
            by["s", m.group(1)].append(i)
    found = components([(ids[0], x) for ids in by.values() for x in ids])
    return {i: found.get(i, i) for i, *_ in rows}


def test_broken_groups_are_whole_and_named_by_their_smallest_document(spark):
    rows, frame = documents(spark)
    group = grouped(rows)
    labels = defaultdict(set)
    for i, _, _, split, *_ in rows:
        labels[group[i]].add(split)
    want = sorted((i, g) for i, g in group.items() if len(labels[g] - {None}) > 1)
    assert sorted(tuple(r) for r in splits.broken_groups(frame).collect()) == want
    assert splits.broken_groups(frame.limit(0)).count() == 0


def test_splits_keep_groups_and_proportions(spark):
    rows, frame = documents(spark)
    group = grouped(rows)
    pages = spark.createDataFrame([(1, "CD13_000000003_P001"), (2, "cd13-000000003-p009"), (3, None), (4, "zz99-000000001-p001")], "row_id long, id string")
    made = splits.assign_splits(frame, pages).collect()
    of = {(r.src, r.row_id): r.dataset_split for r in made}
    assert len(made) == len(of) == len(rows) + 4
    by_group = defaultdict(set)
    for i, *_ in rows:
        by_group[group[i]].add(of["documents", i])
    assert all(len(s) == 1 for s in by_group.values())
    assert of["manifest", 1] == of["manifest", 2]
    many = spark.range(20_000).select(splits.hash_split(splits.F.col("id")).alias("s")).groupBy("s").count().collect()
    share = {r["s"]: r["count"] / 20_000 for r in many}
    assert abs(share["train"] - 0.8) < 0.01 and abs(share["dev"] - 0.1) < 0.01


DAY = datetime(2024, 3, 1)


def arrivals(n, seed=1):
    rng = random.Random(seed)
    rows = [(f"ab-{rng.randrange(n):06d}", DAY + timedelta(days=min(rng.randrange(12), 9), hours=rng.randrange(24)), "x") for _ in range(n)]
    return rows + [(None, DAY, "x"), ("", DAY, "x"), ("late", None, "x")]


def taken(spark, rows, rate=0.1):
    from folioflow.functions.ids import page_key

    frame = spark.createDataFrame(rows, "id string, at timestamp_ntz, batch string")
    return {(r.key, r.batch) for r in sample.frozen_sample(frame, page_key(splits.F.col("id")), "at", rate).collect()}


def test_sample_is_bottom_k_of_each_closed_batch(spark):
    rows = arrivals(3000)
    first = {}
    for key, at, _ in rows:
        if key and at:
            k = key.replace("-", "")
            first[k] = min(first.get(k, at.date()), at.date())
    batches = defaultdict(list)
    for k, day in first.items():
        batches[day].append((sha256(f"sample:{k}".encode()).hexdigest(), k))
    newest = max(at.date() for key, at, _ in rows if at and key)
    want = {(k, day) for day, ks in batches.items() if day < newest for _, k in sorted(ks)[: math.ceil(len(ks) * 0.1)]}
    assert taken(spark, rows) == want


def test_sample_ignores_order_and_repeats_and_only_grows(spark):
    rows = arrivals(1500)
    shuffled = rows * 2
    random.Random(4).shuffle(shuffled)
    shuffled = [(k and random.Random(k).choice([k, k.upper(), k.replace("-", "_")]), at, x) for k, at, x in shuffled]
    assert taken(spark, rows) == taken(spark, shuffled)
    early = [r for r in rows if r[1] is None or r[1] < DAY + timedelta(days=5)]
    assert taken(spark, early) <= taken(spark, rows)
    assert taken(spark, []) == set()
    with pytest.raises(ValueError):
        taken(spark, rows, 0)


def stored(spark, folder, keys, rate=0.1):
    frame = spark.createDataFrame([(k, "x") for k in keys], "id string, hash string")
    return {(r.key, r.batch): r.hash for r in sample.extend_sample(str(folder), frame, F.col("id"), rate).collect()}


def test_stored_batches_never_change(spark, tmp_path):
    assert stored(spark, tmp_path / "s", []) == {} and stored(spark, tmp_path / "s", [None]) == {}
    first = [f"k{i}" for i in range(95)]
    one = stored(spark, tmp_path / "s", [*first, None, *first[:9]])
    want = sorted((sha256(f"sample:{k}".encode()).hexdigest(), k) for k in first)[:10]
    assert one == {(k, 0): h for h, k in want}
    # Nothing new, then late rows among known ones: a stateless sample by their times could lose members to them.
    assert stored(spark, tmp_path / "s", first) == one
    late = [f"late{i}" for i in range(31)]
    two = stored(spark, tmp_path / "s", [*late, *first])
    assert one.items() < two.items() and {b for _, b in two} == {0, 1} and len(two) == 10 + 4
    # A batch that was not finished is made again.
    (tmp_path / "s" / "1" / "_SUCCESS").unlink()
    assert stored(spark, tmp_path / "s", late[:11]).items() > one.items()
    assert stored(spark, tmp_path / "s", late).items() > one.items()
    with pytest.raises(ValueError):
        stored(spark, tmp_path / "s", first, 0)


TEXTS = "doc_id long, document_id string, source string, text string, created_at timestamp_ntz, tokens string, pattern string"


def corpus(spark):
    rng = random.Random(2)
    rows = []
    for i in range(1, 400):
        source = "big" if i % 3 else rng.choice(["mid", " MID", "small-one", "SMALL_ONE", None, "", "other"])
        rows.append((i, f"p-{i}", source, "word " * rng.randrange(1, 40), DAY + timedelta(hours=i), "t", "p"))
    rows += [(1000, "P_3", "mid", "word " * 50, DAY + timedelta(days=99), "t", "p"), (1001, None, "big", None, None, None, None), (1002, None, "big", "", DAY, None, None)]
    return rows, spark.createDataFrame(rows, TEXTS)


TARGETS = [("big", 0.3, 2, "x"), ("mid", 0.3, 3, "x"), ("small_one", 0.2, 2, "x"), ("absent", 0.1, 5, "x"), (None, 0.1, 1, "x")]


def test_mixture_respects_quotas_repeats_and_reports_shares(spark):
    rows, frame = corpus(spark)
    targets = spark.createDataFrame(TARGETS, "source string, weight double, max_repeats int, tokens string")
    sized, mix = mixture.mix(frame, targets)
    assert sized.filter("unit = 'p3'").count() == 1 and sized.filter("unit = 'p3'").first().pattern == "|".join(sorted({"mid", mixture_key(rows[2][2])} - {None, "other"}))
    assert mix.total == sized.agg({"tokens": "sum"}).first()[0]
    chosen = mixture.selected_documents(frame, targets)
    got = chosen.collect()
    limits = {s: r for s, _, r, _ in TARGETS}
    assert all(0 < r.copies <= limits[r.source] for r in got)
    spent = Counter()
    for r in got:
        spent[r.source] += r.copies * r.tokens
    for source, quota in mix.quota.items():
        # A stretch's last copy may overshoot, its first may be owed to the source before.
        assert abs(spent[source] - mix.given(source)) <= 2 * 60
        assert mix.given(source) == min(quota, room(mix, source, limits))
    short = {r.source for r in mixture.starved_sources(frame, targets).collect()}
    assert short == {s for s in mix.quota if room(mix, s, limits) < mix.quota[s]} and "absent" in short
    report = {r.source: r for r in mixture.share_report(chosen, targets).collect()}
    assert report["absent"].tokens == 0 and abs(sum(r.share for r in report.values()) - 1) < 1e-4


def test_starved_sources_agree_with_counting_tokens_of_each_source(spark):
    from folioflow.llm.tokens import VOCABULARY, _encoding

    rng = random.Random(7)
    rows = [(i, f"q-{i}", rng.choice(["a", "A ", "b-x", "b_x", "c", None]), rng.choice(["한 글 문장 ", "words of text ", "x1 "]) * rng.randrange(0, 30), DAY, "t", "p") for i in range(200)]
    targets = [("a", 0.5, 1), ("b_x", 0.2, 2), ("c", 0.9, 3), ("none", 0.01, 9), ("free", 0.0, 1)]
    count, total = Counter(), 0
    for _, _, source, text, *_ in rows:
        n = len(_encoding(VOCABULARY).encode_ordinary(text))
        count[mixture_key(source)] += n
        total += n
    want = {s for s, w, r in targets if count[s] * r < round(w * total)}
    got = mixture.starved_sources(spark.createDataFrame(rows, TEXTS), spark.createDataFrame(targets, "source string, weight double, max_repeats int"))
    assert {r.source for r in got.collect()} == want and 0 < len(want) < len(targets)


def room(mix, source, limits):
    """Tokens of a source if it had all its documents for itself."""
    return sum(n for p, n in mix.tokens.items() if source in p.split("|")) * limits[source]


def mixture_key(source):
    return source and source.strip().lower().replace("-", "_") or None


def test_mixture_of_nothing(spark):
    _, frame = corpus(spark)
    targets = spark.createDataFrame(TARGETS, "source string, weight double, max_repeats int, tokens string")
    assert mixture.selected_documents(frame.limit(0), targets).count() == 0
    assert mixture.starved_sources(frame.limit(0), targets).count() == 0


class FlowNetwork:
    """Minimum-cost maximum flow by successive shortest paths, arc by arc; what the pattern flow is held against."""

    def __init__(self, size):
        self.size, self.heads, self.room, self.cost = size, [], [], []
        self.out = [[] for _ in range(size)]

    def arc(self, tail: int, head: int, capacity: int, cost: int = 0) -> int:
        for a, b, c, w in ((tail, head, capacity, cost), (head, tail, 0, -cost)):
            self.out[a].append(len(self.heads))
            self.heads.append(b)
            self.room.append(c)
            self.cost.append(w)
        return len(self.heads) - 2

    def flow(self, arc: int) -> int:
        return self.room[arc ^ 1]

    def solve(self, start: int, end: int) -> int:
        import heapq

        lift, moved = [0] * self.size, 0
        while True:
            reach, via = [None] * self.size, [-1] * self.size
            reach[start], queue = 0, [(0, start)]
            while queue:
                far, at = heapq.heappop(queue)
                if far > reach[at]:
                    continue
                for k in self.out[at]:
                    if self.room[k] > 0:
                        to = self.heads[k]
                        cost = far + self.cost[k] + lift[at] - lift[to]
                        if reach[to] is None or cost < reach[to]:
                            reach[to], via[to] = cost, k
                            heapq.heappush(queue, (cost, to))
            if reach[end] is None:
                return moved
            lift = [p + r if r is not None else p for p, r in zip(lift, reach, strict=True)]
            step, at = None, end
            while at != start:
                step = self.room[via[at]] if step is None else min(step, self.room[via[at]])
                at = self.heads[via[at] ^ 1]
            at = end
            while at != start:
                self.room[via[at]] -= step
                self.room[via[at] ^ 1] += step
                at = self.heads[via[at] ^ 1]
            moved += step


def test_flow_is_cheapest():
    rng = random.Random(8)
    for _ in range(60):
        supply, demand = [rng.randrange(1, 4) for _ in range(2)], [rng.randrange(1, 5) for _ in range(2)]
        cost = [[rng.randrange(4) for _ in range(2)] for _ in range(2)]
        net = FlowNetwork(6)
        for i in range(2):
            net.arc(0, 2 + i, supply[i])
            net.arc(4 + i, 1, demand[i])
        arcs = {(i, j): net.arc(2 + i, 4 + j, 9, cost[i][j]) for i in range(2) for j in range(2)}
        moved = net.solve(0, 1)
        total = sum(net.flow(a) * cost[i][j] for (i, j), a in arcs.items())
        best = min(
            ((-(a + b + c + d), a * cost[0][0] + b * cost[0][1] + c * cost[1][0] + d * cost[1][1])
             for a in range(5) for b in range(5) for c in range(5) for d in range(5)
             if a + b <= supply[0] and c + d <= supply[1] and a + c <= demand[0] and b + d <= demand[1])
        )
        assert (-moved, total) == best


def plain_flow(tokens, repeats, quota):
    """(moved, cost) of the same problem as a network of single arcs."""
    names, sources = sorted(tokens), sorted(quota)
    net = FlowNetwork(2 + len(names) + len(sources))
    uses = []
    for i, name in enumerate(names):
        members = [s for s in name.split("|") if s in quota]
        uses += [(net.arc(0, 2 + i, tokens[name], k), k) for k in range(max((repeats[s] for s in members), default=0))]
        for s in members:
            net.arc(2 + i, 2 + len(names) + sources.index(s), tokens[name] * repeats[s])
    for j, s in enumerate(sources):
        net.arc(2 + len(names) + j, 1, quota[s])
    return net.solve(0, 1), sum(net.flow(a) * k for a, k in uses)


def cost_of(routed, tokens):
    used, cost = Counter(), 0
    for (name, _), n in routed.items():
        used[name] += n
    for name, n in used.items():
        whole, rest = divmod(n, tokens[name])
        cost += sum(range(whole)) * tokens[name] + whole * rest
    return cost


def test_pattern_flow_is_largest_and_cheapest():
    rng = random.Random(11)
    for _ in range(300):
        sources = "abcde"[: rng.randrange(1, 6)]
        tokens = {"|".join(sorted(rng.sample(sources, rng.randrange(1, len(sources) + 1)))): rng.randrange(1, 30) for _ in range(rng.randrange(1, 12))}
        repeats = {s: rng.randrange(4) for s in sources}
        quota = {s: rng.randrange(60) for s in sources}
        routed = mixture.PatternFlow(tokens, repeats, quota).solve()
        given = Counter()
        for (name, source), n in routed.items():
            assert source in name and 0 < n <= tokens[name] * repeats[source]
            given[source] += n
        assert all(given[s] <= quota[s] for s in sources)
        assert (sum(given.values()), cost_of(routed, tokens)) == plain_flow(tokens, repeats, quota)


def test_many_patterns_take_seconds():
    import time

    rng = random.Random(12)
    sources = [f"s{i:02d}" for i in range(24)]
    tokens = {"|".join(sorted(rng.sample(sources, rng.randrange(1, 6)))): rng.randrange(1, 10**6) for _ in range(40_000)}
    quota = {s: round(sum(tokens.values()) * rng.random() / 10) for s in sources}
    began = time.process_time()
    routed = mixture.PatternFlow(tokens, {s: rng.randrange(1, 5) for s in sources}, quota).solve()
    assert len(tokens) > 10_000 and sum(routed.values()) == sum(quota.values()) and time.process_time() - began < 10


def test_sources_that_share_too_little_stay_short(spark):
    rows = [(i, f"r-{i // 2}", "ab"[i % 2], "word " * 30, DAY, None, None) for i in range(20)] + [(99, "r-99", "c", "word " * 30, DAY, None, None)]
    frame = spark.createDataFrame(rows, TEXTS)
    targets = spark.createDataFrame([("a", 0.7, 1), ("b", 0.7, 1), ("c", 0.05, 1)], "source string, weight double, max_repeats int")
    _, mix = mixture.mix(frame, targets)
    assert mix.given("a") + mix.given("b") == mix.tokens["a|b"] and mix.given("c") == mix.quota["c"]
    assert [r.source for r in mixture.starved_sources(frame, targets).collect()] == ["b"]


def test_the_mix_holds_every_document_as_often_as_a_plain_walk_over_the_tape(spark):
    from hashlib import sha256

    rows, frame = corpus(spark)
    targets = spark.createDataFrame(TARGETS, "source string, weight double, max_repeats int, tokens string")
    sized, mix = mixture.mix(frame, targets)
    tapes = {}
    for r in sized.collect():
        if r.pattern and r.tokens:
            tapes.setdefault(r.pattern, []).append((sha256(f"mix:{r.unit}".encode()).hexdigest(), r.unit, r.doc_id, r.tokens))
    want, end = Counter(), Counter()
    for (name, source), amount in sorted(mix.routed.items()):
        begin, end[name] = end[name], end[name] + amount
        at = 0
        while at < end[name]:
            for _, _, doc, tokens in sorted(tapes[name]):
                if begin <= at < end[name]:
                    want[doc, source] += 1
                at += tokens
    chosen = mixture.selected_documents(frame, targets)
    assert {(r.doc_id, r.source): r.copies for r in chosen.collect()} == dict(want)
    sizes = {r.doc_id: r.tokens for r in sized.collect()}
    spent = Counter()
    for (doc, source), n in want.items():
        spent[source] += sizes[doc] * n
    for r in mixture.share_report(chosen, targets).collect():
        if r.source:
            assert r.tokens == spent[r.source] and abs(r.share - spent[r.source] / sum(spent.values())) < 1e-6
