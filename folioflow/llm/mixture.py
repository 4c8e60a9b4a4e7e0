"""Mixing sources to target weights by min-cost flow over membership patterns.

Documents are aggregated by the set of target sources they belong to (their pattern). On the driver, a flow network
over the patterns routes tokens to source quotas: a pattern's first use is free and each further use of all its
documents costs more than the one before, so repetition is spread as evenly as quotas allow. Only the pattern table,
not the documents, reaches the driver. The documents that carry the flow are then chosen by seeded hash order with
two-level prefix sums.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions.ids import narrow, page_key
from folioflow.llm.tokens import VOCABULARY, token_count
from folioflow.plans.lineage import cut_lineage
from folioflow.plans.ranks import preceding_total

#: Stretches of tape that may be broadcast; more are joined by a shuffle.
MOST_BROADCAST = 100_000


def source_key(source: Column) -> Column:
    """A source apart from letter case, outer blanks and ``-`` for ``_``; blank is null."""
    key = F.replace(F.lower(F.trim(narrow(source))), F.lit("-"), F.lit("_"))
    return F.when(key != "", key)


class PatternFlow:
    """Minimum-cost maximum flow of tokens from patterns to source quotas.

    Only the uses of a pattern cost, each more than the one before, so the flow is cheapest if uses are opened one level
    at a time and each level is filled as far as it goes. Sources are few, patterns many: a level is filled along paths
    from source to source (a gives up tokens of some patterns for b, whose quota is open), and all patterns that a step
    of the path may use are moved at once.
    """

    def __init__(self, tokens: dict[str, int], repeats: dict[str, int], quota: dict[str, int]) -> None:
        self.names, self.sources = sorted(tokens), sorted(quota)
        self.tokens = np.array([tokens[n] for n in self.names], np.int64)
        number = {s: i for i, s in enumerate(self.sources)}
        members = [[number[s] for s in n.split("|") if s in number] for n in self.names]
        self.most = np.array([max((repeats[self.sources[i]] for i in m), default=0) for m in members], np.int64)
        held: list[list[int]] = [[] for _ in self.sources]
        for p, m in enumerate(members):
            for i in m:
                held[i].append(p)
        #: Patterns of each source, ascending; what flows from each and how much more may.
        self.patterns = [np.array(h, np.int64) for h in held]
        self.flow = [np.zeros(len(h), np.int64) for h in held]
        self.room = [self.tokens[h] * repeats[s] for h, s in zip(self.patterns, self.sources, strict=True)]
        self.open = [quota[s] for s in self.sources]
        self.free = np.zeros(len(self.names), np.int64)
        self.common: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    def solve(self) -> dict[tuple[str, str], int]:
        """Tokens of each (pattern, source) that has some."""
        level = 0
        while any(self.open) and (self.most > level).any():
            self.free += np.where(self.most > level, self.tokens, 0)
            for i in range(len(self.sources)):
                self._give(i, self.open[i])
            while self._reroute():
                pass
            level += 1
        return {(self.names[p], s): int(f) for s, h, flow in zip(self.sources, self.patterns, self.flow, strict=True) for p, f in zip(h.tolist(), flow.tolist(), strict=True) if f}

    def _give(self, i: int, most: int) -> None:
        """Up to ``most`` free tokens to a source."""
        part = _first(np.minimum(self.free[self.patterns[i]], self.room[i]), most)
        self.flow[i] += part
        self.room[i] -= part
        self.free[self.patterns[i]] -= part
        self.open[i] -= int(part.sum())

    def _both(self, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        if (i, j) not in self.common:
            self.common[i, j] = np.intersect1d(self.patterns[i], self.patterns[j], assume_unique=True, return_indices=True)[1:]
        return self.common[i, j]

    def _movable(self, i: int, j: int) -> np.ndarray:
        x, y = self._both(i, j)
        return np.minimum(self.flow[i][x], self.room[j][y])

    def _reroute(self) -> bool:
        """One shortest path from free tokens to an open quota; False if there is none."""
        spare = [int(np.minimum(self.free[h], r).sum()) for h, r in zip(self.patterns, self.room, strict=True)]
        queue = [i for i, n in enumerate(spare) if n]
        via: dict[int, int | None] = dict.fromkeys(queue)
        for i in queue:
            if self.open[i]:
                path = [i]
                while via[path[-1]] is not None:
                    path.append(via[path[-1]])
                steps = list(zip(path[1:], path))
                amount = min(self.open[i], spare[path[-1]], *(int(self._movable(a, b).sum()) for a, b in steps))
                for a, b in steps:
                    x, y = self._both(a, b)
                    part = _first(self._movable(a, b), amount)
                    self.flow[a][x] -= part
                    self.room[a][x] += part
                    self.flow[b][y] += part
                    self.room[b][y] -= part
                self.open[path[-1]] += amount
                self._give(path[-1], amount)
                self.open[i] -= amount
                return True
            for j in range(len(self.sources)):
                if j not in via and self._movable(i, j).any():
                    via[j] = i
                    queue.append(j)
        return False


def _first(amounts: np.ndarray, most: int) -> np.ndarray:
    """The part of each amount that goes into ``most``, from the first on."""
    ends = np.cumsum(amounts)
    return np.clip(most - (ends - amounts), 0, amounts)


@dataclass
class Mixture:
    """What the flow decided: quotas of sources, and tokens of each (pattern, source)."""

    total: int
    quota: dict[str, int]
    routed: dict[tuple[str, str], int]
    tokens: dict[str, int]

    def given(self, source: str) -> int:
        return sum(t for (_, s), t in self.routed.items() if s == source)


def sized_documents(documents: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(unit, doc_id, tokens, pattern): one row per document, delivered once or more.

    Deliveries with one document_id (in any spelling) are one document: the latest counts, and it belongs to all
    sources it was delivered by. Documents without an id are counted by doc_id. ``pattern`` holds the sorted target
    sources joined by ``|``; it is empty for documents of no target source, which count for the total only.
    """
    known = targets.select(source_key(F.col("source")).alias("_source")).filter("_source is not null").distinct().withColumn("_known", F.lit(True))
    sized = documents.select(
        F.coalesce(page_key(F.col("document_id")), F.concat(F.lit("doc:"), F.col("doc_id").cast("string"))).alias("unit"),
        "doc_id", "created_at", source_key(F.col("source")).alias("_source"), token_count(F.col("text"), vocabulary).alias("tokens"),
    ).join(F.broadcast(known), "_source", "left")
    return sized.groupBy("unit").agg(
        F.max(F.struct("created_at", "doc_id", "tokens")).alias("_last"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("_known"), F.col("_source")))), "|").alias("pattern"),
    ).select("unit", "_last.doc_id", "_last.tokens", "pattern")


def route(sized: DataFrame, targets: DataFrame) -> Mixture:
    """Solve the flow over membership patterns. The mix is as large, in tokens, as all documents once.

    Patterns are sets of target sources, at most two to the power of their number, whatever the documents; one row each
    reaches the driver.
    """
    patterns = sized.groupBy("pattern").agg(F.sum("tokens").alias("tokens")).collect()
    wanted = targets.select(source_key(F.col("source")).alias("source"), "weight", "max_repeats").filter("source is not null").groupBy("source").agg(F.sum("weight").alias("weight"), F.max("max_repeats").alias("repeats")).collect()
    total = sum(p["tokens"] for p in patterns)
    tokens = {p["pattern"]: p["tokens"] for p in patterns if p["pattern"] and p["tokens"] > 0}
    weight = {r["source"]: r["weight"] or 0.0 for r in wanted}
    repeats = {r["source"]: max(0, r["repeats"] or 0) for r in wanted}
    quota = {s: max(0, round(w * total)) for s, w in weight.items()}
    return Mixture(total, quota, PatternFlow(tokens, repeats, quota).solve(), tokens)


def mix(documents: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY) -> tuple[DataFrame, Mixture]:
    """The sized documents (checkpointed: the flow and the selection read them) and the flow over them."""
    sized = cut_lineage(sized_documents(documents, targets, vocabulary))
    return sized, route(sized, targets)


def starved_sources(documents: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(source) whose quota the flow cannot fill even with all documents repeated as often as allowed.

    Where sources share documents that are too few for all of them, the flow is largest however it divides these; the
    last ones by name stay short.
    """
    _, mixture = mix(documents, targets, vocabulary)
    short = [(s,) for s in sorted(mixture.quota) if mixture.given(s) < mixture.quota[s]]
    return documents.sparkSession.createDataFrame(short, "source string")


def selected_documents(documents: DataFrame, targets: DataFrame, seed: str = "mix", vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, copies, tokens): how often each document enters the mix, for which source.

    A pattern's documents, in seeded hash order, form a tape that is passed as often as the flow asks; each source
    owns a stretch of it, so no document is used for a source more than its max_repeats.
    """
    sized, mixture = mix(documents, targets, vocabulary)
    stretches, end = [], {}
    for (name, source), amount in sorted(mixture.routed.items()):
        begin = end.get(name, 0)
        end[name] = begin + amount
        stretches.append((name, source, begin, begin + amount, mixture.tokens[name]))
    tape = sized.sparkSession.createDataFrame(stretches, "pattern string, source string, begin long, `end` long, lap long")
    ordered = preceding_total(sized.filter("pattern <> '' and tokens > 0").withColumn("_hash", F.sha2(F.concat_ws(":", F.lit(seed), "unit"), 256)), ["pattern"], ["_hash", "unit"], "_hash", "tokens")
    laps = lambda edge: F.greatest(F.lit(0), F.ceil((F.col(edge) - F.col("preceding")) / F.col("lap")))
    return (
        ordered.join(F.broadcast(tape) if len(stretches) <= MOST_BROADCAST else tape, "pattern")
        .select("doc_id", "source", (laps("end") - laps("begin")).cast("long").alias("copies"), "tokens")
        .filter("copies > 0")
    )


def share_report(selected: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, weight, share, tokens, n_docs, most_copies): the shares really reached."""
    used = selected.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.count("*").alias("n_docs"), F.max("copies").alias("most_copies"))
    wanted = targets.select(source_key(F.col("source")).alias("source"), "weight")
    rows = wanted.join(used, "source", "left").na.fill(0, ["tokens", "n_docs", "most_copies"])
    whole = rows.agg(F.sum("tokens").alias("_all"))
    return rows.crossJoin(F.broadcast(whole)).select("source", "weight", F.round(F.try_divide("tokens", "_all"), 6).alias("share"), "tokens", "n_docs", "most_copies")
