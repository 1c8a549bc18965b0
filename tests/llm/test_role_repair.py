"""Role repair against exhaustive search, at any cut of the turns into ranges."""

import heapq
import random
import re

import pytest
from pyspark.sql import functions as F

from stratapack.llm import role_repair as rr
from stratapack.llm.common import table
from tests.conftest import SF


def cheapest(roles):
    """Uniform-cost search over (turns taken, role of the last turn), one edit at a time."""
    heap, seen = [(0, 0, "")], set()
    follow = {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}
    while heap:
        cost, k, last = heapq.heappop(heap)
        if (k, last) in seen:
            continue
        seen.add((k, last))
        if k == len(roles) and last == "assistant":
            return cost
        for role in follow[last]:
            heapq.heappush(heap, (cost + rr.COSTS["insert"], k, role))
        if k < len(roles):
            for role in ("system", "user", "assistant"):
                label = 0 if role == roles[k] else rr.COSTS["relabel" if roles[k] in ("system", "user", "assistant") else "unknown"]
                if role in follow[last]:
                    heapq.heappush(heap, (cost + label, k + 1, role))
                if role == last:
                    heapq.heappush(heap, (cost + label + rr.COSTS["merge"], k + 1, role))
    return None


def legal(text):
    roles = re.findall(r"<\|im_start\|>(\w+)\n", text)
    return re.fullmatch(r"(s)?(ua)+", "".join(r[0] for r in roles)) and text.count("<|im_end|>") == len(roles)


@pytest.mark.parametrize("ranges", [1, 5, 23])
def test_costs_and_order(spark, ranges):
    rng = random.Random(ranges)
    rows = []
    for conv in range(25):
        n = rng.choice([1, 2, 3, 7, 30])
        for turn in range(n):
            rows.append((conv, turn, rng.choice(["system", "user", "assistant", "user", "assistant", None, "tool"]), f"t{conv}.{turn}"))
    rows += [(100, k, "user", f"h{k}") for k in range(400)] + [(None, 0, "user", None), (None, 1, "assistant", "x"), (101, 3, "user", "same"), (101, 3, "user", "same"), (102, None, "assistant", "w" * 100_000)]
    rng.shuffle(rows)
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("seq", F.lit("clash")).withColumn("cost", F.lit(1))
    pieces = rr.repaired_turns(turns, ranges).cache()
    assert pieces.count() == len(rows)
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append((t if t is not None else -1, r or "", x or "", r))
    cost = {r["conv_id"]: r["c"] for r in pieces.groupBy("conv_id").agg(F.sum("cost").alias("c")).collect()}
    whole = {r["conv_id"]: r["text"] for r in rr.rendered(pieces).collect()}
    assert set(whole) == set(by)
    for conv, own in by.items():
        own.sort(key=lambda x: x[:2])
        assert cost[conv] == cheapest([x[3] for x in own])
        assert legal(whole[conv])
        at = [whole[conv].index(x[2]) for x in own]
        assert at == sorted(at)
    assert rr.repaired_turns(turns.limit(0)).count() == 0


def test_repaired_conversations_stay(spark):
    """What is legal costs nothing and keeps its roles."""
    turns = table(spark, SF, "conversations")
    pieces = rr.repaired_turns(turns, 3).collect()
    assert len(pieces) == turns.count()
    by = {}
    for p in sorted(pieces, key=lambda p: (p["conv_id"] is not None, p["conv_id"] or 0, p["position"])):
        by.setdefault(p["conv_id"], []).append(p)
    for own in by.values():
        if re.fullmatch("s?(ua)+", "".join(p["role"][0] for p in own)):
            assert all(p["cost"] == 0 and p["action"] == "keep" and p["out_role"] == p["role"] for p in own)
        assert legal("".join(p["rendered"] for p in own))
