"""Conversation repair against Dijkstra over whole edit texts, and the damage of the query against a loop."""

import hashlib
import heapq
import re
import zlib

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from barspark.llm import conversations as C
from barspark.llm.queries import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string"
SOLID = re.compile(r"[^\x20\x09-\x0D]")


def edits(rows):
    """(cost, audit, repaired) of the least among the cheapest, by search over (cost, letters)."""
    seen, heap = set(), [(0, "", 0, "", ())]
    while heap:
        cost, letters, k, roles, out = heapq.heappop(heap)
        if (k, letters) in seen or not re.fullmatch("(s?(ua)*u?)?", roles):
            continue
        seen.add((k, letters))
        if k == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            return cost, letters, "\n".join(f"{r}:{t}" for r, t in out)
        if len(letters) < 3 * len(rows) + 3:
            for role in ("user", "assistant"):
                heapq.heappush(heap, (cost + 5, letters + "I", k, roles + role[0], (*out, (role, ""))))
        if k < len(rows):
            role, text, fault = rows[k]
            heapq.heappush(heap, (cost + 2, letters + "D", k + 1, roles, out))
            if fault not in ("blank", "duplicate"):
                more = 5 * (fault == "truncated")
                if role:
                    heapq.heappush(heap, (cost + more, letters + "K", k + 1, roles + role[0], (*out, (role, text))))
                for new in ("user", "assistant"):
                    heapq.heappush(heap, (cost + 1 + more, letters + "R", k + 1, roles + new[0], (*out, (new, text))))


def folded(rows):
    """As edits(), by a fold of the least (cost, letters, text) of each prefix of roles' end."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    def with_inserts(best):
        for _ in range(4):
            for state, (cost, letters, out) in list(best.items()):
                for role in ("user", "assistant"):
                    if (to := step.get((state, role[0]))) is not None:
                        best[to] = min(best.get(to, (1 << 40,)), (cost + 5, letters + "I", (*out, f"{role}:")))
        return best

    best = with_inserts({"": (0, "", ())})
    for role, text, fault in rows:
        new = {}
        for state, (cost, letters, out) in best.items():
            ways = [(state, (cost + 2, letters + "D", out))]
            if fault not in ("blank", "duplicate"):
                ways += [(step.get((state, r[:1])), (cost + c + 5 * (fault == "truncated"), letters + x, (*out, f"{r}:{text}"))) for x, c, r in (("K", 0, role), ("R", 1, "user"), ("R", 1, "assistant"))]
            for to, way in ways:
                if to is not None:
                    new[to] = min(new.get(to, (1 << 40,)), way)
        best = with_inserts(new)
    cost, letters, out = min(best[q] for q in ("", "a") if q in best)
    return cost, letters, "\n".join(out)


def marked(rows):
    seen, out = set(), []
    for role, text in rows:
        fault = "" if SOLID.search(text) else "blank"
        fault = fault or ("duplicate" if (role, text) in seen else "")
        fault = fault or ("" if SOLID.findall(text)[-1] in ".!?" else "truncated")
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def digest(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()


def report(turns, conversations):
    """The report of [(conv_id, turn, role, text)] by loops."""
    out = {}
    for conv in conversations:
        mine = [(t, r if r is not None else " ", x if x is not None else " ") for c, t, r, x in turns if c == conv]
        mine.sort(key=lambda t: (t[0] is not None, t[0] or 0, digest(t[1], t[2])))
        rows = marked([(r, x) for _, r, x in mine])
        numbers = [t for t, _, _ in mine if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum((a[0][:1] + b[0][:1]) not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        cost, audit, text = folded(rows)
        count = lambda f: sum(x[2] == f for x in rows)  # noqa: E731, B023
        out[conv] = (gaps, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


def of(df):
    assert df.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    rows = [tuple(r) for r in df.collect()]
    assert len({r[0] for r in rows}) == len(rows)
    return {r[0]: r[1:] for r in rows}


def hurt(turns):
    out = []
    for conv, turn, role, text in turns:
        shown = [" " if v is None else str(v) for v in (conv, turn, role, text)]
        draw = zlib.crc32(f"{shown[0]}:{shown[1]}".encode()) % 20
        role, text = "user" if draw == 4 else shown[2], {1: "", 2: re.sub("[.!?]", "", shown[3])}.get(draw, shown[3])
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(draw, 1)
    return out


def test_registered_query(spark, sf):
    turns = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert of(QUERIES["op12_tight_arcs"](spark, sf)) == report(hurt(turns), {t[0] for t in turns})


def test_registered_query_on_odd_rows(spark, tmp_path):
    turns = [(c, t, r, x) for c in (None, 1, 2, 3, 4, 5, 6, 7) for t in (None, 0, 1, 2, 4) for r, x in (("user", "Hi."), ("assistant", None), (None, "So?"))]
    turns += [(8, t, "tool", "x" * 300_000 + ".") for t in range(3)] + [(9, None, "", "a.")] * 3 + [(10, 5, "user", " \t\n")] + [(11, 2**40, "system", "A!"), (11, 0, "é", "B")]
    path = str(tmp_path)
    df = pd.DataFrame(turns, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"}).assign(conv=1, at="x", code=None)
    df.to_parquet(f"{path}/conversations.parquet")
    assert of(QUERIES["op12_tight_arcs"](spark, path)) == report(hurt(turns), {t[0] for t in turns})
    df.iloc[:0].astype({"role": "string", "text": "string"}).to_parquet(f"{path}/conversations.parquet")
    assert of(QUERIES["op12_tight_arcs"](spark, path)) == {}


@pytest.fixture
def many_pieces(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_a_long_conversation_in_pieces(spark, many_pieces):
    rng = np.random.default_rng(5)
    roles, texts = ["system", "user", "assistant", "tool", "user", "assistant"], ["", "cut", "Yes.", "No!", " "]
    turns = [(1, int(rng.integers(0, 60)) if rng.random() < 0.95 else None, roles[rng.integers(6)], texts[rng.integers(5)] + ("" if rng.random() < 0.3 else f"{k}.")) for k in range(40)]
    turns += [(2, k, ("user", "assistant")[k % 2], f"t{k}.") for k in range(6)]
    df = spark.createDataFrame(turns, SCHEMA)
    assert C.ordered_turns(df).where("conv = '=1'").selectExpr("at >> 33").distinct().count() > 3
    assert of(C.repair_report(df)) == report(turns, {1, 2})
    repaired = sorted((r.conv_id, r.turn, f"{r.role}:{r.text}") for r in C.repaired_turns(df).collect())
    for conv, row in report(turns, {1, 2}).items():
        mine = [x for c, _, x in repaired if c == conv]
        assert [t for c, t, _ in repaired if c == conv] == list(range(len(mine)))
        assert hashlib.sha256("\n".join(mine).encode()).hexdigest() == row[-1]


def test_pieces_give_what_the_whole_gives():
    """A conversation of 5,000 turns, cut at any places, spells the same edits."""
    rng = np.random.default_rng(2)
    keys = np.arange(5000) * 16 + rng.choice(16, 5000, p=np.r_[np.full(4, 0.15), np.full(12, 0.4 / 12)])
    none = {"into": None, "out_of": None, "total": None, "last": None}
    whole = next(C._traced(iter([pd.DataFrame([{"conv": "c", "piece": 0, "keys": keys, **none}])])))
    cuts = [0, 1, 2, 700, 701, 2500, 5000]
    pieces = pd.DataFrame([{"conv": "c", "piece": k, "keys": keys[a:b]} for k, (a, b) in enumerate(zip(cuts, cuts[1:]))])
    carried = C._carried(pd.concat(C._matrices(iter([pieces]))))
    traced = pd.concat(C._traced(iter([pieces.merge(carried, on=["conv", "piece"])]))).sort_values("piece")
    chain = C._chained(traced).sort_values("piece")
    letters = "".join(next(w["letters"] for w in ways if w["entry"] == q) for ways, q in zip(traced["ways"], chain["entry"]))
    assert letters == whole["ways"].iat[0][0]["letters"]
    assert traced["illegal"].sum() + chain["joint"].sum() == whole["illegal"].iat[0]
    assert set(traced["cost"]) == set(whole["cost"])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["system", "user", "assistant", "x"]), st.sampled_from(["", "", "", "truncated", "blank", "duplicate"])), max_size=5))
def test_least_of_the_cheapest_edits(rows):
    if not rows:
        return
    codes = [(C.INITIALS + "x").index(r[0]) + 4 * C.FAULTS.index(f) for r, f in rows]
    keys = np.arange(len(rows)) * 16 + np.array(codes)
    found = next(C._traced(iter([pd.DataFrame([{"conv": "c", "piece": 0, "keys": keys, "into": None, "out_of": None, "total": None, "last": None}])])))
    assert edits([(r, "t", f) for r, f in rows])[:2] == folded([(r, "t", f) for r, f in rows])[:2]
    cost, audit, _ = edits([(r, "t", f) for r, f in rows])
    assert (found["cost"].iat[0], found["ways"].iat[0][0]["letters"]) == (cost, audit)
