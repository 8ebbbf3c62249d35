"""Conversation repair: the cheapest edits that bring the turns of a conversation into a legal order.

Edits are arcs of a layered graph whose nodes are (turns consumed, state of the role grammar): Keep, Rerole and Delete consume a turn,
Insert does not. Forward and backward minimum costs over the layers tell which arcs lie on some cheapest path (forward cost + weight
+ backward cost equals the optimum: the arc is tight). A set of frontier nodes then walks the tight arcs, taking the least letter that
any of its nodes offers, so the walk spells the least of all cheapest edit texts.

A conversation of any length is cut into pieces by a range partitioning of all turns. A piece acts on costs as a small
matrix in (min, +); the matrices of a cut conversation, one a piece, are folded from both ends, and each piece is then
walked on its own from every state that it may be entered in. Only the hash of the repaired text, which is one byte string a conversation,
runs through a conversation from end to end; it streams, a batch at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barspark.llm.storage import attached, discard, saved

#: The grammar `(s?(ua)+)?` of role initials: 0 at the start, 1 after s, 2 after u, 3 after a.
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
ACCEPTED = (0, 3)
STATES = 4
INITIALS = "sua"  # all others are one more
ROLES = {"u": "user", "a": "assistant"}
#: Costs of the edits, and what an undeleted truncated turn adds.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
LETTERS = "DIKR"
NEVER = 1 << 40
FAULTS = ("", "blank", "duplicate", "truncated")
#: Cells of padded arrays that one step of a task holds.
CELLS = 1 << 20


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights of the arcs [code, letter, from, to] of a turn, of one insertion [from, to], and of any number of them.

    code is initial + 4 * fault; code 16 is no turn at all, which costs nothing.
    """
    arcs = np.full((17, len(LETTERS), STATES, STATES), NEVER)
    insert = np.full((STATES, STATES), NEVER)
    for (q, c), to in NEXT.items():
        if c in ROLES:
            insert[q, to] = INSERT
    for code in range(16):
        initial, fault = (INITIALS + "?")[code % 4], FAULTS[code // 4]
        arcs[code, LETTERS.index("D")][np.diag_indices(STATES)] = DELETE
        if fault in ("blank", "duplicate"):
            continue
        more = TRUNCATED if fault == "truncated" else 0
        for (q, c), to in NEXT.items():
            if c == initial:
                arcs[code, LETTERS.index("K"), q, to] = KEEP + more
            if c in ROLES:
                arcs[code, LETTERS.index("R"), q, to] = REROLE + more
    arcs[16, 0][np.diag_indices(STATES)] = 0
    closed = np.where(np.eye(STATES, dtype=bool), 0, insert)
    for _ in range(STATES):
        closed = np.minimum(closed, (closed[:, :, None] + closed[None]).min(1))
    return arcs, insert, closed


ARCS, ONE_INSERT, INSERTS = _tables()
TURN = ARCS.min(1)
#: Inserting before a turn and consuming it.
STEP = np.minimum((INSERTS[None, :, :, None] + TURN[:, None]).min(2), NEVER)
# From a state, a letter and the turn's role lead to one state at most, so an edit text names its path and thereby the repaired turns.
assert ((ARCS < NEVER).sum(3) <= 1).all() and ((ONE_INSERT < NEVER).sum(1) <= 1).all()


def forward(codes: np.ndarray, into: np.ndarray) -> np.ndarray:
    """[row, layer, state] least costs of reaching a node, before insertions there; codes [row, turn] are padded with 16."""
    out = np.empty((len(codes), codes.shape[1] + 1, STATES), np.int64)
    out[:, 0] = into
    for k in range(codes.shape[1]):
        out[:, k + 1] = np.minimum((out[:, k, :, None] + STEP[codes[:, k]]).min(1), NEVER)
    return out


def backward(codes: np.ndarray, out_of: np.ndarray) -> np.ndarray:
    """[row, layer, state] least costs from a node to the end, insertions there included. out_of: costs from the last layer, likewise."""
    out = np.empty((len(codes), codes.shape[1] + 1, STATES), np.int64)
    out[:, -1] = out_of
    for k in range(codes.shape[1] - 1, -1, -1):
        out[:, k] = np.minimum((STEP[codes[:, k]] + out[:, k + 1, None, :]).min(2), NEVER)
    return out


#: Costs from the last layer of a conversation.
AT_END = (INSERTS + np.where(np.isin(np.arange(STATES), ACCEPTED), 0, NEVER)).min(1)
AT_START = np.where(np.arange(STATES) == 0, 0, NEVER)


def walked(codes: np.ndarray, lengths: np.ndarray, into: np.ndarray, out_of: np.ndarray, total: np.ndarray, entry: np.ndarray, last: np.ndarray) -> list[tuple[str, int]]:
    """The least letters and the set of states at the end of each row, entered in the states of entry [row, state].

    A row that is the last of its conversation may insert behind its last turn and ends in an accepted state.
    """
    n = len(codes)
    ahead = forward(codes, into)
    ahead = np.minimum((ahead[..., None] + INSERTS).min(2), NEVER)
    behind = backward(codes, out_of)
    at, frontier, active = np.zeros(n, int), entry.copy(), np.ones(n, bool)
    letters: list[list[str]] = [[] for _ in range(n)]
    accepted = np.isin(np.arange(STATES), ACCEPTED)
    while active.any():
        w = np.flatnonzero(active)
        done = at[w] == lengths[w]
        over = done & (~last[w] | (frontier[w] & accepted & (ahead[w, at[w]] == total[w, None])).any(1))
        active[w[over]] = False
        w, done = w[~over], done[~over]
        if not len(w):
            break
        code = np.where(done, 16, codes[w, np.minimum(at[w], codes.shape[1] - 1)] if codes.shape[1] else 16)
        open_ = np.ones(len(w), bool)
        for k, letter in enumerate(LETTERS):
            weight = np.broadcast_to(ONE_INSERT, (len(w), STATES, STATES)) if letter == "I" else ARCS[code, k]
            to = at[w] if letter == "I" else np.minimum(at[w] + 1, codes.shape[1])
            tight = frontier[w][:, :, None] & (ahead[w, at[w]][:, :, None] + weight + behind[w, to][:, None, :] == total[w, None, None])
            reached = tight.any(1)
            takes = open_ & reached.any(1) & ((letter == "I") | ~done)
            frontier[w[takes]] = reached[takes]
            at[w[takes]] = to[takes]
            for x in w[takes]:
                letters[x].append(letter)
            open_ &= ~takes
        if open_.any():
            raise AssertionError("a frontier without a tight arc")
    return [("".join(s), int(np.flatnonzero(f)[0])) for s, f in zip(letters, frontier, strict=True)]


def _padded(pieces: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray]]:
    """Pieces of like lengths with their codes as one array, in parts of about CELLS cells or one piece."""
    lengths = pieces["keys"].map(len).to_numpy(int)
    order = np.argsort(lengths, kind="stable")
    start = 0
    while start < len(order):
        end = start + 1
        while end < len(order) and (end + 1 - start) * (lengths[order[end]] + 1) <= CELLS:
            end += 1
        rows = order[start:end]
        codes = np.full((len(rows), lengths[rows].max(initial=0)), 16, np.int64)
        for r, x in enumerate(rows):
            codes[r, : lengths[x]] = np.asarray(pieces["keys"].iat[x], np.int64) & 15
        yield pieces.iloc[rows], codes, lengths[rows]
        start = end


def _matrices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Costs from each state before a piece to each state behind it."""
    for batch in batches:
        for rows, codes, _ in _padded(batch):
            per = [forward(codes, np.where(np.arange(STATES) == q, 0, NEVER))[:, -1] for q in range(STATES)]
            yield pd.DataFrame({"conv": rows["conv"].to_numpy(), "piece": rows["piece"].to_numpy(), "costs": list(np.stack(per, 1).reshape(len(rows), -1))})


def _carried(group: pd.DataFrame) -> pd.DataFrame:
    """Costs into and out of each piece of a cut conversation, from the matrices of its pieces."""
    group = group.sort_values("piece")
    costs = [np.asarray(c, np.int64).reshape(STATES, STATES) for c in group["costs"]]
    into, out_of = [AT_START], [AT_END]
    for m in costs:
        into.append(np.minimum((into[-1][:, None] + m).min(0), NEVER))
    for m in reversed(costs):
        out_of.append(np.minimum((m + out_of[-1][None]).min(1), NEVER))
    out_of = out_of[::-1]
    n = len(costs)
    return pd.DataFrame({"conv": group["conv"], "piece": group["piece"], "into": into[:n], "out_of": out_of[1:], "total": int(out_of[0][0]), "last": [k == n - 1 for k in range(n)]})


_LEGAL = np.zeros((4, 4), bool)
for _a, _b in ("su", "ua", "au"):
    _LEGAL[INITIALS.index(_a), INITIALS.index(_b)] = True


def _traced(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The walk through each piece from every state that a cheapest path may enter it in."""
    for batch in batches:
        for rows, codes, lengths in _padded(batch):
            n, cut = len(rows), rows["total"].notna().to_numpy()
            into, out_of = np.tile(AT_START, (n, 1)), np.tile(AT_END, (n, 1))
            last, total = np.ones(n, bool), backward(codes, out_of)[:, 0, 0]
            for r in np.flatnonzero(cut):
                into[r], out_of[r] = rows["into"].iat[r], rows["out_of"].iat[r]
                last[r], total[r] = rows["last"].iat[r], int(rows["total"].iat[r])
            first = backward(codes, out_of)[:, 0]
            closed = np.minimum((into[:, :, None] + INSERTS).min(1), NEVER)
            ways: list[list[dict]] = [[] for _ in range(n)]
            for q in range(STATES):
                may = np.flatnonzero((closed[:, q] + first[:, q] == total) & (cut | (q == 0)))
                if len(may):
                    entry = np.tile(np.arange(STATES) == q, (len(may), 1))
                    found = walked(codes[may], lengths[may], into[may], out_of[may], total[may], entry, last[may])
                    for r, (letters, end) in zip(may, found, strict=True):
                        ways[r].append({"entry": q, "end": end, "letters": letters})
            initials = codes % 4
            inside = np.arange(1, codes.shape[1]) < lengths[:, None] if codes.shape[1] > 1 else np.zeros((n, 0), bool)
            illegal = (inside & ~_LEGAL[initials[:, :-1], initials[:, 1:]]).sum(1)
            ends = initials[np.arange(n), lengths - 1]
            yield pd.DataFrame({"conv": rows["conv"].to_numpy(), "piece": rows["piece"].to_numpy(), "cost": total, "illegal": illegal, "head": initials[:, 0], "tail": ends, "ways": ways})


def _chained(group: pd.DataFrame) -> pd.DataFrame:
    """The state that each piece of a cut conversation is entered in, and whether its first turn is illegal behind the piece before."""
    group = group.sort_values("piece")
    state, entries, joints, before = 0, [], [], None
    for head, tail, ways in zip(group["head"], group["tail"], group["ways"], strict=True):
        entries.append(state)
        joints.append(int(before is not None and not _LEGAL[before, head]))
        state, before = next(w["end"] for w in ways if w["entry"] == state), tail
    return pd.DataFrame({"conv": group["conv"], "piece": group["piece"], "entry": entries, "joint": joints})


def _acts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each turn the role that it gets (null: deleted, '': its own), and the roles inserted before it; behind the last one, too."""
    by_letter = {q: c for (q, c) in NEXT if c in ROLES}
    for batch in batches:
        rows: list[tuple] = []
        for conv, keys, letters, state in zip(batch["conv"], batch["keys"], batch["letters"], batch["entry"], strict=True):
            k, lead = 0, []
            for x in letters:
                if x == "I":
                    lead.append(ROLES[by_letter[state]])
                    state = NEXT[state, by_letter[state]]
                    continue
                key = int(keys[k])
                k += 1
                role = None
                if x == "K":
                    role, state = "", NEXT[state, INITIALS[key & 3]]
                elif x == "R":
                    role, state = ROLES[by_letter[state]], NEXT[state, by_letter[state]]
                rows.append((conv, key >> 4, 0, lead, role))
                lead = []
            if lead:
                rows.append((conv, int(keys[-1]) >> 4, 2, lead, None))
        yield pd.DataFrame(rows, columns=["conv", "at", "kind", "lead", "new_role"])


def _hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The digest of each conversation of a sorted stream of repaired turns."""
    now, digest, empty = None, None, True
    for batch in batches:
        out: list[tuple[str, str]] = []
        for conv, role, text in zip(batch["conv"], batch["role"], batch["text"], strict=True):
            if conv != now:
                if digest is not None:
                    out.append((now, digest.hexdigest()))
                now, digest, empty = conv, hashlib.sha256(), True
            if role is not None:
                digest.update(("" if empty else "\n").encode() + role.encode() + b":" + text.encode())
                empty = False
        yield pd.DataFrame(out, columns=["conv", "repaired_sha256"])
    if digest is not None:
        yield pd.DataFrame([(now, digest.hexdigest())], columns=["conv", "repaired_sha256"])


def _with_acts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Repaired turns of a stream in which the act on a turn (kind 0) goes before the turn (kind 1). A conversation without any keeps one row without role."""
    now, act = None, None
    for batch in batches:
        out: list[tuple] = []
        for conv, kind, lead, new_role, role, text in zip(*(batch[c] for c in ("conv", "kind", "lead", "new_role", "role", "text")), strict=True):
            if conv != now:
                out.append((conv, None, None))
                now = conv
            if kind != 1:
                out.extend((conv, r, "") for r in lead)
                act = new_role
            elif act is not None:
                out.append((conv, act or role, text))
        yield pd.DataFrame(out, columns=["conv", "role", "text"])


def ordered_turns(turns: DataFrame) -> DataFrame:
    """conv, at, turn, role, text and digest of turns (conv_id, turn, role, text); at rises along each conversation.

    Order is turn, nulls first; tied turns by the digest of role and text. conv is a text form of conv_id that nulls have as well. A null
    role or text is one space. The upper bits of at number the partition, that is the piece.
    """
    role, text = F.coalesce(F.col("role"), F.lit(" ")), F.coalesce(F.col("text"), F.lit(" "))
    rows = turns.select(conversation_key().alias("conv"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    rows = rows.withColumn("digest", F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.encode("role", "UTF-8"), F.encode("text", "UTF-8")), 256))
    order = ["conv", F.asc_nulls_first("turn"), "digest"]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())


def conversation_key() -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))


def faults(ordered: DataFrame) -> DataFrame:
    """conv, at, turn, code of ordered turns: the initial's number + 4 * the number of the first fault in FAULTS.

    blank: no character but white space; duplicate: role and text seen earlier in the conversation; truncated: the last
    character but white space is none of `.!?`.
    """
    first = F.substring("role", 1, 1)
    initial = F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)
    solid = r"[^\x20\x09-\x0D]"
    narrow = ordered.select("conv", "at", "turn", "digest", initial.alias("initial"), (~F.col("text").rlike(solid)).alias("blank"), (~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")).alias("cut"))
    narrow = saved(narrow, "turn-marks")
    firsts = narrow.groupBy("conv", "digest").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("new"))
    fault = F.when(F.col("blank"), 1).when(F.col("new").isNull(), 2).when(F.col("cut"), 3).otherwise(0)
    return narrow.join(firsts, "at", "left").select("conv", "at", "turn", (F.col("initial") + 4 * fault).alias("code"))


def _repair(turns: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Marked turns, pieces with their chosen edits, and the stream of repaired turns, sorted in each conversation."""
    ordered = saved(ordered_turns(turns), "turns")
    marked = saved(faults(ordered), "turn-faults")
    keys = F.sort_array(F.collect_list(F.col("at") * 16 + F.col("code")))
    pieces = saved(marked.groupBy("conv", F.shiftright("at", 33).alias("piece")).agg(keys.alias("keys")), "turn-pieces")
    # A cut lies between two partitions, so there are fewer cut conversations than partitions.
    cut = pieces.groupBy("conv").agg(F.count("*").alias("n")).where("n > 1").select("conv")
    matrices = pieces.join(cut, "conv", "left_semi").mapInPandas(_matrices, "conv string, piece long, costs array<long>")
    carried = matrices.groupBy("conv").applyInPandas(_carried, "conv string, piece long, into array<long>, out_of array<long>, total long, last boolean")
    traced = saved(
        attached(pieces, saved(carried, "turn-carried"), ["conv", "piece"], "left").mapInPandas(
            _traced, "conv string, piece long, cost long, illegal long, head int, tail int, ways array<struct<entry:int,end:int,letters:string>>"
        ),
        "turn-ways",
    )
    ends = F.transform("ways", lambda w: F.struct(w["entry"].alias("entry"), w["end"].alias("end"))).alias("ways")
    chained = traced.join(cut, "conv", "left_semi").select("conv", "piece", "head", "tail", ends)
    chained = saved(chained.groupBy("conv").applyInPandas(_chained, "conv string, piece long, entry int, joint int"), "turn-chain")
    entry = F.coalesce("entry", F.lit(0))
    letters = F.filter("ways", lambda w: w["entry"] == entry)[0]["letters"]
    chosen = attached(traced, chained, ["conv", "piece"], "left")
    chosen = saved(chosen.select("conv", "piece", entry.alias("entry"), letters.alias("letters"), "cost", (F.col("illegal") + F.coalesce("joint", F.lit(0))).alias("illegal")), "turn-edits")
    discard(traced)
    acts = pieces.join(chosen.select("conv", "piece", "letters", "entry"), ["conv", "piece"])
    acts = acts.mapInPandas(_acts, "conv string, at long, kind int, lead array<string>, new_role string")
    none = F.lit(None).cast("string")
    stream = acts.select("*", none.alias("role"), none.alias("text")).union(
        ordered.select("conv", "at", F.lit(1).alias("kind"), F.array().cast("array<string>").alias("lead"), none.alias("new_role"), "role", "text")
    )
    stream = stream.repartition("conv").sortWithinPartitions("conv", "at", "kind")
    return marked, chosen, stream.mapInPandas(_with_acts, "conv string, role string, text string")


def repaired_turns(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of the repaired conversations; turn counts from 0. Conversations that lose all turns have no rows.

    Of turns (conv_id, turn, role, text) only these columns are read, in the order that ordered_turns() states. Null roles and
    texts count as one space, so they are deleted or get a role; a null conv_id is one conversation.
    """
    _, _, repaired = _repair(turns)
    schema = "conv string, turn long, role string, text string"

    def numbered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, at = None, 0
        for batch in batches:
            out: list[tuple] = []
            for conv, role, text in zip(batch["conv"], batch["role"], batch["text"], strict=True):
                now, at = (conv, at) if conv == now else (conv, 0)
                if role is not None:
                    out.append((conv, at, role, text))
                    at += 1
            yield pd.DataFrame(out, columns=["conv", "turn", "role", "text"])

    kind = turns.schema["conv_id"].dataType
    conv_id = F.when(F.col("conv") != "", F.substr("conv", F.lit(2))).cast(kind)
    return repaired.mapInPandas(numbered, schema).select(conv_id.alias("conv_id"), "turn", "role", "text")


def repair_report(turns: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of each conversation.

    conversations (conv_id) names those to report, by default those in turns; one without turns has zeros, an empty audit and the hash of no text. gaps
    are the whole numbers missing between the least and the greatest turn, nulls ignored. blank, duplicate and truncated count turns by their
    first fault, illegal the neighbours whose role initials are none of su, ua, au. cost is that of the cheapest edits, audit their initials,
    the least such text. A turn with an empty role has no initial and is never kept as it is. Repeated rows are turns that repeat; other columns
    are ignored; an empty table gives an empty result. Texts of any length are read whole; a conversation of any length is cut into pieces.
    """
    marked, chosen, repaired = _repair(turns)
    count = lambda k: F.count_if(F.shiftright("code", 2) == k).alias(FAULTS[k])
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0))
    counts = marked.groupBy("conv").agg(gaps.alias("gaps"), *map(count, (1, 2, 3)))
    edits = chosen.groupBy("conv").agg(
        F.sum("illegal").alias("illegal"),
        F.max("cost").alias("cost"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", "letters"))), lambda p: p["letters"]), "").alias("audit"),
    )
    hashes = repaired.mapInPandas(_hashed, "conv string, repaired_sha256 string")
    asked = (turns if conversations is None else conversations).select("conv_id").distinct().withColumn("conv", conversation_key())
    whole = asked.join(counts, "conv", "left").join(edits, "conv", "left").join(hashes, "conv", "left")
    longs = [F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return whole.select("conv_id", *longs, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", nothing).alias("repaired_sha256"))


def damaged(turns: DataFrame) -> DataFrame:
    """turns with the faults of the query, chosen by crc32(conv_id:turn) % 20: dropped, emptied, unpunctuated, repeated, or role user. Nulls are one space."""
    as_text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    draw = F.crc32(F.encode(F.concat(as_text("conv_id"), F.lit(":"), as_text("turn")), "UTF-8")) % 20
    text = F.when(draw == 1, F.lit("")).when(draw == 2, F.regexp_replace(as_text("text"), "[.!?]", "")).otherwise(as_text("text"))
    role = F.when(draw == 4, F.lit("user")).otherwise(as_text("role"))
    rows = turns.where(draw != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.sequence(F.lit(1), F.when(draw == 3, 2).otherwise(1))).alias("_copy"))
    return rows.drop("_copy")


def op12_tight_arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """repair_report() of all conversations after damaged(). Nulls, ties, repeated rows and empty tables as there."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return repair_report(damaged(turns), turns)
