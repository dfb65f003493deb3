"""Conversation structure repair by a time-major tensor of state costs.

The states of a repaired conversation are nothing yet, after a system turn, after a user
turn, after an assistant turn. Conversations are bucketed by length; for a bucket the
cost of finishing from every state is one array [turn, state, conversation], filled from
the last turn back by one vector step a turn, and edits are traced forward by one vector
step an edit. Costs are a (min, +) product over turns: conversations over LONG turns are
cut into pieces wherever sorted ranges put them, each piece is summed up as a 4 x 4 matrix
in its own task, and only the digest of the repaired text, which is serial by nature,
reads such a conversation in one stream, a piece at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import whole
from .common import kept

SPACES = " \t\n\x0b\x0c\r"
#: Turns above which a conversation is repaired in pieces, and turns of a piece.
LONG = 4096
#: Role initials; ABSENT pads a bucket.
USER, ASSISTANT, SYSTEM, OTHER, ABSENT = range(5)
START, AFTER_S, AFTER_U, AFTER_A = range(4)
#: By state: the role that may come next besides a first system turn, and its state.
WANT = np.array([USER, USER, ASSISTANT, USER])
NEXT = np.array([AFTER_U, AFTER_U, AFTER_A, AFTER_U])
DELETE_COST, INSERT_COST, REROLE_COST, CUT_COST = 2, 5, 1, 5
FAR = 1 << 40
DONE = np.array([0, 10, 5, 0])  # with the inserts that a last open turn needs
ROLE = {USER: "user", ASSISTANT: "assistant"}
SCHEMA = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
D, I, K, R = b"DIKR"


def damaged(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, dropped, kind, blank, cut): rows damaged by the hash of
    their id and turn. Null roles, texts, ids and turns are one space where text is made of
    them. Dropped rows stay, marked and empty, so that no conversation is lost."""
    said = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"))
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    hit = said.withColumn("h", F.crc32(key) % 20)
    text = F.when(F.col("h") <= 1, "").when(F.col("h") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = hit.select("conv_id", "turn", F.when(F.col("h") == 0, "").when(F.col("h") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("h") == 0).alias("dropped"), F.explode(F.when(F.col("h") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")
    bare = F.rtrim("text", F.lit(SPACES))
    first = F.left("role", F.lit(1))
    kind = F.when(first == "u", USER).when(first == "a", ASSISTANT).when(first == "s", SYSTEM).otherwise(OTHER)
    return rows.select("*", kind.cast("byte").alias("kind"), (F.length(bare) == 0).alias("blank"), (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("cut"))


def step(after: np.ndarray, kind: np.ndarray, must: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Costs [state, conversation] before a turn from those after it."""
    pay = CUT_COST * cut
    edit = after[NEXT] + pay + REROLE_COST * (kind[None] != WANT[:, None])
    edit[START] = np.where(kind == SYSTEM, np.minimum(edit[START], after[AFTER_S] + pay), edit[START])
    best = np.minimum(after + DELETE_COST, np.where(must, FAR, edit))
    for _ in range(2):  # a user and an assistant turn at most are worth inserting
        best = np.minimum(best, best[NEXT] + INSERT_COST)
    return np.where(kind == ABSENT, after, best)


def costs(kind: np.ndarray, must: np.ndarray, cut: np.ndarray, end: np.ndarray) -> np.ndarray:
    """[turn, state, conversation] from [turn, conversation] inputs and end [state, conversation]."""
    back = np.empty((len(kind) + 1, *end.shape), np.int64)
    back[-1] = end
    for t in range(len(kind) - 1, -1, -1):
        back[t] = step(back[t + 1], kind[t], must[t], cut[t])
    return back


def trace(back: np.ndarray, kind: np.ndarray, must: np.ndarray, cut: np.ndarray, state: np.ndarray, last: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The cheapest edits, ASCII-least: (letters, turns, roles, final states), the first
    three [edit, conversation] with letter 0 where a conversation has no more. ``last``
    adds the inserts after the last turn."""
    turns, n = kind.shape
    lane, pos, state = np.arange(n), np.zeros(n, np.int64), state.copy()
    letters, at, roles = [], [], []
    while True:
        inside = pos < turns
        if not inside.any() and not (last and np.isin(state, (AFTER_S, AFTER_U)).any()):
            break
        p = np.minimum(pos, max(turns - 1, 0))
        to = NEXT[state]
        if turns:
            now, k, m, c = back[pos, state, lane], kind[p, lane], must[p, lane], cut[p, lane]
            then = np.minimum(pos + 1, turns)
            follow, stay = back[then, to, lane], back[then, state, lane]
            first = (state == START) & (k == SYSTEM) & (now == back[then, AFTER_S, lane] + CUT_COST * c)
            keep = ~m & (((k == WANT[state]) & (now == follow + CUT_COST * c)) | first)
            letter = np.where(now == stay + DELETE_COST, D, np.where(now == back[pos, to, lane] + INSERT_COST, I, np.where(keep, K, R)))
            letter = np.where(k == ABSENT, 0, letter)
        else:
            letter, first = np.zeros(n, np.int64), np.zeros(n, bool)
        ends = ~inside & last & np.isin(state, (AFTER_S, AFTER_U))
        letter = np.where(inside, letter, np.where(ends, I, 0))
        moves = np.isin(letter, (I, K, R))
        letters.append(letter)
        at.append(p)
        roles.append(np.where(to == AFTER_U, USER, ASSISTANT))
        state = np.where(moves, np.where((letter == K) & first & inside, AFTER_S, to), state)
        pos = pos + (inside & (letter != I))
    shape = (0, n)
    return (np.array(letters, np.uint8) if letters else np.zeros(shape, np.uint8), np.array(at) if at else np.zeros(shape, np.int64), np.array(roles) if roles else np.zeros(shape, np.int64), state)


def _buckets(sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Groups of similar length: those with the same highest bit."""
    bits = np.ceil(np.log2(np.maximum(sizes, 1))).astype(int)
    bits[sizes == 0] = -1
    for b in np.unique(bits):
        yield np.flatnonzero(bits == b)


def _tensor(group: np.ndarray, starts: np.ndarray, sizes: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Row numbers [turn, conversation] of a bucket (-1: none) and the columns there."""
    t = np.arange(int(sizes[group].max(initial=0)))[:, None]
    rows = np.where(t < sizes[group], starts[group] + t, -1)
    return rows, [np.where(rows >= 0, c[rows], fill) if len(c) else np.full(rows.shape, fill) for c, fill in zip(columns, (ABSENT, False, False), strict=True)]


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    for t, conv in whole(batches, ["conv_id"]):
        ids = t["conv_id"].to_pylist()
        firsts = np.flatnonzero(np.r_[True, conv[1:] != conv[:-1]])
        n = len(firsts)
        rows = t.append_column("conv", pa.array(conv)).filter(pa.compute.invert(t["dropped"]))
        frame = rows.select(["conv", "turn", "role", "text", "kind", "blank", "cut"]).to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get)
        conv = frame.conv.to_numpy(np.int64)
        kind, blank = frame.kind.to_numpy(np.int64), frame.blank.to_numpy(bool)
        duplicate = frame.duplicated(["conv", "role", "text"]).to_numpy() & ~blank
        cut = frame.cut.to_numpy(bool) & ~blank & ~duplicate
        must = blank | duplicate
        out = pd.DataFrame({"conv_id": pd.array([ids[f] for f in firsts], "Int64")})
        known = frame[frame.turn.notna()].groupby("conv").turn
        gaps = (known.max() - known.min() + 1 - known.nunique()).reindex(range(n), fill_value=0)
        out["gaps"] = gaps.to_numpy(np.int64)
        for name, flag in (("blank", blank), ("duplicate", duplicate), ("truncated", cut)):
            out[name] = np.bincount(conv[flag], minlength=n)
        out["illegal"] = np.bincount(conv[1:][(conv[1:] == conv[:-1]) & _illegal(kind[:-1], kind[1:])], minlength=n)
        sizes = np.bincount(conv, minlength=n)
        starts = np.cumsum(sizes) - sizes
        cost, audits, digests = np.zeros(n, np.int64), [""] * n, [""] * n
        role, text = frame.role.to_numpy(), frame.text.to_numpy()
        for group in _buckets(sizes):
            at, (k, m, c) = _tensor(group, starts, sizes, kind, must, cut)
            back = costs(k, m, c, np.repeat(DONE[:, None], len(group), axis=1))
            cost[group] = back[0, START]
            letters, turns, roles, _ = trace(back, k, m, c, np.zeros(len(group), np.int64), True)
            for j, g in enumerate(group.tolist()):
                used = letters[:, j] > 0
                mine = letters[used, j]
                audits[g] = mine.tobytes().decode("ascii")
                digests[g] = _digest(mine.tolist(), at[turns[used, j], j].tolist() if len(at) else [0] * len(mine), roles[used, j].tolist(), role, text)
        out["cost"], out["audit"], out["repaired_sha256"] = cost, audits, digests
        yield pa.RecordBatch.from_pandas(out[names], preserve_index=False)


def _illegal(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ~(((b == USER) & ((a == SYSTEM) | (a == ASSISTANT))) | ((a == USER) & (b == ASSISTANT)))


def _digest(letters: list[int], rows: list[int], roles: list[int], role: np.ndarray, text: np.ndarray) -> str:
    found, between = hashlib.sha256(), b""
    for letter, row, new in zip(letters, rows, roles, strict=True):
        if letter != D:
            who, what = ROLE[new] if letter != K else role[row], "" if letter == I else text[row]
            found.update(between + who.encode() + b":" + what.encode())
            between = b"\n"
    return found.hexdigest()


def _piece_matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cost from each state before a piece to each after it."""
    for t, piece in whole(batches, ["conv_id", "p", "k"]):
        frame = t.to_pandas()
        sizes = np.bincount(piece)
        starts = np.cumsum(sizes) - sizes
        found = np.empty((len(sizes), 16), np.int64)
        for group in _buckets(sizes):
            _, (k, m, c) = _tensor(group, starts, sizes, frame.kind.to_numpy(np.int64), frame.must.to_numpy(bool), frame.cut.to_numpy(bool))
            for last in range(4):
                end = np.full((4, len(group)), FAR, np.int64)
                end[last] = 0
                for _ in range(2):
                    end = np.minimum(end, end[NEXT] + INSERT_COST)
                found[group, last::4] = costs(k, m, c, end)[0].T
        yield pa.RecordBatch.from_arrays([t[c].combine_chunks().take(starts) for c in ("conv_id", "p", "k")] + [pa.array(found.tolist(), pa.list_(pa.int64()))], names=["conv_id", "p", "k", "costs"])


def _ends(pieces: pd.DataFrame) -> pd.DataFrame:
    """Costs of finishing after each piece of a conversation: 16 numbers a piece of LONG turns."""
    pieces = pieces.sort_values(["p", "k"])
    ends, end = [], DONE.astype(np.int64)
    for m in reversed([np.array(c).reshape(4, 4) for c in pieces.costs]):
        ends.append(end.tolist())
        end = np.minimum((m + end).min(axis=1), FAR)
    return pieces[["conv_id", "p", "k"]].assign(end=ends[::-1], last=[False] * (len(pieces) - 1) + [True], cost=int(end[START]))


def _piece_edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edits of a piece for each state that it may be entered in."""
    for t, piece in whole(batches, ["conv_id", "p", "k"]):
        frame = t.to_pandas()
        sizes = np.bincount(piece)
        starts = np.cumsum(sizes) - sizes
        audits: list = [None] * len(sizes)
        end, last = np.array(frame.end.iloc[starts].tolist()).T, frame["last"].to_numpy(bool)[starts]
        for closing in (False, True):
            for group in _buckets(sizes):
                group = group[last[group] == closing]
                if not len(group):
                    continue
                _, (k, m, c) = _tensor(group, starts, sizes, frame.kind.to_numpy(np.int64), frame.must.to_numpy(bool), frame.cut.to_numpy(bool))
                back = costs(k, m, c, end[:, group])
                for entered in range(4):
                    letters = trace(back, k, m, c, np.full(len(group), entered), closing)[0]
                    for j, g in enumerate(group.tolist()):
                        audits[g] = (audits[g] or []) + [letters[letters[:, j] > 0, j].tobytes().decode("ascii")]
        yield pa.RecordBatch.from_arrays([t[c].combine_chunks().take(starts) for c in ("conv_id", "p", "k", "cost")] + [pa.array(audits, pa.list_(pa.string()))], names=["conv_id", "p", "k", "cost", "audits"])


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of long conversations in order, each piece after its row of edits: replays the
    edits that belong to the state reached and digests the repaired text."""
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    now, out = None, None

    def closed() -> pa.RecordBatch:
        out["audit"], out["repaired_sha256"] = "".join(out.pop("parts")), out.pop("hash").hexdigest()
        out["gaps"] = out.pop("high") - out.pop("low") + 1 - out["gaps"] if out["gaps"] else 0
        return pa.RecordBatch.from_pylist([{c: out[c] for c in names}], schema=pa.schema([(c, pa.string() if c in ("audit", "repaired_sha256") else pa.int64()) for c in names]))

    def apply(letter: str, role: str, text: str, kind: int) -> None:
        nonlocal state, between
        if letter == "D":
            return
        system = letter == "K" and kind == SYSTEM
        state = AFTER_S if system else int(NEXT[state])
        who = role if letter == "K" else ROLE[USER if state == AFTER_U else ASSISTANT]
        out["hash"].update(between + who.encode() + b":" + text.encode())
        between = b"\n"

    pending: Iterator[str] = iter(())
    state, between, before = START, b"", None
    for b in batches:
        for r in b.to_pylist():
            if out is None or r["conv_id"] != now:
                if out is not None:
                    for letter in pending:
                        apply(letter, "", "", OTHER)
                    yield closed()
                now, state, between, before, pending = r["conv_id"], START, b"", None, iter(())
                out = dict.fromkeys(names, 0) | {"conv_id": now, "parts": [], "hash": hashlib.sha256(), "low": None, "high": None}
            if r["audits"] is not None:
                edits = r["audits"][state]
                out["parts"].append(edits)
                out["cost"], pending = r["cost"], iter(edits)
                continue
            for letter in pending:  # up to the edit of this turn
                if letter != "I":
                    apply(letter, r["role"], r["text"], r["kind"])
                    break
                apply("I", "", "", OTHER)
            for name in ("blank", "duplicate"):
                out[name] += r[name]
            out["truncated"] += r["cut"]
            if before is not None:
                out["illegal"] += bool(_illegal(np.array(before), np.array(r["kind"])))
            before = r["kind"]
            if r["turn"] is not None and r["turn"] != out["high"]:
                out["gaps"] += 1  # distinct turns until closed
                out["low"], out["high"] = r["turn"] if out["low"] is None else out["low"], r["turn"]
    if out is not None:
        for letter in pending:
            apply(letter, "", "", OTHER)
        yield closed()


def _repair_long(rows: DataFrame, long: int) -> DataFrame:
    """Pieces of at most ``long`` turns, wherever sorted ranges put them."""
    order = ["conv_id", "turn", "role", "text"]
    spread = rows.where("NOT dropped").repartitionByRange(*order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id()
    sayings = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")))
    placed = kept(spread.select("*", F.spark_partition_id().alias("p"), place.alias("m"), sayings.alias("said")), "turns")
    first = placed.groupBy("conv_id", "said").agg(F.min("m").alias("first")).withColumnRenamed("conv_id", "conv").withColumnRenamed("said", "saying")
    flagged = placed.join(first, F.col("conv_id").eqNullSafe(F.col("conv")) & (F.col("said") == F.col("saying"))).drop("conv", "saying", "said")
    flagged = flagged.withColumn("duplicate", ~F.col("blank") & (F.col("m") > F.col("first"))).withColumn("must", F.col("blank") | F.col("duplicate")).withColumn("cut", F.col("cut") & ~F.col("must"))
    flagged = kept(flagged.withColumn("k", F.floor((F.col("m") - F.shiftleft(F.col("p").cast("long"), 33)) / long)).drop("first", "dropped"), "turns-flagged")
    piece = ["conv_id", "p", "k"]
    bare = flagged.select(*piece, "m", "kind", "must", "cut").repartition(*piece).sortWithinPartitions(*piece, "m")
    matrices = bare.drop("m").mapInArrow(_piece_matrices, "conv_id long, p int, k long, costs array<long>")
    ends = kept(matrices.groupBy("conv_id").applyInPandas(_ends, "conv_id long, p int, k long, end array<long>, last boolean, cost long"), "piece-ends")
    same = [F.col(c).eqNullSafe(F.col(f"e_{c}")) for c in piece]
    renamed = ends.select(*[F.col(c).alias(f"e_{c}") for c in piece], "end", "last", "cost")
    with_ends = flagged.select(*piece, "m", "kind", "must", "cut").join(renamed, same).drop(*[f"e_{c}" for c in piece])
    edits = with_ends.repartition(*piece).sortWithinPartitions(*piece, "m").mapInArrow(_piece_edits, "conv_id long, p int, k long, cost long, audits array<string>")
    columns = ["conv_id", "p", "k", "m", "turn", "role", "text", "kind", "blank", "duplicate", "cut", "cost", "audits"]
    heads = edits.withColumn("m", F.lit(-1).cast("long"))
    stream = flagged.select(*columns[:-2]).unionByName(heads, allowMissingColumns=True).select(*columns)
    return stream.repartition("conv_id").sortWithinPartitions("conv_id", "p", "k", "m").mapInArrow(_stream, SCHEMA)


def repair(turns: DataFrame, long: int = LONG) -> DataFrame:
    """One row a conv_id of ``turns`` (conv_id, turn, role, text; other columns are not
    read): its faults, the least cost of edits that make its roles (s?(ua)+)?, the edits and
    the digest of the repaired text, as the contract of the query says.

    Rows of equal turn are taken by role, then text. Null ids are one conversation. Repeated
    rows are duplicates of the first. A conversation whose rows are all dropped has zeros,
    an empty audit and the digest of the empty string; an empty table gives no rows.
    """
    rows = damaged(turns)
    order = ["conv_id", "turn", "role", "text"]
    many = kept(turns.groupBy(F.col("conv_id").cast("long").alias("big")).count().where(F.col("count") > long // 2).select("big"), "long-conversations")
    if many.isEmpty():
        return rows.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(_repaired, SCHEMA)
    same = F.col("conv_id").eqNullSafe(F.col("big"))
    short = rows.join(many, same, "left_anti").repartition("conv_id").sortWithinPartitions(*order).mapInArrow(_repaired, SCHEMA)
    far = rows.join(many, same, "left_semi")
    out = _repair_long(far, long)
    none = many.join(out.select(F.col("conv_id").alias("found")), F.col("big").eqNullSafe(F.col("found")), "left_anti")
    empty = none.select(F.col("big").alias("conv_id"), *[F.lit(0).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], F.lit("").alias("audit"), F.lit(hashlib.sha256().hexdigest()).alias("repaired_sha256"))
    return short.unionByName(out).unionByName(empty)
