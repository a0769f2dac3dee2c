"""Repair of conversation structure: cheapest edits by dynamic programming, the least of several by prefix doubling.

A conversation's rows go by turn (null first), then role, then SHA-256 of the text. A row is blank (no character but white space), duplicate
(role and text seen earlier) or truncated (the last such character is none of . ! ?), whichever comes first. Edits give the roles a system
row at most, then user and assistant in turns: Keep costs 0, Rerole to user or assistant 1, Delete 2, Insert an empty row 5; blank and
duplicate rows must go, and a truncated row that stays costs 5 more. Of the cheapest edit lists the one whose initials (the audit) come
first in ASCII is taken.

Costs are those of paths through layers of four states, a layer for each row: nothing yet, after system, after user, after assistant. Arcs
on a cheapest path are then ranked by their audits' first 1, 2, 4, ... letters, each rank from two of the last round, with pointers that
double alike; the ranks choose the arc that a path starts with, the pointers give all its nodes. A state and a letter lead to one next
state, so audit and repaired rows belong to each other.

A conversation of any length is worked on in blocks of up to BLOCK rows, which carry no text: rows are range-sorted, each block gives a 4 x 4
matrix of costs, products of these (in a tree with FAN_IN matrices a node) give each block the costs behind it, and in the same way maps from
state to state give the state in which the path comes to it. Only the last step, the digest of a conversation, reads its rows as one sorted
stream, as SHA-256 has to; it holds the audit, which is its result, and one row.

Defined results: nulls in role and text are a space, and a row of an empty role can't be kept; a null turn has no part in gaps; rows with a null conv_id are one conversation. Rows
equal in turn, role and text stand together: the first counts, the others are duplicates (or blank as well). A conversation without rows
gets zeros, an empty audit and the digest of nothing. Other columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stratalens.llm.common import fitting
from stratalens.staging import stage

#: Rows of a block, matrices of a node of the tree, and rows that are worked on at once.
BLOCK, FAN_IN, AT_ONCE = 10_000, 1_000, 100_000
WHITE = r"\x20\x09-\x0D"
KEEP, REROLE, DELETE, INSERT, CUT = 0, 1, 2, 5, 5
#: States: nothing yet, after system, user, assistant. Where an inserted or reroled row leads, and a kept one by its role's initial.
AFTER_TURN = np.array([2, 2, 3, 2])
AFTER_KEPT = np.array([[1, 2, -1], [-1, 2, -1], [-1, -1, 3], [-1, 2, -1]])
INITIALS = "sua"
#: What each state costs behind the last row, and the edits for it.
CLOSING, CLOSED_BY = (0, 2 * INSERT, INSERT, 0), ("", "II", "I", "")
LETTERS = "DIKR"
FAR = 1 << 60

#: A row's code: place of its role's initial (3: another), 4 more if it must go, 8 more if it is truncated.
MUST_GO, TRUNCATED = 4, 8


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role and text with a fifth of the rows damaged, by a checksum of conv_id and turn."""
    def filled(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(filled("text"), "[.!?]", "")).otherwise(filled("text"))
    role = F.when(kind == 4, "user").otherwise(filled("role"))
    rows = turns.select("conv_id", "turn", kind.alias("kind"), role.alias("role"), text.alias("text")).filter("kind <> 0")
    return rows.select("conv_id", "turn", "role", "text", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


def keyed(turns: DataFrame) -> DataFrame:
    """conv (conv_id as text that is never null), turn, role, text and its digest."""
    conv = F.concat(F.lit("="), F.col("conv_id").cast("string"))
    rows = turns.select(F.coalesce(conv, F.lit("")).alias("conv"), F.col("turn").cast("long").alias("turn"), *[F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")])
    return rows.withColumn("digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))


KEY = ("turn", "role", "digest")


def coded(rows: DataFrame) -> DataFrame:
    """Distinct rows without their text: conv, turn, role, digest and code."""
    blank, cut = ~F.col("text").rlike(f"[^{WHITE}]"), ~F.col("text").rlike(rf"[.!?][{WHITE}]*\z")
    # Spark's hash aggregation takes the flags as keys; they follow from the digest
    keys = rows.select("conv", *KEY, blank.alias("blank"), cut.alias("cut")).distinct()
    first = keys.filter("NOT blank").groupBy("conv", "role", "digest").agg(F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn")).alias("least"))
    first = first.select(F.col("conv").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), F.col("least.turn").alias("t"), F.lit(True).alias("first"))
    # one row on either side for a key, however often a text is repeated
    both = keys.join(first, (F.col("conv") == F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d")) & F.col("turn").eqNullSafe(F.col("t")), "left")
    start = F.substring("role", 1, 1)
    code = F.when(start == "s", 0).when(start == "u", 1).when(start == "a", 2).otherwise(3)
    code = code + F.when(F.col("first").isNull(), MUST_GO).otherwise(0) + F.when(F.col("cut"), TRUNCATED).otherwise(0)
    return both.select("conv", *KEY, code.cast("byte").alias("code"))


def blocks(codes: DataFrame, size: int) -> DataFrame:
    """A row for each run of up to `size` rows of a conversation: conv, block (ascending in a conversation), key of the first row, codes."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns, first, held, number = ["conv", "number", *KEY, "codes"], (None,), [], 0
        for batch in batches:
            out = []
            for conv, turn, role, digest, code in batch[["conv", *KEY, "code"]].itertuples(index=False):
                if conv != first[0] or len(held) == size:
                    if held:
                        out.append((first[0], number, *first[1:], bytes(held)))
                        number += 1
                    first, held = (conv, turn, role, digest), []
                held.append(code)
            yield pd.DataFrame(out, columns=columns)
        if held:
            yield pd.DataFrame([(first[0], number, *first[1:], bytes(held))], columns=columns)

    ordered = codes.repartitionByRange("conv", *KEY).sortWithinPartitions("conv", *KEY)
    schema = "conv string, number long, turn string, role string, digest binary, codes binary"
    # turns go as text: a column of numbers with nulls would become one of floats
    found = ordered.withColumn("turn", F.col("turn").cast("string")).mapInPandas(run, schema)
    block = F.spark_partition_id().cast("long") * (1 << 40) + F.col("number")
    return found.select("conv", block.alias("block"), F.col("turn").cast("long").alias("turn"), "role", "digest", "codes")


class Layers:
    """The layers of several blocks after one another; a block of n rows has n + 1, the last of which lies behind its rows."""

    def __init__(self, codes: list[bytes]):
        self.sizes = np.array([len(c) for c in codes], np.int64)
        code = np.frombuffer(b"".join(codes), np.uint8).astype(np.int64)
        self.last = np.cumsum(self.sizes + 1) - 1
        self.first = self.last - self.sizes
        self.rows = np.delete(np.arange(len(code) + len(codes)), self.last) if len(code) else np.zeros(0, np.int64)
        total = len(code) + len(codes)
        role, stays = np.full(total, 3), np.full(total, FAR)
        role[self.rows] = code & 3
        stays[self.rows] = np.where(code & MUST_GO, FAR, np.where(code & TRUNCATED, CUT, 0))
        self.kept = np.where(role[:, None] < 3, AFTER_KEPT[:, np.minimum(role, 2)].T, -1)  # layer, state -> state
        self.stays = stays

    def arcs(self, at: np.ndarray, behind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Costs by deleting, keeping and reroling the rows of these layers (layer, state, goal), given the costs of the layers behind them."""
        stays, kept = self.stays[at][:, None, None], self.kept[at]
        keep = np.take_along_axis(behind, np.maximum(kept, 0)[:, :, None], 1) + stays + KEEP
        return behind + DELETE, np.where(kept[:, :, None] < 0, FAR, keep), behind[:, AFTER_TURN] + stays + REROLE

    def costs(self, right: np.ndarray) -> np.ndarray:
        """The least cost from each layer and state to each goal, given those behind each block (block, state, goal)."""
        out = np.full((len(self.stays), 4, right.shape[2]), FAR)
        out[self.last] = right
        by_size = np.argsort(-self.sizes, kind="stable")
        for step in range(1, int(self.sizes.max(initial=0)) + 1):
            at = self.last[by_size[: np.searchsorted(-self.sizes[by_size], -step, "right")]] - step
            least = np.minimum.reduce(self.arcs(at, out[at + 1]))
            user, assistant = least[:, 2].copy(), least[:, 3].copy()
            least[:, 2], least[:, 3] = np.minimum(user, assistant + INSERT), np.minimum(assistant, user + INSERT)
            least[:, :2] = np.minimum(least[:, :2], least[:, 2:3] + INSERT)
            out[at] = np.minimum(least, FAR)
        return out

    def paths(self, right: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """The letter of the least path's first arc from each node (layer * 4 + state; -1 behind a block) and pointers 1, 2, 4, ... arcs on."""
        cost = self.costs(right[:, :, None])
        deleted, kept, reroled = (np.full((len(self.stays), 4), FAR) for _ in range(3))
        for whole, part in zip((deleted, kept, reroled), self.arcs(self.rows, cost[self.rows + 1]), strict=True):
            whole[self.rows] = part[:, :, 0]
        inserted = cost[:, AFTER_TURN, 0] + INSERT
        inserted[self.last] = FAR
        layer, state = np.arange(len(self.stays))[:, None], np.arange(4)[None]
        heads = np.stack([(layer + 1) * 4 + state, layer * 4 + AFTER_TURN[state], (layer + 1) * 4 + self.kept, (layer + 1) * 4 + AFTER_TURN[state]], 2).reshape(-1, 4)
        # arcs of cheapest paths, numbered node * 4 + letter; behind a block there are none
        best = (np.stack([deleted, inserted, kept, reroled], 2) == cost[:, :, 0][:, :, None]).reshape(-1, 4)
        best &= (cost[:, :, 0] < FAR).reshape(-1, 1)
        nodes = len(best)
        end = nodes * 4  # the arc that follows all others, of rank 0
        rank = np.zeros(nodes * 4 + 1, np.int64)
        rank[:-1] = np.where(best, np.arange(1, 5), FAR).reshape(-1)

        def chosen() -> np.ndarray:
            """The arc of least rank out of each node."""
            arc = rank[:-1].reshape(-1, 4).argmin(1) + np.arange(nodes) * 4
            return np.where(best.any(1), arc, end)

        after = np.append(np.where(best, chosen()[np.where(best, heads, 0)], end).reshape(-1), end)
        hops = [after]
        # the pointers reach the end once they are as long as the longest path
        while (hops[-1] != end).any():
            pair = rank * (int(rank[rank < FAR].max()) + 1) + np.minimum(rank[hops[-1]], FAR)
            pair[rank >= FAR] = FAR
            rank = np.unique(pair, return_inverse=True)[1].reshape(-1).astype(np.int64)
            rank[pair >= FAR] = FAR
            hops.append(hops[-1][hops[-1]])
        first = chosen()
        letter = np.where(first == end, -1, first % 4)
        node = np.where(best, heads, 0).reshape(-1)
        onwards = np.where(first == end, np.arange(nodes), node[np.minimum(first, end - 1)])
        jumps = [onwards]
        for _ in hops[1:]:
            jumps.append(jumps[-1][jumps[-1]])
        return letter, jumps


def alike(codes: list[bytes]) -> Iterator[np.ndarray]:
    """Blocks of about the same size together, not too many rows at once."""
    sizes = np.array([len(c) for c in codes])
    width = np.frexp(sizes)[1]
    for w in np.unique(width):
        of = np.flatnonzero(width == w)
        per = max(1, AT_ONCE >> int(w))
        for start in range(0, len(of), per):
            yield of[start:start + per]


def matrices(codes: list[bytes]) -> list[list[int]]:
    """The 16 costs from each state before a block to each state behind it."""
    out: list[list[int]] = [[]] * len(codes)
    for of in alike(codes):
        layers = Layers([codes[i] for i in of])
        right = np.broadcast_to(np.where(np.eye(4, dtype=bool), 0, FAR), (len(of), 4, 4))
        for i, m in zip(of, layers.costs(right)[layers.first], strict=True):
            out[i] = m.reshape(-1).tolist()
    return out


def walked(codes: list[bytes], right: list[list[int]]) -> tuple[list[list[int]], list[list[str]]]:
    """For each block the states behind it, and the letters of its rows (joined by commas), by the state before it."""
    ends: list[list[int]] = [[]] * len(codes)
    written: list[list[str]] = [[]] * len(codes)
    for of in alike(codes):
        layers = Layers([codes[i] for i in of])
        letter, jumps = layers.paths(np.array([right[i] for i in of], np.int64))
        path = (layers.first[:, None] * 4 + np.arange(4)[None]).reshape(-1, 1)
        last = jumps[-1][path[:, 0]]
        for jump in jumps[:-1]:
            path = np.concatenate([path, jump[path]], 1)
        text = letter[path]
        for n, i in enumerate(of):
            ends[i] = (last[n * 4:n * 4 + 4] % 4).tolist()
            rows = []
            for j in range(n * 4, n * 4 + 4):
                out = "".join(LETTERS[x] for x in text[j] if x >= 0)
                rows.append(",".join(x for x in out.replace("D", "D,").replace("K", "K,").replace("R", "R,").split(",") if x))
            written[i] = rows
    return ends, written


def joined_matrix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The costs of a block followed by another."""
    return np.minimum((a.reshape(4, 4)[:, :, None] + b.reshape(4, 4)[None]).min(1), FAR).reshape(-1)


def costs_before(a: np.ndarray, behind: np.ndarray) -> np.ndarray:
    return np.minimum((a.reshape(4, 4) + behind[None]).min(1), FAR)


def carried(rows: DataFrame, start: list[int], act: Callable, join: Callable, backwards: bool, fan_in: int) -> DataFrame:
    """conv, number and carry: what start has become by the values of the rows behind each row (before it, if not backwards)."""
    top = rows.agg(F.coalesce(F.max("number"), F.lit(0))).first()[0]
    schema = "conv string, number long, carry array<long>"

    def walk(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("number", ascending=not backwards)
        x, out = np.array(g["carry"].iloc[0] if "carry" in g else start, np.int64), []
        for value in g["value"]:
            out.append(x.tolist())
            x = act(np.array(value, np.int64), x)
        return pd.DataFrame({"conv": g["conv"], "number": g["number"], "carry": out})

    if top < fan_in:
        return rows.groupBy("conv").applyInPandas(walk, schema)
    parent = F.floor(F.col("number") / fan_in).alias("parent")

    def whole(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        values = [np.array(v, np.int64) for v in g.sort_values("number")["value"]]
        x = values[0]
        for value in values[1:]:
            x = join(x, value)
        return pd.DataFrame({"conv": [key[0]], "number": [key[1]], "value": [x.tolist()]})

    above = stage(rows.groupBy("conv", parent).applyInPandas(whole, "conv string, number long, value array<long>"), "nodes")
    carry = carried(above, start, act, join, backwards, fan_in).withColumnRenamed("number", "parent")
    return rows.withColumn("parent", parent).join(carry, ["conv", "parent"]).groupBy("conv", "parent").applyInPandas(walk, schema)


def edits(cut: DataFrame, fan_in: int) -> DataFrame:
    """The key of each block's first row, the block's codes, and the letters of its rows."""
    many = cut.groupBy("conv").count().filter("count > 1").select("conv")
    # few conversations: those longer than a block, and those at the border of two partitions
    order = Window.partitionBy("conv").orderBy("block")
    parts = stage(cut.join(fitting(stage(many, "long")), "conv", "left_semi").withColumn("number", F.row_number().over(order).cast("long") - 1).select("conv", "block", "number", "codes"), "parts")

    @F.pandas_udf("array<long>")
    def matrix(codes: pd.Series) -> pd.Series:
        return pd.Series(matrices(list(codes)), dtype=object)

    @F.pandas_udf("array<long>")
    def ends(codes: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series(walked(list(codes), list(right))[0], dtype=object)

    @F.pandas_udf("string")
    def letters(codes: pd.Series, right: pd.Series, state: pd.Series) -> pd.Series:
        return pd.Series([rows[s] for rows, s in zip(walked(list(codes), list(right))[1], state, strict=True)], dtype=object)

    closing = F.array(*[F.lit(x).cast("long") for x in CLOSING])
    if parts.isEmpty():
        return cut.select("conv", *KEY, "codes", letters("codes", closing, F.lit(0).cast("long")).alias("letters"))
    right = carried(stage(parts.select("conv", "number", matrix("codes").alias("value")), "matrices"), list(CLOSING), costs_before, joined_matrix, True, fan_in)
    parts = stage(parts.join(right.withColumnRenamed("carry", "right"), ["conv", "number"]), "behind")
    # the value of a block is the state behind it for each state before it; the carry is one state
    left = carried(stage(parts.select("conv", "number", ends("codes", "right").alias("value")), "ends"), [0], lambda a, x: a[x], lambda a, b: b[a], False, fan_in)
    placed = stage(parts.join(left, ["conv", "number"]).select("conv", "block", "right", F.element_at("carry", 1).alias("state")), "placed")
    known = fitting(placed.select(F.col("conv").alias("c"), F.col("block").alias("b"), "right", "state"))
    both = cut.join(known, (F.col("conv") == F.col("c")) & (F.col("block") == F.col("b")), "left")
    return both.select("conv", *KEY, "codes", letters("codes", F.coalesce("right", closing), F.coalesce("state", F.lit(0).cast("long"))).alias("letters"))


RESULT = "conv string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
SPACE = " \t\n\x0b\x0c\r"


class Repair:
    """What has been read of a conversation."""

    def __init__(self, conv: str):
        self.conv, self.turns, self.seen, self.faults, self.illegal, self.cost = conv, 0, [None, None], [0, 0, 0], 0, 0
        self.audit, self.hash, self.state, self.any, self.before, self.key, self.wanted = [], hashlib.sha256(), 0, False, None, None, iter(())

    def put(self, role: str, text: str) -> None:
        self.hash.update(f"{chr(10) if self.any else ''}{role}:{text}".encode())
        self.any = True

    def insert(self) -> None:
        self.state = int(AFTER_TURN[self.state])
        self.put("user" if self.state == 2 else "assistant", "")
        self.cost += INSERT

    def add(self, turn: int | None, role: str, digest: bytes, text: str) -> None:
        start, core = role[:1], text.rstrip(SPACE)
        if self.before is not None and self.before + start not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = start
        again = (turn, role, digest) == self.key
        if turn is not None and self.seen[1] != turn:
            self.turns += 1
            self.seen = [turn if self.seen[0] is None else self.seen[0], turn]
        self.key = turn, role, digest
        code, edit = (MUST_GO, "D") if again else next(self.wanted)
        self.faults[0 if not core else 1 if code & MUST_GO else 2] += 1 if not core or code & (MUST_GO | TRUNCATED) else 0
        for letter in edit:
            if letter == "I":
                self.insert()
            elif letter == "D":
                self.cost += DELETE
            else:
                if letter == "R":
                    self.state = int(AFTER_TURN[self.state])
                    role = "user" if self.state == 2 else "assistant"
                else:
                    self.state = int(AFTER_KEPT[self.state][INITIALS.index(start)])
                self.cost += (REROLE if letter == "R" else KEEP) + (CUT if code & TRUNCATED else 0)
                self.put(role, text)
        self.audit.append(edit)

    def result(self) -> tuple:
        for _ in CLOSED_BY[self.state]:
            self.insert()
            self.audit.append("I")
        gaps = 0 if self.seen[0] is None else self.seen[1] - self.seen[0] + 1 - self.turns
        return self.conv, gaps, *self.faults, self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest()


def repaired(turns: DataFrame, conversations: DataFrame | None = None, block: int = BLOCK, fan_in: int = FAN_IN) -> DataFrame:
    """Faults, cost, audit and digest of the repair of each conversation in turns (conv_id, turn, role, text), and in conversations (conv_id)."""
    rows = keyed(turns)
    cut = stage(blocks(coded(rows), block), "blocks")
    # a block's codes and letters come right before its first row
    marks = edits(cut, fan_in).select("conv", *KEY, F.lit(0).alias("kind"), "codes", F.col("letters").alias("text"))
    texts = rows.select("conv", *KEY, F.lit(1).alias("kind"), F.lit(None).cast("binary").alias("codes"), "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Repair | None = None
        for batch in batches:
            out = []
            for conv, turn, role, digest, kind, codes, text in batch[["conv", *KEY, "kind", "codes", "text"]].itertuples(index=False):
                if held is None or held.conv != conv:
                    if held:
                        out.append(held.result())
                    held = Repair(conv)
                if kind == 0:
                    held.wanted = zip(codes, text.split(","), strict=True)
                else:
                    held.add(None if turn is None else int(turn), role, digest, text)
            yield pd.DataFrame(out, columns=[c.split(" ")[0] for c in RESULT.split(", ")])
        if held:
            yield pd.DataFrame([held.result()], columns=[c.split(" ")[0] for c in RESULT.split(", ")])

    stream = marks.unionByName(texts).repartition("conv").sortWithinPartitions("conv", *KEY, "kind")
    found = stream.withColumn("turn", F.col("turn").cast("string")).mapInPandas(run, RESULT)
    every = turns.select("conv_id").unionByName(conversations.select("conv_id")) if conversations is not None else turns.select("conv_id")
    every = every.distinct().withColumn("conv", F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")))
    numbers = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    empty = hashlib.sha256().hexdigest()
    return every.join(found, "conv", "left").select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))
